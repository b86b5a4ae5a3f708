import sys

from pagesift.api import main

sys.exit(main())
