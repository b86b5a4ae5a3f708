"""Operators for large training-corpus pipelines.

Nothing else in the package imports this subpackage; ``__spark_entry__.py`` adds
its queries when it can be imported.
"""
