"""SQL of another formulation than the queries': recursive CTEs for the anchored
clusters, ``lag`` with running sums for the chained ones, ``string_agg`` for joins."""

from __future__ import annotations

from pagesift.functions.text import WHITE
from pagesift.plans.fixtures import ALL, duck_sql

def trim(c: str) -> str:
    return f"regexp_replace({c}, '^[{WHITE}]+|[{WHITE}]+\\z', '', 'g')"


def trim_end(c: str) -> str:
    return f"regexp_replace({c}, '[{WHITE}]+\\z', '')"


def spans(name: str) -> str:
    return f"spans AS ({duck_sql(ALL[name])}),\nkept AS (SELECT * FROM spans WHERE {trim('text')} <> '')"


def rows(p: str, source: str, keys: str, tolerance: str | None = None) -> str:
    """``{p}rows``: source with ``row_idx`` (anchored on the row's first y) and ``pos`` by x."""
    k = keys.split(", ")
    on = " AND ".join(f"r.{c} = s.{c}" for c in k)
    tol = f"SELECT {keys}, {tolerance or 'avg(font_size) * 0.5'} AS tol FROM {source} GROUP BY {keys}"
    return f"""{p}tol AS ({tol}),
{p}s AS MATERIALIZED (SELECT a.*, tol, row_number() OVER (PARTITION BY {", ".join("a." + c for c in k)} ORDER BY y DESC, x, ord) AS idx FROM {source} a JOIN {p}tol USING ({keys})),
{p}r AS (
  SELECT {keys}, idx, y AS at, 0::BIGINT AS row_idx FROM {p}s WHERE idx = 1
  UNION ALL
  SELECT {", ".join("s." + c for c in k)}, s.idx, CASE WHEN abs(s.y - r.at) <= s.tol THEN r.at ELSE s.y END, r.row_idx + CASE WHEN abs(s.y - r.at) <= s.tol THEN 0 ELSE 1 END
  FROM {p}r r JOIN {p}s s ON {on} AND s.idx = r.idx + 1),
{p}rows AS MATERIALIZED (SELECT s.*, r.row_idx, row_number() OVER (PARTITION BY {", ".join("s." + c for c in k)}, r.row_idx ORDER BY s.x, s.idx) AS pos FROM {p}s s JOIN {p}r r USING ({keys}, idx))"""


def clusters(p: str, source: str, keys: str) -> str:
    """``{p}nx``: anchored x clusters of each row of ``source``."""
    k = [*keys.split(", "), "row_idx"]
    on = " AND ".join(f"r.{c} = s.{c}" for c in k)
    cols = ", ".join(k)
    return f"""{p}xs AS (SELECT {cols}, x, row_number() OVER (PARTITION BY {cols} ORDER BY x) AS j FROM {source}),
{p}xr AS (
  SELECT {cols}, j, x AS at, 1::BIGINT AS n FROM {p}xs WHERE j = 1
  UNION ALL
  SELECT {", ".join("s." + c for c in k)}, s.j, CASE WHEN abs(s.x - r.at) > 10 THEN s.x ELSE r.at END, r.n + CASE WHEN abs(s.x - r.at) > 10 THEN 1 ELSE 0 END
  FROM {p}xr r JOIN {p}xs s ON {on} AND s.j = r.j + 1),
{p}nx AS (SELECT {cols}, max(n) AS clusters FROM {p}xr GROUP BY {cols})"""


def columns(p: str, source: str, keys: str) -> str:
    """``{p}cols``: chained clusters of x over a page."""
    return f"""{p}b AS (SELECT {keys}, x, CASE WHEN x - lag(x) OVER w <= 10 THEN 0 ELSE 1 END AS new FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY x)),
{p}g AS (SELECT {keys}, x, sum(new) OVER (PARTITION BY {keys} ORDER BY x, new DESC ROWS UNBOUNDED PRECEDING) - 1 AS col_idx FROM {p}b),
{p}cols AS MATERIALIZED (SELECT {keys}, col_idx::BIGINT AS col_idx, avg(x) AS cx FROM {p}g GROUP BY {keys}, col_idx)"""


def grid(p: str, source: str, keys: str) -> str:
    """``{p}cells``: every cell of every row, empty ones too."""
    return f"""{columns(p, source, keys)},
{p}near AS (SELECT a.*, c.col_idx, row_number() OVER (PARTITION BY {", ".join("a." + c for c in keys.split(", "))}, a.idx ORDER BY abs(a.x - c.cx), c.col_idx) AS pick FROM {p}rows a JOIN {p}cols c USING ({keys})),
{p}full AS MATERIALIZED (SELECT {keys}, row_idx, col_idx, string_agg(text, ' ' ORDER BY pos) AS text FROM {p}near WHERE pick = 1 GROUP BY {keys}, row_idx, col_idx),
{p}cells AS MATERIALIZED (SELECT {keys}, row_idx, col_idx, coalesce(f.text, '') AS text FROM (SELECT DISTINCT {keys}, row_idx FROM {p}rows) JOIN {p}cols USING ({keys}) LEFT JOIN {p}full f USING ({keys}, row_idx, col_idx))"""


def table_text(p: str, keys: str) -> str:
    """``{p}text``: the grid as padded text; ``{p}md``: as a pipe table."""
    return f"""{p}w AS (SELECT {keys}, col_idx, max(length(text)) AS w, greatest(3, max(length(replace(text, '|', '\\|')))) AS mw FROM {p}cells GROUP BY {keys}, col_idx),
{p}l AS (SELECT {keys}, row_idx, {trim_end("string_agg(rpad(text, w::INT, ' '), '  ' ORDER BY col_idx)")} AS line, '| ' || string_agg(rpad(replace(text, '|', '\\|'), mw::INT, ' '), ' | ' ORDER BY col_idx) || ' |' AS bars,
  '| ' || string_agg(repeat('-', mw::INT), ' | ' ORDER BY col_idx) || ' |' AS rule FROM {p}cells JOIN {p}w USING ({keys}, col_idx) GROUP BY {keys}, row_idx),
{p}text AS (SELECT {keys}, string_agg(line, chr(10) ORDER BY row_idx) AS body, string_agg(CASE WHEN row_idx = 0 THEN bars || chr(10) || rule ELSE bars END, chr(10) ORDER BY row_idx) AS md FROM {p}l GROUP BY {keys})"""


PAGE = "doc_id, page_no"
CSV_CELL = "CASE WHEN regexp_matches(text, '[,\"\\n\\r]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END"


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def table_rows(name: str) -> str:
    return with_(spans(name), rows("t", "kept", PAGE), grid("t", "trows", PAGE))


BODY = f"body AS (SELECT {PAGE}, k / 2.0 AS size FROM (SELECT {PAGE}, k, row_number() OVER (PARTITION BY {PAGE} ORDER BY n DESC, k DESC) AS pick FROM (SELECT {PAGE}, round(font_size * 2)::INT AS k, sum(length(text)) AS n FROM kept GROUP BY {PAGE}, k)) WHERE pick = 1)"

LINES = f"""lines AS (SELECT {PAGE}, row_idx, avg(y) AS y, max(font_size) / any_value(size) AS ratio, any_value(clusters) AS clusters, string_agg({trim("text")}, ' ' ORDER BY pos) AS text, any_value(size) AS size
  FROM trows JOIN body USING ({PAGE}) JOIN xnx USING ({PAGE}, row_idx) GROUP BY {PAGE}, row_idx),
kinds AS (SELECT *, CASE WHEN ratio >= 1.3 AND clusters <= 2 THEN 'heading' WHEN clusters >= 3 THEN 'table_candidate' ELSE 'paragraph' END AS kind,
  (CASE WHEN ratio >= 1.3 AND clusters <= 2 THEN CASE WHEN ratio >= 1.8 THEN 1 WHEN ratio >= 1.4 THEN 2 ELSE 3 END ELSE 0 END)::BIGINT AS level FROM lines)"""

ELEMENTS = f"""flags AS (SELECT *, CASE WHEN kind = 'heading' OR lag(kind) OVER w IS NULL OR lag(kind) OVER w <> kind OR (kind = 'paragraph' AND abs(lag(y) OVER w - y) > size * 1.5) THEN 1 ELSE 0 END AS new FROM kinds WINDOW w AS (PARTITION BY {PAGE} ORDER BY row_idx)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY {PAGE} ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS run FROM flags),
els AS (SELECT {PAGE}, run, any_value(kind) AS kind0, max(level) AS level, string_agg(text, ' ' ORDER BY row_idx) AS text, any_value(kind) = 'table_candidate' AND (count(*) >= 2 OR max(clusters) >= 4) AS is_table FROM runs GROUP BY {PAGE}, run),
elems AS (SELECT {PAGE}, row_number() OVER (PARTITION BY {PAGE} ORDER BY run) - 1 AS el_idx, run, CASE WHEN is_table THEN 'table' WHEN kind0 = 'heading' THEN 'heading' ELSE 'paragraph' END AS kind, level, CASE WHEN NOT is_table THEN text END AS text FROM els WHERE is_table OR kind0 = 'heading' OR {trim("text")} <> ''),
tspans AS (SELECT a.doc_id, a.page_no, b.run, a.text, a.x, a.y, a.font_size, row_number() OVER (PARTITION BY a.doc_id, a.page_no, b.run ORDER BY a.row_idx, a.pos) AS ord
  FROM trows a JOIN runs b USING ({PAGE}, row_idx) JOIN elems e ON e.doc_id = a.doc_id AND e.page_no = a.page_no AND e.run = b.run AND e.kind = 'table')"""


def classified(name: str) -> list[str]:
    return [spans(name), rows("t", "kept", PAGE), clusters("x", "trows", PAGE), BODY, LINES]


def elements(name: str) -> list[str]:
    key = PAGE + ", run"
    rendered = f"""shown AS (SELECT {PAGE}, el_idx, kind, level, text, CASE WHEN kind = 'table' THEN b.body ELSE text END AS txt,
      CASE kind WHEN 'table' THEN b.md WHEN 'heading' THEN repeat('#', level::INT) || ' ' || text ELSE text END AS md FROM elems LEFT JOIN etext b USING ({key})),
pages_out AS (SELECT {PAGE}, {trim_end("string_agg(txt, chr(10) || chr(10) ORDER BY el_idx)")} || chr(10) AS txt, {trim_end("string_agg(md, chr(10) || chr(10) ORDER BY el_idx)")} || chr(10) AS md FROM shown GROUP BY {PAGE})"""
    return [*classified(name), ELEMENTS, rows("e", "tspans", key), grid("e", "erows", key), table_text("e", key), rendered]
