"""Queries over spans, operators and objects as tables: joins, windows, recursion and ordered
folds, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesift.functions import sql, syntax
from pagesift.operators import cluster, content, merge, nearest, objects
from pagesift.plans import fixtures
from pagesift.plans import oracles as O

_P = "doc_id, page_no"


def _read(spark, sf, name):
    return fixtures.table(spark, sf, name)


def _long(name):
    return F.col(name).cast("long").alias(name)


def _flat(pages, *key):
    # an inner explode gets a filter on size and null, pushed down with two more copies of what makes the spans
    s = F.col("s")
    return pages.select(*key, F.explode_outer("spans").alias("s")).where("s is not null").select(*key, s["ord"].cast("long").alias("ord"), s["text"].alias("text"), F.round(s["x"], 6).alias("x"), F.round(s["y"], 6).alias("y"), s["font_size"].alias("font_size"), s["font_name"].alias("font_name"))


def _merged(name: str):
    return lambda spark, sf: _flat(merge.merged_pages(fixtures.pages(spark, sf, name)), "doc_id", "page_no")


def _merge_sql(name: str, joint: str) -> str:
    """Gaps and islands over the fixture, whose pages are of one font and size: a width
    is 5, and a line is one y."""
    return (
        O.with_(O.spans(name))
        + f""", n AS (SELECT *, row_number() OVER w AS k, lag(x) OVER w AS px, lag(y) OVER w AS py, length(lag(text) OVER w) AS pn FROM spans WINDOW w AS (PARTITION BY {_P} ORDER BY y DESC, x, ord)),
g AS (SELECT *, x - (px + pn * 5) AS gap FROM n),
j AS (SELECT *, CASE WHEN px IS NULL OR y <> py THEN NULL ELSE {joint} END AS between_t FROM g),
s AS (SELECT *, sum(CASE WHEN between_t IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY {_P} ORDER BY k) AS island FROM j)
SELECT {_P}, island::BIGINT - 1 AS ord, string_agg(CASE WHEN between_t IS NULL THEN '' ELSE between_t END || text, '' ORDER BY k) AS text, round(arg_min(x, k), 6) AS x, round(arg_min(y, k), 6) AS y, any_value(font_size) AS font_size, any_value(font_name) AS font_name
FROM s GROUP BY {_P}, island"""
    )


_SINGLE = "CASE WHEN gap > -15 AND gap < 15 THEN '' END"
_MULTI = "CASE WHEN gap > -10 AND gap < 4 THEN '' WHEN gap < 10 THEN ' ' END"

#: The same fold step by step: the head and the last span go down the recursion.
_MIXED_SQL = (
    O.with_(O.spans("spans_mixed"))
    + f""", n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {_P} ORDER BY (ord - 1) // 12, x, ord) AS k FROM spans),
f AS (
  SELECT {_P}, k, 0::BIGINT AS island, '' AS between_t, x AS hx, y AS hy, font_size AS hs, font_name AS hf, x AS px, length(text)::BIGINT AS pn FROM n WHERE k = 1
  UNION ALL
  SELECT doc_id, page_no, k, CASE WHEN b IS NULL THEN island + 1 ELSE island END, coalesce(b, ''), CASE WHEN b IS NULL THEN x ELSE hx END, CASE WHEN b IS NULL THEN y ELSE hy END,
         CASE WHEN b IS NULL THEN font_size ELSE hs END, CASE WHEN b IS NULL THEN font_name ELSE hf END, x, length(text)
  FROM (SELECT n.*, f.island, hx, hy, hs, hf, CASE WHEN abs(n.y - hy) > 0.3 * hs OR hf <> n.font_name THEN NULL
          WHEN pn <= 1 AND length(n.text) <= 1 THEN CASE WHEN abs(n.x - (px + pn * hs * 0.5)) < 1.5 * hs THEN '' END
          WHEN n.x - (px + pn * hs * 0.5) < 0.4 * hs AND n.x - (px + pn * hs * 0.5) > -hs THEN '' WHEN n.x - (px + pn * hs * 0.5) < hs THEN ' ' END AS b
        FROM f JOIN n ON n.doc_id = f.doc_id AND n.page_no = f.page_no AND n.k = f.k + 1) j)
SELECT {_P}, island AS ord, string_agg(between_t || text, '' ORDER BY k) AS text, round(any_value(hx), 6) AS x, round(any_value(hy), 6) AS y, any_value(hs) AS font_size, any_value(hf) AS font_name
FROM f JOIN n USING ({_P}, k) GROUP BY {_P}, island"""
)


#: A content stream as operators: op, numbers, name, text, items (string or kerning), all SQL.
_OPERATORS = [
    ("q",), ("BT",), ("Tf", "10", "F1"), ("TL", "14"), ("Td", "50, 700 - p_partkey % 7"), ("Tj", "", "", "p_type"), ("Tj", "", "", "'end'"), ("T*",), ("Tj", "", "", "'second'"),
    ("TD", "5, -20"), ("Tj", "", "", "p_name"), ("'", "", "", "'quoted'"),
    ("q",), ("Tf", "8 + p_partkey % 3", "F2"), ("Tj", "", "", "'in'"), ("q",), ("Tm", "1, 0, 0, 1, p_partkey % 9, 5"), ('"', "1, 2", "", "'deep'"), ("Q",), ("Tj", "", "", "'back'"), ("Q",), ("Tj", "", "", "'out'"),
    ("Tm", "1, 0, 0, 1, 30, 40"), ("TJ", "", "", "", [("'a'", ""), ("", "-100"), ("'b'", ""), ("", "-300"), ("'c'", "")]), ("TJ", "", "", "", [("", "-500"), ("p_brand", "")]),
    ("ET",), ("Q",), ("Tj", "", "", "'after'"), ("Q",), ("Do", "", "Im1"), ("Tj", "", "", "'   '"), ("Td", "7"), ("Tj", "", "", "''"),
]


def _operator(seq, op, nums="", name="", text="", items=()):
    number = lambda v: f"cast({v} AS DOUBLE)"
    listed = ", ".join(f"named_struct('text', {t or 'cast(null AS STRING)'}, 'kern', {number(k or 'null')})" for t, k in items)
    quoted = op.replace("'", "\\'")
    return (
        f"named_struct('seq', {seq}, 'op', '{quoted}', 'nums', cast(array({', '.join(map(number, nums.split(', '))) if nums else ''}) AS array<double>), 'name', {repr(name) if name else 'cast(null AS STRING)'},"
        f" 'text', {text or 'cast(null AS STRING)'}, 'items', {f'array({listed})' if items else 'cast(null AS array<struct<text:string,kern:double>>)'})"
    )


def operator_spans(spark, sf):
    """A page of each part from its table of operators."""
    rows = F.expr("array(" + ", ".join(_operator(i, *o) for i, o in enumerate(_OPERATORS)) + ")")
    table = _read(spark, sf, "part").select("p_partkey", F.explode(rows).alias("o")).select("p_partkey", "o.*")
    return _flat(content.pages_of_operators(table, "p_partkey"), "p_partkey")


_SIZE = "8 + p_partkey % 3"
_SHOWN = [
    ("p_type", "50", "b", "10", "'F1'"), ("'end'", "50 + 5 * length(p_type)", "b", "10", "'F1'"), ("'second'", "50", "b - 14", "10", "'F1'"), ("p_name", "55", "b - 34", "10", "'F1'"), ("'quoted'", "55", "b - 54", "10", "'F1'"),
    ("'in'", "85", "b - 54", _SIZE, "'F2'"), ("'deep'", "p_partkey % 9", "-15", _SIZE, "'F2'"), ("'back'", f"85 + ({_SIZE})", "b - 54", _SIZE, "'F2'"), ("'out'", "85", "b - 54", "10", "'F1'"),
    ("'ab'", "30", "40", "10", "'F1'"), ("'c'", "44", "40", "10", "'F1'"), ("p_brand", "54", "40", "10", "'F1'"), ("'after'", "0", "0", "12", "NULL"), ("' '", "30", "0", "12", "NULL"),
]
_OPERATOR_SQL = "WITH p AS (SELECT *, 700 - p_partkey % 7 AS b FROM part) " + " UNION ALL ".join(
    f"SELECT p_partkey, {i}::BIGINT AS ord, {t} AS text, ({x})::DOUBLE AS x, ({y})::DOUBLE AS y, ({s})::DOUBLE AS font_size, {f}::VARCHAR AS font_name FROM p" for i, (t, x, y, s, f) in enumerate(_SHOWN)
)


def assign_columns_join(spark, sf):
    """The cells of :func:`assign_columns` from long tables."""
    S = F.col("spans")
    pages = fixtures.pages(spark, sf, "spans_lineitem").select("doc_id", "page_no", cluster.drop_blank(S).alias("spans"))
    side = "array<struct<row_idx:bigint,pos:int,x:double,text:string,col_idx:bigint,is_mark:boolean>>"
    point = lambda i: lambda s, pos: F.struct(i, pos, s["x"], s["text"], F.lit(None), F.lit(False))
    points = F.flatten(F.transform(cluster.cluster_rows(S, cluster.row_tolerance(S)), lambda r, i: F.transform(cluster.by_x(r), point(i))))
    marks = F.transform(cluster.detect_columns(S), lambda x, i: F.struct(F.lit(None), F.lit(None), x, F.lit(None), i, F.lit(True)))
    # points and marks of a page leave it together, so it is made once
    sides = pages.select("doc_id", "page_no", F.explode_outer(F.concat(points.cast(side), marks.cast(side))).alias("s")).where("s is not null").select("doc_id", "page_no", "s.*")
    placed = nearest.nearest_of(sides, ["doc_id", "page_no"], "x", "col_idx", "is_mark")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda c: c["text"]), " ")
    return placed.groupBy("doc_id", "page_no", "row_idx", "col_idx").agg(text.alias("text"))


#: Objects of a customer's document are its orders, numbered from 1. An object names 2n and 2n+1,
#: but orders divisible by 5 are named by none (orphans with all below them); some name the root (a
#: cycle), some an object that isn't there.
_GRAPH = """WITH o AS (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number FROM orders)"""
_OBJECTS = "SELECT doc_id, number, o_orderkey FROM o"
_EDGES = """SELECT a.doc_id, a.number AS owner, CASE WHEN b.number % 2 = 0 THEN 'Left' ELSE 'Right' END AS k, b.number AS target FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.number = floor(b.number / 2) WHERE b.number > 1 AND b.o_orderkey % 5 <> 0
UNION ALL SELECT doc_id, number, 'Parent', 1 FROM o WHERE o_orderkey % 3 = 0
UNION ALL SELECT doc_id, number, 'Next', 1000 + number FROM o WHERE o_orderkey % 7 = 0"""


def _graph(spark, sf):
    orders = objects.view_name(spark, _read(spark, sf, "orders"))
    run = lambda sql: spark.sql(_GRAPH.replace("FROM orders", f"FROM {orders}") + " " + sql)
    return run(_OBJECTS), run(_EDGES).withColumnRenamed("k", "key")


def resolve(spark, sf):
    known, edges = _graph(spark, sf)
    return objects.resolve(edges, known).select("doc_id", _long("owner"), "key", _long("target"), "o_orderkey")


def dangling_refs(spark, sf):
    known, edges = _graph(spark, sf)
    return objects.dangling(edges, known).select("doc_id", _long("owner"), "key", _long("target"))


def reachable_objects(spark, sf):
    """Each document's objects that can be reached from its first, with their depth."""
    known, edges = _graph(spark, sf)
    found = objects.reachable(objects.resolve(edges, known), known.where("number = 1"))
    return found.select("doc_id", _long("number"), _long("depth"))


#: A tree of nodes a customer: orders again, numbered from 1, of which those with kids enter them. The
#: kids of n are 3n-1 to 3n+1 in falling order; even ones of the lowest level are no pages; every
#: node names the root as a last kid, and so ends in a cycle.
_NODES = "SELECT doc_id, number, CASE WHEN number * 3 - 1 <= max(number) OVER (PARTITION BY doc_id) OR number = 1 THEN 'Pages' WHEN number % 4 = 2 THEN 'Other' ELSE 'Page' END AS kind FROM o"
_KIDS = """SELECT a.doc_id, a.number AS parent, 9 - (b.number - 3 * a.number) AS place, b.number AS child FROM o a JOIN o b ON a.doc_id = b.doc_id AND b.number BETWEEN 3 * a.number - 1 AND 3 * a.number + 1
UNION ALL SELECT doc_id, number, 99, 1 FROM o"""


def page_order(spark, sf):
    orders = objects.view_name(spark, _read(spark, sf, "orders"))
    run = lambda sql: spark.sql(_GRAPH.replace("FROM orders", f"FROM {orders}") + " " + sql)
    nodes = run(_NODES)
    kids = run(_KIDS).selectExpr("doc_id", "parent", "cast(place AS int) AS place", "child")
    return objects.page_order(nodes, kids, nodes.where("number = 1").select("doc_id", "number")).select("doc_id", _long("number"), _long("page_no"))


_ORDER_SQL = f"""{_GRAPH.replace("WITH", "WITH RECURSIVE")}, nodes AS ({_NODES}), kids AS ({_KIDS}),
tree AS (SELECT doc_id, number, kind, '' AS path, [number] AS above FROM nodes WHERE number = 1
  UNION ALL SELECT t.doc_id, k.child, n.kind, t.path || printf('%05d', k.place::INT), list_append(t.above, k.child) FROM tree t JOIN kids k ON k.doc_id = t.doc_id AND k.parent = t.number JOIN nodes n ON n.doc_id = k.doc_id AND n.number = k.child
  WHERE t.kind = 'Pages' AND NOT list_contains(t.above, k.child))
SELECT doc_id, number::BIGINT AS number, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS page_no FROM tree WHERE kind = 'Page'"""


def xref_records(spark, sf):
    """Three records for each order in two ranges, with columns of 0 to 4 bytes, cut off in the third."""
    w1, w2, w3 = F.col("o_orderkey") % 2, F.col("o_orderkey") % 4 + 1, F.col("o_orderkey") % 3
    width = lambda c: (c * 2).cast("int")
    part = lambda value, w: F.rpad(F.lpad(F.hex(value.cast("long")), 16, "0"), 16, "0").substr(F.lit(17) - width(w), width(w))
    one = lambda kind, a, b: F.concat(part(kind, w1), part(a, w2), part(b, w3))
    a = F.col("o_orderkey") % 250
    data = F.unhex(F.concat(one(F.lit(2), a, F.lit(7)), one(F.lit(0), a + 1, F.lit(300)), one(F.lit(1), a + 2, F.lit(9)), F.when(w2 > 1, "00").otherwise("")))
    ranges = F.array(F.struct((F.col("o_custkey") * 10).cast("long").alias("first"), F.lit(2).cast("long").alias("count")), F.struct(F.lit(5).cast("long").alias("first"), F.lit(9).cast("long").alias("count")))
    rows = _read(spark, sf, "orders").select("o_orderkey", F.explode(objects.xref_records(data, F.array(*[w.cast("int") for w in (w1, w2, w3)]), ranges)).alias("r"))
    return rows.select("o_orderkey", "r.*")


_XREF_SQL = " UNION ALL ".join(
    f"SELECT o_orderkey, ({number})::BIGINT AS number, (CASE o_orderkey % 2 WHEN 0 THEN 1 ELSE {kind} END)::BIGINT AS kind, (o_orderkey % 250 + {i})::BIGINT AS a, (CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN {b} % 256 ELSE {b} END)::BIGINT AS b FROM orders"
    for i, (number, kind, b) in enumerate([("o_custkey * 10", 2, 7), ("o_custkey * 10 + 1", 0, 300), ("5", 1, 9)])
)

#: JSON of a value of each kind; the marked words are columns.
_VALUES = ["null", "true", "KEY", "KEY.5", '"NAME"', '{"/": "TYPE"}', "[KEY, [1], true]", '{"Size": KEY}', '{"stream": "PACKED", "dict": {"Length": KEY}}', '{"R": [KEY, 3]}']


def typed_values(spark, sf):
    """The nine accessors on a value of each kind for each part."""
    fill = {"KEY": F.col("p_partkey").cast("string"), "PACKED": F.base64(F.encode("p_name", "UTF-8")), "NAME": F.col("p_name"), "TYPE": F.col("p_type")}
    built = []
    for text in _VALUES:
        column = F.lit(text)
        for mark, value in fill.items():
            column = F.replace(column, F.lit(mark), value) if mark in text else column
        built.append(column)
    rows = _read(spark, sf, "part").select("p_partkey", F.posexplode(F.array(*built)).alias("i", "text")).withColumn("v", F.parse_json("text"))
    a = objects.accessors(F.col("v"))
    shown = {"as_array": F.size(a["as_array"]).cast("long"), "as_dict": F.to_json(a["as_dict"]), "as_stream": F.decode(a["as_stream"], "UTF-8"), "as_ref": F.concat_ws(" ", a["as_ref"]["number"], a["as_ref"]["generation"])}
    return rows.select("p_partkey", _long("i"), *[(F.when(c.isNotNull(), shown[n]) if n in shown else c).alias(n) for n, c in a.items()])


def _typed_sql() -> str:
    k = "p_partkey"
    rows = [{}, {"as_bool": "true"}, {"as_int": k, "as_real": f"{k}::DOUBLE"}, {"as_real": f"{k} + 0.5::DOUBLE"}, {"as_string": "p_name"}, {"as_name": "p_type"}, {"as_array": "3"}, {"as_dict": f"'{{\"Size\":' || {k} || '}}'"}, {"as_dict": f"'{{\"Length\":' || {k} || '}}'", "as_stream": "p_name"}, {"as_ref": f"{k} || ' 3'"}]
    kinds = {"as_bool": "BOOLEAN", "as_int": "BIGINT", "as_real": "DOUBLE", "as_string": "VARCHAR", "as_name": "VARCHAR", "as_array": "BIGINT", "as_dict": "VARCHAR", "as_stream": "VARCHAR", "as_ref": "VARCHAR"}
    return " UNION ALL ".join(f"SELECT p_partkey, {i}::BIGINT AS i, " + ", ".join(f"({row.get(n, 'NULL')})::{t} AS {n}" for n, t in kinds.items()) + " FROM part" for i, row in enumerate(rows))


def decode_fonts(spark, sf):
    """Texts in 50 fonts, each with its own shift of the codes, whose last code no map has."""
    shift = F.col("p_partkey") % 50
    codes = F.transform(F.split("p_name", ""), lambda c: F.lpad(F.hex(F.ascii(c) + 200 + shift), 4, "0"))
    texts = _read(spark, sf, "part").select("p_partkey", shift.alias("font"), F.unhex(F.concat(F.array_join(codes, ""), F.lit("4142"), F.when(shift % 2 == 1, "43").otherwise(""))).alias("codes"))
    fonts = _read(spark, sf, "part").select((F.col("p_partkey") % 50).alias("font")).distinct().where("font <> 7")
    maps = fonts.select("font", F.explode(F.sequence(F.lit(32), F.lit(126))).alias("c")).select("font", (F.col("c") + 200 + F.col("font")).cast("int").alias("code"), F.char("c").alias("letter"))
    return nearest.decode_codes(texts, maps, F.col("codes"), "p_partkey", "font")


_FONTS_SQL = """SELECT p_partkey, CASE WHEN p_partkey % 50 = 7 THEN list_aggregate(list_transform(string_split(p_name, ''), lambda c: chr((ascii(c) + 207) // 256) || chr((ascii(c) + 207) % 256)), 'string_agg', '') ELSE p_name END
  || 'AB' || CASE WHEN p_partkey % 2 = 1 THEN 'C' ELSE '' END AS text FROM part"""

def content_fonts(spark, sf):
    """Bytes in a Windows, a Mac, a mapped and an unknown font, from streams to joined spans."""
    stream = (
        "concat('BT /W 10 Tf 20 500 Td (', p_name, ' \\\\200\\\\351) Tj 0 -20 Td /M 10 Tf <', hex(p_type), '8E> Tj 0 -20 Td /C 10 Tf <', "
        "array_join(transform(split(p_name, ''), c -> lpad(hex(ascii(c) + 300), 4, '0')), ''), '> Tj 0 -20 Td /U 10 Tf [(', p_brand, ') 50 (\\\\200\\\\351)] TJ ET')"
    )
    cids = F.map_from_entries(F.transform(F.sequence(F.lit(32), F.lit(126)), lambda c: F.struct((c + 300).alias("k"), F.char(c).alias("v"))))
    font = lambda name, encoding, cids=None: (F.lit(name), F.struct(F.lit(encoding).alias("encoding"), (F.create_map().cast("map<int,string>") if cids is None else cids).alias("cids")))
    fonts = F.create_map(*font("W", "WinAnsiEncoding"), *font("M", "MacRomanEncoding"), *font("C", "WinAnsiEncoding", cids))
    rows = _read(spark, sf, "part").select("p_partkey", F.expr(f"encode({stream}, 'ISO-8859-1')").alias("content"))
    return _flat(rows.select("p_partkey", merge.merge_spans(content.content_spans(F.col("content"), fonts)).alias("spans")), "p_partkey")


_CONTENT_FONTS_SQL = " UNION ALL ".join(
    f"SELECT p_partkey, {i}::BIGINT AS ord, {text} AS text, 20::DOUBLE AS x, {500 - 20 * i}::DOUBLE AS y, 10::DOUBLE AS font_size, '{font}' AS font_name FROM part"
    for i, (font, text) in enumerate([("W", "p_name || ' ' || chr(8364) || chr(233)"), ("M", "p_type || chr(233)"), ("C", "p_name"), ("U", "p_brand || ' ' || chr(233)")])
)


def parse_object(spark, sf):
    """Objects from their text, nested, with comments, escapes and references."""
    body = "concat('<< /Type /Part % a comment\\n /Name (', p_name, ' \\\\(x\\\\)) /K#65y ', p_partkey, ' /Half ', p_partkey, '.5 /Tags [/A', p_partkey % 9, ' (', p_type, ') null true <4869> << /In [', p_partkey, ' 0 R 7] >>] /Next ', p_partkey + 1, ' 2 R >>')"
    v = F.col("v")
    get = lambda path, to="string": F.try_variant_get(v, path, to)
    rows = _read(spark, sf, "part").select("p_partkey", syntax.parse_object(F.expr(body)).alias("v"))
    return rows.select(
        "p_partkey", get('$.Type["/"]').alias("type"), get("$.Name").alias("name"), get("$.Key", "bigint").alias("key"), get("$.Half", "double").alias("half"), get('$.Tags[0]["/"]').alias("tag"),
        get("$.Tags[1]").alias("words"), get("$.Tags[3]", "boolean").alias("flag"), get("$.Tags[4]").alias("hex"), get("$.Tags[5].In[0].R[0]", "bigint").alias("inner_ref"), get("$.Next.R[0]", "bigint").alias("next_ref"), get("$.Next.R[1]", "bigint").alias("generation"),
    )


_OBJECT_SQL = """SELECT p_partkey, 'Part' AS type, p_name || ' (x)' AS name, p_partkey AS key, p_partkey + 0.5::DOUBLE AS half, 'A' || p_partkey % 9 AS tag, p_type AS words, true AS flag, 'Hi' AS hex,
p_partkey AS inner_ref, p_partkey + 1 AS next_ref, 2::BIGINT AS generation FROM part"""


def object_page_order(spark, sf):
    """The trees of :func:`page_order` from the text of their objects."""
    orders = objects.view_name(spark, _read(spark, sf, "orders"))
    run = lambda sql: spark.sql(_GRAPH.replace("FROM orders", f"FROM {orders}") + " " + sql)
    kids = run(_KIDS).groupBy("doc_id", F.col("parent").alias("number")).agg(F.sort_array(F.collect_list(F.struct("place", "child"))).alias("kids"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("kids", lambda k: F.concat(k["child"].cast("string"), F.lit(" 0 R"))), " "), F.lit("]"))
    text = F.concat(F.lit("<< /Type /"), "kind", F.lit(" /Kids "), F.coalesce(listed, F.lit("[]")), F.lit(" >>"))
    values = run(_NODES).join(kids, ["doc_id", "number"], "left").select("doc_id", F.col("number").cast("long").alias("number"), syntax.parse_object(text).alias("value"))
    nodes, edges = objects.kids_of(values)
    return objects.page_order(nodes, edges, nodes.where("number = 1").select("doc_id", "number")).select("doc_id", _long("number"), _long("page_no"))


def xref_table(spark, sf):
    """A section of two parts for each order."""
    text = F.format_string("xref\n0 1\n0000000000 65535 f \n%d 3\n%010d 00000 n \n%010d 00003 f\r\n%010d 00001 n \ntrailer\n<< /Size 9 >>", F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderkey") + 1, F.col("o_orderkey") + 2)
    return _read(spark, sf, "orders").select("o_orderkey", F.explode(objects.xref_table(text)).alias("r")).select("o_orderkey", "r.number", "r.offset", F.col("r.generation").cast("long").alias("generation"), "r.in_use")


_XREF_TABLE_SQL = " UNION ALL ".join(
    f"SELECT o_orderkey, ({number})::BIGINT AS number, ({at})::BIGINT AS \"offset\", {generation}::BIGINT AS generation, {used} AS in_use FROM orders"
    for number, at, generation, used in [("0", "0", 65535, "false"), ("o_custkey", "o_orderkey", 0, "true"), ("o_custkey + 1", "o_orderkey + 1", 3, "false"), ("o_custkey + 2", "o_orderkey + 2", 1, "true")]
)


def find_startxref(spark, sf):
    """The last of two offsets, with a file's length of padding before them and blanks after."""
    text = F.concat(F.lit("%PDF-1.7\nstartxref\n1\n%%EOF\n"), F.repeat(F.lit("x"), (F.col("p_partkey") % 3000).cast("int")), F.lit("startxref \r\n"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise("\n%%EOF\n"))
    return _read(spark, sf, "part").select("p_partkey", objects.startxref(F.encode(text, "UTF-8")).alias("at"))


def _called(fixture: str, *functions: str):
    """SQL functions applied one to the other's result, from SQL text."""

    def run(spark, sf):
        sql.register(spark, *functions)
        call = "spans"
        for f in functions:
            call = f"{f}({call})"
        return spark.sql(f"SELECT doc_id, page_no, {call} AS body FROM {objects.view_name(spark, fixtures.pages(spark, sf, fixture))}")

    return run


def sql_decoders(spark, sf):
    """Code pages and hexadecimal text through the functions of that name."""
    sql.register(spark, "decode_winansi", "decode_macroman", "ascii_hex_decode", "format_size")
    part = objects.view_name(spark, _read(spark, sf, "part"))
    return spark.sql(
        f"""SELECT p_partkey, decode_winansi(encode(p_name, 'ISO-8859-1')) AS win, decode_macroman(encode(p_type, 'ISO-8859-1')) AS mac,
        decode(ascii_hex_decode(concat(hex(p_brand), '>')), 'UTF-8') AS brand, format_size(p_partkey * 100) AS size FROM {part}"""
    )


QUERIES = {
    "merge_spans_chars": _merged("spans_chars"),
    "merge_spans_words": _merged("spans_words"),
    "merge_spans_mixed": _merged("spans_mixed"),
    "operator_spans": operator_spans,
    "assign_columns_join": assign_columns_join,
    "resolve": resolve,
    "dangling_refs": dangling_refs,
    "reachable_objects": reachable_objects,
    "page_order": page_order,
    "xref_records": xref_records,
    "typed_values": typed_values,
    "decode_fonts": decode_fonts,
    "content_fonts": content_fonts,
    "parse_object": parse_object,
    "object_page_order": object_page_order,
    "xref_table": xref_table,
    "find_startxref": find_startxref,
    "sql_to_csv": _called("spans_lineitem", "spans_to_csv"),
    "sql_to_markdown": _called("spans_statement", "spans_elements", "elements_to_markdown"),
    "sql_to_txt": _called("spans_statement", "spans_elements", "elements_to_txt"),
    "sql_merged_to_text": _called("spans_mixed", "spans_merge", "spans_page_text"),
    "sql_decoders": sql_decoders,
}

ORACLES = {
    "merge_spans_chars": _merge_sql("spans_chars", _SINGLE),
    "merge_spans_words": _merge_sql("spans_words", f"CASE WHEN pn <= 1 AND length(text) <= 1 THEN {_SINGLE} ELSE {_MULTI} END"),
    "merge_spans_mixed": _MIXED_SQL,
    "operator_spans": _OPERATOR_SQL,
    "assign_columns_join": O.table_rows("spans_lineitem") + f"SELECT {_P}, row_idx, col_idx, text FROM tfull",
    "resolve": f"{_GRAPH}, e AS ({_EDGES}) SELECT e.doc_id, owner::BIGINT AS owner, k AS key, target::BIGINT AS target, o_orderkey FROM e JOIN o ON o.doc_id = e.doc_id AND o.number = e.target",
    "dangling_refs": f"{_GRAPH}, e AS ({_EDGES}) SELECT e.doc_id, owner::BIGINT AS owner, k AS key, target::BIGINT AS target FROM e WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = e.doc_id AND o.number = e.target)",
    "reachable_objects": f"""{_GRAPH.replace("WITH", "WITH RECURSIVE")}, e AS ({_EDGES}),
r AS (SELECT doc_id, number, 0 AS depth FROM o WHERE number = 1 UNION SELECT e.doc_id, e.target, r.depth + 1 FROM r JOIN e ON e.doc_id = r.doc_id AND e.owner = r.number JOIN o ON o.doc_id = e.doc_id AND o.number = e.target WHERE r.depth < 40 AND k <> 'Parent')
SELECT doc_id, number::BIGINT AS number, min(depth)::BIGINT AS depth FROM r GROUP BY doc_id, number""",
    "page_order": _ORDER_SQL,
    "xref_records": _XREF_SQL,
    "typed_values": _typed_sql(),
    "decode_fonts": _FONTS_SQL,
    "content_fonts": _CONTENT_FONTS_SQL,
    "parse_object": _OBJECT_SQL,
    "object_page_order": _ORDER_SQL,
    "xref_table": _XREF_TABLE_SQL,
    "find_startxref": "SELECT p_partkey, p_partkey AS at FROM part",
    "sql_to_csv": O.table_rows("spans_lineitem") + f", l AS (SELECT {_P}, row_idx, string_agg({O.CSV_CELL}, ',' ORDER BY col_idx) AS line FROM tcells GROUP BY {_P}, row_idx) SELECT {_P}, string_agg(line, chr(10) ORDER BY row_idx) AS body FROM l GROUP BY {_P}",
    "sql_to_markdown": O.with_(*O.elements("spans_statement")) + f"SELECT {_P}, md AS body FROM pages_out",
    "sql_to_txt": O.with_(*O.elements("spans_statement")) + f"SELECT {_P}, txt AS body FROM pages_out",
    # within the page's text tolerance of 3 each line of the fixture is one row
    "sql_merged_to_text": f"SELECT {_P}, string_agg(line, chr(10) ORDER BY l) AS body FROM (SELECT {_P}, l, string_agg(text, ' ' ORDER BY y DESC, x, ord) AS line FROM (SELECT *, floor((703 - y) / 20) AS l FROM ({_MIXED_SQL}) m) g GROUP BY {_P}, l) t GROUP BY {_P}",
    "sql_decoders": "SELECT p_partkey, p_name AS win, p_type AS mac, p_brand AS brand, CASE WHEN p_partkey * 100 < 1024 THEN p_partkey * 100 || ' B' WHEN p_partkey * 100 < 1048576 THEN printf('%.1f KB', floor(p_partkey * 1000 / 1024.0 + 0.5) / 10) ELSE printf('%.1f MB', floor(p_partkey * 1000 / 1048576.0 + 0.5) / 10) END AS size FROM part",
}
