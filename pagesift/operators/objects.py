"""References between objects as relations: joins, reachability, page order, binary
cross-reference records and typed access to values."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.text import let
from pagesift.sources.shared import scratch_folder


def resolve(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """``doc_id, owner, key, target`` with the target's columns of ``objects`` (``doc_id,
    number, ...``); a hash join on document and number, dangling references left out."""
    return edges.join(objects.withColumnRenamed("number", "target"), ["doc_id", "target"])


def dangling(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """The references whose target is no object of the document."""
    return edges.join(objects.select("doc_id", F.col("number").alias("target")), ["doc_id", "target"], "left_anti")


def _saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, its lineage cut."""
    path = scratch_folder(df.sparkSession, "objects")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``doc_id, number, depth``: objects that can be reached from ``roots`` (``doc_id, number``),
    each at its least depth. Breadth first over all documents at once: a round joins the last
    front with the references and keeps what is new, so cycles end and the number of rounds is the
    longest shortest path."""
    front = _saved(roots.select("doc_id", "number").distinct().withColumn("depth", F.lit(0)))
    seen, depth = front, 0
    steps = edges.select("doc_id", F.col("owner").alias("number"), "target").distinct()
    while front.take(1):
        depth += 1
        found = front.join(steps, ["doc_id", "number"]).select("doc_id", F.col("target").alias("number")).distinct()
        front = _saved(found.join(seen, ["doc_id", "number"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front)
    return seen


def page_order(nodes: DataFrame, kids: DataFrame, roots: DataFrame) -> DataFrame:
    """``doc_id, number, page_no`` of the pages of each tree, in order, by a recursive query.

    ``nodes`` is ``doc_id, number, kind``, ``kids`` is ``doc_id, parent, place, child``, ``roots`` is
    ``doc_id, number``. A node of kind ``Page`` is a leaf, one of kind ``Pages`` is entered, others are
    skipped. A page that two parents name counts for both; a kid that is its own ancestor is
    not entered again."""
    spark = nodes.sparkSession
    names = {n: f"_{n}_{uuid.uuid4().hex}" for n in ("nodes", "kids", "roots")}
    for df, name in zip((nodes, kids, roots), names.values(), strict=True):
        _saved(df).createOrReplaceTempView(name)  # each level of the recursion reads them again
    # a tree is as large as it is: no limit on its rows, and one on its depth by the guard
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "-1")
    return spark.sql(
        f"""
        WITH RECURSIVE tree(doc_id, number, kind, path, above) AS (
          SELECT r.doc_id, r.number, n.kind, cast(array() AS array<int>), array(r.number)
          FROM {names["roots"]} r JOIN {names["nodes"]} n ON n.doc_id = r.doc_id AND n.number = r.number
          UNION ALL
          SELECT t.doc_id, k.child, n.kind, array_append(t.path, k.place), array_append(t.above, k.child)
          FROM tree t JOIN {names["kids"]} k ON k.doc_id = t.doc_id AND k.parent = t.number
          JOIN {names["nodes"]} n ON n.doc_id = k.doc_id AND n.number = k.child
          WHERE t.kind = 'Pages' AND NOT array_contains(t.above, k.child))
        SELECT doc_id, number, cast(row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS int) AS page_no
        FROM tree WHERE kind = 'Page'"""
    )


def xref_field(data: Column, at: Column, width: Column, default: int) -> Column:
    """A big-endian number of ``width`` bytes from byte ``at`` (counted from 0); the default if the
    width is 0."""
    value = F.conv(F.hex(F.substring(data, at + 1, width)), 16, 10).cast("long")
    return F.when(width == 0, F.lit(default).cast("long")).otherwise(value)


def xref_records(data: Column, widths: Column, ranges: Column) -> Column:
    """``array<struct<number, kind, a, b>>`` of a decoded cross-reference stream.

    ``widths`` are its three column widths, ``ranges`` an array of ``first, count``. Records are
    numbered through the ranges and end with the data; a missing kind is 1, missing others are 0. Null
    if the widths aren't three or are all 0."""
    w = [F.get(widths, F.lit(i)) for i in range(3)]
    size = w[0] + w[1] + w[2]
    numbers = F.flatten(F.transform(ranges, lambda r: F.when(r["count"] > 0, F.sequence(r["first"], r["first"] + r["count"] - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))))
    whole = F.slice(numbers, F.lit(1), F.floor(F.octet_length(data) / size).cast("int"))

    def record(number: Column, i: Column) -> Column:
        at = i * size
        return F.struct(number.alias("number"), xref_field(data, at, w[0], 1).alias("kind"), xref_field(data, at + w[0], w[1], 0).alias("a"), xref_field(data, at + w[0] + w[1], w[2], 0).alias("b"))

    return F.when((F.size(widths) == 3) & (size > 0), F.transform(whole, record))


def startxref(content: Column) -> Column:
    """The offset that the last ``startxref`` of a file's last 1,024 bytes names; null if there is
    none. A file without the end marker counts too."""
    length = F.octet_length(content)
    tail = F.decode(F.substring(content, F.greatest(length - 1023, F.lit(1)), F.lit(1024)), "ISO-8859-1")
    return F.regexp_extract(tail, r"(?s)\A.*startxref[\x00\x09\x0A\x0C\x0D\x20]+([0-9]+)", 1).try_cast("bigint")


def xref_table(text: Column) -> Column:
    """``array<struct<number, offset, generation, in_use>>`` of a classic cross-reference section:
    after ``xref`` subsections of a first number, a count and so many entries, up to the trailer."""
    body = F.regexp_extract(text, r"(?s)xref\s+(.*?)\s*(?:trailer|\z)", 1)
    rows = F.regexp_extract_all(body, F.lit(r"[0-9]++\s++[0-9]++(?:\s++[nf]\b)?"), F.lit(0))

    def numbered(rows: Column) -> Column:
        heads = F.filter(F.transform(rows, lambda r, i: F.when(~r.rlike(r"[nf]\z"), i)), lambda i: i.isNotNull())
        part = lambda r, k: F.split(r, r"\s+")[k]

        def section(h: Column) -> Column:
            first, count = part(F.get(rows, h), 0).cast("bigint"), part(F.get(rows, h), 1).cast("int")
            own = lambda r, i: F.struct((first + i).alias("number"), part(r, 0).cast("bigint").alias("offset"), part(r, 1).cast("int").alias("generation"), (part(r, 2) == "n").alias("in_use"))
            return F.transform(F.filter(F.slice(rows, h + 2, count), lambda r: r.rlike(r"[nf]\z")), own)

        return F.flatten(F.transform(heads, section))

    return let(rows, numbered)


def kids_of(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and kids of page trees, as :func:`page_order` takes them, from objects as values
    (``doc_id, number, value VARIANT``). An object without a type is a page if it has contents or a media
    box."""
    v = F.col("value")
    has = lambda key: F.try_variant_get(v, f"$.{key}", "variant").isNotNull()
    named = F.try_variant_get(v, '$.Type["/"]', "string")
    kind = F.when(named.isin("Page", "Pages"), named).when(has("Contents") | has("MediaBox"), "Page").otherwise(F.coalesce(named, F.lit("")))
    nodes = objects.select("doc_id", "number", kind.alias("kind"))
    listed = objects.select("doc_id", F.col("number").alias("parent"), F.posexplode(F.try_variant_get(v, "$.Kids", "array<variant>")).alias("place", "kid"))
    child = F.try_variant_get("kid", "$.R[0]", "bigint")
    return nodes, listed.select("doc_id", "parent", "place", child.alias("child")).where("child is not null")


#: How values that JSON lacks are held in a VARIANT: an object with this one key.
TAGS = {"name": "/", "ref": "R", "stream": "stream"}


def _kind(value: Column) -> Column:
    """``null, bool, int, real, string, array, dict, name, ref`` or ``stream``."""
    shape = F.schema_of_variant(value)
    tagged = lambda tag: F.try_variant_get(value, f'$["{tag}"]', "variant").isNotNull()
    inside = F.when(tagged("/"), "name").when(tagged("R"), "ref").when(tagged("stream"), "stream").otherwise("dict")
    return (
        F.when(shape.startswith("OBJECT"), inside)
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "BOOLEAN", "bool")
        .when(shape == "BIGINT", "int")
        .when(shape.startswith("DECIMAL") | shape.isin("DOUBLE", "FLOAT"), "real")
        .when(shape == "STRING", "string")
        .otherwise("null")
    )


def accessors(value: Column) -> dict[str, Column]:
    """Typed access to a VARIANT value: null if it is of another kind. An integer is also a
    real, and a stream's dictionary is also a dictionary."""
    kind = _kind(value)
    get = lambda path, to: F.try_variant_get(value, path, to)
    return {
        "as_bool": F.when(kind == "bool", get("$", "boolean")),
        "as_int": F.when(kind == "int", get("$", "bigint")),
        "as_real": F.when(kind.isin("int", "real"), get("$", "double")),
        "as_string": F.when(kind == "string", get("$", "string")),
        "as_name": F.when(kind == "name", get('$["/"]', "string")),
        "as_array": F.when(kind == "array", get("$", "array<variant>")),
        "as_dict": F.when(kind == "dict", value).when(kind == "stream", get("$.dict", "variant")),
        "as_stream": F.when(kind == "stream", F.unbase64(get("$.stream", "string"))),
        "as_ref": F.when(kind == "ref", F.struct(get("$.R[0]", "bigint").alias("number"), get("$.R[1]", "bigint").alias("generation"))),
    }


def view_name(spark: SparkSession, df: DataFrame) -> str:
    """A temporary view of ``df`` under a name of its own."""
    name = f"_pagesift_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return name
