"""Relational forms of per-page work on long tables: nearest match without a theta join, and
decoding codes through a table of code maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a dimension is broadcast; it is counted first.
BROADCAST_ROWS = 200_000


def nearest(points: DataFrame, marks: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """``points`` with the ``value`` of the mark of the same ``key`` that is nearest in ``at``, the
    lower one on a tie; null where a key has no mark.

    Points and marks are laid in one order and in its reverse: the last mark before a point and the first one
    after it are running values of a window, so there is no product of both sides (a frame that reaches to the end
    of its key would be run through again for each row). Marks of one key at one place count as the one with the least
    value."""
    marks = marks.groupBy(*key, at).agg(F.min(value).alias(value))
    kind = marks.schema[value].dataType
    sides = points.withColumn("__mark", F.lit(None).cast(kind)).unionByName(marks.select(*key, at, F.col(value).alias("__mark")).withColumn("__is", F.lit(True)), allowMissingColumns=True)
    return nearest_of(sides.withColumn("__is", F.coalesce("__is", F.lit(False))), key, at, "__mark", "__is").select(*points.columns, F.col("__mark").alias(value))


def nearest_of(sides: DataFrame, key: list[str], at: str, value: str, is_mark: str) -> DataFrame:
    """The points among ``sides``, which holds points and marks (where ``is_mark``), with the ``value`` of the
    mark nearest to each. A key has one mark at one place."""
    here = F.when(F.col(is_mark), F.struct(F.col(at).alias("at"), F.col(value).alias("value")))
    # at one place the mark stands before the points
    order = Window.partitionBy(*key).orderBy(at, ~F.col(is_mark))
    back = Window.partitionBy(*key).orderBy(F.col(at).desc(), F.col(is_mark))
    below, above = (F.last(here, ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for o in (order, back))
    rows = sides.select("*", below.alias("__below"), above.alias("__above")).where(~F.col(is_mark))
    lower = F.col("__below").isNotNull() & (F.col("__above").isNull() | (F.col(at) - F.col("__below.at") <= F.col("__above.at") - F.col(at)))
    return rows.withColumn(value, F.when(lower, F.col("__below.value")).otherwise(F.col("__above.value"))).drop("__below", "__above", is_mark)


def decode_codes(texts: DataFrame, maps: DataFrame, codes: Column, key: str, font: str) -> DataFrame:
    """``key, text``: two-byte ``codes`` of each row of ``texts`` through its font's map.

    ``maps`` is a table ``font, code, letter`` of any number of fonts. Codes become rows, meet the
    table by font and code, and are put together again in order. A code the map lacks is two single
    bytes; a last odd byte, and every byte of a font without a map, stands alone."""
    fonts = maps.select(F.col("font").alias("__font")).distinct().withColumn("__mapped", F.lit(True))
    rows = texts.select(F.col(key), F.col(font).alias("__font"), F.hex(codes).alias("__hex"))
    rows = rows.join(F.broadcast(fonts) if fonts.count() <= BROADCAST_ROWS else fonts, "__font", "left")
    step = F.when(F.col("__mapped"), 4).otherwise(2)
    starts = F.when(F.length("__hex") > 0, F.sequence(F.lit(1), F.length("__hex"), step))
    rows = rows.select(key, "__font", F.posexplode_outer(F.transform(starts, lambda i: F.substr(F.col("__hex"), i, step))).alias("__i", "__code"))
    maps = maps.select(F.col("font").alias("__font"), F.lpad(F.hex("code"), 4, "0").alias("__code"), "letter")
    rows = rows.join(F.broadcast(maps) if maps.count() <= BROADCAST_ROWS else maps, ["__font", "__code"], "left")
    letter = F.coalesce("letter", F.decode(F.unhex("__code"), "ISO-8859-1"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__i", letter.alias("t")))), lambda s: s["t"]), "")
    return rows.groupBy(key).agg(whole.alias("text"))
