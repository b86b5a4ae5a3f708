"""CSV text read back, against a reader that goes character by character."""

import random

import pytest
from pyspark.sql import functions as F

from pagesift.functions.csv import csv_rows, row_count


def by_character(text):
    rows, row, field, quoted, i = [], [], "", False, 0
    while i < len(text):
        ch = text[i]
        if quoted:
            if ch == '"' and text[i + 1 : i + 2] == '"':
                field, i = field + ch, i + 1
            elif ch == '"':
                quoted = False
            else:
                field += ch
        elif ch == '"':
            quoted = True
        elif ch in ",\n":
            row.append(field)
            field = ""
            if ch == "\n":
                rows.append(row)
                row = []
        elif ch != "\r":
            field += ch
        i += 1
    rows.append([*row, field])
    return [r for r in rows if any(r)]


def test_rows_equal_a_character_reader(spark):
    draw = random.Random(8)
    texts = ["".join(draw.choices('ab,"\n\r ', [6, 4, 4, 3, 2, 1, 1], k=draw.randint(0, 40))) for _ in range(600)]
    texts += ["", ",", ",a", "a,", '"', '""', 'x"y,z"w,"', "\r\n\r\n", 'a\n,,\n"",\nb']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", csv_rows(F.col("t")).alias("rows"), row_count(F.col("t")).alias("n")).collect():
        assert r["rows"] == by_character(r["t"]), repr(r["t"])
        assert r["n"] == max(len(r["rows"]) - 1, 0)


@pytest.mark.parametrize("size", [4_000, 100_000, 1_000_000])
def test_long_cells(spark, size):
    texts = [f'head,"{"q" * size}"\nnext,{"p" * size}', f'"{"a,b" * (size // 3)}"', '""' * (size // 2), f'"{chr(34) * 2 * (size // 2)}",1', "x\n" * (size // 2), "," * size + "y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = [r[0] for r in df.select(csv_rows(F.col("t"))).collect()]
    assert rows[0] == [["head", "q" * size], ["next", "p" * size]]
    assert rows[1] == [["a,b" * (size // 3)]]
    assert rows[2] == [['"' * (size // 2 - 1)]]
    assert rows[3] == [['"' * (size // 2), "1"]]
    assert len(rows[4]) == size // 2 and rows[5] == [[""] * size + ["y"]]
