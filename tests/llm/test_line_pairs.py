"""What fuzzy lines compares: the bound that spares edit distances, and large keys of lines of unlike lengths."""

import random

from pyspark.sql import functions as F
from test_edges import brute_lines, edit_distance

from pagesift.llm import line_dedup


def test_words_put_in_and_left_out_are_bounded_closely(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(2, 9)))
    rows = []
    for i in range(60):
        one = [word() for _ in range(draw.randint(1, 40))]
        two = [word() for _ in range(draw.randint(1, 40))] if i % 6 == 5 else list(one)
        for _ in range(draw.randint(0, 3)):
            at = draw.randrange(len(two) + 1)
            if draw.random() < 0.5 and len(two) > 1:
                del two[at : at + draw.randint(1, 3)]
                two = two or [word()]
            else:
                two[at:at] = [word() for _ in range(draw.randint(1, 3))]
        rows.append((" ".join(one), " ".join(two)))
    # left out near the front and put in near the end: side by side, the words between all differ
    base = [f"plain{i}" for i in range(30)]
    rows.append((" ".join(base), " ".join([*base[:2], *base[4:26], "more", *base[26:]])))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", F.expr("split(a, ' ')").alias("x"), F.expr("split(b, ' ')").alias("y"))
    got = got.select("a", "b", line_dedup._walked(F.col("x"), F.col("y")).alias("n")).collect()
    assert all(r["n"] >= edit_distance(r["a"], r["b"]) for r in got)
    far = next(r for r in got if "plain" in r["a"])
    assert far["n"] <= 0.2 * len(far["a"])
    alike = [r for r in got if edit_distance(r["a"], r["b"]) <= 0.2 * max(len(r["a"]), len(r["b"]))]
    assert sum(r["n"] <= 0.2 * max(len(r["a"]), len(r["b"])) for r in alike) >= 0.9 * len(alike) > 10


def test_a_large_key_with_lines_of_unlike_lengths(spark):
    """Lines that end in the same words, some of them near copies, are grouped as by comparing all."""
    draw = random.Random(8)
    tail = "one very common end"
    rows = []
    for g in range(12):
        words = draw.choices([f"{a}{b}{i}" for a in "klm" for b in "xyz" for i in range(20)], k=6 + 5 * g)
        for _ in range(3):
            rows.append((len(rows), " ".join(words) + f" {tail}"))
            words = list(words)
            at = draw.randrange(len(words))
            words[at : at + 1] = draw.choice([[], ["added", words[at]], ["other"]])
    want, links = brute_lines(rows)
    assert links > 5
    for lead in (True, False):
        got = line_dedup.line_groups(spark.createDataFrame(rows, "doc_id long, text string"), lead=lead).collect()
        assert {(r["doc_id"], r["line_no"], r["first_doc"], r["first_line"], r["kept"]) for r in got} == set(want)
