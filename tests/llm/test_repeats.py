"""Rows that repeat an id many times."""

import random

from pagesift.llm import ann, langid


def test_a_vector_id_repeated_more_often_than_neighbours_are_asked_for(spark):
    rows = [(0, [1.0, 0.0])] + [(7, [1.0, 0.0])] * 30 + [(i, [i / 200, 0.1]) for i in range(100, 125)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)).where("query_id = 0").orderBy("rank").collect()
    v = dict(rows)
    want = sorted(set(v) - {0}, key=lambda i: (-v[i][0], i))[:20]
    assert [r["vec_id"] for r in got] == want


def test_an_id_repeated_more_often_than_rows_are_learned_from(spark):
    random.seed(5)
    roots = {"de": ["sch", "ung", "ei"], "en": ["the", "ing", "er"], "fr": ["eau", "ou", "qu"]}
    say = lambda g: " ".join("".join(random.choices(roots[g], k=3)) for _ in range(20))
    rows = [(i, say(g), g) for g in roots for i in range(1000 * len(g) + ord(g[0]) * 10000, 1000 * len(g) + ord(g[0]) * 10000 + 40)]
    rows += [(r[0], say("de"), "de") for r in rows[:40] for _ in range(400)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_train=90)
    assert model.langs == ["de", "en", "fr"]
