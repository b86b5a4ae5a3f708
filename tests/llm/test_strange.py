"""The pipeline's language stage on text of no learned language."""

import random

import pytest

FOREIGN = [
    "Все люди рождаются свободными и равными в своем достоинстве и правах",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
]


def test_foreign_text_and_gibberish_go_and_clean_documents_stay(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    random.seed(6)
    roots = {"en": ["the", "ing", "er", "wh"], "fr": ["eau", "é", "ou", "qu"], "de": ["sch", "ung", "ü", "ei"]}
    rows = []
    for i in range(300):
        g = random.choice(list(roots))
        rows.append((i, " ".join("".join(random.choices(roots[g], k=3)) for _ in range(random.choice([1, 8, 80]))), g))
    bad = [*FOREIGN, " ".join("".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(60)), " ".join(f"k{random.randrange(10**6):x} 7" for _ in range(60))]
    planted = [(1000 + i, t, random.choice([None, "en"])) for i, t in enumerate(bad)]
    docs = spark.createDataFrame(rows + planted, "doc_id long, text string, lang string")
    left = {r["doc_id"] for r in pipeline.language(spark, docs, str(tmp_path)).collect()}
    assert left == set(range(300))
