"""The language classifier against its definition, computed directly."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesift.llm import langid


def grams(text):
    """Byte n-grams of length 1 to 3, trigrams by their hash."""
    b = bytes(x if x >= 128 or 97 <= x <= 122 else 32 for x in text.lower().encode())
    out = {("1", x) for x in b} | {("2", b[i : i + 2]) for i in range(len(b) - 1)}
    return out | {("3", (int.from_bytes(b[i : i + 3], "big") * 2654435761 % (1 << 32)) >> 15) for i in range(len(b) - 2)}


def kernel(x, y):
    return len(x & y) / np.sqrt(len(x) * len(y))


def made(rng, langs, n):
    roots = {g: ["".join(rng.choices("abcdefghilmnoprstuäéß", k=rng.randint(2, 4))) for _ in range(25)] for g in langs}
    return [(g, " ".join("".join(rng.choices(roots[g], k=2)) for _ in range(rng.randint(4, 30)))) for _ in range(n) for g in langs]


def bitmaps(texts):
    flags, out = np.zeros(langid.SPACE, bool), []
    for t in texts:
        own = np.zeros(langid.SPACE, np.uint8)
        own[langid.presence(t, flags)] = 1
        out.append(np.packbits(own, bitorder="little"))
    return np.stack(out)


@pytest.mark.parametrize("langs, landmarks", [(3, 20), (9, 6)])
def test_scores_are_those_of_kernel_map_and_ridge(langs, landmarks):
    rng = random.Random(langs)
    names = [f"l{k}" for k in range(langs)]
    rows = made(rng, names, 12)
    train, tests = rows[: 8 * langs], rows[8 * langs :]
    model = langid.fit(bitmaps([t for _, t in train]), [g for g, _ in train], landmarks, 1e-2)
    assert (model.alpha is None) == (langs <= landmarks)
    # landmarks are dealt to languages in turn, in the order of the rows
    turn = sorted(range(len(train)), key=lambda i: (sum(g == train[i][0] for g, _ in train[:i]), train[i][0]))
    marks = [grams(train[i][1]) for i in turn[:landmarks]]
    row = lambda t: np.array([kernel(grams(t), m) for m in marks])
    value, vector = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    keep = value > 1e-8 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = np.hstack([np.array([row(t) for _, t in train]) @ root, np.ones((len(train), 1))])
    want = []
    for g in names:
        penalty = np.eye(phi.shape[1]) * 1e-2
        penalty[-1, -1] = 1e-9
        want.append(np.linalg.solve(phi.T @ phi + penalty, phi.T @ np.array([1.0 if h == g else -1.0 for h, _ in train])))
    out = np.array([np.append(row(t) @ root, 1.0) for _, t in tests]) @ np.array(want).T
    labels, scores = model.predict([t for _, t in tests])
    assert labels == [names[k] for k in out.argmax(axis=1)]
    assert np.allclose(scores, np.clip((1 + out.max(axis=1)) / 2, 0, 1), atol=2e-6)


def test_slices_change_nothing(monkeypatch):
    rng = random.Random(1)
    rows = made(rng, ["a", "b", "c"], 20)
    model = langid.fit(bitmaps([t for _, t in rows]), [g for g, _ in rows])
    texts = [t for _, t in rows] + [" ".join(t for _, t in rows)]
    whole = model.judge(texts)
    monkeypatch.setattr(langid, "_GATHERED", 300)
    parts = model.judge(texts)
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1], atol=1e-6) and (whole[2] == parts[2]).all()


def test_every_language_can_be_predicted(spark):
    rng = random.Random(2)
    names = [f"x{k:03d}" for k in range(230)]
    rows = [(i, t, g) for i, (g, t) in enumerate(made(rng, names, 5))]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_train=100)
    assert model.langs == names


def test_held_out_fold(spark):
    ids = [0, 1, -5, 10**15, *range(2, 90)]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", langid.held_out().alias("h")).collect()
    assert {r["doc_id"]: r["h"] for r in rows} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}


def test_null_ids_and_ties(spark):
    rows = [(None, "the thing there", "en"), (None, "le eau ou", "fr"), (3, "the other thing", "en"), (4, "que eau", "fr")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).select("lang_pred", F.col("doc_id")).collect()
    assert len(got) == 4 and {r["lang_pred"] for r in got} <= {"en", "fr"}
