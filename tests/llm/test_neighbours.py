"""The neighbour search against brute force, with lists left out."""

import numpy as np
import pytest

from pagesift.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def clustered(rng):
    return np.repeat(rng.normal(size=(60, 24)), 50, axis=0) + 0.2 * rng.normal(size=(3000, 24))


def far_group(rng):
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.2, 2, size=(3000, 1))
    x[:12] = 4 + 0.05 * rng.normal(size=(12, 24))
    return x


MAKES = {
    "clustered": clustered,
    "broad, one length": lambda rng: (x := rng.normal(size=(3000, 24))) / np.linalg.norm(x, axis=1)[:, None],
    "lognormal lengths": lambda rng: rng.normal(size=(3000, 24)) * rng.lognormal(size=(3000, 1)),
    "one very long vector": lambda rng: np.vstack([clustered(rng)[:-1], np.full((1, 24), 1e4)]),
    "a far group": far_group,
}


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], SCHEMA)


def nearest(x, ids, q, top=20):
    """Ids and scores by reading everything; a repeated id counts once, at its best."""
    best = {}
    for i, s in zip(ids.tolist(), (x @ x[q]).tolist(), strict=True):
        if i != ids[q]:
            best[i] = max(s, best.get(i, -np.inf))
    return sorted(best.items(), key=lambda r: (-r[1], r[0]))[:top]


@pytest.mark.parametrize("make", MAKES)
def test_recall_with_lists_left_out(spark, make):
    x = MAKES[make](np.random.default_rng(7)).astype(np.float32).astype(float)
    got = ann.search(frame(spark, x), list_rows=50).toPandas()
    ids, hit = np.arange(len(x)), 0
    for q in range(0, len(x), 20):
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and q not in set(mine.vec_id)
        assert np.allclose(mine.score, [x[v] @ x[q] for v in mine.vec_id], rtol=1e-12)
        assert sorted(zip(-mine.score, mine.vec_id)) == list(zip(-mine.score, mine.vec_id))
        hit += len({v for v, _ in nearest(x, ids, q)} & set(mine.vec_id))
    assert hit >= 0.9 * len(x)


def test_clusters_need_few_lists():
    x = clustered(np.random.default_rng(3))
    longest = np.linalg.norm(x, axis=1).max()
    index = ann.build(x, 60, longest)
    assert len(index.centers) == 60
    assert ann.bounds(index, x, longest, 20, ann.CLOSURE, ann.REPLICAS, ann.TARGET)[0] <= 30


def test_many_lists_are_made_in_groups():
    x = np.random.default_rng(3).normal(size=(6000, 8))
    index = ann.build(x, 1500, np.linalg.norm(x, axis=1).max())
    assert 1300 <= len(index.centers) <= 1700
    near, _ = index.of_vectors(ann.lifted(x[:200], np.linalg.norm(x, axis=1).max()), 4)
    exact = ann._nearest(ann.lifted(x[:200], np.linalg.norm(x, axis=1).max()), index.centers, 0.0)
    assert (near[:, 0] == exact).mean() > 0.9


def test_an_id_repeated_many_times(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(340, 8)).astype(np.float32).astype(float)
    x[300:] = x[40] * 3
    ids = np.array([*range(300), *[1001] * 40])
    got = ann.search(frame(spark, x, ids).coalesce(1)).toPandas()
    for q in range(0, 300, 20):
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == [v for v, _ in nearest(x, ids, q)]


def test_queries_that_find_too_few_read_all_lists(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(np.eye(12), 25, axis=0) + 0.01 * rng.normal(size=(300, 12))
    got = ann.search(frame(spark, x), list_rows=10, probes=1, ratio=1.0, closure=1.0, replicas=1).toPandas()
    assert got.groupby("query_id").size().tolist() == [20] * 15


def test_equal_vectors_tie_by_id(spark):
    got = ann.search(frame(spark, np.ones((50, 70)) * 0.1)).toPandas()
    for q in (0, 20, 40):
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == [v for v in range(50) if v != q][:20] and mine.score.nunique() == 1


def test_fewer_candidates_than_places(spark):
    got = ann.search(frame(spark, np.eye(5), [0, 20, 21, 22, 23])).toPandas()
    assert got.groupby("query_id").size().to_dict() == {0: 4, 20: 4}
