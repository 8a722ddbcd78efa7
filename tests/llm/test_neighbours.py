import numpy as np
from pyspark.sql import functions as F

from cohortspark.llm import neighbours as N


def brute(ids, x, queries, k=5):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q in queries:
        i = list(ids).index(q)
        s = unit @ unit[i]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if j != i][:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 32)).astype(np.float32)
    x[100:160] = x[0]  # copies
    x[200] = 2 * x[3]
    ids = np.arange(1500) * 3
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = {}
    for r in N.nearest(frame, frame.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    expected = brute(ids, x.astype(float), [int(i) for i in ids if i % 50 == 0])
    assert set(got) == set(expected)
    hits = sum(len({v for v, _ in got[q].values()} & {v for v, _ in e}) for q, e in expected.items())
    assert hits / (5 * len(expected)) >= 0.9
    assert [got[0][r][0] for r in range(1, 6)] == [300, 303, 306, 309, 312]
    for q, e in expected.items():
        true = dict(e)
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        assert all(abs(true[v] - s) < 1e-12 for v, s in got[q].values() if v in true)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0]), (8, [1.0]), (None, [1.0, 0.0]), (50, [2.0, 0.0]), (50, [2.0, 0.0]), (100, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in N.nearest(frame, frame.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50, 1.0), (0, 2, 7, 0.707107), (0, 3, 1, 0.0), (50, 1, 0, 1.0), (50, 2, 7, 0.707107), (50, 3, 1, 0.0)]
    assert N.nearest(frame.limit(0), frame).collect() == [] and N.nearest(frame, frame.limit(0)).collect() == []


def test_large_leaves_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "PART", 8)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.query_id: r.vec_id for r in N.nearest(frame, frame.where("vec_id % 50 = 0")).where("rank = 1").collect()}
    expected = brute(np.arange(300), x.astype(float), list(got))
    assert sum(got[q] == expected[q][0][0] for q in got) >= len(got) - 1


def test_recall_holds_as_the_table_grows(spark, monkeypatch):
    """The sample stays as it is, and trees go on below its leaves."""
    monkeypatch.setattr(N, "SAMPLE", 600)
    monkeypatch.setattr(N, "LEAF_ROWS", 16)
    rng = np.random.default_rng(2)
    for n in (1000, 3000, 9000):
        centres = rng.standard_normal((40, 24))
        x = (centres[rng.integers(0, 40, n)] + 0.6 * rng.standard_normal((n, 24))).astype(np.float32)
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        got = {}
        for r in N.nearest(frame, frame.where(f"vec_id % {n // 50} = 0")).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        expected = brute(np.arange(n), x.astype(float), list(got))
        hits = sum(len(got[q] & {v for v, _ in e}) for q, e in expected.items())
        assert len(got) == 50 and hits / 250 >= 0.9, (n, hits)


def test_a_deeper_forest_posts_where_it_probes():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    forest = N.grow(x, trees=3, leaves=16).deepened(3)
    leaves = forest.post(x)
    for i in range(0, 500, 50):
        order = forest.probe(x[i], 10**6)
        assert len(order) == len(set(order)) == 8 * sum(forest.leaves)
        assert {(t, int(leaf)) for t, leaf in enumerate(leaves[i])} <= set(order[:3])


def test_queries_need_not_be_in_the_table(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 6)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1000, (x[7] * 3).astype(float).tolist()), (7, x[7].astype(float).tolist())], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in N.nearest(frame, asked).collect()}
    assert got[1000, 1][0] == 7 and abs(got[1000, 1][1] - 1) < 1e-12 and got[7, 1][0] != 7 and len(got) == 10
