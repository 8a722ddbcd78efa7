import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import cosine_join as J
from cohortspark.operators import pairs


def frame(spark, rows, name):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"{name} long, embedding array<double>, cos int, ring string").repartition(3)


def vectors(seed, n, width, spread):
    """Around a few directions, some repeated and some alone."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(4, width))
    out = centres[draw.integers(0, 4, n)] + spread * draw.normal(size=(n, width))
    out[1], out[2] = out[0], -out[0]
    return [(i, [float(x) for x in v]) for i, v in enumerate(out)]


def cosine(a, b):
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / size


@pytest.mark.parametrize(("threshold", "spread", "block"), [(0.3, 0.5, 4096), (0.9, 0.2, 16), (0.0, 1.0, 16), (-0.5, 0.5, 4096), (0.999, 0.1, 7)])
def test_pairs_equal_brute_force(spark, threshold, spread, block):
    left, right = vectors(1, 60, 5, spread), vectors(1, 90, 5, spread)
    found = J.cosine_pairs(frame(spark, left, "l"), frame(spark, right, "r"), threshold, block=block)
    got = {(x.l, x.r): x.cos for x in found.collect()}
    every = {(i, j): cosine(a, b) for i, a in left for j, b in right}
    want = {k for k, c in every.items() if c >= threshold}
    assert found.count() == len(got) and want <= set(got) and all(every[k] >= threshold - 1e-8 for k in got)
    assert all(abs(got[k] - every[k]) < 1e-12 for k in got) and got


def test_rows_without_a_cosine_and_empty_sides(spark):
    odd = [(1, None), (2, [0.0, 0.0]), (3, [math.nan, 1.0]), (4, [1.0, None]), (5, [math.inf, 1.0]), (6, []), (7, [1.0, 2.0]), (8, [1.0, 2.0, 3.0]), (None, [2.0, 4.0]), (9, [1e120, 2e120])]
    got = J.cosine_pairs(frame(spark, odd, "l"), frame(spark, odd, "r"), 0.9)
    assert sorted(((x.l, x.r) for x in got.collect()), key=str) == sorted([(a, b) for a in (7, None, 9) for b in (7, None, 9)] + [(8, 8)], key=str)
    none, some = frame(spark, [(1, None)], "l"), frame(spark, odd, "r")
    assert J.cosine_pairs(none, some, 0.5).collect() == [] and J.cosine_pairs(some.withColumnRenamed("r", "l"), none.withColumnRenamed("l", "r"), 0.5).collect() == []
    assert J.cosine_pairs(none, some, 0.5).columns == ["l", "r", "cos"]


def test_rings_leave_pairs_out(spark):
    rows = vectors(3, 400, 6, 0.05)
    left, right = frame(spark, rows, "l"), frame(spark, rows, "r")
    met, every = J.compared_pairs(left, right, 0.95)
    assert every == 160_000 and met < every / 2
    loose, _ = J.compared_pairs(left, right, -1.0)
    assert loose == every


def test_entity_pairs_equal_all_pairs(spark):
    """Pairs by term, code, ancestor and vector together are the pairs of a loop over everything that have any likeness."""
    draw = np.random.default_rng(5)
    rows = [(i, f"t{i % 7}", f"c{i % 6}" if i % 3 else None, [float(x) for x in draw.normal(size=4)] if i % 5 else None) for i in range(60)]
    edges = spark.createDataFrame([(f"c{i}", f"g{i % 2}") for i in range(5)] + [("g0", "root"), ("g1", "root")], "child string, parent string")
    codes = spark.createDataFrame([(c,) for c in ["root", "g0", "g1", *(f"c{i}" for i in range(6))]], "code string")
    from cohortspark.operators import taxonomy as X

    closure = X.ancestor_closure(codes, edges)
    one = spark.createDataFrame(rows, "case_id int, term string, code string, embedding array<double>")
    depth = {"root": 1, "g0": 2, "g1": 2, **{f"c{i}": 3 for i in range(5)}, "c5": 1}

    def lca(a, b):
        if a is None or b is None or a == b:
            return None
        return 2 * 2 / (depth[a] + depth[b]) if "c5" not in (a, b) and int(a[1]) % 2 == int(b[1]) % 2 else 0.0

    for least in (0.0, 0.3):
        got = {(r.l.t, r.l.c, r.l.v, r.r.t, r.r.c, r.r.v): (r.same_term, r.same_code, r.both_codes, round(r.cos, 9), r.lca) for r in pairs.distinct_pairs(one.where("case_id < 20"), one, closure, 1, least).collect()}
        hashed = {r.case_id: r.h for r in one.select("case_id", F.xxhash64("embedding").alias("h")).collect()}
        want = {}
        for i, t, c, v in rows[:20]:
            for j, u, d, w in rows:
                cos = cosine(v, w) if v and w else 0.0
                same = t == u or (c is not None and c == d)
                if same or (lca(c, d) or 0) > 0 or cos >= max(least, 1e-300):
                    want[t, c or "", hashed[i], u, d or "", hashed[j]] = (t == u, c is not None and c == d, c is not None and d is not None, round(cos, 9), lca(c, d))
        assert got == want
    assert "NestedLoop" not in pairs.distinct_pairs(one, one, closure, 1)._jdf.queryExecution().executedPlan().toString()


def test_cosines_are_summed_in_the_order_of_the_components(spark):
    from cohortspark.functions import vectors as V

    draw = np.random.default_rng(3)
    kinds = [[float(x) for x in v] for v in draw.normal(size=(30, 67))]
    left = spark.createDataFrame([(i, v) for i, v in enumerate(kinds)], "l int, embedding array<double>")
    right = spark.createDataFrame([(i, kinds[i % 30 if i % 7 else 0]) for i in range(400)], "r int, embedding array<double>")
    plain = left.withColumnRenamed("embedding", "a").crossJoin(right.withColumnRenamed("embedding", "b")).select("l", "r", V.cosine(F.col("a"), F.col("b")).alias("cos"))
    for least, block in ((-1.0, 4096), (0.2, 4096), (0.2, 5)):
        expected = {(x.l, x.r): x.cos for x in plain.where(F.col("cos") >= least).collect()}
        got = {(x.l, x.r): x.cos for x in J.cosine_pairs(left, right, least, block=block).collect()}
        assert got == expected
