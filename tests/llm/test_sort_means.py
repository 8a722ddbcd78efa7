import hashlib
import math
import random

import numpy as np
import pytest

from cohortspark.llm import sort_means as S


def rows_of(n, width, seed=0, spread=3):
    draw = random.Random(seed)
    return [(i, [draw.randint(-spread, spread) / 4 for _ in range(width)]) for i in range(n)]


def brute(rows, count, rounds, width, scale=S.SCALE):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:count]
    centres = [list(v) for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((far(v, c), k) for k, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for k in range(len(centres)):
            mine = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == k]
            if mine:
                centres[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assign()
    total, each = sum(d for d, _ in found), [sum(d for d, c in found if c == k) for k in range(len(centres))]
    name = lambda k: hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()
    return sorted(((i, k, d, each[k], total, name(k)) for (i, _), (d, k) in zip(kept, found, strict=True)), key=repr)


def got(spark, rows, width, count=5, rounds=3):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, cluster int").repartition(3)
    found = S.described(*S.clusters(frame, count=count, rounds=rounds, dimensions=width))
    return sorted((tuple(r) for r in found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


@pytest.mark.parametrize(("width", "spread", "count"), [(2, 3, 5), (2, 1, 8), (6, 2, 16)])
def test_equals_brute_force_with_many_ties(spark, width, spread, count):
    rows = rows_of(300, width, width, spread)
    assert got(spark, rows, width, count) == brute(rows, count, 3, width)


def test_vectors_that_take_no_part(spark):
    rows = [*rows_of(40, 3), (50, None), (51, [1.0]), (52, [1.0, None, 2.0]), (53, [1.0, math.nan, 2.0]), (54, [math.inf, 0.0, 0.0]), (55, []), (None, [0.5, 0.5, 0.5]), (7, [0.25, 0.25, 0.25])]
    assert got(spark, rows, 3) == brute(rows, 5, 3, 3)
    assert got(spark, rows[:40] + [(60, [1e300, 0.0, 0.0])], 3) == brute(rows[:40], 5, 3, 3)


def test_few_and_no_vectors(spark):
    few = rows_of(3, 2)
    assert got(spark, few, 2, count=16) == brute(few, 16, 3, 2)
    assert got(spark, [(1, [1.0])], 2) == [] and got(spark, [(None, [1.0, 1.0])], 2) == []
    same = [(i, [0.5, -0.5]) for i in range(20)]
    assert got(spark, same, 2) == brute(same, 5, 3, 2)


@pytest.mark.parametrize("seed", range(20))
def test_scan_finds_the_nearest_from_any_start(seed):
    draw = np.random.default_rng(seed)
    x, c = draw.integers(-3, 4, (200, 2)), draw.integers(-3, 4, (9, 2))
    every = ((x[:, None] - c[None]) ** 2).sum(-1)
    found, best = S.nearest(x, draw.integers(0, 9, 200), c)
    assert (found == every.argmin(1)).all() and (best == every.min(1)).all()


def test_scan_stops_early():
    c = np.array([[0], [1000], [2000], [4]])
    met = []

    class Seen(np.ndarray):
        def __getitem__(self, i):
            if self.ndim == 2 and np.ndim(i) == 0:
                met.append(int(i))
            return super().__getitem__(i)

    found, _ = S.nearest(np.array([[1], [3]]), np.zeros(2, dtype=np.int64), c.view(Seen))
    assert found.tolist() == [0, 3] and set(met) == {0, 3}
