import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import runs as R

from .helpers import LONG, documents, empty


def smaller_suffixes(s):
    n = len(s)
    following, common = [n] * n, [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            if s[j:] < s[i:]:
                following[i] = j
                common[i] = next((m for m in range(n - j) if s[i + m] != s[j + m]), n - j)
                break
    return following, common


def all_runs(s, length, repeats):
    """By trying every period."""
    n, out = len(s), []
    for p in range(1, n // repeats + 1):
        i = p
        while i < n:
            j = i
            while j < n and s[j] == s[j - p]:
                j += 1
            size = j - i + p
            if j > i and size >= max(length, repeats * p):
                w = s[i - p : j]
                if all(w[q:] != w[:-q] for q in range(1, p)):
                    out.append((i - p, size, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequence(draw):
    letters = draw.choice([1, 2, 2, 3, 4])
    s = [draw.randrange(letters) for _ in range(draw.randint(0, 50))]
    for _ in range(draw.randint(0, 3)):
        if s:
            a, b = draw.randrange(len(s)), draw.randint(0, len(s))
            p = draw.randint(1, max(1, (len(s) - a) // 2))
            for i in range(a, b):
                s[i] = s[a + (i - a) % p]
    return s


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("seed", range(40))
def test_kernel_equals_brute_force(seed):
    draw = random.Random(seed)
    for s in [*(sequence(draw) for _ in range(25)), fibonacci(60)[seed % 10 :]]:
        assert R.lyndon_array(s) == smaller_suffixes(s)
        for length, repeats in ((1, 3), (6, 3), (3, 4)):
            assert R.runs_of(s, length, repeats) == all_runs(s, length, repeats)


class Counted(int):
    compared = 0

    def __eq__(self, other):
        Counted.compared += 1
        return int.__eq__(self, other)

    __hash__ = int.__hash__


@pytest.mark.parametrize("make", [fibonacci, lambda n: [0] * n, lambda n: [i % 2 for i in range(n)], lambda n: [bin(i).count("1") % 2 for i in range(n)], lambda n: [bin(i & -i).count("0") for i in range(1, n + 1)]])
def test_comparisons_are_linear(make):
    for n in (500, 5000):
        Counted.compared = 0
        R.lyndon_array([Counted(x) for x in make(n)])
        assert Counted.compared <= 3 * n


def planted(doc, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def expected(doc, text):
    words = planted(doc, text)
    found = all_runs(words, R.MIN_LENGTH, R.MIN_REPEATS)
    gone = {i for start, size, p in found for i in range(start + p, start + size)}
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    digest = lambda b: hashlib.sha256(b).hexdigest()
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    return (doc, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest(listed.encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def texts():
    draw = random.Random(5)
    out = ["", None, "  \n\t ", "one", " ".join(["same"] * 23), " ".join(["same"] * 24), "pre " + " ".join("a b c".split() * 8) + " a b post", " ".join(f"w{i % 97}" for i in range(1200)), " ".join(f"w{x}" for x in fibonacci(400)), "É x y " * 30]
    for _ in range(60):
        out.append(" ".join(f"w{draw.choice(range(draw.choice([2, 5, 200])))}" for _ in range(draw.randint(1, 200))))
    return out


@pytest.mark.parametrize("chunk", [R.CHUNK, 100])
def test_query_equals_brute_force(spark, tmp_path, chunk):
    rows = [*enumerate(texts()), (None, " ".join(["x y"] * 30)), (3, "one"), (3, "one")]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, period int, runs string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = R.op13_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(rows)))


@pytest.mark.parametrize("length", [4, 24])
def test_batches_hold_no_run_across_texts(length):
    import pyarrow as pa

    given = ["a b a b", "a b a b a b a b", None, "a b a b a b", "x " * 40, "x " * 3]
    found, left = R.found_runs(pa.array(given), length, 3)
    words = [(t or "").split() for t in given]
    assert found == [all_runs(w, length, 3) for w in words]
    assert left.to_pylist()[2] == ""


def test_very_long_text(spark):
    (row,) = R.periodic_runs(documents(spark, [LONG])).collect()
    assert [tuple(r) for r in row.runs] == [(0, 60_000, 997)] and row.collapsed == " ".join(LONG.split()[:997])


def test_empty_table_and_few_periods(spark):
    assert R.periodic_runs(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        R.periodic_runs(documents(spark, ["a"]), repeats=2)
    kept = R.periodic_runs(documents(spark, ["b a b a b a b c"]), F.upper("text"), length=6).collect()
    assert [(r.runs[0].start, r.runs[0].length, r.runs[0].period, r.collapsed) for r in kept] == [(0, 7, 2, "B A C")]
