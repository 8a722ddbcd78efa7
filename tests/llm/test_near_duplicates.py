import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import shingles
from cohortspark.llm.near_duplicates import near_duplicates

from .helpers import LONG, documents, empty


def brute(texts, percent=85):
    """(n_shingles, component) of each text from all pairs of full sets."""
    sets = []
    for text in texts:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(60, 140))] for _ in range(6)]
    out = []
    for b in base:
        for _ in range(25):  # near copies around the threshold
            copy = list(b)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    shared = " ".join(base[0][:40])
    out += [shared + " " + " ".join(rng.choice(words) for _ in range(30)) for _ in range(30)]  # one passage, no links
    out += [base_text for base_text in out[:10]] + ["A b\tC d E", "a B c\nd e", "a b c", "A  b c ", "a", "A", "é É", "é é", "", " \t\n", None, None, LONG, LONG + " end", "x y"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_brute_force(spark, percent):
    texts = corpus()
    got = {r.doc_id: r for r in near_duplicates(documents(spark, texts), (percent, 100)).collect()}
    assert len(got) == len(texts)
    for i, (n, component) in enumerate(brute(texts, percent)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, component, component == i), texts[i] and texts[i][:80]


def test_long_lists_are_dealt_in_blocks(spark, monkeypatch):
    from cohortspark.llm import near_duplicates as module

    monkeypatch.setattr(module, "LIST_BLOCK", 4)
    monkeypatch.setattr(module, "SET_BLOCK", 300)
    texts = corpus(1)
    got = {r.doc_id: r.component_id for r in near_duplicates(documents(spark, texts), (85, 100)).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in brute(texts)]


def test_repeated_null_and_empty(spark):
    assert near_duplicates(empty(spark)).collect() == []
    frame = documents(spark, ["a b c d e f", "a b c d e f", "x"]).withColumn("doc_id", F.when(F.col("doc_id") < 2, F.lit(5)))
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_duplicates(frame).collect())
    assert got == [(-1, -1, True), (5, 5, True), (5, 5, True)]


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [(1, " ".join(base)), (7, " ".join(base) + " end"), (7, "quite another text that nobody shares at all"), (7, " ".join(base) + " end"), (1, "a b c d e f"), (1, "a  b c d e f")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept, r.chosen) for r in near_duplicates(frame).collect())
    assert [x[:4] for x in got] == [(1, 2, 1, True), (1, 2, 1, True), (1, 56, 1, True), (7, 4, 7, True), (7, 57, 1, False), (7, 57, 1, False)]
    assert sum(x[4] for x in got if x[1] == 2) == 1  # one of the two that differ in white space
    assert [x[4] for x in got if x[1] != 2] == [True, True, False, False]


def test_links_hidden_behind_a_failed_edge_are_found(spark, monkeypatch):
    """With any match retained, edges of lists are mostly false and say little; the second step must still find all links."""
    from cohortspark.llm import near_duplicates as module

    monkeypatch.setattr(module, "matches_for", lambda similarity: 90)
    monkeypatch.setattr(module, "SET_BLOCK", 700)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(80)]
    texts = []
    for k in range(60):  # a drift: neighbours are similar, ends are not
        base[k % 80] = rng.choice(words)
        texts.append(" ".join(base))
    rng.shuffle(texts)
    got = {r.doc_id: r.component_id for r in near_duplicates(documents(spark, texts), (85, 100)).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in brute(texts)]


def test_components_of_random_graphs(spark):
    from cohortspark.llm.common import Scratch
    from cohortspark.llm.components import connected_components

    rng = random.Random(7)
    graphs = [[], [(5, 5)], [(i + 1, i) for i in range(30)], [(0, i) for i in range(1, 9)] + [(9, 3)], [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]]
    for edges in graphs:
        frame = spark.createDataFrame([*edges, (None, 3)], "u long, v long")
        got = {r.node: r.root for r in connected_components(frame, Scratch(spark, "test")).collect()}
        root = {x: x for e in edges if e[0] != e[1] for x in e}
        for _ in root:
            for u, v in edges:
                if u != v:
                    root[u] = root[v] = min(root[u], root[v])
        assert got == root


def test_signature_positions():
    column = pa.array(["a b c d e f g", None, "a b c d e f h"])
    (_, data, offsets) = next(shingles.chunks(column))
    hashes, starts = shingles.shingle_sets(data, offsets)
    assert list(np.diff(starts)) == [3, 0, 3] and len(np.intersect1d(hashes[:3], hashes[3:])) == 2
    keys, signature = shingles.signature(hashes, starts, 4, 2, 16)
    assert keys.shape == (3, 4) and signature.shape == (3, 16) and not signature[1].any()


def test_chunks_cover_all_rows(monkeypatch):
    monkeypatch.setattr(shingles, "CHUNK_BYTES", 10)
    texts = ["abc def", "x" * 40, "", None, "y", "z" * 9, "é"]
    for column in (pa.array(texts), pa.array(["skip", *texts]).slice(1), pa.array(texts, pa.large_string())):
        found = [(at, bytes(data), list(offsets)) for at, data, offsets in shingles.chunks(column)]
        whole = [data[o[i] : o[i + 1]].decode() for _, data, o in found for i in range(len(o) - 1)]
        assert whole == [t or "" for t in texts]
