import hashlib
import re

import pytest

from cohortspark.llm import decontamination as D

from .helpers import LONG, documents, empty

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(D.UPPER, D.LOWER)
ITEMS = [(1, "The quick brown fox jumps over the lazy dog and then it sleeps all day"), (2, "short Item"), (3, None), (4, "..."), (5, "é É ü"), (10, "short item"), (6, " ".join(f"word{i}" for i in range(12)))]
TEXTS = [
    "so, the QUICK brown fox jumps over the lazy dog; and then it rests",
    "quick brown fox jumps over the lazy dog and then it sleeps all day the quick brown",
    "a short-item and short item, SHORT ITEM",
    "é É ü é É ü",
    "É É ü",
    "nothing here",
    "",
    None,
    LONG,
    "the quick brown fox jumps over a lazy dog and then it sleeps",
    "a short-item and short item, SHORT ITEM",
]


def brute(texts, items, width=10):
    cut = lambda t: WORDS.findall((t or "").translate(LOWER))
    windows = [(i, tuple(w[s : s + width])) for i, t in items if (w := cut(t)) for s in range(max(1, len(w) - width + 1))]
    out = []
    for text in texts:
        w, hit, found = cut(text), set(), set()
        for i, phrase in windows:
            for s in range(len(w) - len(phrase) + 1):
                if tuple(w[s : s + len(phrase)]) == phrase:
                    hit |= set(range(s, s + len(phrase)))
                    found.add(str(i))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("rows", [D.BROADCAST_ROWS, 0])
def test_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(D, "BROADCAST_ROWS", rows)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in D.contamination(documents(spark, TEXTS), items).collect()}
    assert [got[i] for i in range(len(TEXTS))] == brute(TEXTS, ITEMS)


def test_empty_tables_and_repeated_ids(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.contamination(empty(spark), items).collect() == []
    clean = D.contamination(documents(spark, TEXTS), items.limit(0)).collect()
    assert len(clean) == len(TEXTS) and not any(r.contaminated for r in clean)
    twice = documents(spark, ["short item", "other text", "short item"]).selectExpr("cast(null as long) doc_id", "text")
    assert sorted(r.n_hit for r in D.contamination(twice, items).collect()) == [0, 2, 2]


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, None)], "item_id long, text string")
    docs = documents(spark, ["gamma x beta x alpha y delta", "alpha " + "x " * 30 + "beta gamma delta", "alpha beta gamma", None])
    got = [(r.doc_id, r.item_id) for r in D.proximity_matches(docs, items, terms=4, span=8).collect()]
    assert got == [(0, 1)]


def test_proximity_equals_brute_force(spark):
    import random

    rng = random.Random(2)
    letters = [f"t{i}" for i in range(30)]
    texts = [" ".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(30)]
    items = [(i, " ".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))) for i in range(12)]
    count = {w: sum(t.split().count(w) for t in texts) for w in letters}
    want = []
    for i, item in items:
        rarest = sorted({w for w in item.split() if count[w]}, key=lambda w: (count[w], w))[:3]
        for d, text in enumerate(texts):
            w = text.split()
            want += [(d, i, p) for p, x in enumerate(w) if rarest and x == rarest[0] and set(rarest) <= set(w[max(0, p - 7) : p + 8])]
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in D.proximity_matches(docs, bench, terms=3, span=7).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20
    twice = documents(spark, ["alpha beta", "alpha beta", "beta"]).selectExpr("cast(5 as long) doc_id", "text")
    assert [tuple(r) for r in D.proximity_matches(twice, spark.createDataFrame([(1, "beta alpha")], "item_id long, text string")).collect()] == [(5, 1, 0)] * 2


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    frame = spark.createDataFrame([(None, "short item"), (None, "clean"), (3, "clean"), (3, "a short item")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.contaminated) for r in D.contamination(frame, items).collect()) == [(0, False), (0, True), (3, False), (3, True)]


def test_proximity_bears_words_the_corpus_lacks(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma Zyx42"), (2, "nowhere")], "item_id long, text string")
    docs = documents(spark, ["gamma x beta x alpha y altered", "alpha " + "x " * 30 + "beta gamma"])
    assert [(r.doc_id, r.item_id) for r in D.proximity_matches(docs, items, terms=4, span=8).collect()] == [(0, 1)]
