import difflib
import random

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import ontology as O
from cohortspark.operators import similar_strings as S

from .test_plain_references import rung, words

ODD = ["", "a", "ab", "aa", "aaa", "é", "日本語日本", "x" * 40, "a b", "a%_\\.b", "ab ab ab ab"]


def strings(seed, n, letters="abcde "):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def shared(a, b):
    return sum(min(a.count(x), b.count(x)) for x in set(a))


@pytest.mark.parametrize("threshold", [0.6, 0.72, 0.78, 1.0])
def test_pairs_are_those_within_the_bound(spark, threshold):
    left, right = strings(1, 120), strings(2, 120)
    frame = lambda rows, name: spark.createDataFrame([(x,) for x in [*rows, *rows[:5], None]], f"{name} string")
    got = S.similar_strings(frame(left, "a"), frame(right, "b"), threshold).collect()
    want = {(a, b) for a in left for b in right if a and b and 2 * shared(a, b) / (len(a) + len(b)) >= threshold}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {(a, b) for a in left for b in right if a and b and difflib.SequenceMatcher(None, a, b).ratio() >= threshold} <= want
    pairs = spark.createDataFrame([(a, b) for a in left for b in right], "a string, b string")
    kept = {tuple(r) for r in pairs.where(S.within_bound(F.col("a"), F.col("b"), threshold)).collect()}
    assert kept == want | {("", "")}


def test_strings_inside_texts(spark):
    texts = strings(3, 150, "abc ") + ["abcabcabcabc", "aaaaaaaa"]
    asked = strings(4, 150, "abc ") + ["abcabc", "aaaa", "zzz", "abz", "bca"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = S.containing(spark.createDataFrame([(q,) for q in [*asked, None]], "q string"), S.gram_postings(frame, "id", "text"), "id").collect()
    want = {(q, i) for q in asked for i, t in enumerate(texts) if q and q in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("sent", [None, 0])
def test_strings_inside_pieces_of_texts(spark, monkeypatch, sent):
    if sent is not None:
        monkeypatch.setattr(S, "SENT_QUERIES", sent)
    long = "".join(random.Random(6).choice("abc") for _ in range(900))
    texts = [*strings(5, 60, "abc ,"), long, f"x {long[:300]},{long[200:]} é", "abcabc abcabc", "", None]
    asked = [*strings(7, 60, "abc "), long[250:270], long[240:280], long[100:700], long[:20] + "q", "a b", "c,", "é", "abcabc abc", "x y", *ODD]
    # ids repeat and may be missing; a text counts once for each of its rows
    ids = [i // 2 if i % 5 else None for i in range(len(texts))]
    frame = spark.createDataFrame(list(zip(ids, texts, strict=True)), "id int, text string")
    got = S.inside_pieces(spark.createDataFrame([(q,) for q in [*asked, *asked[:9], "", None]], "q string"), frame, "id", "text", "[^a-c]+").collect()
    want = [(q, i) for q in set(asked) for i, t in zip(ids, texts, strict=True) if q and t and q in t]
    order = lambda rows: sorted((q, -1 if i is None else i) for q, i in rows)
    assert order(got) == order(want)


def test_words_inside_texts_shuffle_no_more_than_the_texts(spark, tmp_path):
    from cohortspark.plans import search_queries as Q

    turns = [(i, 0, "Abcde, an abcdefghijklmnopq of abc") for i in range(5)] + [(0, 0, "abc")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([("ABC bcd an zz",), ("abcdefghijklmnop abcdefghijklmnox",)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = Q.t10_inside_texts(spark, str(tmp_path))
    assert dict(map(tuple, found.collect())) == {"abc": 6, "bcd": 5, "an": 5, "abcdefghijklmnop": 5}
    # the texts are dealt out before they are taken apart, the parts are counted where they are
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_empty_sides(spark):
    none = spark.createDataFrame([], "a string")
    some = spark.createDataFrame([("ab",)], "b string")
    assert S.similar_strings(none, some, 0.7).collect() == [] and S.similar_strings(some.toDF("a"), none.toDF("b"), 0.7).collect() == []
    assert S.containing(none.toDF("q"), S.gram_postings(some.withColumn("id", F.lit(1)), "id", "b"), "id").collect() == []


def test_terms_without_a_key_get_every_entry_that_fits(spark):
    """Odd terms against all entries, as a loop over all of them says."""
    rng = random.Random(11)
    stock = "sleep sleeping disturbance anxious anxiety mood lows panic attack fear insomnia early waking of the tremor hand ab c".split()
    say = lambda n: " ".join(rng.choice(stock) for _ in range(n))
    rows = [{"id": f"HP:{i:07d}", "label": say(rng.randint(1, 3)), "synonyms": [say(rng.randint(1, 3)) for _ in range(rng.randint(0, 2))], "definition": say(rng.randint(0, 8)), "alt_ids": []} for i in range(60)]
    rows.append({"id": "HP:0000900", "label": "β-wave (α)", "synonyms": ["?!"], "definition": "slow-wave microsleep, unlike others", "alt_ids": []})
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], "id string, label string, synonyms array<string>, definition string, alt_ids array<string>")
    entries = O.search_entries(frame)
    odd = ["nsomnia", "nxiety", "rosleep", "isturbance", "atack", "tremer", "of the", "the", "abs", "?!", "β-wave", "α", "crosle", "wave microsleep, un", "zzzz", "\t ", "leep", "p", "fera", "earlywaking", "handtremor"]
    terms = spark.createDataFrame([(t,) for t in odd], "term string")
    hits = {}
    for r in O.search(terms, entries, O.token_postings(entries), limit=100).collect():
        hits.setdefault(r.term, {})[r.id] = (r.match_type, r.score)
    stop = set(O.STOPWORDS)
    queries = O.queries_of(terms)
    none = spark.createDataFrame([], "key string, ordinal int")
    every = {(r.term, r.id) for r in O.candidate_pairs(queries, entries, none).select("term", "id").collect()}
    for term in odd:
        q = " ".join(term.lower().split())
        if not q:
            assert term not in hits
            continue
        query = [w for w in words(q) if w not in stop] or words(q)
        want = {e["id"]: (kind, round(score, 4)) for e in rows if (found := rung(q, query, e)) for kind, score in [found]}
        assert set(want) <= {i for t, i in every if t == term}, term
        if not any(w in stock or w[:4] in {s[:4] for s in stock} for w in query if w not in stop) and "β" not in q and "wave" not in q:
            assert hits.get(term, {}) == want, term


def test_no_join_of_everything_with_everything(spark):
    entries = O.search_entries(spark.createDataFrame([("HP:1", "tremor", [], "shaking", [])], "id string, label string, synonyms array<string>, definition string, alt_ids array<string>"))
    queries = O.queries_of(spark.createDataFrame([("haking",)], "term string"))
    near = O.near_entries(queries, entries)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "true" not in [line.split("Join")[1].strip() for line in plan.splitlines() if "Join" in line]
    assert [tuple(r) for r in near.collect()] == [("haking", 1)]
