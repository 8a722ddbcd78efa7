import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import language_id as L
from cohortspark.llm import quality as Q

from .helpers import LONG, documents, empty

SOUNDS = {"aa": "the ing ion and ere hat", "bb": "ung sch der ein ich keit", "cc": "ción que los ado mente ía"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(0)
    rows = [(i, prose(rng, lang, 40), lang) for i, lang in enumerate(list(SOUNDS) * 30)]
    train = spark.createDataFrame([*rows, (900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string")
    prototypes = L.language_prototypes(train)
    assert sorted(prototypes) == sorted(SOUNDS)
    texts = [prose(rng, lang, 30) for lang in SOUNDS for _ in range(10)] + [None, "", "123 !?", "日本", LONG]
    got = {r.doc_id: r for r in L.predict_languages(documents(spark, texts), prototypes).collect()}
    assert [got[i].lang_pred for i in range(30)] == [lang for lang in SOUNDS for _ in range(10)]
    assert [got[i].lang_pred for i in (30, 31, 32)] == ["und"] * 3 and got[33].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values()) and got[0].kept == "kept"
    assert L.predict_languages(empty(spark), prototypes).collect() == []
    assert L.language_prototypes(train.limit(0)) == {}
    assert {r.lang_pred for r in L.predict_languages(documents(spark, ["abc"]), {}).collect()} == {"und"}


def test_bundles_by_definition(monkeypatch):
    profiles = L.Profiles()
    monkeypatch.setattr(L, "CHUNK", 40)
    texts = ["Ab c1 dÉf", "..x", "", "日本語 テキスト", prose(random.Random(1), "cc", 60), "z"]
    got, has = profiles.vectors(texts)
    for text, vector, letters in zip(texts, got, has, strict=True):
        plain = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split()) + " "
        expected = sum((profiles._gram(map(ord, plain[i : i + 3])) for i in range(len(plain) - 2) if plain[i + 1] != " "), np.zeros(L.DIMENSIONS))
        assert np.array_equal(vector, expected) and letters == any(c.isalpha() for c in text)


def test_quality(spark):
    rng = random.Random(2)
    good = [prose(rng, "aa", rng.randint(20, 120)) + "." for _ in range(300)]
    bad = [" | ".join(f"{rng.randint(0, 9)}$$$ {rng.choice('XYZ') * 3}!!" for _ in range(rng.randint(10, 60))) for _ in range(150)]
    texts = good + bad
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(450)] + [(None, 1, 0), (3, None, 0), (10**6, 1, 0)], "doc_id long, quality int, toxic int")
    model = Q.fold_model(docs, labels)
    got = {r.doc_id: r.quality_score for r in Q.score_quality(docs, model).withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 4 == 2).where("held").collect()}
    right = [(s >= Q.THRESHOLD) == (i < 300) for i, s in got.items()]
    assert len(right) > 80 and sum(right) / len(right) > 0.95
    odd = {r.doc_id: r.quality_score for r in Q.score_quality(documents(spark, [None, "", LONG]), model).collect()}
    assert odd[0] == odd[1] and all(0 <= s <= 1 for s in odd.values())
    assert Q.score_quality(empty(spark), model).collect() == []


@pytest.mark.parametrize(("rows", "expected"), [([], 0.5), ([(0, 1)], 1.0), ([(0, 0)], 0.0)])
def test_quality_without_both_classes(spark, rows, expected):
    docs = documents(spark, ["some text"])
    model = Q.train_quality(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
    assert abs(Q.score_quality(docs, model).first().quality_score - expected) < 0.01


def test_quality_with_a_very_long_text_first(spark):
    rng = random.Random(3)
    texts = [prose(rng, "aa", 60) if i % 2 else " | ".join(f"{rng.randint(0, 9)}$$$!!" for _ in range(40)) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    model = Q.train_quality(documents(spark, texts), labels, most_bytes=10)  # shorter than any text
    score = model.scorer()
    assert model.good and model.bad and score(texts[1]) > 0.5 > score(texts[0])


def test_scores_equal_plain_python(spark):
    """The score by its definition, and rows that repeat scored each, alike."""
    import math

    import zstandard

    rng = random.Random(5)
    texts = [prose(rng, "aa", rng.randint(1, 400)) if i % 2 else " | ".join(f"{rng.randint(0, 9)}$$$!!" for _ in range(rng.randint(1, 300))) for i in range(160)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    docs = documents(spark, texts)
    model = Q.train_quality(docs, labels)
    tools = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad, b"")]
    got = Q.score_quality(docs.unionByName(docs.where("doc_id < 3")), model).collect()
    assert len(got) == 163
    for r in got:
        data = texts[r.doc_id].encode()
        cut = [data[i : i + 1024] for i in range(0, len(data), 1024)]
        good, bad = (sum(len(tool.compress(x)) for x in cut) for tool in tools[:2])
        plain = len(tools[2].compress(data)) / (len(data) + 16)
        z = sum(w * x for w, x in zip(model.weights, (1, 20 * (bad - good) / max(1, bad + good), plain, plain**2)))
        assert abs(r.quality_score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9


def test_repeated_rows_have_one_language(spark):
    rng = random.Random(6)
    train = spark.createDataFrame([(i, prose(rng, lang, 40), lang) for i, lang in enumerate(list(SOUNDS) * 20)], "doc_id long, text string, lang string")
    prototypes = L.language_prototypes(train.unionByName(train))
    docs = documents(spark, [prose(rng, "bb", 30), None])
    got = sorted((r.doc_id, r.lang_pred) for r in L.predict_languages(docs.unionByName(docs), prototypes).collect())
    assert got == [(0, "bb"), (0, "bb"), (1, "und"), (1, "und")]


def test_quality_sample_takes_sizes_first(spark):
    """Texts are taken up to the bytes given, one an id; what is not taken does not matter, however long it is."""
    draw = random.Random(8)
    say = lambda stock, n: " ".join(draw.choice(stock) for _ in range(n))
    good, bad = "the of plain prose reads well enough today".split(), "buy now click win cash free offer xx".split()
    texts = [(i, say(good if i % 2 else bad, 60)) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    small = Q.train_quality(frame(texts), labels, most_bytes=8000)
    order = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    taken = set()
    for q in (0, 1):
        mine, size = [i for i in order if i % 2 == q], 0
        for n, i in enumerate(mine):
            if size <= 8000 or n < Q.LEAST_TEXTS:
                taken.add(i)
            size += len(texts[i][1])
    assert len(taken) < 100
    huge = [(i, t if i in taken else "z" * 1_000_000) for i, t in texts]
    again = Q.train_quality(frame(huge + texts[:7]), labels, most_bytes=8000)
    assert (small.good, small.bad, small.weights) == (again.good, again.bad, again.weights)
