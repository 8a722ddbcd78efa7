import hashlib
import random

import corpus_pipeline


def write(spark, folder, texts, labels, items):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(4)
    parts = "the ing ion and ere hat ver con tor mel san dri pol que lim".split()
    prose = lambda n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))
    good = [prose(rng.randint(40, 120)) + "." for _ in range(260)]
    bad = [" | ".join(f"{rng.randint(0, 9)}$$$ ZZZ!!" for _ in range(rng.randint(20, 60))) for _ in range(120)]
    token = hashlib.sha1(b"k").hexdigest()
    passage = prose(14)
    copy = good[0].split()
    copy[3] = "changed"
    special = [good[0], " ".join(copy + prose(1).split()[:0]), prose(30) + " " + passage + " " + prose(30), prose(30) + f' token = "{token}" ' + prose(30)]
    texts = good + bad + special
    labels = [(i, int(i < 260), 0) for i in range(380)]
    write(spark, tmp_path, texts, labels, [(1, passage), (2, None)])
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sentencepieces":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert sum(i in seen["quality"] for i in range(260)) >= 255 and sum(i in seen["quality"] for i in range(260, 380)) <= 6
    near = seen["near_duplicates"]
    assert 0 in near and 380 not in near
    assert 382 not in seen["decontamination"] and 383 in seen["decontamination"]
    assert token not in seen["secrets"][383].text and seen["secrets"][383].n_chars == len(seen["secrets"][383].text)
    last = seen["sentencepieces"]
    assert set(last) == set(seen["secrets"]) and all(r.n_tokens == len(r.ids) > 0 for r in last.values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(last)


def test_awkward_rows(spark, tmp_path):
    write(spark, tmp_path, [None, "", "a b", "a b", "x" * 50_000], [(2, 1, 0)], [(1, "c d")])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 1
    write(spark, tmp_path / "none", [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_rows_go_by_their_own_text(spark, tmp_path):
    passage = "one two three four five six seven eight nine ten eleven"
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, base), (2, base + " end"), (2, "a text of its own that nobody else has"), (None, passage), (None, "a clean text without an id"), (5, "x " + passage), (5, "a clean text that shares its id"), (6, None), (6, "")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    left = lambda name: {(r.doc_id, r.text) for r in stages[name](spark, frame, str(tmp_path)).collect()}
    assert set(rows) - left("near_duplicates") == {(2, base + " end")}
    assert set(rows) - left("decontamination") == {(None, passage), (5, "x " + passage)}
    assert left("quality") == set(rows)  # without labels nothing is known against a document
    assert stages["secrets"](spark, frame, str(tmp_path)).count() == len(rows)
