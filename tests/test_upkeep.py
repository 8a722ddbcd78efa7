import os
import random

import pytest
from pyspark.sql import functions as F

from cohortspark.functions import text as X
from cohortspark.operators import layout, ledger, taxonomy, upsert
from cohortspark.sources import obo, readers

OBO = """format-version: 1.2
ontology: hp

[Term]
id: HP:0000001
name: All

[Term]
id: HP:0000002
name: Low: mood
synonym: "Sad \\"mood\\"" EXACT []
synonym: "Down" RELATED [x:1]
def: "A mood, said \\"low\\"." [ref:1]
alt_id: HP:0000900
is_a: HP:0000001 ! All
[Typedef]
id: HP:part_of
name: part of

[Term]
id: HP:0000003
name: Gone
is_obsolete: true

[Term]
id: MP:0000004
name: Other é
is_a: HP:0000001
"""


@pytest.mark.parametrize("size", [1, 7, 50, 10_000])
def test_ontology_source_reads_each_stanza_once(spark, tmp_path, size):
    obo.register(spark)
    text = OBO + "\n" + "\n".join(f"[Term]\nid: HP:1{i:06d}\nname: n{i}\n" for i in range(5))
    for name, content in (("a.obo", text), ("b.obo", text.replace("\n", "\r\n")), ("_hidden", "[Term]\nid: HP:9\n")):
        (tmp_path / name).write_bytes(content.encode())
    one = spark.read.format("obo").option("range_bytes", size).load(str(tmp_path / "a.obo"))
    rows = sorted(map(tuple, one.collect()))
    assert len(rows) == 9 and rows[1] == ("HP:0000002", "Low: mood", ['Sad \\"mood\\"', "Down"], 'A mood, said \\"low\\".', ["HP:0000900"], ["HP:0000001"], False)
    assert [r[0] for r in rows if r[6]] == ["HP:0000003"] and ("MP:0000004", "Other é") in [r[:2] for r in rows]
    every = spark.read.format("obo").option("range_bytes", size).load(f"file:{tmp_path}")
    assert sorted(map(tuple, every.collect())) == sorted(rows * 2)
    if size < 100:
        assert one.rdd.getNumPartitions() > 1


def test_ontology_source_equals_the_stanza_reader_and_takes_filters(spark, tmp_path):
    (tmp_path / "a.obo").write_text(OBO.replace("[Typedef]", "\n[Typedef]"))
    obo.register(spark)
    read = spark.read.format("obo").load(str(tmp_path / "a.obo"))
    kept = read.where(F.col("id").startswith("HP:"))
    old = readers.ontology_terms(readers.ontology_stanzas(spark, str(tmp_path / "a.obo")), "HP")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, old.select(*read.columns).collect()))
    live = kept.where(F.col("is_obsolete") == F.lit(False))
    assert sorted(r.id for r in live.collect()) == ["HP:0000001", "HP:0000002"]
    plan = live._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in plan.split("BatchScan")[0]
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("obo").load(str(tmp_path / "nowhere")).collect()


def longest(nodes, edges):
    out = {}

    def climb(code, at, steps):
        out[code, at] = max(out.get((code, at), 0), steps)
        for parent in edges.get(at, ()):
            climb(code, parent, steps + 1)

    for n in nodes:
        climb(n, n, 0)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_closure_of_releases(spark, seed):
    rng = random.Random(seed)
    nodes, edges, closure, before = set(range(10)), set(), None, None
    for release in range(4):
        if release:
            nodes = (nodes - set(rng.sample(sorted(nodes), 2))) | {rng.randint(0, 16) for _ in range(3)}
        edges = {(c, p) for c, p in edges if c in nodes and p in nodes and rng.random() < 0.8}
        edges |= {tuple(sorted(rng.sample(sorted(nodes), 2), reverse=True)) for _ in range(4)}
        n = spark.createDataFrame([(x,) for x in nodes], "code int")
        e = spark.createDataFrame(sorted(edges), "child int, parent int")
        closure = taxonomy.ancestor_closure(n, e) if closure is None else taxonomy.updated_closure(closure, n, e, before)
        closure, before = closure.checkpoint(), e
        up = {}
        for c, p in edges:
            up.setdefault(c, []).append(p)
        assert {(r.code, r.ancestor): r.steps for r in closure.collect()} == longest(nodes, up)
    assert sorted(map(tuple, taxonomy.updated_closure(closure, n, e, e).collect())) == sorted(map(tuple, closure.collect()))


def test_cycle_in_a_release_fails(spark):
    n = spark.createDataFrame([(1,), (2,)], "code int")
    e = spark.createDataFrame([(2, 1)], "child int, parent int")
    loop = spark.createDataFrame([(2, 1), (1, 2)], "child int, parent int")
    with pytest.raises(ValueError):
        taxonomy.updated_closure(taxonomy.ancestor_closure(n, e), n, loop, e, levels=8)


def test_counts_observed_in_the_write(spark, tmp_path):
    table = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (None, "n", 3.0)], "k int, x string, y double")
    updates = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "m", 3.0), (4, "d", 4.0)], "k int, x string, y double")
    assert upsert.counted_upsert(table, updates, ["k"], f"{tmp_path}/t") == {"upserted": 1, "matched": 3, "modified": 2}
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t").collect()), key=str) == sorted([(1, "a", 1.0), (2, "b", 2.0), (None, "m", 3.0), (4, "d", 4.0)], key=str)
    assert upsert.counted_upsert(table, updates, ["k"], f"{tmp_path}/u", ["x"]) == {"upserted": 1, "matched": 3, "modified": 1}
    assert (4, "d", None) in map(tuple, spark.read.parquet(f"{tmp_path}/u").collect())
    assert upsert.counted_upsert(table, updates.limit(0), ["k"], f"{tmp_path}/v") == {"upserted": 0, "matched": 0, "modified": 0}


def test_failing_model_gives_each_answer_once(spark, tmp_path):
    seen, path = str(tmp_path / "seen"), str(tmp_path / "ledger")
    os.makedirs(seen)

    def ask(prompt):
        """Fails for the first two tries of each prompt; one prompt always fails."""
        with open(os.path.join(seen, prompt.encode().hex()), "a") as f:
            f.write("x")
            n = f.tell()
        if n < 3 or prompt == "never":
            raise RuntimeError("busy")
        return prompt.upper()

    waits = []
    prompts = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", "a", "never", None, "é"])], "i int, prompt string")
    first = {r.i: (r.answer, r.error, r.tries) for r in ledger.answered(prompts, path, ask, "m", 4, sleep=lambda s: None).collect()}
    assert first == {0: ("A", None, 3), 1: ("B", None, 3), 2: ("A", None, 3), 3: (None, "RuntimeError: busy", 4), 4: (None, None, None), 5: ("É", None, 3)}
    again = {r.i: r.answer for r in ledger.answered(prompts, path, ask, "m", 4, sleep=lambda s: None).collect()}
    assert again == {i: v[0] for i, v in first.items()}
    assert {f: os.path.getsize(os.path.join(seen, f)) for f in os.listdir(seen)} == {"a".encode().hex(): 3, "b".encode().hex(): 3, "é".encode().hex(): 3, "never".encode().hex(): 8}
    assert ledger.entries(spark, path).where("answer is not null").groupBy("digest").count().where("count > 1").isEmpty()
    calling = ledger._calling(lambda p: 1 / 0, "m", 3, 5.0, waits.append)
    import pyarrow as pa

    (out,) = calling([pa.RecordBatch.from_pydict({"digest": ["d"], "prompt": ["p"]})])
    assert waits == [5.0, 10.0, 20.0] and out.column("tries").to_pylist() == [4]


def test_broken_run_goes_on_with_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    prompts = spark.createDataFrame([(f"p{i}",) for i in range(30)], "prompt string")
    ledger.answered(prompts.limit(12), path, str.upper, "m", 4)

    def ask(prompt):
        return prompt.lower()

    rows = {r.prompt: r.answer for r in ledger.answered(prompts, path, ask, "m", 4).collect()}
    assert sum(a.startswith("P") for a in rows.values()) == 12 and sum(a.startswith("p") for a in rows.values()) == 18


def test_tables_by_key_join_without_exchange(spark, tmp_path):
    a = spark.createDataFrame([(i, f"a{i}") for i in range(50)], "k int, x string")
    b = spark.createDataFrame([(i % 40, i) for i in range(90)], "k int, y int")
    left, right = (layout.store_by_key(rows, f"t_{n}", ["k"], 4, f"{tmp_path}/{n}") for n, rows in (("a", a), ("b", b)))
    joined = layout.joined_by_key(left, right, ["k"]).groupBy("k").agg(F.sum("y").alias("s"))
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, a.join(b, "k").groupBy("k").agg(F.sum("y").alias("s")).collect()))
    updates = spark.createDataFrame([(3, "new"), (70, "more")], "k int, x string")
    after = layout.upserted_by_key("t_a", updates, ["k"], "t_a2", 4, f"{tmp_path}/a2")
    assert after.count() == 51 and {r.k: r.x for r in after.collect()}[3] == "new" and {r.k: r.x for r in after.collect()}[70] == "more"
    assert "Exchange" not in layout.joined_by_key(after, right, ["k"])._jdf.queryExecution().executedPlan().toString()
    for name in ("t_a", "t_b", "t_a2"):
        spark.sql(f"DROP TABLE {name}")


def test_segments_by_a_table_function(spark):
    X.register_segments(spark)
    notes = ["• fever\n* cough.\r\n\n..", "a●b ● c ", "", None, "½ dose\x0bé", "-- x\x85y"]
    frame = spark.createDataFrame(list(enumerate(notes)), "i int, note string")
    frame.createOrReplaceTempView("notes_of_test")
    got = {}
    for r in spark.sql("SELECT i, s.pos, s.segment FROM notes_of_test, LATERAL segment_note(note) AS s").collect():
        got.setdefault(r.i, []).append((r.pos, r.segment))
    want = {r.i: r.s for r in frame.select("i", X.segment(F.col("note")).alias("s")).collect()}
    assert {i: [s for _, s in sorted(v)] for i, v in got.items()} == {i: v for i, v in want.items() if v}
