import random
import re

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import medicines as M
from cohortspark.operators import text_index as T

KIND = "ident int, brand_name string, canonical_molecule string, clinical_dosing_indication string, score int, term string"


def words(text):
    return set(re.findall(r"\b([a-z0-9]+)\b", (text or "").lower(), re.ASCII))


def best(master, query, k):
    wanted = words(query)
    scored = []
    for ident, brand, molecule, use, *_ in master:
        total = sum(w * len(wanted & words(f)) for f, w in zip((brand, molecule, use), M.SEARCH_WEIGHTS, strict=True))
        if wanted and total:
            scored.append((-round(total / len(wanted) + 1e-12, 4), (brand is not None, brand or ""), (molecule is not None, molecule or ""), ident))
    return [(n + 1, s[3], -s[0]) for n, s in enumerate(sorted(scored)[:k])]


def master(seed, n):
    rng = random.Random(seed)
    stock = [f"w{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(300)]
    say = lambda a, b: " ".join(rng.choice(stock) for _ in range(rng.randint(a, b)))
    rows = [(i, say(1, 2), say(0, 2) or None, say(0, 5), 1, "x") for i in range(n)]
    return rows + [(n, None, None, None, 1, "x"), (n + 1, "Straße 50mg", "β-blocker w1", "W1, w1; w2", 1, "x")], rng, say


@pytest.mark.parametrize("k", [1, 3, 20, 1000])
def test_search_equals_scoring_every_row(spark, tmp_path, k):
    rows, rng, say = master(k, 250)
    frame = spark.createDataFrame(rows, KIND)
    M.index_master(frame, f"{tmp_path}/i", "ident")
    asked = [say(1, 4) for _ in range(60)] + ["W1 w1", "", None, "!?", "unknown", "unknown w1", "blocker", "50mg w1 w2 w3"]
    found = {}
    for r in M.text_search_all(frame, f"{tmp_path}/i", spark.createDataFrame([(q,) for q in [*asked, *asked[:5]]], "query string"), k, "ident").collect():
        found.setdefault(r.query, []).append((r["rank"], r.id, r.score))
    for q in asked:
        assert sorted(found.get(q, [])) == best(rows, q, k), q
        if q:
            alone = [(r.ident, r.score) for r in M.text_search(frame.drop("score"), q, k, "ident").collect()]
            assert alone == [x[1:] for x in sorted(found.get(q, []))]


def test_lists_that_cannot_matter_are_not_read(spark, tmp_path):
    rows = [(i, "common", f"name{i % 50}", "everywhere", 1, "x") for i in range(400)]
    frame = spark.createDataFrame(rows, KIND)
    M.index_master(frame, f"{tmp_path}/i", "ident")
    asked = spark.createDataFrame([("name7 everywhere",), ("common everywhere",), ("name7 common",)], "query string")
    planned = T.plan_lists(spark, f"{tmp_path}/i", asked, 3, M.MASTER_FIELDS)
    lists = {(r.query, r.term): r.essential for r in planned.lists.join(planned.queries, "qid").collect()}
    # eight rows hold name7 and the other word; what only that finds gets less
    assert lists["name7 everywhere", "name7"] and not lists["name7 everywhere", "everywhere"]
    assert lists["name7 common", "name7"] and not lists["name7 common", "common"]
    assert lists["common everywhere", "common"]
    some = T.plan_lists(spark, f"{tmp_path}/i", asked.where("query = 'name7 everywhere'"), 3, M.MASTER_FIELDS).lists.where("essential")
    plan = T.read_postings(spark, f"{tmp_path}/i", some)._jdf.queryExecution().executedPlan().toString()
    (shard,) = {r.shard for r in some.collect()}
    assert "shard#" in plan and f"= {shard})" in plan.split("PartitionFilters")[1]


def test_vector_search_for_a_table_of_queries(spark):
    rng = random.Random(3)
    unit = lambda: [rng.gauss(0, 1) for _ in range(5)]
    rows = [(i, unit()) for i in range(120)] + [(200, None), (201, [0.0] * 5)]
    asked = [(q, unit()) for q in range(10)]
    got = M.vector_search_all(spark.createDataFrame(rows, "ident int, embedding array<double>"), spark.createDataFrame(asked, "query int, embedding array<double>"), 4, 0.3, "ident")
    size = lambda v: sum(x * x for x in v) ** 0.5
    want = []
    for q, v in asked:
        near = sorted((-round(c, 4), i) for i, w in rows if w and size(w) and (c := sum(x * y for x, y in zip(v, w, strict=True)) / size(v) / size(w)) >= 0.3)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near[:4])]
    assert sorted(map(tuple, got.collect())) == want


def test_refreshed_master_embeds_new_digests_once(spark):
    kind = "brand_name string, canonical_molecule string, dosage_group_id string, clinical_dosing_indication string"
    table = spark.createDataFrame([("A", "a", "1", "Pain"), ("B", "b", "1", "Fever")], kind)
    stored = M.with_digest(table).withColumn("embedding", F.array(F.lit(9.0)))
    updates = spark.createDataFrame([("A", "a", "1", "Pain"), ("B", "b", None, "Cough"), ("C", "c", "2", "Sleep"), ("C", "c", "2", "Sleep")], kind)
    out = {r.brand_name: r for r in M.refreshed_master(stored, updates, lambda t: F.array(F.length(t).cast("double"))).collect()}
    assert out["A"].embedding == [9.0] and out["A"].dosage_group_id == "1"
    assert out["B"].digest_text == "b, marketed as B, is used as cough." and out["B"].embedding == [float(len(out["B"].digest_text))] and out["B"].dosage_group_id == "1"
    assert out["C"].embedding == [float(len(out["C"].digest_text))] and len(out) == 3


def test_rows_of_equal_texts_are_searched_as_one(spark, tmp_path):
    frame = spark.createDataFrame([(i, "Brand", f"name{i % 2}", None if i % 3 else "use") for i in range(60)], "ident int, brand_name string, canonical_molecule string, clinical_dosing_indication string")
    M.index_master(frame, f"{tmp_path}/i", "ident")
    assert spark.read.parquet(f"{tmp_path}/i/rows").count() == 4
    asked = spark.createDataFrame([("brand",), ("name1 use",)], "query string")
    got = sorted((r.query, r["rank"], r.id) for r in M.text_search_all(frame, f"{tmp_path}/i", asked, 4, "ident").collect())
    assert got == [("brand", i + 1, 2 * i) for i in range(4)] + [("name1 use", i + 1, 3 + 6 * i) for i in range(4)]
    rows = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(40)], "ident int, embedding array<double>")
    near = M.vector_search_all(rows, spark.createDataFrame([("q", [1.0, 0.0])], "query string, embedding array<double>"), 3, 0.3, "ident")
    assert sorted((r["rank"], r.id) for r in near.collect()) == [(1, 0), (2, 2), (3, 4)]


def test_vector_search_gives_back_rows_of_equal_vectors_by_id(spark):
    rows = spark.createDataFrame([("c", [2.0, 0.0]), ("a", [2.0, 0.0]), ("b", [1.0, 1.0]), ("d", None), ("e", [0.0, 0.0])], "brand_name string, embedding array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("none", None)], "query string, embedding array<double>")
    assert sorted(tuple(r) for r in M.vector_search_all(rows, asked, 5).collect()) == [("q", 1, "a", 1.0), ("q", 2, "c", 1.0), ("q", 3, "b", 0.7071)]


def test_names_that_functions_read_are_there():
    import builtins
    import dis
    import importlib
    import pkgutil
    import types

    import cohortspark

    def read(code):
        yield from (i.argval for i in dis.get_instructions(code) if i.opname == "LOAD_GLOBAL")
        for inner in code.co_consts:
            if isinstance(inner, types.CodeType):
                yield from read(inner)

    missing = []
    for found in pkgutil.walk_packages(cohortspark.__path__, "cohortspark."):
        if found.name.startswith("cohortspark.llm") or found.name.endswith("__main__"):
            continue
        module = importlib.import_module(found.name)
        with open(module.__file__) as f:
            names = set(read(compile(f.read(), module.__file__, "exec")))
        missing += [(found.name, n) for n in sorted(names) if not hasattr(module, n) and not hasattr(builtins, n)]
    assert missing == []
