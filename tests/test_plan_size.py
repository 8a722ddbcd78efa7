"""Values that a rule names often are computed once: counted in the plans."""

from pyspark.sql import functions as F

from cohortspark.functions import answers as N
from cohortspark.operators import assessment as A


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _texts(spark):
    return spark.range(2).select("id", F.concat(F.lit('{"summary": "'), F.col("id").cast("string"), F.lit('"}')).alias("text"))


def test_an_answer_is_parsed_once(spark):
    for contract in (N.triage_answer, N.med_check_answer, N.prescription_answer):
        plan = _plan(_texts(spark).select(contract(F.col("text")).alias("a")))
        # the whole text, and from the first to the last brace
        assert plan.count("parseJson") == 2, (contract.__name__, plan.count("parseJson"))


def test_an_item_is_found_once(spark):
    rows = _texts(spark).withColumns({"symptoms": F.array("text"), "past_symptoms": F.array(F.lit("x"))})
    marked = A.keyword_marks(rows).withColumn("a", N.triage_answer(F.col("text"))).localCheckpoint()
    plan = _plan(marked.select(A.answered_items(F.col("marks"), F.col("a.triaged_items")).alias("items")))
    # equal names and one inside the other, each looked for once
    assert plan.count("filter(") <= 6, plan.count("filter(")


def test_vectors_are_not_shuffled_with_each_owner(spark):
    from cohortspark.operators import pairs as P

    held = spark.createDataFrame([(1, [("a", "A", 1), ("b", None, 2), ("A ", "A", 9)]), (2, [("c", None, None), (" ", "B", 2)])], "o long, e array<struct<term: string, code: string, vector_id: int>>")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vector_id int, embedding array<double>")
    got = P.entities(held, ["o"], "e", F.broadcast(vectors))
    assert sorted((r.o, r.pos, r.term, r.code, r.embedding) for r in got.collect()) == [(1, 0, "a", "A", [1.0, 0.0]), (1, 1, "b", None, [0.0, 1.0]), (2, 0, "c", None, None)]
    # the entities are met with their vectors after the only shuffle
    plan = got._jdf.queryExecution().sparkPlan().toString().split("\n")
    assert min(i for i, line in enumerate(plan) if "embedding" in line) < min(i for i, line in enumerate(plan) if "Aggregate" in line)
    assert not any("embedding" in line for line in plan if "Aggregate" in line)


def test_an_index_of_trigrams_is_not_broadcast(spark, tmp_path):
    from cohortspark.operators import similar_strings as S

    spark.createDataFrame([(1, "abcdef"), (2, "xabcy"), (3, None)], "id int, text string").write.parquet(f"{tmp_path}/texts")
    spark.createDataFrame([("abc",), ("bcde",), ("x",), ("zzz",), ("",)], "q string").write.parquet(f"{tmp_path}/asked")
    texts, asked = spark.read.parquet(f"{tmp_path}/texts"), spark.read.parquet(f"{tmp_path}/asked")
    found = S.containing(asked, S.gram_postings(texts, "id", "text"), "id")
    assert sorted(map(tuple, found.collect())) == [("abc", 1), ("abc", 2), ("bcde", 1), ("x", 2)]
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()


def test_ids_that_parts_share_give_each_of_them(spark, tmp_path):
    import duckdb

    from cohortspark.plans import search_queries as Q

    keys = [*range(8), 100_000, 100_001, 999_997, *range(1_000_000, 1_000_013)]
    parts = spark.createDataFrame([(k, f"n{k}", f"t{k}") for k in keys], "p_partkey long, p_name string, p_type string")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, Q.t11_get_by_id(spark, str(tmp_path)).select("asked", "id", "label", "definition").collect()))
    duck = duckdb.connect()
    duck.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted(duck.sql(Q.ORACLE_SQL["t11_get_by_id"]).to_arrow_table().select(["asked", "id", "label", "definition"]).to_pandas().itertuples(index=False, name=None))
    assert sum(asked == "HP:9100000 " for asked, *_ in got) == 3


def test_answers_of_a_small_file_are_read_by_every_core(spark, tmp_path):
    from cohortspark.plans import assessment_queries as Q

    parts = spark.createDataFrame([(k, f"n{k}", f"Brand#{k}", f"t{k}") for k in range(60)], "p_partkey long, p_name string, p_brand string, p_type string")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("contract_triage", "contract_med_check", "contract_prescriptions", "contract_search_queries"):
        found = Q.QUERIES[name](spark, str(tmp_path))
        assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name
        assert sorted(r.p_partkey for r in found.collect()) == list(range(60)), name


def test_tasks_of_rankings_and_sets_stay_small(spark):
    from cohortspark.plans import ranking_queries as Q
    from cohortspark.plans import workflow_queries as W

    # a set number of parts is not packed into few great ones
    for name, found in [*Q.QUERIES.items(), *W.QUERIES.items()]:
        if name in ("a5_set_similarity_long", "q2_rank_molecules", "q5_entity_matrix", "w6_top_cases", "v12_best_of_each"):
            assert "REPARTITION_BY_NUM" in found(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString(), name


def test_closures_send_no_table_to_the_driver(spark, tmp_path):
    from cohortspark.operators import taxonomy as X

    rows = [(c, c // 3) for c in range(1, 40)]
    spark.createDataFrame(rows, "child long, parent long").write.parquet(f"{tmp_path}/edges")
    spark.createDataFrame([(c,) for c in range(40)], "code long").write.parquet(f"{tmp_path}/nodes")
    edges, nodes = spark.read.parquet(f"{tmp_path}/edges"), spark.read.parquet(f"{tmp_path}/nodes")
    old = edges.where("child % 5 <> 0")
    found = X.updated_closure(X.ancestor_closure(nodes, old), nodes, edges, old)
    got = sorted(map(tuple, found.collect()))
    # as it was run
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert got == sorted(map(tuple, X.ancestor_closure(nodes, edges).collect()))


def test_findings_are_computed_once(spark):
    from cohortspark.plans import search_queries as Q

    # one pass over the tokens, not another for the filter
    assert _plan(Q.n2_scoped_findings(spark, "/root/testdata/sf0.001")).count("aggregate(") == 1


def test_terms_of_migrated_cases_are_found_once(spark):
    from cohortspark.functions import text as T
    from cohortspark.plans import workflows as P

    rows = spark.createDataFrame([(1, "no fever, rash, no fever"), (2, None), (3, "cough")], "i int, names string")
    plans = []

    def resolver(terms):
        plans.append(_plan(terms))
        return terms.where("term <> 'cough'").withColumn("code", F.upper("term"))

    found = P.decorate_terms(rows, ["i"], "names", T.comma_terms, resolver, "found")
    got = {r.i: [tuple(x) for x in r.found] for r in found.collect()}
    assert got == {1: [(0, "no fever", "NO FEVER", True), (1, "rash", "RASH", False), (2, "no fever", "NO FEVER", True)], 3: [(0, "cough", None, False)]}
    # the resolver reads what was written, and the terms of a row come together without an exchange of their own
    assert len(plans) == 1 and "Generate" not in plans[0], plans
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan, plan


def test_terms_of_decorated_cases_are_found_once(spark, monkeypatch):
    from cohortspark.operators import resolution as R
    from cohortspark.plans import resolution_queries as Q

    plans, search = [], R.O.search

    def seen(terms, *rest, **options):
        plans.append(_plan(terms))
        return search(terms, *rest, **options)

    monkeypatch.setattr(R.O, "search", seen)
    Q.n7_decorated_cases(spark, "/root/testdata/sf0.001")
    assert len(plans) == 2 and not any("Generate" in p for p in plans), plans
