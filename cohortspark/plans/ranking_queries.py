"""Queries over vectors, similarity, taxonomies and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import ranking as R
from ..operators import similarity as S
from ..operators import taxonomy as X
from . import views as W

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, r.vec_id, round(list_dot_product(r.e, q.e) / (sqrt(list_dot_product(r.e, r.e)) * sqrt(list_dot_product(q.e, q.e))), 4) AS score FROM v AS q JOIN v AS r ON q.vec_id % 20 = 0 AND r.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def v1_cosine_topk_all(spark, d):
    """The nearest rows of every row whose vec_id is divisible by 20."""
    rows = W.table(spark, d, "embeddings")
    return S.cosine_topk(rows, rows.where("vec_id % 20 = 0"))


_SETS = """WITH s AS (SELECT DISTINCT l_orderkey AS owner, p_brand AS x FROM lineitem JOIN part ON l_partkey = p_partkey), q AS (SELECT unnest(['Brand#1', 'Brand#12', 'Brand#20', 'Brand#99']) AS y),
p AS (SELECT owner, x, y, CASE WHEN x = y THEN 1.0 WHEN substr(x, 1, 7) = substr(y, 1, 7) THEN 0.5 ELSE 0.0 END AS sim FROM s, q)
"""


@query(_SETS + """SELECT owner, round(0.5 * a + 0.5 * b, 4) AS set_similarity FROM (SELECT owner, avg(m) AS a FROM (SELECT owner, y, max(sim) AS m FROM p GROUP BY ALL) GROUP BY 1) JOIN (SELECT owner, avg(m) AS b FROM (SELECT owner, x, max(sim) AS m FROM p GROUP BY ALL) GROUP BY 1) USING (owner)""")
def a5_set_similarity(spark, d):
    items = W.table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("owner")).join(W.table(spark, d, "part"), "p_partkey")
    sets = items.groupBy("owner").agg(F.collect_set("p_brand").alias("brands"))
    query_set = F.array(*map(F.lit, ("Brand#1", "Brand#12", "Brand#20", "Brand#99")))
    sim = lambda x, y: F.when(x == y, 1.0).when(F.substring(x, 1, 7) == F.substring(y, 1, 7), 0.5).otherwise(0.0)
    return sets.select("owner", F.round(S.array_set_similarity(query_set, F.col("brands"), sim), 4).alias("set_similarity"))


@query(_SETS + """SELECT owner, round(0.5 * a + 0.5 * b, 4) AS set_similarity FROM (SELECT owner, avg(m) AS a FROM (SELECT owner, y, max(sim) AS m FROM p GROUP BY ALL) GROUP BY 1) JOIN (SELECT owner, avg(m) AS b FROM (SELECT owner, x, max(sim) AS m FROM p GROUP BY ALL) GROUP BY 1) USING (owner)""")
def a5_set_similarity_long(spark, d):
    items = W.table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("owner")).join(W.table(spark, d, "part"), "p_partkey")
    # an owner's rows come together once, before they are told apart and paired
    sets = W.spread(items.select("owner", F.col("p_brand").alias("c_key")), "owner").distinct()
    pairs = sets.withColumn("q_key", F.explode(F.array(*map(F.lit, ("Brand#1", "Brand#12", "Brand#20", "Brand#99")))))
    sim = F.when(F.col("c_key") == F.col("q_key"), 1.0).when(F.substring("c_key", 1, 7) == F.substring("q_key", 1, 7), 0.5).otherwise(0.0)
    return S.set_similarity(pairs.withColumn("sim", sim), ["owner"]).withColumn("set_similarity", F.round("set_similarity", 4))


@query("""WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 11 / 10.0 END AS a, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 7 / 6.0 END AS b, CASE WHEN c_custkey % 12 <> 0 THEN c_custkey % 2 * 1.0 END AS c FROM customer)
SELECT c_custkey, round(CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN 0 ELSE (coalesce(0.4 * a, 0) + coalesce(0.4 * b, 0) + coalesce(0.2 * c, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 0.4 END + CASE WHEN b IS NULL THEN 0 ELSE 0.4 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END) END, 4) AS score FROM s""")
def a6_composite_score(spark, d):
    k = F.col("c_custkey")
    parts = [(F.when(k % 3 != 0, k % 11 / 10.0), 0.4), (F.when(k % 4 != 0, k % 7 / 6.0), 0.4), (F.when(k % 12 != 0, k % 2 * 1.0), 0.2), (F.lit(1.0), 0.0)]
    return W.table(spark, d, "customer").select("c_custkey", F.round(V.composite(parts), 4).alias("score"))


@query(f"""WITH {W.PATIENTS_SQL} SELECT case_no, round({W.age_sql('age', 'CAST(41 AS DOUBLE)')}, 4) AS age_similarity FROM patients""")
def v8_age_gauss(spark, d):
    return W.patients(spark, d).select("case_no", F.round(V.age_similarity(F.col("age"), F.lit(41.0)), 4).alias("age_similarity"))


@query(f"""WITH {W.PATIENTS_SQL}, a AS (SELECT case_no, gender, {W.age_sql('age', 'CAST(41 AS DOUBLE)')} AS s FROM patients) SELECT case_no, round(CASE WHEN s = 0 THEN 0.0 ELSE (s + CASE WHEN gender = 'BUILDING' THEN 1.0 ELSE 0.0 END) / 2 END, 4) AS demographic FROM a""")
def v9_demographic(spark, d):
    return W.patients(spark, d).select("case_no", F.round(V.demographic_similarity(F.col("age"), F.lit(41.0), F.col("gender"), F.lit("Building")), 4).alias("demographic"))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderpriority = '2-HIGH' THEN 1.0 ELSE 0.5 END AS DOUBLE) AS visit_similarity FROM orders""")
def v10_visit_type(spark, d):
    return W.table(spark, d, "orders").select("o_orderkey", V.visit_type_similarity(F.col("o_orderpriority"), F.lit("2-high")).alias("visit_similarity"))


@query("""SELECT c_custkey, round(CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 11 / 10.0 ELSE 0.5 * (c_custkey % 11 / 10.0) + 0.5 * (c_custkey % 7 / 8.0) END, 4) AS case_score FROM customer""")
def v11_case_score(spark, d):
    k = F.col("c_custkey")
    return W.table(spark, d, "customer").select("c_custkey", V.case_score(k % 11 / 10.0, F.when(k % 5 != 0, k % 7 / 8.0)).alias("case_score"))


def _evidence(spark, d):
    """(query_id, case_id, lca, cos): each region as a query entity against each visit."""
    people = W.table(spark, d, "customer").join(W.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("case_no"), "n_regionkey")
    rows = W.visits(spark, d).join(people, "case_no")
    each = rows.withColumn("query_id", F.explode(F.array(*map(F.lit, range(5)))))
    return each.select("query_id", F.col("visit_id").alias("case_id"), F.when(F.col("n_regionkey") == F.col("query_id"), 1.0).otherwise(0.3).alias("lca"), ((F.col("case_no") * 7 + F.col("query_id")) % 100 / 100.0).alias("cos"))


_EVIDENCE = f"""WITH {W.VISITS_SQL}, {W.PATIENTS_SQL}, {W.MEDICINES_SQL}, pairs AS (SELECT query_id, visit_id AS case_id, CASE WHEN n_regionkey = query_id THEN 1.0 ELSE 0.3 END AS lca, (case_no * 7 + query_id) % 100 / 100.0 AS cos
FROM visits JOIN customer ON case_no = c_custkey JOIN nation ON c_nationkey = n_nationkey, (SELECT CAST(unnest(range(5)) AS INTEGER) AS query_id)), clinical AS (SELECT query_id, case_id, max(lca) AS best_lca, max(cos) AS best_cos, 0.5 * max(lca) + 0.5 * max(cos) AS clinical_sim FROM pairs GROUP BY ALL)
"""


@query(_EVIDENCE + "SELECT query_id, case_id, CAST(best_lca AS DOUBLE) AS best_lca, best_cos, round(clinical_sim, 4) AS clinical_sim FROM clinical")
def v12_best_of_each(spark, d):
    return R.best_evidence(W.spread(_evidence(spark, d), "case_id"), ["query_id", "case_id"]).withColumn("clinical_sim", F.round("clinical_sim", 4))


_TOP = _EVIDENCE + f""", scored AS (SELECT c.*, round(0.5 * clinical_sim + 0.5 * ({W.age_sql('age', 'CAST(41 AS DOUBLE)')}), 4) AS case_score FROM clinical c JOIN visits ON case_id = visit_id JOIN patients USING (case_no) WHERE clinical_sim >= 0.5 AND abs(({W.band_sql('age')}) - ({W.band_sql('41')})) < 3),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY case_score DESC, clinical_sim DESC, case_id) AS place FROM scored) WHERE place <= 20),
used AS (SELECT * FROM (SELECT t.*, molecule, brand, is_fdc, pos, row_number() OVER (PARTITION BY query_id, case_id, lower(molecule) ORDER BY pos) AS n FROM top t JOIN medicines ON case_id = visit_id) WHERE n = 1),
agg AS (SELECT query_id, molecule, count(*) AS frequency, round(sum(case_score), 4) AS score, array_to_string(list_sort(list_distinct(list(brand)))[1:5], ',') AS brands, arg_max(is_fdc, struct_pack(a := place, b := pos)) AS is_fdc, round(avg(case_score), 4) AS avg_similarity FROM used GROUP BY ALL)
"""


@query(_TOP + """SELECT query_id, rank, molecule, frequency, score, brands, is_fdc, round(frequency / (SELECT count(*) FROM top t WHERE t.query_id = r.query_id) * 100, 1) AS percentage FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frequency DESC, avg_similarity DESC, molecule) AS INTEGER) AS rank FROM agg) r WHERE rank <= 10""")
def q2_rank_molecules(spark, d):
    cases = W.visits(spark, d).join(W.patients(spark, d), "case_no").select(F.col("visit_id").alias("case_id"), "age", "gender")
    meds = W.medicines(spark, d).select(F.col("visit_id").alias("case_id"), "pos", "molecule", "brand", "is_fdc")
    ranked = R.rank_medicines(_evidence(spark, d), cases, meds, ["query_id"], k=10, limit=20, min_similarity=0.5, age=F.lit(41.0))
    return ranked.select("query_id", "rank", "molecule", "frequency", "score", F.array_join("brands", ",").alias("brands"), "is_fdc", "percentage")


@query(_TOP + "SELECT query_id, CAST(place AS INTEGER) AS place, case_id, case_score FROM top")
def w6_top_cases(spark, d):
    cases = W.visits(spark, d).join(W.patients(spark, d), "case_no").select(F.col("visit_id").alias("case_id"), "age", "gender")
    scored = R.best_evidence(W.spread(_evidence(spark, d), "case_id"), ["query_id", "case_id"]).join(cases, "case_id")
    return R.top_cases(scored, ["query_id"], 20, 0.5, F.lit(41.0)).select("query_id", "place", "case_id", "case_score")


@query(f"""WITH {W.VISITS_SQL}, {W.PATIENTS_SQL}, {W.MEDICINES_SQL}, m AS (SELECT visit_id AS case_id, avg(CASE WHEN form = 'SMALL' THEN 1.0 WHEN form = 'MEDIUM' THEN 0.5 ELSE 0.0 END) AS symptom_sim FROM medicines GROUP BY 1), dx AS (SELECT visit_id AS case_id, max(CASE WHEN molecule = 'red bolt' THEN 1.0 ELSE 0.25 END) AS diagnosis_sim FROM medicines WHERE l_returnflag = 'N' GROUP BY 1),
s AS (SELECT visit_id AS case_id, case_no, visit_date, symptom_sim, diagnosis_sim, CASE WHEN a.s = 0 THEN 0.0 ELSE (a.s + CASE WHEN gender = 'BUILDING' THEN 1.0 ELSE 0.0 END) / 2 END AS dem, CASE WHEN visit_reason = '2-HIGH' THEN 1.0 ELSE 0.5 END AS vis FROM visits JOIN (SELECT *, {W.age_sql('age', 'CAST(41 AS DOUBLE)')} AS s FROM patients) a USING (case_no) LEFT JOIN m ON case_id = visit_id LEFT JOIN dx ON dx.case_id = visit_id),
f AS (SELECT *, round((coalesce(0.4 * symptom_sim, 0) + coalesce(0.4 * diagnosis_sim, 0) + 0.1 * dem + 0.1 * vis) / (CASE WHEN symptom_sim IS NULL THEN 0 ELSE 0.4 END + CASE WHEN diagnosis_sim IS NULL THEN 0 ELSE 0.4 END + 0.2), 4) AS final FROM s),
c AS (SELECT *, row_number() OVER (PARTITION BY case_no ORDER BY final DESC, coalesce(diagnosis_sim, -1) DESC, coalesce(symptom_sim, -1) DESC, visit_date DESC, case_id) AS n FROM f)
SELECT case_id, case_no, final FROM c WHERE n <= 3 ORDER BY final DESC, coalesce(diagnosis_sim, -1) DESC, coalesce(symptom_sim, -1) DESC, visit_date DESC, case_id LIMIT 10""")
def q1_similar_cases(spark, d):
    cases = W.visits(spark, d).join(W.patients(spark, d), "case_no").withColumnRenamed("visit_id", "case_id")
    meds = W.medicines(spark, d)
    symptoms = meds.groupBy(F.col("visit_id").alias("case_id")).agg(F.avg(F.when(F.col("form") == "SMALL", 1.0).when(F.col("form") == "MEDIUM", 0.5).otherwise(0.0)).alias("set_similarity"))
    diagnoses = meds.where("l_returnflag = 'N'").groupBy(F.col("visit_id").alias("case_id")).agg(F.max(F.when(F.col("molecule") == "red bolt", 1.0).otherwise(0.25)).alias("set_similarity"))
    return S.similar_cases({"age": 41.0, "gender": "building", "visit_type": "2-HIGH"}, cases, symptoms, diagnoses, 10).select("case_id", "case_no", "final")


def _graph(spark, d):
    """Edges of the tree: world, region, nation, customer."""
    region = W.table(spark, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("child"), F.lit("W").alias("parent"))
    nation = W.table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("child"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("parent"))
    people = W.table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("child"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("parent"))
    edges = region.unionByName(nation).unionByName(people)
    nodes = edges.select(F.col("child").alias("code")).unionByName(spark.range(1).select(F.lit("W").alias("code")))
    return nodes, edges


@query("""WITH RECURSIVE e AS (SELECT 'R' || r_regionkey AS child, 'W' AS parent FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer),
n AS (SELECT child AS code FROM e UNION ALL SELECT 'W'), up AS (SELECT code, code AS ancestor, 0 AS steps FROM n UNION ALL SELECT up.code, e.parent, steps + 1 FROM up JOIN e ON up.ancestor = e.child)
SELECT code, CAST(max(steps) + 1 AS INTEGER) AS depth, count(*) AS n_ancestors FROM up GROUP BY 1""")
def v4_depth_closure(spark, d):
    closure = X.ancestor_closure(*_graph(spark, d))
    return closure.groupBy("code").agg((F.max("steps") + 1).alias("depth"), F.count("*").alias("n_ancestors"))


@query("""WITH p AS (SELECT 'C' || c_custkey AS a, 'N' || c_custkey % 27 AS b, c_nationkey AS na, c_custkey % 27 AS nb FROM customer)
SELECT a, b, round(CASE WHEN n2.n_nationkey IS NULL THEN 0.0 WHEN na = nb THEN 6.0 / 7 WHEN n1.n_regionkey = n2.n_regionkey THEN 4.0 / 7 ELSE 0.0 END, 6) AS wu_palmer FROM p JOIN nation n1 ON na = n1.n_nationkey LEFT JOIN nation n2 ON nb = n2.n_nationkey""")
def v3_wu_palmer(spark, d):
    pairs = W.table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("a"), F.concat(F.lit("N"), F.col("c_custkey") % 27).alias("b"))
    return X.wu_palmer(pairs, X.ancestor_closure(*_graph(spark, d)), generic_depth=1).select("a", "b", F.round("wu_palmer", 6).alias("wu_palmer"))


@query("""SELECT event_id, round((40 * event_id * CASE WHEN event_id % 2 = 0 THEN 1.25 ELSE 0.075 END + 10 * user_id * CASE WHEN event_id % 2 = 0 THEN 5.0 ELSE 0.3 END) / 1000000, 6) AS cost FROM events""")
def v13_call_cost(spark, d):
    family = F.when(F.col("event_id") % 2 == 0, "x-pro").otherwise("x-light")
    return W.table(spark, d, "events").select("event_id", V.call_cost(family, 40 * F.col("event_id"), 10 * F.col("user_id")).alias("cost"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 WHEN 3 THEN 0.5 WHEN 4 THEN 1.0 ELSE 0.5 END::DOUBLE AS similarity FROM orders""")
def v10_visit_synonyms(spark, d):
    """Kinds of visits under their several names, blank ones being like no other."""
    k = F.col("o_orderkey") % 6
    pairs = (("FU visit", "Follow-Up"), ("First contact", "new consultation"), ("follow up", "New"), ("", ""), (" Home ", "home"), (None, "home"))
    side = lambda n: F.element_at(F.array(*(F.lit(p[n]) for p in pairs)), (k + 1).cast("int"))
    return W.table(spark, d, "orders").select("o_orderkey", V.visit_type_similarity(side(0), side(1)).alias("similarity"))
