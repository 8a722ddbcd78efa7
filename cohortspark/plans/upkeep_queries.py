"""Queries over what is kept up to date: closures of releases, observed upserts, call ledgers, ontology files, bucketed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import layout, ledger, taxonomy, upsert
from ..session import ensure_checkpoint_dir
from ..sources import obo
from . import views as W

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _folder(spark, name):
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


@query("""WITH RECURSIVE n AS (SELECT c_custkey AS c FROM customer WHERE c_custkey % 50 <> 49), e AS (SELECT DISTINCT c AS child, p AS parent FROM (SELECT c, c // 3 AS p FROM n WHERE c % 11 <> 10 UNION SELECT c, c // 5 FROM n WHERE c % 7 = 0) WHERE p < c AND p % 50 <> 49),
w AS (SELECT c AS code, c AS ancestor, 0 AS steps FROM n UNION SELECT code, parent, steps + 1 FROM w JOIN e ON ancestor = child), m AS (SELECT code, ancestor, max(steps) AS steps FROM w GROUP BY ALL)
SELECT code, count(*) AS n_ancestors, CAST(sum(steps) AS BIGINT) AS total_steps, max(steps) + 1 AS depth FROM m GROUP BY 1""")
def v4_closure_of_releases(spark, d):
    """The closure of a hierarchy after two releases that add and remove codes and edges, each made from the one before."""
    k = F.col("c_custkey")
    every = W.table(spark, d, "customer").select(k.alias("c"))
    named = lambda rows, parent: rows.select(F.col("c").alias("child"), parent.alias("parent")).where("parent < child")
    c = F.col("c")
    third, fifth = F.floor(c / 3), F.floor(c / 5)
    releases = [
        (every.where("c % 13 <> 12"), named(every.where("c % 13 <> 12"), third)),
        (every.where("c % 50 <> 49"), named(every, third).unionByName(named(every.where("c % 9 = 0"), fifth))),
        (every.where("c % 50 <> 49"), named(every.where("c % 11 <> 10"), third).unionByName(named(every.where("c % 7 = 0"), fifth))),
    ]
    ensure_checkpoint_dir(spark)
    closure = before = None
    for nodes, edges in releases:
        nodes = nodes.withColumnRenamed("c", "code")
        edges = edges.join(nodes.select(F.col("code").alias("child")).hint("merge"), "child", "left_semi").join(nodes.select(F.col("code").alias("parent")).hint("merge"), "parent", "left_semi").select("child", "parent").distinct().checkpoint()
        closure = taxonomy.ancestor_closure(nodes, edges) if closure is None else taxonomy.updated_closure(closure, nodes, edges, before)
        before = edges
    return closure.groupBy("code").agg(F.count(F.lit(1)).alias("n_ancestors"), F.sum("steps").alias("total_steps"), (F.max("steps") + 1).alias("depth"))


@query("""WITH t AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 2 = 0), u AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'new' END AS p_brand FROM part WHERE p_partkey % 5 <> 0)
SELECT count(*) FILTER (t.p_partkey IS NULL) AS upserted, count(*) FILTER (t.p_partkey IS NOT NULL) AS matched, count(*) FILTER (t.p_brand <> u.p_brand) AS modified, (SELECT count(*) FROM (SELECT p_partkey FROM t UNION SELECT p_partkey FROM u)) AS n_rows, (SELECT count(*) FROM t) AS n_sizes FROM u LEFT JOIN t USING (p_partkey)""")
def a17_observed_upsert(spark, d):
    """An upsert of one column: what its write counts, and the table it leaves, whose other column new rows lack."""
    p = W.table(spark, d, "part")
    table = p.where("p_partkey % 2 = 0").select("p_partkey", "p_brand", "p_size")
    updates = p.where("p_partkey % 5 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise("new").alias("p_brand"), F.lit(-1).alias("p_size"))
    path = _folder(spark, "upserted")
    counts = upsert.counted_upsert(table, updates, ["p_partkey"], path, ["p_brand"])
    left = spark.read.schema(table.schema).parquet(path).agg(F.count(F.lit(1)).alias("n_rows"), F.count("p_size").alias("n_sizes"))
    return left.select(*(F.lit(counts[c]).alias(c) for c in ("upserted", "matched", "modified")), "n_rows", "n_sizes")


def _stand_in(prompt: str) -> str:
    """A model that turns prompts round."""
    return prompt[::-1]


@query("""SELECT p_partkey, reverse('What is ' || p_name || '?') AS answer, 1 AS tries FROM part""")
def l1_call_ledger(spark, d):
    """Prompts answered through a ledger: the second table asks only what the first has not asked."""
    path = _folder(spark, "ledger")
    p = W.table(spark, d, "part").select("p_partkey", F.concat(F.lit("What is "), "p_name", F.lit("?")).alias("prompt"))
    ledger.answered(p.where("p_partkey % 2 = 0"), path, _stand_in, "stand-in")
    return ledger.answered(p, path, _stand_in, "stand-in").select("p_partkey", "answer", "tries")


@query("""SELECT 'HP:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS id, p_name AS label, p_type || '|' || p_brand || ' "x"' AS synonyms, CASE WHEN p_partkey % 2 = 0 THEN 'A ' || p_name ELSE '' END AS definition, 'HP:' || lpad(CAST(p_partkey // 2 AS VARCHAR), 7, '0') AS parents FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 1""")
def src5_ontology_file(spark, d):
    """Parts written as an ontology file and read as a data source in ranges, filters pushed to it."""
    p, k = W.table(spark, d, "part"), F.col("p_partkey")
    curie = lambda prefix, n: F.concat(F.lit(prefix), F.lpad(n.cast("string"), 7, "0"))
    lines = F.array(
        F.lit("[Term]"), F.concat(F.lit("id: "), F.when(k % 3 == 0, curie("MP:", k)).otherwise(curie("HP:", k))), F.concat(F.lit("name: "), "p_name"),
        F.concat(F.lit('synonym: "'), "p_type", F.lit('" EXACT []')), F.concat(F.lit('synonym: "'), "p_brand", F.lit(' \\"x\\"" RELATED []')), F.when(k % 2 == 0, F.concat(F.lit('def: "A '), "p_name", F.lit('" [ref:1]'))),
        F.concat(F.lit("is_a: "), curie("HP:", F.floor(k / 2)), F.lit(" ! parent")), F.when(k % 4 == 1, "is_obsolete: true"), F.lit(""),
    )
    path = _folder(spark, "ontology")
    p.select(F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n").alias("value")).write.text(path)
    obo.register(spark)
    terms = spark.read.format("obo").option("range_bytes", 20_000).load(path).where(F.col("id").startswith("HP:") & (F.col("is_obsolete") == F.lit(False)))
    plain = F.transform("synonyms", lambda s: F.replace(s, F.lit('\\"'), F.lit('"')))
    return terms.select("id", "label", F.array_join(plain, "|").alias("synonyms"), "definition", F.array_join("parents", "|").alias("parents"))


@query("""SELECT o_orderkey, o_custkey, count(l_linenumber) AS n_items, round(coalesce(sum(l_quantity), 0), 2) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def j1_bucketed_assembly(spark, d):
    """Visits with their items from tables stored by visit: the join and the sums need no exchange."""
    names = {n: f"{n}_{uuid.uuid4().hex[:12]}" for n in ("orders", "lineitem")}
    orders = W.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    items = W.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    kept = {n: layout.store_by_key(rows, names[n], ["o_orderkey"], 16, _folder(spark, n)) for n, rows in (("orders", orders), ("lineitem", items))}
    return layout.joined_by_key(kept["orders"], kept["lineitem"], ["o_orderkey"], "left").groupBy("o_orderkey", "o_custkey").agg(F.count("l_linenumber").alias("n_items"), F.round(F.coalesce(F.sum("l_quantity"), F.lit(0.0)), 2).alias("quantity"))
