"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

Items are cut into windows of WINDOW consecutive words.  One pass over the
corpus counts the words of the benchmark's vocabulary; each window is then
looked up by its LISTS rarest places, and windows with a word that the corpus
lacks are out.  A second pass stores the postings (term, document, position) of
those terms: the index.  The list of a window's rarest term, shifted by its
place in the window, is intersected with the shifted lists of the next ones;
what is left are starts in documents.  Only for these documents the postings of
all terms are made, and the remaining lists intersected, which leaves the exact
phrase.  Proximity matches intersect the lists of an item's rarest terms within
a span instead.

Tables derived from the benchmark are broadcast while their counted size is
within BROADCAST_ROWS and joined by shuffle beyond it; words of the corpus are
counted before they are shuffled.  No row holds more than one document's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

WINDOW, LISTS = 10, 3
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case; none for null."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, BREAK), "")


def item_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item_id, phrase): every run of ``width`` words of an item, or all of its words if it has fewer but some."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return items.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), F.lit(width)).alias("phrase")).distinct()


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


DOC = ["k1", "k2"]


def _keyed(documents: DataFrame) -> DataFrame:
    """``documents`` with DOC, 128 bits that stand for id and text: ids that repeat or are null do no harm."""
    return documents.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", "doc_id", F.lit(1))})


def _postings(documents: DataFrame) -> DataFrame:
    return documents.select(*DOC, F.posexplode(words(F.col("text"))).alias("pos", "term"))


def _frequencies(vocabulary: DataFrame, documents: DataFrame) -> DataFrame:
    """(term, frequency) of the vocabulary's terms that occur in the corpus."""
    found = documents.select(F.explode(words(F.col("text"))).alias("term"))
    n = vocabulary.count()
    if n <= BROADCAST_ROWS:
        return found.join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").agg(F.count("*").alias("frequency"))
    return found.groupBy("term").agg(F.count("*").alias("frequency")).join(vocabulary, "term", "left_semi")


def _index(documents: DataFrame, terms: DataFrame, scratch: Scratch) -> DataFrame:
    """The stored index (term, k1, k2, pos) of distinct ``terms``."""
    return scratch.save(_postings(documents).join(_small(terms, terms.count()), "term", "left_semi").select("term", *DOC, "pos"))


def phrase_matches(documents: DataFrame, windows: DataFrame, scratch: Scratch) -> DataFrame:
    """(k1, k2, start, phrase_id, size): every place where a window's words stand in a document, one after the other.

    ``windows`` has phrase_id and phrase, each phrase once; ``documents`` has
    DOC and text.
    """
    terms = scratch.save(windows.select("phrase_id", F.size("phrase").alias("size"), F.posexplode("phrase").alias("offset", "term")))
    counts = scratch.save(_frequencies(terms.select("term").distinct(), documents))
    ranked = terms.join(_small(counts, counts.count()), "term", "left").groupBy("phrase_id", "size")
    rarest = ranked.agg(F.array_sort(F.collect_list(F.struct("frequency", "offset", "term"))).alias("r"), F.count_if(F.col("frequency").isNull()).alias("missing")).where("missing = 0")
    # a window with fewer places than lists asks for its last one again
    place = lambda i: F.element_at("r", F.least(F.lit(i + 1), F.size("r")))
    lookup = scratch.save(rarest.select("phrase_id", "size", *[c for i in range(LISTS) for c in (place(i)["term"].alias(f"term{i}"), place(i)["offset"].alias(f"offset{i}"))]))
    n = lookup.count()
    wanted = scratch.save(lookup.select(F.explode(F.array(*[f"term{i}" for i in range(LISTS)])).alias("term")).distinct())
    index = _index(documents, wanted, scratch)
    starts = index.withColumnRenamed("term", "term0").join(_small(lookup, n), "term0").withColumn("start", F.col("pos") - F.col("offset0")).where("start >= 0").drop("pos")
    for i in range(1, LISTS):
        other = index.select(F.col("term").alias(f"term{i}"), *DOC, (F.col("pos")).alias("at"))
        starts = starts.withColumn("at", F.col("start") + F.col(f"offset{i}")).join(other, [f"term{i}", *DOC, "at"], "left_semi")
    near = scratch.save(starts.select(*DOC, "start", "phrase_id", "size").distinct())
    some = scratch.save(near.select(*DOC).distinct())
    have = _postings(documents.join(_small(some, some.count()), DOC, "left_semi"))
    need = near.join(_small(terms.select("phrase_id", "offset", "term"), terms.count()), "phrase_id").withColumn("pos", F.col("start") + F.col("offset"))
    met = need.join(have, [*DOC, "pos", "term"], "left_semi").groupBy(*DOC, "start", "phrase_id", "size").agg(F.count("*").alias("n"))
    return met.where("n = size").drop("n")


def proximity_matches(documents: DataFrame, benchmark: DataFrame, terms: int = 4, span: int = 20) -> DataFrame:
    """(doc_id, item_id, pos): places of an item's rarest term with its ``terms`` rarest terms within ``span`` words around.

    Words that the corpus lacks are left out of the ranking; items with fewer
    distinct words than ``terms`` need all that are left.  Nulls have no words;
    rows that repeat are matched each, rows of one doc_id by their own text; an
    empty table on either side gives no rows.
    """
    scratch = Scratch(documents.sparkSession, "proximity")
    docs = _keyed(documents.select("doc_id", F.col("text").cast("string").alias("text")))
    item_terms = scratch.save(benchmark.select("item_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).distinct())
    counts = scratch.save(_frequencies(item_terms.select("term").distinct(), docs))
    ranked = item_terms.join(_small(counts, counts.count()), "term").groupBy("item_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.col("frequency").alias("f"), "term"))), 1, terms).alias("r"))
    wanted = scratch.save(ranked.select("item_id", F.monotonically_increasing_id().alias("item"), F.col("r")[0]["term"].alias("term"), F.transform("r", lambda x: x["term"]).alias("all")))
    index = _index(docs, wanted.select(F.explode("all").alias("term")).distinct(), scratch)
    places = index.distinct().join(_small(wanted.select("item", "term", "all"), wanted.count()), "term")
    # the other lists by parts of ``span`` positions: within reach means the same part or the next to it
    asked = places.select(*DOC, "item", "pos", F.size("all").alias("n"), F.explode("all").alias("term")).withColumn("part", F.explode(F.array(*[F.floor(F.col("pos") / span) + i for i in (-1, 0, 1)])))
    others = index.distinct().select("term", *DOC, F.floor(F.col("pos") / span).alias("part"), F.col("pos").alias("at"))
    met = asked.join(others, ["term", *DOC, "part"]).where(F.abs(F.col("at") - F.col("pos")) <= span)
    found = met.select(*DOC, "item", "pos", "n", "term").distinct().groupBy(*DOC, "item", "pos", "n").agg(F.count("*").alias("m")).where("m = n")
    named = found.join(wanted.select("item", "item_id"), "item")
    return docs.select("doc_id", *DOC).join(named, DOC).select("doc_id", "item_id", "pos")


def judged(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per row of ``documents``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and digest, the xxhash64 of its text.

    A word is hit if it stands in an occurrence of any window of any item.
    Null and empty texts have no words; items without words have no windows;
    an item whose item_id is null counts for hits but in no list of items.
    Rows that repeat are judged each, by their own text; a null doc_id is kept;
    an empty benchmark leaves every document clean; columns beyond those named
    are ignored.
    """
    scratch = Scratch(documents.sparkSession, "decontamination")
    docs = _keyed(documents.select("doc_id", F.col("text").cast("string").alias("text")))
    windows = scratch.save(item_windows(benchmark.select("item_id", "text"), width))
    phrases = scratch.save(windows.select("phrase").distinct().withColumn("phrase_id", F.monotonically_increasing_id()))
    hits = scratch.save(phrase_matches(docs, phrases, scratch))
    spans = hits.groupBy(*DOC).agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["reach"]))).alias("n"), F.greatest(a["reach"], s["end"]).alias("reach")),
        lambda a: a["n"],
    )
    hit_words = spans.select(*DOC, covered.cast("long").alias("n_hit"))
    holders = phrases.join(windows, "phrase").select("phrase_id", F.col("item_id").cast("string").alias("item"))
    named = hits.select(*DOC, "phrase_id").distinct().join(_small(holders, windows.count()), "phrase_id").groupBy(*DOC).agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = scratch.save(hit_words.join(named, DOC))
    scratch.keep_only(found)
    sized = docs.select("doc_id", *DOC, F.xxhash64("text").alias("digest"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = sized.join(_small(found, found.count()), DOC, "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "digest")


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``judged`` without the digest, which callers need only to find a row again by its text."""
    return judged(documents, benchmark, width).drop("digest")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, p, len(p) AS n FROM (SELECT item_id, w[s:s + 9] AS p FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0))
), lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d),
hit AS (
  SELECT pos.doc_id, pos.s, win.n, win.item_id
  FROM pos, lens, win WHERE pos.s + lens.n - 1 <= len(pos.w) AND win.n = lens.n AND win.p = pos.w[pos.s:pos.s + lens.n - 1]
), covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
