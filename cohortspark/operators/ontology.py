"""Ontology search: blocking by tokens, a ladder of matches, top hits, and resolution policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.udfs import ratio
from ..session import ensure_checkpoint_dir, written
from . import similar_strings as S

# Words that do not count, and everyday names of phenotypes.
STOPWORDS = "a an the and or of in to for with on at by from as is are was were be".split()
ALIASES = {
    "lack of sleep": "sleep disturbance", "loss of sleep": "sleep disturbance", "shortage of sleep": "sleep disturbance", "difficulty sleeping": "sleep disturbance", "trouble sleeping": "sleep disturbance",
    "poor sleep": "poor sleep quality", "lack of appetite": "loss of appetite", "decreased appetite": "loss of appetite", "lack of energy": "fatigue", "loss of energy": "fatigue", "low energy": "fatigue",
    "lack of concentration": "poor concentration",
}
MIN_SCORE = 0.70
#: Ratios from which tokens and whole names are like each other; below LEAST_RATIO a name's ratio decides nothing.
FUZZY_TOKEN, FUZZY_NAME, LEAST_RATIO = 0.78, 0.72, 0.6


def search_entries(terms: DataFrame) -> DataFrame:
    """Terms prepared for search: ordinal by id, normalised label, synonyms and definition."""
    place = F.row_number().over(Window.orderBy("id")) if "ordinal" not in terms.columns else F.col("ordinal")  # a bounded dimension
    return terms.select("id", place.alias("ordinal"), "label", X.normalize_label(F.col("label")).alias("label_norm"), "synonyms", F.transform("synonyms", X.normalize_label).alias("synonyms_norm"), "definition", X.normalize_label(F.coalesce("definition", F.lit(""))).alias("definition_norm"), "alt_ids")


def token_postings(entries: DataFrame) -> DataFrame:
    """(key, ordinal): the tokens of label, synonyms and definition, with their stems and four-letter heads."""
    every = F.array_distinct(F.concat(X.tokens(F.col("label_norm")), F.flatten(F.transform("synonyms_norm", X.tokens)), X.tokens(F.col("definition_norm"))))
    rows = entries.select("ordinal", F.explode(every).alias("t")).where(~F.col("t").isin(STOPWORDS))
    return rows.select("ordinal", F.explode(_keys(F.col("t"))).alias("key")).distinct()


def _keys(token: Column) -> Column:
    stem = X.stem(token)
    return F.array_distinct(F.filter(F.array(token, F.when((stem != token) & (F.length(stem) >= 3), stem), F.when(F.length(token) >= 4, F.substring(token, 1, 4))), lambda x: x.isNotNull()))


def queries_of(terms: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Distinct query terms (column term) with normal form, effective tokens and alias."""
    norm = X.normalize_label(F.col("term"))
    toks = X.tokens(norm)
    strong = F.filter(toks, lambda x: ~x.isin(STOPWORDS))
    alias = F.element_at(F.create_map(*[x for p in aliases.items() for x in map(F.lit, p)]), norm) if aliases else F.lit(None).cast("string")
    return terms.select("term").where(norm != "").distinct().select("term", norm.alias("q"), F.when(F.size(strong) > 0, strong).otherwise(toks).alias("q_tokens"), alias.alias("alias"))


def candidate_pairs(queries: DataFrame, entries: DataFrame, postings: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    """Queries with the entries that share a key with them; queries without any get all entries that a rung of the ladder may fit.

    ``grams`` may give the stored ``definition_grams`` of the entries.
    """
    ensure_checkpoint_dir(queries.sparkSession)
    heads = F.flatten(F.transform(F.array_distinct(F.concat("q_tokens", F.coalesce(X.tokens(F.col("alias")), F.array().cast("array<string>")))), _keys))
    found = queries.select("term", F.explode(F.array_distinct(heads)).alias("key")).join(postings, "key").select("term", "ordinal").distinct().checkpoint()
    rest = queries.join(found.select("term").distinct(), "term", "left_anti").checkpoint()
    if not rest.isEmpty():
        found = found.unionByName(near_entries(rest, entries, grams))
    return found.join(queries, "term").join(entries, "ordinal")


def names_of(entries: DataFrame) -> DataFrame:
    """(ordinal, name): the labels and synonyms of the entries."""
    return entries.select("ordinal", F.explode(F.concat(F.array("label_norm"), "synonyms_norm")).alias("name"))


def definition_grams(entries: DataFrame) -> DataFrame:
    """The trigrams of names and definitions with their places; a name or definition is one text, told by its hash."""
    texts = names_of(entries).select("name").unionByName(entries.select(F.col("definition_norm").alias("name"))).where("name <> ''").distinct()
    return S.gram_postings(texts.withColumn("text", F.xxhash64("name")), "text", "name")


def near_entries(rest: DataFrame, entries: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    """(term, ordinal): the entries that a rung may fit for terms that share no key with any.

    A name or definition contains the term, or a name is its alias; a name's
    ratio may reach the fuzzy rungs; or a token is like one of the term's.
    """
    grams = definition_grams(entries) if grams is None else grams
    names = names_of(entries)
    texts = names.unionByName(entries.select("ordinal", F.col("definition_norm").alias("name"))).select("ordinal", F.xxhash64("name").alias("text")).distinct()
    asked = rest.select("term", F.col("q")).unionByName(rest.where("alias is not null").select("term", F.col("alias").alias("q")))
    inside = asked.join(S.containing(asked, grams, "text"), "q").join(texts, "text").select("term", "ordinal")
    fuzzy = S.similar_strings(rest.select(F.col("q").alias("a")), names.select(F.col("name").alias("b")), FUZZY_NAME)
    by_name = rest.join(fuzzy, F.col("q") == F.col("a")).join(names, F.col("b") == F.col("name")).select("term", "ordinal")
    return inside.unionByName(by_name).unionByName(_by_tokens(rest, entries)).distinct()


def _by_tokens(rest: DataFrame, entries: DataFrame) -> DataFrame:
    """(term, ordinal) with a token of each that are like each other on any scale, words that do not count included."""
    own = rest.select("term", F.explode("q_tokens").alias("a")).distinct()
    every = F.array_distinct(F.concat(X.tokens(F.col("label_norm")), F.flatten(F.transform("synonyms_norm", X.tokens)), X.tokens(F.col("definition_norm"))))
    held = entries.select("ordinal", F.explode(every).alias("b"))
    left, right = own.select("a").distinct(), held.select("b").distinct()
    alike = left.select("a", F.explode(_every_key(F.col("a"))).alias("key")).join(right.select("b", F.explode(_every_key(F.col("b"))).alias("key")), "key").select("a", "b")
    long = S.similar_strings(left.where(F.length("a") >= 4), right.where(F.length("b") >= 4), FUZZY_TOKEN)
    return own.join(alike.unionByName(long).distinct(), "a").join(held, "b").select("term", "ordinal")


def _every_key(token: Column) -> Column:
    """What two tokens have in common if they are equal, plurals, of one stem, or one begins with the other."""
    bare = F.concat(F.lit("s "), F.rtrim(token, F.lit("s")))
    return F.array_distinct(F.concat(F.array(token, bare), _keys(token)))


def token_similarity(a: Column, b: Column, fuzzy: Column | None = None) -> Column:
    """1, 0.95, 0.90, 0.85 by equality, plural, stem and prefix; otherwise the ratio given, from 0.78."""
    bare = lambda c: F.rtrim(c, F.lit("s"))
    sa, sb = X.stem(a), X.stem(b)
    long = (F.length(a) >= 4) & (F.length(b) >= 4)
    out = F.when(a == b, 1.0).when(bare(a) == bare(b), 0.95).when((F.length(sa) >= 3) & (sa == sb), 0.90).when(long & (a.startswith(b) | b.startswith(a)), 0.85)
    return out.when(long & (fuzzy >= FUZZY_TOKEN), fuzzy).otherwise(0.0) if fuzzy is not None else out.otherwise(0.0)


def token_score(query: Column, target: Column, fuzzy=None) -> Column:
    """Mean over the query's tokens of the best target token; 0 if either has none.  ``fuzzy(a, b)`` may give the last rung."""
    best = F.transform(query, lambda q: F.coalesce(F.array_max(F.transform(target, lambda t: token_similarity(q, t, fuzzy(q, t) if fuzzy else None))), F.lit(0.0)))
    return F.when((F.size(query) > 0) & (F.size(target) > 0), F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(query)).otherwise(0.0)


def _with_fuzzy(pairs: DataFrame) -> DataFrame:
    """Adds label_ratio, synonym_ratio and the map of token-pair ratios.

    Arrow calls are made on distinct string pairs whose shared letters allow a
    ratio that decides something; a ratio that is not computed counts as 0.
    """
    texts = pairs.select("q", F.explode(F.array_distinct(F.concat(F.array("label_norm"), "synonyms_norm"))).alias("t")).distinct()
    long = lambda c: F.filter(c, lambda x: F.length(x) >= 4)
    every = F.array_distinct(F.concat(X.tokens(F.col("label_norm")), F.flatten(F.transform("synonyms_norm", X.tokens)), X.tokens(F.col("definition_norm"))))
    toks = pairs.select(F.explode(long(F.col("q_tokens"))).alias("q"), long(every).alias("ts")).select("q", F.explode("ts").alias("t")).distinct()
    scored = texts.where(S.within_bound(F.col("q"), F.col("t"), LEAST_RATIO)).select("q", "t", ratio("q", "t").alias("r"))
    near = toks.where((F.col("q") != F.col("t")) & S.within_bound(F.col("q"), F.col("t"), FUZZY_TOKEN)).select("q", "t", ratio("q", "t").alias("r")).where(F.col("r") >= FUZZY_TOKEN)
    by_label = scored.select("q", F.col("t").alias("label_norm"), F.col("r").alias("label_ratio"))
    synonyms = pairs.select("term", "q", "ordinal", F.explode("synonyms_norm").alias("t")).join(scored, ["q", "t"]).groupBy("term", "ordinal").agg(F.max("r").alias("synonym_ratio"))
    maps = near.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("t", "r"))).alias("m"))
    per_term = pairs.select("term", "q_tokens").distinct().select("term", F.explode("q_tokens").alias("q")).distinct().join(maps, "q").groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("q", "m"))).alias("near"))
    return pairs.join(by_label, ["q", "label_norm"], "left").join(synonyms, ["term", "ordinal"], "left").join(per_term, "term", "left")


def ladder(pairs: DataFrame) -> DataFrame:
    """Adds match_type and score by the first rung that fits; pairs that fit none are dropped.

    The rungs that need no Python come first and their rows never reach it.
    """
    q, alias, label, syn = F.col("q"), F.col("alias"), F.col("label_norm"), F.col("synonyms_norm")
    has = lambda c: F.coalesce(F.array_contains(syn, c), F.lit(False))
    word = F.concat(F.lit(r"\b\Q"), q, F.lit(r"\E\b"))
    exact = (q == label) | F.coalesce(alias == label, F.lit(False))
    direct = (
        F.when(exact, F.struct(F.lit("exact_label"), F.when(q == label, 1.0).otherwise(0.95)))
        .when(has(q) | has(alias), F.struct(F.lit("synonym"), F.when(has(q), 0.98).otherwise(0.93)))
        .when(F.regexp_like(label, word), F.struct(F.lit("substring_label"), 0.90 + 0.05 * F.length(q) / F.greatest(F.length(label), F.lit(1))))
        .when(F.exists(syn, lambda s: F.regexp_like(s, word)), F.struct(F.lit("substring_synonym"), F.lit(0.85)))
    )
    seen = pairs.withColumn("__d", direct)
    names = ["match_type", "score"]
    kept = [c for c in pairs.columns]
    first = seen.where("__d is not null").select(*kept, F.col("__d.col1").alias(names[0]), F.col("__d.col2").alias(names[1]))
    rest = _with_fuzzy(seen.where("__d is null").drop("__d"))
    near = lambda a, b: F.coalesce(F.element_at(F.element_at("near", a), b), F.lit(0.0))
    rest = rest.withColumns(
        {
            "__l": token_score(F.col("q_tokens"), X.tokens(label), near),
            "__s": F.coalesce(F.array_max(F.transform(syn, lambda s: token_score(F.col("q_tokens"), X.tokens(s), near))), F.lit(0.0)),
            "__d": token_score(F.col("q_tokens"), X.tokens(F.col("definition_norm")), near),
            "__r": F.coalesce("label_ratio", F.lit(0.0)),
            "__t": F.coalesce("synonym_ratio", F.lit(0.0)),
        }
    )
    lt, st, dt, lr, sr = (F.col(c) for c in ("__l", "__s", "__d", "__r", "__t"))
    defined = F.col("definition_norm") != ""
    fuzzy = (
        F.when((lt >= 0.6) & (lt >= st) & (lt >= lr), F.struct(F.lit("token_label"), 0.70 * lt + 0.15))
        .when((st >= 0.6) & (st >= lr), F.struct(F.lit("token_synonym"), 0.65 * st + 0.15))
        .when(lr >= FUZZY_NAME, F.struct(F.lit("fuzzy_label"), 0.60 * lr + 0.10))
        .when(sr >= FUZZY_NAME, F.struct(F.lit("fuzzy_synonym"), 0.55 * sr + 0.10))
        .when(defined & F.col("definition_norm").contains(q), F.struct(F.lit("substring_definition"), F.lit(0.50)))
        .when(defined & (dt >= 0.75), F.struct(F.lit("token_definition"), 0.40 + 0.10 * dt))
    )
    second = rest.withColumn("__h", fuzzy).where("__h is not null").select(*kept, F.col("__h.col1").alias(names[0]), F.col("__h.col2").alias(names[1]))
    return first.unionByName(second).withColumn("score", F.round("score", 4))


def search(terms: DataFrame, entries: DataFrame, postings: DataFrame, limit: int = 5, min_score: float = 0.0, aliases: dict[str, str] | None = None) -> DataFrame:
    """The best ``limit`` entries of each distinct term: term, rank, id, label, match_type and score.

    A term that is an id, or an alternative one, gets that entry alone.
    """
    # the terms may come from whole tables, and are read by every step
    queries = written(queries_of(terms, aliases))
    ids = entries.select(F.upper("id").alias("given"), "id", "label").unionByName(entries.select(F.explode("alt_ids").alias("given"), "id", "label").withColumn("given", F.upper("given")))
    direct = queries.join(ids, F.upper(F.trim("term")) == F.col("given")).select("term", "id", "label", F.lit("id_lookup").alias("match_type"), F.lit(1.0).alias("score"), F.lit(0).alias("ordinal"))
    open_ = queries.join(direct.select("term").distinct(), "term", "left_anti")
    # read by every rung: written once, so that neither blocking nor the plan is repeated
    pairs = written(candidate_pairs(open_, entries, postings))
    hits = ladder(pairs).where((F.col("score") > 0) & (F.col("score") >= min_score)).select("term", "id", "label", "match_type", "score", "ordinal")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "ordinal"))
    return direct.unionByName(hits).withColumn("rank", place).where(F.col("rank") <= limit).drop("ordinal")


def get_by_id(asked: DataFrame, entries: DataFrame, every: bool = False) -> DataFrame:
    """(asked, id, label, synonyms, definition, match_type, score) of distinct ids and alternative ids, letters' case and outer blanks aside; unknown ones have no row.

    An alternative id of several entries gives the first of them, or with ``every`` all.
    """
    own = entries.select(F.upper("id").alias("given"), F.lit(0).alias("rank"), "ordinal")
    other = entries.select(F.explode("alt_ids").alias("given"), F.lit(1).alias("rank"), "ordinal").withColumn("given", F.upper("given"))
    # an id of its own comes before an alternative one of another entry
    known = own.unionByName(other)
    if every:
        first = known.withColumn("n", F.rank().over(Window.partitionBy("given").orderBy("rank"))).where("n = 1").select("given", "ordinal").distinct()
    else:
        first = known.groupBy("given").agg(F.min(F.struct("rank", "ordinal")).alias("f")).select("given", "f.ordinal")
    found = asked.select("asked").distinct().join(first, F.upper(F.trim("asked")) == F.col("given")).join(entries, "ordinal")
    return found.select("asked", "id", "label", "synonyms", "definition", F.lit("id_lookup").alias("match_type"), F.lit(1.0).alias("score"))


def resolve(terms: DataFrame, entries: DataFrame, postings: DataFrame, policy: str = "strict", k: int = 1, aliases: dict[str, str] | None = None) -> DataFrame:
    """Hits under a policy: strict abstains below 0.70 and on definitions, lenient takes the best hit, raw gives the best ``k``."""
    if policy not in ("strict", "lenient", "raw"):
        raise ValueError(f"unknown policy: {policy}")
    hits = search(terms, entries, postings, limit=k if policy == "raw" else 1, aliases=aliases)
    return hits.where(accepted(F.col("match_type"), F.col("score"))) if policy == "strict" else hits


def accepted(match_type: Column, score: Column) -> Column:
    """Whether a hit is taken: no definition match, and 0.70 or more; a hit without a score passes."""
    return ~F.coalesce(match_type.endswith("_definition"), F.lit(False)) & F.coalesce(score.try_cast("double") >= MIN_SCORE, F.lit(True))
