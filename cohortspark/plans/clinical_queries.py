"""Queries over text functions, dates, triage, changes, ontology search and medicine matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import identifiers as I
from ..functions import text as X
from ..functions import triage as R
from ..functions.udfs import embedder, ratio
from ..operators import delta, medicines, ontology
from . import views as W

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(r"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{0085}\x{2028}\x{2029}●]')) AS l FROM documents), s AS (SELECT doc_id, trim(regexp_replace(regexp_replace(l, '^(\s|[!"#$&''*<=>@\[\\\]^_`{|}~¡¿«»“”‘’–—…•★§¶·©®°±×÷€£¢¥])+', ''), '\s+$', ''), ' .') AS segment FROM p)
SELECT doc_id, count(*) AS n_segments, CAST(sum(length(segment)) AS BIGINT) AS n_chars FROM s WHERE segment <> '' GROUP BY 1""")
def t2_segment(spark, d):
    rows = W.table(spark, d, "documents").select("doc_id", F.explode(X.segment(F.col("text"), normalize=False)).alias("segment"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.sum(F.length("segment")).alias("n_chars"))


@query()
def nfkc_sanitize(spark, d):
    return W.table(spark, d, "documents").select("doc_id", X.sanitize(F.col("text")).alias("clean"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'HP:' || CASE WHEN length(CAST(o_orderkey AS VARCHAR)) < 7 THEN lpad(CAST(o_orderkey AS VARCHAR), 7, '0') ELSE CAST(o_orderkey AS VARCHAR) END END AS curie FROM orders""")
def t3_curie(spark, d):
    raw = F.when(F.col("o_orderkey") % 5 == 0, "unmatched").otherwise(F.concat(F.lit("HPO:"), F.col("o_orderkey")))
    return W.table(spark, d, "orders").select("o_orderkey", X.to_curie("HPO", raw).alias("curie"))


@query("SELECT p_partkey, p_name || ' with ' || lower(p_type) AS term FROM part")
def t4_clean_term(spark, d):
    return W.table(spark, d, "part").select("p_partkey", X.clean_diagnosis(F.concat(F.lit("- ? "), F.col("p_name"), F.lit(" with "), F.lower("p_type"), F.lit(" . "))).alias("term"))


@query(r"""SELECT conv_id, turn, len(t) AS n_tokens, array_to_string(list_transform(t, lambda x: regexp_replace(x, '(ing|ed|es|s)$', '')), ' ') AS stems FROM (SELECT conv_id, turn, regexp_extract_all(translate(lower(text), 'áàâäãéèêëíìîïóòôöõúùûüñçß', '__________________________'), '\b([a-z0-9]+)\b', 1) AS t FROM conversations)""")
def t7_tokenise_stem_all(spark, d):
    """The stems of all tokens of every text."""
    plain = F.translate(F.lower("text"), "áàâäãéèêëíìîïóòôöõúùûüñçß", "_" * 26)
    toks = X.tokens(plain)
    return W.table(spark, d, "conversations").select("conv_id", "turn", F.size(toks).cast("long").alias("n_tokens"), F.array_join(F.transform(toks, X.stem), " ").alias("stems"))


@query("SELECT p_partkey, p_name AS term FROM part")
def t12_strip_form(spark, d):
    return W.table(spark, d, "part").select("p_partkey", X.strip_dose_forms(F.concat(F.lit("Tab. "), F.col("p_name"), F.lit(" CAPSULE"))).alias("term"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name || '.' WHEN p_partkey % 4 = 1 THEN p_name || ', marketed as ' || p_brand || ', is used as ' || p_type || ' therapy.' WHEN p_partkey % 4 = 2 THEN p_brand || ' is used as adjuvant ' || p_type || '.' ELSE 'Medication used as adjuvant.' END AS digest FROM part""")
def t13_digest(spark, d):
    kind = F.col("p_partkey") % 4
    molecule = F.when(kind < 2, F.col("p_name"))
    brand = F.when(kind.isin(1, 2), F.col("p_brand"))
    indication = F.when(kind == 1, F.concat(F.col("p_type"), F.lit(" therapy."))).when(kind == 2, F.concat(F.lit("Adjuvant "), F.col("p_type"))).when(kind == 3, "Adjuvant.")
    return W.table(spark, d, "part").select("p_partkey", X.digest_sentence(molecule, brand, indication).alias("digest"))


@query("SELECT p_partkey, p_name AS bare, p_name || ' ' || lower(p_type) AS clean FROM part")
def t14_strip_strength(spark, d):
    name = F.concat(F.col("p_name"), F.lit(" 50 MG"))
    odd = F.concat(F.lit("?"), F.col("p_name"), F.lit(" (old) ["), F.col("p_brand"), F.lit("] - "), F.lower("p_type"))
    return W.table(spark, d, "part").select("p_partkey", X.strip_strength(name).alias("bare"), X.strip_special(odd).alias("clean"))


@query("""SELECT p_partkey, p_brand AS brand_name, score FROM (SELECT *, round((10.0 * len(list_intersect(['brand', '12', 'red', 'bolt'], regexp_extract_all(lower(p_brand), '[a-z0-9]+'))) + 10.0 * len(list_intersect(['brand', '12', 'red', 'bolt'], regexp_extract_all(lower(p_name), '[a-z0-9]+'))) + 5.0 * len(list_intersect(['brand', '12', 'red', 'bolt'], regexp_extract_all(lower(p_type), '[a-z0-9]+')))) / 4, 4) AS score FROM part) WHERE score > 0 ORDER BY score DESC, p_brand, p_name, p_partkey LIMIT 25""")
def t24_text_search(spark, d):
    p = W.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand_name"), F.col("p_name").alias("canonical_molecule"), F.col("p_type").alias("clinical_dosing_indication"))
    return medicines.text_search(p, "Brand#12 red bolt", 25, "p_partkey").select("p_partkey", "brand_name", "score")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS visit_date FROM orders""")
def dt1_parse_date(spark, d):
    kind, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    raw = F.when(kind == 0, F.date_format(day, "dd/MM/yyyy")).when(kind == 1, F.date_format(day, "yyyy-MM-dd")).when(kind == 2, F.concat(F.date_format(day, "d/M/yyyy"), F.lit(" 10:30"))).otherwise("31/02/2020")
    return W.table(spark, d, "orders").select("o_orderkey", D.clinical_date(raw).alias("visit_date"))


@query("""WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS p, date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS n FROM orders)
SELECT o_orderkey, CASE WHEN n < 0 THEN CAST(p AS VARCHAR) WHEN n = 0 THEN 'today' WHEN n = 1 THEN 'yesterday' WHEN n < 7 THEN n || ' days ago' WHEN n // 7 < 5 THEN n // 7 || ' week' || CASE WHEN n // 7 > 1 THEN 's' ELSE '' END || ' ago' WHEN n // 30 < 12 THEN n // 30 || ' month' || CASE WHEN n // 30 > 1 THEN 's' ELSE '' END || ' ago' ELSE n // 365 || ' year' || CASE WHEN n // 365 > 1 THEN 's' ELSE '' END || ' ago' END AS ago FROM x""")
def dt4_relative_time(spark, d):
    return W.table(spark, d, "orders").select("o_orderkey", D.relative_time(F.col("o_orderdate").cast("date"), F.lit("1999-01-01").cast("date")).alias("ago"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN NULL ELSE c_custkey END AS case_no, 'DT' || c_custkey AS label, round(c_custkey % 90 + 6 / 12 + (c_custkey % 31) / 365.25, 2) AS age, CASE WHEN starts_with(lower(c_mktsegment), 'f') THEN 'f' ELSE 'm' END AS gender FROM customer""")
def p1_source_fields(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 2, F.concat(F.lit("DT"), k)).otherwise("none")
    age = I.fractional_age((k % 90).cast("string"), F.lit("6"), (k % 31).cast("string"))
    return W.table(spark, d, "customer").select("c_custkey", I.case_number(raw).alias("case_no"), I.case_label(k).alias("label"), age.alias("age"), I.source_gender(F.col("c_mktsegment")).alias("gender"))


_PHRASES = ("Informant: patient", "labs advised", "feels much better", "denies {} currently", "{} resolved", "moderate {}", "no complaints", "nil", "{}", "free of {}", "", "worse {}")


def _phrases(spark, d):
    k = F.col("event_id") % len(_PHRASES)
    text = F.replace(F.element_at(F.array(*map(F.lit, _PHRASES)), (k + 1).cast("int")), F.lit("{}"), F.col("event_type"))
    return W.table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", text.alias("text"))


@query("""SELECT event_id, CASE event_id % 12 WHEN 0 THEN 'non_symptom' WHEN 1 THEN 'non_symptom' WHEN 2 THEN 'global_status' WHEN 3 THEN 'negated_symptom' WHEN 4 THEN 'negated_symptom' WHEN 5 THEN 'symptom' WHEN 6 THEN 'global_status' WHEN 7 THEN 'global_status' WHEN 8 THEN 'symptom' WHEN 9 THEN 'negated_symptom' WHEN 10 THEN 'non_symptom' ELSE 'symptom' END AS category,
CASE event_id % 12 WHEN 3 THEN event_type WHEN 4 THEN event_type WHEN 5 THEN 'moderate ' || event_type WHEN 8 THEN event_type WHEN 9 THEN event_type WHEN 11 THEN 'worse ' || event_type END AS entity FROM events""")
def n9_triage(spark, d):
    return _phrases(spark, d).select("event_id", R.complaint_category(F.col("text")).alias("category"), R.complaint_entity(F.col("text")).alias("entity"))


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'error') THEN CASE WHEN event_id % 4 = 0 THEN 'decreased' WHEN event_id % 4 = 1 THEN 'increased' WHEN event_id % 4 = 2 THEN 'stop' ELSE 'maintained' END WHEN event_id % 4 = 2 THEN 'stop' ELSE 'new' END AS status FROM events""")
def n11_change_class(spark, d):
    k = F.col("event_id") % 4
    term = F.concat(F.when(k == 0, "less ").when(k == 1, "worse ").when(k == 2, "no more ").otherwise(""), F.col("event_type"))
    return W.table(spark, d, "events").select("event_id", R.change_class(term, F.array(F.lit("view"), F.lit("severe error"))).alias("status"))


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'error') THEN CASE WHEN event_type = 'view' THEN 'view' ELSE 'severe error' END END AS matched, CASE WHEN event_type NOT IN ('view', 'error') THEN 'new symptom' WHEN event_id % 3 = 0 THEN 'condition resolved/stopped, changed from ' || CASE WHEN event_type = 'view' THEN 'view' ELSE 'severe error' END
WHEN event_id % 3 = 1 THEN CASE WHEN event_type = 'view' THEN 'condition worsened, changed from view' ELSE 'no change' END ELSE CASE WHEN event_type = 'view' THEN 'no change' ELSE 'condition improved, changed from severe error' END END AS note FROM events""")
def n12_condition(spark, d):
    k = F.col("event_id") % 3
    term = F.concat(F.when(k == 0, "no ").when(k == 1, "worse ").otherwise(""), F.col("event_type"))
    return W.table(spark, d, "events").select("event_id", R.symptom_condition(term, F.array(F.lit("view"), F.lit("severe error"))).alias("c")).select("event_id", "c.matched", "c.note")


@query("""WITH v AS (SELECT o_orderkey AS visit_id, o_custkey AS case_no, CAST(o_orderdate AS DATE) AS visit_date, substr(o_orderpriority, 3) AS dx FROM orders), h AS (SELECT visit_id, lower(dx) AS cur, list_distinct(coalesce(list(lower(dx)) OVER (PARTITION BY case_no ORDER BY visit_date, visit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])) AS past, dx FROM v)
SELECT visit_id, 'diagnosis' AS entity_type, CASE WHEN list_contains(past, cur) THEN 'maintained' ELSE 'new' END AS status, dx AS entity FROM h UNION ALL SELECT visit_id, 'diagnosis', 'stop', p FROM (SELECT visit_id, cur, unnest(past) AS p FROM h) WHERE p <> cur""")
def n13_delta_long(spark, d):
    v = W.visits(spark, d).select("visit_id", "case_no", "visit_date", F.expr("substring(visit_reason, 3)").alias("dx"))
    order = Window.partitionBy("case_no").orderBy("visit_date", "visit_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = v.select("visit_id", F.array().cast("array<string>").alias("symptoms"), F.array("dx").alias("diagnoses"), F.array().cast("array<string>").alias("past_symptoms"), F.collect_set("dx").over(order).alias("past_diagnoses"))
    return delta.long_form(delta.encounter_delta(rows), ["visit_id"])


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || ' 10mg' END AS in_use, CASE WHEN event_id % 3 = 1 THEN event_type || ' 20mg 2 weeks' END AS stopped FROM events""")
def n14_medicines_in_text(spark, d):
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.concat(F.lit("currently taking tab "), F.col("event_type"), F.lit(" 10mg"))).when(k == 1, F.concat(F.lit("stopped "), F.col("event_type"), F.lit(" 20mg 2 weeks"))).otherwise("taking medications.")
    return W.table(spark, d, "events").select("event_id", R.medicine_in_use(text).alias("in_use"), R.medicine_discontinued(text).alias("stopped"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE event_id % 4 WHEN 0 THEN 'decreased' WHEN 1 THEN 'stop' WHEN 2 THEN 'new' END AS status FROM events""")
def n16_json_answer(spark, d):
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, F.concat(F.lit("Here:\n```json\n"), F.col("props"), F.lit("\n```\nDone"))).when(kind == 1, F.concat(F.lit("so "), F.col("props"), F.lit(" ok"))).otherwise("no answer")
    word = F.element_at(F.array(*map(F.lit, ("Improving", "resolved ", "new", "whatever"))), (F.col("event_id") % 4 + 1).cast("int"))
    return W.table(spark, d, "events").select("event_id", F.try_variant_get(R.json_answer(text), "$.k", "long").alias("k"), R.canonical_status(word).alias("status"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'negated' WHEN 1 THEN 'historical' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'family' ELSE 'affirmed' END AS status FROM events""")
def n2_assertion(spark, d):
    phrase = F.element_at(F.array(*map(F.lit, ("denies {}", "history of {}", "? {}", "mother had {}", "{}, loss of appetite"))), (F.col("event_id") % 5 + 1).cast("int"))
    return W.table(spark, d, "events").select("event_id", R.assertion_status(F.replace(phrase, F.lit("{}"), F.col("event_type"))).alias("status"))


def _entries(spark, d):
    """Distinct part names as an ontology, with a synonym and a definition each."""
    names = W.table(spark, d, "part").select(F.col("p_name").alias("label")).distinct()
    terms = names.select(F.concat(F.lit("HP:"), F.lpad(F.abs(F.crc32("label")).cast("string"), 10, "0")).alias("id"), "label", F.array(F.concat(F.col("label"), F.lit(" disorder"))).alias("synonyms"), F.concat(F.lit("Any "), F.col("label"), F.lit(" of the part list")).alias("definition"), F.array().cast("array<string>").alias("alt_ids"))
    return ontology.search_entries(terms)


@query(r"""WITH n AS (SELECT DISTINCT p_name AS l FROM part), t AS (SELECT DISTINCT l, unnest(regexp_extract_all(l || ' ' || l || ' disorder any ' || l || ' of the part list', '[a-z0-9]+')) AS t FROM n), s AS (SELECT l, t, regexp_replace(t, '(ing|ed|es|s)$', '') AS st FROM t WHERE t NOT IN ('of', 'the')),
k AS (SELECT l, t AS key FROM s UNION SELECT l, st FROM s WHERE st <> t AND length(st) >= 3 UNION SELECT l, substr(t, 1, 4) FROM s WHERE length(t) >= 4) SELECT key, count(DISTINCT l) AS n_terms FROM k GROUP BY 1""")
def j6_token_blocking(spark, d):
    postings = ontology.token_postings(_entries(spark, d))
    return postings.groupBy("key").agg(F.countDistinct("ordinal").alias("n_terms"))


@query()
def t10_ontology_search(spark, d):
    entries = _entries(spark, d)
    terms = W.table(spark, d, "part").select(F.explode(F.array(F.col("p_name"), F.concat(F.lit("Old "), F.col("p_name"), F.lit("s")), F.lower("p_type"))).alias("term"))
    return ontology.search(terms, entries, ontology.token_postings(entries), limit=3).select("term", "rank", "id", "label", "match_type", "score")


@query()
def t8_ratio_search(spark, d):
    names = W.table(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    pairs = names.withColumn("b", F.explode(F.array(F.reverse("a"), F.concat(F.col("a"), F.lit("s")), F.lit("red bolt"))))
    return pairs.select("a", "b", F.round(ratio("a", "b"), 6).alias("ratio"))


@query()
def embed_terms(spark, d):
    names = W.table(spark, d, "part").select(F.col("p_name").alias("term")).distinct()
    return names.select("term", embedder(64)("term").alias("embedding"))


_MASTER_SQL = "master AS (SELECT p_name AS canonical_molecule, min(p_brand) AS brand_name, min(p_partkey) AS ordinal, min(p_type) AS form FROM part GROUP BY 1)"


def _master(spark, d):
    return W.table(spark, d, "part").groupBy(F.col("p_name").alias("canonical_molecule")).agg(F.min("p_brand").alias("brand_name"), F.min("p_partkey").alias("ordinal"), F.min("p_type").alias("form"))


@query(f"""WITH {_MASTER_SQL}, t AS (SELECT DISTINCT unnest([p_name, 'Tab. ' || p_brand || ' 5mg', 'Inj ' || upper(p_name) || ' forte', substr(p_name, 1, 5), 'zq']) AS term FROM part),
c AS (SELECT term, upper(trim(regexp_replace(trim(term), '(?i)\\b(tab|cap|inj|syp|tablet|capsule|syrup|injection)\\b\\.?', '', 'g'))) AS u FROM t), x AS (SELECT *, regexp_replace(u, '[\\s\\-_]+', '', 'g') AS q FROM c),
m AS (SELECT *, upper(brand_name) AS ub, upper(canonical_molecule) AS um, regexp_replace(upper(brand_name), '[\\s\\-_]+', '', 'g') AS qb, regexp_replace(upper(canonical_molecule), '[\\s\\-_]+', '', 'g') AS qm FROM master),
j AS (SELECT term, ordinal, CASE WHEN q = '' THEN NULL WHEN q = qb OR q = qm THEN 1 WHEN regexp_matches(u, '\\b' || ub || '\\b') OR starts_with(u, ub) THEN 2 WHEN regexp_matches(u, '\\b' || um || '\\b') OR starts_with(u, um) THEN 3 WHEN contains(q, qb) OR contains(q, qm) OR (length(q) >= 4 AND (contains(qb, q) OR contains(qm, q))) THEN 4 END AS tier FROM x, m)
SELECT term, CAST(min(tier) AS INTEGER) AS tier, arg_min(ordinal, struct_pack(a := tier, b := ordinal)) AS ordinal FROM j WHERE tier IS NOT NULL GROUP BY 1""".replace("\\\\", "\\"))
def m1_tiered_match(spark, d):
    terms = W.table(spark, d, "part").select(F.explode(F.array(F.col("p_name"), F.concat(F.lit("Tab. "), F.col("p_brand"), F.lit(" 5mg")), F.concat(F.lit("Inj "), F.upper("p_name"), F.lit(" forte")), F.substring("p_name", 1, 5), F.lit("zq"))).alias("term"))
    return medicines.match_medicines(terms, _master(spark, d)).select("term", "tier", "ordinal")


@query(f"""WITH {_MASTER_SQL} SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'given' ELSE coalesce(b.form, m.form) END AS form FROM part LEFT JOIN (SELECT lower(brand_name) AS k, arg_min(form, ordinal) AS form FROM master GROUP BY 1) b ON lower(p_brand) = b.k LEFT JOIN (SELECT lower(canonical_molecule) AS k, form FROM master) m ON lower(p_name) = m.k""")
def j9_enrichment(spark, d):
    rows = W.table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.concat(F.col("p_brand"), F.lit(" 50 mg"))).alias("brand_name"), F.col("p_name").alias("canonical_molecule"), F.when(F.col("p_partkey") % 2 == 0, "given").alias("form"))
    return medicines.enrich(rows, _master(spark, d), ["form"]).select("p_partkey", "form")


_ASSERTED = (
    ("no {}", "negated"), ("{} denied", "negated"), ("without any {}", "negated"), ("negative for {}", "negated"), ("never had {}", "negated"), ("lack of sleep, {}", "affirmed"), ("h/o {}", "historical"), ("previous {}", "historical"),
    ("suspected {}", "uncertain"), ("r/o {}", "uncertain"), ("might be {}", "uncertain"), ("sister has {}", "family"), ("family history of {}", "historical"), ("no family history of {}", "negated"), ("nothing but {}", "affirmed"), ("knows {}", "affirmed"),
)


@query("SELECT event_id, CASE event_id % 16 " + " ".join(f"WHEN {i} THEN '{status}'" for i, (_, status) in enumerate(_ASSERTED)) + " END AS status FROM events")
def n2_assertion_phrases(spark, d):
    """More phrases of each class, words that only look like triggers, and phrases of two classes."""
    phrase = F.element_at(F.array(*(F.lit(p) for p, _ in _ASSERTED)), (F.col("event_id") % len(_ASSERTED) + 1).cast("int"))
    return W.table(spark, d, "events").select("event_id", R.assertion_status(F.replace(phrase, F.lit("{}"), F.col("event_type"))).alias("status"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Unknown' ELSE upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) END AS gender, CASE c_custkey % 5 WHEN 0 THEN 'New Consultation' WHEN 1 THEN 'Follow-up' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'Home Visit' ELSE 'Unknown' END AS visit FROM customer""")
def t19_labels(spark, d):
    """How genders and kinds of consultation are shown in reports."""
    k = F.col("c_custkey")
    gender = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ")))
    visit = F.when(k % 5 == 0, "a NEW patient").when(k % 5 == 1, "Follow up").when(k % 5 == 2, " ").when(k % 5 == 3, "home visit")
    return W.table(spark, d, "customer").select("c_custkey", I.display_gender(gender).alias("gender"), I.consultation_type(visit).alias("visit"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS visit_date FROM orders""")
def dt1_free_forms(spark, d):
    """Dates in words and figures, with times, weekdays and ordinals beside them, and phrases that are none."""
    kind, day = F.col("o_orderkey") % 8, F.col("o_orderdate")
    form = lambda pattern: F.date_format(day, pattern)
    n = F.dayofmonth(day)
    end = F.when(n.isin(1, 21, 31), "st").when(n.isin(2, 22), "nd").when(n.isin(3, 23), "rd").otherwise("th")
    raw = (
        F.when(kind == 0, form("d MMM yyyy")).when(kind == 1, form("MMMM d, yyyy")).when(kind == 2, form("dd.MM.yyyy HH:mm")).when(kind == 3, F.concat(form("EEEE, d"), end, F.lit(" of "), form("MMMM yyyy")))
        .when(kind == 4, form("d-MMM-yyyy h:mm a")).when(kind == 5, form("yyyy MMM dd")).when(kind == 6, form("d-M-yyyy")).otherwise(F.concat(F.lit("since "), form("MMMM yyyy")))
    )
    return W.table(spark, d, "orders").select("o_orderkey", D.clinical_date(raw).alias("visit_date"))


_FRAMES = ("{}", "no {}", "{} resolved", "denies {} currently", "labs {}", "review {}", "feels better, {}", "{} is ruled out", "worse {}", "mild {}", "plan: {}", "zero {} since monday", "absence of {} now", "overall stable {}", "{} gone", "severe {}", "next visit {}", "without {}!")


def _framed(spark, d):
    """Up to four words of every line of the documents, inside a phrase; and a word of the line that was said before."""
    line = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    rows = W.table(spark, d, "documents").select("doc_id", F.posexplode(line).alias("n", "line"))
    words = rows.select("doc_id", "n", F.regexp_extract_all(F.lower("line"), F.lit("([a-z]+)"), F.lit(1)).alias("w"))
    frame = F.element_at(F.array(*map(F.lit, _FRAMES)), ((F.col("doc_id") + F.col("n")) % len(_FRAMES) + 1).cast("int"))
    text = F.replace(frame, F.lit("{}"), F.array_join(F.slice("w", 1, 4), " "))
    return words.select("doc_id", "n", text.alias("text"), F.coalesce(F.get("w", F.lit(2)), F.lit("none before")).alias("past"))


def _sql(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _any_sql(patterns) -> str:
    return "regexp_matches(clean, '(?i)" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + "')"


_FRAMED_SQL = f"""l AS (SELECT doc_id, unnest(t) AS line, unnest(range(len(t))) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents)), w AS (SELECT doc_id, n, regexp_extract_all(lower(line), '[a-z]+') AS w FROM l),
f AS (SELECT doc_id, n, replace({_sql(_FRAMES)}[(doc_id + n) % {len(_FRAMES)} + 1], '{{}}', coalesce(array_to_string(w[1:4], ' '), '')) AS text, coalesce(w[3], 'none before') AS past FROM w), c AS (SELECT *, trim(text) AS clean FROM f)"""
_DENIED_SQL = ", ".join(rf"lower(trim(regexp_replace(trim(regexp_replace(trim(regexp_extract(clean, '(?i){p}', 1)), '{R.TIME_WORDS}', '', 'g')), '[^\w\s-]', '', 'g')))" for p in R.NEGATED)


@query(f"""WITH {_FRAMED_SQL}, d AS (SELECT *, list_filter([{_DENIED_SQL}], lambda x: length(x) > 1)[1] AS denied FROM c),
k AS (SELECT *, CASE WHEN clean = '' OR {_any_sql(R.NON_SYMPTOM)} THEN 'non_symptom' WHEN {_any_sql(R.GLOBAL_STATUS)} THEN 'global_status' WHEN denied IS NOT NULL THEN 'negated_symptom' WHEN list_contains({_sql(R.NOTHING)}, lower(clean)) THEN 'global_status' ELSE 'symptom' END AS category FROM d)
SELECT doc_id, CAST(n AS INTEGER) AS n, category, CASE category WHEN 'negated_symptom' THEN denied WHEN 'symptom' THEN clean END AS entity FROM k""")
def n9_triage_of_texts(spark, d):
    """Category and entity of phrases about the words of every line of the documents."""
    return _framed(spark, d).select("doc_id", "n", R.complaint_category(F.col("text")).alias("category"), R.complaint_entity(F.col("text")).alias("entity"))


def _core_sql(text: str) -> str:
    return f"list_distinct(list_filter(string_split(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) > 2 AND NOT list_contains({_sql(R.STOP_WORDS)}, x)))"


def _said_sql(vocabulary) -> str:
    return f"list_has_any(said, {_sql(vocabulary)})"


@query(f"""WITH {_FRAMED_SQL}, p AS (SELECT *, lower(clean) AS low, regexp_extract_all(lower(clean), '\\w+') AS said, unnest([past, 'severe ' || past || ' pain', 'low mood']) AS term FROM c),
s AS (SELECT doc_id, n, any_value(said) AS said, bool_or(contains(term, low) OR contains(low, term) OR list_has_any({_core_sql('low')}, {_core_sql('term')})) AS seen FROM p GROUP BY ALL)
SELECT doc_id, CAST(n AS INTEGER) AS n, CASE WHEN NOT seen THEN CASE WHEN {_said_sql(R.RESOLUTION)} THEN 'stop' ELSE 'new' END WHEN {_said_sql(R.RESOLUTION)} THEN 'stop' WHEN {_said_sql(R.IMPROVEMENT)} THEN 'decreased' WHEN {_said_sql(R.WORSENING)} THEN 'increased' ELSE 'maintained' END AS status FROM s""")
def n11_change_of_texts(spark, d):
    """What has become of phrases about the words of every line, against terms that a word of the line makes."""
    past = F.array(F.col("past"), F.concat(F.lit("severe "), F.col("past"), F.lit(" pain")), F.lit("low mood"))
    return _framed(spark, d).select("doc_id", "n", R.change_class(F.col("text"), past).alias("status"))
