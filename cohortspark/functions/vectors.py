"""Vector and similarity arithmetic on array columns, in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHA, TAU, SIGMA = 0.5, 0.3, 0.3


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one is null or has no length."""
    length = norm(a) * norm(b)
    return F.coalesce(F.when(length > 0, dot(a, b) / length), F.lit(0.0))


def sharpen(raw: Column, tau: float = TAU) -> Column:
    return F.greatest(F.lit(0.0), (raw - tau) / (1 - tau))


def term_similarity(term_a: Column, term_b: Column, code_a: Column, code_b: Column, cos: Column, wu_palmer: Column, alpha: float = ALPHA, tau: float = TAU) -> Column:
    """1 for equal terms or codes; otherwise cosine, mixed with Wu-Palmer where both have codes, sharpened above ``tau``."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    positive = F.greatest(F.coalesce(cos, F.lit(0.0)), F.lit(0.0))
    both = code_a.isNotNull() & code_b.isNotNull()
    raw = F.when(both, alpha * positive + (1 - alpha) * F.coalesce(wu_palmer, F.lit(0.0))).otherwise(positive)
    same = ((low(term_a) != "") & (low(term_a) == low(term_b))) | (both & (code_a.cast("string") == code_b.cast("string")))
    return F.when(same, F.lit(1.0)).otherwise(sharpen(raw, tau))


def idf_weight(df: Column, n: int = 1000) -> Column:
    return F.log(F.lit(float(n + 1)) / (F.coalesce(df, F.lit(1)) + 1.0)) + 1.0


def composite(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the parts that are not null and weigh something, cut to 0..1; 0 if none is."""
    used = [(s, w) for s, w in parts if w > 0]
    if not used:
        return F.lit(0.0)
    total = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in used), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in used), F.lit(0.0))
    return F.when(weight > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / weight))).otherwise(0.0)


def age_band(age: Column) -> Column:
    """Eight bands of completed years; fractions of a year fall upward."""
    edges = (5, 9, 12, 17, 25, 40, 60)
    out = F.when(age <= edges[0], 0)
    for band, edge in enumerate(edges[1:], 1):
        out = out.when(age <= edge, band)
    return F.when(age.isNotNull(), out.otherwise(7))


def age_similarity(a: Column, b: Column, sigma: float = SIGMA) -> Column:
    """0.7 of the bands' nearness and 0.3 of a Gaussian of the log ages; 0 from three bands apart, null for missing or negative ages."""
    a, b = a.cast("double"), b.cast("double")
    apart = F.abs(age_band(a) - age_band(b))
    band = F.when(apart == 0, 1.0).when(apart == 1, 0.7).when(apart == 2, 0.1)
    gap = F.log1p(a) - F.log1p(b)
    score = 0.7 * band + 0.3 * F.exp(-(gap * gap) / (2 * math.pow(sigma, 2)))
    return F.when((a >= 0) & (b >= 0), F.when(apart >= 3, 0.0).otherwise(F.least(score, F.lit(1.0))))


def ages_compatible(a: Column, b: Column) -> Column:
    """False only where both ages are there and three or more bands apart; a plain predicate that can be pushed down."""
    return F.coalesce(F.abs(age_band(a) - age_band(b)) < 3, F.lit(True))


def normalize_gender(value: Column) -> Column:
    text = F.lower(F.trim(value))
    return F.when(text == "", F.lit(None)).when(text.isin("m", "male"), "male").when(text.isin("f", "female"), "female").when(text.isin("o", "other"), "other").otherwise(text)


def gender_similarity(a: Column, b: Column) -> Column:
    a, b = normalize_gender(a), normalize_gender(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, 1.0).otherwise(0.0))


def demographic_similarity(age_a: Column, age_b: Column, gender_a: Column, gender_b: Column) -> Column:
    """Mean of age and gender; 0 where ages do not fit; either alone where the other is missing."""
    age, gender = age_similarity(age_a, age_b), gender_similarity(gender_a, gender_b)
    return F.when(age == 0, 0.0).otherwise(F.coalesce((age + gender) / 2, age, gender))


def normalize_visit_type(value: Column) -> Column:
    text = F.lower(F.trim(value))
    return F.when(text.contains("follow") | text.contains("fu"), "follow-up").when(text.contains("new") | text.contains("consult") | text.contains("first"), "new consultation").otherwise(text)


def visit_type_similarity(a: Column, b: Column) -> Column:
    a, b = normalize_visit_type(a), normalize_visit_type(b)
    return F.when((a != "") & (a == b), 1.0).otherwise(0.5)


def case_score(clinical: Column, demographic: Column) -> Column:
    return F.round(F.coalesce(0.5 * clinical + 0.5 * demographic, clinical), 4)


def call_cost(family: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """US dollars of a model call: prices per million tokens, in and out, by family."""
    pro = F.lower(family).contains("pro")
    price = lambda n, a, b: n * F.when(pro, a).otherwise(b)
    return F.round((price(tokens_in, 1.25, 0.075) + price(tokens_out, 5.0, 0.3)) / 1_000_000, 6)


def unit(a: Column) -> Column:
    """A vector scaled to length 1; a vector without length stays as it is."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def mean_pooled(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask is above 0, component by component; null where none is."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] > 0), lambda x: x["v"])
    first = F.transform(F.get(kept, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(kept, first, lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))
