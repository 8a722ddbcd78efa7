"""Joins of strings: by what they share of their letters, and by one standing inside the other.

``similar_strings`` bounds the ratio 2 * matches / (|a| + |b|) of two strings
from above by the letters they share, counted as often as both have them, and
finds the pairs within that bound by a prefix filter: the k-th of a letter is
an element of its string, elements are in one order, rarest first, and two
strings that share enough of them share one among the first few of each.

``containing`` finds strings inside texts by an index of trigrams with their
places.  A query is cut into trigrams that cover it; the list of its rarest
one gives the places where it may begin, at which the others are looked up.

``inside_pieces`` needs no index: queries that hold no separator stand inside
a piece of a text between separators, and are looked up by their first letters
among the parts of its pieces.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread, written

GRAM = 3
#: Letters by which a query is looked up, those of a piece that are taken apart at once, and queries that are sent to every task.
HEAD, STRETCH, SENT_QUERIES = 12, 256, 200_000


def _letters(s: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(s, "")), "")


def _times(s: Column, letter: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, letter, F.lit("")))


def common_letters(a: Column, b: Column) -> Column:
    """How many letters two strings share, each as often as both have it."""
    return F.aggregate(_letters(a), F.lit(0), lambda n, x: n + F.least(_times(a, x), _times(b, x)))


def _over(numerator: int, denominator: int, n: Column) -> Column:
    """n * numerator / denominator, rounded up; both are whole, so that their quotient is whole if it should be."""
    return F.ceil((n * numerator).cast("double") / denominator).cast("int")


def _limit(threshold: float) -> Fraction:
    return Fraction(str(threshold))


def within_bound(a: Column, b: Column, threshold: float) -> Column:
    """Whether the ratio of two strings may reach ``threshold``: by their lengths first, then by the letters they share."""
    t = _limit(threshold)
    both = F.length(a) + F.length(b)
    enough = lambda common: 2 * t.denominator * common >= t.numerator * both
    return F.when(enough(F.least(F.length(a), F.length(b))), enough(common_letters(a, b))).otherwise(both == 0)


def _elements(strings: DataFrame, s: str) -> DataFrame:
    """(s, e): an element for each letter of each string, the k-th of one letter told from the first."""
    counted = F.transform(_letters(F.col(s)), lambda x: F.struct(x.alias("x"), _times(F.col(s), x).alias("n")))
    each = F.flatten(F.transform(counted, lambda c: F.transform(F.sequence(F.lit(1), c["n"]), lambda k: F.concat(c["x"], k.cast("string")))))
    return strings.select(s, F.explode(each).alias("e"))


def _prefixes(strings: DataFrame, s: str, order: DataFrame, t: Fraction) -> DataFrame:
    """(s, e, place): the first elements of each string, one more than it can do without."""
    placed = _elements(strings, s).join(order, "e", "left")
    place = F.row_number().over(Window.partitionBy(s).orderBy(F.coalesce("n", F.lit(0)), "e"))
    size = F.length(s)
    return placed.select(s, "e", place.alias("place")).where(F.col("place") <= size - _over(t.numerator, 2 * t.denominator - t.numerator, size) + 1)


def similar_strings(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b): strings of ``left`` (column a) with those of ``right`` (column b) whose ratio may reach ``threshold``.

    Every pair whose Ratcliff/Obershelp ratio reaches it is among them, and
    none that shares too few letters.  Strings that repeat, null and empty
    ones count once or not at all; an empty side gives no rows.
    """
    t = _limit(threshold)
    a = left.select("a").where("a <> ''").distinct()
    b = right.select("b").where("b <> ''").distinct()
    order = _elements(b, "b").groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    la, lb = F.length("a"), F.length("b")
    pa, pb = _prefixes(a, "a", order, t).withColumnRenamed("place", "i"), _prefixes(b, "b", order, t).withColumnRenamed("place", "j")
    needed = t.numerator * (la + lb)
    # what can still be shared from the first common element on
    left_over = F.least(la - F.col("i"), lb - F.col("j")) + 1
    met = pa.join(pb, "e").where((2 * t.denominator * F.least(la, lb) >= needed) & (2 * t.denominator * left_over >= needed))
    return met.select("a", "b").distinct().where(2 * t.denominator * common_letters(F.col("a"), F.col("b")) >= needed)


def gram_postings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(gram, key, at): every trigram of the texts with its places, and each single letter and pair once a text, at 0."""
    s = F.col(text)
    size = F.length(s)
    placed = F.when(size >= GRAM, F.transform(F.sequence(F.lit(1), size - (GRAM - 1)), lambda i: F.struct(F.substring(s, i, F.lit(GRAM)).alias("gram"), i.alias("at"))))
    short = lambda n: F.when(size >= n, F.transform(F.array_distinct(F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))), lambda g: F.struct(g.alias("gram"), F.lit(0).alias("at"))))
    none = F.array().cast("array<struct<gram: string, at: int>>")
    every = F.concat(*(F.coalesce(x, none) for x in (placed, short(1), short(2))))
    return texts.select(key, F.explode(every).alias("p")).select("p.gram", key, "p.at").distinct()


def containing(queries: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """(q, key): query strings (column q) with the texts that contain them, told from the index alone.

    ``postings`` are ``gram_postings``.  Empty and null queries are inside
    none; those that repeat count once.
    """
    asked = queries.select("q").where("q <> ''").distinct().withColumn("size", F.length("q"))
    # an index is many times its texts, which the plan's estimates don't know: it is never sent to the driver for a broadcast
    postings = postings.hint("merge")
    short = asked.where(F.col("size") < GRAM).join(postings.where("at = 0"), F.col("q") == F.col("gram")).select("q", key).distinct()
    long = asked.where(F.col("size") >= GRAM)
    offsets = F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("size") - GRAM, F.lit(GRAM)), F.array(F.col("size") - GRAM)))
    cover = long.select("q", F.explode(offsets).alias("off")).withColumn("gram", F.substring("q", F.col("off") + 1, F.lit(GRAM)))
    places = postings.where("at > 0").hint("merge")
    often = places.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a trigram that no text has leaves nothing of its query
    counted = cover.join(often.hint("merge"), "gram", "left").groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "off")).alias("rare"), F.collect_set(F.struct("off", "gram")).alias("cover")).where("rare.n > 0")
    starts = counted.select("q", "cover", "rare.gram", "rare.off").hint("merge").join(places, "gram").select("q", "cover", key, (F.col("at") - F.col("off")).alias("start")).where("start > 0")
    others = starts.select("q", key, "start", F.size("cover").alias("needed"), F.explode("cover").alias("c")).select("q", key, "start", "needed", "c.gram", (F.col("start") + F.col("c.off")).alias("at"))
    whole = others.join(places, ["gram", key, "at"]).groupBy("q", key, "start").agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed")).where("n = needed")
    return short.unionByName(whole.select("q", key).distinct())


def _parts(pieces: Column, sizes: list[int]) -> Column:
    """The distinct parts of the pieces that have one of the sizes, each piece taken in stretches that overlap."""
    long = lambda p: F.transform(F.sequence(F.lit(1), F.length(p), F.lit(STRETCH)), lambda at: F.substring(p, at, F.lit(STRETCH + HEAD - 1)))
    stretches = F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) <= STRETCH, F.array(p)).otherwise(long(p))))
    of_size = lambda p, n: F.when(F.length(p) >= n, F.transform(F.sequence(F.lit(1), F.length(p) - n + 1), lambda i: F.substring(p, i, n))).otherwise(F.array().cast("array<string>"))
    every = F.transform(stretches, lambda p: F.flatten(F.transform(F.array(*map(F.lit, sizes)), lambda n: of_size(p, n))))
    return F.array_distinct(F.flatten(every))


def inside_pieces(queries: DataFrame, texts: DataFrame, key: str, text: str, separators: str) -> DataFrame:
    """(q, key): query strings (column q) with the texts that contain them, once for each row of ``texts``.

    ``separators`` is a pattern of what may stand between pieces.  Texts are
    shuffled once to be dealt out; their parts are not shuffled, as queries are
    sent to every task.  Queries that hold a separator, and those beyond
    SENT_QUERIES, are found by ``containing``.  Empty and null queries are
    inside none; those that repeat count once.
    """
    asked = written(queries.select("q").where("q <> ''").distinct().withColumn("plain", ~F.regexp_like("q", F.lit(separators))))
    rows = spread(texts.select(key, F.col(text).alias("__text")), key)
    plain = asked.where("plain").select("q", F.substring("q", 1, HEAD).alias("__part"))
    if plain.count() > SENT_QUERIES:
        plain, asked = plain.limit(0), asked.withColumn("plain", F.lit(False))
    sizes = sorted(r.n for r in plain.select(F.length("__part").alias("n")).distinct().collect())  # at most HEAD
    found = None
    if sizes:
        parts = rows.withColumn("__part", F.explode(_parts(F.array_distinct(F.split("__text", separators)), sizes)))
        held = (F.length("q") <= HEAD) | F.contains("__text", F.col("q"))
        found = parts.join(F.broadcast(plain), "__part").where(held).select("q", key)
    rest = asked.where("not plain").select("q")
    if found is not None and rest.isEmpty():
        return found
    numbered = written(rows.withColumn("__row", F.monotonically_increasing_id()))
    other = containing(rest, gram_postings(numbered, "__row", "__text"), "__row").join(numbered.select("__row", key), "__row").select("q", key)
    return other if found is None else found.unionByName(other)
