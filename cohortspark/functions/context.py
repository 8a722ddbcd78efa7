"""Assertion with scopes, after the published ConText algorithm: a status for each finding of a text.

A text is cut into tokens; phrases of a vocabulary, the longest first, become
one mark each.  One pass over the tokens keeps which modifiers are open:

* ``negated>`` and the like open a modifier for what follows, up to the next
  terminating word or mark;
* ``<negated`` and the like hold for the findings before them, back to the
  last termination;
* ``stop`` ends all scopes, ``gap`` only ends a finding;
* ``pseudo`` phrases look like a modifier and are none.

Words between marks make a finding.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .triage import DEFICIT

STATUSES = ("negated", "historical", "uncertain", "family")
TOKEN = r"[\p{L}\p{N}'/-]+|[,;:.!?\n]"

#: Trigger phrases of the published NegEx and ConText lists, by what they do.
PHRASES = {
    "negated>": "no, not, denies, denied, denying, without, absence of, free of, negative for, never, never had, no evidence of, no sign of, no signs of, rules out, ruled out for, declines, nil",
    "<negated": "denied by patient, is absent, are absent, was absent, were absent, absent, resolved, is ruled out, are ruled out, was ruled out, were ruled out, ruled out, unlikely",
    "historical>": "history of, h/o, past history of, past medical history of, previous, previously, prior",
    "<historical": "in the past, years ago, in childhood",
    "uncertain>": "possible, possibly, probable, probably, suspected, query, may have, might have, might be, could be, likely, if, rule out, r/o, ?",
    "<uncertain": "is suspected, is possible, cannot be excluded, not ruled out, to be ruled out",
    "family>": "family history of, mother has, mother had, father has, father had, brother has, brother had, sister has, sister had, parents have, parents had, grandmother had, grandfather had, uncle had, aunt had",
    "<family": "in the family, in his family, in her family, in mother, in father",
    "stop": "but, however, although, though, yet, except, apart from, aside from, besides, nevertheless, still, because, since, which, ., ;, :, !, \n",
    "gap": "and, or, nor, as well as, with, has, had, have, is, was, are, were, the, a, an, any, patient, pt, he, she, they, reports, reported, complains of, presents with, also, now, ,",
    "pseudo": "no increase, no change, no further, not only, not necessarily, not certain, gram negative, without difficulty, history taking, no interval change, history and physical",
}


def vocabulary(phrases: Mapping[str, str]) -> dict[str, str]:
    """What each phrase does; phrases are listed with a comma and a blank between them, a comma as the last one."""
    return {phrase: kind for kind, listed in phrases.items() for phrase in listed.split(", ")}


CLINICAL = vocabulary(PHRASES)


def _marks(text: Column, known: Mapping[str, str]) -> Column:
    """An array of (word, kind, skip): the longest phrase that begins at each token, and how many tokens it covers besides."""
    longest = max((p.count(" ") + 1 for p in known), default=1)
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    tokens = F.transform(F.array(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))), lambda t: t)

    def at(t: Column, i: Column) -> Column:
        found = F.lit(None).cast("struct<word: string, kind: string, skip: int>")
        for n in range(1, longest + 1):  # the last that fits is the longest
            kind = F.try_element_at(table, F.array_join(F.slice(t, i + 1, F.lit(n)), " "))
            found = F.when((i + n <= F.size(t)) & kind.isNotNull(), F.struct(t[i].alias("word"), kind.alias("kind"), F.lit(n - 1).alias("skip"))).otherwise(found)
        return F.coalesce(found, F.struct(t[i].alias("word"), F.lit("word").alias("kind"), F.lit(0).alias("skip")))

    return F.flatten(F.transform(tokens, lambda t: F.transform(F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>")), lambda i: at(t, i))))


def scoped_findings(text: Column, known: Mapping[str, str] = CLINICAL) -> Column:
    """The findings of a text in order, as an array of (finding, status); none for null and empty texts.

    A finding that several modifiers hold for has the first status of
    STATUSES; findings that are a deficit, such as loss of appetite, are never
    negated.
    """
    finding = f"struct<finding: string, {', '.join(f'{s}: boolean' for s in STATUSES)}>"
    none = F.array().cast("array<string>")
    start = F.struct(
        none.alias("words"), F.array().cast(f"array<{finding}>").alias("closed"), F.array().cast(f"array<{finding}>").alias("open"), F.struct(*(F.lit(False).alias(s) for s in STATUSES)).alias("on"), F.lit(0).alias("skip")
    )

    def flushed(s: Column) -> Column:
        """The findings of the present scope, with the one that ends here."""
        now = F.struct(F.array_join(s["words"], " ").alias("finding"), *(s["on"][x].alias(x) for x in STATUSES))
        return F.when(F.size(s["words"]) > 0, F.concat(s["open"], F.array(now))).otherwise(s["open"])

    def state(words: Column, closed: Column, open_: Column, on: Column, skip: Column) -> Column:
        return F.struct(words.alias("words"), closed.alias("closed"), open_.alias("open"), on.alias("on"), skip.alias("skip"))

    def step(s: Column, m: Column) -> Column:
        kind = m["kind"]
        off = F.struct(*(F.lit(False).alias(x) for x in STATUSES))
        opened = F.struct(*((s["on"][x] | (kind == f"{x}>")).alias(x) for x in STATUSES))
        behind = F.transform(flushed(s), lambda f: F.struct(f["finding"].alias("finding"), *((f[x] | (kind == f"<{x}")).alias(x) for x in STATUSES)))
        return (
            F.when(s["skip"] > 0, state(s["words"], s["closed"], s["open"], s["on"], s["skip"] - 1))
            .when(kind == "word", state(F.concat(s["words"], F.array(m["word"])), s["closed"], s["open"], s["on"], F.lit(0)))
            .when(kind == "stop", state(none, F.concat(s["closed"], flushed(s)), start["open"], off, m["skip"]))
            .when(kind.startswith("<"), state(none, s["closed"], behind, s["on"], m["skip"]))
            .otherwise(state(none, s["closed"], flushed(s), opened, m["skip"]))
        )

    def named(f: Column) -> Column:
        status = F.when(f["negated"] & ~F.coalesce(f["finding"].rlike(DEFICIT), F.lit(False)), "negated")
        for x in STATUSES[1:]:
            status = status.when(f[x], x)
        return F.struct(f["finding"].alias("finding"), status.otherwise("affirmed").alias("status"))

    return F.transform(F.aggregate(_marks(text, known), start, step, lambda s: F.concat(s["closed"], flushed(s))), named)


def overall_status(findings: Column) -> Column:
    """The status of a text by those of its findings: the first of STATUSES that any has, affirmed if none has one."""
    has = lambda x: F.exists(findings, lambda f: f["status"] == x)
    out = F.when(has(STATUSES[0]), STATUSES[0])
    for x in STATUSES[1:]:
        out = out.when(has(x), x)
    return out.otherwise("affirmed")
