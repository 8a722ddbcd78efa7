"""Complaint triage, assertion and change words, as regular-expression columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and phrase patterns of the clinical rules.
IMPROVEMENT = "improved improving better less decreased mild slight minor occasional intermittent reduced subsided controlled minimal fading easing resolving settled stable manageable partial responding".split()
WORSENING = "worse worsening increased severe significant marked persistent constant acute aggravated frequent escalating deteriorating unbearable exacerbated flaring uncontrolled intractable progressive refractory spreading intensified".split()
RESOLUTION = "no none nil denies denied zero resolved free stopped without absent gone cleared cured remission asymptomatic symptom-free".split()
STOP_WORDS = "a an the in on at for to of and or last days no none mild severe occasional worse better improved didnt didn't suit once twice consumption".split()
NON_SYMPTOM = (
    r"^informant\b", r"^history\s+(?:to\s+be\s+taken|obtained|given)", r"^more\s+history", r"to\s+be\s+taken\s+from", r"^follow\s*-?up\b", r"^review\b", r"^referred?\s+to\b", r"^investigations?\b", r"^labs?\b", r"^blood\s+test",
    r"^advised\b", r"^plan\b", r"^next\s+visit\b", r"^attendant\b", r"^attending\b", r"^accompanied\s+by\b", r"^brought\s+by\b", r"^reliable\b", r"^patient\s+is\s+accompanied\b",
)
GLOBAL_STATUS = (
    r"^(?:feels?|feeling)\s+(?:much\s+|far\s+|a\s+lot\s+)?(?:better|well|good|fine|normal|stable|ok|okay)",
    r"^doing\s+(?:much\s+|far\s+|a\s+lot\s+)?(?:better|well|good|fine|ok|okay)",
    r"^(?:no|nil|zero)\s+(?:active\s+)?(?:symptoms?|complaints?|issues?|problems?)(?:\s+reported|\s+noted)?",
    r"^(?:asymptomatic|symptom\s*-?free|completely\s+normal|in\s+remission|doing\s+fine|no\s+complaints?)",
    r"^patient\s+(?:feels?|is\s+doing)\s+(?:much\s+)?better",
    r"^overall\s+(?:better|improved|stable|good|fine)",
)
NEGATED = (
    r"^(?:denies|denied|denying)\s+(.+)", r"^(?:no|nil)\s+(.+)", r"^without\s+(.+)", r"^free\s+of\s+(.+)", r"^zero\s+(.+)", r"^absence\s+of\s+(.+)",
    r"^(.+?)\s+(?:resolved|stopped|gone|cleared|cured|absent)$", r"^(.+?)\s+(?:is\s+)?(?:denied|ruled\s+out)$",
)
TIME_WORDS = r"(?i)\b(?:currently|now|today|reported|noted|anymore|at\s+present|any\s+more|since\s+\w+)\b"
NOTHING = ("nil", "none", "no", "zero", "na", "n/a")
DEFICIT = r"(?i)\b(?:lack|loss|shortage|decreased|reduced|poor|low|difficulty|trouble)\s+(?:of\s+)?(?:sleep|sleeping|appetite|energy|concentration|interest|memory|weight|libido)\b"
MEDICINE_NAME = r"(?:tab(?:let)?\.?\s+|cap(?:sule)?\.?\s+)?([A-Za-z0-9\-\.\+/]+(?:\s+[A-Za-z0-9\-\.\+/]+){0,3})"
IN_USE = r"(?i)(?:currently\s+)?(?:taking|takes|on|uses|using|compliant\s+with|continuing|continued)\s+" + MEDICINE_NAME
NOT_IN_USE = r"(?i)\b(?:not|stopped|discontinued|stopped\s+taking|never)\b"
DISCONTINUED = r"(?i)(?:stopped|discontinued|off|omitted|withdrawn|held|not\s+taking|stopped\s+taking)\s+" + MEDICINE_NAME
GENERIC_NAMES = ("medication", "medications", "meds", "pills", "drugs")


def _any(text: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once, however often ``f`` names it.

    A column that is used in several places is an expression in each of them,
    also inside a lambda, so that nested uses multiply; a lambda's variable
    isn't.
    """
    return F.transform(F.array(value), f)[0]


def negated_entity(text: Column) -> Column:
    """What a negated phrase denies, in lower case, without time words and punctuation; null if nothing is denied."""

    def found(clean: Column) -> Column:
        hits = F.array(*(F.trim(F.regexp_extract(clean, f"(?i){pattern}", 1)) for pattern in NEGATED))
        bare = F.transform(hits, lambda hit: F.trim(F.regexp_replace(F.trim(F.regexp_replace(hit, TIME_WORDS, "")), r"[^\w\s-]", "")))
        return F.lower(F.get(F.filter(bare, lambda hit: F.length(hit) > 1), F.lit(0)))

    return bound(F.trim(text), found)


def complaint_category(text: Column, denied: Column | None = None) -> Column:
    """non_symptom, global_status, negated_symptom or symptom; the first family that fits.  ``denied`` may give the text's negated entity."""

    def category(clean: Column) -> Column:
        return (
            F.when(clean == "", "non_symptom")
            .when(_any(clean, NON_SYMPTOM), "non_symptom")
            .when(_any(clean, GLOBAL_STATUS), "global_status")
            .when((negated_entity(clean) if denied is None else denied).isNotNull(), "negated_symptom")
            .when(F.lower(clean).isin(*NOTHING), "global_status")
            .otherwise("symptom")
        )

    return bound(F.trim(F.coalesce(text, F.lit(""))), category)


def complaint_entity(text: Column) -> Column:
    def entity(m: Column) -> Column:
        category = complaint_category(m["clean"], m["denied"])
        return bound(category, lambda c: F.when(c == "negated_symptom", m["denied"]).when(c == "symptom", m["clean"]))

    return bound(F.struct(F.trim(text).alias("clean"), negated_entity(text).alias("denied")), entity)


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.trim(text)), F.lit(r"\b(\w+)\b"), F.lit(1)))


def core_tokens(text: Column) -> Column:
    """Words of more than two characters that are no stop words."""
    parts = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(parts, lambda x: (F.length(x) > 2) & ~x.isin(*STOP_WORDS)))


def has_word(text: Column, vocabulary: Sequence[str]) -> Column:
    return F.arrays_overlap(words(text), F.array(*map(F.lit, vocabulary)))


def seen_before(term: Column, past: Column) -> Column:
    """Whether a term equals, holds, is held by, or shares a core word with one of the past terms."""

    def seen(m: Column) -> Column:
        alike = lambda p: F.lower(F.trim(p)).contains(m["low"]) | m["low"].contains(F.lower(F.trim(p))) | F.coalesce(F.arrays_overlap(m["mine"], core_tokens(p)), F.lit(False))
        return F.exists(past, alike)

    return bound(F.lower(F.trim(term)), lambda low: bound(F.struct(low.alias("low"), core_tokens(low).alias("mine")), seen))


def _said(words_: Column, vocabulary: Sequence[str]) -> Column:
    return F.arrays_overlap(words_, F.array(*map(F.lit, vocabulary)))


def change_class(term: Column, past: Column) -> Column:
    """stop, new, decreased, increased or maintained, by the term's words and whether it was seen before."""

    def change(m: Column) -> Column:
        resolved = _said(m["words"], RESOLUTION)
        return (
            F.when(~F.coalesce(m["seen"], F.lit(False)), F.when(resolved, "stop").otherwise("new"))
            .when(resolved, "stop")
            .when(_said(m["words"], IMPROVEMENT), "decreased")
            .when(_said(m["words"], WORSENING), "increased")
            .otherwise("maintained")
        )

    return bound(F.struct(words(term).alias("words"), seen_before(term, past).alias("seen")), change)


def symptom_condition(term: Column, past: Column) -> Column:
    """(matched, note) of a current term against the past terms in order: the first that holds or is held by it, else the largest core overlap."""

    def match(low: Column) -> Column:
        direct = F.get(F.filter(past, lambda p: F.lower(F.trim(p)).contains(low) | low.contains(F.lower(F.trim(p)))), F.lit(0))
        ranked = lambda mine: F.transform(past, lambda p, i: F.struct(F.size(F.array_intersect(mine, core_tokens(p))).alias("n"), (-i).alias("at"), p.alias("p")))
        best = bound(core_tokens(low), lambda mine: F.array_max(F.filter(ranked(mine), lambda x: x["n"] > 0)))
        return F.coalesce(direct, best["p"])

    def note(m: Column) -> Column:
        now, then = (lambda v: _said(m["now"], v)), (lambda v: _said(m["then"], v))
        said = (
            F.when(m["matched"].isNull(), "new symptom")
            .when(now(RESOLUTION), F.concat(F.lit("condition resolved/stopped, changed from "), m["matched"]))
            .when((now(IMPROVEMENT) & ~then(IMPROVEMENT)) | (then(WORSENING) & ~now(WORSENING)), F.concat(F.lit("condition improved, changed from "), m["matched"]))
            .when((now(WORSENING) & ~then(WORSENING)) | (then(IMPROVEMENT) & ~now(IMPROVEMENT)), F.concat(F.lit("condition worsened, changed from "), m["matched"]))
            .otherwise("no change")
        )
        return F.struct(m["matched"].alias("matched"), said.alias("note"))

    matched = bound(F.lower(F.trim(term)), match)
    return bound(matched, lambda found: bound(F.struct(found.alias("matched"), words(term).alias("now"), words(found).alias("then")), note))


def _medicine(text: Column, pattern: str) -> Column:
    name = F.trim(F.regexp_replace(F.trim(F.regexp_extract(F.trim(text), pattern, 1)), r"[,;:\.\?]+$", ""))
    return F.when((name != "") & ~F.lower(name).isin(*GENERIC_NAMES), name)


def medicine_in_use(text: Column) -> Column:
    return F.when(~F.coalesce(text.rlike(NOT_IN_USE), F.lit(True)), _medicine(text, IN_USE))


def medicine_discontinued(text: Column) -> Column:
    return _medicine(text, DISCONTINUED)


def assertion_status(text: Column) -> Column:
    """negated, historical, uncertain, family or affirmed, by trigger phrases before a term; deficits such as loss of appetite are affirmed.

    Trigger phrases follow the published NegEx and ConText algorithms, with the
    segment as their scope.
    """
    negated = r"(?i)\b(?:no|not|denies|denied|denying|without|absence of|free of|negative for|rules? out|ruled out|never|nil|resolved)\b"
    historical = r"(?i)\b(?:history of|h/o|past history|previous(?:ly)?|in the past|prior)\b"
    uncertain = r"(?i)(?:^\s*\?|\b(?:possible|possibly|probable|probably|suspected|query|may have|might|likely|if|rule out|r/o)\b)"
    family = r"(?i)\b(?:family history|mother|father|brother|sister|sibling|parent|grand(?:mother|father)|uncle|aunt|cousin)s?\b"
    return F.when(text.rlike(negated) & ~text.rlike(DEFICIT), "negated").when(text.rlike(historical), "historical").when(text.rlike(uncertain), "uncertain").when(text.rlike(family), "family").otherwise("affirmed")


#: Status words of model answers, and what they mean.
STATUS_MEANING = {
    "improved": ("decreased", "improved"), "improving": ("decreased", "improved"), "decreased": ("decreased", "improved"), "better": ("decreased", "improved"), "mild": ("decreased", "improved"),
    "worsened": ("increased", "worsened"), "worsening": ("increased", "worsened"), "increased": ("increased", "worsened"), "worse": ("increased", "worsened"), "severe": ("increased", "worsened"),
    "maintained": ("maintained", "maintained"), "unchanged": ("maintained", "maintained"), "same": ("maintained", "maintained"), "stable": ("maintained", "maintained"),
    "resolved": ("stop", "resolved"), "stopped": ("stop", "resolved"), "stop": ("stop", "resolved"), "new": ("new", "new"),
}


def _meaning(raw: Column, which: int) -> Column:
    mapping = F.create_map(*[F.lit(x) for k, v in STATUS_MEANING.items() for x in (k, v[which])])
    return F.element_at(mapping, F.lower(F.trim(F.coalesce(raw, F.lit("")))))


def canonical_status(raw: Column, default: Column | None = None) -> Column:
    """The canonical status of a model's status word; the default for words that are not listed."""
    return F.coalesce(_meaning(raw, 0), default if default is not None else F.lit(None).cast("string"))


def displayed_status(raw: Column) -> Column:
    """How a model's status word is shown; null for words that are not listed."""
    return _meaning(raw, 1)


def json_answer(text: Column) -> Column:
    """The JSON object of a model's answer: inside a fence if there is one, else from the first to the last brace; null if it does not parse."""
    fenced = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)\s*```", 1)
    body = bound(fenced, lambda f: F.when(F.coalesce(f, F.lit("")) != "", f).otherwise(text))
    return bound(body, lambda b: F.coalesce(F.try_parse_json(b), F.try_parse_json(F.regexp_extract(b, r"(\{[\s\S]*\})", 1))))
