import random
import re

import pytest
from pyspark.sql import functions as F

from cohortspark.functions import context as C
from cohortspark.functions import triage
from cohortspark.operators import resolution as R



def plain(text, known=C.CLINICAL):
    """The same rules as a loop."""
    tokens = re.findall(r"(?:[^\W_]|['/-])+|[,;:.!?\n]", (text or "").lower())
    longest = max(p.count(" ") + 1 for p in known)
    closed, scope, words, on, i = [], [], [], set(), 0

    def flush():
        if words:
            scope.append([" ".join(words), set(on)])
            words.clear()

    while i < len(tokens):
        for n in range(longest, 0, -1):
            kind = known.get(" ".join(tokens[i : i + n])) if i + n <= len(tokens) else None
            if kind:
                break
        i += n if kind else 1
        if not kind:
            words.append(tokens[i - 1])
            continue
        flush()
        if kind == "stop":
            closed += scope
            scope, on = [], set()
        elif kind[0] == "<":
            for f in scope:
                f[1].add(kind[1:])
        elif kind[-1] == ">":
            on.add(kind[:-1])
    flush()
    out = []
    for name, marks in closed + scope:
        marks = marks - {"negated"} if re.search(triage.DEFICIT, name) else marks
        out.append((name, next((s for s in C.STATUSES if s in marks), "affirmed")))
    return out


PHRASES = {
    "no fever but cough": [("fever", "negated"), ("cough", "affirmed")],
    "Denies chest pain, nausea or vomiting; has headache": [("chest pain", "negated"), ("nausea", "negated"), ("vomiting", "negated"), ("headache", "affirmed")],
    "fever and cough resolved but rash": [("fever", "negated"), ("cough", "negated"), ("rash", "affirmed")],
    "mother has diabetes. patient reports anxiety": [("diabetes", "family"), ("anxiety", "affirmed")],
    "no loss of appetite": [("loss of appetite", "affirmed")],
    "history of asthma; no increase in pain": [("asthma", "historical"), ("in pain", "affirmed")],
    "no family history of stroke": [("stroke", "negated")],
    "? pneumonia": [("pneumonia", "uncertain")],
    "embolism cannot be excluded\nnot only fever": [("embolism", "uncertain"), ("fever", "affirmed")],
    "nothing but notable knots": [("nothing", "affirmed"), ("notable knots", "affirmed")],
    "": [],
    None: [],
    " , . ; ": [],
}


def found(spark, texts, known=C.CLINICAL):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", C.scoped_findings(F.col("t"), known).alias("f"), C.overall_status(C.scoped_findings(F.col("t"), known)).alias("s"))
    return {r.i: ([tuple(x) for x in r.f], r.s) for r in rows.collect()}


def test_scopes_of_phrases(spark):
    got = found(spark, PHRASES)
    assert [got[i][0] for i in range(len(PHRASES))] == list(PHRASES.values())
    assert got[0][1] == "negated" and got[4][1] == "affirmed" and got[3][1] == "family"


@pytest.mark.parametrize("seed", range(2))
def test_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    stock = [*rng.sample(list(C.CLINICAL), 40), "but", "no", "absent", ",", ".", "pain", "low", "mood", "é-x", "loss of sleep", "(", "h/o", "\n"]
    texts = [" ".join(rng.choice(stock) for _ in range(rng.randint(0, 14))) for _ in range(250)]
    got = found(spark, texts)
    assert {i: got[i][0] for i in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_findings_of_notes(spark):
    notes = spark.createDataFrame([(1, "no fever but cough\n• history of asthma"), (2, None)], "k int, note string")
    rows = sorted((r.k, r.pos, r["at"], r.finding, r.assertion_status, r.is_pheno) for r in R.note_findings(notes, ["k"]).collect())
    assert rows == [(1, 0, 0, "fever", "negated", False), (1, 0, 1, "cough", "affirmed", True), (1, 1, 0, "asthma", "historical", False)]
