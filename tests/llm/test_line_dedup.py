import pytest

from cohortspark.llm import line_dedup as L

from .helpers import LONG, documents, empty

LOWER = str.maketrans(L.UPPER, L.LOWER)
TEXTS = [
    "A line that repeats\nanother one, alone\n  a LINE that repeats\t",
    "a line that repeats\n\nshort\nÉtendue, ÉCOLE",
    "short\nÉtendue, école\n\t étendue, ÉCOLE\nÉTENDUE, École \x0b\x0c\r",
    "",
    None,
    "\n\n",
    "A line that repeats",
    "only here, twice over\nonly here, twice over",
    LONG + "\n" + LONG,
    "x\n" + LONG.upper(),
    "nine chars\nnine char",
    "nine char\nnine chars ",
    "     a     \n                   b",
]


def brute(rows, points=10, documents=2):
    key = lambda line: line.strip(L.WHITE).translate(LOWER)
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        every = (text or "").split("\n")
        gone = lambda k: len(k) >= points and len(holders[k]) >= documents and doc != min((d for d in holders[k] if d is not None), default=None)
        kept = [line for line in every if not gone(key(line))]
        out.append((doc, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df, **options):
    return sorted((tuple(r) for r in L.deduplicated_lines(df, **options).select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=repr)


@pytest.mark.parametrize("hot", [L.HOT_KEYS, 1])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(L, "HOT_KEYS", hot)
    assert got(documents(spark, TEXTS)) == brute(list(enumerate(TEXTS)))


def test_other_thresholds(spark):
    assert got(documents(spark, TEXTS), min_points=1, min_documents=3) == brute(list(enumerate(TEXTS)), 1, 3)
    with pytest.raises(ValueError):
        L.deduplicated_lines(documents(spark, TEXTS), min_documents=1)


def test_shared_and_missing_ids(spark):
    rows = [(5, "shared line of text\nmine"), (5, "shared line of text"), (None, "shared line of text\nrest"), (None, "without an id, twice"), (None, "without an id, twice"), (9, "shared line of text"), (9, "shared line of text")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(frame) == brute(rows)


def test_one_line_in_every_document(spark):
    rows = [(i, f"a line that all documents hold\nnumber {i}") for i in range(400)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == brute(rows)


def test_empty_table(spark):
    assert got(empty(spark)) == []


def test_no_python_on_the_path(spark):
    plan = L.deduplicated_lines(documents(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
