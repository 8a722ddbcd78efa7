import datetime as dt
import random
import re

from pyspark.sql import functions as F

from cohortspark.functions import dates as D

NAMES = "January February March April May June July August September October November December".split()
FORMS = (
    "{d}/{m}/{y}", "{d:02}/{m:02}/{y} 10:30", "{y}-{m:02}-{d:02}", "{y}-{m}-{d} 10:30:00", "{d} {mon} {y}", "{d}-{mon}-{y}", "{mon} {d}, {y}", "{month} {d} {y}", "{d:02}.{m:02}.{y}", "{d}-{m}-{y}", "{d} {m} {y}",
    "{y}{m:02}{d:02}", "{wd}, {d} {month} {y}", "{d}{th} {month} {y}", "{d}{th} of {mon}, {y}", "{d} {mon} {yy:02}", "{d:02}.{m:02}.{yy:02}", "{y}/{m:02}/{d:02}", "{y} {mon} {d}", "{month} {d}{th}, {y} at 9:05 pm", "{d} {mon}. {y} 23:59", "{m}/{d}/{y}", "{D} {MON} {y}",
)


def forms(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        day = dt.date(1990, 1, 1) + dt.timedelta(days=rng.randrange(15_000))
        th = {1: "st", 2: "nd", 3: "rd"}.get(day.day % 10 if day.day not in (11, 12, 13) else 0, "th")
        month = NAMES[day.month - 1]
        yield rng.choice(FORMS).format(d=day.day, D=day.day, m=day.month, y=day.year, yy=day.year % 100, mon=month[:3], MON=month[:3].upper(), month=month, wd=day.strftime("%A"), th=th)


def test_dates_equal_the_public_parser(spark):
    from dateutil import parser

    texts = sorted(set(forms(1, 1500)))
    got = {r.t: r.d for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.clinical_date(F.col("t")).alias("d")).collect()}
    for t in texts:
        want = parser.parse(t, dayfirst=not re.match(r"\d{4}-", t)).date()
        assert got[t] == want, t


def test_what_is_no_date(spark):
    texts = ["", " ", None, "none", "Unknown", "31/02/2020", "32 Jan 2020", "yesterday", "Oct", "2025", "8 Oct", "about 8 Oct 2025 or so", "99.99.2020", "2025-13-45", "20251345", "8 Octopus 2025"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.clinical_date(F.col("t")).alias("d")).collect()
    assert [r.t for r in rows if r.d is not None] == []


def test_years_of_two_digits(spark):
    frame = spark.createDataFrame([("8 Oct 74",), ("8 Oct 75",), ("8 Oct 76",), ("8 Oct 00",)], "t string")
    got = [r.d.year for r in frame.select(D.free_date(F.col("t"), F.lit("2025-06-01").cast("date")).alias("d")).collect()]
    assert got == [2074, 1975, 1976, 2000]
