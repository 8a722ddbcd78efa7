"""Frames with the awkward rows that every operator has to bear."""

from __future__ import annotations

LONG = " ".join(f"word{i % 997}" for i in range(60_000))


def documents(spark, texts, extra=True, **columns):
    """doc_id 0, 1, ... with the texts, and columns whose names clash with those that operators make."""
    rows = [(i, t, "en", "src", 1, "kept", 7) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score int")
    return frame if extra else frame.select("doc_id", "text")


def empty(spark):
    return documents(spark, ["x"]).limit(0)
