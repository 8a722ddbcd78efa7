import random

import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortspark.llm import sentencepieces, token_counts

from .helpers import LONG, documents, empty

PARTS = ["a", "b", "the", " ", "  ", "\n", "é", "ß", "日", "́", "xxxxx", "1", "22", "...", "Th", "ing", "▁", "😀", "===", "\t", "<|startoftext|>", "<|endoftext|>", "<|", "'s", "'re", "İ", "\x85", "\xa0", "\x1c", "Σ", "½", "²", "’", "K", "\x00"]
mixed = st.lists(st.sampled_from(PARTS), max_size=40).map("".join) | st.text(max_size=60)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PieceCounter(public.path(token_counts.TOKENIZER))


@pytest.fixture(scope="module")
def pieces():
    return sentencepieces.Pieces(public.path(sentencepieces.MODEL))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public.path(sentencepieces.MODEL))


@settings(max_examples=400, deadline=None)
@given(text=mixed)
def test_counts_equal_the_library(counter, text):
    assert counter.count(text) == len(counter.tokenizer.encode(text, add_special_tokens=False))


def test_counts_of_long_texts(counter, monkeypatch):
    text = "x" * 500 + " " + LONG[:5000] + "\n<|endoftext|>" + "é" * 300
    whole = len(counter.tokenizer.encode(text, add_special_tokens=False))
    monkeypatch.setattr(token_counts, "SEGMENT", 64)
    monkeypatch.setattr(token_counts, "MEMO", 50)
    assert counter.count(text) == whole


@settings(max_examples=400, deadline=None)
@given(text=mixed)
def test_ids_equal_the_library(pieces, library, text):
    assert pieces.encode(text) == library.encode(text)


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80))
def test_decoding_gives_the_text_back(pieces, text):
    assert pieces.decode(pieces.encode(text)) == text.replace("▁", " ")


def test_the_window_stays_bounded(pieces, library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "FLUSH", 16)
    rng = random.Random(0)
    text = "".join(rng.choice("aeinsthr") for _ in range(4000))
    assert pieces.encode(text) == library.encode(text)
    stream = pieces.segments("▁" + text)
    assert next(stream)  # committed long before the end


def test_commits_come_along_with_ordinary_text(pieces, library):
    text = "Streaming search commits ids early, word by word, wherever all paths meet. " * 40
    runs = list(pieces.commits("▁" + text.strip().replace(" ", "▁")))
    assert [i for run in runs for i in run] == library.encode(text.strip())
    assert len(runs) > len(text.split()) and max(map(len, runs)) < 8


def test_two_pieces_stand_side_by_side_as_merging_them_says(pieces):
    rng = random.Random(5)
    merged = lambda text: [pieces._text(i) for run in pieces.commits(text) for i in run]
    for word in ("theirs", "▁unbelievable", "▁wwwxyz", "aaaaaaaa", "▁Donaudampf", "ingingthethe"):
        found = merged(word)
        assert "".join(found) == word
        for a, b in zip(found, found[1:]):
            assert pieces._stand(pieces.ids[a], pieces.ids[b])
    some = [i for p, i in pieces.ids.items() if p.isalpha() and len(p) < 6]
    for _ in range(2000):
        a, b = rng.choice(some), rng.choice(some)
        symbols, whole = list(pieces.pieces[a] + pieces.pieces[b]), [pieces.pieces[a], pieces.pieces[b]]
        while pairs := [(-pieces.score[x + y], i) for i, (x, y) in enumerate(zip(symbols, symbols[1:])) if x + y in pieces.score]:
            at = min(pairs)[1]
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        assert pieces._stand(a, b) == (symbols == whole)


def test_operators(spark, counter, pieces):
    texts = ["Hello  world\n", "", None, LONG, "Hello  world\n", " lead", "�"]
    docs = documents(spark, texts)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, public.path(token_counts.TOKENIZER)).collect()}
    assert got == {i: (len((t or "").encode()), n := counter.count(t or ""), n > 2048) for i, t in enumerate(texts)}
    model = public.path(sentencepieces.MODEL)
    ids = sentencepieces.encoded(docs, model)
    rows = {r.doc_id: r for r in ids.collect()}
    assert all(rows[i].ids == pieces.encode(t or "") and rows[i].n_tokens == len(rows[i].ids) for i, t in enumerate(texts))
    back = {r.doc_id: r.text for r in sentencepieces.decoded(ids, model).collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]
    assert all(r.round_trip for r in sentencepieces.round_trips(docs, model).collect())
    for f, arg in ((token_counts.token_counts, public.path(token_counts.TOKENIZER)), (sentencepieces.encoded, model), (sentencepieces.round_trips, model)):
        assert f(empty(spark), arg).collect() == []


def test_rows_that_repeat_and_null_ids(spark, counter):
    texts = [(None, "one two"), (None, "one two"), (1, "one two"), (1, "x" * 3000), (None, None)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(frame, public.path(token_counts.TOKENIZER)).collect())
    assert got == sorted((i or 0, len((t or "").encode()), counter.count(t or "")) for i, t in texts)
    model = public.path(sentencepieces.MODEL)
    ids = spark.createDataFrame([(None, None), (None, []), (2, [450])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id or 0, r.text) for r in sentencepieces.decoded(ids, model).collect()) == [(0, ""), (0, ""), (2, sentencepieces.Pieces(model).decode([450]))]


def test_rare_and_frequent_pre_tokens_add_up(spark, counter, monkeypatch):
    monkeypatch.setattr(token_counts, "FREQUENT", 3)  # all but the most frequent are joined by shuffle
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "a", f"w{rng.randint(0, 400)}", "É", "日本"]) for _ in range(rng.randint(0, 50))) for _ in range(200)]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents(spark, texts), public.path(token_counts.TOKENIZER)).collect()}
    assert got == {i: counter.count(t) for i, t in enumerate(texts)}


def test_broadcast_is_bounded_by_bytes(spark):
    rows = [("a" * 10, 64), ("b" * 10, 64), ("c" * 10, 8), ("d" * 1000, 32), ("e" * 10, 1)]
    counts = spark.createDataFrame(rows, "token string, documents long")
    assert token_counts._share(counts) == 1
    assert token_counts._share(counts, most_bytes=200) == 64  # the long one would be too much
    assert token_counts._share(counts, most_bytes=30) == 128  # not even the two most frequent fit
    assert token_counts._share(counts, most_bytes=1100) == 2
    assert token_counts._share(counts, most=3) == 57
    assert token_counts._share(counts.limit(0)) == 1


@pytest.mark.parametrize("size", [10, 100])
def test_counts_with_long_pre_tokens_and_little_to_broadcast(spark, monkeypatch, counter, size):
    monkeypatch.setattr(token_counts._share, "__defaults__", (token_counts.FREQUENT, size))
    texts = ["x" * 30_000 + " the end", "the " * 40, "x" * 30_000, None, "the end é"]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents(spark, texts), public.path(token_counts.TOKENIZER)).collect()}
    assert got == {i: counter.count(t or "") for i, t in enumerate(texts)}
