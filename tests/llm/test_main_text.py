import pytest
from pyspark.sql import functions as F

from cohortspark.llm import main_text as M


@pytest.fixture(scope="module")
def model():
    return M.train_text_model(M.labelled_pages())


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- x --><div class="ad">Buy now, it is cheap.</div>'
    "<article><h1>A title of some words</h1><p>First   paragraph with\n a &amp; b &copy; and some more text in it.</p><p><b>Second one, unclosed, that goes on for a while.<br><p>Third paragraph ends here. It has two sentences.</article>"
    '<div class="comments"><p>I liked it very much.</p></div><footer>&copy; site</footer></body></html>'
)


def test_article(model):
    assert model.extract([PAGE])[0].split("\n") == ["A title of some words", "First paragraph with a & b © and some more text in it.", "Second one, unclosed, that goes on for a while.", "Third paragraph ends here. It has two sentences."]


def test_held_out_layouts(model):
    pages = [M.parse(x) for x in M.labelled_pages(200, seed=991)]
    batch = M.batch_of(pages)
    content = M.sum_product(batch, model.weights, model.edge)[0] > 0.5
    wrong = total = 0
    for page, first in zip(pages, batch.first, strict=True):
        y = []
        for parent, attributes in zip(page.parents, page.attributes, strict=True):
            mark = M._LABEL.search(attributes)
            y.append(int(mark[1]) if mark else y[parent] if parent >= 0 else 0)
        for node, _, text in page.runs:
            total += len(text.strip())
            wrong += len(text.strip()) * (bool(content[first + node]) != bool(y[node]))
    assert wrong / total < 0.03


def test_messages_equal_enumeration(model):
    """Marginals on a small tree from all assignments."""
    import itertools

    import numpy as np

    page = M.parse("<div><p>one two</p><nav><a>x</a></nav></div>")
    batch = M.batch_of([page])
    n = len(page.tags)
    evidence = batch.x @ model.weights
    weight = np.zeros((n, 2))
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(evidence[i] * y[i] for i in range(n)) + sum(model.edge[y[p], y[i]] for i, p in enumerate(page.parents) if p >= 0))
        for i in range(n):
            weight[i, y[i]] += w
    assert np.allclose(M.sum_product(batch, model.weights, model.edge)[0], weight[:, 1] / weight.sum(axis=1))


def test_awkward_pages(spark, model):
    pages = [None, "", "plain words only", "<", "<div><div><div", "<p>" * 3000 + "x", "</p></div>", "<script>var a = '<p>x</p>'", "<p a='>'>t</p>", PAGE + " " * 200_000]
    rows = [(i, None if i == 1 else f"u{i}", p, "clash") for i, p in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in M.main_text(frame, model).collect()}
    assert len(got) == len(pages) and got[0].text == "" and got[1].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    assert "var a" not in got[7].text and got[9].text.startswith("A title") and got[1].url is None
    assert M.main_text(frame.limit(0), model).collect() == []
    twice = M.main_text(frame.where("page_id = 9").unionByName(frame.where("page_id = 9")), model).select(F.sha2("text", 256).alias("h")).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_long_attributes_are_read_whole(model):
    for long in (f'style="background:url(data:image/png;base64,{"A" * 5000})"', "data-props='" + '{"a": [1, 2]}' * 500 + "'"):
        for names in ('class="ad"', 'id="comments"', 'role="navigation"', 'itemprop="articleBody"', 'aria-hidden="true"'):
            assert M._marks(f" {long} {names}") == M._marks(f" {names} {long}") == M._marks(f" {names}") != ()
        page = PAGE.replace('<div class="ad">', f'<div {long} class="ad">').replace('<div class="comments">', f'<div {long} class="comments">')
        assert page != PAGE and model.extract([page]) == model.extract([PAGE])


def say(n):
    return " ".join(f"This is sentence {k} of a paragraph that goes on, with words." for k in range(n))


@pytest.mark.parametrize("inner", ['<div class="comment">I liked it very much, thanks.</div>', '<section id="comments"><p>Nice. I will read it again.</p></section>'])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_a_short_article_keeps_its_text_without_the_comment_in_it(model, n, inner):
    body = "".join(f"<p>{say(2)}</p>" for _ in range(n))
    page = f'<html><body><nav><a href="/">Home</a></nav><article><h1>A title of some words</h1>{body}{inner}</article><footer>c</footer></body></html>'
    assert model.extract([page]) == ["\n".join(["A title of some words"] + [say(2)] * n)]


@pytest.mark.parametrize("shape", ["<div>{}</div>", "<div><div>{}</div></div>", "<center>{}</center>", "<table><tr><td>{}</td></tr></table>", "<section>{}</section>"])
def test_containers_without_a_name(model, shape):
    """Layouts that say nothing but by where their prose stands."""
    body = "".join(f"<p>{say(3)}</p>" for _ in range(3))
    page = f'<html><body><ul class="menu"><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul>{shape.format(body)}<footer>&copy; site</footer></body></html>'
    assert model.extract([page])[0].removeprefix("A title of some words\n") == "\n".join([say(3)] * 3)
