"""Main text of HTML pages by a tree-structured graphical model.

Every DOM element is a variable, content or not.  Its own evidence (tag, class
and id words, role, length and link density of its text, the share of the
page's prose below and beside it) gives a potential, and each parent-child edge
another one.  Sum-product messages pass upward from
the leaves and downward from the root, level by level and for many pages at
once; on a tree the resulting marginals are exact.  Weights are trained by
maximum likelihood on labelled pages, a bounded set made here from layouts.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

TRAINING_PAGES = 600
PAGES, BYTES = 64, 1 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "html", "body", "head", "title", "legend", "summary"}
SELF_CLOSING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}

GROUPS = ("article", "main", "p", "h1 h2 h3 h4 h5 h6", "li", "ul ol dl", "td th", "table tbody thead tr", "blockquote pre code figure figcaption dd dt", "div section", "a", "b i em strong span small u mark sub sup font q cite abbr", "nav menu", "header hgroup", "footer address", "aside", "form input label select option button textarea fieldset legend", "dialog details summary", "head title meta", "html body #root")
_GROUP = {tag: i for i, tags in enumerate(GROUPS) for tag in tags.split()}
MARKS = (
    r"article|post|entry|story|prose|body.?text|\btext\b|paragraph",
    r"content|main",
    r"nav|menu|breadcrumb|pag(er|ination)|toc\b|skip",
    r"head|masthead|logo|brand|topbar|hero",
    r"foot|copyright|legal|colophon",
    r"side|aside|widget|related|recommend|trending|popular|teaser|more-",
    r"\bads?\b|\bad[-_]|[-_]ads?\b|advert|sponsor|promo|banner|outbrain|taboola|affiliate",
    r"comment|repl(y|ies)|disqus|discussion|respond|feedback|review",
    r"cookie|consent|notice|alert|gdpr|warning|popup|modal|overlay|toast|paywall|announce",
    r"form|search|login|sign.?(in|up)|newsletter|subscri|register|contact",
    r"share|social|follow|tweet|facebook|like|rating|tags?\b|meta\b|byline|author|date|time",
    r"hidden|sr-only|visually|collapse|offscreen",
)
_MARKS = [re.compile(x) for x in MARKS]
_NAMES = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_ROLE = re.compile(r"""role\s*=\s*["']?(navigation|banner|contentinfo|complementary|search|dialog|alert|alertdialog|form|menu|toolbar)""", re.I)
_MAIN = re.compile(r"""role\s*=\s*["']?(main|article)|itemprop\s*=\s*["']?articlebody""", re.I)
_HIDDEN = re.compile(r"""display\s*:\s*none|visibility\s*:\s*hidden|(^|\s)hidden(\s|=|$)|aria-hidden\s*=\s*["']?true""", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*?)(?:>|\Z)|([^<]+|<)", re.S)
_LABEL = re.compile(r'data-y="([01])"')
N_FEATURES = 1 + len(GROUPS) + len(MARKS) + 3 + 8 + 4
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li".split())


@dataclass
class Page:
    """Elements of one page in document order, and its runs of text (element, block, text)."""

    tags: list[str] = field(default_factory=lambda: ["#root"])
    attributes: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    runs: list[tuple[int, int, str]] = field(default_factory=list)


def parse(source: str) -> Page:
    """A page's elements; unclosed and misplaced tags are repaired as browsers do in the common cases."""
    page = Page()
    stack, block, at = [0], 0, 0
    tags, parents, depths, runs = page.tags, page.parents, page.depths, page.runs
    while at < len(source):
        token = _TOKEN.match(source, at)
        at = token.end()
        text = token[4]
        if text is not None:
            runs.append((stack[-1], block, html.unescape(text) if "&" in text else text))
            continue
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            if tag in BLOCK:
                block += 1
            for depth in range(len(stack) - 1, 0, -1):
                if tags[stack[depth]] == tag:
                    del stack[depth:]
                    break
                if tags[stack[depth]] in ("table", "body", "html") and tag not in ("table", "body", "html"):
                    break
            continue
        if tag == "br":
            runs.append((stack[-1], block, " "))
            continue
        if tag in BLOCK:
            block += 1
        if tag in CLOSES_P:
            _close(stack, tags, {"p"}, {"table", "button", "td", "th"})
        elif tag in SELF_CLOSING:
            _close(stack, tags, *SELF_CLOSING[tag])
        if tag in VOID:
            continue
        node = len(tags)
        tags.append(tag)
        page.attributes.append(token[3])
        parents.append(stack[-1])
        depths.append(depths[stack[-1]] + 1)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(source, at)
            if tag == "title":
                runs.append((node, block, source[at : end.start() if end else len(source)]))
            at = end.end() if end else len(source)
            block += tag in BLOCK
        elif not token[3].endswith("/"):
            stack.append(node)
    return page


def _close(stack: list[int], tags: list[str], which: set[str], within: set[str]) -> None:
    """Closes the innermost element of ``which``, unless one of ``within`` stands between."""
    for depth in range(len(stack) - 1, 0, -1):
        if tags[stack[depth]] in which:
            del stack[depth:]
            return
        if tags[stack[depth]] in within:
            return


@dataclass
class Batch:
    """Elements of several pages: features, parents, and the elements of each depth."""

    x: np.ndarray
    parent: np.ndarray
    levels: list[np.ndarray]
    first: list[int]


def batch_of(pages: list[Page]) -> Batch:
    first, total = [], 0
    for page in pages:
        first.append(total)
        total += len(page.tags)
    parent = np.array([p + f if p >= 0 else -1 for page, f in zip(pages, first, strict=True) for p in page.parents], dtype=np.int64)
    depth = np.array([d for page in pages for d in page.depths], dtype=np.int64)
    x = np.zeros((total, N_FEATURES), dtype=np.float32)
    x[:, 0] = 1
    own, linked, stops = np.zeros(total), np.zeros(total), np.zeros(total)
    base = 1 + len(GROUPS)
    roles = base + len(MARKS)
    for page, f in zip(pages, first, strict=True):
        in_link = [False] * len(page.tags)
        for i, tag in enumerate(page.tags):
            if tag in _GROUP:
                x[f + i, 1 + _GROUP[tag]] = 1
            p = page.parents[i]
            in_link[i] = tag == "a" or p >= 0 and in_link[p]
            if attributes := page.attributes[i]:
                for k, on in _marks(attributes):
                    x[f + i, base + k if k < len(MARKS) else roles + k - len(MARKS)] = on
        for node, _, text in page.runs:
            size = len(text.strip())
            if size:
                own[f + node] += size
                linked[f + node] += size if in_link[node] else 0
                stops[f + node] += text.count(".") + text.count("!") + text.count("?")
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if total else []
    whole, links = own.copy(), linked.copy()
    for level in levels[:0:-1]:
        np.add.at(whole, parent[level], whole[level])
        np.add.at(links, parent[level], links[level])
    density = links / np.maximum(whole, 1)
    at = roles + 3
    x[:, at] = np.log1p(own) / 5
    x[:, at + 1] = np.log1p(whole) / 8
    x[:, at + 2] = density
    x[:, at + 3] = whole == 0
    x[:, at + 4] = (own > 0) & (own < 25)
    x[:, at + 5] = own >= 80
    x[:, at + 6] = np.minimum(stops, 3) / 3
    x[:, at + 7] = (density > 0.5) & (whole > 0)
    # the share of the page's plain text that stands in prose right below an element, and right beside it
    plain = np.maximum(own - linked, 0) * np.array([tag in PROSE for page in pages for tag in page.tags], dtype=float)
    below = np.zeros(total)
    child = np.flatnonzero(parent >= 0)
    np.add.at(below, parent[child], plain[child])
    page_of = np.repeat(np.arange(len(pages)), [len(page.tags) for page in pages])
    below /= np.maximum(np.bincount(page_of, np.maximum(own - linked, 0), len(pages)), 1)[page_of]
    beside = np.where(parent >= 0, below[parent], 0)
    x[:, at + 8], x[:, at + 9], x[:, at + 10], x[:, at + 11] = below, below > 0.4, beside, beside > 0.4
    return Batch(x, parent, levels, first)


def _marks(attributes: str) -> tuple[tuple[int, float], ...]:
    """Features of a tag from its whole attribute string; long strings are read each time, so the memory of results stays small."""
    return _short_marks(attributes) if len(attributes) <= 2000 else _short_marks.__wrapped__(attributes)


@functools.lru_cache(20_000)
def _short_marks(attributes: str) -> tuple[tuple[int, float], ...]:
    names = " ".join(x.strip("\"'") for x in _NAMES.findall(attributes)).lower()
    found = [(k, 1.0) for k, mark in enumerate(_MARKS) if mark.search(names)] if names else []
    found += [(len(MARKS) + k, 1.0) for k, mark in enumerate((_ROLE, _MAIN, _HIDDEN)) if mark.search(attributes)]
    return tuple(found)


def sum_product(batch: Batch, weights: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Content marginals of the elements and the expected counts of (parent, child) states, by messages up and down."""
    up = np.zeros((len(batch.parent), 2))
    up[:, 1] = batch.x @ weights
    message = np.zeros_like(up)
    for level in batch.levels[:0:-1]:
        message[level] = np.logaddexp(up[level, :1] + edge[:, 0], up[level, 1:] + edge[:, 1])
        np.add.at(up, batch.parent[level], message[level])
    belief = up.copy()
    pairs = np.zeros((2, 2))
    for level in batch.levels[1:]:
        rest = belief[batch.parent[level]] - message[level]
        joint = rest[:, :, None] + edge[None] + up[level][:, None, :]
        belief[level] = np.logaddexp(joint[:, 0], joint[:, 1])
        joint = np.exp(joint - np.logaddexp.reduce(belief[level], axis=1)[:, None, None])
        pairs += joint.sum(axis=0)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50))), pairs


@dataclass(frozen=True)
class TextModel:
    weights: np.ndarray
    edge: np.ndarray

    def extract(self, sources: list[str]) -> list[str]:
        """Main texts of whole pages."""
        pages = [parse(x) for x in sources]
        batch = batch_of(pages)
        content = sum_product(batch, self.weights, self.edge)[0] > 0.5
        out = []
        for page, first in zip(pages, batch.first, strict=True):
            lines, last, parts = [], -1, []
            for node, block, text in page.runs:
                if content[first + node]:
                    if block != last:
                        lines.append(parts)
                        parts, last = [], block
                    parts.append(text)
            lines.append(parts)
            out.append("\n".join(line for x in lines if (line := " ".join("".join(x).split()))))
        return out


def train_text_model(pages: list[str], steps: int = 300, ridge: float = 0.001) -> TextModel:
    """A model from pages whose elements carry data-y="1" (content) or "0"; the mark holds for what lies within."""
    parsed = [parse(x) for x in pages]
    batch = batch_of(parsed)
    labels = []
    for page in parsed:
        y: list[int] = []
        for p, attributes in zip(page.parents, page.attributes, strict=True):
            mark = _LABEL.search(attributes)
            y.append(int(mark[1]) if mark else y[p] if p >= 0 else 0)
        labels += y
    y = np.array(labels)
    child = np.flatnonzero(batch.parent >= 0)
    counts = np.zeros((2, 2))
    np.add.at(counts, (y[batch.parent[child]], y[child]), 1)
    target = batch.x.T @ y
    theta = np.zeros(N_FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, steps + 1):
        p, pairs = sum_product(batch, theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))
        slope = np.concatenate((target - batch.x.T @ p, (counts - pairs).reshape(-1))) - ridge * len(pages) * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return TextModel(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 29) -> list[str]:
    """Pages of varied layouts, their content and the boilerplate within it marked by data-y."""
    rng = random.Random(seed)
    pick, maybe = rng.choice, lambda p: rng.random() < p
    parts = "an ber cht den er form gal hin ion ker lan men nor ou pra que ril sto tan ung vel wor zen".split()
    word = lambda: "".join(pick(parts) for _ in range(rng.randint(1, 3)))

    def say(k: int) -> str:
        words = [word() + pick(["", "", "", "", ","]) for _ in range(max(1, k))]
        return " ".join(words).capitalize().rstrip(",") + "."

    def prose(k: int) -> str:
        return " ".join(say(rng.randint(3, 16)) for _ in range(k))

    def links(k: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{word()}">{word()}{pick(["", " " + word()])}</a></{tag}>' for _ in range(k))

    def name(*options: str) -> str:
        value = pick(options)
        return f' {pick(["class", "class", "id"])}="{pick(["", "", word() + " "])}{value}{pick(["", "", "-" + word()])}"'

    def inline() -> str:
        text = prose(rng.randint(1, 6))
        if maybe(0.3):
            text += f" <{(t := pick(['b', 'em', 'span', 'strong', 'i']))}>{say(3)}</{t}> " + say(4)
        if maybe(0.2):
            text += f' <a href="/{word()}">{word()} {word()}</a> {say(5)}'
        return text

    def ad() -> str:
        return f'<{(t := pick(["div", "div", "aside", "section"]))} data-y="0"{name("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner-ad")}>{pick(["", "<p>"])}{prose(rng.randint(1, 3))}</{t}>'

    def nav() -> str:
        body = f"<ul>{links(rng.randint(3, 9))}</ul>" if maybe(0.7) else links(rng.randint(3, 9), "span")
        return f"<nav{name('nav', 'menu')}>{body}</nav>" if maybe(0.4) else f"<nav>{body}</nav>" if maybe(0.5) else f"<div{name('menu', 'navbar', 'main-nav', 'breadcrumbs', 'pagination')}>{body}</div>"

    def notice() -> str:
        return f'<div data-y="0"{name("cookie-notice", "notice", "alert", "consent", "gdpr-bar", "paywall", "announcement")}><p>{prose(rng.randint(1, 3))}</p>{pick(["", "<button>Ok</button>"])}</div>'

    def form() -> str:
        return f'<form data-y="0"{pick(["", name("search", "newsletter", "login", "subscribe")])}><label>{say(2)}</label><input type="text"><button>{word()}</button>{pick(["", "<p>" + prose(1) + "</p>"])}</form>'

    def comments() -> str:
        one = lambda: f"<{(t := pick(['div', 'li', 'article', 'p']))}{name('comment', 'reply', 'comment-body')}>{pick(['', '<b>' + word() + '</b> '])}{pick(['', '<p>'])}{prose(rng.randint(1, 5))}</{t}>"
        return f'<{(t := pick(["div", "section", "ol"]))} data-y="0"{name("comments", "comment-list", "discussion", "responses", "reader-comments")}>{pick(["", "<h2>Comments</h2>", "<h3>" + say(2) + "</h3>"])}{"".join(one() for _ in range(rng.randint(1, 5)))}</{t}>'

    def remark() -> str:
        return f'<{(t := pick(["div", "div", "p", "section", "li"]))} data-y="0"{name("comment", "reply", "reader-comment", "feedback", "review")}>{pick(["", "<p>", "<b>" + word() + "</b> "])}{prose(rng.randint(1, 4))}</{t}>'

    def side() -> str:
        body = "".join(pick([lambda: f"<h3>{say(2)}</h3><ul>{links(rng.randint(2, 6))}</ul>", lambda: f"<p>{prose(rng.randint(1, 4))}</p>", ad])() for _ in range(rng.randint(1, 3)))
        return f'<aside data-y="0"{pick(["", name("sidebar", "related")])}>{body}</aside>' if maybe(0.5) else f'<div data-y="0"{name("sidebar", "widget", "related-posts", "side-column", "trending", "recommended")}>{body}</div>'

    def share() -> str:
        return f'<div data-y="0"{name("share", "social", "follow-us", "share-buttons")}>{links(rng.randint(2, 4), "span")}</div>'

    def inside() -> str:
        kinds = [
            lambda: f"<p>{inline()}</p>",
            lambda: f"<p>{say(rng.randint(1, 3))}</p>",
            lambda: f"<p><b>{inline()}<br>",
            lambda: f"<p>{inline()}",
            lambda: f"<{(t := pick(['h2', 'h3']))}>{say(3)}</{t}>",
            lambda: f"<{(t := pick(['ul', 'ol']))}>{''.join(f'<li>{say(rng.randint(2, 9))}</li>' for _ in range(rng.randint(2, 5)))}</{t}>",
            lambda: f"<blockquote>{pick(['', '<p>'])}{prose(2)}</blockquote>",
            lambda: f"<table><tr><th>{word()}</th><th>{word()}</th></tr><tr><td>{say(2)}</td><td>{word()}</td></tr></table>",
            lambda: f'<figure><img src="/{word()}.png"><figcaption>{say(5)}</figcaption></figure>',
            lambda: f"<pre>{say(4)}</pre>",
            lambda: f"<div>{inline()}</div>",
            lambda: f"<section><h2>{say(2)}</h2><p>{inline()}</p></section>",
            lambda: f"<header><h1>{say(5)}</h1></header>" if maybe(0.3) else f"<h1>{say(6)}</h1>",
        ]
        weights = [10, 4, 2, 2, 3, 2, 1, 1, 1, 0.5, 2, 1, 0.5]
        return rng.choices(kinds, weights)[0]()

    def content() -> str:
        body = [f"<h1>{say(rng.randint(3, 9))}</h1>"] if maybe(0.8) else []
        for _ in range(rng.randint(1, 3) if maybe(0.35) else rng.randint(1, 9)):
            body.append(inside())
            if maybe(0.07):
                body.append(pick([ad, share, form, side, notice, remark])())
        if maybe(0.2):
            body.append(pick([comments, side, share, remark])())
        text = "".join(body)
        shape = rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9])
        if shape < 3:
            return f'<article data-y="1"{pick(["", "", name("post", "entry", "hentry")])}>{text}</article>'
        if shape == 3:
            return f'<main data-y="1">{text}</main>'
        if shape == 4:
            return f'<main data-y="1"><div{name("content", "article", "post", "text")}>{text}</div></main>'
        if shape == 5:
            return f'<div data-y="1" itemprop="articleBody">{text}</div>'
        if shape == 6:
            return f'<div data-y="1"{name("content", "main-content", "article-body", "post-content", "entry-content", "story-text", "body-text", "prose")}>{text}</div>'
        if shape == 7:
            return f'<div data-y="1">{text}</div>'
        if shape == 8:
            return f'<div><div data-y="1">{text}</div></div>' if maybe(0.5) else f'<table><tr><td data-y="1">{text}</td></tr></table>'
        return f'<div{name("wrap", "layout", "col")}><section data-y="1"{name("article", "story", "content", "post")}>{text}</section></div>'

    def page() -> str:
        top = [nav() if maybe(0.7) else "", f"<header{pick(['', name('header', 'masthead', 'site-head')])}><h1>{word()}</h1>{pick(['', nav(), '<p>' + say(4) + '</p>'])}</header>" if maybe(0.5) else ""]
        if maybe(0.15):
            top = [f"<div{name('header', 'topbar', 'site-header', 'masthead')}><span>{word()}</span><p>{say(4)}</p></div>", *top]
        rng.shuffle(top)
        extra = [ad() if maybe(0.5) else "", notice() if maybe(0.25) else "", form() if maybe(0.2) else ""]
        late = [comments() if maybe(0.3) else "", side() if maybe(0.4) else "", share() if maybe(0.15) else ""]
        rng.shuffle(late)
        middle = "".join(top) + f"<!-- {word()} -->" + "".join(extra) + (side() if maybe(0.1) else "") + content() + "".join(late)
        if maybe(0.4):
            middle = f"<div{name('page', 'wrapper', 'container', 'site', 'root')}>{middle}</div>"
        small = f"&copy; {word()}.example &middot; {prose(rng.randint(1, 3))}"
        foot = pick([f"<footer>{small}</footer>", f"<footer><p>{small}</p><ul>{links(3)}</ul></footer>", f"<div{name('footer', 'copyright', 'site-footer')}>{small}</div>", f"<footer{name('footer')}>{small}"])
        head = f"<head><meta charset=\"utf-8\"><title>{say(4)}</title><style>p{{margin:0}}</style></head>"
        return f"<!DOCTYPE html><html>{head}<body>{middle}{foot}<script>x()</script>{pick(['</body></html>', ''])}"

    return [page() for _ in range(n)]


def main_text(pages: DataFrame, model: TextModel) -> DataFrame:
    """All columns of ``pages`` but ``text`` and ``n_chars``, which are added (replaced, if there).

    Reads whole pages.  A null or empty html has an empty text, as has a page
    without content; n_chars counts code points.  Rows that repeat are read
    each; null ids and urls are kept; an empty table gives no rows.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    rest = [c for c in kept if c != "html"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*rest).schema) + ", text string, n_chars long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column("html").fill_null("")
            at = 0
            while at < batch.num_rows:
                end, size, some = at, 0, []
                while end < batch.num_rows and len(some) < PAGES and (not some or size < BYTES):
                    some.append(sources[end].as_py())
                    size += len(some[-1])
                    end += 1
                texts = model.extract(some)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at, end - at) for c in rest), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*rest, "text", "n_chars"]
                )
                at = end

    return map_arrow(pages.select(*kept), run, schema)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("string").alias("html"))
    return main_text(pages, train_text_model(labelled_pages()))
