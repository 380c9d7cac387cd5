"""Main text of web pages, by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each
with its open ancestors.  Features are the block's tag, its ancestors' tags, telling
parts of their class, id and role attributes, and shape of the text (length, share
inside links, closing punctuation, place in the page).  Two labels, content and
boilerplate, form a chain.  Weights are trained by conditional likelihood on
labelled pages and pages are decoded by Viterbi.

The labelled pages are written by ``labelled_pages`` from a seed: layouts that
place an article among menus, headers, notices, adverts, sidebars, forms,
comments and footers, with each block's label known.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import small_batches

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select option head".split())
#: Elements that end an open one of the same kind when they begin.
SELF_CLOSING = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())
#: Parts of class, id and role attributes that tell what an element holds.
TELLING = (
    "article content story post entry main text body "
    "nav menu breadcrumb header masthead foot sidebar aside widget related share social "
    "ad ads advert sponsor promo banner cookie consent notice alert popup modal newsletter subscribe "
    "form login search comment reply respond discuss copyright legal tag meta pagination toolbar"
).split()

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z]+")


class Block:
    """A leaf block: its text, open elements as (tag, telling parts), and characters inside links."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple, linked: int):
        self.text, self.path, self.linked = text, path, linked


@lru_cache(maxsize=4096)
def _telling(attributes: str) -> tuple[str, ...]:
    words: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        words.update(_PARTS.findall((m[1] or m[2] or m[3] or "").lower()))
    return tuple(t for t in TELLING if t in words or len(t) > 3 and any(w.startswith(t) or w.endswith(t) for w in words))


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order; what scripts, styles, titles and the like hold is left out."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = 0
    pos, size = 0, len(page)

    def close() -> None:
        nonlocal parts, linked
        if parts:
            raw = "".join(parts)
            text = _SPACE.sub(" ", html.unescape(raw) if "&" in raw else raw).strip()
            if text:
                out.append(Block(text, tuple(x for x in stack if x[0] not in INLINE), linked))
            parts, linked = [], 0

    while pos < size:
        m = _MARKUP.search(page, pos)
        start = m.start() if m else size
        if start > pos:
            piece = page[pos:start]
            parts.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        pos = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag not in INLINE:
                close()
            if any(x[0] == tag for x in stack):
                while stack:
                    if stack.pop()[0] == tag:
                        break
            continue
        if tag in RAW:
            if tag not in INLINE:
                close()
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\s*>" if tag != "head" else r"</head\s*>|(?=<body[\s>])", re.I).search(page, pos)
                pos = end.end() if end else size
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag == "a":
            links += 1
        if tag not in INLINE:
            close()
            links = 0 if tag in ("p", "div", "section", "article", "footer", "header") else links
            if tag in SELF_CLOSING:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE:
                        break
        if tag not in VOID and not m[3].endswith("/"):
            stack.append((tag, _telling(m[3]) if m[3] else ()))
    close()
    return out


def path_features(path: tuple) -> list[str]:
    """Features of a block's open elements."""
    names = {f"in={tag}" for tag, _ in path} | {f"has={p}" for _, parts in path for p in parts}
    return ["bias", f"tag={path[-1][0] if path else 'none'}", *sorted(names)]


def text_features(b: Block, i: int, n: int) -> list[str]:
    """Features of the text of block ``i`` of ``n``."""
    size = len(b.text)
    names = [
        "size=" + ("s" if size < 30 else "m" if size < 100 else "l"),
        "links=" + ("none" if not b.linked else "some" if b.linked < 0.5 * size else "most"),
        "stop" if b.text[-1] in ".!?…\"'”»" else "open",
        "place=" + ("first" if i * 10 < n else "last" if i * 10 >= 9 * n else "middle"),
    ]
    if "©" in b.text or "copyright" in b.text[:80].lower():
        names.append("copyright")
    return names


def features(found: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    return [path_features(b.path) + text_features(b, i, len(found)) for i, b in enumerate(found)]


class Model:
    """Weights of a two-label chain: label 1 is content."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move
        self.paths: dict[tuple, tuple[float, float]] = {}  # scores of open elements, which pages share
        self.texts = {k: tuple(emit[i].tolist()) for k, i in names.items()}

    def scores(self, b: Block, i: int, n: int) -> tuple[float, float]:
        got = self.paths.get(b.path)
        if got is None:
            if len(self.paths) > 100_000:
                self.paths.clear()
            known = [self.texts[f] for f in path_features(b.path) if f in self.texts]
            got = self.paths[b.path] = (sum(k[0] for k in known), sum(k[1] for k in known))
        x, y = got
        for f in text_features(b, i, n):
            if f in self.texts:
                x += self.texts[f][0]
                y += self.texts[f][1]
        return x, y

    def decode(self, found: list[Block]) -> np.ndarray:
        """The likeliest labels (Viterbi); boilerplate on ties."""
        if not found:
            return np.zeros(0, np.int64)
        scores = [self.scores(b, i, len(found)) for i, b in enumerate(found)]
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            p, q = a + m00 >= b + m10, a + m01 >= b + m11
            back.append((0 if p else 1, 0 if q else 1))
            a, b = (a + m00 if p else b + m10) + x, (a + m01 if q else b + m11) + y
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return np.array(out[::-1])


def train(pages: list[tuple[str, list[int]]], rounds: int = 120, rate: float = 0.3, decay: float = 1e-3) -> Model:
    """Maximise the conditional likelihood of the labels by gradient ascent (AdaGrad), all pages at once."""
    parsed = [(features(blocks(p)), y) for p, y in pages]
    names: dict[str, int] = {}
    for f, _ in parsed:
        for block in f:
            for x in block:
                names.setdefault(x, len(names))
    n, longest = len(parsed), max(len(f) for f, _ in parsed)
    x = np.zeros((n, longest, len(names)), np.float32)
    y, real = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (f, labels) in enumerate(parsed):
        if len(f) != len(labels):
            raise ValueError("a labelled page's blocks and labels differ in number")
        real[i, : len(f)] = True
        y[i, : len(f)] = labels
        for t, block in enumerate(f):
            x[i, t, [names[k] for k in block]] = 1
    emit, move = np.zeros((len(names), 2)), np.zeros((2, 2))
    ge, gm = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
    gold = np.eye(2)[y] * real[:, :, None]
    pairs = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    for _ in range(rounds):
        s = x @ emit
        fwd, bwd = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fwd[:, 0] = s[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(fwd[:, t - 1, :, None] + move, axis=1) + s[:, t]
            fwd[:, t] = np.where(real[:, t, None], step, fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(move + (s[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
            bwd[:, t] = np.where(real[:, t + 1, None], step, 0)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        node = np.exp(fwd + bwd - z[:, None, None]) * real[:, :, None]
        edge = np.exp(fwd[:, :-1, :, None] + move + (s[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        de = np.einsum("ntf,ntl->fl", x, gold - node) - decay * emit * n
        dm = pairs - edge.sum(axis=(0, 1)) - decay * move * n
        ge += de**2
        gm += dm**2
        emit += rate * de / np.sqrt(ge)
        move += rate * dm / np.sqrt(gm)
    return Model(names, emit, move)


def labelled_pages(count: int = 320, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Pages in many layouts with a label (1: article) for each of their leaf blocks, in order."""
    r = random.Random(seed)
    letters = "etaoinsrhldcumfpgwyb"

    def word() -> str:
        return "".join(r.choice(letters) for _ in range(r.randint(2, 9)))

    def words(a: int, b: int, stop: bool = False) -> str:
        return " ".join(word() for _ in range(r.randint(a, b))).capitalize() + ("." if stop else "")

    def sentences(a: int, b: int) -> str:
        return " ".join(words(3, 14, True) for _ in range(r.randint(a, b)))

    def links(cls: str, n: int) -> tuple[str, list[int]]:
        tag = r.choice(["nav", "div", "ul", "nav"])
        inner = "".join(f'<li><a href="/{word()}">{words(1, 2)}</a></li>' for _ in range(n))
        return f'<{tag} class="{cls}">{inner if tag == "ul" else f"<ul>{inner}</ul>"}</{tag}>', [0] * n

    def box(tags: list[str], classes: list[str], texts: list[str]) -> tuple[str, list[int]]:
        tag, cls = r.choice(tags), r.choice(classes)
        inner = "".join(f"<{k}>{t}</{k}>" for t in texts for k in [r.choice(["p", "div", "p", "h3"])])
        if len(texts) == 1 and r.random() < 0.5:
            inner = texts[0]
        attribute = "" if tag in ("nav", "aside", "footer", "header", "form") and r.random() < 0.5 else f' {r.choice(["class", "id"])}="{cls}"'
        return f"<{tag}{attribute}>{inner}</{tag}>", [0] * len(texts)

    def article() -> tuple[str, list[int]]:
        tag, cls = r.choice([("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "entry-content"), ("section", "story"), ("div", "post-text"), ("div", "")])
        parts, labels = [], []
        if r.random() < 0.85:
            parts.append(f"<h1>{words(2, 9)}</h1>")
        for _ in range(r.choice([1, 1, 1, 2, 3, 4, 6, 9])):
            kind = r.random()
            if kind < 0.5:
                text = sentences(1, 6)
            elif kind < 0.75:
                text = words(1, 4, r.random() < 0.5)
            elif kind < 0.92:
                text = words(6, 30, r.random() < 0.5)
            else:
                text = f'{words(3, 8)} <a href="/{word()}">{words(1, 3)}</a> {words(2, 8, True)}'
            form = r.random()
            if form < 0.72:
                parts.append(f"<p>{text}</p>")
            elif form < 0.8:
                parts.append(f"<p><b>{text}<br>")
            elif form < 0.86:
                parts.append(f"<h2>{text}</h2>")
            elif form < 0.92:
                parts.append(f"<blockquote><p>{text}</p></blockquote>")
            else:
                parts.append(f"<ul><li>{text}</li></ul>" if r.random() < 0.6 else f"<table><tr><td>{text}</td></tr></table>")
        labels = [1] * len(parts)
        for _ in range(r.choice([0, 0, 1])):
            k = r.randint(0, len(parts))
            inner, zero = r.choice([advert, share])()
            parts.insert(k, inner)
            labels[k:k] = zero
        open_tag = f'<{tag} class="{cls}">' if cls else f"<{tag}>"
        return f"{open_tag}{''.join(parts)}</{tag}>", labels

    def advert() -> tuple[str, list[int]]:
        return box(["div", "aside", "section", "div"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot"], [sentences(1, 3) if r.random() < 0.6 else words(2, 6)])

    def share() -> tuple[str, list[int]]:
        return links(r.choice(["share", "social", "tags", "related"]), r.randint(1, 4))

    def comments() -> tuple[str, list[int]]:
        texts = [sentences(1, 4) for _ in range(r.randint(1, 5))]
        return box(["section", "div", "ol", "aside"], ["comments", "comment-list", "replies", "discussion", "respond", "user-comments"], texts)

    def form() -> tuple[str, list[int]]:
        inner = f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button>"
        return f'<form class="{r.choice(["search", "login", "subscribe", ""])}">{inner}</form>', [0, 0]

    def head() -> tuple[str, list[int]]:
        return box(["header", "div"], ["header", "site-header", "masthead", "topbar-header"], [words(1, 4)] + ([sentences(1, 2)] if r.random() < 0.4 else []))

    def notice() -> tuple[str, list[int]]:
        return box(["div", "section", "aside", "p"], ["cookie", "cookie-notice", "consent", "notice", "alert", "popup", "newsletter", "legal-notice"], [sentences(1, 2)])

    def side() -> tuple[str, list[int]]:
        return box(["aside", "div", "aside"], ["sidebar", "widget", "related", "side-bar", "popular-widget"], [sentences(1, 2) if r.random() < 0.6 else words(2, 7) for _ in range(r.randint(1, 4))])

    def foot() -> tuple[str, list[int]]:
        return box(["footer", "div", "footer"], ["footer", "site-footer", "foot", "copyright"], [r.choice(["&copy; ", "Copyright ", ""]) + words(2, 6) + r.choice([" &middot; ", ". "]) + sentences(1, 2)] + ([words(2, 5)] if r.random() < 0.3 else []))

    out = []
    for _ in range(count):
        before = [part() for part in (head, notice, side, form, advert) if r.random() < 0.4]
        r.shuffle(before)
        if r.random() < 0.8:
            before.insert(r.randint(0, len(before)), links(r.choice(["nav", "menu", "breadcrumb", "main-nav", ""]), r.randint(2, 8)))
        after = [part() for part in (comments, side, share, advert, form, notice) if r.random() < 0.35]
        r.shuffle(after)
        if r.random() < 0.85:
            after.append(foot())
        whole = [*before, article(), *after]
        inner = "".join(p for p, _ in whole)
        if r.random() < 0.3:
            inner = f'<div class="{r.choice(["page", "wrapper", "container", "site"])}">{inner}</div>'
        page = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{margin:0}}</style></head><body>{inner}<script>var t='</p>';</script></body></html>"
        labels = [x for _, part in whole for x in part]
        if len(blocks(page)) == len(labels):  # unclosed tags may merge blocks
            out.append((page, labels))
    return out


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def main_text(page: str | None, model: Model) -> str:
    """The content blocks of a page, joined by newlines; empty if there are none."""
    found = blocks(page)
    return "\n".join(b.text for b, label in zip(found, model.decode(found)) if label)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    The whole html is read.  A null or empty page, and one without content, has
    an empty text; broken markup is read as far as it makes sense: unclosed
    elements end with their parents, an unclosed comment or script runs to the
    end; repeated rows give repeated rows; other columns are not read.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = [main_text(h.as_py(), m) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
