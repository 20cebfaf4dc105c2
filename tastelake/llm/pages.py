"""Main text of HTML pages by a recurrent labeller of blocks.

A page becomes its sequence of leaf blocks: runs of text between block-level tags, each with the path of tags, class and id words above it. A
bidirectional LSTM in NumPy reads for each block a vector of its hashed path words, one of its hashed words, and a few numbers (sizes,
links, how many path words name page parts), and labels every block with the whole page in view; the blocks labelled as article text are joined.

There are no labelled pages, so the labeller is trained on weak labels: names of elements and classes that say what a block is. The sample
is at most ``TRAIN_PAGES`` pages of at most ``TRAIN_CHARS`` characters, chosen by hash; each also takes part in altered forms, with other
containers of the article and with added menus, notices, forms, comments and the like around and inside it (their texts are words of the
sample), so that the labeller knows page parts that the sample lacks, and part of these forms lack the labelling names altogether.

A null page is empty. Pages without blocks, or without article blocks, give an empty text. A page of many blocks is labelled in parts with the
state carried on, so memory grows with its text and 32 numbers a block. Unclosed, misplaced and cut-off tags are tolerated, and a
silent element that was left open ends with an element around it; text inside scripts, styles and similar elements, comments and declarations is never a block. Repeated rows give equal rows. An
empty table gives an empty result. Columns beside page_id, url and html are not read.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastelake.llm.common import slices, small_batches

TRAIN_PAGES, TRAIN_CHARS = 300, 100_000
#: Share of the altered training pages without the names that weak labels come from.
HIDE = 0.25
HIDDEN, PATH_DIMS, WORD_DIMS, SIZES = 16, 256, 64, 7
#: A quote begins a value only right after ``=``; elsewhere it is a character like others.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
PART = re.compile(r"[a-z0-9]+")
#: Elements whose content is not text of the page. The first four hold plain text up to their own end tag.
RAW = frozenset("script style textarea title".split())
SILENT = RAW | frozenset("template noscript iframe object svg annotation select datalist optgroup option button canvas audio video".split())
#: Silent elements that hold phrases only, and the start tags that show that one of them was left open.
PHRASE = frozenset("select optgroup option button".split())
SECTION = frozenset("article main section nav aside header footer form body h1 h2 h3 h4 h5 h6 p table ul ol blockquote pre".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr br input math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mtable mtr mtd "
    "mstyle mspace mpadded mphantom semantics".split()
)
#: Start tags that end an open element of these names.
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
    "th": {"td", "th", "p"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
} | {x: {"p"} for x in "article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
#: Containers that an implied end does not reach across.
BARRIER = frozenset("ul ol dl table article section div body main aside nav header footer form".split())
#: Weak labels: names of what is not the article, and of what holds it.
AROUND = frozenset(
    "nav menu navigation navbar header footer aside sidebar form ad ads advert advertisement sponsored promo banner cookie consent "
    "notice alert popup modal comment comments reply disqus share social related recommended newsletter subscribe signup login search breadcrumb breadcrumbs "
    "pagination pager toolbar widget copyright legal".split()
)
INSIDE = frozenset("article main content post entry story body text".split())
#: Parts that altered training pages get: path words of the container, and of the blocks in it.
ADDED = (
    ("header", "h1"), ("header div.logo", "p"), ("div.header", "div"), ("nav.menu ul", "li"), ("ul.menu", "li"), ("div.navigation", "a"), ("aside", "p"),
    ("aside.sidebar", "li"), ("div.sidebar", "p"), ("div#sidebar ul", "li"), ("form", "label"), ("form.search", "p"), ("form.newsletter", "p"),
    ("form.login div", "label"), ("section.comments div.comment", "p"), ("div#comments", "p"), ("ol.comments li.comment", "p"), ("div.comments", "h3"),
    ("ul.comments", "li"), ("div.comment", "p"), ("div.cookie.notice", "p"), ("div.cookie.consent.banner", "p"), ("div.notice", "p"), ("div.alert", "p"), ("div.popup", "p"),
    ("div.ad", "p"), ("div.ads", "div"), ("div.advert", "p"), ("div.advertisement", "p"), ("aside.ad", "p"), ("div.sponsored", "p"),
    ("div.promo", "p"), ("div.banner", "p"), ("div.share.social", "li"), ("div.related ul", "li"), ("section.related", "p"), ("div.newsletter.subscribe", "p"),
    ("footer", "p"), ("footer ul", "li"), ("div.footer", "p"), ("div#footer", "p"), ("div.breadcrumb", "li"), ("nav.breadcrumbs ol", "li"),
    ("div.pagination", "a"), ("div.widget", "p"), ("div.copyright", "p"), ("div.legal", "p"), ("section.recommended", "h3"), ("nav", "p"),
)
CONTAINERS = ("article", "main", "main article", "div.content", "div#content", "div.post", "div.entry.content", "section", "div", "div.main div.text", "article div.body", "div.story")


@dataclass
class Block:
    """Path words (``t`` elements, ``c`` classes, ids and roles), text, and the characters of it inside links."""

    path: tuple[str, ...]
    text: str
    linked: int


def path_words(name: str, attributes: str) -> list[str]:
    """Names on html and body are of the page as a whole and say nothing about a block."""
    found = ["t" + name]
    if "=" in attributes and name not in ("html", "body"):
        for m in NAMES.finditer(attributes):
            found += ["c" + x for x in PART.findall(m[1].lower())]
    return found


def blocks(page: str) -> list[Block]:
    """Silent elements are on the stack like others, so an end tag around them ends them too; text below one is no text."""
    out: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    links = linked = silent = at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            path: list[str] = []
            for name, own in stack:
                if name in SILENT:
                    break
                path += own
            out.append(Block(tuple(path), text, linked))
        parts.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal links, silent
        links -= sum(n == "a" for n, _ in stack[to:])
        silent -= sum(n in SILENT for n, _ in stack[to:])
        del stack[to:]

    while at < len(page):
        m = TOKEN.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at and not silent:
            parts.append(page[at:stop])
            linked += (stop - at) if links else 0
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name, ends = m[2].lower(), bool(m[1])
        breaks = name not in INLINE and name not in SILENT
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if breaks and not any(n in SILENT for n, _ in stack[:k]):
                        flush()
                    close(k)
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break
            else:
                if breaks and not silent:
                    flush()
            continue
        if name in RAW:
            # Their content is text to the parser: it ends at their own end tag only.
            if not m[0].endswith("/>"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if silent and name in SECTION:
            for k, (open_, _) in enumerate(stack):
                if open_ in SILENT:
                    if all(n in PHRASE or n not in SILENT for n, _ in stack[k:]):
                        close(k)
                    break
        if breaks and not silent:
            flush()
        elif name == "br" and not silent:
            parts.append(" ")
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in CLOSES.get(name, ()):
                close(k)
                break
            if stack[k][0] in BARRIER:
                break
        if name not in VOID and not (name in SILENT and m[0].endswith("/>")):
            stack.append((name, path_words(name, m[3])))
            links += name == "a"
            silent += name in SILENT
    flush()
    return out


def weak_label(path: Sequence[str], words: int) -> int:
    """Whether names say that a block is article text. A header inside the article is its own, with its title."""
    inner = path.index("tarticle") if "tarticle" in path else len(path)
    names = {w[1:] for i, w in enumerate(path) if not (w == "theader" and i > inner)}
    if names & AROUND:
        return 0
    return int(bool((names - {"body"}) & INSIDE) or ("cbody" in path) or words >= 5)


def path_of(spec: str) -> list[str]:
    """Path words of ``div#a.b li``."""
    return [("t" if i == 0 else "c") + w for part in spec.split() for i, w in enumerate(re.split("[.#]", part))]


_BUCKETS: dict[str, int] = {}


def bucket(word: str) -> int:
    if (b := _BUCKETS.get(word)) is None:
        b = zlib.crc32(word.encode())
        if len(_BUCKETS) < 200_000:
            _BUCKETS[word] = b
    return b


def is_named(page: Sequence[Block]) -> bool:
    """Whether a page names any of its parts."""
    return any(w[1:] in AROUND or w[1:] in INSIDE for b in page for w in b.path)


def vectors(page: Sequence[Block], hidden: bool = False, start: int = 0, total: int | None = None, named: bool | None = None) -> np.ndarray:
    """One row per block. ``hidden``: without the names that weak labels are made of.

    A part of a page is told its ``start``, the ``total`` of the page's blocks and whether the page is ``named``.
    """
    n = len(page)
    paths = [[w for w in b.path if w[1:] not in AROUND and w[1:] not in INSIDE] if hidden else b.path for b in page]
    path = [(i, bucket(w) % PATH_DIMS) for i, own in enumerate(paths) for w in set(own)]
    split = [b.text.split() for b in page]
    word = [(i, bucket(w) % WORD_DIMS) for i, ws in enumerate(split) for w in ws]
    out = np.zeros((n, PATH_DIMS + WORD_DIMS + SIZES), np.float32)
    if n:
        rows, cols = np.array(path, np.int64).reshape(-1, 2).T
        out[rows, cols] = 1
        rows, cols = np.array(word, np.int64).reshape(-1, 2).T
        counts = np.bincount(rows * WORD_DIMS + cols, minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
        size = np.array([len(ws) for ws in split], np.float32)
        chars = np.array([max(len(b.text), 1) for b in page], np.float32)
        out[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts / np.sqrt(size[:, None])
        names = [{w[1:] for i, w in enumerate(own) if not (w == "theader" and "tarticle" in own[:i])} for own in paths]
        out[:, -7] = not hidden and (is_named(page) if named is None else named)
        out[:, -6] = [len(x & AROUND) for x in names]
        out[:, -5] = [len(x & INSIDE) for x in names]
        out[:, -4] = np.log1p(size) / 4
        out[:, -3] = [min(b.linked / c, 1) for b, c in zip(page, chars)]
        out[:, -2] = [sum(map(b.text.count, ".,;!?")) / c * 10 for b, c in zip(page, chars)]
        out[:, -1] = (start + np.arange(n)) / (total or n)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one logistic output per block. Arrays are (places, pages, units)."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        dims, h = PATH_DIMS + WORD_DIMS + SIZES, HIDDEN

        def normal(*shape: int) -> np.ndarray:
            return (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.weights = {f"{k}{d}": v for d in "fb" for k, v in (("w", normal(dims, 4 * h)), ("u", normal(h, 4 * h)), ("c", np.zeros(4 * h, np.float32)))}
        for d in "fb":
            self.weights["c" + d][h : 2 * h] = 1  # gates start out remembering
        self.weights |= {"o": normal(2 * h), "z": np.zeros(1, np.float32)}

    def _run(
        self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = True, begin: tuple[np.ndarray, np.ndarray] | None = None
    ) -> tuple[np.ndarray, list, tuple[np.ndarray, np.ndarray]]:
        """Hidden states in reading order of direction d, the tape of all steps (if it is to ``keep``), and the last state to go on from.

        Masked places leave the state as it is.
        """
        w, h = self.weights, HIDDEN
        steps = x.shape[0]
        pre = x @ w["w" + d] + w["c" + d]
        state, cell = begin or (np.zeros((x.shape[1], h), np.float32),) * 2
        out, tape = np.zeros((steps, x.shape[1], h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gates = pre[t] + state @ w["u" + d]
            s = sigmoid(gates[:, : 3 * h])
            g = np.tanh(gates[:, 3 * h :])
            new = s[:, h : 2 * h] * cell + s[:, :h] * g
            tanh = np.tanh(new)
            m = mask[t][:, None]
            if keep:
                tape.append((t, s, g, cell, tanh, state))
            state = np.where(m, s[:, 2 * h :] * tanh, state)
            cell = np.where(m, new, cell)
            out[t] = state
        return out, tape, (state, cell)

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, keep=False)[0] for d in "fb"], axis=2)
        return both @ self.weights["o"] + self.weights["z"]

    def long_scores(self, page: Sequence[Block], places: int) -> np.ndarray:
        """Scores of one page of any length: its vectors are made part by part, in both directions, only states go on."""
        n, named = len(page), is_named(page)
        both = np.zeros((n, 2 * HIDDEN), np.float32)
        for i, d in enumerate("fb"):
            state = None
            starts = range(0, n, places)
            for at in starts if d == "f" else reversed(starts):
                x = vectors(page[at : at + places], False, at, n, named)[:, None, :]
                found, _, state = self._run(x, np.ones((len(x), 1), bool), d, False, state)
                both[at : at + places, i * HIDDEN : (i + 1) * HIDDEN] = found[:, 0]
        return both @ self.weights["o"] + self.weights["z"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, h = self.weights, HIDDEN
        runs = {d: self._run(x, mask, d) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        error = (sigmoid(both @ w["o"] + w["z"]) - y) * mask / max(mask.sum(), 1)
        grads = {"o": np.tensordot(error, both, 2), "z": np.array([error.sum()], np.float32)}
        for i, d in enumerate("fb"):
            upper = error[:, :, None] * w["o"][i * h : (i + 1) * h]
            pre = np.zeros((*x.shape[:2], 4 * h), np.float32)
            d_state = d_cell = np.zeros((x.shape[1], h), np.float32)
            du = np.zeros_like(w["u" + d])
            for t, s, g, cell, tanh, state in reversed(runs[d][1]):
                m = mask[t][:, None]
                d_state = d_state + upper[t]
                here, passed = d_state * m, d_state * ~m
                i_, f_, o_ = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
                d_new = d_cell * m + here * o_ * (1 - tanh**2)
                gate = np.concatenate(
                    [d_new * g * i_ * (1 - i_), d_new * cell * f_ * (1 - f_), here * tanh * o_ * (1 - o_), d_new * i_ * (1 - g**2)], axis=1
                )
                pre[t] = gate
                du += state.T @ gate
                d_state = gate @ w["u" + d].T + passed
                d_cell = d_new * f_ + d_cell * ~m
            grads["w" + d] = np.tensordot(x, pre, ([0, 1], [0, 1]))
            grads["u" + d], grads["c" + d] = du, pre.sum(axis=(0, 1))
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 10, batch: int = 24, rate: float = 0.01) -> Labeller:
        """Adam over pages (vectors, labels), batches of pages of similar length."""
        r = np.random.default_rng(3)
        pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        n = 0
        for _ in range(epochs):
            for at in r.permutation(range(0, len(pages), batch)):
                x, mask, y = padded(pages[at : at + batch])
                n += 1
                for k, g in self.gradients(x, mask, y).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    step = rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)
                    self.weights[k] = (self.weights[k] - step).astype(np.float32)
        return self

    def label(self, pages: Sequence[Sequence[Block]], places: int = 4096) -> list[np.ndarray]:
        """True for article blocks, page by page; pages of similar length run together, ``places`` places at a time, longer ones in parts."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [i for i in np.argsort([len(p) for p in pages], kind="stable") if len(pages[i])]
        while order:
            longest = len(pages[order[-1]])
            if longest > places:
                i = order.pop()
                out[i] = self.long_scores(pages[i], places) > 0
                continue
            n = max(1, places // longest)
            own, order = order[-n:], order[:-n]
            x, mask, _ = padded([(vectors(pages[i]), np.zeros(len(pages[i]))) for i in own])
            found = self.scores(x, mask) > 0
            for k, i in enumerate(own):
                out[i] = found[: len(pages[i]), k]
        return out


def padded(pages: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(x) for x, _ in pages)
    x = np.zeros((steps, len(pages), pages[0][0].shape[1]), np.float32)
    mask, y = np.zeros((steps, len(pages)), bool), np.zeros((steps, len(pages)), np.float32)
    for k, (own, labels) in enumerate(pages):
        x[: len(own), k], mask[: len(own), k], y[: len(own), k] = own, True, labels
    return x, mask, y


def altered(page: list[Block], labels: list[int], sentences: list[list[str]], r: np.random.Generator) -> tuple[list[Block], list[int]]:
    """The page with another container of its article and with added parts around and inside it.

    All added texts are runs of words from blocks of the sample, so that words alone do not tell the parts from the article.
    """
    container = path_of(CONTAINERS[r.integers(len(CONTAINERS))])
    out: list[tuple[Block, int]] = []
    for b, y in zip(page, labels):
        if y and "tarticle" in b.path:
            k = b.path.index("tarticle")
            b = Block((*b.path[:k], *container, *b.path[k + 1 :]), b.text, b.linked)
        out.append((b, y))

    def words(n: int) -> str:
        own = sentences[r.integers(len(sentences))]
        at = int(r.integers(max(1, len(own) - n)))
        return " ".join(own[at : at + n])

    for _ in range(r.integers(1, 6)):
        spec, leaf = ADDED[r.integers(len(ADDED))]
        at = int(r.integers(len(out) + 1))
        around = out[at - 1][0].path if at and r.random() < 0.5 else ("thtml", "tbody")
        if out and at and out[at - 1][1] and r.random() < 0.5:
            around = ("thtml", "tbody", *container)
        parts = []
        for _ in range(r.integers(1, 5)):
            text = words(int(r.choice([1, 3, 8, 25, 60])))
            linked = len(text) if r.random() < 0.3 else 0
            parts.append((Block((*[w for w in around if w not in ("tp", "tli")], *path_of(spec), "t" + leaf), text, linked), 0))
        out[at:at] = parts
    for _ in range(r.integers(0, 6)):  # article blocks of other kinds
        if mine := [i for i, (_, y) in enumerate(out) if y]:
            at = mine[r.integers(len(mine))]
            leaf = str(r.choice(["h1", "h2", "h3", "h4", "ul li", "ol li", "dl dd", "div", "blockquote", "blockquote p", "pre", "td", "figcaption", "section p", "p"]))
            head = [w for w in out[at][0].path if w not in ("tp", "th1", "tb")]
            out.insert(at, (Block((*head, *path_of(leaf)), words(int(r.choice([2, 6, 20, 60]))), 0), 1))
    return [b for b, _ in out], [y for _, y in out]


def train(pages: DataFrame, limit: int = TRAIN_PAGES, forms: int = 4) -> Labeller:
    """A labeller from weak labels of a bounded sample."""
    fraction = min(1.0, 20 * limit / max(pages.count(), 1))
    hashed = pages.select("html", F.xxhash64("html").alias("_h"))
    hashed = hashed.filter((F.pmod("_h", F.lit(1_000_000)) < int(fraction * 1_000_000) + 1) & (F.length("html") > 0) & (F.length("html") <= TRAIN_CHARS))
    # Hashes first, then the pages of the chosen ones: no task sends more than ``limit`` numbers or its share of ``limit`` pages.
    chosen = [r["_h"] for r in hashed.select("_h").distinct().orderBy("_h").limit(limit).collect()]
    rows = hashed.filter(F.col("_h").isin(chosen)).groupBy("_h").agg(F.first("html").alias("html"))
    sample = [r["html"] for r in sorted(rows.collect(), key=lambda r: r["_h"])]
    r = np.random.default_rng(11)
    read = [p for p in map(blocks, sample) if p]
    sentences = [b.text.split() for p in read for b in p] or [["text"]]
    out = []
    for page in read:
        labels = [weak_label(b.path, len(b.text.split())) for b in page]
        out.append((vectors(page), np.array(labels, np.float32)))
        for _ in range(forms):
            changed, y = altered(page, labels, sentences, r)
            # Names are hidden in part of the forms, so that sizes, words and neighbours must tell the parts too.
            out.append((vectors(changed, hidden=r.random() < HIDE), np.array(y, np.float32)))
    return Labeller().fit(out) if out else Labeller()


def main_text(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    spark = pages.sparkSession
    small_batches(spark, 256)
    source = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    model = spark.sparkContext.broadcast(labeller or train(source))
    schema = source.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html", 1 << 20):
            read = [blocks(p) for p in part.column("html").to_pylist()]
            chosen = model.value.label(read)
            texts = ["\n".join(b.text for b, y in zip(p, own) if y) for p, own in zip(read, chosen)]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    return source.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
