"""Main text of web pages by a recurrent labeller of blocks.

A page is cut into its text blocks in order, each with the path of elements it lies in. A bidirectional
LSTM in numpy reads, for every block, hashed vectors of its path (tags, classes, ids) and of its words with
a few measures of its text, forwards and backwards over the whole page, and tells main text from the rest.
Pages are read in batches bounded by their padded blocks; a page beyond the bound is read alone, in pieces that
hand on their states.

There are no labelled pages, so the network learns from a teacher's rules on a bounded sample
(``FIT_PAGES`` pages chosen by a hash of the id, those of up to ``FIT_BLOCKS`` blocks). The sample is varied:
two of the measures are the teacher's own findings on the path, so the network may lean on the rules; the main element gets other usual names, and side matter of other kinds (notices, comments, related links,
forms, sidebars) is put in between, so that the network meets what the sample happens to lack. The order of
all random choices is fixed; the same pages give the same network.

Scripts, styles, comments and the head hold no blocks. Odd input: null or empty html, or html without a
block of main text, gives the empty text; tags that are not closed, or cut off at the end, are read as far
as they go. Repeated rows and rows without id are read alike. Without any page to learn from, the rules of
the teacher decide; pages of over 200 000 characters or 120 blocks are read but do not teach. A probability of
exactly one half counts as main text. An empty table gives an empty one. Extra columns pass untouched unless they bear
the name of a result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_PAGES = 240
FIT_BLOCKS = 120
FIT_CHARS = 200_000
PATHS, WORDS, MEASURES = 96, 48, 8
HIDDEN = 20
STEPS = 200
RATE = 0.01
PAGES_AT_ONCE = 64
BLOCKS_AT_ONCE = 16_384  # of a batch, padding counted; a longer page is read in pieces of so many

# fixed values: elements by the way they shape text
# left out with all they hold; the head of a page holds nothing else, and its end tag may be omitted
RAW = frozenset("script style noscript template iframe svg math title textarea select datalist object canvas".split())
TEXT_ONLY = frozenset("script style noscript iframe title textarea".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CLOSED_BY_ITSELF = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())
EMPTY = frozenset("hr br img input meta link area base col embed source track wbr".split())
MAIN = frozenset("article main".split())
SIDE = frozenset("nav footer aside form menu dialog button fieldset".split())
SIDE_NAMES = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright footer "
    "header login menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related "
    "reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
MAIN_NAMES = ("div.content", "div#main", "div.post", "section.entry", "div.article", "main", "article", "article", "article")
SIDE_KINDS = (
    "aside", "aside.sidebar", "div.sidebar", "div.comments", "section#comments", "section.comments", "div.comment", "form",
    "div.newsletter", "div.cookie-notice", "div.notice", "div.consent", "header", "div.header", "div#footer", "div.related",
    "section.related", "div.share", "div.social", "ul.menu", "div.menu", "div.breadcrumb", "div.ad", "div.ads",
    "div.advert", "div.sponsored", "div.banner", "div.promo", "div.popup", "div.login", "div.search", "nav", "footer",
)

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
_NAMED = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PART = re.compile(r"[a-z0-9]+")


@dataclass
class Block:
    path: tuple[str, ...]  # as ``div.ad`` from the outermost element on
    text: str
    linked: int = 0  # characters inside links


def parse(page: str | None) -> list[Block]:
    """Text blocks of a page in order; references decoded, white space in runs made one space."""
    out: list[Block] = []
    stack: list[str] = []
    parts: list[str] = []
    linked, in_link, at, text = 0, False, 0, page or ""

    def flush() -> None:
        nonlocal linked
        said = " ".join("".join(parts).split())
        if said:
            out.append(Block(tuple(stack), said, linked))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            said = html.unescape(raw)
            parts.append(said)
            linked += len(said.strip()) if in_link else 0

    while (m := _TAG.search(text, at)) is not None:
        say(text[at : m.start()])
        at = m.end()
        closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if closing or (rest or "").rstrip().endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(text, at)
            # without its end, what can hold text only takes the rest of the page, any other element nothing
            at = end.end() if end else len(text) if name in TEXT_ONLY else at
        elif name == "a":
            in_link = not closing
        elif name in BLOCKS:
            flush()
            in_link = False
            open_ = [s.split(".")[0].split("#")[0] for s in stack]
            if name in EMPTY:
                continue
            if closing:
                if name in open_:
                    del stack[len(open_) - 1 - open_[::-1].index(name) :]
                continue
            # an open paragraph ends before any block, an item before the next one
            if open_ and open_[-1] == "p":
                stack.pop()
            elif open_ and open_[-1] == name and name in CLOSED_BY_ITSELF:
                stack.pop()
            stack.append(name + _marks(rest or ""))
        elif name == "br":
            parts.append(" ")
    say(text[at:])
    flush()
    return out


def _marks(attributes: str) -> str:
    marks = []
    for kind, *values in _NAMED.findall(attributes):
        sign = "#" if kind.lower() == "id" else "."
        marks += [sign + x for v in values for x in v.lower().split()]
    return "".join(marks)


def surroundings(path: Sequence[str]) -> tuple[bool, bool]:
    """Whether elements of a path go by names of side matter, and by names of main text."""
    main = side = False
    for element in path:
        tag, *names = re.split(r"[.#]", element)
        parts = {p for n in names for p in _PART.findall(n)}
        side |= tag in SIDE or bool(parts & SIDE_NAMES) or (tag == "header" and not main)
        main |= tag in MAIN or bool(parts & {"content", "main", "post", "entry", "article"})
    return side, main


def teacher(block: Block) -> bool:
    """Whether the rules take a block for main text."""
    side, main = surroundings(block.path)
    return not side and (main or (len(block.text) >= 80 and block.linked * 3 < len(block.text)))


def features(blocks: Sequence[Block], begin: int = 0, end: int | None = None) -> np.ndarray:
    """A row for each block of a page from ``begin`` to ``end``: hashed path, hashed words, measures."""
    digest = xxhash.xxh32_intdigest
    some = blocks[begin:end]
    out = np.zeros((len(some), PATHS + WORDS + MEASURES), dtype=np.float32)
    for row, b in enumerate(some):
        i = begin + row
        for depth, element in enumerate(b.path[-8:]):
            tag, *names = re.split(r"[.#]", element)
            out[row, digest(tag) % PATHS] = 1
            for p in {p for n in names for p in _PART.findall(n)}:
                out[row, digest("." + p) % PATHS] = 1
            if depth == len(b.path[-8:]) - 1:
                out[row, digest("last " + tag) % PATHS] = 1
        words = b.text.lower().split()
        at = np.array([digest(w) for w in words], dtype=np.int64) % WORDS
        out[row, PATHS : PATHS + WORDS] = np.bincount(at, minlength=WORDS) / len(words)
        n, (side, main) = len(b.text), surroundings(b.path)
        out[row, PATHS + WORDS :] = (
            np.log1p(n) / 8,
            min(1.0, b.linked / n),
            b.text[-1] in ".!?…",
            i / max(1, len(blocks)),
            1 / (1 + i),
            1 / (len(blocks) - i),
            side,
            main and not side,
        )
    return out


class Labeller:
    """Bidirectional LSTM over the blocks of a page with one output for each block."""

    def __init__(self, rng: np.random.Generator):
        n, h = PATHS + WORDS + MEASURES, HIDDEN
        self.p: dict[str, np.ndarray] = {"out": rng.normal(0, 0.2, (2 * h, 1)), "bias": np.zeros(1)}
        for d in "fb":
            self.p |= {f"x{d}": rng.normal(0, 0.15, (n, 4 * h)), f"h{d}": rng.normal(0, 0.15, (h, 4 * h)), f"c{d}": np.zeros(4 * h)}
            self.p[f"c{d}"][h : 2 * h] = 1.0  # remember at first
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(
        self, d: str, x: np.ndarray, live: np.ndarray, start: tuple[np.ndarray, np.ndarray] | None = None, keep: bool = True
    ) -> tuple[np.ndarray, list, tuple[np.ndarray, np.ndarray]]:
        """States over time of one direction, what slopes need if ``keep``, and the last states.

        ``x`` is time by page by feature; past the end states stay.
        """
        t, n, _ = x.shape
        drive = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h, c = start if start is not None else (np.zeros((n, HIDDEN), dtype=np.float32),) * 2
        out, kept = np.zeros((t, n, HIDDEN), dtype=np.float32), []
        for i in range(t):
            gates = drive[i] + h @ self.p[f"h{d}"]
            s = 1 / (1 + np.exp(-np.clip(gates[:, : 3 * HIDDEN], -30, 30)))
            g, (a, f, o) = np.tanh(gates[:, 3 * HIDDEN :]), np.split(s, 3, axis=1)
            c_new = f * c + a * g
            squashed = np.tanh(c_new)
            m = live[i][:, None]
            if keep:
                kept.append((h, c, a, f, o, g, squashed))
            h, c = np.where(m, o * squashed, h), np.where(m, c_new, c)
            out[i] = h
        return out, kept, (h, c)

    def forward(self, x: np.ndarray, live: np.ndarray, keep: bool = True) -> tuple[np.ndarray, tuple]:
        ahead, kept_a, _ = self._run("f", x, live, keep=keep)
        back, kept_b, _ = self._run("b", x[::-1], live[::-1], keep=keep)
        both = np.concatenate([ahead, back[::-1]], axis=2)
        return self._likely(both), (both, kept_a, kept_b)

    def _likely(self, both: np.ndarray) -> np.ndarray:
        odds = (both @ self.p["out"])[..., 0] + self.p["bias"]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def read(self, blocks: Sequence[Block]) -> np.ndarray:
        """What ``forward`` gives for one page, with the features of ``BLOCKS_AT_ONCE`` blocks in memory at a time."""
        both = np.zeros((len(blocks), 2 * HIDDEN), dtype=np.float32)
        starts = range(0, len(blocks), BLOCKS_AT_ONCE)
        for d, order, turn, at in (("f", starts, 1, slice(0, HIDDEN)), ("b", reversed(starts), -1, slice(HIDDEN, None))):
            state = None
            for begin in order:
                x = features(blocks, begin, begin + BLOCKS_AT_ONCE)[::turn, None]
                out, _, state = self._run(d, x, np.ones(x.shape[:2], dtype=bool), state, keep=False)
                both[begin : begin + len(x), at] = out[::turn, 0]
        return self._likely(both)

    def slopes(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over the blocks, by back-propagation through time."""
        p, (both, kept_a, kept_b) = self.forward(x, live)
        e = (np.where(live, p - y, 0) / live.sum()).astype(np.float32)
        g = {"out": np.einsum("tnh,tn->h", both, e)[:, None], "bias": e.sum()[None]}
        up = e[:, :, None] * self.p["out"][:, 0]
        for d, kept, slope, xs, lives in (
            ("f", kept_a, up[:, :, :HIDDEN], x, live),
            ("b", kept_b, up[::-1, :, HIDDEN:], x[::-1], live[::-1]),
        ):
            gate_slopes = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
            dh = dc = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
            gh = np.zeros_like(self.p[f"h{d}"])
            for i in range(len(xs) - 1, -1, -1):
                h, c, a, f, o, q, squashed = kept[i]
                m = lives[i][:, None]
                dh_all = dh + slope[i]
                own = np.where(m, dh_all, 0)
                dcell = np.where(m, dc + own * o * (1 - squashed**2), 0)
                parts = [dcell * q * a * (1 - a), dcell * c * f * (1 - f), own * squashed * o * (1 - o), dcell * a * (1 - q**2)]
                gate_slopes[i] = np.concatenate(parts, axis=1)
                gh += h.T @ gate_slopes[i]
                dh = np.where(m, gate_slopes[i] @ self.p[f"h{d}"].T, dh_all)
                dc = np.where(m, dcell * f, dc)
            g |= {f"h{d}": gh, f"x{d}": np.einsum("tni,tnj->ij", xs, gate_slopes, optimize=True), f"c{d}": gate_slopes.sum((0, 1))}
        return g


def _padded(pages: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in pages])
    x = np.zeros((int(sizes.max()), len(pages), pages[0].shape[1]), dtype=np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i] = p
    return x, np.arange(len(x))[:, None] < sizes


def varied(blocks: list[Block], marks: list[bool], rng: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """The page with another name for its main element and side matter of other kinds put in."""
    name = str(rng.choice(MAIN_NAMES))
    out = []
    for b in blocks:
        path = tuple(name if re.split(r"[.#]", e)[0] in MAIN else e for e in b.path)
        out.append(Block(path, b.text, b.linked))
    marks = list(marks)
    words = " ".join(b.text for b in blocks).split()
    for _ in range(int(rng.integers(0, 5))):
        at = int(rng.integers(0, len(out) + 1))
        kind = str(rng.choice(SIDE_KINDS))
        near = out[min(at, len(out) - 1)].path
        around = near[: int(rng.integers(1, len(near) + 1))]
        # a page's head and foot of its own kind stand outside of its main element
        around = tuple(e for e in around if kind not in ("header", "footer", "nav") or e != name)
        for _ in range(int(rng.integers(1, 5))):
            begin, n = int(rng.integers(0, len(words))), int(rng.integers(1, 60))
            said = " ".join(words[begin : begin + n]) or words[0]
            inner = (str(rng.choice(["p", "li", "div", "h3", "span-"])),)
            path = (*around, kind, *(i for i in inner if i != "span-"))
            out.insert(at, Block(path, said, len(said) if rng.random() < 0.4 else 0))
            marks.insert(at, False)
    return out, marks


def fit(pages: Sequence[list[Block]]) -> Labeller | None:
    """A labeller that has learned the teacher's marks on the pages and on varied copies of them."""
    pages = [p for p in pages if 0 < len(p) <= FIT_BLOCKS]
    if not pages:
        return None
    rng = np.random.default_rng(5)
    net, marked = Labeller(rng), [[teacher(b) for b in p] for p in pages]
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, STEPS + 1):
        chosen = rng.choice(len(pages), min(16, len(pages)), replace=False)
        some = [(pages[i], marked[i]) if rng.random() < 0.35 else varied(pages[i], marked[i], rng) for i in chosen.tolist()]
        x, live = _padded([features(b) for b, _ in some])
        y = np.zeros(live.shape, dtype=np.float32)
        for i, (_, m) in enumerate(some):
            y[: len(m), i] = m
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, g in net.slopes(x, live, y).items():
            g = np.clip(g, -1, 1)
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            net.p[k] = net.p[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)
    return net


def batches(sizes: Sequence[int]) -> list[list[int]]:
    """Places of the pages with blocks, shortest first, so that no batch of two or more exceeds either bound when padded."""
    out: list[list[int]] = []
    for i in sorted((i for i in range(len(sizes)) if sizes[i]), key=lambda i: sizes[i]):
        if out and len(out[-1]) < PAGES_AT_ONCE and (len(out[-1]) + 1) * sizes[i] <= BLOCKS_AT_ONCE:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def main_texts(pages: Sequence[str | None], net: Labeller | None) -> list[str]:
    cut = [parse(p) for p in pages]
    out = [""] * len(cut)
    for some in batches([len(c) for c in cut]):
        if net is None:
            kept = [[teacher(b) for b in cut[i]] for i in some]
        elif len(cut[some[0]]) > BLOCKS_AT_ONCE:
            kept = [net.read(cut[some[0]]) >= 0.5]
        else:
            p, _ = net.forward(*_padded([features(cut[i]) for i in some]), keep=False)
            kept = [p[: len(cut[i]), column] >= 0.5 for column, i in enumerate(some)]
        for i, marks in zip(some, kept, strict=True):
            out[i] = " ".join(b.text for b, k in zip(cut[i], marks, strict=True) if k)
    return out


def learned(pages: DataFrame, page_id: str = "page_id", source: str = "html") -> Labeller | None:
    """A labeller fitted on a sample of the pages, at most some more than ``FIT_PAGES``."""
    usable = pages.where(F.length(source).between(1, FIT_CHARS) & F.col(page_id).isNotNull())
    rank = F.pmod(F.xxhash64(F.col(page_id).cast("string")), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    n = usable.count()
    sample = usable.where(rank < min(1.0, FIT_PAGES / max(1, n))).select(F.col(page_id).alias("i"), F.col(source).alias("s"))
    rows = sorted(sample.collect(), key=lambda r: (str(r["i"]), r["s"]))
    return fit([parse(r["s"]) for r in rows])


def with_main_text(pages: DataFrame, net: Labeller | None, source: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of each page."""
    held = pages.sparkSession.sparkContext.broadcast(net)

    def extract(column: pa.Array) -> pa.Array:
        out: list[str] = []
        for begin in range(0, len(column), 256):
            out += main_texts([x.as_py() for x in column.slice(begin, 256)], held.value)
        return pa.array(out, pa.string())

    return pages.withColumn(text, F.arrow_udf(extract, "string")(F.col(source).cast("string")))


