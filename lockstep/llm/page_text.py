"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks (runs of text without a block tag inside). Each block is a vector: its tag path with class and id
words, hashed; its words, hashed; its length, its share of link text and its place. A bidirectional LSTM in numpy reads the whole sequence
and calls every block main text or not, so a block is judged within its document. It is trained on a bounded sample of the given pages
whose blocks are labelled by structure (`weak_label`), with blocks of furniture that these pages lack mixed in.

Character references are decoded, scripts, styles, comments and other text that is never shown are dropped, white space inside a block
(line breaks too) becomes one space, and kept blocks are joined by one newline in page order.

Edge cases: null or empty html gives the empty text; unclosed tags end with their container; a page cut off inside a tag ends there;
repeated rows give repeated rows; an empty table gives none. Other columns do not pass.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lockstep.llm.chars import Words
from lockstep.llm.common import batches_of, prepared, strings, with_fields

PATH_WIDTH, WORD_WIDTH, PLAIN = 64, 24, 4
WIDTH = PATH_WIDTH + WORD_WIDTH + PLAIN
HIDDEN = 16
#: Most pages that are learned from, and the characters after which no further page is taken. Pages are whole.
TRAINING_PAGES, TRAINING_CHARS = 256, 4_000_000
#: Blocks that gradients reach over: longer pages are learned in stretches, every block of them.
STRETCH = 400
EPOCHS = 30

BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
                       "h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td "
                       "tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag ends, and where the search for it stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Words of tags, classes and ids that mark furniture, and those that mark the article.
FURNITURE = frozenset("nav navbar navigation menu header masthead footer aside sidebar form button select label head title ad ads advert adverts advertisement "
                      "sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal newsletter subscribe login search comment "
                      "comments reply replies disqus related recommended share social breadcrumb breadcrumbs pagination pager widget copyright".split())
ARTICLE = frozenset("article main content post entry story body-text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|iframe|svg|textarea|object)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
                    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
                    re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME_WORD = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Block:
    path: tuple[str, ...]  # tags, and class and id words with a leading dot, outermost first
    text: str
    linked: float          # share of the characters inside links


def blocks(page: str) -> list[Block]:
    """Leaf blocks with visible text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links = [0, 0]  # open links, characters inside links
    at = 0

    def end_block() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(tuple(x for _, names in stack for x in names), text, min(1.0, links[1] / len(text))))
            parts.clear()
            links[1] = 0

    def pop_to(depth: int) -> None:
        links[0] -= sum(tag == "a" for tag, _ in stack[depth:])
        del stack[depth:]

    def add(piece: str) -> None:
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if links[0]:
                links[1] += len(piece.strip())

    for m in _TOKEN.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        closing, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        block = tag in BLOCK_TAGS
        if block:
            end_block()
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    pop_to(depth)
                    break
            continue
        if tag in VOID_TAGS:
            continue
        if block:
            ended, stop = ENDS.get(tag, ({"p"}, {"table", "button"}))
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ended:
                    pop_to(depth)
                    break
                if stack[depth][0] in stop:
                    break
        names: tuple[str, ...] = (tag,) if block else ()
        if attributes and block and ("=" in attributes):
            names += tuple(f".{w}" for found in _NAMES.findall(attributes) for w in _NAME_WORD.findall("".join(found).lower()))
        links[0] += tag == "a"
        stack.append((tag, names))
    add(page[at:])
    end_block()
    return out


def weak_label(block: Block, page_has_article: bool) -> int:
    """Main text or not by structure alone: the innermost telling name decides; without one, long text outside links counts as main."""
    for name in reversed(block.path):
        word = name.lstrip(".")
        if word in FURNITURE and not (word in ("header", "title") and "article" in block.path and name[0] != "."):
            return 0
        if word in ARTICLE:
            return 1
    return 0 if page_has_article else int(len(block.text) >= 80 and block.linked < 0.3)


@lru_cache(20_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH_WIDTH, np.float32)
    for name in path:
        h = zlib.crc32(name.encode())
        for shift in (0, 8, 16):
            out[(h >> shift) % PATH_WIDTH] += 1 - 2 * ((h >> (24 + shift // 8)) & 1)
    return out


def vectors(pages: list[list[Block]]) -> np.ndarray:
    """One row per block of all pages."""
    flat = [b for page in pages for b in page]
    out = np.zeros((len(flat), WIDTH), np.float32)
    if not flat:
        return out
    out[:, :PATH_WIDTH] = np.stack([_path_vector(b.path) for b in flat])
    words = Words([b.text for b in flat])
    counts = np.bincount(words.text * WORD_WIDTH + (words.hash % np.uint64(WORD_WIDTH)).astype(np.int64), minlength=len(flat) * WORD_WIDTH).reshape(len(flat), WORD_WIDTH)
    out[:, PATH_WIDTH:-PLAIN] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    place = np.concatenate([np.arange(len(p)) / len(p) for p in pages if p])
    length = np.log1p([len(b.text) for b in flat])
    out[:, -PLAIN:] = np.stack([length / 6, [b.linked for b in flat], place, np.ones(len(flat))], 1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output per block."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in ("f", "b"):
            self.p[f"x{d}"] = rng.normal(0, WIDTH**-0.5, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            self.p[f"h{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p[f"c{d}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)  # the forget gate starts open
        self.p["o"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        self.p["s"] = rng.normal(0, 0.05, WIDTH).astype(np.float32)

    def _pass(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        gates = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.zeros((*x.shape[:2], HIDDEN), np.float32)
        for t in range(len(x)):
            a = gates[t] + h @ self.p[f"h{d}"]
            i, f, o = (_sigmoid(a[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(a[:, 3 * HIDDEN:])
            nc = f * c + i * g
            tc = np.tanh(nc)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((h, c, i, f, o, g, tc, m))
            c, h = m * nc + (1 - m) * c, m * (o * tc) + (1 - m) * h
            out[t] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Log odds of (time, page) for vectors of (time, page, item)."""
        kf, kb = ([], []) if keep is not None else (None, None)
        hf = self._pass("f", x, mask, kf)
        hb = self._pass("b", x[::-1], mask[::-1], kb)[::-1]
        if keep is not None:
            keep.update(f=kf, b=kb, hf=hf, hb=hb)
        return hf @ self.p["o"][:HIDDEN] + hb @ self.p["o"][HIDDEN:] + x @ self.p["s"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        z = self.forward(x, mask, keep)
        slope = ((_sigmoid(z) - y) * mask / mask.sum()).astype(np.float32)
        grads = {"o": np.concatenate([np.einsum("tb,tbh->h", slope, keep["hf"]), np.einsum("tb,tbh->h", slope, keep["hb"])]),
                 "s": np.einsum("tb,tbw->w", slope, x)}
        for d, own, hs in (("f", self.p["o"][:HIDDEN], slope), ("b", self.p["o"][HIDDEN:], slope[::-1])):
            xs = x if d == "f" else x[::-1]
            da = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(self.p[f"h{d}"])
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t in range(len(x) - 1, -1, -1):
                h, c, i, f, o, g, tc, m = keep[d][t]
                dh = dh + hs[t][:, None] * own
                dn, dcn = dh * m, dc * m
                dcn = dcn + dn * o * (1 - tc * tc)
                a = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), dn * tc * o * (1 - o), dcn * i * (1 - g * g)], 1)
                da[t] = a
                gh += h.T @ a
                dh, dc = dh * (1 - m) + a @ self.p[f"h{d}"].T, dc * (1 - m) + dcn * f
            grads[f"x{d}"] = np.einsum("tbw,tbg->wg", xs, da, optimize=True)
            grads[f"h{d}"], grads[f"c{d}"] = gh, da.sum((0, 1))
        return grads

    def odds(self, pages: list[list[Block]], group: int = 64) -> list[np.ndarray]:
        """Log odds of every block; pages of like length are read together."""
        x = vectors(pages)
        starts = np.cumsum([0, *(len(p) for p in pages)])
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if pages[i]]
        for a in range(0, len(order), group):
            some = order[a:a + group]
            padded, mask = pad([x[starts[i]:starts[i + 1]] for i in some])
            z = self.forward(padded, mask)
            for k, i in enumerate(some):
                out[i] = z[:len(pages[i]), k]
        return out


def pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, rows))
    x, mask = np.zeros((longest, len(rows), WIDTH), np.float32), np.zeros((longest, len(rows)), np.float32)
    for k, r in enumerate(rows):
        x[:len(r), k], mask[:len(r), k] = r, 1
    return x, mask


def varied(page: list[Block], rng: np.random.Generator, pool: list[str]) -> list[Block]:
    """The page with other names for its article and with furniture that it may lack, in words of other pages."""
    frame = ("html", "body")
    rename = rng.choice(["article", "main", ".content", ".post", ".story", ""])
    named = {"": ("article",), "article": ("article",), "main": ("main",)}.get(rename, ("div", rename))
    out = [Block(tuple(y for n in b.path for y in (named if n == "article" else (n,))), b.text, b.linked) for b in page]
    for word in rng.choice(sorted(FURNITURE - {"head", "title"}), rng.integers(1, 5), replace=False):
        tag = word if word in BLOCK_TAGS else None
        where = int(rng.choice([0, len(out), rng.integers(0, len(out) + 1)]))
        path = (*frame, *((tag,) if tag else (str(rng.choice(["div", "section", "ul", "aside" if word != "comment" else "div"])), f".{word}")), *rng.choice(["p", "div", "li"], 1).tolist())
        inside = where not in (0, len(out)) and rng.random() < 0.5 and "article" not in path
        path = (*frame, *named, *path[2:]) if inside else path
        made = [Block(path, pool[rng.integers(len(pool))][:int(rng.choice([20, 80, 2000]))] or "x", float(rng.choice([0, 0, 1]))) for _ in range(rng.integers(1, 5))]
        out[where:where] = made
    return out


def muted(page: list[Block], rng: np.random.Generator) -> list[Block]:
    """The page with names that say nothing: what is main text must then be told by words, length, links and place."""
    telling = sorted({n for b in page for n in b.path if n.lstrip(".") in FURNITURE | ARTICLE})
    said = {n: ("div", f".z{rng.integers(10**6)}") if not n.startswith(".") else (f".z{rng.integers(10**6)}",) for n in telling}
    return [Block(tuple(y for n in b.path for y in said.get(n, (n,))), b.text, b.linked) for b in page]


def train(pages: list[str], seed: int = 3) -> Labeller:
    """A labeller from pages labelled by structure, each also in two varied forms, the first of them also muted (Adam)."""
    rng = np.random.default_rng(seed)
    plain = [b for b in map(blocks, pages) if b]
    model = Labeller(seed)
    if not plain:
        plain = [[Block(("html", "body", "article", "p"), "text", 0.0), Block(("html", "body", "nav", "li"), "text", 1.0)]]
    pool = [b.text for p in plain for b in p]
    every = plain + [varied(p, rng, pool) for p in plain for _ in range(2)]
    labels = []
    for p in every:
        has = any(n.lstrip(".") in ARTICLE for b in p for n in b.path)
        labels.append(np.array([weak_label(b, has) for b in p], np.float32))
    every += [muted(p, rng) for p in every[len(plain):2 * len(plain)]]
    labels += labels[len(plain):2 * len(plain)]
    rows = [x[a:a + STRETCH] for x in (vectors([p]) for p in every) for a in range(0, len(x), STRETCH)]
    labels = [y[a:a + STRETCH] for y in labels for a in range(0, len(y), STRETCH)]
    m, v, step = {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}, 0
    for epoch in range(EPOCHS):
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]) + 6 * rng.random())
        groups = [order[a:a + 48] for a in range(0, len(order), 48)]
        for g in rng.permutation(len(groups)):
            x, mask = pad([rows[i] for i in groups[g]])
            y = np.zeros(mask.shape, np.float32)
            for k, i in enumerate(groups[g]):
                y[:len(labels[i]), k] = labels[i]
            step += 1
            for name, grad in model.gradients(x, mask, y).items():
                grad = np.clip(grad, -1, 1)
                m[name], v[name] = 0.9 * m[name] + 0.1 * grad, 0.99 * v[name] + 0.01 * grad * grad
                rate = 0.02 * (1 - epoch / EPOCHS) + 0.001
                model.p[name] = (model.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def learn(df: DataFrame, key: str = "page_id", html: str = "html", pages: int = TRAINING_PAGES) -> Labeller:
    """Train on whole pages drawn by hash of the key: at most ``pages``, and none once ``TRAINING_CHARS`` characters are reached."""
    prepared(df.sparkSession)
    total = df.count()
    drawn = df.where(F.col(html).isNotNull() & (F.pmod(F.xxhash64(F.col(key), F.lit(41)), F.lit(1_000_000)) < min(1.0, 2 * pages / max(1, total)) * 1_000_000))
    picked = drawn.select(F.xxhash64(F.col(key), F.lit(42)).alias("h"), F.col(key).alias("k"), F.col(html).alias("html")).orderBy("h", "k", "html").limit(pages)
    before = F.coalesce(F.sum(F.char_length("html")).over(Window.orderBy("h", "k", "html").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = picked.withColumn("before", before).where(F.col("before") < TRAINING_CHARS).orderBy("before").select("html").collect()  # training only
    return train([r.html for r in rows])


def extract(df: DataFrame, model: Labeller, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``keep`` columns and ``text``: the main text of the whole page."""
    prepared(df.sparkSession)
    schema = with_fields(df.select(*keep), "text string")
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = strings(batch.column(n))
            for a, b in batches_of(sources):
                pages = [blocks(s) for s in sources[a:b]]
                texts = ["\n".join([x.text for x, z in zip(page, odds, strict=True) if z > 0]) for page, odds in zip(pages, model.odds(pages), strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:n]), pa.array(texts, pa.string())], names=schema.names)

    return df.select(*keep, html).mapInArrow(run, schema)
