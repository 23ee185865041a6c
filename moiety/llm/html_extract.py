"""HTML extraction by a recurrent block labeller: a bidirectional LSTM in numpy reads a page's blocks in order.

A page is split at tags into blocks: text between block-level tags, with inline tags left out.  Each block becomes a vector: hashed names, classes and ids of the
elements around it (its tag path), hashed words, and a few numbers (length, share of link text and of digits, place).  One LSTM reads the
blocks forwards, one backwards, and a logistic unit on their two states says whether the block is main text, so each decision sees
the whole page and nothing but the states.  Texts of the chosen blocks are joined in page order.

There are no labelled pages to learn from.  ``html_training`` makes them up from a fixed seed (pages with telling class names, with
none, and with meaningless ones) and fits the weights, which are stored beside this module; running it again gives them again.

Content of elements that never show text is no block: script, style, textarea and title up to their end tag (or the page's
end, as in browsers), and those of ``SILENT`` up to their end tag, the end of the element around them, or their own "/>"; one of them
that is never closed and has no element around it is ignored.  The end tag of head may be missing.  A ">" inside a quoted attribute ends no
tag.  Text of math and of object counts as shown.  Character references are decoded; white space in a block becomes one space.
Nothing else is dropped or capped; of tag paths deeper than 128 the vector sees the outer and inner 64.

Defined results: null or empty html gives empty text and 0; html without any tag is its whole text.  Unclosed elements end with the
element around them.  Rows that repeat are extracted each; an empty table gives no rows.
"""

from __future__ import annotations

import html
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from moiety.llm import common as C

PATHS, WORDS, NUMBERS, HIDDEN = 384, 96, 12, 32
INPUT = PATHS + WORDS + NUMBERS
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for n in ("script", "style", "textarea", "title")}
SILENT = frozenset("noscript template svg iframe select canvas audio video annotation annotation-xml".split())
NESTED = frozenset("svg template".split())  #: silent elements that may hold themselves
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?>(?:[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*)(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>""",
    re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_MARKS = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math object q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
MATH = frozenset("mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mstyle mspace mpadded mphantom menclose mfenced mtable mtr mtd merror maction semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())

BREAKS_SVG = CLOSES_P | frozenset("b big blockquote body br center code em font i p small span strike strong sub sup tt u var".split())  #: not part of a drawing, so they end it


def _hash(token: str) -> int:
    return zlib.crc32(token.encode()) % PATHS


def _tag(raw: str, cache: dict):
    """(name, ends, tokens of name and marks) of a tag's source."""
    got = cache.get(raw)
    if got is None:
        m = _NAME.match(raw)
        if not m:
            return None
        name = m[1].lower()
        tokens = [name]
        if "=" in raw:
            for a in _MARKS.finditer(raw):
                tokens += [f"{'id' if a[1].lower() == 'id' else 'c'}:{w}" for w in _PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2",
                    a[2] or a[3] or a[4] or "").lower())]
        got = (name, raw.startswith("</"), tuple(tokens))
        if len(raw) < 200 and len(cache) < 20_000:
            cache[raw] = got
    return got


def blocks(page: str, cache: dict) -> list[tuple[tuple, str, float]]:
    """(tag path, text, share of link text) of each block of a page, in order."""
    out, stack, opened, parts, links, linked = [], [], Counter(), [], 0, 0

    def close():
        nonlocal links
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = text.replace("&amp;", "&") if text.count("&") == text.count("&amp;") else html.unescape(text)
            text = " ".join(text.split())
            if text:
                seen = stack if len(stack) <= 128 else stack[:64] + stack[-64:]
                out.append((tuple(t for _, t in seen), text, min(1.0, links / len(text))))
            parts.clear()
        links = 0

    def closed(name):
        if name not in ended:
            ended[name] = max((e.start() for e in re.finditer(f"</{name}", page, re.I)), default=-1)
        return ended[name] >= at

    at, quiet, ended = 0, [], {}
    while True:
        m = _TOKEN.search(page, at)
        a = m.start() if m else len(page)
        if a > at and not quiet:
            parts.append(page[at:a])
            links += (a - at) if linked else 0
        if not m:
            break
        at = m.end()
        if page[a + 1] in "!?":
            continue
        tag = _tag(m[0], cache)
        if tag is None:
            continue
        name, ends, tokens = tag
        empty = m[0].endswith("/>")
        if name in _RAW and not ends and not (quiet and quiet[0] == "svg" and (empty or not closed(name))):
            e = _RAW[name].search(page, at)
            at = e.end() if e else len(page)
            continue
        if quiet:
            if ends and name in quiet:
                del quiet[len(quiet) - 1 - quiet[::-1].index(name) if name in NESTED or name not in SILENT else quiet.index(name):]
                continue
            if ends:
                over = name == "head" or opened[name] > 0
            else:
                over = name == "body" and not opened["body"] or quiet[0] == "svg" and name in BREAKS_SVG and not {"foreignobject", "desc",
                    "title"}.intersection(quiet)
            if not over:
                if not ends and not empty and name not in VOID:
                    quiet.append(name)
                continue
            quiet.clear()
        if name == "head":  # what shows no text in it is silent by itself; all else ends it
            continue
        if name in SILENT:
            if not ends and not empty and (closed(name) or len(stack) > opened["html"] + opened["body"]):
                quiet.append(name)
            continue
        if name in MATH:
            parts += [] if ends else [" "]
            continue
        if name in INLINE:
            if name == "a":
                linked = max(0, linked + (-1 if ends else 1))
            continue
        if name == "br":
            parts.append(" ")
            continue
        close()
        linked = 0
        if ends:
            while opened[name]:  # what is open inside it ends with it
                n, _ = stack.pop()
                opened[n] -= 1
                if n == name:
                    break
        elif name not in VOID:
            if stack and (stack[-1][0] == "p" and name in CLOSES_P or name == stack[-1][0] and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                opened[stack.pop()[0]] -= 1
            stack.append((name, tokens))
            opened[name] += 1
    close()
    return out


def _path_vector(path: tuple, cache: dict) -> np.ndarray:
    got = cache.get(path)
    if got is None:
        got = np.zeros(PATHS, np.float32)
        for k, tokens in enumerate(path):
            for t in tokens:
                got[_hash(t)] = 1
                if k == len(path) - 1:
                    got[_hash("last " + t)] = 1
        if len(cache) < 20_000:
            cache[path] = got
    return got


def block_vectors(found: list, cache: dict) -> np.ndarray:
    """Vectors of one page's blocks."""
    n = len(found)
    x = np.zeros((n, INPUT), np.float32)
    raw = [t.encode() for _, t, _ in found]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    words, first = C.word_hashes(data, ends)
    count = np.diff(first)
    of = np.repeat(np.arange(n), count)
    x[:, PATHS:PATHS + WORDS] = np.sqrt(np.bincount(of * WORDS + (words % np.uint64(WORDS)).astype(np.int64),
        minlength=n * WORDS).reshape(n, WORDS) / np.maximum(count, 1)[:, None])
    for i, (path, text, links) in enumerate(found):
        x[i, :PATHS] = _path_vector(path, cache)
        digits = sum(map(str.isdigit, text[:200])) / min(len(text), 200)
        same = i > 0 and found[i - 1][0] == path
        x[i, PATHS + WORDS:] = (np.log1p(len(text)) / 6, links, min(count[i], 60) / 60, text[-1] in ".!?\"", i / n, (n - i) / n,
            min(len(path), 20) / 10, text[0].isupper(), digits, same, links > 0.9, "\u00a9" in text)
    return x


class Labeller:
    """Weights of the two LSTMs and the logistic unit."""

    def __init__(self, seed: int = 5):
        r = np.random.RandomState(seed)
        self.p = {}
        for d in "fb":
            self.p[d + "x"] = (r.normal(size=(INPUT, 4 * HIDDEN)) * 0.15).astype(np.float32)
            self.p[d + "h"] = (r.normal(size=(HIDDEN, 4 * HIDDEN)) * 0.15).astype(np.float32)
            self.p[d + "b"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        self.p["o"] = (r.normal(size=(2 * HIDDEN,)) * 0.1).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    @staticmethod
    def _sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def _run(self, x, mask, d, keep):
        """States (steps, pages, HIDDEN) of one direction; x: (steps, pages, INPUT)."""
        order = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        pre = x @ self.p[d + "x"] + self.p[d + "b"]
        h, c = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
        out, tape = np.zeros((len(x), x.shape[1], HIDDEN), np.float32), []
        for t in order:
            g = pre[t] + h @ self.p[d + "h"]
            i, f, o = (self._sigmoid(g[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            z = np.tanh(g[:, 3 * HIDDEN:])
            new = f * c + i * z
            th = np.tanh(new)
            m = mask[t][:, None]
            if keep:
                tape.append((t, h, c, i, f, o, z, th, m))
            c = np.where(m, new, c)
            h = np.where(m, o * th, h)
            out[t] = h
        return out, tape

    def forward(self, x, mask, keep=False):
        f, tf = self._run(x, mask, "f", keep)
        b, tb = self._run(x, mask, "b", keep)
        both = np.concatenate([f, b], axis=2)
        return self._sigmoid(both @ self.p["o"] + self.p["c"][0]), both, tf, tb

    def gradients(self, x, mask, y):
        p, both, tf, tb = self.forward(x, mask, keep=True)
        d = np.where(mask, p - y, 0).astype(np.float32) / mask.sum()
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"], g["c"] = np.einsum("tp,tpk->k", d, both), np.array([d.sum()], np.float32)
        for name, tape, k in (("f", tf, 0), ("b", tb, 1)):
            into = d[:, :, None] * self.p["o"][k * HIDDEN:(k + 1) * HIDDEN]
            dh, dc = np.zeros_like(into[0]), np.zeros_like(into[0])
            pre = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            for t, h, c, i, f, o, z, th, m in reversed(tape):
                dh = dh + into[t]
                own = np.where(m, dh, 0)
                dn = np.where(m, dc, 0) + own * o * (1 - th * th)
                pre[t] = np.concatenate([dn * z * i * (1 - i), dn * c * f * (1 - f), own * th * o * (1 - o), dn * i * (1 - z * z)], axis=1)
                g[name + "h"] += h.T @ pre[t]
                dh = np.where(m, 0, dh) + pre[t] @ self.p[name + "h"].T
                dc = np.where(m, dn * f, dc)
            flat = pre.reshape(-1, 4 * HIDDEN)
            g[name + "x"], g[name + "b"] = x.reshape(-1, INPUT).T @ flat, flat.sum(0)
        return g

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """P(main text) of the blocks of each page; pages of like length are run together."""
        out = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        a = 0
        while a < len(order):
            steps = len(pages[order[min(a + 127, len(order) - 1)]])
            some = order[a:a + max(1, min(128, 40_000 // steps))]
            steps = max(len(pages[k]) for k in some)
            x, mask = np.zeros((steps, len(some), INPUT), np.float32), np.zeros((steps, len(some)), bool)
            for j, k in enumerate(some):
                x[:len(pages[k]), j], mask[:len(pages[k]), j] = pages[k], True
            p = self.forward(x, mask)[0]
            for j, k in enumerate(some):
                out[k] = p[:len(pages[k]), j]
            a += len(some)
        return out


WEIGHTS = os.path.join(os.path.dirname(__file__), "html_labeller.npz")


def trained() -> Labeller:
    """The labeller that ``moiety.llm.html_training`` fitted and stored beside this module."""
    own = Labeller()
    with np.load(WEIGHTS) as stored:
        own.p = {k: stored[k].astype(np.float32) for k in own.p}
    return own


def main_texts(pages: list[str], model: Labeller, tags: dict, paths: dict) -> list[str]:
    """Main text of each page."""
    found = [blocks(p, tags) if p else [] for p in pages]
    bare = [bool(p) and not _TOKEN.search(p) for p in pages]
    shown = model.probabilities([block_vectors(f, paths) if f else np.zeros((0, INPUT), np.float32) for f in found])
    return [" ".join(t for (_, t, _), q in zip(f, p, strict=True) if q >= 0.5 or b) for f, p, b in zip(found, shown, bare, strict=True)]


def _extract(batches, model):
    own, tags, paths = Labeller(), {}, {}
    own.p = model.value
    for batch in batches:
        htmls = batch.column("html").to_pylist()
        texts = [t for i in range(0, len(htmls), 256) for t in main_texts(htmls[i:i + 256], own, tags, paths)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
            pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    model = pages.sparkSession.sparkContext.broadcast((model or trained()).p)
    return pages.select("page_id", "url", "html").mapInArrow(lambda it: _extract(it, model), "page_id long, url string, text string, n_chars long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op2_html_extraction``: the operator over the whole of ``pages``."""
    return extract(C.table(spark, sf_dir, "pages"))
