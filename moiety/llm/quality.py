"""Quality classifier: a linear-chain conditional random field marks every line of a document good or bad.

A line is described by counts of its bytes and words (upper case, digits, symbols, words repeated in a row, sentence
ends, ...), each put into a few bins (lengths at the training sample's quantiles), for itself, the line before and the line
after.  The field has a weight for each bin and for each pair of neighbouring labels.  Forward-backward gives every
line's marginal; their mean, weighted by line length, is the document's quality, which a logistic curve fitted on the
same sample turns into the probability of label 1.

Lines carry no labels of their own: in training all lines of a document have the document's label.  The field is
fitted on a sample of at most ``most_docs`` labelled documents (those with the smallest hash of their doc_id, folds with
crc32(doc_id) mod 5 = 0 left out); features of these documents alone come to the driver.  Labels, lang, source and
doc_id are no inputs of a score.  Scoring reads every whole text, in one pass, without a shuffle.

Defined results: null or empty text counts as one empty line and gets a score like any other.  A doc_id with several labels
takes the smallest.  Without labels of both kinds every score is 0.5.  Rows that repeat are scored each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moiety.llm import common as C

BINS, SLICE = 8, 1 << 20
SHARES = (0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.8)  #: bounds of the bins of features that are shares
THRESHOLD = 0.3
NAMES = ("bytes", "words", "upper", "digits", "high", "hashes", "pipes", "bangs", "stops", "other", "odd_ends", "repeats", "word_bytes",
    "ends_well", "starts_upper", "same_line")


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[list(chars)] = 1
    return t


_UPPER, _LOWER, _DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(b"0123456789")
_HASH, _PIPE, _BANG, _STOP = _table(b"#$%&*@^~=+_\\<>{}[]"), _table(b"|"), _table(b"!?"), _table(b".,;:'\"()-")
_HIGH = _table(bytes(range(128, 256)))
_OTHER = _table(bytes(set(range(33, 127)) - {i for t in (_UPPER, _LOWER, _DIGIT, _HASH, _PIPE, _BANG,
    _STOP) for i in np.flatnonzero(t).tolist()} | set(range(9)) | set(range(14, 32)) | {127}))


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x NAMES, float32), bytes of each line, and lines before each text; data[offsets[0]:offsets[-1]] holds the texts."""
    base = int(offsets[0])
    part = data[base:int(offsets[-1])]
    breaks = np.flatnonzero(part == 10) + 1
    starts = np.unique(np.concatenate([breaks[breaks < len(part)], offsets[:-1] - base]))
    starts = starts[starts < len(part)]
    if not len(part):
        starts = np.zeros(0, np.int64)
    edges = np.append(starts, len(part))
    n = np.diff(edges).astype(np.float32)
    n_lines = len(starts)
    before = np.searchsorted(starts, offsets - base)
    if not n_lines:
        return np.zeros((0, len(NAMES)), np.float32), np.zeros(0, np.float32), before
    total = lambda t: np.add.reduceat(t[part].astype(np.int32), starts).astype(np.float32)
    size = np.maximum(n, 1)
    upper, lower, high = total(_UPPER), total(_LOWER), total(_HIGH)
    letters = np.maximum(upper + lower + high, 1)
    words, first = C.word_hashes(part, edges)
    count = np.diff(first).astype(np.float32)
    many = np.maximum(count, 1)
    line_of = np.repeat(np.arange(n_lines), np.diff(first))
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (line_of[1:] == line_of[:-1])
    repeats = np.bincount(line_of, again, n_lines)
    space = C._SPACE[part]
    last = np.zeros(len(part), bool)  # last byte of a word
    last[:-1] = ~space[:-1] & space[1:]
    last[edges[1:] - 1] = ~space[edges[1:] - 1]
    odd = np.add.reduceat((last & ((_HASH | _BANG | _PIPE)[part] > 0)).astype(np.int32), starts)
    solid = np.where(space, -1, np.arange(len(part)))
    ends = part[np.maximum(np.maximum.reduceat(solid, starts), 0)]
    heads = part[starts]
    with np.errstate(over="ignore"):
        keyed = words * C.odd_constants(1, 5)[0]
        line_hash = np.add.reduceat(np.append(keyed, np.uint64(0)), np.minimum(first[:-1], len(keyed))) if len(keyed) else np.zeros(n_lines, np.uint64)
    same = np.zeros(n_lines, np.float32)
    same[1:] = (line_hash[1:] == line_hash[:-1]) & (count[1:] > 0)
    out = np.stack([np.log1p(n), np.log1p(count), upper / letters, total(_DIGIT) / size, high / letters, total(_HASH) / size,
        total(_PIPE) / size, total(_BANG) / size, total(_STOP) / size, total(_OTHER) / size, odd / many, repeats / many,
        (size - count) / many, np.isin(ends, np.frombuffer(b".!?\"", np.uint8)), _UPPER[heads] | _HIGH[heads], same],
        axis=1).astype(np.float32)
    return out, n, before


class Field:
    """Two labels (0 bad, 1 good); weights of good against bad for each bin of each feature of three lines."""

    def __init__(self, cuts):
        self.cuts = cuts  # features x (BINS - 1)
        self.w = np.zeros((3, len(NAMES), BINS))
        self.step, self.first, self.curve = np.zeros((2, 2)), np.zeros(2), np.array([1.0, 0.0])

    def bins(self, x):
        return np.stack([np.searchsorted(self.cuts[k], x[:, k], side="right") for k in range(x.shape[1])], axis=1)

    def emissions(self, bins, before):
        """Score of good of each line; neighbours beyond the document's ends add nothing."""
        k = np.arange(bins.shape[1])
        own, prev, next_ = (w[k, bins].sum(axis=1) for w in self.w)
        u = own.copy()
        starts = before[:-1][np.diff(before) > 0]
        is_start = np.zeros(len(u), bool)
        is_start[starts] = True
        is_end = np.append(is_start[1:], True)
        u[1:] += np.where(is_start[1:], 0, prev[:-1])
        u[:-1] += np.where(is_end[:-1], 0, next_[1:])
        return u, is_start, is_end

    def marginals(self, u, before):
        """P(good) of each line, expected pair counts, and the log of the normaliser, by forward-backward over all documents at once."""
        n = np.diff(before)
        order = np.argsort(-n, kind="stable")
        lengths, at = n[order], before[:-1][order]
        longest = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")  # documents with a line t
        alpha, beta = np.zeros((len(u), 2)), np.zeros((len(u), 2))
        pairs = np.zeros((2, 2))
        for t in range(longest):
            i = at[:active[t]] + t
            a = self.first + np.zeros((len(i), 2)) if t == 0 else np.logaddexp(alpha[i - 1, :1] + self.step[0], alpha[i - 1, 1:] + self.step[1])
            a[:, 1] += u[i]
            alpha[i] = a
        for t in range(longest - 2, -1, -1):
            i = at[:active[t + 1]] + t
            b = beta[i + 1].copy()
            b[:, 1] += u[i + 1]
            beta[i] = np.logaddexp(self.step[:, 0] + b[:, :1], self.step[:, 1] + b[:, 1:])
        log = alpha + beta
        z = np.logaddexp(log[:, 0], log[:, 1])
        good = np.exp(log[:, 1] - z)
        inner = np.ones(len(u), bool)
        inner[before[:-1][n > 0]] = False
        i = np.flatnonzero(inner)
        for p in (0, 1):
            for q in (0, 1):
                pairs[p, q] = np.exp(alpha[i - 1, p] + self.step[p, q] + u[i] * q + beta[i, q] - z[i]).sum()
        return good, pairs

    def document_means(self, good, n, before):
        weight = np.concatenate([[0.0], np.cumsum(np.maximum(n, 1))])
        total = np.concatenate([[0.0], np.cumsum(good * np.maximum(n, 1))])
        size = weight[before[1:]] - weight[before[:-1]]
        return np.where(size > 0, (total[before[1:]] - total[before[:-1]]) / np.maximum(size, 1), 0.5)

    def scores(self, x, n, before):
        if not self.w.any():
            return np.full(len(before) - 1, 0.5)
        u, _, _ = self.emissions(self.bins(x), before)
        mean = self.document_means(self.marginals(u, before)[0], n, before)
        mean = np.clip(mean, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.curve[0] * np.log(mean / (1 - mean)) + self.curve[1])))


def fit(x, n, before, labels, rounds: int = 200, rate: float = 0.1, l2: float = 5e-5) -> Field:
    """Maximum likelihood by Adam, every document with the same weight, and the logistic curve after it."""
    cuts = np.stack([np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1]) for k in range(x.shape[1])]) if len(x) else np.zeros((len(NAMES), BINS - 1))
    for k, name in enumerate(NAMES):
        if name not in ("bytes", "words", "word_bytes"):  # shares: the same bins for every sample
            cuts[k] = SHARES
    field = Field(cuts)
    if len(set(labels.tolist())) < 2:
        return field
    bins = field.bins(x)
    lines = np.diff(before)
    y = np.repeat(labels, lines).astype(float)
    weight = np.repeat(1 / np.maximum(lines, 1), lines)
    k = np.arange(bins.shape[1])
    flat = bins + k * BINS
    size, first = 3 * bins.shape[1] * BINS, None
    m, v = np.zeros(size + 6), np.zeros(size + 6)
    theta = np.zeros(size + 6)
    docs = len(labels)
    inner = np.ones(len(y), bool)
    inner[before[:-1][lines > 0]] = False
    i = np.flatnonzero(inner)
    for r in range(1, rounds + 1):
        field.w = theta[:size].reshape(field.w.shape)
        field.step, field.first = theta[size:size + 4].reshape(2, 2), theta[size + 4:]
        u, is_start, is_end = field.emissions(bins, before)
        good, pairs = field.marginals(u, before)
        d = (y - good) * weight
        shifted = [d, np.append(np.where(is_start[1:], 0, d[1:]), 0), np.append(0, np.where(is_end[:-1], 0, d[:-1]))]
        gw = np.concatenate([np.bincount(flat.ravel(), np.repeat(s, bins.shape[1]), bins.shape[1] * BINS) for s in shifted])
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[i - 1].astype(int), y[i].astype(int)), 1)
        starts = np.flatnonzero(is_start)
        gs = (seen - pairs) * (docs / max(len(y), 1))
        gf = np.array([(1 - y[starts]).sum() - (1 - good[starts]).sum(), y[starts].sum() - good[starts].sum()])
        g = np.concatenate([gw, gs.ravel(), gf]) / docs - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9 ** r)) / (np.sqrt(v / (1 - 0.999 ** r)) + 1e-8)
    field.w = theta[:size].reshape(field.w.shape)
    field.step, field.first = theta[size:size + 4].reshape(2, 2), theta[size + 4:]
    u, _, _ = field.emissions(bins, before)
    mean = np.clip(field.document_means(field.marginals(u, before)[0], n, before), 1e-4, 1 - 1e-4)
    s, a, b = np.log(mean / (1 - mean)), 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic curve
        p = 1 / (1 + np.exp(-(a * s + b)))
        q = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * s * s).sum() + 1e-2, (q * s).sum()], [(q * s).sum(), q.sum() + 1e-2]])
        step = np.linalg.solve(h, np.array([((labels - p) * s).sum() - 1e-2 * (a - 1), (labels - p).sum() - 1e-2 * b]))
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    field.curve = np.array([max(a, 1e-3), b])
    return field


def _described(batches):
    """Slices of a batch with their line features; an empty text gets one empty line."""
    C.trim(forget=True)
    for batch in batches:
        column = pa.compute.if_else(pa.compute.equal(pa.compute.binary_length(batch.column("text").fill_null("")), 0), "\n", batch.column("text"))
        data, offsets = C.column_bytes(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
        for i, j in C.text_slices(offsets, SLICE):
            yield batch.slice(i, j - i), *line_features(data, offsets[i:j + 1])
    C.trim()


def _sample_features(batches):
    for part, x, n, before in _described(batches):
        ends = before * len(NAMES)
        flat = x.reshape(-1)
        yield pa.RecordBatch.from_arrays([part.column("label"),
            pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
            pa.array([n[a:b].tobytes() for a, b in zip(before[:-1], before[1:], strict=True)], pa.binary())], ["label", "x", "n"])


def train(docs: DataFrame, labels: DataFrame, held_out: int | None = 0, most_docs: int = 3000, most_bytes: int = 1 << 18) -> Field:
    """Fits the field on a sample of labelled documents; ``held_out`` is the fold (of 5) left out.

    The sample is bounded: ``most_docs`` doc_ids by hash, of each one row (the first by the hash of its text), and none of
    texts over ``most_bytes``, which are scored like any other but not fitted on."""
    named = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    if held_out is not None:
        named = named.where(F.crc32(F.col("doc_id").cast("string")) % 5 != held_out)
    sample = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    short = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    rows = short.join(F.broadcast(sample),
        "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("x")).select("x.text",
        "x.label")  # most_docs rows
    got = rows.mapInArrow(_sample_features, "label int, x binary, n binary").toPandas()
    if not len(got):
        return Field(np.zeros((len(NAMES), BINS - 1)))
    got = got.sort_values(["label", "x"], kind="stable")
    n = [np.frombuffer(b, np.float32) for b in got.n]
    x = np.frombuffer(b"".join(got.x), np.float32).reshape(-1, len(NAMES))
    before = np.concatenate([[0], np.cumsum([len(k) for k in n])])
    field = fit(x, np.concatenate(n), before, got.label.to_numpy(float))
    C.trim()
    return field


def _score(batches, field):
    for part, x, n, before in _described(batches):
        s = field.value.scores(x, n, before)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"),
            pa.array([None if i is None else zlib.crc32(str(i).encode()) % 5 == 0 for i in part.column("doc_id").to_pylist()], pa.bool_()),
            pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def score(docs: DataFrame, labels: DataFrame, held_out: int | None = 0, most_docs: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    field = docs.sparkSession.sparkContext.broadcast(train(docs, labels, held_out, most_docs))
    return docs.select("doc_id", "text").mapInArrow(lambda it: _score(it, field), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, most_docs: int = 3000) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns; the model is fitted as for ``score``."""
    field = docs.sparkSession.sparkContext.broadcast(train(docs, labels, 0, most_docs))
    names = docs.columns

    def kept(batches):
        for part, x, n, before in _described(batches):
            yield part.filter(pa.array(field.value.scores(x, n, before) >= THRESHOLD)).select(names)

    return docs.mapInArrow(kept, docs.schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op8_quality_classifier``: the operator over the whole of ``documents``."""
    return score(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
