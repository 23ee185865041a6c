"""Best-fit packing of documents into sequences, after Martello and Toth's dominance reduction.

How many bins are needed depends only on how many pieces there are of each length, and there are at most ``capacity``
lengths.  The plan is made from that histogram, which is the same size for any corpus:

- Reduction (procedure MTRP, with sets of up to three items, on all equal items at once): for the longest length s,
  {s} is fixed if nothing fits beside it; {s, a} with the longest a that fits, if it fills the bin or no two items fit
  beside s; {s, a, b} if no three fit and every pair that fits is dominated item by item.  A fixed set dominates every
  other that holds s, so some optimal packing has it.
- Best fit on what is left, longest first: each item goes to the fullest sequence that it fits, equal items at once.

Pieces get a number within their length (a count per partition and length, and sums of those), and the plan says for
ranges of such numbers which sequences they go to and where.  No piece is collected, and no task holds a length.

Defined results: null or empty text is one piece, the end id alone.  Documents over the capacity are cut into full
pieces; the last may be shorter.  Rows that repeat a doc_id are packed each.  Sequence numbers have no gaps.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moiety.llm import common as C
from moiety.llm import tokens

CAPACITY = 4096


class Plan:
    """Ranges of equal pieces: (length, first number, first sequence, place in it, pieces)."""

    def __init__(self):
        self.rows, self.next, self.bins = [], {}, 0

    def put(self, length, n, bin_, offset):
        first = self.next.get(length, 0)
        self.rows.append((length, first, bin_, offset, n))
        self.next[length] = first + n

    def open(self, n):
        self.bins += n
        return self.bins - n

    def arrays(self):
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        return rows[:, 0] << 44 | rows[:, 1], rows[:, 1], rows[:, 2], rows[:, 3]


def _largest(counts, most, *without):
    """The largest length up to ``most`` of which a piece is left besides those in ``without``."""
    k = most
    while k > 0:
        some = np.flatnonzero(counts[1:k + 1])
        if not len(some):
            return 0
        k = int(some[-1]) + 1
        if counts[k] > without.count(k):
            return k
        k -= 1
    return 0


def reduce_by_dominance(counts: np.ndarray, capacity: int, plan: Plan) -> None:
    """Fixes dominating sets and takes their pieces out of ``counts``."""
    for s in range(capacity, 0, -1):
        while counts[s]:
            room = capacity - s
            small = []  # the three shortest other pieces
            for k in np.flatnonzero(counts[:room + 1])[:4].tolist():
                small += [k] * int(min(3, counts[k] - (k == s)))
            small = small[:3]
            if not small:
                n = int(counts[s])
                plan.put(s, n, plan.open(n), 0)
                counts[s] = 0
                break
            a = _largest(counts, room, s)
            chosen = None
            if a == room or len(small) < 2 or small[0] + small[1] > room:
                chosen = [s, a]
            elif len(small) < 3 or sum(small) > room:
                b = _largest(counts, room - a, s, a)
                left = counts.copy()
                left[s] -= 1
                sizes = np.flatnonzero(left[:room + 1])
                above = np.append(sizes[1:], capacity + 1)
                partner = np.where(left[sizes] > 1, sizes, above)
                pairs = sizes[partner + sizes <= room]
                if b and (not len(pairs) or int(pairs[-1]) <= b):
                    chosen = [s, a, b]
            if not chosen:
                break
            n = min(int(counts[k]) // chosen.count(k) for k in chosen)
            first, at = plan.open(n), 0
            for k in chosen:
                plan.put(k, n, first, at)
                counts[k] -= n
                at += k


def best_fit(counts: np.ndarray, capacity: int, plan: Plan) -> None:
    """Best fit, longest first; groups of sequences that are filled alike move together."""
    groups: dict[int, list[tuple[int, int]]] = {}
    rooms = np.zeros(capacity + 1, bool)
    for s in np.flatnonzero(counts)[::-1].tolist():
        c = int(counts[s])
        while c:
            fits = np.flatnonzero(rooms[s:])
            if len(fits):
                room = int(fits[0]) + s
                first, n = groups[room].pop()
            else:
                room, n = capacity, -(-c // (capacity // s))
                first = plan.open(n)
            k = min(room // s, c)
            m = min(n, c // k)
            for j in range(k):
                plan.put(s, m, first, capacity - room + j * s)
            c -= k * m
            for rest, f, g in ((room - k * s, first, m), (room, first + m, n - m)):
                if g and rest:
                    groups.setdefault(rest, []).append((f, g))
            for r in (room, room - k * s):
                rooms[r] = bool(groups.get(r))
        counts[s] = 0


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    counts = np.zeros(capacity + 1, np.int64)
    for k, n in histogram.items():
        counts[k] = n
    plan = Plan()
    reduce_by_dominance(counts, capacity, plan)
    best_fit(counts, capacity, plan)
    return plan


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"


def _pieces(batches, path, end_id, capacity):
    """Pieces with their number within their length in this partition."""
    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for kept, ids, n in tokens.encoded_rows(batches, path, end_id, ["doc_id"]):
        pieces = -(-n // capacity)
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        length = np.minimum(n[row] - start, capacity)
        at = (np.cumsum(n) - n)[row] + start
        data = memoryview(ids.astype("<u4")).cast("B")
        crc = [zlib.crc32(data[4 * a:4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
        order = np.argsort(length, kind="stable")
        sorted_ = length[order]
        new = np.flatnonzero(np.diff(sorted_, prepend=-1))
        runs = np.diff(np.append(new, len(sorted_)))
        number = np.empty(len(row), np.int64)
        number[order] = np.arange(len(row)) - np.repeat(new, runs) + seen[sorted_]
        seen[sorted_[new]] += runs
        docs = np.array(kept["doc_id"], object)[row].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
            pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(number)],
            [x.split()[0] for x in _PIECES.split(", ")])


def _place(batches, plan):
    keys, firsts, bins, offsets = plan.value
    for batch in batches:
        length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
        k = np.searchsorted(keys, length << 44 | number, side="right") - 1
        out = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays([*out, pa.array(bins[k] + number - firsts[k]), pa.array(offsets[k])],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    pieces = C.cut(docs.select("doc_id", "text").mapInArrow(lambda it: _pieces(it, path, end_id, capacity), _PIECES))
    counts = C.cut(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = spark.sparkContext.broadcast(make_plan(histogram, capacity).arrays())  # ranges of equal pieces: bounded by the lengths, not the rows
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    numbered = pieces.join(before, ["part", "length"]).withColumn("number", F.col("number") + F.col("before"))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(lambda it: _place(it, plan),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op5_best_fit_packing``: the operator over the whole of ``documents`` at 4096 tokens."""
    return pack(C.table(spark, sf_dir, "documents"), C.env_path("word_bpe_49k.json"))
