"""What several operators of this subpackage share: worker caches, numpy hashing, sums of tables, filters of ids."""

from __future__ import annotations

import os
import sys
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moiety.operators.graph import component_stars as connected_components  # noqa: F401
from moiety.sources.scratch import cut, release, scratch_root  # noqa: F401

U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a query.  Arrow batches of long texts are kept small, which bounds what a Python worker holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker: loaded vocabularies are kept there between tasks."""
    return sys.__dict__.setdefault("_moiety_worker_cache", {})


def trim(forget: bool = False) -> None:
    """Hands freed memory back to the system; ``forget`` also empties this worker's tables (kept from other operators)."""
    import ctypes

    import pyarrow as pa

    if forget:
        worker_cache().clear()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


# ---------------------------------------------------------------- hashing

def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser (public domain constants), in place on a copy."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


def text_slices(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Row ranges [i, j) of at most ``limit`` bytes, or of one row."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        out.append((i, j))
        i = j
    return out


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null reads as empty."""
    import pyarrow as pa

    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data, offsets


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) of consecutive texts, and the words before each text.

    Works on pieces of about ``chunk`` bytes that end at white space or a text's end, so that one very long text
    needs no more memory than many short ones, but for its hashes."""
    space, letters = _SPACE, odd_constants(256, 11)
    letters = letters.copy()
    letters[65:91] = letters[97:123]
    base, end = int(offsets[0]), int(offsets[-1])
    hashes, starts_at = [], []
    cuts = np.unique(offsets)
    powers = odd_constants(4096, 23)
    a = base
    while a < end:
        b = min(a + chunk, end)
        if b < end:  # back to a text's end or white space, else on to the next one
            k = int(np.searchsorted(cuts, b, side="right")) - 1
            if cuts[k] > a:
                b = int(cuts[k])
            else:
                back = np.flatnonzero(space[data[a:b]])
                if len(back):
                    b = a + int(back[-1]) + 1
                else:
                    stop = int(cuts[k + 1])
                    while b < stop and not space[data[b]]:
                        b += 1
        part = data[a:b]
        solid = ~space[part]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        inner = cuts[np.searchsorted(cuts, a):np.searchsorted(cuts, b)] - a
        first[inner] |= solid[inner]
        at = np.flatnonzero(first)
        if len(at):
            place = np.arange(len(part), dtype=np.int64)
            place -= np.repeat(at, np.diff(np.append(at, len(part)))) if at[0] == 0 else np.concatenate([np.zeros(at[0], np.int64),
                np.repeat(at, np.diff(np.append(at, len(part))))])
            long = int(place.max()) + 1
            if long > len(powers):
                powers = odd_constants(long, 23)
            value = letters[part]
            value *= powers[place]
            value[~solid] = 0
            hashes.append(mix(np.add.reduceat(value, at)))
            starts_at.append(at + a)
        a = b
    h = np.concatenate(hashes) if hashes else np.zeros(0, U)
    at = np.concatenate(starts_at) if starts_at else np.zeros(0, np.int64)
    return h, np.searchsorted(at, offsets)


SHINGLE = 5
_STEP = odd_constants(64, 37)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles; fewer words: one of the whole sequence; none: empty."""
    words, before = word_hashes(data, offsets)
    n = len(words)
    grams = np.zeros(max(n - k + 1, 0), U)
    for i in range(k):
        grams += words[i:n - k + 1 + i] * _STEP[i] if n >= k else U(0)
    grams = mix(grams) if len(grams) else grams
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(grams[a:b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mix(np.array([np.sum(words[a:b] * _STEP[:b - a], dtype=U) + U(b - a) * _STEP[40]], U)))
        else:
            out.append(np.zeros(0, U))
    return out


def utf8(text) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def env_path(name: str) -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


# ---------------------------------------------------------------- sums of fixed-size tables

def pack_counts(x: np.ndarray) -> bytes:
    """int64 counters as compressed byte planes: mostly small numbers take few bytes."""
    return zlib.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_counts(raw) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def _sum_blocks(batches):
    import pyarrow as pa

    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, b in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            x = unpack_counts(b.as_buffer())
            total[k] = total[k] + x if k in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pack_counts(x) for x in total.values()], pa.binary())], ["block", "counts"])


def summed_table(rows: DataFrame, size: int, blocks: int) -> np.ndarray:
    """Sum of tables of ``size`` counters that tasks left as rows (block, counts, salt): salted first, so no task gets all."""
    kind = "block int, counts binary"
    first = rows.repartition("block", F.pmod("salt", F.lit(16))).select("block", "counts").mapInArrow(_sum_blocks, kind)
    out = np.zeros(size, np.int64)
    width = size // blocks
    for r in first.repartition("block").mapInArrow(_sum_blocks, kind).collect():
        out[r.block * width:(r.block + 1) * width] += unpack_counts(r.counts)
    trim()
    return out


# ---------------------------------------------------------------- which rows to look at again

PART = 1 << 21  #: bits of a part of the table below


def _places(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        h = mix(ids.astype(np.int64).view(U) + U(0x9E3779B97F4A7C15))
    return (h & U(bits - 1)).astype(np.int64), ((h >> U(32)) & U(bits - 1)).astype(np.int64)


def _mark(batches, bits):
    import pyarrow as pa

    for batch in batches:
        at = np.sort(np.concatenate(_places(batch.column(0).to_numpy(zero_copy_only=False), bits)))
        edges = np.flatnonzero(np.diff(at // PART, prepend=-1))
        parts = np.split((at % PART).astype(np.uint32), edges[1:]) if len(edges) else []
        yield pa.RecordBatch.from_arrays([pa.array((at // PART)[edges], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "places"])


def _merge_marks(batches):
    import pyarrow as pa

    marks: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column("part").to_pylist(), batch.column("places"), strict=True):
            marks.setdefault(k, np.zeros(PART, bool))[np.frombuffer(x.as_buffer(), np.uint32)] = True
    yield pa.RecordBatch.from_arrays([pa.array(list(marks), pa.int32()),
        pa.array([np.packbits(m).tobytes() for m in marks.values()], pa.binary())], ["part", "marks"])


def id_filter(ids: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter (2 probes) of the single long column of ``ids``, about ``n`` rows: rows it passes still have to be joined.

    It has 16 bits a row, from 256 kB to 32 MB; beyond 17 million rows it lets more through and nothing else changes."""
    bits = PART
    while bits < 16 * n and bits < 1 << 28:
        bits *= 2
    out = np.zeros(bits // 8, np.uint8)
    for r in ids.mapInArrow(lambda it: _mark(it, bits), "part int, places binary").repartition("part").mapInArrow(_merge_marks,
        "part int, marks binary").collect():
        out[r.part * (PART // 8):(r.part + 1) * (PART // 8)] |= np.frombuffer(bytes(r.marks), np.uint8)
    return out


def passes(marks: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), bool)
    for at in _places(ids, 8 * len(marks)):
        out &= (marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def marked(rows: DataFrame, marks, kept: bool = True, column: str = "doc_id") -> DataFrame:
    """Those ``rows`` whose id passes the broadcast filter ``marks``, or the others; rows without an id do not pass."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ids = batch.column(place)
            there = passes(marks.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ~ids.is_null().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(there == kept))

    place = [c.lower() for c in rows.columns].index(column)
    return rows.mapInArrow(run, rows.schema)


def marks_of(ids: DataFrame):
    """The broadcast filter of the single column of ``ids``, a written table."""
    return ids.sparkSession.sparkContext.broadcast(id_filter(ids, ids.count()))
