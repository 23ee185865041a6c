"""Suffix-array dedup by prefix-free parsing: bytes of repeated 50-byte strings are removed from later documents.

A byte goes if a ``length``-byte string that covers it also starts in a document with a smaller doc_id.  Strings never
cross documents and are judged on the input.

1. Triggers.  A rolling hash of every ``trigger``-byte window picks, for each string of ``length`` bytes, the least
   window inside it (leftmost if equal), so every string has one trigger and equal strings have the same one at the
   same place.  A trigger with all the bytes that its strings can reach is a phrase; phrases overlap, so no string is
   cut, and which strings belong to a phrase follows from its bytes alone.
2. Parse.  Each document becomes its sequence of phrases (40 bits of the trigger hash, 64 of the phrase hash).  One sort by trigger, phrase and
   document brings equal phrases together.  A trigger met in one document only is done.  A phrase that an earlier
   document has too goes whole, without its strings being looked at: highly repetitive text costs one entry a phrase.
3. Dictionary.  What is left are the first occurrences of phrases whose trigger stands in several different phrases.
   Their bytes are fetched, and the suffixes of these dictionary phrases that are ``length`` bytes or longer are sorted
   by their first ``length`` bytes: a suffix array of the dictionary, cut at that length.  Neighbours that agree are the
   same string, and the smallest document among them is known.  With the parse's order this gives the order of all
   strings of the corpus that can repeat, one bucket of triggers at a time; no array of the whole corpus is built.
4. The ranges found for a document are laid over its bytes.

Texts that are equal as a whole are settled beforehand by their SHA-256.  Within a batch only the smallest document
with a phrase is sent on, so a passage in a third of all documents costs one entry a batch and not one a document.

Defined results: null text is empty.  Fewer than ``length`` bytes: nothing goes.  Rows that repeat a doc_id do not
remove each other's bytes; both are removed from later documents.  Rows without a doc_id have no order: they lose nothing and
remove nothing.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moiety.llm import common as C
from moiety.llm.line_dedup import free_name

LENGTH, TRIGGER = 50, 24
SEGMENT = 1 << 18  #: windows looked at together
U = np.uint64
LOW = U((1 << 31) - 1)


def _segments(rows, length):
    """(row, first window, windows) in lots of about SEGMENT windows; a long document is cut, with its context kept."""
    lot, size = [], 0
    for k, b in enumerate(rows):
        n = len(b) - length + 1
        for a in range(0, max(n, 0), SEGMENT):
            m = min(SEGMENT, n - a)
            if size + m > SEGMENT and lot:
                yield lot
                lot, size = [], 0
            lot.append((k, a, m))
            size += m + length
    if lot:
        yield lot


def phrases(rows: list[bytes], length: int = LENGTH, trigger: int = TRIGGER):
    """For lots of rows: arrays of row, first string's place, further strings, trigger hash and phrase hash."""
    if trigger != 24 or length < 50 or length > 64:
        raise ValueError("the rolling hashes are composed for triggers of 24 bytes and strings of 50 to 64")
    reach = length - trigger + 1
    pad, symbols = reach - 1, C.odd_constants(257, 3)
    step = C.odd_constants(16, 91)
    for lot in _segments(rows, length):
        size = sum(m + length - 1 + 2 * pad for _, _, m in lot)
        code = np.full(size, 256, np.int16)
        at, row, first = 0, np.empty(len(lot), np.int64), np.empty(len(lot), np.int64)
        starts, counts = np.empty(len(lot), np.int64), np.empty(len(lot), np.int64)
        for i, (k, a, m) in enumerate(lot):
            b, z = rows[k], a + m + length - 1 + pad
            lo = max(0, a - pad)
            part = np.frombuffer(b, np.uint8, min(len(b), z) - lo, lo)
            code[at + pad - (a - lo):at + pad - (a - lo) + len(part)] = part
            row[i], first[i], starts[i], counts[i] = k, a, at + pad, m
            at += m + length - 1 + 2 * pad
        h1 = symbols[code]
        h, n = {1: h1}, 1
        while n < 32:
            g = h[n]
            h[2 * n] = g[:len(g) - n] * step[n.bit_length()] + g[n:]
            n *= 2
        gram = C.mix(h[16][:size - 23] * step[9] + h[8][16:16 + size - 23])
        least = (gram & ~LOW) | np.arange(len(gram), dtype=U)
        n = 1
        while 2 * n <= reach:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        if n < reach:
            least = np.minimum(least[:len(least) - (reach - n)], least[reach - n:])
        window = np.concatenate([np.arange(s, s + m) for s, m in zip(starts, counts, strict=True)])
        of = np.repeat(np.arange(len(lot)), counts)
        t = (least[window] & LOW).astype(np.int64)
        new = np.flatnonzero((np.diff(t, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
        more = np.diff(np.append(new, len(t))) - 1
        of, t, window = of[new], t[new], window[new]
        left = t - pad  # the phrase: pad bytes before the trigger, and ``length`` from its start on
        tail = length - (32 - pad) - 32
        whole = h[32][left] * step[10] + h[32][left + 32] * step[11]
        rest = left + 64
        for n in (16, 8, 4, 2, 1):
            if (tail) & n:
                whole = whole * step[12] + h[n][rest]
                rest = rest + n
        yield row[of], window - starts[of] + first[of], more, C.mix(gram[t] + U(1)), C.mix(whole)


def _binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of an array as an Arrow binary column; ends in elements, the first is 0."""
    flat = np.ascontiguousarray(flat)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])


def _planes(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices as binary, each as differences with all lowest bytes first, then the next: what a compressor likes."""
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        d = np.diff(x[a:b], prepend=np.zeros(1, x.dtype))
        out.append(d.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())
    return pa.array(out, pa.binary())


def _unplane(raw, kind) -> np.ndarray:
    raw = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).reshape(-1).view(kind), dtype=kind)


def _by_row(doc, tag, *flat):
    """Packs arrays by (doc, tag): keys and one binary column for each array."""
    order = np.lexsort((tag, doc))
    doc, tag = doc[order], tag[order]
    new = np.flatnonzero((np.diff(doc, prepend=doc[0] - 1) != 0) | (np.diff(tag, prepend=tag[0] - 1) != 0))
    ends = np.append(new, len(doc))
    return [pa.array(doc[new]), pa.array(tag[new]), *(_binary(x[order], ends) for x in flat)]


_PARSED = "bucket int, trigger binary, phrase binary, doc binary, tag binary, place binary, more binary, doc_id long, row_tag long, gone binary"
_NAMES = [x.split()[0] for x in _PARSED.split(", ")]


def _gone_rows(doc, tag, place, more, names, kinds):
    if not len(doc):
        return None
    cols = _by_row(doc, tag, (place << 8) | more)
    n = len(cols[0])
    return pa.RecordBatch.from_arrays([pa.nulls(n, k) for k in kinds] + cols, names)


def _parse(batches, n_buckets):
    """Packed parse entries by bucket of trigger; ranges that an earlier document of the same batch has already."""
    C.trim(forget=True)
    blob = [pa.int32()] + [pa.binary()] * 6
    with np.errstate(over="ignore"):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            tags = batch.column("tag").to_numpy(zero_copy_only=False).astype(np.int64)
            rows = [memoryview(x.as_buffer()) if x.is_valid else b"" for x in batch.column("text")]
            lots, held = [], 0

            def flush(lots, ids, tags):
                row, place, more, trigger, phrase = map(np.concatenate, zip(*lots, strict=True))
                lots.clear()
                doc, tag = ids[row], tags[row]
                key = trigger ^ (phrase * U(0x9E3779B97F4A7C15))
                order = np.lexsort((doc, key))
                new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (phrase[order][1:] != phrase[order][:-1])])
                first = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
                later = doc[order] > first
                gone, order = order[later], order[~later]
                if len(gone):
                    yield _gone_rows(doc[gone], tag[gone], place[gone], more[gone], _NAMES, blob)
                order = np.sort(order)
                bucket = ((trigger[order] >> U(48)) % U(n_buckets)).astype(np.int64)
                order = order[np.argsort(bucket, kind="stable")]
                bucket = np.sort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(edges, len(order))
                five = (trigger[order] & U(0xFFFFFFFFFF)).view(np.uint8).reshape(-1, 8)[:, :5].reshape(-1)
                packed = [_binary(five, ends * 5), _binary(phrase[order], ends), _planes(doc[order], ends), _planes(tag[order], ends),
                    _planes(place[order].astype(np.uint32), ends), _binary(more[order].astype(np.uint8), ends)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edges], pa.int32()), *packed, pa.nulls(len(edges), pa.int64()),
                    pa.nulls(len(edges), pa.int64()), pa.nulls(len(edges), pa.binary())], _NAMES)

            for lot in phrases(rows):
                lots.append(lot)
                held += len(lot[0])
                if held > 400_000:
                    yield from flush(lots, ids, tags)
                    held = 0
            if lots:
                yield from flush(lots, ids, tags)
        C.trim()


def _gather(batches, kinds):
    got = {k: [] for k in kinds}
    for batch in batches:
        for k, kind in kinds.items():
            got[k] += [np.frombuffer(x.as_buffer(), kind) for x in batch.column(k)]
    return [np.concatenate(got[k]) if got[k] else np.zeros(0, kind) for k, kind in kinds.items()]


_FOUND = "doc_id long, row_tag long, gone binary, asked binary, trigger binary"


def _sort_parse(batches):
    """Ranges that an earlier document has; phrases whose strings the dictionary has to settle."""
    kinds = {"trigger": np.uint8, "phrase": U, "doc": np.int64, "tag": np.int64, "place": np.uint32, "more": np.uint8}
    got = {k: [] for k in kinds}
    for batch in batches:
        ready = batch.column("bucket").is_null()
        if batch.num_rows > ready.true_count:
            rest = batch.filter(pc.invert(ready))
            for k, kind in kinds.items():
                read = _unplane if k in ("doc", "tag", "place") else np.frombuffer
                got[k] += [read(x.as_buffer(), kind) for x in rest.column(k)]
        if ready.true_count:  # found within a batch already
            batch = batch.filter(ready)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "row_tag", "gone")] + [pa.nulls(batch.num_rows,
                pa.binary())] * 2, ["doc_id", "row_tag", "gone", "asked", "trigger"])
    five, phrase, doc, tag, place, more = (np.concatenate(got.pop(k)) if got[k] else np.zeros(0, kind) for k, kind in kinds.items())
    if not len(phrase):
        return
    C.trim(forget=True)
    trigger = np.zeros((len(phrase), 8), np.uint8)
    trigger[:, :5] = five.reshape(-1, 5)
    trigger = trigger.reshape(-1).view(U)
    del five
    once = np.argsort(trigger, kind="stable")  # most triggers stand in one document
    t, d = trigger[once], doc[once]
    new = np.concatenate([[True], t[1:] != t[:-1]])
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    shared = np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at)
    keep = once[shared[group]]
    if not len(keep):
        return
    trigger, phrase, doc, tag, place, more = (x[keep] for x in (trigger, phrase, doc, tag, place, more))
    order = np.lexsort((doc, phrase, trigger))
    trigger, phrase, doc, tag, place, more = (x[order] for x in (trigger, phrase, doc, tag, place, more))
    new_t = np.concatenate([[True], trigger[1:] != trigger[:-1]])
    new_p = new_t | np.concatenate([[True], phrase[1:] != phrase[:-1]])
    first = doc[np.flatnonzero(new_p)][np.cumsum(new_p) - 1]
    several = np.bincount(np.cumsum(new_t) - 1, new_p)[np.cumsum(new_t) - 1] > 1
    gone, asked = doc > first, (doc == first) & several
    ranges = (place.astype(np.int64) << 8) | more
    if gone.any():
        cols = _by_row(doc[gone], tag[gone], ranges[gone])
        yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(cols[0]), pa.binary()), pa.nulls(len(cols[0]), pa.binary())],
            ["doc_id", "row_tag", "gone", "asked", "trigger"])
    if asked.any():
        cols = _by_row(doc[asked], tag[asked], ranges[asked], trigger[asked])
        yield pa.RecordBatch.from_arrays([*cols[:2], pa.nulls(len(cols[0]), pa.binary()), *cols[2:]], ["doc_id", "row_tag", "gone", "asked", "trigger"])


def _fetch(batches, n_buckets, length):
    """Bytes of the asked phrases, packed by bucket of trigger."""
    for batch in batches:
        out = []
        for doc, tag, text, asked, triggers in zip(batch.column("doc_id").to_pylist(), batch.column("row_tag").to_pylist(),
            batch.column("text"), batch.column("asked"), batch.column("triggers"), strict=True):
            text = text.as_buffer().to_pybytes() if text.is_valid else b""
            ranges = np.concatenate([np.frombuffer(x, np.int64) for x in asked.as_py()])
            trigger = np.concatenate([np.frombuffer(x, U) for x in triggers.as_py()])
            place, more = ranges >> 8, ranges & 255
            bytes_ = [text[p:p + m + length] for p, m in zip(place.tolist(), more.tolist(), strict=True)]
            out.append((np.full(len(place), doc), np.full(len(place), tag), place, more, trigger, bytes_))
        if not out:
            continue
        doc, tag, place, more, trigger = (np.concatenate([x[k] for x in out]) for k in range(5))
        parts = np.array([b for x in out for b in x[5]], object)
        bucket = (C.mix(trigger) % U(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        ends = np.append(edges, len(order))
        cols = [_binary(x[order], ends) for x in (doc, tag, place.astype(np.uint32), more.astype(np.uint8), trigger)]
        joined = pa.array([b"".join(parts[order[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[order[edges]], pa.int32()), *cols, joined],
            ["bucket", "doc", "tag", "place", "more", "trigger", "bytes"])


def repeated_suffixes(text: np.ndarray, starts: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the suffixes of ``text`` at ``starts`` have a neighbour of a smaller document in the suffix array cut at ``length``."""
    words = -(-length // 8)
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    rows = np.zeros((len(starts), words * 8), np.uint8)
    rows[:, :length] = view[starts]
    keys = rows.view(">u8").astype(U)
    order = np.lexsort((doc, *keys.T[::-1]))
    keys, doc = keys[order], doc[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
    smallest = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.zeros(len(starts), bool)
    out[order] = doc > smallest
    return out


def _dictionary(batches, length, lot=200_000):
    """Settles the strings of the asked phrases, some triggers at a time."""
    doc, tag, place, more, trigger, text = _gather(batches,
        {"doc": np.int64, "tag": np.int64, "place": np.uint32, "more": np.uint8, "trigger": U, "bytes": np.uint8})
    if not len(doc):
        return
    C.trim(forget=True)
    sizes = more.astype(np.int64) + length
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    order = np.argsort(trigger, kind="stable")
    strings = np.cumsum(more[order].astype(np.int64) + 1)
    a = 0
    while a < len(order):
        b = int(np.searchsorted(strings, (strings[a - 1] if a else 0) + lot, side="right"))
        b = max(b, a + 1)
        last = trigger[order[min(b, len(order)) - 1]]
        b = int(np.searchsorted(trigger[order], last, side="right")) if b < len(order) else len(order)
        some = order[a:b]
        n = more[some].astype(np.int64) + 1
        of = np.repeat(some, n)
        shift = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        found = repeated_suffixes(text, begins[of] + shift, doc[of], length)
        if found.any():
            of, at = of[found], place[of[found]].astype(np.int64) + shift[found]
            cols = _by_row(doc[of], tag[of], at << 8)
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row_tag", "gone"])
        a = b
    C.trim()


def kept_bytes(text: bytes, lists, length: int) -> tuple[bytes, int, int]:
    """What is left of a text without the bytes of its ranges; how many go, and in how many runs."""
    ranges = np.concatenate([np.frombuffer(x, np.int64) for x in lists])
    place, more = ranges >> 8, ranges & 255
    depth = np.zeros(len(text) + 1, np.int32)
    np.add.at(depth, place, 1)
    np.add.at(depth, place + more + length, -1)
    gone = np.cumsum(depth[:-1]) > 0
    spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def _lay(batches, length):
    """Lays the ranges over the bytes."""
    for batch in batches:
        out = []
        for text, lists in zip(batch.column("text"), batch.column("gone"), strict=True):
            kept, n, spans = kept_bytes(text.as_buffer().to_pybytes() if text.is_valid else b"", lists.as_py(), length)
            out.append((n, spans, hashlib.sha256(kept).hexdigest()))
        n, s, h = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_tag"), pa.array(n, pa.int64()), pa.array(s, pa.int64()),
            pa.array(h, pa.string())], ["doc_id", "row_tag", "n_removed", "n_spans", "kept_sha256"])
    C.trim()


EMPTY = hashlib.sha256(b"").hexdigest()


SHARE = 24 << 20  #: bytes of text whose parse is one task's work


def _found(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, tagged, ranges): rows (doc_id, text, row_tag), what is known of each as a whole, and its ranges that go."""
    spark = docs.sparkSession
    n = C.partitions(spark)
    rows = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.xxhash64("text").alias("row_tag"))
    info = C.cut(rows.select("doc_id", "row_tag", F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")))
    firsts = info.groupBy("sha").agg(F.min("doc_id").alias("first"))
    tagged = C.cut(info.join(firsts, "sha"))
    # entries name a row by doc_id alone, unless a doc_id has several texts
    several = bool(info.groupBy("doc_id").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).where("a <> b").head(1))
    if not several:
        rows, tagged = (x.withColumn("row_tag", F.lit(0).cast("long")) for x in (rows, tagged))
    alone = tagged.where(F.col("doc_id") == F.col("first")).select("doc_id", "row_tag").distinct()
    total = info.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(2 * n, -(-total // SHARE))
    parsed = rows.withColumnRenamed("row_tag", "tag").mapInArrow(lambda it: _parse(it, buckets), _PARSED)
    found = C.cut(parsed.repartition(buckets,
        F.coalesce("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))).mapInArrow(_sort_parse, _FOUND), free=True)
    gone = found.where("gone is not null").select("doc_id", "row_tag", "gone")
    asked = found.where("asked is not null").groupBy("doc_id", "row_tag").agg(F.collect_list("asked").alias("asked"),
        F.collect_list("trigger").alias("triggers"))
    marks = C.marks_of(C.cut(asked.select("doc_id").distinct()))
    settled = C.marked(rows, marks).join(asked, ["doc_id", "row_tag"]).mapInArrow(lambda it: _fetch(it, 2 * buckets, length),
        "bucket int, doc binary, tag binary, place binary, more binary, trigger binary, bytes binary")
    settled = C.cut(settled.repartition(2 * buckets, "bucket").mapInArrow(lambda it: _dictionary(it, length),
        "doc_id long, row_tag long, gone binary"), free=True)
    ranges = gone.unionAll(settled).join(alone, ["doc_id", "row_tag"], "left_semi").groupBy("doc_id", "row_tag").agg(F.collect_list("gone").alias("gone"))
    return rows, tagged, ranges


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text)."""
    rows, tagged, ranges = _found(docs, length)
    marks = C.marks_of(C.cut(ranges.select("doc_id").distinct()))
    laid = C.marked(rows, marks).join(ranges, ["doc_id", "row_tag"]).mapInArrow(lambda it: _lay(it, length),
        "doc_id long, row_tag long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["doc_id", "row_tag"])
    whole = (F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= length)  # a copy of an earlier text
    out = tagged.join(laid, ["doc_id", "row_tag"], "left").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(whole, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
    text, none = F.coalesce("text", F.lit("")).cast("binary"), F.lit(0).cast("long")
    return out.unionAll(docs.where("doc_id is null").select("doc_id", F.length(text).cast("long"), none, none, F.sha2(text, 256)))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with what the remaining bytes spell as text (a character cut in two goes whole), and n_chars to match.

    All columns pass through, whatever their names; texts that keep all their bytes are as they were, null included."""
    _, tagged, ranges = _found(docs, length)
    whole = tagged.where((F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= length)).select("doc_id", "row_tag",
        F.lit(None).cast("array<binary>").alias("gone")).distinct()
    several = bool(tagged.where("row_tag <> 0").head(1))
    doc, tag, gone, new = (free_name(docs, c) for c in ("cut_doc", "cut_tag", "cut_ranges", "cut_text"))
    found = ranges.unionAll(whole).select(F.col("doc_id").alias(doc), F.col("row_tag").alias(tag), F.col("gone").alias(gone))
    # texts that keep all their bytes are not shuffled
    marks = C.marks_of(C.cut(found.select(doc).distinct()))
    untouched, docs = C.marked(docs, marks, kept=False), C.marked(docs, marks)
    same = F.xxhash64(docs["text"]) == F.col(tag) if several else F.lit(True)
    joined = docs.join(found, (docs["doc_id"] == F.col(doc)) & same, "left")

    @F.pandas_udf("string")
    def kept(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else "" if r is None else kept_bytes(t.encode(), r, length)[0].decode("utf-8", "ignore") for t,
            r in zip(texts, lists, strict=True)], dtype=object)

    # the text goes through Python only where ranges were found
    hit = F.col(doc).isNotNull()
    joined = joined.withColumn(new, kept(F.when(hit, docs["text"]), F.col(gone)))
    changed = {"text": F.col(new), "n_chars": F.char_length(new)}
    return untouched.unionAll(joined.select(*(F.when(hit,
        changed[c.lower()]).otherwise(docs[c]).cast(docs.schema[c].dataType).alias(c) if c.lower() in changed else docs[c] for c in docs.columns)))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op6_suffix_array_dedup``: the operator over the whole of ``documents`` at 50 bytes."""
    return remove_repeats(C.table(spark, sf_dir, "documents"))
