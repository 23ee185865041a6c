"""N-gram Jaccard join by adaptive multi-match prefixes (the idea of AdaptJoin, Wang, Li and Feng 2012).

A document's set is its distinct 5-word shingles, as 64-bit hashes.  All sets are sorted in one global order: rare
shingles first, by a table of shingle counts over the whole corpus, ties by hash.  The table has a slot for 16 shingles of the
corpus, within 2^18 and 2^24 slots (64 MB).  The order is the same for every document whatever the counters hold, so it
decides speed and not results.

If two sets have Jaccard similarity >= t, their prefixes of |r| - ceil(t|r|) + l shingles share at least l shingles,
and when the two use different l, at least the smaller of the two.  Each document picks its own l: a longer prefix
costs more postings, and cuts the pairs that reach verification, which is estimated from the counts of its shingles.

Equal sets are joined first and one of each goes on (copies that a Bloom filter lets through do no harm), so thousands of
copies cost no pairs.  Every list of documents that share a prefix shingle, short or long, is treated alike, in two steps:

1. Leaders.  Each document meets two leaders of each of its lists, the one first by hash and the one that has the fewest rarer shingles
   (the middle of a group of near copies).  Meetings of a pair are counted over all lists; a pair that meets at least l times is
   verified exactly.  Rows are as many as postings.
2. Lists whose documents are one component by now are done: no pair inside a component has to be compared, since only
   components are asked for.  A pair that is still to be linked shares at least l shingles in the lists that remain.  They are
   counted for every pair of different components: documents meet under the leaders by hash of their lists, with all shingles of
   their prefixes that remain; what meets under one leader is dealt in blocks of documents on both sides, and a task counts a block
   against a block.  Within a leader's documents only those outside its largest component are held against all.  What
   reaches l is verified exactly.

So no link that joins two components is lost, no list is one task's work, and pairs become rows only after they reach l.

Defined results: null or empty text, or white space only: an empty set, in a component of its own.  Documents with
fewer than 5 words: their whole sequence is one shingle.  Rows that repeat a doc_id are one vertex: they share their component and each
shows the size of its own set.  Rows without a doc_id get nulls.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moiety.llm import common as C

SLOTS = 1 << 24  #: counters of a task, folded to as many as the corpus calls for
WIDTH = 1 << 18  #: counters of a block
SLICE = 1 << 20
MOST = 8  #: longest l that a document may choose
HOT = 1 << 17  #: postings of a shingle that may be met more often are dealt to several tasks
U = np.uint64


def _profile(batches):
    """Rows of documents: id, set size, a 128-bit digest of the set; at the end, the partition's shingle counts in blocks."""
    C.trim(forget=True)
    counts, part = np.zeros(SLOTS, np.int32), 0
    with np.errstate(over="ignore"):
        for batch in batches:
            data, offsets = C.column_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            part = int(ids[0]) if len(ids) else part
            for i, j in C.text_slices(offsets, SLICE):
                sets = C.shingle_sets(data, offsets[i:j + 1])
                n = np.array([len(s) for s in sets], np.int64)
                one = np.array([np.sum(C.mix(s), dtype=U) for s in sets], U)
                two = np.array([np.bitwise_xor.reduce(C.mix(s ^ U(0xA5A5A5A55A5A5A5A))) if len(s) else 0 for s in sets], U)
                flat = np.concatenate(sets)
                if len(flat):
                    np.add.at(counts, (flat & U(SLOTS - 1)).astype(np.int64), 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array(n), pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())],
                    ["doc_id", "n_shingles", "d1", "d2", "block", "counts"])
    C.trim()
    for k in range(0, SLOTS // WIDTH, 8):
        blocks = [(b, x) for b in range(k, k + 8) if (x := counts[b * WIDTH:(b + 1) * WIDTH]).any()]
        n = len(blocks)
        if n:
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array([part & 0xFFFF] * n, pa.int64()), pa.nulls(n, pa.int64()),
                pa.nulls(n, pa.int64()), pa.array([b for b, _ in blocks], pa.int32()),
                pa.array([C.pack_counts(x) for _, x in blocks], pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "block", "counts"])


def choose_prefix(costs: np.ndarray, size: int, t: float, most: int = MOST, per_posting: float = 1.0, per_pair: float = 0.02) -> tuple[int, int]:
    """(l, prefix length) of a set whose shingles, in the global order, have these estimated posting-list lengths.

    At most S/l documents share l shingles with a prefix whose lists hold S postings; each such candidate costs a
    verification in proportion to the set's size."""
    least = size - math.ceil(t * size - 1e-9)
    lengths = np.arange(least + 1, min(size, least + most) + 1)
    l = lengths - least
    postings = np.cumsum(costs[:lengths[-1]])[lengths - 1]
    best = int(np.argmin(per_posting * (postings + lengths) + per_pair * size * postings / l))
    return int(l[best]), int(lengths[best])


_PACKED = "bucket int, token binary, doc binary, size binary, l binary, place binary, last binary"


def _postings(batches, marks, table, noise, n_buckets, t, hot):
    """Packed postings by bucket of shingle: hash, document, set size, l, place in the prefix, count of the prefix's last.  A hot shingle has several buckets."""
    C.trim(forget=True)
    table, slots = table.value, U(len(table.value) - 1)
    with np.errstate(over="ignore"):
        for batch in batches:
            batch = batch.filter(pa.array(C.passes(marks.value, batch.column("doc_id").to_numpy(zero_copy_only=False))))
            data, offsets = C.column_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in C.text_slices(offsets, SLICE):
                tokens, docs, sizes, ls, places, met, lasts = [], [], [], [], [], [], []
                for doc, s in zip(ids[i:j], C.shingle_sets(data, offsets[i:j + 1]), strict=True):
                    n = len(s)
                    if not n:
                        continue
                    count = table[(s & slots).astype(np.int64)]
                    reach = n - math.ceil(t * n - 1e-9) + MOST
                    if reach < n // 2:  # the rarest, in order
                        least = np.argpartition(count, reach)[:reach]
                        pick = np.flatnonzero(count <= count[least].max())
                        order = pick[np.lexsort((s[pick], count[pick]))]
                    else:
                        order = np.lexsort((s, count))
                    l, length = choose_prefix(np.maximum(count[order] - noise, 1.0), n, t)
                    order = order[:length]
                    tokens.append(s[order])
                    met.append(count[order])
                    docs.append(np.full(length, doc))
                    sizes.append(np.full(length, n, np.int32))
                    ls.append(np.full(length, l, np.int8))
                    places.append((np.arange(length) * 255 // n).astype(np.uint8))
                    lasts.append(np.full(length, met[-1][-1], np.int32))
                if not tokens:
                    continue
                token, doc, size, l, place, met, last = map(np.concatenate, (tokens, docs, sizes, ls, places, met, lasts))
                salt = C.mix(doc.view(U)) % (met // hot + 1).astype(U)
                bucket = (((token >> U(32)) + salt * U(0x9E3779B1)) % U(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                ends = np.append(edges[1:], len(order))
                groups = [order[a:b] for a, b in zip(edges, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[order[edges]], pa.int32())] + [pa.array([x[g].tobytes() for g in groups],
                    pa.binary()) for x in (token, doc, size, l, place, last)], [x.split()[0] for x in _PACKED.split(", ")])
    C.trim()


_LISTED = "token long, doc long, size int, l int, place int, last int"


def _listed(batches, table, hot):
    """Postings of the shingles that more than one document has in its prefix, one row each."""
    kinds = {"token": U, "doc": np.int64, "size": np.int32, "l": np.int8, "place": np.uint8, "last": np.int32}
    got = {k: [] for k in kinds}
    for batch in batches:
        for k, kind in kinds.items():
            got[k] += [np.frombuffer(x.as_buffer(), kind) for x in batch.column(k)]
    if not got["token"]:
        return
    token, doc, size, l, place, last = (np.concatenate(got.pop(k)) for k in kinds)
    C.trim(forget=True)
    order = np.argsort(token, kind="stable")
    again = np.diff(token[order]) == 0
    keep = np.zeros(len(order), bool)
    keep[:-1] |= again
    keep[1:] |= again
    keep |= table.value[(token[order] & U(len(table.value) - 1)).astype(np.int64)] >= hot  # the others may be in another task
    order = order[keep]
    for i in range(0, len(order), 65536):
        k = order[i:i + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(token[k].view(np.int64)), pa.array(doc[k]), pa.array(size[k]),
            pa.array(l[k].astype(np.int32)), pa.array(place[k].astype(np.int32)), pa.array(last[k])],
            [x.split()[0] for x in _LISTED.split(", ")])
    C.trim()


def _sets(batches, marks):
    with np.errstate(over="ignore"):
        for batch in batches:
            ids = batch.column("doc_id")
            batch = batch.filter(pa.array(C.passes(marks.value, ids.to_numpy(zero_copy_only=False))))
            data, offsets = C.column_bytes(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j in C.text_slices(offsets, SLICE):
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i),
                    pa.array([s.tobytes() for s in C.shingle_sets(data, offsets[i:j + 1])], pa.binary())], ["id", "s"])
    C.trim()


def _verify(batches, percent):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            same = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(100 * same >= percent * (len(both) - same) and same > 0)
        keep = pa.array(keep, pa.bool_())
        yield batch.select(["a", "b"]).filter(keep)
    C.trim()


def verified(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct candidate ``pairs`` (a, b) whose sets are similar enough, from their whole texts."""
    sets = sets_of(docs, pairs.select("a").unionAll(pairs.select("b")))
    wide = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return wide.mapInArrow(lambda it: _verify(it, percent), "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct candidate ``pairs`` (a, b) whose sets, from their whole texts, are similar enough; no text is shuffled."""
    ids = C.cut(pairs.select("a").unionAll(pairs.select("b")).distinct())
    marks = C.marks_of(ids)
    sets = docs.mapInArrow(lambda it: _sets(it, marks), "id long, s binary")
    sets = C.cut(sets.join(ids.toDF("id"), "id", "left_semi"))
    wide = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    out = C.cut(wide.mapInArrow(lambda it: _verify(it, percent), "a long, b long"))
    marks.destroy()
    return out


def enough(size_x, l_x, last_x, size_y, l_y, last_y, percent: int):
    """Shingles that two prefixes have to share: the smaller l; and what the prefixes must hold if all that follows them is shared too.

    Similar sets share at least p (x + y) / (100 + p) shingles.  Those that the two prefixes do not share come after the end
    of the prefix that ends first in the global order."""
    tail_x, tail_y = (np.maximum(-(-percent * n // 100) - k, 0) for n, k in ((size_x, l_x), (size_y, l_y)))
    tail = np.where(last_x < last_y, tail_x, np.where(last_x > last_y, tail_y, np.maximum(tail_x, tail_y)))
    return np.maximum(np.minimum(l_x, l_y), -(-percent * (size_x + size_y) // (100 + percent)) - tail)


def _count_block(doc, c, size, l, last, late, tokens, percent):
    """Pairs of a late document (outside the largest component) with another of the block that share enough of ``tokens``."""
    x, y = np.flatnonzero(late), np.flatnonzero(~late)
    n = np.array([len(z) for z in tokens], np.int64)
    of, flat = np.repeat(np.arange(len(tokens)), n), np.concatenate(tokens)
    token = np.unique(flat, return_inverse=True)[1]
    more = (np.bincount(token, late[of]) > 0) & (np.bincount(token, ~late[of]) > 0)  # on both sides
    keep = more[token]
    of, token = of[keep], (np.cumsum(more) - 1)[token[keep]]
    shared = np.zeros((len(x), len(y)), np.float32)
    place = np.empty(len(doc), np.int64)
    place[x], place[y] = np.arange(len(x)), np.arange(len(y))
    order = np.argsort(token, kind="stable")
    of, token = of[order], token[order]
    for a in range(0, int(token[-1]) + 1 if len(token) else 0, 2048):
        i, j = np.searchsorted(token, [a, a + 2048])
        o, k, first = of[i:j], token[i:j] - a, late[of[i:j]]
        left, right = np.zeros((len(x), 2048), np.float32), np.zeros((len(y), 2048), np.float32)
        left[place[o[first]], k[first]] = 1
        right[place[o[~first]], k[~first]] = 1
        shared += left @ right.T
    i, j = np.nonzero(shared >= np.minimum(l[x][:, None], l[y][None, :]))
    met, i, j = shared[i, j], x[i], y[j]
    fits = (met >= enough(size[i], l[i], last[i], size[j], l[j], last[j],
        percent)) & (c[i] != c[j]) & (doc[i] != doc[j]) & (np.minimum(size[i], size[j]) * 100 >= percent * np.maximum(size[i], size[j]))
    return doc[i[fits]], doc[j[fits]]


def _count(table, percent):
    """Candidate pairs of the blocks of a lot."""
    table = table.combine_chunks()
    key = [table.column(k).to_numpy() for k in ("lead", "x", "y")]
    order = np.lexsort(key)
    new = np.flatnonzero(np.any([np.diff(k[order], prepend=k[order[:1]] - 1) != 0 for k in key], axis=0))
    doc, c, size, l, last = (table.column(k).to_numpy().astype(np.int64) for k in ("doc", "c", "size", "l", "last"))
    late = table.column("late").to_numpy(zero_copy_only=False)
    tokens = table.column("tokens").combine_chunks()
    flat, ends = tokens.values.to_numpy(), tokens.offsets.to_numpy()
    found = []
    for some in np.split(order, new[1:]):
        if late[some].any() and not late[some].all():
            found.append(_count_block(doc[some], c[some], size[some], l[some], last[some], late[some], [flat[ends[k]:ends[k + 1]] for k in some], percent))
    a, b = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    lo, hi = (z for z in np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1))
    return pa.table({"a": pa.array(lo, pa.int64()), "b": pa.array(hi, pa.int64())})


def _meetings(listed: DataFrame, percent: int) -> DataFrame:
    """Pairs of documents and leaders of their lists that meet often enough."""
    head = F.struct("doc", "size", "l")
    leaders = listed.groupBy("token").agg(F.min(F.struct(F.xxhash64("doc"), *("doc", "size", "l"))).alias("p"),
        F.min(F.struct("place", F.xxhash64("doc"), *("doc", "size", "l"))).alias("q"))
    leaders = leaders.select("token", *(F.struct(*(F.col(f"{k}.{f}").alias(f) for f in ("doc", "size", "l"))).alias(k) for k in "pq"))
    both = listed.select("token", head.alias("d")).join(leaders, "token")
    both = both.select("d", "p", F.explode(F.array_distinct(F.array("p", "q"))).alias("q"))
    # the two leaders meet in one direction only
    both = both.where("d.doc <> q.doc and (d.doc <> p.doc or q.doc = p.doc)").where(F.least("d.size",
        "q.size") * 100 >= percent * F.greatest("d.size", "q.size"))
    met = both.groupBy(F.least("d.doc", "q.doc").alias("a"), F.greatest("d.doc", "q.doc").alias("b")).agg(F.count("*").alias("n"),
        F.min(F.least("d.l", "q.l")).alias("l"))
    return met.where("n >= l").select("a", "b")


def _remaining(listed: DataFrame, links: DataFrame, percent: int, block: int) -> DataFrame | None:
    """Pairs of different components that share enough prefix shingles; None if every list is one component."""
    parts = C.connected_components(links)
    named = listed.join(parts.withColumnRenamed("id", "doc"), "doc", "left").select(*listed.columns, F.coalesce("component", "doc").alias("c"))
    spread = named.groupBy("token").agg(F.min("c").alias("c1"), F.max("c").alias("c2"),
        F.min(F.struct(F.xxhash64("doc"), "doc")).alias("p")).where("c1 <> c2").select("token", F.col("p.doc").alias("lead"))
    open_ = C.cut(named.join(spread, "token").select("token", "doc", "c", "size", "l", "last", "lead"))
    if not open_.count():
        return None
    text = ("doc", "size", "l", "last")  # a doc_id may have several
    own = C.cut(open_.groupBy(*text).agg(F.min("c").alias("c"), F.collect_set("token").alias("tokens"), F.collect_set("lead").alias("leads")))
    there = own.select(*text, "c", (F.size("tokens") + 64).alias("w"), F.explode("leads").alias("lead"))
    per = there.groupBy("lead", "c").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    major = per.groupBy("lead").agg(F.max(F.struct("n", "c", "w")).alias("m"), F.sum("w").alias("all")).where("all > m.w")
    major = major.select("lead", F.col("m.c").alias("major"), F.ceil(F.col("all") / block).cast("int").alias("nb"),
        F.ceil((F.col("all") - F.col("m.w")) / block).cast("int").alias("ns"))
    dealt = there.join(major, "lead")
    mine = lambda k: F.pmod(F.xxhash64("doc"), F.col(k)).cast("int")
    whole = dealt.select("lead", *text, "w", F.lit(False).alias("late"), mine("nb").alias("y"), F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("x"))
    late = dealt.where("c <> major").select("lead", *text, "w", F.lit(True).alias("late"),
        F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("y"), mine("ns").alias("x"))
    rows = C.cut(whole.unionByName(late))
    lots = max(1, math.ceil((rows.agg(F.sum("w")).first()[0] or 0) / block))  # small blocks share a lot
    rows = rows.withColumn("lot", F.pmod(F.xxhash64("lead", "x", "y"), F.lit(lots)).cast("int"))
    filled = rows.join(own.select(*text, "c", "tokens"), list(text)).select("lot", "lead", "x", "y", *text, "c", "late", "tokens")
    return C.cut(filled.groupBy("lot").applyInArrow(lambda x: _count(x, percent), "a long, b long").distinct())


def similarity_components(docs: DataFrame, percent: int = 75, block: int = 200_000, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id that its links reach)."""
    spark, t = docs.sparkSession, percent / 100
    nameless = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    docs = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    profile = C.cut(docs.mapInArrow(_profile, "doc_id long, n_shingles long, d1 long, d2 long, block int, counts binary"))
    shown = profile.where("block is null").select("doc_id", "n_shingles", "d1", "d2")
    full = shown.where("n_shingles > 0")
    chosen = C.cut(full.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep")))
    total, blocks = int(shown.agg(F.sum("n_shingles")).first()[0] or 0), 1
    while blocks * WIDTH < min(total // 16, SLOTS):
        blocks *= 2
    counts = C.summed_table(profile.where("block is not null").select(F.pmod("block", F.lit(blocks)).alias("block"), "counts",
        F.col("n_shingles").alias("salt")), blocks * WIDTH, blocks)
    table, marks = spark.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32)), C.marks_of(chosen.select("rep"))
    n_buckets, noise = max(C.partitions(spark), total // 4_000_000, 1), total / len(counts)
    packed = docs.mapInArrow(lambda it: _postings(it, marks, table, noise, n_buckets, t, hot), _PACKED)
    listed = C.cut(packed.repartition(n_buckets, "bucket").mapInArrow(lambda it: _listed(it, table, hot), _LISTED), free=True)
    table.destroy()
    marks.destroy()
    met = C.cut(_meetings(listed, percent))
    links = verified(docs, met, percent)
    more = _remaining(listed, links, percent, block)
    if more is not None:
        links = links.unionAll(verified(docs, C.cut(more.join(met, ["a", "b"], "left_anti")), percent))
    groups = C.connected_components(links)
    found = chosen.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("n_shingles", "d1", "d2",
        F.coalesce("component", "rep").alias("component_id"))
    linked = full.join(found, ["n_shingles", "d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    return linked.unionAll(shown.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))).unionAll(nameless)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op10_ngram_jaccard_join``: the operator over the whole of ``documents`` at 75 percent."""
    return similarity_components(C.table(spark, sf_dir, "documents"))
