"""Embedding near-dedup: a subspace pigeonhole join of equally labelled vectors, verified exactly.

Vectors are scaled to length 1, where cosine >= c means squared distance <= 2 - 2c, and rotated by a fixed random
orthogonal matrix, which changes no distance and spreads the variance.  The dimensions are split into blocks.  If two
vectors are within the squared distance T, then in at least one block of d of D dimensions their parts are within T d/D: the
pigeonhole.  In each block a range join finds such pairs: the first dimensions of the block make a grid, each vector
lives in one cell and visits all cells that the ball of the block's radius around it touches.  A pair that meets within the
block's budget is a candidate, unless an earlier block has it within its own budget already, which each pair's parts show;
so every pair is verified once from each side, by cosine in double precision on the original vectors, and no list of pairs is shuffled.

Equal vectors of a label are one point with a count, so a group of copies costs no comparisons.  Points of a cell are
compared as numpy products, tile by tile, on coordinates rounded to 2^-22, whose products and sums are exact in double precision: every task
decides alike which block owns a pair.  A cell with many points is dealt out on both sides by a hash, a piece of its residents against a
piece of its visitors.  What leaves a task are sums: for each visitor how many it links with, and one edge for each connected
part of what the task has seen.  So a third of all vectors may be near copies of each other: their comparisons are as many
as n_links asks for, but no row is made for a pair.

The grid uses as many dimensions as the largest label calls for (lossless at any number).

Defined results: vectors that are null, zero, or that hold null or
non-finite components, and vectors without a label, link with nothing; vectors of different lengths neither.  Labels may be of any
type that Spark can group by.  Rows that repeat a vec_id do not link with each
other; others count each of them, and all of them show the sum of their links.  Rows without a vec_id link with nothing and get
no component.  An empty table gives no rows.  Columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from moiety.llm import common as C

BLOCK = 16  #: dimensions of a block
TILE = 1024
UNIT = 1 << 22  #: coordinates are compared in units of 1 / UNIT
SLACK = 1e-6  #: added to budgets, for that rounding


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.RandomState(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def usable(batch) -> tuple[np.ndarray, np.ndarray]:
    """Rows with finite, non-zero vectors (of the batch's commonest length) and those vectors in double precision."""
    lists = batch.column("embedding")
    n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    out, rows = [], []
    for dim in np.unique(n[n > 0]).tolist():
        at = np.flatnonzero(n == dim)
        flat = pc.list_flatten(lists.take(pa.array(at))).cast(pa.float64())
        x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
        ok = np.isfinite(x).all(axis=1)
        ok[ok] = np.linalg.norm(x[ok], axis=1) > 0
        rows.append(at[ok])
        out.append(x[ok])
    if not rows:
        return np.zeros(0, np.int64), []
    return rows, out


_KEYS = ("label", "dim", "block", "cell")


def _vectors(batches, kind):
    """(id, label, dim, vector) of the usable rows."""
    for batch in batches:
        rows, vectors = usable(batch)
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        for at, x in zip(rows, vectors, strict=True):
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at].astype(np.int64)), batch.column("label").take(pa.array(at)),
                    pa.array(np.full(len(at), x.shape[1], np.int32)), pa.array([v.tobytes() for v in (x + 0.0).astype(kind)], pa.binary())],
                    ["id", "label", "dim", "vector"])


def _points(batches, bound, grid, kind):
    """Each point in its cell of each block (home), and in the other cells that the ball around it touches."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            rows = batch.filter(pa.array(dims == dim))
            x = np.frombuffer(b"".join(rows.column("vector").to_pylist()), kind).reshape(-1, dim).astype(np.float64)
            y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(dim)
            for b in range(0, dim, BLOCK):
                part = y[:, b:b + BLOCK]
                radius = math.sqrt(bound * part.shape[1] / dim) + SLACK
                width, g = 4 * radius, min(grid, part.shape[1])
                home = np.floor(part[:, :g] / width).astype(np.int64)
                where, cells, gap = np.arange(len(x)), home.copy(), np.zeros(len(x))
                for k in range(g):  # neighbours, dimension by dimension, as far as the ball reaches them
                    place = part[where, k] / width - home[where, k]
                    lots = [(where, cells, gap)]
                    for step, far in ((-1, place), (1, 1 - place)):
                        d = gap + (far * width) ** 2
                        near = d <= radius * radius
                        moved = cells[near].copy()
                        moved[:, k] += step
                        lots.append((where[near], moved, d[near]))
                    where, cells, gap = (np.concatenate(z) for z in zip(*lots, strict=True))
                with np.errstate(over="ignore"):
                    name = C.mix((cells.astype(np.uint64) * C.odd_constants(BLOCK, 3)[:g]).sum(axis=1, dtype=np.uint64)).view(np.int64)
                out = rows.take(pa.array(where))
                yield pa.RecordBatch.from_arrays([out.column("label"), out.column("dim"), pa.array(np.full(len(where), b, np.int32)),
                    pa.array(name), *(out.column(c) for c in ("id", "own", "n")), pa.array((cells == home[where]).all(axis=1)),
                    out.column("vector")], [*_KEYS, "id", "own", "n", "home", "vector"])


def merged(label: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Labels (indices of roots) after joining the parts of r[i] and s[i] for all i."""
    while True:
        x, y = label[r], label[s]
        differ = x != y
        if not differ.any():
            return label
        r, s, x, y = r[differ], s[differ], x[differ], y[differ]
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
        label = root[label]


def _links(table, cosine, bound, kind):
    """Of a piece of a cell's residents and one of its visitors: (a, n, other): visitor a has n links with residents; other: a point joined with it."""
    none = pa.table({k: pa.array([], pa.int64()) for k in ("a", "n", "other")})
    table = table.combine_chunks()
    dim, b = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
    here, come = (np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False)) for c in ("resident", "visitor"))
    if not len(here) or not len(come):
        return none
    ids, count = table.column("id").to_numpy(), table.column("n").to_numpy()
    own = table.column("own").fill_null(False).to_numpy(zero_copy_only=False)  # all its rows have one vec_id, which other points have too
    x = np.frombuffer(b"".join(table.column("vector").to_pylist()), kind).reshape(-1, dim).astype(np.float64)
    norm = np.linalg.norm(x, axis=1)
    y = np.rint((x / norm[:, None]) @ rotation(dim) * UNIT)
    n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    order = [b, *range(0, b, BLOCK)]  # near in this block, in none before it
    square = {k: (y[:, k:k + BLOCK] ** 2).sum(1) for k in order}
    for i in range(0, len(come), TILE):
        v = come[i:i + TILE]
        for j in range(0, len(here), TILE):
            o, alive = here[j:j + TILE], None
            for k in order:
                part = y[:, k:k + BLOCK]
                near = square[k][v][:, None] + square[k][o][None,
                    :] - 2 * (part[v] @ part[o].T) <= math.floor((bound * part.shape[1] / dim + SLACK) * UNIT * UNIT)
                alive = near if alive is None else alive & ~near
                if not alive.any():
                    break
            r, s = np.nonzero(alive)
            r, s = v[r], o[s]
            other = ids[r] != ids[s]
            same = ~other & (count[r] > 1) & ~own[r]  # a point of several vectors: each links with the others
            n += np.bincount(r[same], count[r[same]] - 1, minlength=len(ids)).astype(np.int64)
            r, s = r[other], s[other]
            if not len(r):
                continue
            hit = np.concatenate([np.einsum("ij,ij->i", x[r[k:k + 65536]],
                x[s[k:k + 65536]]) / (norm[r[k:k + 65536]] * norm[s[k:k + 65536]]) >= cosine for k in range(0, len(r), 65536)])
            r, s = r[hit], s[hit]
            n += np.bincount(r, count[s], minlength=len(ids)).astype(np.int64)
            label = merged(label, r, s)
    n *= np.where(own, count, 1)  # rows of a repeated vec_id show the sum of their links
    some = np.flatnonzero((n > 0) | (label != np.arange(len(ids))))
    return pa.table({"a": pa.array(ids[some]), "n": pa.array(n[some]), "other": pa.array(ids[label[some]])})


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, piece: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label)."""
    bound, schema = 2 - 2 * cosine, vectors.schema
    kind = np.float32 if schema["embedding"].dataType.elementType == FloatType() else np.float64
    named = schema["label"].dataType.simpleString()
    rows = vectors.select("vec_id", "embedding", "label")
    part = rows.where("vec_id is not null and label is not null and embedding is not null")
    used = C.cut(part.mapInArrow(lambda it: _vectors(it, kind), f"id long, label {named}, dim int, vector binary"))
    repeated = used.groupBy("id").agg(F.count("*").alias("r")).where("r > 1").select("id", F.lit(True).alias("own"))
    told = used.join(repeated, "id", "left")
    # copies are one point, named by the smallest vec_id; vectors of a repeated vec_id stay apart, as they do not link with each other
    alike = ["label", "dim", "vector", F.when(F.col("own"), F.col("id")).alias("only")]
    points = C.cut(told.groupBy(*alike).agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("own").alias("own")))
    largest = points.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    grid = max(1, min(BLOCK, round(math.log(largest / 2000 + 1) / math.log(2.5))))
    placed = points.mapInArrow(lambda it: _points(it, bound, grid, kind),
        f"label {named}, dim int, block int, cell long, id long, own boolean, n long, home boolean, vector binary")
    crowds = C.cut(placed.groupBy(*_KEYS).agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces")).where("pieces > 1"))
    dealt = placed.join(crowds, list(_KEYS), "left").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    role = lambda x, y, resident, visitor: F.struct(x.alias("x"), y.alias("y"), resident.alias("resident"), visitor.alias("visitor"))
    zero, yes, no = F.lit(0), F.lit(True), F.lit(False)
    every = F.sequence(zero, F.col("pieces") - 1)
    visits = F.transform(every, lambda k: role(k, F.col("mine"), no, yes))
    stays = F.when(F.col("home"), F.transform(every,
        lambda k: role(F.col("mine"), k, yes, no))).otherwise(F.array().cast("array<struct<x:int,y:int,resident:boolean,visitor:boolean>>"))
    dealt = dealt.withColumn("role", F.explode(F.when(F.col("pieces").isNull(),
        F.array(role(zero, zero, F.col("home"), yes))).otherwise(F.concat(visits, stays))))
    dealt = dealt.select(*_KEYS, "role.*", "id", "own", "n", "vector")
    met = C.cut(dealt.groupBy(*_KEYS, "x", "y").applyInArrow(lambda t: _links(t, cosine, bound, kind), "a long, n long, other long"))
    # back to the rows: copies have their point's links
    copies = points.where("n > 1 and own is null").select("label", "dim", "vector", F.col("id").alias("point"))
    sums = met.groupBy(F.col("a").alias("point")).agg(F.sum("n").alias("n"))
    known = told.join(copies, ["label", "dim", "vector"], "left").select("id",
        F.when(F.col("own"), F.col("id")).otherwise(F.coalesce("point", "id")).alias("point"))
    known = C.cut(known)
    links = known.distinct().join(sums, "point").groupBy(F.col("id").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    parts = C.connected_components(met.where("a <> other").select("a", F.col("other").alias("b")).unionAll(known.where("id <> point").select("id", "point")))
    out = rows.select("vec_id").join(links, "vec_id", "left").join(parts.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        (component == F.col("vec_id")).alias("kept"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op1_embedding_near_dedup``: the operator over the whole of ``embeddings`` at cosine 0.98."""
    return near_duplicates(C.table(spark, sf_dir, "embeddings"))
