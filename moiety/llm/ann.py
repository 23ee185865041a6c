"""Approximate nearest neighbours by collision-counting hashing (the ideas of C2LSH, Gan et al. 2012, and QALSH, Huang et al. 2015).

Vectors are scaled to length 1, so the largest cosine is the least distance.  Each of ``projections`` lines gives every
vector one number (sets of orthogonal lines, whose counts vary less than those of independent ones); the numbers of a lot of vectors are
sorted, one array for each line.  A query opens a window around its own number in every array, and a vector collides
with it once for each window that it is in.  Windows widen step by step (virtual rehashing: ``WIDTHS`` in units of the numbers'
deviation): only the two new ends of each window are read and added to the counts.  A vector that has at least ``threshold`` of all
collisions is verified, once, by cosine in double precision on the original vectors.  Widening stops when the k-th nearest verified is so near
that nearer ones would collide often enough, or when a share ``verify`` of the lot (and 8 k more) is verified.

Recall depends on the data and not on their number; tests measure it against brute force with these settings.

Every distinct vector is indexed once, with the k + 1 smallest of its ids, so a group of equal vectors takes one place in the arrays
and its smallest ids, which win ties, are never missed.  Lots are made by a hash of the vector: of 2048 or more, as many as shuffle
partitions, or more where they would hold over ``lot`` vectors.  Queries go to every lot, in blocks of ``block``; a block of queries with a
lot is one task's work.  A query asks for nearness to all rows, so the work is queries times vectors, in reads of sorted arrays.

Defined results: vectors that are null, zero, or that hold null or non-finite components take no part, as queries or as
candidates; vectors of different lengths are not compared.  Rows that repeat a vec_id are candidates of one id (the query's
own id is no candidate); as queries the smallest vector counts.  With fewer candidates than ``k`` all are returned.
Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from moiety.llm import common as C
from moiety.llm.embedding_dedup import usable

PROJECTIONS, THRESHOLD, VERIFY, LOT, QUERIES = 128, 0.7, 0.04, 65_536, 4096
WIDTHS = (0.4, 0.8, 1.0, 1.1, 1.2, 1.3, 1.4, 1.6, 1.9, 2.4, 3.5, np.inf)  #: reach of a window to either side
NEAR = 1.3  #: vectors within a distance of width / NEAR have well over ``THRESHOLD`` of all collisions


def lines(dim: int, n: int, seed: int = 13) -> np.ndarray:
    """n lines in sets of orthogonal ones; a vector of length 1 has numbers of deviation 1 on them."""
    r = np.random.RandomState(seed)
    return np.concatenate([np.linalg.qr(r.normal(size=(dim, dim)))[0] for _ in range(-(-n // dim))], axis=1)[:, :n] * np.sqrt(dim)


def nearest(index: np.ndarray, queries: np.ndarray, projections: int, threshold: float, verify: float, k: int, names: np.ndarray):
    """For each query the places of the vectors of ``index`` (both of length 1) that collide often enough, and the array entries read.

    Vectors of one name count as one of the k."""
    n, a = len(index), lines(index.shape[1], projections)
    values = (index @ a).T
    order = np.argsort(values, axis=1).astype(np.int32)
    values, asked = np.take_along_axis(values, order, axis=1), queries @ a
    # where each window of each query begins and ends in each array
    steps = np.array(WIDTHS)
    begin, end = (np.empty((len(queries), len(steps), projections), np.int32) for _ in "ab")
    for j in range(projections):
        begin[:, :, j] = np.searchsorted(values[j], asked[:, j, None] - steps, "left")
        end[:, :, j] = np.searchsorted(values[j], asked[:, j, None] + steps, "right")
    need, most = max(1, int(threshold * projections)), verify * n + 8 * k
    for q, b, e in zip(queries, begin, end, strict=True):
        count, open_ = np.zeros(n, np.int64), np.ones(n, bool)
        found, far, read = np.zeros(0, np.int64), np.zeros(0), 0
        left = right = (b[0] + e[0]) // 2
        for width, lo, hi in zip(WIDTHS, b, e, strict=True):
            ends = [order[j, x:y] for j in range(projections) for x, y in ((lo[j], left[j]), (right[j], hi[j])) if x < y]
            if ends:
                new = np.concatenate(ends)
                read += len(new)
                count += np.bincount(new, minlength=n)
            left, right = lo, hi
            some = np.flatnonzero((count >= need) & open_)
            open_[some] = False
            found, far = np.concatenate([found, some]), np.concatenate([far, 2 - 2 * index[some] @ q])
            bound = (width / NEAR) ** 2
            if len(found) >= most and len(set(names[found].tolist())) >= k or np.count_nonzero(far <= bound) >= k and len(set(names[found[far <= bound]].tolist())) >= k:
                break
        yield found, read


def _best(score, ids: list, own: int, k: int) -> list[tuple[float, int]]:
    """(score, id) of the k best distinct ids other than ``own`` of vectors with scores and sorted lists of ids."""
    least = np.array([next((i for i in x[:2] if i != own), -1) for x in ids], np.int64)
    best, met = {}, set()
    for v in np.lexsort((least, -score)):
        if len(met) == k:  # so many ids come before all of this vector's
            break
        for i in ids[v]:
            if i != own:
                best[i] = max(best.get(i, -np.inf), score[v])
        if len(ids[v]) > 1 or ids[v][0] != own:
            met.add(int(least[v]))
    return sorted(((s, i) for i, s in best.items()), key=lambda x: (-x[0], x[1]))[:k]


def _search(table, projections, threshold, verify, k, kind):
    """One lot of distinct vectors with a block of queries: the k best ids of the lot for each query."""
    table = table.combine_chunks()
    dim = table.column("dim")[0].as_py()
    is_query = table.column("query").to_numpy(zero_copy_only=False)
    ids = table.column("ids").to_pylist()
    x = np.frombuffer(b"".join(table.column("vector").to_pylist()), kind).reshape(-1, dim).astype(np.float64)
    norm = np.linalg.norm(x, axis=1)
    unit = x / norm[:, None]
    q, v = np.flatnonzero(is_query), np.flatnonzero(~is_query)
    if not len(q) or not len(v):
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    out = []
    for i, (found, _) in zip(q, nearest(unit[v], unit[q], projections, threshold, verify, k + 1, np.array([ids[i][0] for i in v])), strict=True):
        found = v[found]
        score = (x[found] @ x[i]) / (norm[found] * norm[i])
        out += [(ids[i][0], n, s) for s, n in _best(score, [ids[f] for f in found], ids[i][0], k)]
    q_, v_, s_ = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"query_id": pa.array(q_, pa.int64()), "vec_id": pa.array(v_, pa.int64()), "score": pa.array(s_, pa.float64())})


def _vectors(batches, kind):
    for batch in batches:
        rows, vectors = usable(batch)
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        for at, x in zip(rows, vectors, strict=True):
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at].astype(np.int64)), pa.array(np.full(len(at), x.shape[1], np.int32)),
                    pa.array([v.tobytes() for v in (x + 0.0).astype(kind)], pa.binary())], ["id", "dim", "vector"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, projections: int = PROJECTIONS, threshold: float = THRESHOLD,
    verify: float = VERIFY, lot: int = LOT, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its k nearest among ``vectors`` (both vec_id, embedding)."""
    out, kind = "id long, dim int, vector binary", np.float32 if all(x.schema["embedding"].dataType.elementType == FloatType() for x in (vectors,
        queries)) else np.float64
    whole = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    asked = queries.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    n, m = whole.count(), asked.count()
    lots, blocks = max(1, min(C.partitions(vectors.sparkSession), n // 2048), -(-n // lot)), max(1, -(-m // block))
    # equal vectors are one, with the smallest ids that can be among the k of a query (which may be one of them)
    index = whole.mapInArrow(lambda it: _vectors(it, kind), out).distinct().withColumn("n",
        F.row_number().over(Window.partitionBy("dim", "vector").orderBy("id"))).where(F.col("n") <= k + 1)
    index = index.groupBy("dim", "vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("lot",
        F.pmod(F.xxhash64("vector"), F.lit(lots)).cast("int"))
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("query", F.lit(False))
    ask = asked.mapInArrow(lambda it: _vectors(it, kind), out).groupBy("id").agg(F.min(F.struct("dim", "vector")).alias("x")).select("id", "x.*")
    ask = ask.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("lot",
        F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).withColumn("query", F.lit(True)).withColumn("ids", F.array("id")).drop("id")
    both = index.unionByName(ask).repartition("dim", "lot", "block")
    found = both.groupBy("dim", "lot", "block").applyInArrow(lambda t: _search(t, projections, threshold, verify, k, kind),
        "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op3_nearest_neighbours``: queries are the rows of ``embeddings`` whose vec_id is divisible by 50, against all rows."""
    vectors = C.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0"))
