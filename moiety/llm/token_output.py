"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

An id is replaced by its rank among all ids of the corpus by frequency (ties by id), so common ids take one byte.
Each rank takes 1 to 4 bytes, little-endian.  Two bits for each rank, four ranks in a control byte, say how many; they
stand apart from the data bytes, so that numpy decodes a block by looking the control bytes up in a table of 256 rows.

File format: a folder with two Parquet tables, so that Spark's committer decides which attempt of a task counts.
``ranks``: one row, the ids by rank (uint32).  ``blocks``: part, seq (order within the part), docs (int64 doc_ids), lengths
(int64), control, data, tokens_before (within the part), tokens.  Parts are ranges of doc_id, so reading by (part, seq)
gives the documents in ascending doc_id order; rows that repeat a doc_id are ordered by text.

Defined results: null or empty text is the end id alone; rows without a doc_id have no place in the order and are left out; an
empty table gives files without blocks.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moiety.llm import common as C
from moiety.llm import tokens

LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)  #: bytes of the four ranks of a control byte
IDLE_WORDS = 250_000  #: that a worker keeps between tasks; a task of 11 MB meets about as many that it has not seen


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes)."""
    wide, more = int(ranks.max(initial=0)) > 0xFFFF, (ranks > 0xFF).astype(np.uint8)
    if wide:
        more = more + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[:len(ranks)] = more
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    raw = ranks.astype("<u4" if wide else "<u2").view(np.uint8).reshape(-1, 4 if wide else 2)
    return control.tobytes(), raw[np.arange(raw.shape[1]) <= more[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a block."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(sizes) - sizes
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(3, np.uint8))
    out = raw[at].astype(np.uint32)
    for k in range(1, int(sizes.max(initial=1))):
        far = np.flatnonzero(sizes > k)
        out[far] |= raw[at[far] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


_RAW = "part int, seq int, docs binary, lengths binary, ids binary, tokens_before long, tokens long, block int, counts binary, salt int"
_FILES = "part int, seq int, docs binary, lengths binary, control binary, data binary, tokens_before long, tokens long"


def _tokenise(batches, path, end_id, size, wide):
    """Blocks of ids in order, and at the end how often this partition has each id."""
    part, seq, before, counts = TaskContext.get().partitionId(), 0, 0, np.zeros(size, np.int64)
    names = [x.split()[0] for x in _RAW.split(", ")]
    for kept, ids, n in tokens.encoded_rows(batches, path, end_id, ["doc_id"], idle=IDLE_WORDS):
        counts += np.bincount(ids, minlength=size)
        row = [part, seq, np.array(kept["doc_id"], np.int64).tobytes(), n.astype(np.int64).tobytes(),
            ids.astype(np.uint32 if wide else np.uint16).tobytes(), before, len(ids), None, None, None]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v,
            t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(),
            pa.int32()), strict=True)], names)
        seq, before = seq + 1, before + len(ids)
    if seq:
        row = [None] * 7 + [0, C.pack_counts(counts), part & 0xFFFF]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v,
            t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(),
            pa.int32()), strict=True)], names)


def _compress(batches, rank, wide):
    for batch in batches:
        coded = [encode_ranks(rank.value[np.frombuffer(x.as_buffer(), np.uint32 if wide else np.uint16)]) for x in batch.column("ids")]
        keep = [batch.column(c) for c in ("part", "seq", "docs", "lengths")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary()),
            batch.column("tokens_before"), batch.column("tokens")], [x.split()[0] for x in _FILES.split(", ")])


def write_files(docs: DataFrame, path: str, out: str, end_id: int = 1) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the two tables to the folder ``out``."""
    spark = docs.sparkSession
    size = tokens.WordEncoder(path).size
    size, wide = max(size, end_id + 1), max(size, end_id + 1) > 1 << 16
    ordered = docs.where("doc_id is not null").select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    raw = C.cut(ordered.mapInArrow(lambda it: _tokenise(it, path, end_id, size, wide), _RAW))
    counts = C.summed_table(raw.where("counts is not null").select("block", "counts", "salt"), size, 1)  # as large as the vocabulary
    by_rank = np.lexsort((np.arange(size), -counts)).astype(np.uint32)
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size, dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)
    blocks = raw.where("counts is null").select("part", "seq", "docs", "lengths", "ids", "tokens_before",
        "tokens").mapInArrow(lambda it: _compress(it, shared, wide), _FILES)
    blocks.write.option("compression", "uncompressed").parquet(f"{out}/blocks")
    spark.createDataFrame([(bytearray(by_rank.tobytes()),)], "ids binary").write.parquet(f"{out}/ranks")


def _decode(batches, by_rank):
    for batch in batches:
        for base, docs, lengths, control, data, before, n in zip(*(batch.column(c) for c in ("base", "docs", "lengths", "control", "data",
            "tokens_before", "tokens")), strict=True):
            ids = by_rank.value[decode_ranks(control.as_buffer(), data.as_buffer(), n.as_py())].astype("<u4")
            docs, lengths = np.frombuffer(docs.as_buffer(), np.int64), np.frombuffer(lengths.as_buffer(), np.int64)
            ends = np.cumsum(lengths)
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(base.as_py() + before.as_py() + ends - lengths), pa.array(lengths),
                pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a folder."""
    blocks = spark.read.schema(_FILES).parquet(f"{path}/blocks")
    by_rank = spark.sparkContext.broadcast(np.frombuffer(bytes(spark.read.parquet(f"{path}/ranks").first()[0]), np.uint32))
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("n"))  # one row for each part
    bases = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return blocks.join(bases, "part").mapInArrow(lambda it: _decode(it, by_rank), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op7_token_binary_output``: files of the whole of ``documents``, written to the shared folder and read back."""
    out = f"{C.scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
    C.cut(spark.range(0))  # registers the folder for removal
    write_files(C.table(spark, sf_dir, "documents"), C.env_path("word_bpe_49k.json"), out)
    return read_files(spark, out)
