"""A cleaning pipeline over ``documents``: five stages, each one operator of moiety.llm over all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a table.  All but the last return the columns of ``docs``, whatever they
are besides doc_id, text and n_chars; the last returns the pieces of packed sequences.  ``run`` writes what each stage
returns as Parquet in the shared scratch folder and reads it back for the next.

Null texts count as empty everywhere.  Rows of a doc_id that repeats go through each stage like any other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moiety.llm import common, line_dedup, ngram_join, packing, quality, suffix_dedup


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold stay; the classifier learns from the labels of ``sf_dir``."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, from all but the first document that has them; documents left without text go too, unless they had none."""
    lines, gone = (line_dedup.free_name(docs, c) for c in ("line_count", "gone_count"))
    cleaned = line_dedup.remove_repeated_lines(docs, counts=(lines, gone))
    return cleaned.where((F.col(gone) == 0) | (F.trim("text") != "")).select(*docs.columns)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest doc_id stays; rows without a doc_id stay too."""
    groups = ngram_join.similarity_components(docs)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").select(*docs.columns).unionAll(docs.where("doc_id is null"))


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a smaller document has go; a document left without text goes too, unless it had none."""
    flag = line_dedup.free_name(docs, "had_text")
    marked = docs.withColumn(flag, F.trim(F.coalesce("text", F.lit(""))) != "")
    return suffix_dedup.without_repeats(marked).where(~F.col(flag) | (F.trim("text") != "")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, common.env_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_near_copies),
    ("suffix-array dedup", dedup_passages),
    ("best-fit packing", pack_sequences),
]

#: The quality classifier is a trained model, which SQL can't express: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), free=True)
    return STAGES[-1][1](spark, docs, sf_dir)
