"""Which types of a keyword taxonomy a corpus covers, and how diverse its geometry is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moiety.functions import scalar as S
from moiety.functions import vocabulary as V


def taxonomy_table(spark: SparkSession, taxonomy: dict | None = None) -> DataFrame:
    """(type, keyword); a few hundred rows at most, so joins with it are broadcast."""
    return spark.createDataFrame([(t, k.lower()) for t, words in (taxonomy or V.TAXONOMY).items() for k in words], "type string, keyword string")


def coverage(texts: DataFrame, taxonomy: DataFrame, source: str = "source", text: str = "text", least_sources: int = 1) -> DataFrame:
    """One row a type: covered, source_count, sources, matched_keywords, gap (missing, undercovered or null).

    Keywords are matched anywhere in the lower-cased text.  Types without a hit stay, because the taxonomy is the left side."""
    hits = texts.select(F.col(source).alias("source"), F.lower(text).alias("body")).join(F.broadcast(taxonomy), F.contains(F.col("body"), F.col("keyword")))
    found = hits.groupBy("type").agg(F.count_distinct("source").alias("source_count"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("keyword")).alias("matched_keywords"))
    out = taxonomy.select("type").distinct().join(found, "type", "left")
    n = F.coalesce("source_count", F.lit(0))
    empty = F.array().cast("array<string>")
    return out.select("type", (n > 0).alias("covered"), n.alias("source_count"), F.coalesce("sources", empty).alias("sources"),
        F.coalesce("matched_keywords", empty).alias("matched_keywords"),
                      F.when(n == 0, "missing").when(n < least_sources, "undercovered").alias("gap"))


def signature_counts(parts: DataFrame, source: str) -> DataFrame:
    """Parts and sources of each geometry signature; rare: at most two parts."""
    sig = S.geometry_signature("volume", "surface_area", "faces", "edges", "vertices")
    return parts.groupBy(sig.alias("signature")).agg(F.count("*").alias("part_count"),
        F.count_distinct(source).alias("source_count")).withColumn("rare", F.col("part_count") <= 2)
