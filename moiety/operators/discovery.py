"""Candidates of several providers: union, gate, one per address, rank."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moiety.functions import scalar as S
from moiety.functions import vocabulary as V

Provider = Callable[[SparkSession, str, list[str]], DataFrame]


def datacite_license(identifier, uri):
    """License name from a rights identifier, else from what the rights address says."""
    named = F.lower(F.coalesce(S.col(identifier), F.lit("")))
    address = F.lower(F.coalesce(S.col(uri), F.lit("")))
    by_id = F.when(named != "", F.upper(named))
    return F.coalesce(by_id, F.when(F.contains(address, F.lit("by-sa/4.0")), "CC-BY-SA-4.0").when(F.contains(address, F.lit("by/4.0")),
        "CC-BY-4.0").when(F.contains(address, F.lit("apache")), "Apache-2.0").when(F.contains(address, F.lit("mit")), "MIT"),
        F.lit("unknown"))


def gated(candidates: DataFrame, most_bytes: int, allowed=V.LICENSES) -> DataFrame:
    """Adds the license and size decision, downgraded where the assembly evidence is weak."""
    out = candidates.withColumn("decision", S.license_decision("license", "expected_bytes", most_bytes, allowed))
    return out.withColumn("decision", S.downgraded("decision", "assembly_confidence")) if "assembly_confidence" in out.columns else out


def best_per_address(candidates: DataFrame, address: str = "download_url", other: str = "landing_url", score: str = "score",
    key: str = "candidate_id") -> DataFrame:
    """The candidate with the highest score of each address (ties: smallest id): an aggregation with map-side combining."""
    where = F.coalesce(F.nullif(F.col(address), F.lit("")), F.col(other))
    order = F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))
    return candidates.groupBy(where.alias("address_")).agg(F.min_by(F.struct(*candidates.columns), order).alias("row")).select("row.*")


def ranked(candidates: DataFrame, score: str = "score", key: str = "candidate_id") -> DataFrame:
    return candidates.orderBy(F.desc(score), key)


def staged(candidates: DataFrame, most: int, key: str = "candidate_id") -> DataFrame:
    """The first staged candidates that have an address."""
    return candidates.where((F.col("decision") == "staged") & (F.coalesce("download_url", F.lit("")) != "")).orderBy(F.desc("score"), key).limit(most)


def discover(spark: SparkSession, providers: dict[str, Provider], names: Iterable[str], gaps: dict[str, list[str]],
    most_types: int = 4) -> tuple[DataFrame | None, list[dict]]:
    """Asks each named provider for each missing type; failures and unknown providers are events, not errors."""
    found, events = None, []
    for kind in list(gaps)[:most_types]:
        for name in names:
            if name not in providers:
                events.append({"provider": name, "type": kind, "status": "unsupported"})
                continue
            try:
                rows = providers[name](spark, kind, gaps[kind])
                events.append({"provider": name, "type": kind, "status": "ok"})
            except OSError as e:
                events.append({"provider": name, "type": kind, "status": "failed", "error": str(e)})
                continue
            found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found, events


def keyword_hits(df: DataFrame, text: str, keywords: list[str]) -> DataFrame:
    """Adds the keywords that stand as whole words in a text."""
    lower = F.lower(F.col(text))
    return df.withColumn("hits", F.array_compact(F.array(*(F.when(S.has_word(lower, k), F.lit(k)) for k in sorted(set(keywords))))))


def window_best(df: DataFrame, by, order) -> DataFrame:
    """First row of each group in an order, by window: for orders that are not one comparable value."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_r = 1").drop("_r")
