"""Metadata prescreening by keyword evidence: one projection per row, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moiety.functions import scalar as S
from moiety.functions import vocabulary as V

TEXT_COLUMNS = ("title", "description", "filename", "file_names", "categories", "bom_summary")


def joined_text(df: DataFrame) -> Column:
    """Lower-cased text of all descriptive columns that the table has."""
    some = [F.when(F.col(c) != "", F.col(c)) for c in TEXT_COLUMNS if c in df.columns]
    return F.lower(F.concat_ws(" ", *some))


def ranked_labels(text, taxonomy: dict) -> Column:
    """Labels with at least one term in the text, most terms first, then by name: array of (n, label)."""
    scored = [F.struct((-F.size(S.found_terms(text, terms))).alias("n"), F.lit(label).alias("label")) for label, terms in taxonomy.items()]
    return F.array_sort(F.filter(F.array(*scored), lambda x: x["n"] < 0))


def prescreen(df: DataFrame) -> DataFrame:
    """candidate_id, sector and its confidence, domains, components, assembly confidence and score, decision, evidence, caveats.

    ``df`` has id, any of TEXT_COLUMNS, access_status, license, and the counts product_count, assembly_occurrence_count and
    solid_marker_count of a probe; what is missing reads as unknown or 0."""
    or_default = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in df.columns else F.lit(default)
    work = df.select(F.col("id").cast("string").alias("candidate_id"), joined_text(df).alias("text"),
        or_default("access_status", "unknown").alias("access"), F.lower(or_default("license", "unknown")).alias("license"),
                     *(or_default(c, 0).cast("int").alias(c) for c in ("product_count", "assembly_occurrence_count", "solid_marker_count")))
    work = work.select("*", ranked_labels("text", V.SECTORS).alias("sectors"), ranked_labels("text", V.DOMAINS).alias("domains"),
        ranked_labels("text", V.COMPONENTS).alias("components"), S.quantities("text").alias("quantity"),
                       S.contains_any("text", V.STEP_MARKERS).alias("has_step"),
                           S.contains_any("text", V.NEGATIVE_SIGNALS).alias("negative"),
                           *(S.found_terms("text", terms).alias(f"s_{name}") for name, terms in V.ASSEMBLY_SIGNALS.items()))
    structured = (F.col("product_count") >= 2) | (F.col("assembly_occurrence_count") >= 1)
    solid = ~structured & (F.col("solid_marker_count") >= 10)
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = reduce(lambda a, b: a + b, [points(F.size(f"s_{n}") > 0, 3 if n == "explicit_full_assembly" else 2) for n in V.ASSEMBLY_SIGNALS])
    score = score + points(F.size("quantity") > 0, 2) + points(F.col("has_step"), 2) - points(F.col("negative"), 6) + points(structured, 5) + points(solid, 3)
    said = [F.when(F.size(f"s_{n}") > 0, F.concat(F.lit(f"{n}:"), F.array_join(F.slice(f"s_{n}", 1, 4), "|"))) for n in V.ASSEMBLY_SIGNALS]
    said += [F.when(F.size("quantity") > 0, F.concat(F.lit("quantity:"), F.array_join("quantity", "|"))),
        F.when(F.col("has_step"), "step_brep_format"), F.when(F.col("negative"), "negative_single_part_signal"),
             F.when(structured, F.format_string("step_structure:products=%d,occurrences=%d", "product_count",
                 "assembly_occurrence_count")).when(solid, F.format_string("step_structure:solid_markers=%d", "solid_marker_count"))]
    review = F.col("license").isin(*V.UNLICENSED)
    caveats = [F.when(review, "license_requires_review"),
        F.when(F.col("access").isin(*V.CLOSED_ACCESS), F.concat(F.lit("access_"), F.col("access"))),
        F.when(~F.col("has_step"), "no_step_brep_evidence")]
    work = work.withColumn("score", score.cast("int"))
    s = F.col("score")
    decision = (F.when(~F.col("has_step") | (s < 1), "reject_or_metadata_only").when(review,
        "manual_license_review").when((s >= 8) & F.col("access").isin(*V.OPEN_ACCESS), "priority_download")
                .when(s >= 5, "metadata_first").otherwise("manual_assembly_review"))
    best = F.get("sectors", F.lit(0))
    labels = lambda c: F.transform(c, lambda x: x["label"])
    return work.select(
        "candidate_id", F.coalesce(best["label"], F.lit("unknown")).alias("manufacturing_sector"),
            F.when(best["n"] <= -3, "high").when(F.size("sectors") > 0, "medium").otherwise("low").alias("sector_confidence"),
        F.slice(labels("domains"), 1, 4).alias("engineering_domains"), labels("components").alias("possible_components"),
        F.when(s >= 8, "high").when(s >= 5, "medium").otherwise("low").alias("assembly_confidence"), s.alias("assembly_score"), decision.alias("decision"),
        F.array_compact(F.array(*said)).alias("evidence"), F.array_compact(F.array(*caveats)).alias("caveats"))


def summarize(results: DataFrame) -> DataFrame:
    """(dimension, value, n): candidates by sector, domain, component, confidence and decision, in one aggregation."""
    pair = lambda name, value: F.struct(F.lit(name).alias("dimension"), value.alias("value"))
    single = F.array(pair("manufacturing_sector", F.col("manufacturing_sector")), pair("assembly_confidence", F.col("assembly_confidence")),
        pair("decision", F.col("decision")))
    listed = lambda c: F.transform(c, lambda x: pair(c, x))
    lists = [listed(c) for c in ("engineering_domains", "possible_components")]
    return results.select(F.explode(F.flatten(F.array(single, *lists))).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def with_probe(candidates: DataFrame, probes: DataFrame, key: str = "id") -> DataFrame:
    """Candidates with the counts of their probe, where there is one; the candidate's own values otherwise."""
    own = [c for c in probes.columns if c != key]
    renamed = probes.select(key, *(F.col(c).alias(f"probe_{c}") for c in own))
    out = candidates.join(renamed, key, "left")
    return out.select(*(c for c in candidates.columns if c not in own),
        *(F.coalesce(f"probe_{c}", F.col(c) if c in candidates.columns else F.lit(None)).alias(c) for c in own))
