"""Catalogues and run indexes: outer-join chains, upserts, summaries, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moiety.functions import scalar as S
from moiety.functions import vocabulary as V
from moiety.operators.naming import free_name
from moiety.operators.numbering import numbered


def left_chain(base: DataFrame, others: list[DataFrame], key: str, default: str = "pending", defaulted: tuple[str, ...] = ()) -> DataFrame:
    """``base`` with the columns of the others by key; named status columns read ``default`` where a row is missing."""
    out = reduce(lambda a, b: a.join(b, key, "left"), others, base)
    return out.select(*(F.coalesce(c, F.lit(default)).alias(c) if c in defaulted else F.col(c) for c in out.columns))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows without a new one, and the new rows."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def latest(df: DataFrame, key: str | list[str], order: list) -> DataFrame:
    """The row of highest priority of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def not_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def by_manifest_order(df: DataFrame, ids: list[str], key: str) -> DataFrame:
    """Rows in the order of a manifest's ids; an id that the manifest repeats counts at its first place."""
    place, name = free_name(df, "manifest_place"), free_name(df, "manifest_id")
    listed = df.sparkSession.createDataFrame([(str(i), k) for k, i in enumerate(dict.fromkeys(map(str, ids)))], f"{name} string, {place} long")
    return df.join(listed, F.col(key).cast("string") == F.col(name)).orderBy(place).drop(place, name)


def incomplete_groups(assignments: DataFrame, n: int) -> DataFrame:
    """Parts 1..n without a group, or groups' parts outside 1..n: none, if the groups cover all."""
    whole = assignments.sparkSession.range(1, n + 1).select(F.col("id").alias("part_index"), F.lit(True).alias("expected"))
    both = whole.join(assignments.select("part_index", "group"), "part_index", "full")
    return both.where("expected is null or `group` is null or `group` = 0")


def batches(df: DataFrame, order: str, size: int = 4, workers: int = 4) -> DataFrame:
    """Numbers rows in an order into batches, and batches to workers in turn."""
    at = free_name(df, "place_in_order")
    n = F.col(at)
    placed = numbered(df, [order], at, 0)
    return placed.withColumn("batch", F.floor(n / size).cast("long")).withColumn("worker", F.pmod(F.floor(n / size), F.lit(workers)).cast("long")).drop(at)


def run_index(reports: DataFrame) -> DataFrame:
    """(id, groups: part counts, pairs: statuses, stages: seconds) as one summary row a run."""
    multi = F.filter("groups", lambda g: g["part_count"] > 1)
    return reports.select("id", F.size("groups").alias("final_groups"), F.size(multi).alias("multi_member_groups"),
        F.aggregate(multi, F.lit(0).cast("long"), lambda s, g: s + g["part_count"]).alias("solids_in_multi_member_groups"),
                          F.size(F.filter("pairs", lambda p: p["status"].isin(*V.UNRESOLVED))).alias("unresolved_pairs"),
                              F.bround(F.aggregate("stages", F.lit(0.0), lambda s, x: s + x["elapsed_seconds"]),
                              3).alias("elapsed_seconds"))


def stage_seconds(stages, name: str) -> Column:
    """Seconds of the first stage of a name in an array of stages; 0 without one."""
    return F.coalesce(F.get(F.filter(stages, lambda s: s["name"] == name), F.lit(0))["elapsed_seconds"], F.lit(0.0))


def corpus_summary(runs: DataFrame) -> DataFrame:
    """Counts and sums over classification runs, in one pass: partial sums in each task."""
    done = F.col("status") == "completed"
    exact = done & (F.col("precision_mode") == "boolean")
    total = lambda c, w: F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0))
    return runs.agg(F.count("*").alias("runs"), F.count_if(done).alias("completed"),
        F.count_if(exact).alias("boolean_completed_assemblies"), F.count_if(F.col("status") == "failed").alias("failed"),
                    total("solids", exact).alias("solids"), total("final_groups", exact).alias("final_groups"),
                        total("multi_member_groups", exact).alias("multi_member_groups"),
                        total("unresolved_pairs", exact).alias("unresolved_pairs"), total("elapsed_seconds", done).alias("elapsed_seconds"))


def data_quality(parts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ids of bad parts, unknown uses, distance range and how many distances are outside [0, 1] or not numbers."""
    ids = lambda w: F.array_sort(F.collect_list(F.when(w, F.col("part_index"))))
    a = parts.agg(F.count("*").alias("part_count"), ids(F.col("volume") <= 0).alias("nonpositive_volume_parts"),
        ids(F.col("faces") <= 0).alias("zero_face_parts"))
    bad = F.isnan("distance") | (F.col("distance") < 0) | (F.col("distance") > 1)
    return a.crossJoin(pairs.agg(F.min("distance").alias("least_distance"), F.max("distance").alias("largest_distance"),
        F.count_if(bad).alias("invalid_distances")))  # one row each


def gate_checks(summary: DataFrame, limits: dict | None = None) -> DataFrame:
    """(name, passed, observed, required) of the ten promotion gates over one summary row of strings or numbers.

    Stability values that are missing count as 0 and fail; benchmark and human values that are missing wait."""
    g = limits or V.GATE_LIMITS
    n = S.number_or_null
    zero = lambda c: F.coalesce(n(c), F.lit(0.0))
    check = lambda name, passed, observed, required: F.struct(F.lit(name).alias("name"), passed.alias("passed"),
        S.col(observed).cast("string").alias("observed"), F.lit(str(required)).alias("required"))
    least = lambda name, c, limit: check(name, n(c) >= float(g[limit]), c, g[limit])
    checks = F.array(
        check("input_order_ari", zero("minimum_order_permutation_ari") >= float(g["minimum_order_ari"]), "minimum_order_permutation_ari",
            g["minimum_order_ari"]),
        check("threshold_ari", zero("median_adjacent_threshold_ari") >= float(g["minimum_threshold_ari"]), "median_adjacent_threshold_ari",
            g["minimum_threshold_ari"]),
        check("rigid_invariance", F.coalesce(F.col("rigid_invariance_passed"), F.lit(False)), "rigid_invariance_passed", True),
        check("minimum_completed_assemblies", zero("boolean_completed_assemblies") >= int(g["minimum_completed_assemblies"]),
            "boolean_completed_assemblies", g["minimum_completed_assemblies"]),
        least("holdout_partition_ari", "minimum_partition_ari", "minimum_holdout_partition_ari"),
        check("holdout_runtime_ratio", n("runtime_ratio") <= float(g["maximum_holdout_runtime_ratio"]), "runtime_ratio", g["maximum_holdout_runtime_ratio"]),
        least("human_merge_precision", "merge_precision", "minimum_merge_precision"),
            least("human_merge_precision_lower_bound", "merge_precision_low", "minimum_merge_precision_lower_bound"),
        least("random_cross_correct_split", "cross_split", "minimum_random_cross_correct_split"),
            least("random_cross_lower_bound", "cross_split_low", "minimum_random_cross_lower_bound"))
    return summary.select(F.explode(checks).alias("c")).select("c.*")


def gate_decision(checks: DataFrame) -> DataFrame:
    """One row: decision, failed and missing checks."""
    names = lambda w: F.array_sort(F.collect_list(F.when(w, F.col("name"))))
    out = checks.agg(names(F.col("passed") == F.lit(False)).alias("failed_checks"), names(F.col("passed").isNull()).alias("missing_checks"))
    return out.select(F.when(F.size("failed_checks") > 0, "rejected").when(F.size("missing_checks") > 0,
        "waiting_for_human_labels").otherwise("eligible_for_promotion").alias("decision"), "failed_checks", "missing_checks")


def reusable(runs: DataFrame, wanted: DataFrame, signature: list[str]) -> DataFrame:
    """Completed runs whose signature is wanted."""
    return runs.where("status = 'completed'").join(wanted.select(*signature).distinct(), signature, "left_semi")


def united(tables: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of several tables by column name, once for each value of ``key``: the first table that has it counts."""
    place = free_name(tables[0], "tier_place")
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (t.withColumn(place, F.lit(k)) for k, t in enumerate(tables)))
    return latest(every, key, [F.asc(place)]).drop(place)


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows of each status, most first."""
    return df.groupBy(status).agg(F.count("*").alias("n")).orderBy(F.desc("n"), status)


def largest_runs(runs: DataFrame, n: int = 10, size: str = "solid_count", key: str = "id") -> DataFrame:
    """The n largest runs, ties by key: a top-k report."""
    return runs.orderBy(F.desc(size), key).limit(n)


def by_size(files: DataFrame) -> DataFrame:
    """Files (path, length) in the order of their size, then of their name without folders."""
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1)).orderBy("length", "name")


#: summed over runs of exact verification: name, column
_SUMS = (("total_solids", "solid_count"), ("total_final_groups", "final_groups"), ("total_multi_member_groups", "multi_member_groups"),
    ("total_solids_in_repeated_groups", "solids_in_multi_member_groups"),
         ("total_checked_pairs", "checked_pairs"), ("total_split_pairs", "split_pairs"),
             ("total_verified_different_pairs", "verified_different_pairs"), ("total_unresolved_pairs", "unresolved_pairs"))


def corpus_totals(inventory: DataFrame, inspection: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of counts over downloads (status), inspections (id, status, solids) and runs (id, precision_mode and what run reports count).

    Each table is aggregated once; a run's id counts once in the coverage whatever its tiers, and ids that are admitted and in no run are counted, not listed."""
    admitted = F.col("status") == "admitted"
    exact, rigid = (F.col("precision_mode") == m for m in ("boolean", "rigid"))
    sum_ = lambda c: F.coalesce(F.sum(F.when(exact, F.col(c))), F.lit(0)).cast("long")
    got = inventory.agg(F.count_if(F.col("status").isin("downloaded", "verified")).alias("downloaded_files"))
    seen = inspection.agg(F.count("*").alias("inspected_files"), F.count_if(admitted).alias("admitted_assemblies"),
        F.count_if(~admitted).alias("rejected_files"),
                          *(F.count_if(admitted & (F.col("solids") >= k)).alias(f"admitted_at_least_{k}_solids") for k in (30, 50, 200)))
    done = runs.agg(F.count_if(exact).alias("boolean_completed_assemblies"), *(sum_(c).alias(f"boolean_{name}") for name, c in _SUMS),
                    F.count_if(exact & (F.col("multi_member_groups") > 0)).alias("boolean_assemblies_with_repeated_geometry"),
                    F.count_if(exact & (F.col("unresolved_pairs") == 0)).alias("boolean_zero_unresolved_assemblies"),
                        F.count_if(rigid).alias("rigid_screened_assemblies"))
    tiers = runs.groupBy("id").agg(F.bool_or(exact).alias("exact"), F.bool_or(rigid).alias("rigid"))
    each = inspection.where(admitted).select("id", F.lit(True).alias("admitted")).distinct().join(tiers, "id", "full")
    covered = F.coalesce(F.col("exact") | F.col("rigid"), F.lit(False))
    cover = each.agg(F.count_if(covered).alias("covered_by_either_tier"), F.count_if(F.col("rigid") & ~F.col("exact")).alias("rigid_only_assemblies"),
                     F.count_if(F.col("admitted") & ~covered).alias("unclassified_admitted"))
    return reduce(lambda a, b: a.crossJoin(b), (seen, done, cover), got)  # one row each
