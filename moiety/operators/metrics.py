"""How two partitions agree, threshold sweeps, weighted accuracy: contingency aggregates without pair joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moiety.functions import scalar as S


def pair_counts(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """n, and pairs that are together in both partitions, in truth, in prediction: three counts by group, no pair made."""
    by = by or []
    cells = df.groupBy(*by, truth, predicted).agg(F.count("*").alias("n"))
    together = cells.groupBy(*by).agg(F.sum(S.choose2("n")).alias("both"), F.sum("n").alias("n"))
    sums = []
    for column, name in ((truth, "same_truth"), (predicted, "same_predicted")):
        one = cells.groupBy(*by, column).agg(F.sum("n").alias("m")).groupBy(*by).agg(F.sum(S.choose2("m")).alias(name))
        sums.append(one)
    join = (lambda x, y: x.join(y, by)) if by else (lambda x, y: x.crossJoin(y))  # one row each without groups
    return join(join(together, sums[0]), sums[1])


def adjusted_rand_index(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None, undefined: float | None = None) -> DataFrame:
    """Adjusted Rand index.  Fewer than two rows: 1.  Zero denominator: ``undefined``, or 1 if the partitions are equal and else 0."""
    c = pair_counts(df, truth, predicted, by)
    total = S.choose2("n").cast("double")
    expected = F.col("same_truth").cast("double") * F.col("same_predicted") / total  # the product of two counts of pairs leaves a long
    top = (F.col("same_truth") + F.col("same_predicted")) / F.lit(2.0)
    equal = (F.col("both") == F.col("same_truth")) & (F.col("both") == F.col("same_predicted"))
    ari = F.when(F.col("n") < 2, 1.0).when(top == expected,
        F.when(equal, 1.0).otherwise(0.0) if undefined is None else F.lit(float(undefined))).otherwise((F.col("both") - expected) / (top - expected))
    return c.select(*(by or []), "n", ari.alias("ari"))


def ratio(a, b, empty: float) -> Column:
    a, b = S.col(a), S.col(b)
    return F.when(b == 0, F.lit(empty)).otherwise(a / F.nullif(b.cast("double"), F.lit(0.0)))


def pair_confusion(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn over all pairs, precision, recall (1 if empty), f1 (0 if empty), accuracy."""
    c = pair_counts(df, truth, predicted, by).withColumn("tp", F.col("both")).withColumn("fp",
        F.col("same_predicted") - F.col("both")).withColumn("fn", F.col("same_truth") - F.col("both"))
    c = c.withColumn("tn", S.choose2("n") - F.col("tp") - F.col("fp") - F.col("fn"))
    c = c.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp"), 1.0)).withColumn("recall", ratio("tp", F.col("tp") + F.col("fn"), 1.0))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0)
    return c.select(*(by or []), "tp", "fp", "fn", "tn", "precision", "recall", f1.alias("f1"),
        ratio(F.col("tp") + F.col("tn"), S.choose2("n"), 1.0).alias("accuracy"))


def threshold_totals(df: DataFrame, run: str, threshold: str, label: str, final: str) -> DataFrame:
    """For each threshold the summed pair workload, final pairs, captured ones, false ones, and the recall (1 without final pairs)."""
    c = pair_counts(df, final, label, [run, threshold]).groupBy(threshold).agg(
        F.sum("same_predicted").alias("candidate_pair_workload"), F.sum("same_truth").alias("final_same_pairs"),
        F.sum("both").alias("captured_same_pairs"), F.sum(F.col("same_predicted") - F.col("both")).alias("false_pair_workload"))
    return c.withColumn("final_pair_recall", ratio("captured_same_pairs", "final_same_pairs", 1.0))


def recommend_threshold(totals: DataFrame, threshold: str, least_recall: float, baseline: float, least_gain: float) -> DataFrame:
    """One row: best eligible threshold (least workload, then least threshold), its gain over the baseline, and a status."""
    ok = F.col("final_pair_recall") >= least_recall
    best = totals.agg(
        F.min(F.when(ok, F.struct(F.col("candidate_pair_workload").alias("w"), F.col(threshold).alias("t")))).alias("best"),
        F.max(F.when(F.col(threshold) == baseline, F.col("candidate_pair_workload"))).alias("base"))
    gain = F.when(F.col("base") > 0, 1 - F.col("best.w") / F.col("base"))
    best = best.select(F.col("best.t").alias("best_eligible_threshold"), gain.alias("best_workload_reduction"))
    good = F.col("best_workload_reduction") >= least_gain
    return best.select(
        F.when(good, F.col("best_eligible_threshold")).alias("recommended_threshold"), "best_eligible_threshold", "best_workload_reduction",
        F.when(good, "proposal_requires_holdout_validation").when(F.col("best_eligible_threshold").isNotNull(),
            "no_material_gain").otherwise("no_eligible_threshold").alias("recommendation_status"))


def upper_median(x) -> Column:
    """Middle of the sorted values, the upper one of two (an exact aggregate)."""
    values = F.sort_array(F.collect_list(x))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def adjacent(df: DataFrame, run: str, threshold: str, value: str) -> DataFrame:
    """Each threshold's value beside that of the next threshold of its run."""
    w = Window.partitionBy(run).orderBy(threshold)
    out = df.withColumn("next_threshold", F.lead(threshold).over(w)).withColumn("next_value", F.lead(value).over(w))
    return out.where("next_threshold is not null")


def weighted_accuracy(records: DataFrame, stratum: str, total_name: str = "all") -> DataFrame:
    """Inverse-probability weighted accuracy of each stratum and of all, with the Wilson interval on unweighted counts.

    ``records``: stratum, probability, correct (null: uncertain)."""
    weight = 1 / F.greatest("probability", F.lit(1e-15))
    decided = F.col("correct").isNotNull()
    rows = records.rollup(stratum).agg(F.grouping(stratum).alias("pooled"), F.count("*").alias("labeled"),
        F.count_if(decided).alias("decided"), F.count_if(~decided).alias("uncertain"),
        F.sum(F.when(F.col("correct"), 1).otherwise(0)).alias("n_correct"),
               (F.sum(F.when(decided, weight * F.col("correct").cast("int"))) / F.sum(F.when(decided, weight))).alias("estimate"))
    low, high = S.wilson("n_correct", "decided")
    return rows.select(F.when(F.col("pooled") == 1, total_name).otherwise(F.col(stratum)).alias("stratum"), "labeled", "decided",
        "uncertain", F.col("n_correct").alias("correct"), "estimate", low.alias("wilson_low"), high.alias("wilson_high"))


def holdout_totals(baseline: DataFrame, candidate: DataFrame, key: str, ari: DataFrame) -> DataFrame:
    """Smallest agreement and total runtime ratio of two sets of runs (``key``, seconds).

    A run without its counterpart, or without an agreement, is an error: the result would speak of fewer runs than were asked for."""
    sides = baseline.select(key, F.lit(1).alias("side")).unionAll(candidate.select(key, F.lit(2))).unionAll(ari.select(key, F.lit(4)))
    missing = sides.groupBy(key).agg(F.bit_or("side").alias("sides")).where("sides <> 7").orderBy(key).limit(5).collect()
    if missing:
        raise KeyError(f"runs without a counterpart: {', '.join(str(r[0]) for r in missing)}")
    both = baseline.select(key, F.col("seconds").alias("old")).join(candidate.select(key, F.col("seconds").alias("new")), key).join(ari, key)
    return both.agg(F.count("*").alias("run_count"), F.min("ari").alias("minimum_partition_ari"), ratio(F.sum("new"), F.sum("old"), 0.0).alias("runtime_ratio"))
