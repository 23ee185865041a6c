"""Review queues: the riskiest and some random pairs and groups, and how reviewers' labels score."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moiety.functions import scalar as S
from moiety.functions import vocabulary as V
from moiety.operators.metrics import weighted_accuracy
from moiety.operators.pairs import plain_value
from moiety.sources.scratch import cut


def near_misses(pairs: DataFrame, k: int) -> DataFrame:
    """The k most similar pairs of different groups; ties to smaller parts.  A top-k per partition, then one of those."""
    return pairs.where(~F.col("same_group")).orderBy(F.desc("similarity"), "part_a", "part_b").limit(k)


def hash_sample(pairs: DataFrame, k: int, seed: str, a: str = "part_a", b: str = "part_b", n: int | None = None) -> DataFrame:
    """The k pairs with the smallest digest of seed and parts: a sample without replacement that any run repeats.

    Where it is known that there are ``n`` pairs, only digests below a bound that about k + 10 sqrt(k) + 10 of them meet are kept and sorted; should
    fewer than k meet it, all are."""
    keyed = pairs.withColumn("sample_key", S.sample_key(seed, a, b))
    if n is not None and n > (share := k + 10 * k ** 0.5 + 10):
        low = cut(keyed.where(F.col("sample_key") < f"{int(share / n * 16 ** 13):013x}"))
        keyed = low if low.count() >= k else keyed
    return keyed.orderBy("sample_key").limit(k)


def nearest_in_groups(df: DataFrame, key: str, by: list[str], value: str, name: str, k: int) -> DataFrame:
    """Pairs of rows that are equal in ``by`` and different in ``name``, among which are the ``k`` that come first by the rounded similarity
    of ``value``, then by keys; as (part_a, part_b, value_a, value_b).

    A pair comes behind k others if k smaller keys have the value of its first row, each of which makes a pair with one of the two, or k of
    them also the name of its second row; so a few rows of each value stand for it.  Pairs of values that follow each other bound the k-th
    similarity from below, and a banded join makes the pairs within that bound.  Rows whose value is not positive and finite are paired with all."""
    held = df.select(*by, F.col(key).alias("part"), F.col(value).alias("value"), F.col(name).alias("name")).dropna(subset=[*by, "part", "name"])
    held = held.withColumn("odd", ~plain_value("value"))
    plain = held.where("not odd").drop("odd")
    place = lambda *c: F.dense_rank().over(Window.partitionBy(*by, "value", *c).orderBy("part"))
    few = plain.withColumn("in_name", place("name")).where(F.col("in_name") <= k + 1).withColumn("in_value", place())
    few = cut(few.withColumn("first", F.col("in_value") <= k).drop("in_name", "in_value"))
    # some pairs that there are: two names of one value, or of values that follow each other
    ends = few.groupBy(*by, "value").agg(F.min(F.struct("name", "part")).alias("lo"), F.max(F.struct("name", "part")).alias("hi"))
    w = Window.partitionBy(*by).orderBy("value")
    ends = ends.withColumns({"next": F.lead("value").over(w), "next_lo": F.lead("lo").over(w), "next_hi": F.lead("hi").over(w)})
    there = ends.where("lo.name <> hi.name and lo.part <> hi.part").select(F.col("value").alias("value_a"), F.col("value").alias("value_b")).unionAll(
        ends.where("(lo.name <> next_lo.name and lo.part <> next_lo.part) or (lo.name <> next_hi.name and lo.part <> next_hi.part)").select("value", "next"))
    far = [r[0] for r in there.select(S.relative_difference("value_a", "value_b").alias("far")).orderBy("far").limit(k).collect()]
    # similarities are rounded to 9 places; with too few pairs known all are made
    bound = min(far[-1] + 2e-9, 1.0) if len(far) == k else 1.0
    a, b = (few.select(*by, *(F.col(c).alias(f"{c}_{s}") for c in ("part", "value", "name", "first"))) for s in "ab")
    if bound < 1:
        width = -math.log1p(-bound) * 1.001  # room for rounding: the bound is narrow
        band = lambda v: F.floor(F.ln(v) / width)
        a = a.withColumn("band", F.explode(F.array(*(band(F.col("value_a")) + d for d in (-1, 0, 1)))))
        b, on = b.withColumn("band", band(F.col("value_b"))), [*by, "band"]
    else:
        on = by
    close = a.where("first_a").join(b, on).where((F.col("part_a") < F.col("part_b")) & (F.col("name_a") != F.col("name_b")) & (
        S.relative_difference("value_a", "value_b") <= bound))
    out = close.select("part_a", "part_b", "value_a", "value_b")
    a, b = (held.select(*by, *(F.col(c).alias(f"{c}_{s}") for c in ("part", "value", "name", "odd"))) for s in "ab")
    for x, y in ((a.where("odd_a"), b), (a.where("not odd_a"), b.where("odd_b"))):
        out = out.unionAll(x.join(y, by).where("part_a < part_b and name_a <> name_b").select(*out.columns))
    return out


def inclusion_probability(k: int, n):
    return F.least(F.lit(1.0), F.lit(float(k)) / F.greatest(F.lit(1), S.col(n)))


_COLUMNS = ("item_type", "group_a", "part_ids", "group_size", "predicted_relation", "risk_score", "selection_stratum", "inclusion_probability", "evidence")


def _tasks(df: DataFrame, item: str, parts, relation: str, risk, stratum: str, evidence, group=None, size=None, probability=None) -> DataFrame:
    return df.select(F.lit(item).alias("item_type"), (group if group is not None else F.lit(None)).cast("long").alias("group_a"),
        parts.cast("array<long>").alias("part_ids"), (size if size is not None else F.lit(2)).cast("long").alias("group_size"),
        F.lit(relation).alias("predicted_relation"), risk.cast("double").alias("risk_score"), F.lit(stratum).alias("selection_stratum"),
        (probability if probability is not None else F.lit(1.0)).alias("inclusion_probability"), evidence.alias("evidence"))


def select_tasks(dataset: str, groups: DataFrame, checks: DataFrame, pairs: DataFrame, max_groups: int = 20, max_near: int = 20,
    cross_sample: int = 10, internal_sample: int = 10, max_unresolved: int = 20, max_boundary: int = 20) -> DataFrame:
    """The review queue of one run, most urgent first, each pair once.

    ``groups`` as group_summary gives them, ``checks`` as verification does (with boolean_relative_error if known), ``pairs``
    with part_a, part_b, similarity, same_group.  Random pairs are hash samples: the same in every run, though not those
    that a sequential random generator would draw."""
    seed = f"{V.REVIEW_SEED}:{dataset}"
    two = lambda a, b: F.array(F.col(a), F.col(b))
    risky = groups.where("part_count > 1").orderBy("minimum_internal_similarity", F.desc("part_count"), "group").limit(max_groups)
    out = _tasks(risky, "group_merge", F.slice("parts", 1, 3), "same", 1 - F.col("minimum_internal_similarity"), "high_risk_internal",
        F.format_string("min_internal_similarity=%.6f", "minimum_internal_similarity"), F.col("group"), F.col("part_count"))
    if "boolean_relative_error" not in checks.columns:
        checks = checks.withColumn("boolean_relative_error", F.lit(None).cast("double"))
    open_ = checks.where(F.col("status").isin(*V.UNRESOLVED)).orderBy("group", "reference_part", "candidate_part").limit(max_unresolved)
    out = out.unionAll(_tasks(open_, "unresolved_precision", two("reference_part", "candidate_part"), "different", F.lit(1.0),
        "unresolved_precision", F.coalesce("reason", F.lit("")), F.col("group")))
    error = F.nullif(F.col("boolean_relative_error"), F.lit(0.0))
    split = checks.where("status = 'different'").withColumn("e", error).orderBy(F.asc_nulls_last("e"), "reference_part", "candidate_part").limit(max_boundary)
    out = out.unionAll(_tasks(split, "boolean_boundary_split", two("reference_part", "candidate_part"), "different",
        1 / F.greatest(F.coalesce("e", F.lit(1.0)), F.lit(1e-15)), "boolean_boundary_split",
        F.concat(F.lit("boolean_relative_error="), F.coalesce(F.col("boolean_relative_error").cast("string"), F.lit("None"))),
        F.col("group")))
    near = near_misses(pairs, max_near)
    out = out.unionAll(_tasks(near, "near_miss_pair", two("part_a", "part_b"), "different", F.col("similarity"), "high_risk_cross_group",
        F.format_string("cross_group_similarity=%.6f", "similarity")))
    chosen = out.where(F.size("part_ids") == 2).select(F.array_min("part_ids").alias("part_a"), F.array_max("part_ids").alias("part_b"))
    cross, inner = pairs.where(~F.col("same_group")), pairs.where("same_group")
    drawn = hash_sample(cross.join(chosen, ["part_a", "part_b"], "left_anti"), cross_sample, seed).crossJoin(cross.agg(F.count("*").alias("n")))
    out = out.unionAll(_tasks(drawn, "random_cross_pair", two("part_a", "part_b"), "different", F.col("similarity"),
        "random_cross_baseline", F.format_string("random_cross_similarity=%.6f", "similarity"),
        probability=inclusion_probability(cross_sample, "n")))
    inside = hash_sample(inner, internal_sample, seed).crossJoin(inner.agg(F.count("*").alias("n")))
    out = out.unionAll(_tasks(inside, "random_internal_pair", two("part_a", "part_b"), "same", F.lit(0.0), "random_internal_baseline",
        F.lit("random pair from a retained multi-member group"), probability=inclusion_probability(internal_sample, "n")))
    priority = F.coalesce(*(F.when(F.col("item_type") == k, F.lit(v)) for k, v in V.TASK_PRIORITY.items()), F.lit(9))
    pair = F.when(F.size("part_ids") == 2,
        F.concat_ws(":", F.array_min("part_ids"), F.array_max("part_ids"))).otherwise(F.concat_ws(":", "item_type", "group_a"))
    ordered = out.withColumn("p", priority).withColumn("pair", pair)
    first = ordered.withColumn("r", F.row_number().over(Window.partitionBy("pair").orderBy("p", F.desc("risk_score"), "part_ids"))).where("r = 1")
    return first.orderBy("p", F.desc("risk_score"), "part_ids").select(F.lit(dataset).alias("dataset_id"), *_COLUMNS)


def label_records(queue: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled tasks with whether the label confirms the prediction (null: uncertain); unknown tasks and blank labels are left out."""
    both = queue.join(labels.select("task_id", "human_label"), "task_id").where("human_label <> ''")
    right = ((F.col("predicted_relation") == "same") & (F.col("human_label") == "correct_merge")) | ((F.col("predicted_relation") == "different") & (F.col("human_label") == "correct_split"))
    return both.select("task_id", "predicted_relation", F.col("selection_stratum").alias("stratum"),
        F.col("inclusion_probability").cast("double").alias("probability"),
        F.when(F.col("human_label") != "uncertain", right).alias("correct"))


def score_labels(queue: DataFrame, labels: DataFrame) -> DataFrame:
    """Accuracy by stratum, of predicted merges, and of random cross pairs."""
    records = label_records(queue, labels)
    named = lambda df, name: weighted_accuracy(df, "stratum").where(F.col("stratum") == "all").withColumn("stratum", F.lit(name))
    out = weighted_accuracy(records, "stratum").where(F.col("stratum") != "all")
    out = out.unionByName(named(records.where("predicted_relation = 'same'"), "merge_precision"))
    return out.unionByName(named(records.where("predicted_relation = 'different' and stratum = 'random_cross_baseline'"), "random_cross_correct_split"))
