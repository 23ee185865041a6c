"""Partitions, thresholds, weighted accuracy, gates."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from moiety.functions import scalar as S
from moiety.operators import metrics, records
from moiety.operators.numbering import upper_medians
from moiety.queries.registry import query, table
from moiety.sources.scratch import cut

C2 = "({0} * ({0} - 1) / 2)"


def _pair_sql(source: str, t: str, p: str, by: str = "") -> str:
    b, g = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    using = f"JOIN {{0}} USING ({by})" if by else "CROSS JOIN {0}"
    return f"""
cells AS (SELECT {b}{t} AS t, {p} AS p, count(*)::DOUBLE AS n FROM {source} GROUP BY ALL), totals AS (SELECT {b}sum({C2.format('n')}) AS both_, sum(n) AS n FROM cells {g}),
ts AS (SELECT {b}sum({C2.format('m')}) AS same_t FROM (SELECT {b}t, sum(n) AS m FROM cells GROUP BY ALL) {g}), ps AS (SELECT {b}sum({C2.format('m')}) AS same_p FROM (SELECT {b}p, sum(n) AS m FROM cells GROUP BY ALL) {g}),
c AS (SELECT * FROM totals {using.format('ts')} {using.format('ps')})"""


@query(f"""
WITH {_pair_sql('part', 'p_brand', 'p_type')}
SELECT n::BIGINT AS n, round((both_ - same_t * same_p / {C2.format('n')}) / ((same_t + same_p) / 2 - same_t * same_p / {C2.format('n')}), 9) AS ari FROM c""")
def ari_two_labelings(spark, sf_dir):
    return metrics.adjusted_rand_index(table(spark, sf_dir, "part"), "p_brand", "p_type").select("n", F.round("ari", 9).alias("ari"))


@query(f"""
WITH {_pair_sql('labels', 'quality', 'toxic')}, x AS (SELECT both_ AS tp, same_p - both_ AS fp, same_t - both_ AS fn, {C2.format('n')} - same_p - same_t + both_ AS tn FROM c)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(tp / (tp + fp), 9) AS "precision", round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy FROM x""")
def pair_confusion(spark, sf_dir):
    out = metrics.pair_confusion(table(spark, sf_dir, "labels"), "quality", "toxic")
    return out.select("tp", "fp", "fn", "tn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


THRESHOLDS = (2.0, 5.0, 10.0, 20.0, 50.0)
SWEPT = f"s AS (SELECT p_brand AS run, t AS threshold, floor(p_retailprice / t)::BIGINT AS label, p_name AS final FROM part CROSS JOIN (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in THRESHOLDS)}]) AS t))"


def _swept(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in THRESHOLDS))))
    return part.select(F.col("p_brand").alias("run"), "threshold", F.floor(F.col("p_retailprice") / F.col("threshold")).alias("label"),
        F.col("p_name").alias("final"))


TOTALS = f"""{SWEPT}, {_pair_sql('s', 'final', 'label', 'run, threshold').strip()},
totals_ AS (SELECT threshold, sum(same_p)::BIGINT AS candidate_pair_workload, sum(same_t)::BIGINT AS final_same_pairs, sum(both_)::BIGINT AS captured_same_pairs, sum(same_p - both_)::BIGINT AS false_pair_workload, round(sum(both_) / sum(same_t), 9) AS final_pair_recall FROM c GROUP BY threshold)"""


@query(f"WITH {TOTALS} SELECT * FROM totals_")
def threshold_recall_workload(spark, sf_dir):
    out = metrics.threshold_totals(_swept(spark, sf_dir), "run", "threshold", "label", "final")
    return out.withColumn("final_pair_recall", F.round("final_pair_recall", 9))


@query(f"""
WITH {TOTALS}, best AS (SELECT threshold, candidate_pair_workload FROM totals_ WHERE final_pair_recall >= 0.1::DOUBLE ORDER BY candidate_pair_workload, threshold LIMIT 1),
r AS (SELECT best.threshold AS t, 1 - best.candidate_pair_workload / base.candidate_pair_workload AS gain FROM best, totals_ base WHERE base.threshold = 50)
SELECT CASE WHEN gain >= 0.01::DOUBLE THEN t END AS recommended_threshold, t AS best_eligible_threshold, round(gain, 9) AS best_workload_reduction, CASE WHEN gain >= 0.01::DOUBLE THEN 'proposal_requires_holdout_validation' ELSE 'no_material_gain' END AS recommendation_status FROM r""")
def threshold_recommendation(spark, sf_dir):
    totals = metrics.threshold_totals(_swept(spark, sf_dir), "run", "threshold", "label", "final")
    return metrics.recommend_threshold(totals, "threshold", 0.1, 50.0, 0.01).withColumn("best_workload_reduction", F.round("best_workload_reduction", 9))


@query(f"""
WITH {SWEPT}, n AS (SELECT run, threshold, count(DISTINCT label) AS groups_ FROM s GROUP BY ALL)
SELECT * FROM (SELECT run, threshold, groups_ AS n_groups, lead(threshold) OVER w AS next_threshold, lead(groups_) OVER w AS next_n_groups FROM n WINDOW w AS (PARTITION BY run ORDER BY threshold)) WHERE next_threshold IS NOT NULL""")
def adjacent_threshold_delta(spark, sf_dir):
    groups = _swept(spark, sf_dir).groupBy("run", "threshold").agg(F.count_distinct("label").alias("n_groups"))
    return metrics.adjacent(groups, "run", "threshold", "n_groups").withColumnRenamed("next_value", "next_n_groups")


@query("SELECT event_type, list_sort(list(value))[(count(*) // 2 + 1)::BIGINT] AS upper_median, min(value) AS least, bool_and(value >= 0) AS all_nonnegative FROM events GROUP BY event_type")
def upper_median_value(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    ranges = events.groupBy("event_type").agg(F.min("value").alias("least"), F.bool_and(F.col("value") >= 0).alias("all_nonnegative"))
    return ranges.join(upper_medians(events, "event_type", "value").withColumnRenamed("median", "upper_median"), "event_type", "left")


Z = "1.959963984540054::DOUBLE"


def _wilson_sql(k: str, n: str, sign: str) -> str:
    p = f"({k}::DOUBLE / {n})"
    return f"(({p} + {Z} * {Z} / (2 * {n})) / (1 + {Z} * {Z} / {n}) {sign} {Z} * sqrt({p} * (1 - {p}) / {n} + {Z} * {Z} / (4.0::DOUBLE * {n} * {n})) / (1 + {Z} * {Z} / {n}))"


@query(f"""
WITH r AS (SELECT lang, count(*) AS n, sum(quality)::BIGINT AS k FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, n, k AS good, round(greatest(0::DOUBLE, {_wilson_sql('k', 'n', '-')}), 9) AS wilson_low, round(least(1::DOUBLE, {_wilson_sql('k', 'n', '+')}), 9) AS wilson_high FROM r""")
def wilson_quality_by_lang(spark, sf_dir):
    labelled = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    low, high = S.wilson("good", "n")
    return labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("good")).select("lang", "n", "good",
        F.round(low, 9).alias("wilson_low"), F.round(high, 9).alias("wilson_high"))


@query(f"""
WITH r AS (SELECT lang AS stratum, (doc_id % 7 + 1) / 10.0::DOUBLE AS probability, CASE WHEN toxic = 1 THEN NULL ELSE quality = 1 END AS correct FROM documents JOIN labels USING (doc_id)),
a AS (SELECT coalesce(stratum, 'all') AS stratum, count(*) AS labeled, count(correct) AS decided, count(*) - count(correct) AS uncertain, coalesce(sum(correct::INT), 0)::BIGINT AS correct, sum(correct::INT / probability) / sum(CASE WHEN correct IS NOT NULL THEN 1 / probability END) AS estimate FROM r GROUP BY ROLLUP (stratum))
SELECT stratum, labeled, decided, uncertain, correct, round(estimate, 9) AS estimate, round(greatest(0::DOUBLE, {_wilson_sql('correct', 'decided', '-')}), 9) AS wilson_low, round(least(1::DOUBLE, {_wilson_sql('correct', 'decided', '+')}), 9) AS wilson_high FROM a""")
def stratum_rollup(spark, sf_dir):
    labelled = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = labelled.select(F.col("lang").alias("stratum"), ((F.col("doc_id") % 7 + 1) / F.lit(10.0)).alias("probability"),
        F.when(F.col("toxic") != 1, F.col("quality") == 1).alias("correct"))
    out = metrics.weighted_accuracy(rows, "stratum")
    return out.select("stratum", "labeled", "decided", "uncertain", F.col("correct").cast("long").alias("correct"),
        *(F.round(c, 9).alias(c) for c in ("estimate", "wilson_low", "wilson_high")))


GATES = """
WITH s AS (SELECT count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'O')::DOUBLE / count(*) AS share FROM orders),
c AS (SELECT unnest(['input_order_ari', 'threshold_ari', 'rigid_invariance', 'minimum_completed_assemblies', 'holdout_partition_ari', 'holdout_runtime_ratio', 'human_merge_precision', 'human_merge_precision_lower_bound', 'random_cross_correct_split', 'random_cross_lower_bound']) AS name,
  unnest([true, share >= 0.98::DOUBLE, true, completed >= 20, true, 1.05::DOUBLE <= 1.1::DOUBLE, NULL, NULL, share >= 0.97::DOUBLE, share >= 0.93::DOUBLE]) AS passed FROM s)"""


def _gate_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = o.agg(F.count_if(F.col("o_orderstatus") == "F").alias("boolean_completed_assemblies"),
        (F.count_if(F.col("o_orderstatus") == "O") / F.count("*")).alias("share"))
    given = {"minimum_order_permutation_ari": F.lit(1.0), "median_adjacent_threshold_ari": F.col("share"),
        "rigid_invariance_passed": F.lit(True), "minimum_partition_ari": F.lit("1.0"), "runtime_ratio": F.lit("1.05"),
        "merge_precision": F.lit("n/a"), "merge_precision_low": F.lit(None).cast("string"), "cross_split": F.col("share"),
        "cross_split_low": F.col("share")}
    return records.gate_checks(s.withColumns(given))


@query(GATES + " SELECT name, passed FROM c")
def gate_checks(spark, sf_dir):
    return _gate_rows(spark, sf_dir).select("name", "passed")


@query(GATES + " SELECT CASE WHEN bool_or(NOT passed) THEN 'rejected' WHEN count(*) > count(passed) THEN 'waiting_for_human_labels' ELSE 'eligible_for_promotion' END AS decision, count(*) FILTER (NOT passed) AS n_failed, count(*) - count(passed) AS n_missing FROM c")
def gates_decision(spark, sf_dir):
    return records.gate_decision(_gate_rows(spark, sf_dir)).select("decision", F.size("failed_checks").cast("long").alias("n_failed"),
        F.size("missing_checks").cast("long").alias("n_missing"))


@query("""
WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS s FROM orders GROUP BY ALL), y AS (SELECT min(y) AS a FROM o)
SELECT count(*) AS run_count, round(min(least(1::DOUBLE, n.s / b.s)), 9) AS minimum_partition_ari, round(sum(n.s) / sum(b.s), 9) AS runtime_ratio FROM o b JOIN y ON b.y = y.a JOIN o n ON n.o_custkey = b.o_custkey AND n.y = y.a + 1""")
def holdout_totals(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("seconds"))
    first = o.agg(F.min("y").alias("a"))
    old, new = (o.join(F.broadcast(first), F.col("y") == F.col("a") + k).select("o_custkey", F.col("seconds").alias(f"s{k}")) for k in (0, 1))
    both = cut(old.join(new, "o_custkey"))  # the SQL speaks of customers with orders in both years, and of no others
    old, new = (both.select("o_custkey", F.col(f"s{k}").alias("seconds")) for k in (0, 1))
    agree = both.select("o_custkey", F.least(F.lit(1.0), F.col("s1") / F.col("s0")).alias("ari"))
    return metrics.holdout_totals(old, new, "o_custkey", agree).select("run_count",
        F.round("minimum_partition_ari", 9).alias("minimum_partition_ari"), F.round("runtime_ratio", 9).alias("runtime_ratio"))


def _order():
    return Window.orderBy("s_suppkey")


@query("SELECT s_suppkey, ((row_number() OVER (ORDER BY s_suppkey) - 1) // 4)::BIGINT AS batch, (((row_number() OVER (ORDER BY s_suppkey) - 1) // 4) % 4)::BIGINT AS worker FROM supplier")
def batch_of_four(spark, sf_dir):
    return records.batches(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")
