"""Group the parts of an assembly: descriptors, distances, complete-link candidates, verification, tables and a manifest."""

from __future__ import annotations

import random
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moiety.operators import cluster, metrics, pairs, records, rigid
from moiety.operators.graph import groups_are_connected
from moiety.operators.numbering import numbered
from moiety.plans.recorder import Recorder
from moiety.sources import step
from moiety.sources.scratch import cut
from moiety.sources.tables import PARTS, SIMILARITIES, write_csv


@dataclass(frozen=True)
class Config:
    """Settings of a run; values out of range are an error."""

    mode: str = "strict"
    threshold: float = 0.12
    precision: str = "rigid"
    size_tolerance: float = 0.03
    vertex_tolerance: float = 1e-5
    label_rounds: int = 3
    allow_unknown_geometry: bool = False
    boolean_relative_tolerance: float = 1e-6
    export_volume_relative_tolerance: float = 1e-6
    precision_workers: int = 4

    def __post_init__(self):
        if self.mode not in ("strict", "family"):
            raise ValueError(f"mode: {self.mode}")
        if self.precision not in ("off", "rigid", "boolean"):
            raise ValueError(f"precision: {self.precision}")
        for name, low, high in (("threshold", 0, 1), ("size_tolerance", 0, 1)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be within {low} and {high}")
        for name, low, high in (("label_rounds", 1, 5), ("precision_workers", 1, 16)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be within {low} and {high}")
        if min(self.vertex_tolerance, self.boolean_relative_tolerance, self.export_volume_relative_tolerance) <= 0:
            raise ValueError("tolerances must be positive")


def verifier(config: Config, own: rigid.Verifier | None = None) -> rigid.Verifier:
    if own is not None:
        return own
    return {"off": rigid.no_check, "rigid": rigid.RigidCheck(config.vertex_tolerance), "boolean": rigid.boolean_check}[config.precision]


def group_parts(spark: SparkSession, texts: DataFrame, exact: DataFrame, out: str, config: Config | None = None, check: rigid.Verifier | None = None) -> dict:
    """Runs all stages over ``texts`` (part, text) and ``exact`` (part, volume, area, edge_length, moments); returns the manifest.

    Exact properties come from a CAD kernel (or any table); exact Boolean checks need one too, as ``check``."""
    config = config or Config()
    rec = Recorder(f"{out}/record", asdict(config))
    with rec.stage("feature_collection") as m:
        scales = exact.select("part", F.pow(F.greatest("volume", F.lit(1e-15)), F.lit(1 / 3)).alias("scale"))
        index = cut(numbered(texts.select("part").distinct(), ["part"], "part_index").select("part", "part_index"))
        parts = cut(step.descriptors(texts, scales, config.label_rounds).join(exact, "part").join(index, "part").withColumn("stable_key",
            F.sha2(F.to_json(F.struct("volume", "area", "edge_length", "moments", F.array_sort(F.map_entries("wl")).alias("wl"))), 256)))
        m["part_count"] = n = parts.count()
    rec.gate("nonempty_model", n > 0)
    unknown = parts.where((F.col("unknown_surface_uses") > 0) | (F.col("unknown_curve_uses") > 0)).select("part").head(1)
    rec.gate("known_geometry", config.allow_unknown_geometry or not unknown)
    with rec.stage("similarity"):
        # beyond the size gate the distance is 1: such pairs matter only where the threshold admits them
        near = cut(pairs.channel_distances(parts, config.mode, config.size_tolerance, gated=config.threshold < 1))
    quality = near.agg(F.count_if(F.isnan("distance") | (F.col("distance") < 0) | (F.col("distance") > 1)).alias("bad")).first()
    rec.gate("distance_matrix_valid", quality.bad == 0)
    with rec.stage("candidate_clustering"):
        candidates = cut(cluster.complete_link(parts, near, config.threshold))
    rec.gate("complete_link", not cluster.complete_link_violations(candidates, near, config.threshold).head(1))
    with rec.stage("precision_verification") as m:
        geometry = cut(step.rigid_geometry(texts))
        shapes = geometry.join(index, "part").join(candidates, "part_index")
        final, checked = rigid.refine(shapes, verifier(config, check))
        final, checked = cut(final), cut(checked)
        m |= records_row(rigid.precision_counters(checked))
    if config.precision != "off":
        proof = groups_are_connected(final.select(F.col("part_index").alias("id"), F.col("group").alias("grp")),
            checked.where("passed").select(F.col("reference_part").alias("a"), F.col("candidate_part").alias("b")))
        rec.gate("precision_partition_proven", not proof.where("not connected").head(1))
    rec.gate("final_group_coverage", not records.incomplete_groups(final, n).head(1))
    with rec.stage("result_materialization"):
        same = near.join(final.select(F.col("part_index").alias("part_a"), F.col("group").alias("ga")),
            "part_a").join(final.select(F.col("part_index").alias("part_b"), F.col("group").alias("gb")), "part_b")
        same = same.withColumn("same_group", F.col("ga") == F.col("gb")).drop("ga", "gb")
        write_csv(result_rows(parts, final, geometry), f"{out}/parts.csv", column_names(PARTS))
        write_csv(same, f"{out}/similarities.csv", column_names(SIMILARITIES))
        cluster.group_summary(final, near).write.mode("overwrite").json(f"{out}/groups")
        checked.write.mode("overwrite").json(f"{out}/precision")
    rec.collect_artifacts(spark, out)
    return rec.complete()


def column_names(schema: str) -> list[str]:
    return [c.split()[0].strip("`") for c in schema.split(", ")]


def result_rows(parts: DataFrame, final: DataFrame, geometry: DataFrame) -> DataFrame:
    """The rows of parts.csv: exact properties where ``parts`` has them, else what its entities and vertices say."""
    rows = parts.join(final.select("part_index", "group"), "part_index").join(geometry.select("part", F.col("points").alias("vertex_xyz")), "part", "left")
    have = {c.lower() for c in parts.columns}
    counted = {"faces": "ADVANCED_FACE", "edges": "EDGE_CURVE", "vertices": "VERTEX_POINT"}
    numbers = [F.col(c).cast("int").alias(c) if c in have else F.coalesce(F.try_element_at("counts", F.lit(kind)),
        F.lit(0)).cast("int").alias(c) for c, kind in counted.items()]
    axis = lambda k: F.transform("vertex_xyz", lambda p: p[k])
    sides = F.col("bbox") if "bbox" in have else F.array(*(F.coalesce(F.array_max(axis(k)) - F.array_min(axis(k)), F.lit(0.0)) for k in range(3)))
    three = lambda values, name: [F.get(F.sort_array(values, False), F.lit(k)).alias(f"{name}_{size}") for k,
        size in enumerate(("max", "mid", "min"))]
    return rows.select("part_index", F.col("label").alias("part_name"), "group", "volume", F.col("area").alias("surface_area"),
        "edge_length", *numbers, *three(sides, "bbox"), *three(F.col("moments"), "moment"), F.col("part").alias("normalized_step"))


def reusable_parts(kept: DataFrame, wanted: DataFrame, key: tuple[str, ...] = ("schema", "source_sha256", "backend")) -> DataFrame:
    """Prepared sources that need no new extraction.

    ``kept``: key, files (array of struct file, bytes, sha256), parts; ``wanted``: key and the files that are there now.  Everything must agree,
    and each part have its two files."""
    now = wanted.select(*key, F.array_sort("files").alias("files_now"))
    same = kept.join(now, list(key)).where((F.array_sort("files") == F.col("files_now")) & (F.size("files") == 2 * F.col("parts")))
    return same.select(*kept.columns)


def records_row(df: DataFrame) -> dict:
    return df.first().asDict()


def threshold_sweep(runs: DataFrame, thresholds: list[float], parts: DataFrame | None = None) -> DataFrame:
    """(run, part_index, threshold, label) of complete-link groups at each threshold; ``runs``: run, part_a, part_b, distance.

    ``parts`` (run, part_index) adds parts that no listed pair has; pairs that are not listed are at 1.  A run's distances are
    grouped in one task; runs and thresholds spread over tasks."""
    if parts is not None:
        runs = runs.select("run", "part_a", "part_b", "distance").unionAll(parts.select("run", "part_index", F.lit(None), F.lit(None)))
    kind = dict(runs.dtypes)["run"]

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        t, run = rows.threshold.iloc[0], rows.run.iloc[0]
        items = sorted({int(i) for i in [*rows.part_a, *rows.part_b.dropna()]})
        rows = rows[rows.part_b.notna()]
        label = _labels(items, [(int(a), int(b), d) for a, b, d in zip(rows.part_a, rows.part_b, rows.distance, strict=True)], t)
        return pd.DataFrame({"run": run, "part_index": items, "threshold": t, "label": [label[i] for i in items]})

    wide = runs.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    return wide.groupBy("run", "threshold").applyInPandas(group, f"run {kind}, part_index long, threshold double, label long")


def _labels(items, listed, threshold, order=None) -> dict:
    rows: dict = {i: [] for i in items}
    for a, b, d in listed:
        rows[a].append(d)
        rows[b].append(d)
    tokens = {i: (str(i).zfill(12), cluster.row_token(rows[i], len(items))) for i in items}
    ranks = {t: k for k, t in enumerate(sorted(set(tokens.values())))}
    order = order or items
    return cluster.complete_link_labels(list(order), {i: ranks[tokens[i]] for i in items}, [(a, b, d) for a, b, d in listed if d <= threshold])


def order_trials(runs: DataFrame, thresholds: list[float], trials: int = 3, seed: int = 7) -> DataFrame:
    """(run, threshold, trial, part_index, base, shuffled): labels in input order and in shuffled orders, to be compared."""
    kind = dict(runs.dtypes)["run"]

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        t, trial = rows.threshold.iloc[0], int(rows.trial.iloc[0])
        items = sorted(set(rows.part_a) | set(rows.part_b))
        listed = list(zip(rows.part_a.tolist(), rows.part_b.tolist(), rows.distance.tolist(), strict=True))
        mixed = items[:]
        random.Random(f"{seed}:{trial}").shuffle(mixed)
        base, other = _labels(items, listed, t), _labels(items, listed, t, mixed)
        return pd.DataFrame({"run": rows.run.iloc[0], "threshold": t, "trial": trial, "part_index": items, "base": [base[i] for i in items],
            "shuffled": [other[i] for i in items]})

    wide = runs.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))).withColumn("trial",
        F.explode(F.array(*(F.lit(k) for k in range(trials)))))
    return wide.groupBy("run", "threshold", "trial").applyInPandas(group, f"run {kind}, threshold double, trial int, part_index long, base long, shuffled long")


def stability(runs: DataFrame, thresholds: list[float], trials: int = 3) -> DataFrame:
    """One row a run: least agreement over shuffled orders, upper median agreement of neighbouring thresholds."""
    ari = metrics.adjusted_rand_index(order_trials(runs, thresholds, trials), "base", "shuffled", ["run", "threshold", "trial"])
    order = ari.groupBy("run").agg(F.min("ari").alias("minimum_order_ari"))
    swept = threshold_sweep(runs, thresholds)
    step_ = {a: b for a, b in zip(sorted(thresholds), sorted(thresholds)[1:], strict=False)}
    nxt = F.coalesce(*(F.when(F.col("threshold") == a, F.lit(float(b))) for a, b in step_.items())) if step_ else F.lit(None).cast("double")
    a = swept.withColumn("next", nxt).where("next is not null")
    b = swept.select("run", "part_index", F.col("threshold").alias("next"), F.col("label").alias("next_label"))
    beside = metrics.adjusted_rand_index(a.join(b, ["run", "part_index", "next"]), "label", "next_label", ["run", "threshold"])
    return order.join(beside.groupBy("run").agg(metrics.upper_median(F.col("ari")).alias("median_adjacent_ari")), "run", "left")


def moved(points: np.ndarray, seed: int) -> np.ndarray:
    """Points after a random proper rotation and shift: for invariance experiments."""
    r = np.random.RandomState(seed)
    q, _ = np.linalg.qr(r.normal(size=(3, 3)))
    if np.linalg.det(q) < 0:
        q[:, 0] = -q[:, 0]
    return points @ q.T + r.normal(size=3) * 10


def rigid_invariance(parts: DataFrame, tolerance: float = 1e-5, seed: int = 11) -> DataFrame:
    """Agreement of representative groups before and after every part is moved at random: it must be 1."""
    kind = dict(parts.dtypes)
    move = F.pandas_udf(lambda i, p: pd.Series([moved(np.array([list(x) for x in q], float), seed + int(k)).tolist() for k,
        q in zip(i, p, strict=True)]), kind["points"])
    a = rigid.representative_groups(parts, tolerance).select("part_index", F.col("group").alias("before"))
    b = rigid.representative_groups(parts.withColumn("points", move("part_index", "points")), tolerance).select("part_index", F.col("group").alias("after"))
    return metrics.adjusted_rand_index(a.join(b, "part_index"), "before", "after")


def fast_against_rigid(fast: DataFrame, exact: DataFrame) -> DataFrame:
    """Pair confusion of fast groups (part_index, group) held against rigid ones."""
    return metrics.pair_confusion(fast.select("part_index",
        F.col("group").alias("p")).join(exact.select("part_index", F.col("group").alias("t")), "part_index"), "t", "p")


def recovered_groups(spark: SparkSession, root: str) -> DataFrame:
    """(run, group, part_count, parts, minimum and mean similarity inside) of runs whose report is lost, from the tables they left."""
    from moiety.sources.tables import read_runs

    parts = read_runs(spark, root).select("run", "part_index", "group")
    near = read_runs(spark, root, "similarities.csv", SIMILARITIES).where("same_group").select("run", F.col("part_a").alias("part_index"), "similarity")
    inner = near.join(parts, ["run", "part_index"]).groupBy("run", "group").agg(F.min("similarity").alias("lo"), F.avg("similarity").alias("mean"))
    sizes = parts.groupBy("run", "group").agg(F.count("*").alias("part_count"), F.array_sort(F.collect_list("part_index")).alias("parts"))
    return sizes.join(inner, ["run", "group"], "left").select("run", "group", "part_count", "parts",
        F.coalesce("lo", F.lit(1.0)).alias("minimum_internal_similarity"), F.coalesce("mean", F.lit(1.0)).alias("mean_internal_similarity"))
