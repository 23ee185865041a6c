"""Command line: group parts, plan, coverage, discover, optimize, evaluate, benchmark, and the closed cycle of them."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moiety.functions import vocabulary as V
from moiety.operators import coverage as cov
from moiety.operators import discovery, metrics, records
from moiety.plans import recorder, workflow
from moiety.plans.recorder import CycleState
from moiety.sources import probe, step, tables


def _spark() -> SparkSession:
    return SparkSession.builder.appName("moiety").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _taxonomy(config: dict) -> dict:
    return {k: v["keywords"] for k, v in config["coverage"].get("types", {}).items()} or {k: list(v) for k, v in V.TAXONOMY.items()}


def group(a) -> dict:
    spark = _spark()
    config = workflow.Config(mode=a.mode, threshold=a.threshold, precision=a.precision, size_tolerance=a.size_tolerance,
        vertex_tolerance=a.vertex_tolerance, label_rounds=a.label_rounds)
    exact = spark.read.json(a.properties)
    return workflow.group_parts(spark, step.read_step(spark, a.source), exact, a.output, config)


def coverage(a) -> dict:
    """Coverage of the corpus by type, and the gaps, missing types first."""
    spark, config = _spark(), tables.load_config(a.config)
    texts = step.read_step(spark, a.assemblies)
    from moiety.functions import scalar as S

    named = texts.select(F.regexp_extract("part", r"([^/]+)\.[^.]+$", 1).alias("source"),
        F.concat_ws(" ", F.regexp_extract("part", r"([^/]+)\.[^.]+$", 1), F.array_join(S.product_names("text"), " ")).alias("text"))
    rows = cov.coverage(named, cov.taxonomy_table(spark, _taxonomy(config)),
        least_sources=config["coverage"].get("minimum_sources_per_type", 1)).orderBy("type").collect()  # one row a type
    gaps = [r.type for r in rows if r.gap == "missing"] + [r.type for r in rows if r.gap == "undercovered"]
    result = {"semantic_types": [r.asDict() for r in rows], "coverage_gaps": gaps}
    tables.write_json(result, Path(a.output) / "coverage.json")
    return result


def plan(a) -> dict:
    """What a cycle would ask for, without asking."""
    config = tables.load_config(a.config)
    gaps = tables.load_json(Path(a.output) / "coverage.json", {}).get("coverage_gaps", [])
    return {"providers": config["discovery"].get("providers", []), "types": gaps[: config["discovery"].get("max_missing_types_per_cycle", 4)]}


def discover(a) -> dict:
    """Candidates from recorded answers (``--recorded name=folder``); there is no network client here."""
    spark, config = _spark(), tables.load_config(a.config)
    schema = "candidate_id string, title string, download_url string, landing_url string, license string, expected_bytes long, score int, assembly_confidence string"
    providers = {n: probe.recorded_provider(p, schema, n) for n, p in (x.split("=", 1) for x in a.recorded)}
    gaps = tables.load_json(Path(a.output) / "coverage.json", {}).get("coverage_gaps", [])
    taxonomy, d = _taxonomy(config), config["discovery"]
    found, events = discovery.discover(spark, providers, d.get("providers", list(providers)),
        {g: taxonomy[g] for g in gaps if g in taxonomy}, d.get("max_missing_types_per_cycle", 4))
    n = 0
    if found is not None:
        chosen = discovery.best_per_address(discovery.gated(found, d.get("maximum_file_bytes", 1 << 29), d.get("allowed_licenses", V.LICENSES)))
        staged = discovery.staged(chosen, config["cycle"].get("maximum_new_sources", 5))
        tables.write_csv(staged, f"{a.output}/staged")
        n = staged.count()
    return {"query_count": len(events), "events": events, "staged": n}


def _sweep(spark: SparkSession, a, config: dict) -> DataFrame:
    near = tables.read_runs(spark, a.runs, "similarities.csv", tables.SIMILARITIES).select("run", "part_a", "part_b", "distance")
    final = tables.read_runs(spark, a.runs).select("run", F.col("part_index").cast("long").alias("part_index"), F.col("group").alias("final"))
    swept = workflow.threshold_sweep(near, config["optimization"].get("thresholds", [0.12]), final)
    return swept.join(final, ["run", "part_index"])


def optimize(a) -> dict:
    spark, config = _spark(), tables.load_config(a.config)
    o = config["optimization"]
    totals = metrics.threshold_totals(_sweep(spark, a, config), "run", "threshold", "label", "final")
    best = metrics.recommend_threshold(totals, "threshold", o.get("minimum_final_pair_recall", 1.0), o.get("baseline_threshold", 0.12),
        o.get("minimum_workload_reduction", 0.01)).first()
    result = {"thresholds": [r.asDict() for r in totals.orderBy("threshold").collect()], **best.asDict()}  # one row a threshold
    tables.write_json(result, Path(a.output) / "thresholds.json")
    return result


def evaluate(a) -> dict:
    spark, config = _spark(), tables.load_config(a.config)
    limits = {**V.GATE_LIMITS, **config["quality_gates"]}
    schema = "minimum_order_permutation_ari string, median_adjacent_threshold_ari string, rigid_invariance_passed boolean, boolean_completed_assemblies string, minimum_partition_ari string, runtime_ratio string, merge_precision string, merge_precision_low string, cross_split string, cross_split_low string"
    checks = records.gate_checks(tables.read_json(spark, a.summary, schema), limits)
    result = {**records.gate_decision(checks).first().asDict(), "checks": [r.asDict() for r in checks.collect()]}  # ten rows
    tables.write_json(result, Path(a.output) / "gates.json")
    return result


def benchmark(a) -> dict:
    """Agreement and runtime of two folders of runs, by run."""
    spark = _spark()
    old, new = (tables.read_runs(spark, p).select("run", "part_index", F.col("group").alias(n)) for p, n in ((a.baseline, "old"), (a.candidate, "new")))
    ari = metrics.adjusted_rand_index(old.join(new, ["run", "part_index"]), "old", "new", ["run"], undefined=1.0)
    seconds = lambda p: recorder.run_seconds(spark, p)
    return metrics.holdout_totals(seconds(a.baseline), seconds(a.candidate), "run", ari).first().asDict()


def cycle(a) -> dict:
    """Coverage, discovery, threshold search and gates; resumes where an interrupted cycle stopped."""
    state = CycleState(Path(a.output) / "cycle_state.json")
    state.run("coverage", lambda: len(coverage(a)["coverage_gaps"]))
    if not a.offline:
        state.run("discover", lambda: discover(a)["staged"])
    state.run("optimize", lambda: optimize(a)["recommendation_status"])
    decision = state.run("evaluate", lambda: evaluate(a)["decision"])
    state.finish()
    return {"decision": decision, "cycle": state.value["cycle_id"]}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="moiety")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("group", help=workflow.group_parts.__doc__.split("\n")[0])
    g.add_argument("source")
    g.add_argument("--properties", required=True, help="JSON lines: part, volume, area, edge_length, moments")
    g.add_argument("--output", default="out")
    for name, default in (("mode", "strict"), ("precision", "rigid")):
        g.add_argument(f"--{name}", default=default)
    for name, default in (("threshold", 0.12), ("size-tolerance", 0.03), ("vertex-tolerance", 1e-5)):
        g.add_argument(f"--{name}", type=float, default=default)
    g.add_argument("--label-rounds", type=int, default=3)
    g.set_defaults(run=group)
    for f in (plan, coverage, discover, optimize, evaluate, benchmark, cycle):
        c = sub.add_parser(f.__name__, help=f.__doc__)
        c.add_argument("--config", default="config.toml")
        c.add_argument("--output", default="out")
        for name in ("assemblies", "runs", "summary", "baseline", "candidate"):
            c.add_argument(f"--{name}", default=name)
        c.add_argument("--recorded", action="append", default=[])
        c.add_argument("--offline", action="store_true")
        c.set_defaults(run=f)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    print(json.dumps(a.run(a), ensure_ascii=False, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
