"""Operators against small cases worked out by hand, and against plain versions of themselves."""

import itertools
import json
import math
import random
import shutil
import struct

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from moiety.functions import scalar as S
from moiety.operators import cluster, discovery, graph, kernel, metrics, numbering, pairs, prescreen, records, review, rigid
from moiety.plans import cli, recorder, workflow
from moiety.sources import probe, step, tables


def value(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


# ---------------------------------------------------------------- scalars

@pytest.mark.parametrize("a,b,want", [(1.0, 1.0, 0), (2.0, 1.0, 1 / 3), (0.0, 0.0, 0), (1.0, 0.0, 1), (1e9, 1.0, 1)])
def test_log_ratio(spark, a, b, want):
    assert value(spark, S.log_ratio(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_cosine_and_histogram(spark):
    m = lambda d: F.from_json(F.lit(json.dumps(d)), "map<string,bigint>")
    assert value(spark, S.cosine_distance(m({}), m({}))) == 0
    assert value(spark, S.cosine_distance(m({"a": 1}), m({}))) == 1
    assert value(spark, S.cosine_distance(m({"a": 3, "b": 4}), m({"a": 3, "b": 4}))) == pytest.approx(0)
    assert value(spark, S.cosine_distance(m({"a": 1}), m({"b": 1}))) == 1
    h = lambda x: F.array(*map(F.lit, x))
    assert value(spark, S.histogram_distance(h([1.0, 0.0]), h([0.0, 1.0]))) == 1


def test_unknown_mode_is_an_error():
    with pytest.raises(ValueError):
        S.weighted_total("loose", F.lit(0), F.lit(0), F.lit(0), F.lit(0))


def test_tokens_round_half_to_even(spark):
    assert value(spark, S.length_token(F.lit(0.0))) == "L0"
    assert value(spark, S.length_token(F.lit(10.0))) == "L1.0"
    assert value(spark, S.angle_token(F.lit(math.pi / 2))) == "A90.0"


def test_signature_by_formula(spark):
    assert value(spark, S.geometry_signature(F.lit(100.0), F.lit(40.0), F.lit(12), F.lit(24), F.lit(16))) == "4:3:3:3:2"


def test_words_and_licenses(spark):
    assert not value(spark, S.has_word(F.lit("laser cutting process"), "cutter"))
    assert value(spark, S.has_word(F.lit("end mill tool holder"), "end mill"))
    decide = lambda text, size: value(spark, S.license_decision(F.lit(text), F.lit(size).cast("long"), 1000, ["MIT"]))
    assert [decide("unknown", 100), decide("mit", 100), decide("MIT", 2000), decide("MIT", None)] == ["manual_review", "staged", "rejected", "staged"]


def test_products_and_numbers(spark):
    assert value(spark, S.product_names(F.lit("#1=PRODUCT('M6 screw','','',());#2=PRODUCT('it''s','',());"))) == ["M6 screw", "it's"]
    assert value(spark, S.numbers(F.lit("'x 9',#12,(1.5,-2.,.25E1)"))) == [1.5, -2.0, 2.5]


def test_wilson(spark):
    low, high = S.wilson(F.lit(9), F.lit(10))
    assert value(spark, low) == pytest.approx(0.59584, abs=1e-4) and value(spark, high) == pytest.approx(0.98213, abs=1e-4)
    assert value(spark, S.wilson(F.lit(0), F.lit(0))[0]) is None


def test_stable_id(spark):
    import hashlib

    assert value(spark, S.stable_id(12, F.lit("a"), F.lit("b"))) == hashlib.sha256(b"a\x1fb").hexdigest()[:12]


# ---------------------------------------------------------------- pairs and groups

@pytest.mark.parametrize("tolerance", [0.0, 0.03, 0.3, 1.0])
def test_banded_join_is_the_plain_join(spark, tolerance):
    r = random.Random(4)
    values = [r.choice([0.0, 1e-13, 1e-12, 1.2e-12, -1.0, 1.0, 1.03, 1 / 0.97, 10 ** r.uniform(-13, 6), 5.0]) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double")
    got = {(x.k_a, x.k_b) for x in pairs.banded_pairs(df, "k", "v", tolerance).collect()}
    want = {(i, j) for i, j in itertools.combinations(range(len(values)), 2) if abs(values[i] - values[j]) / max(abs(values[i]),
        abs(values[j]), 1e-12) <= tolerance}
    assert got == want


def _pairs(spark, matrix):
    n = len(matrix)
    return spark.createDataFrame([(i, j, float(matrix[i][j])) for i in range(n) for j in range(i + 1, n)], "part_a long, part_b long, distance double")


def _groups(spark, matrix, threshold, keys=None):
    parts = spark.createDataFrame([(i, (keys or [f"{k:04d}" for k in range(len(matrix))])[i]) for i in range(len(matrix))],
        "part_index long, stable_key string")
    out = cluster.complete_link(parts, _pairs(spark, matrix), threshold).collect()
    return [r.group for r in sorted(out, key=lambda r: r.part_index)]


def test_chain_is_cut(spark):
    assert _groups(spark, [[0, .1, .2], [.1, 0, .1], [.2, .1, 0]], 0.11) == [1, 1, 2]


def test_components_apart_are_the_whole(spark):
    r = np.random.RandomState(3)
    for _ in range(4):
        n = 12
        m = np.round(r.uniform(0, 1, (n, n)) * 5) / 5
        m = np.minimum(m, m.T)
        np.fill_diagonal(m, 0)
        listed = [(i, j, float(m[i][j])) for i in range(n) for j in range(i + 1, n)]
        first = workflow._labels(list(range(n)), listed, 0.3)
        smallest = sorted(set(first.values()))
        assert _groups(spark, m, 0.3, [str(i).zfill(12) for i in range(n)]) == [smallest.index(first[i]) + 1 for i in range(n)]


def test_complete_link_invariant_and_summary(spark):
    m = [[0, .1, .9], [.1, 0, .9], [.9, .9, 0]]
    near = _pairs(spark, m).withColumn("similarity", 1 - F.col("distance"))
    groups = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "part_index long, group long")
    assert cluster.complete_link_violations(groups, near, 0.1).count() == 0
    assert cluster.complete_link_violations(groups, near, 0.05).count() == 1
    rows = {r.group: r for r in cluster.group_summary(groups, near).collect()}
    assert rows[1].minimum_internal_similarity == pytest.approx(.9) and rows[2].mean_internal_similarity == 1.0


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 9), (7, 8), (3, 1)], "a long, b long")
    assert {r.id: r.component for r in graph.connected_components(e).collect()} == {1: 1, 3: 1, 4: 1, 5: 1, 9: 9, 7: 7, 8: 7}
    assert graph.connected_components(e.limit(0)).count() == 0


def test_refinement_does_not_see_names(spark):
    def histogram(shift):
        n = spark.createDataFrame([(i + shift, "x" if i else "y") for i in range(4)], "node long, label string")
        half = [(0, 1), (1, 2), (2, 3)]
        e = spark.createDataFrame([(a + shift, b + shift, "k") for a, b in half + [(b, a) for a, b in half]], "node long, other long, kind string")
        return sorted((r.level, r.label) for r in graph.refine_labels(n, e, 3).collect())

    assert histogram(0) == histogram(1000)


# ---------------------------------------------------------------- metrics

def test_pair_metrics_and_ari(spark):
    df = spark.createDataFrame(list(zip([1, 1, 2, 3], [8, 9, 9, 4], [8, 8, 4, 9], strict=True)), "t int, p int, q int")
    c = metrics.pair_confusion(df, "t", "p").first()
    assert (c.tp, c.fp, c.fn, c.tn) == (0, 1, 1, 4) and c.accuracy == pytest.approx(2 / 3) and c.precision == c.recall == c.f1 == 0
    assert metrics.adjusted_rand_index(df, "t", "q").first().ari == 1.0
    one = spark.createDataFrame([(1, 1), (1, 1), (1, 1)], "t int, p int")
    assert metrics.adjusted_rand_index(one, "t", "p").first().ari == 1.0


def test_upper_median(spark):
    assert spark.range(1, 5).agg(metrics.upper_median(F.col("id")).alias("m")).first().m == 3


def test_no_eligible_threshold(spark):
    totals = spark.createDataFrame([(0.1, 5, 0.5)], "threshold double, candidate_pair_workload long, final_pair_recall double")
    assert metrics.recommend_threshold(totals, "threshold", 1.0, 0.1, 0.01).first().recommendation_status == "no_eligible_threshold"
    totals = spark.createDataFrame([(0.1, 5, 1.0), (0.2, 10, 1.0)], "threshold double, candidate_pair_workload long, final_pair_recall double")
    row = metrics.recommend_threshold(totals, "threshold", 1.0, 0.2, 0.01).first()
    assert row.recommended_threshold == 0.1 and row.best_workload_reduction == 0.5


def test_label_scores(spark):
    queue = spark.createDataFrame([("a", "same", "s1", 1.0), ("b", "different", "random_cross_baseline", 0.5), ("c", "same", "s1", 1.0),
        ("d", "same", "s1", 1.0)], "task_id string, predicted_relation string, selection_stratum string, inclusion_probability double")
    labels = spark.createDataFrame([("a", "correct_merge"), ("b", "correct_split"), ("c", "uncertain"), ("d", ""), ("zz", "correct_merge")],
        "task_id string, human_label string")
    rows = {r.stratum: r for r in review.score_labels(queue, labels).collect()}
    assert (rows["s1"].labeled, rows["s1"].decided, rows["s1"].correct) == (2, 1, 1)
    assert rows["merge_precision"].estimate == 1.0 and rows["random_cross_correct_split"].decided == 1


def test_tasks_are_distinct_and_ordered(spark):
    groups = spark.createDataFrame([(1, 3, [1, 2, 3], 0.9, 0.95), (2, 1, [4], 1.0, 1.0)],
        "group long, part_count long, parts array<long>, minimum_internal_similarity double, mean_internal_similarity double")
    checks = spark.createDataFrame([(1, 1, 4, "alignment_failed", "none")],
        "group long, reference_part long, candidate_part long, status string, reason string")
    near = spark.createDataFrame([(1, 4, 0.8, False), (2, 4, 0.7, False), (1, 2, 0.95, True)],
        "part_a long, part_b long, similarity double, same_group boolean")
    tasks = review.select_tasks("d", groups, checks, near, cross_sample=5, internal_sample=5).collect()
    kinds = [t.item_type for t in tasks]
    assert kinds == ["unresolved_precision", "group_merge", "near_miss_pair", "random_internal_pair"]
    assert len({tuple(sorted(t.part_ids)) for t in tasks if len(t.part_ids) == 2}) == 3


# ---------------------------------------------------------------- rigid matching

CLOUD = np.array([[0, 0, 0], [2, 0, 0], [0, 3, 0], [0, 0, 4], [1, 1, 1.5]], float)


def test_transform_is_found_and_mirrors_are_not():
    c, s = math.cos(0.61), math.sin(0.61)
    turned = CLOUD @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + [7, -4, 2.5]
    found = rigid.rigid_transform(rigid.Shape(CLOUD), rigid.Shape(turned[::-1]), 1e-8)
    assert found and found["max_vertex_error"] < 1e-10 and found["angle_degrees"] == pytest.approx(math.degrees(0.61))
    assert rigid.rigid_transform(rigid.Shape(CLOUD), rigid.Shape(CLOUD * [-1, 1, 1] + 3)) is None
    assert rigid.rigid_transform(rigid.Shape(CLOUD[:2]), rigid.Shape(CLOUD[:2])) is None
    line = np.array([[0, 0, 0], [1, 0, 0], [2, 0, 0]], float)
    assert rigid.rigid_transform(rigid.Shape(line), rigid.Shape(line)) is None
    assert rigid.rigid_transform(rigid.Shape(CLOUD, {(0, 1, "LINE"): 1}), rigid.Shape(CLOUD, {(0, 1, "CIRCLE"): 1})) is None


def test_axis_angle_near_a_half_turn():
    axis, angle = np.array([0.5356, 0.8445, -2e-12]), math.pi - 2e-11
    axis = axis / np.linalg.norm(axis)
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    turn = lambda a, t: np.eye(3) + math.sin(t) * a + (1 - math.cos(t)) * a @ a
    got, degrees = rigid.axis_angle(turn(k, angle))
    g = np.array([[0, -got[2], got[1]], [got[2], 0, -got[0]], [-got[1], got[0], 0]])
    assert np.abs(turn(g, math.radians(degrees)) - turn(k, angle)).max() < 1e-9


def _shapes(spark, clouds, group=None):
    rows = [Row(part_index=i, group=(group or [1] * len(clouds))[i], points=c.tolist(), edges=[], faces=[]) for i, c in enumerate(clouds)]
    return spark.createDataFrame(rows, "part_index long, group long, points array<array<double>>, edges array<struct<i:int,j:int,curve:string,n:long>>, faces array<struct<surface:string,boundary:array<struct<i:int,j:int,curve:string>>,n:long>>")


def test_refinement_rounds_and_representatives(spark):
    clouds = [CLOUD, CLOUD * 2, CLOUD + 5, CLOUD * 2 - 1]
    final, checked = rigid.refine(_shapes(spark, clouds), rigid.RigidCheck())
    assert [r.group for r in final.orderBy("part_index").collect()] == [1, 2, 1, 2]
    counters = rigid.precision_counters(checked).first()
    assert (counters.checked, counters.passed, counters.unresolved) == (4, 2, 2)
    assert [r.group for r in rigid.representative_groups(_shapes(spark, clouds)).orderBy("part_index").collect()] == [1, 2, 1, 2]
    assert workflow.rigid_invariance(_shapes(spark, clouds)).first().ari == 1.0
    pairs_ = rigid.star_pairs(_shapes(spark, clouds), rigid.RigidCheck())
    merged = rigid.groups_from_pairs(_shapes(spark, clouds), pairs_)
    assert [r.group for r in merged.orderBy("part_index").collect()] == [1, 2, 1, 3]


def test_broken_checks_stand_alone(spark):
    final, _ = rigid.refine(_shapes(spark, [CLOUD] * 3), lambda a, b: ("boolean_failed", "timeout", None))
    assert [r.group for r in final.orderBy("part_index").collect()] == [1, 2, 3]
    with pytest.raises(NotImplementedError):
        rigid.boolean_check()


# ---------------------------------------------------------------- STEP

STEP = """#1=CARTESIAN_POINT('',(0.,0.,0.));#2=CARTESIAN_POINT('',(1.,0.,0.));#3=VERTEX_POINT('',#1);#4=VERTEX_POINT('',#2);
#5=LINE('',#1,#20);#6=EDGE_CURVE('',#3,#4,#5,.T.);#7=ORIENTED_EDGE('',*,*,#6,.T.);#8=EDGE_LOOP('',(#7));#9=FACE_OUTER_BOUND('',#8,.T.);
#10=PLANE('',#1);#11=ADVANCED_FACE('',(#9),#10,.T.);#12=CLOSED_SHELL('',(#11));#13=MANIFOLD_SOLID_BREP('sample',#12);"""


def test_step_descriptor(spark):
    import re

    moved = re.sub(r"#(\d+)", lambda m: f"#{int(m[1]) + 10000}", STEP)
    wrapped = STEP.replace("#6=EDGE_CURVE('',#3,#4,#5,.T.);", "#6=EDGE_CURVE('',#3,#4,#30,.T.);#30=SURFACE_CURVE('',#5,(),.PCURVE_S1.);")
    texts = spark.createDataFrame([("a", STEP), ("b", moved), ("c", wrapped)], "part string, text string")
    a, b, c = step.descriptors(texts).orderBy("part").collect()
    assert a.label == "sample" and a.counts["ADVANCED_FACE"] == 1 and a.surfaces == {"PLANE": 1} and a.curves == {"LINE": 1}
    assert sum(a.distances) == pytest.approx(1.0) and (a.vertex_points, a.boundary_edges, a.nodes) == (2, 1, 1)
    assert (a.wl, a.wl_family, a.distances) == (b.wl, b.wl_family, b.distances) and c.curves == {"LINE": 1}


def test_complex_and_repeated_records(spark):
    text = "#1=(BOUNDED_CURVE() B_SPLINE_CURVE(2,(#1,#2),.U.) B_SPLINE_CURVE_WITH_KNOTS((1),(0.),.U.) RATIONAL_B_SPLINE_CURVE((1.)));#2=PLANE('a',#1);#2=CIRCLE('b',#1,3.);#3=nothing;"
    rows = {r.id: r for r in step.entities(spark.createDataFrame([("p", text)], "part string, text string")).collect()}
    assert rows[1].kind == "B_SPLINE_CURVE_WITH_KNOTS" and rows[1].refs == [1, 2] and rows[2].kind == "CIRCLE" and 3 not in rows


def test_histogram_ignores_motion_and_order():
    t = np.linspace(0, 7, 120)
    cloud = np.stack([np.cos(t) * t, np.sin(2 * t), t ** 1.5], axis=1)
    a = step.distance_histogram(cloud)
    assert np.allclose(a, step.distance_histogram(workflow.moved(cloud[::-1], 3)), atol=1e-9)


# ---------------------------------------------------------------- metadata, catalogue, files

def test_prescreen_decisions(spark):
    rows = [("p", "Complete 3D printer assembly STEP file with bill of materials, 40 screws and nuts", "public", "MIT"),
        ("m", "mesh only assembly STL", "public", "MIT")]
    df = spark.createDataFrame(rows, "id string, title string, access_status string, license string")
    out = {r.candidate_id: r for r in prescreen.prescreen(df).collect()}
    assert out["p"].manufacturing_sector == "additive_manufacturing" and out["p"].decision == "priority_download"
    assert out["m"].decision == "reject_or_metadata_only"


def test_best_candidate_and_events(spark):
    c = spark.createDataFrame([("b", "u", "", 3), ("a", "u", "", 3), ("c", "", "l", 1)],
        "candidate_id string, download_url string, landing_url string, score int")
    assert {r.candidate_id for r in discovery.best_per_address(c).collect()} == {"a", "c"}
    found, events = discovery.discover(spark, {}, ["nowhere"], {"gear": ["gear"]})
    assert found is None and events[0]["status"] == "unsupported"
    assert discovery.discover(spark, {}, ["nowhere"], {}) == (None, [])


def test_gates_wait_for_labels(spark):
    row = {"minimum_order_permutation_ari": "1.0", "median_adjacent_threshold_ari": "1.0", "rigid_invariance_passed": True,
        "boolean_completed_assemblies": 25, "minimum_partition_ari": None, "runtime_ratio": None, "merge_precision": None,
        "merge_precision_low": None, "cross_split": "n/a", "cross_split_low": None}
    df = spark.createDataFrame([row], "minimum_order_permutation_ari string, median_adjacent_threshold_ari string, rigid_invariance_passed boolean, boolean_completed_assemblies int, minimum_partition_ari string, runtime_ratio string, merge_precision string, merge_precision_low string, cross_split string, cross_split_low string")
    assert records.gate_decision(records.gate_checks(df)).first().decision == "waiting_for_human_labels"
    assert records.gate_decision(records.gate_checks(df.withColumn("rigid_invariance_passed", F.lit(False)))).first().decision == "rejected"


def test_upsert_latest_and_coverage(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c")], "id int, v string")
    assert {(r.id, r.v) for r in records.upsert(old, new, "id").collect()} == {(1, "a"), (2, "c")}
    groups = spark.createDataFrame([(1, 1), (3, 1)], "part_index long, group long")
    assert [r.part_index for r in records.incomplete_groups(groups, 3).collect()] == [2]
    assert [r.id for r in records.by_manifest_order(old, ["2", "1"], "id").collect()] == [2, 1]


def test_zip_and_stl():
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a/assembly.step", "x")
        z.writestr("b.txt", "y")
    assert probe.zip_names(buffer.getvalue()) == ["a/assembly.step", "b.txt"]
    assert probe.zip_names(buffer.getvalue()[:-60]) in (["a/assembly.step"], ["a/assembly.step", "b.txt"])
    binary = bytes(80) + struct.pack("<I", 1) + struct.pack("<12fH", *range(12), 0)
    assert probe.stl_triangles(binary) == [[[3, 4, 5], [6, 7, 8], [9, 10, 11]]]
    assert probe.stl_triangles(b"vertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nvertex 9 9 9") == [[[0, 0, 0], [1, 0, 0], [0, 1, 0]]]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], None)], "id int, l array<string>, v string")
    tables.write_csv(df, f"file://{tmp_path}/t", ["id", "l", "v", "absent"])
    assert tables.read_csv(spark, f"file://{tmp_path}/t").first().asDict() == {"id": "1", "l": "a | b", "v": None, "absent": None}
    assert tables.read_json(spark, f"file://{tmp_path}/none/*.json", "a int").count() == 0
    kept = tables.checkpoint(spark, f"file://{tmp_path}/c", "s1", lambda: spark.range(3).toDF("id"))
    again = tables.checkpoint(spark, f"file://{tmp_path}/c", "s1", lambda: spark.range(99).toDF("id"))
    assert kept.count() == again.count() == 3
    wanted = spark.createDataFrame([(1, 2), (1, 3)], "reference_part int, candidate_part int")
    old = spark.createDataFrame([(1, 2, "verified", "x"), (1, 3, "alignment_failed", "x")],
        "reference_part int, candidate_part int, status string, signature string")
    done, left = tables.resume_pairs(wanted, old, "x", legacy=True)
    assert done.count() == 1 and left.first().candidate_part == 3
    assert tables.upsert_table(spark, f"file://{tmp_path}/u", spark.range(2).toDF("id"), "id").count() == 2
    assert tables.upsert_table(spark, f"file://{tmp_path}/u", spark.range(1, 4).toDF("id"), "id").count() == 4


def test_config(tmp_path):
    good = "schema_version = 1\n" + "\n".join(f"[{s}]" for s in tables.REQUIRED_SECTIONS)
    (tmp_path / "a.toml").write_text(good)
    assert tables.load_config(tmp_path / "a.toml")["schema_version"] == 1
    (tmp_path / "b.toml").write_text("schema_version = 1\n[cycle]")
    with pytest.raises(ValueError):
        tables.load_config(tmp_path / "b.toml")
    for bad in ({"mode": "x"}, {"threshold": 2.0}, {"vertex_tolerance": 0.0}, {"precision": "exact"}):
        with pytest.raises(ValueError):
            workflow.Config(**bad)


def test_recorder_and_state(spark, tmp_path):
    rec = recorder.Recorder(tmp_path / "r")
    with rec.stage("one") as m:
        m["n"] = 1
    with pytest.raises(recorder.GateFailed):
        rec.gate("g", False)
    assert rec.manifest["status"] == "failed" and tables.read_events(spark, f"file://{tmp_path}/r/workflow_events.jsonl").count() == 3
    state = recorder.CycleState(tmp_path / "s.json")
    assert state.run("a", lambda: 5) == 5
    with pytest.raises(RuntimeError):
        state.run("b", lambda: (_ for _ in ()).throw(RuntimeError()))
    again = recorder.CycleState(tmp_path / "s.json")
    assert again.value["cycle_id"] == state.value["cycle_id"] and again.run("a", lambda: 6) == 5
    again.finish()
    assert recorder.CycleState(tmp_path / "s.json").value["cycle_id"] != state.value["cycle_id"]


def test_sweep_and_stability(spark):
    rows = [("r", 1, 2, 0.1), ("r", 1, 3, 0.2), ("r", 2, 3, 0.1), ("r", 1, 4, 0.9), ("r", 2, 4, 0.9), ("r", 3, 4, 0.9)]
    runs = spark.createDataFrame(rows, "run string, part_a long, part_b long, distance double")
    labels = {(r.threshold, r.part_index): r.label for r in workflow.threshold_sweep(runs, [0.15, 0.25]).collect()}
    assert labels[(0.25, 1)] == labels[(0.25, 3)] == 1 and labels[(0.25, 4)] == 4 and labels[(0.15, 1)] != labels[(0.15, 3)]
    assert workflow.stability(runs, [0.15, 0.25]).first().minimum_order_ari == 1.0


def test_workflow_end_to_end(spark, tmp_path):
    texts = spark.createDataFrame([("a", STEP), ("b", STEP.replace("sample", "other"))], "part string, text string")
    exact = spark.createDataFrame([("a", 8.0, 24.0, 24.0, [1.0, 2.0, 3.0]), ("b", 8.0, 24.0, 24.0, [1.0, 2.0, 3.0])],
        "part string, volume double, area double, edge_length double, moments array<double>")
    manifest = workflow.group_parts(spark, texts, exact, str(tmp_path / "run"), workflow.Config(precision="off"))
    assert manifest["status"] == "completed" and all(g["passed"] for g in manifest["quality_gates"])
    groups = spark.read.json(f"file://{tmp_path}/run/groups").collect()
    assert [g.part_count for g in groups] == [2]


def test_stage_stream(spark, tmp_path):
    from moiety.streaming.stages import stage_stream

    log = tmp_path / "log"
    log.mkdir()
    rec = recorder.Recorder(log)
    with rec.stage("one"):
        pass
    (log / "workflow_manifest.json").unlink()
    q = stage_stream(spark, f"file://{log}").writeStream.format("memory").queryName("stages").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("stages").where("stage = 'one'").first().n == 1


# ---------------------------------------------------------------- numbers, medians, runs

def test_numbers_and_medians_without_one_task(spark):
    r = np.random.RandomState(2)
    rows = [(int(k), float(r.randint(0, 9)), "abc"[r.randint(3)]) for k in r.permutation(500)] + [(900, 1.5, "d"), (901, None, "d"), (902, 2.5, "d")]
    df = spark.createDataFrame(rows, "k long, v double, g string").repartition(7)
    got = numbering.numbered(df.withColumn("offset_x", F.lit(1)), ["k"], "number", 5).orderBy("k").collect()
    assert [x.number for x in got] == list(range(5, 5 + len(rows))) and [x.k for x in got] == sorted(k for k, _, _ in rows)
    medians = {x.g: x.median for x in numbering.upper_medians(df, "g", "v").collect()}
    for g in "abcd":
        values = sorted(v for _, v, h in rows if h == g and v is not None)
        assert medians[g] == values[len(values) // 2]
    batches = {x.k: (x.batch, x.worker) for x in records.batches(df, "k").collect()}
    assert batches[0] == (0, 0) and batches[4] == (1, 1) and batches[17] == (4, 0)


def test_two_conventions_for_an_undefined_index(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 3, 3)], "k long, a long, b long")
    assert metrics.adjusted_rand_index(df, "a", "b").first().ari == 1.0
    lone = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "k long, a long, b long")
    assert metrics.adjusted_rand_index(lone, "a", "b", undefined=1.0).first().ari == 1.0


def test_runs_without_a_counterpart_are_an_error(spark):
    old = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "run string, seconds double")
    ari = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "run string, ari double")
    both = metrics.holdout_totals(old, old.withColumn("seconds", F.lit(1.0)), "run", ari).first()
    assert (both.run_count, both.minimum_partition_ari, both.runtime_ratio) == (2, 0.5, 0.5)
    with pytest.raises(KeyError, match="b"):
        metrics.holdout_totals(old, old.where("run = 'a'"), "run", ari)


def test_points_are_matched_in_order_to_the_nearest_free_one():
    r = np.random.RandomState(4)
    for _ in range(60):
        n, tolerance = r.randint(1, 12), 0.15
        target = r.uniform(0, 0.5, (n, 3))
        moved = target[r.permutation(n)] + r.normal(size=(n, 3)) * 0.03
        free, want = set(range(n)), []
        for p in moved:
            near = sorted((float(np.linalg.norm(p - target[k])), k) for k in free)
            if not near or near[0][0] > tolerance:
                want = None
                break
            want.append(near[0][1])
            free.discard(near[0][1])
        got = rigid.match_points(moved, target, tolerance)
        assert (got is None) == (want is None) and (want is None or got.tolist() == want)


def test_prepared_sources_are_reused_only_if_all_agrees(spark):
    kind = "schema int, source_sha256 string, backend string, files array<struct<file:string,bytes:long,sha256:string>>"
    two = [("b.step", 2, "y"), ("a.step", 1, "x")]
    kept = spark.createDataFrame([(5, "s", "k", two, 1), (5, "t", "k", two, 2), (5, "u", "k", two, 1)], kind + ", parts int")
    now = spark.createDataFrame([(5, "s", "k", two[::-1]), (5, "t", "k", two), (5, "u", "k", two[:1])], kind)
    assert [r.source_sha256 for r in workflow.reusable_parts(kept, now).collect()] == ["s"]


CONFIG = """schema_version = 1
[discovery]
providers = []
[cycle]
[quality_gates]
[optimization]
thresholds = [0.12, 0.2]
[coverage.types.fastener]
keywords = ["bolt"]
[coverage.types.gear]
keywords = ["gear"]
"""


def test_command_line_from_group_to_cycle(spark, tmp_path, capsys):
    """What ``group`` writes is what ``benchmark``, ``optimize`` and ``cycle`` read."""
    source = tmp_path / "source"
    source.mkdir()
    for name in ("bolt", "bolt2", "plate"):
        (source / f"{name}.step").write_text(STEP.replace("sample", name))
    names = {r.part for r in step.read_step(spark, f"file://{source}").collect()}
    values = [{"part": p, "volume": 8.0 if "bolt" in p else 80.0, "area": 24.0, "edge_length": 24.0, "moments": [1.0, 2.0, 3.0]} for p in sorted(names)]
    (tmp_path / "exact.jsonl").write_text("\n".join(map(json.dumps, values)))
    assert cli.main(["group", f"file://{source}", "--properties", f"file://{tmp_path}/exact.jsonl", "--output",
        str(tmp_path / "runs" / "one"), "--precision", "off", "--label-rounds", "1"]) == 0
    shutil.copytree(tmp_path / "runs" / "one", tmp_path / "runs" / "two")
    parts = tables.read_runs(spark, str(tmp_path / "runs"))
    assert parts.columns == [*workflow.column_names(tables.PARTS), "run"]
    got = {(r.run, r.part_index): r for r in parts.collect()}
    assert sorted(got) == [(run, k) for run in ("one", "two") for k in (1, 2, 3)]
    assert got[("one", 1)].group == got[("one", 2)].group != got[("one", 3)].group
    assert got[("one", 1)].moment_max == 3.0 and got[("one", 1)].faces > 0 and got[("one", 1)].normalized_step in names
    again = {(r.run, r.group): (r.part_count, r.parts, r.minimum_internal_similarity) for r in workflow.recovered_groups(spark,
        str(tmp_path / "runs")).collect()}
    assert again[("two", 1)][:2] == (2, [1, 2]) and again[("two", 2)] == (1, [3], 1.0)
    (tmp_path / "config.toml").write_text(CONFIG)
    common = ["--config", str(tmp_path / "config.toml"), "--output", str(tmp_path / "out")]
    (tmp_path / "summary.json").write_text(json.dumps({"minimum_order_permutation_ari": "1.0", "median_adjacent_threshold_ari": "1.0",
        "rigid_invariance_passed": True, "boolean_completed_assemblies": "25"}))
    capsys.readouterr()
    assert cli.main(["benchmark", "--baseline", str(tmp_path / "runs"), "--candidate", str(tmp_path / "runs"), *common]) == 0
    agreed = json.loads(capsys.readouterr().out)
    assert agreed["run_count"] == 2 and agreed["minimum_partition_ari"] == 1.0 and agreed["runtime_ratio"] == 1.0
    assert cli.main(["cycle", "--offline", "--assemblies", f"file://{source}", "--runs", str(tmp_path / "runs"), "--summary",
        str(tmp_path / "summary.json"), *common]) == 0
    assert json.loads(capsys.readouterr().out)["decision"] == "waiting_for_human_labels"
    best = json.loads((tmp_path / "out" / "thresholds.json").read_text())
    assert [t["final_pair_recall"] for t in best["thresholds"]] == [1.0, 1.0]
    assert cli.main(["plan", *common]) == 0 and json.loads(capsys.readouterr().out)["types"] == ["gear"]


def test_batches_that_break_down_are_tried_alone():
    def run(pairs):
        if any(p == "slow" for p in pairs):
            raise TimeoutError
        if any(p == "bad" for p in pairs):
            raise ValueError("no solid")
        return [("verified", "") for _ in pairs]

    got = kernel.in_batches(["a", "b", "c", "d", "e", "slow", "f", "bad", "slow"], run)
    assert [x[0] for x in got] == ["verified"] * 5 + ["boolean_failed", "verified", "boolean_failed", "boolean_failed"]
    assert got[0][2] == 1 and got[4][2] == 2 and got[5][1:] == ("timeout", 2) and got[7][1] == "ValueError: no solid" and got[8][2] == 1


def test_forest_joins_the_first_root_that_passes(spark):
    clouds = [CLOUD, CLOUD * [-1, 1, 1], CLOUD + 1, CLOUD * 2, CLOUD * 2 + 5]
    members, told = rigid.verification_forest(_shapes(spark, clouds), rigid.RigidCheck())
    assert {r.part_index: r["first"] for r in members.collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 3}
    checks = {(r.reference_part, r.candidate_part): r.passed for r in told.collect()}
    assert checks == {(0, 1): False, (0, 2): True, (0, 3): False, (1, 3): False, (3, 4): True}


def test_extensions_and_checked_pairs(spark):
    got = [value(spark, kernel.address_extension(F.lit(x))) for x in ("https://a/b/C.STP?x=1.zip", "https://a/b/c", "a.b/c#.stl")]
    assert got == [".stp", ".step", ".step"]
    pairs_ = spark.createDataFrame([(k, k + 1) for k in range(5)], "a long, b long")
    rows = kernel.checked_in_batches(pairs_, lambda x: [("different", str(r.a)) for r in x]).collect()
    assert {(r.a, r.status, r.reason, r.attempts) for r in rows} == {(k, "different", str(k), 1) for k in range(5)}
