"""Queries over whole tables that have no SQL, against brute force on small tables."""

import itertools
import random

import pytest

from moiety import catalog
from moiety.operators import cluster
from moiety.sources import probe


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables of a few rows, of which the cut queries leave most out."""
    d = str(tmp_path_factory.mktemp("small"))
    lines = [(o, o % 5, o * 7 % 11) for o in range(1, 60) if o % 5 != 3 or o * 7 % 11 < 4]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k, f"part {k}", k % 50 + 1) for k in range(1, 24)], "p_partkey long, p_name string, p_size int").write.parquet(f"{d}/part.parquet")
    return d


def _components(edges):
    of = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(of[a], of[b])
            changed |= of[a] != m or of[b] != m
            of[a] = of[b] = m
    return of


def test_components_over_all_orders(spark, small):
    edges = [(r[0], -1 - r[1]) for r in spark.read.parquet(f"{small}/lineitem.parquet").select("l_suppkey", "l_partkey").collect()]
    got = dict(map(tuple, catalog.QUERIES["cc_supplier_part"](spark, small).select("id", "component").collect()))
    assert got == _components(edges)


def test_descriptors_of_all_parts(spark, small):
    got = {tuple(r) for r in catalog.QUERIES["step_descriptor"](spark, small).select("part", "label", "faces", "vertex_points",
        "boundary_edges", "surface", "curve").collect()}
    assert got == {(k, f"part {k}", 1, 2, 1, "PLANE", "LINE") for k in range(1, 24)}


def test_markers_in_the_first_and_last_mebibyte(spark, tmp_path):
    data = bytearray(b" " * 2_500_000)
    for at in (10, 70_000, 1_000_000, 1_600_000, 2_400_000):
        data[at:at + 8] = b"PRODUCT("
    (tmp_path / "a.step").write_bytes(data)
    files = probe.read_files(spark, f"file://{tmp_path}")
    assert probe.step_markers(files, "head").first()["product_count"] == 3
    assert probe.step_markers(files, "tail").first()["product_count"] == 2


def test_latest_and_markers_of_all_rows(spark, small, tmp_path):
    got = {tuple(r) for r in catalog.QUERIES["latest_by_key"](spark, small).select("p_partkey", "initial").collect()}
    assert got == {(k, "P") for k in range(1, 24)}
    spark.createDataFrame([(1, "x product( y PRODUCT("), (3, "none"), (5, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.doc_id, r.product_count) for r in catalog.QUERIES["step_markers"](spark, str(tmp_path)).collect()} == {(1, 3), (3, 0), (5, 2)}


def test_weighted_distances_of_all_pairs(spark, tmp_path):
    spark.createDataFrame([(k, f"brand {k % 2}", k * 9, 1000.0 + k) for k in range(1, 7)],
        "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, "N", 1.0 * k, 10.0 * k) for k in range(1, 7)],
        "l_partkey long, l_returnflag string, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = lambda mode: {(r.part_a, r.part_b) for r in catalog.QUERIES[f"weighted_distance_{mode}"](spark, str(tmp_path)).collect()}
    pairs = [(a, b) for a in range(1, 7) for b in range(a + 1, 7)]
    assert got("strict") == {(a, b) for a, b in pairs if (b - a) / (1000 + b) <= 0.002}
    assert got("family") == {(a, b) for a, b in pairs if (a - b) % 2 == 0}


def test_shapes_of_all_parts(spark, small):
    got = {}
    for r in catalog.QUERIES["rigid_group"](spark, small).collect():
        got.setdefault(r.group_id, set()).add(r.part_index)
    assert sorted(map(sorted, got.values())) == [[k for k in range(1, 24) if k % 4 == m] for m in (1, 2, 3, 0)]


def test_groups_by_price_are_the_definition(spark, tmp_path):
    """complete_link_groups against merging the nearest two groups, over and over, among all pairs of groups."""
    r = random.Random(5)
    prices = {k: 1000.0 + r.randrange(40) * 0.05 for k in range(1, 40)}
    spark.createDataFrame([(k, v) for k, v in prices.items()], "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = {}
    for row in catalog.QUERIES["complete_link_groups"](spark, str(tmp_path)).collect():
        got.setdefault(row.group_id, set()).add(row.part_index)
    far = lambda a, b: abs(prices[a] - prices[b]) / max(prices[a], prices[b])
    keys = sorted(prices)
    token = {k: (str(k).zfill(12), cluster.row_token([far(k, j) for j in keys if j != k and far(k, j) <= 0.0002], len(keys))) for k in keys}
    rank = {k: sorted(token.values()).index(token[k]) for k in keys}
    groups = [[k] for k in keys]
    while True:
        best = min(((max(far(a, b) for a in x for b in y), sorted(rank[k] for k in x + y), min(x), min(y), x, y) for x,
            y in itertools.combinations(groups, 2)), default=None)
        if best is None or best[0] > 0.0002:
            break
        groups = [g for g in groups if g is not best[4] and g is not best[5]] + [best[4] + best[5]]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))
    assert [min(got[g]) for g in sorted(got)] == sorted(min(g) for g in groups)
