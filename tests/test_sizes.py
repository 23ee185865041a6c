"""Cases that only show with larger tables or uneven ones: no rows on one side, large counts, many copies."""

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from moiety import catalog
from moiety.functions import scalar as S
from moiety.operators import cluster, metrics, pairs, review
from moiety.queries import distances


def test_holdout_totals_of_customers_with_both_years(spark, tmp_path):
    rows = [(1, 100.0, 1995), (1, 90.0, 1996), (2, 50.0, 1995), (3, 70.0, 1996), (4, 10.0, 1995), (4, 30.0, 1996), (4, 5.0, 1997), (None, 1.0, 1995)]
    spark.createDataFrame([(k, p, datetime.datetime(y, 5, 1)) for k, p, y in rows],
        "o_custkey long, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.QUERIES["holdout_totals"](spark, str(tmp_path)).first()
    assert (got.run_count, got.minimum_partition_ari, got.runtime_ratio) == (2, 0.9, pytest.approx(120 / 110))


def test_ari_of_counts_whose_product_leaves_a_long(spark):
    df = spark.range(200_000).select((F.col("id") % 2).alias("t"), F.shiftright("id", 1).bitwiseAND(1).alias("p"))
    got = metrics.adjusted_rand_index(df, "t", "p").first()
    assert (got.n, got.ari) == (200_000, pytest.approx(0, abs=1e-4))


def test_pairs_of_large_counts(spark):
    n = [0, 1, 2, 5, 300_000_001, 4_000_000_000]
    got = spark.createDataFrame([(k,) for k in n], "n long").select("n", S.choose2("n").alias("c")).collect()
    assert [(r.n, r.c) for r in got] == [(k, k * (k - 1) // 2) for k in n]


def _grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.group, set()).add(r.part_index)
    return sorted(map(sorted, out.values())), [min(out[g]) for g in sorted(out)]


@pytest.mark.parametrize("threshold", [0.0, 0.0002, 0.01])
def test_groups_of_one_value_are_those_of_all_pairs(spark, threshold):
    r = random.Random(3)
    odd = {200: None, 201: float("nan"), 202: -900.0, 203: -900.01, 204: 0.0, 205: 0.0}
    prices = {k: 900 + r.randrange(60) * r.choice([0.05, 0.05, 1.0]) for k in range(1, 120)} | odd
    keys = list(prices)
    r.shuffle(keys)
    parts = spark.createDataFrame([(k, v, f"{keys.index(k):05}") for k, v in prices.items()], "part_index long, v double, stable_key string")
    near = [(a, b, abs(x - y) / max(abs(x), abs(y), 1e-12)) for a, x in prices.items() for b, y in prices.items() if a < b and x is not None and y is not None]
    listed = spark.createDataFrame([p for p in near if p[2] <= threshold], "part_a long, part_b long, distance double")
    got = cluster.complete_link_values(parts, "v", threshold)
    assert _grouped(got.collect()) == _grouped(cluster.complete_link(parts, listed, threshold).collect())
    assert cluster.value_violations(got, parts, "v", threshold).first().violations == 0


def test_violations_among_all_pairs_of_a_group(spark):
    parts = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 101.0), (4, 110.0), (5, 100.0), (6, 300.0)], "part_index long, v double")
    groups = parts.select("part_index", F.when(F.col("part_index") < 5, 1).otherwise(F.col("part_index")).alias("group"))
    assert cluster.value_violations(groups, parts, "v", 0.02).first().violations == 3


def test_groups_of_many_parts_of_few_prices(spark, tmp_path):
    """Twelve million pairs are within the threshold: a table of them, walked in one task, is not done in time."""
    spark.range(8000).select(F.col("id").alias("p_partkey"), (900 + F.col("id") % 4 / 10).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.QUERIES["complete_link_groups"](spark, str(tmp_path))
    assert sorted(map(tuple, got.groupBy("group_id").agg(F.count("*"), F.min("part_index")).collect())) == [(1, 4000, 0), (2, 4000, 2)]


def _parts(spark, path, rows):
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.mode("overwrite").parquet(
        f"{path}/part.parquet")


def _random_parts(seed, n, odd=()):
    r = random.Random(seed)
    price = lambda k: odd[k % len(odd)] if odd and k % 9 == 0 else 900 + r.randrange(40) * r.choice([0.1, 1e-9, 1.0])
    return [(k, f"name {r.randrange(4)}" if k % 13 else None, f"brand {r.randrange(3)}", r.choice(["x", "y"]), r.randrange(2), price(k)) for k in range(n)]


@pytest.mark.parametrize(("n", "odd"), [(30, ()), (300, ()), (300, (None, -3.0, 1e-14, 2e-14))])
def test_near_misses_are_those_of_all_pairs(spark, tmp_path, n, odd):
    rows = _random_parts(n, n, odd)
    _parts(spark, tmp_path, rows)
    far = lambda x, y: None if x is None or y is None else round(1 - abs(x - y) / max(x, y), 9)
    both = [(a[0], b[0], far(a[5], b[5])) for a in rows for b in rows if a[0] < b[0] and a[3:5] == b[3:5] and a[1] and b[1] and a[1] != b[1]]
    want = sorted(both, key=lambda p: (p[2] is None, -(p[2] or 0), p[0], p[1]))[:50]
    assert [tuple(x) for x in catalog.QUERIES["near_miss_topk"](spark, str(tmp_path)).collect()] == want


def test_near_misses_are_not_sought_among_all_pairs(spark):
    many = spark.range(3000).select("id", F.lit("x").alias("t"), (900 + F.col("id") % 10).cast("double").alias("v"), (F.col("id") % 7).cast("string").alias("name"))
    assert review.nearest_in_groups(many, "id", ["t"], "v", "name", 5).count() < 5000  # of 3.9 million


@pytest.mark.parametrize("odd", [(), (-3.0, 2000.0, -5.0), (None,)])
def test_data_quality_is_that_of_all_pairs(spark, tmp_path, odd):
    rows = _random_parts(8, 120, odd)
    _parts(spark, tmp_path, rows)
    far = [abs(a[5] - b[5]) / max(a[5], b[5]) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2] and a[5] is not None and b[5] is not None]
    got = catalog.QUERIES["data_quality"](spark, str(tmp_path)).first()
    assert (got.part_count, got.least_distance, got.largest_distance) == (120, round(min(far), 9), round(max(far), 9))
    assert got.invalid_distances == sum(not 0 <= d <= 1 for d in far)


def test_extremes_do_not_need_all_pairs(spark):
    many = spark.range(3000).select("id", F.lit("x").alias("b"), (900 + F.col("id") % 500).cast("double").alias("v"))
    assert pairs.extreme_pairs(many, "id", "b", "v").count() == 500 + 499 + 1
    twice = spark.createDataFrame([(1, "x", 5.0), (1, "x", 5.0), (2, "x", 8.0)], "id long, b string, v double")
    assert {tuple(r) for r in pairs.extreme_pairs(twice, "id", "b", "v").collect()} == {(5.0, 8.0)}


@pytest.mark.parametrize("n", [4, 500])
def test_sampled_pairs_are_the_first_digests_of_all(spark, tmp_path, n):
    rows = _random_parts(2, n)
    _parts(spark, tmp_path, rows)
    key = lambda a, b: hashlib.sha256(f"review:{a}:{b}".encode()).hexdigest()
    both = [(a[0], b[0], key(a[0], b[0])) for a in rows for b in rows if a[0] < b[0] and (a[2], a[4]) == (b[2], b[4])]
    got = catalog.QUERIES["hash_sample_pairs"](spark, str(tmp_path)).collect()
    assert [tuple(r)[:3] for r in got] == sorted(both, key=lambda p: p[2])[:40]
    assert {r.inclusion_probability for r in got} <= {round(min(1, 40 / max(1, len(both))), 9)}


def test_lists_make_every_pair_once(spark):
    df = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(None, 1), (3, 1)], "id long, g long")
    lists = pairs.list_pairs(pairs.key_lists(df, "id", ["g"], size=4), ["g"], deal=3)
    got = sorted(map(tuple, pairs.expanded(lists, "a", "b", ["g"]).collect()))
    keys = [[k for k in range(50) if k % 2 == 0], sorted([k for k in range(50) if k % 2] + [3])]
    assert got == sorted((a, b, g) for g in (0, 1) for a in keys[g] for b in keys[g] if a < b)
    assert pairs.pair_count(df, "id", ["g"]).first().n == len(got)
    assert lists.where("size(keys_a) > 4 or size(keys_b) > 4").count() == 0


def _same_as_sql(spark, path, name):
    import duckdb

    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(path)).select("part_a", "part_b", "distance")
    want = con.execute(f"SELECT part_a, part_b, distance FROM ({catalog.ORACLES[name]})").fetchall()
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: (r[0], r[1], r[2] is None, r[2]))
    got, want = order(got.collect()), order(want)
    assert len(want) > 1000 and [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1.1e-6)


def _lines(spark, path, lines):
    spark.createDataFrame(lines, "l_partkey long, l_returnflag string, l_quantity double, l_extendedprice double").repartition(5).write.parquet(f"{path}/lineitem.parquet")


def _bought(spark, path, copies, prices):
    """Parts in interleaved copies with lines of all kinds: no flag, another flag, no price, fractions of a cent; one key stands in three rows."""
    r = random.Random(11)
    kinds = [(f"brand {k % 2}" if k % 7 else None, r.choice(prices)) for k in range(24)]
    lines = {k: [(r.choice(["A", "N", "R", "R", "X", None]), float(r.randrange(1, 50)), r.choice([None, 10.1, 7.07, 1 / 3, 1234.56])) for _ in range(1 + k % 9)] for k in range(24)}
    parts = [(k + c * 24, "x", brand, "x", 1, price) for c in range(copies) for k, (brand, price) in enumerate(kinds)] + [(30, "x", "brand 0", "x", 1, 905.0)] * 2
    _parts(spark, path, parts)
    _lines(spark, path, [(k + c * 24, *x) for c in range(copies) for k, rows in lines.items() for x in r.sample(rows, len(rows))])


@pytest.mark.parametrize("copies, prices", [(8, (900.0, 900.5, 905.0, 1.0)), (8, (905.0, None, 0.0, 1e-12, 9.99e-13, 1.001e-12, -5.0, 905.3))])
def test_weighted_distances_within_a_brand_are_those_of_sql(spark, tmp_path, copies, prices):
    _bought(spark, tmp_path, copies, prices)
    _same_as_sql(spark, tmp_path, "weighted_distance_family")


def test_weighted_distances_of_copies_are_worked_out_once(spark, tmp_path):
    """Lines of copies in another order, in tenths and cents that doubles do not hold: their sums are equal all the same."""
    _parts(spark, tmp_path, [(k, "x", "b", "x", 1, 900.0 + k % 10) for k in range(400)])
    r = random.Random(2)
    lines = {k: [r.randrange(100000) / 100 for _ in range(30)] for k in range(10)}
    _lines(spark, tmp_path, [(k, "N", 1.1, x) for k in range(400) for x in r.sample(lines[k % 10], 30)])
    lists = distances._part_lists(spark, str(tmp_path), ["p_brand"])
    assert [len(x.keys) for x in lists.select("keys").collect()] == [40] * 10
    assert pairs.met_lists(lists, ["p_brand"]).count() == 55  # for 79,800 pairs of parts


@pytest.mark.parametrize("copies, prices", [(12, (900.0, 900.5, 901.8, 1.0)), (8, (905.0, None, 0.0, 1e-12, 9.99e-13, 1.001e-12, -5.0, 905.3, float("inf"), float("nan")))])
def test_weighted_distances_within_the_gate_are_those_of_sql(spark, tmp_path, copies, prices):
    _bought(spark, tmp_path, copies, prices)
    _same_as_sql(spark, tmp_path, "weighted_distance_strict")


def test_lists_within_a_band_meet_once(spark):
    held = spark.range(400).select("id", (900.0 + F.col("id") % 10).alias("v"))
    met = pairs.met_lists(pairs.key_lists(held, "id", ["v"]), [], ("v", 0.002))
    assert sorted((r.v_a, r.v_b) for r in met.collect()) == [(900.0 + a, 900.0 + b) for a in range(10) for b in range(a, min(a + 2, 10))]


def test_pairs_of_few_lists_are_the_work_of_several_tasks(spark, tmp_path):
    """Lists of a few kilobytes stand for two million pairs; lists meet once, so that sizes are compared in both orders of the keys."""
    sizes, prices = (1, 3, 7, 0, None, 50), (900.0, 927.5, None, -3.0)
    _parts(spark, tmp_path, [(k, "x", f"brand {k % 2}" if k % 97 else None, "x", sizes[k % 6], prices[k // 6 % 4]) for k in range(3000)] + [(30, "x", "brand 0", "x", 3, 905.0)] * 2)
    got = catalog.QUERIES["part_pair_distance"](spark, str(tmp_path))
    assert got.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = "part_a, part_b, price_difference, size_distance, size_gate_failed"
    _same_tables(got, _sql(tmp_path, "part_pair_distance", ["part"]), columns)


def test_cosines_of_few_lists_are_the_work_of_several_tasks(spark, tmp_path):
    r = random.Random(4)
    kinds = [[r.choice(["buy", "view", "view", None]) for _ in range(1 + k % 9)] for k in range(60)]
    events = [(u, e) for u in range(1500) for e in kinds[u % 60]] + [(None, "buy")]
    spark.createDataFrame(events, "user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["user_event_cosine"](spark, str(tmp_path))
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    _same_tables(got, _sql(tmp_path, "user_event_cosine", ["events"]), "user_a, user_b, distance")


def _sql(path, name, tables):
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    return con.sql(catalog.ORACLES[name])


def _same_tables(got, want, columns):
    """Pairs are counted by their values on both sides, with sums of keys: millions of them are not collected."""
    a, b, *by = columns.split(", ")
    counted = f"SELECT {', '.join(by)}, count(*), sum({a}), sum({b}), sum({a} * {b}) FROM %s GROUP BY ALL"
    got.createOrReplaceTempView("got_")
    assert {tuple(r) for r in got.sparkSession.sql(counted % "got_").collect()} == set(want.query("want_", counted % "want_").fetchall())


def test_equal_texts_are_described_once(spark, tmp_path, monkeypatch):
    """Parts of few names, sizes and remainders by 7; a key that stands in two rows has a row of its own for each, as in SQL."""
    from moiety.sources import step

    _parts(spark, tmp_path, [(7 * k, f"name {k % 2}", "b", "t", 3, 1.0) for k in range(40)] + [(7, "another", "b", "t", 4, 1.0), (10**10 + 1, "name 0", "b", "t", 3, 1.0)])
    parsed, entities = [], step.entities
    monkeypatch.setattr(step, "entities", lambda texts: (parsed.append(texts.count()), entities(texts))[1])
    got = catalog.QUERIES["step_descriptor"](spark, str(tmp_path)).collect()
    want = _sql(tmp_path, "step_descriptor", ["part"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 42
    assert parsed == [4]
