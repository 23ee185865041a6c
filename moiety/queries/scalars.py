"""Tokens, names, decisions, numberings and unions over the driver tables."""

from pyspark.sql import functions as F

from moiety.functions import scalar as S
from moiety.operators import kernel, numbering, records
from moiety.queries.registry import query, table


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice / 1000 < 1e-15 THEN 'L0' ELSE concat('L', format('{:.4f}', round_even(log10(l_extendedprice / 1000) * 16, 0) / 16)) END AS length_token,
       concat('A', format('{:.1f}', round_even(l_discount * 360 / 3.141592653589793, 0) / 2)) AS angle_token FROM lineitem""")
def size_tokens(spark, sf_dir):
    """Length and angle tokens of prices and discounts; printed with fixed places, so that both engines write them alike."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber",
        S.length_token(F.col("l_extendedprice").cast("double"), 1000.0).alias("a"),
        S.angle_token(F.col("l_discount").cast("double")).alias("b"))
    shown = lambda c, places: F.concat(F.substring(c, 1, 1), F.format_string(f"%.{places}f", F.substring(c, 2, 40).cast("double")))
    return l.select("l_orderkey", "l_linenumber", F.when(F.col("a") == "L0", F.lit("L0")).otherwise(shown("a", 4)).alias("length_token"),
        shown("b", 1).alias("angle_token"))


@query("SELECT p_partkey, list_sort(list_distinct([trim(p_name), 'O''Neil ' || p_brand]))::VARCHAR AS names, [p_size::DOUBLE, p_retailprice::DOUBLE, -0.5::DOUBLE]::VARCHAR AS numbers FROM part")
def record_fields(spark, sf_dir):
    """Product names and numbers read back from records written from the part table."""
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("#1=PRODUCT('"), "p_name", F.lit("',$); #2=product ( 'O''Neil "), "p_brand",
        F.lit("',$); #3=PRODUCT('',$); #4=PRODUCT('"), "p_name", F.lit("',$);"))
    body = F.concat(F.lit("'7',#12,("), F.col("p_size").cast("string"), F.lit("., "), F.col("p_retailprice").cast("string"), F.lit(",-.5E0),A1"))
    listed = lambda a: F.concat(F.lit("["), F.array_join(a.cast("array<string>"), ", "), F.lit("]"))
    quoted = F.transform(S.product_names(text),
        lambda x: F.when(F.contains(x, F.lit("'")), F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))).otherwise(x))
    return p.select("p_partkey", listed(quoted).alias("names"), listed(S.numbers(body)).alias("numbers"))


@query("SELECT p_partkey, CASE WHEN p_size < 4 THEN 'inspection_failed' WHEN p_partkey % 3 = 0 THEN 'invalid_shape' WHEN p_size - 4 >= 10 THEN 'admitted' ELSE 'too_few_solids' END AS verdict FROM part")
def admitted_parts(spark, sf_dir):
    """Structural admission by size and a validity flag."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", S.admission(F.col("p_size") - 4, F.col("p_partkey") % 3 != 0).alias("verdict"))


@query("SELECT DISTINCT o.* FROM (SELECT o_orderkey, o_orderstatus AS status, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F') o JOIN (SELECT DISTINCT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey")
def reusable_runs(spark, sf_dir):
    """Completed orders of customers with a positive balance: runs whose signature is wanted."""
    runs = table(spark, sf_dir, "orders").select("o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"), "o_custkey", "o_orderpriority")
    wanted = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return records.reusable(runs, wanted, ["o_custkey"]).withColumn("status", F.lit("F"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS number FROM lineitem")
def numbered_lines(spark, sf_dir):
    """Consecutive numbers over the largest table, by ranges."""
    return numbering.numbered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], "number")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (7, 3, 21, 11)")
def manifest_rows(spark, sf_dir):
    """Rows that a manifest lists, one of its ids twice and one unknown; the feature is the list."""
    return records.by_manifest_order(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), [7, 3, 21, 3, 11, 99], "n_nationkey")


@query("SELECT id, kind FROM (SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION SELECT s_suppkey, 'supplier' FROM supplier)")
def united_tiers(spark, sf_dir):
    """Distinct rows of two tiers."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))
    return records.united([a, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))], ["id", "kind"])


@query("""
SELECT part_a, part_b, distance FROM (SELECT a.p_partkey AS part_a, b.p_partkey AS part_b, round(abs(a.p_retailprice - b.p_retailprice), 6) AS distance
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey) ORDER BY distance, part_a, part_b LIMIT 100""")
def nearest_pairs(spark, sf_dir):
    """The hundred nearest pairs by distance, then by both parts: a top-k report."""
    part = table(spark, sf_dir, "part")
    a, b = (part.select("p_brand", "p_size", F.col("p_partkey").alias(f"part_{s}"), F.col("p_retailprice").alias(f"price_{s}")) for s in "ab")
    both = a.join(b, ["p_brand", "p_size"]).where("part_a < part_b").select("part_a", "part_b",
        F.round(F.abs(F.col("price_a") - F.col("price_b")), 6).alias("distance"))
    return both.orderBy("distance", "part_a", "part_b").limit(100)


@query("""
WITH s AS (SELECT o_orderkey, ceil(o_totalprice)::BIGINT AS expected_bytes, (o_orderkey % 7 * 30000)::BIGINT AS kept_bytes FROM orders),
k AS (SELECT *, CASE WHEN kept_bytes > expected_bytes THEN 0 ELSE kept_bytes END AS start FROM s), l AS (SELECT *, ceil((expected_bytes - start) / least(4, expected_bytes - start))::BIGINT AS step FROM k WHERE expected_bytes > start)
SELECT o_orderkey, segment::INT AS segment, start + segment * step AS first_byte, least(expected_bytes - 1, start + segment * step + step - 1) AS last_byte
FROM (SELECT *, unnest(range(0, ceil((expected_bytes - start) / step)::BIGINT)) AS segment FROM l)""")
def segment_plan(spark, sf_dir):
    """Byte ranges that are still to be fetched, an order standing for a download."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.ceil("o_totalprice").cast("long").alias("expected_bytes"),
        (F.col("o_orderkey") % 7 * 30000).cast("long").alias("kept_bytes"))
    return kernel.download_segments(o, 4).select("o_orderkey", "segment", "first_byte", "last_byte")


@query("SELECT p_partkey::BIGINT AS source, p_size::BIGINT AS part_index, p_retailprice::DOUBLE AS volume, (p_size * 2)::DOUBLE AS area, 0::DOUBLE AS edge_length, greatest(p_size, 3)::DOUBLE AS longest, p_size AS faces, p_size::BIGINT = 1 AS agreed FROM part")
def kernel_output(spark, sf_dir):
    """Records of a kernel's output written from the part table, read back and held against the announced count and the written files."""
    p = table(spark, sf_dir, "part").withColumn("source", F.col("p_partkey").cast("long"))
    put = lambda *xs: F.concat(*(x.cast("string") if not isinstance(x, str) else F.lit(x) for x in xs))
    size = F.col("p_size")
    output = put("@@SOLID_COUNT 1\n@@PART_BEGIN ", size, " s_1\n@@VPROPS_BEGIN\nMass : ", F.col("p_retailprice"),
        "\nCenter of gravity :\nX = 1 Y = 2 Z = 3\n@@VPROPS_END\n@@SPROPS_BEGIN\nMass : ", size * 2,
                 "\n@@SPROPS_END\n@@LPROPS_BEGIN\n@@LPROPS_END\n@@BBOX 3 -", size, " 1\n FACE : ", size, "\n@@PART_END\n")
    told = p.select("source", output.alias("output"))
    files = p.withColumn("k", F.explode(F.sequence(F.lit(1), size))).select("source",
        F.concat(F.lit("/c/part_"), F.lpad(F.col("k").cast("string"), 4, "0")).alias("stem"))
    files = files.select("source", F.explode(F.array(F.concat("stem", F.lit(".step")), F.concat("stem", F.lit(".brep")))).alias("file"))
    rows = kernel.kernel_records(told, "source", "output").join(kernel.kernel_agreement(told, "source", "output", files).select("source", "agreed"), "source")
    return rows.select("source", "part_index", "volume", "area", "edge_length", F.col("bbox")[0].alias("longest"), "faces", "agreed")


@query("""
WITH t AS (SELECT o_custkey AS id, bool_or(o_orderpriority = '1-URGENT') AS exact, bool_or(o_orderpriority = '2-HIGH') AS rigid FROM orders GROUP BY 1)
SELECT (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS downloaded_files, count(*) AS inspected_files, count(*) FILTER (c_acctbal > 0) AS admitted_assemblies, count(*) FILTER (c_acctbal > 0 AND c_nationkey * 10 >= 50) AS admitted_at_least_50_solids,
  (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS boolean_completed_assemblies, (SELECT sum(o_custkey)::BIGINT FROM orders WHERE o_orderpriority = '1-URGENT') AS boolean_total_solids,
  (SELECT count(*) FROM t WHERE exact OR rigid) AS covered_by_either_tier, (SELECT count(*) FROM t WHERE rigid AND NOT exact) AS rigid_only_assemblies,
  count(*) FILTER (c_acctbal > 0 AND c_custkey NOT IN (SELECT id FROM t WHERE exact OR rigid)) AS unclassified_admitted FROM customer""")
def corpus_counts(spark, sf_dir):
    """Suppliers as downloads, customers as inspections, orders as runs."""
    got = table(spark, sf_dir, "supplier").select(F.when(F.col("s_acctbal") > 0, "verified").otherwise("failed").alias("status"))
    seen = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") > 0, "admitted").otherwise("rejected").alias("status"), (F.col("c_nationkey") * 10).alias("solids"))
    mode = F.when(F.col("o_orderpriority") == "1-URGENT", "boolean").when(F.col("o_orderpriority") == "2-HIGH", "rigid").otherwise("off")
    one = {c: F.lit(1).alias(c) for c in ("final_groups", "multi_member_groups", "solids_in_multi_member_groups", "checked_pairs",
        "split_pairs", "verified_different_pairs", "unresolved_pairs")}
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), mode.alias("precision_mode"),
        F.col("o_custkey").alias("solid_count"), *one.values())
    return records.corpus_totals(got, seen, runs).select("downloaded_files", "inspected_files", "admitted_assemblies",
        "admitted_at_least_50_solids", "boolean_completed_assemblies", "boolean_total_solids", "covered_by_either_tier",
        "rigid_only_assemblies", "unclassified_admitted")


@query("SELECT o_orderkey AS id, o_totalprice AS solid_count FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def ten_largest(spark, sf_dir):
    """The ten largest orders: a top-k report."""
    return records.largest_runs(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("solid_count")))
