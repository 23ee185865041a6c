"""Keyword, license and catalogue queries."""

from pyspark.sql import functions as F

from moiety.functions import scalar as S
from moiety.functions import vocabulary as V
from moiety.operators import coverage as cov
from moiety.operators import discovery, prescreen, records
from moiety.queries.registry import query, table, text_list

TAXONOMY_SQL = "x AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{k}')" for t, words in V.TAXONOMY.items() for k in words) + ") v(type, keyword))"


@query(f"""
WITH {TAXONOMY_SQL}, h AS (SELECT x.type, p_brand AS source, keyword FROM part JOIN x ON contains(lower(p_name), keyword)),
f AS (SELECT type, count(DISTINCT source) AS n, string_agg(DISTINCT keyword, '|' ORDER BY keyword) AS k FROM h GROUP BY type)
SELECT t.type, coalesce(n, 0) > 0 AS covered, coalesce(n, 0)::BIGINT AS source_count, coalesce(k, '') AS matched_keywords, CASE WHEN n IS NULL THEN 'missing' WHEN n < 5 THEN 'undercovered' END AS gap FROM (SELECT DISTINCT type FROM x) t LEFT JOIN f ON f.type = t.type""")
def coverage_by_type(spark, sf_dir):
    out = cov.coverage(table(spark, sf_dir, "part"), cov.taxonomy_table(spark), "p_brand", "p_name", 5)
    return out.select("type", "covered", F.col("source_count").cast("long").alias("source_count"),
        F.array_join("matched_keywords", "|").alias("matched_keywords"), "gap")


@query("""
WITH s AS (SELECT concat_ws(':', floor(log10(p_retailprice + 0.5) / 0.5::DOUBLE)::BIGINT, floor(log10(p_size::DOUBLE * 1.001) / 0.5::DOUBLE)::BIGINT, p_size // 4, p_size // 8, (p_size + 3) // 8) AS signature, p_brand FROM part)
SELECT signature, count(*) AS part_count, count(DISTINCT p_brand) AS source_count, count(*) <= 2 AS rare FROM s GROUP BY signature""")
def size_signature_counts(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", (F.col("p_retailprice") + 0.5).alias("volume"),
        (F.col("p_size").cast("double") * F.lit(1.001)).alias("surface_area"), F.col("p_size").alias("faces"),
        F.col("p_size").alias("edges"), (F.col("p_size") + 3).alias("vertices"))
    return cov.signature_counts(part, "p_brand")


def _hits(terms, text="t") -> str:
    return f"list_sort(list_filter([{text_list(sorted(set(terms)))}], lambda k: contains({text}, k)))"


def _ranked(taxonomy: dict, text="t") -> str:
    rows = ", ".join(f"{{'n': -len({_hits(w, text)}), 'label': '{k}'}}" for k, w in taxonomy.items())
    return f"list_sort(list_filter([{rows}], lambda x: x.n < 0))"


def _any(terms, text="t") -> str:
    return "(" + " OR ".join(f"contains({text}, '{k}')" for k in terms) + ")"


SCREENED = f"""
d AS (SELECT doc_id, lower(concat(p_name, ' step file assembly components ', p_type, ' quantity ', (doc_id % 90)::VARCHAR, ' ', source, CASE WHEN doc_id % 5 = 0 THEN ' single part' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN ' complete assembly' ELSE '' END)) AS t,
        CASE doc_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'manual' WHEN 2 THEN 'verified_api' ELSE 'unknown' END AS access, CASE doc_id % 6 WHEN 0 THEN 'unknown' ELSE 'mit' END AS license, (doc_id % 4)::INT AS product_count, 0 AS occurrences, (doc_id % 20)::INT AS solids
      FROM documents JOIN part ON p_partkey = doc_id + 1),
e AS (SELECT *, {_ranked(V.SECTORS)} AS sectors, {_ranked(V.DOMAINS)} AS domains, {_ranked(V.COMPONENTS)} AS components, {_any(V.STEP_MARKERS)} AS has_step, {_any(V.NEGATIVE_SIGNALS)} AS negative,
        {' + '.join(f"CASE WHEN {_any(w)} THEN {3 if k == 'explicit_full_assembly' else 2} ELSE 0 END" for k, w in V.ASSEMBLY_SIGNALS.items())} AS signals, regexp_matches(t, '(^|[^a-z0-9_])(qty|quantity)[ ]*[:=]?[ ]*[0-9]{{1,5}}([^a-z0-9_]|$)') AS quantity FROM d),
f AS (SELECT *, (signals + CASE WHEN quantity THEN 2 ELSE 0 END + CASE WHEN has_step THEN 2 ELSE 0 END - CASE WHEN negative THEN 6 ELSE 0 END + CASE WHEN product_count >= 2 OR occurrences >= 1 THEN 5 WHEN solids >= 10 THEN 3 ELSE 0 END)::INT AS score FROM e),
r AS (SELECT doc_id::VARCHAR AS candidate_id, coalesce(sectors[1].label, 'unknown') AS manufacturing_sector, CASE WHEN sectors[1].n <= -3 THEN 'high' WHEN len(sectors) > 0 THEN 'medium' ELSE 'low' END AS sector_confidence,
        array_to_string(list_transform(domains[1:4], lambda x: x.label), '|') AS engineering_domains, array_to_string(list_transform(components, lambda x: x.label), '|') AS possible_components,
        CASE WHEN score >= 8 THEN 'high' WHEN score >= 5 THEN 'medium' ELSE 'low' END AS assembly_confidence, score AS assembly_score,
        CASE WHEN NOT has_step OR score < 1 THEN 'reject_or_metadata_only' WHEN license IN ({text_list(V.UNLICENSED)}) THEN 'manual_license_review' WHEN score >= 8 AND access IN ({text_list(V.OPEN_ACCESS)}) THEN 'priority_download' WHEN score >= 5 THEN 'metadata_first' ELSE 'manual_assembly_review' END AS decision FROM f)"""


def _screened(spark, sf_dir):
    d, part = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    both = d.join(part, F.col("p_partkey") == F.col("doc_id") + 1)
    k = F.col("doc_id")
    title = F.concat("p_name", F.lit(" step file assembly components "), "p_type", F.lit(" quantity "), (k % 90).cast("string"), F.lit(" "),
        "source", F.when(k % 5 == 0, " single part").otherwise(""), F.when(k % 3 == 0, " complete assembly").otherwise(""))
    return both.select(k.alias("id"), title.alias("title"),
        F.when(k % 4 == 0, "public").when(k % 4 == 1, "manual").when(k % 4 == 2,
        "verified_api").otherwise("unknown").alias("access_status"), F.when(k % 6 == 0, "unknown").otherwise("MIT").alias("license"),
        (k % 4).cast("int").alias("product_count"), (k % 20).cast("int").alias("solid_marker_count"))


@query(f"WITH {SCREENED} SELECT * FROM r")
def prescreen_documents(spark, sf_dir):
    out = prescreen.prescreen(_screened(spark, sf_dir)).drop("evidence", "caveats")
    return out.withColumns({c: F.array_join(c, "|") for c in ("engineering_domains", "possible_components")})


@query(f"""
WITH {SCREENED} SELECT dimension, value, count(*) AS n FROM (SELECT 'manufacturing_sector' AS dimension, manufacturing_sector AS value FROM r UNION ALL SELECT 'assembly_confidence', assembly_confidence FROM r UNION ALL SELECT 'decision', decision FROM r
UNION ALL SELECT 'engineering_domains', unnest(string_split(engineering_domains, '|')) FROM r WHERE engineering_domains <> '' UNION ALL SELECT 'possible_components', unnest(string_split(possible_components, '|')) FROM r WHERE possible_components <> '') GROUP BY ALL""")
def prescreen_summary(spark, sf_dir):
    return prescreen.summarize(prescreen.prescreen(_screened(spark, sf_dir)))


@query(f"""
SELECT doc_id, CASE WHEN l IS NULL OR lower(l) NOT IN ({text_list([x.lower() for x in V.LICENSES])}) THEN 'manual_review' WHEN n > 2000 THEN 'rejected' ELSE 'staged' END AS decision
FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'MIT' WHEN 'de' THEN 'cc-by-4.0' WHEN 'fr' THEN 'proprietary' END AS l, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE n_chars END AS n FROM documents)""")
def license_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id",
        F.when(F.col("lang") == "en", "MIT").when(F.col("lang") == "de", "cc-by-4.0").when(F.col("lang") == "fr", "proprietary").alias("l"),
        F.when(F.col("doc_id") % 11 != 0, F.col("n_chars")).alias("n"))
    return d.select("doc_id", S.license_decision("l", "n", 2000).alias("decision"))


WORDS = ("license", "and", "the", "gear")


@query("SELECT keyword, count(*) AS n FROM documents CROSS JOIN (SELECT unnest([" + text_list(WORDS) + "]) AS keyword) WHERE regexp_matches(lower(text), concat('(^|[^\\p{L}\\p{N}_-])', keyword, '($|[^\\p{L}\\p{N}_-])')) GROUP BY keyword")
def word_boundary_hits(spark, sf_dir):
    hits = discovery.keyword_hits(table(spark, sf_dir, "documents").select("text"), "text", list(WORDS))
    return hits.select(F.explode("hits").alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, length(html) AS score FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id) AS k FROM c)
SELECT page_id, host, score FROM r WHERE k = 1""")
def dedup_best_page(spark, sf_dir):
    c = table(spark, sf_dir, "pages").select(F.col("page_id").alias("candidate_id"),
        F.regexp_extract("url", "://([^/]+)", 1).alias("landing_url"), F.lit("").alias("download_url"),
        F.char_length("html").cast("long").alias("score"))
    return discovery.best_per_address(c).select(F.col("candidate_id").alias("page_id"), F.col("landing_url").alias("host"), "score")


@query("SELECT c_custkey, substr(sha256(concat(c_name, chr(31), c_mktsegment)), 1, 16) AS stable_id FROM customer")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.stable_id(16, "c_name", "c_mktsegment").alias("stable_id"))


@query("""
SELECT c_custkey, coalesce(o.status, 'pending') AS status, o.n_orders, l.n_lines FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS status, count(*) AS n_orders FROM orders GROUP BY 1) o ON o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) l ON l.o_custkey = c_custkey""")
def catalog_left_chain(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(o,
        "o_orderkey").groupBy("c_custkey").agg(F.count("*").alias("n_lines"))
    orders = o.groupBy("c_custkey").agg(F.max("o_orderstatus").alias("status"), F.count("*").alias("n_orders"))
    return records.left_chain(table(spark, sf_dir, "customer").select("c_custkey"), [orders, lines], "c_custkey", defaulted=("status",))


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unclassified_ids(spark, sf_dir):
    return records.not_in(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("""
WITH o AS (SELECT *, o_orderdate >= TIMESTAMP '1996-01-01' AS fresh FROM orders), x AS (SELECT o_custkey, fresh, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o GROUP BY ALL)
SELECT o_custkey, n, total, fresh FROM x WHERE fresh OR o_custkey NOT IN (SELECT o_custkey FROM x WHERE fresh)""")
def run_index_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("fresh", F.col("o_orderdate") >= F.expr("timestamp_ntz '1996-01-01 00:00:00'"))
    x = o.groupBy("o_custkey", "fresh").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return records.upsert(x.where("not fresh"), x.where("fresh"), "o_custkey").select("o_custkey", "n", "total", "fresh")


@query("""
SELECT count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS boolean_completed_assemblies, count(*) FILTER (o_orderstatus = 'P') AS failed,
       coalesce(sum(o_custkey) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'), 0)::BIGINT AS solids, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) AS elapsed_seconds FROM orders""")
def corpus_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    runs = o.select(F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P",
        "failed").otherwise("running").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "boolean").otherwise("rigid").alias("precision_mode"),
                    F.col("o_custkey").alias("solids"), F.lit(1).alias("final_groups"), F.lit(0).alias("multi_member_groups"),
                        F.lit(0).alias("unresolved_pairs"), F.col("o_totalprice").alias("elapsed_seconds"))
    return records.corpus_summary(runs).select("runs", "completed", "boolean_completed_assemblies", "failed", "solids",
        F.round("elapsed_seconds", 2).alias("elapsed_seconds"))


@query("""
WITH g AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey AS id, count(*) AS final_groups, count(*) FILTER (n > 1) AS multi_member_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS solids_in_multi_member_groups, round(sum(n)::DOUBLE / 8, 3) AS elapsed_seconds FROM g GROUP BY 1""")
def run_index(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"), "o_orderstatus").agg(F.count("*").alias("part_count"))
    reports = g.groupBy("id").agg(F.collect_list(F.struct("part_count")).alias("groups"),
        F.collect_list(F.struct((F.col("part_count") / 8).alias("elapsed_seconds"))).alias("stages")).withColumn("pairs",
        F.array(F.struct(F.lit("verified").alias("status"))))
    out = records.run_index(reports)
    return out.select("id", F.col("final_groups").cast("long").alias("final_groups"),
        F.col("multi_member_groups").cast("long").alias("multi_member_groups"), "solids_in_multi_member_groups", "elapsed_seconds")


@query("""
SELECT item_id, CASE WHEN text IS NULL THEN 'missing' WHEN n <> expected THEN 'size_mismatch' WHEN item_id % 7 = 0 THEN 'sha256_mismatch' ELSE 'valid' END AS verdict
FROM (SELECT item_id, text, length(text) AS n, CASE WHEN item_id % 5 = 0 THEN length(text) + 1 ELSE length(text) END AS expected FROM benchmark)""")
def file_integrity(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    n, k = F.char_length("text"), F.col("item_id")
    return b.select("item_id", S.file_integrity(F.col("text").isNotNull(), n, n + F.when(k % 5 == 0, 1).otherwise(0), F.sha2("text", 256),
        F.when(k % 7 == 0, "x").otherwise(F.sha2("text", 256)), F.concat(F.lit("ISO-10303-21;"), "text")).alias("verdict"))


@query("SELECT page_id, concat('https://example.org/raw/', replace(replace(url_encode(url), '%2F', '/'), '+', '%20')) AS address FROM pages")
def source_address(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://example.org/raw/"), S.percent_encoded("url")).alias("address"))
