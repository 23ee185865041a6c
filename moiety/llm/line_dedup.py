"""Line dedup by winnowing over line hashes, with DataFrame functions only.

Lines are what stands between line feeds; blank ones (nothing but spaces) are passed over and always stay.  A run of
``window`` or more lines that a smaller document has too (or the same document further up) is deleted, and so is a single
line of ``long_line`` or more characters.

Winnowing picks in every window of ``window`` neighbouring lines the one with the least hash (leftmost if equal): any
repeated run of that many lines holds a picked line at the same place in both copies, so only picked lines (fingerprints)
have to be met.  Fingerprints that occur once are dropped.  The others are extended both ways: each window that picked the
fingerprint is looked up with its whole content, and one that occurred earlier makes its lines part of a repeated run;
overlapping windows make up the maximal run.  Looking windows up by content, with the first occurrence as a minimum with
map-side combining, stands in for comparing every two places of a fingerprint: a line in a third of all documents costs as
many rows as it has places, not their square.  Long single lines go through the same lookup as windows of one line.

Lines and windows are compared as two 64-bit hashes.

Defined results: null text is empty and stays so.  A document whose lines are all deleted becomes empty.  Rows that repeat
doc_id and text are one document; rows that repeat doc_id alone are ordered by the hash of their text.  All other columns
pass through, whatever their names, but for n_chars (if there) which is the length of the new text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moiety.llm import common as C

WINDOW, LONG_LINE = 2, 50


def repeated_lines(docs: DataFrame, window: int = WINDOW, long_line: int = LONG_LINE) -> DataFrame:
    """(d, t, gone): for documents that lose lines their doc_id, hash of the text, and the places of those lines."""
    lines = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("ls"))
    lines = lines.withColumn("at", F.expr("filter(sequence(0, size(ls) - 1), i -> trim(ls[i]) <> '')"))
    lines = lines.withColumn("h", F.expr("transform(at, i -> xxhash64(trim(ls[i])))")).withColumn("g", F.expr("transform(at, i -> xxhash64(7, trim(ls[i])))"))
    lines = lines.withColumn("n", F.expr(f"transform(at, i -> char_length(trim(ls[i])) >= {long_line})")).select("d", "t", "at", "h", "g", "n")
    part = f"slice({{}}, i + 1, {window})"
    picked = lines.withColumn("w", F.expr(f"""
        if(size(h) >= {window},
           transform(sequence(0, size(h) - {window}),
                     i -> struct(i + cast(array_position({part.format('h')}, array_min({part.format('h')})) as int) - 1 as p,
                                 xxhash64({part.format('h')}) as k1, xxhash64({part.format('g')}) as k2, {part.format('at')} as gone)),
           array())"""))
    prints = picked.select("d", "t", F.explode(F.expr(f"""
        transform(array_distinct(transform(w, x -> x.p)),
                  p -> struct(h[p] as f, filter(slice(w, greatest(p - {window} + 1, 0) + 1, least({window}, p + 1)), x -> x.p = p) as w))""")).alias("x")).select("d",
                      "t", "x.f", "x.w")
    again = prints.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f")
    windows = prints.join(again, "f", "left_semi").select("d", "t", F.explode("w").alias("x")).select("d", "t", "x.k1", "x.k2", "x.gone")
    single = lines.select("d", "t", F.explode(F.expr("filter(transform(at, (a, j) -> struct(h[j] as k1, g[j] as k2, array(a) as gone, n[j] as long)), x -> x.long)")).alias("x")).select("d",
        "t", "x.k1", "x.k2", "x.gone")
    runs = windows.unionAll(single)
    first = runs.groupBy("k1", "k2").agg(F.min(F.struct("d", "t", F.col("gone")[0].alias("i"))).alias("first"),
        F.count("*").alias("n")).where("n > 1").drop("n")
    later = runs.join(first, ["k1", "k2"]).where(F.struct("d", "t", F.col("gone")[0].alias("i")) > F.col("first"))
    return later.groupBy("d", "t").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def free_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def remove_repeated_lines(docs: DataFrame, window: int = WINDOW, long_line: int = LONG_LINE, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with repeated lines deleted from ``text``; ``counts`` names columns to add for the lines before and deleted."""
    found = repeated_lines(docs, window, long_line)
    d, t, gone = (free_name(docs, c) for c in ("gone_doc", "gone_text", "gone_lines"))
    found = found.select(F.col("d").alias(d), F.col("t").alias(t), F.col("gone").alias(gone))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(t)), "left")
    # in steps, so that a text is split once and not for each line
    ls, new = (free_name(docs, c) for c in ("gone_split", "gone_kept"))
    joined = joined.withColumn(ls, F.when(F.col(gone).isNotNull() | F.lit(bool(counts)), F.split(F.coalesce(docs["text"], F.lit("")), "\n", -1)))
    left = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(gone))
    joined = joined.withColumn(new, F.when(F.col(gone).isNotNull(), F.array_join(F.transform(left, lambda i: F.get(F.col(ls), i)), "\n")))
    same = F.col(gone).isNull()
    changed = {"text": F.col(new), "n_chars": F.char_length(new)}
    out = [F.when(same, docs[c]).otherwise(changed[c.lower()]).cast(docs.schema[c].dataType).alias(c) if c.lower() in changed else docs[c] for c in docs.columns]
    if counts:
        out += [F.size(ls).cast("long").alias(counts[0]), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(counts[1])]
    return joined.select(*out)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op4_line_dedup``: the operator over the whole of ``documents``: doc_id, n_lines, n_removed, kept_sha256."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeated_lines(docs, counts=("n_lines", "n_removed"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def cleaned_sql(source: str, window: int = WINDOW, long_line: int = LONG_LINE) -> str:
    """DuckDB common table expressions: ``cleaned`` (doc_id, kept, n_lines, n_removed) of a table (doc_id unique, text)."""
    more = ", ".join(f"lead(t, {k}) OVER o AS t{k}, lead(k, {k}) OVER o AS k{k}" for k in range(1, window))
    key = ", ".join(["t", *(f"t{k}" for k in range(1, window))])
    gone = " UNION ".join(f"SELECT doc_id, {c} AS k FROM seen WHERE r > 1 AND {c} IS NOT NULL" for c in ["k", *(f"k{k}" for k in range(1, window))])
    return f"""
lines AS (SELECT doc_id, unnest(range(len(ls))) AS k, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {source})),
full_lines AS (SELECT doc_id, k, trim(line) AS t FROM lines WHERE trim(line) <> ''),
windows AS (SELECT doc_id, k, t, {more} FROM full_lines WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
seen AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY doc_id, k) AS r FROM windows WHERE t{window - 1} IS NOT NULL),
alone AS (SELECT doc_id, k, row_number() OVER (PARTITION BY t ORDER BY doc_id, k) AS r FROM full_lines WHERE length(t) >= {long_line}),
gone AS ({gone} UNION SELECT doc_id, k FROM alone WHERE r > 1),
cleaned AS (SELECT l.doc_id, coalesce(string_agg(CASE WHEN g.k IS NULL THEN l.line END, chr(10) ORDER BY l.k), '') AS kept,
            count(*) AS n_lines, count(g.k) AS n_removed FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.k = g.k GROUP BY l.doc_id)"""


OP4_SQL = f"WITH {cleaned_sql('documents').strip()}\nSELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM cleaned"
