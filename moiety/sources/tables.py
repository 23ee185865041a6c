"""Readers of CSV, JSON, event logs, TOML and recorded runs; writers with blanks, upserts, versions and checkpoints."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import tomllib
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moiety.sources.scratch import cut

PARTS = "part_index int, part_name string, `group` int, volume double, surface_area double, edge_length double, faces int, edges int, vertices int, bbox_max double, bbox_mid double, bbox_min double, moment_max double, moment_mid double, moment_min double, normalized_step string"
SIMILARITIES = "part_a int, part_b int, similarity double, distance double, topology_distance double, geometry_distance double, shape_distance double, size_distance double, size_gate_failed boolean, same_group boolean"
EVENTS = "timestamp string, type string, stage string, name string, passed boolean, error string, elapsed_seconds double"
REQUIRED_SECTIONS = ("discovery", "cycle", "quality_gates", "optimization", "coverage")


# ---------------------------------------------------------------- readers

def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header (a byte-order mark is fine), by a schema or as strings; one scan, columns pruned."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-document JSON files by a schema; a missing path gives no rows."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """An event log of one JSON object a line."""
    return spark.read.schema(EVENTS).json(path)


def read_runs(spark: SparkSession, root: str, name: str = "parts.csv", schema: str = PARTS) -> DataFrame:
    """The table ``name`` of every run folder below ``root``, with ``run``: the name of its folder.

    A table is a file of that name, or a folder of that name as this engine's writers leave it.  No run gives no rows."""
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for depth in ("*", "*/*", "*/*/*"):  # runs are folders, or folders of folders
        at = f"{root}/{depth}/{name}"
        found += [at] if files.globStatus(jvm.org.apache.hadoop.fs.Path(at)) else []
    if not found:
        return spark.createDataFrame([], schema).withColumn("run", F.lit(""))
    rows = spark.read.option("header", True).schema(schema).csv(found)
    parts = F.split("_metadata.file_path", "/")
    return rows.withColumn("run", F.element_at(parts, F.array_position(F.reverse(parts), name).cast("int") * -1 - 1))


def load_config(path: str | Path) -> dict:
    """A TOML configuration; its schema version must be 1 and all sections present."""
    with open(path, "rb") as f:
        config = tomllib.load(f)
    if config.get("schema_version") != 1:
        raise ValueError(f"Unsupported schema_version: {config.get('schema_version')}")
    missing = [s for s in REQUIRED_SECTIONS if s not in config]
    if missing:
        raise ValueError(f"Missing sections: {', '.join(missing)}")
    return config


def labelled_pairs(pairs: DataFrame, labels: DataFrame, expected: int | None = None) -> DataFrame:
    """Pairs with both parts' labels, in long form; with ``expected`` the number of labels must agree."""
    if expected is not None and labels.count() != expected:
        raise ValueError(f"Expected {expected} labels")
    a = labels.select(F.col("part_index").alias("part_a"), F.col("group").alias("group_a"))
    b = labels.select(F.col("part_index").alias("part_b"), F.col("group").alias("group_b"))
    return pairs.join(a, "part_a").join(b, "part_b").withColumn("same_group", F.col("group_a") == F.col("group_b"))


# ---------------------------------------------------------------- writers

def write_csv(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """CSV with a header; chosen fields, blanks for nulls and for fields that the table lacks, lists joined by " | "."""
    fields = fields or df.columns
    kinds = dict(df.dtypes)
    column = lambda c: F.lit("") if c not in kinds else F.array_join(c,
        " | ") if kinds[c].startswith("array<string") else F.coalesce(F.col(c).cast("string"), F.lit(""))
    df.select(*(column(c).alias(c) for c in fields)).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_json(value, path: str | Path) -> None:
    """A small JSON file of the driver, replaced as a whole."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=path.parent, delete=False, encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, default=str)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def load_json(path: str | Path, default=None):
    return json.loads(Path(path).read_text(encoding="utf-8")) if Path(path).is_file() else default


def write_versioned(df: DataFrame, root: str) -> str:
    """Writes beside earlier versions, which stay; returns the new folder."""
    path = f"{root}/{datetime.now(UTC).strftime('%Y%m%dT%H%M%S%fZ')}"
    df.write.parquet(path)
    return path


def archive(paths: list[str | Path], to: str | Path) -> list[Path]:
    """Copies of the driver's report files that exist, before they are replaced."""
    Path(to).mkdir(parents=True, exist_ok=True)
    return [Path(shutil.copy2(p, to)) for p in paths if Path(p).is_file()]


def checkpoint(spark: SparkSession, root: str, signature: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table kept for a signature, built and written if there is none."""
    path = f"{root}/signature={signature}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def resume_pairs(wanted: DataFrame, kept: DataFrame, signature: str, legacy: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept results that are wanted, pairs still to do).  Only results of the same signature count; of a legacy table
    without signatures only the resolved ones."""
    usable = kept.where(F.col("status").isin("verified", "different")) if legacy else kept.where(F.col("signature") == signature)
    key = ["reference_part", "candidate_part"]
    return usable.join(wanted.select(*key), key, "left_semi"), wanted.join(usable.select(*key), key, "left_anti")


def upsert_table(spark: SparkSession, path: str, new: DataFrame, key: str) -> DataFrame:
    """Replaces rows of a Parquet table by key: the result is written aside first, so a lost task loses nothing."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    merged = new
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        merged = spark.read.parquet(path).join(new.select(key), key, "left_anti").unionByName(new)
    cut(merged.orderBy(key)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of all files below a folder, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
