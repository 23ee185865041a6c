"""Looking into files without reading all of them: ZIP directories, STEP markers, triangle meshes; recorded provider answers."""

from __future__ import annotations

import re
import struct
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moiety.functions import scalar as S

HEAD, TAIL = 1 << 20, 1 << 20  #: bytes looked at from either end of a file, as many as the reference takes


def read_files(spark: SparkSession, path: str, head: int = HEAD, tail: int = TAIL) -> DataFrame:
    """(path, length, head, tail): the ends of each file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ends = F.when(F.col("length") > head, F.substring("content", -tail, tail)).otherwise(F.lit(b""))
    return files.select("path", "length", F.substring("content", 1, head).alias("head"), ends.alias("tail"))


def step_markers(df: DataFrame, content: str) -> DataFrame:
    """Adds product_count, assembly_occurrence_count and solid_marker_count of the content, read as upper-case Latin-1."""
    text = F.upper(F.decode(content, "ISO-8859-1"))
    one = lambda w: F.regexp_count(text, F.lit(S.quoted(w)))
    count = lambda words: reduce(lambda a, b: a + b, map(one, words))
    return df.select("*", count(["PRODUCT("]).alias("product_count"),
        count(["NEXT_ASSEMBLY_USAGE_OCCURRENCE"]).alias("assembly_occurrence_count"),
        count(["MANIFOLD_SOLID_BREP", "BREP_WITH_VOIDS", "FACETED_BREP"]).alias("solid_marker_count"))


def zip_names(data: bytes) -> list[str]:
    """Names in the central directory of (the end of) a ZIP file; an entry cut off ends the list."""
    out, at = [], data.find(b"PK\x01\x02")
    while at >= 0 and at + 46 <= len(data):
        name, extra, comment = struct.unpack_from("<HHH", data, at + 28)
        raw = data[at + 46:at + 46 + name]
        if len(raw) < name:
            break
        out.append(raw.decode("utf-8", "replace"))
        at = data.find(b"PK\x01\x02", at + 46 + name + extra + comment)
    return out


def with_zip_names(df: DataFrame, content: str) -> DataFrame:
    """Adds file_names: an array of the ZIP directory's names, read in Arrow batches."""
    names = F.pandas_udf(lambda s: s.map(lambda b: zip_names(bytes(b)) if b is not None else []), "array<string>")
    return df.withColumn("file_names", names(content))


def stl_triangles(data: bytes) -> list[list[list[float]]]:
    """Triangles of a binary STL (its length must fit its count), else of an ASCII one; incomplete ones are left out."""
    if len(data) >= 84:
        n = struct.unpack_from("<I", data, 80)[0]
        if len(data) == 84 + 50 * n:
            return [[list(struct.unpack_from("<3f", data, 84 + 50 * k + 12 * (v + 1))) for v in range(3)] for k in range(n)]
    number = r"([-+]?[\d.]+(?:[eE][-+]?\d+)?)"
    points = [list(map(float, m)) for m in re.findall(rf"vertex\s+{number}\s+{number}\s+{number}", data.decode("ascii", "ignore"))]
    return [points[k:k + 3] for k in range(0, len(points) - 2, 3)]


def triangles(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, triangle, corners): one row a triangle."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for rows in batches:
            out = [(k, i, t) for k, b in zip(rows[key], rows[content], strict=True) for i, t in enumerate(stl_triangles(bytes(b) if b is not None else b""))]
            yield pd.DataFrame(out, columns=[key, "triangle", "corners"])

    return df.select(key, content).mapInPandas(run, f"{key} {kind}, triangle int, corners array<array<double>>")


def recorded_provider(path: str, schema: str, name: str):
    """A provider that reads recorded answers (JSON files) instead of asking over a network."""
    def ask(spark: SparkSession, kind: str, keywords: list[str]) -> DataFrame:
        rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("provider", F.lit(name)).withColumn("matched_type", F.lit(kind))
        hit = None
        for k in keywords:
            c = S.has_word(F.lower("title"), k)
            hit = c if hit is None else hit | c
        return rows.where(hit) if hit is not None else rows

    return ask


def kernel_values(df: DataFrame, text: str) -> DataFrame:
    """Adds volume and center parsed from a CAD kernel's printed mass properties; the kernel itself is not run here."""
    number = r"([-+]?[\d.]+(?:[eE][-+]?\d+)?)"
    return df.select("*", F.regexp_extract(text, rf"Mass\s*:\s*{number}", 1).try_cast("double").alias("volume"),
                     F.array(*(F.regexp_extract(text, rf"\b{c}\s*=\s*{number}", 1).try_cast("double") for c in "XYZ")).alias("center"))


def round_trip_valid(ok, solids, expected_solids, volume, expected_volume, tolerance: float):
    """Whether an exported group came back whole."""
    return F.coalesce(S.col(ok) & (S.col(solids) == S.col(expected_solids)) & (S.relative_difference(volume, expected_volume) <= tolerance), F.lit(False))
