"""Around an external CAD kernel: what it printed, batches of checks with retries, downloads in segments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moiety.functions import scalar as S

# The marks and headings of the printed records.
RECORD = r"(?s)@@PART_BEGIN\s+\d+\s+\S+\s*.*?@@PART_END"
SECTIONS = {"volume": "VPROPS", "area": "SPROPS", "edge_length": "LPROPS"}
COUNTED = {"vertices": "VERTEX", "edges": "EDGE", "wires": "WIRE", "faces": "FACE", "shells": "SHELL", "solids": "SOLID"}
NUMBER = r"([-+0-9.eE]+)"


def _read(text, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def _three(text, pattern: str) -> Column:
    """Three numbers of one match; zeros without it."""
    return F.transform(F.array(*(_read(text, pattern, k) for k in (1, 2, 3))), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))


def kernel_records(df: DataFrame, key: str, output: str) -> DataFrame:
    """One row for each solid that a kernel's ``output`` describes: ``key``, part_index, shape_name, masses, center, moments, bbox, counts.

    Numbers that are not printed are 0; a missing section is shown in ``missing_sections``.  Moments and box are sorted, largest first."""
    found = df.select(key, F.explode(F.regexp_extract_all(F.col(output), F.lit(RECORD), F.lit(0))).alias("record"))
    record = F.col("record")
    section = lambda name: _read(record, rf"(?s)@@{name}_BEGIN\s*(.*?)@@{name}_END")
    mass = lambda name: F.coalesce(_read(section(name), rf"Mass\s*:\s*{NUMBER}").try_cast("double"), F.lit(0.0))
    exact = section("VPROPS")
    axes = lambda head, names: rf"(?s){head}\s*:.*?" + r".*?".join(rf"{n}\s*=\s*{NUMBER}" for n in names)
    box = _three(record, rf"@@BBOX\s+{NUMBER}\s+{NUMBER}\s+{NUMBER}")
    count = lambda item: F.coalesce(_read(record, rf"(?m)^\s*{item}\s*:\s*(\d+)").try_cast("int"), F.lit(0))
    missing = F.filter(F.array(*(F.when(~record.contains(f"@@{s}_BEGIN") | ~record.contains(f"@@{s}_END"),
        F.lit(s)) for s in SECTIONS.values())), lambda x: x.isNotNull())
    return found.select(
        key, _read(record, r"@@PART_BEGIN\s+(\d+)").cast("long").alias("part_index"), _read(record, r"@@PART_BEGIN\s+\d+\s+(\S+)").alias("shape_name"),
        *(mass(s).alias(name) for name, s in SECTIONS.items()), _three(exact, axes("Center of gravity", "XYZ")).alias("center"),
        F.sort_array(_three(exact, axes("Moments", ("IX", "IY", "IZ"))), False).alias("moments"), F.sort_array(F.transform(box, F.abs), False).alias("bbox"),
        *(count(kind).alias(name) for name, kind in COUNTED.items()), missing.alias("missing_sections"))


def kernel_agreement(df: DataFrame, key: str, output: str, files: DataFrame) -> DataFrame:
    """(key, expected, parsed, step_files, brep_files, agreed): whether a kernel's count, records and written files tell the same.

    ``files``: key and file name.  An output without a count, or with records that lack a section, does not agree."""
    records = kernel_records(df, key, output).groupBy(key).agg(F.count("*").alias("parsed"), F.count_if(F.size("missing_sections") > 0).alias("broken"))
    ends = lambda suffix: F.count_if(F.col("file").rlike(rf"(^|/)part_\d+\.{suffix}$"))
    written = files.groupBy(key).agg(ends("step").alias("step_files"), ends("brep").alias("brep_files"))
    told = df.select(key, _read(F.col(output), r"@@SOLID_COUNT\s+(\d+)").try_cast("long").alias("expected"))
    both = told.join(records, key, "left").join(written, key, "left").na.fill(0, ["parsed", "broken", "step_files", "brep_files"])
    same = (F.col("broken") == 0) & F.forall(F.array("parsed", "step_files", "brep_files"), lambda n: n == F.col("expected"))
    return both.select(key, "expected", "parsed", "step_files", "brep_files", F.coalesce(same, F.lit(False)).alias("agreed"))


#: Checks several pairs at once: rows of pairs in, one (status, reason) each out.  May raise; TimeoutError means that it took too long.
Batch = Callable[[Sequence], Sequence[tuple[str, str]]]


def in_batches(pairs: Sequence, run: Batch, size: int = 4) -> list[tuple[str, str, int]]:
    """(status, reason, attempts) of each pair: batches of ``size``; the pairs of a batch that breaks down are tried alone, once each.

    What breaks down alone is boolean_failed, with the cause as its reason."""
    out: list[tuple[str, str, int]] = []
    for k in range(0, len(pairs), size):
        lot = pairs[k:k + size]
        try:
            found = run(lot)
            if len(found) != len(lot):
                raise ValueError(f"{len(found)} results for {len(lot)} pairs")
            out += [(*x, 1) for x in found]
            continue
        except Exception as broken:
            cause = broken
        for one in lot:
            if len(lot) > 1:
                try:
                    (found,) = run([one])
                    out.append((*found, 2))
                    continue
                except Exception as broken:
                    cause = broken
            out.append(("boolean_failed", "timeout" if isinstance(cause, TimeoutError) else f"{type(cause).__name__}: {cause}", 2 if len(lot) > 1 else 1))
    return out


def checked_in_batches(pairs: DataFrame, run: Batch, size: int = 4) -> DataFrame:
    """``pairs`` with status, reason and attempts; every task takes its own batches."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)

    def check(batches):
        for rows in batches:
            found = in_batches(list(rows.itertuples(index=False)), run, size)
            yield rows.assign(status=[x[0] for x in found], reason=[x[1] for x in found],
                attempts=[x[2] for x in found]) if len(rows) else pd.DataFrame(columns=[*rows.columns, "status", "reason", "attempts"])

    return pairs.mapInPandas(check, f"{kinds}, status string, reason string, attempts int")


def download_segments(sources: DataFrame, segments: int) -> DataFrame:
    """(source columns, segment, first_byte, last_byte): what is still to be fetched, in at most ``segments`` equal ranges.

    ``sources``: expected_bytes and kept_bytes (of an interrupted download; more than expected counts as none).  Complete ones give no rows."""
    kept = F.when(F.col("kept_bytes") > F.col("expected_bytes"), F.lit(0)).otherwise(F.coalesce("kept_bytes", F.lit(0))).cast("long")
    left = F.col("expected_bytes") - kept
    step = F.ceil(left / F.least(F.lit(segments), left)).cast("long")
    cut = sources.where(left > 0).select("*", kept.alias("from_"), step.alias("step_"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.ceil((F.col("expected_bytes") - F.col("from_")) / F.col("step_")).cast("int") - 1)).alias("segment"))
    first = F.col("from_") + F.col("segment") * F.col("step_")
    return cut.select(*sources.columns, "segment", first.alias("first_byte"),
        F.least(F.col("expected_bytes") - 1, first + F.col("step_") - 1).alias("last_byte"))


def address_extension(address, default: str = ".step") -> Column:
    """Lower-case extension of an address's path, without its query; ``default`` without one."""
    path = F.regexp_replace(S.col(address), r"[?#].*$", "")
    own = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]{1,8})$", 1))
    return F.when(own == "", F.lit(default)).otherwise(own)
