"""Scalar column expressions: distances, tokens, keyword and license rules, intervals.  All are built-in functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from moiety.functions import vocabulary as V


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- distances

def relative_difference(a, b) -> Column:
    """|a - b| / max(|a|, |b|, 1e-12)."""
    a, b = col(a), col(b)
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-12))


def log_ratio(a, b) -> Column:
    """min(1, |log2(a/b)| / 3); 0 if both are at most 1e-15, 1 if one is."""
    a, b = col(a).cast("double"), col(b).cast("double")
    tiny_a, tiny_b = a <= 1e-15, b <= 1e-15
    return F.when(tiny_a & tiny_b, 0.0).when(tiny_a | tiny_b, 1.0).otherwise(F.least(F.lit(1.0), F.abs(F.log2(a / b)) / 3))


def _number(x) -> Column:
    return F.coalesce(x, F.lit(0)).cast("double")


def map_norm(m) -> Column:
    """Length of a sparse vector (map of counts)."""
    return F.sqrt(F.aggregate(F.map_values(col(m)), F.lit(0.0), lambda s, x: s + _number(x) * _number(x)))


def cosine_distance(a, b, norm_a=None, norm_b=None) -> Column:
    """1 - cosine of two count maps, in [0, 1]; both empty 0, one empty 1.  Norms may be given, computed once per row."""
    a, b = col(a), col(b)
    na, nb = (col(n) if n is not None else map_norm(m) for n, m in ((norm_a, a), (norm_b, b)))
    dot = F.aggregate(F.map_values(F.map_zip_with(a, b, lambda _, x, y: _number(x) * _number(y))), F.lit(0.0), lambda s, x: s + x)
    far = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - dot / (na * nb)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 0.0).when((F.size(a) == 0) | (F.size(b) == 0), 1.0).otherwise(far)


def histogram_distance(a, b) -> Column:
    """Half the L1 distance of two histograms, at most 1; the longer one is cut."""
    a, b = col(a), col(b)
    n = F.least(F.size(a), F.size(b))
    total = F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.least(F.lit(1.0), total / 2)


def count_distance(a, b) -> Column:
    """Mean relative difference over all keys of two count maps; 0 without keys."""
    a, b = col(a), col(b)
    each = F.map_values(F.map_zip_with(a, b, lambda _, x, y: relative_difference(_number(x), _number(y))))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.lit(1), F.size(each))


def weighted_total(mode: str, topology, geometry, shape, size) -> Column:
    """Weighted sum of the four channels; an unknown mode is an error."""
    if mode not in V.WEIGHTS:
        raise ValueError(f"Unknown comparison mode: {mode}")
    return reduce(lambda x, y: x + y, (w * col(c) for w, c in zip(V.WEIGHTS[mode], (topology, geometry, shape, size), strict=True)))


def soft_bins(position) -> Column:
    """Entries (bin, weight) of a position on the bin axis: linear split between the two nearest bins."""
    position = col(position)
    low = F.floor(position)
    return F.array(F.struct(low.cast("int").alias("bin"), (1 - (position - low)).alias("weight")),
        F.struct((low + 1).cast("int").alias("bin"), (position - low).alias("weight")))


# ---------------------------------------------------------------- tokens and labels

def length_token(x, scale=1.0) -> Column:
    """log10 in sixteenths, rounded half to even; L0 below 1e-15."""
    size = F.abs(col(x)) / F.greatest(F.abs(F.lit(scale) if isinstance(scale, float) else col(scale)), F.lit(1e-15))
    return F.when(size < 1e-15, F.lit("L0")).otherwise(F.concat(F.lit("L"), (F.rint(F.log10(size) * 16) / 16).cast("string")))


def angle_token(x) -> Column:
    """Degrees rounded to halves."""
    return F.concat(F.lit("A"), (F.rint(col(x) * 360 / F.lit(3.141592653589793)) / 2).cast("string"))


def geometry_signature(volume, area, faces, edges, vertices) -> Column:
    """Coarse bins of size and counts, joined by colons."""
    log_bin = lambda x: F.floor(F.log10(F.greatest(col(x).cast("double"), F.lit(1e-18))) / 0.5).cast("string")
    count_bin = lambda x, w: F.floor(col(x).cast("int") / w).cast("string")
    return F.concat_ws(":", log_bin(volume), log_bin(area), count_bin(faces, 4), count_bin(edges, 8), count_bin(vertices, 8))


def product_names(text) -> Column:
    """Distinct sorted names of PRODUCT records; doubled quotes are single ones."""
    raw = F.regexp_extract_all(col(text), F.lit(r"(?i)\bPRODUCT\s*\(\s*'((?:''|[^'])*)'"), 1)
    return F.array_sort(F.array_distinct(F.filter(F.transform(raw, lambda x: F.trim(F.replace(x, F.lit("''"), F.lit("'")))), lambda x: x != "")))


def numbers(body) -> Column:
    """Numbers of a record, without references and quoted strings."""
    cleaned = F.regexp_replace(F.regexp_replace(col(body), r"#(\d+)", " "), r"'((?:''|[^'])*)'", " ")
    return F.transform(F.regexp_extract_all(cleaned, F.lit(r"(?i)(?<![#A-Z_])([-+]?(?:\d+\.\d*|\.\d+|\d+)(?:E[-+]?\d+)?)"), 1), lambda x: x.cast("double"))


def stable_id(length: int, *parts) -> Column:
    """First characters of the SHA-256 of the parts joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *(col(p) for p in parts)), 256), 1, length)


def sample_key(seed: str, a, b) -> Column:
    """Digest whose order is the deterministic random order of a pair."""
    return F.sha2(F.concat_ws(":", F.lit(seed), col(a).cast("string"), col(b).cast("string")), 256)


def number_or_null(x) -> Column:
    return col(x).cast("string").try_cast("double")


def percent_encoded(path) -> Column:
    """URL-encoded path segments; slashes stay and a space is %20."""
    return F.replace(F.replace(F.url_encode(col(path)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


# ---------------------------------------------------------------- keywords and licenses

def found_terms(text, terms) -> Column:
    """Sorted terms that the text contains."""
    return F.array_sort(F.filter(F.array(*(F.lit(t) for t in sorted(set(terms)))), lambda t: F.contains(col(text), t)))


def contains_any(text, terms) -> Column:
    return reduce(lambda x, y: x | y, (F.contains(col(text), F.lit(t)) for t in terms))


def has_word(text, keyword: str) -> Column:
    """Keyword between characters that are neither word characters nor hyphens."""
    return col(text).rlike(rf"(?U)(?<![\w-])\Q{keyword.lower()}\E(?![\w-])")


def quantities(text) -> Column:
    """First eight distinct quantity phrases, sorted."""
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(col(text), F.lit("(?U)(" + V.QUANTITY + ")"), 1))), 1, 8)


def license_decision(license_, size, most_bytes: int, allowed=V.LICENSES) -> Column:
    """manual_review without an allowed license, rejected beyond the size, else staged; an unknown size passes."""
    known = F.lower(F.coalesce(col(license_), F.lit(""))).isin([x.lower() for x in allowed])
    return F.when(~known, "manual_review").when(col(size) > most_bytes, "rejected").otherwise("staged")


def downgraded(decision, confidence) -> Column:
    """Staged rows of low confidence need a manual review."""
    return F.when((col(decision) == "staged") & (col(confidence) == "low"), "manual_review").otherwise(col(decision))


def file_integrity(exists, size, expected_size, digest, expected_digest, head) -> Column:
    """The first check that a downloaded file fails, else "valid"."""
    bad = lambda x, y: col(y).isNotNull() & ~col(x).eqNullSafe(col(y))
    return (F.when(~F.coalesce(col(exists), F.lit(False)), "missing").when(bad(size, expected_size),
        "size_mismatch").when(bad(digest, expected_digest), "sha256_mismatch")
            .when(F.startswith(col(head), F.lit("version https://git-lfs")),
                "lfs_pointer").when(~F.contains(F.upper(col(head)), F.lit("ISO-10303-21")), "invalid_header").otherwise("valid"))


def admission(solids, valid, least: int = 10) -> Column:
    """Structural admission of an inspected assembly."""
    return F.when(col(solids) < 0, "inspection_failed").when(~F.coalesce(col(valid), F.lit(False)),
        "invalid_shape").when(col(solids) >= least, "admitted").otherwise("too_few_solids")


# ---------------------------------------------------------------- intervals

def wilson(successes, total, z: float = V.WILSON_Z) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, cut to [0, 1]; null without observations."""
    k, n = col(successes).cast("double"), col(total).cast("double")
    p = k / n
    scale = 1 + z * z / n
    center = (p + z * z / (2 * n)) / scale
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), center - margin)), F.when(some, F.least(F.lit(1.0), center + margin))


def choose2(n) -> Column:
    """Pairs of n, as a long: halved before it is multiplied, so that nothing is rounded or leaves the type sooner than the result."""
    n = col(n).cast("long")
    return F.shiftright(n, 1) * (n - 1 + n % 2)


def quoted(text: str) -> str:
    """A literal for a regular expression."""
    return re.escape(text)
