"""STEP text as an entity table, and part descriptors from it: equi-joins on (part, id), no per-part Python but for walks.

All tables are keyed by ``part`` (any type); every shuffle is on it, so parts spread evenly and one part's rows stay together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moiety.functions import scalar as S
from moiety.functions import vocabulary as V
from moiety.operators.graph import label_histogram, refine_labels
from moiety.sources.scratch import cut


def read_step(spark: SparkSession, path: str) -> DataFrame:
    """(part, text) of all .step and .stp files below a folder; part is the file's path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(step|stp)$"))
    return files.select(F.col("path").alias("part"), F.decode("content", "ISO-8859-1").alias("text"))


def entities(texts: DataFrame) -> DataFrame:
    """(part, id, kind, body, refs) of (part, text).  Records end at the first semicolon; of records with one id the last counts.

    A record of several kinds takes the first of the priority list that it has, else its first; records without a kind are
    left out."""
    record = r"#(\d+)\s*=\s*([^;]*);"
    raw = texts.select("part", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s)({record})"), 1)).alias("pos", "r"))
    raw = raw.select("part", "pos", F.regexp_extract("r", f"(?s){record}", 1).cast("int").alias("id"),
        F.trim(F.regexp_replace(F.regexp_extract("r", f"(?s){record}", 2), r"^\s+|\s+$", "")).alias("value"))
    simple = r"(?s)^([A-Z][A-Z0-9_]*)\s*\((.*)\)$"
    kinds = F.regexp_extract_all("value", F.lit(r"([A-Z][A-Z0-9_]*)\s*\("), 1)
    listed = F.coalesce(*(F.when(F.array_contains(kinds, k), F.lit(k)) for k in V.COMPLEX_PRIORITY), F.get(kinds, F.lit(0)))
    one = F.col("value").rlike(simple)
    parsed = raw.select("part", "pos", "id", F.when(one, F.regexp_extract("value", simple, 1)).otherwise(listed).alias("kind"),
        F.when(one, F.regexp_extract("value", simple, 2)).otherwise(F.col("value")).alias("body"))
    last = parsed.where("kind is not null").groupBy("part", "id").agg(F.max_by(F.struct("kind", "body"), "pos").alias("e")).select("part", "id", "e.*")
    return last.withColumn("refs", F.transform(F.regexp_extract_all("body", F.lit(r"#(\d+)"), 1), lambda x: x.cast("int")))


def _walk(ids: list, kinds: list, refs: list) -> tuple[int, set]:
    """The first solid (in id order of appearance) and everything it reaches."""
    at = {i: k for k, i in enumerate(ids)}
    root = next((i for i, kind in zip(ids, kinds, strict=True) if kind in V.SOLIDS), None)
    seen, left = set(), [root] if root is not None else []
    while left:
        i = left.pop()
        if i in seen or i not in at:
            continue
        seen.add(i)
        left.extend(int(r) for r in refs[at[i]])
    return root, seen


def _graphs(ents: DataFrame) -> DataFrame:
    """(part, e): a part's entities (id, kind, refs) by id, one row a part; bodies stay where they are."""
    return ents.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("id", "kind", "refs"))).alias("e"))


def reachable(ents: DataFrame) -> DataFrame:
    """Entities that their part's first solid reaches, with ``root``; one part's entity graph is walked in one row, many parts in a batch."""
    @F.pandas_udf("struct<root:int,ids:array<int>>")
    def walk(ids: pd.Series, kinds: pd.Series, refs: pd.Series) -> pd.DataFrame:
        found = [_walk(i.tolist(), k.tolist(), r) for i, k, r in zip(ids, kinds, refs, strict=True)]
        return pd.DataFrame({"root": [-1 if root is None else root for root, _ in found], "ids": [sorted(seen) for _, seen in found]})

    walked = _graphs(ents).select("part", walk("e.id", "e.kind", "e.refs").alias("w"))
    return ents.join(walked.select("part", F.col("w.root").alias("root"), F.explode("w.ids").alias("id")), ["part", "id"]).select(*ents.columns, "root")


def solid_labels(ents: DataFrame) -> DataFrame:
    """(part, label) of the root: its first quoted string, or solid_<id>."""
    raw = F.trim(F.replace(F.regexp_extract("body", r"'((?:''|[^'])*)'", 1), F.lit("''"), F.lit("'")))
    label = F.when((raw != "") & ~F.upper(raw).isin("NONE", "SOLID"), raw).otherwise(F.concat(F.lit("solid_"), F.col("id").cast("string")))
    return ents.where("id = root").select("part", label.alias("label"))


def _refs(ents: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    df = ents if kinds is None else ents.where(F.col("kind").isin(*kinds))
    return df.select("part", F.col("id").alias("src"), F.posexplode("refs").alias("pos", "dst"))


def _kinds(ents: DataFrame, prefix: str, kinds: tuple[str, ...]) -> DataFrame:
    return ents.where(F.col("kind").isin(*kinds)).select("part", F.col("id").alias(prefix))


def face_edges(ents: DataFrame) -> DataFrame:
    """(part, face, edge) of every use: face, bound, loop, oriented edge, edge curve; uses are not made distinct."""
    hop = lambda source, target, kinds, to: _refs(ents, source).join(_kinds(ents, "dst", kinds), ["part", "dst"]).select("part",
        F.col("src").alias(target), F.col("dst").alias(to))
    bounds = hop(("ADVANCED_FACE",), "face", ("FACE_BOUND", "FACE_OUTER_BOUND"), "bound")
    loops = hop(("FACE_BOUND", "FACE_OUTER_BOUND"), "bound", ("EDGE_LOOP",), "loop")
    members = _refs(ents, ("EDGE_LOOP",)).select("part", F.col("src").alias("loop"), F.col("dst").alias("member"))
    oriented = _refs(ents, ("ORIENTED_EDGE",)).join(_kinds(ents, "dst", ("EDGE_CURVE",)), ["part", "dst"])
    oriented = oriented.groupBy("part", F.col("src").alias("member")).agg(F.max_by("dst", "pos").alias("edge"))
    direct = _kinds(ents, "member", ("EDGE_CURVE",)).withColumn("edge", F.col("member"))
    return bounds.join(loops, ["part", "bound"]).join(members, ["part", "loop"]).join(oriented.unionByName(direct),
        ["part", "member"]).select("part", "face", "edge")


def face_surfaces(ents: DataFrame) -> DataFrame:
    """(part, face, surface, body): the last referenced surface of each face, else UNKNOWN_SURFACE."""
    surfaces = ents.where(F.col("kind").isin(*V.SURFACES) | F.contains("kind", F.lit("SURFACE"))).select("part", F.col("id").alias("dst"),
        F.struct("kind", "body").alias("s"))
    found = _refs(ents, ("ADVANCED_FACE",)).join(surfaces, ["part", "dst"]).groupBy("part", F.col("src").alias("face")).agg(F.max_by("s", "pos").alias("s"))
    faces = _kinds(ents, "face", ("ADVANCED_FACE",))
    return faces.join(found, ["part", "face"], "left").select("part", "face",
        F.coalesce("s.kind", F.lit("UNKNOWN_SURFACE")).alias("surface"), F.coalesce("s.body", F.lit("")).alias("body"))


def _unwrapped(ids, kinds, refs) -> list[tuple[int, int | None]]:
    """(edge, id of its curve or None) of each edge curve of a part."""
    base, named = set(V.BASE_CURVES), set(V.CURVES)
    kind, refs_of, out = dict(zip(ids, kinds, strict=True)), dict(zip(ids, refs, strict=True)), []
    for edge in (i for i, k in kind.items() if k == "EDGE_CURVE"):
        left, seen, chosen, wrapper = refs_of[edge].tolist()[::-1], set(), None, None
        while left and chosen is None:
            i = left.pop()
            if i in seen or i not in kind:
                continue
            seen.add(i)
            if kind[i] in base:
                chosen = i
            elif kind[i] in named or "CURVE" in kind[i]:
                wrapper = i if wrapper is None else wrapper
                left.extend(refs_of[i].tolist()[::-1])
        out.append((edge, chosen if chosen is not None else wrapper))
    return out


def edge_curves(ents: DataFrame) -> DataFrame:
    """(part, edge, curve, body): each edge's curve, unwrapped through curves of curves, first base curve in depth-first order."""
    @F.pandas_udf("array<struct<edge:int,id:int>>")
    def unwrap(ids: pd.Series, kinds: pd.Series, refs: pd.Series) -> pd.Series:
        return pd.Series([[{"edge": e, "id": c} for e, c in _unwrapped(i.tolist(), k.tolist(), r)] for i, k, r in zip(ids, kinds, refs, strict=True)],
            dtype=object)

    found = _graphs(ents).select("part", F.explode(unwrap("e.id", "e.kind", "e.refs")).alias("c")).select("part", "c.edge", "c.id")
    return found.join(ents.select("part", "id", "kind", "body"), ["part", "id"], "left").select("part", "edge",
        F.coalesce("kind", F.lit("UNKNOWN_CURVE")).alias("curve"), F.coalesce("body", F.lit("")).alias("body"))


def parameter_token(kind, body, scale):
    """Log-quantised parameters of a record: its last numbers, lengths (over ``scale``) then angles."""
    values = S.numbers(body)

    def tokens(lengths, angles):
        own = F.slice(values, F.greatest(F.size(values) - (lengths + angles), F.lit(0)) + 1, F.lit(lengths + angles))
        n = F.greatest(F.size(own) - angles, F.lit(0))
        return F.concat_ws(":", F.transform(own, lambda x, i: F.when(i < n, S.length_token(x, scale)).otherwise(S.angle_token(x))))

    out = F.lit("")
    for k, (lengths, angles) in V.PARAMETERS.items():
        out = F.when(S.col(kind) == k, tokens(lengths, angles)).otherwise(out)
    return out


def vertex_points(ents: DataFrame) -> DataFrame:
    """(part, points): distinct sorted vertex coordinates, rounded to 10 places."""
    points = ents.where("kind = 'CARTESIAN_POINT'").select("part", F.col("id").alias("dst"),
        F.slice(S.numbers("body"), F.greatest(F.size(S.numbers("body")) - 2, F.lit(1)), F.lit(3)).alias("xyz")).where(F.size("xyz") == 3)
    own = _refs(ents, ("VERTEX_POINT",)).join(points, ["part", "dst"])
    rounded = F.transform("xyz", lambda x: F.rint(x * 1e10) / 1e10)
    return own.groupBy("part").agg(F.array_sort(F.collect_set(rounded)).alias("points"))


def distance_histogram(points, bins: int = 32) -> list[float]:
    """Softly binned distances of all pairs of points over their largest, as shares."""
    x = np.array([list(p) for p in points], float).reshape(-1, 3) if len(points) else np.zeros((0, 3))
    if len(x) < 2:
        return [0.0] * bins
    i, j = np.tril_indices(len(x), -1)
    d = np.sqrt(((x[i] - x[j]) ** 2).sum(axis=1))
    if d.max() < 1e-12:
        return [0.0] * bins
    at = np.clip(d / d.max() * (bins - 1), 0, bins - 1)
    low = np.floor(at).astype(int)
    out = np.bincount(low, 1 - (at - low), bins) + np.bincount(np.minimum(low + 1, bins - 1), at - low, bins)
    return (out / out.sum()).tolist()


def adjacency(uses: DataFrame) -> DataFrame:
    """(part, edge, faces, uses): faces that share each edge.  One face twice is a seam, one face once a boundary."""
    return uses.groupBy("part", "edge").agg(F.array_sort(F.collect_set("face")).alias("faces"), F.count("*").alias("uses"))


def _as_map(counted: DataFrame, key: str, name: str) -> DataFrame:
    return counted.groupBy("part").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("n"))))).alias(name))


def descriptors(texts: DataFrame, scales: DataFrame | None = None, rounds: int = 3) -> DataFrame:
    """One descriptor a row of ``texts`` (part, text): counts, surface, curve and label histograms, distance histogram, graph figures.

    ``scales`` (part, scale) divides lengths in family labels; 1 without it.  Rows of equal text and scale are described once, under the
    digest of both; texts are read twice for that, as copies of them would take more disk than their digests."""
    held = texts.where("text is not null")
    held = held.join(scales, "part", "left") if scales is not None else held.withColumn("scale", F.lit(1.0))
    held = held.select("part", "text", F.coalesce("scale", F.lit(1.0)).cast("double").alias("scale"))
    digest = F.substring(F.unhex(F.sha2(F.concat_ws("\u0000", F.col("scale").cast("string"), "text"), 256)), 1, 16)
    held = held.withColumn("alike", digest)
    kinds = cut(held.groupBy("alike").agg(F.first("text").alias("text"), F.first("scale").alias("scale")).withColumnRenamed("alike", "part"))
    out = _described(kinds.select("part", "text"), kinds.select("part", "scale"), rounds).withColumnRenamed("part", "alike")
    return held.select("part", "alike").join(out, "alike").drop("alike")


def _described(texts: DataFrame, scales: DataFrame, rounds: int) -> DataFrame:
    """``descriptors`` of texts that differ.  What several figures are drawn from is written once, as a plan that holds it at each place would
    parse and walk the texts as many times."""
    ents = cut(reachable(cut(entities(texts))))
    scaled = ents.select("part").distinct().join(scales, "part")
    uses = cut(face_edges(ents))
    surfaces = face_surfaces(ents).join(scaled, "part")
    curves = edge_curves(ents).join(scaled, "part")
    curves = cut(curves.select("part", "edge", "curve", F.concat_ws("|p=", "curve", parameter_token("curve", "body", 1.0)).alias("strict"),
        F.concat_ws("|p=", "curve", parameter_token("curve", "body", "scale")).alias("family")))
    bounds = _refs(ents, ("ADVANCED_FACE",)).join(_kinds(ents, "dst", ("FACE_BOUND", "FACE_OUTER_BOUND")), ["part", "dst"]).groupBy("part",
        F.col("src").alias("face")).agg(F.count("*").alias("bounds"))
    degree = uses.groupBy("part", "face").agg(F.count_distinct("edge").alias("degree"))
    nodes = surfaces.join(bounds, ["part", "face"], "left").join(degree, ["part", "face"], "left")
    base = F.concat(F.col("surface"), F.lit("|b="), F.least(F.coalesce("bounds", F.lit(0)), F.lit(4)).cast("string"), F.lit("|d="),
        F.least(F.coalesce("degree", F.lit(0)), F.lit(12)).cast("string"), F.lit("|p="))
    nodes = cut(nodes.select("part", "face", "surface", F.concat(base, parameter_token("surface", "body", 1.0)).alias("strict"),
        F.concat(base, parameter_token("surface", "body", "scale")).alias("family")))
    shared = adjacency(uses)
    sides = shared.withColumn("a", F.explode("faces")).withColumn("b",
        F.explode("faces")).where((F.col("a") != F.col("b")) | ((F.size("faces") == 1) & (F.col("uses") > 1)))
    sides = cut(sides.join(curves, ["part", "edge"]))
    seam = F.when(F.col("a") == F.col("b"), F.lit("|SEAM")).otherwise(F.lit(""))
    histograms = []
    for mode, name in (("strict", "wl"), ("family", "wl_family")):
        key = lambda c: F.struct(F.col("part"), F.col(c))
        labels = refine_labels(nodes.select(key("face").alias("node"), F.col(mode).alias("label")),
            sides.select(F.struct("part", F.col("a").alias("face")).alias("node"),
            F.struct("part", F.col("b").alias("face")).alias("other"), F.concat(F.col(mode), seam).alias("kind")), rounds, settle=True)
        histograms.append(cut(label_histogram(labels.withColumn("part", F.col("node.part")), "part").withColumnRenamed("histogram", name)))
    counts = ents.where(F.col("kind").isin(*V.COUNTED_KINDS)).groupBy("part", "kind").agg(F.count("*").alias("n"))
    every = scaled.select("part", F.explode(F.array(*(F.lit(k) for k in V.COUNTED_KINDS))).alias("kind")).join(counts, ["part", "kind"],
        "left").na.fill(0, ["n"])
    edges = shared.groupBy("part").agg(F.sum(F.expr("size(faces) * (size(faces) - 1) / 2")).cast("long").alias("shared_edges"),
        F.count_if(F.expr("size(faces) = 1 and uses = 1")).alias("boundary_edges"),
        F.count_if(F.expr("size(faces) = 1 and uses > 1")).alias("seam_edges"))
    histogram = F.pandas_udf(lambda p: p.map(distance_histogram), "array<double>")
    points = vertex_points(ents).select("part", F.col("points"), histogram("points").alias("distances"))
    curve_uses = uses.join(curves.select("part", "edge", "curve"), ["part", "edge"])
    out = solid_labels(ents).join(_as_map(every, "kind", "counts"), "part")
    for df in (_as_map(surfaces.groupBy("part", "surface").agg(F.count("*").alias("n")), "surface", "surfaces"),
        _as_map(curve_uses.groupBy("part", "curve").agg(F.count("*").alias("n")), "curve", "curves"), *histograms, points, edges,
        nodes.groupBy("part").agg(F.count("*").alias("nodes"))):
        out = out.join(df, "part", "left")
    none = F.create_map().cast("map<string,bigint>")
    maps = {m: F.coalesce(m, none).alias(m) for m in ("counts", "surfaces", "curves", "wl", "wl_family")}
    figure = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("part", "label", *maps.values(), F.coalesce("distances", F.array_repeat(F.lit(0.0), 32)).alias("distances"),
        F.coalesce(F.size("points"), F.lit(0)).alias("vertex_points"), figure("nodes"), figure("shared_edges"), figure("boundary_edges"),
        figure("seam_edges"),
                      F.coalesce(F.try_element_at("surfaces", F.lit("UNKNOWN_SURFACE")), F.lit(0)).alias("unknown_surface_uses"),
                          F.coalesce(F.try_element_at("curves", F.lit("UNKNOWN_CURVE")), F.lit(0)).alias("unknown_curve_uses"))


def rigid_geometry(texts: DataFrame) -> DataFrame:
    """(part, points, edges, faces) for rigid matching: coordinates; typed edges (i, j, curve, n); faces (surface, boundary, n)."""
    ents = reachable(entities(texts))
    points = vertex_points(ents)
    uses, curves = face_edges(ents), edge_curves(ents)
    coordinates = ents.where("kind = 'CARTESIAN_POINT'").select("part", F.col("id").alias("dst"),
        F.transform(F.slice(S.numbers("body"), -3, 3), lambda x: F.rint(x * 1e10) / 1e10).alias("xyz"))
    vertex = _refs(ents, ("VERTEX_POINT",)).join(coordinates, ["part", "dst"]).groupBy("part",
        F.col("src").alias("dst")).agg(F.min_by("xyz", "pos").alias("xyz"))
    ends = _refs(ents, ("EDGE_CURVE",)).join(vertex, ["part", "dst"]).groupBy("part",
        F.col("src").alias("edge")).agg(F.array_sort(F.collect_list(F.struct("pos", "xyz"))).alias("e"))
    index = lambda k: F.array_position("points", F.get("e", k)["xyz"]).cast("int") - 1
    typed = ends.where(F.size("e") >= 2).join(points, "part").join(curves.select("part", "edge", "curve"), ["part", "edge"])
    typed = typed.select("part", "edge", F.struct(F.least(index(0), index(1)).alias("i"), F.greatest(index(0), index(1)).alias("j"), F.col("curve")).alias("t"))
    edges = typed.groupBy("part", "t").agg(F.count("*").alias("n")).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("t.i", "t.j",
        "t.curve", "n"))).alias("edges"))
    boundary = uses.join(typed, ["part", "edge"]).groupBy("part", "face").agg(F.array_sort(F.collect_list("t")).alias("boundary"))
    faces = face_surfaces(ents).join(boundary, ["part", "face"], "left").groupBy("part", "surface",
        "boundary").agg(F.count("*").alias("n")).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("surface", "boundary",
        "n"))).alias("faces"))
    return points.join(edges, "part", "left").join(faces, "part", "left")
