"""Graphs as edge tables: connected components, label refinement, checks of groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moiety.sources.scratch import cut


#: Up to so many edges (16 MB of longs), measured, one task settles all components; beyond that, star steps do.
SMALL = 1 << 20


def _settled(batches):
    """Stars (id, component) of all components of the edges, which are few: hooking and pointer jumping in numpy."""
    import pyarrow as pa

    found = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if found is None or not found.num_rows:
        return
    kind, m = found.schema.field(0).type, found.num_rows
    names, place = np.unique(np.concatenate([found.column(k).to_numpy() for k in (0, 1)]), return_inverse=True)
    root, x, y = np.arange(len(names)), place[:m], place[m:]
    while len(x):
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while not np.array_equal(up := root[root], root):
            root = up
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    for i in range(0, len(names), 65536):
        k = slice(i, i + 65536)
        yield pa.RecordBatch.from_arrays([pa.array(names[k], kind), pa.array(names[root[k]], kind)], ["id", "component"])


def component_stars(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (a, b) that has an edge to another: the smallest id that it reaches.

    A table of at most ``small`` edges is settled in one task.  Larger ones take alternating large-star and small-star
    steps (Kiveris et al. 2014): each is a minimum per vertex, with map-side combining, and a join whose large side adaptive execution
    can split, so one vertex may have a third of all edges.  Every two steps end in a table of the scratch folder.
    Loops and repeated edges are allowed."""
    def stats(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()

    e = cut(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct())
    if e.count() <= small:
        kind = e.schema["lo"].dataType.simpleString()
        return cut(e.coalesce(1).mapInArrow(_settled, f"id {kind}, component {kind}"))
    seen = stats(e)
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        roots = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small_star = large.join(roots, "hi").select(F.col("lo").alias("hi"),
            F.col("m").alias("lo")).where("hi <> lo").unionAll(roots.select("hi", F.col("m").alias("lo")))
        e = cut(small_star.distinct())
        now = stats(e)
        if now == seen:
            break
        seen = now
    leaves = e.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return leaves.unionAll(e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


def connected_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (a, b), those with loops only included: the smallest id that it reaches."""
    vertices = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return vertices.join(component_stars(edges, small), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def refine_labels(nodes: DataFrame, edges: DataFrame, rounds: int, settle: bool = False) -> DataFrame:
    """Weisfeiler-Lehman labels (level, node, label) of levels 0 to ``rounds``.

    ``nodes`` (node, label), ``edges`` (node, other, kind) in both directions.  A round hashes a node's label with its
    sorted neighbours' labels and edge kinds.  Rounds are unrolled in one plan, in which each holds all before it, or with ``settle`` end in a
    table each, which keeps the driver's plans small; only equality of labels has meaning."""
    now = nodes.select("node", F.sha2(F.concat(F.lit("0|"), "label"), 256).alias("label"))
    out = now.select(F.lit(0).alias("level"), "node", "label")
    for level in range(1, rounds + 1):
        around = edges.join(now.select(F.col("node").alias("other"), F.col("label").alias("theirs")), "other")
        joined = around.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "theirs"))), "|").alias("around"))
        now = now.join(joined, "node", "left").select("node", F.sha2(F.concat("label", F.lit("|"), F.coalesce("around", F.lit(""))), 256).alias("label"))
        now = cut(now) if settle else now
        out = out.unionAll(now.select(F.lit(level), "node", "label"))
    return out


def label_histogram(labels: DataFrame, by: Column | str) -> DataFrame:
    """One map level:label -> count for each value of ``by``."""
    counted = labels.groupBy(by, F.concat_ws(":", "level", "label").alias("k")).agg(F.count("*").alias("n"))
    return counted.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("histogram"))


def renumbered(groups: DataFrame, group: str, member: str) -> DataFrame:
    """Groups numbered from 1 by their smallest member, without a sort in one task."""
    from moiety.operators.numbering import numbered

    first = groups.groupBy(group).agg(F.min(member).alias("first_member"))
    ranked = numbered(first, ["first_member"], "number")
    return groups.join(ranked.select(group, "number"), group).drop(group).withColumnRenamed("number", group)


def groups_are_connected(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(grp, connected): whether the passed edges (a, b) inside each group of ``members`` (id, grp) connect all of it."""
    a = members.select(F.col("id").alias("a"), F.col("grp"))
    b = members.select(F.col("id").alias("b"), F.col("grp").alias("grp_b"))
    inside = edges.join(a, "a").join(b, "b").where("grp = grp_b").select("a", "b")
    parts = connected_components(inside.unionAll(members.select(F.col("id").alias("a"), F.col("id").alias("b"))))
    return members.join(parts, "id").groupBy("grp").agg((F.count_distinct("component") == 1).alias("connected"))
