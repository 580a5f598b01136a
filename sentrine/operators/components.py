"""Connected components by alternating large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrine.storage import drop, materialize


def _fingerprint(e: DataFrame):
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node reachable.

    Each round contracts every neighbourhood to its smallest member, so the number of rounds is logarithmic in
    the diameter. Minima are combined before the shuffle and the joins are plain equi-joins that adaptive
    execution can split, so one hub with a third of all edges does not end in one task. Edges with a null end
    are ignored; self-edges give a node without links. An empty input gives an empty result. ``drop`` of the result
    deletes the table it is read from, when it has been written.
    """
    a, b = F.col(src), F.col(dst)
    given = edges.where(a.isNotNull() & b.isNotNull())
    selfs = given.where(a == b).select(a.alias("node")).distinct()
    cur = materialize(given.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = _fingerprint(cur)
    while seen[0]:
        both = cur.union(cur.select("v", "u"))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = materialize(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        )
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(low2, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = materialize(moved.union(low2.select("u", F.col("m").alias("v"))).distinct())
        drop(low, large, low2, cur)
        cur, was, seen = nxt, seen, _fingerprint(nxt)
        if was == seen:
            break
    found = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    linked = found.union(roots)
    alone = selfs.join(linked.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    out = linked.union(alone)
    out._sentrine_path = cur._sentrine_path
    return out
