"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrine.storage import drop, materialize

CELL = 256  # documents that are ranked among themselves
EXACT = 1 << 16  # remaining budget, in words, that the knapsack fits exactly


def _knapsack(lengths: list[int], have: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length, at most ``have``, to come as near below ``budget`` as possible.

    Reachable sums are the bits of one integer; each step adds 1, 2, 4, ... documents of a length, and the search
    ends as soon as the budget itself is reachable.
    """
    reach, mask, steps = 1, (1 << (budget + 1)) - 1, []
    for n in lengths:
        left, k = min(have[n], budget // n if n else 0), 1
        while left and not reach >> budget & 1:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= reach << (n * k) & mask
            left, k = left - k, k * 2
    at, out = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            out[n] = out.get(n, 0) + k
            at -= n * k
    return out


def fit_counts(sizes: dict[int, int], budget: int, seed: int) -> dict[int, int]:
    """Documents of each length to take so that their words add up to ``budget`` or nearly so."""
    total = sum(n * c for n, c in sizes.items())
    if budget <= 0 or not total:
        return {}
    if budget >= total:
        return {n: c for n, c in sizes.items() if n}
    take = {n: c * budget // total for n, c in sizes.items() if n}
    left = budget - sum(n * k for n, k in take.items())
    order = sorted(take)
    random.Random(seed).shuffle(order)
    for n in order:
        if left - n >= EXACT and take[n] < sizes[n]:
            take[n], left = take[n] + 1, left - n
    while left > 2 * EXACT and any(take[n] < sizes[n] and n <= left - EXACT for n in order):  # only with very long documents
        n = next(n for n in order if take[n] < sizes[n] and n <= left - EXACT)
        k = min(sizes[n] - take[n], (left - EXACT) // n)
        take[n], left = take[n] + k, left - n * k
    for n, k in _knapsack([n for n in order if n <= left], {n: sizes[n] - take[n] for n in order}, left).items():
        take[n] += k
    return take


def with_targets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source_size`` per source to ``target``: weights repeat over the sources by code point, null last.

    A target stops at ``most`` times its source's size and the excess goes to the others by weight, which ends at
    min(most * size, level * weight) with one level for all; running sums over the sources in order of the level at
    which each stops give it. One row per source goes through this window, never documents.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_at") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("_at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("_w", w)
    ranked = ranked.withColumn("_cap", F.lit(most) * F.col("source_size")).withColumn("_stop", F.col("_cap") / F.col("_w"))
    every, upto = Window.partitionBy(), Window.orderBy("_stop", "_at").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("_left", F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)))
    ranked = ranked.withColumn("_free", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(upto), F.lit(0.0)))
    level = F.col("_left") / F.col("_free")
    open_ = F.when(level < F.col("_stop"), level)  # the first source that does not reach its stop sets the level
    ranked = ranked.withColumn("_level", F.min(F.when(open_.isNotNull(), F.struct(F.col("_stop").alias("s"), F.col("_at").alias("a"), level.alias("v")))).over(every)["v"])
    out = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_w")))
    return ranked.withColumn("target", out.cast("double")).drop("_at", "_w", "_cap", "_stop", "_left", "_free", "_level")


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 11) -> DataFrame:
    """What a mix of all sources takes of every document: ``doc_id, size, source_size, target, taken``, and ``source, sig, copies``.

    ``sig`` is a hash of the text, ``copies`` how often the document is repeated. Size is the number of words (null text: 0). Rows with null source are a source of their own, the last one. The
    target of a source is met by whole documents: as many times all of them as fit, then for the remaining budget a
    count per exact length, fitted by bounded knapsack, and of each length that many documents in seeded order.
    Nothing is drawn at random, so reruns agree. Every row counts for itself, repeated or without doc_id; empty
    documents take 0; no rows give no rows. What the knapsack fits exactly is at most ``EXACT`` words; what a budget has
    beyond, which is the rounding of the shares of all lengths, goes to whole documents first.

    Only lengths and counts meet in one task per source (its distinct lengths). The documents of one length are
    ranked in cells of about 256 by hash, with running sums over the cells, so no group is ranked in one task.
    """
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    sizes = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("sig"), words.alias("size")).withColumn("key", key))
    hist = materialize(sizes.groupBy("key", "source", "size").agg(F.count("*").alias("n")))
    sources = hist.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = materialize(with_targets(sources, weights, share, float(most)).select("key", "source_size", "target"))

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        base = min(most, int((target + 1e-6) // total)) if total else 0
        budget = round(target - base * total) if base < most else 0
        take = fit_counts(dict(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True)), budget, seed)
        pdf["base"], pdf["extra"] = base, np.array([take.get(n, 0) for n in pdf["size"].tolist()], np.int64)
        return pdf[["key", "size", "n", "source_size", "target", "base", "extra"]]

    plan = hist.drop("source").join(sources, "key").groupBy("key").applyInPandas(fit, "key string, size long, n long, source_size long, target double, base int, extra long")
    plan = materialize(plan.withColumn("cells", F.ceil(F.col("n") / CELL).cast("long")).drop("n"))
    turn = F.xxhash64(F.lit(seed), "doc_id", "sig")
    rows = sizes.join(plan, ["key", "size"]).withColumn("turn", turn).withColumn("cell", F.pmod("turn", "cells"))
    over = Window.partitionBy("key", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = materialize(rows.groupBy("key", "size", "cell").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0))).drop("n"))
    place = F.row_number().over(Window.partitionBy("key", "size", "cell").orderBy("turn", "doc_id", "sig"))
    # not materialized: two small equi-joins and one ranking of small cells
    out = rows.join(cells, ["key", "size", "cell"]).withColumn("copies", F.col("base") + (F.col("before") + place <= F.col("extra")).cast("int"))
    drop(hist, sources)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "sig", "copies")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """What a mix of the sources of ``documents`` takes of each document."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).drop("source", "sig", "copies")
