"""The transfer graph: edges, pass-through, chains, rings and neighbourhoods, as equi-joins of bounded fan-out."""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrine.config import DEFAULT, EngineConfig
from sentrine.functions.exprs import java_round
from sentrine.operators.components import connected_components
from sentrine.operators.metrics import global_rank
from sentrine.operators.users import running_count
from sentrine.storage import append, drop, materialize, release


def build_edges(t: DataFrame) -> DataFrame:
    """Transfers between two accounts in event order; rows without counterparty and self-transfers are no edges."""
    real = F.col("counterparty_id").isNotNull() & (F.col("counterparty_id") != F.col("user_id"))
    return t.where(real).select("seq", "txn_id", F.col("user_id").alias("src"), F.col("counterparty_id").alias("dst"), "amount", "ts_ms")


def edge_lifetimes(edges: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``out_until, in_until``: the edge whose arrival pushes this one out of the newest 50 of its source, its target."""
    fall = lambda side: F.lead("seq", cfg.max_edges).over(Window.partitionBy(side).orderBy("seq"))
    return edges.withColumns({"out_until": fall("src"), "in_until": fall("dst")})


def cap_edges(edges: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The newest edges of each account."""
    newest = Window.partitionBy("src").orderBy(F.desc("seq"))
    return edges.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= cfg.max_edges).drop("_r")


def out_degree(t: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``out_degree`` at every payment of an account: its transfers of the last day, itself included, 50 at most."""
    edge = F.when(F.col("counterparty_id").isNotNull() & (F.col("counterparty_id") != F.col("user_id")), 1)
    day = Window.partitionBy("user_id").orderBy("ts_ms").rangeBetween(-cfg.edge_ttl_ms, 0)
    later = Window.partitionBy("user_id", "ts_ms").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    return t.withColumn("out_degree", F.least(F.lit(cfg.max_edges), F.count(edge).over(day) - F.count(edge).over(later)).cast("int"))


def live_edges_asof(edges: DataFrame, now_ms: int, cfg: EngineConfig = DEFAULT) -> DataFrame:
    return cap_edges(edges.where(F.col("ts_ms") <= now_ms), cfg).where(F.col("ts_ms") >= now_ms - cfg.edge_ttl_ms)


def graph_node_count(edges: DataFrame) -> DataFrame:
    return edges.agg(F.countDistinct("src").alias("nodes"))


def match_pass_through(edges: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Outgoing transfers with the recent inbound ones of their account: ``seq, in_seq, in_src, in_amount, in_ts, ratio, fits``.

    Inbound transfers get a rank per account; an outgoing one knows how many had arrived, so it meets at most the
    50 newest by an equi-join on (account, rank), with no range condition that a busy account could blow up.
    """
    rank = F.row_number().over(Window.partitionBy("dst").orderBy("seq"))
    inbound = edges.select(F.col("dst").alias("account"), rank.alias("rank"), F.col("seq").alias("in_seq"), F.col("src").alias("in_src"), F.col("amount").alias("in_amount"), F.col("ts_ms").alias("in_ts"))
    moves = edges.select(F.col("src").alias("account"), "seq", "amount", "ts_ms", F.lit(0).alias("arrives")).union(
        edges.select(F.col("dst").alias("account"), "seq", "amount", "ts_ms", F.lit(1).alias("arrives"))
    )
    so_far = Window.partitionBy("account").orderBy("seq", "arrives").rowsBetween(Window.unboundedPreceding, 0)
    out = moves.withColumn("had", F.sum("arrives").over(so_far)).where("arrives = 0 and had > 0")
    out = out.withColumn("rank", F.explode(F.sequence(F.greatest(F.lit(1), F.col("had") - (cfg.max_edges - 1)), F.col("had")))).withColumn("rank", F.col("rank").cast("int"))
    ratio = F.col("amount") / F.when(F.col("in_amount") > 0, F.col("in_amount"))
    near = (F.col("in_ts") <= F.col("ts_ms")) & (F.col("in_ts") >= F.col("ts_ms") - cfg.pass_window_ms) & (F.col("in_amount") > 0)
    return out.join(inbound, ["account", "rank"]).where(near).withColumn("ratio", ratio).withColumn("fits", F.col("ratio").between(cfg.pass_low, cfg.pass_high))


def pass_through(edges: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Per transfer with recent inbound money: ``seq, in_from, in_amount, pt_ratio, pt_secs, parent`` (null: no match)."""
    m = match_pass_through(edges, cfg)
    pick = F.max(F.struct("fits", "in_seq", "in_src", "in_amount", "in_ts", "ratio", "ts_ms"))
    best = m.groupBy("seq").agg(pick.alias("b"))
    return best.select(
        "seq", F.col("b.in_src").alias("in_from"), F.col("b.in_amount").alias("in_amount"), java_round(F.col("b.ratio"), 3).alias("pt_ratio"),
        F.floor((F.col("b.ts_ms") - F.col("b.in_ts")) / 1000).cast("long").alias("pt_secs"), F.when(F.col("b.fits"), F.col("b.in_seq")).alias("parent"),
    )


def chain_depth(matched: DataFrame, cap: int = DEFAULT.chain_cap, known: DataFrame | None = None) -> DataFrame:
    """``seq, depth``: forwarded hops in a row up to ``cap``, by pointer doubling over the matched parents.

    ``known`` (``seq, depth``) has earlier transfers that may be parents; they are not in the result.
    """
    cur = matched.select("seq", F.col("parent").alias("jump"), F.when(F.col("parent").isNotNull(), 1).otherwise(0).alias("depth"))
    if known is not None:
        cur = cur.unionByName(known.select("seq", F.lit(None).cast("string").alias("jump"), "depth"))
    cur, reach = materialize(cur), 1
    while reach < cap:
        far = cur.select(F.col("seq").alias("jump"), F.col("jump").alias("jump2"), F.col("depth").alias("depth2"))
        nxt = materialize(cur.join(far, "jump", "left").select("seq", F.col("jump2").alias("jump"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth")))
        drop(cur)
        cur = nxt
        reach *= 2
    out = cur.select("seq", F.least(F.lit(cap), "depth").cast("int").alias("depth"))
    return out if known is None else out.join(known.select("seq"), "seq", "left_anti")


def ranked_edges(edges: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``seq, src, dst, ts_ms, rank, until``: the number of each transfer among those of its source, and the one that pushes it out of the newest."""
    e = running_count(edges.select("seq", "src", "dst", "ts_ms"), "src", "rank")
    fall = e.select("src", (F.col("rank") - cfg.max_edges).alias("rank"), F.col("seq").alias("until"))
    return e.join(fall, ["src", "rank"], "left").select("seq", "src", "dst", "ts_ms", "rank", "until")


def out_lists(step: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``node, chunk, list``: the transfers of each account by rank, ``max_edges`` in a row; those to accounts that nothing leaves are left out."""
    leads = step.select(F.col("src").alias("dst")).distinct()
    e = F.struct(F.col("dst").alias("to"), F.col("seq").alias("e_seq"), F.col("ts_ms").alias("e_ts"), F.col("until").alias("e_until"))
    return step.join(leads, "dst", "left_semi").groupBy(F.col("src").alias("node"), F.floor((F.col("rank") - 1) / cfg.max_edges).alias("chunk")).agg(F.collect_list(e).alias("list"))


def _forward(cur: DataFrame, lists: DataFrame, sent: DataFrame | None, i: int, cfg: EngineConfig) -> DataFrame:
    """Paths one transfer longer: ``x<i>`` and ``s<i>`` are the account it reaches and the transfer.

    ``sent`` has the transfers of accounts with more than ``max_edges`` of them. There a path knows how many had been sent
    when ``seq`` arrived, and so meets at most two lists by an equi-join on (account, chunk), however many are no longer
    live. The other accounts have one list. Lists are opened after the join, so that a path is shuffled once.
    """
    at = cur.withColumn("chunk", F.lit(0).cast("long"))
    if sent is not None:
        busy = sent.select("node").distinct()
        both = cur.join(busy, "node", "left_semi").withColumns({"_sent": F.lit(0), "ev": F.col("ts_ms")}).unionByName(sent, allowMissingColumns=True)
        had = running_count(both, "node", "had", "ev", "_sent").where("_sent = 0 and had > 0").drop("_sent", "ev")
        chunk = lambda rank: F.floor((rank - 1) / cfg.max_edges)
        chunks = F.sequence(chunk(F.greatest(F.lit(1), F.col("had") - (cfg.max_edges - 1))), chunk(F.col("had")))
        at = at.join(busy, "node", "left_anti").unionByName(had.withColumn("chunk", F.explode(chunks)).drop("had"))
    nxt = at.join(lists, ["node", "chunk"]).select(*[c for c in at.columns if c != "chunk"], F.inline("list"))
    nxt = nxt.where((F.col("e_seq") < F.col("seq")) & (F.col("e_until").isNull() | (F.col("e_until") >= F.col("seq"))) & (F.col("e_ts") >= F.col("ts_ms") - cfg.edge_ttl_ms))
    for seen in ["x0", *(f"x{j}" for j in range(1, i))]:
        nxt = nxt.where(F.col("to") != F.col(seen))
    return nxt.withColumns({f"x{i}": F.col("to"), f"s{i}": F.col("e_seq"), "node": F.col("to")}).drop("to", "e_seq", "e_ts", "e_until")


def half_paths(step: DataFrame, wanted: DataFrame | None, length: int, cfg: EngineConfig, goals: DataFrame) -> DataFrame:
    """Paths of one or two transfers to one of ``goals`` by first and last account and day: ``node, goal, day, mid, hops, newest, until, oldest_ms``.

    A transfer counts on its own day and the next, beyond which it is dead. Two meet at the account between them; where
    an account has so many on both sides that all pairs would exceed ``max_edges`` squared for each of its transfers, only
    pairs between ``wanted`` accounts (``node, goal, day``) are made, a lookup for each of them.
    """
    days = lambda ts: F.explode(F.array(F.floor(ts / cfg.edge_ttl_ms), F.floor(ts / cfg.edge_ttl_ms) + 1))
    e = step.select("seq", "src", "dst", "ts_ms", "until").withColumn("day", days(F.col("ts_ms")))
    last = e.join(goals.select(F.col("goal").alias("dst")), "dst", "left_semi")
    out = last.select(F.col("src").alias("node"), F.col("dst").alias("goal"), "day", F.lit(None).cast(step.schema["src"].dataType).alias("mid"), F.array("seq").alias("hops"), F.col("seq").alias("newest"), "until", F.col("ts_ms").alias("oldest_ms"))
    if length < 2:
        return out
    a = e.select(F.col("src").alias("node"), F.col("dst").alias("mid"), "day", *[F.col(c).alias(f"{c}_a") for c in ("seq", "ts_ms", "until")])
    b = last.select(F.col("src").alias("mid"), F.col("dst").alias("goal"), "day", *[F.col(c).alias(f"{c}_b") for c in ("seq", "ts_ms", "until")])
    if wanted is not None:
        dense = dense_accounts(step, cfg).withColumn("day", F.explode(F.array("day", F.col("day") + 1))).distinct()
        heavy = a.join(dense, ["mid", "day"], "left_semi").join(wanted, ["node", "day"]).join(b, ["mid", "goal", "day"])
        a = a.join(dense, ["mid", "day"], "left_anti")
        pairs = a.join(b, ["mid", "day"]).unionByName(heavy)
    else:
        pairs = a.join(b, ["mid", "day"])
    newest, until = F.greatest("seq_a", "seq_b"), F.least("until_a", "until_b")  # least skips nulls, which stand for never
    two = pairs.where((F.col("node") != F.col("goal")) & (until.isNull() | (until > newest)))
    return out.unionByName(two.select("node", "goal", "day", "mid", F.array("seq_a", "seq_b").alias("hops"), newest.alias("newest"), until.alias("until"), F.least("ts_ms_a", "ts_ms_b").alias("oldest_ms")))


def dense_accounts(step: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``mid, day`` of accounts whose incoming times outgoing transfers of a day exceed ``max_edges`` squared for each transfer."""
    day = F.floor(F.col("ts_ms") / cfg.edge_ttl_ms).alias("day")
    ends = step.select(F.col("dst").alias("mid"), day, F.lit(1).alias("i"), F.lit(0).alias("o")).union(step.select("src", day, F.lit(0), F.lit(1)))
    n = ends.groupBy("mid", "day").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return n.where(F.least("i", "o") > cfg.max_edges**2).select("mid", "day")


def _placed(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Rows with their ``global_rank`` as ``name``, written."""
    ranked = global_rank(rows, *order)
    out = materialize(ranked.withColumnRenamed("rank", name))
    drop(ranked)
    return out


def numbered(starts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Starts and edges with numbers for ``seq`` and accounts, in the order of their names; and the names of both, ``seq, no`` and ``node, id``."""
    order = _placed(edges.select("seq").union(starts.select("seq")).distinct(), "no", "seq")
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(starts.select("goal")).union(starts.select("node")).distinct()
    names = _placed(ends, "id", "node")

    def plain(rows: DataFrame, *ends: str) -> DataFrame:
        rows = rows.join(order, "seq").drop("seq").withColumnRenamed("no", "seq")
        for c in ends:
            rows = rows.join(names.select(F.col("node").alias(c), F.col("id").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
        return materialize(rows)

    return plain(starts.select("seq", "ts_ms", "goal", "node"), "goal", "node"), plain(edges.select("seq", "src", "dst", "ts_ms"), "src", "dst"), order, names


def path_slices(starts: DataFrame, step: DataFrame, crowded: bool, cfg: EngineConfig, few: int, most: int) -> int:
    """In how many slices starts are followed, so that each has about ``few`` half paths; and ``most`` paths ahead, if those have to be written."""
    day = F.floor(F.col("ts_ms") / cfg.edge_ttl_ms)
    days = F.explode(F.array(day, day + 1)).alias("day")
    ends = step.select(F.col("dst").alias("mid"), days, F.lit(1).alias("i"), F.lit(0).alias("o")).union(step.select("src", days, F.lit(0), F.lit(1)))
    pairs = ends.groupBy("mid", "day").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).where(F.least("i", "o") <= 2 * cfg.max_edges**2)
    n = (pairs.agg(F.sum(F.col("i") * F.col("o")).alias("n")).first()["n"] or 0) / few
    if crowded:
        leaves = step.groupBy(F.col("src").alias("node")).agg(F.least(F.lit(cfg.max_edges), F.count("*")).alias("c"))
        two = step.join(leaves.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.avg("c").alias("two"))
        ahead = starts.join(leaves, "node").join(two, "node").agg(F.sum(F.col("c") * F.col("two")).alias("n"))
        n = max(n, (ahead.first()["n"] or 0) / most)
    return max(1, math.ceil(n))


def expand_paths(starts: DataFrame, edges: DataFrame, cfg: EngineConfig = DEFAULT, few: int = 8_000_000, most: int = 32_000_000) -> DataFrame:
    """First path, by edge order, from ``node`` to ``goal`` over the edges live when ``seq`` arrives.

    ``starts``: ``seq, ts_ms, goal, node``. Paths are simple and have at most ``max_cycle - 1`` edges. They meet in the
    middle: paths of two transfers go forward from each start, at most ``max_edges`` squared of them, and look up the
    half paths of one or two transfers that lead from where they are to the goal, by (account, goal, day); whether
    those are live is checked as of ``seq``. So no step makes rows for paths that do not close beyond the second
    transfer. Accounts that nothing leaves are trimmed. Returns ``seq, path`` (accounts) and ``hops``.

    Both kinds of paths grow with the square of what an account sends, so they are made for a slice of the goals at a time,
    about ``few`` half paths each, and go before the next slice; transfers and accounts are numbers on the way.
    """
    back = max(0, min(2, cfg.max_cycle - 2))
    ahead = cfg.max_cycle - 1 - back
    spark = edges.sparkSession
    starts, plain, order, names = numbered(starts, edges)
    step = materialize(ranked_edges(plain, cfg))
    lists = materialize(out_lists(step, cfg))
    busy = step.where(F.col("rank") > cfg.max_edges).select("src").distinct()
    sent = None
    if busy.head(1):
        sent = materialize(step.join(busy, "src", "left_semi").select(F.col("src").alias("node"), "seq", F.col("ts_ms").alias("ev"), F.lit(1).alias("_sent")))
    crowded = back > 1 and bool(dense_accounts(step, cfg).head(1))
    n = path_slices(starts, step, crowded, cfg, few, most) if back > 1 else 1
    base = [starts, plain, step, lists, *([sent] if sent is not None else [])]
    if n > 1:  # a goal of more starts than a slice should have is in several
        many = starts.groupBy("goal").agg(F.count("*").alias("_n"))
        share = F.ceil(F.col("_n") * n / F.lit(starts.count()))
        starts = starts.join(many, "goal").withColumn("part", F.pmod(F.xxhash64("goal", F.pmod(F.xxhash64("seq"), share)), F.lit(n))).drop("_n")
        starts = materialize(starts.repartitionByRange("part").sortWithinPartitions("part"))
        base.append(starts)
    release(spark)
    best = None
    for i in range(n):
        mine = starts.where(F.col("part") == i).drop("part") if n > 1 else starts
        rows, tables = _meet_in_the_middle(mine, step, lists, sent, crowded, ahead, back, cfg, few)
        best = append(best, rows)
        drop(*tables)
        release(spark)
    out = best.select("seq", F.posexplode(F.arrays_zip("path", "hops"))).select("seq", "pos", F.col("col.path").alias("id"), F.col("col.hops").alias("hop"))
    out = out.join(names, "id").join(order.select(F.col("no").alias("hop"), F.col("seq").alias("name")), "hop", "left")
    out = out.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "name"))).alias("on"))
    out = out.withColumnRenamed("seq", "no").join(order, "no").select("seq", F.col("on.node").alias("path"), F.array_compact("on.name").alias("hops"))
    out = materialize(out)
    drop(*base, best, order, names)
    release(spark)
    return out


def _meet_in_the_middle(starts: DataFrame, step: DataFrame, lists: DataFrame, sent: DataFrame | None, crowded: bool, ahead: int, back: int, cfg: EngineConfig, few: int) -> tuple[DataFrame, list[DataFrame]]:
    """First paths, ``seq, path, hops``, of numbered ``starts``; and the tables to drop when they are written."""
    cur, found, tables = starts.withColumn("x0", F.col("node")), [], []
    for i in range(1, ahead):
        cur = materialize(_forward(cur, lists, sent, i, cfg))
        tables.append(cur)
        found.append(cur.where("node = goal").select("seq", _path(i).alias("path"), _hops(i).alias("hops")))
        cur = cur.where("node != goal")
    cur = _forward(cur, lists, sent, ahead, cfg)
    if back:
        cur = cur.withColumn("day", F.floor(F.col("ts_ms") / cfg.edge_ttl_ms))
        if crowded:
            cur = materialize(cur)
            tables.append(cur)
        half = half_paths(step, cur.select("node", "goal", "day").distinct() if crowded else None, back, cfg, starts.select("goal").distinct())
        half = materialize(half.withColumnsRenamed({"hops": "rest", "node": "from", "goal": "to", "day": "on"}))
        tables.append(half)
        cur = _leads_back(cur, half, few)
        leads_back = (F.col("node") == F.col("from")) & (F.col("goal") == F.col("to")) & (F.col("day") == F.col("on"))
        live = (F.col("newest") < F.col("seq")) & (F.col("until").isNull() | (F.col("until") > F.col("seq"))) & (F.col("oldest_ms") >= F.col("ts_ms") - cfg.edge_ttl_ms)
        cur = cur.join(half, leads_back, "left").where((F.col("node") == F.col("goal")) | (live & ~F.coalesce(F.array_contains(_path(ahead), F.col("mid")), F.lit(False))))
        rest = F.when(F.col("node") != F.col("goal"), F.array_compact(F.array("mid", "goal")))
        none = F.array().cast("array<long>")
        path, hops = F.concat(_path(ahead), F.coalesce(rest, none)), F.concat(_hops(ahead), F.coalesce("rest", none))
    else:
        cur, path, hops = cur.where("node = goal"), _path(ahead), _hops(ahead)
    every = cur.select("seq", path.alias("path"), hops.alias("hops"))
    for f in found:
        every = every.union(f)
    return every.groupBy("seq").agg(F.min(F.struct("hops", "path")).alias("b")).select("seq", "b.path", "b.hops"), tables


def _leads_back(cur: DataFrame, half: DataFrame, few: int) -> DataFrame:
    """Paths ahead that may have a half path, before they are shuffled: most have none.

    Ends of half paths set bits of bitmaps, 16 or more for each end and 16 MB at most, which are broadcast; beyond four times ``few`` half
    paths bits would be too full to tell, and all paths go on.
    """
    n = half.count()
    if n > 4 * few:
        return cur
    size = 1 << 15  # bits of one of Spark's bitmaps
    bits = size * min(1 << 12, max(1, math.ceil(16 * n / size)))
    bit = lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(bits))
    ends = half.select(bit("from", "to").alias("bit")).distinct()
    maps = ends.groupBy(F.floor(F.col("bit") / size).alias("_map")).agg(F.bitmap_construct_agg(F.col("bit") % size).alias("_bits"))
    cur = cur.withColumn("_bit", bit("node", "goal")).withColumn("_map", F.floor(F.col("_bit") / size))
    octet = F.conv(F.hex(F.substring("_bits", (F.col("_bit") % size / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    some = F.expr("shiftright(_octet, cast(_bit % 8 as int)) & 1") == 1
    return cur.join(F.broadcast(maps), "_map", "left").withColumn("_octet", octet).where((F.col("node") == F.col("goal")) | some).drop("_map", "_bit", "_bits", "_octet")


def _path(i: int):
    return F.array(*[f"x{j}" for j in range(i)], "node")


def _hops(i: int):
    return F.array(*[f"s{j}" for j in range(1, i + 1)])


def ring_cycles(edges: DataFrame, cfg: EngineConfig = DEFAULT, of: DataFrame | None = None) -> DataFrame:
    """``seq, cycle``: the first cycle each transfer (``of`` these) closes, as accounts from its source round to its source."""
    of = edges if of is None else of
    starts = of.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("seq", "ts_ms", F.col("src").alias("goal"), F.col("dst").alias("node"))
    out = expand_paths(starts, edges, cfg).join(of.select("seq", "src"), "seq")
    return out.select("seq", F.concat(F.array("src"), "path").alias("cycle"))


def cycles_through(edges: DataFrame, roots: DataFrame, now_ms: int, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Cycles that accounts (``root``) sit on as of ``now_ms``: one per live edge, the first of each set of accounts."""
    live = live_edges_asof(edges, now_ms, cfg)
    first = live.join(roots, F.col("src") == F.col("root"), "left_semi")
    starts = first.select(F.concat(F.lit("~"), "seq").alias("seq"), F.lit(now_ms).alias("ts_ms"), F.col("src").alias("goal"), F.col("dst").alias("node"))
    out = expand_paths(starts, edges.where(F.col("ts_ms") <= now_ms), cfg)
    out = out.select(F.expr("substr(seq, 2)").alias("seq"), "path").join(first.select("seq", "src"), "seq")
    out = out.select(F.col("src").alias("root"), "seq", F.concat(F.array("src"), "path").alias("cycle")).withColumn("_set", F.array_sort(F.array_distinct("cycle")))
    return distinct_cycles(out)


def distinct_cycles(cycles: DataFrame) -> DataFrame:
    """One cycle for each root and set of accounts, the earliest."""
    w = Window.partitionBy("root", "_set").orderBy("seq")
    return cycles.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_set")


class Neighborhood:
    """What surrounds some accounts (``root``) as of ``now_ms``, a table each, made when it is asked for.

    ``nodes`` (root, node, hop, degree) has all within ``depth`` live transfers; ``edges`` (root, seq, src, dst, amount,
    ts_ms, chain_depth) the live transfers of every account on the way, each with the number of hops over which its
    money had been passed on when it was made; ``cycles`` (root, seq, cycle) those of ``cycles_through``; ``sizes`` (root,
    component_size) counts over all transfers so far, 1 for an account without any.
    """

    def __init__(self, edges: DataFrame, roots: DataFrame, now_ms: int, depth: int = 2, cfg: EngineConfig = DEFAULT):
        self.known, self.roots, self.now_ms, self.depth, self.cfg = edges.where(F.col("ts_ms") <= now_ms), roots.select("root").distinct(), now_ms, depth, cfg

    @cached_property
    def live(self) -> DataFrame:
        return materialize(live_edges_asof(self.known, self.now_ms, self.cfg))

    @cached_property
    def seen(self) -> DataFrame:
        front = seen = self.roots.select("root", F.col("root").alias("node"), F.lit(0).alias("hop"))
        for hop in range(1, self.depth + 1):
            front = front.join(self.live.select(F.col("src").alias("node"), "dst"), "node").select("root", F.col("dst").alias("node"), F.lit(hop).alias("hop")).distinct()
            seen = seen.union(front)
        return materialize(seen.groupBy("root", "node").agg(F.min("hop").alias("hop")))

    @cached_property
    def nodes(self) -> DataFrame:
        degree = self.live.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
        return self.seen.join(degree, "node", "left").select("root", "node", "hop", F.coalesce("degree", F.lit(0)).alias("degree"))

    @cached_property
    def edges(self) -> DataFrame:
        deep = self.live.join(chain_depth(pass_through(self.known, self.cfg), self.cfg.chain_cap), "seq", "left").withColumn("chain_depth", F.coalesce("depth", F.lit(0)))
        on_the_way = self.seen.where(F.col("hop") < self.depth).withColumnRenamed("node", "src")
        return on_the_way.join(deep, "src").select("root", "seq", "src", "dst", "amount", "ts_ms", "chain_depth")

    @cached_property
    def cycles(self) -> DataFrame:
        return cycles_through(self.known, self.roots, self.now_ms, self.cfg)

    @cached_property
    def sizes(self) -> DataFrame:
        sizes = components_final(self.known).select(F.col("node").alias("root"), F.col("size").alias("component_size"))
        return self.roots.join(sizes, "root", "left").fillna(1, ["component_size"])


def components_final(edges: DataFrame) -> DataFrame:
    """``node, component, size``."""
    c = connected_components(edges)
    return c.join(c.groupBy("component").agg(F.count("*").alias("size")), "component").select("node", "component", "size")


def component_size_asof(t: DataFrame, block: int = 1 << 18) -> DataFrame:
    """``seq, component_size``: the size of its account's component as each payment arrives, its own transfer included; 1 if unseen.

    ``t``: ``seq, ts_ms, src, dst``; a payment without ``dst`` links nothing.
    """
    return component_sizes(t, None, block)


def component_size_windowed(t: DataFrame, window_ms: int = 86_400_000, block: int = 1 << 18) -> DataFrame:
    """``seq, component_size`` over the transfers of the trailing window alone, so that old ones stop counting; the window's start is included."""
    return component_sizes(t, window_ms, block)


def component_sizes(t: DataFrame, window_ms: int | None, block: int = 1 << 18) -> DataFrame:
    """Sizes of components that gain and lose transfers, by offline dynamic connectivity over a segment tree of time.

    Arrivals and ends of all transfers get places in one order, which is cut into slices of at most ``block`` of them.
    From the whole of it down to slices, each part is halved: transfers that live throughout a half are contracted there,
    so that their components become the accounts of that half and carry their sizes, and those that begin or end within
    it go on to its own halves. A slice is one task, which halves on in memory with a union-find that is rolled back.
    The number of rounds is logarithmic, and no task sees more than ``block`` ends, however large a component is.
    ``t`` may carry ``size_a, size_b``, where accounts stand for several.
    """
    one = F.lit(1).cast("long")
    moves = F.col("dst").isNotNull() & (F.col("dst") != F.col("src"))
    sizes = [F.col(c) if c in t.columns else one.alias(c) for c in ("size_a", "size_b")]
    rows = t.select("seq", F.col("ts_ms").alias("at"), F.lit(0).alias("end"), F.col("src").alias("a"), F.when(moves, F.col("dst")).otherwise(F.col("src")).alias("b"), *sizes)
    if window_ms is not None:
        ends = rows.where("a != b").select("seq", (F.col("at") + window_ms).alias("at"), F.lit(1).alias("end"))
        rows = rows.unionByName(ends, allowMissingColumns=True)
    ranked = global_rank(rows, "at", "end", "seq")
    placed = materialize(ranked.withColumn("rank", F.col("rank") - 1))
    drop(ranked)
    if window_ms is not None:
        over = placed.where("end = 1").select("seq", F.col("rank").alias("hi"))
        rows = placed.where("end = 0").join(over, "seq", "left")
    else:
        rows = placed.withColumn("hi", F.lit(None).cast("long"))
    n = placed.count()
    slices = 1
    while slices * block < n:
        slices *= 2
    slot = lambda c: F.floor(F.col(c) * slices / max(n, 1)).cast("long")
    forever = F.lit(1 << 62)
    rows = rows.select(F.lit(0).cast("long").alias("part"), "seq", F.col("rank").alias("lo"), F.coalesce("hi", F.when(F.col("a") == F.col("b"), F.col("rank") + 1).otherwise(forever)).alias("hi"), "a", "b", "size_a", "size_b")
    rows = rows.withColumns({"lo_s": slot("lo"), "hi_s": F.when(F.col("hi") == forever, forever).otherwise(slot("hi"))})
    width, tag = slices, lambda c: F.concat(F.col("part").cast("string"), F.lit(":"), F.col(c))
    tables = [placed]
    while width > 1:
        width //= 2
        half = rows.withColumn("part", F.explode(F.array(F.col("part") * 2, F.col("part") * 2 + 1)))
        first, beyond = F.col("part") * width, (F.col("part") + 1) * width
        half = half.where((F.col("lo_s") < beyond) & (F.col("hi_s") >= first)).withColumn("through", (F.col("lo_s") < first) & (F.col("hi_s") >= beyond))
        half = materialize(half)
        whole = half.where("through")
        nodes = whole.select(tag("a").alias("node"), F.col("size_a").alias("size")).union(whole.select(tag("b"), "size_b")).distinct()
        linked = connected_components(whole.select(tag("a").alias("src"), tag("b").alias("dst")))
        comp = linked.join(nodes, "node")
        totals = comp.groupBy("component").agg(F.sum("size").alias("total"))
        comp = materialize(comp.join(totals, "component").select("node", F.regexp_replace("component", "^[0-9]+:", "").alias("to"), "total"))
        out = half.where("not through").drop("through")
        for side in ("a", "b"):
            found = comp.select(F.col("node").alias(f"node_{side}"), F.col("to").alias(f"to_{side}"), F.col("total").alias(f"total_{side}"))
            out = out.join(found, tag(side) == F.col(f"node_{side}"), "left")
        moved = lambda new, old: F.coalesce(F.col(new), F.col(old)).alias(old)
        rows = materialize(out.select("part", "seq", "lo", "hi", "lo_s", "hi_s", moved("to_a", "a"), moved("to_b", "b"), moved("total_a", "size_a"), moved("total_b", "size_b")))
        drop(*tables, half, linked, comp)
        release(t.sparkSession)
        tables = [rows]
    return rows.groupBy("part").applyInPandas(_replay, f"seq {t.schema['seq'].dataType.simpleString()}, component_size long")


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sizes for the payments of one slice: those whose place lies in it. Transfers from before it lead in."""
    pdf = pdf.sort_values("lo", kind="stable")
    own = pdf["lo_s"].to_numpy() == pdf["part"].to_numpy()
    at = pdf["lo"].to_numpy()[own]
    names, codes = np.unique(np.concatenate([pdf["a"].to_numpy(object), pdf["b"].to_numpy(object)]).astype(str), return_inverse=True)
    a, b = codes[: len(pdf)].tolist(), codes[len(pdf) :].tolist()
    size = np.ones(len(names), np.int64)
    size[codes] = np.concatenate([pdf["size_a"].to_numpy(), pdf["size_b"].to_numpy()])
    size, up, asked, out = size.tolist(), list(range(len(names))), codes[: len(pdf)][own].tolist(), [0] * len(at)

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    def link(x: int, y: int, undo: list) -> None:
        x, y = top(x), top(y)
        if x != y:
            if size[x] < size[y]:
                x, y = y, x
            up[y] = x
            size[x] += size[y]
            undo.append((x, y))

    begin = np.searchsorted(at, pdf["lo"].to_numpy(), side="left").tolist()
    end = np.searchsorted(at, pdf["hi"].to_numpy(), side="left").tolist()
    real = [i for i in range(len(pdf)) if a[i] != b[i] and begin[i] < end[i]]

    def halve(lo: int, hi: int, edges: list[int]) -> None:
        undo, rest = [], []
        for i in edges:
            if begin[i] <= lo and end[i] >= hi:
                link(a[i], b[i], undo)
            else:
                rest.append(i)
        if hi - lo == 1:
            out[lo] = size[top(asked[lo])]
        elif not rest:
            out[lo:hi] = [size[top(x)] for x in asked[lo:hi]]
        elif all(end[i] >= hi for i in rest):  # nothing ends in here: in order, without going back
            todo, k = sorted(rest, key=begin.__getitem__), 0
            for j in range(lo, hi):
                while k < len(todo) and begin[todo[k]] <= j:
                    link(a[todo[k]], b[todo[k]], undo)
                    k += 1
                out[j] = size[top(asked[j])]
        else:
            mid = (lo + hi) // 2
            halve(lo, mid, [i for i in rest if begin[i] < mid])
            halve(mid, hi, [i for i in rest if end[i] > mid])
        for x, y in reversed(undo):
            size[x] -= size[y]
            up[y] = y

    if len(at):
        halve(0, len(at), real)
    return pd.DataFrame({"seq": pdf["seq"].to_numpy()[own], "component_size": out})
