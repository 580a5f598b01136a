"""Per-user features. What grows with an account's history is counted in chunks of time, so that a busy account is many tasks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrine.config import DEFAULT, EngineConfig
from sentrine.functions.exprs import haversine_km, java_round
from sentrine.storage import drop, materialize


def _user():
    return Window.partitionBy("user_id")


def _in_order():
    return _user().orderBy("seq")


def _before():
    return _in_order().rowsBetween(Window.unboundedPreceding, -1)


HOUR = 3_600_000


def running_count(rows: DataFrame, key: str, name: str, at: str = "ts_ms", counted: str | None = None, order: str = "seq", chunk_ms: int = HOUR) -> DataFrame:
    """Adds ``name``: of the rows of one ``key`` how many there are up to each by ``order``, itself included.

    With ``counted`` only rows where it is 1 count, and of equal ``order`` rows of 0 come first. A key's rows are counted
    in chunks of time, whose totals are carried on, so that a key with a third of all rows is spread over tasks;
    ``order`` has to follow ``at``.
    """
    chunk = F.floor(F.col(at) / chunk_ms)
    one = F.col(counted).cast("long") if counted else F.lit(1).cast("long")
    own = Window.partitionBy(key, "_c").orderBy(order, *([counted] if counted else []))
    within = F.sum(one).over(own.rowsBetween(Window.unboundedPreceding, 0)) if counted else F.row_number().over(own).cast("long")
    totals = rows.groupBy(key, chunk.alias("_c")).agg(F.sum(one).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.withColumn("_before", before).drop("_n")
    return rows.withColumn("_c", chunk).withColumn(name, within).join(totals, [key, "_c"]).withColumn(name, F.col(name) + F.col("_before")).drop("_c", "_before")


def _meet(rows: DataFrame, sums: DataFrame, *keys: str) -> DataFrame:
    """Each row with the sums of its keys, null keys too."""
    named = sums.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return rows.join(named, same).drop(*[f"_of_{k}" for k in keys])


def velocity_features(t: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``cnt1m, cnt5m, cnt1h`` and sums, the payment itself included.

    A window is sixty tumbling buckets ending with the payment's own; payments later in that bucket are taken off.
    Every window fits two chunks of its own length, so payments are counted within chunks of time, each of which also
    sees those of the chunk before: an account is spread over as many tasks as it has chunks.
    """
    out = t
    for name, size, _ in cfg.windows:
        b = size // 60
        chunk, bucket = F.floor(F.col("ts_ms") / size), F.col("ts_ms") - F.pmod("ts_ms", F.lit(b))
        sums = t.groupBy("user_id", bucket.alias("_b")).agg(F.count("*").alias("_n"), F.sum("amount").alias("_s"))
        at = F.floor(F.col("_b") / size)
        sums = sums.withColumn("_own", at).withColumn("_c", F.explode(F.array(at, at + 1)))
        near = Window.partitionBy("user_id", "_c").orderBy("_b").rangeBetween(-(size - b), 0)
        sums = sums.select("user_id", "_b", "_c", "_own", F.sum("_n").over(near).alias("_n"), F.sum("_s").over(near).alias("_s")).where("_c = _own").drop("_c", "_own")
        later = Window.partitionBy("user_id", "_b").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
        out = out.withColumn("_b", bucket).withColumns({"_ln": F.count("*").over(later), "_ls": F.coalesce(F.sum("amount").over(later), F.lit(0.0))})
        out = _meet(out, sums, "user_id", "_b").withColumns({f"cnt{name}": (F.col("_n") - F.col("_ln")).cast("long"), f"sum{name}": F.col("_s") - F.col("_ls")})
        out = out.drop("_b", "_n", "_s", "_ln", "_ls")
    return out


def amount_zscore(t: DataFrame, cfg: EngineConfig = DEFAULT, chunk_ms: int = HOUR) -> DataFrame:
    """``amt_z`` against the user's earlier amounts; 0 with few of them or hardly any spread.

    Number, sum and squared deviations are taken within chunks of time and joined with those of the chunks before, by
    the rule for merging two sets; so an account's history is in many tasks, and no sum of squares loses digits.
    """
    chunk = F.floor(F.col("ts_ms") / chunk_ms)
    before = Window.partitionBy("user_id").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = t.groupBy("user_id", chunk.alias("_c")).agg(F.count("amount").alias("n"), F.sum("amount").alias("s"), F.coalesce(F.var_pop("amount") * F.count("amount"), F.lit(0.0)).alias("m2"))
    # merged before a chunk: all squares about a common origin, the account's first chunk mean, which keeps them small
    origin = F.first(F.col("s") / F.when(F.col("n") > 0, F.col("n")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("_c").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sums = sums.withColumn("o", origin)
    shift = F.col("s") - F.col("n") * F.col("o")
    sums = sums.select("user_id", "_c", "o", *[F.coalesce(F.sum(x).over(before), F.lit(0.0)).alias(a) for a, x in (("n0", F.col("n")), ("d0", shift), ("q0", F.col("m2") + F.when(F.col("n") > 0, shift * shift / F.col("n")).otherwise(0.0)))])
    own = Window.partitionBy("user_id", "_c").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    out = _meet(t.withColumn("_c", chunk), sums, "user_id", "_c")
    d = F.col("amount") - F.col("o")
    out = out.withColumns({"_n": F.col("n0") + F.count("amount").over(own), "_d": F.col("d0") + F.coalesce(F.sum(d).over(own), F.lit(0.0)), "_q": F.col("q0") + F.coalesce(F.sum(d * d).over(own), F.lit(0.0))})
    n, mean = F.col("_n"), F.col("_d") / F.when(F.col("_n") > 0, F.col("_n"))
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("_q") - F.col("_d") * mean) / F.when(n > 1, n - 1))
    z = (d - mean) / F.when(std > 0, std)
    known = (n >= cfg.min_samples) & (std >= cfg.min_std)
    return out.withColumn("amt_z", F.when(known, java_round(z, 2)).otherwise(0.0)).drop("_c", "o", "n0", "d0", "q0", "_n", "_d", "_q")


def geo_features(t: DataFrame) -> DataFrame:
    """``secs_since, gap_s, distance_km, speed_kmh`` against the payment before; -1 seconds and nulls without one."""
    was = lambda c: F.lag(c).over(_in_order())
    out = t.withColumns({"_lat": was("lat"), "_lon": was("lon"), "_ms": was("ts_ms")})
    gap = F.col("ts_ms") - F.col("_ms")
    out = out.withColumns({
        "secs_since": F.when(gap.isNull(), -1.0).otherwise(F.greatest(F.lit(0.0), gap / 1000.0)),
        "gap_s": F.floor(gap / 1000).cast("long"),
        "distance_km": F.when(gap.isNotNull(), haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))),
    })
    return out.withColumn("speed_kmh", F.when(F.col("gap_s") >= 1, F.col("distance_km") / (F.col("gap_s") / 3600.0))).drop("_lat", "_lon", "_ms")


def dedup_first(t: DataFrame, ttl_ms: int = DEFAULT.dedup_ttl_ms, key: str = "txn_id") -> DataFrame:
    """Of rows with one id those accepted: the first, and each one more than the TTL after the last accepted one.

    Where no id comes twice all rows stay as they are. Else rows that repeat id and time are put together before they are
    shuffled. An id whose rows lie within the TTL keeps its first. Of the others each time points to the first time more
    than the TTL later, and the times reached from the first are found by doubling the pointers, so an id that is
    replayed for long fills no row and needs no loop.
    """
    t = t.where(F.col(key).isNotNull() & F.col("ts_ms").isNotNull())
    if not t.groupBy(key).count().where("count > 1").head(1):
        return t
    t = t.dropDuplicates([key, "ts_ms"])
    span = t.groupBy(key).agg(F.min("ts_ms").alias("_first"), F.max("ts_ms").alias("_last"))
    replayed = span.where(F.col("_last") - F.col("_first") > ttl_ms)
    if not replayed.head(1):
        return t.join(span.select(key, F.col("_first").alias("ts_ms")), [key, "ts_ms"], "left_semi")
    later = F.min("ts_ms").over(Window.partitionBy(key).orderBy("ts_ms").rangeBetween(ttl_ms + 1, Window.unboundedFollowing))
    jump = materialize(t.select(key, "ts_ms").join(replayed.select(key), key, "left_semi").withColumn("to", later))
    reached, n, was, tables = span.select(key, F.col("_first").alias("ts_ms")), -1, 0, [jump]
    while n != was:
        ahead = reached.join(jump.where("to is not null"), [key, "ts_ms"]).select(key, F.col("to").alias("ts_ms"))
        reached = materialize(reached.union(ahead).distinct())
        n, was = reached.count(), n
        double = jump.join(jump.select(key, F.col("ts_ms").alias("to"), F.col("to").alias("_to2")), [key, "to"], "left")
        jump = materialize(double.select(key, "ts_ms", F.col("_to2").alias("to")))
        tables += [jump, reached]
    out = t.join(reached, [key, "ts_ms"], "left_semi")
    drop(*tables[:-1])
    return out


def windows_asof(t: DataFrame, now_ms: int, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Counts and sums of each user's windows as of ``now_ms``: one conditional aggregation."""
    aggs = []
    for name, size, _ in cfg.windows:
        b = size // 60
        bucket = F.col("ts_ms") - F.pmod("ts_ms", F.lit(b))
        live = (bucket > now_ms - size) & (bucket <= now_ms)
        aggs += [F.count(F.when(live, 1)).alias(f"cnt{name}"), F.coalesce(F.sum(F.when(live, F.col("amount"))), F.lit(0.0)).alias(f"sum{name}")]
    return t.where(F.col("ts_ms") <= now_ms).groupBy("user_id").agg(*aggs)


def profile_snapshot(t: DataFrame) -> DataFrame:
    return t.groupBy("user_id").agg(
        F.count("amount").alias("n"), java_round(F.avg("amount"), 2).alias("mean"), F.coalesce(java_round(F.stddev_samp("amount"), 2), F.lit(0.0)).alias("std")
    )


def recent_decisions(decisions: DataFrame, now_ms: int, hours: int, cap: int = DEFAULT.history_cap) -> DataFrame:
    """The newest ``cap`` of each user first, then those strictly newer than the cutoff; null times stay."""
    newest = _user().orderBy(F.col("ts_ms").desc_nulls_first(), F.col("seq").desc())
    ranked = decisions.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= cap)
    return ranked.where(F.col("ts_ms").isNull() | (F.col("ts_ms") > now_ms - hours * 3_600_000))


def user_history(t: DataFrame, decisions: DataFrame, now_ms: int, hours: int) -> DataFrame:
    """Profile, windows and recent decisions of every account as one row."""
    hours = min(168, max(1, hours))
    recent = recent_decisions(decisions, now_ms, hours).groupBy("user_id").agg(F.count("*").alias("recent"), F.max("ts_ms").alias("last_ms"))
    return profile_snapshot(t).join(windows_asof(t, now_ms), "user_id", "left").join(recent, "user_id", "left").fillna(0, ["recent"])


def history_view(decisions: DataFrame, most: int = 5) -> DataFrame:
    """Per account: number of decisions and the newest five as structs."""
    newest = _user().orderBy(F.desc("seq"))
    top = decisions.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= most)
    latest = F.array_sort(F.collect_list(F.struct("_r", "verdict", F.round("ml_score", 4).alias("score"))))
    return decisions.groupBy("user_id").agg(F.count("*").alias("in_period")).join(top.groupBy("user_id").agg(latest.alias("latest")), "user_id")
