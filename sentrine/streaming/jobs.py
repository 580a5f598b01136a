"""The same engine on streams: state keyed by id and by user, everything shared through foreachBatch and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrine.config import DEFAULT, EngineConfig
from sentrine.functions.exprs import merchant_category, merchant_risk_tier
from sentrine.operators import cases as C
from sentrine.operators import decisions as D
from sentrine.operators import transfers as G
from sentrine.operators.components import connected_components
from sentrine.operators.metrics import feed_pulse
from sentrine.storage import drop, exists, materialize
from sentrine.streaming.accounts import stream_accounts


def stream_dedup(t: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """First row of each id within the TTL of event time; state ends with the watermark."""
    return t.where("txn_id is not null").withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["txn_id"])


def stream_user_state(t: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Velocity, spending and travel of each payment as it arrives; the last two are null for a user's first payment."""
    return stream_accounts(t, cfg).select("user_id", "txn_id", "cnt1m", "cnt5m", "cnt1h", "sum1h", "amt_z", "secs_since", "distance_km", "speed_kmh")


def stream_pulse(decisions: DataFrame) -> DataFrame:
    return feed_pulse(decisions.withWatermark("ts", "30 seconds"))


class StreamDecider:
    """A foreachBatch function that makes decisions of the rows of ``stream_accounts`` joined with their payments.

    What one account cannot know is found from tables beside the stream, and for new payments alone: rings among the
    live transfers, chains from the depths of the transfers passed on, and components from labels that change only where
    two components meet. A batch writes folders of its own number and reads those of earlier numbers, so a batch that is
    run again replaces what it wrote. ``compact`` batches of labels are put together from time to time.
    """

    def __init__(self, spark: SparkSession, path: str, scorer=None, cfg: EngineConfig = DEFAULT, compact: int = 64):
        self.spark, self.path, self.scorer, self.cfg, self.compact = spark, path, scorer, cfg, compact

    def _before(self, name: str, number: int, since_ms: int | None = None) -> DataFrame | None:
        if not exists(self.spark, f"{self.path}/{name}"):
            return None
        rows = self.spark.read.parquet(f"{self.path}/{name}").where(F.col("batch") < number)
        return rows if since_ms is None else rows.where(F.col("ts_ms") >= since_ms)

    def _write(self, rows: DataFrame, name: str, number: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}/batch={number}")

    def __call__(self, batch: DataFrame, number: int) -> None:
        cfg = self.cfg
        new = self._write(batch, "features", number)
        since = new.agg(F.min("ts_ms")).first()[0]
        if since is None:
            return
        edges = G.build_edges(new)
        old = self._before("edges", number, since - cfg.edge_ttl_ms)
        self._write(edges, "edges", number)
        live = edges if old is None else edges.unionByName(old.select(edges.columns))
        rings = G.ring_cycles(live, cfg, edges)
        known = self._before("depths", number, since - cfg.pass_window_ms)
        depth = self._write(G.chain_depth(new.where("in_from is not null"), cfg.chain_cap, known).join(new.select("seq", "ts_ms"), "seq"), "depths", number)
        out = new.join(depth.select("seq", "depth"), "seq", "left").join(rings, "seq", "left").join(self.sizes(new, number), "seq", "left")
        out = D.finish_features(merchant_risk_tier(out.withColumn("category", merchant_category(F.col("merchant_id")))), cfg)
        self._write(D.assemble_decision(out, self.scorer, cfg).drop("features"), "decisions", number)

    def sizes(self, new: DataFrame, number: int) -> DataFrame:
        """Component sizes as of each payment; writes the labels of accounts, and the sizes, that this batch changes."""
        rows = new.select("seq", "ts_ms", F.col("user_id").alias("src"), F.coalesce("counterparty_id", "user_id").alias("dst"))
        latest = lambda t, key, value: None if t is None else t.groupBy(key).agg(F.max_by(value, "batch").alias(value))
        labels, counts = latest(self._before("labels", number), "node", "label"), latest(self._before("sizes", number), "label", "size")
        ends = rows.select(F.col("src").alias("node")).union(rows.select("dst")).distinct()
        if labels is None:
            ends = ends.select("node", F.lit(None).cast("string").alias("label"), F.lit(1).cast("long").alias("size"))
        else:
            ends = ends.join(labels, "node", "left").join(counts, "label", "left").select("node", "label", F.coalesce("size", F.lit(1).cast("long")).alias("size"))
        ends = materialize(ends.withColumn("at", F.coalesce("label", "node")))
        side = lambda node, at, size: ends.select(F.col("node").alias(node), F.col("at").alias(at), F.col("size").alias(size))
        linked = materialize(rows.join(side("src", "a", "size_a"), "src").join(side("dst", "b", "size_b"), "dst").select("seq", "ts_ms", F.col("a").alias("src"), F.col("b").alias("dst"), "size_a", "size_b"))
        groups = connected_components(linked.select("src", "dst").distinct())
        groups = groups.join(ends.select(F.col("at").alias("node"), "size").distinct(), "node")
        # the largest keeps its label, so an account changes its own only as often as its component doubles
        into = groups.groupBy("component").agg(F.max_by("node", F.struct("size", "node")).alias("to"), F.sum("size").alias("total"))
        moved = materialize(groups.join(into, "component").select(F.col("node").alias("label"), "to", "total"))
        fresh = ends.where("label is null").select("node", F.col("at").alias("label"))
        have = fresh if labels is None else labels.join(moved.where("label != to").select("label"), "label", "left_semi").select("node", "label").unionByName(fresh)
        self._write(have.join(moved, "label").select("node", F.col("to").alias("label")), "labels", number)
        self._write(moved.select(F.col("to").alias("label"), F.col("total").alias("size")).distinct(), "sizes", number)
        if number and number % self.compact == 0:
            self._compact(number)
        return G.component_size_asof(linked)

    def _compact(self, number: int) -> None:
        """Puts the labels and sizes of earlier batches into the folder of the last of them, which then has all."""
        for name, key, value in (("labels", "node", "label"), ("sizes", "label", "size")):
            old = self._before(name, number)
            whole = materialize(old.groupBy(key).agg(F.max_by(value, "batch").alias(value)))
            self._write(whole, name, number - 1)
            drop(whole)


def decide_stream(t: DataFrame, cfg: EngineConfig = DEFAULT, late: str = "1 hour") -> DataFrame:
    """Payments of a stream with the features of their accounts, once each: what ``StreamDecider`` takes. ``t`` has event time ``ts``."""
    once = t.where("txn_id is not null").withWatermark("ts", late).dropDuplicatesWithinWatermark(["txn_id"])
    return stream_accounts(once, cfg, None, keep=("merchant_id", "counterparty_id", "channel", "amount"))


def open_cases_batch(spark: SparkSession, path: str):
    """A foreachBatch function that opens cases for flagged decisions without one."""

    def run(batch: DataFrame, number: int) -> None:
        have = spark.read.parquet(path).where(F.col("batch") < number) if exists(spark, path) else batch.limit(0)
        C.open_cases(batch, have)[0].write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run
