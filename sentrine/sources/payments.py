"""Reading and writing payments, labels and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrine.config import CATEGORIES, CITIES

TXN_SCHEMA = (
    "txn_id string, user_id string, merchant_id string, counterparty_id string, amount double, currency string, "
    "lat double, lon double, device_id string, channel string, ts timestamp"
)
T0_MS = 1_704_067_200_000  # 2024-01-01


def _pick(values, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def txns(spark: SparkSession, sf_dir: str, speedup: int = 1) -> DataFrame:
    """Payments derived from ``events`` in plain arithmetic; ``speedup`` compresses the month they span."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = e.agg((F.max("user_id") + 1).alias("u"))
    k = F.get_json_object("props", "$.k").cast("long")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = e.crossJoin(F.broadcast(users)).withColumn("k", k)  # one row: the number of users
    buy = F.col("event_type") == "purchase"
    city = F.when(F.col("k") >= 95, F.pmod(F.col("user_id") + 3, F.lit(8))).otherwise(F.pmod("user_id", F.lit(8)))
    ts_ms = F.floor((us - T0_MS * 1000) / (speedup * 1000)).cast("long") + T0_MS
    return e.select(
        F.col("event_id").cast("string").alias("txn_id"), "event_id", "k", F.concat(F.lit("u_"), "user_id").alias("user_id"),
        F.when(buy, "m_P2P_0000").otherwise(F.concat(F.lit("m_"), _pick(CATEGORIES, F.pmod(F.col("k") + 5, F.lit(10))), F.lit("_"), F.lpad(F.col("k").cast("string"), 4, "0"))).alias("merchant_id"),
        F.when(buy, F.concat(F.lit("u_"), (F.col("user_id") * 7 + F.col("k")) % F.col("u"))).alias("counterparty_id"),
        (F.col("value") * 500).alias("amount"), F.lit("INR").alias("currency"),
        _pick([c[1] for c in CITIES], city).alias("lat"), _pick([c[2] for c in CITIES], city).alias("lon"),
        F.concat(F.lit("d_"), "user_id").alias("device_id"),
        F.when(buy, "P2P").when(F.col("event_type").isin("click", "view"), "CARD").otherwise("UPI").alias("channel"),
        ts_ms.alias("ts_ms"), F.timestamp_millis(ts_ms).alias("ts"), order_key(ts_ms, F.col("event_id").cast("string")).alias("seq"),
        (((F.col("event_id") * 7919) % 1000) / 1000.0).alias("score"),
    )


def order_key(ts_ms: Column, txn_id: Column) -> Column:
    """Event order (time, then id) as one comparable string; it orders rows without numbering them."""
    return F.concat(F.lpad(ts_ms.cast("string"), 15, "0"), F.lit("|"), txn_id)


def labels(t: DataFrame) -> DataFrame:
    """Fraud labels of the derived payments: pattern, episode, hop and hops."""
    pattern = F.when(F.col("channel") == "P2P", "RING").when(F.col("k") >= 90, "GEO").otherwise("VELOCITY")
    ep = Window.partitionBy("episode")
    base = t.where("k % 10 = 0").select("txn_id", "user_id", "ts_ms", "seq", pattern.alias("pattern"), F.floor(F.col("event_id") / 40).alias("episode"))
    return base.withColumns({"hop": (F.row_number().over(ep.orderBy("seq")) - 1).cast("int"), "hops": F.count("*").over(ep).cast("int")})


def read_transactions(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON rows to typed payments; unknown fields are ignored, undecodable rows keep their text in ``corrupt``."""
    camel = "txnId string, userId string, merchantId string, counterpartyId string, amount double, currency string, lat double, lon double, deviceId string, channel string, ts timestamp"
    doc = F.from_json(F.col(column).cast("string"), camel + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    names = {"txnId": "txn_id", "userId": "user_id", "merchantId": "merchant_id", "counterpartyId": "counterparty_id", "deviceId": "device_id"}
    return raw.withColumn("_d", doc).select(
        *[F.col(f"_d.{f.split()[0]}").alias(names.get(f.split()[0], f.split()[0])) for f in camel.split(", ")],
        F.when(F.col("_d").isNull(), F.col(column)).otherwise(F.col("_d._corrupt")).alias("corrupt"), *[c for c in raw.columns if c != column],
    )


def assign_event_time(df: DataFrame, record_time: str, late: str = "1 hour") -> DataFrame:
    """Event time is the payment's own, else the record's."""
    out = df.withColumn("ts", F.coalesce("ts", F.col(record_time)))
    return out.withWatermark("ts", late) if df.isStreaming else out


def dlq_split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows as ``stage, error, payload``)."""
    bad = parsed.where("corrupt is not null").select(F.lit("deserialize").alias("stage"), F.lit("undecodable JSON").alias("error"), F.col("corrupt").alias("payload"))
    return parsed.where("corrupt is null").drop("corrupt"), bad


def drop_missing_id(df: DataFrame) -> DataFrame:
    return df.where(F.col("txn_id").isNotNull())


def bounded_read(df: DataFrame, since_ms: int, until_ms: int) -> DataFrame:
    """Rows of [since, until); the comparison reaches the scan."""
    return df.where((F.col("ts_ms") >= since_ms) & (F.col("ts_ms") < until_ms))


def read_labels(labels_: DataFrame, since_ms: int) -> DataFrame:
    """Labels from one hour before the window, so none at its edge is missed."""
    return labels_.where(F.col("ts_ms") >= since_ms - 3_600_000)


def write_decisions(decisions: DataFrame, path: str) -> None:
    """The decision log by day, readable with partition pruning."""
    decisions.withColumn("day", F.to_date(F.timestamp_millis("ts_ms"))).write.mode("append").partitionBy("day").parquet(path)


def save_training_frame(frame: DataFrame, path: str, version: int) -> None:
    frame.withColumn("model_version", F.lit(version)).write.mode("errorifexists").parquet(path)


def intake_decisions(raw: DataFrame, column: str = "value") -> DataFrame:
    """Decision documents with a ``reason`` if they cannot become cases: unparseable, incomplete or bad_txn_id."""
    schema = "txnId string, userId string, verdict string, mlScore double, firedRules array<string>, _corrupt string"
    d = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    uuid = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    reason = (
        F.when(F.col("d").isNull() | F.col("d._corrupt").isNotNull(), "unparseable")
        .when(F.col("d.txnId").isNull() | F.col("d.userId").isNull() | F.col("d.verdict").isNull(), "incomplete")
        .when(~F.col("d.txnId").rlike(uuid), "bad_txn_id")
    )
    return raw.withColumn("d", d).select(*[c for c in raw.columns if c != column], "d.txnId", "d.userId", "d.verdict", "d.mlScore", "d.firedRules", reason.alias("reason"))


def session_extract(decisions: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Decisions of a session, the first of each payment, with their offset from its start."""
    first = Window.partitionBy("txn_id").orderBy("seq")
    rows = bounded_read(decisions, start_ms, end_ms).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return rows.withColumns({"at_ms": F.col("ts_ms") - start_ms, "ml_score": F.round("ml_score", 4)}).orderBy("at_ms", "txn_id")
