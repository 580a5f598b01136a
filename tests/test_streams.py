"""Streams in several batches over days, with late, repeated and silent accounts, against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from sentrine.operators import decisions as D
from sentrine.operators import users as U
from sentrine.sources.payments import T0_MS
from sentrine.streaming.accounts import dropped_rows, stream_accounts
from sentrine.streaming.jobs import StreamDecider, decide_stream
from tests.test_fraud import txns

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset(PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def feed(t, cuts, path):
    """One file, and so one batch, for each stretch between ``cuts`` (seconds); ``t`` may name the batch of a row itself."""
    n = F.col("batch") if "batch" in t.columns else sum((F.when(F.col("ts_ms") - T0_MS >= c * 1000, 1).otherwise(0) for c in cuts), F.lit(0))
    for i in range(len(cuts) + 1):
        t.where(n == i).drop("batch").coalesce(1).write.mode("append").parquet(path)
    return t.sparkSession.readStream.schema(t.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(writer, tmp_path):
    q = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(400) and q.exception() is None
    return q


def collected(df, tmp_path):
    q = run(df.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append"), tmp_path)
    return q, df.sparkSession.read.parquet(str(tmp_path / "out")).collect()


def payments(spark, rows):
    return txns(spark, rows).withColumn("ts", F.timestamp_millis("ts_ms"))


def test_user_state_equals_batch_over_several_batches(rocks, tmp_path):
    rng = random.Random(2)
    rows = [{"user": rng.choice(["u_a", "u_b"]), "at": 7 * i + rng.random(), "amount": rng.randrange(10, 900), "lat": 17 + rng.random() * 9, "lon": 77 + rng.random()} for i in range(60)]
    t = payments(rocks, rows).cache()
    _, got = collected(stream_accounts(feed(t, (140, 280), str(tmp_path / "in"))), tmp_path)
    names = ("cnt1m", "cnt5m", "cnt1h", "sum1m", "sum1h", "amt_z", "secs_since", "gap_s", "distance_km", "speed_kmh")
    near = lambda r: tuple(None if r[n] is None else round(r[n], 4) for n in names)
    want = {r.txn_id: near(r) for r in U.geo_features(U.amount_zscore(U.velocity_features(t))).collect()}
    assert {r.txn_id: near(r) for r in got} == want


def test_late_payments(rocks, tmp_path):
    """A late one counts in its bucket and does not move the place; one behind the watermark is dropped and counted."""
    mumbai, delhi = {"lat": 19.076, "lon": 72.8777}, {"lat": 28.6139, "lon": 77.209}
    rows = [{"at": 0}, {"at": 600, **mumbai}, {"at": 590, **delhi}, {"at": 610, **mumbai}, {"at": 90_000}, {"at": 100}, {"at": 90_010}]
    t = payments(rocks, rows).withColumn("batch", F.element_at(F.array(*map(F.lit, (0, 0, 1, 2, 3, 5, 4))), F.expr("int(substr(txn_id, 2)) + 1")))
    q, got = collected(stream_accounts(feed(t, range(5), str(tmp_path / "in"))), tmp_path)
    r = {x.txn_id: x for x in got}
    assert set(r) == {"t0000", "t0001", "t0002", "t0003", "t0004", "t0006"} and dropped_rows(q) == 1
    assert r["t0002"].secs_since == 0 and r["t0003"].cnt1m == 3  # 590, 600 and 610 share a minute
    assert r["t0003"].secs_since == 10 and r["t0003"].distance_km < 1  # from Mumbai at 600, not from Delhi at 590


def test_late_transfers_are_put_in_by_time(rocks, tmp_path):
    rows = [
        {"user": "x", "to": "a", "amount": 100, "at": 100}, {"user": "a", "to": "b", "amount": 95, "at": 200}, {"user": "y", "to": "a", "amount": 100, "at": 300},
        {"user": "a", "to": "c", "amount": 99, "at": 250}, {"user": "z", "to": "a", "amount": 98, "at": 220}, {"user": "a", "to": "c", "amount": 97, "at": 260},
    ]
    t = payments(rocks, rows).withColumn("batch", F.element_at(F.array(*map(F.lit, (0, 0, 0, 1, 2, 3))), F.expr("int(substr(txn_id, 2)) + 1")))
    _, got = collected(stream_accounts(feed(t, range(3), str(tmp_path / "in"))), tmp_path)
    r = {x.txn_id: x for x in got}
    assert [(r[k].in_from, r[k].out_degree) for k in ("t0001", "t0003", "t0005")] == [("x", 1), ("x", 2), ("z", 3)]  # y paid after them


def test_state_stays_flat(rocks, tmp_path):
    """Three hours of steady payments: buckets and transfers that no later row can reach leave the state."""
    cfg = type(D.DEFAULT)(windows=(("1m", 60_000, 8), ("5m", 300_000, 20), ("1h", 600_000, 60)), edge_ttl_ms=600_000, pass_window_ms=300_000)
    rows = [{"user": f"u{i % 5}", "to": f"u{(i + 1) % 5}" if i % 3 else None, "at": 20 * i} for i in range(540)]
    df = stream_accounts(feed(payments(rocks, rows), range(1800, 10_800, 1800), str(tmp_path / "in")), cfg, "1 minute")
    q, got = collected(df, tmp_path)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["numInputRows"]]
    assert len(got) == 540 and len(kept) == 6 and max(kept[2:]) <= min(kept[1:3]) * 1.1


def test_decisions_of_three_days_equal_batch(rocks, tmp_path):
    rng = random.Random(12)
    who, rows = [f"u_{i}" for i in range(14)], []
    for i in range(150):
        at, a = 1700 * i + rng.randrange(900), rng.choice(who)
        b = rng.choice([None, None, *who])
        rows.append({"user": a, "to": b, "amount": rng.choice([100, 120, 90_000, 250_000]), "at": at, "channel": "P2P" if b else "CARD", "lat": rng.choice([17.385, 28.6139]), "lon": rng.choice([78.4867, 77.209])})
        if b and rng.random() < 0.5:  # money that goes on, some of it in a circle
            c = rng.choice([a, *who])
            rows.append({"user": b, "to": c, "amount": rows[-1]["amount"] * 0.97, "at": at + 300, "channel": "P2P"})
            rows.append({"user": c, "to": a, "amount": rows[-1]["amount"] * 0.97, "at": at + 700, "channel": "P2P"})
    t = payments(rocks, sorted(rows, key=lambda r: r["at"])).cache()
    again = t.where("txn_id like '%7'")  # repeated in the same batch
    df = decide_stream(feed(t.union(again), (40_000, 90_000, 130_000, 200_000), str(tmp_path / "in")))
    decider = StreamDecider(rocks, str(tmp_path / "state"), compact=2)
    twice = lambda batch, n: [decider(batch, n) for _ in range(2 if n == 3 else 1)]  # noqa: E731  as after a failure
    run(df.writeStream.foreachBatch(twice), tmp_path)
    names = ("verdict", "mode", "fired_rules", "cnt1m", "cnt1h", "sum1h", "amt_z", "geo_speed", "secs_since", "tier", "out_degree", "in_cycle", "cycle", "component_size", "pt_ratio", "pt_secs", "chain_depth")
    near = lambda r: {n: round(r[n], 4) if isinstance(r[n], float) else r[n] for n in names}
    want = {r.txn_id: near(r) for r in D.decide(t).collect()}
    rows = rocks.read.parquet(str(tmp_path / "state/decisions")).collect()
    assert len(rows) == len(want) and {r.txn_id: near(r) for r in rows} == want
    assert sum(r["in_cycle"] for r in want.values()) > 5 and max(r["chain_depth"] for r in want.values()) > 1
