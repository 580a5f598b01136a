"""State of each account on a stream of payments: what it spent, where it was, and its live transfers on both sides."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sentrine.config import DEFAULT, EARTH_KM, EngineConfig

OUTPUT = (
    "user_id string, txn_id string, seq string, ts_ms long, cnt1m long, cnt5m long, cnt1h long, sum1m double, sum5m double, sum1h double, amt_z double, secs_since double, gap_s long, "
    "distance_km double, speed_kmh double, out_degree int, in_from string, in_amount double, pt_ratio double, pt_secs long, parent string, given string"
)
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
_GAPS = ("distance_km", "speed_kmh", "in_amount", "pt_ratio")  # numbers that may be missing, which pandas marks as NaN


def _km(lat: float, lon: float, lat2: float, lon2: float) -> float:
    a, b, c, d = map(math.radians, (lat, lon, lat2, lon2))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(h)))


def _half_up(x: float, digits: int) -> float:
    return math.floor(x * 10**digits + 0.5) / 10**digits


class AccountState(StatefulProcessor):
    """One account: velocity buckets, spending profile, last place, and the newest transfers it sent and received.

    Rows are taken in event order within each batch. A row that comes late, behind ones of an earlier batch, counts in
    its own buckets and in the profile and is put among the transfers by its time; it does not move the last place back,
    and transfers that arrived after it are not seen from it. Buckets and transfers that no later row can reach are
    dropped as rows come in, and by an event-time timer once the account has been silent for long.
    """

    def __init__(self, cfg: EngineConfig = DEFAULT, grace_ms: int = 30_000):
        self.cfg, self.grace = cfg, grace_ms
        self.silence = max(cfg.edge_ttl_ms, cfg.pass_window_ms, *(size for _, size, _ in cfg.windows)) + grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "size long, start long", "n long, total double")
        self.profile = handle.getValueState("profile", "n long, mean double, m2 double, last_ms long, lat double, lon double")
        self.sent = handle.getListState("sent", "seq string, ts_ms long")
        self.received = handle.getListState("received", "seq string, src string, amount double, ts_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cfg, pdf = self.cfg, pd.concat(list(rows)).sort_values("seq")
        profile = tuple(self.profile.get()) if self.profile.exists() else (0, 0.0, 0.0, -1, None, None)
        buckets = {tuple(k): tuple(v) for k, v in self.buckets.iterator()} if self.buckets.exists() else {}
        before, changed, out = set(buckets), set(), []
        sent = [tuple(x) for x in self.sent.get()] if self.sent.exists() else []
        received = [tuple(x) for x in self.received.get()] if self.received.exists() else []
        newest = 0
        for arrives, txn, seq, other, amount, lat, lon, ms, given in zip(*(pdf[c] for c in ("arrives", "txn_id", "seq", "other", "amount", "lat", "lon", "ts_ms", "given")), strict=True):
            ms, amount = int(ms), float(amount)
            newest = max(newest, ms)
            if arrives:
                bisect.insort(received, (seq, other, amount, ms))
                continue
            counts = self._count(buckets, changed, ms, amount)
            z, since, gap, km, speed, profile = self._compare(profile, ms, amount, float(lat), float(lon))
            if other is not None:
                bisect.insort(sent, (seq, ms))
            live = sum(1 for s, at in sent[-cfg.max_edges :] if s <= seq and at >= ms - cfg.edge_ttl_ms)
            out.append((key[0], txn, seq, ms, *(n for n, _ in counts), *(total for _, total in counts), z, since, gap, km, speed, live, *(self._inbound(received, seq, ms, amount) if other is not None else (None,) * 5), given))
        if profile[0]:
            self.profile.update(profile)
        dead = {k for k in buckets if k[1] <= profile[3] - k[0] - self.grace}  # retention
        for k in changed - dead:
            self.buckets.updateValue(k, buckets[k])
        for k in dead & before:
            self.buckets.removeKey(k)
        self._put(self.sent, sent, newest - cfg.edge_ttl_ms)
        self._put(self.received, received, newest - cfg.edge_ttl_ms)
        timers = list(self.handle.listTimers())
        due = max([newest + self.silence, *timers])
        if due not in timers:
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)
        if out:
            yield pd.DataFrame(out, columns=_NAMES).astype({"pt_secs": "Int64", "gap_s": "Int64", **dict.fromkeys(_GAPS, "float64")})

    def _put(self, state, kept: list[tuple], since_ms: int) -> None:
        live = [x for x in kept if x[-1] >= since_ms][-self.cfg.max_edges :]
        if live:
            state.put(live)
        elif state.exists():
            state.clear()

    def _count(self, buckets: dict, changed: set, ms: int, amount: float) -> list[tuple[int, float]]:
        """Number and sum of payments in each window that ends with the bucket of this one, which is entered first."""
        out = []
        for _, size, _ in self.cfg.windows:
            b = size // 60
            at = ms - ms % b
            n, total = buckets.get((size, at), (0, 0.0))
            buckets[size, at] = n + 1, total + amount
            changed.add((size, at))
            near = [buckets[size, x] for x in range(at - (size - b), at + b, b) if (size, x) in buckets]
            out.append((sum(n for n, _ in near), sum(total for _, total in near)))
        return out

    def _compare(self, profile: tuple, ms: int, amount: float, lat: float, lon: float) -> tuple:
        """What the payment is against the profile before it, and the profile with it."""
        n, mean, m2, last, lat0, lon0 = profile
        std = (m2 / (n - 1)) ** 0.5 if n > 1 else 0.0
        z = _half_up((amount - mean) / std, 2) if n >= self.cfg.min_samples and std >= self.cfg.min_std else 0.0
        since, gap, km, speed = -1.0, None, None, None
        if lat0 is not None:
            since, gap, km = max(0.0, (ms - last) / 1000), (ms - last) // 1000, _km(lat0, lon0, lat, lon)
            speed = km / (gap / 3600) if gap >= 1 else None
        d = amount - mean
        mean += d / (n + 1)
        place = (ms, lat, lon) if ms >= last else (last, lat0, lon0)
        return z, since, gap, km, speed, (n + 1, mean, m2 + d * (amount - mean), *place)

    def _inbound(self, received: list[tuple], seq: str, ms: int, amount: float) -> tuple:
        """The newest transfer received lately that this one passes on, else the newest one."""
        cfg, best = self.cfg, None
        for s, src, money, at in received[: bisect.bisect_left(received, (seq,))][-cfg.max_edges :]:
            if money > 0 and ms - cfg.pass_window_ms <= at <= ms:
                fits = cfg.pass_low <= amount / money <= cfg.pass_high
                best = max(best or (False, ""), (fits, s, src, money, at))
        if best is None:
            return (None,) * 5
        fits, s, src, money, at = best
        return src, money, _half_up(amount / money, 3), (ms - at) // 1000, s if fits else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.buckets, self.sent, self.received):
            if state.exists():
                state.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_accounts(t: DataFrame, cfg: EngineConfig = DEFAULT, late: str | None = "1 hour", keep: tuple[str, ...] = ()) -> DataFrame:
    """Features of each payment as it arrives that depend on its account alone (needs the RocksDB state store).

    Every transfer goes to both of its accounts: to the payer's as a payment, to the other's as money that arrived.
    ``t`` has event time ``ts``; rows later than the watermark ``late`` are dropped and counted, see ``dropped_rows``.
    Columns named in ``keep`` are passed through. Without ``late`` the watermark is the one that ``t`` has.
    """
    real = F.col("counterparty_id").isNotNull() & (F.col("counterparty_id") != F.col("user_id"))
    given = F.to_json(F.struct(*keep)) if keep else F.lit(None).cast("string")
    rest = [given.alias("given"), "txn_id", "seq", "amount", "lat", "lon", "ts_ms", "ts"]
    t = t.withWatermark("ts", late) if late else t
    ends = F.array(
        F.struct(F.col("user_id").alias("account"), F.lit(False).alias("arrives"), F.when(real, F.col("counterparty_id")).alias("other")),
        F.when(real, F.struct(F.col("counterparty_id").alias("account"), F.lit(True).alias("arrives"), F.col("user_id").alias("other"))),
    )
    both = t.withColumn("end", F.explode(F.array_compact(ends))).select("end.*", *rest)
    schema = t.select(*keep).schema
    out = both.groupBy("account").transformWithStateInPandas(AccountState(cfg), OUTPUT, "append", "EventTime")
    out = out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in _GAPS})
    return (out.withColumn("given", F.from_json("given", schema)).select("*", "given.*") if keep else out).drop("given")


def dropped_rows(query) -> int:
    """Rows that came behind the watermark and were left out, over the batches whose progress ``query`` still has."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
