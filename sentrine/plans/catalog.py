"""All queries of the library and their SQL. Payments are derived from ``events`` (see sources.payments)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrine.config import CATEGORIES, CITIES, DEFAULT, HARD_RULES, SANCTIONED, TIERS
from sentrine.functions import exprs as X
from sentrine.operators import cases as C
from sentrine.operators import decisions as D
from sentrine.operators import metrics as M
from sentrine.operators import models as ML
from sentrine.operators import transfers as G
from sentrine.operators import users as U
from sentrine.sources import payments as P
from sentrine.storage import materialize, shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DAY = P.T0_MS + 86_400_000  # a moment inside the sped-up month
NOW = P.T0_MS + 3_600_000


def query(sql: str | None = None, speedup: int = 720):
    """Registers ``f(t, ctx)`` where t are the payments; SQL may use the tables t, d (decisions) and l (labels)."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(P.txns(spark, sf_dir, speedup), spark, sf_dir)
        if sql:
            ORACLES[f.__name__] = base_sql(speedup) + sql
        return f

    return add


def dec(t: DataFrame) -> DataFrame:
    """Decisions by plain arithmetic, for operators on the decision log."""
    k, p2p = F.col("k"), F.col("channel") == "P2P"
    out = t.withColumn("rule", D.hard_rules()).withColumn("ml_score", F.when(k % 3 != 0, F.col("score")))
    fired = F.array_compact(F.array(
        F.when(k % 7 == 0, "VELOCITY_1M"), F.when(k >= 95, "GEO_IMPOSSIBLE"), F.when(p2p & (k % 11 == 0), "RING_SUSPECT"), F.when(p2p & (k % 5 == 0), "PASS_THROUGH"), F.col("rule"),
    ))
    verdict = F.when(F.col("rule").isNotNull() | (F.col("score") >= 0.99), "BLOCK").when(F.col("score") >= 0.6, "REVIEW").otherwise("ALLOW")
    return out.withColumns({"fired_rules": fired, "verdict": verdict, "mode": F.when(k % 10 == 1, "DEGRADED").otherwise("FULL"), "latency_ms": (F.col("event_id") * 37) % 500})


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def base_sql(speedup: int) -> str:
    return f"""WITH RECURSIVE e0 AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type = 'purchase' AS buy,
  (epoch_us(ts) - {P.T0_MS * 1000}) // ({speedup} * 1000) + {P.T0_MS} AS ts_ms, (SELECT max(user_id) + 1 FROM events) AS u FROM events),
e1 AS (SELECT *, CASE WHEN k >= 95 THEN (user_id + 3) % 8 ELSE user_id % 8 END AS city FROM e0),
t AS (SELECT CAST(event_id AS VARCHAR) AS txn_id, event_id, k, 'u_' || user_id AS user_id,
  CASE WHEN buy THEN 'm_P2P_0000' ELSE 'm_' || {_list(CATEGORIES)}[(k + 5) % 10 + 1] || '_' || lpad(CAST(k AS VARCHAR), 4, '0') END AS merchant_id,
  CASE WHEN buy THEN 'u_' || ((user_id * 7 + k) % u) END AS counterparty_id, value * 500 AS amount,
  CAST({_list(c[1] for c in CITIES)}[city + 1] AS DOUBLE) AS lat, CAST({_list(c[2] for c in CITIES)}[city + 1] AS DOUBLE) AS lon,
  CASE WHEN buy THEN 'P2P' WHEN event_type IN ('click', 'view') THEN 'CARD' ELSE 'UPI' END AS channel, ts_ms,
  lpad(CAST(ts_ms AS VARCHAR), 15, '0') || '|' || event_id AS seq, CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000.0 AS score FROM e1),
d0 AS (SELECT *, CASE WHEN merchant_id IN ('{SANCTIONED[0]}', '{SANCTIONED[1]}') THEN 'HARD_BLOCK_MERCHANT' WHEN amount > 200000 THEN 'AMOUNT_CAP' END AS rule,
  CASE WHEN k % 3 <> 0 THEN score END AS ml_score FROM t),
d AS (SELECT *, list_filter([CASE WHEN k % 7 = 0 THEN 'VELOCITY_1M' END, CASE WHEN k >= 95 THEN 'GEO_IMPOSSIBLE' END,
    CASE WHEN channel = 'P2P' AND k % 11 = 0 THEN 'RING_SUSPECT' END, CASE WHEN channel = 'P2P' AND k % 5 = 0 THEN 'PASS_THROUGH' END, rule], lambda x: x IS NOT NULL) AS fired_rules,
  CASE WHEN rule IS NOT NULL OR score >= 0.99 THEN 'BLOCK' WHEN score >= 0.6 THEN 'REVIEW' ELSE 'ALLOW' END AS verdict,
  CASE WHEN k % 10 = 1 THEN 'DEGRADED' ELSE 'FULL' END AS mode, (event_id * 37) % 500 AS latency_ms FROM d0),
l0 AS (SELECT txn_id, user_id, ts_ms, seq, CASE WHEN channel = 'P2P' THEN 'RING' WHEN k >= 90 THEN 'GEO' ELSE 'VELOCITY' END AS pattern, event_id // 40 AS episode FROM t WHERE k % 10 = 0),
l AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY seq) - 1 AS hop, count(*) OVER (PARTITION BY episode) AS hops FROM l0),
g AS (SELECT seq, txn_id, user_id AS src, counterparty_id AS dst, amount, ts_ms FROM t WHERE counterparty_id <> user_id)
"""


def _km(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


def _jr(x: str, d: int) -> str:
    return f"floor({x} * {10**d}.0 + 0.5) / {10**d}.0"


# ------------------------------------------------------------------ scalar

_CAT = "CASE WHEN len(string_split(rtrim(merchant_id, '_'), '_')) >= 3 THEN string_split(rtrim(merchant_id, '_'), '_')[2] ELSE 'UNKNOWN' END"


@query(f", c AS (SELECT {_CAT} AS category FROM t) SELECT category, count(*) AS n FROM c GROUP BY category")
def merchant_category(t, *_):
    return t.groupBy(X.merchant_category(F.col("merchant_id")).alias("category")).agg(F.count("*").alias("n"))


@query(f", c AS (SELECT txn_id, {_CAT} AS category FROM t) SELECT txn_id, category, CAST(CASE category {' '.join(f"WHEN '{k}' THEN {v}" for k, v in TIERS.items())} ELSE 0 END AS INTEGER) AS tier FROM c")
def merchant_risk_tier(t, *_):
    return X.merchant_risk_tier(t.select("txn_id", X.merchant_category(F.col("merchant_id")).alias("category"))).select("txn_id", "category", "tier")


@query(f" SELECT txn_id, round({_km('lat', 'lon', '28.6139', '77.2090')}, 6) AS km FROM t")
def haversine_km(t, *_):
    return t.select("txn_id", F.round(X.haversine_km(F.col("lat"), F.col("lon"), F.lit(28.6139), F.lit(77.2090)), 6).alias("km"))


@query(f" SELECT txn_id, {_jr('(amount - 1000)', 2)} AS r FROM t")
def java_round(t, *_):
    return t.select("txn_id", X.java_round(F.col("amount") - 1000, 2).alias("r"))


_HASH = """, h0 AS (SELECT txn_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(txn_id, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: (a * 31 + b) & 4294967295) AS h FROM t),
h1 AS (SELECT txn_id, xor(h, h >> 16) AS h FROM h0), h2 AS (SELECT txn_id, (h * 51819 + (((h * 34283) & 65535) << 16)) & 4294967295 AS h FROM h1)
"""


@query(_HASH + " SELECT txn_id FROM h2 WHERE CAST(xor(h, h >> 13) & 2147483647 AS DOUBLE) / 2147483647.0 < 0.1")
def shadow_sample(t, *_):
    return t.where(X.shadow_sample(F.col("txn_id"), 0.1)).select("txn_id")


@query(" SELECT channel, CASE channel WHEN 'CARD' THEN 0 WHEN 'UPI' THEN 1 ELSE 2 END AS code, count(*) AS n FROM t GROUP BY channel")
def channel_code(t, *_):
    return t.groupBy("channel").agg(F.count("*").alias("n")).withColumn("code", X.channel_code(F.col("channel")))


@query(""" SELECT txn_id, array_to_string(list_filter([CASE WHEN list_has_any(fired_rules, ['RING_SUSPECT', 'PASS_THROUGH']) THEN 'RING' END,
  CASE WHEN list_contains(fired_rules, 'GEO_IMPOSSIBLE') THEN 'GEO' END, CASE WHEN list_contains(fired_rules, 'VELOCITY_1M') THEN 'VELOCITY' END,
  CASE WHEN rule IS NOT NULL THEN 'POLICY' END], lambda x: x IS NOT NULL), ',') AS families FROM d""")
def rule_families(t, *_):
    return dec(t).select("txn_id", F.array_join(X.rule_families(F.col("fired_rules")), ",").alias("families"))


@query(""" SELECT txn_id, CASE WHEN list_has_any(fired_rules, ['RING_SUSPECT', 'PASS_THROUGH']) THEN 'RING' WHEN list_contains(fired_rules, 'GEO_IMPOSSIBLE') THEN 'GEO'
  WHEN list_contains(fired_rules, 'VELOCITY_1M') THEN 'VELOCITY' WHEN list_contains(fired_rules, 'HARD_BLOCK_MERCHANT') THEN 'POLICY' END AS pattern FROM d""")
def primary_pattern(t, *_):
    return dec(t).select("txn_id", X.primary_pattern(F.col("fired_rules")).alias("pattern"))


_CITY = ", ".join(f"{{'km': {_km('a', 'b', str(x), str(y))}, 'name': '{n}'}}" for n, x, y in CITIES)
_CITY_DEGREES = ", ".join(f"{{'d': pow(a - {x}, 2) + pow(b - {y}, 2), 'name': '{n}'}}" for n, x, y in CITIES)


@query(f", c AS (SELECT txn_id, lat + (k % 7) * 0.08 AS a, lon AS b FROM t), s AS (SELECT txn_id, list_sort([{_CITY}])[1] AS best, list_sort([{_CITY_DEGREES}])[1] AS by_degrees FROM c) SELECT txn_id, CASE WHEN best.km < 30 THEN best.name END AS city, CASE WHEN by_degrees.d < 0.04 THEN by_degrees.name END AS city_by_degrees FROM s")
def nearest_city(t, *_):
    lat = F.col("lat") + (F.col("k") % 7) * 0.08
    return t.select("txn_id", X.nearest_city(lat, F.col("lon")).alias("city"), X.nearest_city_by_degrees(lat, F.col("lon"), 0.2).alias("city_by_degrees"))


@query(" SELECT txn_id, greatest(0, latency_ms - 100) AS latency FROM d")
def latency_ms(t, *_):
    return dec(t).select("txn_id", X.latency_ms(F.col("ts_ms") + 100, F.col("ts_ms") + F.col("latency_ms")).alias("latency"))


_KNOWN = ", ".join(f"'{k}': '{v}'" for k, v in X.HYPOTHESES.items())


@query(f""", h AS (SELECT txn_id, list_filter(list_transform(fired_rules, lambda r: map {{{_KNOWN}}}[r]), lambda x: x IS NOT NULL) AS x FROM d)
SELECT txn_id, CASE WHEN len(x) > 0 THEN array_to_string(x, '; ') ELSE 'No rule fired; the model score alone raised it' END AS hypotheses FROM h""")
def triage_hypotheses(t, *_):
    return dec(t).select("txn_id", F.array_join(X.triage_hypotheses(F.col("fired_rules")), "; ").alias("hypotheses"))


@query(_HASH + " SELECT txn_id, k % 7 = 0 OR CAST(xor(h, h >> 13) & 2147483647 AS DOUBLE) / 2147483647.0 < " + str(DEFAULT.sample_rate) + " AS gate FROM h2 JOIN t USING (txn_id)")
def score_gate(t, *_):
    signals = F.when(F.col("k") % 7 == 0, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>"))
    return t.select("txn_id", D.score_gate(signals, F.col("txn_id")).alias("gate"))


@query(" SELECT txn_id, CASE WHEN k % 2 = 0 AND ml_score IS NULL THEN 'DEGRADED' ELSE 'FULL' END AS mode FROM d")
def decision_mode(t, *_):
    return dec(t).select("txn_id", D.decision_mode(F.col("k") % 2 == 0, F.col("ml_score")).alias("mode"))


@query(""", c AS (SELECT txn_id, CAST(k AS DOUBLE) AS v, k + (event_id % 9 - 4) / 4.0 AS c FROM t)
SELECT txn_id, abs(v - c) <= greatest(abs(v), abs(c)) * 0.01 OR abs(v - c) <= 0.5 + 1e-9 OR v = trunc(c) AS same FROM c""")
def number_matches(t, *_):
    near = F.col("k") + (F.col("event_id") % 9 - 4) / 4.0
    return t.select("txn_id", X.number_matches(F.col("k").cast("double"), near).alias("same"))


@query(""" SELECT txn_id, array_to_string(list_filter(['VELOCITY_1M', 'RING_SUSPECT', 'AMOUNT_CAP'], lambda x: NOT list_contains(fired_rules, x)), ',') AS missing FROM d""")
def missing_features(t, *_):
    wanted = F.array(*map(F.lit, ("VELOCITY_1M", "RING_SUSPECT", "AMOUNT_CAP")))
    return dec(t).select("txn_id", F.array_join(D.missing_features(wanted, F.col("fired_rules")), ",").alias("missing"))


@query(""" SELECT txn_id, array_to_string(CASE WHEN merchant_id IN ('""" + "', '".join(SANCTIONED) + """') THEN ['BLOCK', 'HARD_BLOCK_MERCHANT', 'merchantId', merchant_id]
  WHEN amount > 200000 THEN ['BLOCK', 'AMOUNT_CAP', 'cap', '200000.0'] END, ',') AS outcome FROM t WHERE merchant_id IN ('""" + "', '".join(SANCTIONED) + """') OR amount > 200000""")
def rule_evidence(t, *_):
    r = t.withColumn("r", D.fired_rule()).where("r is not null")
    name = F.when(F.col("r.signal.code") == "AMOUNT_CAP", "cap").otherwise("merchantId")
    return r.select("txn_id", F.concat_ws(",", "r.verdict", "r.signal.code", name, F.element_at("r.signal.evidence", name)).alias("outcome"))


@query(""" SELECT txn_id, CAST(3 + CAST(list_contains(fired_rules, 'VELOCITY_1M') AS INTEGER) + CAST(list_contains(fired_rules, 'GEO_IMPOSSIBLE') AS INTEGER)
  + CAST(list_has_any(fired_rules, ['RING_SUSPECT', 'PASS_THROUGH']) AS INTEGER) + CAST(list_contains(fired_rules, 'HARD_BLOCK_MERCHANT') AS INTEGER) AS INTEGER) AS questions FROM d""")
def suggested_questions(t, *_):
    return dec(t).select("txn_id", F.size(X.suggested_questions(F.col("fired_rules"))).alias("questions"))


@query(""", c AS (SELECT txn_id, score, unnest([{'f': 'amount', 'v': abs(amount / 1e5)}, {'f': 'k', 'v': abs(k - 50.0)}, {'f': 'score', 'v': abs(score)}]) AS x FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY x.v DESC, x.f) AS r FROM c)
SELECT txn_id, CASE WHEN score >= 0.4 THEN string_agg(x.f, ',' ORDER BY r) FILTER (WHERE r <= 2) ELSE '' END AS top FROM r GROUP BY txn_id, score""")
def top_contributions(t, *_):
    parts = F.array(*[F.struct(F.lit(n).alias("feature"), v.cast("double").alias("value")) for n, v in (("amount", F.col("amount") / 1e5), ("k", F.col("k") - 50), ("score", F.col("score")))])
    top = X.F.coalesce(C.top_contributions(parts, F.col("score"), 2), F.array().cast("array<struct<feature:string,value:double>>"))
    return t.select("txn_id", F.array_join(F.transform(top, lambda c: c["feature"]), ",").alias("top"))


def _add(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


_ROUTE = {n: p.replace("\\", "\\\\") if False else p for n, p in X.ROUTES}
_add("route_text", lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.array_join(X.route_text(F.col("text")), ",").alias("routes")),
     "SELECT conv_id, turn, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in _ROUTE.items()) + "], lambda x: x IS NOT NULL), ',') AS routes FROM conversations")
_add("normalize_question", lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.sha2(X.normalize_question(F.col("text")), 256).alias("key")),
     r"SELECT conv_id, turn, sha256(regexp_replace(trim(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g'), ' '), '\?+$', '')) AS key FROM conversations")
_add("extract_quantities", lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", X.extract_quantities(F.col("text")).alias("q")).select(
    "conv_id", "turn", F.size("q").alias("n"), F.round(F.aggregate("q", F.lit(0.0), lambda a, q: a + q["value"]), 4).alias("total")),
    r"""WITH a AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z?', ' ', 'g'),
  '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}', ' ', 'g'), '\[\s*\d+(\s*,\s*\d+)*\s*\]', ' ', 'g') AS x FROM conversations),
b AS (SELECT conv_id, turn, regexp_extract_all(x, '-?\d{1,3}(,\d{3})+(\.\d+)?|-?\d+(\.\d+)?') AS q FROM a)
SELECT conv_id, turn, CAST(len(q) AS INTEGER) AS n, round(coalesce(list_sum(list_transform(q, lambda v: CAST(replace(v, ',', '') AS DOUBLE))), 0.0), 4) AS total FROM b""")

# ------------------------------------------------------------------ per user


def _vel(name: str, size: int) -> str:
    b = size // 60
    return (f"(SELECT count(*) FROM t y WHERE y.user_id = x.user_id AND y.ts_ms - y.ts_ms % {b} BETWEEN x.ts_ms - x.ts_ms % {b} - {size - b} AND x.ts_ms - x.ts_ms % {b} "
            f"AND (y.ts_ms - y.ts_ms % {b} < x.ts_ms - x.ts_ms % {b} OR y.seq <= x.seq)) AS cnt{name}")


_V = ", v AS (SELECT x.*, " + ", ".join(_vel(n, s) for n, s, _ in DEFAULT.windows) + ", round((SELECT sum(amount) FROM t y WHERE y.user_id = x.user_id AND y.ts_ms - y.ts_ms % 60000 BETWEEN x.ts_ms - x.ts_ms % 60000 - 3540000 AND x.ts_ms - x.ts_ms % 60000 AND (y.ts_ms - y.ts_ms % 60000 < x.ts_ms - x.ts_ms % 60000 OR y.seq <= x.seq)), 2) AS sum1h FROM t x)"


@query(_V + " SELECT txn_id, cnt1m, cnt5m, cnt1h, sum1h FROM v")
def velocity_features(t, *_):
    return U.velocity_features(t).select("txn_id", "cnt1m", "cnt5m", "cnt1h", F.round("sum1h", 2).alias("sum1h"))


@query(_V + " SELECT txn_id, CASE WHEN cnt1m > 8 THEN 'VELOCITY_1M' END AS s1m, CASE WHEN cnt5m > 20 THEN 'VELOCITY_5M' END AS s5m, CASE WHEN cnt1h > 60 THEN 'VELOCITY_1H' END AS s1h, round(CASE WHEN cnt1h > 60 THEN least(1.0, (cnt1h - 60) / 60.0) END, 6) AS severity FROM v", 5000)
def velocity_signals(t, *_):
    s = D.velocity_signals()
    f = U.velocity_features(t).select("txn_id", *[c.alias(n) for c, n in zip(s, ("a", "b", "c"), strict=True)])
    return f.select("txn_id", F.col("a.code").alias("s1m"), F.col("b.code").alias("s5m"), F.col("c.code").alias("s1h"), F.round("c.severity", 6).alias("severity"))


_Z = ", z0 AS (SELECT *, count(amount) OVER w AS n, avg(amount) OVER w AS m, stddev_samp(amount) OVER w AS s FROM t WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query(_Z + f" SELECT txn_id, CASE WHEN n >= 10 AND s >= 1.0 THEN {_jr('((amount - m) / s)', 2)} ELSE 0.0 END AS amt_z FROM z0")
def amount_zscore(t, *_):
    return U.amount_zscore(t).select("txn_id", "amt_z")


_GEO = f""", g0 AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, lag(ts_ms) OVER w AS pm FROM t WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
g1 AS (SELECT *, CASE WHEN pm IS NULL THEN -1.0 ELSE greatest(0.0, (ts_ms - pm) / 1000.0) END AS secs_since, (ts_ms - pm) // 1000 AS gap_s, CASE WHEN pm IS NOT NULL THEN {_km('la', 'lo', 'lat', 'lon')} END AS km FROM g0),
g2 AS (SELECT *, CASE WHEN gap_s >= 1 THEN km / (gap_s / 3600.0) END AS speed FROM g1)"""


@query(_GEO + " SELECT txn_id, secs_since, gap_s, round(km, 4) AS km, round(speed, 4) AS speed FROM g2", 100)
def geo_features(t, *_):
    return U.geo_features(t).select("txn_id", "secs_since", "gap_s", F.round("distance_km", 4).alias("km"), F.round("speed_kmh", 4).alias("speed"))


@query(_GEO + f" SELECT txn_id, round(least(1.0, (speed - 900) / 900), 6) AS severity, CAST({_jr('km', 1)} AS VARCHAR) AS km FROM g2 WHERE gap_s >= 60 AND speed > 900 AND km > 100", 100)
def geo_signal(t, *_):
    s = U.geo_features(t).withColumn("s", D.geo_signal()).where("s is not null")
    return s.select("txn_id", F.round("s.severity", 6).alias("severity"), F.element_at("s.evidence", "distanceKm").alias("km"))


@query(""", x AS (SELECT txn_id, k, ts_ms + unnest(CASE WHEN k % 2 = 0 THEN [0, 1800000, 3660000, 7300000] ELSE [0, 3600000, 7200000, 7200001] END) AS ts_ms FROM t),
ac(txn_id, ts_ms) AS (SELECT txn_id, min(ts_ms) FROM x GROUP BY txn_id UNION ALL SELECT x.txn_id, min(x.ts_ms) FROM ac JOIN x ON x.txn_id = ac.txn_id AND x.ts_ms > ac.ts_ms + 3600000 GROUP BY x.txn_id)
SELECT txn_id, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM ac GROUP BY txn_id""")
def dedup_first(t, *_):
    """Each payment four times over two hours, some exactly the TTL apart, which is still a repeat."""
    shift = F.when(F.col("k") % 2 == 0, F.array(*map(F.lit, (0, 1_800_000, 3_660_000, 7_300_000)))).otherwise(F.array(*map(F.lit, (0, 3_600_000, 7_200_000, 7_200_001))))
    again = t.withColumn("ms", F.explode(shift)).withColumn("ts_ms", F.col("ts_ms") + F.col("ms")).withColumn("seq", P.order_key(F.col("ts_ms"), F.col("txn_id")))
    return U.dedup_first(again).groupBy("txn_id").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


@query(f" SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE ts_ms - ts_ms % {s // 60} > {NOW - s} AND ts_ms - ts_ms % {s // 60} <= {NOW}) AS cnt{n}" for n, s, _ in DEFAULT.windows) + f" FROM t WHERE ts_ms <= {NOW} GROUP BY user_id")
def windows_asof(t, *_):
    return U.windows_asof(t, NOW).select("user_id", "cnt1m", "cnt5m", "cnt1h")


@query(f" SELECT user_id, count(*) AS n, {_jr('avg(amount)', 2)} AS mean, coalesce({_jr('stddev_samp(amount)', 2)}, 0.0) AS std FROM t GROUP BY user_id")
def profile_snapshot(t, *_):
    return U.profile_snapshot(t)


@query(f", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, seq DESC) AS rank FROM d) SELECT txn_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 50 AND ts_ms > {DAY - 20 * 3_600_000}", 30)
def recent_decisions(t, *_):
    return U.recent_decisions(dec(t), DAY, 20).select("txn_id", "rank")


@query(f""", pr AS (SELECT user_id, count(*) AS n, {_jr('avg(amount)', 2)} AS mean, coalesce({_jr('stddev_samp(amount)', 2)}, 0.0) AS std FROM t GROUP BY user_id),
wi AS (SELECT user_id, """ + ", ".join(f"count(*) FILTER (WHERE ts_ms - ts_ms % {s // 60} > {NOW - s} AND ts_ms - ts_ms % {s // 60} <= {NOW}) AS cnt{n}" for n, s, _ in DEFAULT.windows) + f""" FROM t WHERE ts_ms <= {NOW} GROUP BY user_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, seq DESC) AS rank FROM d),
rc AS (SELECT user_id, count(*) AS recent, max(ts_ms) AS last_ms FROM rk WHERE rank <= 50 AND ts_ms > {NOW - 24 * 3_600_000} GROUP BY user_id)
SELECT pr.*, cnt1m, cnt5m, cnt1h, coalesce(recent, 0) AS recent, last_ms FROM pr LEFT JOIN wi USING (user_id) LEFT JOIN rc USING (user_id)""")
def user_history(t, *_):
    h = U.user_history(t, dec(t), NOW, 24)
    return h.select("user_id", "n", "mean", "std", "cnt1m", "cnt5m", "cnt1h", "recent", "last_ms")


@query(", hr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS r FROM d) SELECT user_id, count(*) AS in_period, string_agg(verdict || ':' || coalesce(CAST(round(ml_score, 3) AS VARCHAR), '-'), ',' ORDER BY r) FILTER (WHERE r <= 5) AS latest FROM hr GROUP BY user_id")
def history_view(t, *_):
    shown = F.transform("latest", lambda x: F.concat_ws(":", x["verdict"], F.coalesce(F.round(x["score"], 3).cast("string"), F.lit("-"))))
    return U.history_view(dec(t)).select("user_id", "in_period", F.array_join(shown, ",").alias("latest"))


# ------------------------------------------------------------------ transfers


@query(" SELECT seq, src, dst, round(amount, 2) AS amount FROM g", 5)
def build_edges(t, *_):
    return G.build_edges(t).select("seq", "src", "dst", F.round("amount", 2).alias("amount"))


@query(" SELECT seq, lead(seq, 50) OVER (PARTITION BY src ORDER BY seq) AS out_until, lead(seq, 50) OVER (PARTITION BY dst ORDER BY seq) AS in_until FROM g", 5)
def edge_lifetimes(t, *_):
    return G.edge_lifetimes(G.build_edges(t)).select("seq", "out_until", "in_until")


@query(" SELECT txn_id, CAST(least(50, (SELECT count(*) FROM g WHERE g.src = t.user_id AND g.seq <= t.seq AND g.ts_ms >= t.ts_ms - 86400000)) AS INTEGER) AS out_degree FROM t", 5)
def out_degree(t, *_):
    return G.out_degree(t).select("txn_id", "out_degree")


@query(" SELECT count(DISTINCT src) AS nodes FROM g", 5)
def graph_node_count(t, *_):
    return G.graph_node_count(G.build_edges(t))


_LIVE = f", lv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY seq DESC) AS r FROM g WHERE ts_ms <= {DAY}) WHERE r <= 50 AND ts_ms >= {DAY - 86_400_000})"


@query(_LIVE + " SELECT seq, src, dst FROM lv", 5)
def live_edges_asof(t, *_):
    return G.live_edges_asof(G.build_edges(t), DAY).select("seq", "src", "dst")


@query(", r AS (SELECT seq, src, row_number() OVER (PARTITION BY src ORDER BY seq DESC) AS r FROM g) SELECT seq, src FROM r WHERE r <= 50", 5)
def cap_edges(t, *_):
    return G.cap_edges(G.build_edges(t)).select("seq", "src")


_PT = f""", ar AS (SELECT a.seq, b.seq AS in_seq, b.src AS in_src, b.amount AS in_amount, b.ts_ms AS in_ts, a.ts_ms, a.amount, row_number() OVER (PARTITION BY a.seq ORDER BY b.seq DESC) AS r
  FROM g a JOIN g b ON b.dst = a.src AND b.seq < a.seq),
pm AS (SELECT *, amount / in_amount BETWEEN 0.8 AND 1.02 AS fits FROM ar WHERE r <= 50 AND in_ts >= ts_ms - 43200000 AND in_amount > 0),
pb AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY fits DESC, in_seq DESC) AS best FROM pm),
pt AS (SELECT seq, in_src AS in_from, {_jr('(amount / in_amount)', 3)} AS pt_ratio, (ts_ms - in_ts) // 1000 AS pt_secs, CASE WHEN fits THEN in_seq END AS parent FROM pb WHERE best = 1)"""
WIDE = type(DEFAULT)(pass_window_ms=43_200_000)  # twelve hours, for more matches in the derived payments


@query(_PT + " SELECT seq, in_from, pt_ratio, pt_secs, parent FROM pt", 5)
def pass_through(t, *_):
    return G.pass_through(G.build_edges(t), WIDE).drop("in_amount")


@query(_PT + " SELECT seq, in_seq, fits FROM pm", 5)
def match_pass_through(t, *_):
    return G.match_pass_through(G.build_edges(t), WIDE).select("seq", "in_seq", "fits")


@query(_PT.replace(", pt AS", ", pt AS") + ", ch(seq, depth) AS (SELECT seq, 0 FROM pt WHERE parent IS NULL UNION ALL SELECT g.seq, 0 FROM g WHERE g.seq NOT IN (SELECT seq FROM pt) UNION ALL SELECT pt.seq, ch.depth + 1 FROM pt JOIN ch ON pt.parent = ch.seq) SELECT pt.seq, CAST(least(10, max(ch.depth)) AS INTEGER) AS depth FROM pt JOIN ch ON ch.seq = pt.seq GROUP BY pt.seq", 5)
def chain_depth(t, *_):
    return G.chain_depth(G.pass_through(G.build_edges(t), WIDE))


_RING = """, lf AS (SELECT *, lead(seq, 50) OVER (PARTITION BY src ORDER BY seq) AS out_until FROM g),
rp(seq, ts_ms, goal, node, path, hops) AS (SELECT seq, ts_ms, src, dst, [dst], CAST([] AS VARCHAR[]) FROM g
  UNION ALL SELECT rp.seq, rp.ts_ms, rp.goal, lf.dst, list_append(rp.path, lf.dst), list_append(rp.hops, lf.seq) FROM rp JOIN lf ON lf.src = rp.node
  WHERE rp.node <> rp.goal AND len(rp.hops) < 4 AND lf.seq < rp.seq AND lf.ts_ms >= rp.ts_ms - 86400000 AND (lf.out_until IS NULL OR lf.out_until > rp.seq) AND NOT list_contains(rp.path, lf.dst)),
rc AS (SELECT seq, goal, path, row_number() OVER (PARTITION BY seq ORDER BY hops) AS r FROM rp WHERE node = goal)"""


@query(_RING + " SELECT seq, goal || ',' || array_to_string(path, ',') AS cycle FROM rc WHERE r = 1", 5)
def ring_cycles(t, *_):
    return G.ring_cycles(G.build_edges(t)).select("seq", F.array_join("cycle", ",").alias("cycle"))


@query(_RING + " SELECT seq, len(list_distinct(path)) AS accounts FROM rc WHERE r = 1 AND len(list_distinct(path)) >= 3", 5)
def ring_signal(t, *_):
    return G.ring_cycles(G.build_edges(t)).where(D.ring_signal().isNotNull()).select("seq", F.size(F.array_distinct("cycle")).cast("long").alias("accounts"))


@query(_LIVE + """, rp(seq, goal, node, path, hops) AS (SELECT seq, src, dst, [dst], CAST([] AS VARCHAR[]) FROM lv
  UNION ALL SELECT rp.seq, rp.goal, lv.dst, list_append(rp.path, lv.dst), list_append(rp.hops, lv.seq) FROM rp JOIN lv ON lv.src = rp.node
  WHERE rp.node <> rp.goal AND len(rp.hops) < 4 AND NOT list_contains(rp.path, lv.dst)),
rc AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY hops) AS r FROM rp WHERE node = goal),
ds AS (SELECT *, row_number() OVER (PARTITION BY goal, list_sort(list_distinct(list_append(path, goal))) ORDER BY seq) AS d FROM rc WHERE r = 1)
SELECT goal AS root, seq, goal || ',' || array_to_string(path, ',') AS cycle FROM ds WHERE d = 1""", 30)
def cycles_through(t, *_):
    e = G.build_edges(t)
    return G.cycles_through(e, e.select(F.col("src").alias("root")).distinct(), DAY).select("root", "seq", F.array_join("cycle", ",").alias("cycle"))


@query(_LIVE + f""", rt AS (SELECT DISTINCT src AS root FROM g), n1 AS (SELECT root, root AS node, 0 AS hop FROM rt UNION SELECT rt.root, lv.dst, 1 FROM rt JOIN lv ON lv.src = rt.root),
n2 AS (SELECT * FROM n1 UNION SELECT n1.root, lv.dst, 2 FROM n1 JOIN lv ON lv.src = n1.node WHERE n1.hop = 1), dg AS (SELECT src, count(*) AS k FROM lv GROUP BY src)
SELECT root, node, CAST(min(hop) AS INTEGER) AS hop, coalesce(max(dg.k), 0) AS degree FROM n2 LEFT JOIN dg ON dg.src = node GROUP BY root, node""", 5)
def neighborhood(t, *_):
    e = G.build_edges(t)
    return G.Neighborhood(e, e.select(F.col("src").alias("root")).distinct(), DAY).nodes


_NEAR = _LIVE + ", rt AS (SELECT DISTINCT src AS root FROM g), n1 AS (SELECT root, root AS node FROM rt UNION SELECT rt.root, lv.dst FROM rt JOIN lv ON lv.src = rt.root)"


@query(_PT.replace("43200000", "3600000") + ", ch(seq, depth) AS (SELECT seq, 0 FROM g WHERE seq NOT IN (SELECT seq FROM pt WHERE parent IS NOT NULL) UNION ALL SELECT pt.seq, ch.depth + 1 FROM pt JOIN ch ON pt.parent = ch.seq), cd AS (SELECT seq, least(10, max(depth)) AS depth FROM ch GROUP BY seq)"
       + _NEAR + " SELECT n1.root, lv.seq, lv.src, lv.dst, round(lv.amount, 2) AS amount, CAST(cd.depth AS INTEGER) AS chain_depth FROM n1 JOIN lv ON lv.src = n1.node JOIN cd ON cd.seq = lv.seq", 30)
def neighborhood_edges(t, *_):
    e = G.build_edges(t)
    n = G.Neighborhood(e, e.select(F.col("src").alias("root")).distinct(), DAY)
    return n.edges.select("root", "seq", "src", "dst", F.round("amount", 2).alias("amount"), "chain_depth")


@query(f", b AS (SELECT src AS x, dst AS y FROM g WHERE ts_ms <= {DAY} UNION SELECT dst, src FROM g WHERE ts_ms <= {DAY}), r(root, node) AS (SELECT DISTINCT src, src FROM g UNION SELECT r.root, b.y FROM r JOIN b ON b.x = r.node) SELECT root, count(*) AS component_size FROM r GROUP BY root", 30)
def neighborhood_sizes(t, *_):
    """Of accounts that ever send, what they were linked with at the time."""
    e = G.build_edges(t)
    return G.Neighborhood(e, e.select(F.col("src").alias("root")).distinct(), DAY).sizes


@query(", b AS (SELECT src AS x, dst AS y FROM g UNION SELECT dst, src FROM g), r(node, root) AS (SELECT x, x FROM b UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.node), c AS (SELECT node, min(root) AS component FROM r GROUP BY node) SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM c", 5)
def components_final(t, *_):
    return G.components_final(G.build_edges(t))


def _sizes(since: str = "", rows: str = "t") -> str:
    """Each payment's account and what it reaches over transfers up to then (``since``: and not before), a walk for each payment."""
    src = "user_id" if rows == "t" else "src"
    return (f", ud AS (SELECT seq, ts_ms, src AS a, dst AS b FROM g UNION ALL SELECT seq, ts_ms, dst, src FROM g), cr(seq, ts_ms, node) AS (SELECT seq, ts_ms, {src} FROM {rows} UNION SELECT cr.seq, cr.ts_ms, ud.b FROM cr JOIN ud ON ud.a = cr.node AND ud.seq <= cr.seq{since}),"
            " zs AS (SELECT seq, count(*) AS component_size FROM cr GROUP BY seq)")


def _linked(t):
    return t.select("seq", "ts_ms", F.col("user_id").alias("src"), F.col("counterparty_id").alias("dst"))


@query(_sizes() + " SELECT seq, component_size FROM zs", 5)
def component_size_asof(t, *_):
    """At every payment, transfers and others."""
    return G.component_size_asof(_linked(t))


@query(_sizes(" AND ud.ts_ms >= cr.ts_ms - 43200000") + " SELECT seq, component_size FROM zs", 5)
def component_size_windowed(t, *_):
    return G.component_size_windowed(_linked(t), 43_200_000)


# ------------------------------------------------------------------ decisions


@query(" SELECT txn_id, rule FROM d WHERE rule IS NOT NULL")
def hard_rules(t, *_):
    return t.withColumn("rule", D.hard_rules()).where("rule is not null").select("txn_id", "rule")


@query(_V + ", p AS (SELECT v.*, d.rule, CAST(cnt1m > 8 AS INTEGER) + CAST(cnt5m > 20 AS INTEGER) + CAST(cnt1h > 60 AS INTEGER) AS ns, CAST((cnt1m - 8) / 8.0 >= 0.5 AS INTEGER) + CAST((cnt5m - 20) / 20.0 >= 0.5 AS INTEGER) + CAST((cnt1h - 60) / 60.0 >= 0.5 AS INTEGER) AS strong FROM v JOIN d ON d.txn_id = v.txn_id) SELECT txn_id, CASE WHEN rule IS NOT NULL THEN 'BLOCK' WHEN strong >= 2 OR ns >= 1 THEN 'REVIEW' ELSE 'ALLOW' END AS verdict FROM p", 5000)
def threshold_policy(t, *_):
    f = U.velocity_features(t).withColumn("signals", F.array_compact(F.array(*D.velocity_signals())))
    none, mode = F.lit(None).cast("double"), F.when(F.size("signals") > 0, "DEGRADED").otherwise("FULL")
    return f.select("txn_id", D.threshold_policy(D.hard_rules(), none, F.col("signals"), mode).alias("verdict"))


_DECIDE = (
    _V + _Z.replace("FROM t ", "FROM t ") + _GEO + _PT.replace("43200000", "3600000")
    + ", ch(seq, depth) AS (SELECT seq, 0 FROM g WHERE seq NOT IN (SELECT seq FROM pt WHERE parent IS NOT NULL) UNION ALL SELECT pt.seq, ch.depth + 1 FROM pt JOIN ch ON pt.parent = ch.seq), cd AS (SELECT seq, least(10, max(depth)) AS depth FROM ch GROUP BY seq)"
    + _RING + """, f AS (SELECT v.txn_id, v.seq, d0.rule, cnt1m, cnt5m, cnt1h, g2.speed, g2.km, g2.gap_s, coalesce(cd.depth, 0) AS depth, len(list_distinct(rc.path)) AS ring
  FROM v JOIN d0 ON d0.seq = v.seq JOIN g2 ON g2.seq = v.seq LEFT JOIN cd ON cd.seq = v.seq LEFT JOIN rc ON rc.seq = v.seq AND rc.r = 1),
s AS (SELECT *, list_filter([CASE WHEN cnt1m > 8 THEN 'VELOCITY_1M' END, CASE WHEN cnt5m > 20 THEN 'VELOCITY_5M' END, CASE WHEN cnt1h > 60 THEN 'VELOCITY_1H' END,
  CASE WHEN gap_s >= 60 AND speed > 900 AND km > 100 THEN 'GEO_IMPOSSIBLE' END, CASE WHEN ring >= 3 THEN 'RING_SUSPECT' END, CASE WHEN depth >= 1 THEN 'PASS_THROUGH' END], lambda x: x IS NOT NULL) AS sig FROM f)
SELECT txn_id, CASE WHEN rule IS NOT NULL THEN 'BLOCK' WHEN len(sig) >= 1 THEN 'REVIEW' ELSE 'ALLOW' END AS verdict,
  array_to_string(CASE WHEN rule IS NULL THEN sig ELSE list_append(sig, rule) END, ',') AS fired FROM s"""
)


@query(_DECIDE, 100)
def decide(t, *_):
    """No model answers, so what needed one is degraded; the sample of clean payments has no signal and is allowed."""
    return D.decide(t).select("txn_id", "verdict", F.array_join("fired_rules", ",").alias("fired"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["decide"](spark, sf_dir).where("verdict != 'ALLOW'")


@query(" SELECT 'signal' AS kind, unnest(fired_rules) AS key, count(*) AS n FROM d GROUP BY 1, 2 UNION ALL SELECT 'decision', verdict || '/' || mode, count(*) FROM d GROUP BY 1, 2")
def ops_counters(t, *_):
    return D.ops_counters(dec(t))


@query(_HASH + " SELECT round(count(*) FILTER (WHERE k % 10 <> 0 AND counterparty_id IS NOT NULL AND list_contains(fired_rules, 'PASS_THROUGH')) * 1.0 / count(*) FILTER (WHERE k % 10 <> 0 AND counterparty_id IS NOT NULL), 6) AS honest_pass_through, round(avg(CAST(len(list_filter(fired_rules, lambda x: x NOT IN ('HARD_BLOCK_MERCHANT', 'AMOUNT_CAP'))) > 0 OR CAST(xor(h, h >> 13) & 2147483647 AS DOUBLE) / 2147483647.0 < " + str(DEFAULT.sample_rate) + " AS INTEGER)), 6) AS scored_share FROM d JOIN h2 USING (txn_id)")
def gate_cost(t, *_):
    """The gate is that of the engine: a check has fired, or the payment is in the sample."""
    checks = F.filter("fired_rules", lambda r: ~r.isin(*HARD_RULES))
    g = D.gate_cost(dec(t).withColumn("gate", D.score_gate(checks, F.col("txn_id"))), P.labels(t))
    return g.select(*[F.round(c, 6).alias(c) for c in g.columns])


@query(" SELECT strftime(epoch_ms(ts_ms), '%Y-%m-%d') AS day, count(*) AS n FROM d GROUP BY day", 5)
def write_decisions(t, *_):
    """The log written by day to the shared folder, and read back."""
    path = f"{shared_dir(t.sparkSession)}/log_{uuid.uuid4().hex}"
    P.write_decisions(dec(t), path)
    return t.sparkSession.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query(" SELECT count(*) AS all_rows, count(*) FILTER (WHERE k % 4 <> 0) AS usable, sum(CASE channel WHEN 'CARD' THEN 0.0 WHEN 'UPI' THEN 1.0 ELSE 2.0 END) AS channels FROM t")
def usable_decisions(t, *_):
    """Feature maps of which every fourth lacks a key."""
    have = t.withColumns({n: F.lit(0) for n in D.FEATURES if n != "channel"}).withColumn("features", D.features_map())
    some = have.withColumn("features", F.when(F.col("k") % 4 == 0, F.map_filter("features", lambda n, _: n != "tier")).otherwise(F.col("features")))
    good = D.usable_decisions(some).agg(F.count("*").alias("usable"))
    return some.agg(F.count("*").alias("all_rows"), F.sum(F.element_at("features", "channel")).alias("channels")).crossJoin(good)


@query(" SELECT txn_id, user_id, verdict, mode FROM d")
def decision_tick(t, *_):
    return D.decision_tick(dec(t)).select("txn_id", "user_id", "verdict", "mode")


# ------------------------------------------------------------------ metrics

_LABELLED = ", jl AS (SELECT d.*, l.pattern, CAST(l.txn_id IS NOT NULL AS INTEGER) AS y FROM d LEFT JOIN l ON l.txn_id = d.txn_id)"


def scored(t):
    return M.join_labels(dec(t), P.labels(t)).withColumn("p", F.col("score"))


@query(_LABELLED + " SELECT txn_id, pattern, y FROM jl")
def join_labels(t, *_):
    return M.join_labels(dec(t), P.labels(t)).select("txn_id", "pattern", "y")


@query(" SELECT txn_id FROM d WHERE txn_id NOT IN (SELECT txn_id FROM l WHERE pattern = 'GEO')")
def drop_scenarios(t, *_):
    return M.drop_scenarios(dec(t), P.labels(t).where("pattern = 'GEO'")).select("txn_id")


@query(", r AS (SELECT txn_id, row_number() OVER (ORDER BY seq) AS i, count(*) OVER () AS n FROM t) SELECT txn_id, i <= CAST(floor(n * 0.8) AS BIGINT) AS is_train FROM r")
def time_split(t, *_):
    return M.time_split(t.select("txn_id", "seq")).select("txn_id", "is_train")


_SWEEP = _LABELLED + f""", th AS (SELECT CAST(unnest({_list(M.THRESHOLDS)}) AS DOUBLE) AS threshold),
sw AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND y = 0) AS fp, count(*) FILTER (WHERE score < threshold AND y = 1) AS fn, count(*) AS n FROM jl, th GROUP BY threshold),
sp AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) ELSE 0 END AS re FROM sw),
sf AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM sp)"""


@query(_SWEEP + " SELECT threshold, tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, round((tp + fp) * 1.0 / n, 6) AS flagged_rate FROM sf")
def threshold_sweep(t, *_):
    s = M.threshold_sweep(scored(t))
    return s.select("threshold", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "flagged_rate")])


@query(_SWEEP + ", b AS (SELECT min(threshold) FILTER (WHERE pr >= 0.09 AND tp > 0) AS block, min(threshold) FILTER (WHERE f1 = (SELECT max(f1) FROM sf)) AS best FROM sf) SELECT block, CASE WHEN best >= block THEN CASE WHEN round(block - 0.05, 2) > 0 THEN round(block - 0.05, 2) ELSE block END ELSE best END AS review FROM b")
def suggest_thresholds(t, *_):
    return M.suggest_thresholds(M.threshold_sweep(scored(t)), 0.09)


@query(_LABELLED + " SELECT pattern, count(*) AS positives, round(avg(CAST(score >= 0.6 AS INTEGER)), 6) AS recall FROM jl WHERE pattern IS NOT NULL GROUP BY pattern")
def per_pattern_recall(t, *_):
    return M.per_pattern_recall(scored(t), 0.6).withColumn("recall", F.round("recall", 6))


_CURVE = _LABELLED + ", cv AS (SELECT score, count(*) AS n, sum(y) AS pos FROM jl GROUP BY score), cu AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS above, sum(pos) OVER (ORDER BY score DESC) AS tp FROM cv)"


@query(_CURVE + " SELECT round(sum(pos * tp * 1.0 / above) / sum(pos), 6) AS pr_auc FROM cu")
def pr_auc(t, *_):
    return M.pr_auc(scored(t)).select(F.round("pr_auc", 6).alias("pr_auc"))


@query(_CURVE + " SELECT round(sum((n - pos) * (tp - pos / 2.0)) / (sum(pos) * sum(n - pos)), 6) AS roc_auc FROM cu")
def roc_auc(t, *_):
    return M.roc_auc(scored(t)).select(F.round("roc_auc", 6).alias("roc_auc"))


@query(" SELECT CAST(greatest(1, ceil(score * 20)) AS INTEGER) AS bin, count(*) AS n FROM t GROUP BY 1")
def score_histogram(t, *_):
    return M.score_histogram(t, "score")


@query(_LABELLED + ", r AS (SELECT *, row_number() OVER (ORDER BY seq) > CAST(floor(count(*) OVER () * 0.8) AS BIGINT) AS test FROM jl), s AS (SELECT CAST(sum(y) AS BIGINT) AS positives, CAST(sum(y) FILTER (WHERE test) AS BIGINT) AS test_positives, max(ts_ms) FILTER (WHERE test) - min(ts_ms) FILTER (WHERE test) AS test_span_ms FROM r) SELECT *, positives >= 200 AND test_positives >= 50 AND test_span_ms >= 600000 AS trainable FROM s")
def check_trainable(t, *_):
    return M.check_trainable(M.time_split(scored(t)))


@query(" SELECT pattern, count(*) AS n, round(avg(CAST(verdict <> 'ALLOW' AS INTEGER)), 6) AS recall, round(avg(CAST(ml_score IS NOT NULL AS INTEGER)), 6) AS consulted, count(*) FILTER (WHERE verdict = 'ALLOW') AS allowed, count(*) FILTER (WHERE verdict = 'REVIEW') AS reviewed, count(*) FILTER (WHERE verdict = 'BLOCK') AS blocked FROM d JOIN l USING (txn_id) GROUP BY pattern")
def production_recall(t, *_):
    return M.production_recall(dec(t), P.labels(t)).withColumns({c: F.round(c, 6) for c in ("recall", "consulted")})


_HOPS = ", rl AS (SELECT l.*, d.verdict, count(*) OVER (PARTITION BY episode) AS k FROM l JOIN d USING (txn_id) WHERE pattern = 'RING'), rs AS (SELECT *, CASE WHEN hop = 0 THEN 'first' WHEN hop = hops - 1 THEN 'closing' ELSE 'middle' END AS slot FROM rl WHERE k = hops)"


@query(_HOPS + " SELECT txn_id, slot FROM rs")
def ring_hop_slots(t, *_):
    return M.ring_hop_slots(dec(t), P.labels(t)).select("txn_id", "slot")


@query(_HOPS + " SELECT slot, count(*) AS n, round(avg(CAST(verdict <> 'ALLOW' AS INTEGER)), 6) AS recall FROM rs GROUP BY slot")
def ring_recall_by_hop(t, *_):
    return M.ring_recall_by_hop(dec(t), P.labels(t)).withColumn("recall", F.round("recall", 6))


@query(", u AS (SELECT * FROM d WHERE k % 10 <> 0), a AS (SELECT count(*) AS n, count(*) FILTER (WHERE verdict <> 'ALLOW' AND rule IS NOT NULL) AS flagged_policy, count(*) FILTER (WHERE verdict <> 'ALLOW' AND rule IS NULL) AS flagged_stat FROM u) SELECT *, round(flagged_stat * 1.0 / n, 6) AS false_positive_rate, (SELECT count(*) FROM d WHERE mode = 'FULL') AS full_mode, (SELECT count(*) FROM d WHERE mode = 'DEGRADED') AS degraded_mode FROM a")
def legit_ledger(t, *_):
    ledger = M.legit_ledger(dec(t), P.labels(t)).withColumn("false_positive_rate", F.round("false_positive_rate", 6))
    return ledger.withColumns({f"{m.lower()}_mode": F.coalesce(F.element_at("modes", m), F.lit(0)) for m in ("FULL", "DEGRADED")}).drop("modes")


@query(" SELECT verdict, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) AS p95, round(quantile_cont(latency_ms, 0.99), 4) AS p99 FROM d GROUP BY verdict")
def latency_percentiles(t, *_):
    return M.latency_percentiles(dec(t)).select("verdict", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")])


@query(""", w0 AS (SELECT ts_ms, latency_ms, (ts_ms // 10000 - unnest([0, 1, 2])) * 10000 AS start_ms FROM d),
w AS (SELECT start_ms, count(*) AS samples, count(*) FILTER (WHERE ts_ms >= start_ms + 20000) AS n, start_ms + 30000 - min(ts_ms) FILTER (WHERE ts_ms >= start_ms + 20000) AS oldest, list_sort(list(latency_ms)) AS ls FROM w0 GROUP BY start_ms)
SELECT start_ms, samples, round(CASE WHEN n > 0 THEN n * 1000.0 / least(10000, greatest(1000, oldest)) ELSE 0 END, 6) AS tps, ls[CAST(ceil(0.5 * samples) AS BIGINT)] AS p50, ls[CAST(ceil(0.99 * samples) AS BIGINT)] AS p99 FROM w""")
def feed_pulse(t, *_):
    """With exact ranks, since windows hold more samples in larger tables."""
    return M.feed_pulse(dec(t), k=None).withColumn("tps", F.round("tps", 6))


def results(t):
    """Reports on decisions, by arithmetic."""
    d = M.join_labels(dec(t), P.labels(t)).where("verdict != 'ALLOW'")
    k = F.col("k")
    return d.select(
        "txn_id", F.col("pattern").alias("truth"), "fired_rules", F.when(k % 4 == 0, "UNCERTAIN").when(k % 20 < 10, "RING").otherwise("VELOCITY").alias("fraud_type"),
        F.when(k % 9 == 0, None).when(k % 3 == 0, "CONFIRM_BLOCK").when(k % 3 == 1, "RELEASE").otherwise("ESCALATE").alias("action"),
        (k % 5 != 0).alias("passed"), (k % 6).alias("tool_calls"), F.when(k % 13 == 0, "model call failed").otherwise("ok").alias("notes"),
    )


_RES = _LABELLED + """, rs AS (SELECT pattern AS truth, rule, CASE WHEN k % 4 = 0 THEN 'UNCERTAIN' WHEN k % 20 < 10 THEN 'RING' ELSE 'VELOCITY' END AS fraud_type,
  CASE WHEN k % 9 = 0 THEN NULL WHEN k % 3 = 0 THEN 'CONFIRM_BLOCK' WHEN k % 3 = 1 THEN 'RELEASE' ELSE 'ESCALATE' END AS action, k % 5 <> 0 AS passed, k % 6 AS tool_calls, k FROM jl WHERE verdict <> 'ALLOW'),
rk AS (SELECT *, CASE WHEN truth IS NOT NULL THEN 'planted' WHEN rule IS NOT NULL THEN 'policy' ELSE 'falsePositive' END AS kind FROM rs WHERE k % 13 <> 0)"""


@query(_RES + """ SELECT kind, count(*) AS n, count(action) AS actions, round(avg(CAST(CASE WHEN kind <> 'falsePositive' THEN action = 'CONFIRM_BLOCK' ELSE action IN ('RELEASE', 'ESCALATE') END AS INTEGER)), 6) AS action_accuracy,
  round(avg(CAST(CASE WHEN kind = 'planted' THEN fraud_type = truth END AS INTEGER)), 6) AS type_agreement, round(avg(CAST(passed AS INTEGER)), 6) AS verify_rate, round(avg(tool_calls), 6) AS mean_calls, max(tool_calls) AS max_calls, count(*) FILTER (WHERE fraud_type = 'UNCERTAIN') AS uncertain FROM rk GROUP BY kind""")
def eval_score(t, *_):
    return M.eval_score(results(t)).withColumns({c: F.round(c, 6) for c in ("action_accuracy", "type_agreement", "verify_rate", "mean_calls")})


@query(_RES + " SELECT truth, fraud_type, count(*) AS n FROM rs WHERE truth IS NOT NULL GROUP BY truth, fraud_type")
def eval_confusion(t, *_):
    return M.eval_confusion(results(t))


@query(" SELECT 'case_' || txn_id AS case_id, pattern AS truth FROM d LEFT JOIN l USING (txn_id) WHERE verdict <> 'ALLOW' AND event_id % 17 <> 0")
def cases_x_truth(t, *_):
    return M.cases_x_truth(opened(t), P.labels(t)).select("case_id", "truth")


# ------------------------------------------------------------------ cases


def opened(t):
    have = dec(t).where("event_id % 17 = 0").select("txn_id")
    return C.open_cases(dec(t), have)[0].withColumn("status", F.element_at(F.array(*map(F.lit, C.STATUSES)), (F.col("txn_id").cast("long") % 4 + 1).cast("int")))


_CASES = f", cs AS (SELECT 'case_' || txn_id AS case_id, txn_id, user_id, verdict, ml_score, fired_rules, {_list(C.STATUSES)}[event_id % 4 + 1] AS status, ts_ms AS created_ms, k FROM d WHERE verdict <> 'ALLOW' AND event_id % 17 <> 0)"


@query(_CASES + " SELECT case_id, verdict, created_ms FROM cs")
def open_cases(t, *_):
    return opened(t).select("case_id", "verdict", "created_ms")


@query(" SELECT txn_id FROM d WHERE event_id % 17 <> 0")
def insert_if_absent(t, *_):
    return C.insert_if_absent(t.union(t), t.where("event_id % 17 = 0")).select("txn_id")


@query(_CASES + " SELECT case_id, created_ms, count(*) OVER () AS total FROM cs WHERE status = 'OPEN' AND list_contains(fired_rules, 'VELOCITY_1M') ORDER BY created_ms DESC, case_id LIMIT 20 OFFSET 5")
def list_cases(t, *_):
    return C.list_cases(opened(t), "OPEN", "VELOCITY_1M", 20, 5).select("case_id", "created_ms", "total")


@query(_CASES + f", st AS (SELECT unnest({_list(C.STATUSES)}) AS status) SELECT st.status, count(cs.case_id) AS n FROM st LEFT JOIN cs ON cs.status = st.status GROUP BY st.status")
def case_counts_by_status(t, *_):
    return C.case_counts_by_status(opened(t))


@query(_CASES + f" SELECT count(*) FILTER (WHERE verdict = 'BLOCK' AND created_ms > {NOW - 1_800_000}) AS block, count(*) FILTER (WHERE verdict = 'REVIEW' AND created_ms > {NOW - 1_800_000}) AS review FROM cs")
def verdict_counts_since(t, *_):
    return C.verdict_counts_since(opened(t), NOW, 1_800_000)


@query(_CASES + " SELECT status, verdict, count(*) AS n FROM cs GROUP BY status, verdict")
def window_stats(t, *_):
    return C.window_stats(opened(t))


def moves(t):
    return t.select(F.concat(F.lit("case_"), (F.col("event_id") % 500).cast("string")).alias("case_id"), "event_id", F.element_at(F.array(*map(F.lit, C.STATUSES)), (F.col("k") % 5 + 1).cast("int")).alias("to_status"))


@query(f""", mv AS (SELECT 'case_' || (event_id % 500) AS case_id, event_id, {_list(C.STATUSES)}[k % 5 + 1] AS to_status FROM t),
m2 AS (SELECT *, coalesce(max(CAST(starts_with(to_status, 'CLOSED') AS INTEGER)) OVER (PARTITION BY case_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed, coalesce(lag(to_status) OVER (PARTITION BY case_id ORDER BY event_id), 'OPEN') AS was FROM mv)
SELECT case_id, event_id, to_status, closed = 0 AND was <> to_status AS accepted FROM m2""")
def fold_case_status(t, *_):
    return C.fold_case_status(moves(t))


@query(_CASES + ", rp AS (SELECT case_id, 'report ' || txn_id AS report FROM cs WHERE k % 3 = 0) SELECT cs.case_id, rp.report, CASE WHEN rp.report IS NOT NULL AND cs.status IN ('OPEN', 'INVESTIGATING') THEN 'REPORTED' ELSE cs.status END AS status FROM cs LEFT JOIN rp ON rp.case_id = cs.case_id")
def attach_reports(t, *_):
    c = opened(t)
    r = t.where("k % 3 = 0").select(F.concat(F.lit("case_"), "txn_id").alias("case_id"), F.concat(F.lit("report "), "txn_id").alias("report"), F.col("ts_ms").alias("at_ms"))
    return C.attach_reports(c, r.union(r.withColumns({"report": F.lit("older"), "at_ms": F.col("at_ms") - 1}))).select("case_id", "report", "status")


@query(_CASES + " SELECT case_id, CASE WHEN k % 3 = 0 THEN 'CREATED,NOTE,STATUS' WHEN k % 3 = 1 THEN 'NOTE,CREATED' ELSE 'CREATED' END AS events FROM cs")
def case_detail(t, *_):
    """Up to three events a case, given in no order."""
    c = opened(t).join(t.select("txn_id", "k"), "txn_id")
    event = lambda kind, ms: c.select("case_id", "k", F.lit(kind).alias("event_type"), (F.col("created_ms") + ms).alias("at_ms"))
    events = event("STATUS", 9).where("k % 3 = 0").union(event("NOTE", 5).where("k % 3 = 0")).union(event("NOTE", -5).where("k % 3 = 1")).union(event("CREATED", 0))
    return C.case_detail(c, events.drop("k")).select("case_id", F.array_join(F.transform("events", lambda e: e["event_type"]), ",").alias("events"))


@query(" SELECT * FROM (SELECT txn_id, 'all' AS feed FROM d ORDER BY seq DESC LIMIT 200) UNION ALL SELECT * FROM (SELECT txn_id, 'flagged' AS feed FROM d WHERE verdict <> 'ALLOW' ORDER BY seq DESC LIMIT 200)")
def latest_ticks(t, *_):
    return C.latest_ticks(dec(t)).select("txn_id", "feed")


@query(" SELECT episode, array_to_string(list_sort(list_distinct(list(user_id))), ',') AS accounts FROM l GROUP BY episode")
def episode_accounts(t, *_):
    return C.episode_accounts(P.labels(t)).select("episode", F.array_join("accounts", ",").alias("accounts"))


@query(_CASES + ", sc AS (SELECT pattern, case_id, row_number() OVER (PARTITION BY pattern ORDER BY CASE WHEN hop <= 10 THEN hop END DESC NULLS LAST, created_ms DESC, case_id) AS r FROM cs JOIN l USING (txn_id)) SELECT pattern, case_id FROM sc WHERE r = 1")
def scenario_cases(t, *_):
    return C.scenario_cases(opened(t), P.labels(t)).select("pattern", "case_id")


@query(f" SELECT txn_id, ts_ms - {P.T0_MS} AS at_ms FROM d WHERE ts_ms >= {P.T0_MS} AND ts_ms < {NOW}")
def session_extract(t, *_):
    return P.session_extract(dec(t).union(dec(t)), P.T0_MS, NOW).select("txn_id", "at_ms")


@query(f" SELECT txn_id FROM t WHERE ts_ms >= {P.T0_MS + 600_000} AND ts_ms < {NOW}")
def bounded_read(t, *_):
    return P.bounded_read(t, P.T0_MS + 600_000, NOW).select("txn_id")


@query(f" SELECT txn_id, pattern FROM l WHERE ts_ms >= {DAY - 3_600_000}", 5)
def read_labels(t, *_):
    return P.read_labels(P.labels(t), DAY).select("txn_id", "pattern")


def documents_json(t):
    doc = F.to_json(F.struct(F.col("txn_id").alias("txnId"), F.col("user_id").alias("userId"), F.col("merchant_id").alias("merchantId"), "amount", "channel", F.lit(1).alias("more")))
    return t.select(F.when(F.col("k") % 10 == 3, F.concat(F.lit("{broken"), "txn_id")).otherwise(doc).alias("value"))


@query(" SELECT txn_id, user_id, round(amount, 2) AS amount FROM t WHERE k % 10 <> 3")
def read_transactions(t, *_):
    return P.dlq_split(P.read_transactions(documents_json(t)))[0].select("txn_id", "user_id", F.round("amount", 2).alias("amount"))


@query(" SELECT 'deserialize' AS stage, '{broken' || txn_id AS payload FROM t WHERE k % 10 = 3")
def dlq_split(t, *_):
    return P.dlq_split(P.read_transactions(documents_json(t)))[1].select("stage", "payload")


@query(" SELECT 'decision' AS stage, count(*) AS n FROM t WHERE k % 20 = 1")
def dlq_decision_errors(t, *_):
    bad = D.dlq_decision_errors(t.withColumn("user_id", F.when(F.col("k") % 20 != 1, F.col("user_id"))))
    return bad.groupBy("stage").agg(F.count("*").alias("n"))


@query(" SELECT txn_id FROM t WHERE k % 9 <> 0")
def drop_missing_id(t, *_):
    return P.drop_missing_id(t.withColumn("txn_id", F.when(F.col("k") % 9 != 0, F.col("txn_id")))).select("txn_id")


@query(" SELECT coalesce(CASE WHEN k % 10 = 3 THEN 'unparseable' WHEN k % 10 = 4 THEN 'incomplete' WHEN k % 10 = 5 THEN 'bad_txn_id' END, 'ok') AS reason, count(*) AS n FROM t GROUP BY 1")
def intake_decisions(t, *_):
    uuid = F.concat(F.lpad("txn_id", 8, "0"), F.lit("-0000-4000-8000-"), F.lpad("txn_id", 12, "0"))
    doc = F.to_json(F.struct(F.when(F.col("k") % 10 == 5, F.col("txn_id")).otherwise(uuid).alias("txnId"), "user_id", F.when(F.col("k") % 10 != 4, F.col("user_id")).alias("userId"), F.lit("REVIEW").alias("verdict")))
    raw = t.select(F.when(F.col("k") % 10 == 3, "{broken").otherwise(doc).alias("value"))
    return P.intake_decisions(raw).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query(" SELECT txn_id, 'signals: ' || array_to_string(fired_rules, ', ') || ' type: UNKNOWN' AS text FROM d WHERE len(fired_rules) > 0")
def summary_text(t, *_):
    return dec(t).where(F.size("fired_rules") > 0).select("txn_id", X.summary_text(F.lit(""), F.col("fired_rules"), F.lit(None).cast("string")).alias("text"))


@query(_CASES + " SELECT case_id, trim('case of ' || user_id || CASE WHEN len(fired_rules) > 0 THEN ' signals: ' || array_to_string(fired_rules, ', ') ELSE '' END || ' type: RING', ' ') AS text FROM cs WHERE starts_with(status, 'CLOSED')")
def index_closed_cases(t, *_):
    return C.index_closed_cases(opened(t).withColumns({"summary": F.concat(F.lit("case of "), "user_id"), "fraud_type": F.lit("RING")})).drop("at_ms")


@query(_CASES + " SELECT case_id, trim(CASE WHEN k % 2 = 0 THEN 'newer case of ' ELSE 'case of ' END || user_id || CASE WHEN len(fired_rules) > 0 THEN ' signals: ' || array_to_string(fired_rules, ', ') ELSE '' END || ' type: RING', ' ') AS text FROM cs WHERE starts_with(status, 'CLOSED')")
def upsert_closed_cases(t, *_):
    """Cases put into the index, half of them then again with a newer report, and at last with an older one, which changes nothing."""
    path = f"{shared_dir(t.sparkSession)}/index_{uuid.uuid4().hex}"
    c = opened(t).join(t.select("txn_id", "k"), "txn_id").withColumns({"summary": F.concat(F.lit("case of "), "user_id"), "fraud_type": F.lit("RING")})
    C.upsert_closed_cases(path, c)
    C.upsert_closed_cases(path, c.where("k % 2 = 0").withColumns({"summary": F.concat(F.lit("newer "), "summary"), "created_ms": F.col("created_ms") + 1}))
    return C.upsert_closed_cases(path, c.withColumn("created_ms", F.col("created_ms") - 1)).select("case_id", "text")


def evidence(t):
    """Two pieces of evidence a case: a document with lists, nested lists, exponents and numbers in its strings, and one that failed."""
    case, k = F.concat(F.lit("case_"), "txn_id"), F.col("k").cast("string")
    payload = F.concat(
        F.lit('{"count": '), k, F.lit(', "ids": ["a", "b", "a"], "counts": ['), k, F.lit(", 14, "), k, F.lit('], "pairs": [[1, 2], [1, 2], [7, 7, 7, '), k,
        F.lit(']], "share": 1.5e3, "low": -0.25, "none": [], "note": "paid 1,'), F.lpad(k, 3, "0"), F.lit(' to m_9, \\"x,y\\"", "of 40": {"flag": true, "gap": null}}'),
    )
    e = t.select(case.alias("case_id"), F.lit(0).alias("idx"), payload.alias("payload"), F.lit(None).cast("string").alias("error"))
    return e.union(t.select(case, F.lit(1), F.lit(None).cast("string"), F.when(F.col("k") % 2 == 0, "timeout").otherwise("failed")))


def claims(t):
    """A claim a case, of which some cite nothing, a piece that is not there or failed, or quote a number that may not be in the payload."""
    k = F.col("k")
    refs = F.when(k % 5 == 0, F.array().cast("array<int>")).when(k % 5 == 1, F.array(F.lit(7))).when(k % 5 == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    said = F.when(k % 5 == 3, F.concat(F.lit("it was "), (k * 13 + 17).cast("string"), F.lit(" times [0]"))).otherwise(F.concat(F.lit("it was "), k.cast("string"), F.lit(" times, 2 ids, 25% and 1,500")))
    return t.select(F.concat(F.lit("case_"), "txn_id").alias("case_id"), F.lit(0).alias("claim"), said.alias("text"), refs.alias("refs"))


#: The payload of each case read with DuckDB's JSON functions: numbers, sizes of lists, and what stands in strings and keys.
_NUMBERS = r""", ev AS (SELECT txn_id, k, '{"count": ' || k || ', "ids": ["a", "b", "a"], "counts": [' || k || ', 14, ' || k || '], "pairs": [[1, 2], [1, 2], [7, 7, 7, ' || k ||
  ']], "share": 1.5e3, "low": -0.25, "none": [], "note": "paid 1,' || lpad(CAST(k AS VARCHAR), 3, '0') || ' to m_9, \"x,y\"", "of 40": {"flag": true, "gap": null}}' AS payload FROM t),
tr AS (SELECT ev.txn_id, j.* FROM ev, LATERAL (SELECT key, type, atom, value FROM json_tree(ev.payload)) j),
nm AS (SELECT txn_id, abs(CAST(atom AS DOUBLE)) AS number FROM tr WHERE type IN ('UBIGINT', 'BIGINT', 'DOUBLE')
  UNION SELECT txn_id, CAST(json_array_length(value) AS DOUBLE) FROM tr WHERE type = 'ARRAY'
  UNION SELECT txn_id, CAST(len(list_distinct(CAST(value AS JSON[]))) AS DOUBLE) FROM tr WHERE type = 'ARRAY' AND NOT regexp_matches(CAST(value AS VARCHAR), '.[\[{]')
  UNION SELECT txn_id, abs(CAST(replace(unnest(regexp_extract_all(x, '-?\d{1,3}(,\d{3})+(\.\d+)?|-?\d+(\.\d+)?')), ',', '') AS DOUBLE))
    FROM (SELECT txn_id, CASE WHEN type = 'VARCHAR' THEN CAST(atom AS VARCHAR) END AS x FROM tr UNION ALL SELECT txn_id, CASE WHEN NOT regexp_matches(key, '^\d+$') THEN key END FROM tr) WHERE x IS NOT NULL),
sd AS (SELECT txn_id, k, CASE WHEN k % 5 = 3 THEN [{'v': k * 13.0 + 17.0, 'p': false}] ELSE [{'v': CAST(k AS DOUBLE), 'p': false}, {'v': 2.0, 'p': false}, {'v': 25.0, 'p': true}, {'v': 1500.0, 'p': false}] END AS q FROM t),
qd AS (SELECT txn_id, k, unnest(q) AS q FROM sd WHERE k % 5 <> 0),
cd AS (SELECT txn_id, k, q, unnest(CASE WHEN q.p THEN [q.v, q.v / 100] ELSE [q.v] END) AS v FROM qd),
hit AS (SELECT cd.txn_id, cd.k, q, coalesce(bool_or(abs(v - number) <= greatest(v, number) * 0.01 OR abs(v - number) <= CASE WHEN v = trunc(v) THEN 0.5 ELSE 0.005 END + 1e-9 OR v = trunc(number)), false) AS ok
  FROM cd LEFT JOIN nm ON nm.txn_id = cd.txn_id AND cd.k % 5 <> 1 GROUP BY ALL),
vd AS (SELECT t.txn_id, t.k, CASE WHEN t.k % 5 = 0 THEN 'no_refs' WHEN t.k % 5 = 1 THEN 'bad_ref' WHEN t.k % 5 = 2 THEN 'failed_tool_ref' WHEN count(*) FILTER (WHERE NOT ok) > 0 THEN 'uncited_number' END AS violation
  FROM t LEFT JOIN hit ON hit.txn_id = t.txn_id GROUP BY t.txn_id, t.k)"""


@query(_NUMBERS + " SELECT 'case_' || txn_id AS case_id, violation FROM vd")
def verify_claims(t, *_):
    return C.verify_claims(claims(t), evidence(t)).select("case_id", "violation")


@query(_NUMBERS + " SELECT 'case_' || txn_id AS case_id, q.v AS value, ok AS supported FROM hit")
def claims_x_evidence(t, *_):
    return C.claims_x_evidence(claims(t), evidence(t)).select("case_id", "value", "supported")


@query(_NUMBERS + " SELECT number, count(*) AS n FROM nm GROUP BY number")
def evidence_numbers(t, *_):
    return C.evidence_numbers(evidence(t)).groupBy("number").agg(F.count("*").alias("n"))


@query(_NUMBERS + " SELECT txn_id, count(*) AS n, round(sum(number), 4) AS total FROM nm GROUP BY txn_id")
def flatten_numbers(t, *_):
    numbers = X.flatten_numbers(F.col("payload"))
    e = evidence(t).where("idx = 0").select(F.expr("substr(case_id, 6)").alias("txn_id"), numbers.alias("x"))
    return e.select("txn_id", F.size("x").cast("long").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(_NUMBERS + " SELECT 'case_' || txn_id AS case_id, CAST(violation IS NULL AS INTEGER) AS kept, CAST(violation IS NOT NULL AS BIGINT) AS removed FROM vd")
def verified_answer(t, *_):
    return C.verified_answer(C.verify_claims(claims(t), evidence(t))).select("case_id", F.size("kept").alias("kept"), "removed")


@query(_NUMBERS + " SELECT 'case_' || txn_id AS case_id, CASE WHEN violation IS NULL THEN 'RING' ELSE 'UNCERTAIN' END AS fraud_type, CASE WHEN violation IS NULL THEN 0.9 ELSE 0.0 END AS confidence, violation IS NULL AS passed FROM vd")
def finalize_reports(t, *_):
    r = t.select(F.concat(F.lit("case_"), "txn_id").alias("case_id"), F.lit("RING").alias("fraud_type"), F.lit(0.9).alias("confidence"), F.lit("CONFIRM_BLOCK").alias("action"))
    return C.finalize_reports(r, C.verify_claims(claims(t), evidence(t))).select("case_id", "fraud_type", "confidence", "passed")


def _similar(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("case_id"), "embedding")
    return C.similar_cases(e, e.where("case_id % 50 = 0"))


_add("similar_cases", _similar, """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS case_id, list_cosine_similarity(q.e, c.e) AS x FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY x DESC, case_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, case_id, round(x, 3) AS similarity FROM r WHERE rank <= 3""")

# ------------------------------------------------------------------ models


def _decided(t):
    """Payments with all features."""
    return D.features(t).withColumn("features", D.features_map())


_FEATURES = _DECIDE[: _DECIDE.index(",\ns AS (SELECT *, list_filter")] + ", fx AS (SELECT f.*, pt.pt_ratio, pt.pt_secs FROM f LEFT JOIN pt ON pt.seq = f.seq)"


#: All features of the map, each by its own definition.
_ALL = _FEATURES + _sizes() + f""", od AS (SELECT seq, CAST(least(50, (SELECT count(*) FROM g WHERE g.src = t.user_id AND g.seq <= t.seq AND g.ts_ms >= t.ts_ms - 86400000)) AS INTEGER) AS out_degree, {_CAT} AS category FROM t),
fa AS (SELECT fx.txn_id, CAST(cnt1m AS DOUBLE) AS cnt1m, CAST(cnt5m AS DOUBLE) AS cnt5m, CAST(cnt1h AS DOUBLE) AS cnt1h, (SELECT sum1h FROM v WHERE v.seq = fx.seq) AS sum1h,
  CASE WHEN z0.n >= 10 AND z0.s >= 1.0 THEN {_jr('((z0.amount - z0.m) / z0.s)', 2)} ELSE 0.0 END AS amt_z, CASE WHEN fx.gap_s >= 60 THEN coalesce({_jr('fx.speed', 1)}, 0.0) ELSE 0.0 END AS geo_speed, g2.secs_since,
  CAST(CASE category {' '.join(f"WHEN '{k}' THEN {v}" for k, v in TIERS.items())} ELSE 0 END AS DOUBLE) AS tier, CAST(out_degree AS DOUBLE) AS out_degree, CAST(ring IS NOT NULL AS DOUBLE) AS in_cycle,
  CAST(component_size AS DOUBLE) AS component_size, CASE z0.channel WHEN 'CARD' THEN 0.0 WHEN 'UPI' THEN 1.0 ELSE 2.0 END AS channel, coalesce(pt_ratio, 0.0) AS pt_ratio, CAST(coalesce(pt_secs, -1) AS DOUBLE) AS pt_secs, CAST(least(10, depth) AS DOUBLE) AS chain_depth
  FROM fx JOIN z0 ON z0.seq = fx.seq JOIN g2 ON g2.seq = fx.seq JOIN od ON od.seq = fx.seq JOIN zs ON zs.seq = fx.seq)"""


def _named(frame, *more):
    return frame.select("txn_id", *[(F.round("f_sum1h", 2) if n == "sum1h" else F.col(f"f_{n}")).alias(n) for n in D.FEATURES], *more)


@query(_ALL + _LABELLED + " SELECT fa.*, jl.y FROM fa JOIN jl ON jl.txn_id = fa.txn_id", 100)
def training_frame(t, *_):
    return _named(ML.training_frame(_decided(t), P.labels(t)), "y")


@query(_ALL + " SELECT * FROM fa", 100)
def feature_row(t, *_):
    return _named(D.feature_row(_decided(t)))


@query(_Z + f", e1_ AS (SELECT txn_id, seq, n AS prior_n, round(m, 4) AS prior_mean, round(s, 4) AS prior_std, lag(lat) OVER (PARTITION BY user_id ORDER BY seq) AS prior_lat, lag(ts_ms) OVER (PARTITION BY user_id ORDER BY seq) AS prior_ms, {_CAT} AS category FROM z0) SELECT * EXCLUDE (seq), CAST(CASE category {' '.join(f"WHEN '{k}' THEN {v}" for k, v in TIERS.items())} ELSE 0 END AS INTEGER) AS tier FROM e1_")
def enrich(t, *_):
    return D.enrich(t).select("txn_id", "category", "tier", "prior_n", F.round("prior_mean", 4).alias("prior_mean"), F.round("prior_std", 4).alias("prior_std"), "prior_lat", "prior_ms")


@query(None, 100)
def fit_score(t, *_):
    frame = materialize(ML.training_frame(_decided(t), P.labels(t)))
    return ML.score(ML.fit_model(frame), frame).select("txn_id", "y", "p")


@query(None, 100)
def decide_scored(t, *_):
    """Decisions with a model: boosted trees, fitted on the same payments, score what the gate lets through."""
    f = materialize(D.features(t))
    model = ML.fit_model(ML.training_frame(f.withColumn("features", D.features_map()), P.labels(t)))
    names = {f"f_{k}": F.col(k).cast("double") for k in D.FEATURES} | {"f_channel": X.channel_code(F.col("channel")).cast("double"), "f_in_cycle": F.col("in_cycle").cast("double")}
    scorer = lambda rows: ML.score(model, rows.withColumns(names)).withColumnRenamed("p", "ml_score").drop(*names)
    return D.assemble_decision(f, scorer).select("txn_id", "verdict", "mode", F.round("ml_score", 6).alias("ml_score"), F.array_join("fired_rules", ",").alias("fired"))


@query(None, 100)
def feature_importance(t, *_):
    """What each feature weighs in the trees, with all features and without the velocity counts."""
    frame = materialize(ML.training_frame(_decided(t), P.labels(t)))
    rows = []
    for without in ((), ("f_cnt1m", "f_cnt5m", "f_cnt1h")):
        rows += [(len(without), name, value) for name, value in ML.feature_importance(ML.ablate(frame, without))]
    return t.sparkSession.createDataFrame(rows, "left_out int, feature string, importance double")


@query(None, 100)
def explain(t, *_):
    """What each feature adds to the log-odds that the boosted trees give each payment."""
    frame = materialize(ML.training_frame(_decided(t), P.labels(t)))
    return ML.explain(ML.fit_model(frame), frame).select("txn_id", "base", F.explode("contributions").alias("c")).select("txn_id", "base", "c.feature", "c.value")
