"""Signals, rules, policy and the whole decision."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrine.config import DEFAULT, HARD_RULES, EngineConfig
from sentrine.functions.exprs import channel_code, java_round, latency_ms, merchant_category, merchant_risk_tier, shadow_sample
from sentrine.operators import transfers as G
from sentrine.operators import users as U
from sentrine.operators.metrics import global_rank
from sentrine.storage import drop, materialize, release

FEATURES = ("cnt1m", "cnt5m", "cnt1h", "sum1h", "amt_z", "geo_speed", "secs_since", "tier", "out_degree", "in_cycle", "component_size", "channel", "pt_ratio", "pt_secs", "chain_depth")


def _signal(on: Column, code: str, severity: Column, **evidence: Column) -> Column:
    facts = F.create_map(*[x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))])
    return F.when(on, F.struct(F.lit(code).alias("code"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), severity)).alias("severity"), facts.alias("evidence")))


def velocity_signals(cfg: EngineConfig = DEFAULT) -> list[Column]:
    out = []
    for name, size, limit in cfg.windows:
        n = F.col(f"cnt{name}")
        out.append(_signal((n > limit) & F.lit(limit > 0), f"VELOCITY_{name.upper()}", (n - limit) / F.lit(float(max(limit, 1))), count=n, limit=F.lit(limit), windowSecs=F.lit(size // 1000)))
    return out


def geo_signal(cfg: EngineConfig = DEFAULT) -> Column:
    on = (F.col("gap_s") >= cfg.min_gap_s) & (F.col("speed_kmh") > cfg.max_kmh) & (F.col("distance_km") > cfg.min_km)
    return _signal(on, "GEO_IMPOSSIBLE", (F.col("speed_kmh") - cfg.max_kmh) / cfg.max_kmh, distanceKm=java_round(F.col("distance_km"), 1), gapSecs=F.col("gap_s"), speedKmh=java_round(F.col("speed_kmh"), 1))


def ring_signal(cfg: EngineConfig = DEFAULT) -> Column:
    return _signal(F.size(F.array_distinct("cycle")) >= cfg.min_cycle, "RING_SUSPECT", F.lit(1.0), cycle=F.array_join("cycle", ","))


def pass_through_signal(cfg: EngineConfig = DEFAULT) -> Column:
    return _signal(F.col("chain_depth") >= cfg.pass_depth, "PASS_THROUGH", F.col("chain_depth") / 3.0, depth=F.col("chain_depth"), ratio=F.col("pt_ratio"), secs=F.col("pt_secs"))


@dataclass(frozen=True)
class Rule:
    """A hard rule: of those whose ``condition`` holds, the one of lowest ``priority`` decides, and says why in its ``evidence``."""

    code: str
    priority: int
    condition: Callable[[EngineConfig], Column]
    evidence: Callable[[EngineConfig], dict[str, Column]] = lambda cfg: {}
    verdict: str = "BLOCK"


RULES = (
    Rule(HARD_RULES[0], 0, lambda cfg: F.col("merchant_id").isin(*cfg.sanctioned), lambda cfg: {"merchantId": F.col("merchant_id")}),
    Rule(HARD_RULES[1], 10, lambda cfg: F.col("amount") > cfg.amount_cap, lambda cfg: {"amount": F.col("amount"), "cap": F.lit(float(cfg.amount_cap))}),
)


def fired_rule(cfg: EngineConfig = DEFAULT, rules=RULES) -> Column:
    """``struct<verdict, signal>`` of the first rule that fits, by priority; null if none does. A rule that cannot be built is left out."""
    out = None
    for rule in sorted(rules, key=lambda r: r.priority):
        try:
            on, facts = rule.condition(cfg), rule.evidence(cfg)
            hit = F.struct(F.lit(rule.verdict).alias("verdict"), _signal(F.lit(True), rule.code, F.lit(1.0), **facts).alias("signal"))
        except Exception:  # one rule must not stop the others
            logging.getLogger(__name__).warning("rule %s failed", rule.code, exc_info=True)
            continue
        out = F.when(on, hit) if out is None else out.when(on, hit)
    return F.lit(None).cast("struct<verdict:string,signal:struct<code:string,severity:double,evidence:map<string,string>>>") if out is None else out


def hard_rules(cfg: EngineConfig = DEFAULT, rules=RULES) -> Column:
    """Code of the first hard rule that fits, by priority."""
    return fired_rule(cfg, rules)["signal"]["code"]


def enrich(t: DataFrame) -> DataFrame:
    """Payments with the static tier of their merchant and their account as it was before: ``category, tier, prior_n, prior_mean, prior_std, prior_lat, prior_lon, prior_ms``."""
    out = merchant_risk_tier(t.withColumn("category", merchant_category(F.col("merchant_id"))))
    before, was = U._before(), lambda c: F.lag(c).over(U._in_order())
    return out.withColumns({
        "prior_n": F.count("amount").over(before), "prior_mean": F.avg("amount").over(before), "prior_std": F.stddev_samp("amount").over(before),
        "prior_lat": was("lat"), "prior_lon": was("lon"), "prior_ms": was("ts_ms"),
    })


def features(t: DataFrame, cfg: EngineConfig = DEFAULT, sizes: bool = True) -> DataFrame:
    """All features of every payment; without ``sizes`` components count as 1.

    Payments get their place in event order as a number. Each group of features is made of that number and the few columns
    it needs, and written before the next: no plan has more than one group, no shuffle before the last carries whole
    payments, and what a group leaves on disk goes with it.
    """
    ranked = global_rank(t, "seq")
    t = _instead_of(ranked, merchant_risk_tier(ranked.withColumnRenamed("rank", "_row").withColumn("category", merchant_category(F.col("merchant_id")))))
    lean = t.select("_row", F.when(F.col("seq").isNotNull(), F.col("_row")).alias("seq"), *[c for c in ("txn_id", "user_id", "counterparty_id", "ts_ms", "amount", "lat", "lon") if c in t.columns])
    counted = lean.select("_row", "seq", "user_id", "ts_ms", "amount")
    for window in cfg.windows:
        counted = _instead_of(counted, U.velocity_features(counted, replace(cfg, windows=(window,))))
    counted = _instead_of(counted, U.amount_zscore(counted, cfg).drop("seq", "user_id", "ts_ms", "amount"))
    moved = G.out_degree(U.geo_features(lean.drop("txn_id", "amount")), cfg)
    moved = _instead_of(None, moved.drop("seq", "user_id", "counterparty_id", "ts_ms", "lat", "lon"))
    edges = _instead_of(None, G.build_edges(lean))
    pt = _instead_of(None, G.pass_through(edges, cfg))
    rings = _instead_of(edges, G.ring_cycles(edges, cfg))
    links = pt.join(G.chain_depth(pt, cfg.chain_cap), "seq").join(rings, "seq", "full_outer").withColumnRenamed("seq", "_row")
    links = _instead_of(pt, links)
    drop(rings)
    out = t.join(counted, "_row").join(moved, "_row").join(links, "_row", "left")
    if sizes:
        of = G.component_size_asof(lean.select("seq", "ts_ms", F.col("user_id").alias("src"), F.col("counterparty_id").alias("dst")))
        out = out.join(_instead_of(None, of.withColumnRenamed("seq", "_row")), "_row", "left")
    else:
        out = out.withColumn("component_size", F.lit(None).cast("long"))
    return finish_features(out.drop("_row"), cfg)


def _instead_of(was: DataFrame | None, now: DataFrame) -> DataFrame:
    """``now``, written; the table it was made of goes, and so do the shuffle files on the way."""
    now = materialize(now)
    if was is not None:
        drop(was)
    release(now.sparkSession)
    return now


def finish_features(out: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Features with a value where an account has no history, no transfer or no ring."""
    speed = F.when(F.col("gap_s") >= cfg.min_gap_s, java_round(F.col("speed_kmh"), 1)).otherwise(0.0)
    return out.withColumns({
        "chain_depth": F.coalesce("depth", F.lit(0)), "pt_ratio": F.coalesce("pt_ratio", F.lit(0.0)), "pt_secs": F.coalesce("pt_secs", F.lit(-1)),
        "in_cycle": F.col("cycle").isNotNull(), "component_size": F.coalesce("component_size", F.lit(1)), "geo_speed": F.coalesce(speed, F.lit(0.0)),
    }).drop("depth", "parent")


def all_signals(cfg: EngineConfig = DEFAULT, checks: list[Callable[[EngineConfig], Column]] = ()) -> Column:
    """Signals in the order of the checks; more checks may be given as functions of the configuration. A check that cannot be built is left out."""
    out = []
    for check in (velocity_signals, geo_signal, ring_signal, pass_through_signal, *checks):
        try:
            got = check(cfg)
            out += got if isinstance(got, list) else [got]
        except Exception:  # one check must not stop the others
            logging.getLogger(__name__).warning("check %s failed", getattr(check, "__name__", check), exc_info=True)
    return F.array_compact(F.array(*out))


def threshold_policy(rule: Column, score: Column, signals: Column, mode: Column, cfg: EngineConfig = DEFAULT, ruled: Column | None = None) -> Column:
    """BLOCK, REVIEW or ALLOW; the first condition that holds decides. A rule means ``ruled``, by default BLOCK."""
    strong = F.size(F.filter(signals, lambda s: s["severity"] >= cfg.min_severity)) >= cfg.min_signals
    return (
        F.when(rule.isNotNull(), F.lit("BLOCK") if ruled is None else ruled).when(score >= cfg.block, "BLOCK").when((score >= cfg.review) | strong, "REVIEW")
        .when((mode == "DEGRADED") & (F.size(signals) >= 1), "REVIEW").otherwise("ALLOW")
    )


def score_gate(signals: Column, txn_id: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return (F.size(signals) > 0) | shadow_sample(txn_id, cfg.sample_rate)


def decision_mode(gate: Column, score: Column) -> Column:
    return F.when(gate & score.isNull(), "DEGRADED").otherwise("FULL")


def assemble_decision(f: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None = None, cfg: EngineConfig = DEFAULT, checks=(), rules=RULES) -> DataFrame:
    """Features to decisions. ``scorer`` adds ``ml_score`` and is only given the payments the gate lets through.

    The rule that fires is one more signal of the decision, with its evidence, after those of the checks; it does not
    count as one of the strong signals that ask for a review.
    """
    out = f.withColumn("signals", all_signals(cfg, checks)).withColumn("gate", score_gate(F.col("signals"), F.col("txn_id"), cfg))
    if scorer is None:
        out = out.withColumn("ml_score", F.lit(None).cast("double"))
    else:
        rest = out.where("not gate").withColumn("ml_score", F.lit(None).cast("double"))
        out = scorer(out.where("gate")).unionByName(rest)
    out = out.withColumn("ruled", fired_rule(cfg, rules)).withColumn("rule", F.col("ruled.signal.code"))
    out = out.withColumn("mode", decision_mode(F.col("gate"), F.col("ml_score")))
    out = out.withColumn("verdict", threshold_policy(F.col("rule"), F.col("ml_score"), F.col("signals"), F.col("mode"), cfg, F.col("ruled.verdict")))
    out = out.withColumn("signals", F.array_compact(F.array_append("signals", F.col("ruled.signal")))).drop("ruled")
    out = out.withColumn("fired_rules", F.transform("signals", lambda s: s["code"]))
    out = out.withColumn("features", features_map())
    return out.withColumn("latency_ms", latency_ms(F.col("ts_ms"), F.col("decided_ms") if "decided_ms" in out.columns else F.col("ts_ms")))


def features_map() -> Column:
    """Features by name in a fixed order, as numbers."""
    value = {"channel": channel_code(F.col("channel")), "in_cycle": F.col("in_cycle").cast("int")}
    return F.create_map(*[x for k in FEATURES for x in (F.lit(k), value.get(k, F.col(k)).cast("double"))])


def feature_row(decisions: DataFrame, strict: bool = True) -> DataFrame:
    """The features map as columns in fixed order. A missing key is an error if ``strict``, else its row is left out."""
    has = F.forall(F.array(*map(F.lit, FEATURES)), lambda k: F.map_contains_key("features", k))
    rows = decisions if strict else decisions.where(has)
    get = lambda k: F.element_at("features", k) if strict else F.try_element_at("features", F.lit(k))
    return rows.select("txn_id", "ts_ms", "seq", *[get(k).alias(f"f_{k}") for k in FEATURES])


def usable_decisions(decisions: DataFrame) -> DataFrame:
    return decisions.where(F.forall(F.array(*map(F.lit, FEATURES)), lambda k: F.map_contains_key("features", k)))


def missing_features(wanted: Column, produced: Column) -> Column:
    return F.array_except(wanted, produced)


def decide(t: DataFrame, scorer=None, cfg: EngineConfig = DEFAULT, sizes: bool = True) -> DataFrame:
    """Payments to auditable decisions."""
    return assemble_decision(features(U.dedup_first(t, cfg.dedup_ttl_ms), cfg, sizes), scorer, cfg)


def decision_tick(decisions: DataFrame) -> DataFrame:
    return decisions.select("txn_id", "user_id", "merchant_id", "amount", "verdict", "mode", "ml_score", "fired_rules", "ts_ms")


def dlq_decision_errors(decisions: DataFrame) -> DataFrame:
    """Payments that cannot be decided, with their payload."""
    bad = F.col("user_id").isNull() | F.col("amount").isNull() | F.col("ts_ms").isNull()
    return decisions.where(bad).select(F.lit("decision").alias("stage"), F.lit("missing user, amount or time").alias("error"), F.to_json(F.struct("txn_id", "user_id", "amount", "ts_ms")).alias("payload"))


def ops_counters(decisions: DataFrame) -> DataFrame:
    """``kind, key, n``: signals by code, decisions by verdict and mode."""
    sig = decisions.select(F.lit("signal").alias("kind"), F.explode("fired_rules").alias("key"))
    return sig.union(decisions.select(F.lit("decision"), F.concat_ws("/", "verdict", "mode"))).groupBy("kind", "key").agg(F.count("*").alias("n"))


def gate_cost(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of honest transfers with PASS_THROUGH, and share of payments scored."""
    d = decisions.join(labels.select("txn_id", F.lit(1).alias("_l")), "txn_id", "left")
    honest = F.col("_l").isNull() & F.col("counterparty_id").isNotNull()
    hit = F.array_contains("fired_rules", "PASS_THROUGH")
    return d.agg((F.count(F.when(honest & hit, 1)) / F.count(F.when(honest, 1))).alias("honest_pass_through"), F.avg(F.col("gate").cast("int")).alias("scored_share"))
