"""Training frames, curves, thresholds and what was really caught."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrine.config import HARD_RULES
from sentrine.storage import materialize

THRESHOLDS = tuple(round(i / 20, 2) for i in range(1, 20)) + (0.97, 0.98, 0.99)
FLAGGED = ("REVIEW", "BLOCK")


def join_labels(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Every decision with ``pattern`` and ``y``; without a label it is legitimate."""
    return decisions.join(labels.select("txn_id", "pattern"), "txn_id", "left").withColumn("y", F.col("pattern").isNotNull().cast("int"))


def cases_x_truth(cases: DataFrame, labels: DataFrame, only_labelled: bool = False) -> DataFrame:
    """Cases with what the labels say of their payment, as ``truth``; null, or left out, without a label."""
    return cases.join(labels.select("txn_id", F.col("pattern").alias("truth")), "txn_id", "inner" if only_labelled else "left")


def drop_scenarios(rows: DataFrame, staged: DataFrame) -> DataFrame:
    return rows.join(staged.select("txn_id"), "txn_id", "left_anti")


def global_rank(df: DataFrame, *order: str) -> DataFrame:
    """``rank`` from 1 over all rows without sorting them in one task: range partitions and their running counts.

    The sorted rows are a table of their own, which ``drop`` of the result deletes when that has been written.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = materialize(parts.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("n"))  # one row per partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    out = parts.withColumn("_w", within).join(F.broadcast(before), "_p").withColumn("rank", F.col("_before") + F.col("_w")).drop("_p", "_i", "_w", "_before")
    out._sentrine_path = parts._sentrine_path
    return out


def time_split(df: DataFrame, share: float = 0.8) -> DataFrame:
    """``is_train``: the earlier share of the rows by event order, never a random one."""
    n = df.count()
    return global_rank(df, "seq").withColumn("is_train", F.col("rank") <= int(n * share)).drop("rank")


def threshold_sweep(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """One row per threshold: ``threshold, tp, fp, fn, precision, recall, f1, flagged_rate`` with ``p >= t`` flagged.

    Scores are counted once by how many thresholds they clear; running sums over the 23 bins give all rows.
    """
    spark = scored.sparkSession
    cleared = sum((F.when(F.col(p) >= t, 1).otherwise(0) for t in THRESHOLDS), F.lit(0))
    bins = scored.groupBy(cleared.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    grid = spark.createDataFrame([(i, float(t)) for i, t in enumerate(THRESHOLDS, 1)] + [(0, None)], "bin int, threshold double")
    all_, up = Window.partitionBy(), Window.orderBy(F.desc("bin"))
    s = grid.join(bins, "bin", "left").fillna(0, ["n", "pos"])
    s = s.withColumns({"flagged": F.sum("n").over(up), "tp": F.sum("pos").over(up), "N": F.sum("n").over(all_), "P": F.sum("pos").over(all_)}).where("bin > 0")
    s = s.withColumns({"fp": F.col("flagged") - F.col("tp"), "fn": F.col("P") - F.col("tp")})
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    s = s.withColumns({"precision": ratio(F.col("tp"), F.col("flagged")), "recall": ratio(F.col("tp"), F.col("P"))})
    s = s.withColumns({"f1": ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "flagged_rate": ratio(F.col("flagged"), F.col("N"))})
    return s.select("threshold", "tp", "fp", "fn", "precision", "recall", "f1", "flagged_rate")


def suggest_thresholds(sweep: DataFrame, bar: float = 0.98) -> DataFrame:
    """``block``: lowest threshold of at least that precision; ``review``: the best f1, below ``block``."""
    s = sweep.agg(
        F.min(F.when((F.col("precision") >= bar) & (F.col("tp") > 0), F.col("threshold"))).alias("block"),
        F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("b"),
    )
    review = -F.col("b.t")
    lower = F.round(F.col("block") - 0.05, 2)
    return s.select("block", F.when(review >= F.col("block"), F.when(lower > 0, lower).otherwise(F.col("block"))).otherwise(review).alias("review"))


def per_pattern_recall(scored: DataFrame, threshold: float, p: str = "p") -> DataFrame:
    hit = F.when(F.col(p) >= threshold, 1).otherwise(0)
    return scored.where("pattern is not null").groupBy("pattern").agg(F.count("*").alias("positives"), F.avg(hit.cast("double")).alias("recall"))


def _curve(scored: DataFrame, p: str, y: str, bands: int = 4096) -> DataFrame:
    """Distinct scores with their counts and what lies at or above each.

    Scores between 0 and 1 are ordered in ``bands`` of their own; one window of a row per band adds what lies above each.
    """
    by = scored.groupBy(F.col(p).alias("p")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    by = by.withColumn("band", F.greatest(F.lit(0), F.least(F.lit(bands), F.floor(F.col("p") * bands).cast("int"))))
    before = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    sums = by.groupBy("band").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    sums = sums.select("band", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("pos").over(before), F.lit(0)).alias("pos0"))
    up = Window.partitionBy("band").orderBy(F.desc("p"))
    by = by.join(F.broadcast(sums), "band")  # at most bands + 1 rows
    return by.withColumns({"above": F.col("n0") + F.sum("n").over(up), "tp": F.col("pos0") + F.sum("pos").over(up)})


def pr_auc(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Average precision as the step sum over distinct scores; null with one class."""
    s = _curve(scored, p, y).agg(F.sum(F.col("pos") * F.col("tp") / F.col("above")).alias("a"), F.sum("pos").alias("P"), F.sum("n").alias("N"))
    return s.select(F.when((F.col("P") > 0) & (F.col("P") < F.col("N")), F.col("a") / F.col("P")).alias("pr_auc"))


def roc_auc(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half; null with one class."""
    c = _curve(scored, p, y).withColumn("neg", F.col("n") - F.col("pos"))
    s = c.agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("a"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return s.select(F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("a") / (F.col("P") * F.col("N"))).alias("roc_auc"))


def score_histogram(scored: DataFrame, p: str = "p", bins: int = 20) -> DataFrame:
    """Counts by upper-inclusive bins of equal width; 0 is in the first."""
    return scored.groupBy(F.greatest(F.lit(1), F.ceil(F.col(p) * bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def check_trainable(split: DataFrame, positives: int = 200, in_test: int = 50, span_ms: int = 600_000) -> DataFrame:
    test = ~F.col("is_train")
    s = split.agg(
        F.sum("y").cast("long").alias("positives"), F.coalesce(F.sum(F.when(test, F.col("y"))), F.lit(0)).cast("long").alias("test_positives"),
        (F.max(F.when(test, F.col("ts_ms"))) - F.min(F.when(test, F.col("ts_ms")))).alias("test_span_ms"),
    )
    ok = (F.col("positives") >= positives) & (F.col("test_positives") >= in_test) & (F.col("test_span_ms") >= span_ms)
    return s.withColumn("trainable", F.coalesce(ok, F.lit(False)))


def production_recall(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Per pattern: ``n, recall, consulted`` and the numbers of each verdict."""
    d = decisions.select("txn_id", "verdict", "ml_score").join(labels.select("txn_id", "pattern"), "txn_id")
    v = lambda x: F.count(F.when(F.col("verdict") == x, 1))
    return d.groupBy("pattern").agg(
        F.count("*").alias("n"), F.avg(F.col("verdict").isin(*FLAGGED).cast("double")).alias("recall"),
        F.avg(F.col("ml_score").isNotNull().cast("double")).alias("consulted"), v("ALLOW").alias("allowed"), v("REVIEW").alias("reviewed"), v("BLOCK").alias("blocked"),
    )


def ring_hop_slots(decisions: DataFrame, labels: DataFrame, settled_ms: int = 1_920_000) -> DataFrame:
    """Flagged or not for each hop of complete ring episodes, with its ``slot``: first, middle or closing."""
    d = labels.join(decisions.select("txn_id", "verdict"), "txn_id")
    newest = d.agg(F.max("ts_ms").alias("newest"))
    ep = Window.partitionBy("episode")
    r = d.where("pattern = 'RING' and episode is not null").crossJoin(F.broadcast(newest))  # one row
    r = r.withColumns({"i": F.row_number().over(ep.orderBy("ts_ms", "txn_id")) - 1, "k": F.count("*").over(ep), "began": F.min("ts_ms").over(ep), "declared": F.max("hops").over(ep)})
    done = F.when(F.col("declared").isNotNull(), F.col("k") == F.col("declared")).otherwise((F.col("k") >= 3) & (F.col("newest") - F.col("began") >= settled_ms))
    at, of = F.coalesce("hop", "i"), F.coalesce("hops", "k")
    slot = F.when(at == 0, "first").when(at == of - 1, "closing").otherwise("middle")
    return r.where(done).select("episode", "txn_id", slot.alias("slot"), F.col("verdict").isin(*FLAGGED).alias("flagged"))


def ring_recall_by_hop(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    return ring_hop_slots(decisions, labels).groupBy("slot").agg(F.count("*").alias("n"), F.avg(F.col("flagged").cast("double")).alias("recall"))


def legit_ledger(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Unlabelled payments: ``n, flagged_policy, flagged_stat, false_positive_rate``; and ``modes``, the number of all decisions by mode."""
    modes = decisions.groupBy("mode").agg(F.count("*").alias("c")).agg(F.map_from_entries(F.collect_list(F.struct("mode", "c"))).alias("modes"))  # a row for each mode
    d = decisions.join(labels.select("txn_id"), "txn_id", "left_anti")
    flagged, policy = F.col("verdict").isin(*FLAGGED), F.arrays_overlap("fired_rules", F.array(*map(F.lit, HARD_RULES)))
    s = d.agg(F.count("*").alias("n"), F.count(F.when(flagged & policy, 1)).alias("flagged_policy"), F.count(F.when(flagged & ~policy, 1)).alias("flagged_stat"))
    return s.withColumn("false_positive_rate", F.when(F.col("n") > 0, F.col("flagged_stat") / F.col("n"))).crossJoin(F.broadcast(modes))  # one row each


def latency_percentiles(decisions: DataFrame, by: str = "verdict", k: int | None = None) -> DataFrame:
    """``p50, p95, p99`` of each group; with ``k`` from sketches of bounded size, whose values are of ranks within about 3 / ``k`` of those asked for."""
    if k:
        s = decisions.groupBy(by).agg(F.kll_sketch_agg_bigint("latency_ms", k).alias("s"))
        return s.select(by, *[F.kll_sketch_get_quantile_bigint("s", F.lit(p)).cast("double").alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])
    q = lambda p: F.percentile("latency_ms", F.lit(p))
    return decisions.groupBy(by).agg(q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"))


def feed_pulse(decisions: DataFrame, slide: str = "10 seconds", k: int | None = 400) -> DataFrame:
    """The feed as of the end of each sliding window: ``start_ms, samples, tps, p50, p99``.

    Latencies are those of the 30 seconds before, by sketches that merge and stay small (a rank is off by at most 1 in
    100 at the default ``k``; up to ``k`` samples they are exact nearest ranks). Without ``k`` they are exact nearest ranks
    of any number of samples, from a count of each latency; that takes a window of Spark's and so is not for streams. The
    rate is that of the last 10 seconds, over the part of them since their first decision, one second at least; 0 if they
    have none.
    """
    w = F.window("ts", "30 seconds", slide)
    end = F.unix_millis(w["end"])
    ms = F.unix_millis("ts")
    late = ms >= end - 10_000
    d = decisions.select(w.alias("w"), "latency_ms", F.when(late, end - ms).alias("age"))
    sums = [F.count("*").alias("samples"), F.count("age").alias("n"), F.max("age").alias("oldest")]
    if k:
        out = d.groupBy("w").agg(*sums, F.kll_sketch_agg_bigint("latency_ms", k).alias("s"))
        ranks = [F.kll_sketch_get_quantile_bigint("s", F.lit(p)).alias(n) for n, p in (("p50", 0.5), ("p99", 0.99))]
    else:
        each = d.groupBy("w", "latency_ms").agg(*sums).withColumn("c", F.when(F.col("latency_ms").isNotNull(), F.col("samples")).otherwise(0))
        each = each.withColumns({"up": F.sum("c").over(Window.partitionBy("w").orderBy("latency_ms")), "of": F.sum("c").over(Window.partitionBy("w"))})
        reached = lambda hundredths: F.min(F.when((F.col("c") > 0) & (F.col("up") * 100 >= F.col("of") * hundredths), F.col("latency_ms")))
        out = each.groupBy("w").agg(F.sum("samples").alias("samples"), F.sum("n").alias("n"), F.max("oldest").alias("oldest"), reached(50).alias("p50"), reached(99).alias("p99"))
        ranks = ["p50", "p99"]
    span = F.least(F.lit(10_000), F.greatest(F.lit(1_000), "oldest")) / 1000.0
    rate = F.when(F.col("n") > 0, F.col("n") / span).otherwise(0.0)
    return out.select(F.unix_millis("w.start").alias("start_ms"), "samples", rate.alias("tps"), *ranks)


def eval_kind() -> Column:
    return F.when(F.col("truth").isNotNull(), "planted").when(F.arrays_overlap("fired_rules", F.array(*map(F.lit, HARD_RULES))), "policy").otherwise("falsePositive")


def eval_score(results: DataFrame) -> DataFrame:
    """Reports by kind: ``n, actions, action_accuracy, type_agreement, verify_rate, mean_calls, max_calls, uncertain``; starved ones left out."""
    notes = F.coalesce("notes", F.lit(""))
    r = results.where(~(notes.contains("model call failed") & ~notes.contains("draft_report: drafted"))).withColumn("kind", eval_kind())
    right = F.when(F.col("kind").isin("planted", "policy"), F.col("action") == "CONFIRM_BLOCK").otherwise(F.col("action").isin("RELEASE", "ESCALATE"))
    return r.groupBy("kind").agg(
        F.count("*").alias("n"), F.count("action").alias("actions"), F.avg(right.cast("double")).alias("action_accuracy"),
        F.avg(F.when(F.col("kind") == "planted", (F.col("fraud_type") == F.col("truth")).cast("double"))).alias("type_agreement"),
        F.avg(F.coalesce(F.col("passed"), F.lit(False)).cast("double")).alias("verify_rate"), F.avg("tool_calls").alias("mean_calls"), F.max("tool_calls").alias("max_calls"),
        F.count(F.when(F.col("fraud_type") == "UNCERTAIN", 1)).alias("uncertain"),
    )


def eval_confusion(results: DataFrame) -> DataFrame:
    return results.where("truth is not null").groupBy("truth", "fraud_type").agg(F.count("*").alias("n"))
