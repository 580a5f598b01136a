"""Cases as tables: opening, status, reports, listings, similar cases, and claims against evidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrine.functions import exprs as X
from sentrine.storage import drop, exists, materialize

STATUSES = ("OPEN", "INVESTIGATING", "REPORTED", "CLOSED_FRAUD", "CLOSED_FP")


def insert_if_absent(new: DataFrame, have: DataFrame, key: str = "txn_id", order: str = "seq") -> DataFrame:
    """The rows of ``new`` to append: the first of each key that ``have`` lacks."""
    w = Window.partitionBy(key).orderBy(order)
    return new.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").join(have.select(key), key, "left_anti")


def open_cases(decisions: DataFrame, have: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, CREATED events) for flagged decisions that have none yet; running it twice adds nothing."""
    cases = insert_if_absent(decisions.where(F.col("verdict").isin("REVIEW", "BLOCK")), have)
    cases = cases.select(F.concat(F.lit("case_"), "txn_id").alias("case_id"), "txn_id", "user_id", "verdict", "ml_score", "fired_rules", F.lit("OPEN").alias("status"), F.col("ts_ms").alias("created_ms"))
    return cases, cases.select("case_id", F.lit("CREATED").alias("event_type"), F.col("created_ms").alias("at_ms"))


def fold_case_status(events: DataFrame) -> DataFrame:
    """``case_id, event_id, to_status, accepted``: closed is final and a move to the same status is refused."""
    w = Window.partitionBy("case_id").orderBy("event_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    closed = F.max(F.col("to_status").startswith("CLOSED").cast("int")).over(before)
    was = F.coalesce(F.lag("to_status").over(w), F.lit("OPEN"))
    return events.select("case_id", "event_id", "to_status", ((F.coalesce(closed, F.lit(0)) == 0) & (was != F.col("to_status"))).alias("accepted"))


def current_status(folded: DataFrame) -> DataFrame:
    return folded.where("accepted").groupBy("case_id").agg(F.max_by("to_status", "event_id").alias("status"))


def attach_reports(cases: DataFrame, reports: DataFrame) -> DataFrame:
    """The latest report of each case; open ones become REPORTED."""
    last = reports.groupBy("case_id").agg(F.max_by("report", "at_ms").alias("report"))
    moved = F.when(F.col("report").isNotNull() & F.col("status").isin("OPEN", "INVESTIGATING"), "REPORTED").otherwise(F.col("status"))
    return cases.drop("report").join(last, "case_id", "left").withColumn("status", moved)


def case_detail(cases: DataFrame, events: DataFrame) -> DataFrame:
    e = events.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("at_ms", "event_type"))).alias("events"))
    return cases.join(e, "case_id", "left")


def list_cases(cases: DataFrame, status: str | None = None, rule: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of cases, newest first, with the ``total`` of all that fit; blank filters count as none, and the limit stays between 1 and 200."""
    out = cases.where(F.col("status") == status) if status else cases
    out = out.where(F.array_contains("fired_rules", rule)) if rule else out
    total = out.agg(F.count("*").alias("total"))
    page = out.orderBy(F.desc("created_ms"), "case_id").offset(max(0, offset)).limit(min(200, max(1, limit)))
    return page.crossJoin(F.broadcast(total))  # one row


def case_counts_by_status(cases: DataFrame, statuses=STATUSES) -> DataFrame:
    dim = cases.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return dim.join(cases.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def verdict_counts_since(cases: DataFrame, now_ms: int, window_ms: int) -> DataFrame:
    """Counts of REVIEW and BLOCK strictly newer than the window, zeros included, in one row."""
    v = lambda x: F.count(F.when((F.col("verdict") == x) & (F.col("created_ms") > now_ms - window_ms), 1))
    return cases.agg(v("BLOCK").alias("block"), v("REVIEW").alias("review"))


def window_stats(cases: DataFrame) -> DataFrame:
    return cases.groupBy("status", "verdict").agg(F.count("*").alias("n"))


def latest_ticks(decisions: DataFrame, n: int = 200) -> DataFrame:
    """The newest decisions overall and the newest flagged ones, as two feeds."""
    d = decisions.select("txn_id", "user_id", "verdict", "seq")
    top = lambda x, name: x.orderBy(F.desc("seq")).limit(n).withColumn("feed", F.lit(name))
    return top(d, "all").union(top(d.where("verdict != 'ALLOW'"), "flagged"))


def episode_accounts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("episode").agg(F.array_sort(F.collect_set("user_id")).alias("accounts"))


def scenario_cases(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """One case per pattern: the last hop of a ring, else the eleventh or last payment, else the newest case."""
    c = cases.join(labels.select("txn_id", "pattern", "hop"), "txn_id")
    w = Window.partitionBy("pattern").orderBy(F.when(F.col("hop") <= 10, F.col("hop")).desc_nulls_last(), F.desc("created_ms"), "case_id")
    return c.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("pattern", "case_id", "txn_id")


def top_contributions(contributions: Column, score: Column, n: int = 5, least: float = 0.4) -> Column:
    """The n largest contributions by size, for scores of at least ``least``."""
    ranked = F.array_sort(F.transform(contributions, lambda c: F.struct((-F.abs(c["value"])).alias("o"), c["feature"].alias("feature"), c["value"].alias("value"))))
    return F.when(score >= least, F.transform(F.slice(ranked, 1, n), lambda c: F.struct(c["feature"].alias("feature"), c["value"].alias("value"))))


def similar_cases(closed: DataFrame, asked: DataFrame, k: int = 3, block: int = 8192) -> DataFrame:
    """k most similar closed cases by cosine: ``query_id, rank, case_id, similarity``.

    Both have ``case_id, embedding`` of one length; zero and null vectors take no part. Cases are dealt into blocks of
    about ``block``, which meet the queries as one matrix product each and keep their best k before the last ranking.
    """
    vec, parts = F.col("embedding").cast("array<double>"), closed.count() // block + 1
    some = F.exists("embedding", lambda x: x != 0)
    c = closed.where(some).select("case_id", vec.alias("v"), F.pmod(F.xxhash64("case_id"), F.lit(parts)).alias("part"))
    q = asked.where(some).select(F.col("case_id").alias("query_id"), vec.alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))

    def unit(vectors: pd.Series) -> np.ndarray:
        m = np.vstack(vectors.to_numpy())
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def best(key: tuple, qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        out, names = [], ["query_id", "case_id", "similarity"]
        if len(qs) and len(cs):
            cs = cs.sort_values("case_id")  # so that of ties the first come first
            known, ids = unit(cs["v"]), cs["case_id"].to_numpy()
            for lo in range(0, len(qs), 256):
                asked_ids = qs["query_id"].to_numpy()[lo : lo + 256]
                s = unit(qs["v"].iloc[lo : lo + 256]) @ known.T
                s[asked_ids[:, None] == ids[None]] = -2.0  # not itself
                least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -1.5)
                for query, near, at_least in zip(asked_ids, s, np.maximum(least, -1.5), strict=True):
                    at = np.flatnonzero(near >= at_least)
                    at = at[np.argsort(-near[at], kind="stable")][:k]
                    out.append(pd.DataFrame({"query_id": query, "case_id": ids[at], "similarity": near[at]}))
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    kinds = {f.name: f.dataType.simpleString() for f in closed.schema}
    found = q.groupBy("part").cogroup(c.groupBy("part")).applyInPandas(best, f"query_id {asked.schema['case_id'].dataType.simpleString()}, case_id {kinds['case_id']}, similarity double")
    last = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "case_id"))
    return found.withColumn("rank", last).where(F.col("rank") <= k).select("query_id", "rank", "case_id", F.round("similarity", 3).alias("similarity"))


def index_closed_cases(cases: DataFrame) -> DataFrame:
    """Closed cases with a report as ``case_id, text, at_ms``, the latest of each id."""
    rows = cases.where(F.col("status").startswith("CLOSED") & F.col("summary").isNotNull())
    text = X.summary_text(F.col("summary"), F.col("fired_rules"), F.col("fraud_type"))
    return rows.groupBy("case_id").agg(F.max_by(text, F.struct("created_ms", text)).alias("text"), F.max("created_ms").alias("at_ms"))


def upsert_closed_cases(index: str, cases: DataFrame, buckets: int = 64) -> DataFrame:
    """Puts closed cases into the table at ``index``, a newer text in place of an older one, and returns the table.

    Cases are dealt into ``buckets`` by their id. Only buckets that get a case are read and written again, so running it
    twice changes nothing and the files of the others stay as they are.
    """
    spark = cases.sparkSession
    new = materialize(index_closed_cases(cases).withColumn("bucket", F.pmod(F.xxhash64("case_id"), F.lit(buckets)).cast("int")))
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most all buckets
    if exists(spark, index):
        new = new.unionByName(spark.read.parquet(index).where(F.col("bucket").isin(touched)).select(new.columns))
    latest = F.max(F.struct("at_ms", "text")).alias("m")
    merged = materialize(new.groupBy("bucket", "case_id").agg(latest).select("case_id", "m.text", "m.at_ms", "bucket"))
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(index)
    drop(merged)
    return spark.read.schema(merged.schema).parquet(index)


def evidence_numbers(evidence: DataFrame) -> DataFrame:
    """``case_id, idx, number`` of every usable piece of evidence."""
    ok = evidence.where("error is null")
    return ok.select("case_id", "idx", F.explode(X.flatten_numbers(F.col("payload"))).alias("number"))


def claims_x_evidence(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``case_id, claim, value, supported``: each number a claim quotes, against the evidence it cites."""
    quoted = claims.select("case_id", "claim", F.explode("refs").alias("idx"), "text").withColumn("q", F.explode(X.extract_quantities(F.col("text"))))
    quoted = quoted.select("case_id", "claim", "idx", F.abs("q.value").alias("value"), "q.is_percent")
    quoted = quoted.withColumns({"places": X.decimal_places(F.col("value")), "part": F.col("value") / 100, "part_places": X.decimal_places(F.col("value") / 100)})
    has = lambda n: X.number_matches(F.col("value"), n, F.col("places")) | (F.col("is_percent") & X.number_matches(F.col("part"), n, F.col("part_places")))
    pieces = evidence.where("error is null").select("case_id", "idx", X.flatten_numbers(F.col("payload")).alias("numbers"))
    hit = F.exists("numbers", has)  # a piece's numbers stay together
    m = quoted.join(pieces, ["case_id", "idx"], "left")
    return m.groupBy("case_id", "claim", "value").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("supported"))


def verify_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``case_id, claim, violation`` (null: none): no_refs, bad_ref, failed_tool_ref or uncited_number, the first that applies."""
    have = evidence.groupBy("case_id").agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("error").isNotNull(), F.col("idx"))).alias("failed"))
    wrong = claims_x_evidence(claims, evidence).where("not supported").groupBy("case_id", "claim").agg(F.count("*").alias("uncited"))
    c = claims.join(have, "case_id", "left").join(wrong, ["case_id", "claim"], "left")
    v = (
        F.when(F.coalesce(F.size("refs"), F.lit(0)) <= 0, "no_refs")
        .when(F.exists("refs", lambda r: r >= F.coalesce("n", F.lit(0))), "bad_ref")
        .when(F.arrays_overlap("refs", "failed"), "failed_tool_ref").when(F.col("uncited") > 0, "uncited_number")
    )
    return c.select("case_id", "claim", "text", v.alias("violation"))


def verified_answer(verified: DataFrame) -> DataFrame:
    """Per case the sentences that hold, in order, and the number removed."""
    ok = F.when(F.col("violation").isNull(), F.struct("claim", "text"))
    return verified.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(ok)), lambda s: s["text"]).alias("kept"), F.count("violation").alias("removed"))


def finalize_reports(reports: DataFrame, verified: DataFrame) -> DataFrame:
    """Reports with unsupported claims become UNCERTAIN, confidence 0, ESCALATE, and lose those claims."""
    a = verified_answer(verified)
    bad = F.coalesce(F.col("removed"), F.lit(0)) > 0
    return reports.join(a, "case_id", "left").select(
        "case_id", F.when(bad, "UNCERTAIN").otherwise(F.col("fraud_type")).alias("fraud_type"), F.when(bad, 0.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(bad, "ESCALATE").otherwise(F.col("action")).alias("action"), F.coalesce(F.size("kept"), F.lit(0)).alias("findings"), (~bad).alias("passed"),
    )
