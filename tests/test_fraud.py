"""Small streams with the decisions they must get, and pure expressions at their limits."""

import random
import re

from pyspark.sql import functions as F

from sentrine.functions import exprs as X
from sentrine.operators import cases as C
from sentrine.operators import decisions as D
from sentrine.operators import metrics as M
from sentrine.operators import transfers as G
from sentrine.operators import users as U
from sentrine.operators.components import connected_components
from sentrine.sources.payments import T0_MS, order_key
from sentrine.storage import materialize

COLS = "txn_id string, user_id string, merchant_id string, counterparty_id string, amount double, lat double, lon double, channel string, ts_ms long"


def txns(spark, rows):
    out = [(f"t{i:04d}", r.get("user", "u_a"), r.get("merchant", "m_GROC_0001"), r.get("to"), float(r.get("amount", 250)), r.get("lat", 17.385), r.get("lon", 78.4867), r.get("channel", "CARD"), T0_MS + int(r["at"] * 1000)) for i, r in enumerate(rows)]
    return spark.createDataFrame(out, COLS).withColumn("seq", order_key(F.col("ts_ms"), F.col("txn_id")))


def decided(spark, rows, scorer=None):
    return [r.asDict() for r in D.decide(txns(spark, rows), scorer).orderBy("seq").collect()]


def test_single_payment_is_allowed(spark):
    (d,) = decided(spark, [{"at": 0}])
    assert (d["verdict"], d["mode"], d["fired_rules"]) == ("ALLOW", "FULL", [])
    assert (d["cnt1m"], d["cnt1h"], d["sum1h"], d["amt_z"], d["secs_since"]) == (1, 1, 250.0, 0.0, -1.0)


def test_burst(spark):
    d = decided(spark, [{"at": 3 * i} for i in range(9)])
    assert [x["verdict"] for x in d] == ["ALLOW"] * 8 + ["REVIEW"]
    assert d[8]["mode"] == "DEGRADED" and d[8]["fired_rules"] == ["VELOCITY_1M"] and d[8]["cnt1m"] == 9
    scored = decided(spark, [{"at": 3 * i} for i in range(9)], lambda f: f.withColumn("ml_score", F.lit(0.995)))
    assert scored[8]["verdict"] == "BLOCK" and scored[8]["mode"] == "FULL" and scored[0]["ml_score"] is None


def test_impossible_travel_and_rules(spark):
    d = decided(spark, [{"at": 0, "merchant": "m_GIFT_0001"}, {"at": 300, "merchant": "m_GIFT_0001", "lat": 28.6139, "lon": 77.209}])
    assert d[1]["fired_rules"] == ["GEO_IMPOSSIBLE"] and d[1]["verdict"] == "REVIEW" and d[1]["secs_since"] == 300 and d[1]["tier"] == 3
    d = decided(spark, [{"at": 0, "merchant": "m_CRYPTO_0013", "amount": 10}, {"at": 9999, "amount": 500000}])
    assert [x["fired_rules"] for x in d] == [["HARD_BLOCK_MERCHANT"], ["AMOUNT_CAP"]] and {x["verdict"] for x in d} == {"BLOCK"}


def test_rules_carry_evidence_and_fail_alone(spark):
    (d,) = decided(spark, [{"at": 0, "amount": 500000}])
    assert [(s["code"], s["severity"]) for s in d["signals"]] == [("AMOUNT_CAP", 1.0)] and d["signals"][0]["evidence"]["cap"] == "200000.0"

    def broken(cfg):
        raise RuntimeError("no such table")

    rules = [D.Rule("LATE", 5, lambda cfg: F.col("amount") > 100, lambda cfg: {"amount": F.col("amount")}, "REVIEW"), D.Rule("BROKEN", 1, broken), D.Rule("NEVER", 0, lambda cfg: F.lit(False))]
    f = D.features(txns(spark, [{"at": 0}, {"at": 90000, "amount": 50}]))
    got = D.assemble_decision(f, rules=rules).orderBy("seq").collect()
    assert [(r.verdict, r.fired_rules) for r in got] == [("REVIEW", ["LATE"]), ("ALLOW", [])]
    assert D.assemble_decision(f, rules=()).where("rule is not null").count() == 0


def test_numbers_of_a_document(spark):
    cases = {
        '{"counts": [13, 14], "n": 2}': {13, 14, 2}, '["x,y","z"]': {2}, '{"a": 1.5e3}': {1500}, "[[1, 2], [1, 2]]": {2, 1}, '[{"a": 1}, {"a": 1}]': {2, 1},
        "[]": {0}, '{"k7": true, "b": null}': {7}, '"paid 1,200 in 3 parts"': {1200, 3}, "not json 5": {5}, "[1, 1.0, 1]": {3, 1}, '{"x": -4}': {4},
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "payload string")
    got = {r.payload: set(r.x) for r in df.select("payload", X.flatten_numbers(F.col("payload")).alias("x")).collect()}
    assert got == {k: set(map(float, v)) for k, v in cases.items()} | {None: set()}


def test_ring(spark):
    names = ["u_a", "u_b", "u_c", "u_d", "u_a"]
    d = decided(spark, [{"user": names[i], "to": names[i + 1], "amount": 40000 - 1000 * i, "at": 120 * i, "channel": "P2P"} for i in range(4)])
    assert [x["verdict"] for x in d] == ["ALLOW", "REVIEW", "REVIEW", "REVIEW"]
    assert [x["chain_depth"] for x in d] == [0, 1, 2, 3] and d[1]["pt_secs"] == 120
    assert d[3]["fired_rules"] == ["RING_SUSPECT", "PASS_THROUGH"] and d[3]["cycle"] == ["u_d", "u_a", "u_b", "u_c", "u_d"]


def test_pass_through_outside_the_band(spark):
    d = decided(spark, [{"user": "u_w", "to": "u_x", "amount": 40000, "at": 0}, {"user": "u_x", "to": "u_y", "amount": 300, "at": 90}])
    assert d[1]["verdict"] == "ALLOW" and d[1]["chain_depth"] == 0 and d[1]["pt_ratio"] == 0.008 and d[1]["pt_secs"] == 90


def test_dedup(spark):
    t = txns(spark, [{"at": 0}, {"at": 100}, {"at": 7300}]).withColumn("txn_id", F.lit("same"))
    assert U.dedup_first(t).count() == 2
    rng = random.Random(1)
    rows = [(rng.choice("aabbbbc"), rng.randrange(120)) for _ in range(300)] + [("x", 5), ("x", 5), (None, 3), ("y", 7), ("y", 17)]
    want = set()
    for k in {k for k, _ in rows if k}:
        last = None
        for ms in sorted(ms for x, ms in rows if x == k):
            if last is None or ms - last > 10:
                want.add((k, ms))
                last = ms
    df = spark.createDataFrame([(k, ms, f"{ms:09}|{k}") for k, ms in rows], "txn_id string, ts_ms long, seq string")
    got = [(r.txn_id, r.ts_ms) for r in U.dedup_first(df, 10).collect()]
    assert len(got) == len(want) and set(got) == want
    assert U.dedup_first(df.limit(0)).count() == 0


def test_components_against_union_find(spark):
    random.seed(5)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(260)] + [(0, i) for i in range(500, 560)] + [(i, i + 1) for i in range(600, 640)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: top(x) for e in edges for x in e}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def sizes_by_walking(rows, window):
    """Of rows (ms, a, b or None): what each account reaches over the transfers up to then, and not older than the window."""
    out = []
    for i, (ms, a, _) in enumerate(rows):
        near = {}
        for then, x, y in rows[: i + 1]:
            if y is not None and (window is None or then >= ms - window):
                near.setdefault(x, set()).add(y)
                near.setdefault(y, set()).add(x)
        seen, todo = {a}, [a]
        while todo:
            for y in near.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out.append(len(seen))
    return out


def test_component_sizes_that_grow_and_shrink(spark):
    t = txns(spark, [{"user": a, "to": b, "at": i} for i, (a, b) in enumerate([("a", "b"), ("c", "d"), ("b", "c"), ("a", "d"), ("e", None), ("a", None), ("f", "f")])])
    linked = lambda t: t.select("seq", "ts_ms", F.col("user_id").alias("src"), F.col("counterparty_id").alias("dst"))
    sizes = lambda df: [r.component_size for r in df.orderBy("seq").collect()]
    assert sizes(G.component_size_asof(linked(t))) == [2, 2, 4, 4, 1, 4, 1]
    assert sizes(G.component_size_windowed(linked(t), 2000)) == [2, 2, 4, 4, 1, 2, 1]
    assert sizes(G.component_size_windowed(linked(t), 1000)) == [2, 2, 3, 2, 1, 1, 1]
    rng = random.Random(6)
    rows = [{"user": f"u{rng.randrange(16)}", "to": rng.choice([None, f"u{rng.randrange(16)}"]), "at": rng.randrange(40)} for _ in range(70)]
    t = linked(txns(spark, sorted(rows, key=lambda r: r["at"]))).cache()
    plain = [(r.ts_ms, r.src, r.dst) for r in t.orderBy("seq").collect()]
    for window, block in ((None, 1000), (None, 9), (6000, 1000), (6000, 20), (25000, 12)):
        assert sizes(G.component_sizes(t, window, block)) == sizes_by_walking(plain, window)
    assert G.component_size_asof(t.limit(0)).count() == 0


def test_ring_search_through_crowded_accounts(spark):
    """More transfers on both sides of an account than its newest, so that half paths are looked up rather than listed; against all paths."""
    rng = random.Random(9)
    cfg = type(D.DEFAULT)(max_edges=3)
    who = lambda: rng.choice(["hub", "hub", *"abcdefgh"])
    rows = [{"user": who(), "to": who(), "at": 1800 * i + rng.randrange(900)} for i in range(150)]
    e = G.build_edges(txns(spark, rows)).cache()
    edges = [(r.seq, r.src, r.dst, r.ts_ms) for r in e.orderBy("seq").collect()]
    want = {}
    for i, (seq, src, dst, ms) in enumerate(edges):
        mine = {}
        for j, x in enumerate(edges[:i]):
            mine.setdefault(x[1], []).append(j)
        live = {n: [j for j in js[-3:] if edges[j][3] >= ms - cfg.edge_ttl_ms] for n, js in mine.items()}

        def walk(node, path, hops):
            if node == src:
                return [src, *path]
            for j in live.get(node, []) if len(hops) < 4 else []:
                if edges[j][2] not in path and (got := walk(edges[j][2], [*path, edges[j][2]], [*hops, j])):
                    return got

        if got := walk(dst, [dst], []):
            want[seq] = got
    assert G.dense_accounts(G.ranked_edges(e, cfg), cfg).count() > 0
    assert {r.seq: list(r.cycle) for r in G.ring_cycles(e, cfg).collect()} == want and len(want) > 20
    short = type(D.DEFAULT)(max_edges=3, max_cycle=3)
    assert all(len(r.cycle) <= 4 for r in G.ring_cycles(e, short).collect())


def test_ring_search_writes_a_slice_at_a_time(spark, monkeypatch):
    """No table has more than a slice of the paths, an account of many starts is in several, and all slices together find what one finds and plain loops find."""
    rng = random.Random(4)
    who = lambda: f"u{rng.randrange(60)}" if rng.random() < 0.8 else "u0"
    rows = [{"user": who(), "to": who(), "at": 60 * i} for i in range(500)]
    e = materialize(G.build_edges(txns(spark, rows)))
    cfg = type(D.DEFAULT)(max_edges=20)
    starts = e.select("seq", "ts_ms", F.col("src").alias("goal"), F.col("dst").alias("node"))
    gone, drop = [], G.drop
    monkeypatch.setattr(G, "drop", lambda *tables: gone.extend(df.count() for df in tables) or drop(*tables))
    whole = {r.seq: (r.path, r.hops) for r in G.expand_paths(starts, e, cfg).collect()}
    largest = max(gone)
    gone.clear()
    assert {r.seq: (r.path, r.hops) for r in G.expand_paths(starts, e, cfg, few=6_000).collect()} == whole
    assert max(gone) < 0.7 * largest
    edges, mine, want = [(r.seq, r.src, r.dst) for r in e.orderBy("seq").collect()], {}, {}

    def walk(goal, node, path, hops):
        if node == goal:
            return path, [edges[j][0] for j in hops]
        for j in mine.get(node, [])[-20:] if len(hops) < 3 else []:
            if edges[j][2] not in path and (got := walk(goal, edges[j][2], [*path, edges[j][2]], [*hops, j])):
                return got

    for i, (seq, src, dst) in enumerate(edges):
        if got := walk(src, dst, [dst], []):
            want[seq] = got
        mine.setdefault(src, []).append(i)
    assert len(want) > 100 and all(whole[seq] == got for seq, got in want.items() if len(whole[seq][1]) < 4)


def test_a_busy_account_is_counted_in_chunks(spark):
    """A third of all rows are of one account; counts, sums and deviations against plain loops, with nulls and equal times."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", None, *"abcd"]), rng.randrange(30_000) * 500, rng.choice([None, *[float(x) for x in range(1, 900)]])) for _ in range(500)]
    df = spark.createDataFrame([(u, T0_MS + ms, a, f"{ms:09}|{i:04}") for i, (u, ms, a) in enumerate(rows)], "user_id string, ts_ms long, amount double, seq string")
    got = sorted(map(tuple, U.amount_zscore(U.velocity_features(df), chunk_ms=3_600_000).select("seq", "cnt1m", "cnt5m", "cnt1h", F.round("sum1h", 4), "amt_z").collect()))
    plain = sorted((f"{ms:09}|{i:04}", u, ms, a) for i, (u, ms, a) in enumerate(rows))
    for g, (seq, u, ms, a) in zip(got, plain, strict=True):
        mine = [(s, at, x) for s, v, at, x in plain if v == u and s <= seq]
        for i, size in enumerate((60_000, 300_000, 3_600_000)):
            b = size // 60
            near = [x for s, at, x in mine if (T0_MS + ms) // b * b - (size - b) <= (T0_MS + at) // b * b]
            assert g[1 + i] == len(near)
        before = [x for s, at, x in mine if s < seq and x is not None]
        z = 0.0
        if len(before) >= 10 and a is not None:
            mean = sum(before) / len(before)
            std = (sum((x - mean) ** 2 for x in before) / (len(before) - 1)) ** 0.5
            z = (a - mean) / std if std >= 1 else 0.0
        if a is not None or len(before) < 10:
            assert g[0] == seq and abs(g[5] - z) < 0.0051
    plan = U.velocity_features(df)._jdf.queryExecution().optimizedPlan().toString()
    assert all("_c#" in line or "_b#" in line for line in plan.splitlines() if "windowspecdefinition" in line)
    ranked = {r.seq: r.n for r in U.running_count(df.where("user_id is not null"), "user_id", "n").collect()}
    assert all(ranked[s] == sum(v == u and x <= s for x, v, *_ in plain) for s, u, *_ in plain if u)


def test_plans_read_each_table_few_times(spark):
    """A plan that doubles with each step fills the driver's memory, however few the rows."""
    t = txns(spark, [{"at": 60 * i, "user": f"u_{i}", "to": f"u_{i + 1}", "amount": 1000 - i} for i in range(12)])
    read = lambda df: len(re.findall("LogicalRDD|LocalRelation|Relation \\[", df._jdf.queryExecution().optimizedPlan().toString()))
    assert read(U.velocity_features(t)) <= 4
    depths = G.chain_depth(materialize(G.pass_through(G.build_edges(t))))
    assert read(depths) == 1 and [r.depth for r in depths.orderBy("seq").collect()] == [*range(1, 11), 10]
    f = D.features(t)
    assert read(f) <= 5 and [r.chain_depth for r in f.orderBy("seq").collect()] == [*range(11), 10]


def test_features_carry_few_columns(spark, monkeypatch):
    """Whole payments are written once, however many groups of features there are; each row stays one, repeated ones and one without a place too."""
    t = txns(spark, [{"at": 60 * i, "user": f"u_{i % 3}", "to": f"u_{(i + 1) % 3}", "amount": 1000 - i} for i in range(6)])
    t = t.union(t.where("txn_id = 't0002'")).union(t.where("txn_id = 't0005'").withColumn("seq", F.lit(None).cast("string")))
    written, write = [], D.materialize
    monkeypatch.setattr(D, "materialize", lambda df: written.append(df.columns) or write(df))
    got = D.features(t).select("txn_id", "cnt1h", "in_cycle").collect()
    assert sorted(r.txn_id for r in got) == sorted([*(f"t000{i}" for i in range(6)), "t0002", "t0005"])
    assert [c for c in written if "merchant_id" in c] == written[:1] and any(r.in_cycle for r in got)


def test_ids_that_come_once_move_no_rows(spark):
    rows = [(f"t{i}", i) for i in range(9)] + [(None, 4), ("t0", None)]
    once = U.dedup_first(spark.createDataFrame(rows, "txn_id string, ts_ms long"), 10)
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and sorted(map(tuple, once.collect())) == rows[:9]


def test_pulse_by_sketches(spark):
    """Rates over what the last ten seconds cover, and ranks within the stated error."""
    rng = random.Random(5)
    rows = [(T0_MS + rng.randrange(30_000), rng.randrange(100_000)) for _ in range(20_000)] + [(T0_MS + 95_500, 7), (T0_MS + 99_900, 9)]
    df = spark.createDataFrame(rows, "ts_ms long, latency_ms long").select(F.timestamp_millis("ts_ms").alias("ts"), "latency_ms")
    got = {(r.start_ms - T0_MS) // 1000: r for r in M.feed_pulse(df).collect()}
    assert got[70].tps == 2 / 4.5 and (got[70].p50, got[70].p99, got[70].samples) == (7, 9, 2) and got[80].tps == 0.0
    full, every = got[0], sorted(x for ms, x in rows if ms < T0_MS + 30_000)
    last = [ms for ms, _ in rows if T0_MS + 20_000 <= ms < T0_MS + 30_000]
    assert full.samples == 20_000 and abs(full.tps - len(last) * 1000 / (T0_MS + 30_000 - min(last))) < 1e-9
    assert all(abs(sum(x <= v for x in every) / len(every) - p) < 0.01 for v, p in ((full.p50, 0.5), (full.p99, 0.99)))
    d = df.withColumn("verdict", F.lit("ALLOW"))
    exact, near = M.latency_percentiles(d).first(), M.latency_percentiles(d, k=400).first()
    assert all(abs(exact[c] - near[c]) < 1500 for c in ("p50", "p95", "p99"))


def test_pulse_of_the_query_is_exact(spark, tmp_path):
    """Windows of more samples than a sketch holds; ranks, as the SQL defines them, are those of all samples sorted."""
    from sentrine.plans import catalog

    n = 20_000
    events = spark.range(n).selectExpr("id as event_id", f"timestamp_millis({T0_MS} + cast(id * 720 * 25000 / {n} as long)) as ts", "id % 50 as user_id", "'view' as event_type", "1.0D as value", "concat('{\"k\": ', id % 100, '}') as props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.start_ms - T0_MS) // 1000: r for r in catalog.QUERIES["feed_pulse"](spark, str(tmp_path)).collect()}
    for start, r in got.items():
        every = sorted(i * 37 % 500 for i in range(n) if start <= i * 25 / n < start + 30)
        assert (r.samples, r.p50, r.p99) == (len(every), every[-(-len(every) // 2) - 1], every[-(-len(every) * 99 // 100) - 1])
    assert max(r.samples for r in got.values()) == n
    few = spark.createDataFrame([(T0_MS, x) for x in (None, 9, 5, 7, 7)], "ts_ms long, latency_ms long").select(F.timestamp_millis("ts_ms").alias("ts"), "latency_ms")
    assert {tuple(r)[1:] for r in M.feed_pulse(few, k=None).collect()} == {tuple(r)[1:] for r in M.feed_pulse(few).collect()}
    assert {(r.samples, r.p50, r.p99) for r in M.feed_pulse(few, k=None).collect()} == {(5, 7, 9)}


def test_neighborhood_of_many_roots(spark):
    rows = [{"user": a, "to": b, "amount": m, "at": 60 * i} for i, (a, b, m) in enumerate([("a", "b", 100), ("b", "c", 98), ("c", "a", 97), ("c", "d", 5), ("d", "e", 5), ("x", "y", 1), ("a", "b", 3)])]
    e = G.build_edges(txns(spark, rows))
    n = G.Neighborhood(e, spark.createDataFrame([("a",), ("d",), ("lone",)], "root string"), T0_MS + 3_600_000)
    assert sorted(map(tuple, n.nodes.collect())) == [("a", "a", 0, 2), ("a", "b", 1, 1), ("a", "c", 2, 2), ("d", "d", 0, 1), ("d", "e", 1, 0), ("lone", "lone", 0, 0)]
    assert sorted((r.root, r.src, r.dst, r.amount, r.chain_depth) for r in n.edges.collect()) == [("a", "a", "b", 3.0, 0), ("a", "a", "b", 100.0, 0), ("a", "b", "c", 98.0, 1), ("d", "d", "e", 5.0, 1)]
    assert [r.cycle for r in n.cycles.collect()] == [["a", "b", "c", "a"]]
    assert sorted(map(tuple, n.sizes.collect())) == [("a", 5), ("d", 5), ("lone", 1)]


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    c = spark.createDataFrame([(f"c{i}", "CLOSED_FP", f"text {i}", ["R"], "RING", 10 + i) for i in range(40)], "case_id string, status string, summary string, fired_rules array<string>, fraud_type string, created_ms long")
    path = str(tmp_path / "index")
    files = lambda: {p.relative_to(path): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert C.upsert_closed_cases(path, c, 8).count() == 40
    was = files()
    newer = c.where("case_id = 'c7'").withColumns({"summary": F.lit("changed"), "created_ms": F.lit(99).cast("long")})
    for _ in range(2):
        got = {r.case_id: r.text for r in C.upsert_closed_cases(path, newer, 8).collect()}
        assert len(got) == 40 and got["c7"].startswith("changed") and got["c8"].startswith("text 8")
    mine = {f.parent.name for f in files()} - {f.parent.name for f in was if was[f] == files().get(f)}
    assert len(mine) == 1 and len({f.parent.name for f in was}) > 4
    assert C.upsert_closed_cases(path, c.limit(0), 8).count() == 40


def test_a_failing_check_stops_no_other(spark):
    def broken(cfg):
        raise RuntimeError("no such column")

    more = lambda cfg: D._signal(F.col("amount") > 100, "LARGE", F.lit(0.3), amount=F.col("amount"))
    got = D.assemble_decision(D.features(txns(spark, [{"at": 0}]), sizes=False), checks=(broken, more)).first()
    assert got.fired_rules == ["LARGE"] and got.verdict == "REVIEW"


def test_quantities_and_numbers(spark):
    rows = ["18 transactions in 60 seconds, limit 8", "Forwarded 97% of it", "13 805 at 2024-01-01T10:00:00Z", "see [3] and [0, 2]", "−0.38 below", "1,234.56"]
    got = [[(q.value, q.is_percent) for q in r.q] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").withColumn("q", X.extract_quantities(F.col("x"))).orderBy("i").collect()]
    assert got == [[(18, False), (60, False), (8, False)], [(97, True)], [(13805, False)], [], [(-0.38, False)], [(1234.56, False)]]
    pairs = [(0.42, 0.9997, False), (13500.0, 13499.3, True), (1.6, 1.5672, True), (4.0, 4.669, True), (12.0, 9.0, False)]
    df = spark.createDataFrame(pairs, "a double, b double, ok boolean")
    assert df.where(X.number_matches(F.col("a"), F.col("b")) != F.col("ok")).count() == 0


def test_categories_and_rounding(spark):
    df = spark.createDataFrame([("m_ELEC_",), ("m_ELEC_0001",), ("x",)], "m string")
    assert [r[0] for r in df.select(X.merchant_category(F.col("m"))).collect()] == ["UNKNOWN", "ELEC", "UNKNOWN"]
    assert spark.range(1).select(X.java_round(F.lit(-2.5), 0)).first()[0] == -2.0


def test_sweep_matches_the_hand_count(spark):
    p = [0.9, 0.8, 0.3, 0.7, 0.2, 0.1, 0.05, 0.0]
    df = spark.createDataFrame([(a, int(i < 3)) for i, a in enumerate(p)], "p double, y int")
    s = {r.threshold: (r.tp, r.fp, r.fn) for r in M.threshold_sweep(df).collect()}
    assert s[0.25] == (3, 1, 0) and s[0.75] == (2, 0, 1)
    sug = M.suggest_thresholds(M.threshold_sweep(df)).first()
    assert sug.block == 0.75 and sug.review == 0.25


def test_cases(spark):
    e = spark.createDataFrame([("c", i, s) for i, s in enumerate(["INVESTIGATING", "INVESTIGATING", "CLOSED_FP", "OPEN"])], "case_id string, event_id long, to_status string")
    assert [r.accepted for r in C.fold_case_status(e).orderBy("event_id").collect()] == [True, False, True, False]
    assert C.current_status(C.fold_case_status(e)).first().status == "CLOSED_FP"


def test_stream_dedup(spark, tmp_path):
    from sentrine.streaming.jobs import stream_dedup

    t = txns(spark, [{"at": i} for i in range(5)]).withColumn("ts", F.timestamp_millis("ts_ms"))
    t.union(t).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    q = stream_dedup(src).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_cases_open_once_whatever_the_batches(spark, tmp_path):
    from sentrine.streaming.jobs import open_cases_batch

    d = D.decide(txns(spark, [{"at": 3 * i} for i in range(11)])).cache()
    run = open_cases_batch(spark, str(tmp_path / "cases"))
    for number, n in ((0, 10), (1, 11), (1, 11)):  # the second batch is run again
        run(d.orderBy("seq").limit(n), number)
    flagged = d.where("verdict != 'ALLOW'").count()
    cases = spark.read.parquet(str(tmp_path / "cases"))
    assert flagged == 3 and cases.count() == 3 and cases.select("case_id").distinct().count() == 3


def test_stream_pulse(spark, tmp_path):
    from sentrine.streaming.jobs import stream_pulse

    t = txns(spark, [{"at": i} for i in range(40)]).select(F.timestamp_millis("ts_ms").alias("ts"), F.lit(5).cast("long").alias("latency_ms"))
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream_pulse(spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("pulse").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("pulse").collect())) == sorted(map(tuple, M.feed_pulse(t).collect())) and spark.table("pulse").count() > 3


def test_entry_imports():
    import __spark_entry__ as e

    assert len(e.queries()) > 80 and set(e.oracle_sql()) <= set(e.queries())
