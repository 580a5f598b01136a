"""Models: what trees say of each feature, against listing all sets of features; versions and saved frames."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrine.operators import models as ML
from sentrine.operators.decisions import FEATURES
from sentrine.sources import payments as P

COLS = [f"f_{k}" for k in FEATURES]


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        x = [float(rng.randrange(9)) for _ in COLS]
        rows.append((str(i), *x, int(x[0] + 2 * (x[3] > 4) * (x[7] > 2) - x[10] * (x[0] > 3) + rng.random() * 3 > 5)))
    return spark.createDataFrame(rows, "txn_id string, " + ", ".join(f"{c} double" for c in COLS) + ", y int").cache()


def expected(nodes, node, x, known):
    """What a tree gives when only ``known`` features are known: both ways by their share of rows where one is not."""
    if node["leftChild"] < 0:
        return node["prediction"]
    left, right = nodes[node["leftChild"]], nodes[node["rightChild"]]
    if (f := node["split"]["featureIndex"]) in known:
        return expected(nodes, left if x[f] <= node["split"]["leftCategoriesOrThreshold"][0] else right, x, known)
    share = left["impurityStats"][0] / node["impurityStats"][0]
    return share * expected(nodes, left, x, known) + (1 - share) * expected(nodes, right, x, known)


def test_trees_explained(spark, frame, tmp_path):
    model = ML.fit_model(frame, trees=4, depth=3)
    gbt = model.stages[1]
    gbt.write().save(str(tmp_path / "m"))
    trees = {}
    for r in spark.read.parquet(str(tmp_path / "m/data")).select("treeID", "nodeData.*").collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    value = lambda x, known: sum(2 * w * expected(trees[t], trees[t][0], x, known) for t, w in enumerate(gbt.treeWeights))
    rows = ML.explain(model, frame.limit(12)).collect()
    used = sorted({n["split"]["featureIndex"] for t in trees.values() for n in t.values() if n["leftChild"] >= 0})
    for r in rows[:6]:
        x, got = [r[c] for c in COLS], {c["feature"]: c["value"] for c in r["contributions"]}
        assert abs(r["base"] - value(x, set())) < 1e-9
        for j in used:
            others, want = [k for k in used if k != j], 0.0
            for n in range(len(others) + 1):
                w = math.factorial(n) * math.factorial(len(others) - n) / math.factorial(len(used))
                want += w * sum(value(x, {*s, j}) - value(x, set(s)) for s in combinations(others, n))
            assert abs(got[COLS[j]] - want) < 1e-9
        assert all(abs(got[c]) < 1e-12 for k, c in enumerate(COLS) if k not in used)


@pytest.mark.parametrize("kind", ["gbt", "linear"])
def test_contributions_add_up_to_the_log_odds(frame, kind):
    model = ML.fit_model(frame, kind=kind)
    rows = ML.explain(model, ML.score(model, frame)).collect()
    for r in rows:
        total = r["base"] + sum(c["value"] for c in r["contributions"])
        assert abs(total - math.log(r["p"] / (1 - r["p"]))) < 1e-6
    top = sorted(rows[0]["contributions"], key=lambda c: -abs(c["value"]))
    assert abs(top[0]["value"]) > 0 and np.isfinite(rows[0]["base"])


@pytest.mark.parametrize("kind", ["gbt", "linear"])
def test_missing_values_are_explained_as_they_are_scored(frame, kind):
    """NaN counts as 0 like null, and -inf is on the lower side of each question."""
    model = ML.fit_model(frame, kind=kind)
    odd = frame.limit(40).withColumns({"f_cnt1m": F.lit(float("nan")), "f_sum1h": F.lit(None).cast("double")})
    if kind == "gbt":
        odd = odd.unionByName(frame.limit(40).withColumns({"txn_id": F.concat(F.lit("i"), "txn_id")} | {c: F.lit(float("-inf")) for c in COLS[::3]}))
    rows = ML.explain(model, odd.join(ML.score(model, odd).select("txn_id", "p"), "txn_id")).collect()
    for r in rows:
        total = r["base"] + sum(c["value"] for c in r["contributions"])
        assert abs(total - math.log(r["p"] / (1 - r["p"]))) < 1e-6
    assert len(rows) == (80 if kind == "gbt" else 40)


def test_leaves_that_ask_many_features(spark):
    """Patterns beyond the tables: the same values as from every pattern at once."""
    rng = np.random.default_rng(3)
    d = 11
    leaf = ML.Leaf(1.5, np.arange(d), np.full(d, np.nan), rng.random(d), rng.random(d))
    x = rng.random((50, d))
    got = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").select(ML.tree_contributions([leaf], d)("x")).collect()
    assert np.allclose([r[0] for r in got], ML.leaf_shapley(leaf, x <= leaf.high), atol=1e-12)


def test_a_model_needs_both_classes_and_known_features(frame):
    with pytest.raises(ValueError):
        ML.fit_model(frame.where("y = 1"))
    with pytest.raises(ValueError):
        ML.score(ML.fit_model(frame, kind="linear"), frame.drop("f_cnt1m"))


def test_versions(spark, frame, tmp_path):
    for v, without in ((1, ()), (2, ("f_tier",))):
        ML.save_version(ML.fit_model(frame, without, "linear"), str(tmp_path), spark, v, rows=frame.count())
    spark.createDataFrame([(3, ["f_cnt1m", "f_moon"], 5)], "version long, features array<string>, rows long").write.parquet(str(tmp_path / "v3/meta"))
    got = ML.model_versions(spark, str(tmp_path)).collect()
    assert [(r.version, len(r.features), r.servable) for r in got] == [(3, 2, False), (2, 14, True), (1, 15, True)]


def test_saved_frames(spark, frame, tmp_path):
    P.save_training_frame(frame, str(tmp_path / "f"), 4)
    again = spark.read.parquet(str(tmp_path / "f"))
    assert again.count() == 600 and again.select("model_version").distinct().collect() == [(4,)]
    assert sorted(again.drop("model_version").columns) == sorted(frame.columns)
    with pytest.raises(Exception, match="already exists"):
        P.save_training_frame(frame, str(tmp_path / "f"), 4)


def test_event_time_falls_back(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", "2024-01-02 00:00:00"), (2, None, "2024-01-02 00:00:00"), (3, None, None)], "i int, ts string, record string")
    df = df.withColumns({"ts": F.to_timestamp("ts"), "record": F.to_timestamp("record")})
    got = {r.i: r.ts and r.ts.day for r in P.assign_event_time(df, "record").collect()}
    assert got == {1: 1, 2: 2, 3: None}
