import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.operators import evaluate, features, learn, validation

CLASSES = ("ai", "human", "hybrid")
TEMPLATES = {
    "human": "def f{i}(a):\n    # note\n    return a + {i}\n",
    "ai": "class Thing{i}:\n    \"\"\"Doc.\"\"\"\n    def run(self, value: int) -> int:\n        if value > {i}:\n            return value\n        raise ValueError\n",
    "hybrid": "import os\nfor x in range({i}):\n    print(x, os.getcwd())\n",
}


@pytest.fixture(scope="module")
def feature_rows(spark):
    rows = [
        (f"{label}-{group}", f"g{group}", "ruby", template.replace("{i}", str(group)), "m", 1, group, 1, label)
        for group in range(9) for label, template in TEMPLATES.items()
    ]
    frame = spark.createDataFrame(rows, "sample_id STRING, group_id STRING, language STRING, code STRING, commit_message STRING, "
                                  "files_changed BIGINT, additions BIGINT, deletions BIGINT, label STRING")
    return features.sample_features(frame)


def test_fit_and_predict(spark, feature_rows):
    config = learn.ModelConfig(folds=3, trees=10, max_depth=4, novelty_trees=20)
    model = learn.fit(feature_rows, config)
    assert model.classes == CLASSES
    held = evaluate.with_prediction(model.out_of_fold, CLASSES)
    assert held.count() == 27
    assert evaluate.overall_metrics(evaluate.class_metrics(evaluate.confusion(held, CLASSES))).first()["macro_f1"] > 0.9
    result = model.predict(feature_rows.withColumn("public_reuse_fraction", F.lit(0.0))).collect()
    assert len(result) == 27
    for row in result:
        assert abs(row["p_ai"] + row["p_human"] + row["p_hybrid"] - 1) < 1e-6
        assert 0 <= row["ood_score"] <= 1
        assert (row["organic_fraction"] is None) == row["abstained"]
        assert (row["predicted_label"] == "unknown") == row["abstained"]
    assert {round(max(r["ood_score"] for r in result), 6), round(min(r["ood_score"] for r in result), 6)} == {0.0, 1.0}


def test_preconditions(spark, feature_rows):
    with pytest.raises(validation.ValidationError):
        evaluate.require_trainable(feature_rows.limit(5), 5)
    with pytest.raises(validation.ValidationError):
        evaluate.require_trainable(feature_rows.withColumn("label", F.lit("ai")), 5)
    with pytest.raises(validation.ValidationError):
        evaluate.require_trainable(feature_rows.withColumn("group_id", F.lit("g")), 5)


@pytest.mark.parametrize("groups", [4, 40, 1500])
def test_folds_never_split_a_group(spark, groups):
    rows = [(f"g{g}", i) for g in range(groups) for i in range(300 if g == 0 else g % 7 + 1)]
    frame = spark.createDataFrame(rows, "group_id STRING, i INT")
    placed = evaluate.assign_folds(frame, 4)
    assert placed.groupBy("group_id").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert placed.count() == len(rows) and placed.select("fold").distinct().count() == 4


def test_far_point_is_novel(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(400)] + [(999, 9.0, -9.0, 9.0)]
    frame = spark.createDataFrame(rows, "sample_id INT, a DOUBLE, b DOUBLE, c DOUBLE")
    model = learn.fit_novelty(frame, "sample_id", learn.ModelConfig(novelty_trees=50, novelty_sample=64), ("a", "b", "c"))
    assert len(model.trees) == 50
    top = model.ood_scores(frame).orderBy(F.col("ood_score").desc()).first()
    assert top["sample_id"] == 999 and top["ood_score"] == pytest.approx(1.0)


def test_sigmoids_follow_the_scores(spark):
    rng = random.Random(2)
    rows = [(fold, "ai", s := rng.random(), int(rng.random() < s)) for fold in (0, 1) for _ in range(400)]
    fitted = learn.fit_sigmoids(spark.createDataFrame(rows, "fold INT, class STRING, score DOUBLE, pos BIGINT"))
    for slope, offset in fitted.values():
        assert slope > 1 and -slope < offset < 0


def direct_auc(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def direct_precision(pairs):
    total, seen, result = sum(y for _, y in pairs), 0, 0.0
    for cut in sorted({s for s, _ in pairs}, reverse=True):
        above = [y for s, y in pairs if s >= cut]
        result += (sum(above) - seen) / total * sum(above) / len(above)
        seen = sum(above)
    return result


def test_ranking_matches_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        label = rng.choice(CLASSES)
        raw = [rng.randrange(1, 9) + (3 if name == label else 0) for name in CLASSES]
        rows.append((str(i), f"g{i % 11}", label, *[value / sum(raw) for value in raw]))
    frame = spark.createDataFrame(rows, "sample_id STRING, group_id STRING, label STRING, p_ai DOUBLE, p_human DOUBLE, p_hybrid DOUBLE")
    got = {r["class"]: r for r in evaluate.ranking_metrics(frame, CLASSES).collect()}
    for index, name in enumerate(CLASSES):
        pairs = [(row[3 + index], int(row[2] == name)) for row in rows]
        assert got[name]["roc_auc"] == pytest.approx(direct_auc(pairs))
        assert got[name]["average_precision"] == pytest.approx(direct_precision(pairs))
    scored = evaluate.with_prediction(frame, CLASSES)
    low, high = evaluate.bootstrap_macro_f1(scored, 100).first()
    middle = evaluate.overall_metrics(evaluate.class_metrics(evaluate.confusion(scored, CLASSES))).first()["macro_f1"]
    assert low < middle < high and high - low < 0.3


def test_confident_predictions_stay_in_the_last_bin(spark):
    frame = spark.createDataFrame([("ai", "ai", 1.0), ("ai", "human", 0.95), ("ai", "ai", 0.1)], "label STRING, predicted STRING, confidence DOUBLE")
    bins = {r["bin"]: r["n"] for r in evaluate.calibration_bins(frame).collect()}
    assert bins == {9: 2, 1: 1}


def test_analyzer_gaps_stay_misses(spark):
    rows = [("app", "CWE-089", "db.run(q)", True, ["SQL-FORMAT"]), ("ctl", "CWE-089", "x = 1", False, ["SQL-FORMAT"]), ("odd", "CWE-1", "eval(x)", True, [])]
    frame = spark.createDataFrame(rows, "fixture_id STRING, oracle STRING, content STRING, expected_detection BOOLEAN, supported_rule_ids ARRAY<STRING>")
    results = evaluate.oracle_results(frame)
    summary = evaluate.oracle_summary(results).first()
    assert (summary["total"], summary["supported"], summary["false_negative"], summary["true_negative"]) == (3, 2, 1, 1)
    assert summary["recall"] == 0.0 and summary["precision"] is None and summary["f1"] is None
    odd = results.filter("fixture_id = 'odd'").first()
    assert not odd["detected"] and odd["matched_rule_ids"] == ["PY-EVAL"] and odd["notes"] == [evaluate.UNSUPPORTED_NOTE]


def test_folds_train_together_in_few_tasks(spark, monkeypatch):
    """Each fold waits for the others, and a few rows of many partitions train in one task."""
    import threading

    together, tasks = threading.Barrier(3, timeout=60), []

    def train(training, config):
        tasks.append(training.rdd.getNumPartitions())
        together.wait()
        raise InterruptedError

    monkeypatch.setattr(learn, "_fit_forest", train)
    rows = spark.range(60).repartition(4).select(
        F.col("id").alias("sample_id"), F.concat(F.lit("g"), F.col("id") % 12).alias("group_id"),
        F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("id") % 3 + 1).cast("int")).alias("label"),
        *[F.col("id").cast("double").alias(name) for name in learn.FEATURE_NAMES],
    )
    with pytest.raises(InterruptedError):
        learn.cross_fit(rows, learn.ModelConfig(folds=3))
    assert tasks == [1, 1, 1]


def test_passes_send_no_trees_and_few_tasks_score(spark, feature_rows, monkeypatch):
    """Rows keep their nodes, which changes no tree; a few rows of many partitions are scored in one task."""
    fitted, fit = [], learn.RandomForestClassifier.fit

    def keep(estimator, training):
        model = fit(estimator, training)
        plain = fit(estimator.copy().setCacheNodeIds(False), training)
        fitted.append((estimator.getCacheNodeIds(), model.toDebugString.partition("\n")[2], plain.toDebugString.partition("\n")[2]))
        return model

    monkeypatch.setattr(learn.RandomForestClassifier, "fit", keep)
    model = learn.fit(feature_rows.repartition(4), learn.ModelConfig(folds=3, trees=5, novelty_trees=5))
    assert len(fitted) == 3
    assert all(kept and with_ids == without for kept, with_ids, without in fitted)
    assert model.calibrated(feature_rows.repartition(4)).rdd.getNumPartitions() == 1


def test_driver_holds_few_trees_at_once(spark, feature_rows, monkeypatch):
    """A forest grows and judges in batches of bounded nodes; its scores are the means over all trees of the fold."""
    batches, fit = [], learn._fit_forest

    def keep(training, config):
        model = fit(training, config)
        batches.append((frozenset(r[0] for r in training.select("sample_id").collect()), config, model))
        return model

    monkeypatch.setattr(learn, "_fit_forest", keep)
    monkeypatch.setattr(learn, "NODES_AT_ONCE", 90, raising=False)
    config = learn.ModelConfig(folds=3, trees=10, novelty_trees=5)
    model = learn.fit(feature_rows, config)
    by_fold = {}
    for rows, own, forest in batches:
        by_fold.setdefault(rows, []).append((own, forest))
    assert len(by_fold) == 3 and len(batches) > 3
    for rows, grown in by_fold.items():
        assert sum(own.trees for own, _ in grown) == config.trees and len({own.seed for own, _ in grown}) == len(grown)
        assert all(own.trees == 1 or forest.totalNumNodes <= 2 * 90 for own, forest in grown)
        want = {}
        for own, forest in grown:
            for row in forest.transform(learn.feature_matrix(feature_rows)).collect():
                want[row["sample_id"]] = want.get(row["sample_id"], 0) + row["probability"].toArray() * own.trees / config.trees
        for row in model.out_of_fold.collect():
            if row["sample_id"] not in rows:
                assert [row["p_ai"], row["p_human"], row["p_hybrid"]] == pytest.approx(list(want[row["sample_id"]]))
    found = model.calibrated(feature_rows).collect()
    assert len(found) == 27 and all(abs(r["p_ai"] + r["p_human"] + r["p_hybrid"] - 1) < 1e-9 for r in found)
