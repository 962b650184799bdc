"""Oracle evaluation of an analyzer, and metrics of group-disjoint predictions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import short_digest
from ..functions.paths import metric_key
from ..session import broadcast_if_bounded, materialise
from .security import RULES, Rule, scan_code
from .validation import ValidationError

UNSUPPORTED_NOTE = "oracle is outside the lightweight analyzer rule set"
RANGE_ROWS = 1_000_000


# --- analyzer against oracle -------------------------------------------------------


def oracle_results(fixtures: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Matched rules and detection per fixture.

    ``fixtures``: ``fixture_id, oracle, content, expected_detection, supported_rule_ids``.
    An oracle without supported rules is kept apart and never counts as detected.
    """
    hits = scan_code(fixtures.select("fixture_id", F.col("content").alias("code")), rules)
    matched = hits.groupBy("fixture_id").agg(F.array_sort(F.collect_set("rule_id")).alias("_m"))
    joined = fixtures.drop("content").join(matched, "fixture_id", "left")
    found = F.coalesce("_m", F.array().cast("array<string>"))
    supported = F.size("supported_rule_ids") > 0
    return joined.select(
        "fixture_id", "oracle", (supported & F.arrays_overlap(found, "supported_rule_ids")).alias("detected"),
        "expected_detection", found.alias("matched_rule_ids"), supported.alias("supported"),
        F.array_compact(F.array(F.when(~supported, UNSUPPORTED_NOTE))).alias("notes"),
    )


def oracle_summary(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts over supported oracles; an undefined ratio is null, never 0."""
    expected, detected, supported = F.col("expected_detection"), F.col("detected"), F.col("supported")
    counts = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(supported).alias("supported"),
        F.count_if(supported & expected & detected).alias("true_positive"),
        F.count_if(supported & expected & ~detected).alias("false_negative"),
        F.count_if(supported & ~expected & ~detected).alias("true_negative"),
        F.count_if(supported & ~expected & detected).alias("false_positive"),
    )
    hit = F.col("true_positive")
    precision = F.try_divide(hit, hit + F.col("false_positive"))
    recall = F.try_divide(hit, hit + F.col("false_negative"))
    return counts.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def detection_regressions(summary: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Violations of a pinned baseline (``keys, revision, detected``); the baseline is only read."""
    joined = baseline.join(summary.select(*keys, "true_positive"), list(keys), "left")
    current = F.coalesce("true_positive", F.lit(0))
    detail = (
        F.when(F.length(F.coalesce("revision", F.lit(""))) != 40, "revision must have 40 characters")
        .when(F.coalesce("detected", F.lit(-1)) < 0, "detected count must not be negative")
        .when(current < F.col("detected"), F.format_string("baseline %d, current %d", "detected", current))
    )
    return joined.select(*keys, detail.alias("detail")).filter(F.col("detail").isNotNull())


# --- training preconditions and folds ----------------------------------------------


def labelled(samples: DataFrame) -> DataFrame:
    return samples.filter(F.col("label") != "unknown")


def training_counts(samples: DataFrame) -> DataFrame:
    return labelled(samples).agg(
        F.count(F.lit(1)).alias("samples"), F.count_distinct("label").alias("classes"),
        F.count_distinct("group_id").alias("groups"),
    )


def require_trainable(samples: DataFrame, folds: int) -> int:
    """Number of folds to use, after checking sample, class and group counts."""
    row = training_counts(samples).first()
    if row["samples"] < 12:
        raise ValidationError("at least 12 labelled samples are required")
    if row["classes"] < 2:
        raise ValidationError("at least two authorship classes are required")
    usable = min(folds, row["groups"])
    if usable < 2:
        raise ValidationError("at least two repository/author groups are required")
    return usable


def assign_folds(samples: DataFrame, folds: int) -> DataFrame:
    """Add ``fold`` so that no group is split and folds have similar sizes.

    Groups above one percent of a fold, fewer than ``folds * 100``, are placed greedily,
    largest first, into the lightest fold; the smaller ones are spread by hash.
    """
    sizes = materialise(samples.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")), "groups")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    heavy = sizes.filter(F.col("n") * (folds * 100) > total)
    loads = [0] * folds
    placed = []
    for row in sorted(heavy.collect(), key=lambda item: (-item["n"], str(item["group_id"]))):
        fold = loads.index(min(loads))
        loads[fold] += row["n"]
        placed.append((row["group_id"], fold))
    schema = T.StructType([sizes.schema["group_id"], T.StructField("_fold", T.IntegerType())])
    table = samples.sparkSession.createDataFrame(placed, schema)
    hashed = F.pmod(F.xxhash64("group_id"), F.lit(folds)).cast("int")
    return samples.join(F.broadcast(table), "group_id", "left").withColumn(
        "fold", F.coalesce("_fold", hashed)
    ).drop("_fold")


# --- classification metrics ----------------------------------------------------------


def probability(label: str) -> str:
    return f"p_{label}"


def _pick(column: str, classes: Sequence[str]) -> Column:
    """Probability column of the class a label column names."""
    return reduce(
        lambda chain, name: chain.when(F.col(column) == name, F.col(probability(name))),
        classes[1:], F.when(F.col(column) == classes[0], F.col(probability(classes[0]))),
    )


def with_prediction(frame: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Most probable class (first of equals) and its probability."""
    best = F.greatest(*[F.col(probability(name)) for name in classes])
    first = reduce(
        lambda chain, name: chain.when(F.col(probability(name)) == best, name),
        classes[1:], F.when(F.col(probability(classes[0])) == best, classes[0]),
    )
    return frame.withColumns({"predicted": first, "confidence": best})


def confusion(predictions: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Dense ``label, predicted, n`` over all class pairs."""
    counts = predictions.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    pairs = [(actual, guess) for actual in classes for guess in classes]
    grid = predictions.sparkSession.createDataFrame(pairs, "label STRING, predicted STRING")
    return grid.join(counts, ["label", "predicted"], "left").fillna(0, ["n"])


def confusion_names(matrix: DataFrame) -> DataFrame:
    return matrix.select(
        F.concat(F.lit("confusion_"), metric_key(F.col("label")), F.lit("_as_"), metric_key(F.col("predicted"))).alias("metric"),
        F.col("n").cast("double").alias("value"),
    )


def class_metrics(matrix: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; a division by zero counts 0."""
    sides = F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"),
                 F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(F.lit(0)).alias("hit")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"),
                 F.lit(0).cast("long").alias("hit")),
    )).alias("s")
    sums = matrix.select(*keys, sides).groupBy(*keys, F.col("s.class").alias("class")).agg(
        F.sum("s.support").alias("support"), F.sum("s.guessed").alias("guessed"), F.sum("s.hit").alias("hit")
    )
    ratio = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0))
    hit, support, guessed = F.col("hit"), F.col("support"), F.col("guessed")
    return sums.select(
        *keys, "class", ratio(hit, guessed).alias("precision"), ratio(hit, support).alias("recall"),
        ratio(2 * hit, support + guessed).alias("f1"), "support", "guessed", "hit",
    )


def overall_metrics(per_class: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Macro and weighted F1, balanced accuracy, multiclass correlation."""
    seen = (F.col("support") + F.col("guessed")) > 0
    sums = per_class.groupBy(*keys).agg(
        F.avg(F.when(seen, F.col("f1"))).alias("macro_f1"),
        F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)).alias("weighted_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.sum("hit").cast("double").alias("_c"), F.sum("support").cast("double").alias("_s"),
        F.sum(F.col("support").cast("double") * F.col("guessed")).alias("_pt"),
        F.sum(F.col("guessed").cast("double") * F.col("guessed")).alias("_pp"),
        F.sum(F.col("support").cast("double") * F.col("support")).alias("_tt"),
    )
    spread = F.sqrt((F.col("_s") * F.col("_s") - F.col("_pp")) * (F.col("_s") * F.col("_s") - F.col("_tt")))
    mcc = F.coalesce(F.try_divide(F.col("_c") * F.col("_s") - F.col("_pt"), spread), F.lit(0.0))
    return sums.select(*keys, "macro_f1", "weighted_f1", "balanced_accuracy", mcc.alias("mcc"))


def probability_metrics(predictions: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Log loss, multiclass Brier score and the counts, in one aggregate."""
    truth = _pick("label", classes)
    tiny = 2.220446049250313e-16
    square = reduce(lambda a, b: a + b, [
        F.pow(F.col(probability(name)) - F.when(F.col("label") == name, 1.0).otherwise(0.0), 2) for name in classes
    ])
    return predictions.agg(
        (-F.avg(F.ln(F.least(F.greatest(truth, F.lit(tiny)), F.lit(1 - tiny))))).alias("log_loss"),
        F.avg(square).alias("multiclass_brier"), F.count(F.lit(1)).cast("double").alias("samples"),
        F.count_distinct("group_id").cast("double").alias("groups"),
    )


def calibration_bins(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Count, accuracy and mean confidence per confidence bin; the last bin is closed."""
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return predictions.groupBy(at.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("label") == F.col("predicted"), 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg("confidence").alias("mean_confidence"),
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    gap = F.abs(F.col("accuracy") - F.col("mean_confidence")) * F.col("n")
    return bins.agg((F.sum(gap) / F.sum("n")).alias("ece_10bin"))


def running_totals(
    frame: DataFrame, group: str, order: str, values: Sequence[str], rows_in_range: int = RANGE_ROWS
) -> DataFrame:
    """Add ``below_<value>``: the sum over smaller ``order`` within ``group``.

    ``order`` is distinct within a group. A distributed prefix sum: rows are dealt into ranges of (group,
    order) of about ``rows_in_range`` rows, so every group is cut at its own values and their number grows
    with the rows. A window runs inside each range, and what earlier ranges of the group hold is
    summed over one row for each range. No window spans a group's rows.
    """
    stored = materialise(frame, "totals")
    ranges = max(1, math.ceil(stored.count() / rows_in_range))
    # The written range number stays as it is, whatever is computed again later.
    ranged = materialise(stored.repartitionByRange(ranges, group, order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(group, "_range").agg(*[F.sum(name).alias(f"_t_{name}") for name in values])
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(totals.select(
        group, "_range", *[F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_o_{name}") for name in values]
    ), "offsets")
    inside = Window.partitionBy(group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(broadcast_if_bounded(offsets), [group, "_range"])
    return joined.select(
        *frame.columns,
        *[(F.col(f"_o_{name}") + F.coalesce(F.sum(name).over(inside), F.lit(0))).alias(f"below_{name}") for name in values],
    )


def ranking_metrics(predictions: DataFrame, classes: Sequence[str]) -> DataFrame:
    """One-against-rest area under ROC and average precision per class; null if undefined.

    Equal scores collapse to one row with counts before anything is ordered.
    """
    scores = predictions.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("class"), F.col(probability(name)).alias("score"),
                 F.when(F.col("label") == name, 1).otherwise(0).cast("long").alias("pos"))
        for name in classes
    ])).alias("s")).select("s.*")
    tied = scores.groupBy("class", "score").agg(
        F.sum("pos").alias("pos"), (F.count(F.lit(1)) - F.sum("pos")).alias("neg")
    )
    ranked = materialise(running_totals(tied, "class", "score", ("pos", "neg")), "ranked")
    sums = ranked.groupBy("class").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    joined = ranked.join(F.broadcast(sums), "class")
    true_above = (F.col("all_pos") - F.col("below_pos")).cast("double")
    false_above = F.col("all_neg") - F.col("below_neg")
    return joined.groupBy("class").agg(
        F.try_divide(
            F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2.0)),
            F.max("all_pos").cast("double") * F.max("all_neg"),
        ).alias("roc_auc"),
        F.try_divide(
            F.sum(F.col("pos") * (true_above / (true_above + false_above))), F.max("all_pos").cast("double")
        ).alias("average_precision"),
    )


def macro_ranking(per_class: DataFrame) -> DataFrame:
    """Means over the classes of both areas; null where the area of any class is undefined."""
    whole = F.count("roc_auc") == F.count(F.lit(1))
    return per_class.agg(
        F.when(whole, F.avg("roc_auc")).alias("roc_auc_ovr_macro"), F.when(whole, F.avg("average_precision")).alias("pr_auc_macro"))


def metric_table(predictions: DataFrame, classes: Sequence[str], features: int, fit_seconds: float | None = None,
                 replicates: int = 200, seed: int = 42) -> DataFrame:
    """``metric, value``: everything that is published of a model's out-of-fold predictions.

    ``features`` is the number of columns the model saw; ``fit_seconds`` is left out where not known, as
    are values that are undefined. All parts are aggregates of the predictions, of at most classes squared rows.
    """
    matrix = confusion(predictions, classes)
    per_class = class_metrics(matrix)

    def listed(frame: DataFrame, prefix: str = "group_oof_") -> DataFrame:
        return frame.select(*[F.col(name).cast("double").alias(f"{prefix}{name}") for name in frame.columns]).unpivot(
            [], [f"{prefix}{name}" for name in frame.columns], "metric", "value")

    scores = probability_metrics(predictions, classes)
    plain = [("features", float(features))] + ([("fit_seconds", float(fit_seconds))] if fit_seconds is not None else [])
    by_class = per_class.select(F.explode(F.array(*[
        F.struct(F.concat(F.lit("class_"), metric_key(F.col("class")), F.lit(f"_{name}")).alias("metric"), F.col(name).cast("double").alias("value"))
        for name in ("precision", "recall", "f1", "support")
    ])).alias("m")).select("m.*")
    parts = [
        listed(overall_metrics(per_class)), listed(scores.select("log_loss", "multiclass_brier")), listed(scores.select("samples", "groups"), ""),
        listed(calibration_error(calibration_bins(predictions))), listed(bootstrap_macro_f1(predictions, replicates, seed)),
        listed(macro_ranking(ranking_metrics(predictions, classes))), by_class, confusion_names(matrix),
        predictions.sparkSession.createDataFrame(plain, "metric STRING, value DOUBLE"),
    ]
    return reduce(DataFrame.unionByName, parts).filter(F.col("value").isNotNull())


def poisson_thresholds(terms: int = 12) -> list[float]:
    """Cumulative probabilities of a unit-rate Poisson variable."""
    return list(accumulate(math.exp(-1) / math.factorial(k) for k in range(terms)))


def _poisson_draw(uniform: Column) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, poisson_thresholds())), lambda cut: cut <= uniform))


def bootstrap_macro_f1(
    predictions: DataFrame, replicates: int = 200, seed: int = 42
) -> DataFrame:
    """2.5 and 97.5 percent points of macro F1 over resamples of whole groups.

    A group's weight in a replicate is a Poisson draw hashed from (seed, group, replicate),
    so resampling needs no shared state; groups enter as confusion counts, not as samples.
    """
    cells = predictions.groupBy("group_id", "label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    drawn = cells.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    named = F.concat_ws(":", F.lit(str(seed)), "group_id", F.col("replicate").cast("string"))
    uniform = F.conv(short_digest(named, 8), 16, 10).cast("long") / float(1 << 32)
    weighted = drawn.withColumn("n", F.col("n") * _poisson_draw(uniform)).filter(F.col("n") > 0)
    matrix = weighted.groupBy("replicate", "label", "predicted").agg(F.sum("n").alias("n"))
    scores = overall_metrics(class_metrics(matrix, ("replicate",)), ("replicate",))
    points = F.percentile("macro_f1", [0.025, 0.975])
    return scores.agg(points[0].alias("macro_f1_ci_low"), points[1].alias("macro_f1_ci_high"))


# --- estimates -----------------------------------------------------------------------


def estimates(frame: DataFrame, confidence_threshold: float = 0.60, ood_threshold: float = 0.70) -> DataFrame:
    """Authorship estimate per row, or an abstention.

    Needs ``p_human, p_ai, p_hybrid`` (null for a class the model does not know),
    ``ood_score`` and ``public_reuse_fraction``.
    """
    classes = ("human", "ai", "hybrid")
    filled = {probability(name): F.coalesce(probability(name), F.lit(0.0)) for name in classes}
    total = reduce(lambda a, b: a + b, filled.values())
    scaled = frame.withColumns({name: value / total for name, value in filled.items()})
    chosen = with_prediction(scaled, classes).withColumn(
        "abstained",
        (F.col("confidence") < confidence_threshold) | (F.col("ood_score") >= ood_threshold),
    )
    organic = (F.col("p_human") + 0.5 * F.col("p_hybrid")) * (1 - F.col("public_reuse_fraction"))
    return chosen.withColumns({
        "predicted_label": F.when(F.col("abstained"), "unknown").otherwise(F.col("predicted")),
        "organic_fraction": F.when(~F.col("abstained"), F.least(F.greatest(organic, F.lit(0.0)), F.lit(1.0))),
        "claim": F.when(
            F.col("abstained"), "Unknown/OOD: available evidence does not support an authorship estimate."
        ).otherwise(F.concat(
            F.lit("Statistically most consistent with "), "predicted", F.lit("; this is not proof of authorship.")
        )),
    }).drop("predicted")
