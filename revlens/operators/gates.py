"""Efficiency and evidence-quality gates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import TARGET
from .validation import ValidationError

METRICS = ("runtime_ms", "peak_rss_mb", "throughput_per_second")


@dataclass(frozen=True)
class EfficiencyBudget:
    """Fixed default values of the regression budget."""

    max_runtime_regression: float = 0.20
    max_memory_regression: float = 0.20
    max_throughput_regression: float = 0.20
    minimum_repeats: int = 3

    def __post_init__(self) -> None:
        for share in (self.max_runtime_regression, self.max_memory_regression, self.max_throughput_regression):
            if not 0 <= share <= 1:
                raise ValidationError("regression budgets must be in [0, 1]")
        if self.minimum_repeats < 1:
            raise ValidationError("minimum_repeats must be positive")


def compare_efficiency(
    baseline: DataFrame,
    candidate: DataFrame,
    budget: EfficiencyBudget = EfficiencyBudget(),
    keys: Sequence[str] = TARGET,
) -> DataFrame:
    """Relative change per metric for targets measured on both sides.

    A metric missing on one side has no delta; lower throughput is the worse side.
    """
    keys = list(keys)
    before = baseline.select(*keys, *[F.col(m).alias(f"_b_{m}") for m in METRICS], F.col("repeats").alias("baseline_repeats"))
    after = candidate.select(*keys, *[F.col(m).alias(f"_c_{m}") for m in METRICS], F.col("repeats").alias("candidate_repeats"))
    deltas = before.join(after, keys).select(
        *keys, "baseline_repeats", "candidate_repeats",
        *[((F.col(f"_c_{m}") - F.col(f"_b_{m}")) / F.col(f"_b_{m}")).alias(m) for m in METRICS],
    )
    exceeded = F.array_compact(F.array(
        F.when(F.col("peak_rss_mb") > budget.max_memory_regression, "peak_rss_mb"),
        F.when(F.col("runtime_ms") > budget.max_runtime_regression, "runtime_ms"),
        F.when(F.col("throughput_per_second") < -budget.max_throughput_regression, "throughput_per_second"),
    ))
    repeats = F.least("baseline_repeats", "candidate_repeats")
    observed = F.coalesce(*METRICS).isNotNull()
    return deltas.select(
        *keys, "baseline_repeats", "candidate_repeats",
        F.map_filter(
            F.map_from_arrays(F.array(*map(F.lit, METRICS)), F.array(*METRICS)),
            lambda name, value: value.isNotNull(),
        ).alias("deltas"),
        exceeded.alias("exceeded"),
        F.least(F.lit(1.0), repeats / float(max(budget.minimum_repeats, 5))).alias("confidence"),
        F.when(~observed | (repeats < budget.minimum_repeats), "unknown")
        .when(F.size(exceeded) > 0, "fail").otherwise("pass").alias("status"),
    )


def evidence_quality(
    inputs: DataFrame, ood_threshold: float = 0.70, minimum_context_coverage: float = 0.80
) -> DataFrame:
    """Status, confidence and tags of a detector's own evidence; works on streams too."""
    unsupported = ~F.col("schema_supported")
    partial = F.col("context_coverage") < minimum_context_coverage
    strange = F.col("ood_score") >= ood_threshold
    unverifiable = unsupported | partial
    return inputs.withColumns({
        "status": F.when(unverifiable, "unknown").when(strange, "fail").otherwise("pass"),
        "confidence": F.when(unverifiable, 0.0).otherwise(1.0 - F.col("ood_score")),
        "tags": F.array_compact(F.array(
            F.when(strange, "OOD_INPUT"),
            F.when(partial, "REPOSITORY_CONTEXT_PARTIAL"),
            F.when(unsupported, "SCHEMA_UNSUPPORTED"),
        )),
    })
