"""Checks that list every offending record as ``table, key, rule, detail`` rows.

Checks are lazy filters; :func:`require_clean` turns a non-empty list into an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import is_blank
from ..schemas import SCOPES_WITHOUT_AUTHORSHIP, TARGET, WEAK_LABEL_SOURCES

# Columns a corpus manifest must have.
MANIFEST_COLUMNS = (
    "sample_id", "repository_id", "group_id", "language", "path", "label", "label_source",
    "generator_family",
)
# Fields each external payload must fill.
SWEBENCH_FIELDS = ("instance_id", "repo", "base_commit", "problem_statement", "patch")
DEVGPT_FIELDS = ("URL", "MentionedURL")

AWARE_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})$"


class ValidationError(ValueError):
    """Raised by strict checks."""


def _key(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(name).cast("string"), F.lit("null")) for name in columns])


def violations(
    df: DataFrame, table: str, key: Sequence[str], rule: str, condition: Column, detail: Column
) -> DataFrame:
    return df.filter(condition).select(
        F.lit(table).alias("table"), _key(key).alias("key"), F.lit(rule).alias("rule"),
        detail.cast("string").alias("detail"),
    )


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValidationError(f"missing columns: {missing}")


def require_manifest(df: DataFrame, has_code_root: bool) -> None:
    require_columns(df, MANIFEST_COLUMNS)
    if "code" not in df.columns and not has_code_root:
        raise ValidationError("manifest needs an inline code column or a code root")


def require_positive(name: str, value: int, least: int = 1) -> None:
    if value < least:
        raise ValidationError(f"{name} must be at least {least}")


def duplicates(df: DataFrame, table: str, key: Sequence[str]) -> DataFrame:
    counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return violations(counted, table, key, "duplicate_key", F.col("_n") > 1, F.col("_n"))


def repeated_findings(findings: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """Dimensions a request has more than one finding for; :func:`assess.assess` routes no such request."""
    return duplicates(findings, "findings", (*keys, "dimension"))


def not_in_domain(
    df: DataFrame, table: str, key: Sequence[str], column: str, domain: Sequence[str]
) -> DataFrame:
    value = F.col(column)
    return violations(
        df, table, key, f"domain:{column}", value.isNull() | ~value.isin(*domain), F.coalesce(value, F.lit("null"))
    )


def weak_labels(df: DataFrame, table: str = "code_samples", key: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Labelled rows whose label rests on a heuristic or on nothing."""
    condition = (F.col("label") != "unknown") & F.col("label_source").isin(*WEAK_LABEL_SOURCES)
    return violations(df, table, key, "weak_label_source", condition, F.col("label_source"))


def escaping_paths(df: DataFrame, table: str, key: Sequence[str], column: str = "path") -> DataFrame:
    return violations(df, table, key, f"escapes_root:{column}", paths.escapes_root(F.col(column)), F.col(column))


def blank_text(df: DataFrame, table: str, key: Sequence[str], column: str) -> DataFrame:
    value = F.coalesce(F.col(column), F.lit(""))
    return violations(df, table, key, f"blank:{column}", is_blank(value), F.lit(""))


def outside_unit_interval(df: DataFrame, table: str, key: Sequence[str], column: str) -> DataFrame:
    value = F.col(column)
    return violations(
        df, table, key, f"unit_interval:{column}",
        value.isNull() | F.isnan(value) | ~value.between(0, 1), F.coalesce(value.cast("string"), F.lit("null")),
    )


def below_minimum(
    df: DataFrame, table: str, key: Sequence[str], column: str, least: float, strict: bool = False
) -> DataFrame:
    """Observed values that are too small; a null is "not observed" and passes."""
    value = F.col(column)
    return violations(
        df, table, key, f"minimum:{column}", (value <= least) if strict else (value < least), value
    )


def probabilities_off_one(df: DataFrame, table: str, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    total = reduce(lambda left, right: left + right, [F.col(name) for name in columns])
    return violations(df, table, key, "probabilities_sum", F.abs(total - 1.0) > 1e-6, total)


def malformed_digest(df: DataFrame, table: str, key: Sequence[str], column: str) -> DataFrame:
    value = F.coalesce(F.col(column), F.lit(""))
    return violations(df, table, key, f"sha256:{column}", ~value.rlike(r"^[0-9a-f]{64}\z"), value)


def naive_timestamp(df: DataFrame, table: str, key: Sequence[str], column: str = "created_at") -> DataFrame:
    """Raw timestamp text without a zone; to be checked before it is cast."""
    value = F.coalesce(F.col(column), F.lit(""))
    return violations(df, table, key, f"timezone:{column}", ~value.rlike(AWARE_TIMESTAMP), value)


def foreign_target(
    df: DataFrame, known: DataFrame, table: str, key: Sequence[str], target: Sequence[str] = TARGET
) -> DataFrame:
    """Rows bound to a code state that is not among ``known``."""
    strangers = df.join(known.select(*target).distinct(), list(target), "left_anti")
    return violations(strangers, table, key, "target_mismatch", F.lit(True), _key(target))


def catalog_provenance(df: DataFrame, table: str = "fixture_catalog") -> DataFrame:
    key = ("dataset_id", "record_id")
    source = (
        (F.coalesce(F.col("source_revision"), F.lit("")) == "")
        | ~F.coalesce(F.col("source_url"), F.lit("")).startswith("https://")
    )
    label = F.col("authorship_label").isNotNull() & F.col("ground_truth_scope").isin(*SCOPES_WITHOUT_AUTHORSHIP)
    return violations(df, table, key, "source_provenance", source, F.col("source_url")).unionByName(
        violations(df, table, key, "authorship_label", label, F.col("ground_truth_scope"))
    )


def missing_fields(df: DataFrame, table: str, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Sorted names of required payload fields that are null or blank."""
    absent = F.array_compact(
        F.array(*[F.when(is_blank(F.coalesce(F.col(name), F.lit(""))), F.lit(name)) for name in sorted(fields)])
    )
    return violations(df, table, key, "missing_fields", F.size(absent) > 0, F.array_join(absent, ","))


def claims_without_reference(claims: DataFrame, key: Sequence[str] = ("claim_id",)) -> DataFrame:
    condition = F.coalesce(F.size("evidence_refs"), F.lit(0)) < 1
    return violations(claims, "claims", key, "no_evidence_reference", condition, F.lit(""))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def require_clean(found: DataFrame, shown: int = 5) -> None:
    """Strict mode: fail and name a few of the offending records."""
    rows = found.limit(shown).collect()
    if rows:
        raise ValidationError("; ".join(f"{r['table']}[{r['key']}] {r['rule']}: {r['detail']}" for r in rows))
