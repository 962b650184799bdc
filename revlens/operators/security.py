"""Pattern-based security signals, their roll-up, and package registry risk."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import SPACE_CLASS, WORD_CLASS, each
from ..schemas import SEVERE, TARGET

_S = f"[{SPACE_CLASS}]*"
_START = f"(?<![{WORD_CLASS}])"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    pattern: str
    evidence: str


# The rules; callers may pass a longer list.
RULES = (
    Rule("PY-EVAL", "high", rf"{_START}eval{_S}\(", "dynamic eval"),
    Rule("PY-EXEC", "high", rf"{_START}exec{_S}\(", "dynamic exec"),
    Rule("SHELL-TRUE", "high", rf"shell{_S}={_S}True", "shell execution"),
    Rule("SQL-FORMAT", "high", rf"(?:execute|query){_S}\({_S}f?[\"'][^\n]*\{{", "formatted SQL"),
    Rule(
        "SECRET-LITERAL", "critical",
        rf"(?i)(?:api[_-]?key|secret|token|password){_S}={_S}[\"'][^\"']{{8,}}",
        "credential-like literal",
    ),
    Rule("TLS-VERIFY-OFF", "high", rf"verify{_S}={_S}False", "TLS verification disabled"),
    Rule("PICKLE-LOAD", "medium", rf"pickle\.loads?{_S}\(", "unsafe deserialization surface"),
)

# Registry state to supply-chain risk.
REGISTRY_RISK = {"exists": "low", "new": "high", "missing": "critical", "unknown": "unknown"}

_MARK = "\x01"


def _rule_case(rules: Sequence[Rule], value) -> Column:
    chosen = None
    for index, rule in enumerate(rules):
        condition = F.col("_rule") == index
        chosen = F.when(condition, value(rule)) if chosen is None else chosen.when(condition, value(rule))
    return chosen


def scan_code(samples: DataFrame, rules: Sequence[Rule] = RULES, code: str = "code") -> DataFrame:
    """One row per match with its rule and 1-based line; text columns are dropped.

    A text is first tried by each rule, which stops at the first match. Only where one matches a mark is put
    before each of its matches, the text is cut into lines, and marks are counted per line. That is
    linear in the text, keeps every match, stays in the row and so never shuffles.
    """
    kept = [name for name in samples.columns if name != code]
    met = F.array_compact(F.array(*[F.when(F.rlike(F.col(code), F.lit(rule.pattern)), F.lit(index)) for index, rule in enumerate(rules)]))
    hit = samples.select(*kept, F.col(code).alias("_code"), each(met).alias("_rule"))
    clean = F.translate(F.col("_code"), _MARK, "\x02")
    marked = _rule_case(rules, lambda rule: F.regexp_replace(clean, rule.pattern, f"{_MARK}$0"))
    hits = F.length("_line") - F.length(F.replace(F.col("_line"), F.lit(_MARK), F.lit("")))
    repeated = (
        hit.select(*kept, "_rule", marked.alias("_text"))
        .select(*kept, "_rule", F.posexplode(F.split("_text", "\n", -1)).alias("_at", "_line"))
        .filter(F.contains("_line", F.lit(_MARK)))
        .select(*kept, "_rule", (F.col("_at") + 1).cast("long").alias("line"),
                F.explode(F.sequence(F.lit(1), hits)).alias("_n"))
    )
    return repeated.select(
        *kept,
        _rule_case(rules, lambda rule: F.lit(rule.rule_id)).alias("rule_id"),
        _rule_case(rules, lambda rule: F.lit(rule.severity)).alias("severity"),
        _rule_case(rules, lambda rule: F.lit(rule.evidence)).alias("evidence"),
        "line",
    )


def security_rollup(signals: DataFrame, targets: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """Status, severity and counts per target; a target without a signal passes.

    ``signals`` need ``keys, path, severity``. Counts are partially aggregated, so
    a hot repository costs one row per task.
    """
    keys = list(keys)
    severe = F.col("severity").isin(*SEVERE)
    production = severe & ~paths.in_test_folder_prefix(F.col("path"))
    counts = signals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("signals"),
        F.count_if(production).alias("production_severe"),
        F.count_if(severe & ~production).alias("test_only_severe"),
        F.count_if(production & (F.col("severity") == "critical")).alias("production_critical"),
    )
    joined = targets.select(*keys).join(counts, keys, "left").fillna(0)
    return joined.select(
        *keys,
        "signals",
        "production_severe",
        "test_only_severe",
        F.when(F.col("production_severe") > 0, "fail")
        .when(F.col("test_only_severe") > 0, "warn").otherwise("pass").alias("status"),
        F.when(F.col("production_critical") > 0, "critical")
        .when(F.col("production_severe") > 0, "high")
        .when(F.col("test_only_severe") > 0, "low").otherwise("info").alias("severity"),
    )


def signal_references(signals: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """``path:line:rule`` per signal, kept as rows because their number has no bound."""
    return signals.select(
        *keys,
        F.lit("security_risk").alias("dimension"),
        F.concat_ws(":", "path", F.col("line").cast("string"), "rule_id").alias("reference"),
    )


def imported_packages(samples: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """Distinct top-level packages named by import lines, per target."""
    return samples.select(*keys, F.explode(paths.python_dependencies(F.col("code"))).alias("package")).distinct()


def package_risk(packages: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry state and supply-chain risk; a package absent from the registry is unknown.

    States outside the known set get a null risk and are listed by
    :func:`validation.not_in_domain`.
    """
    joined = packages.join(registry.select("package", "registry_state"), "package", "left")
    state = F.coalesce("registry_state", F.lit("unknown"))
    return joined.withColumn("registry_state", state).withColumn(
        "supply_chain_risk", F.try_element_at(paths.literal_map(REGISTRY_RISK), state)
    )
