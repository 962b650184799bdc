"""Sixty descriptive features per code sample, and repository and change aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..schemas import TARGET

# Feature names in model order.
FEATURE_NAMES = (
    "lines", "nonblank_lines", "comment_fraction", "mean_line_length", "line_length_std",
    "identifier_count", "identifier_diversity", "mean_identifier_length",
    "string_literal_fraction", "numeric_literal_fraction", "max_indent", "mean_indent",
    "function_count", "class_count", "branch_count", "exception_count", "import_count",
    "docstring_count", "mean_function_lines", "message_length", "message_line_count",
    "files_changed", "additions", "deletions", "change_balance", "code_token_entropy",
    "blank_line_fraction", "token_count", "unique_token_fraction", "keyword_density",
    "operator_density", "todo_count", "trailing_whitespace_fraction", "tab_indent_fraction",
    "snake_identifier_fraction", "camel_identifier_fraction", "identifier_length_std",
    "async_function_count", "decorator_count", "typed_argument_fraction",
    "return_annotation_fraction", "lambda_count", "comprehension_count", "assert_count",
    "with_count", "await_count", "yield_count", "call_count", "assignment_count",
    "max_ast_depth", "cyclomatic_complexity", "branch_density", "docstring_coverage",
    "function_length_std", "max_function_lines", "commit_word_count",
    "commit_issue_reference_count", "churn", "change_size_log", "deletion_fraction",
)

# Features that only a syntax tree can give.
STRUCTURE_NAMES = (
    "function_count", "class_count", "branch_count", "exception_count", "import_count",
    "docstring_count", "mean_function_lines", "function_length_std", "max_function_lines",
    "async_function_count", "decorator_count", "typed_argument_fraction",
    "return_annotation_fraction", "lambda_count", "comprehension_count", "assert_count",
    "with_count", "await_count", "yield_count", "call_count", "assignment_count",
    "max_ast_depth", "cyclomatic_complexity", "branch_density", "docstring_coverage",
)

# Words counted in place of a syntax tree for other languages.
FALLBACK_WORDS = {
    "function_count": ("function", "def"),
    "class_count": ("class",),
    "branch_count": ("if", "for", "while", "switch"),
    "exception_count": ("try", "catch", "throw", "raise", "except"),
    "import_count": ("import", "require", "include"),
}
TODO_WORDS = ("TODO", "FIXME", "XXX")

# Feature families, tested in this order; everything else is size.
CHANGE_FEATURES = (
    "message_length", "message_line_count", "files_changed", "additions", "deletions",
    "change_balance", "commit_word_count", "commit_issue_reference_count", "churn",
    "change_size_log", "deletion_fraction",
)
COMPLEXITY_FEATURES = (
    "max_indent", "mean_indent", "mean_function_lines", "function_length_std",
    "max_function_lines", "max_ast_depth", "cyclomatic_complexity", "branch_density",
)
NAMING_MARKS = ("identifier", "docstring", "comment")
TREE_FEATURES = (
    "function_count", "class_count", "branch_count", "exception_count", "import_count",
    "async_function_count", "decorator_count", "typed_argument_fraction",
    "return_annotation_fraction", "lambda_count", "comprehension_count", "assert_count",
    "with_count", "await_count", "yield_count", "call_count", "assignment_count",
)


def _share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole.cast("double"), F.lit(1.0))


def _count_where(array: Column, condition) -> Column:
    return F.size(F.filter(array, condition))


def _squares(items: str) -> Column:
    """Sum of squared lengths of an array of texts."""
    return text.sum_of(F.col(items), lambda item: F.length(item).cast("long") * F.length(item))


def _count_words(words: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.filter(words, lambda word: word.isin(*wanted)))


def lexical_columns(code: Column, language: Column) -> dict[str, Column]:
    """Arrays every lexical feature is computed from; each is one pass over the text."""
    return {
        "_lines": text.lines_of(code),
        "_tokens": text.extract_all(code, text.TOKEN),
        "_words": text.words_of(code),
        "_comment": text.comment_characters(code, language),
        "_quoted": F.regexp_count(code, F.lit(text.QUOTED)),
        "_numbers": text.standalone_numbers(code),
    }


def sample_features(samples: DataFrame, structure: DataFrame | None = None) -> DataFrame:
    """All sixty features per row of ``samples``; other columns pass through.

    Needs ``sample_id, code, language, commit_message, files_changed, additions,
    deletions``. Python rows take their structural features from ``structure``
    (``sample_id`` plus ``STRUCTURE_NAMES``, see :mod:`structure`) and get zeros
    without it; other languages count words. Without ``structure`` nothing shuffles.
    """
    code, message = F.col("code"), F.coalesce(F.col("commit_message"), F.lit(""))
    frame = samples.withColumns(lexical_columns(code, F.col("language")))
    keyword_set = text.PYTHON_KEYWORDS
    frame = frame.withColumns({
        "_nonblank": F.filter("_lines", lambda line: ~text.is_blank(line)),
        "_names": F.filter("_tokens", lambda token: token.rlike("^[A-Za-z_]")),
        "_figures": F.size(F.filter("_tokens", lambda token: token.rlike(r"^\p{Nd}"))),
    })
    frame = frame.withColumns({
        "_identifiers": F.filter("_names", lambda name: ~name.isin(*keyword_set)),
        "_indents": F.transform("_nonblank", text.indent_width),
        "_line_sum": F.length(F.array_join("_nonblank", "")).cast("double"),
        "_line_squares": _squares("_nonblank"),
    })
    frame = frame.withColumns({
        "_name_sum": F.length(F.array_join("_identifiers", "")).cast("double"),
        "_name_squares": _squares("_identifiers"),
    })
    lines, nonblank = F.size("_lines"), F.size("_nonblank")
    tokens, identifiers = F.size("_tokens"), F.size("_identifiers")
    line_mean, name_mean = _share(F.col("_line_sum"), nonblank), _share(F.col("_name_sum"), identifiers)
    line_std = text.deviation(nonblank, F.col("_line_sum"), F.col("_line_squares"))
    name_std = text.deviation(identifiers, F.col("_name_sum"), F.col("_name_squares"))
    indent_mean = _share(text.sum_of(F.col("_indents")), nonblank)
    added, removed = F.col("additions"), F.col("deletions")
    churn = added + removed
    space = text.SPACE_CLASS
    values = {
        "lines": lines,
        "nonblank_lines": nonblank,
        "comment_fraction": _share(F.col("_comment"), F.length(code)),
        "mean_line_length": line_mean,
        "line_length_std": line_std,
        "identifier_count": identifiers,
        "identifier_diversity": _share(F.size(F.array_distinct("_identifiers")), identifiers),
        "mean_identifier_length": name_mean,
        "string_literal_fraction": _share(F.col("_quoted"), tokens),
        "numeric_literal_fraction": _share(F.col("_numbers"), tokens),
        "max_indent": F.coalesce(F.array_max("_indents"), F.lit(0)),
        "mean_indent": indent_mean,
        "message_length": F.length(message),
        "message_line_count": text.line_count(message),
        "files_changed": F.col("files_changed"),
        "change_balance": _share(added - removed, churn),
        "code_token_entropy": text.shannon_entropy(F.col("_tokens")),
        "blank_line_fraction": _share(lines - nonblank, lines),
        "token_count": tokens,
        "unique_token_fraction": _share(F.size(F.array_distinct("_tokens")), tokens),
        "keyword_density": _share(F.size("_names") - identifiers, tokens),
        "operator_density": _share(tokens - F.size("_names") - F.col("_figures"), tokens),
        "todo_count": _count_where(F.col("_words"), lambda word: F.upper(word).isin(*TODO_WORDS)),
        "trailing_whitespace_fraction": _share(
            _count_where(F.col("_lines"), lambda line: line.rlike(rf"[{space}]\z")), lines
        ),
        "tab_indent_fraction": _share(
            _count_where(F.col("_nonblank"), lambda line: line.startswith("\t")), nonblank
        ),
        "snake_identifier_fraction": _share(
            _count_where(
                F.col("_identifiers"),
                lambda name: F.contains(name, F.lit("_")) & (F.lower(name) == name),
            ),
            identifiers,
        ),
        "camel_identifier_fraction": _share(
            _count_where(F.col("_identifiers"), lambda name: name.rlike("[a-z][A-Z]")), identifiers
        ),
        "identifier_length_std": name_std,
        "commit_word_count": F.size(text.words_of(message)),
        "commit_issue_reference_count": F.regexp_count(message, F.lit(r"#\p{Nd}+|[A-Z]{2,}-\p{Nd}+")),
        "churn": churn,
        "change_size_log": F.log1p(churn.cast("double")),
        "deletion_fraction": _share(removed, churn),
        "additions": added,
        "deletions": removed,
    }
    is_python = F.lower("language") == "python"
    for name in STRUCTURE_NAMES:
        word_list = FALLBACK_WORDS.get(name)
        values[name] = (
            F.when(is_python, F.lit(0.0)).otherwise(
                _count_words(F.col("_words"), word_list).cast("double")
            )
            if word_list else F.lit(0.0)
        )
    kept = [name for name in samples.columns if name not in FEATURE_NAMES]
    result = frame.select(*kept, *[values[name].cast("double").alias(name) for name in FEATURE_NAMES])
    if structure is None:
        return result
    tree = structure.select(
        F.col("sample_id"), *[F.col(name).alias(f"_tree_{name}") for name in STRUCTURE_NAMES]
    )
    # A parser's output is estimated by its input, far too small, and must not be broadcast for it.
    joined = result.join(tree.hint("merge"), "sample_id", "left")
    return joined.select(
        *kept,
        *[
            F.when(F.lower("language") == "python", F.coalesce(F.col(f"_tree_{name}"), F.lit(0.0)))
            .otherwise(F.col(name)).alias(name)
            if name in STRUCTURE_NAMES else F.col(name)
            for name in FEATURE_NAMES
        ],
    )


def feature_family(name: str) -> str:
    if name in CHANGE_FEATURES:
        return "change_structure"
    if name in COMPLEXITY_FEATURES:
        return "complexity"
    if any(mark in name for mark in NAMING_MARKS):
        return "identifier_documentation"
    return "ast_structure" if name in TREE_FEATURES else "size_composition"


def feature_definitions(spark) -> DataFrame:
    """Sixty-row dimension table describing the model features."""
    rows = [
        (
            name,
            "change" if name in CHANGE_FEATURES else "file",
            feature_family(name),
            "revlens.features:v2",
            ["python"] if name in TREE_FEATURES + COMPLEXITY_FEATURES else ["*"],
            "zero_when_not_observed",
            "fit_on_training_partition",
            "medium" if name in CHANGE_FEATURES else "low",
            "high" if name in CHANGE_FEATURES else "medium",
            "supporting statistical signal; never authorship proof",
        )
        for name in FEATURE_NAMES
    ]
    return spark.createDataFrame(
        rows,
        "name STRING, scope STRING, family STRING, producer STRING, languages ARRAY<STRING>, "
        "missingness STRING, normalization STRING, leakage_risk STRING, reliability STRING, "
        "scientific_role STRING",
    )


def to_long(features: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Wide features to ``keys, name, value`` rows."""
    return features.select(*keys, *[F.col(name).cast("double").alias(name) for name in names]).unpivot(
        list(keys), list(names), "name", "value"
    )


def sample_feature_values(features: DataFrame) -> DataFrame:
    """Long feature vector joined to its definitions (sixty fixed rows, so broadcast)."""
    long = to_long(features, ["sample_id"], FEATURE_NAMES).withColumnRenamed("sample_id", "target_id")
    return long.join(F.broadcast(feature_definitions(features.sparkSession)), "name")


def aggregate_feature_values(wide: DataFrame, scope: str, keys: Sequence[str] = TARGET) -> DataFrame:
    """Long vector of repository or change aggregates with their own metadata."""
    names = sorted(name for name in wide.columns if name not in keys)
    family = {"repository": "repository_behavior", "change": "change_structure"}[scope]
    return to_long(wide, keys, names).withColumns({
        "scope": F.lit(scope),
        "family": F.lit(family),
        "producer": F.lit(f"revlens.features:{scope}"),
        "missingness": F.lit("explicit_zero"),
        "normalization": F.lit("per_repository_or_change"),
        "leakage_risk": F.lit("low"),
        "reliability": F.lit("high"),
        "scientific_role": F.lit("descriptive context; not authorship evidence"),
    })


def repository_features(files: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """Eight values per repository from ``keys, path, code``; null code is not text.

    Two partial aggregations: per extension first, then per repository, so a hot
    repository reaches the second step as a handful of rows.
    """
    keys = list(keys)
    count = text.line_count(F.col("code"))
    by_extension = files.groupBy(
        *keys, F.when(paths.extension(F.col("path")) == "", "<none>").otherwise(paths.extension(F.col("path"))).alias("extension")
    ).agg(
        F.count(F.lit(1)).alias("files"),
        F.count("code").alias("texts"),
        F.coalesce(F.sum(count), F.lit(0)).alias("text_lines"),
        F.coalesce(F.max(count), F.lit(0)).alias("longest"),
        F.count_if(paths.is_test_path(F.col("path"))).alias("tests"),
    )
    total = F.sum("files").cast("double")
    weighted = F.sum(F.col("files") * F.log2(F.col("files").cast("double")))
    return by_extension.groupBy(*keys).agg(
        F.sum("files").cast("double").alias("repository_files"),
        F.sum("text_lines").cast("double").alias("repository_text_lines"),
        _share(F.sum("text_lines"), F.sum("texts")).alias("repository_mean_file_lines"),
        F.max("longest").cast("double").alias("repository_max_file_lines"),
        F.sum("tests").cast("double").alias("repository_test_files"),
        _share(F.sum("tests"), F.sum("files")).alias("repository_test_file_ratio"),
        F.count(F.lit(1)).cast("double").alias("repository_extension_count"),
        F.greatest(F.log2(total) - weighted / total, F.lit(0.0)).alias("repository_language_entropy"),
    )


def change_features(
    changed_files: DataFrame, changed_hunks: DataFrame, keys: Sequence[str] = TARGET
) -> DataFrame:
    """Eight values per change; a change without hunks or files counts zero."""
    keys = list(keys)
    path = F.col("path")
    subsystem = F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(".")
    by_subsystem = changed_files.groupBy(*keys, subsystem.alias("subsystem")).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
        F.count_if(paths.is_test_path(path)).alias("tests"),
        F.count_if(F.col("binary")).alias("binaries"),
    )
    totals = by_subsystem.groupBy(*keys).agg(
        F.sum("files").alias("files"),
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
        F.count(F.lit(1)).alias("subsystems"),
        F.sum("tests").alias("tests"),
        F.sum("binaries").alias("binaries"),
    )
    hunks = changed_hunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("hunks"))
    joined = totals.join(hunks, keys, "left")
    return joined.select(
        *keys,
        F.col("files").cast("double").alias("change_files"),
        F.coalesce("hunks", F.lit(0)).cast("double").alias("change_hunks"),
        F.col("additions").cast("double").alias("change_additions"),
        F.col("deletions").cast("double").alias("change_deletions"),
        (F.col("additions") + F.col("deletions")).cast("double").alias("change_churn"),
        F.col("subsystems").cast("double").alias("change_subsystems"),
        _share(F.col("tests"), F.col("files")).alias("change_test_file_ratio"),
        F.col("binaries").cast("double").alias("change_binary_files"),
    )


def language_counts(samples: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    return samples.groupBy(*keys, "language").agg(F.count(F.lit(1)).alias("files"))
