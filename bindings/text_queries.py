"""Features, security signals and reuse over documents, pages and derived scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions import text
from revlens.operators import features, reuse, security
from revlens.plans import report
from revlens.session import materialise

from .inputs import (
    BREAK, DOCUMENT_SAMPLES_SQL, PAGE_SAMPLES_SQL, S, SCRIPT_FILES_SQL, W,
    document_samples, page_samples, script_files, table,
)

PLACES = 6


def rounded(df: DataFrame, names) -> DataFrame:
    return df.withColumns({name: F.round(name, PLACES) for name in names})


def document_features(spark, sf_dir):
    wide = features.sample_features(document_samples(spark, sf_dir))
    return rounded(wide, features.FEATURE_NAMES).select("sample_id", *features.FEATURE_NAMES)


def page_features(spark, sf_dir):
    wide = features.sample_features(page_samples(spark, sf_dir))
    return rounded(wide, features.FEATURE_NAMES).select("sample_id", *features.FEATURE_NAMES)


def feature_values(spark, sf_dir):
    long = features.sample_feature_values(features.sample_features(document_samples(spark, sf_dir)))
    return long.groupBy("name", "scope", "family", "leakage_risk", "reliability").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.sum("value"), 3).alias("total")
    )


def repository_features(spark, sf_dir):
    files = document_samples(spark, sf_dir).unionByName(
        page_samples(spark, sf_dir), allowMissingColumns=True
    )
    wide = features.repository_features(files)
    return rounded(wide, [name for name in wide.columns if name.startswith("repository_") and name != "repository_id"])


def language_counts(spark, sf_dir):
    return features.language_counts(document_samples(spark, sf_dir), ["repository_id"])


def repository_medians(spark, sf_dir):
    rows = report.sample_summary(document_samples(spark, sf_dir), ("repository_id",))
    return rows.select("repository_id", "files_analyzed", F.col("total_nonblank_lines").cast("long").alias("total_nonblank_lines"),
                       F.round("median_file_lines", PLACES).alias("median_file_lines"))


def document_signals(spark, sf_dir):
    signals = security.scan_code(document_samples(spark, sf_dir).select("sample_id", "code"))
    return signals.select("sample_id", "rule_id", "severity", "line")


def script_signals(spark, sf_dir):
    signals = security.scan_code(script_files(spark, sf_dir))
    return signals.select("path", "rule_id", "severity", "line")


def security_rollup(spark, sf_dir):
    scripts = script_files(spark, sf_dir)
    signals = security.scan_code(scripts)
    return security.security_rollup(signals, scripts.select("repository_id").distinct(), ["repository_id"])


def signal_references(spark, sf_dir):
    return security.signal_references(security.scan_code(script_files(spark, sf_dir)), ["repository_id"])


def package_risk(spark, sf_dir):
    packages = security.imported_packages(script_files(spark, sf_dir), ["repository_id"])
    supplier = table(spark, sf_dir, "supplier")
    registry = supplier.select(
        F.concat(F.lit("package"), "s_suppkey").alias("package"),
        F.when(F.col("s_acctbal") < 0, "missing").when(F.col("s_acctbal") < 3000, "new")
        .otherwise("exists").alias("registry_state"),
    )
    return security.package_risk(packages, registry)


def script_dependencies(spark, sf_dir):
    return security.imported_packages(script_files(spark, sf_dir), ["path"])


def reuse_tokens(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    tokens = reuse.normalized_tokens(F.col("text"))
    return documents.select("doc_id", tokens.alias("t")).select(
        "doc_id", F.size("t").alias("tokens").cast("long"),
        F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"),
        F.sha2(F.array_join("t", " "), 256).alias("digest"),
    )


def reuse_overlap(spark, sf_dir):
    index = reuse.stored_index(table(spark, sf_dir, "benchmark").select(F.col("text").alias("code")))
    result = reuse.overlap_fractions(
        table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("code")), index, "doc_id"
    )
    return result.withColumn("fraction", F.round("fraction", PLACES))


def reuse_index_summary(spark, sf_dir):
    return reuse.index_summary(table(spark, sf_dir, "documents").select(F.col("text").alias("code")))


def shingle_set_operations(spark, sf_dir):
    """Shingles shared with, only in, and joined over two corpora."""
    corpus = materialise(reuse.reuse_index(table(spark, sf_dir, "benchmark").select(F.col("text").alias("code"))))
    talk = materialise(reuse.reuse_index(table(spark, sf_dir, "conversations").select(F.col("text").alias("code"))))
    parts = [
        ("intersection", corpus.intersect(talk)), ("difference", corpus.exceptAll(talk)),
        ("union", corpus.union(talk).distinct()),
    ]
    counted = [
        part.groupBy(F.lit(name).alias("operation")).agg(
            F.count(F.lit(1)).alias("shingles"), F.min("shingle").alias("first")
        )
        for name, part in parts
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


QUERIES = {
    "document_features": document_features,
    "page_features": page_features,
    "feature_values": feature_values,
    "repository_features": repository_features,
    "language_counts": language_counts,
    "repository_medians": repository_medians,
    "document_signals": document_signals,
    "script_signals": script_signals,
    "security_rollup": security_rollup,
    "signal_references": signal_references,
    "package_risk": package_risk,
    "script_dependencies": script_dependencies,
    "reuse_tokens": reuse_tokens,
    "reuse_overlap": reuse_overlap,
    "reuse_index_summary": reuse_index_summary,
    "shingle_set_operations": shingle_set_operations,
}


def _literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _lines(code: str) -> str:
    parts = f"regexp_split_to_array({code}, {_literal(BREAK)})"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


NAME_SQL = rf"[A-Za-z_][{W}]*"
TOKEN_SQL = rf"{NAME_SQL}|\p{{Nd}}+(?:\.\p{{Nd}}+)?|[^{S}{W}]"
KEYWORDS_SQL = ", ".join(_literal(word) for word in text.PYTHON_KEYWORDS)


def features_sql(samples: str, comment: str, names=features.FEATURE_NAMES) -> str:
    def word_count(words):
        listed = ", ".join(_literal(word) for word in words)
        return f"len([w FOR w IN words IF w IN ({listed})])"

    def ratio(part, whole):
        return f"({part})::DOUBLE / greatest({whole}, 1)"

    expressions = {
        "lines": "len(lines)",
        "nonblank_lines": "len(nonblank)",
        "comment_fraction": ratio("comment", "length(code)"),
        "mean_line_length": "coalesce(list_avg(line_lengths), 0)",
        "line_length_std": "coalesce(list_stddev_pop(line_lengths), 0)",
        "identifier_count": "len(identifiers)",
        "identifier_diversity": ratio("len(list_distinct(identifiers))", "len(identifiers)"),
        "mean_identifier_length": "coalesce(list_avg(name_lengths), 0)",
        "string_literal_fraction": ratio("quoted", "len(tokens)"),
        "numeric_literal_fraction": ratio("numbers", "len(tokens)"),
        "max_indent": "coalesce(list_max(indents), 0)",
        "mean_indent": "coalesce(list_avg(indents), 0)",
        "message_length": "length(commit_message)",
        "message_line_count": f"CASE WHEN commit_message = '' THEN 0 ELSE len({_lines('commit_message')}) END",
        "files_changed": "files_changed", "additions": "additions", "deletions": "deletions",
        "change_balance": ratio("additions - deletions", "additions + deletions"),
        "code_token_entropy": "coalesce(list_entropy(tokens), 0)",
        "blank_line_fraction": ratio("len(lines) - len(nonblank)", "len(lines)"),
        "token_count": "len(tokens)",
        "unique_token_fraction": ratio("len(list_distinct(tokens))", "len(tokens)"),
        "keyword_density": ratio("len(names) - len(identifiers)", "len(tokens)"),
        "operator_density": ratio(
            f"len([t FOR t IN tokens IF regexp_full_match(t, '[^{S}{W}]')])", "len(tokens)"
        ),
        "todo_count": "len([w FOR w IN words IF upper(w) IN ('TODO', 'FIXME', 'XXX')])",
        "trailing_whitespace_fraction": ratio(
            f"len([l FOR l IN lines IF regexp_matches(l, '[{S}]$')])", "len(lines)"
        ),
        "tab_indent_fraction": ratio("len([l FOR l IN nonblank IF l[1] = chr(9)])", "len(nonblank)"),
        "snake_identifier_fraction": ratio(
            "len([i FOR i IN identifiers IF contains(i, '_') AND lower(i) = i])", "len(identifiers)"
        ),
        "camel_identifier_fraction": ratio(
            "len([i FOR i IN identifiers IF regexp_matches(i, '[a-z][A-Z]')])", "len(identifiers)"
        ),
        "identifier_length_std": "coalesce(list_stddev_pop(name_lengths), 0)",
        "function_count": word_count(("function", "def")),
        "class_count": word_count(("class",)),
        "branch_count": word_count(("if", "for", "while", "switch")),
        "exception_count": word_count(("try", "catch", "throw", "raise", "except")),
        "import_count": word_count(("import", "require", "include")),
        "commit_word_count": f"len(regexp_extract_all(commit_message, '[{W}]+'))",
        "commit_issue_reference_count": r"len(regexp_extract_all(commit_message, '#\p{Nd}+|[A-Z]{2,}-\p{Nd}+'))",
        "churn": "additions + deletions",
        "change_size_log": "ln(1 + additions + deletions)",
        "deletion_fraction": ratio("deletions", "additions + deletions"),
    }
    columns = ",\n  ".join(
        f"round(({expressions.get(name, '0')})::DOUBLE, {PLACES}) AS {name}" for name in names
    )
    return rf"""
WITH base AS ({samples}),
arrays AS (
  SELECT *, {_lines('code')} AS lines,
    regexp_extract_all(code, {_literal(TOKEN_SQL)}) AS tokens,
    regexp_extract_all(code, '[{W}]+') AS words,
    length(code) - length(regexp_replace(code, {_literal(comment)}, '', 'g')) AS comment,
    len(regexp_extract_all(code, {_literal(text.QUOTED)})) AS quoted,
    len(regexp_extract_all(regexp_replace(code, '[{W}]*[\p{{L}}\p{{Nl}}\p{{No}}_][{W}]*', 'x', 'g'),
        '\b[0-9]+(?:\.[0-9]+)?\b')) AS numbers
  FROM base),
named AS (
  SELECT *, [l FOR l IN lines IF regexp_matches(l, '[^{S}]')] AS nonblank,
    [t FOR t IN tokens IF regexp_matches(t, '^[A-Za-z_]')] AS names
  FROM arrays),
filtered AS (SELECT *, [n FOR n IN names IF n NOT IN ({KEYWORDS_SQL})] AS identifiers FROM named),
sized AS (
  SELECT *, [length(l) FOR l IN nonblank] AS line_lengths,
    [length(l) - length(regexp_replace(l, '^[{S}]+', '')) FOR l IN nonblank] AS indents,
    [length(i) FOR i IN identifiers] AS name_lengths
  FROM filtered)
SELECT sample_id,
  {columns}
FROM sized"""


DOCUMENT_FEATURES_SQL = features_sql(DOCUMENT_SAMPLES_SQL, "#[^\\n]*")
PAGE_FEATURES_SQL = features_sql(PAGE_SAMPLES_SQL, r"//[^\n]*|/\*[\s\S]*?\*/")

_definition_rows = ", ".join(
    f"('{name}', '{'change' if name in features.CHANGE_FEATURES else 'file'}', "
    f"'{features.feature_family(name)}', "
    f"'{'medium' if name in features.CHANGE_FEATURES else 'low'}', "
    f"'{'high' if name in features.CHANGE_FEATURES else 'medium'}')"
    for name in features.FEATURE_NAMES
)


def signals_sql(samples: str, passed: str) -> str:
    """Same rules with RE2 word boundaries; a mark before each match, counted per line."""
    rules = ", ".join(
        "({}, {}, {})".format(
            _literal(rule.rule_id), _literal(rule.severity),
            _literal("(" + rule.pattern.replace(security._START, r"\b") + ")"),
        )
        for rule in security.RULES
    )
    return rf"""
WITH base AS ({samples}), rules(rule_id, severity, pattern) AS (VALUES {rules}),
marked AS (
  SELECT {passed}, rule_id, severity,
    string_split(CASE rule_id {" ".join(
        "WHEN " + _literal(rule.rule_id) + " THEN regexp_replace(replace(code, chr(1), chr(2)), "
        + _literal("(" + rule.pattern.replace(security._START, chr(92) + "b") + ")")
        + ", chr(1) || '\\1', 'g')" for rule in security.RULES)} END, chr(10)) AS parts
  FROM base CROSS JOIN rules),
numbered AS (SELECT {passed}, rule_id, severity, unnest(parts) AS part, generate_subscripts(parts, 1) AS line FROM marked)
SELECT {passed}, rule_id, severity, line::BIGINT AS line
FROM (SELECT *, unnest(range(length(part) - length(replace(part, chr(1), '')))) AS n FROM numbered
      WHERE contains(part, chr(1)))"""


SCRIPT_SIGNALS_SQL = signals_sql(SCRIPT_FILES_SQL, "repository_id, path")

PACKAGES_SQL = rf"""
SELECT DISTINCT repository_id, path,
  unnest(regexp_extract_all(code, '(?:^|\n)[{S}]*(?:from|import)[{S}]+([A-Za-z_][{W}]*)', 1)) AS package
FROM ({SCRIPT_FILES_SQL})"""

REUSE_TOKENS_SQL = (
    r"regexp_extract_all(lower(regexp_replace(text, '#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/', ' ', 'g')), "
    rf"'{NAME_SQL}|\p{{Nd}}+|[^{S}{W}]')"
)


def shingles_sql(table_name: str, key: str) -> str:
    return (
        f"SELECT DISTINCT {key}, sha256(array_to_string(t[i:i + 6], chr(31)))[:20] AS shingle FROM "
        f"(SELECT {key}, t, unnest(range(1, len(t) - 5)) AS i FROM "
        f"(SELECT {key}, {REUSE_TOKENS_SQL} AS t FROM {table_name}))"
    )


ORACLES = {
    "document_features": DOCUMENT_FEATURES_SQL,
    "page_features": PAGE_FEATURES_SQL,
    "feature_values": f"""
WITH wide AS ({DOCUMENT_FEATURES_SQL.replace(f', {PLACES}) AS', ', 12) AS')}),
long AS (UNPIVOT wide ON {', '.join(features.FEATURE_NAMES)} INTO NAME name VALUE value),
definitions(name, scope, family, leakage_risk, reliability) AS (VALUES {_definition_rows})
SELECT name, scope, family, leakage_risk, reliability, count(*) AS samples, round(sum(value), 3) AS total
FROM long JOIN definitions USING (name) GROUP BY ALL""",
    "repository_features": rf"""
WITH files AS (
  SELECT source AS repository_id, 'docs/d' || doc_id || '.txt' AS path, text AS code FROM documents
  UNION ALL
  SELECT split_part(url, '/', 3), 'web/p' || page_id || '.js',
    '// ' || url || chr(10) || '/* page' || chr(10) || page_id || ' */' || chr(10) || html FROM pages),
sized AS (SELECT repository_id, regexp_extract(path, '(\.[^.]+)$', 1) AS ext, len({_lines('code')}) AS n FROM files),
exts AS (SELECT repository_id, ext, count(*) AS c FROM sized GROUP BY ALL),
ent AS (SELECT repository_id, count(*) AS e,
   -sum(c / t * log2(c / t)) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY repository_id)::DOUBLE AS t FROM exts) GROUP BY ALL)
SELECT repository_id, 'snap_' || repository_id AS snapshot_id, sha256(repository_id) AS head_sha,
  count(*)::DOUBLE AS repository_files, sum(n)::DOUBLE AS repository_text_lines,
  round(avg(n), {PLACES}) AS repository_mean_file_lines, max(n)::DOUBLE AS repository_max_file_lines,
  0.0::DOUBLE AS repository_test_files, 0.0::DOUBLE AS repository_test_file_ratio,
  any_value(e)::DOUBLE AS repository_extension_count,
  round(abs(any_value(h)), {PLACES})::DOUBLE AS repository_language_entropy
FROM sized JOIN ent USING (repository_id) GROUP BY repository_id""",
    "language_counts": "SELECT source AS repository_id, lang AS language, count(*) AS files FROM documents GROUP BY ALL",
    "repository_medians": rf"""
SELECT source AS repository_id, count(*) AS files_analyzed,
  sum(len([l FOR l IN {_lines('text')} IF regexp_matches(l, '[^{S}]')]))::BIGINT AS total_nonblank_lines,
  round(median(len({_lines('text')})), {PLACES})::DOUBLE AS median_file_lines
FROM documents GROUP BY source""",
    "document_signals": signals_sql(DOCUMENT_SAMPLES_SQL, "sample_id"),
    "script_signals": f"SELECT path, rule_id, severity, line FROM ({SCRIPT_SIGNALS_SQL})",
    "security_rollup": f"""
WITH s AS ({SCRIPT_SIGNALS_SQL}),
c AS (SELECT repository_id, count(*) AS signals,
  count(*) FILTER (severity IN ('high', 'critical') AND path NOT LIKE 'tests/%' AND path NOT LIKE 'test/%') AS production_severe,
  count(*) FILTER (severity IN ('high', 'critical') AND (path LIKE 'tests/%' OR path LIKE 'test/%')) AS test_only_severe,
  count(*) FILTER (severity = 'critical' AND path NOT LIKE 'tests/%') AS crit FROM s GROUP BY ALL)
SELECT repository_id, coalesce(signals, 0) AS signals, coalesce(production_severe, 0) AS production_severe,
  coalesce(test_only_severe, 0) AS test_only_severe,
  CASE WHEN production_severe > 0 THEN 'fail' WHEN test_only_severe > 0 THEN 'warn' ELSE 'pass' END AS status,
  CASE WHEN crit > 0 THEN 'critical' WHEN production_severe > 0 THEN 'high'
       WHEN test_only_severe > 0 THEN 'low' ELSE 'info' END AS severity
FROM (SELECT DISTINCT 'repo' || (l_orderkey % 97) AS repository_id FROM lineitem) LEFT JOIN c USING (repository_id)""",
    "signal_references": f"""
SELECT repository_id, 'security_risk' AS dimension, path || ':' || line || ':' || rule_id AS reference
FROM ({SCRIPT_SIGNALS_SQL})""",
    "package_risk": f"""
WITH registry AS (SELECT 'package' || s_suppkey AS package, CASE WHEN s_acctbal < 0 THEN 'missing'
    WHEN s_acctbal < 3000 THEN 'new' ELSE 'exists' END AS registry_state FROM supplier)
SELECT package, repository_id, coalesce(registry_state, 'unknown') AS registry_state,
  CASE registry_state WHEN 'exists' THEN 'low' WHEN 'new' THEN 'high' WHEN 'missing' THEN 'critical'
    ELSE 'unknown' END AS supply_chain_risk
FROM (SELECT DISTINCT repository_id, package FROM ({PACKAGES_SQL})) LEFT JOIN registry USING (package)""",
    "script_dependencies": f"SELECT path, package FROM ({PACKAGES_SQL})",
    "reuse_tokens": f"""
SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens, sha256(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, {REUSE_TOKENS_SQL} AS t FROM documents)""",
    "reuse_overlap": f"""
WITH corpus AS (SELECT DISTINCT shingle FROM ({shingles_sql('benchmark', 'item_id')})),
q AS ({shingles_sql('documents', 'doc_id')}),
c AS (SELECT doc_id, count(*) AS total, count(corpus.shingle) AS matched FROM q LEFT JOIN corpus USING (shingle) GROUP BY doc_id)
SELECT doc_id, coalesce(total, 0) AS total, coalesce(matched, 0) AS matched,
  round(coalesce(matched / total, 0), {PLACES})::DOUBLE AS fraction
FROM documents LEFT JOIN c USING (doc_id)""",
    "reuse_index_summary": f"""
SELECT (SELECT count(*) FROM documents) AS documents, count(DISTINCT shingle) AS distinct_shingles
FROM ({shingles_sql('documents', 'doc_id')})""",
    "shingle_set_operations": f"""
WITH a AS (SELECT DISTINCT shingle FROM ({shingles_sql('benchmark', 'item_id')})),
b AS (SELECT DISTINCT shingle FROM ({shingles_sql('conversations', 'conv_id, turn')}))
SELECT 'intersection' AS operation, count(*) AS shingles, min(shingle) AS first FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
HAVING count(*) > 0
UNION ALL SELECT 'difference', count(*), min(shingle) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) HAVING count(*) > 0
UNION ALL SELECT 'union', count(*), min(shingle) FROM (SELECT * FROM a UNION SELECT * FROM b) HAVING count(*) > 0""",
}
