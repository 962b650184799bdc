"""Oracle evaluation, catalogs, metrics and the authorship model over labelled documents."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from revlens.operators import catalog, evaluate, features, learn, reuse, validation
from revlens.session import materialise
from revlens.sources import documents as document_sources

from .inputs import DOCUMENT_SAMPLES_SQL, document_samples, table
from .text_queries import PLACES, features_sql

CLASSES = ("ai", "human", "hybrid")


def labelled_documents(spark, sf_dir):
    label = F.when(F.col("toxic") == 1, "hybrid").when(F.col("quality") == 1, "human").otherwise("ai")
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("sample_id"), F.col("source").alias("group_id"), label.alias("label"), F.col("text").alias("code"),
        "lang",
    )


def with_scores(frame):
    """Made-up class scores from the id, leaning towards the label."""
    raw = {
        name: F.col("sample_id") * factor % modulus + 1 + F.when(F.col("label") == name, 40).otherwise(0)
        for name, factor, modulus in (("ai", 37, 101), ("human", 53, 97), ("hybrid", 71, 89))
    }
    total = raw["ai"] + raw["human"] + raw["hybrid"]
    return frame.withColumns({f"p_{name}": value / total for name, value in raw.items()})


def predictions(spark, sf_dir):
    return evaluate.with_prediction(with_scores(labelled_documents(spark, sf_dir).drop("code")), CLASSES)


def fixtures(spark, sf_dir):
    return labelled_documents(spark, sf_dir).select(
        F.col("sample_id").alias("fixture_id"), F.col("lang").alias("oracle"), F.col("code").alias("content"),
        (F.col("label") == "hybrid").alias("expected_detection"),
        F.when(F.col("lang") == "fr", F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("SECRET-LITERAL"), F.lit("SQL-FORMAT"))).alias("supported_rule_ids"),
    )


def oracle_results(spark, sf_dir):
    rows = evaluate.oracle_results(fixtures(spark, sf_dir))
    return rows.withColumns({
        "matched_rule_ids": F.array_join("matched_rule_ids", ","), "notes": F.array_join("notes", ","),
    })


def oracle_summary(spark, sf_dir):
    rows = evaluate.oracle_summary(evaluate.oracle_results(fixtures(spark, sf_dir)), ["oracle"])
    return rows.withColumns({name: F.round(name, PLACES) for name in ("precision", "recall", "f1")})


def detection_regressions(spark, sf_dir):
    summary = evaluate.oracle_summary(evaluate.oracle_results(fixtures(spark, sf_dir)), ["oracle"])
    languages = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("oracle")).agg(F.count(F.lit(1)).alias("n"))
    baseline = languages.select(
        "oracle", F.when(F.col("oracle") == "es", "short").otherwise(F.sha1("oracle")).alias("revision"),
        F.when(F.col("oracle") == "de", F.lit(-1)).otherwise(F.col("n")).cast("long").alias("detected"),
    )
    return evaluate.detection_regressions(summary, baseline, ["oracle"])


def label_rows(spark, sf_dir):
    rows = labelled_documents(spark, sf_dir).withColumn("label", F.when(F.col("lang") == "es", "unknown").otherwise(F.col("label")))
    return evaluate.labelled(rows).groupBy("label", "group_id").agg(F.count(F.lit(1)).alias("samples"))


def training_counts(spark, sf_dir):
    return evaluate.training_counts(labelled_documents(spark, sf_dir))


def fold_leakage(spark, sf_dir):
    rows = evaluate.assign_folds(labelled_documents(spark, sf_dir).drop("code"), 5)
    return rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("fold").alias("folds"))


def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_names(evaluate.confusion(predictions(spark, sf_dir), CLASSES))


def class_metrics(spark, sf_dir):
    rows = evaluate.class_metrics(evaluate.confusion(predictions(spark, sf_dir), CLASSES))
    return rows.select("class", *[F.round(name, PLACES).alias(name) for name in ("precision", "recall", "f1")], "support")


def overall_metrics(spark, sf_dir):
    per_class = evaluate.class_metrics(evaluate.confusion(predictions(spark, sf_dir), CLASSES))
    rows = evaluate.overall_metrics(per_class)
    return rows.select(*[F.round(name, PLACES).alias(name) for name in rows.columns])


def probability_metrics(spark, sf_dir):
    rows = evaluate.probability_metrics(predictions(spark, sf_dir), CLASSES)
    return rows.select(*[F.round(name, PLACES).alias(name) for name in rows.columns])


def calibration_error(spark, sf_dir):
    rows = evaluate.calibration_error(evaluate.calibration_bins(predictions(spark, sf_dir)))
    return rows.select(F.round("ece_10bin", PLACES).alias("ece_10bin"))


def ranking_metrics(spark, sf_dir):
    rows = evaluate.ranking_metrics(predictions(spark, sf_dir), CLASSES)
    return rows.select("class", F.round("roc_auc", PLACES).alias("roc_auc"),
                       F.round("average_precision", PLACES).alias("average_precision"))


def model_metrics(spark, sf_dir):
    """All published metrics of given predictions, as one table."""
    rows = evaluate.metric_table(predictions(spark, sf_dir), CLASSES, len(features.FEATURE_NAMES))
    return rows.select("metric", F.round("value", PLACES).alias("value"))


def bootstrap_interval(spark, sf_dir):
    rows = evaluate.bootstrap_macro_f1(predictions(spark, sf_dir))
    return rows.select(*[F.round(name, PLACES).alias(name) for name in rows.columns])


def estimates(spark, sf_dir):
    rows = with_scores(labelled_documents(spark, sf_dir).drop("code")).withColumns({
        "p_hybrid": F.when(F.col("lang") != "en", F.col("p_hybrid")),
        "ood_score": F.col("sample_id") * 13 % 100 / 100.0,
        "public_reuse_fraction": F.col("sample_id") * 7 % 100 / 100.0,
    })
    result = evaluate.estimates(rows)
    return result.select(
        "sample_id", "predicted_label", "abstained", "claim", F.round("confidence", PLACES).alias("confidence"),
        F.round("organic_fraction", PLACES).alias("organic_fraction"),
    )


def estimate_violations(spark, sf_dir):
    rows = with_scores(labelled_documents(spark, sf_dir).drop("code"))
    shifted = rows.withColumn("p_ai", F.when(F.col("lang") == "de", F.col("p_ai") + 0.5).otherwise(F.col("p_ai")))
    return validation.probabilities_off_one(shifted, "estimates", ("sample_id",), ("p_ai", "p_human", "p_hybrid")).drop("detail")


def catalog_rows(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    talk = table(spark, sf_dir, "conversations")
    pages = table(spark, sf_dir, "pages")
    files = documents.select(F.concat(F.lit("python/"), "lang", F.lit("/d "), "doc_id", F.lit(".py")).alias("path"),
                             F.col("text").alias("content"))
    tasks = talk.select(
        F.concat(F.lit(" conv__"), "conv_id", F.lit("-"), "turn").alias("instance_id"), F.col("role").alias("repo"),
        F.sha1(F.col("conv_id").cast("string")).alias("base_commit"), F.col("role").alias("problem_statement"),
        F.lit("diff").alias("patch"),
    )
    links = pages.select(F.col("url").alias("URL"), F.concat("url", F.lit("#"), "page_id").alias("MentionedURL"))
    return (
        catalog.codeql_rows(files).unionByName(catalog.swebench_rows(tasks)).unionByName(catalog.devgpt_rows(links))
    )


def fixture_catalog(spark, sf_dir):
    return catalog_rows(spark, sf_dir).select(
        "dataset_id", "record_id", "category", "ground_truth_scope", "source_url", "payload_hash", "local_path"
    )


def catalog_counts(spark, sf_dir):
    return catalog.catalog_counts(catalog_rows(spark, sf_dir))


def catalog_violations(spark, sf_dir):
    rows = catalog_rows(spark, sf_dir)
    bent = rows.withColumns({
        "payload_hash": F.when(F.col("payload_hash").startswith("0"), F.upper("payload_hash")).otherwise(F.col("payload_hash")),
        "source_revision": F.when(F.col("payload_hash").startswith("a"), "").otherwise(F.col("source_revision")),
        "authorship_label": F.when(F.col("payload_hash").startswith("b"), "ai"),
        "category": F.when(F.col("payload_hash").startswith("c"), "other").otherwise(F.col("category")),
    })
    return document_sources.catalog_violations(bent).groupBy("rule").agg(
        F.count(F.lit(1)).alias("records"), F.min("key").alias("first")
    )


def payload_violations(spark, sf_dir):
    """Cached payloads of all three datasets, keys in another order than the catalog's; some are altered, some gone."""
    rows = catalog_rows(spark, sf_dir)
    documents = table(spark, sf_dir, "documents").filter(F.col("source") != "src9")
    name = F.concat(F.lit("codeql/python-"), "lang", F.lit("-d-"), "doc_id", F.lit(".py.json"))
    none = F.lit(None).cast("string")
    sources = documents.select(
        name.alias("local_path"), none.alias("payload"),
        F.when(F.col("source") == "src8", F.upper("text")).otherwise(F.col("text")).alias("content"),
    )
    talk = table(spark, sf_dir, "conversations").filter(F.col("turn") % 4 != 3)
    tasks = talk.select(
        F.concat(F.lit("swebench/conv__"), "conv_id", F.lit("-"), "turn", F.lit(".json")).alias("local_path"),
        F.to_json(F.struct(
            F.col("role").alias("repo"), F.col("role").alias("problem_statement"), F.when(F.col("turn") % 4 == 2, "other").otherwise("diff").alias("patch"),
            F.concat(F.lit(" conv__"), "conv_id", F.lit("-"), "turn").alias("instance_id"), F.sha1(F.col("conv_id").cast("string")).alias("base_commit"),
        )).alias("payload"), none.alias("content"))
    pages = table(spark, sf_dir, "pages").filter(F.col("page_id") % 7 != 2)
    mentioned = F.concat("url", F.lit("#"), "page_id")
    links = pages.select(
        F.concat(F.lit("devgpt/"), F.substr(F.sha2(F.concat("url", F.lit(chr(31)), mentioned), 256), F.lit(1), F.lit(20)), F.lit(".json")).alias("local_path"),
        F.when(F.col("page_id") % 7 == 1, "no json").otherwise(
            F.concat(F.lit(' { "URL" :'), F.to_json(F.array("url")).substr(2, 10_000).substr(F.lit(1), F.length(F.to_json(F.array("url"))) - 2),
                     F.lit(', "MentionedURL": "'), mentioned, F.lit('" } '))).alias("payload"), none.alias("content"))
    return catalog.payload_violations(rows, sources.unionByName(tasks).unionByName(links))


def missing_fields(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    rows = talk.select(
        F.concat_ws("-", "conv_id", "turn").alias("instance_id"), F.when(F.col("turn") > 2, F.col("role")).alias("repo"),
        F.when(F.col("role") == "user", F.lit(" ")).otherwise(F.lit("x")).alias("base_commit"),
        F.col("text").alias("problem_statement"), F.col("text").alias("patch"),
    )
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("record"), F.when(F.col("page_id") % 3 == 0, "  ").otherwise(F.col("url")).alias("URL"),
        F.when(F.col("page_id") % 5 > 0, F.col("url")).alias("MentionedURL"))
    return validation.missing_fields(rows, "swebench", ("instance_id",), validation.SWEBENCH_FIELDS).unionByName(
        validation.missing_fields(pages, "devgpt", ("record",), validation.DEVGPT_FIELDS))


def manifest_violations(spark, sf_dir):
    rows = labelled_documents(spark, sf_dir).select(
        (F.col("sample_id") - F.col("sample_id") % 2).cast("string").alias("sample_id"),
        F.when(F.col("lang") == "es", "robot").otherwise(F.col("label")).alias("label"),
        F.when(F.col("lang") == "de", "heuristic").otherwise("declared").alias("label_source"),
        F.concat(F.when(F.col("lang") == "fr", "../").otherwise("a/../"), "group_id", F.lit("/x.py")).alias("path"),
    )
    return document_sources.manifest_violations(rows)


def feature_matrix(spark, sf_dir):
    """All sixty places of the vector, under the names they should have."""
    wide = learn.feature_matrix(features.sample_features(document_samples(spark, sf_dir)))
    vector = vector_to_array("features")
    return wide.select("sample_id", F.size(vector).cast("long").alias("columns"),
                       *[F.round(vector[place], PLACES).alias(name) for place, name in enumerate(features.FEATURE_NAMES)])


def scaled_features(spark, sf_dir):
    names = features.FEATURE_NAMES
    wide = materialise(features.sample_features(document_samples(spark, sf_dir)).select("sample_id", *names))
    ready = learn.scaled(wide, learn.standard_scale(wide, names))
    return ready.select("sample_id", *[F.round(name, 5).alias(name) for name in names])


def training_features(spark, sf_dir):
    samples = document_samples(spark, sf_dir)
    labels = labelled_documents(spark, sf_dir).select("sample_id", "label")
    wide = features.sample_features(samples.join(labels, "sample_id")).select("sample_id", "group_id", "label", *features.FEATURE_NAMES)
    return materialise(wide, "features")


# The settings of every fit: 300 trees of any depth that Spark ML allows, 200 isolation trees.
DEFAULTS = learn.ModelConfig()


def model_estimates(spark, sf_dir):
    """Fit on the labelled documents, then estimate every one of them with its reuse share."""
    rows = training_features(spark, sf_dir)
    model = learn.fit(rows, DEFAULTS)
    index = reuse.stored_index(table(spark, sf_dir, "benchmark").select(F.col("text").alias("code")))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("text").alias("code"))
    shares = reuse.overlap_fractions(texts, index, "sample_id").select(
        "sample_id", F.col("fraction").alias("public_reuse_fraction")
    )
    result = model.predict(rows.join(shares, "sample_id"))
    return result.select(
        "sample_id", "predicted_label", "confidence", "ood_score", "abstained", "organic_fraction",
        "public_reuse_fraction", "claim", "p_human", "p_ai", "p_hybrid",
    )


def out_of_fold_metrics(spark, sf_dir):
    classes, _, _, held = learn.cross_fit(training_features(spark, sf_dir), DEFAULTS, keep=False)
    scored = evaluate.with_prediction(held, classes)
    overall = evaluate.overall_metrics(evaluate.class_metrics(evaluate.confusion(scored, classes)))
    return overall.unpivot([], overall.columns, "metric", "value")


QUERIES = {
    "oracle_results": oracle_results,
    "oracle_summary": oracle_summary,
    "detection_regressions": detection_regressions,
    "label_rows": label_rows,
    "training_counts": training_counts,
    "fold_leakage": fold_leakage,
    "confusion_matrix": confusion_matrix,
    "class_metrics": class_metrics,
    "overall_metrics": overall_metrics,
    "probability_metrics": probability_metrics,
    "calibration_error": calibration_error,
    "ranking_metrics": ranking_metrics,
    "model_metrics": model_metrics,
    "bootstrap_interval": bootstrap_interval,
    "estimates": estimates,
    "estimate_violations": estimate_violations,
    "fixture_catalog": fixture_catalog,
    "catalog_counts": catalog_counts,
    "catalog_violations": catalog_violations,
    "payload_violations": payload_violations,
    "missing_fields": missing_fields,
    "manifest_violations": manifest_violations,
    "feature_matrix": feature_matrix,
    "scaled_features": scaled_features,
    "model_estimates": model_estimates,
    "out_of_fold_metrics": out_of_fold_metrics,
}

LABELLED_SQL = """(SELECT doc_id AS sample_id, source AS group_id, CASE WHEN toxic = 1 THEN 'hybrid' WHEN quality = 1 THEN 'human' ELSE 'ai' END AS label,
  text, lang FROM labels JOIN documents USING (doc_id))"""
SCORED_SQL = f"""(SELECT *, a / (a + b + c) AS p_ai, b / (a + b + c) AS p_human, c / (a + b + c) AS p_hybrid FROM (SELECT *,
  (sample_id * 37 % 101 + 1 + CASE label WHEN 'ai' THEN 40 ELSE 0 END)::DOUBLE AS a,
  (sample_id * 53 % 97 + 1 + CASE label WHEN 'human' THEN 40 ELSE 0 END)::DOUBLE AS b,
  (sample_id * 71 % 89 + 1 + CASE label WHEN 'hybrid' THEN 40 ELSE 0 END)::DOUBLE AS c FROM {LABELLED_SQL}))"""
PREDICTED_SQL = f"""(SELECT *, greatest(p_ai, p_human, p_hybrid) AS confidence,
  CASE greatest(p_ai, p_human, p_hybrid) WHEN p_ai THEN 'ai' WHEN p_human THEN 'human' ELSE 'hybrid' END AS predicted FROM {SCORED_SQL})"""
_secret = r"'(?i)(?:api[_-]?key|secret|token|password)\s*=\s*[\"''][^\"'']{8,}'"
ORACLES_SQL = f"""(SELECT sample_id AS fixture_id, lang AS oracle, label = 'hybrid' AS expected_detection, lang <> 'fr' AS supported,
  regexp_matches(text, {_secret}) AS hit FROM {LABELLED_SQL})"""
SUMMARY_SQL = f"""(SELECT oracle, count(*) AS total, count(*) FILTER (supported) AS supported,
  count(*) FILTER (supported AND expected_detection AND hit) AS true_positive, count(*) FILTER (supported AND expected_detection AND NOT hit) AS false_negative,
  count(*) FILTER (supported AND NOT expected_detection AND NOT hit) AS true_negative, count(*) FILTER (supported AND NOT expected_detection AND hit) AS false_positive
  FROM {ORACLES_SQL} GROUP BY oracle)"""
CLASS_SQL = f"""(SELECT class, count(*) FILTER (label = class AND predicted = class) AS hit, count(*) FILTER (label = class) AS support,
  count(*) FILTER (predicted = class) AS guessed FROM {PREDICTED_SQL} CROSS JOIN (VALUES ('ai'), ('human'), ('hybrid')) v(class) GROUP BY class)"""
CLASS_METRICS_SQL = f"""(SELECT class, CASE WHEN guessed = 0 THEN 0 ELSE hit / guessed END::DOUBLE AS precision,
  CASE WHEN support = 0 THEN 0 ELSE hit / support END::DOUBLE AS recall,
  CASE WHEN support + guessed = 0 THEN 0 ELSE 2 * hit / (support + guessed) END::DOUBLE AS f1, support, guessed, hit FROM {CLASS_SQL})"""

CATALOG_SQL = f"""
SELECT 'codeql-python-tests' AS dataset_id, 'python-' || lang || '-d-' || doc_id || '.py' AS record_id, 'security_analyzer_oracle' AS category,
  'analyzer_expectation' AS ground_truth_scope, '{catalog.CODEQL["source_url"]}{catalog.CODEQL["source_revision"]}/python/' || lang || '/d ' || doc_id || '.py' AS source_url,
  sha256(text) AS payload_hash, 'codeql/python-' || lang || '-d-' || doc_id || '.py.json' AS local_path FROM documents
UNION ALL SELECT 'swebench-lite', 'conv__' || conv_id || '-' || turn, 'issue_patch_correctness', 'patch_and_test_outcome', '{catalog.SWEBENCH["source_url"]}',
  sha256('{{"base_commit":"' || sha1(conv_id::VARCHAR) || '","instance_id":" conv__' || conv_id || '-' || turn || '","patch":"diff","problem_statement":"' || role || '","repo":"' || role || '"}}'),
  'swebench/conv__' || conv_id || '-' || turn || '.json' FROM conversations
UNION ALL SELECT 'devgpt', r, 'ai_assisted_trace', 'ai_link_association', '{catalog.DEVGPT["source_url"]}', h, 'devgpt/' || r || '.json'
FROM (SELECT sha256(url || chr(31) || url || '#' || page_id)[:20] AS r, sha256('{{"MentionedURL":"' || url || '#' || page_id || '","URL":"' || url || '"}}') AS h FROM pages)"""

_thresholds = ", ".join(repr(value) for value in evaluate.poisson_thresholds())
BOOTSTRAP_SQL = f"""
WITH cells AS (SELECT group_id, label, predicted, count(*) AS n FROM {PREDICTED_SQL} GROUP BY ALL),
drawn AS (SELECT *, unnest(range(1, 201)) AS replicate FROM cells),
weighted AS (SELECT label, predicted, replicate, n * len(list_filter([{_thresholds}]::DOUBLE[], lambda x: x <=
  ('0x' || sha256('42:' || group_id || ':' || replicate)[:8])::BIGINT / 4294967296.0::DOUBLE)) AS n FROM drawn),
per_class AS (SELECT replicate, class, sum(n) FILTER (label = class) AS support, sum(n) FILTER (predicted = class) AS guessed,
  sum(n) FILTER (label = class AND predicted = class) AS hit
  FROM weighted CROSS JOIN (VALUES ('ai'), ('human'), ('hybrid')) v(class) GROUP BY ALL),
scores AS (SELECT replicate, avg(2 * coalesce(hit, 0) / (coalesce(support, 0) + coalesce(guessed, 0))) AS f1 FROM per_class
  WHERE coalesce(support, 0) + coalesce(guessed, 0) > 0 GROUP BY replicate)
SELECT round(quantile_cont(f1, 0.025), {PLACES}) AS macro_f1_ci_low, round(quantile_cont(f1, 0.975), {PLACES}) AS macro_f1_ci_high FROM scores"""

RANKING_SQL = f"""
WITH s AS (SELECT class, CASE class WHEN 'ai' THEN p_ai WHEN 'human' THEN p_human ELSE p_hybrid END AS score, (label = class)::INT AS pos
  FROM {SCORED_SQL} CROSS JOIN (VALUES ('ai'), ('human'), ('hybrid')) v(class)),
t AS (SELECT class, score, sum(pos) AS pos, count(*) - sum(pos) AS neg FROM s GROUP BY ALL),
c AS (SELECT *, sum(neg) OVER w - neg AS below, sum(pos) OVER d AS tp, sum(pos + neg) OVER d AS n, sum(pos) OVER (PARTITION BY class) AS p,
  sum(neg) OVER (PARTITION BY class) AS q FROM t WINDOW w AS (PARTITION BY class ORDER BY score), d AS (PARTITION BY class ORDER BY score DESC))
SELECT class, sum(pos * (below + neg / 2)) / (max(p) * max(q)) AS roc_auc, sum(pos * tp / n) / max(p) AS average_precision
FROM c GROUP BY class"""

ORACLES = {
    "bootstrap_interval": BOOTSTRAP_SQL,
    "oracle_results": f"""
SELECT fixture_id, oracle, supported AND hit AS detected, expected_detection, CASE WHEN hit THEN 'SECRET-LITERAL' ELSE '' END AS matched_rule_ids,
  supported, CASE WHEN supported THEN '' ELSE '{evaluate.UNSUPPORTED_NOTE}' END AS notes FROM {ORACLES_SQL}""",
    "oracle_summary": f"""
SELECT * EXCLUDE (p, r), round(p, {PLACES}) AS precision, round(r, {PLACES}) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, {PLACES}) AS f1
FROM (SELECT *, CASE WHEN true_positive + false_positive > 0 THEN true_positive / (true_positive + false_positive) END AS p,
  CASE WHEN true_positive + false_negative > 0 THEN true_positive / (true_positive + false_negative) END AS r FROM {SUMMARY_SQL})""",
    "detection_regressions": f"""
SELECT * FROM (SELECT l.oracle, CASE WHEN l.oracle = 'es' THEN 'revision must have 40 characters' WHEN l.oracle = 'de' THEN 'detected count must not be negative'
  WHEN coalesce(true_positive, 0) < n THEN 'baseline ' || n || ', current ' || coalesce(true_positive, 0) END AS detail
FROM (SELECT lang AS oracle, count(*) AS n FROM documents GROUP BY lang) l LEFT JOIN {SUMMARY_SQL} s ON s.oracle = l.oracle) WHERE detail IS NOT NULL""",
    "label_rows": f"SELECT label, group_id, count(*) AS samples FROM {LABELLED_SQL} WHERE lang <> 'es' GROUP BY ALL",
    "training_counts": f"SELECT count(*) AS samples, count(DISTINCT label) AS classes, count(DISTINCT group_id) AS groups FROM {LABELLED_SQL}",
    "fold_leakage": f"SELECT group_id, count(*) AS samples, 1::BIGINT AS folds FROM {LABELLED_SQL} GROUP BY ALL",
    "confusion_matrix": f"""
SELECT 'confusion_' || k1 || '_as_' || k2 AS metric, count(label)::DOUBLE AS value
FROM (VALUES ('ai'), ('human'), ('hybrid')) x(k1) CROSS JOIN (VALUES ('ai'), ('human'), ('hybrid')) y(k2)
LEFT JOIN {PREDICTED_SQL} ON label = k1 AND predicted = k2 GROUP BY ALL""",
    "class_metrics": f"""SELECT class, round(precision, {PLACES}) AS precision, round(recall, {PLACES}) AS recall, round(f1, {PLACES}) AS f1, support
FROM {CLASS_METRICS_SQL}""",
    "overall_metrics": f"""
SELECT round(avg(f1), {PLACES}) AS macro_f1, round(sum(f1 * support) / sum(support), {PLACES}) AS weighted_f1,
  round(avg(recall), {PLACES}) AS balanced_accuracy,
  round((sum(hit) * sum(support) - sum(support * guessed)) / sqrt((sum(support) ** 2 - sum(guessed ** 2)) * (sum(support) ** 2 - sum(support ** 2))), {PLACES}) AS mcc
FROM {CLASS_METRICS_SQL}""",
    "probability_metrics": f"""
SELECT round(-avg(ln(CASE label WHEN 'ai' THEN p_ai WHEN 'human' THEN p_human ELSE p_hybrid END)), {PLACES}) AS log_loss,
  round(avg((p_ai - (label = 'ai')::INT) ** 2 + (p_human - (label = 'human')::INT) ** 2 + (p_hybrid - (label = 'hybrid')::INT) ** 2), {PLACES}) AS multiclass_brier,
  count(*)::DOUBLE AS samples, count(DISTINCT group_id)::DOUBLE AS groups FROM {SCORED_SQL}""",
    "calibration_error": f"""
SELECT round(sum(n * abs(acc - conf)) / sum(n), {PLACES})::DOUBLE AS ece_10bin FROM (SELECT least(floor(confidence * 10), 9) AS bin, count(*) AS n,
  avg((label = predicted)::INT) AS acc, avg(confidence) AS conf FROM {PREDICTED_SQL} GROUP BY bin)""",
    "ranking_metrics": f"""SELECT class, round(roc_auc, {PLACES})::DOUBLE AS roc_auc, round(average_precision, {PLACES})::DOUBLE AS average_precision
FROM ({RANKING_SQL})""",
    "estimates": f"""
WITH e AS (SELECT sample_id, p_human / t AS h, p_ai / t AS a, coalesce(y, 0) / t AS y, o, u FROM (SELECT *, CASE WHEN lang <> 'en' THEN p_hybrid END AS y,
    p_human + p_ai + coalesce(CASE WHEN lang <> 'en' THEN p_hybrid END, 0) AS t, (sample_id * 13 % 100) / 100 AS o, (sample_id * 7 % 100) / 100 AS u FROM {SCORED_SQL})),
f AS (SELECT *, greatest(h, a, y) AS c, greatest(h, a, y) < 0.6 OR o >= 0.7 AS abstained, CASE greatest(h, a, y) WHEN h THEN 'human' WHEN a THEN 'ai' ELSE 'hybrid' END AS l FROM e)
SELECT sample_id, CASE WHEN abstained THEN 'unknown' ELSE l END AS predicted_label, abstained,
  CASE WHEN abstained THEN 'Unknown/OOD: available evidence does not support an authorship estimate.' ELSE 'Statistically most consistent with ' || l || '; this is not proof of authorship.' END AS claim,
  round(c, {PLACES}) AS confidence, round(CASE WHEN NOT abstained THEN (h + 0.5 * y) * (1 - u) END, {PLACES}) AS organic_fraction FROM f""",
    "estimate_violations": f"""SELECT 'estimates' AS "table", sample_id::VARCHAR AS key, 'probabilities_sum' AS rule FROM {LABELLED_SQL} WHERE lang = 'de'""",
    "fixture_catalog": CATALOG_SQL,
    "catalog_counts": f"SELECT dataset_id, category, count(*) AS records, 0::BIGINT AS authorship_labels FROM ({CATALOG_SQL}) GROUP BY ALL",
    "catalog_violations": f"""
WITH c AS (SELECT *, dataset_id || '|' || record_id AS key FROM ({CATALOG_SQL}))
SELECT rule, count(*) AS records, min(key) AS first FROM (
  SELECT 'duplicate_key' AS rule, key FROM c GROUP BY key HAVING count(*) > 1
  UNION ALL SELECT 'sha256:payload_hash', key FROM c WHERE starts_with(payload_hash, '0') AND regexp_matches(payload_hash, '[a-f]')
  UNION ALL SELECT 'source_provenance', key FROM c WHERE starts_with(payload_hash, 'a')
  UNION ALL SELECT 'authorship_label', key FROM c WHERE starts_with(payload_hash, 'b')
  UNION ALL SELECT 'domain:category', key FROM c WHERE starts_with(payload_hash, 'c')) GROUP BY rule""",
    "payload_violations": """
SELECT 'fixture_catalog' AS "table", 'codeql-python-tests|python-' || lang || '-d-' || doc_id || '.py' AS key,
  CASE WHEN source = 'src9' THEN 'payload_missing' ELSE 'hash_mismatch' END AS rule, 'codeql/python-' || lang || '-d-' || doc_id || '.py.json' AS detail
FROM documents WHERE source = 'src9' OR (source = 'src8' AND upper(text) <> text)
UNION ALL SELECT 'fixture_catalog', 'swebench-lite|conv__' || conv_id || '-' || turn, CASE turn % 4 WHEN 3 THEN 'payload_missing' ELSE 'hash_mismatch' END,
  'swebench/conv__' || conv_id || '-' || turn || '.json' FROM conversations WHERE turn % 4 IN (2, 3)
UNION ALL SELECT 'fixture_catalog', 'devgpt|' || r, CASE page_id % 7 WHEN 2 THEN 'payload_missing' ELSE 'hash_mismatch' END, 'devgpt/' || r || '.json'
FROM (SELECT page_id, sha256(url || chr(31) || url || '#' || page_id)[:20] AS r FROM pages) WHERE page_id % 7 IN (1, 2)""",
    "missing_fields": """
SELECT 'swebench' AS "table", conv_id || '-' || turn AS key, 'missing_fields' AS rule,
  concat_ws(',', CASE WHEN role = 'user' THEN 'base_commit' END, CASE WHEN trim(text) = '' THEN 'patch' END, CASE WHEN trim(text) = '' THEN 'problem_statement' END, CASE WHEN turn <= 2 THEN 'repo' END) AS detail
FROM conversations WHERE turn <= 2 OR role = 'user' OR trim(text) = ''
UNION ALL SELECT 'devgpt', page_id::VARCHAR, 'missing_fields', concat_ws(',', CASE WHEN page_id % 5 = 0 THEN 'MentionedURL' END, CASE WHEN page_id % 3 = 0 THEN 'URL' END)
FROM pages WHERE page_id % 3 = 0 OR page_id % 5 = 0""",
    "manifest_violations": f"""
WITH m AS (SELECT (sample_id - sample_id % 2)::VARCHAR AS key, * FROM {LABELLED_SQL})
SELECT 'manifest' AS "table", key, 'duplicate_key' AS rule, count(*)::VARCHAR AS detail FROM m GROUP BY key HAVING count(*) > 1
UNION ALL SELECT 'manifest', key, 'domain:label', 'robot' FROM m WHERE lang = 'es'
UNION ALL SELECT 'manifest', key, 'weak_label_source', 'heuristic' FROM m WHERE lang = 'de'
UNION ALL SELECT 'manifest', key, 'escapes_root:path', '../' || group_id || '/x.py' FROM m WHERE lang = 'fr'""",
    "feature_matrix": f"""SELECT sample_id, 60::BIGINT AS columns, {", ".join(features.FEATURE_NAMES)}
FROM ({features_sql(DOCUMENT_SAMPLES_SQL, "#[^" + chr(92) + "n]*")})""",
    "scaled_features": "SELECT sample_id, "
    + ", ".join(f"round(({n} - avg({n}) OVER ()) / CASE WHEN stddev_pop({n}) OVER () = 0 THEN 1 ELSE stddev_pop({n}) OVER () END, 5) AS {n}" for n in features.FEATURE_NAMES)
    + " FROM (" + features_sql(DOCUMENT_SAMPLES_SQL, "#[^" + chr(92) + "n]*").replace(f", {PLACES}) AS", ", 15) AS") + ")",
}


def _one_row(name: str) -> str:
    return f"SELECT metric, value FROM ({ORACLES[name]}) UNPIVOT (value FOR metric IN (COLUMNS(*)))"


ORACLES["model_metrics"] = f"""
SELECT 'group_oof_' || metric AS metric, value FROM ({_one_row("overall_metrics")})
UNION ALL SELECT CASE WHEN metric IN ('samples', 'groups') THEN metric ELSE 'group_oof_' || metric END, value FROM ({_one_row("probability_metrics")})
UNION ALL SELECT 'group_oof_' || metric, value FROM ({_one_row("calibration_error")})
UNION ALL SELECT 'group_oof_' || metric, value FROM ({_one_row("bootstrap_interval")})
UNION ALL SELECT 'group_oof_roc_auc_ovr_macro', round(avg(roc_auc), {PLACES}) FROM ({RANKING_SQL})
UNION ALL SELECT 'group_oof_pr_auc_macro', round(avg(average_precision), {PLACES}) FROM ({RANKING_SQL})
UNION ALL SELECT 'features', 60
UNION ALL SELECT metric, value FROM ({ORACLES["confusion_matrix"]})
UNION ALL SELECT 'class_' || class || '_' || name, value FROM (SELECT class, precision, recall, f1, support::DOUBLE AS support FROM ({ORACLES["class_metrics"]}))
  UNPIVOT (value FOR name IN (precision, recall, f1, support))"""
