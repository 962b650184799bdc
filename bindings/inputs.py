"""Operator inputs derived from the driver tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.session import spread

# SQL spellings of the character classes used by the oracles.
W = r"\p{L}\p{N}_"
S = (
    r"\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"


TEXT_TABLES = ("documents", "pages", "conversations", "benchmark")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in TEXT_TABLES else scan


def with_target(df: DataFrame, repository: Column) -> DataFrame:
    return df.withColumns({
        "repository_id": repository.cast("string"),
        "snapshot_id": F.concat(F.lit("snap_"), repository.cast("string")),
        "head_sha": F.sha2(repository.cast("string"), 256),
    })


def document_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as code samples; the language falls to the default comment rule."""
    documents = table(spark, sf_dir, "documents")
    return with_target(documents, F.col("source")).select(
        F.col("doc_id").alias("sample_id"), "repository_id", "snapshot_id", "head_sha",
        F.col("source").alias("group_id"), F.col("lang").alias("language"),
        F.col("text").alias("code"),
        F.concat(F.lit("docs/d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.concat(F.lit("Import ABC-"), F.col("doc_id").cast("string"), F.lit(" from #"),
                 F.col("n_chars").cast("string"), F.lit("\n\nsource "), F.col("source")).alias("commit_message"),
        F.lit(1).cast("long").alias("files_changed"),
        F.col("n_chars").alias("additions"),
        (F.col("doc_id") * 7).alias("deletions"),
    )


DOCUMENT_SAMPLES_SQL = """
SELECT doc_id AS sample_id, source AS repository_id, 'snap_' || source AS snapshot_id,
       sha256(source) AS head_sha, source AS group_id, lang AS language, text AS code,
       'docs/d' || doc_id || '.txt' AS path,
       'Import ABC-' || doc_id || ' from #' || n_chars || chr(10) || chr(10) || 'source ' || source AS commit_message,
       1 AS files_changed, n_chars AS additions, doc_id * 7 AS deletions
FROM documents
"""


def page_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as JavaScript samples: a line comment, a block comment, then the markup."""
    pages = table(spark, sf_dir, "pages")
    return with_target(pages, F.substring_index(F.substring_index("url", "/", 3), "/", -1)).select(
        F.col("page_id").alias("sample_id"), "repository_id", "snapshot_id", "head_sha",
        F.lit("javascript").alias("language"),
        F.concat(F.lit("// "), F.col("url"), F.lit("\n/* page\n"), F.col("page_id").cast("string"),
                 F.lit(" */\n"), F.col("html")).alias("code"),
        F.concat(F.lit("web/p"), F.col("page_id").cast("string"), F.lit(".js")).alias("path"),
        F.lit("").alias("commit_message"),
        F.lit(0).cast("long").alias("files_changed"),
        F.lit(0).cast("long").alias("additions"),
        F.lit(0).cast("long").alias("deletions"),
    )


PAGE_SAMPLES_SQL = """
SELECT page_id AS sample_id, 'javascript' AS language,
       '// ' || url || chr(10) || '/* page' || chr(10) || page_id || ' */' || chr(10) || html AS code,
       '' AS commit_message, 0 AS files_changed, 0 AS additions, 0 AS deletions
FROM pages
"""


def _statement(number: Column) -> Column:
    return (
        F.when(number == 1, F.concat(F.lit("value = eval (row"), F.col("l_partkey"), F.lit(")")))
        .when(number == 2, F.concat(F.lit("exec(source"), F.col("l_partkey"), F.lit("); exec(tail)")))
        .when(number == 3, F.lit("run(command, shell =\n    True)"))
        .when(number == 4, F.lit("db.execute(f\"SELECT {column} FROM t\")"))
        .when(number == 5, F.lit("get(url, verify = False)  # import os"))
        .when(number == 6, F.concat(F.lit("from package"), F.col("l_suppkey"), F.lit(" import load\npickle.loads(blob)")))
        .otherwise(F.concat(F.lit("import module"), F.col("l_partkey"), F.lit("\nAPI_KEY = 'abcdefgh"),
                            F.col("l_partkey"), F.lit("'")))
    )


def script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One script of three statements per line item: gives every security rule hits."""
    lineitem = spread(table(spark, sf_dir, "lineitem"))
    folder = F.when(F.col("l_orderkey") % 10 == 0, "tests/s").otherwise("src/s")
    keyed = with_target(lineitem, F.concat(F.lit("repo"), (F.col("l_orderkey") % 97).cast("string")))
    return keyed.select(
        "repository_id", "snapshot_id", "head_sha",
        F.concat_ws("\n", _statement(F.col("l_linenumber")), _statement(F.col("l_partkey") % 7),
                    _statement(F.col("l_suppkey") % 9)).alias("code"),
        F.concat(folder, F.col("l_orderkey"), F.lit("/m"), F.col("l_linenumber"), F.lit("_"),
                 F.col("l_partkey"), F.lit(".py")).alias("path"),
    )


def _statement_sql(number: str) -> str:
    return f"""CASE {number}
   WHEN 1 THEN 'value = eval (row' || l_partkey || ')'
   WHEN 2 THEN 'exec(source' || l_partkey || '); exec(tail)'
   WHEN 3 THEN 'run(command, shell =' || chr(10) || '    True)'
   WHEN 4 THEN 'db.execute(f"SELECT {{column}} FROM t")'
   WHEN 5 THEN 'get(url, verify = False)  # import os'
   WHEN 6 THEN 'from package' || l_suppkey || ' import load' || chr(10) || 'pickle.loads(blob)'
   ELSE 'import module' || l_partkey || chr(10) || 'API_KEY = ''abcdefgh' || l_partkey || '''' END"""


SCRIPT_FILES_SQL = f"""
SELECT 'repo' || (l_orderkey % 97) AS repository_id,
  CASE WHEN l_orderkey % 10 = 0 THEN 'tests/s' ELSE 'src/s' END || l_orderkey || '/m' || l_linenumber || '_' || l_partkey || '.py' AS path,
  concat_ws(chr(10), {_statement_sql("l_linenumber")}, {_statement_sql("l_partkey % 7")}, {_statement_sql("l_suppkey % 9")}) AS code
FROM lineitem"""
