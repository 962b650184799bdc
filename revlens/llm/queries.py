"""Registered queries of the operators, one for each, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.session import shared_folder

from . import ann, fingerprints, heap_means, id_store, language, main_text, packing, parity_join, phrases, piece_bpe, sharding, toxicity, url_filter

URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op3_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/id-store-{uuid.uuid4().hex}"
    store = id_store.write_store(documents, folder, public_tokenizers.path("word_bpe_49k.json"))
    return store.lookup(documents, keep_ids=False)


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    chain = toxicity.fit(documents, _table(spark, sf_dir, "labels"))
    return toxicity.score_documents(documents.select("doc_id", "text"), chain).drop("text")


def op5_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_documents(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op6_boosted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_byte_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out(F.col("doc_id")))
    network = language.fit(documents.filter("not held_out"))
    return language.predict_languages(documents.drop("lang"), network).drop("text")


def op8_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.similar_documents(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op9_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_weighted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_edits(_table(spark, sf_dir, "documents"))


def op11_phrase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return main_text.extract(pages.select("page_id", "url", "html"), main_text.fit(pages))


def op13_heap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_means.cluster(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (op1_learned_partitions, op2_rendezvous_shards, op3_id_store, op4_toxicity_chain, op5_piece_bpe,
                  op6_boosted_urls, op7_byte_language, op8_parity_join, op9_sum_of_squares, op10_weighted_samples,
                  op11_phrase_graph, op12_block_labeller, op13_heap_clusters)
}



def _clusters_sql(clusters: int = 8, rounds: int = 10) -> str:
    """The rounds one after another, each an assignment and floored means."""
    steps = [f"""
    kept AS MATERIALIZED (
        SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    ), centroids0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS cluster, v AS c
        FROM kept QUALIFY cluster < {clusters}
    )"""]
    for turn in range(rounds + 1):
        steps.append(f"""assigned{turn} AS MATERIALIZED (
        SELECT place, vec_id, v, cluster, distance FROM (
            SELECT *, row_number() OVER (PARTITION BY place ORDER BY distance, cluster) AS nearest
            FROM (SELECT place, vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
                  FROM kept, centroids{turn}))
        WHERE nearest = 1
    )""")
        if turn < rounds:
            steps.append(f"""centroids{turn + 1} AS MATERIALIZED (
        SELECT cluster, coalesce(m, c) AS c FROM centroids{turn} LEFT JOIN (
            SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (
                SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
                FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS i FROM assigned{turn}) GROUP BY cluster, i)
            GROUP BY cluster) USING (cluster)
    )""")
    return "WITH " + ", ".join(steps) + f"""
    SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
           CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM assigned{rounds} JOIN centroids{rounds} USING (cluster)"""


# What SQL can't express, or only too slowly on whole tables, is tested against brute force.
ORACLES: dict[str, str] = {
    "op11_phrase_graph": r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ), lists AS (
        SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces
    ), grams AS (
        SELECT lang, k, array_to_string(g, ' ') AS phrase, count(*) AS f
        FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) AS g
              FROM lists, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)
        GROUP BY ALL
    ), candidates AS (
        SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 10
    ), covered AS (
        SELECT s.lang, s.phrase FROM candidates s
        JOIN (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
              FROM candidates WHERE k = 3) t USING (lang, phrase)
        WHERE s.k = 2 AND 100 * t.a >= 50 * s.a
    ), cuts AS (
        SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest
        FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)
        WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM covered)
    ), scored AS (
        SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r,
               (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
        FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.head JOIN grams y ON y.lang = c.lang AND y.phrase = c.rest
    ), best AS (
        SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
    ), totals AS (
        SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang
    )
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op13_heap_clusters": _clusters_sql(),
}
