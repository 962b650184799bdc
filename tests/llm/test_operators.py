"""The ten operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import math
import struct
import zlib
from collections import defaultdict
from functools import lru_cache

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
import xxhash
from pyspark.sql import functions as F

from revlens.llm import ann, fingerprints, id_store, language, packing, parity_join, piece_bpe, sharding, shingles, toxicity, url_filter, wordwise

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

ODD = [
    (1, "the cat sat on the mat and the cat ran away from the big dog today"),
    (2, "the cat sat on the mat and the cat ran away from the big dog today"),
    (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "a  b\n\nc   d \t e"), (8, "word " * 30_000), (9, "x" * 50_000),
    (10, "İstanbul ſtraße 漢字 😀 é́ <|endoftext|> it's We'LL"), (None, "null key here"), (11, "again"), (11, "again"), (11, "other text"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with columns whose names clash with those of the operators."""
    rows = [(key, text, "en", 7, 1.5, "h", "p", 3) for key, text in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, shard int, score double, host string, path string, size long").repartition(3)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@lru_cache
def tokenizer(path):
    return tokenizers.Tokenizer.from_file(path)


def ids_of(path, text, end=1):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids + [end]


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_nearest_agrees_with_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = ann.nearest(table, F.col("vec_id") % 50 == 0).collect()
    rows = table.toPandas()
    vectors = np.stack(rows["embedding"].to_numpy()).astype(float)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = wanted = 0
    by_query = defaultdict(list)
    for row in found:
        by_query[row["query_id"]].append(row)
    for place, name in enumerate(rows["vec_id"]):
        if name % 50:
            continue
        scores = unit @ unit[place]
        best = [rows["vec_id"][k] for k in np.lexsort((rows["vec_id"], -scores)) if k != place][:5]
        mine = sorted(by_query[name], key=lambda row: row["rank"])
        assert [row["rank"] for row in mine] == [1, 2, 3, 4, 5]
        for row in mine:
            other = int(np.flatnonzero(rows["vec_id"] == row["vec_id"])[0])
            assert row["score"] == pytest.approx(scores[other], abs=1e-12)
        hits += len({row["vec_id"] for row in mine} & set(best))
        wanted += 5
    assert hits / wanted >= 0.9


def test_nearest_odd_vectors_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]),
            (8, [1.0, None]), (9, [0.0, 1.0]), (10, [1.0, 2.0, 3.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), *[(100 + k, [1.0, 0.0]) for k in range(300)]]
    table = spark.createDataFrame([(*row, 1, 0.5) for row in rows], "vec_id long, embedding array<float>, part int, score double")
    found = sorted(map(tuple, ann.nearest(table, F.col("vec_id").isin(0, 3, 50)).collect()))
    assert [row[2] for row in found if row[0] == 0] == [1, 2, 50, 100, 101]
    assert [row[2] for row in found if row[0] == 50] == [0, 1, 2, 100, 101]
    assert {row[0] for row in found} == {0, 50} and all(row[3] == 1.0 for row in found)
    assert ann.nearest(table.limit(0), F.lit(True)).collect() == []
    few = ann.nearest(table.filter("vec_id in (0, 9)"), F.col("vec_id") == 0).collect()
    assert [tuple(row) for row in few] == [(0, 1, 9, 0.0)]


def brute_shard(key, count):
    base = xxhash.xxh64_intdigest(("" if key is None else str(key)).encode(), 42)
    def score(number):
        drawn = xxhash.xxh64_intdigest(struct.pack("<i", number), xxhash.xxh64_intdigest(struct.pack("<q", base - (base >> 63 << 64)), 42))
        return -math.log(((drawn >> 11) + 0.5) * 2.0**-53), number
    return min(map(score, range(count)))[1]


def test_rendezvous_shards(documents, odd):
    for table in (documents, odd):
        rows = sharding.shard_documents(table).collect()
        assert len(rows) == table.count()
        texts = defaultdict(list)
        for row in table.collect():
            texts[row["doc_id"]].append(row["text"] or "")
        slots = defaultdict(list)
        for row in rows:
            assert row["grown_shard"] in (row["shard"], 40)
            assert (row["size"], row["text_crc32"]) in {(len(t.encode()) + 16, zlib.crc32(t.encode())) for t in texts[row["doc_id"]]}
            slots[row["shard"]].append(row["slot"])
        assert all(sorted(found) == list(range(len(found))) for found in slots.values())
        for row in rows[:60]:
            assert row["shard"] == brute_shard(row["doc_id"], 40) and row["grown_shard"] == brute_shard(row["doc_id"], 41)
    assert sharding.shard_documents(documents.limit(0)).collect() == []


def test_rendezvous_weights(spark):
    rows = spark.range(20_000).select(sharding.rendezvous_shard(F.col("id"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    assert dict(map(tuple, rows))[1] == pytest.approx(15_000, rel=0.03)
    with pytest.raises(ValueError):
        sharding.rendezvous_shard(F.lit(1), [1.0, 0.0])


def test_id_store_round_trip(odd, documents, tmp_path):
    for place, table in enumerate((odd, documents, documents.limit(0))):
        store = id_store.write_store(table, f"file://{tmp_path}/{place}", WORDS)
        found = sorted(store.lookup(table).collect(), key=lambda row: row["start"])
        wanted, start = [], 0
        for row in sorted(table.collect(), key=lambda row: (row["doc_id"] is not None, row["doc_id"] or 0, (row["text"] or "").encode())):
            ids = ids_of(WORDS, row["text"])
            wanted.append((row["doc_id"], start, len(ids), zlib.crc32(packed(ids)), packed(ids)))
            start += len(ids)
        assert [(*row[:4], bytes(row[4])) for row in map(tuple, found)] == wanted
    missing = store.lookup(odd.filter("doc_id = 6"))
    assert missing.collect() == []


def test_perfect_hash_is_minimal_and_knows_strangers():
    for size in (1, 2, 5, 1000, 20_000):
        hashes = id_store.key_hashes([str(k).encode() for k in range(size)], 0)
        seeds = id_store.perfect_hash(hashes)
        groups = ((hashes >> np.uint64(32)) % np.uint64(len(seeds))).astype(np.int64)
        assert sorted(id_store._slots(hashes, seeds[groups], size)) == list(range(size))


def test_toxicity_chain_on_unseen_rows(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    chain = toxicity.fit(documents, labels.filter(~fold))
    rows = toxicity.score_documents(documents.join(labels.filter(fold), "doc_id"), chain).select("toxic", "is_toxic").collect()
    toxic = [row["is_toxic"] for row in rows if row["toxic"] == 1]
    clean = [row["is_toxic"] for row in rows if row["toxic"] == 0]
    # The small table has too few toxic rows for every made-up word; some of its labels tell nothing.
    assert sum(toxic) / len(toxic) >= 0.85 and sum(clean) / len(clean) <= 0.005


def test_toxicity_odd_rows(spark, odd, documents):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, 1, 1), (11, None, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(odd, labels)
    rows = toxicity.score_documents(odd, chain).collect()
    assert len(rows) == len(ODD) and "score" in rows[0].asDict()
    assert all(row["p_toxic"] == 0 and not row["is_toxic"] for row in rows if not (row["text"] or "").strip())
    none = toxicity.fit(documents, labels.limit(0))
    assert toxicity.score_documents(documents, none).filter("is_toxic").count() == 0
    assert toxicity.score_documents(documents.limit(0), none).collect() == []


def test_piece_bpe_equals_ranked_encoding(odd, documents):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for table in (odd, documents):
        texts = sorted(((row["doc_id"] or -1, row["text"] or "") for row in table.collect() if row["doc_id"] != 9))
        made = sorted(((row["doc_id"] or -1, row) for row in piece_bpe.encode_documents(table, RANKS, public_tokenizers.PATTERN).collect() if row["doc_id"] != 9),
                      key=lambda pair: (pair[0], pair[1]["decoded_sha256"]))
        texts.sort(key=lambda pair: (pair[0], hashlib.sha256(pair[1].encode()).hexdigest()))
        for (key, text), (_, row) in zip(texts, made):
            ids = packed(plain.encode_ordinary(text))
            assert bytes(row["ids"]) == ids and row["n_tokens"] == len(ids) // 4
            assert row["ids_sha256"] == hashlib.sha256(ids).hexdigest() and row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    long = piece_bpe.encode_documents(odd.filter("doc_id = 9"), RANKS, public_tokenizers.PATTERN).first()
    assert long["decoded_sha256"] == hashlib.sha256(b"x" * 50_000).hexdigest()
    assert piece_bpe.encode_documents(documents.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_words_give_the_ids_of_whole_texts():
    parts = ["a", "The", " ", "  ", "\n", "\t", " \n", "é", "ß", "İ", "1", "23", "'s", "'LL", "!", "<|endoftext|>", "\u00a0", "\u3000", "漢字", "😀", "\u0301", "\x1c", "\r\n", "\x01", "%%%", "***,", "&&.", "Ⅷ", "²", "ª", "word", "it's,"]
    draw = np.random.default_rng(1)
    texts = ["".join(draw.choice(parts, draw.integers(0, 40))) for _ in range(1500)]
    for ordinary in (False, True):
        for path, memory in ((WORDS, wordwise.separated_word_memory(WORDS, ordinary)), (BYTES, wordwise.byte_level_memory(BYTES, ordinary))):
            tool = tokenizers.Tokenizer.from_file(path)
            tool.encode_special_tokens = ordinary
            assert [packed(e.ids) for e in tool.encode_batch(texts, add_special_tokens=False)] == memory.payloads(texts)


RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(mark) for mark in "/?#" if mark in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [rule for _, rule in RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith("/" + rule.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules_and_trees(spark):
    urls = ["http://A.Example.NET/en/x?y#z", "https://example.net/de/", "http://net", "http://net/", "http://xnet/", "ftp://a.example.com/de/1", "http://org/fr/?a=1",
            "nothing", None, "", "://", "http://É.net/x", "http://a.net?x=/", "http://a.net#://b", "a://b://net/x", "http://b.org/fr\n/", "http://b.org/fr/\nx?y"]
    table = spark.createDataFrame([(k, url, "x", 1.0) for k, url in enumerate(urls * 2)], "page_id long, url string, host string, prediction double")
    rows = url_filter.filter_urls(table, RULES).collect()
    assert len(rows) == len(urls) * 2
    verdicts = {rule: verdict for verdict, rule in RULES}
    for row in rows:
        assert (row["host"], row["path"], row["rule"]) == brute_rule(urls[row["page_id"] % len(urls)])
        assert row["verdict"] == verdicts[row["rule"]] if row["rule"] else row["verdict"] in ("allow", "block")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = url_filter.filter_urls(pages, RULES)
    assert found.count() == pages.count() and found.filter("judged_by = 'trees'").count() > 0
    assert url_filter.filter_urls(table.limit(0), RULES).collect() == []
    assert {row["verdict"] for row in url_filter.filter_urls(table.filter("url = 'nothing'"), RULES).collect()} == {"allow"}


def test_trees_learn_from_lexical_features(spark):
    rows = spark.range(2000).select(
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("http://a.com/story/"), F.md5(F.col("id").cast("string"))))
        .otherwise(F.concat(F.lit("http://b.com/x?"), F.repeat(F.lit("q=1&"), (F.col("id") % 7 + 2).cast("int")))).alias("url"),
        F.when(F.col("id") % 2 == 0, "allow").otherwise("block").alias("verdict"))
    rows = rows.withColumns({"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))})
    model = url_filter.fit(rows.limit(1000), "url", "verdict", rounds=3)
    assert model.judge(rows, "url").filter("predicted = verdict").count() >= 1980


def labelled_urls(spark, rows):
    table = spark.createDataFrame(rows, "url string, verdict string")
    return table.withColumns({"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))})


def test_repeated_url_leaves_room_for_others(spark):
    rows = [(f"http://a.com/story/{k}", "allow") if k % 2 else (f"http://b.com/x?{'q=1&' * 20}{k}", "block") for k in range(400)]
    table = labelled_urls(spark, rows)
    first = table.orderBy(F.xxhash64("url")).first()
    copies = labelled_urls(spark, rows + [(first["url"], first["verdict"])] * 200)
    model = url_filter.fit(copies, "url", "verdict", rows=100, rounds=3)
    assert model.trees is not None and model.judge(table, "url").filter("predicted = verdict").count() == 400
    # A copy doesn't move the statistics either, and a verdict that few URLs have is learned from.
    assert sorted(map(tuple, model.suffixes.collect())) == sorted(map(tuple, url_filter.fit(table, "url", "verdict", rows=100, rounds=1).suffixes.collect()))
    rare = labelled_urls(spark, [(f"http://a.com/story/{k}", "allow") for k in range(3000)] + rows[:1])
    assert url_filter.fit(rare, "url", "verdict", rows=20, rounds=1).trees is not None


def test_suffix_statistics_count_all_urls(spark):
    rows = [(f"http://h.s{k}/{n}", "block" if k % 3 == 0 else "allow") for k in range(1500) for n in range(2)]
    model = url_filter.fit(labelled_urls(spark, rows), "url", "verdict", rows=50, rounds=1)
    found = {row["_suffix"]: (row["_share"], row["_rate"]) for row in model.suffixes.collect()}
    assert len(found) == 1500
    for k in range(1500):
        assert found[f"s{k}"] == pytest.approx((math.log1p(2) / math.log1p(3000), 0.75 if k % 3 == 0 else 0.25))


def test_language_of_held_out_rows(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumn("held", language.held_out(F.col("doc_id")))
    network = language.fit(documents.filter("not held"))
    rows = language.predict_languages(documents.filter("held"), network).filter("lang is not null and lang_pred <> 'und'").select("lang", "lang_pred").collect()
    assert sum(row["lang"] == row["lang_pred"] for row in rows) / len(rows) >= 0.97


def test_language_odd_rows(spark, odd):
    network = language.fit(odd)
    rows = language.predict_languages(odd, network).collect()
    assert len(rows) == len(ODD) and set(rows[0].asDict()) == {*odd.columns, "lang_pred"}
    for row in rows:
        letters = any(map(str.isalpha, row["text"] or ""))
        assert row["lang_pred"] == ("en" if letters else "und") and 0 <= row["score"] <= 1
    nothing = language.fit(odd.limit(0))
    assert {row["lang_pred"] for row in language.predict_languages(odd, nothing).collect()} == {"und"}
    assert language.predict_languages(odd.limit(0), network).collect() == []


def test_language_learns_from_the_end_of_long_texts(spark):
    draw = np.random.default_rng(4)
    same, ends = ["plain", "common", "start"], {"aa": ["zhu", "xiq", "qeng"], "bb": ["ould", "orth", "amble"]}
    rows = [(name, " ".join([*draw.choice(same, 3000), *draw.choice(words, 12_000)])) for name, words in ends.items() for _ in range(40)]
    network = language.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert network.predict([" ".join(words * 20) for words in ends.values()])[0] == list(ends)


def test_language_knows_every_language(spark):
    rows = [(f"l{k}", f"{chr(0x4E00 + 7 * k) * 40} {n}") for k in range(140) for n in range(2 if k == 77 else 3)]
    network = language.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert len(network.labels) == 140 and network.labels == sorted({name for name, _ in rows})
    texts = [text for _, text in rows]
    with pytest.MonkeyPatch.context() as patch:
        whole = network.predict(texts)
        patch.setattr(language, "_CELLS", 140 * 7)
        found = network.predict(texts)
    assert found[0] == whole[0] and found[1] == pytest.approx(whole[1], abs=1e-5)


def test_language_stage_rejects_junk_and_keeps_unlabelled_corpora(spark, documents, odd):
    draw = np.random.default_rng(8)
    marks = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/")
    junk = [(-1 - k, "".join(draw.choice(marks, 600)), None, 1.5) for k in range(50)]
    extra = spark.createDataFrame(junk + [(-100, "12 34 !", None, 1.5), (-101, None, None, 1.5)], "doc_id long, text string, lang string, score double")
    kept = corpus_pipeline.drop_unknown_language(spark, documents.withColumn("score", F.lit(2.5)).unionByName(extra, allowMissingColumns=True), SF)
    rows = kept.select("doc_id", "score").collect()
    assert {row["score"] for row in rows if row["doc_id"] >= 0} == {2.5}
    lettered = {row["doc_id"] for row in documents.collect() if any(map(str.isalpha, row["text"] or ""))}
    found = {row["doc_id"] for row in rows}
    assert len([k for k in found if k < 0]) <= 2 and lettered <= found
    bare = odd.withColumn("lang", F.lit(None).cast("string"))
    stay = corpus_pipeline.drop_unknown_language(spark, bare, SF)
    assert stay.columns == bare.columns
    assert stay.count() == sum(any(map(str.isalpha, text or "")) for _, text in ODD)


def brute_components(rows, width, percent):
    sets = {}
    for number, (_, text) in enumerate(rows):
        words = (text or "").encode().lower().split()
        sets[number] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    parent = list(range(len(rows)))
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for number in sets:
        groups[root(number)].append(number)
    return sorted(((rows[n][0], len(sets[n]), min((rows[m][0] for m in group if rows[m][0] is not None), default=None)) for group in groups.values() for n in group), key=str)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_similar_documents_agree_with_brute_force(spark, documents, odd, width, percent):
    draw = np.random.default_rng(7)
    vocabulary = [f"w{k}" for k in range(400)]
    made, number = [], 1000
    for _ in range(6):
        base = list(draw.choice(vocabulary, draw.integers(4, 120)))
        for _ in range(25):
            text = list(base)
            for _ in range(draw.integers(0, 1 + len(base) // 12)):
                text[draw.integers(len(text))] = draw.choice(vocabulary)
            made.append((number, " ".join(text)))
            number += 1
    near = spark.createDataFrame(made, "doc_id long, text string")
    for table in (documents, odd, near, documents.limit(0)) if width == 3 else (near,):
        rows = [(row["doc_id"], row["text"]) for row in table.collect()]
        found = sorted((tuple(row) for row in parity_join.similar_documents(table, width=width, percent=percent).collect()), key=str)
        assert found == brute_components(rows, width, percent)


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BLOCK", 8)
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(base[:k] + ["x"] + base[k + 1 :])) for k in range(60)]
    found = parity_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), width=1, percent=95).collect()
    assert {row["component_id"] for row in found} == {0}


def test_keep_one_of_each_group(odd):
    kept = parity_join.keep_one(odd)
    assert kept.columns == odd.columns
    names = sorted((row["doc_id"] is not None, row["doc_id"] or 0, (row["text"] or "")[:6]) for row in kept.collect())
    assert [name[1] for name in names] == [0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 11]


def test_keep_one_where_ids_repeat_or_miss(spark):
    near = {name: [" ".join([f"{name}{k}" for k in range(60)] + [f"end{copy}"]) for copy in range(3)] for name in "uvwx"}
    rows = [(5, text) for text in near["u"]] + [(None, text) for text in near["v"]] + [(None, near["x"][0]), (8, near["x"][1]), (6, near["x"][1])]
    # A near copy stays away even where an unrelated row has its id; one of two spellings of the same words stays.
    rows += [(7, near["w"][0]), (9, near["w"][1]), (9, "an unrelated text"), (12, "the same words"), (12, "The  Same words"), (12, "the same words")]
    kept = [tuple(row) for row in parity_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(str(key) for key, _ in kept) == ["12", "5", "6", "7", "9", "None"]
    assert {text for key, text in kept if key in (6, 7, 9)} == {near["x"][1], near["w"][0], "an unrelated text"}
    assert all(row in rows for row in kept)


def test_keep_one_deals_whole_rows_out_once(spark, odd):
    """One exchange below the window, one of the narrow side; the join adds none."""
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = parity_join.keep_one(odd)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)
    assert plan.count("hashpartitioning(_id") == 2 and "hashpartitioning(_key" not in plan


def test_unrelated_sets_share_no_piece():
    """Otherwise chance alone gives a number of candidates that grows with the square of the sets."""
    draw, bands = np.random.default_rng(3), shingles.Bands(80)
    sets = [draw.integers(0, 2**64, draw.integers(300, 330), np.uint64) for _ in range(1500)]
    keys = np.concatenate([np.unique(shingles.piece_keys(found, bands)) for found in sets])
    assert len(np.unique(keys)) == len(keys)


@pytest.mark.parametrize("percent", [80, 90])
def test_sets_at_the_limit_share_a_piece(percent):
    draw, bands = np.random.default_rng(percent), shingles.Bands(percent)
    for size in [*range(1, 60), 100, 333, 1000]:
        for _ in range(10):
            # So many elements go and as many as may come then do, or the other way round.
            gone = int(draw.integers(0, size - -(-size * percent // 100) + 1))
            come = (size - gone) * 100 // percent - size
            one = draw.integers(0, 2**64, size, np.uint64)
            other = np.concatenate([one[gone:], draw.integers(0, 2**64, come, np.uint64)])
            assert 100 * (size - gone) >= percent * (size + come)
            assert np.intersect1d(shingles.piece_keys(one, bands), shingles.piece_keys(other, bands)).size


def test_component_of_equal_texts_with_and_without_id(spark):
    table = spark.createDataFrame([(None, "one two three"), (7, "one two three"), (9, "one two three"), (None, "other")], "doc_id long, text string")
    found = sorted((tuple(row) for row in parity_join.similar_documents(table).collect()), key=str)
    assert found == [(7, 1, 7), (9, 1, 7), (None, 1, 7), (None, 1, None)]


def test_packing_places_every_id_once(documents, odd):
    for table in (documents, odd):
        pieces = packing.pack_documents(table, BYTES, keep_ids=True).collect()
        by_sequence = defaultdict(list)
        for row in pieces:
            assert row["length"] == len(row["ids"]) // 4 and row["ids_crc32"] == zlib.crc32(bytes(row["ids"]))
            by_sequence[row["sequence_id"]].append((row["offset"], row["length"]))
        fills = []
        for found in by_sequence.values():
            place = 0
            for offset, length in sorted(found):
                assert offset == place
                place += length
            assert place <= 2048
            fills.append(place)
        assert sum(fill <= 1024 for fill in fills) <= 1
        wanted = sum(len(ids_of(BYTES, row["text"])) for row in table.collect())
        assert sum(row["length"] for row in pieces) == wanted
        texts = {row["doc_id"]: row["text"] for row in table.collect() if row["doc_id"] not in (11, None)}
        joined = defaultdict(list)
        for row in pieces:
            joined[row["doc_id"]].append((row["start"], bytes(row["ids"]), row["doc_tokens"]))
        for key, text in texts.items():
            ids = packed(ids_of(BYTES, text))
            assert b"".join(part for _, part, _ in sorted(joined[key])) == ids and joined[key][0][2] == len(ids) // 4
    assert packing.pack_documents(documents.limit(0), BYTES).collect() == []


def test_sum_of_squares_rule_is_greedy():
    draw = np.random.default_rng(3)
    packer, levels = packing.SumOfSquares(20, 0, unit=1), {}
    for _ in range(400):
        size = int(draw.integers(1, 20))
        counts = np.bincount([v for v in levels.values() if v < 20], minlength=20)
        def after(level):
            now = counts.astype(int).copy()
            if level:
                now[level] -= 1
            if level + size < 20:
                now[level + size] += 1
            return (now * now).sum()
        best = min(after(level) for level in [0, *[v for v in set(levels.values()) if v + size <= 20 and v < 20]])
        name, offset = packer.place(size)
        assert after(offset) == best and levels.get(name, 0) == offset
        levels[name] = offset + size


@pytest.mark.parametrize("partitions", [1, 32])
def test_windows_are_closed_by_the_rule_however_the_table_is_split(spark, partitions):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").repartition(partitions)
    fills = packing.pack_documents(table, BYTES).groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.count(F.lit(1)).alias("pieces")).collect()
    shared = [row["fill"] for row in fills if row["pieces"] > 1 or row["fill"] < 2048]
    closed = sum(fill > 2048 - packing.UNIT for fill in shared)
    assert closed >= 0.9 * len(shared)
    assert sum(2048 - row["fill"] for row in fills) <= 0.02 * 2048 * len(fills)


def brute_print(text):
    counts = defaultdict(int)
    for word in text.strip(" ").lower().split() or [""]:
        counts[word] += 1
    return counts


def test_fingerprints(documents, odd, spark):
    for table in (documents, odd, documents.filter("doc_id = 5")):
        rows = sorted(((row["doc_id"], row["text"] or "") for row in table.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
        found = fingerprints.fingerprint_with_edits(table).collect()
        assert len(found) == len(rows)
        wanted = []
        for (key, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            wanted.append((str(key), len(text), hashlib.sha256(edited.encode()).hexdigest()))
        assert sorted((str(row["doc_id"]), row["n_chars"], row["edited_sha256"]) for row in found) == sorted(wanted)
        assert all(0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1 for row in found)
    texts = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(ODD)], "k long, text string")
    prints = {row["k"]: row["fingerprint"] for row in fingerprints.fingerprint_texts(texts, ["k"]).collect()}
    assert prints[0] == prints[1] and prints[2] == prints[3] and prints[0] != prints[5]
    assert fingerprints.fingerprint_with_edits(documents.limit(0)).collect() == []


def test_likeness_estimates_weighted_similarity(spark):
    draw = np.random.default_rng(2)
    pairs = []
    for number in range(200):
        words = [f"{number}word{k}" for k in range(60)]
        pairs.append((" ".join(draw.choice(words[:40], 80)), " ".join(draw.choice(words[20:], 80))))
    table = spark.createDataFrame([(k, side, pair[side]) for k, pair in enumerate(pairs) for side in (0, 1)], "k long, side int, text string")
    prints = fingerprints.fingerprint_texts(table, ["k", "side"])
    left, right = (prints.filter(F.col("side") == side).select("k", F.col("fingerprint").alias(f"f{side}")) for side in (0, 1))
    found = left.join(right, "k").select(F.avg(fingerprints.likeness(F.col("f0"), F.col("f1")))).first()[0]
    def true(a, b):
        a, b = brute_print(a), brute_print(b)
        weigh = lambda counts, word: counts.get(word, 0) * len(word) ** 2
        both = set(a) | set(b)
        return sum(min(weigh(a, w), weigh(b, w)) for w in both) / sum(max(weigh(a, w), weigh(b, w)) for w in both)
    assert found == pytest.approx(np.mean([true(*pair) for pair in pairs]), abs=0.03)


def test_nearest_id_with_several_vectors_and_huge_components(spark):
    rows = [(0, [1.0, 0.0]), *[(1, [1.0, 1e-6 * k]) for k in range(1, 9)], *[(k, [1.0, 0.1 * k]) for k in range(2, 12)]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.nearest(table, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [row["vec_id"] for row in found] == [1, 2, 3, 4, 5]
    for size in (1e200, 1e-200):
        scaled = spark.createDataFrame([(key, [x * size for x in vector]) for key, vector in rows], "vec_id long, embedding array<double>")
        again = ann.nearest(scaled, F.col("vec_id") == 0).orderBy("rank").collect()
        assert [row["vec_id"] for row in again] == [1, 2, 3, 4, 5]
        assert [row["score"] for row in again] == pytest.approx([row["score"] for row in found])


def test_join_of_rows_without_ids_meets_equal_texts_only(spark):
    draw = np.random.default_rng(4)
    base = ["".join(map(chr, draw.integers(97, 123, 5))) for _ in range(60)]
    rows = [(None, " ".join([*base[:30], f"own{k}", *base[30:], f"end{k % 7}"])) for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = parity_join.similar_documents(table, width=3, percent=80).collect()
    assert len(found) == 300 and {row["component_id"] for row in found} == {None}
    assert parity_join.keep_one(table, width=3, percent=80).count() == 1


def test_stages_keep_columns_of_any_name(spark, documents):
    names = ["is_toxic", "_stays", "_repeat", "_first", "p_toxic", "score", "key", "print", "_row"]
    table = documents.limit(60).select("*", *[F.lit(place).alias(name) for place, name in enumerate(names)], F.lit(9).alias("a.b"))
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_unknown_language, corpus_pipeline.drop_near_duplicates):
        kept = stage(spark, table, SF)
        assert kept.columns == table.columns
        rows = kept.collect()
        assert rows and all(row["a.b"] == 9 and row["is_toxic"] == 0 and row["_stays"] == 1 and row["_row"] == 8 for row in rows)


def test_pipeline_from_end_to_end_and_on_no_rows(spark, documents, tmp_path):
    documents.limit(80).write.parquet(f"{tmp_path}/a/documents.parquet")
    documents.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    for name in "ab":
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    packed_rows = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    kept = documents.limit(80)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, f"{tmp_path}/a")
    assert {row["doc_id"] for row in packed_rows} == {row["doc_id"] for row in kept.collect()}
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []


def test_tasks_give_freed_memory_back():
    """Small arrays freed below one that is still held stay with the process until it trims its heap."""
    from pathlib import Path

    from revlens.llm.columns import give_back

    def resident() -> int:
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 >> 20

    arrays = [np.ones(8_000) for _ in range(4_000)]
    held, full = arrays[-1], resident()
    del arrays
    give_back()
    assert len(held) and full - resident() > 150


def test_shingle_sets_take_little_working_memory():
    """The working arrays of a batch stay under 20 MB, and sets don't depend on how it is cut."""
    import tracemalloc

    from revlens.llm import shingles

    texts = [" ".join(f"w{(row * 31 + place) % 5003}" for place in range(20_000)) for row in range(12)]
    tracemalloc.start()
    found = [value.copy() for value in shingles.distinct_shingles(texts, 5)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
    assert all(np.array_equal(value, next(shingles.distinct_shingles([text], 5))) for value, text in zip(found, texts))
