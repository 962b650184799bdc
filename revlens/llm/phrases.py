"""Phrase collocations from a weighted de Bruijn graph.

Texts are cut into pieces and those into words. Only the longest grams are counted: a gram of
``longest`` words is an edge from the node of its first ``longest - 1`` words to the node of its last
ones, weighted by its occurrences; where a piece ends at a node, that is kept as a correction of
the node. A shorter phrase's count is the flow out of its node, the corrections included, so no
shorter gram is counted over the texts for itself. Edges through nodes with one way in and one way out
carry equal weights; these unary paths are compacted by pointer doubling, and nodes inside them
have the path's weight and are covered by its edges.

Each task builds the graph of its share of the texts in blocks of at most ``BLOCK_WORDS`` words and
sends it as packed Arrow tables, one for each bucket of nodes; buckets grow in number with the
texts' bytes, so one of them always fits into a task. A frequent word or pair
reaches a bucket once a block with a count, never once an occurrence. Only grams with at least
``least`` occurrences are stored; all counts that they need are at least as large.

Defined cases: a null text is empty, a null language is ``und``; only A-Z are lower-cased; words are split at spaces
and tabs only, pieces at ``.,;:!?`` and line ends; repeated rows and ids count for each row; of cuts with
equal scores the first counts; empty tables give no rows; other columns are not read. Counts up to 10**15
are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.session import materialise

LONGEST = 3
LEAST = 10
TOP = 2000
# A phrase goes when a longer one has at least this percentage of its occurrences.
COVERED_PERCENT = 50
BLOCK_WORDS = 1_000_000
BUCKET_BYTES = 4_000_000
_CODE_BITS = 21
_MARK = b"\xff"
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)


class _Numbers(dict):
    """Numbers of (language, word) in order of first sight, from 1; 0 marks the end of a piece."""

    def __init__(self, words: list[bytes]) -> None:
        super().__init__({_MARK: 0})
        self.words = words

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self[word] = number = len(self.words) - 1
        return number


class _Block:
    """Words of some texts as numbers, and the graph they make."""

    def __init__(self, longest: int, limit: int) -> None:
        self.longest, self.limit = longest, limit
        self.words: list[bytes] = [b""]
        self.numbers: dict[str, _Numbers] = {}
        self.languages: list[tuple[int, str]] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes, lang: str) -> None:
        numbers = self.numbers.get(lang)
        if numbers is None:
            numbers = self.numbers[lang] = _Numbers(self.words)
        before = len(self.words)
        tokens = text.lower().translate(_ENDS).replace(b"\n", b" \xff ").split()
        tokens.append(_MARK)
        self.parts.append(np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens)))
        self.size += len(tokens)
        if len(self.words) > before:
            self.languages.append((before, lang))

    def full(self) -> bool:
        return self.size >= self.limit or len(self.words) >= (1 << _CODE_BITS) // 2

    def graph(self) -> Iterator[tuple[int, np.ndarray, pa.Table]]:
        """Level, hash of each row's node and the rows: nodes with their flow below the level of
        the edges' nodes, there (node, next word or nothing at a piece's end, count)."""
        codes = np.concatenate([*self.parts, np.zeros(self.longest, np.int64)])
        starts = [begin for begin, _ in self.languages]
        owner = np.searchsorted(starts, np.arange(len(self.words)), side="right") - 1
        prefixes = [lang.encode() + b"\t" for _, lang in self.languages]
        named = [prefixes[of] + word for of, word in zip(owner.tolist(), self.words)]
        words = pa.array(self.words, pa.binary())
        texts = pa.array(named, pa.binary())
        base = np.fromiter(map(zlib.crc32, named), np.uint64, len(named))
        hashes = base
        place = np.flatnonzero(codes)
        node = codes[place]
        for level in range(1, self.longest):
            last = level == self.longest - 1
            follow = codes[place + level]
            if not last:
                flow = np.bincount(node, minlength=len(texts))
                held = np.flatnonzero(flow)
                yield level, hashes[held], pa.table({"node": texts.take(pa.array(held)), "count": flow[held]})
                going = follow > 0
                place, node, follow = place[going], node[going], follow[going]
            keys = node << _CODE_BITS | follow
            if last:
                keys, counts = np.unique(keys, return_counts=True)
            else:
                keys, node = np.unique(keys, return_inverse=True)
            left, right = keys >> _CODE_BITS, keys & (1 << _CODE_BITS) - 1
            if last:
                yield level, hashes[left], pa.table({"node": texts.take(pa.array(left)), "last": words.take(pa.array(right)), "count": counts})
            else:
                texts = pc.binary_join_element_wise(texts.take(pa.array(left)), words.take(pa.array(right)), b" ")
                hashes = (hashes[left] ^ hashes[left] >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + base[right]


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _block_rows(block: _Block, buckets: int) -> Iterator[pa.RecordBatch]:
    for level, hashes, table in block.graph():
        mixed = (hashes ^ hashes >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        bucket = ((mixed >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        table, bucket = table.take(pa.array(order)), bucket[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
        for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield pa.RecordBatch.from_arrays(
                [pa.array([level], pa.int32()), pa.array([int(bucket[begin])], pa.int64()),
                 pa.array([_packed(table.slice(begin, end - begin).combine_chunks())], pa.binary())], names=["level", "bucket", "rows"])


def frequent_grams(documents: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST,
                   block_words: int = BLOCK_WORDS) -> DataFrame:
    """``level, lang, phrase, count`` of all phrases of 1 to ``longest`` words with at least ``least``
    occurrences, ``level`` words each; rows of level 0 sum to the number of words of a language."""
    if longest < 2:
        raise ValueError("phrases need two words or more")
    rows = documents.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(longest, block_words)
        for batch in batches:
            for value, name in zip(batch.column(0), batch.column(1).to_pylist()):
                block.add(value.as_py(), name)
                if block.full():
                    yield from _block_rows(block, buckets)
                    block = _Block(longest, block_words)
        if block.size:
            yield from _block_rows(block, buckets)

    def reduce(key: tuple, group: pa.Table) -> pa.Table:
        level = key[0].as_py()
        parts = pa.concat_tables([pa.ipc.open_stream(value.as_py()).read_all() for value in group.column("rows")])
        out = []

        def keep(table: pa.Table, words: int) -> None:
            table = table.filter(pc.greater_equal(table["count_sum"], least))
            out.append(pa.table({"level": pa.array(np.full(len(table), words, np.int32)), "node": table["node"].cast(pa.string()), "count": table["count_sum"]}))

        if level == longest - 1:
            edges = parts.group_by(["node", "last"]).aggregate([("count", "sum")])
            flows = edges.rename_columns(["node", "last", "count"]).group_by("node").aggregate([("count", "sum")])
            edges = edges.filter(pc.and_(pc.greater(pc.binary_length(edges["last"]), 0), pc.greater_equal(edges["count_sum"], least)))
            names = pc.binary_join_element_wise(edges["node"], edges["last"], b" ")
            keep(pa.table({"node": names, "count_sum": edges["count_sum"]}), longest)
        else:
            flows = parts.group_by("node").aggregate([("count", "sum")])
        keep(flows, level)
        if level == 1:
            spoken = pa.table({"node": pc.replace_substring_regex(flows["node"].cast(pa.string()), pattern="(?s)\t[^\t]*$", replacement="\t"), "count": flows["count_sum"]})
            totals = spoken.group_by("node").aggregate([("count", "sum")])
            out.append(pa.table({"level": pa.array(np.zeros(len(totals), np.int32)), "node": totals["node"], "count": totals["count_sum"]}))
        return pa.concat_tables([part.combine_chunks() for part in out])

    blocks = rows.mapInArrow(build, "level int, bucket long, rows binary")
    found = blocks.groupBy("level", "bucket").applyInArrow(reduce, "level int, node string, count long")
    phrase = F.substring_index("node", "\t", -1)
    return found.select("level", F.expr("left(node, length(node) - length(substring_index(node, '\t', -1)) - 1)").alias("lang"), phrase.alias("phrase"), "count")


def _all_but_last(phrase: str) -> Column:
    return F.regexp_replace(phrase, " [^ ]*$", "")


def _all_but_first(phrase: str) -> Column:
    return F.regexp_replace(phrase, "^[^ ]* ", "")


def graph_edges(grams: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Stored edges with their two nodes and these nodes' flows."""
    nodes = grams.filter(F.col("level") == longest - 1)
    tails = nodes.select("lang", F.col("phrase").alias("tail"), F.col("count").alias("tail_flow"))
    heads = nodes.select("lang", F.col("phrase").alias("head"), F.col("count").alias("head_flow"))
    edges = grams.filter(F.col("level") == longest).select(
        "lang", "phrase", "count", _all_but_last("phrase").alias("tail"), _all_but_first("phrase").alias("head"))
    return edges.join(tails, ["lang", "tail"]).join(heads, ["lang", "head"])


def compact_paths(edges: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``lang, path, phrase, place, count`` of every edge: the first edge of its unary path, and its place there.

    An edge follows another where all occurrences of the node between them come by the one and leave
    by the other. Pointers to the edge before are doubled until all reach their path's first
    edge, so rounds grow with the logarithm of the longest path; a path never closes, since a
    piece of text has a beginning.
    """
    into = edges.filter("count = head_flow").select("lang", F.col("head").alias("tail"), F.col("phrase").alias("before"))
    out = edges.select("lang", "tail", "phrase", "count", (F.col("count") == F.col("tail_flow")).alias("only"))
    linked = out.join(into, ["lang", "tail"], "left").select(
        "lang", "phrase", "count", F.when(F.col("only"), F.col("before")).alias("before"))
    jump = F.coalesce("before", "phrase")
    state = materialise(linked.select(
        "lang", "phrase", "count", jump.alias("path"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("place"),
        F.col("before").isNull().alias("done")), "paths")
    while state.filter("not done").limit(1).count():
        # Only edges not yet at their path's start look further.
        ahead = state.select("lang", F.col("phrase").alias("path"), F.col("path").alias("_path"), F.col("place").alias("_place"), F.col("done").alias("_done"))
        moved = state.filter("not done").join(ahead, ["lang", "path"]).select(
            "lang", "phrase", "count", F.col("_path").alias("path"), (F.col("place") + F.col("_place")).alias("place"), F.col("_done").alias("done"))
        state = materialise(moved.unionByName(state.filter("done")), "paths")
    return state.drop("done")


def path_texts(paths: DataFrame) -> DataFrame:
    """One row for each compacted path: its words, its edges and their common weight.

    A path lies within one piece of text, which bounds the words that meet in a row.
    """
    last = F.substring_index("phrase", " ", -1)
    steps = F.array_sort(F.collect_list(F.struct("place", last.alias("word"))))
    return paths.groupBy("lang", "path").agg(steps.alias("_steps"), F.count(F.lit(1)).alias("edges"), F.max("count").alias("count")).select(
        "lang", F.concat_ws(" ", "path", F.transform(F.slice("_steps", 2, 1 << 30), lambda step: step["word"])).alias("words"), "edges", "count")


def _covered(grams: DataFrame, paths: DataFrame, longest: int) -> DataFrame:
    """Phrases that lie in a longer one with enough of their occurrences.

    One more word is enough to look at: what lies in a still longer phrase lies in one of those
    too. Nodes inside a compacted path have its weight, so only path ends are compared with flows.
    """
    ends = F.row_number().over(Window.partitionBy("lang", "path").orderBy(F.desc("place"))) == 1
    inside = paths.filter("place > 0").select("lang", _all_but_last("phrase").alias("phrase"))
    marked = paths.withColumn("_end", ends)
    longer = marked.filter("place = 0").select("lang", _all_but_last("phrase").alias("phrase"), "count").unionByName(
        marked.filter("_end").select("lang", _all_but_first("phrase").alias("phrase"), "count"))
    between = grams.filter((F.col("level") > 2) & (F.col("level") < longest))
    for shorter in (_all_but_last("phrase"), _all_but_first("phrase")):
        longer = longer.unionByName(between.select("lang", shorter.alias("phrase"), "count"))
    most = longer.groupBy("lang", "phrase").agg(F.max("count").alias("most"))
    own = grams.filter((F.col("level") > 1) & (F.col("level") < longest)).select("lang", "phrase", "count")
    found = own.join(most, ["lang", "phrase"]).filter(F.col("most") * 100 >= F.col("count") * COVERED_PERCENT)
    return found.select("lang", "phrase").unionByName(inside).distinct()


def score_phrases(grams: DataFrame, covered: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of phrases that no longer one covers, by their lowest-scoring cut."""
    words = F.split("phrase", " ")
    kept = grams.filter("level > 1").join(covered, ["lang", "phrase"], "left_anti")
    cuts = kept.select("lang", "phrase", F.col("count").alias("a"), F.explode(F.sequence(F.lit(1), F.col("level") - 1)).alias("cut"), words.alias("_words"))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut", F.concat_ws(" ", F.slice("_words", F.lit(1), F.col("cut"))).alias("left"),
        F.concat_ws(" ", F.slice("_words", F.col("cut") + 1, F.size("_words"))).alias("right"))
    counts = grams.filter("level > 0").select("lang", "phrase", "count")
    first = counts.select("lang", F.col("phrase").alias("left"), F.col("count").alias("l"))
    rest = counts.select("lang", F.col("phrase").alias("right"), F.col("count").alias("r"))
    scored = cuts.join(first, ["lang", "left"]).join(rest, ["lang", "right"])
    scored = scored.select("lang", "phrase", "a", "cut", "l", "r", F.expr(
        "(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))").alias("score"))
    return scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("_best")).select(
        "lang", "phrase", "a", "_best.l", "_best.r", "_best.score")


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases of 2 to ``longest`` words."""
    grams = materialise(frequent_grams(documents, text, lang, longest, least), "grams")
    totals = grams.filter("level = 0").groupBy("lang").agg(F.sum("count").alias("n"))
    paths = compact_paths(graph_edges(grams, longest), longest)
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = score_phrases(grams, _covered(grams, paths, longest)).withColumn("rank", order).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
