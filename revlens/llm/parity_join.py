"""N-gram Jaccard join by parity sketches.

Every document is a set of word shingles. In each size band a sketch has more pieces, of 64 parity
bits each, than two similar sets can differ in elements, so similar sets share a piece, and one
shuffle by piece brings them together. Unlike sets share one only with all their elements in it, so
chance adds no candidates as the sets grow in number. Sets that share a piece are compared by
a further sketch, whose Hamming distance never exceeds the symmetric difference; what passes is
verified on the whole texts. Nothing similar is missed, but for equal 64-bit hashes.

Groups of copies stay cheap: equal sets are one node; inside a set of nodes that share a piece
only a spanning forest of passing pairs is verified first. Where a pair of it fails, a second pass
verifies every passing pair of such a group that lies between two components by then; those
are few, as the sketch is close to the true difference. Sets of nodes that are too
large for one task are compared in blocks.

Defined cases: null, empty and blank texts have no shingles and are linked with nothing; texts of
fewer words than a shingle are one shingle; a repeated id gets one row for each of its rows;
``component_id`` is null only where all ids of a component are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.session import broadcast_if_bounded, materialise

from .columns import give_back, quoted
from .shingles import SKETCH_BITS, Bands, distinct_shingles, parity_sketch, piece_keys, set_signature

WIDTH = 5
PERCENT = 80
BLOCK = 2048
_SKETCH_LONGS = SKETCH_BITS // 64


def describe_sets(documents: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Key, hash of the text, signature, size and sketch of each row's set; signature and sketch null if empty."""
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("print"))
    schema = T.StructType([rows.schema["key"], T.StructField("print", T.LongType()), T.StructField("sig", T.LongType()),
                           T.StructField("size", T.LongType()), T.StructField("sketch", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(set_signature(found), len(found), parity_sketch(found, SKETCH_BITS).tobytes()) if len(found) else (None, 0, None)
                    for found in distinct_shingles(batch.column(1).to_pylist(), width)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()),
                 pa.array([m[2] for m in made], pa.binary())], names=schema.names)
        give_back()

    return rows.mapInArrow(work, schema)


def set_pieces(documents: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """``piece, sig``: the join keys of each set, once for each set and task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for batch in batches:
            keys, sigs, held = [], [], 0
            for found in distinct_shingles(batch.column(0).to_pylist(), width):
                if not len(found):
                    continue
                sig = set_signature(found)
                if sig in seen:
                    continue
                seen.add(sig)
                keys.append(piece_keys(found, bands))
                sigs.append(np.full(len(keys[-1]), sig))
                held += len(keys[-1])
                if held > 100_000:
                    yield _pairs(keys, sigs)
                    keys, sigs, held = [], [], 0
            if keys:
                yield _pairs(keys, sigs)
        give_back()

    return documents.select(text).mapInArrow(work, "piece long, sig long")


def _pairs(keys: list, sigs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(sigs))], names=["piece", "sig"])


def shared_pieces(pieces: DataFrame) -> DataFrame:
    """``piece, chunk, members``: sorted sets with the same piece, two or more, in chunks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_piece, members, chunk = None, [], 0
        out: list[list] = [[], [], []]

        def settle(last: bool) -> None:
            nonlocal members, chunk
            if len(members) > 1 or (chunk and members):
                for column, value in zip(out, (open_piece, chunk, members)):
                    column.append(value)
                chunk += 1
            members = []
            if last:
                chunk = 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int64()))],
                names=["piece", "chunk", "members"])
            out[0], out[1], out[2] = [], [], []
            return batch

        for batch in batches:
            piece, sig = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fresh = np.concatenate(([True], (piece[1:] != piece[:-1]) | (sig[1:] != sig[:-1])))
            piece, sig = piece[fresh], sig[fresh]
            begins = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            ends = np.append(begins[1:], len(piece))
            # A run of one row matters only where it may go on from or into another batch.
            long = np.flatnonzero(ends - begins > 1)
            for run in sorted({0, len(begins) - 1, *long.tolist()}):
                begin, end = begins[run], ends[run]
                if piece[begin] != open_piece:
                    settle(True)
                    open_piece = int(piece[begin])
                for value in sig[begin:end].tolist():
                    if not members or members[-1] != value:
                        if len(members) == BLOCK:
                            settle(False)
                        members.append(value)
                if run != len(begins) - 1:
                    settle(True)
                    open_piece = None
            if len(out[0]) > 2000:
                yield flush()
        settle(True)
        yield flush()
        give_back()

    dealt = pieces.repartition("piece").sortWithinPartitions("piece", "sig")
    return dealt.mapInArrow(work, "piece long, chunk int, members array<long>")


def comparison_groups(shared: DataFrame) -> DataFrame:
    """``grp, sig``: sets of nodes to be compared, each once. Chunks of one piece meet in pairs."""
    more = shared.filter("chunk > 0").select("piece").distinct()
    single = shared.join(more, "piece", "left_anti").select("members")
    chunks = shared.join(more, "piece", "left_semi")
    other = chunks.select("piece", F.col("chunk").alias("other"), F.col("members").alias("more"))
    several = chunks.join(other, "piece").filter(
        F.col("chunk") < F.col("other")).select(F.array_sort(F.array_union("members", "more")).alias("members"))
    return single.union(several).distinct().select(F.xxhash64("members").alias("grp"), F.explode("members").alias("sig"))


def _forest(sigs: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, labels: np.ndarray, failed: set, percent: int) -> list[tuple[int, int]]:
    """Pairs that would join the components of ``labels`` as far as sketches allow, none of them failed."""
    waiting, out = np.arange(len(sigs)), []
    while len(waiting):
        queue = waiting[labels[waiting] == labels[waiting[0]]].tolist()
        waiting = np.setdiff1d(waiting, queue, assume_unique=True)
        while queue and len(waiting):
            row = queue.pop()
            apart = np.bitwise_count(sketches[waiting] ^ sketches[row]).sum(axis=1, dtype=np.int64)
            both = sizes[waiting] + sizes[row]
            passing = apart * (100 + percent) <= both * (100 - percent)
            passing &= np.minimum(sizes[waiting], sizes[row]) * 100 >= np.maximum(sizes[waiting], sizes[row]) * percent
            joined = set()
            for other in waiting[passing].tolist():
                pair = (min(sigs[row], sigs[other]), max(sigs[row], sigs[other]))
                if labels[other] not in joined and pair not in failed:
                    out.append(pair)
                    joined.add(labels[other])
            if joined:
                moved = np.isin(labels[waiting], list(joined))
                queue += waiting[moved].tolist()
                waiting = waiting[~moved]
    return out


def _between(sigs: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, labels: np.ndarray, failed: set, percent: int) -> list[tuple[int, int]]:
    """All pairs of different ``labels`` that pass the sketch and have not failed."""
    out = []
    for row in range(len(sigs) - 1):
        rest = np.flatnonzero(labels[row + 1 :] != labels[row]) + row + 1
        apart = np.bitwise_count(sketches[rest] ^ sketches[row]).sum(axis=1, dtype=np.int64)
        passing = apart * (100 + percent) <= (sizes[rest] + sizes[row]) * (100 - percent)
        passing &= np.minimum(sizes[rest], sizes[row]) * 100 >= np.maximum(sizes[rest], sizes[row]) * percent
        for other in rest[passing].tolist():
            pair = (min(sigs[row], sigs[other]), max(sigs[row], sigs[other]))
            if pair not in failed:
                out.append(pair)
    return out


def candidate_pairs(groups: DataFrame, nodes: DataFrame, percent: int, labels: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """Distinct pairs ``a, b`` to verify: a forest in each group or, with the labels and failed
    pairs of a first pass, all passing pairs between components."""
    pick = _forest if failed is None else _between
    rows = groups.join(nodes.select("sig", "size", "sketch"), "sig")
    rows = rows.join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig")) if labels is not None else rows.withColumn("label", F.col("sig"))
    rows = rows.select("grp", "sig", "size", "label", "sketch")
    if failed is not None:
        # Tested pairs travel as rows of their own: the partner stands in ``label``, size is -1.
        tested = groups.join(failed.withColumnRenamed("a", "sig"), "sig").join(
            groups.select("grp", F.col("sig").alias("b")), ["grp", "b"]).select("grp", "sig", F.lit(-1).cast("long").alias("size"), F.col("b").alias("label"), F.lit(None).cast("binary").alias("sketch"))
        rows = rows.union(tested)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: list) -> list[tuple[int, int]]:
            real = [row for row in held if row[2] >= 0]
            known = {(min(row[1], row[3]), max(row[1], row[3])) for row in held if row[2] < 0}
            if len(real) < 2:
                return []
            column = lambda place: np.array([row[place] for row in real], np.int64)
            sketches = np.frombuffer(b"".join(row[4] for row in real), np.uint64).reshape(-1, _SKETCH_LONGS)
            return [(int(a), int(b)) for a, b in pick(column(1), column(2), sketches, column(3), known, percent)]

        current, held = None, []
        for batch in batches:
            found = []
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if row[0] != current:
                    found += solve(held)
                    current, held = row[0], []
                held.append(row)
            yield _edges(found)
        yield _edges(solve(held))
        give_back()

    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(work, "a long, b long").distinct()


def _edges(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def representative_texts(sigs: DataFrame, nodes: DataFrame, documents: DataFrame, key: str, text: str) -> DataFrame:
    """``sig, text``: one text for each wanted set, that of its least row, found by key and hash of the text.

    Repeated and null keys meet only rows with the same text.
    """
    wanted = materialise(nodes.join(sigs, "sig", "left_semi").select("sig", "key", "print"), "wanted-sets")
    rows = documents.select(F.col(quoted(key)).alias("_key"), F.col(quoted(text)).alias("text")).withColumn("_print", F.xxhash64("text"))
    same = F.col("_key").eqNullSafe(F.col("key")) & (F.col("_print") == F.col("print"))
    found = rows.join(broadcast_if_bounded(wanted), same)
    # A text is a few kilobytes and a sum of its repeats isn't needed: any of them has this set.
    return materialise(found.select("sig", "text").dropDuplicates(["sig"]), "wanted-texts")


def verify_pairs(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """``a, b, linked`` by the exact sets of both texts."""
    sigs = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    texts = representative_texts(sigs, nodes, documents, key, text)
    rows = pairs.join(texts.select(F.col("sig").alias("a"), F.col("text").alias("a_text")), "a").join(
        texts.select(F.col("sig").alias("b"), F.col("text").alias("b_text")), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            sets = [distinct_shingles(batch.column(place).to_pylist(), width) for place in (2, 3)]
            for a, b, left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *sets):
                common = len(np.intersect1d(left, right, assume_unique=True))
                for column, value in zip(out, (a, b, 100 * common >= percent * (len(left) + len(right) - common))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())], names=["a", "b", "linked"])
        give_back()

    return rows.select("a", "b", "a_text", "b_text").mapInArrow(work, "a long, b long, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """``sig, label``: every linked node with the least node of its component.

    Alternates steps that hang larger neighbours, then smaller ones, on each node's least neighbour,
    until nothing changes; the number of rounds grows with the logarithm of the nodes.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")

    def state(found: DataFrame) -> tuple:
        return tuple(found.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "links-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialise(small.select("e.u", "e.v").filter("u <> v").distinct(), "links-small")
        after = state(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("sig"), F.col("v").alias("label"))
    return stars.union(stars.select(F.col("label").alias("sig"), "label").distinct())


def _linked(documents: DataFrame, key: str, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every row's set, and of each different set the least row (``key``, null last, and ``print``) and the ``label`` of its component."""
    described = materialise(describe_sets(documents, key, text, width), "sets")
    nodes = described.filter("size > 0").groupBy("sig").agg(
        F.min(F.struct(F.col("key").isNull().alias("unnamed"), "key", "print", "size", "sketch")).alias("n")).select("sig", "n.*")
    nodes = materialise(nodes, "set-nodes")
    shared = materialise(shared_pieces(set_pieces(documents, text, width, percent)), "shared-pieces")
    groups = materialise(comparison_groups(shared), "piece-groups")
    pairs = materialise(candidate_pairs(groups, nodes, percent), "pairs")
    tested = materialise(verify_pairs(pairs, nodes, documents, key, text, width, percent), "tested")
    labels = materialise(components(tested.filter("linked")), "labels")
    failed = tested.filter(~F.col("linked")).select("a", "b")
    if failed.limit(1).count():
        # Only groups in which a tested pair failed can still hide a link between components.
        doubtful = groups.join(failed.withColumnRenamed("a", "sig"), "sig").join(
            groups.select("grp", F.col("sig").alias("b")), ["grp", "b"]).select("grp").distinct()
        pairs = materialise(candidate_pairs(groups.join(doubtful, "grp", "left_semi"), nodes, percent, labels, failed), "pairs")
        if pairs.limit(1).count():
            tested = tested.union(verify_pairs(pairs, nodes, documents, key, text, width, percent))
            labels = materialise(components(tested.filter("linked")), "labels")
    known = nodes.select("sig", "unnamed", "key", "print").join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    return described, known


def similar_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Key, ``n_shingles`` and ``component_id`` (least key reachable by links, null last) of every row."""
    described, known = _linked(documents, key, text, width, percent)
    least = known.groupBy("label").agg(F.min("key").alias("component_id"))
    named = known.join(least, "label").select("sig", "component_id")
    return described.join(named, "sig", "left").select(
        F.col("key").alias(key), F.col("size").alias("n_shingles"),
        F.when(F.col("sig").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Rows of ``documents`` without similar ones: of each component the row with the least key (null
    last), signature and hash of the text, whatever other rows share its key; of rows that repeat key
    and text one. Rows without shingles all stay, but for such repeats."""
    described, known = _linked(documents, key, text, width, percent)
    least = known.groupBy("label").agg(F.min(F.struct("unnamed", "key", "sig", "print")).alias("n"))
    stay = least.select("n.key", "n.print").union(described.filter("sig is null").select("key", "print").distinct())
    other = [F.col(quoted(name)) for name in documents.columns if name not in (key, text)]
    # Key and hash are one value, for which null keys are equal: rows are dealt out once, for the window and the join.
    rows = documents.select(F.struct(*[F.col(quoted(name)) for name in documents.columns]).alias("_row"),
                            F.struct(F.col(quoted(key)).alias("key"), F.xxhash64(F.col(quoted(text))).alias("print")).alias("_id"),
                            (F.xxhash64(F.to_json(F.struct(*other))) if other else F.lit(0)).alias("_order"))
    # Of rows that repeat key and text the one with the least hash of its other columns stays.
    first = F.row_number().over(Window.partitionBy("_id").orderBy("_order"))
    single = rows.withColumn("_first", first).filter("_first = 1")
    # A hash of a text is never null; said so here too, both sides have one type and the join deals nothing out again.
    kept = stay.select(F.struct("key", F.coalesce("print", F.lit(0)).alias("print")).alias("_id"))
    return single.join(kept, "_id", "left_semi").select("_row.*")
