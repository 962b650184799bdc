"""Nearest neighbours by cosine over learned partitions.

On a bounded sample a neighbour graph is built and cut into parts of balanced size; a small network
learns each vector's part from the vector. Every row goes to its most probable part; a query
goes to its most probable parts until their probabilities reach ``ROUTED`` and is compared with all
their rows in double precision.

Equal vectors are kept once, with their ``k + 1`` smallest ids: with the query's own id left out,
no other copy can be among the ``k`` nearest. A part is compared in blocks of at most about
``BLOCK`` rows and queries, so no task holds a part as a whole.

Defined cases: vectors that are null, empty, zero or have null or non-finite components take no
part, nor do vectors of another length than the most frequent one (the shorter of two equally
frequent); of a repeated id's different vectors the nearest counts; with fewer than ``k``
candidates all are given; equal scores go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.session import materialise

# The graph, its parts and the network are fitted on at most so many vectors, chosen by hash.
FIT_ROWS = 8_192
ROUTED = 0.97
LEAST_PARTS = 2
BLOCK = 4096
_NEAR = 10


def usable(vector: Column) -> Column:
    """Not null, not empty, every component finite, not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(odd, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near 1: exact, and the same cosines."""
    _, power = np.frexp(np.abs(rows).max(axis=1, keepdims=True))
    return np.ldexp(rows, -power)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = _scaled(rows)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def neighbour_graph(unit: np.ndarray, near: int = _NEAR) -> np.ndarray:
    """Row numbers of the ``near`` nearest rows of each row, itself left out."""
    near = min(near, len(unit) - 1)
    out = np.empty((len(unit), near), np.int64)
    for begin in range(0, len(unit), 1024):
        scores = unit[begin : begin + 1024] @ unit.T
        scores[np.arange(len(scores)), np.arange(begin, begin + len(scores))] = -2
        out[begin : begin + 1024] = np.argpartition(-scores, near - 1, axis=1)[:, :near]
    return out


def balanced_parts(unit: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Part of each row: few graph edges between parts, no part over ``slack`` of its share.

    Starts from halves cut along main directions, then rows move to the part in which most of
    their neighbours are, as long as there is room.
    """
    label = np.zeros(len(unit), np.int64)

    def halve(rows: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            label[rows] = first
            return
        centred = unit[rows] - unit[rows].mean(axis=0)
        vector = np.random.default_rng(first).normal(size=unit.shape[1])
        for _ in range(15):
            vector = centred.T @ (centred @ vector)
            vector /= np.linalg.norm(vector) + 1e-300
        order = rows[np.argsort(centred @ vector, kind="stable")]
        left = count // 2
        cut = len(order) * left // count
        halve(order[:cut], first, left)
        halve(order[cut:], first + left, count - left)

    halve(np.arange(len(unit)), 0, parts)
    room = math.ceil(len(unit) / parts * slack)
    sizes = np.bincount(label, minlength=parts)
    back: list[list[int]] = [[] for _ in range(len(unit))]
    for row, others in enumerate(graph.tolist()):
        for other in others:
            back[other].append(row)
    around = [np.array([*graph[row], *back[row]], np.int64) for row in range(len(unit))]
    for _ in range(rounds):
        moved = 0
        for row in range(len(unit)):
            votes = np.bincount(label[around[row]], minlength=parts)
            votes[sizes >= room] = -1
            own = label[row]
            best = int(votes.argmax())
            if best != own and votes[best] > np.count_nonzero(label[around[row]] == own):
                sizes[own] -= 1
                sizes[best] += 1
                label[row] = best
                moved += 1
        if moved * 200 < len(unit):
            break
    return label


class Router:
    """One hidden layer and a softmax over parts, fitted to the parts of each row's neighbours."""

    def __init__(self, width: int, parts: int, hidden: int = 128) -> None:
        draw = np.random.default_rng(2)
        self.parts = parts
        self.values = [draw.normal(0, width**-0.5 * 3, (width, hidden)), np.zeros(hidden), draw.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]

    def probabilities(self, unit: np.ndarray) -> np.ndarray:
        hidden = np.maximum(unit @ self.values[0] + self.values[1], 0)
        scores = hidden @ self.values[2] + self.values[3]
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)

    def train(self, unit: np.ndarray, target: np.ndarray, epochs: int = 30, rate: float = 0.005, block: int = 256) -> None:
        draw = np.random.default_rng(4)
        first, second = [np.zeros_like(x) for x in self.values], [np.zeros_like(x) for x in self.values]
        step, total = 0, epochs * -(-len(unit) // block)
        for _ in range(epochs):
            order = draw.permutation(len(unit))
            for begin in range(0, len(unit), block):
                rows, wanted = unit[order[begin : begin + block]], target[order[begin : begin + block]]
                hidden = np.maximum(rows @ self.values[0] + self.values[1], 0)
                scores = hidden @ self.values[2] + self.values[3]
                scores = np.exp(scores - scores.max(axis=1, keepdims=True))
                error = (scores / scores.sum(axis=1, keepdims=True) - wanted) / len(rows)
                back = (error @ self.values[2].T) * (hidden > 0)
                step += 1
                pace = rate * (1 - step / (total + 1))
                for k, gradient in enumerate((rows.T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0))):
                    first[k] = 0.9 * first[k] + 0.1 * gradient
                    second[k] = 0.99 * second[k] + 0.01 * gradient**2
                    self.values[k] = self.values[k] - pace * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)


def fit(sample: np.ndarray, parts: int) -> Router:
    """Router over balanced parts of the sample's neighbour graph."""
    unit = _unit(sample)
    parts = max(1, min(parts, len(unit) // 8))
    router = Router(unit.shape[1], parts)
    if parts > 1:
        graph = neighbour_graph(unit)
        label = balanced_parts(unit, graph, parts)
        target = np.zeros((len(unit), parts))
        np.add.at(target, (np.arange(len(unit))[:, None], label[graph]), 1.0)
        target[np.arange(len(unit)), label] += 2.0
        router.train(unit, target / target.sum(axis=1, keepdims=True))
    return router


def routes(probabilities: np.ndarray, covered: float = ROUTED, least: int = LEAST_PARTS) -> list[np.ndarray]:
    """Most probable parts of each row until their probabilities reach ``covered``."""
    order = np.argsort(-probabilities, axis=1)
    reached = np.cumsum(np.take_along_axis(probabilities, order, axis=1), axis=1)
    counts = np.maximum((reached < covered).sum(axis=1) + 1, least)
    return [row[:count] for row, count in zip(order, counts)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def _routed(rows: DataFrame, router: Router, width: int, several: bool) -> DataFrame:
    """Adds ``part``: the most probable one, or with ``several`` one row for each route."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            chances = router.probabilities(_unit(_matrix(batch.column("vector"), width)))
            picks = routes(chances) if several else [np.array([best]) for best in chances.argmax(axis=1)]
            source = pa.array(np.repeat(np.arange(batch.num_rows), [len(pick) for pick in picks]))
            table = batch.take(source)
            yield pa.RecordBatch.from_arrays([*table.columns, pa.array(np.concatenate(picks).astype(np.int32), pa.int32())], names=[*batch.schema.names, "part"])

    return rows.mapInArrow(route, f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, part int")


def _compare(k: int):
    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        queries, rows = _scaled(np.stack(left["vector"].to_numpy())), _scaled(np.stack(right["vector"].to_numpy()))
        query_size, row_size = np.sqrt((queries * queries).sum(axis=1)), np.sqrt((rows * rows).sum(axis=1))
        ids = [np.asarray(value, np.int64) for value in right["ids"]]
        near = (queries / query_size[:, None]) @ (rows / row_size[:, None]).T
        out = []
        for place, query in enumerate(left["query_id"]):
            # An id may have several vectors here, so more rows are taken until enough different ids are among them.
            wanted = k + 1
            while True:
                wanted = min(wanted, len(ids))
                bound = np.partition(near[place], len(ids) - wanted)[len(ids) - wanted] - 1e-9
                found = np.flatnonzero(near[place] >= bound)
                names = np.concatenate([ids[row] for row in found])
                if wanted == len(ids) or len(np.unique(names[names != query])) >= k:
                    break
                wanted *= 4
            exact = (queries[place] * rows[found]).sum(axis=1) / (query_size[place] * row_size[found])
            scores = np.repeat(exact, [len(ids[row]) for row in found])
            keep = names != query
            names, scores = names[keep], scores[keep]
            best = np.lexsort((names, -scores))
            # The first place of each id in this order is its best score.
            best = best[np.sort(np.unique(names[best], return_index=True)[1])][:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": names[best], "score": scores[best]}))
        return pd.concat(out)

    return compare


def nearest(embeddings: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
            fit_rows: int = FIT_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the nearest rows found for each row that fits ``queries``."""
    rows = embeddings.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("vector"),
        F.coalesce(queries, F.lit(False)).alias("asks"))
    lengths = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = lengths[0]["width"] if lengths else 1
    rows = rows.filter(F.size("vector") == width)
    # Of equal vectors the k + 1 smallest ids are enough; the limit works before the shuffle too.
    order = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    distinct = materialise(
        rows.select("id", "vector").distinct().withColumn("_n", order).filter(F.col("_n") <= k + 1)
        .groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")), "ann-vectors")
    count = distinct.count()
    sample = distinct.orderBy(F.xxhash64("vector"), F.col("ids")[0]).limit(fit_rows).select("vector").toPandas()
    # Parts grow with the root of the rows, up to what the sample can tell apart.
    parts = max(1, min(fit_rows // 64, math.ceil(math.sqrt(count) / 8)))
    router = fit(np.stack(sample["vector"].to_numpy()), parts) if len(sample) else Router(width, 1)
    stored = materialise(_routed(distinct, router, width, False), "ann-parts")
    asking = materialise(_routed(rows.filter("asks").select(F.col("id").alias("query_id"), "vector").distinct(), router, width, True), "ann-queries")
    held = {row["part"]: row["count"] for row in stored.groupBy("part").count().collect()}
    asked = {row["part"]: row["count"] for row in asking.groupBy("part").count().collect()}
    both = [(part, -(-held[part] // BLOCK), -(-asked[part] // BLOCK)) for part in held if part in asked]
    blocks = F.broadcast(embeddings.sparkSession.createDataFrame(both or [(-1, 1, 1)], "part int, row_blocks int, query_blocks int"))
    left = asking.join(blocks, "part").select(
        "part", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("row_block"),
        F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int").alias("query_block"), "query_id", "vector")
    right = stored.join(blocks, "part").select(
        "part", F.pmod(F.xxhash64("vector"), F.col("row_blocks")).cast("int").alias("row_block"),
        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"), "ids", "vector")
    cell = ["part", "row_block", "query_block"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(_compare(k), "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
