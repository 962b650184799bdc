"""Centroid clustering with heap-ordered bounds, exact in integers.

Vectors become integers and lie in blocks of at most ``BLOCK`` rows. A block keeps for each
cluster a heap of its rows by gap: the distance to the second nearest centroid less the distance to the own
one, plus the drift that the cluster had gathered when the row entered. The drift grows each round by how
far the own centroid and the farthest-moving other one went, so it tells by the heap's root alone
whether any gap may have closed. Only rows whose gap has expired are popped and compared with all
centroids again, in exact integers; all others provably keep their cluster. A block also
keeps its sums for each cluster and corrects them by the rows that changed.

A round is one pass over the blocks, without a shuffle, written to one of two folders in turn; the
driver gets the sums of each centroid's components, whatever the number of rows. Equal vectors
are rows like all others, in whichever block they lie.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are left
out; repeated ids count for each row; a null id comes last in the choice of first centroids, equal
ids there are taken in the order of their vectors; with fewer rows than clusters each row starts one; of
equal distances the smaller cluster counts; an empty cluster keeps its centroid; an empty table gives no rows. Components
of any finite size are compared exactly; a distance or sum beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.session import TwoSlots, materialise

WIDTH = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SALT = "3:"
BLOCK = 4096
# Relative allowance for rounding in the bounds; a gap within it counts as closed.
_SLACK = 1e-9
# Below this size squares and products of components are exact in double precision.
_EXACT = 1 << 20
_LIMB = 31
_LONG = 1 << 63


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): whole doubles where those are exact in later sums, else Python integers."""
    with np.errstate(over="ignore"):
        whole = np.floor(values * scale)
    if not whole.size or np.abs(whole).max() < _EXACT:
        return whole
    exact = [math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale for x in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def squared_distances(rows: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    if rows.dtype != object and max(max(map(abs, centroid)) for centroid in centroids) < _EXACT:
        places = np.array(centroids, np.float64)
        return (rows * rows).sum(axis=1)[:, None] - 2.0 * (rows @ places.T) + (places * places).sum(axis=1)
    rows = np.array([[int(x) for x in row] for row in rows.tolist()], dtype=object).reshape(rows.shape)
    return np.stack([((rows - np.array(centroid, dtype=object)) ** 2).sum(axis=1) for centroid in centroids], axis=1)


def _root(value) -> float:
    try:
        return math.sqrt(value)
    except OverflowError:
        return math.inf


def gaps(distances: np.ndarray, nearest: np.ndarray) -> np.ndarray:
    """Safe lower bound of second nearest less nearest distance; minus infinity where it can't be told."""
    count, clusters = distances.shape
    if clusters == 1:
        return np.full(count, np.inf)
    if distances.dtype == object:
        ordered = np.array([[_root(x) for x in sorted(row)[:2]] for row in distances.tolist()], np.float64).reshape(-1, 2)
    else:
        ordered = np.sqrt(np.partition(distances, 1, axis=1)[:, :2])
    with np.errstate(invalid="ignore"):
        found = ordered[:, 1] - ordered[:, 0] - _SLACK * (ordered[:, 1] + ordered[:, 0])
    return np.where(np.isnan(found), -np.inf, found)


def drifts(before: list[list[int]], after: list[list[int]], gathered: list[float]) -> list[float]:
    """Gathered drift of each cluster after its centroids moved."""
    moves = [_root(sum((a - b) ** 2 for a, b in zip(old, new))) for old, new in zip(before, after)]
    return [sofar + (move + max([m for k, m in enumerate(moves) if k != own], default=0.0)) * (1 + _SLACK)
            for own, (sofar, move) in enumerate(zip(gathered, moves))]


class Block:
    """Rows of one block with their heaps and sums."""

    def __init__(self, rows: np.ndarray, clusters: int) -> None:
        self.rows, self.clusters = rows, clusters
        self.heaps: list[list[tuple[float, int]] | None] = [None] * clusters
        self.keys = [np.empty(0)] * clusters
        self.names = [np.empty(0, np.int32)] * clusters
        self.sums = np.zeros((clusters, rows.shape[1]), rows.dtype)
        self.counts = np.zeros(clusters, np.int64)
        self.scanned = 0

    def _heap(self, cluster: int) -> list[tuple[float, int]]:
        """A stored heap is taken apart only when it changes."""
        if self.heaps[cluster] is None:
            self.heaps[cluster] = list(zip(self.keys[cluster].tolist(), self.names[cluster].tolist()))
        return self.heaps[cluster]

    def scan_all(self, centroids: list[list[int]], drift: list[float]) -> None:
        """First assignment of every row."""
        distances = squared_distances(self.rows, centroids)
        nearest = distances.argmin(axis=1)
        keys = gaps(distances, nearest)
        for cluster in range(self.clusters):
            members = np.flatnonzero(nearest == cluster)
            heap = list(zip((keys[members] + drift[cluster]).tolist(), members.tolist()))
            heapify(heap)
            self.heaps[cluster] = heap
            if len(members):
                self.sums[cluster] = self.rows[members].sum(axis=0)
            self.counts[cluster] = len(members)
        self.scanned = len(self.rows)

    def rescan_expired(self, centroids: list[list[int]], drift: list[float]) -> None:
        """Pops rows whose gap the drift has used up, and assigns them again."""
        popped, owners = [], []
        for cluster in range(self.clusters):
            if not len(self.keys[cluster]) or self.keys[cluster][0] > drift[cluster]:
                continue
            heap = self._heap(cluster)
            while heap and heap[0][0] <= drift[cluster]:
                popped.append(heappop(heap)[1])
                owners.append(cluster)
        self.scanned = len(popped)
        if not popped:
            return
        rows = self.rows[popped]
        distances = squared_distances(rows, centroids)
        nearest = distances.argmin(axis=1)
        for name, cluster, gap in zip(popped, nearest.tolist(), gaps(distances, nearest).tolist()):
            # Beyond double precision nothing is known of a row, which is then looked at each round.
            key = gap + drift[cluster] if math.isfinite(drift[cluster]) else -math.inf
            heappush(self._heap(cluster), (key, name))
        owners = np.array(owners)
        moved = np.flatnonzero(owners != nearest)
        for old, new, row in zip(owners[moved].tolist(), nearest[moved].tolist(), rows[moved]):
            self.sums[old] -= row
            self.sums[new] += row
            self.counts[old] -= 1
            self.counts[new] += 1

    def stored_heaps(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for heap, keys, names in zip(self.heaps, self.keys, self.names):
            if heap is not None:
                keys = np.array([key for key, _ in heap], np.float64)
                names = np.array([name for _, name in heap], np.int32)
            yield keys, names

    def assignment(self) -> np.ndarray:
        out = np.empty(len(self.rows), np.int32)
        for cluster, (_, names) in enumerate(self.stored_heaps()):
            out[names] = cluster
        return out


def _limbs(sums: np.ndarray) -> list[int]:
    """Sums as 64-bit numbers: themselves, or where large in limbs, lowest ones of all first."""
    left = [int(x) for x in sums.ravel().tolist()]
    if all(-_LONG <= x < _LONG for x in left):
        return left
    out: list[int] = []
    while any(not -_LONG <= x < _LONG for x in left):
        out += [x & (1 << _LIMB) - 1 for x in left]
        left = [x >> _LIMB for x in left]
    return out + left


def _from_limbs(limbs: list[int], count: int) -> list[int]:
    return [sum(int(limbs[place]) << _LIMB * number for number, place in enumerate(range(first, len(limbs), count))) for first in range(count)]


def _packed(values: np.ndarray, whole: np.ndarray) -> tuple[str, bytes]:
    """Integers in as few bytes as hold them; very large ones as the given doubles."""
    if whole.dtype == object:
        return "f8", values.astype("<f8").tobytes()
    kind = "i2" if not whole.size or np.abs(whole).max() < 1 << 15 else "i4"
    return kind, whole.astype(f"<{kind}").tobytes()


def _unpacked(kind: str, data: bytes, width: int, scale: int) -> np.ndarray:
    values = np.frombuffer(data, f"<{kind}").reshape(-1, width)
    return integers(values, scale) if kind == "f8" else values.astype(np.float64)


_RESULT = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
_STATE = "kind string, data binary, keys array<double>, names array<int>, sizes array<int>, sums array<bigint>, counts array<bigint>, scanned bigint"


def _blocks(rows: DataFrame, width: int, scale: int) -> DataFrame:
    """Kept rows in blocks: their keys and integers, and nothing assigned yet."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(rows.schema[0].dataType)), *T.StructType.fromDDL(_STATE).fields])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                values = np.asarray(part.column(1).flatten(), np.float64).reshape(-1, width)
                kind, data = _packed(values, integers(values, scale))
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column(0)]))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([kind]), pa.array([data], pa.binary()), pa.array([None], pa.list_(pa.float64())), pa.array([None], pa.list_(pa.int32())),
                     pa.array([None], pa.list_(pa.int32())), pa.array([None], pa.list_(pa.int64())), pa.array([None], pa.list_(pa.int64())), pa.array([0], pa.int64())],
                    names=["ids", "kind", "data", "keys", "names", "sizes", "sums", "counts", "scanned"])

    return rows.mapInArrow(pack, schema)


def _opened(row: dict, clusters: int, width: int, scale: int) -> Block:
    block = Block(_unpacked(row["kind"], row["data"], width, scale), clusters)
    if row["sizes"] is not None:
        ends = np.cumsum(row["sizes"])[:-1]
        block.keys = np.split(np.array(row["keys"], np.float64), ends)
        block.names = np.split(np.array(row["names"], np.int32), ends)
        block.sums = np.array(_from_limbs(row["sums"], clusters * width), dtype=block.rows.dtype).reshape(clusters, width)
        block.counts = np.array(row["counts"], np.int64)
    return block


def _assign(row: dict, centroids: list[list[int]], drift: list[float], scale: int) -> Block:
    block = _opened(row, len(centroids), len(centroids[0]), scale)
    if row["sizes"] is None:
        block.scan_all(centroids, drift)
    else:
        block.rescan_expired(centroids, drift)
    return block


def _round(state: DataFrame, centroids: list[list[int]], drift: list[float], scale: int) -> DataFrame:
    """The blocks after one assignment."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in range(batch.num_rows):
                part = batch.slice(place, 1)
                row = {name: part.column(part.schema.get_field_index(name))[0].as_py() for name in ("kind", "data", "keys", "names", "sizes", "sums", "counts")}
                block = _assign(row, centroids, drift, scale)
                heaps = list(block.stored_heaps())
                new = [pa.array([np.concatenate([keys for keys, _ in heaps])], pa.list_(pa.float64())),
                       pa.array([np.concatenate([names for _, names in heaps])], pa.list_(pa.int32())),
                       pa.array([[len(keys) for keys, _ in heaps]], pa.list_(pa.int32())), pa.array([_limbs(block.sums)], pa.list_(pa.int64())),
                       pa.array([block.counts.tolist()], pa.list_(pa.int64())), pa.array([block.scanned], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *new], names=part.schema.names)

    return state.mapInArrow(work, state.schema)


def _measured(state: DataFrame, centroids: list[list[int]], drift: list[float], scale: int) -> DataFrame:
    """The last assignment: ids, clusters and distances of each block, and its distances summed by cluster."""
    schema = T.StructType([state.schema["ids"], *T.StructType.fromDDL("clusters array<int>, distances array<bigint>, sums array<decimal(38,0)>").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in range(batch.num_rows):
                part = batch.slice(place, 1)
                row = {name: part.column(part.schema.get_field_index(name))[0].as_py() for name in ("kind", "data", "keys", "names", "sizes", "sums", "counts")}
                block = _assign(row, centroids, drift, scale)
                owner = block.assignment()
                distances: list[int | None] = [None] * len(owner)
                sums: list[Decimal | None] = []
                for cluster, centroid in enumerate(centroids):
                    members = np.flatnonzero(owner == cluster)
                    found = [int(x) for x in squared_distances(block.rows[members], [centroid])[:, 0].tolist()] if len(members) else []
                    for member, value in zip(members.tolist(), found):
                        distances[member] = value if value < _LONG else None
                    sums.append(Decimal(sum(found)) if all(value < _LONG for value in found) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([owner.tolist()], pa.list_(pa.int32())), pa.array([distances], pa.list_(pa.int64())),
                     pa.array([sums], pa.list_(pa.decimal128(38, 0)))], names=["ids", "clusters", "distances", "sums"])

    return state.mapInArrow(work, schema)


def _totals(state: DataFrame, column: str) -> dict[int, int]:
    """Sums over all blocks by place in the array; as many rows as an array has places."""
    places = state.select(F.posexplode(column).alias("place", "value"))
    return {row["place"]: int(row["total"]) for row in
            places.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total")).collect()}


def _moved(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids at the floored means of their rows; empty ones stay."""
    counts, sums = _totals(state, "counts"), _totals(state, "sums")
    width, cells = len(centroids[0]), len(centroids) * len(centroids[0])
    top = max(sums) // cells + 1
    whole = [sum(sums.get(limb * cells + cell, 0) << _LIMB * limb for limb in range(top)) for cell in range(cells)]
    return [[x // counts[k] for x in whole[k * width : (k + 1) * width]] if counts[k] else centroid for k, centroid in enumerate(centroids)]


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = WIDTH, clusters: int = CLUSTERS,
            rounds: int = ROUNDS, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """Key, ``cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each kept vector."""
    values = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    odd = F.exists("_values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(f"`{key}`"), values.alias("_values")).filter((F.size("_values") == width) & ~odd)
    hashed = F.sha2(F.concat(F.lit(salt), F.col(f"`{key}`").cast("string")), 256)
    first = rows.orderBy(hashed.asc_nulls_last(), "_values").limit(clusters).select("_values").collect()
    spark: SparkSession = vectors.sparkSession
    if not first:
        return spark.createDataFrame([], T.StructType([rows.schema[0], *T.StructType.fromDDL(_RESULT).fields]))
    centroids = [[int(x) for x in integers(np.array([row["_values"]], np.float64), scale)[0].tolist()] for row in first]
    drift = [0.0] * len(centroids)
    slots = TwoSlots(spark, "heap-means")
    state = slots.store(_blocks(rows, width, scale))
    for _ in range(rounds):
        state = slots.store(_round(state, centroids, drift, scale))
        moved = _moved(state, centroids)
        drift, centroids = drifts(centroids, moved, drift), moved
    done = materialise(_measured(state, centroids, drift, scale), "heap-distances")
    per_cluster = {row["place"]: row["total"] for row in done.select(F.posexplode("sums").alias("place", "value")).groupBy("place").agg(
        F.when(F.count("value") == F.count(F.lit(1)), F.sum("value")).alias("total")).collect()}
    inertia = [None if per_cluster[k] is None else int(per_cluster[k]) for k in range(len(centroids))]
    whole = None if None in inertia else sum(inertia)
    fit = [value if value is not None and value < _LONG else None for value in [*inertia, whole]]
    hashes = [hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest() for centroid in centroids]
    facts = F.array(*[F.struct(F.lit(value).cast("long").alias("inertia"), F.lit(text).alias("hash")) for value, text in zip(fit, hashes)])
    flat = done.select(F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("clusters").alias("cluster"), F.col("distances").alias("distance"))))
    own = facts[F.col("cluster")]
    return flat.select(F.col("id").alias(key), "cluster", "distance", own["inertia"].alias("cluster_inertia"),
                       F.lit(fit[-1]).cast("long").alias("inertia"), own["hash"].alias("centroid_sha256"))
