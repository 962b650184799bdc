"""Heap-ordered clustering against plain rounds over all vectors in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from revlens.llm import heap_means

SF = "/root/testdata/sf0.001"


def brute(rows, width, clusters, rounds):
    kept = [(key, [int(math.floor(x * 1024)) if abs(x) < 2**900 else int(x) * 1024 for x in vector]) for key, vector in rows
            if vector is not None and len(vector) == width and all(x is not None and math.isfinite(x) for x in vector)]
    order = sorted(kept, key=lambda row: (row[0] is None, hashlib.sha256(f"3:{row[0]}".encode()).hexdigest(), row[1]))
    centroids = [vector for _, vector in order[:clusters]]
    for turn in range(rounds + 1):
        distances = [[sum((a - b) ** 2 for a, b in zip(vector, centroid)) for centroid in centroids] for _, vector in kept]
        owners = [row.index(min(row)) for row in distances]
        if turn < rounds:
            for k in range(len(centroids)):
                members = [vector for (_, vector), owner in zip(kept, owners) if owner == k]
                if members:
                    centroids[k] = [sum(column) // len(members) for column in zip(*members)]
    fit = lambda value: value if value is not None and value < 2**63 else None
    inertia = [sum(row[owner] for row, owner in zip(distances, owners) if owner == k) for k in range(len(centroids))]
    lost = {owner for row, owner in zip(distances, owners) if row[owner] >= 2**63}
    inertia = [None if k in lost else value for k, value in enumerate(inertia)]
    whole = None if lost else sum(inertia)
    hashes = [hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest() for centroid in centroids]
    return [(key, owner, fit(row[owner]), fit(inertia[owner]), fit(whole), hashes[owner]) for (key, _), owner, row in zip(kept, owners, distances)]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(key, vector, 1, "x", "y") for key, vector in rows],
                                 "vec_id long, embedding array<double>, cluster int, distance string, ids string").repartition(3)


def test_given_vectors(spark):
    rows = [(row["vec_id"], row["embedding"]) for row in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = heap_means.cluster(spark.read.parquet(f"{SF}/embeddings.parquet").repartition(5)).collect()
    assert ordered(found) == ordered(brute(rows, 64, 8, 10))


@pytest.mark.parametrize("size", [1.0, 1e-3, 3e4, 1e30, 1e306])
def test_odd_vectors_ties_and_sizes(spark, size):
    draw = np.random.default_rng(5)
    rows = [(k, (draw.normal(size=2) * size).tolist()) for k in range(150)]
    rows += [(200, [size, 0.0])] * 40 + [(200, [-size, 0.0])] * 3 + [(None, [0.0, 0.0])] * 2
    rows += [(300, None), (301, []), (302, [1.0]), (303, [1.0, 2.0, 3.0]), (304, [None, 1.0]), (305, [float("nan"), 1.0]), (306, [float("inf"), 0.0])]
    found = heap_means.cluster(table(spark, rows), width=2, clusters=5, rounds=4).collect()
    assert ordered(found) == ordered(brute(rows, 2, 5, 4))


def test_few_and_no_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    assert ordered(heap_means.cluster(table(spark, rows), width=2).collect()) == ordered(brute(rows, 2, 8, 10))
    assert heap_means.cluster(table(spark, rows).limit(0), width=2).collect() == []


def test_only_expired_rows_are_scanned():
    draw = np.random.default_rng(3)
    rows = np.floor(np.concatenate([draw.normal(loc, 20, (500, 4)) for loc in (-3000, 0, 3000)]))
    centroids = [[int(x) for x in rows[place]] for place in (0, 500, 1000)]
    block, drift, scanned = heap_means.Block(rows, 3), [0.0] * 3, []
    for turn in range(6):
        (block.rescan_expired if turn else block.scan_all)(centroids, drift)
        scanned.append(block.scanned)
        distances = ((rows[:, None, :] - np.array(centroids)) ** 2).sum(axis=2)
        assert (block.assignment() == distances.argmin(axis=1)).all()
        assert (block.sums == [rows[block.assignment() == k].sum(axis=0) for k in range(3)]).all()
        moved = [[int(x) // int(n) for x in total] for total, n in zip(block.sums, block.counts)]
        drift, centroids = heap_means.drifts(centroids, moved, drift), moved
    assert scanned[0] == 1500 and sum(scanned[1:]) == 0
