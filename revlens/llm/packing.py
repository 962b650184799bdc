"""Packing by the online sum-of-squares rule.

A packer keeps an array with the number of open windows at every fill level, of ``UNIT`` ids each. A document's full
windows are closed at once; what is left goes to the level that makes the sum of the squared
counts of partly filled windows least, a new window included; of equal levels to the fullest. A window is closed
once less than a unit is free in it.

Scan partitions encode the texts and send of each piece only its place, length and checksum to a packer (its
ids where wanted), so the rule sees about ``PACKER_DOCUMENTS`` documents, however the table is split, and
a packer never holds more. At its end the windows still open are put together where two or more fit into one,
fullest first; nothing is cut but at full windows. A task that is run again gives the same rows, and
a packer numbers its windows within its own range of ids.

Defined cases: a null text is empty and has the end id alone; repeated rows are packed each
for itself; a long document spans windows of its own and one shared window; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import parts_of, quoted
from .wordwise import WORD_LIMIT, byte_level_memory

WINDOW = 2048
END_ID = 1
UNIT = 16
PACKER_DOCUMENTS = 20_000
_IDS_PER_PACKER = 1 << 36


class SumOfSquares:
    """Open windows by fill level; ``place`` gives window and offset."""

    def __init__(self, window: int, first_id: int, unit: int = UNIT) -> None:
        self.window, self.next_id, self.unit = window, first_id, min(unit, window)
        levels = -(-window // self.unit)
        self.counts = np.zeros(levels, np.int64)
        # Names and fills of the open windows of each level, and the fill of the one to be taken next.
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(levels)]
        self.fills = np.full(levels, window + 1, np.int64)
        self.closed = 0

    def new_window(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, size: int) -> tuple[int, int]:
        """Window and offset of a piece of ``size`` below the window's length."""
        counts, unit, most = self.counts, self.unit, self.window - self.unit
        usable = np.flatnonzero(self.fills <= self.window - size)
        # Change of the sum: one window leaves its level, one enters the new level unless closed.
        after = self.fills[usable] + size
        target = after // unit
        moved = np.where(target == usable, 0, 1 - 2 * counts[usable])
        change = moved + np.where((after > most) | (target == usable), 0, 2 * counts[np.minimum(target, len(counts) - 1)] + 1)
        fresh = 2 * int(counts[size // unit]) + 1 if size <= most else 0
        best = int(len(usable) - 1 - np.argmin(change[::-1])) if len(usable) else -1
        if best < 0 or fresh < change[best]:
            name, fill = self.new_window(), 0
        else:
            level = int(usable[best])
            name, fill = self.open[level].pop()
            counts[level] -= 1
            self.fills[level] = self.open[level][-1][1] if self.open[level] else self.window + 1
        if fill + size <= most:
            level = (fill + size) // unit
            self.open[level].append((name, fill + size))
            counts[level] += 1
            self.fills[level] = fill + size
        else:
            self.closed += 1
        return name, fill

    def left_open(self) -> list[tuple[int, int]]:
        """Name and fill of every open window, fullest first."""
        return sorted((item for level in self.open for item in level), key=lambda item: (-item[1], item[0]))


def put_together(windows: list[tuple[int, int]], window: int) -> dict[int, tuple[int, int]]:
    """For each open window, fullest first, the one it becomes part of and its offset there: the first
    that has room."""
    goal: dict[int, tuple[int, int]] = {}
    bins: list[list[int]] = []
    for name, fill in windows:
        found = next((kept for kept in bins if kept[1] + fill <= window), None)
        if found is None:
            found = [name, 0]
            bins.append(found)
        goal[name] = (found[0], found[1])
        found[1] += fill
    return goal


def pack_documents(documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                   end_id: int = END_ID, keep_ids: bool = False, ordinary: bool = False, word_limit: int = WORD_LIMIT) -> DataFrame:
    """One row for each piece of a document: key, start, length, checksum of its ids, the
    document's ids, sequence and offset there, and with ``keep_ids`` the ids themselves. With
    ``ordinary`` strings of special tokens are text like any other; ``word_limit`` bounds the words a
    worker process remembers, never the result."""
    rows = documents.select(F.col(quoted(key)).alias("_key"), F.col(quoted(text)).alias("_text"))
    packers = max(1, math.ceil(documents.count() / PACKER_DOCUMENTS))
    kind = rows.schema["_key"].dataType
    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([T.StructField(key, kind), *(T.StructField(name, T.LongType()) for name in longs), *[T.StructField("ids", T.BinaryType())] * keep_ids])
    sent = T.StructType([T.StructField("_packer", T.LongType()), T.StructField("_part", T.LongType()), T.StructField("_turn", T.LongType()), *schema.fields])
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every piece of every document; those that fill a window have it, the others wait for a packer."""
        memory = byte_level_memory(tokenizer, ordinary, word_limit)
        part, turn, windows = TaskContext.get().partitionId(), 0, 0
        for batch in parts_of(batches):
            out: list[list] = [[] for _ in sent.names[4:]]
            owners, turns = [], []
            for place, ids in enumerate(memory.payloads([value or "" for value in batch.column(1).to_pylist()])):
                ids += end
                total, turn = len(ids) // 4, turn + 1
                for start in range(0, total, window):
                    piece = ids[start * 4 : (start + window) * 4]
                    full = len(piece) == window * 4
                    row = (start, len(piece) // 4, zlib.crc32(piece), total, (packers + part) * _IDS_PER_PACKER + windows if full else None, 0 if full else None, piece)
                    windows += full
                    for column, value in zip(out, row):
                        column.append(value)
                    owners.append(place)
                    turns.append(turn)
            arrays = [pa.array([(part + number // 64) % packers for number in turns], pa.int64()), pa.array([part] * len(turns), pa.int64()), pa.array(turns, pa.int64()),
                      batch.column(0).take(pa.array(owners, pa.int64())), *(pa.array(column, pa.int64()) for column in out[:6])]
            arrays += [pa.array(pieces, pa.binary()) for pieces in out[6:]]
            yield pa.RecordBatch.from_arrays(arrays, names=sent.names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places the waiting pieces of each packer in turn. Of pieces in open windows only places are held."""
        current, packer = None, SumOfSquares(window, 0)
        waiting: list[pa.RecordBatch] = []

        def settle() -> Iterator[pa.RecordBatch]:
            goal = put_together(packer.left_open(), window)
            held = [batch for batch in waiting if batch.num_rows]
            waiting.clear()
            for batch in held:
                names, offsets = batch.column(8).to_pylist(), batch.column(9).to_pylist()
                moved = [goal.get(name, (name, 0)) for name in names]
                yield _result(batch, [name for name, _ in moved], [offset + more for offset, (_, more) in zip(offsets, moved)])

        def _result(batch: pa.RecordBatch, names: list[int], offsets: list[int]) -> pa.RecordBatch:
            columns = batch.columns
            return pa.RecordBatch.from_arrays([*columns[3:8], pa.array(names, pa.int64()), pa.array(offsets, pa.int64()), *columns[10:]], names=schema.names)

        for batch in batches:
            numbers = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), batch.num_rows]
            for begin, stop in zip(edges[:-1], edges[1:]):
                if begin == stop:
                    continue
                if numbers[begin] != current:
                    yield from settle()
                    current = int(numbers[begin])
                    packer = SumOfSquares(window, current * _IDS_PER_PACKER)
                some = batch.slice(begin, stop - begin)
                names, offsets = some.column(8).to_pylist(), some.column(9).to_pylist()
                for place, size in enumerate(some.column(5).to_pylist()):
                    if names[place] is None:
                        names[place], offsets[place] = packer.place(size)
                columns = list(some.columns)
                columns[8], columns[9] = pa.array(names, pa.int64()), pa.array(offsets, pa.int64())
                waiting.append(pa.RecordBatch.from_arrays(columns, names=sent.names))
        yield from settle()

    dealt = rows.mapInArrow(encode, sent).repartition("_packer").sortWithinPartitions("_packer", "_part", "_turn", "start")
    return dealt.mapInArrow(pack, schema)
