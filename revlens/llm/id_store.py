"""Files of token ids with a minimal perfect hash from document keys to places.

A store is a folder of shard files in ascending key order. A shard file has the raw ids of its
documents one after the other, the first id of each record, and an index: one seed for
each small group of keys sends every key to a slot of its own, where a 32-bit fingerprint of the key
and its record numbers stand. A lookup reads one seed and one slot, whatever the shard's size; a
key that is not in the store is told by its fingerprint.

Shards are ranges of the key, as many as a quarter of the root of the documents, so that both their
number and their size stay moderate. A task streams a shard to a name of its own and
renames it when whole, so a task that is run again replaces its file by an equal one.

Defined cases: a null text is empty and has the end id alone; a null key is a key of its own
and comes first; rows that repeat a key follow each other by text, and a lookup gives all of
them; an empty table makes a store without shards.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranges import range_bounds, range_number
from .shingles import scramble
from .columns import parts_of
from .wordwise import separated_word_memory

MAGIC = b"IDSTORE1"
END_ID = 1
_KEYS_PER_GROUP = 4
_STEP = np.uint64(0xD6E8FEB86659FD93)


def key_bytes(key) -> bytes:
    return b"\xff" if key is None else str(key).encode("utf-8", "surrogatepass")


def key_hashes(keys: list[bytes], salt: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(key, salt) for key in keys), np.uint64, len(keys))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (scramble(hashes ^ _STEP) >> np.uint64(32)).astype(np.uint32)


def _slots(hashes: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """Slot of each hash under its group's seed; a negative seed names the slot itself."""
    drawn = scramble(hashes + seeds.astype(np.uint64) * _STEP) % np.uint64(size)
    return np.where(seeds < 0, -seeds - 1, drawn.astype(np.int64))


def perfect_hash(hashes: np.ndarray) -> np.ndarray:
    """Seeds of the groups of a minimal perfect hash over distinct 64-bit hashes.

    Groups are placed from the largest down, each trying seeds until all its keys meet free slots;
    groups of one key take what slots are left.
    """
    size = len(hashes)
    groups = max(1, -(-size // _KEYS_PER_GROUP))
    of = ((hashes >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=groups)
    begins = np.cumsum(counts) - counts
    seeds = np.zeros(groups, np.int64)
    taken = np.zeros(size, bool)
    tries = np.arange(64, dtype=np.int64)
    by_size = np.argsort(-counts, kind="stable")
    for group in by_size[counts[by_size] > 1].tolist():
        keys = hashes[order[begins[group] : begins[group] + counts[group]]]
        first = 0
        while True:
            slots = _slots(keys[None, :], np.broadcast_to((tries + first)[:, None], (64, len(keys))), size)
            free = ~taken[slots].any(axis=1)
            if len(keys) > 1:
                ordered = np.sort(slots, axis=1)
                free &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            hit = np.flatnonzero(free)
            if len(hit):
                seeds[group] = first + hit[0]
                taken[slots[hit[0]]] = True
                break
            first += 64
    alone = by_size[counts[by_size] == 1]
    seeds[alone] = -np.flatnonzero(~taken)[: len(alone)] - 1
    return seeds


class ShardWriter:
    """Streams records in key order to one shard file."""

    def __init__(self, files: fs.FileSystem, path: str, dtype: str) -> None:
        self._files, self._path, self._dtype = files, path, np.dtype(dtype)
        self._draft = f"{path}.{uuid.uuid4().hex}"
        self._out = files.open_output_stream(self._draft)
        self._starts, self._keys = [0], []

    def add(self, key, ids: bytes) -> None:
        """``ids`` as little-endian 32-bit integers."""
        values = np.frombuffer(ids, "<u4")
        self._out.write(values.astype(self._dtype).tobytes())
        self._starts.append(self._starts[-1] + len(values))
        self._keys.append(key_bytes(key))

    def close(self) -> tuple[int, int]:
        """Writes the index, gives records and ids."""
        keys = list(dict.fromkeys(self._keys))
        salt = 0
        while True:
            hashes = key_hashes(keys, salt)
            if len(np.unique(hashes)) == len(keys):
                break
            salt += 1
        seeds = perfect_hash(hashes)
        groups = ((hashes >> np.uint64(32)) % np.uint64(len(seeds))).astype(np.int64)
        slots = _slots(hashes, seeds[groups], len(keys))
        places = {key: place for place, key in enumerate(keys)}
        numbers = np.fromiter((places[key] for key in self._keys), np.int64, len(self._keys))
        firsts = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1])))
        table = np.zeros(len(keys), [("print", "<u4"), ("record", "<u4"), ("count", "<u4")])
        table["print"][slots] = fingerprint(hashes)
        table["record"][slots] = firsts
        table["count"][slots] = np.bincount(numbers, minlength=len(keys))
        parts = {"starts": np.array(self._starts, "<i8").tobytes(), "seeds": seeds.astype("<i8").tobytes(), "table": table.tobytes()}
        footer = {"dtype": self._dtype.str, "salt": salt, "payload": self._starts[-1] * self._dtype.itemsize,
                  "parts": {name: len(body) for name, body in parts.items()}}
        for body in parts.values():
            self._out.write(body)
        ending = json.dumps(footer).encode()
        self._out.write(ending + struct.pack("<q", len(ending)) + MAGIC)
        self._out.close()
        if self._files.get_file_info(self._path).type != fs.FileType.NotFound:
            self._files.delete_file(self._path)
        self._files.move(self._draft, self._path)
        return len(self._keys), self._starts[-1]


class ShardReader:
    """Keyed access to one shard file; holds its index, reads ids from the file."""

    def __init__(self, files: fs.FileSystem, path: str) -> None:
        self._file = files.open_input_file(path)
        size = self._file.size()
        length, magic = struct.unpack("<q8s", self._file.read_at(16, size - 16))
        if magic != MAGIC:
            raise ValueError(f"not a shard of ids: {path}")
        footer = json.loads(self._file.read_at(length, size - 16 - length))
        place = footer["payload"]
        parts = {}
        for name, count in footer["parts"].items():
            parts[name] = self._file.read_at(count, place)
            place += count
        self._dtype, self._salt = np.dtype(footer["dtype"]), footer["salt"]
        self.starts = np.frombuffer(parts["starts"], "<i8")
        self._seeds = np.frombuffer(parts["seeds"], "<i8")
        self._table = np.frombuffer(parts["table"], [("print", "<u4"), ("record", "<u4"), ("count", "<u4")])

    def find(self, keys: list) -> list[range]:
        """Record numbers of each key; empty for a key that is not there."""
        hashes = key_hashes([key_bytes(key) for key in keys], self._salt)
        groups = ((hashes >> np.uint64(32)) % np.uint64(len(self._seeds))).astype(np.int64)
        slots = _slots(hashes, self._seeds[groups], len(self._table))
        found = self._table[slots % len(self._table)]
        known = found["print"] == fingerprint(hashes)
        return [range(int(r), int(r + c)) if ok else range(0) for ok, r, c in zip(known, found["record"], found["count"])]

    def ids(self, record: int) -> np.ndarray:
        begin, end = int(self.starts[record]), int(self.starts[record + 1])
        width = self._dtype.itemsize
        return np.frombuffer(self._file.read_at((end - begin) * width, begin * width), self._dtype)

    def close(self) -> None:
        self._file.close()


class IdStore:
    """A written store: folder, bounds of the shards' keys, and first id of each shard."""

    def __init__(self, path: str, bounds: list, bases: dict[int, int]) -> None:
        self.path, self.bounds, self.bases = path, bounds, bases

    def lookup(self, keys: DataFrame, key: str = "doc_id", keep_ids: bool = True) -> DataFrame:
        """Every record of the distinct keys: key, first id among all, number of ids, their
        checksum as 32-bit integers and, with ``keep_ids``, the ids themselves."""
        path, bases = self.path, self.bases
        wanted = keys.select(key).distinct().withColumn("_shard", range_number(F.col(key), self.bounds))
        wanted = wanted.repartition(max(1, len(bases)), "_shard").sortWithinPartitions("_shard", key)
        schema = T.StructType([wanted.schema[key], *(T.StructField(name, T.LongType()) for name in ("start", "n_tokens", "ids_crc32")),
                               *[T.StructField("ids", T.BinaryType())] * keep_ids])

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, root = fs.FileSystem.from_uri(path)
            reader, current = None, None
            for batch in batches:
                names, shards = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                out: list[list] = [[], [], [], [], []]
                edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
                for begin, end in zip(edges, edges[1:]):
                    if begin == end or int(shards[begin]) not in bases:
                        continue
                    if int(shards[begin]) != current:
                        if reader:
                            reader.close()
                        current = int(shards[begin])
                        reader = ShardReader(files, f"{root}/{shard_name(current)}")
                    for name, records in zip(names[begin:end], reader.find(names[begin:end])):
                        for record in records:
                            ids = reader.ids(record).astype("<u4").tobytes()
                            for column, value in zip(out, (name, bases[current] + int(reader.starts[record]), len(ids) // 4, zlib.crc32(ids), ids)):
                                column.append(value)
                arrays = [pa.array(out[0], batch.schema.field(0).type), *(pa.array(column, pa.int64()) for column in out[1:4])]
                arrays += [pa.array(out[4], pa.binary())] * keep_ids
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
            if reader:
                reader.close()

        return wanted.mapInArrow(read, schema)


def shard_name(number: int) -> str:
    return f"shard-{number:08d}.ids"


def write_store(documents: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text",
                end_id: int = END_ID, dtype: str = "<u2", ordinary: bool = False) -> IdStore:
    """Encodes all texts and writes the store under ``path`` (a URI or a path that all
    executors reach). ``dtype`` must hold every id; it is checked. With ``ordinary`` strings of
    special tokens are text like any other."""
    rows = documents.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    shards = math.ceil(math.sqrt(rows.count()) / 4)
    bounds = range_bounds(rows, "_key", shards)
    most = np.iinfo(np.dtype(dtype)).max
    end = np.array([end_id], "<u4").tobytes()
    dealt = rows.withColumn("_shard", range_number(F.col("_key"), bounds)).repartition(max(1, shards), "_shard") \
        .sortWithinPartitions("_shard", "_key", "_text").select("_shard", "_key", "_text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)
        files.create_dir(root, recursive=True)
        memory = separated_word_memory(tokenizer, ordinary)
        if len(memory._encode.names) - 1 > most or end_id > most:
            raise ValueError(f"{dtype} can't hold every id of {tokenizer}")
        writer, current, done = None, None, []
        for batch in parts_of(batches):
            payloads = memory.payloads(batch.column(2).to_pylist())
            for shard, name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), payloads):
                if shard != current:
                    if writer:
                        done.append((current, *writer.close()))
                    current, writer = shard, ShardWriter(files, f"{root}/{shard_name(shard)}", dtype)
                writer.add(name, ids + end)
        if writer:
            done.append((current, *writer.close()))
        yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in done], pa.int64()) for k in range(3)], names=["shard", "records", "ids"])

    # One row for each shard.
    bases, total = {}, 0
    for row in sorted(dealt.mapInArrow(write, "shard long, records long, ids long").collect()):
        bases[row["shard"]] = total
        total += row["ids"]
    return IdStore(path, bounds, bases)
