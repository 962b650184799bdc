"""Byte-level BPE by sentencepiece: the model is written straight from a ranked vocabulary.

Every token's bytes become a piece of printable characters, one for each byte, with the score
``-rank``; normalisation is the identity. A text is cut by the vocabulary's pattern, each cut
is encoded by the model, and ids are decoded by the inverse mapping of pieces to bytes.

Defined cases: a null text is empty, an empty text has no ids and decodes to no bytes; rows are kept
as they are, repeated or not.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .wordwise import WordMemory

_NORMAL, _UNKNOWN = 1, 2
_UNKNOWN_PIECE = "⁇"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(value if value in plain else next(others)) for value in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank; ranks must run from 0 without a gap."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[number] for number in range(len(ranks))]


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value & 0xFFFFFFFFFFFFFFFF)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece model file with piece n for token n, and the unknown piece after them."""
    marks = byte_characters()
    pieces = []
    for rank, token in enumerate(tokens):
        text = "".join(marks[value] for value in token).encode()
        pieces.append(_field(1, _field(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _flag(3, _NORMAL)))
    unknown = _field(1, _UNKNOWN_PIECE.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _flag(3, _UNKNOWN)
    pieces.append(_field(1, unknown))
    # Trainer: BPE, vocabulary size, ids of the unknown, begin, end and padding pieces.
    trainer = _flag(3, 2) + _flag(4, len(tokens) + 1) + _flag(40, len(tokens)) + _flag(41, -1) + _flag(42, -1) + _flag(43, -1)
    # Normalizer: identity, no added or removed or escaped spaces.
    normalizer = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class PieceCodec:
    """Encodes and decodes by the model of one ranked vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(tokens))
        self._cut = regex.compile(pattern)
        self._marks = str.maketrans({chr(value): mark for value, mark in enumerate(byte_characters())})
        back = {mark: value for value, mark in enumerate(byte_characters())}
        # From the model's own pieces back to bytes.
        self._bytes = [bytes(back[mark] for mark in self._model.id_to_piece(number)) for number in range(len(tokens))]
        self._memory = WordMemory(self._encode_words, spaced=True)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        cuts = [[cut for cut in self._cut.findall(word)] for word in words]
        mapped = [cut.encode("utf-8", "replace").decode("latin-1").translate(self._marks) for group in cuts for cut in group]
        found = iter(self._model.encode(mapped, num_threads=1) if mapped else [])
        out = []
        for group in cuts:
            ids: list[int] = []
            for _ in group:
                ids += next(found)
            out.append(np.array(ids, "<u4").tobytes())
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return self._memory.payload(text or "")

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> PieceCodec:
    return PieceCodec(read_ranks(path), pattern)


def encode_documents(documents: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text",
                     keep_ids: bool = True) -> DataFrame:
    """Key, number of ids, digests of ids and decoded bytes, and with ``keep_ids`` the ids."""
    rows = documents.select(key, text)
    fields = [rows.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.BinaryType())] * keep_ids
    schema = T.StructType(fields)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for value in batch.column(1):
                ids = tool.encode(value.as_py())
                columns[0].append(len(ids) // 4)
                columns[1].append(hashlib.sha256(ids).hexdigest())
                columns[2].append(hashlib.sha256(tool.decode(ids)).hexdigest())
                if keep_ids:
                    columns[3].append(ids)
            arrays = [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
            arrays += [pa.array(columns[3], pa.binary())] * keep_ids
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(encode, schema)
