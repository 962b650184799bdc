"""Shingle sets of documents as arrays of 64-bit hashes, and their parity sketches.

Plain numpy helpers over one batch of documents; Spark deals out the batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

SKETCH_BITS = 1024
PART_BYTES = 1 << 18
_SPACES = re.compile(rb"[\x20\x09-\x0D]")

# One random 64-bit number for every byte, A-Z as a-z; white space ends words.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, np.uint64)[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def scramble(values: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (multiply and shift rounds), so that any bits may be used."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(length: int) -> np.ndarray:
    powers = np.full(length, _STEP, np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of UTF-8 bytes and the place of each word's first byte.

    Words are runs of anything but ASCII white space, with A-Z in lower case. Long input is
    taken in parts of whole words, so that working arrays stay small.
    """
    found, begin = [], 0
    while begin < len(data) or not found:
        cut = _SPACES.search(data, begin + PART_BYTES)
        end = cut.start() if cut else len(data)
        hashes, starts = _part_hashes(data[begin:end])
        found.append((hashes, starts + begin))
        begin = end
        if not cut:
            break
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _part_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A word's hash sums its byte values times powers of an odd step."""
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    powers = _powers(int((ends - starts).max()))
    values = _BYTE_VALUES[raw]
    lengths = ends - starts
    inside = ~space
    offsets = np.flatnonzero(inside) - np.repeat(starts, lengths)
    sums = np.add.reduceat(values[inside] * powers[offsets], np.cumsum(lengths) - lengths)
    return scramble(sums + lengths.astype(np.uint64)), starts


def distinct_shingles(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than ``width`` words is one
    shingle, a null, empty or blank one has none."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text or "")
        if size > PART_BYTES:
            yield from _group_shingles(group, width)
            group, size = [], 0
    yield from _group_shingles(group, width)


def _group_shingles(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    coded = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
    if not coded:
        return
    hashes, starts = word_hashes(b" ".join(coded))
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    first = np.searchsorted(starts, np.cumsum(lengths + 1) - lengths - 1)
    last = np.append(first[1:], len(starts))
    window = max(0, len(hashes) - width + 1)
    joined = np.full(window, width, np.uint64)
    for place in range(width):
        joined = scramble(joined * _STEP + hashes[place : place + window])
    for begin, end in zip(first.tolist(), last.tolist()):
        if end - begin >= width:
            yield np.unique(joined[begin : end - width + 1])
        elif end > begin:
            short = np.array([end - begin], np.uint64)
            for place in range(begin, end):
                short = scramble(short * _STEP + hashes[place : place + 1])
            yield short
        else:
            yield np.empty(0, np.uint64)


def parity_sketch(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit sketch as bytes: every hash flips one bit, so the Hamming distance of two sketches
    is at most the size of the symmetric difference of the sets."""
    flips = np.bincount((hashes % np.uint64(bits)).view(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(bool))


def set_signature(hashes: np.ndarray) -> int:
    """Signed 64-bit digest of a whole set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


class Bands:
    """Size bands and the number of sketch pieces of each.

    A pair of sizes s and t with Jaccard similarity at or over ``percent`` % differs in at most
    (s + t)(100 - percent) / (100 + percent) elements. Inside band k, where no size is over
    ``tops[k]``, so many disjoint pieces of the sketches can differ; with one piece more, at
    least one is equal. ``spare`` more pieces make up for light ones.
    """

    def __init__(self, percent: int, ratio: float = 1.5, spare: float = 0.25) -> None:
        self.percent, self.ratio, self.spare = percent, ratio, spare
        self.tops: list[int] = []
        self.pieces: list[int] = []

    def differing(self, size: int, other: int) -> int:
        return (size + other) * (100 - self.percent) // (100 + self.percent)

    def _extend(self, size: int) -> None:
        while not self.tops or self.tops[-1] < size:
            top = max(self.tops[-1] + 1, int(self.tops[-1] * self.ratio)) if self.tops else 1
            self.tops.append(top)
            most = self.differing(top, top)
            self.pieces.append(most + 1 + int(most * self.spare))

    def of(self, size: int) -> list[int]:
        """The band of a set of that size, and each higher one in which a partner may lie."""
        largest = size * 100 // self.percent
        self._extend(largest)
        return list(range(int(np.searchsorted(self.tops, size)), int(np.searchsorted(self.tops, largest)) + 1))


def piece_keys(hashes: np.ndarray, bands: Bands) -> np.ndarray:
    """Join keys of a set: of pieces of its sketch, in every band it takes part in.

    A piece holds 64 parity bits, each over the same bit of the hashes that fall into it: unlike sets
    have equal pieces only where they share all elements there, however many sets there are. Pieces of
    few elements are alike in unrelated sets, so only the fullest are taken, one more than can differ in
    the band; ties go by key. That loses nothing: of two partners, one takes all its pieces from a
    higher place of this order on; one of these lies in no difference, and the other takes it too.
    """
    keys = []
    mixed = scramble(hashes)
    bits = scramble(mixed ^ _STEP)
    for band in bands.of(len(hashes)):
        pieces, top = bands.pieces[band], bands.tops[band]
        inside = (mixed % np.uint64(pieces)).view(np.int64)
        words = np.zeros(pieces, np.uint64)
        np.bitwise_xor.at(words, inside, bits)
        place = np.arange(pieces, dtype=np.uint64) + np.uint64(band << 40)
        found = scramble(scramble(place) + words)
        wanted = bands.differing(len(hashes), min(top, len(hashes) * 100 // bands.percent)) + 1
        fullest = np.lexsort((found, np.bincount(inside, minlength=pieces)))[-wanted:]
        keys.append(found[fullest])
    return np.concatenate(keys).view(np.int64)
