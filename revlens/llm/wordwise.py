"""Token ids of whole texts, put together from remembered words.

Tokenizers cut texts before single spaces between words, so the ids of a text are the ids of
its words one after the other. Each distinct word goes through the tokenizer once and its ids are
kept as bytes (32-bit, little-endian); texts with other white space between words are cut at
safe spaces only. The memory of words is emptied when full and never changes a result.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import tokenizers

# Words kept by a worker process (about 0.3 GB): an emptied memory learns its frequent words again.
WORD_LIMIT = 1_200_000
WORDS_AT_ONCE = 10_000
ID_BYTES = 4
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class WordMemory:
    """Ids of texts as bytes. ``encode_words(words)`` gives the ids of words, each as bytes.

    ``spaced``: ids of a word depend on the space before it, and on white space at its edges;
    otherwise white space only parts words, and line feeds do it as spaces do.
    """

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], spaced: bool, limit: int = WORD_LIMIT) -> None:
        self._encode, self._spaced, self._limit = encode_words, spaced, limit
        self._known: dict[str, bytes] = {}
        self._first: dict[str, bytes] = {}

    def payload(self, text: str) -> bytes:
        return self.payloads([text])[0]

    def payloads(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. What is new in any of them goes through the tokenizer in one call."""
        if self._spaced:
            parts = [text.split(" ") for text in texts]
            heads, parts = [part[0] for part in parts], [part[1:] for part in parts]
        else:
            heads, parts = [], [text.replace("\n", " ").split(" ") if text else [] for text in texts]
        self._learn(parts)
        self._learn_heads(heads)
        known, out = self._known, []
        for place, part in enumerate(parts):
            try:
                head = self._first[heads[place]] if heads else b""
                out.append(head + b"".join(map(known.__getitem__, part)))
            except KeyError:
                out.append(self._in_chunks(texts[place]))
        return out

    def _learn(self, parts: list[list[str]]) -> None:
        """Learns missing words, but for those with white space at an edge where that matters."""
        known = self._known
        missing: set[str] = set()
        for part in parts:
            missing.update(itertools.filterfalse(known.__contains__, part))
        if len(known) + len(missing) > self._limit:
            known.clear()
            missing = set().union(*parts)
        words = [word for word in missing if word and word.strip() == word] if self._spaced else list(missing)
        for begin in range(0, len(words), WORDS_AT_ONCE):
            some = words[begin : begin + WORDS_AT_ONCE]
            known.update(zip(some, self._encode([" " + word for word in some] if self._spaced else some)))

    def _learn_heads(self, heads: list[str]) -> None:
        """First words have no space before them and are encoded each for itself."""
        if len(self._first) > self._limit // 10:
            self._first.clear()
        missing = [head for head in set(heads).difference(self._first) if not head or not head[-1].isspace()]
        self._first.update(zip(missing, (self._encode([head])[0] if head else b"" for head in missing)))

    def _in_chunks(self, text: str) -> bytes:
        chunks = _SAFE_SPACE.split(text)
        return b"".join(self._encode([chunks[0], *(" " + chunk for chunk in chunks[1:])]))


def _cut(ids: np.ndarray, places: np.ndarray, ends: np.ndarray) -> list[bytes]:
    data = ids.astype("<u4").tobytes()
    return [data[a:b] for a, b in zip((places * ID_BYTES).tolist(), (ends * ID_BYTES).tolist())]


class _Words:
    """Many words in few calls of the tokenizers library: words are joined and the joined
    ids are cut where a vocabulary entry shows a word's edge; where counts differ, one by one.
    ``ordinary``: strings of special tokens in a text are text like any other."""

    def __init__(self, path: str, ordinary: bool = False) -> None:
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.names = [""] * (max(vocabulary.values()) + 1)
        for name, number in vocabulary.items():
            self.names[number] = name

    def one_by_one(self, words: list[str]) -> list[bytes]:
        return [np.array(found.ids, "<u4").tobytes() for found in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def joined_ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)


class ByteWords(_Words):
    """Words with a leading space for a byte-level vocabulary: a space begins its first id."""

    def __init__(self, path: str, ordinary: bool = False) -> None:
        super().__init__(path, ordinary)
        self.begins = np.array([name.startswith("Ġ") for name in self.names])

    def __call__(self, words: list[str]) -> list[bytes]:
        if len(words) > 1 and self._joinable(words):
            ids = self.joined_ids("".join(words))
            places = np.flatnonzero(self.begins[ids])
            if len(places) == len(words) and places[0] == 0:
                return _cut(ids, places, np.append(places[1:], len(ids)))
            if len(words) > 64:
                # One odd word spoils the count; it costs only its own part to go one by one.
                half = len(words) // 2
                return self(words[:half]) + self(words[half:])
        return self.one_by_one(words)

    @staticmethod
    def _joinable(words: list[str]) -> bool:
        """Whether every word is a space and then text without spaces or white space at its edges."""
        return "".join(words).count(" ") == len(words) and all(word[:1] == " " and word[1:].strip() == word[1:] != "" for word in words)


class SeparatedWords(_Words):
    """Words for a vocabulary whose pieces never reach over white space.

    Words are joined by a control character between spaces, which has one id of its own, and the
    joined ids are cut there. A word that holds this character gives more such ids than there are
    joints; then the words go one by one.
    """

    MARK = "\x01"

    def __init__(self, path: str, ordinary: bool = False) -> None:
        super().__init__(path, ordinary)
        self.mark = self.joined_ids(self.MARK)

    def __call__(self, words: list[str]) -> list[bytes]:
        if len(words) > 1 and len(self.mark) == 1:
            ids = self.joined_ids(f" {self.MARK} ".join(words))
            joints = np.flatnonzero(ids == self.mark[0])
            if len(joints) == len(words) - 1:
                return _cut(ids, np.concatenate(([0], joints + 1)), np.append(joints, len(ids)))
            if len(words) > 64:
                half = len(words) // 2
                return self(words[:half]) + self(words[half:])
        return self.one_by_one(words)


@lru_cache(maxsize=2)
def byte_level_memory(path: str, ordinary: bool = False, limit: int = WORD_LIMIT) -> WordMemory:
    """One memory for each worker process and tokenizer file."""
    return WordMemory(ByteWords(path, ordinary), spaced=True, limit=limit)


@lru_cache(maxsize=2)
def separated_word_memory(path: str, ordinary: bool = False, limit: int = WORD_LIMIT) -> WordMemory:
    return WordMemory(SeparatedWords(path, ordinary), spaced=False, limit=limit)
