"""Language identification by a byte convolutional network in numpy.

Bytes are embedded; filters over two, three and four bytes slide over a window of fixed length;
each filter's largest value feeds a softmax. A text is cut into windows from its first to its
last byte, and its probabilities are the windows' mean, weighted by their bytes.

The network is fitted on the driver on a bounded sample of windows and sent to the tasks. It knows every
language of the labelled rows: ``FIT_DOCUMENTS`` texts of each, fewer where all would be more than
``FIT_TEXTS``, but at least one. Windows are drawn from the whole of a text.

Defined cases: a null text and one without a letter are ``und`` with score 0; without any
labelled text every text is ``und``; with one language every text with a letter has that one.
A network fitted with ``junk`` has ``und`` as one more class, learned from made-up text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.session import broadcast_if_bounded, materialise

from .columns import append_columns, keep_rows

FIT_DOCUMENTS = 1000
HASHES = 2**31
FIT_TEXTS = 128_000
WINDOW = 256
UNKNOWN = "und"
_WIDEST, _EMBED, _PER_WIDTH, _WIDTHS = 4, 8, 16, (2, 3, 4)
_FILTERS = _PER_WIDTH * len(_WIDTHS)
_BLOCK = 128
_CELLS = 4_000_000


def windows_of(raw: bytes, length: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows (rows of byte codes plus one, 0 behind the end) and their bytes."""
    count = max(1, -(-len(raw) // length))
    codes = np.zeros(count * length, np.uint16)
    codes[: len(raw)] = np.frombuffer(raw, np.uint8)
    codes[: len(raw)] += 1
    sizes = np.full(count, length)
    sizes[-1] = len(raw) - (count - 1) * length
    return codes.reshape(count, length), sizes


class ByteNetwork:
    """Weights of the network and its passes."""

    def __init__(self, labels: list[str], seed: int = 11) -> None:
        draw = np.random.default_rng(seed)
        self.labels = labels
        self.embedding = draw.normal(0, 0.5, (257, _EMBED)).astype(np.float32)
        self.embedding[0] = 0
        self.mask = np.zeros((_WIDEST, _EMBED, _FILTERS), np.float32)
        for place, width in enumerate(_WIDTHS):
            self.mask[:width, :, place * _PER_WIDTH : (place + 1) * _PER_WIDTH] = 1
        self.mask = self.mask.reshape(_WIDEST * _EMBED, _FILTERS)
        self.filters = draw.normal(0, 0.25, self.mask.shape).astype(np.float32) * self.mask
        self.bias = np.zeros(_FILTERS, np.float32)
        self.weights = draw.normal(0, 0.1, (_FILTERS, len(labels))).astype(np.float32)
        self.offset = np.zeros(len(labels), np.float32)

    def _unfold(self, codes: np.ndarray) -> np.ndarray:
        """Embedded four-byte neighbourhoods: one row for each byte of each window."""
        padded = np.zeros((len(codes), codes.shape[1] + _WIDEST - 1, _EMBED), np.float32)
        padded[:, : codes.shape[1]] = self.embedding[codes]
        steps = padded.strides
        view = np.lib.stride_tricks.as_strided(
            padded, (len(codes), codes.shape[1], _WIDEST * _EMBED), (steps[0], steps[1], steps[2]))
        return np.ascontiguousarray(view).reshape(-1, _WIDEST * _EMBED)

    def _pooled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unfolded = self._unfold(codes)
        return unfolded, (unfolded @ self.filters).reshape(len(codes), codes.shape[1], _FILTERS)

    def _softmax(self, hidden: np.ndarray) -> np.ndarray:
        scores = hidden @ self.weights + self.offset
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        """One row of probabilities for each window."""
        out = np.empty((len(codes), len(self.labels)), np.float32)
        for begin in range(0, len(codes), _BLOCK):
            _, values = self._pooled(codes[begin : begin + _BLOCK])
            out[begin : begin + _BLOCK] = self._softmax(np.maximum(values.max(axis=1) + self.bias, 0))
        return out

    def train(self, codes: np.ndarray, target: np.ndarray, epochs: int = 4, least_steps: int = 500, rate: float = 0.004, seed: int = 5) -> None:
        """Adam on shuffled blocks of windows; few windows are seen more often."""
        epochs = max(epochs, -(-least_steps * _BLOCK // max(1, len(codes))))
        epochs = min(epochs, least_steps)
        draw = np.random.default_rng(seed)
        names = ("embedding", "filters", "bias", "weights", "offset")
        first = {name: np.zeros_like(getattr(self, name)) for name in names}
        second = {name: np.zeros_like(getattr(self, name)) for name in names}
        step, total = 0, epochs * -(-len(codes) // _BLOCK)
        for _ in range(epochs):
            order = draw.permutation(len(codes))
            for begin in range(0, len(codes), _BLOCK):
                chosen = order[begin : begin + _BLOCK]
                gradients = self._gradients(codes[chosen], target[chosen])
                step += 1
                pace = rate * (1 - step / (total + 1))
                for name in names:
                    gradient = gradients[name]
                    first[name] = 0.9 * first[name] + 0.1 * gradient
                    second[name] = 0.99 * second[name] + 0.01 * gradient**2
                    scale = np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7
                    change = pace * first[name] / (1 - 0.9**step) / scale
                    setattr(self, name, getattr(self, name) - change.astype(np.float32))
                self.embedding[0] = 0
                self.filters *= self.mask

    def _gradients(self, codes: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        count, length = codes.shape
        unfolded, values = self._pooled(codes)
        places = values.argmax(axis=1)
        pooled = np.take_along_axis(values, places[:, None, :], axis=1)[:, 0] + self.bias
        hidden = np.maximum(pooled, 0)
        error = self._softmax(hidden)
        error[np.arange(count), target] -= 1
        error /= count
        back = (error @ self.weights.T) * (pooled > 0)
        rows = unfolded[(places + np.arange(count)[:, None] * length).ravel()].reshape(count, _FILTERS, -1)
        filters = np.einsum("bf,bfk->kf", back, rows) * self.mask
        spread = (back[:, :, None] * self.filters.T[None]).reshape(-1, _EMBED)
        padded = np.zeros((count, length + _WIDEST - 1), codes.dtype)
        padded[:, :length] = codes
        touched = padded[np.arange(count)[:, None, None], places[:, :, None] + np.arange(_WIDEST)].ravel()
        embedding = np.stack([np.bincount(touched, spread[:, k], 257) for k in range(_EMBED)], axis=1)
        return {"embedding": embedding.astype(np.float32), "filters": filters, "bias": back.sum(axis=0),
                "weights": hidden.T @ error, "offset": error.sum(axis=0)}

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Label and mean probability of each text, over all its windows."""
        step = max(1, _CELLS // len(self.labels))
        if len(texts) > step:
            parts = [self.predict(texts[begin : begin + step]) for begin in range(0, len(texts), step)]
            return [name for names, _ in parts for name in names], [score for _, scores in parts for score in scores]
        totals = np.zeros((len(texts), len(self.labels)))
        codes, owners, sizes, held = [], [], [], 0

        def settle() -> None:
            if codes:
                found = self.probabilities(np.concatenate(codes)) * np.concatenate(sizes)[:, None]
                np.add.at(totals, np.concatenate(owners), found)
            codes.clear(), owners.clear(), sizes.clear()

        for number, text in enumerate(texts):
            raw = text.encode("utf-8", "replace")
            for begin in range(0, max(1, len(raw)), WINDOW * 4096):
                part, size = windows_of(raw[begin : begin + WINDOW * 4096])
                codes.append(part), sizes.append(size), owners.append(np.full(len(part), number))
                held += len(part)
                if held >= 2048:
                    settle()
                    held = 0
        settle()
        totals /= np.maximum(totals.sum(axis=1, keepdims=True), 1e-9)
        best = totals.argmax(axis=1)
        return [self.labels[k] for k in best], totals[np.arange(len(texts)), best].tolist()


def training_windows(raw: bytes, seed: int) -> list[bytes]:
    """Up to three windows and a short piece, at places of the whole text that ``seed`` chooses."""
    draw = np.random.default_rng(seed)
    starts = draw.integers(0, len(raw) - WINDOW + 1, 3).tolist() if len(raw) > WINDOW else [0]
    short = int(draw.integers(8, 65))
    place = int(draw.integers(0, max(1, len(raw) - short + 1)))
    return [raw[start : start + WINDOW] for start in starts] + [raw[place : place + short]]


def junk_windows(pieces: list[bytes], seed: int = 9) -> list[bytes]:
    """Made-up text without a language: the characters of every third piece in disorder, and as many
    pieces of random ASCII, of random letters of one alphabet and of random letters of all."""
    draw = np.random.default_rng(seed)
    letters = np.array([chr(code) for code in range(0x10000) if chr(code).isalpha()])
    plain = np.array(list(map(chr, range(32, 127))))
    out = []
    for piece in pieces[::3]:
        marks = np.array(list(piece.decode("utf-8", "ignore") or "?"))
        begin = int(draw.integers(len(letters) - 40))
        kinds = (draw.permutation(marks), draw.choice(plain[draw.random(len(plain)) < draw.uniform(0.2, 1)], len(marks)),
                 draw.choice(letters[begin : begin + 40], len(marks)), draw.choice(letters, len(marks)))
        out += ["".join(kind).encode()[:WINDOW] for kind in kinds]
    return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = FIT_DOCUMENTS, junk: bool = False) -> ByteNetwork | None:
    """Fits on at most ``per_language`` different texts of each language, those with the least hashes.

    Texts are first thinned by their hash to about four times that many of a language, so
    what is shuffled and ranked doesn't grow with the table, and copies count once. Of each of them
    only the windows to fit on are shuffled and collected. With ``junk`` text in no language is a class too.
    """
    rows = labelled.filter(F.col(text).rlike(r"\p{L}") & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.withColumn("_h", F.xxhash64("text"))
    counted = materialise(rows.groupBy("lang").agg(F.approx_count_distinct("_h").alias("texts")), "languages")
    languages = sorted(row["lang"] for row in counted.select("lang").collect())
    if not languages:
        return None
    per_language = max(1, min(per_language, FIT_TEXTS // len(languages)))
    # A few more than four times, so that a language of few texts loses none.
    bounds = counted.select("lang", (F.least(F.lit(1.0), (4 * per_language + 50) / F.greatest("texts", F.lit(1))) * HASHES).cast("long").alias("_bound"))
    thinned = rows.join(broadcast_if_bounded(bounds), "lang").filter(F.pmod("_h", F.lit(HASHES)) < F.col("_bound")).select("lang", "_h", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [training_windows(value.as_py().encode("utf-8", "replace"), seed % 2**64)
                   for value, seed in zip(batch.column(2), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cut, pa.list_(pa.binary()))], names=["lang", "_h", "windows"])

    texts = thinned.mapInArrow(work, "lang string, _h long, windows array<binary>").groupBy("lang", "_h").agg(F.min("windows").alias("windows"))
    chosen = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    sample = texts.withColumn("_n", chosen).filter(F.col("_n") <= per_language).orderBy("lang", "_n").select("lang", "windows").collect()
    names = sorted({*languages, UNKNOWN}) if junk else languages
    network, places = ByteNetwork(names), {name: place for place, name in enumerate(names)}
    pieces = [bytes(piece) for row in sample for piece in row["windows"]]
    target = [places[row["lang"]] for row in sample for _ in row["windows"]]
    if junk:
        made = junk_windows(pieces)
        pieces, target = pieces + made, target + [places[UNKNOWN]] * len(made)
    codes = [windows_of(piece)[0][0] for piece in pieces]
    network.train(np.stack(codes), np.array(target))
    return network


def predict_languages(documents: DataFrame, network: ByteNetwork | None, text: str = "text") -> DataFrame:
    """All columns of ``documents`` with ``lang_pred`` and ``score``."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def start() -> Callable[[list[str | None]], list[list]]:
        def compute(texts: list[str | None]) -> list[list]:
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            known = [] if network is None else [k for k, value in enumerate(texts) if value and any(map(str.isalpha, value))]
            if known:
                for k, name, score in zip(known, *network.predict([texts[k] for k in known])):
                    names[k], scores[k] = name, min(1.0, max(0.0, score))
            return [names, scores]

        return compute

    return append_columns(documents, text, fields, start)


def drop_unknown(documents: DataFrame, network: ByteNetwork | None, least: float, text: str = "text") -> DataFrame:
    """Rows with a letter, but for those that ``network`` calls text in no language with a score of
    ``least`` or more; without a network all with letters."""

    def start() -> Callable[[list[str | None]], list[bool]]:
        def passes(texts: list[str | None]) -> list[bool]:
            stay = [bool(value) and any(map(str.isalpha, value)) for value in texts]
            known = [k for k, good in enumerate(stay) if good] if network is not None else []
            if known:
                for k, name, score in zip(known, *network.predict([texts[k] for k in known])):
                    stay[k] = name != UNKNOWN or score < least
            return stay

        return passes

    return keep_rows(documents, text, start)


def held_out(key: Column) -> Column:
    """A fifth of all documents, by a checksum of the key; rows without a key are not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
