"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each model also sees the probabilities of the
categories before it. For fitting, those come from models that have not seen the row (folds
by a hash of the text), as they will for new rows. Features are the presence of words and of word
beginnings that tell categories apart, and a few shares of characters.

The chain is fitted on the driver on at most ``FIT_DOCUMENTS`` labelled rows chosen by a hash of
their id. Applying it reads whole texts, batch by batch.

Defined cases: null and blank texts have probability 0 everywhere; a category with labels of one
kind only gets that kind's constant; without labels nothing is toxic; repeated rows score alike.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import append_columns, keep_rows

FIT_DOCUMENTS = 4_000
TERMS_PER_CATEGORY = 400
LEAST_ROWS = 5
FOLDS = 4
WORD_LIMIT = 100_000
_WORD = re.compile(r"\w+")
_BEGINNINGS = (3, 4, 5, 6)
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = bytes(value for value in range(33, 127) if not chr(value).isalnum())
_SHARES = 6


def terms_of(text: str) -> set[str]:
    """Distinct words and word beginnings (marked by a trailing star)."""
    words = set(_WORD.findall(text.lower()))
    out = set(words)
    for size in _BEGINNINGS:
        out.update(word[:size] + "*" for word in words if len(word) > size)
    return out


def shares_of(text: str) -> list[float]:
    """Log length, shares of upper case, digits and marks, distinct words, mean word length."""
    raw = text.encode("utf-8", "replace")
    size = max(1, len(raw))
    share = lambda kind: (len(raw) - len(raw.translate(None, kind))) / size
    words = text.split()
    return [math.log1p(len(raw)) / 12, share(_UPPER), share(_DIGITS), share(_MARKS),
            len(set(words)) / max(1, len(words)), min(1.0, size / max(1, len(words)) / 20)]


class LinearModel:
    """Logistic regression with a square penalty, by accelerated gradient steps."""

    def __init__(self, weights: np.ndarray, offset: float) -> None:
        self.weights, self.offset = weights, offset

    @classmethod
    def fit(cls, rows: np.ndarray, target: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> LinearModel:
        """Columns are scaled by their size, so that rare telling terms are learned as fast as
        frequent ones; the rarer class weighs more, by the root of the ratio of the classes."""
        share = float(target.mean()) if len(target) else 0.0
        if share in (0.0, 1.0):
            return cls(np.zeros(rows.shape[1], np.float32), -20.0 if share == 0 else 20.0)
        scale = (np.sqrt((rows * rows).mean(axis=0)) + 0.02).astype(np.float32)
        design = np.hstack([rows / scale, np.ones((len(rows), 1), np.float32)])
        weigh = np.where(target > 0, (share / (1 - share)) ** -0.25, (share / (1 - share)) ** 0.25).astype(np.float32)
        vector = np.random.default_rng(1).normal(size=design.shape[1]).astype(np.float32)
        for _ in range(12):
            vector = design.T @ (weigh * (design @ vector))
            vector /= np.linalg.norm(vector)
        bound = float(np.linalg.norm(design.T @ (weigh * (design @ vector)))) / len(rows) / 4 + penalty
        now = ahead = np.zeros(design.shape[1], np.float32)
        for step in range(steps):
            wrong = weigh * (1 / (1 + np.exp(-np.clip(design @ ahead, -30, 30))) - target)
            gradient = design.T @ wrong.astype(np.float32) / len(rows) + penalty * np.append(ahead[:-1], 0)
            after = ahead - (gradient / bound).astype(np.float32)
            now, ahead = after, after + step / (step + 3) * (after - now)
        return cls(now[:-1] / scale, float(now[-1]))

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights + self.offset, -30, 30)))


class ToxicityChain:
    """Fitted chain: terms, then one linear model for each category in order."""

    def __init__(self, categories: Sequence[str], terms: dict[str, int], models: list[LinearModel]) -> None:
        self.categories, self.terms, self.models = list(categories), terms, models
        self._seen: dict[str, tuple[int, ...]] = {}

    def features(self, texts: Sequence[str]) -> np.ndarray:
        """Presence of terms, then shares."""
        out = np.zeros((len(texts), len(self.terms) + _SHARES), np.float32)
        seen = self._seen
        for row, text in enumerate(texts):
            words = set(_WORD.findall(text.lower()))
            if len(seen) > WORD_LIMIT:
                seen.clear()
            for word in words.difference(seen):
                seen[word] = self._places(word)
            out[row, list(chain.from_iterable(map(seen.__getitem__, words)))] = 1
            out[row, len(self.terms) :] = shares_of(text)
        return out

    def _places(self, word: str) -> tuple[int, ...]:
        """Columns of a word and of its beginnings."""
        names = [word, *(word[:size] + "*" for size in _BEGINNINGS if len(word) > size)]
        return tuple(self.terms[name] for name in names if name in self.terms)

    def probabilities(self, texts: Sequence[str]) -> np.ndarray:
        """One column for each category, each model seeing the columns before its own."""
        rows = self.features(texts)
        for model in self.models:
            rows = np.hstack([rows, model.probability(rows)[:, None].astype(np.float32)])
        found = rows[:, len(self.terms) + _SHARES :].astype(float)
        found[[not text.strip() for text in texts]] = 0.0
        return found

    def judge(self, texts: Sequence[str | None]) -> np.ndarray:
        """``probabilities`` of any number of texts, null ones as empty."""
        parts = [self.probabilities([value or "" for value in texts[begin : begin + 500]]) for begin in range(0, len(texts), 500)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.categories)))

    @classmethod
    def train(cls, texts: Sequence[str], targets: np.ndarray, categories: Sequence[str], folds: np.ndarray) -> ToxicityChain:
        """``targets`` has one column of 0 and 1 for each category; ``folds`` a number for each row."""
        counts = [Counter() for _ in categories]
        total: Counter = Counter()
        for text, marks in zip(texts, targets):
            terms = terms_of(text)
            total.update(terms)
            for count, mark in zip(counts, marks):
                if mark:
                    count.update(terms)
        chosen: list[str] = []
        for place, count in enumerate(counts):
            size = len(targets)
            positive = float(targets[:, place].sum()) if size else 0.0
            if not 0 < positive < size:
                continue
            scored = []
            for term, rows in total.items():
                if rows >= LEAST_ROWS:
                    spread = rows * (positive / size) * (1 - positive / size) * (1 - rows / size)
                    scored.append((-abs(count[term] - rows * positive / size) / math.sqrt(spread + 1), term))
            chosen += [term for _, term in sorted(scored)[:TERMS_PER_CATEGORY]]
        fitted = cls(categories, {term: place for place, term in enumerate(dict.fromkeys(chosen))}, [])
        rows = fitted.features(texts)
        for place in range(len(categories)):
            target = targets[:, place].astype(np.float32)
            fitted.models.append(LinearModel.fit(rows, target))
            if place + 1 < len(categories):
                unseen = np.zeros(len(rows), np.float32)
                for fold in np.unique(folds):
                    unseen[folds == fold] = LinearModel.fit(rows[folds != fold], target[folds != fold]).probability(rows[folds == fold])
                rows = np.hstack([rows, unseen[:, None]])
        fitted._seen.clear()
        return fitted


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = FIT_DOCUMENTS,
        categories: dict[str, str] | None = None) -> ToxicityChain:
    """Fits on at most ``rows`` labelled documents.

    ``categories`` maps names, in the chain's order, to SQL conditions on ``labels``.
    """
    categories = categories or {"low_quality": "quality = 0", "toxic": "toxic = 1"}
    chosen = labels.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), *[F.coalesce(F.expr(rule).cast("int"), F.lit(0)).alias(f"_{place}") for place, rule in enumerate(categories.values())]
    ).groupBy("_key").agg(*[F.max(f"_{place}").alias(f"_{place}") for place in range(len(categories))]).orderBy(F.xxhash64("_key"), "_key").limit(rows)
    # At most ``rows`` ids: small enough for every executor. Of repeated ids each different text counts once.
    found = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull()) \
        .join(F.broadcast(chosen), "_key").distinct().orderBy(F.xxhash64("_key", "_text"), "_key", "_text").limit(rows).toPandas()
    texts = found["_text"].tolist()
    targets = found[[f"_{place}" for place in range(len(categories))]].to_numpy()
    folds = np.array([hash_fold(value) for value in texts], np.int64)
    return ToxicityChain.train(texts, targets, list(categories), folds)


def hash_fold(text: str) -> int:
    """Equal texts share a fold, so a copy never tells about itself."""
    return zlib.crc32(text.encode("utf-8", "replace")) % FOLDS


def score_documents(documents: DataFrame, fitted: ToxicityChain, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns of ``documents`` with ``p_<category>`` for each category and ``is_toxic``, which
    holds where the last category's probability reaches ``threshold``."""
    fields = [T.StructField(f"p_{name}", T.DoubleType()) for name in fitted.categories]
    fields.append(T.StructField("is_toxic", T.BooleanType()))

    def start() -> Callable[[list[str | None]], list[list]]:
        def compute(texts: list[str | None]) -> list[list]:
            found = fitted.judge(texts)
            return [*(column.tolist() for column in found.T), (found[:, -1] >= threshold).tolist()]

        return compute

    return append_columns(documents, text, fields, start)


def drop_toxic(documents: DataFrame, fitted: ToxicityChain, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``documents`` whose last category's probability stays under ``threshold``."""
    return keep_rows(documents, text, lambda: lambda texts: (fitted.judge(texts)[:, -1] < threshold).tolist())
