"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal updates.

Features of a text are its words and runs of marks, neighbouring pairs of them, and one
feature for a word followed by itself, hashed into 2**bits buckets.  A bucket's value is the
square root of its count, divided by the length of the vector.  The score is the logistic
function of a sparse dot product; a text without tokens scores the bias.

Null and empty texts are scored alike.  Repeated rows get equal scores.  An existing column
of the name `score` is replaced.  With no usable label, all scores are 0.5.  Long texts are read whole, with some
ten numbers for each word.  An id that stands at several texts counts once in training and is
scored row by row.  An empty table gives no rows; other columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm import words
from billweave.llm.labelled import train_once, training_rows

_REPEAT = 1  # bucket of a word that follows itself
_BIAS = 0


@dataclass(frozen=True)
class Ftrl:
    """Settings: hash bits, learning rate, smoothing, L1 and L2 strength, sample and passes."""

    bits: int = 18
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01
    max_labelled: int = 20_000
    epochs: int = 2


def features(blobs: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, value) of the hashed words and word pairs of the texts."""
    owner, _, h = words.tokens(blobs)
    size = np.uint64(1 << bits)
    pair = owner[1:] == owner[:-1]
    left, right = h[:-1][pair], h[1:][pair]
    pairs = words.mix(left * np.uint64(0x9E3779B97F4A7C15) + right) % size
    pairs[left == right] = _REPEAT
    owners = np.concatenate([owner, owner[1:][pair]])
    buckets = np.concatenate([h % size, pairs])
    owners, buckets, counts = words.counted(owners, buckets, bits)
    values = np.sqrt(counts)
    length = np.sqrt(np.bincount(owners, values * values, minlength=len(blobs)))
    return owners, buckets, values / length[owners]


class Model:
    """Weights per bucket; the bias is kept apart."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @property
    def learnt(self) -> bool:
        """Whether any labelled row moved the model."""
        return bool(self.bias or self.weights.any())

    def to_bytes(self) -> bytes:
        return np.append(self.weights, self.bias).astype("<f4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Model:
        values = np.frombuffer(raw, "<f4").astype(float)
        return cls(values[:-1], float(values[-1]))

    def score(self, texts: pd.Series) -> np.ndarray:
        bits = len(self.weights).bit_length() - 1
        out = []
        for blobs in words.chunks(texts):
            owners, buckets, values = features(blobs, bits)
            dots = np.bincount(owners, self.weights[buckets] * values, minlength=len(blobs))
            out.append(1 / (1 + np.exp(-np.clip(dots + self.bias, -35, 35))))
        return np.concatenate(out) if out else np.zeros(0)


def fit(batches: Iterator[pd.DataFrame], s: Ftrl) -> Model:
    """Follow-the-regularised-leader over the rows (y, text) as they come."""
    n_coord = (1 << s.bits) + 1
    z, n = np.zeros(n_coord), np.zeros(n_coord)

    def leader(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        l1 = np.where(i == n_coord - 1, 0.0, s.l1)
        shrunk = np.sign(zi) * l1 - zi
        return np.where(np.abs(zi) <= l1, 0.0, shrunk / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2))

    for batch in batches:
        labels, row = batch["y"].to_numpy(), 0
        for blobs in words.chunks(batch["text"]):
            owners, buckets, values = features(blobs, s.bits)
            cuts = np.searchsorted(owners, np.arange(len(blobs) + 1))
            for k in range(len(blobs)):
                i = np.append(buckets[cuts[k] : cuts[k + 1]], n_coord - 1)
                x = np.append(values[cuts[k] : cuts[k + 1]], 1.0)
                w = leader(i)
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - labels[row]) * x
                grown = n[i] + g * g
                z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / s.alpha * w
                n[i] = grown
                row += 1
    w = leader(np.arange(n_coord))
    return Model(w[:-1], w[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Ftrl = Ftrl()) -> Model:
    """Fit on at most `settings.max_labelled` labelled rows outside the held-out fold."""
    rows = training_rows(docs, labels, label, settings.max_labelled, settings.epochs)
    return Model.from_bytes(train_once(rows, lambda b: fit(b, settings).to_bytes()))


def with_score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """The rows with the model's score of their whole text; the weights are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model.to_bytes())
    held: dict[str, Model] = {}

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = held.setdefault("model", Model.from_bytes(shared.value))
        for texts in batches:
            yield pd.Series(model.score(texts))

    return docs.withColumn(out, F.pandas_udf(score, "double")(F.col(text).cast("string")))
