"""Toxicity: a factorization machine over hashed terms.

score = logistic(bias + sum of weights + sum over pairs of the products of their factors),
over the distinct terms (words and word stems) of the text.  Weights follow FTRL-proximal updates with L1; a term
gets factors only once its own weight is not zero and it was seen often enough, so that
pairs of terms carry what the terms alone do not (an insult next to a group's name) and rare
terms add no noise.  Factors follow AdaGrad.

Null and empty texts score the bias.  Repeated rows get equal scores.  An existing column of
the name `score` is replaced.  With no usable label, all scores are 0.5.  Long texts are read whole, with some
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


@dataclass(frozen=True)
class Fm:
    """Settings: hash bits, factors a word, rates, L1 and L2, sightings before factors."""

    bits: int = 18
    factors: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.001
    factor_rate: float = 0.05
    factor_l2: float = 0.001
    sightings: int = 5
    max_labelled: int = 20_000
    epochs: int = 3


STEMS = (4, 5, 6)  # leading bytes of a word that make terms of their own, for its inflected forms


def features(blobs: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of the distinct hashed terms (words and their stems) of the texts."""
    owner, kind, whole, *stems = words.tokens(blobs, STEMS)
    word = kind == words.WORD
    parts = [whole[word], *(words.mix(h[word] + np.uint64(n)) for n, h in zip(STEMS, stems))]
    hashes = np.concatenate(parts) % np.uint64(1 << bits)
    owners, buckets, _ = words.counted(np.tile(owner[word], len(parts)), hashes, bits)
    return owners, buckets


class Model:
    """Bias, weights and factors (zero where a word has none)."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    @property
    def learnt(self) -> bool:
        """Whether any labelled row moved the model."""
        return bool(self.bias or self.weights.any())

    def to_bytes(self) -> bytes:
        used = np.flatnonzero(self.weights)
        head = np.array([len(self.weights), self.factors.shape[1], len(used)], "<i8").tobytes()
        body = np.column_stack([self.weights[used], self.factors[used]]).astype("<f4").tobytes()
        return head + np.array([self.bias], "<f8").tobytes() + used.astype("<i8").tobytes() + body

    @classmethod
    def from_bytes(cls, raw: bytes) -> Model:
        size, k, used = np.frombuffer(raw, "<i8", 3)
        at = np.frombuffer(raw, "<i8", used, 32)
        body = np.frombuffer(raw, "<f4", offset=32 + 8 * used).reshape(used, k + 1)
        weights, factors = np.zeros(size), np.zeros((size, k))
        weights[at], factors[at] = body[:, 0], body[:, 1:]
        return cls(float(np.frombuffer(raw, "<f8", 1, 24)[0]), weights, factors)

    def score(self, texts: pd.Series) -> np.ndarray:
        bits = len(self.weights).bit_length() - 1
        out = []
        for blobs in words.chunks(texts):
            owners, buckets = features(blobs, bits)
            known = self.weights[buckets] != 0
            owners, buckets = owners[known], buckets[known]
            total = self.bias + np.bincount(owners, self.weights[buckets], minlength=len(blobs))
            for f in self.factors.T:
                v = f[buckets]
                s = np.bincount(owners, v, minlength=len(blobs))
                total += 0.5 * (s * s - np.bincount(owners, v * v, minlength=len(blobs)))
            out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
        return np.concatenate(out) if out else np.zeros(0)


def fit(batches: Iterator[pd.DataFrame], s: Fm) -> Model:
    """One pass over the rows (y, text) as they come."""
    size = 1 << s.bits
    z, n, seen = np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
    v = np.random.default_rng(7).normal(0, 0.01, (size, s.factors))
    squares = np.ones((size, s.factors))
    bias, bias_n = 0.0, 1.0

    def leader(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        shrunk = np.sign(zi) * s.l1 - zi
        return np.where(np.abs(zi) <= s.l1, 0.0, shrunk / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2))

    for batch in batches:
        labels, row = batch["y"].to_numpy(), 0
        for blobs in words.chunks(batch["text"]):
            owners, buckets = features(blobs, s.bits)
            cuts = np.searchsorted(owners, np.arange(len(blobs) + 1))
            for k in range(len(blobs)):
                i = buckets[cuts[k] : cuts[k + 1]]
                w = leader(i)
                seen[i] += 1
                paired = i[(w != 0) & (seen[i] >= s.sightings)]
                vi = v[paired]
                sums = vi.sum(0)
                total = bias + w.sum() + 0.5 * float((sums * sums - (vi * vi).sum(0)).sum())
                g = 1 / (1 + np.exp(-np.clip(total, -35, 35))) - labels[row]
                grown = n[i] + g * g
                z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / s.alpha * w
                n[i] = grown
                if len(paired) > 1:
                    gv = g * (sums - vi) + s.factor_l2 * vi
                    squares[paired] += gv * gv
                    v[paired] = vi - s.factor_rate * gv / np.sqrt(squares[paired])
                bias_n += g * g
                bias -= 0.1 * g / np.sqrt(bias_n)
                row += 1
    w = leader(np.arange(size))
    v[(w == 0) | (seen < s.sightings)] = 0
    return Model(bias, w, v)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Fm = Fm()) -> Model:
    """Fit on at most `settings.max_labelled` labelled rows outside the held-out fold."""
    rows = training_rows(docs, labels, label, settings.max_labelled, settings.epochs)
    return Model.from_bytes(train_once(rows, lambda b: fit(b, settings).to_bytes()))


def with_score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """The rows with the model's score of their whole text; the model is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model.to_bytes())
    held: dict[str, Model] = {}

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = held.setdefault("model", Model.from_bytes(shared.value))
        for texts in batches:
            yield pd.Series(model.score(texts))

    return docs.withColumn(out, F.pandas_udf(score, "double")(F.col(text).cast("string")))
