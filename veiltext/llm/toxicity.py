"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltext.llm.batches import annotated, small_batches

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")
BUCKETS = 1 << 18
STARTS = (3, 4, 5, 6, 7)
KNOWN_WORDS = 400_000
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 3; fold 1 is held out."""
    return F.crc32(key.cast("string").cast("binary")) % 3


def features(word: str) -> list[int]:
    """Buckets of a word and of its first letters, in lower case."""
    low = word.lower()
    names = [f"w:{low}"] + [f"{n}:{low[:n]}" for n in STARTS if len(low) >= n]
    return [zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS for name in names]


def sample_labels(labels: DataFrame, per_class: int) -> DataFrame:
    """Up to `per_class` keys of each class outside the held-out fold, those with the smallest hash.

    A key that is labelled twice takes the higher label; null keys and labels are left out.
    """
    marks = (
        labels.filter("toxic is not null and doc_id is not null")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(fold(F.col("doc_id")) != 1)
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [marks.filter(F.col("toxic") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    return some[0].unionByName(some[1])


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per sentence of the sample: its document, label, and features."""
    for batch in batches:
        rows = []
        for key, toxic, text in zip(batch["doc_id"], batch["toxic"], batch["text"]):
            for sentence in SENTENCE.findall(text if isinstance(text, str) else ""):
                if words := WORD.findall(sentence):
                    found = sorted({b for w in words for b in features(w)})
                    rows.append((key, toxic, found))
        yield pd.DataFrame(rows, columns=["doc_id", "toxic", "features"])


class NoisyOr:
    """p(document) = 1 - prod(1 - p(sentence)), p(sentence) a logistic function of its features."""

    def __init__(self, docs: np.ndarray, labels: np.ndarray, rows: np.ndarray, columns: np.ndarray, width: int,
                 weight: float = 1.0) -> None:
        """`weight` is that of a toxic document; a clean one's is 1."""
        self.docs, self.labels, self.rows, self.columns, self.width = docs, labels, rows, columns, width
        share = np.where(labels == 1, weight, 1.0)
        self.share = share / share.sum()

    def gradient(self, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        z = bias + np.bincount(self.rows, weights=weights[self.columns], minlength=len(self.docs))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(self.docs, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(self.labels))
        some = -np.expm1(none)
        # d(-log likelihood)/dz of a sentence: p for a clean document, else -p (1 - P) / P.
        factor = np.where(self.labels == 1, -(1 - some) / np.maximum(some, 1e-12), 1.0)
        dz = p * (factor * self.share)[self.docs]
        return np.bincount(self.columns, weights=dz[self.rows], minlength=self.width), float(dz.sum())

    def fitted(self, steps: int, rate: float, shrink: float) -> tuple[np.ndarray, float]:
        """Full-batch Adam steps; `shrink` pulls weights to 0."""
        at = np.zeros(self.width + 1)
        at[-1] = -4.0
        mean, square = np.zeros_like(at), np.zeros_like(at)
        for t in range(1, steps + 1):
            dw, db = self.gradient(at[:-1], at[-1])
            g = np.r_[dw + shrink * at[:-1], db]
            mean = 0.9 * mean + 0.1 * g
            square = 0.999 * square + 0.001 * g * g
            at -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
        return at[:-1], float(at[-1])


def _train(rows: pd.DataFrame, width: int, steps: int, rate: float, shrink: float) -> pd.DataFrame:
    """The weights from the sentences of the bounded sample: `bucket, weight`; bucket -1 is the bias."""
    rows = rows.sort_values("doc_id", kind="stable")
    _, first, docs = np.unique(rows["doc_id"].to_numpy(), return_index=True, return_inverse=True)
    labels = rows["toxic"].to_numpy()[first].astype(int)
    lengths = rows["features"].map(len).to_numpy()
    owner = np.repeat(np.arange(len(rows)), lengths)
    bucket = np.concatenate(rows["features"].to_numpy()).astype(np.int64)
    # Documents of each class that have a feature; those that tell classes apart best stay.
    pairs = np.unique(bucket * len(labels) + docs[owner])
    seen = [np.bincount(pairs[labels[pairs % len(labels)] == c] // len(labels), minlength=BUCKETS) for c in (0, 1)]
    size = [max(1, int((labels == c).sum())) for c in (0, 1)]
    odds = np.log((seen[1] + 0.5) / (size[1] + 1)) - np.log((seen[0] + 0.5) / (size[0] + 1))
    worth = np.abs(odds) * np.sqrt(seen[0] / size[0] + seen[1] / size[1]) * (seen[0] + seen[1] > 1)
    chosen = np.sort(np.argsort(-worth, kind="stable")[:width])
    chosen = chosen[worth[chosen] > 0]
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))
    use = column[bucket] >= 0
    weight = size[0] / size[1]  # both classes count the same
    model = NoisyOr(docs, labels, owner[use], column[bucket[use]], len(chosen), weight)
    weights, bias = model.fitted(steps, rate, shrink)
    return pd.DataFrame({"bucket": np.r_[chosen, -1], "weight": np.r_[weights, bias]})


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, width: int = 512,
          steps: int = 400, rate: float = 0.1, shrink: float = 1e-5) -> dict[int, float]:
    """The sentence model: a weight for each of at most `width` buckets, and the bias under -1.

    Learned from labels of whole documents: at most `per_class` of each class (a bounded sample, by
    hash of the key), none of the held-out fold. Features of the sample are made in parallel, the
    model by one task, and only its weights reach the driver. Without documents of both classes the
    model is a bias that calls nothing toxic.
    """
    small_batches(docs.sparkSession)
    chosen = F.broadcast(sample_labels(labels, per_class))  # 2 * per_class rows at most
    bags = docs.select("doc_id", "text").join(chosen, "doc_id").mapInPandas(
        _bags, "doc_id bigint, toxic int, features array<int>"
    )

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        return _train(rows.drop(columns="all"), width, steps, rate, shrink)

    fitted = bags.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(fit, "bucket long, weight double")
    model = {int(r["bucket"]): float(r["weight"]) for r in fitted.collect()}
    return model or {-1: -30.0}


class Scorer:
    """Scores texts with a model; words keep their features' weights while a worker remembers them."""

    def __init__(self, model: dict[int, float], offending: float) -> None:
        self.model, self.offending = model, offending
        self.known: dict[str, list[tuple[int, float]]] = {}

    def _sentence(self, words: list[str]) -> float:
        """The log odds of a sentence; a feature that occurs twice counts once."""
        hit: dict[int, float] = {}
        for word in words:
            weights = self.known.get(word)
            if weights is None:
                found = [(b, self.model[b]) for b in features(word) if b in self.model]
                weights = self.known[word] = found
            if weights:
                hit.update(weights)
        return self.model[-1] + math.fsum(hit.values())

    def text(self, text: str) -> tuple[float, list[dict]]:
        none, spans = 0.0, []
        for sentence in SENTENCE.finditer(text):
            if words := WORD.findall(sentence.group()):
                z = max(-700.0, min(700.0, self._sentence(words)))
                none -= max(z, 0.0) + math.log1p(math.exp(-abs(z)))
                p = 1 / (1 + math.exp(-z))
                if p >= self.offending:
                    spans.append({"start": sentence.start(), "end": sentence.end(), "score": p})
        return -math.expm1(none), spans

    def __call__(self, texts: list[str]) -> list:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        scores, spans = zip(*map(self.text, texts))
        return [scores, pa.array(spans, _SPANS)]


def score_documents(docs: DataFrame, model: dict[int, float], offending: float = 0.5) -> DataFrame:
    """`doc_id, score, offending`: the noisy-or of all sentences of each whole text, and the
    sentences (code points, end exclusive) that are toxic by themselves.

    Text alone decides a score. A null text, or one without words, scores 0. Repeated and null keys
    are scored row by row; an empty table gives no rows; other columns are ignored.
    """
    return annotated(
        docs, Scorer(model, offending),
        "score double, offending array<struct<start:int,end:int,score:double>>",
    )
