"""Quality of documents: counted rules, and a likelihood ratio of hashed n-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veiltext.llm.batches import annotated, few_keys, numbered, remembered, small_batches
from veiltext.session import stored

WORD = re.compile(r"[^ \t-\r]")
BLANKS = " \t\n\x0b\x0c\r"
SIGNS = "#*$%&|<>"
WINDOW = 5
GROUP_CHARS = 1 << 20
KNOWN_WORDS = 1 << 18
BASE = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean"
)


def words_of(text: str) -> list[bytes]:
    """The words in UTF-8, which parts at ASCII blanks alone."""
    return text.encode("utf-8", "surrogatepass").split()


class Words:
    """Numbers for words, in the order they are met, and a hash of each.

    Only equality of numbers matters, and hashes are fixed, so emptying a full memory between
    groups of texts changes no result. Fewer than 2**21 words are numbered at a time.
    """

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.hashes = np.zeros(1 << 12, dtype=np.uint64)

    def numbered(self, texts: list[list[bytes]]) -> np.ndarray:
        """The numbers of all words of the texts, one after the other."""
        if len(self.numbers) > KNOWN_WORDS:
            self.numbers.clear()
        known = self.numbers
        for word in set().union(*texts) - known.keys():
            no = known[word] = len(known)
            if no >= len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.hashes[no] = zlib.crc32(word) << 32 | zlib.crc32(word, 0x9E3779B9)
        total = sum(map(len, texts))
        return np.fromiter((known[w] for text in texts for w in text), dtype=np.int64, count=total)


def _words() -> Words:
    return remembered("quality words", Words)


def groups(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """The texts in runs of about a million characters; a null counts as empty."""
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text if isinstance(text, str) else "")
        size += len(held[-1])
        if size >= GROUP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def buckets(hashes: np.ndarray, docs: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and all pairs of neighbours of the same text, and whose text each is."""
    mix = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    mix ^= mix >> np.uint64(29)
    same = docs[:-1] == docs[1:]
    found = np.concatenate([hashes, mix[same]]) * np.uint64(0xD6E8FEB86659FD93)
    found = (found >> np.uint64(33)) % np.uint64(count)
    return found.astype(np.int64), np.concatenate([docs, docs[:-1][same]])


def repeated_words(numbers: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window of five words that its text holds twice or more."""
    n = len(numbers) - WINDOW + 1
    covered = np.zeros(len(numbers) + 1, dtype=np.int64)
    if n <= 0:
        return covered[:-1] > 0
    start = np.flatnonzero(docs[:n] == docs[WINDOW - 1:])
    if not len(start):
        return covered[:-1] > 0
    # A window in two integers, exactly: texts of a group and words have fewer than 2**21 numbers.
    high = numbers[start] << 42 | numbers[start + 1] << 21 | numbers[start + 2]
    low = docs[start] << 42 | numbers[start + 3] << 21 | numbers[start + 4]
    order = np.lexsort((high, low))
    high, low = high[order], low[order]
    equal = (high[1:] == high[:-1]) & (low[1:] == low[:-1])
    hit = start[order[np.r_[equal, False] | np.r_[False, equal]]]
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + WINDOW, -1)
    return np.cumsum(covered[:-1]) > 0


def _lines(text: str) -> int:
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(lines) - len(set(lines))


def _count(batches: Iterator[pd.DataFrame], count: int) -> Iterator[pd.DataFrame]:
    """The bucket counts of one partition, for all texts and for the trusted ones."""
    raw, good = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
    for batch in batches:
        trusted = batch["trusted"].to_numpy(dtype=bool)
        at = 0
        for texts in groups(batch["text"]):
            split = [words_of(text) for text in texts]
            words = _words()
            numbers = words.numbered(split)
            docs = np.repeat(np.arange(len(split)), [len(s) for s in split])
            found, owner = buckets(words.hashes[numbers], docs, count)
            raw += np.bincount(found, minlength=count)
            good += np.bincount(found[trusted[at:at + len(texts)][owner]], minlength=count)
            at += len(texts)
    some = np.flatnonzero(raw)
    yield pd.DataFrame({"bucket": some, "raw": raw[some], "good": good[some]})


def ngram_weights(docs: DataFrame, trusted: DataFrame, count: int = 1 << 15) -> np.ndarray:
    """log p(bucket | trusted) - log p(bucket | all) for each bucket, from all documents.

    `trusted` has the keys of trusted documents; as long as they are few, texts stay where they are.
    Every partition counts into one vector, and the vectors are added by bucket, so what is shuffled
    is small and what reaches the driver has `count` rows at most. Counts are smoothed by one half.
    """
    keys = few_keys(stored(trusted.select("doc_id").distinct().withColumn("trusted", F.lit(True))))
    marked = docs.select("doc_id", "text").join(keys, "doc_id", "left").select(
        "text", F.coalesce("trusted", F.lit(False)).alias("trusted")
    )
    counted = (
        marked.mapInPandas(partial(_count, count=count), "bucket bigint, raw bigint, good bigint")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    )
    table = counted.toPandas()
    raw, good = np.full(count, 0.5), np.full(count, 0.5)
    at = table["bucket"].to_numpy(dtype=np.int64)
    raw[at] += table["raw"].to_numpy(dtype=float)
    good[at] += table["good"].to_numpy(dtype=float)
    if good.sum() == 0.5 * count:
        return np.zeros(count)  # nothing is trusted: no ratio to speak of
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def _score(texts: list[str], weights: np.ndarray, least_words: int, most_repeated: int) -> list[np.ndarray]:
    parts = []
    for some in groups(texts):
        n = len(some)
        split = [words_of(text) for text in some]
        words = _words()
        numbers = words.numbered(split)
        n_words = np.array([len(s) for s in split], dtype=np.int64)
        docs = np.repeat(np.arange(n), n_words)
        found, owner = buckets(words.hashes[numbers], docs, len(weights))
        ngrams = np.bincount(owner, minlength=n)
        ratio = np.bincount(owner, weights=weights[found], minlength=n) / np.maximum(ngrams, 1)
        repeat = np.bincount(docs, weights=repeated_words(numbers, docs), minlength=n).astype(np.int64)
        parts.append((
            n_words,
            np.array([len(text) - sum(map(text.count, BLANKS)) for text in some], dtype=np.int64),
            np.array([sum(map(text.count, SIGNS)) for text in some], dtype=np.int64),
            np.array(list(map(_lines, some)), dtype=np.int64),
            repeat,
            (n_words < least_words) | (100 * repeat > most_repeated * n_words),
            ratio,
        ))
    return [np.concatenate(column) for column in zip(*parts)]


def score_documents(docs: DataFrame, weights: np.ndarray, least_words: int = 10,
                    most_repeated: int = 20, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The counts, the base rules and the mean log-likelihood ratio of each document's n-grams."""
    return annotated(
        docs, lambda texts: _score(texts, weights, least_words, most_repeated), f"{BASE}, ratio double",
        keys,
    )


def verdict_limit(scored: DataFrame, labels: DataFrame, step: float = 1 / 1024) -> float | None:
    """The ratio that best parts documents labelled 1 from those labelled 0, or null without both.

    All labelled documents that pass the base rules are counted in bins of `step` (clipped to
    -32..32, so the table that reaches the driver has a bounded number of rows). Among the limits
    with the best sum of both rates, the middle of the lowest run of them is taken.
    """
    marks = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    place = F.floor(F.greatest(F.lit(-32.0), F.least(F.lit(32.0), F.col("ratio"))) / step)
    table = (
        scored.filter("not base_failed").join(marks, "doc_id").groupBy(place.alias("place"))
        .agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
             F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"))
        .toPandas().sort_values("place")
    )
    good, bad = table["good"].to_numpy(dtype=float), table["bad"].to_numpy(dtype=float)
    if not good.sum() or not bad.sum():
        return None
    places = table["place"].to_numpy(dtype=np.int64)
    # A limit below bin i rejects the bins before it.
    value = np.r_[0.0, np.cumsum(bad / bad.sum() - good / good.sum())]
    best = int(np.argmax(np.round(value, 9)))
    low = places[best - 1] + 1 if best else places[0]
    high = places[best] if best < len(places) else places[-1] + 1
    return float((low + high) / 2 * step)


def judged(docs: DataFrame, labels: DataFrame, count: int = 1 << 15, default_limit: float = -0.08,
           least_words: int = 10, most_repeated: int = 20, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keys` (`doc_id` is one of them), the counts, `base_failed`, `ratio` and `kept` of every document.

    The trusted target are the documents labelled quality 1, the raw corpus is all of `docs`. Words
    and pairs of neighbouring words are hashed into `count` buckets, whose counts over all documents
    give two multinomials; a document's ratio is the mean of its n-grams' log p(trusted) / p(raw).
    Kept are the documents that pass the base rules and whose ratio is not below the limit that
    parts the labelled documents best (`default_limit` where labels don't hold both classes).

    A null or empty text has no words, fails the base rules and has ratio 0. Rows with a null or
    repeated key are judged each by its own text; a key that is labelled twice takes the higher
    label. Empty tables give no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    trusted = labels.filter("quality = 1").select("doc_id")
    weights = ngram_weights(docs, trusted, count)
    scored = stored(score_documents(docs, weights, least_words, most_repeated, keys))
    limit = verdict_limit(scored, labels)
    limit = default_limit if limit is None else limit
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= limit))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns.

    Each row goes or stays by its own verdict, also if its key is null or shared. Rows are known by
    their numbers; the numbers that go are few beside the texts, so texts are moved only if those are
    too many to broadcast.
    """
    rows, row = numbered(docs)
    verdicts = judged(rows, labels, keys=("doc_id", row))
    gone = few_keys(stored(verdicts.filter("not kept").select(row)))
    return rows.join(gone, row, "left_anti").select(*(rows[name] for name in docs.columns))
