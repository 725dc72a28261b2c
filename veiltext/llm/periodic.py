"""Runs of words that repeat with a period, found by seeds on diagonals and extended both ways.

A run with period q is a stretch in which words q apart are equal: on the diagonal of lag q, a row of
matches. A run of `length >= max(least, times * q)` has `length - q` of them, so a k-gram of that many
words at its start occurs again q words later. Lags are taken in bands; in a band, k is the smallest
such number, so every run is hit, and no lag exceeds k. Then the next occurrence of a seed inside a
run is the one a period later, because a k-gram no shorter than the smallest period occurs at no other
distance. So each k-gram is paired with its next occurrence alone, and a text that repeats one word
has as many pairs as words. For each lag a table holds how far it is covered; a pair inside is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veiltext.llm.batches import small_batches

Run = tuple[int, int, int]
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_BOUND = 1 << 62


def bands(n: int, least: int, times: int) -> Iterator[tuple[int, int]]:
    """`(low, k)`: k-grams find the runs of periods low to k; up to the longest period n words allow."""
    low = 1
    while low * times <= n:
        k = min(max(least - q, (times - 1) * q) for q in range(low, max(low, least) + 1))
        yield low, k
        low = k + 1


def _renumbered(names: np.ndarray) -> tuple[np.ndarray, int]:
    kinds, names = np.unique(names, return_inverse=True)
    return names.astype(np.int64), len(kinds)


class Grams:
    """For growing k, a number for each k-gram of a text; equal k-grams, and no others, share one."""

    def __init__(self, words: np.ndarray, kinds: int) -> None:
        self.names, self.bound, self.k = words, max(kinds, 1), 1
        self.words, self.kinds = words, max(kinds, 1)

    def grow(self, k: int) -> np.ndarray:
        n = len(self.words)
        if k > n:
            return self.names[:0]
        while self.k < k:
            if self.bound * self.kinds < _BOUND and k - self.k < 5:
                # One word more.
                self.names = self.names[:n - self.k] * self.kinds + self.words[self.k:]
                self.bound *= self.kinds
                self.k += 1
                continue
            if self.bound * self.bound >= _BOUND:
                self.names, self.bound = _renumbered(self.names)
            wide = min(2 * self.k, k)
            count = n - wide + 1
            self.names = self.names[:count] * self.bound + self.names[wide - self.k:][:count]
            self.bound *= self.bound
            self.k = wide
        return self.names


def _reach(words: np.ndarray, at: int, lag: int) -> int:
    """The first place from `at` on whose word differs from the one `lag` later, or has none."""
    n, step = len(words) - lag, 16
    while at < n:
        stop = min(n, at + step)
        same = words[at:stop] == words[at + lag:stop + lag]
        if not same.all():
            return at + int(same.argmin())
        at, step = stop, 2 * step
    return n


def _back(words: np.ndarray, at: int, lag: int) -> int:
    """The first place of the row of matches that ends before `at`."""
    step = 16
    while at > 0:
        start = max(0, at - step)
        same = words[start:at] == words[start + lag:at + lag]
        if not same.all():
            return at - int(same[::-1].argmin())
        at, step = start, 2 * step
    return 0


def word_numbers(words: list) -> tuple[np.ndarray, int]:
    """Equal words, and no others, share a number."""
    numbers: dict = {}
    found = [numbers.setdefault(word, len(numbers)) for word in words]
    return np.array(found, np.int64), len(numbers)


def runs(words: list, least: int = 6, times: int = 4) -> list[Run]:
    """`(start, length, period)` of each run, by start, then period."""
    if len(words) < max(least, times):
        return []
    numbers, kinds = word_numbers(words)
    grams = Grams(numbers, kinds)
    found: list[Run] = []
    covered: dict[int, int] = {}
    for low, k in bands(len(words), least, times):
        names = grams.grow(k)
        order = np.argsort(names, kind="stable")
        kind = names[order]
        same = kind[1:] == kind[:-1]
        if not same.any():
            # No k-gram occurs twice, so no longer one does.
            break
        left, lag = order[:-1][same], np.diff(order)[same]
        near = (lag >= low) & (lag <= k)
        left, lag = left[near], lag[near]
        by_lag = np.lexsort((left, lag))
        left, lag = left[by_lag], lag[by_lag]
        # A seed right behind another one of its lag lies in what that one is extended to.
        first = np.ones(len(left), bool)
        first[1:] = (lag[1:] != lag[:-1]) | (left[1:] != left[:-1] + 1)
        for i, q in zip(left[first].tolist(), lag[first].tolist()):
            if i < covered.get(q, 0):
                continue
            start, stop = _back(numbers, i, q), _reach(numbers, i + k, q)
            covered[q] = stop
            length = stop - start + q
            if length >= max(least, times * q):
                found.append((start, length, q))
    return sorted(found, key=lambda run: (run[0], run[2]))


def kept(words: list, found: list[Run]) -> list:
    """The words that no run contains after its first period."""
    if not found:
        return words
    change = [0] * (len(words) + 1)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return [word for word, depth in zip(words, accumulate(change)) if not depth]


def _step(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, found, short = [], [], []
        for text in batch.column(1).cast(pa.binary()):
            # Without arguments, bytes are split at the space and at \x09 to \x0D alone.
            words = (text.as_py() or b"").split()
            each = runs(words, least, times)
            counts.append(len(words))
            found.append(each)
            short.append(b" ".join(kept(words, each)).decode())
        flat = np.array([run for each in found for run in each], np.int64).reshape(-1, 3)
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        listed = pa.ListArray.from_arrays(
            ends, pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(_RUN))
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), listed, pa.array(short, pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """`doc_id, n_words, runs, collapsed` of each document, where it stands.

    `runs` has `start, length, period` of every longest stretch of words with a smallest period q and
    `length >= max(least, times * q)`, by start, then period; words are what stands between ASCII
    blanks. `collapsed` is the text without the words that a run contains after its first period,
    joined by single spaces. A null or blank text has no words, no runs and an empty `collapsed`. Keys
    may be null or repeated; each row is decided by itself. Further columns are left out; an empty
    table gives no rows. A text takes time in proportion to its words times the logarithm of their
    number, squared at most, whatever it repeats.
    """
    if times < 3 or least < 1:
        raise ValueError("a run has its period three times at least")
    small_batches(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        partial(_step, least=least, times=times),
        f"doc_id {key}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string",
    )
