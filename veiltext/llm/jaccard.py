"""Documents whose sets of word shingles overlap: a T-occurrence search over inverted lists."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veiltext.llm.batches import few_keys, forget, numbered, remembered, small_batches
from veiltext.llm.components import components
from veiltext.session import stored

GROUP_CHARS = 1 << 20
SHORT_SEARCH = 64
KNOWN_WORDS = 1 << 17
# Shingles with a hash in the first part of the range come first in the order of all shingles. Their
# lists are counted over all documents. The part is a little more than the share of a set that a
# search looks at, so that it seldom has to look at shingles that aren't counted.
MARGIN = 1.2
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Rule:
    """The similarity `num / den` of sets, in integers, and what follows from it.

    Two sets of sizes a and b must share `need(a, b)` members. Under one order of all shingles, they
    then share one among the first `probe(a)` of the one and the first `probe(b)` of the other.
    """

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    @property
    def counted(self) -> float:
        return MARGIN * (1 - self.num / self.den)

    def need(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.den + self.num))

    def probe(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1


class WordHashes:
    """A 64-bit hash for each word, looked up by number; emptied between groups when full."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.hashes = np.zeros(1 << 12, dtype=np.uint64)

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        if len(self.numbers) > KNOWN_WORDS:
            self.numbers.clear()
        known = self.numbers
        for word in set().union(*texts) - known.keys():
            no = known[word] = len(known)
            if no >= len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.hashes[no] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        total = sum(map(len, texts))
        numbers = np.fromiter((known[w] for text in texts for w in text), dtype=np.int64, count=total)
        return self.hashes[numbers]


def _word_hashes() -> WordHashes:
    return remembered("shingle words", WordHashes)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words; runs of different sizes differ."""
    n = len(hashes) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = _mixed(out + hashes[k:k + n])
    return out


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending. Only A-Z is lower-cased; words part at
    ASCII blanks; a text with fewer words than `size` is one shingle, one without words has none."""
    split = [text.encode("utf-8", "surrogatepass").lower().split() for text in texts]
    hashes = _word_hashes().of(split)
    ends = np.cumsum([len(s) for s in split])
    rolled = _rolled(hashes, size) if len(hashes) >= size else np.zeros(0, dtype=np.uint64)
    sets = []
    for end, words in zip(ends.tolist(), split):
        n = len(words)
        if n >= size:
            sets.append(np.unique(rolled[end - n:end - size + 1]))
        else:
            sets.append(_rolled(hashes[end - n:end], n) if n else np.zeros(0, dtype=np.uint64))
    return sets


def _groups(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Where each run of about a million characters begins in the batch, and its texts' sets."""
    column = batch.column(1)
    held, chars, at = [], 0, 0
    for i in range(batch.num_rows):
        held.append(column[i].as_py() or "")
        chars += len(held[-1])
        if chars >= GROUP_CHARS or i == batch.num_rows - 1:
            yield at, shingle_sets(held, size)
            at, held, chars = i + 1, [], 0


def _class(found: np.ndarray) -> int | None:
    """A number for a set: equal sets have equal ones."""
    if not len(found):
        return None
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


# A set's sketch: the parity of its members in each of 64 * SKETCH cells. Two sets differ in at
# least as many members as their sketches differ in bits, which bounds what they can share.
SKETCH = 8
BITS = [f"b{i}" for i in range(SKETCH)]
HEADS = "doc_id bigint, n bigint, class bigint, counted int, head array<bigint>, " + ", ".join(
    f"{name} bigint" for name in BITS
)
_HEAD = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("counted", pa.int32()),
    ("head", pa.list_(pa.int64())), *((name, pa.int64()) for name in BITS),
])
SETS = "class bigint, shingles binary"
_SET = pa.schema([("class", pa.int64()), ("shingles", pa.binary())])


def sketch(found: np.ndarray) -> np.ndarray:
    cells = (found >> np.uint64(7)) % np.uint64(64 * SKETCH)
    odd = np.bincount(cells.astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _heads(batches: Iterator[pa.RecordBatch], size: int, rule: Rule) -> Iterator[pa.RecordBatch]:
    limit = np.uint64(min(int(rule.counted * 2**64), 2**64 - 1))
    for batch in batches:
        for at, sets in _groups(batch, size):
            counted = [int(np.searchsorted(s, limit)) for s in sets]
            kept = [s[:max(c, rule.probe(len(s)) if len(s) else 0)] for s, c in zip(sets, counted)]
            offsets = np.cumsum([0, *map(len, kept)])
            flat = np.concatenate(kept).view(np.int64) if kept else np.zeros(0, dtype=np.int64)
            bits = np.array([sketch(s) for s in sets], dtype=np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(at, len(sets)).cast(pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_class, sets), pa.int64()),
                pa.array(counted, pa.int32()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64())),
                *(pa.array(bits[:, i]) for i in range(SKETCH)),
            ], schema=_HEAD)


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, sets in _groups(batch, size):
            yield pa.RecordBatch.from_arrays([
                pa.array(map(_class, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()),
            ], schema=_SET)


def divide_skip(query: np.ndarray, others: list[np.ndarray], rule: Rule, mu: float = 0.01) -> list[tuple[int, int]]:
    """Which of the other sets share as many members with the query as the rule needs, and how many.

    Each member of the query has an inverted list of the others that hold it. The L longest lists
    are set aside; the short ones are merged with a heap, which counts how often each set occurs.
    A set that the short lists leave more than L short of its need can't reach it. The rest are
    looked up in the long lists by binary search. L follows from the least need T and the longest
    list's length M: T / (mu * log2(M) + 1).
    """
    needs = [rule.need(len(query), len(o)) for o in others]
    sizes = [len(o) for o in others]
    members = np.concatenate(others)
    owner = np.repeat(np.arange(len(others)), sizes)
    where = np.minimum(np.searchsorted(query, members), len(query) - 1)
    shared = query[where] == members
    where, owner = where[shared], owner[shared]
    order = np.lexsort((owner, where))
    owner = owner[order]
    lengths = np.bincount(where, minlength=len(query))
    ends = np.cumsum(lengths)
    lists = [owner[e - n:e] for e, n in zip(ends.tolist(), lengths.tolist()) if n]
    if not lists:
        return []
    lists.sort(key=len)
    aside = min(int(min(needs) / (mu * math.log2(max(len(lists[-1]), 2)) + 1)), min(needs) - 1, len(lists))
    short, long = lists[:len(lists) - aside], lists[len(lists) - aside:]
    found = []
    for no, run in groupby(heapq.merge(*(s.tolist() for s in short))):
        count = sum(1 for _ in run)
        if count < needs[no] - len(long):
            continue
        left = len(long)
        for one in reversed(long):
            at = int(np.searchsorted(one, no))
            count += at < len(one) and one[at] == no
            left -= 1
            if count + left < needs[no]:
                break
        if count >= needs[no]:
            found.append((no, count))
    return found


def _verified(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """The pairs of each batch that are similar; pairs with the same first set are searched together."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("likeness", pa.float64())])
    forget()
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        left, right = batch.column(2), batch.column(3)
        order = sorted(range(batch.num_rows), key=a.__getitem__)
        pairs = []
        for key, rows in groupby(order, key=a.__getitem__):
            rows = list(rows)
            query = np.frombuffer(left[rows[0]].as_py(), dtype=np.uint64)
            for at in range(0, len(rows), 256):
                some = rows[at:at + 256]
                others = [np.frombuffer(right[i].as_py(), dtype=np.uint64) for i in some]
                pairs += [
                    (key, b[some[k]], shared / (len(query) + len(others[k]) - shared))
                    for k, shared in divide_skip(query, others, rule)
                ]
        if pairs:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*pairs))), schema=schema)


def short_lists(heads: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The inverted lists a search looks at: `token, class, n, left, own`.

    All shingles have one order: counted ones by the number of documents that hold them, then the
    rest by hash. A class looks at its first `probe(n)` shingles; `left` counts its shingles from
    this one on, `own` those that no other document has. The latter come first and lead nowhere, so
    they are left out, and a document with enough of them has no candidates at all. Long lists (of
    passages that many documents share) come last, so only documents made of little else look at them.
    """
    tokens = heads.filter("n > 0").select("class", "counted", F.posexplode("head").alias("pos", "token"))
    known = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("docs")).filter("docs > 1")
    repeated = (
        tokens.join(known, "token")
        .select("class", "token", "docs", "pos", (F.col("pos") < F.col("counted")).alias("early"))
        .distinct()
    )
    by_class = Window.partitionBy("class")
    order = by_class.orderBy(F.desc("early"), F.when(F.col("early"), F.col("docs")).otherwise(0), "token")
    ranked = repeated.join(classes.select("class", "n", "counted"), "class").select(
        "class", "token", "n", "early", "pos",
        (F.row_number().over(order) - 1).alias("_at"),
        (F.col("counted") - F.count(F.when(F.col("early"), 1)).over(by_class)).alias("own"),
    )
    rank = F.when(F.col("early"), F.col("own") + F.col("_at")).otherwise(F.col("pos"))
    n = F.col("n")
    # Division is in doubles: one place more costs a candidate, one less could cost a link.
    probe = n - F.ceil(n * rule.num / rule.den) + 1
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= probe).select(
        "token", "class", "n", (n - F.col("rank")).alias("left"), "own"
    )


def links(docs: DataFrame, heads: DataFrame, classes: DataFrame, size: int, rule: Rule) -> DataFrame:
    """Similar pairs of classes, `a, b`: enough to connect all that are linked directly or by others.

    Candidates meet in the inverted lists. First each list's hub, the member with the fewest
    shingles of its own, is compared with the others; then the others that were not like the hub are
    compared with the set most like it, which in a group of copies with a few edits each is the text
    that they all come from. Both are no more pairs than the lists have rows, and they join most
    groups. What is connected by then needs no comparing; lists whose members are all connected are
    done. In the others, each member outside the list's largest connected part is compared with every
    member of another part that it could still share enough with, by what both have left and by their
    sketches. So every pair that may connect two parts is looked at, and the pairs within a large
    group are not. Nothing is capped.
    """
    lists = stored(short_lists(heads, classes, rule))
    shared = lists.groupBy("token").agg(
        F.min(F.struct("own", "n", "class")).alias("r"), F.count(F.lit(1)).alias("m")
    ).filter("m > 1")
    close = F.least("n", "r.n") * rule.den >= F.greatest("n", "r.n") * rule.num
    star = stored(
        lists.join(shared, "token").filter(F.col("class") != F.col("r.class")).filter(close)
        .select(F.col("r.class").alias("a"), F.col("class").alias("b")).distinct()
    )
    some = lists.join(shared.select("token"), "token", "left_semi").select("class").distinct()
    wanted = few_keys(stored(classes.join(some, "class").select(F.col("first").alias("doc_id")).distinct()))
    sets = stored(
        docs.select("doc_id", "text")
        .join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
        .mapInArrow(partial(_sets, size=size), SETS).filter("class is not null")
    )

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("_a"))
        right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("_b"))
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "_a", "_b")
        return stored(both.mapInArrow(partial(_verified, rule=rule), "a bigint, b bigint, likeness double"))

    near = verified(star)
    middle = near.groupBy("a").agg(F.max(F.struct("likeness", "b")).alias("m")).select(
        "a", F.col("m.b").alias("middle")
    )
    again = star.join(near, ["a", "b"], "left_anti").join(middle, "a").select(
        F.col("middle").alias("a"), "b"
    )
    found = near.unionByName(verified(stored(again.distinct())))
    part = components(found)
    marked = stored(
        lists.join(shared.select("token"), "token", "left_semi")
        .join(part, lists["class"] == part["node"], "left")
        .select("token", "class", "n", "left", F.coalesce("component", "class").alias("part"))
    )
    sizes = marked.groupBy("token", "part").agg(F.count(F.lit(1)).alias("m"))
    main = (
        sizes.groupBy("token").agg(F.max(F.struct("m", "part")).alias("most"), F.count(F.lit(1)).alias("parts"))
        .filter("parts > 1").select("token", F.col("most.part").alias("main"))
    )
    still_open = stored(marked.join(main, "token"))
    # A pair shares many shingles; it is made at the first of them in the order alone, which is found
    # where both searches are short. (A long one would carry its shingles with each of them.)
    in_order = F.sort_array(F.collect_list(F.struct((-F.col("left")).alias("place"), "token")))
    searches = still_open.groupBy("class").agg(in_order.alias("s")).select(
        "class", F.when(F.size("s") <= SHORT_SEARCH, F.col("s.token")).alias("search")
    )
    open_lists = stored(still_open.join(searches, "class").join(classes.select("class", *BITS), "class"))
    x = open_lists.filter("part <> main").alias("x")
    y = open_lists.alias("y")
    # At the first shingle that two sets share, what either has left bounds what they share.
    differ = sum((F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in BITS), F.lit(0))
    both = F.col("x.n") + F.col("y.n")
    most = F.least("x.left", "y.left", (both - differ) / 2)
    able = most * (rule.den + rule.num) >= both * rule.num
    shared_first = F.get(F.array_intersect("x.search", "y.search"), F.lit(0))
    first_here = F.coalesce(shared_first == F.col("x.token"), F.lit(True))
    pairs = (
        x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.part") != F.col("y.part")) & able & first_here)
        .select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b"))
        .distinct()
    )
    return found.unionByName(verified(stored(pairs))).select("a", "b")


def jaccard_groups(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """`doc_id, n_shingles, class, component_id` of every row.

    A document's set holds its distinct `size`-word shingles; two documents are linked when
    den * intersection >= num * union; `component_id` is the smallest key reachable by links.
    Documents with equal sets are one class (a 64-bit number of the set) and searched once, so
    thousands of copies cost no more than one. Texts are read whole, and no list, group or partner
    is capped.

    A null text, or one without words, has an empty set, no class, and is its own component. Rows
    with a null key are linked like others, but lend no number; a component without any has a null
    one. Rows with the same key and different texts are sets of their own. An empty table gives no
    rows; other columns are ignored.
    """
    rule = Rule(num, den)
    small_batches(docs.sparkSession)
    heads = stored(docs.select("doc_id", "text").mapInArrow(partial(_heads, size=size, rule=rule), HEADS))
    classes = stored(
        heads.filter("n > 0").groupBy("class")
        .agg(F.min("doc_id").alias("first"), F.min("n").alias("n"), F.min("counted").alias("counted"),
             *(F.min(name).alias(name) for name in BITS))
    )
    part = components(links(docs, heads, classes, size, rule))
    joined = classes.join(part, classes["class"] == part["node"], "left").select(
        "class", "first", F.coalesce("component", "class").alias("part")
    )
    lowest = joined.groupBy("part").agg(F.min("first").alias("component_id"))
    named = stored(joined.join(lowest, "part").select("class", "component_id"))
    return heads.select("doc_id", "n", "class").join(named, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "class",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of each group of `docs`, with all its columns: that with the smallest key.

    Groups are made of rows, whatever their keys: a null key comes after all others, and of rows
    that share their group's smallest key one stays. Rows without words are groups of their own.
    Rows are known by their numbers; the numbers that go are few beside the texts, so texts are
    moved only if those are too many to broadcast.
    """
    rows, row = numbered(docs)
    groups = jaccard_groups(rows.select(F.col(row).alias("doc_id"), "text"), size, num, den).select(
        F.col("doc_id").alias(row), "component_id"
    )
    found = stored(groups.join(rows.select(row, F.col("doc_id").alias("_id")), row))
    first = F.min(F.struct(F.col("_id").isNull(), "_id", row)).alias("first")
    stays = found.groupBy("component_id").agg(first).select(F.col(f"first.{row}").alias(row))
    gone = few_keys(stored(found.select(row).join(stays, row, "left_anti")))
    return rows.join(gone, row, "left_anti").select(*(rows[name] for name in docs.columns))
