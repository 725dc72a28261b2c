"""Fingerprints of documents: invertible Bloom lookup tables of their paragraphs' digests.

A table has three rows of cells. Each paragraph's 64-bit digest falls into one cell of each row, which
keeps the number of its digests, their exclusive or, and that of their check values. Two versions'
tables subtract cell by cell: what both hold cancels out. A cell that is left with one digest gives it
away; taking it out of its other cells uncovers more, until all cells are empty and the differing
digests of both sides are known. If that gets stuck, larger tables of both texts are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veiltext.llm.batches import small_batches
from veiltext.session import stored

SENTENCE_END = (".", "!", "?")
WORDS = 8
HASHES = 3
# Cells of a row of the smallest table, the one that is the fingerprint.
CELLS = 8
GROUP_CHARS = 1 << 20
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_CHECK = np.uint64(0xD6E8FEB86659FD93)


def paragraphs(text: str) -> list[str]:
    """The paragraphs of a text: its lines that aren't blank, cut behind sentence ends and behind every
    eighth word since the last cut. White space around and between words doesn't count."""
    found: list[str] = []
    for line in text.split("\n"):
        held: list[str] = []
        for word in line.split():
            held.append(word)
            if len(held) == WORDS or word.endswith(SENTENCE_END):
                found.append(" ".join(held))
                held = []
        if held:
            found.append(" ".join(held))
    return found


def digests(text: str) -> np.ndarray:
    """A 64-bit digest for each paragraph, in ascending order; the second one of equal paragraphs
    has another, as has the third, so repeated paragraphs count as often as they occur."""
    seen: dict[str, int] = {}
    found = []
    for paragraph in paragraphs(text):
        nth = seen[paragraph] = seen.get(paragraph, -1) + 1
        found.append(xxhash.xxh3_64_intdigest(paragraph, nth))
    return np.unique(np.array(found, np.uint64))


def _mixed(keys: np.ndarray, factor: np.uint64) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(32))) * factor
    return keys ^ (keys >> np.uint64(29))


def places(keys: np.ndarray, cells: int) -> np.ndarray:
    """Where each digest falls, for each of the three rows of `cells` (a power of two) cells."""
    salt = np.uint64(cells * int(_CHECK) % (1 << 64))
    return np.stack([
        (_mixed(keys + salt, factor) >> np.uint64(20)).astype(np.int64) % cells + row * cells
        for row, factor in enumerate(_SPREAD)
    ])


def checks(keys: np.ndarray) -> np.ndarray:
    return _mixed(keys, _CHECK).astype(np.uint32)


class Tables:
    """The tables of several texts: an array each for counts, digests and checks, a line per text."""

    def __init__(self, texts: int, cells: int) -> None:
        self.cells = cells
        self.count = np.zeros((texts, HASHES * cells), np.int64)
        self.key = np.zeros((texts, HASHES * cells), np.uint64)
        self.check = np.zeros((texts, HASHES * cells), np.uint32)

    def add(self, text: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> None:
        """Put digest `keys[i]` into (sign 1) or take it out of (sign -1) the table of `text[i]`."""
        at = (places(keys, self.cells) + text * (HASHES * self.cells)).ravel()
        np.add.at(self.count.reshape(-1), at, np.tile(np.broadcast_to(sign, keys.shape), HASHES))
        np.bitwise_xor.at(self.key.reshape(-1), at, np.tile(keys, HASHES))
        np.bitwise_xor.at(self.check.reshape(-1), at, np.tile(checks(keys), HASHES))

    def minus(self, other: Tables) -> Tables:
        left = Tables(0, self.cells)
        left.count = self.count - other.count
        left.key, left.check = self.key ^ other.key, self.check ^ other.check
        return left

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """`text, key, sign` of the differing digests, and for each text whether they are all found.

        Empties the tables. A cell with one digest left has the count 1 or -1 and the digest's own
        check; all such cells of all texts are taken in one round.
        """
        found = []
        alive = np.arange(len(self.count))
        while len(alive):
            count, key = self.count[alive], self.key[alive]
            line, cell = np.nonzero((np.abs(count) == 1) & (checks(key) == self.check[alive]))
            if not len(line):
                break
            text, keys = alive[line], key[line, cell]
            # A digest may stand alone in two or three of its cells.
            _, first = np.unique(np.stack([text.astype(np.uint64), keys]), axis=1, return_index=True)
            text, keys, sign = text[first], keys[first], count[line, cell][first]
            self.add(text, keys, -sign)
            found.append((text, keys, sign))
            alive = np.unique(text)
        left = np.concatenate([self.count != 0, self.key != 0, self.check != 0], axis=1).any(axis=1)
        text, keys, sign = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        return text, keys.astype(np.uint64), sign, ~left


def tables(keys: Sequence[np.ndarray], cells: int) -> Tables:
    """The tables of texts, each given by its paragraphs' digests."""
    made = Tables(len(keys), cells)
    if keys:
        text = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        made.add(text, np.concatenate(keys), 1)
    return made


def differing(left: Sequence[np.ndarray], right: Sequence[np.ndarray], cells: int = CELLS) -> list[tuple]:
    """For each pair of texts the digests that only the left and only the right one has.

    Begins with the tables of `cells`; the pairs whose peeling gets stuck are compared again in tables
    four times as large, which deal digests out anew, until none is left. A table that can't hold as
    many digests as the numbers of paragraphs differ by is passed over.
    """
    found: list[tuple] = [()] * len(left)
    waiting = list(range(len(left)))
    while waiting:
        now = [i for i in waiting if abs(len(left[i]) - len(right[i])) <= 2 * cells]
        rest = [i for i in waiting if abs(len(left[i]) - len(right[i])) > 2 * cells]
        apart = tables([left[i] for i in now], cells).minus(tables([right[i] for i in now], cells))
        text, keys, sign, done = apart.peel()
        for side in (1, -1):
            mine = sign == side
            order = np.argsort(text[mine], kind="stable")
            cuts = np.searchsorted(text[mine][order], np.arange(len(now) + 1))
            for k, i in enumerate(now):
                if done[k]:
                    found[i] += (keys[mine][order][cuts[k]:cuts[k + 1]],)
        waiting = sorted(rest + [i for k, i in enumerate(now) if not done[k]])
        cells *= 4
    return found


def likeness(left: np.ndarray, right: np.ndarray, apart: tuple) -> float:
    """Shared paragraphs among all paragraphs of both texts, 0 to 1; two texts without any are alike."""
    shared = (len(left) + len(right) - len(apart[0]) - len(apart[1])) // 2
    both = len(left) + len(right) - shared
    return shared / both if both else 1.0


def written(keys: Sequence[np.ndarray], cells: int = CELLS) -> list[bytes]:
    """Each text's smallest table as bytes: all cells' digests, then their checks, then their counts,
    each little-endian; a count in as many groups of seven bits as it needs, the lowest first, each
    but the last with the eighth bit set."""
    made = tables(keys, cells)
    digest, check = made.key.astype("<u8"), made.check.astype("<u4")
    found = []
    for line, counts in enumerate(made.count.tolist()):
        out = bytearray(digest[line].tobytes() + check[line].tobytes())
        for count in counts:
            while count > 127:
                out.append(count & 127 | 128)
                count >>= 7
            out.append(count)
        found.append(bytes(out))
    return found


def edited(text: str, after: str, num: int = 1, den: int = 4) -> str:
    """The text whose last `num / den` code points are replaced by the first as many of `after`."""
    cut = len(text) * num // den
    return text[:len(text) - cut] + after[:cut]


RESULT = (
    "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double, n_paragraphs long, n_edited long, n_changed long"
)
_NAMES = [column.split()[0] for column in RESULT.split(", ")]


def compared(keys: pa.Array, texts: Sequence[str], afters: Sequence[str]) -> list[pa.Array]:
    """The result's columns for texts, each with the text that follows it."""
    changed = [edited(text, after) for text, after in zip(texts, afters)]
    known: dict[str, np.ndarray] = {}
    for text in chain(texts, afters, changed):
        if text not in known:
            known[text] = digests(text)
    own, new, later = ([known[t] for t in group] for group in (texts, changed, afters))
    apart = differing([*own, *own], [*new, *later])
    n = len(texts)
    return [
        keys,
        pa.array(list(map(len, texts)), pa.int64()),
        pa.array([hashlib.sha256(t.encode()).digest() for t in changed], pa.binary()),
        pa.array(written(own), pa.binary()),
        pa.array(written(new), pa.binary()),
        pa.array([likeness(a, b, d) for a, b, d in zip(own, new, apart[:n])], pa.float64()),
        pa.array([likeness(a, b, d) for a, b, d in zip(own, later, apart[n:])], pa.float64()),
        pa.array(list(map(len, own)), pa.int64()),
        pa.array(list(map(len, new)), pa.int64()),
        pa.array([len(d[0]) + len(d[1]) for d in apart[:n]], pa.int64()),
    ]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str], int]]:
    """Keys, texts and the partition's number, about a million characters at a time."""
    for batch in batches:
        texts = [text or "" for text in batch.column(1).to_pylist()]
        low, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= GROUP_CHARS or i == len(texts) - 1:
                yield batch.column(0).slice(low, i + 1 - low), texts[low:i + 1], batch.column(2)[i].as_py()
                low, size = i + 1, 0


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row but the partition's last, compared with the row behind it; then the partition's ends:
    its first text, and its last row with its text, which wait for another partition's."""
    last_key, last_text, part, opening = None, "", None, ""

    def out(columns: list[pa.Array], n: int, end: list) -> pa.RecordBatch:
        ends = [pa.array([value] * n, kind) for value, kind in zip(end, (pa.int32(), pa.string(), pa.string()))]
        return pa.RecordBatch.from_arrays([*columns, *ends], ["doc_id", *_NAMES, "part", "opening", "closing"])

    for keys, texts, number in _groups(batches):
        if part is None:
            part, opening = number, texts[0]
            following = texts
        else:
            keys = pa.concat_arrays([last_key, keys])
            following = [last_text, *texts]
        last_key, last_text = keys.slice(len(keys) - 1), following[-1]
        if len(following) > 1:
            n = len(following) - 1
            yield out(compared(keys.slice(0, n), following[:-1], following[1:]), n, [None, None, None])
    if part is not None:
        yield out([last_key, *(pa.nulls(1, c.type) for c in compared(last_key, [""], [""])[1:])],
                  1, [part, opening, last_text])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            text, after = (batch.column(c)[i].as_py() for c in (1, 2))
            found = compared(batch.column(0).slice(i, 1), [text], [after])
            yield pa.RecordBatch.from_arrays(found, ["doc_id", *_NAMES])


def fingerprints(docs: DataFrame) -> DataFrame:
    """`doc_id` and, of each text, of its edited text and of the next document:

    - `n_chars`: code points; `edited_sha256`: of the text whose last quarter is replaced by the next
      document's beginning; `fingerprint`, `edited_fingerprint`: number of paragraphs and the
      smallest table, `n:base64`,
    - `near_edited`, `near_next`: shared paragraphs among all paragraphs, found by subtracting tables,
    - `n_paragraphs`, and `n_changed`: paragraphs that only one of the text and the edited text has.

    The next document is that with the next key in ascending order, null keys first and rows of equal
    keys by a hash of their texts; after the last comes the first, so a single row is its own next. A
    null or blank text has no paragraphs; two such texts have the likeness 1. Equal texts have equal
    fingerprints, and the likeness 1. Further columns are left out; an empty table gives no rows.

    Rows are dealt by ranges of key, hash and row number, so neither one key nor one text fills a task,
    and each text moves once. A range's last row meets the first text of the next range: two texts a
    range, stored and joined on the range's number.
    """
    spark = docs.sparkSession
    small_batches(spark)
    by = [F.col("doc_id").asc_nulls_first(), F.col("_hash").asc(), F.col("_row").asc()]
    dealt = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
        .repartitionByRange(*by).sortWithinPartitions(*by)
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )
    key = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    walked = stored(dealt.mapInArrow(_walk, f"{key}, {RESULT}, part int, opening string, closing string"))
    ends = walked.filter("part is not null")
    # One number per range: bounded by the number of partitions.
    order = Window.orderBy("part")
    numbers = ends.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(
        Window.partitionBy())).alias("next"))
    after = ends.select(F.col("part").alias("next"), F.col("opening").alias("after"))
    met = ends.join(F.broadcast(numbers), "part").join(after, "next").select("doc_id", "closing", "after")
    closed = met.mapInArrow(_pairs, f"{key}, {RESULT}")

    def shown(table: str, count: str) -> Column:
        # Spark breaks base64 into lines.
        body = F.replace(F.base64(table), F.lit("\r\n"), F.lit(""))
        return F.concat(F.col(count).cast("string"), F.lit(":"), body).alias(table)

    return walked.filter("part is null").select("doc_id", *_NAMES).unionByName(closed).select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        shown("fingerprint", "n_paragraphs"), shown("edited_fingerprint", "n_edited"),
        "near_edited", "near_next", "n_paragraphs", "n_changed",
    )
