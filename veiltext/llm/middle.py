"""Fill-in-the-middle: a text's lines are cut twice and its middle is moved to the end, and back.

A batch of texts is one run of UTF-8 bytes. Each cut adds the difference between the shifts of the
parts on its two sides to a difference array over the bytes; the running sum of that array is every
byte's way from the input to the output, so one numpy scatter builds all outputs of the batch. The
way back finds the marks, builds the array from the parts' places in the output, and gathers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltext.llm.batches import small_batches

# Begin the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
# Bytes that are moved at once; each takes some 20 bytes more while it is.
WINDOW = 1 << 20
# The parts' order in the output: 0 prefix, 1 middle, 2 suffix; and the mark before each.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
_MARK_OF = (0, 2, 1)
_NEW = "n long, form string, prefix_chars long, middle_chars long, output string"


def checked_marks(marks: Sequence[str]) -> list[bytes]:
    """The marks' bytes. Three different ones that can't overlap each other or themselves, so that in
    an output whose text holds none, each is found exactly once."""
    found = [mark.encode() for mark in marks]
    for a in found:
        for b in found:
            tails = {a[i:] for i in range(1, len(a))}
            heads = {b[:i] for i in range(1, len(b))}
            if not a or tails & heads or (a in b and a is not b):
                raise ValueError(f"marks overlap: {a!r}, {b!r}")
    if len(found) != 3:
        raise ValueError("three marks: prefix, suffix, middle")
    return found


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, null as empty, and where each begins and the last one ends."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    begins = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    body = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return body[begins[0]:begins[-1]], begins - begins[0]


def text_column(body: np.ndarray, begins: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer(begins.astype(np.int64).tobytes())
    column = pa.LargeStringArray.from_buffers(len(begins) - 1, offsets, pa.py_buffer(body))
    return column.cast(pa.string())


def shifted(stops: np.ndarray, shifts: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """`(low, high, places)`, window by window, for `n` bytes: the place to which each goes.

    From `stops[i]` on (ascending), bytes move by `shifts[i]`; of equal stops the last one holds.
    """
    change = np.diff(shifts, prepend=0)
    reached = 0
    for low in range(0, n, WINDOW):
        high = min(n, low + WINDOW)
        first, last = np.searchsorted(stops, (low, high))
        difference = np.zeros(high - low, np.int64)
        np.add.at(difference, stops[first:last] - low, change[first:last])
        difference[0] += reached
        moved = np.cumsum(difference)
        reached = moved[-1]
        moved += np.arange(low, high)
        yield low, high, moved


def line_cuts(body: np.ndarray, begins: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
    """`n, first, second`: each text's lines, and the byte at which its line number `h % (n + 1)`
    begins, for both draws in ascending order. Line n begins at the text's end."""
    start, stop = begins[:-1], begins[1:]
    ends = np.flatnonzero(body == 10)
    before = np.searchsorted(ends, start)
    whole = np.searchsorted(ends, stop) - before
    open_end = (stop > start) & (body[np.maximum(stop - 1, 0)] != 10) if len(body) else stop > start
    n = whole + open_end

    def place(k: np.ndarray) -> np.ndarray:
        if not len(ends):
            return np.where(k == 0, start, stop)
        line_end = ends[np.clip(before + k - 1, 0, len(ends) - 1)] + 1
        return np.where(k == 0, start, np.where(k <= whole, line_end, stop))

    one, other = low % (n + 1), high % (n + 1)
    return n, place(np.minimum(one, other)), place(np.maximum(one, other))


def _arranged(forms: Sequence[str], lengths: np.ndarray, marks: list[bytes]) -> tuple:
    """`begins, marked, parts`: where outputs begin, where each of the three marks stands (-1 in a
    plain one) and where prefix, middle and suffix go. `lengths` has a row for each of the three."""
    sizes = np.array([len(mark) for mark in marks])
    plain = np.array([form not in ORDERS for form in forms], bool)
    total = lengths.sum(axis=0) + np.where(plain, 0, sizes.sum())
    begins = np.concatenate([[0], np.cumsum(total)])
    marked = np.full((3, len(forms)), -1)
    parts = np.zeros((3, len(forms)), np.int64)
    parts[:, plain] = begins[:-1][plain]
    parts[1:, plain] += lengths[0, plain]
    parts[2, plain] += lengths[1, plain]
    for form, order in ORDERS.items():
        rows = np.array([f == form for f in forms], bool)
        at = begins[:-1][rows]
        for part in order:
            mark = _MARK_OF[part]
            marked[mark, rows] = at
            parts[part, rows] = at + sizes[mark]
            at = at + sizes[mark] + lengths[part, rows]
    return begins, marked, parts


def scattered(body: np.ndarray, begins: np.ndarray, first: np.ndarray, second: np.ndarray,
              forms: Sequence[str], marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The outputs' bytes and where each begins, for texts cut at the bytes `first` and `second`."""
    stops = np.stack([begins[:-1], first, second])
    lengths = np.stack([first - begins[:-1], second - first, begins[1:] - second])
    places, marked, parts = _arranged(forms, lengths, marks)
    out = np.empty(places[-1], np.uint8)
    # Prefix, middle and suffix of each text in turn.
    for low, high, to in shifted(stops.T.ravel(), (parts - stops).T.ravel(), len(body)):
        out[to] = body[low:high]
    for mark, at in zip(marks, marked):
        at = at[at >= 0]
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    return out, places


def gathered(body: np.ndarray, begins: np.ndarray, forms: Sequence[str], marks: list[bytes]) -> tuple:
    """The texts' bytes and where each begins, from the outputs' bytes and their forms alone."""
    held = body.tobytes()
    sizes = [len(mark) for mark in marks]
    lengths = np.zeros((3, len(forms)), np.int64)
    stops = np.zeros((3, len(forms)), np.int64)
    for i, form in enumerate(forms):
        low, high = int(begins[i]), int(begins[i + 1])
        if form not in ORDERS:
            lengths[0, i], stops[:, i] = high - low, high
            stops[0, i] = low
            continue
        order = ORDERS[form]
        at = [held.find(marks[_MARK_OF[part]], low, high) for part in order]
        if min(at) < 0:
            raise ValueError(f"an output of form {form} has no mark")
        for k, part in enumerate(order):
            stops[part, i] = at[k] + sizes[_MARK_OF[part]]
            lengths[part, i] = (at[k + 1] if k < 2 else high) - stops[part, i]
    places = np.concatenate([[0], np.cumsum(lengths.sum(axis=0))])
    parts = places[:-1] + np.concatenate([np.zeros((1, len(forms)), np.int64), np.cumsum(lengths, axis=0)[:2]])
    text = np.empty(places[-1], np.uint8)
    for low, high, source in shifted(parts.T.ravel(), (stops - parts).T.ravel(), len(text)):
        text[low:high] = body[source]
    return text, places


def _transform(batches: Iterator[pa.RecordBatch], keys: list[str], marks: list[bytes]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        low, high, form, text = batch.columns[len(keys):]
        forms = form.to_pylist()
        body, begins = text_bytes(text)
        n, first, second = line_cuts(body, begins, low.to_numpy(), high.to_numpy())
        plain = np.array([f not in ORDERS for f in forms], bool)
        first, second = np.where(plain, begins[1:], first), np.where(plain, begins[1:], second)
        out, places = scattered(body, begins, first, second, forms, marks)
        leads = (body & 0xC0) != 0x80
        chars = [
            pa.array([None if p else np.count_nonzero(leads[a:b]) for p, a, b in zip(plain, start, stop)], pa.int64())
            for start, stop in ((begins[:-1], first), (first, second))
        ]
        found = [pa.array(n.astype(np.int64)), form, *chars, text_column(out, places)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:len(keys)], *found],
            [*keys, "n", "form", "prefix_chars", "middle_chars", "output"],
        )


def _restore(batches: Iterator[pa.RecordBatch], marks: list[bytes], form: int, output: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            body, begins = text_bytes(batch.column(output))
            text, places = gathered(body, begins, batch.column(form).to_pylist(), marks)
            columns = [*batch.columns, text_column(text, places)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "restored"])


def _types(frame: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in columns)


def drawn(seed: int, key: Column) -> list[Column]:
    """Four numbers below 2**32 from a row's key: the first groups of eight hexadecimal digits of the
    SHA-256 of `seed:key`. A null key counts as no digits."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substr(digits, F.lit(1 + 8 * k), F.lit(8)), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50,
                marks: Sequence[str] = MARKS) -> DataFrame:
    """`doc_id, n, form, prefix_chars, middle_chars, output` of each document, where it stands.

    The prefix ends before one line drawn from the key, the middle before another; `n` is the number
    of lines, each with its line end. `rate` of 100 documents are rearranged, the others are `plain`;
    `spm` of 100 of those have the suffix first. A text that is null, empty or holds a mark is plain:
    its output is the text (null: empty) and its two counts of code points are null. Rows with equal
    keys and texts have equal results; further columns are left out; an empty table gives no rows.
    Memory holds one batch of texts (4 MB, or one text) and its outputs.
    """
    held = checked_marks(marks)
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    h = drawn(seed, F.col("doc_id"))
    plain = (text == "") | (h[2] % 100 >= rate)
    for mark in marks:
        plain = plain | F.contains(text, F.lit(mark))
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = docs.select("doc_id", h[0].alias("low"), h[1].alias("high"), form.alias("form"), text.alias("text"))
    step = partial(_transform, keys=["doc_id"], marks=held)
    return rows.mapInArrow(step, f"{_types(docs, ['doc_id'])}, {_NEW}")


def restored(made: DataFrame, marks: Sequence[str] = MARKS) -> DataFrame:
    """`made` with `restored`: the texts rebuilt from `output` and `form` alone.

    A null output counts as empty; a form that isn't psm or spm is plain. All columns are kept (one
    named `restored` is not allowed). An output without its marks ends the job with an error.
    """
    if "restored" in made.columns:
        raise ValueError("a column named restored is there already")
    small_batches(made.sparkSession)
    step = partial(_restore, marks=checked_marks(marks), form=made.columns.index("form"),
                   output=made.columns.index("output"))
    return made.mapInArrow(step, f"{_types(made, made.columns)}, restored string")
