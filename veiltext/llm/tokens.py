"""Token ids of whole texts, as bytes, through the tokenizers library."""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

# A task has one core; the library's own threads would only take turns. Read when it is loaded.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

from veiltext.llm.batches import remembered  # noqa: E402

ID = np.dtype("<u4")
# Pieces of a text that its tokenizer never joins. Both kinds of tokenizer begin anew at white space
# and after a Latin letter that an ASCII sign or digit follows.
_LATIN = r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?![^\x00-@\[-`{-\x7f])"
# Where white space is dropped, pieces are what stands between it.
WORD = re.compile(_LATIN + r"|[^ \t-\r]+")
# Where it is kept, it belongs to the piece behind it.
PIECE = re.compile(r"[ \t-\r]*" + _LATIN + r"|[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
# Characters on whose being blank the libraries may differ; a text with one is encoded as a whole.
ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
# What may be encoded in one run with other pieces.
PLAIN = re.compile(r" ?[^\s]+")
RUN = 256
GROUP_CHARS = 1 << 20
KNOWN_PIECES = 700_000


def _bytes(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class Known(dict):
    """Ids by piece; a piece that is missing is noted, and has none yet."""

    def __init__(self) -> None:
        super().__init__()
        self.missed: set[str] = set()

    def __missing__(self, piece: str) -> None:
        self.missed.add(piece)


class Encoder:
    """Encodes texts to ids, each as a little-endian unsigned 32-bit integer.

    A piece of text always has the same ids, so the library encodes each piece once while a worker
    remembers it. `blanks` says whether the tokenizer keeps white space: if not, pieces are words.
    The memory of pieces is emptied when it is full, which changes no result.
    """

    def __init__(self, path: str, blanks: bool) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.blanks = blanks
        self.known = Known()
        # The library looks for added tokens before anything else, so a text with one is encoded whole.
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added), re.I) if added else None
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if blanks and len(line) == 1 else None

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [_bytes(x.ids) for x in found]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece.

        A call costs more than a short piece does. Where a line end has one id, pieces without one, with
        at most one blank before them, are encoded in runs with line ends between them, whose ids part
        them again: a line end begins a new piece, and so does what follows it.
        """
        found: dict[str, bytes] = {}
        if self.line is not None:
            plain = [piece for piece in pieces if PLAIN.fullmatch(piece)]
            runs = [plain[low:low + RUN] for low in range(0, len(plain), RUN)]
            for run, ids in zip(runs, self._library(["\n".join(run) for run in runs])):
                ends = np.flatnonzero(np.frombuffer(ids, dtype=ID) == self.line) * ID.itemsize
                if len(ends) == len(run) - 1:
                    parts = zip([0, *(ends + ID.itemsize).tolist()], [*ends.tolist(), len(ids)])
                    found.update(zip(run, (ids[a:b] for a, b in parts)))
        rest = [piece for piece in pieces if piece not in found]
        found.update(zip(rest, self._library(rest)))
        return [found[piece] for piece in pieces]

    def _whole(self, text: str) -> bool:
        return bool(self.blanks and ODD.search(text) or self.added and self.added.search(text))

    def _group(self, texts: list[str]) -> list[bytes]:
        """First look up every piece, noting those not known; then ask the library for these, and
        fill them in."""
        find = (PIECE if self.blanks else WORD).findall
        pieces = [[] if self._whole(text) else find(text) for text in texts]
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        known = self.known
        ids = [list(map(known.__getitem__, p)) for p in pieces]
        if known.missed:
            new = list(known.missed)
            known.missed.clear()
            known.update(zip(new, self._pieces(new)))
            ids = [
                [known[w] if i is None else i for i, w in zip(found, p)] if None in found else found
                for found, p in zip(ids, pieces)
            ]
        return [
            b"".join(found) if found else self._library([text])[0] for found, text in zip(ids, texts)
        ]

    def __call__(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; a null text has none. Works on about a million characters
        at a time, so memory holds one group or one text."""
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)


def encoder(path: str, blanks: bool) -> Encoder:
    """A worker's encoder, kept from task to task."""
    return remembered(path, lambda: Encoder(path, blanks))
