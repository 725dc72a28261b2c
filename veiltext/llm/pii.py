"""Personal data found from anchors: an automaton finds cues, local parsers find the boundaries."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from veiltext.llm.batches import annotated, forget, small_batches

Span = tuple[str, int, int]
KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE_KINDS = KINDS[:4]
SCHEMES = ("http", "https", "ftp", "sftp", "ws", "wss", "rtsp")
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")
SECRET_CUES = ("password", "passwd", "token", "secret", "api_key", "apikey")
KEY_CUES = ("AKIA", "ASIA")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number that starts inside a run of digits can't match if the run as a whole didn't.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+")
_HOST = re.compile(r"(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)(?::[0-9]{1,5})?(?=[/?#]|$)")
_BETWEEN = re.compile(r"[ \t]*(?:(?:no|nr|number|id)\b\.?[ \t]*)?[:=#]?[ \t]*", re.I)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NUMBER = re.compile(r"[0-9]{8,18}(?![A-Za-z0-9])")
_VALUE = re.compile(r"[ \t]*[:=][ \t]*([\"']?)([A-Za-z0-9_+/.~-]{8,})\1")
_KEY = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
_WORDISH = re.compile(r"[A-Za-z0-9_]")
CLOSING = ".,;:!?'"


def luhn(digits: str) -> bool:
    """Whether the digits' Luhn sum is a multiple of ten."""
    doubled = "0246813579"
    total = sum(map(int, digits[-1::-2])) + sum(int(doubled[int(d)]) for d in digits[-2::-2])
    return total % 10 == 0


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """The cues, each in lower case, upper case and with a capital, with what they announce."""
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", "@"))
    for scheme in SCHEMES:
        for form in {scheme, scheme.upper(), scheme.capitalize()}:
            found.add_word(f"{form}://", ("url", f"{form}://"))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, (kind, form))
    for cue in KEY_CUES:
        found.add_word(cue, ("key", cue))
    found.make_automaton()
    return found


class Run:
    """A stretch of address characters, of which ever later ends are looked at.

    Closing punctuation at its end goes, and closing brackets while there are more of them than opening
    ones. `ends[k]` is where the run ends when k brackets have gone.
    """

    def __init__(self, text: str, start: int, stop: int) -> None:
        self.text, self.start, self.stop = text, start, stop
        self.open, self.closed = text.count("(", start, stop), text.count(")", start, stop)
        self.ends = [self._without_marks(stop)]
        while self.ends[-1] > start and text[self.ends[-1] - 1] == ")":
            self.ends.append(self._without_marks(self.ends[-1] - 1))

    def _without_marks(self, stop: int) -> int:
        while stop > self.start and self.text[stop - 1] in CLOSING:
            stop -= 1
        return stop

    def start_at(self, start: int) -> None:
        self.open -= self.text.count("(", self.start, start)
        self.closed -= self.text.count(")", self.start, start)
        self.start = start

    def trimmed(self) -> int:
        return self.ends[min(max(0, self.closed - self.open), len(self.ends) - 1)]


class Anchored:
    """What grows out of one text's anchors, left to right, each kind without overlaps."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.end = dict.fromkeys(KINDS, 0)
        self.spans: list[Span] = []
        self.run = Run("", 0, 0)

    def _add(self, kind: str, start: int, end: int) -> None:
        if start >= self.end[kind]:
            self.spans.append((kind, start, end))
            self.end[kind] = end

    def _starts_word(self, at: int) -> bool:
        return at == 0 or not _WORDISH.match(self.text[at - 1])

    def email(self, at: int, cue: str) -> None:
        """To the left while characters can be of a local part, to the right a domain with a dot."""
        text, low = self.text, self.end["email"]
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            self._add("email", start, domain.end())

    def _run(self, body: int) -> Run | None:
        """The run of address characters from `body` on. Many schemes may stand in one run: it is
        searched once, and its brackets are counted on from the last scheme."""
        if body >= self.run.stop:
            found = _URL.match(self.text, body)
            if not found:
                return None
            self.run = Run(self.text, body, found.end())
        else:
            self.run.start_at(body)
        return self.run

    def url(self, at: int, cue: str) -> None:
        """An address: from its scheme to the last character that isn't closing punctuation."""
        if not self._starts_word(at):
            return
        body = at + len(cue)
        if not (run := self._run(body)):
            return
        stop = run.trimmed()
        host = _HOST.match(self.text, body, stop)
        if host and ("." in host[1] or host[1].startswith("[") or host[1].lower() == "localhost"):
            self._add("url", at, stop)

    def account(self, at: int, cue: str) -> None:
        """An IBAN with right check digits, or 8 to 18 digits, right behind its cue."""
        if not self._starts_word(at):
            return
        begin = _BETWEEN.match(self.text, at + len(cue)).end()
        if found := _IBAN.match(self.text, begin):
            code = found.group().replace(" ", "")
            turned = "".join(str(int(c, 36)) for c in code[4:] + code[:4])
            if 15 <= len(code) <= 34 and int(turned) % 97 == 1:
                self._add("account", begin, found.end())
        elif cue.lower() != "iban" and begin > at + len(cue) and (found := _NUMBER.match(self.text, begin)):
            self._add("account", begin, found.end())

    def secret(self, at: int, cue: str) -> None:
        """A value set behind its cue that has both a digit and a letter."""
        found = _VALUE.match(self.text, at + len(cue))
        if found and re.search("[0-9]", found[2]) and re.search("[A-Za-z]", found[2]):
            self._add("secret", found.start(2), found.end(2))

    def key(self, at: int, cue: str) -> None:
        if self._starts_word(at) and _KEY.match(self.text, at + len(cue)):
            self._add("secret", at, at + len(cue) + 16)


def find(text: str) -> list[Span]:
    """All spans of a text, in code points, by start and then kind."""
    found = Anchored(text)
    for last, (kind, cue) in automaton().iter(text):
        getattr(found, kind)(last - len(cue) + 1, cue)
    spans = found.spans
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) < 4 and int(part) < 256 for part in m.group().split(".")):
            spans.append(("ip", *m.span()))
    for m in _DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m.group())) <= 15:
            spans.append(("phone", *m.span()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def named(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


COUNTS = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def _report(texts: list[str]) -> list[tuple]:
    rows = []
    for text in texts:
        spans = find(text)
        base = [s for s in spans if s[0] in BASE_KINDS]
        counts = [sum(s[0] == kind for s in base) for kind in BASE_KINDS]
        rows.append((*counts, hashlib.sha256(named(base).encode()).hexdigest(), named(spans)))
    return list(zip(*rows))


def personal_data(docs: DataFrame) -> DataFrame:
    """`doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans` of each text.

    An Aho-Corasick automaton goes over the text once and finds at-signs, schemes, and words that
    announce accounts, passwords and keys. From each cue a local parser looks for the boundaries of
    what is there and checks it: e-mail addresses (base), web addresses, account numbers (IBAN check
    digits), passwords, tokens and access keys. Numbers that need no cue (IP addresses, cards,
    phones; base) are found by patterns that take linear time. Spans are `kind:start:end`, in code
    points, ordered by start and then kind; the hash is that of the base kinds alone.

    One text is one row's work, with no shuffle. A null or empty text has no spans; rows with null or
    repeated keys are read each for itself; an empty table gives no rows; other columns are ignored.
    """
    return annotated(docs, _report, COUNTS)


def redact(text: str) -> str:
    """The text with each span replaced by its kind in capitals; of spans that overlap, the first."""
    out, at = [], 0
    for kind, start, end in find(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
    return "".join(out) + text[at:] if out else text


def redacted_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, with personal data in `text` replaced; a null text stays null."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            clean = [None if t is None else redact(t) for t in batch.column(place).to_pylist()]
            columns = [*batch.columns[:place], pa.array(clean, pa.string()), *batch.columns[place + 1:]]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(step, docs.schema)
