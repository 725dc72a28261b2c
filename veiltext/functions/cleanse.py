"""The ordered cleanse chain. Each step is one global replacement on the result of the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veiltext import rules
from veiltext.functions.detect import is_address, matches
from veiltext.functions.spans import occur_once
from veiltext.functions.text import let
from veiltext.rules import ahead


def cleanse_email(text: Column) -> Column:
    """Addresses by their tag; long runs that are none are matched once and given back."""
    pattern = rules.swallowing(rules.CLEANSE_EMAIL)
    return F.when(
        F.contains(text, F.lit("@")), _replace_real(text, pattern, is_address, "[EMAIL]")
    ).otherwise(text)


def cleanse_phone(text: Column) -> Column:
    return F.regexp_replace(text, ahead(r"\d", rules.CLEANSE_PHONE), "[PHONE]")


def cleanse_ssn(text: Column) -> Column:
    return F.regexp_replace(text, ahead(r"\d", rules.CLEANSE_SSN), "[SSN]")


def cleanse_card(text: Column) -> Column:
    return F.regexp_replace(text, ahead(r"\d", rules.CLEANSE_CARD), "[CREDIT CARD]")


def cleanse_ip(text: Column) -> Column:
    return F.regexp_replace(text, ahead(r"\d", rules.CLEANSE_IP), "[IP ADDRESS]")


def cleanse_date(text: Column) -> Column:
    return F.regexp_replace(text, ahead(r"\d", rules.CLEANSE_DATE), "[DATE]")


# An address is a number, then words with at most two commas, then a state and a ZIP. Written
# plainly, with three lazy runs, a search takes quadratic time and more on text without punctuation.
# Three facts make an exact linear form possible. From one number the nearest state-and-ZIP is always
# the end chosen, so a single lazy run with the comma cases behind it finds the same end. If a number
# fails, every later number in the same comma-free run fails too, since the run after the first could
# pass over the second; so the second alternative swallows the rest of that run, to be given back
# unchanged: it never ends in a digit, and an address always does. And white space after the number
# needs to be shared with the words only when at most one letter stands before the end.
_RUN = r"[A-Za-z0-9\s]"
_SKIP = r"|\d{1,5}\s" + _RUN + r"*(?<![0-9])"
_SPACE = r"(?:\s++|\s(?=\s+[A-Za-z]?(?:,|[A-Za-z]{2}\s)))"
_ADDRESS_FULL = (
    r"(?U)\d{1,5}" + _SPACE + _RUN + r"+?"
    r"(?:[A-Za-z\s](?:,\s*)?|,[A-Za-z\s]+?(?:,\s*)?)"
    r"[A-Z]{2}\s+\d{5}(?:-\d{4})?" + _SKIP
)
_ADDRESS_SIMPLE = r"(?U)\d{1,5}" + _SPACE + _RUN + r"+?\s[A-Za-z]{2}\s+\d{5}" + _SKIP
_ZIP_FULL = r"(?U)[A-Z]{2}\s+\d{5}"
_ZIP_SIMPLE = r"(?U)\s[A-Za-z]{2}\s+\d{5}"


def _replace_real(text: Column, pattern: str, is_real: Callable[[Column], Column], tag: str) -> Column:
    """Replace the matches that are real; the others are put back as they were.

    Real ones whose text occurs once are replaced by their text, as no match can hold a tag.
    """
    def shown(gap: Column, hit: Column) -> Column:
        return F.concat(gap, F.when(is_real(hit), tag).otherwise(F.coalesce(hit, F.lit(""))))

    def replaced(hits: Column) -> Column:
        one_by_one = F.aggregate(hits, text, lambda acc, hit: F.replace(acc, hit, F.lit(tag)))
        return F.when(occur_once(text, hits), one_by_one).otherwise(
            F.array_join(F.zip_with(F.split(text, pattern, -1), matches(text, pattern), shown), "")
        )

    return let(F.filter(matches(text, pattern), is_real), replaced)


def _replace_addresses(text: Column, pattern: str) -> Column:
    return _replace_real(
        text, pattern, lambda hit: F.rlike(F.right(hit, F.lit(1)), F.lit(r"(?U)\d")), "[ADDRESS]"
    )


def cleanse_address(text: Column) -> Column:
    once = F.when(
        F.rlike(text, F.lit(_ZIP_FULL)), _replace_addresses(text, _ADDRESS_FULL)
    ).otherwise(text)
    return let(once, lambda t: F.when(
        F.rlike(t, F.lit(_ZIP_SIMPLE)), _replace_addresses(t, _ADDRESS_SIMPLE)
    ).otherwise(t))


def cleanse_mac(text: Column) -> Column:
    return F.regexp_replace(text, ahead(r"[0-9A-F]", rules.CLEANSE_MAC), "[MAC ADDRESS]")


def cleanse_license(text: Column) -> Column:
    return F.regexp_replace(text, ahead(r"[A-Z]", rules.CLEANSE_LICENSE), "[DRIVER LICENSE]")


def cleanse_passport(text: Column) -> Column:
    return F.regexp_replace(text, ahead(r"[A-Z]", rules.CLEANSE_PASSPORT), "[PASSPORT]")


def client_name(file_name: Column) -> Column:
    """The file's stem if it is longer than three characters, else null."""
    base = F.substring_index(file_name, "/", -1)
    stem = F.regexp_replace(base, r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")
    return F.when(F.length(stem) > 3, stem)


def cleanse_client_name(text: Column, file_name: Column) -> Column:
    """Replace the file's stem wherever it occurs, in any case and inside words too."""
    quoted = F.replace(client_name(file_name), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pattern = F.concat(F.lit("(?iu)\\Q"), quoted, F.lit("\\E"))
    return F.when(
        client_name(file_name).isNotNull(), F.regexp_replace(text, pattern, F.lit("[CLIENT NAME]"))
    ).otherwise(text)


def cleanse_client_terms(text: Column) -> Column:
    """One pass for all terms.

    The terms are whole words and the inserted tag begins and ends with a bracket, so no
    replacement can make or unmake a later term; longer names start with words that are gone by then.
    """
    first = "[" + "".join(sorted({term[0] for term in rules.CLIENT_TERMS})) + "]"
    words = ahead(first, r"(?iU)\b(?:" + "|".join(rules.CLIENT_TERMS) + r")\b")
    return F.regexp_replace(text, words, "[CLIENT TERM]")


def cleanse_text(text: Column, file_name: Column | None = None) -> Column:
    """The whole chain in order."""
    out = text
    for step in (cleanse_email, cleanse_phone, cleanse_ssn, cleanse_card, cleanse_ip,
                 cleanse_date, cleanse_address):
        out = let(out, step) if step in (cleanse_email, cleanse_address) else step(out)
    out = cleanse_passport(cleanse_license(cleanse_mac(out)))
    if file_name is not None:
        out = let(out, lambda t: cleanse_client_name(t, file_name))
    return cleanse_client_terms(out)


