"""Descriptions, findings, security facts, prompts and report text for one document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veiltext import rules
from veiltext.functions.detect import matches
from veiltext.functions.text import SENTENCE_END, is_blank, let, split_sentences, strip


def description(clean: Column) -> Column:
    """The first two sentences, at most 300 characters.

    Only the last piece of a split can be blank, so a split into three is enough.
    """
    pieces = F.filter(
        F.transform(F.slice(F.split(clean, SENTENCE_END, 3), 1, 2), strip), lambda s: s != ""
    )
    text = F.substring(F.array_join(pieces, " "), 1, 300)
    return F.when(is_blank(clean), rules.DESCRIPTION_NONE).otherwise(text)


def keyword_findings(clean: Column) -> Column:
    """The findings whose keywords occur anywhere in the lower-cased text, in rule order."""

    def hits(low: Column) -> Column:
        tests = []
        for keywords, finding in rules.FINDINGS:
            any_hit = F.contains(low, F.lit(keywords[0]))
            for keyword in keywords[1:]:
                any_hit = any_hit | F.contains(low, F.lit(keyword))
            tests.append(F.when(any_hit, finding))
        return F.array_compact(F.array(*tests))

    return let(F.lower(clean), hits)


def key_findings(clean: Column) -> Column:
    """Three to five findings: by keyword, then highlighted sentences, then padding."""

    def fill(base: Column) -> Column:
        long_ones = F.filter(split_sentences(clean), lambda s: F.length(s) > 25)
        lines = F.transform(
            F.slice(long_ones, F.lit(1), F.lit(5) - F.size(base)),
            lambda s: F.concat(
                F.lit("Highlights: "), F.substring(F.replace(s, F.lit("\n"), F.lit(" ")), 1, 140)
            ),
        )
        return F.when(F.size(base) < 3, F.concat(base, lines)).otherwise(F.slice(base, 1, 5))

    def pad(some: Column) -> Column:
        least_one = F.when(F.size(some) > 0, some).otherwise(F.array(F.lit(rules.FINDING_NONE)))
        missing = F.greatest(F.lit(0), F.lit(3) - F.greatest(F.size(some), F.lit(1)))
        return F.concat(least_one, F.array_repeat(F.lit(rules.FINDING_PAD), missing))

    return let(let(keyword_findings(clean), fill), pad)


def _facts(text: Column, low: Column, odd: Column, category: str) -> Column:
    patterns = next(p for name, _, p in rules.SECURITY if name == category)
    found = []
    for pattern, words in zip(patterns, rules.SECURITY_HINTS[category]):
        hint = odd
        for word in words:
            hint = hint | F.contains(low, F.lit(word))
        found.append(F.when(hint, matches(text, "(?iU)" + pattern)))
    none = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(f, none) for f in found])


def _has_case_twin(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in rules.CASE_TWINS])


def security_matches(text: Column, category: str) -> Column:
    """One category's facts: whole matches, pattern by pattern.

    Most documents hold none of a pattern's words, so a plain search comes before each pattern.
    """
    return let(F.lower(text), lambda low: _facts(text, low, _has_case_twin(text), category))


def security_info(text: Column) -> Column:
    """All six categories as `array<struct<category, matches>>`."""

    def all_facts(look: Column) -> Column:
        return F.array(*[
            F.struct(
                F.lit(name).alias("category"),
                _facts(text, look["low"], look["odd"], name).alias("matches"),
            )
            for name, _, _ in rules.SECURITY
        ])

    return let(
        F.struct(F.lower(text).alias("low"), _has_case_twin(text).alias("odd")), all_facts
    )


def top_matches(hits: Column, limit: int = 10) -> Column:
    """At most `limit` different matches, in order of their text."""
    return F.slice(F.array_sort(F.array_distinct(hits)), 1, limit)


def security_report(text: Column) -> Column:
    """Headed sections for the categories that have facts."""
    headings = F.create_map(*[F.lit(v) for name, heading, _ in rules.SECURITY for v in (name, heading)])

    def section(info: Column) -> Column:
        items = F.transform(top_matches(info["matches"]), lambda m: F.concat(F.lit("  - "), m))
        return F.concat(F.array(headings[info["category"]]), items, F.array(F.lit("")))

    filled = F.filter(security_info(text), lambda info: F.size(info["matches"]) > 0)
    return let(
        F.flatten(F.transform(filled, section)),
        lambda ls: F.when(F.size(ls) > 0, F.array_join(ls, "\n")).otherwise(rules.SECURITY_NONE),
    )


def analysis_text(cleansed: Column, model_text: Column | None = None) -> Column:
    """The full written analysis, with a model's section when there is one."""
    basic = F.concat(
        F.lit(f"{rules.CONTENT_HEADING}\n{rules.RULER}\n"),
        cleansed,
        F.lit(f"\n\n\n{rules.SECURITY_HEADING}\n{rules.RULER}\n"),
        security_report(cleansed),
    )
    if model_text is None:
        return basic
    extra = F.concat(F.lit(f"\n\n\n{rules.MODEL_HEADING}\n{rules.RULER}\n"), model_text)
    return F.concat(basic, F.when(F.coalesce(model_text, F.lit("")) != "", extra).otherwise(""))


def _fill(template: str, **values: Column) -> Column:
    parts, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(head), values[name]]
    return F.concat(*parts, F.lit(rest))


def analysis_prompt(content: Column, file_type: Column) -> Column:
    return _fill(rules.ANALYSIS_PROMPT, kind=F.upper(file_type), content=content)


def security_prompt(content: Column) -> Column:
    return _fill(rules.SECURITY_PROMPT, content=content)
