"""SQL functions and a span table function, rendered from the same columns that the DataFrame API uses.

The bodies are plain SQL over built-in functions, so Catalyst inlines them into the query; nothing
runs in Python, and there is no second copy of any rule.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from veiltext.functions.cleanse import cleanse_text
from veiltext.functions.mask import mask_spans
from veiltext.functions.spans import detect_ranked, public_spans, resolve_overlaps
from veiltext.functions.text import let, normalize_text

_SPAN = "entity STRING, text STRING, start INT, `end` INT, source STRING"
# A string literal, or an operator written like a function, which the parser takes only in quotes.
_LITERAL_OR_OPERATOR = re.compile(r"'(?:[^'\\]|\\.)*'|(?<=[(, ])([-+*/%!<>=&|]+)\(", re.S)


def sql_of(column: Column) -> str:
    """A column's expression as SQL text; what it refers to stands by its name."""
    shown = str(column)
    text = f" {shown[len('Column<') + 1:-2]}"
    return _LITERAL_OR_OPERATOR.sub(lambda m: f"`{m[1]}`(" if m[1] else m[0], text).strip()


def sql_definitions() -> list[str]:
    array = ", ".join(c.replace(" ", ": ", 1) for c in _SPAN.split(", "))

    def define(signature: str, returns: str, body: Callable[[Column], Column]) -> str:
        # An argument is put in wherever the body names it: it is evaluated once, and then named.
        sql = sql_of(let(F.col("t"), body))
        return f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returns} RETURN {sql}"

    return [
        define("normalize_text(t STRING)", "STRING", normalize_text),
        define("pii_span_array(t STRING)", f"ARRAY<STRUCT<{array}>>",
               lambda t: public_spans(resolve_overlaps(detect_ranked(t)))),
        define("mask_pii(t STRING)", "STRING", lambda t: mask_spans(t)),
        define("cleanse_text(t STRING, file_name STRING DEFAULT NULL)", "STRING",
               lambda t: cleanse_text(t, F.col("file_name"))),
        f"CREATE OR REPLACE TEMPORARY FUNCTION pii_spans(t STRING) RETURNS TABLE ({_SPAN}) RETURN "
        "SELECT s.entity, s.text, s.start, s.`end`, s.source FROM "
        "(SELECT explode_outer(found) AS s FROM (SELECT pii_span_array(t) AS found)) WHERE s IS NOT NULL",
    ]


def register(spark: SparkSession) -> None:
    """Create the functions for SQL queries of the session.

    `normalize_text(text)`, `mask_pii(text)`, `cleanse_text(text [, file_name])`, `pii_span_array(text)`,
    and the table function `pii_spans(text)`: `FROM docs, LATERAL pii_spans(docs.text)`.
    """
    for statement in sql_definitions():
        spark.sql(statement)
