"""Document text from its parts: ordered aggregation, fallback join, fixed messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltext import rules
from veiltext.functions.text import is_blank, strip

PART = 4096


def ordered_join(df: DataFrame, keys: Sequence[str], order: str, text: Column, separator: str,
                 name: str = "text", keep_empty: bool = True, part: int = PART) -> DataFrame:
    """Join each key's texts in order.

    Two steps: parts of at most `part` consecutive numbers first, then the parts of a key. No task
    sorts all the rows of a large key; the last step sees one row per part.
    """

    def gather(no: str, value: Column) -> Column:
        entry = F.struct(F.col(no).alias("no"), value.alias("text"))
        if not keep_empty:
            entry = F.when(value != "", entry)
        return F.array_join(
            F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), separator
        )

    parts = (
        df.withColumn("_text", text)
        .withColumn("_part", F.floor(F.col(order) / part))
        .groupBy(*keys, "_part")
        .agg(gather(order, F.col("_text")).alias("_text"))
    )
    return parts.groupBy(*keys).agg(gather("_part", F.col("_text")).alias(name))


def assemble_lines(units: DataFrame) -> DataFrame:
    """Non-empty texts of a document's units, one per line."""
    return ordered_join(units, ["doc_id"], "unit_no", F.coalesce("text", F.lit("")), "\n",
                        keep_empty=False)


def assemble_pages(pages: DataFrame) -> DataFrame:
    """Pages, missing ones as empty, one below the other, stripped."""
    return ordered_join(
        pages, ["doc_id"], "page_no", F.coalesce("text", F.lit("")), "\n"
    ).withColumn("text", strip(F.col("text")))


def assemble_pages_concat(pages: DataFrame) -> DataFrame:
    return ordered_join(pages, ["doc_id"], "page_no", F.coalesce("text", F.lit("")), "")


def assemble_paragraphs(units: DataFrame, kind: str = "paragraph") -> DataFrame:
    """Each paragraph with a line end after it; other kinds of unit are left out."""
    return ordered_join(
        units.filter(F.col("unit_kind") == kind), ["doc_id"], "unit_no",
        F.concat(F.coalesce("text", F.lit("")), F.lit("\n")), "",
    )


def assemble_sheets(cells: DataFrame) -> DataFrame:
    """Each sheet's heading and grid as text, blocks parted by an empty line.

    `cells` has `doc_id, sheet_no, sheet, row, col_no, col, value`; a grid is its column names and
    then its rows, cells joined by a blank.
    """
    sheet = ["doc_id", "sheet_no", "sheet"]
    value = F.coalesce("value", F.lit(""))
    lines = ordered_join(cells, [*sheet, "row"], "col_no", value, " ", name="line")
    heads = ordered_join(
        cells.select(*sheet, "col_no", "col").distinct(), sheet, "col_no", F.col("col"), " ",
        name="line",
    ).withColumn("row", F.lit(-1).cast("long"))
    grids = ordered_join(
        lines.select(*sheet, "row", "line").unionByName(heads.select(*sheet, "row", "line")),
        sheet, "row", F.col("line"), "\n", name="grid",
    )
    block = F.concat(F.lit("Sheet: "), F.col("sheet"), F.lit("\n\n"), F.col("grid"))
    return ordered_join(grids, ["doc_id"], "sheet_no", block, "\n\n")


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first extractor's text unless it is blank, else the second's."""
    other = second.select("doc_id", F.col("text").alias("_other"))
    return first.join(other, "doc_id", "left").select(
        "doc_id",
        F.when(~is_blank(F.col("text")), F.col("text"))
        .otherwise(F.coalesce("_other", F.lit("")))
        .alias("text"),
    )


def unsupported_text(file_type: Column, text: Column) -> Column:
    """The upload flow's text of a file: a fixed message for types it cannot read."""
    readable = [t for t in (*rules.UPLOAD_TYPES, "csv") if t != "pptx"]
    return F.when(file_type.isin(*readable), text).otherwise(rules.NOT_EXTRACTABLE)


def report_text(file_type: Column, text: Column) -> Column:
    """The report flow's text of a file: empty for types it cannot read."""
    return F.when(file_type.isin(*rules.REPORT_TYPES), text).otherwise("")
