"""Masking of grids, cells, paragraphs and slide units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veiltext.functions.cleanse import cleanse_text
from veiltext.functions.detect import is_structural_label
from veiltext.functions.mask import mask_by_value, mask_cell_by_value, mask_spans
from veiltext.functions.text import is_blank, strip
from veiltext.operators.dictionary import with_person_spans


def mask_table_strings(df: DataFrame, file_name: Column | None = None,
                       skip: Sequence[str] = ()) -> DataFrame:
    """Run the cleanse chain over the string columns; other columns and nulls stay.

    The name gets a column of its own first: by its old name, Spark would find the cleansed one.
    """
    named = df if file_name is None else df.withColumn("_file_name", file_name)
    name = None if file_name is None else F.col("_file_name")
    return named.select(*[
        cleanse_text(F.col(f.name), name).alias(f.name)
        if isinstance(f.dataType, T.StringType) and f.name not in skip
        else F.col(f.name)
        for f in df.schema.fields
    ])


def mask_table_all(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mask by value every cell, or those of `columns`, as strings."""
    chosen = set(df.columns if columns is None else columns)
    return df.select(*[
        mask_cell_by_value(F.col(c).cast("string")).alias(c) if c in chosen else F.col(c)
        for c in df.columns
    ])


def mask_cells_long(cells: DataFrame, names: DataFrame | None = None,
                    keys: Sequence[str] = ("doc_id", "sheet_no", "row", "col_no")) -> DataFrame:
    """Span masking per cell; null becomes empty, blank stays. `names` are persons to be masked too."""
    value = F.coalesce("value", F.lit(""))
    found = with_person_spans(cells, names, value, keys)
    extra = None if names is None else F.col("_extra")
    masked = F.when(is_blank(value), value).otherwise(mask_spans(value, extra=extra))
    return found.withColumn("value", masked).drop("_extra")


def mask_paragraphs(units: DataFrame, file_name: Column | None = None) -> DataFrame:
    """The cleanse chain per paragraph or cell, and whether it changed anything."""
    return (
        units.withColumn("masked", cleanse_text(F.col("text"), file_name))
        .withColumn("changed", F.col("text") != F.col("masked"))
    )


def mask_slide_units_spans(units: DataFrame, names: DataFrame | None = None,
                           keys: Sequence[str] = ("doc_id", "unit_no")) -> DataFrame:
    """Span masking of every shape and cell by itself. `names` are persons to be masked too."""
    text = F.coalesce("text", F.lit(""))
    found = with_person_spans(units, names, text, keys)
    extra = None if names is None else F.col("_extra")
    return found.withColumn("masked", mask_spans(text, extra=extra)).drop("_extra")


def mask_slide_units_values(units: DataFrame) -> DataFrame:
    """Value masking: cells skip labels and are stripped once masked; other text is taken as it is."""
    text = F.col("text")
    paragraph = F.when(is_blank(text), text).otherwise(mask_by_value(text))
    in_cell = mask_by_value(strip(text))
    cell = F.when(
        is_blank(text) | is_structural_label(text) | (in_cell == strip(text)), text
    ).otherwise(in_cell)
    return units.withColumn("masked", F.when(F.col("unit_kind") == "cell", cell).otherwise(paragraph))
