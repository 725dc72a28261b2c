"""File names: types, routing, safe names and the names of written artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veiltext import rules


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The name without its last suffix; a leading dot is not a suffix."""
    return F.regexp_replace(base_name(path), r"(?s)^(\.*[^.].*)\.[^.]+$", "$1")


def file_type(path: Column) -> Column:
    """The last suffix, lower-cased, without the dot."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)[^.].*\.([^.]+)$", 1))


def extension(path: Column) -> Column:
    """Whatever follows the last dot, lower-cased; empty without a dot."""
    return F.when(
        F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1))
    ).otherwise("")


def is_allowed(path: Column, types: Sequence[str] = rules.UPLOAD_TYPES) -> Column:
    return extension(path).isin(*types)


def compound_suffix(path: Column) -> Column:
    """All suffixes joined, lower-cased, dots included."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^\.*[^.]+((?:\.[^.]*)*\.[^.]+)$", 1))


def route_upload(path: Column) -> Column:
    """The handler of the upload flow; other types are copied."""
    ext = extension(path)
    return (
        F.when(ext.isin(*rules.IMAGE_TYPES), "image")
        .when(ext == "pdf", "pdf")
        .when(ext == "txt", "text")
        .when(ext == "xlsx", "excel")
        .when(ext == "docx", "word")
        .otherwise("copy")
    )


def route_report(path: Column) -> Column:
    """The handler of the report flow; other types are copied."""
    ext = file_type(path)
    return (
        F.when(ext.isin(*rules.IMAGE_TYPES), "image")
        .when(ext.isin("pdf", "pptx", "xlsx", "txt"), ext)
        .otherwise("copy")
    )


def route_directory(path: Column) -> Column:
    """The handler of the directory flow, by all suffixes together; other types fail."""
    ext = compound_suffix(path)
    return (
        F.when(ext.isin(".png", ".jpg", ".jpeg", ".bmp", ".tiff"), "image")
        .when(ext == ".pdf", "pdf")
        .when(ext.isin(".xlsx", ".xls"), "excel")
        .when(ext == ".pptx", "pptx")
        .when(ext == ".txt", "text")
        .when(ext == ".csv", "csv")
        .otherwise("fail")
    )


def within_size(length: Column, limit: int = rules.SIZE_LIMIT) -> Column:
    return length <= limit


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")


def stable_id(key: Column) -> Column:
    """Stands where a random id would: the same file gets the same names on every run."""
    return F.substring(F.sha2(key.cast("string"), 256), 1, 32)


def before_first_dot(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def masked_name(name: Column, key: Column) -> Column:
    return F.concat(F.lit("masked_"), stable_id(key), F.lit("_"), name)


def raw_text_name(name: Column) -> Column:
    return F.concat(stem(name), F.lit("_raw.txt"))


def clean_text_name(name: Column) -> Column:
    return F.concat(stem(name), F.lit("_clean.txt"))


def report_name(name: Column) -> Column:
    return F.concat(stem(name), F.lit("_report.json"))


def metadata_name(stored: Column) -> Column:
    return F.concat(F.lit("metadata_"), before_first_dot(stored), F.lit(".txt"))


def cleansed_name(name: Column, key: Column) -> Column:
    """Grids are written back as CSV under the part of the name before its first dot."""
    grid = F.concat(before_first_dot(name), F.lit(".csv"))
    return F.concat(
        F.lit("cleansed_"),
        stable_id(key),
        F.lit("_"),
        F.when(extension(name) == "xlsx", grid).otherwise(name),
    )


def redacted_name(name: Column) -> Column:
    """What the typed redactor writes for a stored file."""
    return F.concat(F.lit("redacted_"), base_name(name))


def analyzed_name(name: Column) -> Column:
    return F.concat(F.lit("analyzed_"), before_first_dot(name), F.lit(".txt"))


def model_analysis_name(name: Column) -> Column:
    return F.concat(F.lit(rules.MODEL_ANALYSIS_PREFIX), before_first_dot(name), F.lit(".txt"))
