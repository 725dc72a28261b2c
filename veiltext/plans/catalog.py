"""The registered queries: name -> function of (spark, folder) that gives a DataFrame.

Lists are given joined by ` | ` so that results compare as plain values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veiltext import rules
from veiltext.functions import cleanse, detect, insight, naming, sql
from veiltext.functions.mask import mask_by_value, mask_cell_by_value, mask_text, value_spans
from veiltext.functions.text import is_blank, normalize_text, preview, split_sentences
from veiltext.operators import assemble, counts, dictionary, ocr, pages, tables
from veiltext.operators.documents import artifacts, report_rows
from veiltext.operators.responses import join_responses, join_security_responses
from veiltext.plans.tables import Tables
from veiltext.session import shared_folder
from veiltext.sources import files as sources
from veiltext.sources import sinks
from veiltext.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Callable[[Tables], DataFrame]] = {}


def query(name: str) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _REGISTRY[name] = fn
        return fn

    return add


def queries(partitions: int | None = None) -> dict[str, Query]:
    """The queries; with `partitions`, input tables are dealt out over so many tasks as they are read."""
    return {
        name: lambda spark, folder, fn=fn: fn(Tables(spark, folder, partitions))
        for name, fn in _REGISTRY.items()
    }


def joined(items: Column) -> Column:
    return F.array_join(items, " | ")


def clean_docs(t: Tables) -> DataFrame:
    return t.corpus().withColumn("text", normalize_text(F.col("text")))


def masked_docs(t: Tables) -> DataFrame:
    return t.corpus().withColumn("text", mask_text(F.col("text")))


# --- sources and sinks ------------------------------------------------------------------------
@query("file_inventory")
def _(t: Tables) -> DataFrame:
    """Notes written as text and as JSON files; only the text files are of a supported type.

    How many files there are depends on the writer, so they are summed.
    """
    folder = shared_folder(t.spark)
    t.notes().select("text").write.text(f"{folder}/deep/text")
    t.notes().select("doc_id", "text").write.json(f"{folder}/deep/json")
    found = sources.file_inventory(t.spark, folder)
    return found.groupBy("ext").agg(
        (F.count(F.lit(1)) > 0).alias("found"), F.sum("length").alias("bytes")
    )


@query("read_text_docs")
def _(t: Tables) -> DataFrame:
    """Documents written one file each and read back whole; the writer ends a file with a line end."""
    folder = shared_folder(t.spark)
    t.documents().select("doc_id", "text").write.partitionBy("doc_id").text(folder)
    return sources.read_text_docs(t.spark, folder).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.regexp_replace("text", r"\n\z", "").alias("text"),
    )


@query("read_csv_docs")
def _(t: Tables) -> DataFrame:
    """Whole texts, with quotes and line ends of all kinds in them."""
    folder = shared_folder(t.spark)
    sinks.write_masked_csv(t.corpus(), folder)
    return sources.read_csv_docs(t.spark, folder, multi_line=True)


@query("write_clean_text")
def _(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark)
    sinks.write_clean_text(artifacts(t.corpus()), folder)
    return t.spark.read.parquet(folder)


@query("write_report_json")
def _(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark)
    sinks.write_report_json(report_rows(t.corpus()), folder)
    back = t.spark.read.schema(
        "doc_id bigint, file_name string, file_type string, file_description string, "
        "key_findings array<string>"
    ).json(folder)
    return back.withColumn("key_findings", joined(F.col("key_findings")))


@query("write_report_array")
def _(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark)
    sinks.write_report_array(report_rows(t.corpus()), folder)
    back = sinks.read_report_array(
        t.spark, folder, "doc_id bigint, file_name string, file_type string, "
        "file_description string, key_findings array<string>",
    )
    return back.withColumn("key_findings", joined(F.col("key_findings")))


@query("write_masked_csv")
def _(t: Tables) -> DataFrame:
    """All columns of the grid: nulls, blank cells, and blanks around values stay as they were."""
    folder = shared_folder(t.spark)
    sinks.write_masked_csv(tables.mask_table_all(t.grid()), folder)
    return sources.read_csv_docs(t.spark, folder, multi_line=True)


@query("manifest")
def _(t: Tables) -> DataFrame:
    """Some files fail the typed redactor, and some of those the basic chain too."""
    doc = F.col("doc_id")
    typed = F.when(doc % 11 == 0, "Failed to cleanse file").otherwise(
        sinks.directory_error(F.col("file_name"))
    )
    basic = F.when(doc % 22 == 0, "Error cleansing file: unreadable")
    return sinks.manifest(t.files().withColumns({"typed_error": typed, "error": basic}))


# --- filters, routing, projections ------------------------------------------------------------
@query("allowed_files")
def _(t: Tables) -> DataFrame:
    name = F.col("file_name")
    return t.files().select(
        "doc_id", "file_name", naming.is_allowed(name, rules.REPORT_TYPES).alias("report_type")
    ).filter(naming.is_allowed(name))


@query("file_type")
def _(t: Tables) -> DataFrame:
    return t.files().select("doc_id", naming.file_type(F.col("file_name")).alias("file_type"))


@query("compound_suffix")
def _(t: Tables) -> DataFrame:
    return t.files().select("doc_id", naming.compound_suffix(F.col("file_name")).alias("suffix"))


@query("route_handler")
def _(t: Tables) -> DataFrame:
    name = F.col("file_name")
    return t.files().select(
        "doc_id", naming.route_upload(name).alias("upload"),
        naming.route_report(name).alias("report"), naming.route_directory(name).alias("directory"),
    )


@query("size_limit")
def _(t: Tables) -> DataFrame:
    return t.files().filter(naming.within_size(F.col("length")))


@query("safe_filename")
def _(t: Tables) -> DataFrame:
    awkward = F.concat(F.lit("fichier é ("), F.col("file_name"), F.lit(")"))
    return t.files().select("doc_id", naming.safe_filename(awkward).alias("safe"))


@query("artifact_names")
def _(t: Tables) -> DataFrame:
    name, key = F.col("file_name"), F.col("doc_id")
    return t.files().select(
        "doc_id", naming.masked_name(name, key).alias("masked"),
        naming.raw_text_name(name).alias("raw"), naming.clean_text_name(name).alias("clean"),
        naming.report_name(name).alias("report"), naming.metadata_name(name).alias("metadata"),
        naming.redacted_name(name).alias("redacted"), naming.analyzed_name(name).alias("analyzed"),
        naming.model_analysis_name(name).alias("model"),
    )


@query("blank_filter")
def _(t: Tables) -> DataFrame:
    return t.grid().filter(~is_blank(F.col("note"))).select("doc_id", "label")


@query("structural_label")
def _(t: Tables) -> DataFrame:
    return t.note_units().select(
        "doc_id", "unit_no", detect.is_structural_label(F.col("text")).alias("structural")
    )


@query("client_name")
def _(t: Tables) -> DataFrame:
    return t.files().select("doc_id", cleanse.client_name(F.col("file_name")).alias("client"))


# --- normalising, detection, spans ------------------------------------------------------------
@query("normalize_text")
def _(t: Tables) -> DataFrame:
    return clean_docs(t)


def _detector(name: str, entity: str) -> None:
    @query(name)
    def _(t: Tables) -> DataFrame:
        hits = detect.found(F.col("text"), detect.by_name(entity))
        return t.corpus().select("doc_id", hits.alias("hits")).select(
            "doc_id", F.size("hits").alias("n"), joined(F.col("hits")).alias("hits")
        )


for _name, _entity in (
    ("detect_email", "EMAIL"), ("detect_phone", "PHONE"), ("detect_aadhaar", "AADHAAR"),
    ("detect_ssn", "SSN"), ("detect_ip_url", "IP_ADDRESS"),
    ("detect_credit_card", "CREDIT_CARD"), ("detect_date", "DATE_TIME"),
):
    _detector(_name, _entity)


@query("detect_person_dict")
def _(t: Tables) -> DataFrame:
    return dictionary.dictionary_spans(t.corpus(), t.names(), "PERSON", "names")


@query("detect_location_dict")
def _(t: Tables) -> DataFrame:
    return dictionary.location_spans(t.place_docs(), t.places())


@query("person_filter")
def _(t: Tables) -> DataFrame:
    return dictionary.person_spans(t.corpus(), t.names())


@query("spans")
def _(t: Tables) -> DataFrame:
    return counts.span_table(clean_docs(t))


@query("resolve_overlaps")
def _(t: Tables) -> DataFrame:
    return counts.span_table(clean_docs(t), resolved=True)


@query("dedup_exact_span")
def _(t: Tables) -> DataFrame:
    return counts.item_table(t.corpus())


@query("dedup_exact_span_names")
def _(t: Tables) -> DataFrame:
    """Items of the detectors and of the name table."""
    return counts.item_table(t.corpus(), extra=dictionary.person_spans(t.corpus(), t.names()))


@query("entity_counts_by_doc")
def _(t: Tables) -> DataFrame:
    return counts.entity_counts_by_doc(
        counts.span_table(clean_docs(t), resolved=True),
        [d.entity for d in rules.SPAN_DETECTORS],
    )


# --- masking ----------------------------------------------------------------------------------
@query("mask_by_offset")
def _(t: Tables) -> DataFrame:
    """Every span of the raw text, not normalised first."""
    return t.corpus().select("doc_id", tables.mask_spans(F.col("text")).alias("masked"))


@query("mask_by_value")
def _(t: Tables) -> DataFrame:
    return t.corpus().select("doc_id", mask_by_value(F.col("text")).alias("masked"))


@query("mask_text")
def _(t: Tables) -> DataFrame:
    return t.corpus().select("doc_id", mask_text(F.col("text")).alias("cleaned_text"))


@query("mask_text_names")
def _(t: Tables) -> DataFrame:
    return dictionary.mask_with_names(t.corpus(), t.names())


@query("mask_table_strings")
def _(t: Tables) -> DataFrame:
    return tables.mask_table_strings(t.grid(), F.col("file_name"))


@query("mask_table_all")
def _(t: Tables) -> DataFrame:
    return tables.mask_table_all(t.grid())


@query("mask_cells_long")
def _(t: Tables) -> DataFrame:
    return tables.mask_cells_long(t.cells())


@query("mask_cells_names")
def _(t: Tables) -> DataFrame:
    return tables.mask_cells_long(t.cells(), t.names())


@query("mask_slide_units_names")
def _(t: Tables) -> DataFrame:
    return tables.mask_slide_units_spans(t.note_units(), t.names()).select("doc_id", "unit_no", "masked")


@query("mask_paragraphs")
def _(t: Tables) -> DataFrame:
    """Each document with the name of its own file."""
    units = t.note_units().join(t.corpus().select("doc_id", "file_name"), "doc_id")
    return tables.mask_paragraphs(units, F.col("file_name")).drop("file_name")


@query("mask_slide_units")
def _(t: Tables) -> DataFrame:
    by_span = tables.mask_slide_units_spans(t.note_units()).withColumnRenamed("masked", "by_span")
    return tables.mask_slide_units_values(by_span).select(
        "doc_id", "unit_no", "by_span", F.col("masked").alias("by_value")
    )


@query("mask_pages_doc_entities")
def _(t: Tables) -> DataFrame:
    """Entities of all kinds: patterns, names, and addresses of machines."""
    clean = clean_docs(t)
    found = counts.span_table(clean, resolved=True).unionByName(
        dictionary.person_spans(clean, t.names())
    ).select("doc_id", "entity", "text", "start")
    machines = counts.item_table(clean, types=["IP_ADDRESS"])
    return pages.mask_pages_doc_entities(t.note_pages(), found.unionByName(
        machines.select("doc_id", F.col("type").alias("entity"), "text", "start")
    ))


@query("mask_pages_own_entities")
def _(t: Tables) -> DataFrame:
    return pages.mask_pages_own_entities(t.note_pages())


# --- the ordered cleanse chain ----------------------------------------------------------------
def _cleanse_step(name: str, step: Callable[[Column], Column]) -> None:
    @query(name)
    def _(t: Tables) -> DataFrame:
        return t.corpus().select("doc_id", step(F.col("text")).alias("text"))


for _name in ("email", "phone", "ssn", "card", "ip", "date", "address", "mac", "license",
              "passport", "client_terms"):
    _cleanse_step(f"cleanse_{_name}", getattr(cleanse, f"cleanse_{_name}"))


@query("cleanse_client_name")
def _(t: Tables) -> DataFrame:
    """The name of each file's first part, so that it occurs in the text."""
    first = F.concat(naming.before_first_dot(F.col("file_name")), F.lit(".txt"))
    return t.corpus().select("doc_id", cleanse.cleanse_client_name(F.col("text"), first).alias("text"))


@query("cleanse_full")
def _(t: Tables) -> DataFrame:
    return t.corpus().select(
        "doc_id", cleanse.cleanse_text(F.col("text"), F.col("file_name")).alias("text")
    )


# --- OCR words --------------------------------------------------------------------------------
@query("ocr_confident_words")
def _(t: Tables) -> DataFrame:
    return ocr.confident_words(t.ocr_words())


def _ngrams(t: Tables) -> DataFrame:
    return ocr.ngrams(ocr.confident_words(t.ocr_words(), ahead=ocr.AHEAD))


@query("ocr_ngrams")
def _(t: Tables) -> DataFrame:
    return _ngrams(t).select("image_id", "word_no", "n", "text")


@query("ocr_bbox_union")
def _(t: Tables) -> DataFrame:
    return _ngrams(t).select(
        "image_id", "word_no", "n", "x", "y", "w", "h"
    )


@query("ocr_pick_ngrams")
def _(t: Tables) -> DataFrame:
    return ocr.pick_ngrams(_ngrams(t))


@query("ocr_picked_counts")
def _(t: Tables) -> DataFrame:
    return ocr.picked_counts(ocr.pick_ngrams(_ngrams(t)))


@query("ocr_redaction_boxes")
def _(t: Tables) -> DataFrame:
    return ocr.redaction_boxes(ocr.pick_ngrams(_ngrams(t)))


@query("ocr_match_entities")
def _(t: Tables) -> DataFrame:
    notes = t.notes().withColumn("text", normalize_text(F.col("text")))
    found = counts.span_table(notes, resolved=True).select(
        F.col("doc_id").alias("image_id"), "text"
    )
    return ocr.match_entities(t.ocr_words(), found)


@query("ocr_match_basic")
def _(t: Tables) -> DataFrame:
    return ocr.match_basic(t.ocr_words())


# --- document assembly ------------------------------------------------------------------------
@query("assemble_lines")
def _(t: Tables) -> DataFrame:
    return assemble.assemble_lines(t.units())


@query("assemble_pages")
def _(t: Tables) -> DataFrame:
    return assemble.assemble_pages(t.note_pages())


@query("assemble_pages_concat")
def _(t: Tables) -> DataFrame:
    return assemble.assemble_pages_concat(t.note_pages())


@query("assemble_paragraphs")
def _(t: Tables) -> DataFrame:
    return assemble.assemble_paragraphs(t.units())


@query("assemble_sheets")
def _(t: Tables) -> DataFrame:
    return assemble.assemble_sheets(t.cells())


@query("extraction_fallback")
def _(t: Tables) -> DataFrame:
    """A first extractor that reads nothing from every fourth note, and a second that reads pages."""
    first = t.notes().select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, " \n").otherwise(F.col("text")).alias("text")
    )
    return assemble.with_fallback(first, assemble.assemble_pages(t.note_pages()))


@query("unsupported_text")
def _(t: Tables) -> DataFrame:
    kind = naming.file_type(F.col("file_name"))
    return t.corpus().select(
        "doc_id", assemble.unsupported_text(kind, F.col("text")).alias("upload_text"),
        assemble.report_text(kind, F.col("text")).alias("report_text"),
    )


# --- insight and security ---------------------------------------------------------------------
@query("split_sentences")
def _(t: Tables) -> DataFrame:
    return clean_docs(t).select(
        "doc_id", F.posexplode(split_sentences(F.col("text"))).alias("no", "sentence")
    )


@query("description")
def _(t: Tables) -> DataFrame:
    return masked_docs(t).select("doc_id", insight.description(F.col("text")).alias("description"))


@query("keyword_findings")
def _(t: Tables) -> DataFrame:
    return masked_docs(t).select(
        "doc_id", joined(insight.keyword_findings(F.col("text"))).alias("findings")
    )


@query("key_findings")
def _(t: Tables) -> DataFrame:
    return masked_docs(t).select(
        "doc_id", joined(insight.key_findings(F.col("text"))).alias("findings")
    )


@query("report_rows")
def _(t: Tables) -> DataFrame:
    return report_rows(t.corpus()).withColumn("key_findings", joined(F.col("key_findings")))


@query("report_rows_names")
def _(t: Tables) -> DataFrame:
    """Reports in which persons from the name table are masked too."""
    rows = report_rows(t.corpus(), dictionary.person_spans(clean_docs(t), t.names()))
    return rows.withColumn("key_findings", joined(F.col("key_findings")))


@query("finding_counts")
def _(t: Tables) -> DataFrame:
    return counts.finding_counts(masked_docs(t))


for _name, _category in (
    ("sec_firewall", "firewall_rules"), ("sec_iam", "iam_policies"),
    ("sec_access", "access_controls"), ("sec_password", "password_policies"),
    ("sec_encryption", "encryption_info"), ("sec_vulnerability", "vulnerabilities"),
):
    def _security(t: Tables, category: str = _category) -> DataFrame:
        return t.corpus().select(
            "doc_id", joined(insight.security_matches(F.col("text"), category)).alias("facts")
        )

    query(_name)(_security)


@query("sec_long")
def _(t: Tables) -> DataFrame:
    return counts.security_long(t.corpus())


@query("sec_top10")
def _(t: Tables) -> DataFrame:
    return counts.security_top(t.corpus())


@query("sec_report_text")
def _(t: Tables) -> DataFrame:
    return t.corpus().select("doc_id", insight.security_report(F.col("text")).alias("report"))


def _cleansed(t: Tables) -> DataFrame:
    return t.corpus().select(
        "doc_id", "file_name",
        cleanse.cleanse_text(F.col("text"), F.col("file_name")).alias("text"),
    )


@query("analysis_text")
def _(t: Tables) -> DataFrame:
    answers = t.responses().withColumnRenamed("response", "answer")
    return _cleansed(t).join(answers, "doc_id", "left").select(
        "doc_id", insight.analysis_text(F.col("text"), F.col("answer")).alias("analysis")
    )


@query("previews")
def _(t: Tables) -> DataFrame:
    return t.corpus().select(
        "doc_id", *[preview(F.col("text"), n).alias(f"first_{n}") for n in (500, 1000, 2000)]
    )


@query("llm_prompt_table")
def _(t: Tables) -> DataFrame:
    kind = naming.extension(F.col("file_name"))
    return _cleansed(t).select(
        "doc_id", insight.analysis_prompt(F.col("text"), kind).alias("prompt")
    )


@query("llm_security_prompt_table")
def _(t: Tables) -> DataFrame:
    return _cleansed(t).select("doc_id", insight.security_prompt(F.col("text")).alias("prompt"))


@query("llm_join_responses")
def _(t: Tables) -> DataFrame:
    docs = t.corpus().withColumn("file_type", naming.extension(F.col("file_name")))
    return join_responses(docs, t.responses())


# --- counters and summaries -------------------------------------------------------------------
def _items(t: Tables) -> DataFrame:
    docs = t.corpus().withColumn("source", naming.extension(F.col("file_name")))
    return counts.item_table(docs, "source")


@query("llm_join_security_responses")
def _(t: Tables) -> DataFrame:
    return join_security_responses(t.corpus(), t.responses())


@query("redactions_by_type")
def _(t: Tables) -> DataFrame:
    return counts.redactions_by_type(_items(t))


@query("redactions_observed")
def _(t: Tables) -> DataFrame:
    """The corpus masked and written; the counts come from that same pass."""
    seen = Observation()
    masked = counts.mask_and_count(t.corpus(), seen, [d.entity for d in rules.VALUE_DETECTORS])
    masked.write.parquet(shared_folder(t.spark))
    return counts.observed_counts(t.spark, seen)


@query("files_outcome")
def _(t: Tables) -> DataFrame:
    routed = naming.route_directory(F.col("file_name"))
    return counts.files_outcome(t.files().select((routed != "fail").alias("success")))


@query("summary_report")
def _(t: Tables) -> DataFrame:
    return counts.summary_report(_items(t))


@query("cells_changed")
def _(t: Tables) -> DataFrame:
    cell = F.col("value")
    masked = mask_cell_by_value(cell)
    found = F.when(detect.is_structural_label(cell), 0).otherwise(
        F.size(value_spans(F.trim(cell)))
    )
    return counts.cells_changed(
        t.cells().select(
            "sheet", (F.coalesce(cell, F.lit("")) != F.coalesce(masked, F.lit(""))).alias("changed"),
            F.when(cell.isNull(), 0).otherwise(found).alias("items"),
        ),
        ["sheet"],
    )


@query("redactions_per_unit")
def _(t: Tables) -> DataFrame:
    return counts.redactions_per_unit(t.note_pages(), "page_no")


@query("type_rollup")
def _(t: Tables) -> DataFrame:
    return counts.type_rollup(_items(t))


# --- streaming --------------------------------------------------------------------------------
def _landed(t: Tables) -> tuple[DataFrame, str]:
    """The corpus written to a landing folder, and a stream over that folder."""
    folder = shared_folder(t.spark)
    t.corpus().write.parquet(f"{folder}/in")
    stream = t.spark.readStream.schema("doc_id bigint, file_name string, text string").parquet(
        f"{folder}/in"
    )
    return stream, folder


@query("stream_cleanse")
def _(t: Tables) -> DataFrame:
    stream, folder = _landed(t)
    tasks = t.tasks("orders", "documents")
    live.start_cleanse(stream, f"{folder}/out", f"{folder}/state", tasks).awaitTermination()
    return t.spark.read.parquet(f"{folder}/out")


@query("stream_counters")
def _(t: Tables) -> DataFrame:
    stream, folder = _landed(t)
    tasks = t.tasks("orders", "documents")
    live.start_counters(stream, f"{folder}/out", f"{folder}/state", tasks=tasks).awaitTermination()
    return live.latest_counts(t.spark, f"{folder}/out")


# --- SQL functions ----------------------------------------------------------------------------
@query("sql_functions")
def _(t: Tables) -> DataFrame:
    sql.register(t.spark)
    return t.spark.sql(
        "SELECT doc_id, normalize_text(text) AS normal, mask_pii(normalize_text(text)) AS masked, "
        "cleanse_text(text) AS cleansed, cleanse_text(text, file_name) AS cleansed_by_name FROM {docs}",
        docs=t.corpus(),
    )


@query("pii_spans")
def _(t: Tables) -> DataFrame:
    sql.register(t.spark)
    return t.spark.sql(
        "SELECT d.doc_id, s.entity, s.text, s.start, s.end FROM {docs} d, LATERAL pii_spans(d.text) s",
        docs=clean_docs(t),
    )


@query("detector_switches")
def _(t: Tables) -> DataFrame:
    """The detectors switched on in a rule table: e-mail, identity numbers, and a pattern of its own."""
    table = t.spark.sql(
        "select * from values ('EMAIL', 1, null, true), ('PHONE', 2, null, false), "
        "('SSN', 3, null, true), ('TICKET', 4, 'Ticket [0-9]+', true), ('NOTE', 5, 'quiet', false) "
        "as t(name, rank, pattern, enabled)"
    )
    enabled = detect.detectors_of(table)
    return t.corpus().select("doc_id", mask_text(F.col("text"), enabled).alias("masked"))


