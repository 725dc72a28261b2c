"""Golden vectors: known inputs and their results."""

import pytest
from pyspark.sql import functions as F

from veiltext.functions import cleanse, detect, insight, mask, naming, spans, text
from veiltext.sources.files import decode_lossy

T = F.col("t")


def run(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_span_masking(spark):
    cases = {
        "Call +1 (743) 555-3824 now": "Call +[REDACTED_PHONE] now",
        "card 4111 1111 1111 1111": "card [REDACTED_ID] 1111",
        "4111-1111-1111-1111": "[REDACTED_ID]-1111",
        "ssn 123-45-6789, id 1234 5678 9012": "ssn [REDACTED_ID], id [REDACTED_ID]",
        "mail a.b@x.co.uk.": "mail [REDACTED_EMAIL].",
        "1234567890": "[REDACTED_PHONE]",
        "123456789012": "[REDACTED_PHONE]",
        "éjohn@x.com": "éjohn@x.com",
        "a@b.com 555-123-4567 a@b.com": "[REDACTED_EMAIL] [REDACTED_PHONE] [REDACTED_EMAIL]",
        "": "",
    }
    assert run(spark, list(cases), mask.mask_text(T)) == list(cases.values())


def test_offsets_are_code_points(spark):
    rows = ["😀 a@b.com é 555-123-4567"]
    found = run(spark, rows, spans.public_spans(spans.resolve_overlaps(spans.detect_ranked(T))))[0]
    assert [(s.entity, s.start, s.end) for s in found] == [("EMAIL", 2, 9), ("PHONE", 12, 24)]
    assert all(rows[0][s.start:s.end] == s.text for s in found)


def test_value_masking(spark):
    cases = {
        "cam rtsp://10.0.0.5:RTSP up": "cam [IP_ADDRESS] up",
        "999.1.1.1": "9[IP_ADDRESS]",
        "1.1.1.300": "[IP_ADDRESS]0",
        "10.0.0.0/24": "[IP_ADDRESS]",
        "v1.2.3.4.5": "v[IP_ADDRESS].5",
    }
    assert run(spark, list(cases), mask.mask_by_value(T)) == list(cases.values())


def test_cleanse_chain_once_and_twice(spark):
    cases = [
        ("Global Tech Solutions and Acme Corporation", "",
         "[CLIENT TERM] [CLIENT TERM] [CLIENT TERM] and [CLIENT TERM] [CLIENT TERM]",
         "[[CLIENT TERM] TERM] [[CLIENT TERM] TERM] [[CLIENT TERM] TERM] and "
         "[[CLIENT TERM] TERM] [[CLIENT TERM] TERM]"),
        ("Zenith report for zenith", "Zenith.txt",
         "[[CLIENT TERM] NAME] report for [[CLIENT TERM] NAME]",
         "[[[CLIENT TERM] TERM] NAME] report for [[[CLIENT TERM] TERM] NAME]"),
        ("on 12/31/2024 from 10.1.2.3", "x.txt", "on [DATE] from [IP ADDRESS]", None),
        ("at 12 Main St, Springfield, IL 62704-1234 ok", "",
         "at 12 Main St, Springfield, IL [SSN] ok", None),
        ("12 main st il 62704", "", "[ADDRESS]", None),
        ("AB1234567 A12345678 00:1A:2B:3C:4D:5E", "",
         "[DRIVER LICENSE] [PASSPORT] [MAC ADDRESS]", None),
        ("x@y.c|m 555.123.4567", "", "[EMAIL] [PHONE]", None),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, t string, n string")
    chain = cleanse.cleanse_text(T, F.col("n"))
    once = [r.t for r in df.select("i", chain.alias("t")).orderBy("i").collect()]
    assert once == [c[2] for c in cases]
    again = df.withColumn("t", chain).select("i", chain.alias("t")).orderBy("i").collect()
    assert [r.t for r in again] == [c[3] or c[2] for c in cases]


def test_client_name_is_literal(spark):
    df = spark.createDataFrame(
        [("see a.b(c) and A.B(C)d", "dir/a.b(c).txt"), ("axb(c", "a.b(c).txt"), ("abc", "abc.txt"),
         ("x \\E.y", "x \\E.y.txt"), (".bashrc", ".bashrc")], "t string, n string")
    out = [r[0] for r in df.select(cleanse.cleanse_client_name(T, F.col("n"))).collect()]
    assert out == ["see [CLIENT NAME] and [CLIENT NAME]d", "axb(c", "abc", "[CLIENT NAME]",
                   "[CLIENT NAME]"]


def test_unicode_word_boundaries(spark):
    rows = ["policy été role naïve"]
    assert run(spark, rows, insight.security_matches(T, "iam_policies")) == [["policy été", "role naïve"]]
    assert run(spark, ["éclient client"], cleanse.cleanse_client_terms(T)) == ["éclient [CLIENT TERM]"]


def test_case_twins_pass_the_word_test(spark):
    rows = ["riſk level", "mİn length", "mın age", "RISK LEVEL"]
    found = run(spark, rows, F.concat(insight.security_matches(T, "vulnerabilities"),
                                      insight.security_matches(T, "password_policies")))
    assert found == [["riſk level"], ["mİn length"], ["mın age"], ["RISK LEVEL"]]


def test_normalize(spark):
    rows = ["　a\tb  c \r\nd\r\re\n\n\n\nf  ", "x y", " \t ", "a \t b"]
    assert run(spark, rows, text.normalize_text(T)) == ["a b c \nd\n\ne\n\nf", "x y", "", "a b"]


def test_description_and_findings(spark):
    rows = ["One. Two! Three?", "  ", "A paper trail with a timestamp, aes and a firewall; mfa, policy.",
            "This sentence is certainly longer than that. Short. And here is another long\nsentence now."]
    assert run(spark, rows, insight.description(T))[:2] == [
        "One. Two!", "No readable text found after extraction."]
    pad = "Additional review recommended to derive more domain-specific insights."
    found = run(spark, rows, insight.key_findings(T))
    assert found[0] == ["No significant themes were detected from extracted content.", pad, pad]
    assert len(found[2]) == 5 and found[2][0] == "Manual processes may introduce operational errors."
    assert found[3] == [
        "Highlights: This sentence is certainly longer than that.",
        "Highlights: And here is another long sentence now.", pad]


def test_labels_and_persons(spark):
    rows = [" time in ", "x", "MAY", "Ada", "123", "cadence", "I"]
    assert run(spark, rows, detect.is_structural_label(T)) == [True, False, True] + [False] * 4
    assert run(spark, rows, detect.is_person_name(T)) == [False, False, False, True, False, False, False]


def test_cells(spark):
    rows = [" a@b.com ", "  ", " Time In ", " plain ", None]
    assert run(spark, rows, mask.mask_cell_by_value(T)) == [
        "[EMAIL_ADDRESS]", "  ", " Time In ", " plain ", None]


def test_names(spark):
    rows = ["A.B.TXT", "noext", ".hidden", "dir/x.y.Pdf", "a..b"]
    assert run(spark, rows, naming.file_type(T)) == ["txt", "", "", "pdf", "b"]
    assert run(spark, rows, naming.compound_suffix(T)) == [".b.txt", "", "", ".y.pdf", "..b"]
    assert run(spark, rows, naming.is_allowed(T)) == [True, False, False, True, False]
    assert run(spark, rows, naming.stem(T)) == ["A.B", "noext", ".hidden", "x.y", "a."]


@pytest.mark.parametrize("raw", [b"ok\r\nline", b"a\xffb\xe2\x82c", "a�b\xe9".encode(), b"\xf0\x9f\x98x", b""])
def test_lossy_decoding(spark, raw):
    df = spark.createDataFrame([(bytearray(raw),)], "c binary")
    wanted = raw.decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n")
    assert df.select(decode_lossy(F.col("c"))).first()[0] == wanted
