"""What keeps the work per row small changes no result, and rows reach all cores."""

from pyspark.sql import functions as F

from veiltext import rules
from veiltext.functions import cleanse, spans
from veiltext.functions.detect import matches
from veiltext.operators import dictionary
from veiltext.operators.dictionary import dictionary_spans
from veiltext.plans.tables import Tables

TEXTS = [
    "éb@x.com b@x.com", "b@x.com b@x.com.", "a@b.com 555-123-4567 a@b.com", "aaa@a.aa aaaa@a.aa", "", None,
    "call 555-123-4567, 1555-123-4567 or 5551234567", "999.1.1.1 http://1.1.1.1/24 RTSP://10.0.0.1:RTSP H.1.1.1.1",
    "\U0001f600 a@b.co \U0001f600 c@d.eu", "x" * 70 + " x@y.org", " ".join(f"u{i}@m.org" for i in range(40)),
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111 1111 1111 1111", "1/2/2024 11/2/2024 12345678901234",
]


def by_split(text, detector):
    """Spans from the text between matches, without looking for a match's text."""
    def step(at, pair):
        begin = at + F.length(pair["gap"])
        span = spans.ranked_span(begin, begin + F.length(pair["hit"]), 1, detector.entity, pair["hit"], "regex")
        return begin + F.length(pair["hit"]), span, pair["hit"].isNotNull()

    pairs = spans.with_gaps(text, matches(text, detector.search), detector.search)
    return spans.scan(pairs, F.lit(0), spans.RANKED, step)


def test_matches_looked_up_by_their_text_have_the_same_places(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for d in rules.SPAN_DETECTORS + rules.VALUE_DETECTORS:
        plain = d._replace(luhn=False, mail=False)._replace(first="", pattern=d.search)
        got = df.select(spans.detect_ranked(F.col("t"), [plain]).alias("a"), by_split(F.col("t"), d).alias("b")).collect()
        assert all(r.a == (r.b or []) for r in got), d.entity


def test_a_text_that_occurs_twice_is_not_looked_up(spark):
    rows = [("ab ab", ["ab"]), ("ab a", ["ab"]), ("aaa", ["aa"]), ("ab", []), ("b", ["b"])]
    df = spark.createDataFrame(rows, "t string, h array<string>")
    assert [r[0] for r in df.select(spans.occur_once(F.col("t"), F.col("h"))).collect()] == [
        False, True, False, True, True]


def test_replaced_one_by_one_or_by_split(spark):
    rows = [("éb@x.com b@x.com",), ("a@b.com c@d.com",), ("a@b.com a@b.com",), (None,), ("no @ here",)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(cleanse.cleanse_email(F.col("t"))).collect()] == [
        "éb@x.com [EMAIL]", "[EMAIL] [EMAIL]", "[EMAIL] [EMAIL]", None, "no @ here"]


def test_few_and_many_names_give_the_same_spans(spark, monkeypatch):
    names = spark.createDataFrame([("Ada",), ("Ada Lovelace",), ("J. R. Smith",)], "name string")
    docs = spark.createDataFrame(
        [(1, "ADA  lovelace met j. r. smith"), (2, "Adam"), (3, " ".join(["Ada"] * 30)), (4, None)],
        "doc_id long, text string")
    assert sorted(dictionary.few_beginnings(dictionary.name_keys(names))) == [("ada", 1), ("ada", 2), ("j", 3)]
    few = sorted(map(tuple, dictionary_spans(docs, names, "PERSON", "names").collect()))
    monkeypatch.setattr(dictionary, "FEW_WORDS", 0)
    monkeypatch.setattr(dictionary, "FEW_FOUND", 0)
    assert few == sorted(map(tuple, dictionary_spans(docs, names, "PERSON", "names").collect()))
    assert len(few) == 33


def test_a_file_of_many_rows_is_dealt_out(spark, tmp_path):
    spark.range(60_000).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(50).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    t = Tables(spark, str(tmp_path))
    dealt = t.read("orders")
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 3 and max(sizes) < 25_000 and dealt.distinct().count() == 60_000
    assert t.read("customer").rdd.getNumPartitions() == 1
