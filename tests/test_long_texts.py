"""E-mail search on long runs: the same finds as the plain pattern, in linear time; CSV round trips."""

import random
import time

from pyspark.sql import functions as F

from veiltext import rules
from veiltext.functions import cleanse, detect, mask, sql
from veiltext.functions.mask import mask_by_value, mask_spans, mask_text
from veiltext.functions.spans import scan
from veiltext.sources import files, sinks


def runs(seed, count):
    rng = random.Random(seed)
    bits = ["a", "-", ".", "@", "b.co", " ", "x@y.org", "_", "%", "é", "a-" * 40, "b" * 70, "@c.de", "|"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(count)]


def test_same_addresses_as_the_plain_pattern(spark):
    rows = spark.createDataFrame([(t,) for t in runs(1, 3000)], "text string")
    text = F.col("text")
    detector = detect.by_name("EMAIL")
    plain = detector._replace(mail=False)
    got = rows.select(
        detect.found(text, detector).alias("a"), detect.found(text, plain).alias("b"),
        cleanse.cleanse_email(text).alias("c"),
        F.regexp_replace(text, rules.CLEANSE_EMAIL, "[EMAIL]").alias("d"),
        mask_text(text, (detector,)).alias("e"), mask_text(text, (plain,)).alias("f"), "text",
    )
    bad = got.filter("a <> b or c <> d or e <> f").collect()
    assert not bad
    assert got.filter("size(a) > 0").count() > 500
    sql.register(spark)
    rows.createOrReplaceTempView("runs_of_text")
    both = spark.sql("select mask_pii(text) as m, cleanse_text(text) as c, text from runs_of_text")
    assert both.filter(F.col("m") != mask_spans(text)).count() == 0
    assert both.filter(F.col("c") != cleanse.cleanse_text(text)).count() == 0


def seconds(spark, text, step):
    frame = spark.createDataFrame([(text,)], "text string")
    begin = time.perf_counter()
    frame.select(step(F.col("text")).alias("x")).collect()
    return time.perf_counter() - begin


def test_long_runs_take_linear_time(spark):
    for step in (cleanse.cleanse_email, mask_text):
        seconds(spark, "a-" * 1000 + " a@b.org", step)
        short = seconds(spark, "a-" * 100_000 + " a@b.org", step)
        long = seconds(spark, "a-" * 200_000 + " a@b.org", step)
        assert long < 3 * short + 2, (short, long)


def test_csv_keeps_values(spark, tmp_path):
    values = ["  lead", " tail ", "  ", None, "x\ty ", 'q"uote', "a,b", "line\nend", "line\r\nend", "'", "\\", '\\"']
    rows = [(str(i), v, "z") for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "k string, v string, z string")
    sinks.write_masked_csv(frame, str(tmp_path / "csv"))
    back = files.read_csv_docs(spark, str(tmp_path / "csv"), multi_line=True)
    assert {tuple(r) for r in back.collect()} == set(rows)
    plain = frame.filter("v not like '%\n%' or v is null")
    sinks.write_masked_csv(plain, str(tmp_path / "plain"))
    assert {tuple(r) for r in files.read_csv_docs(spark, str(tmp_path / "plain")).collect()} == {
        tuple(r) for r in plain.collect()
    }


def test_many_values_equal_the_ordered_replacement(spark, monkeypatch):
    """Values that contain, cross or start one another, that stand elsewhere, or that are in a tag."""
    rng = random.Random(7)
    bits = ["a@b.org", "555-123-4567", "123-45-6789", " ", "x", "10.0.0.1", "1/2/2024", "4111 1111 1111 1111",
            ",", "mail ", "[EMAIL]", "AI ", "a@b.org.uk", "555-123-45678", "AB", "\n", "é", "12", "@", "-", "a@b.or"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    text = F.col("text")
    detectors = rules.VALUE_DETECTORS
    monkeypatch.setattr(mask, "BLOCK", 8)
    many = mask._replace_many(text, mask.detect_ranked(text, detectors))
    # Values of any kind, as names are: short ones, and those that a tag holds.
    names = F.expr("filter(array('AI', 'a@', 'b', 'EMAIL', '[', 'a@b.org', 'mail ', 'x'), v -> contains(text, v))")
    spans = F.transform(names, lambda v, i: F.struct(
        (F.instr(text, v) - 1).alias("start"), (i % 2).alias("rank"), F.concat(F.lit("T"), i % 3).alias("entity"), v.alias("text")
    ))
    ordered = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(
        s["rank"], s["start"], s["text"], s["entity"].alias("type")
    ))), lambda s: F.struct(s["text"], s["type"]))
    bad = rows.select(
        "text", many.alias("a"), mask.replace_values(text, mask.value_items(text, detectors)).alias("b"),
        mask._replace_many(text, spans).alias("c"), mask.replace_values(text, ordered).alias("d"),
    ).filter("a <> b or c <> d").collect()
    assert not bad, bad[:2]


def findings(n):
    return " ".join(
        f"Mail user{i}@mail{i % 7}.example.org, or call 555-{i % 900 + 100}-{i % 10000:04d}! Lorem ipsum\n" for i in range(n // 2)
    )


def test_many_findings_take_near_linear_time(spark):
    sql.register(spark)
    steps = (mask_by_value, mask_text, lambda t: F.call_function("mask_pii", t))
    for step in steps:
        seconds(spark, findings(2000), step)
        short = seconds(spark, findings(8000), step)
        long = seconds(spark, findings(16000), step)
        assert long < 2.5 * short + 2, (short, long)


def test_scan_keeps_order_over_blocks(spark):
    for n in (0, 1, 63, 64, 65, 1000, 5000):
        row = spark.range(1).select(F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.when(i < n, i))).alias("a"))
        out = row.select(scan(F.col("a"), F.lit(0), "array<int>", lambda s, x: (s + x, s + x, x % 3 != 0))).first()[0]
        total, want = 0, []
        for x in range(n):
            total += x
            want += [total] if x % 3 else []
        assert out == want
