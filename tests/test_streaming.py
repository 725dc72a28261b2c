"""Streams: a later start takes only what is new, and totals go on."""

from pyspark.sql import functions as F

from veiltext.functions.mask import mask_text
from veiltext.operators.counts import item_table
from veiltext.streaming import live, quarantine

SCHEMA = "doc_id long, file_name string, text string"


def test_restart_goes_on_and_equals_batch(spark, tmp_path):
    land, out, totals = (str(tmp_path / n) for n in ("in", "out", "totals"))
    rows = [(i, "a.txt", f"user{i}@x.org from 10.0.0.{i} or 555-123-{i:04d}") for i in range(20)]
    rows.append((20, "b.txt", None))  # a bad row among good ones
    for part in (rows[:12], rows[12:]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(land)
        stream = spark.readStream.schema(SCHEMA).parquet(land)
        live.start_cleanse(stream, out, str(tmp_path / "s1")).awaitTermination()
        live.start_counters(stream, totals, str(tmp_path / "s2")).awaitTermination()
    batch = spark.read.parquet(land)
    want = {(r.doc_id, r.m) for r in batch.select("doc_id", mask_text(F.col("text")).alias("m")).collect()}
    got = [(r.doc_id, r.cleaned_text) for r in spark.read.parquet(out).collect()]
    assert len(got) == 21 and set(got) == want
    bad = spark.read.parquet(out).filter("status = 'failed'").collect()
    assert [r.doc_id for r in bad] == [20]
    assert {tuple(r) for r in live.latest_counts(spark, totals).collect()} == {
        tuple(r) for r in item_table(batch).groupBy("type").count().collect()}


def test_crash_between_batches_keeps_the_last_totals(spark, tmp_path):
    """A batch that died half-way has left no readable folder; running it again gives the totals."""
    land, totals, state = (str(tmp_path / n) for n in ("in", "totals", "state"))
    for i in range(4):
        spark.createDataFrame([(i, "a.txt", f"a{i}@x.org b{i}@x.org")], SCHEMA).coalesce(1).write.mode(
            "append").parquet(land)
    stream = live.document_stream(spark, land, files_per_batch=1)
    live.start_counters(stream, totals, state).awaitTermination()
    assert len([p for p in (tmp_path / "totals").iterdir() if p.name.startswith("batch=")]) >= 4
    assert live.latest_counts(spark, str(tmp_path / "nothing")).count() == 0
    (tmp_path / "totals" / "batch=99" / "_temporary").mkdir(parents=True)
    assert [tuple(r) for r in live.latest_counts(spark, totals).collect()] == [("EMAIL_ADDRESS", 8)]
    live.start_counters(stream, totals, state).awaitTermination()
    assert [tuple(r) for r in live.latest_counts(spark, totals).collect()] == [("EMAIL_ADDRESS", 8)]


def folders(path):
    return sorted(p.name for p in path.iterdir() if p.name.startswith("batch="))


def test_totals_do_not_pile_up(spark, tmp_path):
    """Many batches leave a bounded number of folders, and the newest totals are read."""
    out = str(tmp_path / "totals")
    for number in range(60):
        totals = spark.createDataFrame([("EMAIL_ADDRESS", number)], "type string, items bigint")
        live.write_totals(totals, number, out, keep=3)
    assert folders(tmp_path / "totals") == [f"batch={n}" for n in range(56, 60)]
    assert [tuple(r) for r in live.latest_counts(spark, out).collect()] == [("EMAIL_ADDRESS", 59)]


def test_a_crash_at_any_step_keeps_whole_totals(spark, tmp_path, monkeypatch):
    """Each call to the store fails once: readers see the last or the new totals, and a rerun mends it."""
    def totals(n):
        return spark.createDataFrame([("EMAIL_ADDRESS", n)], "type string, items bigint")

    for fail_at in range(1, 7):
        out = str(tmp_path / f"at{fail_at}")
        for number in range(3):
            live.write_totals(totals(number), number, out, keep=1)
        calls = 0

        def failing(step):
            def call(*given):
                nonlocal calls
                calls += 1
                if calls == fail_at:
                    raise OSError("store is gone")
                return step(*given)
            return call

        with monkeypatch.context() as patch:
            for name in ("names_in", "put_mark", "remove"):
                patch.setattr(live, name, failing(getattr(live, name)))
            try:
                live.write_totals(totals(3), 3, out, keep=1)
                assert calls < fail_at
            except OSError:
                pass
        assert live.latest_counts(spark, out).first().items in (2, 3)
        live.write_totals(totals(3), 3, out, keep=1)
        live.write_totals(totals(4), 4, out, keep=1)
        assert live.latest_counts(spark, out).first().items == 4
        assert folders(tmp_path / f"at{fail_at}") == ["batch=3", "batch=4"]


def test_marked_totals_are_not_written_again(spark, tmp_path):
    out = str(tmp_path / "totals")
    for items in (5, 6):
        live.write_totals(spark.createDataFrame([("A", items)], "type string, items bigint"), 0, out)
    assert live.latest_counts(spark, out).first().items == 5


def start_files(spark, tmp_path, per_batch):
    files = quarantine.file_stream(spark, str(tmp_path / "in"), per_batch)
    quarantine.start_file_cleanse(
        files, quarantine.parquet_documents(spark), str(tmp_path / "out"), str(tmp_path / "state")
    ).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out" / "rows"))
    status = spark.read.parquet(str(tmp_path / "out" / "status"))
    return rows, {(r.path.split("/")[-1], r.status) for r in status.collect()}, status


def test_a_broken_file_fails_alone(spark, tmp_path):
    """Broken files among good ones, and again after a restart: all good rows, one row per broken file."""
    land = tmp_path / "in"
    rows = [(i, f"f{i}.txt", f"user{i}@x.org or 555-123-{i:04d}") for i in range(40)]
    spark.createDataFrame(rows[:24], SCHEMA).repartition(6).write.parquet(str(land))
    good = sorted(p.name for p in land.iterdir() if p.suffix == ".parquet")
    (land / "broken.parquet").write_bytes(b"PAR1 this is not a table PAR1")
    (land / "empty.parquet").write_bytes(b"")
    cut = land / "part-cut.parquet"
    cut.write_bytes((land / good[0]).read_bytes()[:-40])
    found, status, _ = start_files(spark, tmp_path, 4)
    bad = {"broken.parquet", "part-cut.parquet"}
    assert status == {(n, "cleansed") for n in good} | {(n, "failed") for n in bad}
    assert found.count() == 24

    more = tmp_path / "more"
    spark.createDataFrame(rows[24:], SCHEMA).repartition(2).write.parquet(str(more))
    for p in more.glob("*.parquet"):
        p.rename(land / f"second-{p.name}")
    (land / "late.parquet").write_bytes(b"nothing")
    found, status, table = start_files(spark, tmp_path, 4)
    assert ("late.parquet", "failed") in status and len(status) == len(good) + 5
    want = {(i, m) for i, m in spark.createDataFrame(rows, SCHEMA).select("doc_id", mask_text(F.col("text"))).collect()}
    assert {(r.doc_id, r.cleaned_text) for r in found.collect()} == want and found.count() == 40
    errors = [r.error for r in table.filter("status = 'failed'").collect()]
    assert len(errors) == 3 and all(errors)
    assert {tuple(r) for r in quarantine.outcome_counts(spark, str(tmp_path / "out")).collect()} == {
        ("cleansed", len(good) + 2), ("failed", 3)}


def test_only_broken_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.parquet").write_bytes(b"x")
    found, status, _ = start_files(spark, tmp_path, 4)
    assert found.count() == 0 and status == {("a.parquet", "failed")}


def test_a_batch_is_run_again_with_the_same_files(spark, tmp_path):
    """A crash behind the rows and before the status: the rerun replaces both."""
    spark.createDataFrame([(1, "a.txt", "a@b.org")], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    read = quarantine.parquet_documents(spark)
    paths = [str(p) for p in (tmp_path / "in").glob("*.parquet")]
    assert quarantine.cleanse_files(paths, read, str(tmp_path / "out" / "rows" / "batch=0")) == {}
    found, status, _ = start_files(spark, tmp_path, 4)
    assert found.count() == 1 and len(status) == 1


def test_other_errors_end_the_batch(spark):
    import pytest

    def read(paths):
        return spark.range(3).select(F.raise_error(F.lit("worker out of order")).alias("x"))

    with pytest.raises(Exception, match="out of order"):
        quarantine.unreadable(["a", "b"], read)


def test_halving_finds_every_bad_file(spark):
    """Any set of bad files, with as many reads as halving needs."""
    import random

    rng = random.Random(2)
    names = [f"f{i}" for i in range(37)]
    for count in (0, 1, 2, 5, 37):
        bad = set(rng.sample(names, count))
        reads = []

        def read(paths):
            reads.append(tuple(paths))
            if bad & set(paths):
                return spark.range(1).select(F.raise_error(F.lit("FAILED_READ_FILE x")).alias("x"))
            return spark.range(0)

        assert set(quarantine.unreadable(names, read)) == bad
        assert len(reads) <= 1 + 2 * 6 * count
