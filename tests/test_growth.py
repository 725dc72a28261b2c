"""What grows with the input stays on the executors, however small the files look."""

import pytest
from pyspark.sql import functions as F

from veiltext import rules
from veiltext.functions.mask import mask_text
from veiltext.operators import counts, dictionary, ocr, ordering
from veiltext.plans import catalog, tables
from veiltext.sources import files
from veiltext.streaming import live


@pytest.mark.parametrize("name", [
    "ocr_bbox_union", "ocr_confident_words", "ocr_match_entities", "ocr_ngrams", "ocr_pick_ngrams",
    "ocr_picked_counts", "ocr_redaction_boxes",
])
def test_ocr_never_broadcasts(spark, folder, name):
    """Tokens and chunks of an image are at least as many as the images."""
    plan = catalog.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_running_index_of_many_chunks_and_missing_keys(spark):
    rows = [("a", o) for o in range(0, 100, 3)] + [("b", 7), ("b", 50), (None, 1), ("c", None)]
    df = spark.createDataFrame(rows, "k string, o bigint")
    got = sorted((r.k, r.o, r.i) for r in ordering.with_running_index(df, "k", "o", "i", size=16).collect())
    assert got == [("a", 3 * i, i) for i in range(34)] + [("b", 7, 0), ("b", 50, 1)]


def test_last_mark_is_carried_over_empty_chunks(spark):
    rows = [("a", 1, None), ("a", 2, 2), ("a", 2, 2), ("a", 40, None), ("a", 70, 70), ("a", 99, None), ("b", 5, 5)]
    df = spark.createDataFrame(rows, "k string, o bigint, m bigint")
    chunked = df.withColumn("_chunk", ordering.chunk_of(F.col("o"), 16))
    got = ordering.with_last_mark(chunked, "k", "o", "m", "island").select("k", "o", "island").collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        ("a", 1, None), ("a", 2, 2), ("a", 2, 2), ("a", 40, 2), ("a", 70, 70), ("a", 99, 70), ("b", 5, 5),
    ], key=str)


WORD = "image_id bigint, word_no bigint, text string, conf int, left int, top int, width int, height int"


def _ocr_rows(spark, texts):
    """Images with gaps of all sizes between their words, one without a key and one without a place."""
    rows = [(image, no, texts[no % len(texts)], 90 - no % 7 * 10, no, None if no % 5 == 0 else 3, 5, 7)
            for image in range(4) for no in sorted({n * n % (7 + 90 * image) for n in range(60)})]
    return spark.createDataFrame(rows + [(None, 1, "x", 99, 1, 1, 1, 1), (3, None, "x", 99, 1, 1, 1, 1)], WORD)


def test_words_move_once_to_their_neighbours(spark):
    """A row of several columns for each word, moved twice, filled the disk."""
    words = _ocr_rows(spark, ["a", "b"])
    with_next = ocr.confident_words(words, ahead=ocr.AHEAD)
    exchanges = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")
                 for df in (with_next, ocr.ngrams(with_next))]
    assert exchanges[0] == exchanges[1]
    assert "following" in with_next.columns and "following" not in ocr.confident_words(words).columns


@pytest.mark.parametrize("chunk", [2, 5, 16, 65_536])
def test_neighbours_ahead_are_those_of_the_dense_numbers(spark, chunk):
    """Across chunks too, some of which have one sure word or none."""
    words = _ocr_rows(spark, ["a", "b,c", " x\n,y ", ",", "1,2", "é"])
    plain = ocr.confident_words(words, chunk)
    ahead = ocr.confident_words(words, chunk, ahead=ocr.AHEAD)
    assert sorted(map(str, ahead.drop("following").collect())) == sorted(map(str, plain.collect()))
    want = sorted(map(str, ocr.ngrams(plain, chunk).collect()))
    assert sorted(map(str, ocr.ngrams(ahead, chunk).collect())) == want and len(want) > 100


def test_short_rows_are_undone(spark):
    schema = "k int, t string, a bigint, u string, b int, d double"
    rows = [(1, "x,1", 5, "u", None, 0.5), (2, None, None, None, -7, None), (3, "", 1 << 62, "", 0, 1.0),
            (None, ",\n é", None, None, None, None), (5, "1", 2, "3", 4, 5.0)]
    df = spark.createDataFrame(rows, schema)
    short, back = ordering.slim(df, "k")
    assert set(short.columns) == {"k", "u", "d", "_row"}
    assert sorted(map(str, back(short).select(*df.columns).collect())) == sorted(map(str, df.collect()))


def test_entities_without_an_image_mark_no_word(spark):
    word = "image_id bigint, word_no bigint, text string, left int, top int, width int, height int"
    words = spark.createDataFrame([
        (1, 0, "Ada,", 0, 0, 9, 9), (1, 1, "Ada,", 0, 0, 9, 9), (1, 2, "Bob", 0, 0, 9, 9), (None, 3, "Bob", 0, 0, 9, 9),
        (None, 4, "a@mail.org", 0, 0, 9, 9), (2, 5, "Ada", 0, 0, 9, 9),
    ], word)
    found = spark.createDataFrame([(1, "Ada Lovelace"), (1, "ada"), (None, "Bob")], "image_id bigint, text string")
    got = sorted((r.word_no, r.text) for r in ocr.match_entities(words, found).collect())
    assert got == [(0, "Ada,"), (1, "Ada,"), (4, "a@mail.org")]


def test_few_files_a_core_are_dealt_out(spark, tmp_path, monkeypatch):
    """As many files as cores, or some more, would leave cores idle at the end of heavy work."""
    monkeypatch.setitem(tables.ROWS_A_TASK, "documents", 2)
    cores = spark.sparkContext.defaultParallelism
    for name, parts in (("few", cores), ("many", 4 * cores)):
        docs = spark.range(0, 8 * cores, 1, parts).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    few, many = (tables.Tables(spark, f"{tmp_path}/{name}").read("documents") for name in ("few", "many"))
    assert few.rdd.getNumPartitions() == 4 * cores and few.count() == 8 * cores
    assert "Exchange" not in many._jdf.queryExecution().executedPlan().toString()


def test_a_stream_deals_out_the_rows_of_few_files(spark, tmp_path):
    """One file of many texts is read by one task, but masked by as many as are wanted."""
    land, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = [(i, "a.txt", f"user{i}@x.org") for i in range(60)]
    schema = "doc_id long, file_name string, text string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(land)
    stream = spark.readStream.schema(schema).parquet(land)
    live.start_cleanse(stream, out, f"{tmp_path}/s1", tasks=6).awaitTermination()
    live.start_counters(stream, f"{tmp_path}/totals", f"{tmp_path}/s2", tasks=6).awaitTermination()
    back = spark.read.parquet(out)
    want = spark.read.parquet(land).select("doc_id", mask_text(F.col("text")).alias("m")).collect()
    assert sorted((r.doc_id, r.cleaned_text) for r in back.collect()) == sorted(map(tuple, want))
    assert len(back.inputFiles()) == 6
    assert [tuple(r) for r in live.latest_counts(spark, f"{tmp_path}/totals").collect()] == [("EMAIL_ADDRESS", 60)]


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(80)], "doc_id long, text string")
    docs.write.partitionBy("doc_id").text(f"{tmp_path}/docs")
    held = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        docs = files.read_text_docs(spark, f"{tmp_path}/docs")
        status = spark.sparkContext.statusTracker()
        stages = [s for job in status.getJobIdsForGroup("listing") for s in status.getJobInfo(job).stageIds]
        tasks = [status.getStageInfo(s).numTasks for s in stages]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism < 80
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == held
    assert {(int(r.doc_id), r.text) for r in docs.collect()} == {(i, f"text {i}\n") for i in range(80)}


def test_texts_without_a_first_word_are_not_cut_into_words(spark, monkeypatch):
    words = ["ada", "j", "οδος"]
    texts = ["Ada", "x ada-y", "Adam xAda ada_", "J. R.", "ΟΔΟΣ'Α", "a ΟΔΟΣ", "İada", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r.m for r in df.select("doc_id", dictionary.may_begin(F.col("text"), words).alias("m")).orderBy(
        "doc_id").collect()]
    assert got[:6] == [True, True, False, True, True, True] and got[7:] == [False, None]
    names = spark.createDataFrame([("Ada",), ("J. R.",), ("οδος",)], "name string")
    found = lambda: sorted(map(tuple, dictionary.dictionary_spans(df, names, "PERSON", "n").collect()))
    short = found()
    monkeypatch.setattr(dictionary, "FEW_SOUGHT", 0)
    assert short == found() and len(short) >= 4


def test_items_of_some_types(spark):
    """A number found by two detectors at one place has the first one's type, as among all types."""
    docs = spark.createDataFrame([
        (1, "10.0.0.1 a@x.org 555-123-4567"), (2, "b@x.org"), (3, "4111 1111 1111 1111 on 1/2/2020"), (4, ""),
        (5, None), (5, "10.0.0.1 10.0.0.1"),
    ], "doc_id long, text string")
    every = counts.item_table(docs)
    for d in rules.VALUE_DETECTORS:
        got = counts.item_table(docs, types=[d.entity]).collect()
        want = every.filter(F.col("type") == d.entity).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
    assert counts.item_table(docs, types=[]).count() == 0
