"""The registered queries: their SQL, the shape of their results, and the pipeline."""

import itertools
import sys
from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pyspark.sql import functions as F

from veiltext import session
from veiltext.llm import jaccard, mixing, pii, quality
from veiltext.llm import queries as llm
from veiltext.llm.batches import numbered
from veiltext.session import stored

from .test_pairs import plain_groups

TABLES = ("documents", "embeddings", "pages", "labels", "benchmark")


def values(rows):
    return Counter(tuple(str(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_oracle(spark, folder, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    found = llm.queries()[name](spark, folder)
    columns = sorted(found.columns)
    cursor = db.execute(llm.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    rows = cursor.fetchall()
    want = [tuple(row[names.index(c)] for c in columns) for row in rows]
    assert values(found.select(*columns).collect()) == values(want)


def test_names():
    assert [f"op{n}" for n in range(1, 14)] == [name.split("_")[0] for name in llm.queries()]
    assert {"pipeline", *llm.queries()} <= set(entry.queries())


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What each stage is given and returns."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, stored(stage(spark, docs, folder))
        out[name] = (given, docs)
    return out


def test_stage_names(stages):
    assert list(stages) == [
        "quality rules", "n-gram Jaccard join", "PII", "mixing sources to target weights", "best-fit packing",
    ]
    for name, (given, out) in list(stages.items())[:-1]:
        assert out.dtypes == given.dtypes, name


def test_quality_stage(spark, folder, stages):
    given, out = stages["quality rules"]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    keep = {r.doc_id for r in quality.judged(given, labels).collect() if r.kept}
    assert {r.doc_id for r in out.collect()} == keep


def test_duplicate_stage(stages):
    given, out = stages["n-gram Jaccard join"]
    groups = plain_groups([(r.doc_id, r.text) for r in given.collect()], 5, 4, 5)
    assert {str(r.doc_id) for r in out.collect()} == {c for _, _, c in groups}


def test_pii_stage(stages):
    given, out = stages["PII"]
    want = {r.doc_id: pii.redact(r.text) for r in given.collect()}
    rows = out.collect()
    assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


def test_mixing_stage(stages):
    given, out = stages["mixing sources to target weights"]
    texts = {r.doc_id: r.text for r in given.collect()}
    rows = out.collect()
    count = Counter(r.doc_id for r in rows)
    assert max(count.values()) <= 2 and all(texts[r.doc_id] == r.text for r in rows)


def test_packing_stage(stages):
    given, out = stages["best-fit packing"]
    rows = out.collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in given.collect())
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


def test_run(spark, folder, stages):
    found = corpus_pipeline.run(spark, folder).count()
    assert found == stages["best-fit packing"][1].count()


def test_odd_documents_pass(spark, odd, tmp_path):
    """Nulls, empty and repeated rows and clashing columns go through all stages."""
    labels = "doc_id bigint, quality int, toxic int"
    spark.createDataFrame([(4, 1, 0), (6, 1, 0), (8, 0, 0), (None, None, None)], labels).write.parquet(
        str(tmp_path / "labels.parquet")
    )
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)))
    assert docs.count() > 0
    docs = odd.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)))
    assert docs.count() == 0


def test_rows_of_files_have_numbers_of_their_own(spark, docs, tmp_path):
    """Numbers come from the rows' places in files, whatever is read with them, and copy nothing."""
    many = spark.createDataFrame([(None, "same")] * 500, "doc_id bigint, text string")
    many.repartition(7).write.parquet(str(tmp_path / "many"))
    read = spark.read.parquet(str(tmp_path / "many"))
    rows, name = numbered(read)
    assert rows.columns == ["doc_id", "text", name] and rows.select(name).distinct().count() == 500
    again, same = numbered(spark.read.parquet(str(tmp_path / "many")))
    assert same == name and again.join(rows.select(name), name).count() == 500
    clashing, free = numbered(read.withColumn("_row_no", F.lit(7)))
    assert free not in ("_row_no", *read.columns) and clashing.filter("_row_no = 7").count() == 500
    stored_rows, name = numbered(many)
    assert stored_rows.select(name).distinct().count() == 500
    empty, name = numbered(read.filter("false"))
    assert empty.count() == 0


def test_a_column_named_like_the_number_stays(spark, odd, tmp_path):
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 0)], "doc_id bigint, quality int, toxic int")
    odd.select("doc_id", "text", "source", F.lit(77).alias("_row_no")).write.parquet(str(tmp_path / "odd"))
    read = spark.read.parquet(str(tmp_path / "odd"))
    for out in (quality.kept_documents(read, labels), jaccard.one_of_each(read), mixing.mixed_documents(read)):
        assert out.columns == read.columns and out.count() > 0
        assert {r._row_no for r in out.collect()} == {77}


def test_stages_leave_no_scratch_behind(spark, folder, tmp_path, monkeypatch):
    """What a stage stored on its way is gone when the next has begun."""
    numbers = itertools.count()
    for module in (session, corpus_pipeline):
        monkeypatch.setattr(module, "shared_folder", lambda _: f"{tmp_path}/scratch/{next(numbers)}")
    assert corpus_pipeline.run(spark, folder).count() > 0
    # The last stage's input, and what the last stage stored.
    assert len(list((tmp_path / "scratch").iterdir())) <= 12 < next(numbers)


def test_library_stands_alone():
    """Nothing outside the subpackage imports it, but for the entry's guard."""
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for path in [*root.glob("veiltext/**/*.py"), *root.glob("tests/*.py"), root / "bench.py"]:
        if "llm" not in path.parts:
            assert "veiltext.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
    assert "veiltext.llm" in sys.modules
