"""Reports as one array, in parts."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from veiltext.sources import sinks

SCHEMA = "doc_id bigint, file_name string, key_findings array<string>"


def whole(path):
    """The parts joined in the order of their names."""
    return json.loads("".join(p.read_text("utf-8") for p in sorted(Path(path).glob("part-*"))))


def test_parts_are_one_array(spark, tmp_path):
    odd = ["a]", "[]", ',"', "line\nend\r\u2028", "\u00e9 \U0001f600", "", None, "\\"]
    rows = [(i, odd[i % len(odd)], [odd[(i + 3) % len(odd)], "x"] if i % 5 else None) for i in range(500)]
    rows += [(7, "same", ["]"])] * 40 + [(None, "no key", []), (None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    path = str(tmp_path / "array")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_report_array(frame, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(Path(path).glob("part-*"))) > 1
    found = whole(path)
    given = [dict(zip(("doc_id", "file_name", "key_findings"), r)) for r in rows]
    text = lambda r: json.dumps(r, sort_keys=True)
    assert sorted(map(text, found)) == sorted(map(text, given))
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in found]
    assert keys == sorted(keys)
    back = sinks.read_report_array(spark, path, SCHEMA)
    assert back.exceptAll(frame).count() == 0 and back.count() == len(rows)


def test_one_report_and_none(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a", ["]"])], SCHEMA)
    for name, part, count in (("one", frame, 1), ("none", frame.filter(F.col("doc_id") > 1), 0)):
        path = str(tmp_path / name)
        sinks.write_report_array(part, path)
        assert len(whole(path)) == count == sinks.read_report_array(spark, path, SCHEMA).count()
