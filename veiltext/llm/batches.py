"""How much of a table a Python worker holds at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import TypeVar

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veiltext.session import stored

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BYTES = 4 << 20
T = TypeVar("T")
ROW = "_row_no"


def small_batches(spark: SparkSession) -> None:
    """Bound batches handed to Python by bytes, unless the session has a smaller bound.

    The other bound, a number of rows, lets a batch of very long texts grow to gigabytes.
    """
    held = spark.conf.get(SETTING, None)
    text = str(held or "").lower().rstrip("b")
    if not text.isdigit() or int(text) > BYTES:
        spark.conf.set(SETTING, str(BYTES))


_held: dict[str, object] = {}


def remembered(name: str, make: Callable[[], T]) -> T:
    """What a worker remembers from task to task: one thing at a time.

    Workers serve the tasks of many stages; if each stage's memory stayed, they would add up.
    """
    if name not in _held:
        forget()
        _held[name] = make()
    return _held[name]


def forget() -> None:
    """Give back what a worker has kept from earlier stages: its memory of words, and Arrow's buffers."""
    _held.clear()
    pa.default_memory_pool().release_unused()


def few_keys(keys: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """A stored table of keys, one number or a little more a row: broadcast up to `limit` rows, so
    that what it joins stays where it is; beyond that a plain side of a shuffled join."""
    return F.broadcast(keys) if keys.count() <= limit else keys


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, each with a number of its own, and the name of the number's column.

    Keys may be null or shared, so what is decided about a row is carried by its number. Rows that are
    read from files have a place already: the number is made of a hash of the file's name, with as many
    bits as the rows' places leave (the hash is seeded anew until no two files share one), and of the
    row's place in the file. Read again, or after a lost task, a row has the same one, and nothing is
    copied. Other rows are stored once with numbers. The name is one that `docs` doesn't have.
    """
    name = ROW
    while name in docs.columns:
        name += "_"
    try:
        path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
        # One row per file; neither texts nor other columns are read.
        files = stored(docs.select(path.alias("path"), place.alias("place")).groupBy("path").agg(
            F.max("place").alias("last")
        ))
    except AnalysisException:
        return stored(docs.withColumn(name, F.monotonically_increasing_id())), name
    count, last = files.agg(F.count(F.lit(1)), F.max("last")).first()
    bits = max((last or 0).bit_length(), 1)
    seed = 0

    def file_no(file: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(file, F.lit(seed)), bits + 1)

    while files.select(file_no(F.col("path"))).distinct().count() < count:
        seed += 1
    number = F.shiftleft(file_no(path), bits).bitwiseOR(place)
    return docs.select("*", number.alias(name)), name


def annotated(docs: DataFrame, find: Callable[[list[str]], list], found: str,
              keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The keys of each row with the columns `found` that `find` gives for a list of texts.

    A null text is handed over as an empty one. Keys pass through as they are, whatever their type.
    """
    small_batches(docs.sparkSession)
    given = ", ".join(f"{key} {docs.schema[key].dataType.simpleString()}" for key in keys)
    columns = StructType.fromDDL(found).names

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column(len(keys)).to_pylist()]
            values = find(texts) if texts else [[] for _ in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, values)], [*keys, *columns])

    return docs.select(*keys, "text").mapInArrow(step, f"{given}, {found}")
