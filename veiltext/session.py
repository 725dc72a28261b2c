"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_own = ""


def local_session(cpus: int | str = "*", app: str = "veiltext") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    parallel = "8" if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", parallel)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """A new folder under `spark.checkpoint.dir`.

    Where that is unset, a session whose executors are threads of the driver gets a folder that is
    deleted when Python ends; any other session is refused.
    """
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        if not _own:
            _own = tempfile.mkdtemp(prefix="veiltext-")
            atexit.register(shutil.rmtree, _own, ignore_errors=True)
        base = _own
    return f"{base.rstrip('/')}/veiltext-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read from there.

    For a small result of long work that several later steps need: the work is not done again for
    each of them, nor after the loss of an executor.
    """
    path = shared_folder(df.sparkSession)
    for paths in _collecting:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


_collecting: list[list[str]] = []


@contextmanager
def stored_paths() -> Iterator[list[str]]:
    """The folders of all tables that `stored` writes meanwhile, for who wants to remove them later."""
    paths: list[str] = []
    _collecting.append(paths)
    try:
        yield paths
    finally:
        _collecting.remove(paths)



def _place(spark: SparkSession, path: str) -> tuple:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder of any store that Spark writes to; none if there is no such folder."""
    store, place = _place(spark, folder)
    return [entry.getPath().getName() for entry in store.listStatus(place)] if store.exists(place) else []


def put_mark(spark: SparkSession, path: str) -> None:
    """An empty file, and the folders that lead to it."""
    store, place = _place(spark, path)
    store.create(place, True).close()


def remove(spark: SparkSession, path: str) -> None:
    """A file, or a folder with all that is in it, if there is one."""
    store, place = _place(spark, path)
    store.delete(place, True)
