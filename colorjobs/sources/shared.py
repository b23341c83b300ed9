"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths made inside scratch(), innermost last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """From spark.checkpoint.dir. Where it is unset a local session gets a temporary folder; on a cluster that is an error,
    because the driver's own folder is not seen by executors."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write as Parquet and read back: computed once, no lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def tasks_for(spark: SparkSession, rows: int, each: int = 1_000_000) -> int:
    """Tasks for an exchange of so many rows: as usual, or more, so that what one task holds does not grow with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of fresh_path(); nothing may read it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that cut() made. Nothing may read them any more; other tables are left alone."""
    for t in tables:
        if path := getattr(t, "_cut_at", None):
            discard(t.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What cut() and fresh_path() make inside is deleted at the end; results must be written or read by then, and a table
    that is to stay is cut outside, or named by keep()."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            discard(spark, path)


def keep(table: DataFrame) -> DataFrame:
    """A table of cut() that outlives the scratch() it was made in; one that encloses it takes it over."""
    for depth, made in enumerate(_open):
        if table._cut_at in made:
            made.remove(table._cut_at)
            if depth:
                _open[depth - 1].append(table._cut_at)
            break
    return table
