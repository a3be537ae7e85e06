"""Reading inputs and keeping intermediate tables in the shared folder."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.session import shared_folder

Batches = Iterator[pa.RecordBatch]

_noted: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and
    an executor lost later costs nothing but the tasks it was running."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(df.sparkSession)
    if _noted:
        _noted[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables; nothing that is still to run may read them."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def done_with(df: DataFrame) -> None:
    """Delete a stored table that later steps no longer read."""
    discard(df.sparkSession, *{path.rsplit("/", 1)[0] for path in df.inputFiles()})


@contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """Add the paths of the tables stored meanwhile to ``paths``."""
    _noted.append(paths)
    try:
        yield
    finally:
        _noted.pop()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps. It does so when the driver
    collects garbage, which a driver with little to do seldom does on its own."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def narrow(df: DataFrame, **columns: Column | str) -> DataFrame:
    """The named columns only, under the operator's own names; extra columns of the
    input, whatever they are called, stay out of its joins."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def by_batch(function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Batches], Batches]:
    """A ``mapInArrow`` function from one on a single batch."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield function(batch)

    return run
