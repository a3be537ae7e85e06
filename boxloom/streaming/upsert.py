"""Saving a stream's results so that a restart neither repeats nor loses one.

Each micro-batch is a table of its own, written under its number, and then a line in a
ledger with what was observed while it was written. A batch that is in the ledger is not
written again; one that was interrupted before that is written anew over its remains. So
however often a query is stopped and started from its checkpoint, every batch counts once,
and later results of an item replace earlier ones when the store is read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from boxloom.sources.folder import _uri

LEDGER = "batch bigint, processed bigint, failed bigint, total bigint"


class ResultStore:
    """Results below ``folder``; ``status`` tells failed ones, as ``error``."""

    def __init__(self, folder: str) -> None:
        self.folder = _uri(folder)

    def _in_ledger(self, batch: int) -> bool:
        files, base = fs.FileSystem.from_uri(self.folder)
        return files.get_file_info(f"{base}/ledger/batch={batch}/_SUCCESS").is_file

    def save(self, results: DataFrame, batch: int) -> None:
        """Save one micro-batch, once; for ``foreachBatch``."""
        if self._in_ledger(batch):
            return
        seen = Observation()
        failed = F.count_if(F.col("status") == "error")
        observed = results.observe(
            seen, (F.count(F.lit(1)) - failed).alias("processed"), failed.alias("failed"), F.count(F.lit(1)).alias("total")
        )
        observed.write.mode("overwrite").parquet(f"{self.folder}/results/batch={batch}")
        counts = seen.get
        line = results.sparkSession.createDataFrame(
            [(counts["processed"], counts["failed"], counts["total"])], "processed bigint, failed bigint, total bigint"
        )
        line.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch}")

    def ledger(self, spark: SparkSession) -> DataFrame:
        """``batch, processed, failed, total`` of every finished micro-batch: the progress
        of the stream so far."""
        files, base = fs.FileSystem.from_uri(self.folder)
        if not files.get_file_info(fs.FileSelector(f"{base}/ledger", allow_not_found=True)):
            return spark.createDataFrame([], LEDGER)
        return spark.read.schema(LEDGER).option("basePath", f"{self.folder}/ledger").parquet(f"{self.folder}/ledger")

    def latest(self, spark: SparkSession, schema: str, keys: Sequence[str]) -> DataFrame:
        """The last result of every ``keys``; of several in one micro-batch any one."""
        names = spark.createDataFrame([], schema).columns
        finished = self.ledger(spark)
        if finished.isEmpty():
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(f"{schema}, batch bigint").option("basePath", f"{self.folder}/results").parquet(f"{self.folder}/results")
        kept = rows.join(finished.select("batch"), "batch", "left_semi")
        rest = [n for n in names if n not in keys]
        return kept.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*").select(*names)


def upsert_stream(
    results: DataFrame, store: ResultStore, checkpoint: str, once: bool = False,
    after: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Save a stream's results into ``store``; ``after`` is called with each saved batch."""

    def save(batch: DataFrame, number: int) -> None:
        store.save(batch, number)
        if after is not None:
            after(batch, number)

    writer = results.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
