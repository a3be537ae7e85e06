"""Session settings, limits and durable lineage cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one group a single task may sort or hold. Larger groups take the
#: distributed path of an operator. Override per session with the keys below.
DEFAULT_HOT_GROUP_ROWS = 200_000
HOT_GROUP_ROWS = "boxloom.hotGroupRows"

#: Boxes of one image that may be nested into one row for matching.
DEFAULT_NESTED_BOXES = 256
NESTED_BOXES = "boxloom.nestedBoxes"


def build_session(app: str = "boxloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _limit(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def hot_group_rows(spark: SparkSession) -> int:
    return _limit(spark, HOT_GROUP_ROWS, DEFAULT_HOT_GROUP_ROWS)


def nested_boxes(spark: SparkSession) -> int:
    return _limit(spark, NESTED_BOXES, DEFAULT_NESTED_BOXES)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder for durable intermediate data.

    It is the one the cluster names in ``spark.checkpoint.dir``, else a folder in the
    session's warehouse, which executors share as well. Nothing goes to a folder that
    only one machine has.
    """
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known is None:
        known = spark.conf.get("spark.checkpoint.dir", None)
        if known is None:
            known = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(known)
    return known


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared folder, so a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sent_if_few(table: DataFrame) -> tuple[DataFrame, bool]:
    """``table`` to be joined with, sent to every task if a count finds few rows, and whether it is."""
    few = table.count() <= hot_group_rows(table.sparkSession)
    return (F.broadcast(table) if few else table), few
