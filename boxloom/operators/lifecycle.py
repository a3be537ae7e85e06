"""State transitions of projects and items, as new DataFrames.

Tables are immutable: an operator returns the next version of a table and the
caller writes it, usually overwriting only the partitions of one project.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Project columns a patch may set; anything else in a patch is ignored.
PATCHABLE = ("name", "status", "detail", "source_dir", "model", "settings", "comparison", "training")
DETAIL_CHARS = 500


def rescan_new(items: DataFrame, found: DataFrame) -> DataFrame:
    """Paths not registered yet: ``project_id, rel_path``, each once."""
    keys = ["project_id", "rel_path"]
    return found.select(*keys).dropDuplicates(keys).join(items.select(*keys), keys, "left_anti")


def pending_items(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items without a result yet, in registration order."""
    return items.join(results.select("item_id"), "item_id", "left_anti").orderBy("item_id")


def results_upsert(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items after applying the latest result of each.

    ``results`` carries ``item_id, run_id, error`` and the scored values; an error
    only sets status and detail, a result also clears the detail.
    """
    fields = (
        "error", "width", "height", "task", "inference_ms", "review_priority", "detection_count",
    )
    latest = results.groupBy("item_id").agg(
        F.max_by(F.struct(*[F.col(c).alias(f"_{c}") for c in fields]), "run_id").alias("_r")
    )
    joined = items.join(latest, "item_id", "left").select(*items.columns, "_r", "_r.*")
    failed = F.col("_error").isNotNull()
    scored = F.col("_r").isNotNull() & ~failed

    def value(name: str) -> Column:
        return F.when(scored, F.col(f"_{name}")).otherwise(F.col(name)).alias(name)

    changed = {
        "status": F.when(failed, "error").when(scored, "done").otherwise(F.col("status")),
        "detail": F.when(failed, F.left(F.col("_error"), F.lit(DETAIL_CHARS)))
        .when(scored, "")
        .otherwise(F.col("detail")),
    }
    return joined.select(
        *[
            changed[c].alias(c) if c in changed else value(c) if c in fields else F.col(c)
            for c in items.columns
        ]
    )


def _replace(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    types = dict(df.dtypes)
    return df.withColumns({k: v.cast(types[k]) for k, v in values.items() if k in types})


def reset_items(items: DataFrame) -> DataFrame:
    """Everything pending again. The baseline stays, its verdict goes to 0 / 0."""
    empty = F.array()
    return _replace(
        items,
        {
            "status": F.lit("pending"), "detail": F.lit(""), "task": F.lit(""),
            "inference_ms": F.lit(0), "review_priority": F.lit(0), "detection_count": F.lit(0),
            "disputed": F.lit(0), "agreement": F.lit(0), "detections": empty,
        },
    )


def capture_baseline(items: DataFrame) -> DataFrame:
    """Freeze the current counts of done items as baseline; their verdict is clean."""
    done = F.col("status") == "done"

    def when_done(value: Column, name: str) -> Column:
        return F.when(done, value).otherwise(F.col(name))

    values = {
        "baseline_count": when_done(F.col("detection_count"), "baseline_count"),
        "disputed": when_done(F.lit(0), "disputed"),
        "agreement": when_done(F.lit(1.0), "agreement"),
    }
    if "detections" in items.columns and "baseline" in items.columns:
        values["baseline"] = when_done(F.col("detections"), "baseline")
    return _replace(items, values)


def capture_set(items: DataFrame, current: DataFrame, baseline: DataFrame) -> DataFrame:
    """The baseline set after a capture: done items take over the current rows."""
    done = items.filter(F.col("status") == "done").select("item_id")
    kept = baseline.join(done, "item_id", "left_anti")
    taken = current.join(done, "item_id", "left_semi")
    return kept.unionByName(taken)


def clear_baseline(items: DataFrame) -> DataFrame:
    return _replace(
        items,
        {
            "baseline_count": F.lit(0), "disputed": F.lit(0), "agreement": F.lit(1.0),
            "baseline": F.array(),
        },
    )


def baseline_size(items: DataFrame) -> DataFrame:
    """How many items carry a baseline, and whether there is anything to compare."""
    return items.agg(F.count_if(F.col("baseline_count") > 0).alias("baseline_items")).withColumn(
        "available", F.col("baseline_items") > 0
    )


def delete_projects(table: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of any table keyed by ``project_id`` that survive deleting projects."""
    return table.join(gone.select("project_id").distinct(), "project_id", "left_anti")


def recover_runs(projects: DataFrame) -> DataFrame:
    """After a restart nothing runs: stale runs are cancelled, trainings failed."""
    running = F.col("status") == "running"
    training = F.col("training_status") == "running"
    return projects.withColumns(
        {
            "status": F.when(running, "cancelled").otherwise(F.col("status")),
            "detail": F.when(running, "interrupted by a restart; run again to continue")
            .otherwise(F.col("detail")),
            "training_status": F.when(training, "failed").otherwise(F.col("training_status")),
            "training_detail": F.when(training, "interrupted by a restart")
            .otherwise(F.col("training_detail")),
        }
    )


def create_projects(requests: DataFrame) -> DataFrame:
    """New project rows from ``name, source_dir``; blank names become Untitled."""
    now = F.date_trunc("second", F.current_timestamp())
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("Untitled"))
    return requests.select(
        F.left(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(12)).alias("project_id"),
        name.alias("name"),
        "source_dir",
        F.lit("new").alias("status"),
        F.lit("").alias("detail"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def patch_project(projects: DataFrame, project_id: str, **fields) -> DataFrame:
    """Set known fields of one project and touch ``updated_at``; ignore the rest."""
    known = {k: v for k, v in fields.items() if k in PATCHABLE and k in projects.columns}
    if not known:
        return projects
    hit = F.col("project_id") == project_id
    values = {k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in known.items()}
    values["updated_at"] = F.when(hit, F.date_trunc("second", F.current_timestamp())).otherwise(
        F.col("updated_at")
    )
    return projects.withColumns(values)


def projects_overview(projects: DataFrame, totals: DataFrame) -> DataFrame:
    """Every project with its item totals, latest update first."""
    numbers = [c for c in totals.columns if c != "project_id"]
    kinds = dict(totals.dtypes)
    return (
        projects.join(totals, "project_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0).cast(kinds[c])) for c in numbers})
        .orderBy(F.desc("updated_at"), "project_id")
    )


def existing_files(items: DataFrame, listing: DataFrame) -> DataFrame:
    """Items whose file is still there."""
    return items.join(listing.select("rel_path").distinct(), "rel_path", "left_semi")


def thumbnail_plan(images: DataFrame, thumbnails: DataFrame, edge: int) -> DataFrame:
    """Thumbnails to build: missing ones and those older than their source."""
    scale = F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest("width", "height"))

    def side(name: str) -> Column:
        return F.greatest(F.lit(1), F.rint(F.col(name) * scale).cast("int"))

    built = thumbnails.groupBy("item_id").agg(F.max("built_at").alias("_built"))
    return (
        images.join(built, "item_id", "left")
        .filter(F.col("_built").isNull() | (F.col("_built") < F.col("modified_at")))
        .select("item_id", side("width").alias("thumb_width"), side("height").alias("thumb_height"))
    )
