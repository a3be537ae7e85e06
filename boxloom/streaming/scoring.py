"""Running a scorer over images, as a batch or as a stream.

A scorer is a callable that gets the bytes of up to one batch of images and
returns one result per image: a dict with ``detections`` and optionally ``task``,
``device``, ``width``, ``height`` and the three stage times. It is built once per
Python worker by a factory, so loading a model costs once per worker, not per batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxloom.functions.numbers import margin_priority
from boxloom.schema import RESULT, SCORING_BATCH

Scorer = Callable[[list[bytes], float], list[dict[str, Any]]]


class UnreadableImage(ValueError):
    """Raised by a scorer for one image; only that image becomes an error row."""


def _score_one_by_one(scorer: Scorer, images: list[bytes], conf: float):
    """After a failed batch, find the images at fault; other failures propagate."""
    out: list[tuple[dict | None, str | None]] = []
    for image in images:
        try:
            out.append((scorer([image], conf)[0], None))
        except UnreadableImage as exc:
            out.append((None, str(exc)))
    return out


def _score_batch(scorer: Scorer, images: list[bytes], conf: float):
    started = time.perf_counter()
    try:
        found = [(result, None) for result in scorer(images, conf)]
    except UnreadableImage:
        found = _score_one_by_one(scorer, images, conf)
    share = (time.perf_counter() - started) * 1000.0 / max(1, len(images))
    if len(found) != len(images):
        raise RuntimeError("a scorer has to return one result per image")
    return [(r if r is None else {"inference_ms": share, **r}, e) for r, e in found]


def score(
    images: DataFrame,
    factory: Callable[[], Scorer],
    conf: float = 0.05,
    batch: int = SCORING_BATCH,
) -> DataFrame:
    """Add a ``result`` struct and an ``error`` to rows carrying ``content``.

    Works on batch and streaming frames. Rows that already carry an ``error``, and
    rows without bytes, are not scored. A failing scorer fails the job.
    """
    keys = [f for f in images.schema.fields if f.name not in ("content", "error")]
    schema = T.StructType(
        [*keys, T.StructField("error", T.StringType()), T.StructField("result", RESULT)]
    )
    names = [f.name for f in keys]
    has_error = "error" in images.columns
    fields = RESULT.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                given = list(part["error"]) if has_error else [None] * len(part)
                errors = [
                    e if isinstance(e, str) else "missing image data" if c is None or not len(c) else None
                    for e, c in zip(given, part["content"])
                ]
                todo = [i for i, e in enumerate(errors) if e is None]
                results: list[dict | None] = [None] * len(part)
                if todo:
                    contents = [bytes(part["content"].iloc[i]) for i in todo]
                    for i, (result, error) in zip(todo, _score_batch(scorer, contents, conf)):
                        errors[i] = error
                        if result is not None:
                            results[i] = {name: result.get(name) for name in fields}
                out = part[names].copy()
                out["error"] = errors
                out["result"] = results
                yield out

    return images.mapInPandas(run, schema)


def result_columns(scored: DataFrame) -> DataFrame:
    """Flat result columns of scored rows, ready for saving."""
    found = F.coalesce("result.detections", F.array())
    best = F.array_max(F.transform("result.detections", lambda d: margin_priority(d["confidence"])))
    ok = F.col("error").isNull()
    return scored.select(
        *[c for c in scored.columns if c not in ("error", "result")],
        F.when(ok, "done").otherwise("error").alias("status"),
        F.coalesce(F.left("error", F.lit(500)), F.lit("")).alias("detail"),
        F.coalesce("result.task", F.when(ok, "detect")).alias("task"),
        "result.width", "result.height", "result.preprocess_ms", "result.inference_ms",
        "result.postprocess_ms", "result.device",
        F.when(ok, F.coalesce(best, F.lit(1.0))).alias("review_priority"),
        F.array_size(found).alias("detection_count"),
        F.col("result.detections").alias("detections"),
    )


def score_pending(
    images: DataFrame, results: DataFrame, factory: Callable[[], Scorer], conf: float = 0.05
) -> DataFrame:
    """Score only the images that have no result yet, so a restart never repeats work."""
    todo = images.join(results.select("item_id"), "item_id", "left_anti")
    return result_columns(score(todo, factory, conf))
