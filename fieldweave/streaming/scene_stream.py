"""Scenes as a stream: windowed counts with late-data rules, and the best live scene per field as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BEST = "field_id long, scene_id long, acquired timestamp, cloud_cover double"


def timed(scenes: DataFrame) -> DataFrame:
    """The scenes with ``acquired`` as an instant: watermarks need one, local timestamps will not do."""
    return scenes.withColumn("acquired", F.col("acquired").cast("timestamp"))


def windowed_counts(scenes: DataFrame, size: str = "5 days", late: str | None = "1 day") -> DataFrame:
    """Scenes and their mean cloud cover per window; a late scene within the watermark still counts, others are
    dropped. The same plan serves a batch (without the watermark's effect)."""
    rows = timed(scenes)
    if late and rows.isStreaming:
        rows = rows.withWatermark("acquired", late)
    by = rows.groupBy(F.window("acquired", size).alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("cloud_cover"), 4).alias("cloud_cover"))
    return by.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "cloud_cover")


def best_scene_stream(scenes: DataFrame, ttl: str = "6 hours", late: str = "1 day") -> DataFrame:
    """The best scene per field after each batch that brings a better one: least cloud, then the earlier, then the
    lower id. State that has seen no scene for ``ttl`` of event time expires."""
    wait = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *best, last = tuple(state.get) if state.exists else (0,)
        was = best = tuple(best)
        for pdf in batches:
            at = pdf["acquired"].astype("datetime64[us]").astype("int64")
            for row in zip(pdf["cloud_cover"].fillna(100.0), at, pdf["scene_id"]):
                best = min(best, row) if best else row
                last = max(last, row[1])
        if best:
            state.update((float(best[0]), int(best[1]), int(best[2]), int(last)))
            # counted from the scenes' own time: the watermark of a first batch is still at its beginning
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(last) // 1000) + wait)
            if best != was:
                yield pd.DataFrame({"field_id": [key[0]], "scene_id": [int(best[2])], "acquired": pd.to_datetime([int(best[1])], unit="us"), "cloud_cover": [float(best[0])]})

    rows = timed(scenes).withWatermark("acquired", late)
    return rows.groupBy("field_id").applyInPandasWithState(
        update, BEST, "cloud_cover double, acquired long, scene_id long, last long", "update", GroupStateTimeout.EventTimeTimeout)
