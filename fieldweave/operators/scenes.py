"""Scene selection: candidates by cloud cover, best scene, best vegetation date, season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 6


def usable(scenes: DataFrame, max_cloud: float = 100.0) -> DataFrame:
    """Scenes within the cloud limit; an unknown cover counts as 100."""
    cover = F.coalesce("cloud_cover", F.lit(100.0))
    return scenes.withColumn("cloud_cover", cover).filter(F.col("cloud_cover") <= max_cloud)


def candidates(scenes: DataFrame, max_cloud: float, k: int = CANDIDATES) -> DataFrame:
    """The k least cloudy scenes of each field, with their rank; ties by date, then id."""
    by = Window.partitionBy("field_id").orderBy("cloud_cover", "acquired", "scene_id")
    return usable(scenes, max_cloud).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def best(scenes: DataFrame, max_cloud: float, order: str = "leastCC") -> DataFrame:
    """One scene per field: the least cloudy, or with ``mostRecent`` the latest."""
    ok = usable(scenes, max_cloud)
    pick = F.struct("acquired", "scene_id", "cloud_cover")
    if order == "mostRecent":
        one = F.max_by(pick, F.struct("acquired", "scene_id"))
    else:
        one = F.min_by(pick, F.struct("cloud_cover", "acquired", "scene_id"))
    return ok.groupBy("field_id").agg(one.alias("s")).select("field_id", "s.*")


def best_vegetation(means: DataFrame) -> DataFrame:
    """The candidate of the highest mean index per field, given (field_id, rank, acquired, ndvi_mean); the less
    cloudy one wins a tie."""
    top = F.max_by(F.struct("acquired", "rank", "ndvi_mean"), F.struct("ndvi_mean", -F.col("rank")))
    return means.groupBy("field_id").agg(top.alias("s"), F.count("*").alias("candidates")).select("field_id", "s.*", "candidates")


def metadata(row: dict[str, Column]) -> Column:
    """A metadata document; unknown entries are left out."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in row.items())))


def headers(columns: dict[str, Column]) -> Column:
    """Response headers as a map without the entries that are null."""
    pairs = [x for k, c in columns.items() for x in (F.lit(k), c.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
