"""Domain tables: pixels, scenes, fields and cached rasters, from star-schema Parquet tables that stand in for imagery."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geodesy as G

from ..functions import scalar as S

GRID = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_id, r, c, b08, b04): one row per observed pixel of each field's 16 x 16 raster; missing ones are nodata."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("field_id"), (F.col("l_orderkey") % GRID).cast("int").alias("r"),
        (F.col("l_partkey") % GRID).cast("int").alias("c"), "l_extendedprice", F.col("l_quantity").cast("double").alias("q"))
    return items.groupBy("field_id", "r", "c").agg(F.avg("l_extendedprice").alias("b08"), F.avg(F.col("q") * 500.0).alias("b04"))


def ndvi_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_id, r, c, ndvi), rounded to 6 digits so that ties and percentiles agree between engines."""
    return pixels(spark, sf_dir).select("field_id", "r", "c", F.round(S.ndvi(F.col("b08"), F.col("b04")), 6).alias("ndvi"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_id, scene_id, acquired, cloud_cover): the scene catalogue."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("field_id"), F.col("event_id").alias("scene_id"), F.col("ts").alias("acquired"), F.least("value", F.lit(100.0)).alias("cloud_cover"))


def rings(fields: DataFrame) -> DataFrame:
    """(field_id, rings): an outline of 12 corners on the raster, by a rule, and a small square hole."""
    def corner(k):
        radius = 5.0 + (F.col("field_id") * 7 + k * 13) % 5 * 0.6
        angle = 2 * np.pi * k / 12
        return F.struct(F.round(8.0 + radius * F.cos(angle), 6).alias("x"), F.round(8.0 + radius * F.sin(angle), 6).alias("y"))

    hole = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((7.2, 7.2), (8.8, 7.2), (8.8, 8.8), (7.2, 8.8))))
    outer = F.transform(F.sequence(F.lit(0), F.lit(11)), corner)
    # an aggregate's value, as the optimiser may put the other side's field_id into a rule that it sees, and then fails
    return fields.groupBy("field_id").agg(F.any_value(F.array(outer, hole)).alias("rings"))


def wkt_ring(text: Column) -> Column:
    """The points of a polygon's outer ring in well-known text, as an array of (x, y)."""
    pairs = F.regexp_extract_all(F.regexp_extract(text, r"\(\(([^)]*)\)", 1), F.lit(r"(-?[\d.]+(?:[eE]-?\d+)?)\s+(-?[\d.]+(?:[eE]-?\d+)?)"), F.lit(0))
    return F.transform(pairs, lambda p: F.struct(F.split(p, r"\s+")[0].cast("double").alias("x"), F.split(p, r"\s+")[1].cast("double").alias("y")))


def wkt_outline(text: Column, grid: G.Grid) -> Column:
    """The outer ring of well-known text in a national or UTM grid, as an array of (lon, lat)."""
    def degrees(p: Column) -> Column:
        lon, lat = G.from_grid(p["x"], p["y"], grid)
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    return F.transform(wkt_ring(text), degrees)


@F.pandas_udf(T.BinaryType())
def encode_raster(values: pd.Series) -> pd.Series:
    """float32 arrays as zlib-compressed bytes."""
    return values.map(lambda v: None if v is None else zlib.compress(np.asarray(v, "<f4").tobytes()))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_raster(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else np.frombuffer(zlib.decompress(b), "<f4"))


def raster_rows(rasters: DataFrame, bands: int = 2) -> DataFrame:
    """(.., r, c, ndvi, data_mask) from a flat array column ``values`` of height x width x bands and a ``width``."""
    at = rasters.select("*", F.posexplode("values").alias("i", "v"))
    keys = [c for c in rasters.columns if c not in ("values", "width")]
    place = F.expr(f"i div {bands}")
    at = at.select(*keys, (place / F.col("width")).cast("int").alias("r"), (place % F.col("width")).cast("int").alias("c"), (F.col("i") % bands).alias("band"), "v")
    return at.groupBy(*keys, "r", "c").agg(F.max(F.when(F.col("band") == 0, F.col("v"))).alias("ndvi"), F.max(F.when(F.col("band") == 1, F.col("v"))).alias("data_mask"))


def settings(spark: SparkSession, prefix: str = "spark.fieldweave.") -> dict[str, str]:
    """The engine's settings, read from the session's configuration."""
    return {k.removeprefix(prefix): v for k, v in spark.sparkContext.getConf().getAll() if k.startswith(prefix)}
