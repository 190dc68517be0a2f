"""Raster operators over long pixel tables (field_id, r, c, ...): masks, neighbourhoods, statistics, runs, bisection.

All shuffle on field_id once; rings and other per-field rows are small beside the pixels and joined by key. A plan's
estimate counts an exploded grid as no larger than its fields, so joins with one say how they are to be made: else the
whole grid may be broadcast through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

N4 = [(-1, 0), (1, 0), (0, -1), (0, 1)]
N8 = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]


def full_grid(fields: DataFrame, height: int, width: int) -> DataFrame:
    """(field_id, r, c) of every cell of every field."""
    rows = fields.select("field_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("r"))
    return rows.select("field_id", "r", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("c"))


def mask(pixels: DataFrame, rings: DataFrame, x: Column | None = None, y: Column | None = None) -> DataFrame:
    """The pixels with ``inside``: whether the centre lies in the field's rings, holes taken out, by even-odd count.
    Neither side passes through the driver: there are as many rings as fields."""
    x, y = x if x is not None else F.col("c") + 0.5, y if y is not None else F.col("r") + 0.5
    return pixels.join(rings.hint("shuffle_hash"), "field_id").withColumn("inside", S.in_rings(x, y, F.col("rings"))).drop("rings")


def mask_by_edges(pixels: DataFrame, edges: DataFrame) -> DataFrame:
    """The same as a join with one row per edge (field_id, x1, y1, x2, y2) and an odd count of crossings."""
    px = pixels.select("field_id", "r", "c", (F.col("c") + 0.5).alias("x"), (F.col("r") + 0.5).alias("y"))
    dy = F.col("y2") - F.col("y1")
    at = (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / F.when(dy == 0, 1e-12).otherwise(dy) + F.col("x1")
    hit = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < at)
    counted = px.join(edges, "field_id", "left").groupBy("field_id", "r", "c").agg(F.sum(hit.cast("int")).alias("n"))
    return counted.select("field_id", "r", "c", (F.coalesce("n", F.lit(0)) % 2 == 1).alias("inside"))


def statistics(pixels: DataFrame, keys: list[str], value: str = "ndvi", digits: int = 4) -> DataFrame:
    rounded = {f"ndvi_{k}": F.round(f(value), digits) for k, f in (("mean", F.avg), ("min", F.min), ("max", F.max))}
    return pixels.groupBy(*keys).agg(*(c.alias(k) for k, c in rounded.items()), F.count("*").alias("n"))


def percentiles(pixels: DataFrame, at: list[float], keys: list[str], value: str = "ndvi") -> DataFrame:
    """Exact percentiles with linear interpolation, as an array ``p``."""
    return pixels.groupBy(*keys).agg(F.percentile(value, [float(a) for a in at]).alias("p"))


def colours(pixels: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Contrast-stretched RGBA of pixels (field_id, r, c, ndvi, valid); alpha 0 where not valid."""
    p = percentiles(pixels.filter("valid"), [low, high], ["field_id"])
    norm = S.stretch(F.col("ndvi"), F.col("p")[0], F.col("p")[1])
    rgb = S.ramp(F.coalesce("norm", F.lit(0.0)))
    out = pixels.join(p, "field_id").withColumn("norm", norm)
    return out.select("field_id", "r", "c", *(c.alias(k) for k, c in zip(("red", "green", "blue"), rgb)), F.when(F.col("valid"), 255).otherwise(0).alias("alpha"))


def box_blur(dense: DataFrame, radius: int, height: int, width: int, value: str = "ndvi") -> DataFrame:
    """Mean over (2 radius + 1) squared cells with repeated edges, as two passes of a sliding window."""
    def smooth(df: DataFrame, along: str, across: str, n: int, src: str, out: str) -> DataFrame:
        w = Window.partitionBy("field_id", across).orderBy(along)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        inner = F.sum(src).over(w.rowsBetween(-radius, radius))
        low = F.greatest(F.lit(0), radius - F.col(along)) * F.first(src).over(whole)
        high = F.greatest(F.lit(0), F.col(along) + radius - (n - 1)) * F.last(src).over(whole)
        return df.withColumn(out, (inner + low + high) / (2 * radius + 1))

    once = smooth(dense, "c", "r", width, value, "_row")
    return smooth(once, "r", "c", height, "_row", "smoothed").drop("_row")


def shifted(cells: DataFrame, steps: list[tuple[int, int]], keep: list[str]) -> DataFrame:
    """Each cell's rows at its neighbours' places: an equi-join on these finds neighbours without a theta join."""
    moves = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in steps))
    out = cells.select("field_id", "r", "c", *keep, F.explode(moves).alias("m"))
    return out.select("field_id", (F.col("r") + F.col("m.dr")).alias("r"), (F.col("c") + F.col("m.dc")).alias("c"), *keep)


def dilate(cells: DataFrame, height: int, width: int) -> DataFrame:
    """Cells and their 4-neighbours within the grid."""
    both = cells.select("field_id", "r", "c").union(shifted(cells, N4, []))
    return both.filter(f"r between 0 and {height - 1} and c between 0 and {width - 1}").distinct()


def borders(zones: DataFrame) -> DataFrame:
    """(field_id, zone, other, contacts): 4-contacts of each zone with each other zone, given (field_id, r, c, zone)."""
    near = shifted(zones.withColumnRenamed("zone", "other"), N4, ["other"])
    return zones.join(near, ["field_id", "r", "c"]).filter("zone <> other").groupBy("field_id", "zone", "other").agg(F.count("*").alias("contacts"))


def runs(cells: DataFrame) -> DataFrame:
    """(field_id, r, first, last): maximal runs of cells in each row, by gaps and islands."""
    w = Window.partitionBy("field_id", "r").orderBy("c")
    return cells.withColumn("g", F.col("c") - F.row_number().over(w)).groupBy("field_id", "r", "g").agg(F.min("c").alias("first"), F.max("c").alias("last")).drop("g")


def outline_edges(cells: DataFrame) -> DataFrame:
    """(field_id, x1, y1, x2, y2): unit edges between a cell of the mask and one outside; shared edges cancel."""
    corners = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("dx1", "dy1", "dx2", "dy2"), e))) for e in ((0, 0, 1, 0), (1, 0, 1, 1), (0, 1, 1, 1), (0, 0, 0, 1))))
    e = cells.select("field_id", "r", "c", F.explode(corners).alias("e"))
    e = e.select("field_id", *((F.col(k) + F.col(f"e.{d}")).alias(n) for k, d, n in (("c", "dx1", "x1"), ("r", "dy1", "y1"), ("c", "dx2", "x2"), ("r", "dy2", "y2"))))
    return e.groupBy("field_id", "x1", "y1", "x2", "y2").count().filter("count = 1").drop("count")


def safe(pixels: DataFrame, keys: list[str], worst: float = 0.2, least: int = 8) -> DataFrame:
    """The pixels with ``safe``: not among the worst share of their group; in groups under ``least`` all are."""
    p = pixels.groupBy(*keys).agg(F.percentile("ndvi", worst).alias("edge"), F.count("*").alias("n"))
    return pixels.join(p, keys).withColumn("safe", (F.col("n") < least) | (F.col("ndvi") >= F.col("edge"))).drop("edge", "n")


def rank_zones(stats: DataFrame) -> DataFrame:
    """``zone_id`` from 0 in ascending order of the mean; ties by the zone's former number."""
    return stats.withColumn("zone_id", F.row_number().over(Window.partitionBy("field_id").orderBy("ndvi_mean", "zone")) - 1)


def bisect(cells: DataFrame, n_zones: int) -> DataFrame:
    """(field_id, r, c, zone): recursive exact cuts of each field's cells into n_zones parts across the longer span,
    one window round per level; n_zones is the same for all fields of a call."""
    rows = cells.select("field_id", "r", "c", F.lit(0).alias("zone"), F.lit(n_zones).alias("parts"))
    size = n_zones
    while size > 1:
        part = Window.partitionBy("field_id", "zone")
        tall = F.max("r").over(part) - F.min("r").over(part) >= F.max("c").over(part) - F.min("c").over(part)
        rows = rows.withColumn("n", F.count("*").over(part)).withColumn("tall", tall)
        order = part.orderBy(F.when(F.col("tall"), F.col("r")).otherwise(F.col("c")), F.when(F.col("tall"), F.col("c")).otherwise(F.col("r")))
        left = F.floor(F.col("parts") / 2).cast("int")
        cut = S.clip(F.bround(F.col("n") * left / F.col("parts")), F.lit(1), F.col("n") - 1)
        goes = (F.col("parts") > 1) & (F.row_number().over(order) > cut)
        rows = rows.withColumn("left", left).withColumn("goes", goes)
        rows = rows.select("field_id", "r", "c", (F.col("zone") + F.when(F.col("goes"), F.col("left")).otherwise(0)).alias("zone"),
                           F.when(F.col("parts") <= 1, F.col("parts")).when(F.col("goes"), F.col("parts") - F.col("left")).otherwise(F.col("left")).alias("parts"))
        size = -(-size // 2)
    return rows.select("field_id", "r", "c", F.col("zone").cast("int").alias("zone"))


def principal_axis(points: DataFrame, keys: list[str], x: str = "c", y: str = "r") -> DataFrame:
    """Closed-form first principal axis (ax, ay), turned so that ax > 0, or ay > 0 where ax is 0."""
    m = points.groupBy(*keys).agg(F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("cxy"))
    angle = 0.5 * F.atan2(2 * F.col("cxy"), F.col("vx") - F.col("vy"))
    return m.select(*keys, F.cos(angle).alias("ax"), F.sin(angle).alias("ay"))


def path_metrics(points: DataFrame, keys: list[str]) -> DataFrame:
    """Length, longest step and sharpest turn (degrees) of ordered paths (keys, seq, x, y)."""
    w = Window.partitionBy(*keys).orderBy("seq")
    p = points.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w), "nx": F.lead("x").over(w), "ny": F.lead("y").over(w)})
    ax, ay, bx, by = F.col("x") - F.col("px"), F.col("y") - F.col("py"), F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    norm = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    turn = F.when(norm > 0, F.degrees(F.acos(S.clip((ax * bx + ay * by) / norm, -1.0, 1.0))))
    step = F.sqrt(ax * ax + ay * ay)
    return p.groupBy(*keys).agg(F.sum(step).alias("length"), F.max(step).alias("longest"), F.max(turn).alias("turn"), F.count("*").alias("n"))
