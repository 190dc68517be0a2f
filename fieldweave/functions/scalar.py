"""Column expressions for vegetation indices, colours, dates, rings and sizing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The vegetation-colour ramp, RGB at 0.0, 0.1, ... 1.0.
RAMP = [
    (165, 0, 38), (215, 48, 39), (244, 109, 67), (253, 174, 97), (254, 224, 139), (255, 255, 191),
    (217, 239, 139), (166, 217, 106), (102, 189, 99), (26, 152, 80), (0, 104, 55),
]
#: Sizing of zones.
MIN_ZONES, MAX_ZONES, MIN_RASTER, MAX_RASTER, MAX_HA, DEVIATION = 2, 12, 16, 512, 4.0, 0.25


def ndvi(nir: Column, red: Column) -> Column:
    return (nir - red) / (nir + red + F.lit(1e-6))


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_column(low), F.least(as_column(high), x))


def stretch(x: Column, low: Column, high: Column) -> Column:
    """x between two percentiles as 0 to 1; a flat range is widened by 0.05 each way."""
    flat = high - low < 1e-6
    a, b = F.when(flat, low - 0.05).otherwise(low), F.when(flat, high + 0.05).otherwise(high)
    return clip((x - a) / (b - a), 0.0, 1.0)


def ramp(norm: Column) -> list[Column]:
    """Red, green and blue of a value from 0 to 1, interpolated and cut to whole numbers."""
    at = F.least(F.lit(9), F.floor(norm * 10)).cast("int")
    part = norm * 10 - at

    def channel(k: int) -> Column:
        stops = F.array(*(F.lit(float(c[k])) for c in RAMP))
        low, high = F.get(stops, at), F.get(stops, at + 1)
        return F.floor(low + part * (high - low)).cast("int")

    return [channel(k) for k in range(3)]


def day_interval(ts: Column) -> Column:
    start = F.date_trunc("DAY", ts)
    return F.struct(start.alias("from"), (start + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")).alias("to"))


def season_window(today: Column) -> Column:
    """April to September up to today; before April, the whole season of the year before. Whole-day bounds."""
    year = F.year(today) - F.when(F.month(today) < 4, 1).otherwise(0)
    end = F.make_timestamp(year, F.lit(9), F.lit(30), F.lit(23), F.lit(59), F.lit(59))
    day_end = F.date_trunc("DAY", today) + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")
    return F.struct(F.make_timestamp(year, F.lit(4), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("from"), F.least(end, day_end).alias("to"))


def bbox(ring: Column) -> Column:
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("min_x"), F.array_min(y).alias("min_y"), F.array_max(x).alias("max_x"), F.array_max(y).alias("max_y"))


def ring_area(ring: Column) -> Column:
    """Signed area of a ring of (x, y), closed or not."""
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"])
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2


def in_rings(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd test against all edges of all rings at once; holes fall out of it."""
    def crossings(ring: Column) -> Column:
        n = F.size(ring)
        def crosses(i: Column) -> Column:
            a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
            dy = b["y"] - a["y"]
            at = (b["x"] - a["x"]) * (y - a["y"]) / F.when(dy == 0, F.lit(1e-12)).otherwise(dy) + a["x"]
            return (((a["y"] > y) != (b["y"] > y)) & (x < at)).cast("int")
        return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crosses), F.lit(0), lambda s, k: s + k)

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda s, k: s + k) % 2 == 1


def raster_side(extent: Column, resolution: float = 10.0) -> Column:
    return clip(F.bround(extent / resolution), MIN_RASTER, MAX_RASTER).cast("int")


def sizing(area: Column, target: Column, valid: Column) -> dict[str, Column]:
    """Zones wanted and pixel budgets, from hectares and valid pixels."""
    most_ha, least_ha = F.least(F.lit(MAX_HA), target * (1 + DEVIATION)), target * (1 - DEVIATION)
    wanted = F.ceil(area / target)
    top = F.greatest(F.lit(MAX_ZONES), F.ceil(area / most_ha))
    pixel = area / valid
    return {
        "min_zones": F.when(area <= target, 1).otherwise(MIN_ZONES),
        "n_zones": F.greatest(F.when(area <= target, 1).otherwise(MIN_ZONES), F.least(top, wanted)).cast("int"),
        "max_ha": most_ha, "min_ha": least_ha,
        "max_px": F.greatest(F.lit(1), F.floor(most_ha / pixel)).cast("int"),
        "min_px": F.greatest(F.lit(1), F.floor(least_ha / pixel)).cast("int"),
    }


def lonlat_valid(ring: Column) -> Column:
    return (F.size(ring) >= 3) & F.forall(ring, lambda p: p["lon"].between(-180, 180) & p["lat"].between(-90, 90))
