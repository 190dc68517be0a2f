"""The two whole requests, for many fields at once: zones with sampling points, and the coloured index raster.

Inputs are tables: ``fields`` (requests with outlines in degrees), ``scenes`` (catalogue) and ``pixels`` (rasters by
scene, over each field's bounding box, row 0 in the north). Every field gets one row with a status, so one bad request
never fails the others. All tables shuffle on field_id; the steps that are sequential within a field share one grouped
map, so a field's pixels cross to Python once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import geodesy as G
from ..functions import scalar as S
from ..operators import polygons as P
from ..operators import raster, sampling, scenes, zoning
from ..runtime import grouped, ship
from ..sources import sinks

#: A request's defaults, and the blur's radius as a share of a zone's side.
DEFAULTS = {"max_cloud_cover": 30.0, "resolution_m": 10.0, "line_smoothing": 2.5, "max_sample_points_per_zone": 8, "single_zone_override": False}
BLUR_SHARE = 0.15
POINT = "struct<lon:double,lat:double>"
RULES = ("width", "height", "max_cloud_cover", "target_plot_size_ha", "resolution_m", "line_smoothing", "max_sample_points_per_zone", "polygon", "zone_polygon", "exclusion_polygons", "single_zone_override")
MOST_PIXELS = 2500


def with_defaults(fields: DataFrame) -> DataFrame:
    out = fields
    for name, value in DEFAULTS.items():
        out = out.withColumn(name, F.coalesce(name, F.lit(value)) if name in out.columns else F.lit(value))
    for name, kind in (("zone_polygon", f"array<{POINT}>"), ("exclusion_polygons", f"array<array<{POINT}>>")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out


def broken(fields: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The requests with ``errors``, the names of the rules that they break, in a fixed order."""
    found = F.filter(F.array(*(F.when(bad, name) for name, bad in rules.items())), lambda e: e.isNotNull())
    return fields.withColumn("errors", F.array_intersect(F.array(*map(F.lit, RULES)), found))


def cloud_rule() -> dict[str, Column]:
    return {"max_cloud_cover": ~F.col("max_cloud_cover").between(0, 100)}


def problems(fields: DataFrame) -> DataFrame:
    """Zone requests with their errors."""
    return broken(fields, cloud_rule() | {
        "polygon": ~F.coalesce(S.lonlat_valid(F.col("polygon")), F.lit(False)),
        "zone_polygon": F.col("zone_polygon").isNotNull() & ~F.coalesce(S.lonlat_valid(F.col("zone_polygon")), F.lit(True)),
        "exclusion_polygons": F.exists(F.coalesce("exclusion_polygons", F.array()), lambda r: F.exists(r, lambda p: ~(p["lon"].between(-180, 180) & p["lat"].between(-90, 90)))),
        "target_plot_size_ha": ~F.coalesce(F.col("target_plot_size_ha") > 0, F.lit(False)),
        "resolution_m": ~((F.col("resolution_m") > 0) & (F.col("resolution_m") <= 100)),
        "line_smoothing": ~((F.col("line_smoothing") > 0) & (F.col("line_smoothing") <= 10)),
        "max_sample_points_per_zone": ~F.col("max_sample_points_per_zone").between(0, 15),
        "single_zone_override": F.col("single_zone_override") & F.col("zone_polygon").isNotNull(),
    })


def image_problems(requests: DataFrame) -> DataFrame:
    """Image requests with their errors."""
    return broken(requests, cloud_rule() | {side: ~F.col(side).between(1, MOST_PIXELS) for side in ("width", "height")})


def land(fields: DataFrame) -> DataFrame:
    """The requests with ``polygon`` repaired, ``rings`` (the part to be zoned: the outline, or the part of it that is
    asked for, without the exclusions; if they sever it, its largest piece; the outer ring first) and ``flaw``, what is
    wrong with the outlines. An outline that crosses itself is its largest loop. One row at a time, nothing shuffled."""
    def to(ring: list[dict], scale: np.ndarray) -> np.ndarray:
        pts = np.array([(p["lon"], p["lat"]) for p in ring]) * scale
        return pts[:-1] if len(pts) > 3 and (pts[0] == pts[-1]).all() else pts

    def back(ring: np.ndarray, scale: np.ndarray) -> list[dict]:
        return [{"lon": float(x), "lat": float(y)} for x, y in ring / scale]

    def one(q: dict) -> dict:
        lat = np.radians(np.mean([p["lat"] for p in q["polygon"]]))
        scale = np.array([np.cos(lat), 1.0]) * P.METRES_A_DEGREE
        name = "polygon"
        try:
            field = P.repaired(to(q["polygon"], scale))
            name = "zone_polygon"
            rings = [field if q["zone_polygon"] is None else P.repaired(to(q["zone_polygon"], scale))]
        except ValueError:
            return {"polygon": q["polygon"], "rings": [], "flaw": f"{name} has no area"}
        cut = [to(e, scale) for e in q["exclusion_polygons"] or () if len(e) >= 3]
        if cut:
            rings = P.Trapezoids(rings, cut).largest().rings()
        return {"polygon": back(field, scale), "rings": [back(r, scale) for r in rings], "flaw": None if rings else "everything is excluded"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [{**q, **one(q)} for q in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(done, to_arrow_schema(kind))

    ship(fields.sparkSession)
    shape = T._parse_datatype_string(f"rings array<array<{POINT}>>, flaw string")
    fields = fields.drop(*shape.names)
    kind = T.StructType([*fields.schema.fields, *shape.fields])
    return fields.mapInArrow(run, kind)


def measured(fields: DataFrame) -> DataFrame:
    """Box and raster size of each field's whole outline, on which its rasters lie, and the UTM area in hectares of the
    part that is zoned."""
    xy = lambda r: F.transform(r, lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    out = fields.withColumn("box", S.bbox(xy("polygon"))).withColumn("rings", F.transform("rings", xy))
    lon, lat = (F.col("box.min_x") + F.col("box.max_x")) / 2, (F.col("box.min_y") + F.col("box.max_y")) / 2
    grid = G.utm(lon, lat)

    def metres(p: Column) -> Column:
        return G.grid_point(p["x"], p["y"], grid)

    out = out.withColumn("extent", S.bbox(F.transform(xy("polygon"), metres)))
    out = out.withColumn("sizes", F.transform("rings", lambda r: F.abs(S.ring_area(F.transform(r, metres)))))
    side = lambda a, b: S.raster_side(F.col(f"extent.{b}") - F.col(f"extent.{a}"), F.col("resolution_m"))
    holes = F.aggregate(F.slice("sizes", 2, F.greatest(F.size("sizes") - 1, F.lit(0))), F.lit(0.0), lambda a, x: a + x)
    area = (F.get("sizes", F.lit(0)) - holes) / 10_000
    return out.select("*", area.alias("area_ha"), side("min_x", "max_x").alias("width"), side("min_y", "max_y").alias("height")).drop("extent", "sizes")


def valid_pixels(pixels: DataFrame, sized: DataFrame) -> DataFrame:
    """The pixels with their centre, and whether it is data inside the part that is zoned."""
    keep = ["field_id", "rings", "box", "width", "height"]
    x = F.col("box.min_x") + (F.col("c") + 0.5) / F.col("width") * (F.col("box.max_x") - F.col("box.min_x"))
    y = F.col("box.max_y") - (F.col("r") + 0.5) / F.col("height") * (F.col("box.max_y") - F.col("box.min_y"))
    out = pixels.join(sized.select(*keep), "field_id").filter((F.col("r") < F.col("height")) & (F.col("c") < F.col("width")))
    out = out.withColumns({"lon": x, "lat": y})
    ok = (F.col("data_mask") > 0) & S.in_rings(F.col("lon"), F.col("lat"), F.col("rings"))
    return out.withColumn("valid", ok).drop(*keep[1:])


def chosen_scene(sized: DataFrame, catalogue: DataFrame, pixels: DataFrame, today: Column) -> DataFrame:
    """The scene of the highest mean index among each field's least cloudy ones of the season."""
    season = S.season_window(today)
    asked = catalogue.join(sized.select("field_id", "max_cloud_cover"), "field_id")
    asked = asked.withColumn("acquired", F.col("acquired").cast("timestamp"))
    near = scenes.candidates(asked.filter(F.col("acquired").between(season["from"], season["to"])).filter(F.coalesce("cloud_cover", F.lit(100.0)) <= F.col("max_cloud_cover")), 100.0)
    means = valid_pixels(pixels, sized).filter("valid").groupBy("field_id", "scene_id").agg(F.avg("ndvi").alias("ndvi_mean"))
    best = near.join(means, ["field_id", "scene_id"], "left").groupBy("field_id").agg(
        F.max_by(F.struct("scene_id", "acquired", "cloud_cover", "ndvi_mean"), F.struct("ndvi_mean", -F.col("rank"))).alias("s"), F.count("*").alias("candidates"))  # a field without a valid pixel keeps its least cloudy scene
    return best.select("field_id", "s.*", "candidates")


def compute_field_zones(fields: DataFrame, catalogue: DataFrame, pixels: DataFrame, today: Column, algorithm: str = "legacy") -> DataFrame:
    """(field_id, status, message, n_zones, area_ha, construction_algorithm, ndvi_metadata, document)."""
    checked = land_of(problems(with_defaults(fields)))
    sized = measured(checked.filter((F.size("errors") == 0) & F.col("flaw").isNull()))
    scene = chosen_scene(sized, catalogue, pixels, today)
    px = valid_pixels(pixels.join(scene.select("field_id", "scene_id"), ["field_id", "scene_id"]), sized)
    some = px.filter("valid").select("field_id").distinct()
    wanted = sized.select("field_id", "box", "width", "height", "area_ha", "target_plot_size_ha", "resolution_m", "line_smoothing", "max_sample_points_per_zone", "single_zone_override",
                          F.when(F.col("zone_polygon").isNotNull(), F.col("rings")).otherwise(F.slice("rings", 1, 0)).alias("border"),
                          F.filter(F.coalesce("exclusion_polygons", F.array()), lambda e: F.size(e) >= 3).alias("exclusions"))
    zones = zone_rows(px.join(some, "field_id", "left_semi").join(wanted, "field_id"), algorithm)
    shape = F.transform("rings", lambda g: F.transform(g, lambda q: F.array(q["lon"], q["lat"])))
    told = F.struct("zone_id", "ndvi_mean", "ndvi_min", "ndvi_max", "area_ha", F.transform("points", lambda q: F.array(q["lon"], q["lat"])).alias("sample_points"))
    docs = zones.groupBy("field_id").agg(F.count("*").alias("n_zones"), F.min("construction_algorithm").alias("construction_algorithm"), sinks.features(told, shape, "visit").alias("features"))
    meta = F.struct(F.date_format("acquired", "yyyy-MM-dd'T'HH:mm:ss").alias("acquired"), "cloud_cover", F.round("ndvi_mean", 4).alias("ndvi_mean_at_selection"), F.col("candidates").alias("candidates_considered"))
    out = checked.select("field_id", "errors", "flaw", "target_plot_size_ha").join(sized.select("field_id", F.round("area_ha", 4).alias("area_ha"), "width", "height"), "field_id", "left")
    out = out.join(scene.select("field_id", meta.alias("ndvi_metadata")), "field_id", "left").join(docs, "field_id", "left")
    wrong = F.when(F.size("errors") > 0, F.array_join("errors", ",")).otherwise(F.col("flaw"))
    status = F.when(wrong.isNotNull(), "INVALID").when(F.col("ndvi_metadata").isNull() | F.col("n_zones").isNull(), "NOT_FOUND").otherwise("OK")
    message = F.when(wrong.isNotNull(), wrong).when(F.col("ndvi_metadata").isNull(), "no usable scene").when(F.col("n_zones").isNull(), "no valid pixels")
    whole = F.struct(F.lit("FeatureCollection").alias("type"), F.col("area_ha").alias("field_area_ha"), "target_plot_size_ha", "n_zones", F.struct("width", "height").alias("raster_size"), "construction_algorithm", "ndvi_metadata", "features")
    return out.select("field_id", status.alias("status"), message.alias("message"), "n_zones", "area_ha", "construction_algorithm", F.to_json("ndvi_metadata").alias("ndvi_metadata"), F.when(F.col("n_zones").isNotNull(), F.to_json(whole)).alias("document"))


def land_of(checked: DataFrame) -> DataFrame:
    """``land`` of the requests without errors; those with errors as they are."""
    good, bad = checked.filter(F.size("errors") == 0), checked.filter(F.size("errors") > 0)
    return land(good).unionByName(bad.withColumns({"rings": F.lit(None).cast(f"array<array<{POINT}>>"), "flaw": F.lit(None).cast("string")}))


ZONE = """field_id long, zone_id int, visit int, ndvi_mean double, ndvi_min double, ndvi_max double, area_ha double, n int, construction_algorithm string,
  points array<struct<lon:double,lat:double>>, rings array<array<struct<lon:double,lat:double>>>"""


def zone_rows(pixels: DataFrame, algorithm: str = "legacy") -> DataFrame:
    """One row per zone from a field's pixels and its request; one group per field."""
    names = T._parse_datatype_string(ZONE).names

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        q = pdf.iloc[0]
        h, w = int(q["height"]), int(q["width"])
        value, valid = np.zeros((h, w)), np.zeros((h, w), bool)
        value[pdf["r"], pdf["c"]] = pdf["ndvi"].fillna(0.0)
        valid[pdf["r"], pdf["c"]] = pdf["valid"]
        n_valid, area, target = int(valid.sum()), float(q["area_ha"]), float(q["target_plot_size_ha"])
        pixel, want = area / n_valid, zoning.sizes(area, target, n_valid)
        n, least = want.zones, want.fewest
        radius = max(1, round(BLUR_SHARE * float(np.sqrt(n_valid / n))))
        flat = np.zeros((h + 2, w + 2))
        flat[1:-1, 1:-1] = zoning.blurred(value, radius)
        ras = zoning.Raster(h, w, flat.ravel())
        cells = ras.flat(*np.nonzero(valid))
        done = zoning.zone_field(ras, cells, n, want.cap, want.least, bool(q["single_zone_override"]), least)
        box = q["box"]
        to_lon = lambda x: box["min_x"] + x / w * (box["max_x"] - box["min_x"])
        to_lat = lambda y: box["max_y"] - y / h * (box["max_y"] - box["min_y"])
        label = np.full((h, w), -1)
        for z, x in enumerate(done.zones):
            label[ras.rc(x)] = z
        res, smooth = float(q["resolution_m"]), float(q["line_smoothing"])
        # rings in metres on the raster; outlines and exclusions are brought there
        grid = lambda ring: np.array([((p[0] - box["min_x"]) / (box["max_x"] - box["min_x"]) * w, (box["max_y"] - p[1]) / (box["max_y"] - box["min_y"]) * h) for p in ring]) * res
        border = [grid([(p["x"], p["y"]) for p in g]) for g in q["border"]]
        cut = [grid([(p["lon"], p["lat"]) for p in e]) for e in q["exclusions"]]
        shapes = {z: P.cleaned([g * res for g in rings], cut, border, max(res * smooth, P.SEAM)) for z, rings in P.zone_rings(label, P.tolerance(res, smooth, n_valid, len(done.zones)) / res).items()}
        shapes = {z: [g / res for g in rings] for z, rings in shapes.items() if rings}
        found = []
        for z, x in enumerate(done.zones):
            if z not in shapes:
                continue
            r, c = ras.rc(x)
            at = np.stack([c, r], 1) * res
            order = sampling.sample(at, value[r, c], int(q["max_sample_points_per_zone"]), algorithm, res)
            found.append((round(float(value[r, c].mean()), 4), z, r, c, order))
        found.sort(key=lambda f: f[:2])
        ends = [np.array([(to_lon(f[3][i] + 0.5), to_lat(f[2][i] + 0.5)) for i in f[4]]).reshape(-1, 2) for f in found]
        gone = np.full(2, np.nan)
        way = sampling.tour(np.array([e[0] if len(e) else gone for e in ends]), np.array([e[-1] if len(e) else gone for e in ends]))
        rows = []
        for visit, (i, flip) in enumerate(way):
            mean, z, r, c, _ = found[i]
            path = ends[i][::-1] if flip else ends[i]
            rows.append({
                "field_id": int(q["field_id"]), "zone_id": i, "visit": visit, "ndvi_mean": mean, "ndvi_min": round(float(value[r, c].min()), 4), "ndvi_max": round(float(value[r, c].max()), 4),
                "area_ha": round(len(r) * pixel, 4), "n": len(r), "construction_algorithm": done.algorithm, "points": [{"lon": float(a), "lat": float(b)} for a, b in path],
                "rings": [[{"lon": float(to_lon(a)), "lat": float(to_lat(b))} for a, b in [*g, g[0]]] for g in shapes[z]],
            })
        return pd.DataFrame(rows, columns=names)

    return grouped(pixels, "field_id").applyInPandas(one, ZONE)


def ndvi_image(fields: DataFrame, catalogue: DataFrame, pixels: DataFrame, today: Column) -> DataFrame:
    """(field_id, r, c, red, green, blue, alpha) of each field's best scene, contrast-stretched over its valid pixels."""
    sized = measured(land(with_defaults(fields)).filter("flaw IS NULL"))
    scene = chosen_scene(sized, catalogue, pixels, today)
    px = valid_pixels(pixels.join(scene.select("field_id", "scene_id"), ["field_id", "scene_id"]), sized)
    return raster.colours(px.select("field_id", "r", "c", "ndvi", "valid"))
