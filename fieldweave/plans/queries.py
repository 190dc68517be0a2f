"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame over whole tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geodesy as G
from ..functions import scalar as S
from ..operators import cache, polygons, raster, sampling, scenes, zoning
from ..sources import domain as D
from ..sources import sinks
from ..streaming import scene_stream
from . import api

N = D.GRID
MASK_LEVEL = 0.6


def ndvi_field_stats(spark: SparkSession, sf: str) -> DataFrame:
    px = D.pixels(spark, sf).withColumn("ndvi", S.ndvi(F.col("b08"), F.col("b04")))
    return raster.statistics(px, ["field_id"])


def scene_candidates_top6(spark: SparkSession, sf: str) -> DataFrame:
    return scenes.candidates(D.scenes(spark, sf), 60.0).select("field_id", "scene_id", "cloud_cover", "rank")


def best_scene_least_cloud(spark: SparkSession, sf: str) -> DataFrame:
    return scenes.best(D.scenes(spark, sf), 60.0).select("field_id", "scene_id", "cloud_cover")


def best_scene_latest(spark: SparkSession, sf: str) -> DataFrame:
    return scenes.best(D.scenes(spark, sf), 60.0, "mostRecent").select("field_id", "scene_id", "cloud_cover")


def best_vegetation_date(spark: SparkSession, sf: str) -> DataFrame:
    ranked = scenes.candidates(D.scenes(spark, sf), 60.0)
    items = D.table(spark, sf, "lineitem")
    index = S.ndvi(F.col("l_extendedprice"), F.col("l_quantity").cast("double") * 500.0)
    score = items.groupBy(F.col("l_suppkey").alias("field_id"), F.col("l_linenumber").cast("int").alias("rank")).agg(F.round(F.avg(index), 4).alias("ndvi_mean"))
    found = scenes.best_vegetation(ranked.join(score, ["field_id", "rank"]).select("field_id", "rank", "acquired", "ndvi_mean"))
    return found.select("field_id", "rank", "ndvi_mean", "candidates")


_TIME = "yyyy-MM-dd HH:mm:ss"


def season_window(spark: SparkSession, sf: str) -> DataFrame:
    days = D.table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("d")).distinct()
    w = S.season_window(F.col("d"))
    return days.select(F.date_format("d", _TIME).alias("day"), F.date_format(w["from"], _TIME).alias("season_from"), F.date_format(w["to"], _TIME).alias("season_to"))


def day_interval(spark: SparkSession, sf: str) -> DataFrame:
    w = S.day_interval(F.col("acquired").cast("timestamp"))
    return D.scenes(spark, sf).select("scene_id", F.date_format(w["from"], _TIME).alias("day_from"), F.date_format(w["to"], _TIME).alias("day_to"))


def fields(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("field_id"))


def masked(spark: SparkSession, sf: str) -> DataFrame:
    return raster.mask(D.ndvi_pixels(spark, sf), D.rings(fields(spark, sf)))


def pixel_mask_rings(spark: SparkSession, sf: str) -> DataFrame:
    grid = raster.full_grid(fields(spark, sf), N, N)
    return raster.mask(grid, D.rings(fields(spark, sf))).select("field_id", "r", "c", "inside")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    each = D.rings(fields(spark, sf)).select("field_id", F.explode("rings").alias("g"))
    e = each.select("field_id", "g", F.posexplode("g").alias("i", "a"))
    b = F.get("g", (F.col("i") + 1) % F.size("g"))
    return e.select("field_id", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def pixel_mask_edges(spark: SparkSession, sf: str) -> DataFrame:
    return raster.mask_by_edges(raster.full_grid(fields(spark, sf), N, N), edges(spark, sf))


def valid_field_stats(spark: SparkSession, sf: str) -> DataFrame:
    return raster.statistics(masked(spark, sf).filter("inside"), ["field_id"], digits=6)


def field_status(spark: SparkSession, sf: str) -> DataFrame:
    """A status per field: fields without a valid pixel are reported, not failed."""
    valid = masked(spark, sf).filter("inside").groupBy("field_id").agg(F.count("*").alias("n"))
    out = fields(spark, sf).join(valid, "field_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("field_id", "n", F.when(F.col("n") > 0, "OK").otherwise("NOT_FOUND").alias("status"))


def stretch_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    p = raster.percentiles(D.ndvi_pixels(spark, sf), [0.02, 0.98], ["field_id"])
    return p.select("field_id", F.round(F.col("p")[0], 6).alias("p02"), F.round(F.col("p")[1], 6).alias("p98"))


def ndvi_rgba(spark: SparkSession, sf: str) -> DataFrame:
    px = masked(spark, sf).select("field_id", "r", "c", "ndvi", F.col("inside").alias("valid"))
    return raster.colours(px)


def dense(spark: SparkSession, sf: str) -> DataFrame:
    grid = raster.full_grid(fields(spark, sf), N, N)
    return grid.join(D.ndvi_pixels(spark, sf), ["field_id", "r", "c"], "left").withColumn("ndvi", F.coalesce("ndvi", F.lit(0.0)))


def box_blur(spark: SparkSession, sf: str) -> DataFrame:
    return raster.box_blur(dense(spark, sf), 2, N, N).select("field_id", "r", "c", F.round("smoothed", 6).alias("smoothed"))


def zone_sizing(spark: SparkSession, sf: str) -> DataFrame:
    valid = masked(spark, sf).filter("inside").groupBy("field_id").agg(F.count("*").alias("valid"))
    area, target = F.col("valid") * (1.0 + F.col("field_id") % 7) / 100.0 * 4, 0.5 + F.col("field_id") % 4
    s = S.sizing(F.col("area_ha"), F.col("target_ha"), F.col("valid"))
    rows = valid.withColumn("area_ha", area).withColumn("target_ha", target)
    return rows.select(
        "field_id", "valid", s["n_zones"].alias("n_zones"), s["max_px"].alias("max_px"), s["min_px"].alias("min_px"))


def raster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """The sides of a request's raster: metres by the resolution, halves to even, within the limits."""
    k = F.col("field_id")
    side = lambda m: S.raster_side((k * m % 9000) * 2.5, 5.0 + k % 20)
    return fields(spark, sf).select("field_id", side(37).alias("width"), side(91).alias("height"))


def bisection_zones(spark: SparkSession, sf: str) -> DataFrame:
    return raster.bisect(masked(spark, sf).filter("inside"), 5)


def high(spark: SparkSession, sf: str) -> DataFrame:
    return D.ndvi_pixels(spark, sf).filter(F.col("ndvi") > MASK_LEVEL).select("field_id", "r", "c")


def mask_components4(spark: SparkSession, sf: str) -> DataFrame:
    return zoning.components_of(high(spark, sf), N, N)


def mask_components8(spark: SparkSession, sf: str) -> DataFrame:
    return zoning.components_of(high(spark, sf), N, N, eight=True)


def mask_runs(spark: SparkSession, sf: str) -> DataFrame:
    return raster.runs(high(spark, sf))


def dilate4(spark: SparkSession, sf: str) -> DataFrame:
    return raster.dilate(high(spark, sf), N, N)


def outline_edges(spark: SparkSession, sf: str) -> DataFrame:
    return raster.outline_edges(high(spark, sf))


def mask_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of one mask and not the other, and of both."""
    a = high(spark, sf)
    b = masked(spark, sf).filter("inside").select("field_id", "r", "c")
    both = a.intersect(b).withColumn("part", F.lit("both"))
    return both.unionByName(a.subtract(b).withColumn("part", F.lit("first"))).unionByName(b.subtract(a).withColumn("part", F.lit("second")))


def quadrants(spark: SparkSession, sf: str) -> DataFrame:
    zone = F.expr(f"(r div {N // 2}) * 2 + c div {N // 2}").cast("int")
    return D.ndvi_pixels(spark, sf).withColumn("zone", zone)


def zone_borders(spark: SparkSession, sf: str) -> DataFrame:
    return raster.borders(quadrants(spark, sf).select("field_id", "r", "c", "zone"))


def zone_rank(spark: SparkSession, sf: str) -> DataFrame:
    stats = raster.statistics(quadrants(spark, sf), ["field_id", "zone"])
    return raster.rank_zones(stats).select("field_id", "zone", "zone_id", "ndvi_mean")


def zone_size_ratio(spark: SparkSession, sf: str) -> DataFrame:
    n = quadrants(spark, sf).groupBy("field_id", "zone").agg(F.count("*").alias("n"))
    ratio = F.max("n") / F.min("n")
    return n.groupBy("field_id").agg(F.round(ratio, 6).alias("ratio"), (ratio > 1.15).alias("uneven"))


def zone_rollup(spark: SparkSession, sf: str) -> DataFrame:
    by = quadrants(spark, sf).rollup("field_id", "zone").agg(F.round(F.avg("ndvi"), 4).alias("ndvi_mean"), F.count("*").alias("n"))
    return by.select("field_id", "zone", "ndvi_mean", "n")


def safe_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return raster.safe(quadrants(spark, sf), ["field_id", "zone"]).select("field_id", "zone", "r", "c", "safe")


def quantile_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Row edges of a sweep over each zone: distinct quartiles of the rows."""
    q = raster.percentiles(quadrants(spark, sf), [0.0, 0.25, 0.5, 0.75, 1.0], ["field_id", "zone"], "r")
    return q.select("field_id", "zone", F.array_join(F.transform(F.array_distinct("p"), lambda v: F.round(v * 4).cast("int").cast("string")), ",").alias("edges"))


def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return box_blur(spark, sf).groupBy("field_id").agg(F.count_distinct("smoothed").alias("n"))


def pca_axis(spark: SparkSession, sf: str) -> DataFrame:
    a = raster.principal_axis(high(spark, sf), ["field_id"])
    return a.select("field_id", F.round("ax", 6).alias("ax"), F.round("ay", 6).alias("ay"))


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """A path per field through its five highest pixels."""
    seq = F.row_number().over(Window.partitionBy("field_id").orderBy(F.desc("ndvi"), "r", "c")) - 1
    return D.ndvi_pixels(spark, sf).withColumn("seq", seq).filter("seq < 5").select("field_id", "seq", F.col("c").alias("x"), F.col("r").alias("y"))


def path_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = raster.path_metrics(paths(spark, sf), ["field_id"])
    return m.select("field_id", F.round("length", 6).alias("length"), F.round("longest", 6).alias("longest"), F.round("turn", 4).alias("turn"), "n")


def places(spark: SparkSession, sf: str) -> DataFrame:
    lon, lat = -170.0 + (F.col("field_id") * 37) % 340, -70.0 + (F.col("field_id") * 23) % 140
    return fields(spark, sf).select("field_id", lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


def utm_project(spark: SparkSession, sf: str) -> DataFrame:
    p = places(spark, sf)
    x, y = G.to_grid(F.col("lon") + 0.3, F.col("lat"), G.utm(F.col("lon"), F.col("lat")))
    return p.select("field_id", G.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"), F.round(x, 3).alias("east"), F.round(y, 3).alias("north"))


def ring_area_utm(spark: SparkSession, sf: str) -> DataFrame:
    """Hectares of a 0.004 x 0.003 degree box around each place, in the UTM grid of its centre."""
    p = places(spark, sf)
    corners = [(-0.002, -0.0015), (0.002, -0.0015), (0.002, 0.0015), (-0.002, 0.0015)]
    grid = G.utm(F.col("lon"), F.col("lat"))
    pts = [G.grid_point(F.col("lon") + dx, F.col("lat") + dy, grid) for dx, dy in corners]
    return p.withColumn("ring", F.array(*pts)).select("field_id", F.round(F.abs(S.ring_area(F.col("ring"))) / 10_000, 4).alias("area_ha"))


def round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Projecting there and back gives the place again."""
    p = places(spark, sf)
    grid = G.utm(F.col("lon"), F.col("lat"))
    x, y = G.to_grid(F.col("lon"), F.col("lat"), grid)
    lon, lat = G.from_grid(F.col("x"), F.col("y"), grid)
    return p.withColumns({"x": x, "y": y}).select("field_id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


def wkt_outlines(spark: SparkSession, sf: str) -> DataFrame:
    """Outlines written as text in the national grid, read back in degrees."""
    k = F.col("field_id")
    points = [G.to_grid(16.0 + k % 9 * 0.5 + x, 50.5 + k % 7 * 0.25 + y, G.EPSG_2180) for x, y in ((0.0, 0.0), (0.004, 0.0), (0.004, 0.003), (0.0, 0.003), (0.0, 0.0))]
    text = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *(F.format_string("%.4f %.4f", e, n) for e, n in points)), F.lit("))"))
    out = fields(spark, sf).select("field_id", F.posexplode(D.wkt_outline(text, G.EPSG_2180)).alias("seq", "p"))
    return out.select("field_id", "seq", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


def coverage_area(spark: SparkSession, sf: str) -> DataFrame:
    """The area that cells share of each outline adds up to the outline's."""
    c = polygons.covered_cells(D.rings(fields(spark, sf)), N, N)
    return c.groupBy("field_id").agg(F.round(F.sum("covered"), 6).alias("area"))


def bounding_boxes(spark: SparkSession, sf: str) -> DataFrame:
    b = S.bbox(F.col("rings")[0])
    return D.rings(fields(spark, sf)).select("field_id", *(F.round(b[k], 6).alias(k) for k in ("min_x", "min_y", "max_x", "max_y")))


def cache_log(spark: SparkSession, sf: str) -> DataFrame:
    """Writes to a raster cache: an event is a write, some without metadata, some under a moved box."""
    e = D.table(spark, sf, "events")
    return cache.rounded_key(e.select(
        F.col("event_id").alias("id"), F.when(F.col("user_id") % 5 > 0, F.col("user_id")).alias("field_id"),
        *((F.col("user_id") % 9 + d).cast("double").alias(k) for k, d in zip(cache.BBOX, (0, 0, 1, 1))), F.lit(64).alias("width"), F.lit(64).alias("height"),
        F.col("value").alias("raster"), F.when(F.col("event_id") % 3 > 0, F.col("event_id").cast("double")).alias("ndvi_mean_at_selection"),
        F.when(F.col("event_id") % 2 > 0, F.col("event_type")).alias("ndvi_metadata"),
        (F.col("ts").cast("timestamp") + F.expr("INTERVAL 6 HOURS")).alias("expires_at"),
    ))


def cache_upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    return cache.upsert(cache_log(spark, sf)).select("field_id", "min_x", "id", F.round("raster", 4).alias("raster"), "ndvi_mean_at_selection", "ndvi_metadata")


def cache_live(spark: SparkSession, sf: str) -> DataFrame:
    state = cache.upsert(cache_log(spark, sf))
    return cache.live(state, F.lit("2024-01-30 12:00:00").cast("timestamp")).select("field_id", "min_x", "id")


def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Requests by field with the current box hit; those with a moved box miss."""
    state = cache.upsert(cache_log(spark, sf))
    ids = D.table(spark, sf, "events").select("user_id").distinct()
    asked = ids.select(
        F.when(F.col("user_id") % 5 > 0, F.col("user_id")).alias("field_id"), *((F.col("user_id") % 9 + d + F.col("user_id") % 2).cast("double").alias(k) for k, d in zip(cache.BBOX, (0, 0, 1, 1))),
        F.lit(64).alias("width"), F.lit(64).alias("height"), "user_id")
    return cache.lookup(state, asked, F.lit("2024-01-01 00:00:00").cast("timestamp")).select("user_id", "hit", "id")


def request_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Requests drawn from customers: each rule that fails is named."""
    c = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"))
    k = F.col("request_id")
    near = F.array(*(F.struct((k * 3 % 400 - 200 + x).cast("double").alias("lon"), F.lit(y).alias("lat")) for x, y in ((0, 1.0), (0, 2.0), (0, 3.0))))
    some = F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((1.0, 1.0), (2.0, 1.0), (2.0, 2.0))))
    q = c.select("request_id", (k * 13 % 3000).alias("width"), (k * 7 % 2600).alias("height"), (k % 120 - 10).cast("double").alias("max_cloud_cover"), (k % 6 - 1).cast("double").alias("target_plot_size_ha"),
                 (k % 110).cast("double").alias("resolution_m"), (k % 12).cast("double").alias("line_smoothing"), (k % 18).alias("max_sample_points_per_zone"), near.alias("polygon"),
                 F.when(k % 3 == 0, some).alias("zone_polygon"), (k % 4 == 0).alias("single_zone_override"))
    q = api.image_problems(api.problems(api.with_defaults(q)).withColumnRenamed("errors", "zone_errors"))
    errors = F.array_join(F.array_intersect(F.array(*map(F.lit, api.RULES)), F.concat("errors", "zone_errors")), ",")
    return q.select("request_id", errors.alias("errors"), F.when(errors == "", "OK").otherwise("INVALID").alias("status"))


def response_headers(spark: SparkSession, sf: str) -> DataFrame:
    b = scenes.best(D.scenes(spark, sf), 20.0)
    h = scenes.headers({"X-Scene": F.col("scene_id"), "X-Cloud-Cover": F.when(F.col("cloud_cover") > 5, F.floor("cloud_cover"))})
    return b.select("field_id", F.array_join(F.transform(F.array_sort(F.map_entries(h)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("headers"))


def scene_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = scene_stream.windowed_counts(D.scenes(spark, sf))
    return w.select(F.date_format("start", _TIME).alias("start"), "n", F.round("cloud_cover", 3).alias("cloud_cover"))


def raster_blobs(spark: SparkSession, sf: str) -> DataFrame:
    """float32 rasters packed to bytes and read back, cell by cell."""
    e = D.table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), D.encode_raster("embedding").alias("blob"))
    rows = D.raster_rows(e.select("vec_id", D.decode_raster("blob").alias("values"), F.lit(8).alias("width")))
    return rows.select("vec_id", "r", "c", F.round(F.col("ndvi").cast("double"), 6).alias("ndvi"), F.round(F.col("data_mask").cast("double"), 6).alias("data_mask"))


def farthest_points(spark: SparkSession, sf: str) -> DataFrame:
    e = D.table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("group"), F.col("vec_id").cast("long").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return sampling.farthest_of(e, 8)


def zoned(spark: SparkSession, sf: str) -> DataFrame:
    """(field_id, r, c, zone, algorithm, ndvi) of all fields: mask, blur, sizing, then one grouped map per field."""
    smooth = raster.box_blur(dense(spark, sf), 1, N, N).select("field_id", "r", "c", F.round("smoothed", 9).alias("smoothed"))
    px = masked(spark, sf).filter("inside").select("field_id", "r", "c", "ndvi").join(smooth.hint("merge"), ["field_id", "r", "c"])
    valid = px.groupBy("field_id").agg(F.count("*").alias("valid"))
    s = S.sizing(F.col("valid") * 0.16, F.lit(2.0) + F.col("field_id") % 3, F.col("valid"))
    sized = valid.select("field_id", *(s[k].alias(k) for k in ("n_zones", "max_px", "min_px")))
    zones = zoning.zones_of(px.join(sized, "field_id"), N, N)
    return zones.join(px, ["field_id", "r", "c"]).select("field_id", "r", "c", "zone", "algorithm", "ndvi")


def grown_zones(spark: SparkSession, sf: str) -> DataFrame:
    return zoned(spark, sf)


def balanced_zone_stats(spark: SparkSession, sf: str) -> DataFrame:
    z = zoned(spark, sf)
    return raster.rank_zones(raster.statistics(z, ["field_id", "zone"])).select("field_id", "zone", "zone_id", "ndvi_mean", "ndvi_min", "ndvi_max", "n")


def zone_polygons(spark: SparkSession, sf: str) -> DataFrame:
    return polygons.polygons_of(zoned(spark, sf).select("field_id", "r", "c", "zone"), N, N)


def gap_filled_zones(spark: SparkSession, sf: str) -> DataFrame:
    z = zoned(spark, sf).select("field_id", "r", "c", "zone")
    return polygons.fill_gaps(z, polygons.covered_cells(D.rings(fields(spark, sf)), N, N))


def gap_filled_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell of the grid belongs to a zone, cells that lie apart to the nearest."""
    every = raster.full_grid(fields(spark, sf), N, N).withColumn("covered", F.lit(1.0))
    return polygons.fill_gaps(bisection_zones(spark, sf), every).select("field_id", "r", "c", "zone")


def budgeted_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Uncovered pieces of the outlines, the largest first, go to zones that have room for them."""
    z = zoned(spark, sf).select("field_id", "r", "c", "zone")
    return polygons.fill_by_budget(z, polygons.covered_cells(D.rings(fields(spark, sf)), N, N), 40.0)


def bisection_tour(spark: SparkSession, sf: str) -> DataFrame:
    """The tour over zones whose paths go from their first cell to their last."""
    ends = bisection_zones(spark, sf).groupBy("field_id", "zone").agg(F.array(F.min(F.struct("r", "c")), F.max(F.struct("r", "c"))).alias("ends"))
    paths = ends.select("field_id", "zone", F.posexplode("ends").alias("seq", "at"))
    return sampling.tour_of(paths.select("field_id", "zone", "seq", F.col("at.c").cast("double").alias("x"), F.col("at.r").cast("double").alias("y")))


def legacy_points(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.points_of(zoned(spark, sf), 8, "legacy")


def sweep_points(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.points_of(zoned(spark, sf), 8, "sweep")


def zone_tour(spark: SparkSession, sf: str) -> DataFrame:
    p = sweep_points(spark, sf)
    return sampling.tour_of(p.select("field_id", "zone", "seq", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y")))


def field_zones(spark: SparkSession, sf: str) -> DataFrame:
    """The whole answer, one document per field: zones with statistics, points in order, in the tour's order."""
    z = zoned(spark, sf).persist()  # read by five branches; a lost part is computed again
    stats = raster.rank_zones(raster.statistics(z, ["field_id", "zone"]))
    pts = sampling.points_of(z, 8, "legacy").persist()
    at = pts.groupBy("field_id", "zone").agg(F.sort_array(F.collect_list(F.struct("seq", "c", "r"))).alias("p"))
    trip = sampling.tour_of(pts.select("field_id", "zone", "seq", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y")))
    shape = polygons.polygons_of(z.select("field_id", "r", "c", "zone"), N, N)
    way = F.when(F.col("reversed"), F.reverse("p")).otherwise(F.col("p"))
    rows = stats.join(at, ["field_id", "zone"], "left").join(trip, ["field_id", "zone"], "left").join(shape, ["field_id", "zone"], "left")
    told = F.struct("zone_id", "ndvi_mean", "ndvi_min", "ndvi_max", "n", F.transform(way, lambda q: F.array(q["c"], q["r"])).alias("sample_points"))
    shown = F.transform("rings", lambda g: F.transform(F.concat(g, F.slice(g, 1, 1)), lambda q: F.array(q["x"], q["y"])))
    method = z.groupBy("field_id").agg(F.min("algorithm").alias("construction_algorithm"))
    docs = rows.groupBy("field_id").agg(F.count("*").alias("n_zones"), sinks.features(told, shown, "visit").alias("features")).join(method, "field_id")
    return docs.select("field_id", "n_zones", "construction_algorithm", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "n_zones", "construction_algorithm", "features")).alias("document"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Zone requests: an outline of about 400 m per field, some with an exclusion, one zone only, or a broken rule."""
    k = F.col("field_id")
    lon, lat = 10.0 + k % 9, 45.0 + k % 7

    def ring(radius: float, n: int):
        return F.array(*(F.struct((lon + radius * np.cos(2 * np.pi * i / n)).alias("lon"), (lat + 0.7 * radius * np.sin(2 * np.pi * i / n)).alias("lat")) for i in range(n)))

    return fields(spark, sf).select(
        k, ring(0.0026, 10).alias("polygon"), F.when(k % 4 == 0, F.array(ring(0.0006, 6))).alias("exclusion_polygons"), (F.lit(0.5) + k % 5 * 0.5 - F.when(k % 50 == 49, 9.0).otherwise(0.0)).alias("target_plot_size_ha"),
        F.lit(60.0).alias("max_cloud_cover"), F.lit(25.0).alias("resolution_m"), (k % 13 == 0).alias("single_zone_override"))


def scene_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """The same raster for every scene of a field's six best, a little brighter by the scene."""
    six = scenes.candidates(D.scenes(spark, sf), 60.0).select("field_id", "scene_id", "rank")
    return D.ndvi_pixels(spark, sf).join(six, "field_id").select("field_id", "scene_id", "r", "c", (F.col("ndvi") + F.col("scene_id") % 7 * 0.001).alias("ndvi"), F.when((F.col("r") * 7 + F.col("c") * 13) % 97 == 0, 0).otherwise(1).alias("data_mask"))


TODAY = "2024-07-01 12:00:00"


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue, moved into the season."""
    return D.scenes(spark, sf).withColumn("acquired", F.col("acquired") + F.expr("INTERVAL 120 DAYS"))


def field_zone_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Whole requests, from outlines in degrees to documents with a status."""
    return api.compute_field_zones(requests(spark, sf), catalogue(spark, sf), scene_pixels(spark, sf), F.lit(TODAY).cast("timestamp"))


def ndvi_images(spark: SparkSession, sf: str) -> DataFrame:
    """The coloured raster of every field as PNG."""
    rgba = api.ndvi_image(requests(spark, sf), catalogue(spark, sf), scene_pixels(spark, sf), F.lit(TODAY).cast("timestamp"))
    return sinks.images(rgba, N, N)


QUERIES = {f.__name__: f for f in (
    ndvi_field_stats, scene_candidates_top6, best_scene_least_cloud, best_scene_latest, best_vegetation_date, season_window, day_interval,
    pixel_mask_rings, pixel_mask_edges, valid_field_stats, field_status, stretch_percentiles, ndvi_rgba, box_blur, zone_sizing, raster_sizes, bisection_zones,
    mask_components4, mask_components8, mask_runs, dilate4, outline_edges, mask_sets, zone_borders, zone_rank, zone_size_ratio, zone_rollup,
    safe_pixels, quantile_rows, distinct_values, pca_axis, path_metrics, utm_project, ring_area_utm, round_trip, wkt_outlines, coverage_area, bounding_boxes,
    cache_upsert_latest, cache_live, cache_lookup, request_validation, response_headers, scene_windows, raster_blobs, farthest_points,
    grown_zones, balanced_zone_stats, zone_polygons, gap_filled_zones, gap_filled_cells, budgeted_gaps, bisection_tour, legacy_points, sweep_points, zone_tour, field_zones, field_zone_requests, ndvi_images,
)}
