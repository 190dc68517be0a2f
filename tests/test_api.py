"""Whole requests: statuses, invariants of the documents, exclusions, and images."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.operators import polygons as P
from fieldweave.plans import api
from fieldweave.sources import sinks


def request(i, target=1.0, radius=0.0026, **more):
    ring = [(10 + radius * np.cos(a), 50 + 0.65 * radius * np.sin(a)) for a in 2 * np.pi * np.arange(12) / 12]
    return {"field_id": i, "polygon": [{"lon": float(x), "lat": float(y)} for x, y in ring], "target_plot_size_ha": target, "resolution_m": 10.0, **more}


KIND = "field_id long, polygon array<struct<lon:double,lat:double>>, target_plot_size_ha double, resolution_m double, exclusion_polygons array<array<struct<lon:double,lat:double>>>, single_zone_override boolean, max_sample_points_per_zone int"


def test_requests(spark):
    hole = [[{"lon": 10.0 + x, "lat": 50.0 + y} for x, y in ((-0.0005, -0.0004), (0.0005, -0.0004), (0.0005, 0.0004), (-0.0005, 0.0004))]]
    everything = [[{"lon": 10.0 + x, "lat": 50.0 + y} for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))]]
    rows = [request(1), request(2, 2.0), request(3, exclusion_polygons=hole), request(4, exclusion_polygons=everything), request(5, -1.0), request(6), request(7, single_zone_override=True), request(8, max_sample_points_per_zone=0)]
    fields = spark.createDataFrame(rows, KIND)
    scenes = spark.sql("SELECT id AS field_id, id * 10 + s AS scene_id, timestamp'2024-05-01' + make_interval(0, 0, 0, int(s)) AS acquired, double(s * 10) AS cloud_cover FROM range(1, 9) CROSS JOIN (SELECT explode(sequence(1, 4)) AS s) WHERE id <> 6")
    surface = 0.55 + 0.25 * F.sin(F.col("r") / 9.0) * F.cos(F.col("c") / 7.0) + 0.05 * F.sin(F.col("r") * 12.9898 + F.col("c") * 78.233)
    grid = spark.range(64).selectExpr("int(id) AS r").crossJoin(spark.range(64).selectExpr("int(id) AS c"))
    pixels = scenes.select("field_id", "scene_id").crossJoin(grid).withColumn("ndvi", surface + F.when(F.col("scene_id") % 10 == 2, 0.01).otherwise(0.0))
    pixels = pixels.withColumn("data_mask", F.when((F.col("r") * 7 + F.col("c") * 13) % 97 == 0, 0).otherwise(1))
    today = F.lit("2024-08-01 00:00:00").cast("timestamp")
    got = {r["field_id"]: r for r in api.compute_field_zones(fields, scenes, pixels, today).collect()}
    assert {i: r["status"] for i, r in got.items()} == {1: "OK", 2: "OK", 3: "OK", 4: "INVALID", 5: "INVALID", 6: "NOT_FOUND", 7: "OK", 8: "OK"}
    assert got[4]["message"] == "everything is excluded" and got[6]["message"] == "no usable scene"
    assert got[7]["n_zones"] == 1 and got[7]["construction_algorithm"] == "single_zone_override"
    for i in (1, 2, 3, 8):
        doc = json.loads(got[i]["document"])
        target = rows[i - 1]["target_plot_size_ha"]
        told = [f["properties"] for f in doc["features"]]
        areas = [f["area_ha"] for f in told]
        assert abs(sum(areas) - doc["field_area_ha"]) < 1e-2 and max(areas) <= min(4.0, 1.25 * target) + 1e-6 and min(areas) >= 0.01
        assert json.loads(got[i]["ndvi_metadata"])["cloud_cover"] == 20.0
        assert sorted(f["zone_id"] for f in told) == list(range(got[i]["n_zones"]))
        means = [f["ndvi_mean"] for f in sorted(told, key=lambda f: f["zone_id"])]
        assert means == sorted(means)
        for f in doc["features"]:
            assert len(f["properties"].get("sample_points", [])) <= 8 and f["geometry"]["coordinates"]
            ring = np.array(f["geometry"]["coordinates"][0])
            assert (ring[0] == ring[-1]).all()
        if i == 8:
            assert all(not f.get("sample_points") for f in told)
    again = {r["field_id"]: r["document"] for r in api.compute_field_zones(fields.repartition(5), scenes, pixels.repartition(7), today).collect()}
    assert all(again[i] == got[i]["document"] for i in got)
    pngs = sinks.images(api.ndvi_image(fields.filter("field_id = 1"), scenes, pixels, today), 64, 64).collect()
    assert pngs[0]["png"][:8] == b"\x89PNG\r\n\x1a\n"


def test_png_holds_the_pixels():
    a = np.random.default_rng(1).integers(0, 256, (5, 7, 4)).astype(np.uint8)
    raw = sinks.png(a)
    at = raw.index(b"IDAT")
    body = zlib.decompress(raw[at + 4 : at + 4 + int.from_bytes(raw[at - 4 : at], "big")])
    assert np.frombuffer(body, np.uint8).reshape(5, 29)[:, 1:].reshape(5, 7, 4).tolist() == a.tolist()


def test_cache_table(spark):
    sinks.create_cache(spark, "raster_cache")
    sinks.create_cache(spark, "raster_cache")
    assert spark.table("raster_cache").count() == 0
    at = lambda t: F.lit(f"2024-05-01 {t}").cast("timestamp")
    rows = lambda i, x, mean: spark.createDataFrame([(i, x, 64, mean)], "id long, min_x double, width int, ndvi_mean_at_selection double")
    sinks.write_cache(rows(1, 10.00000004, 0.5), "raster_cache", at("08:00:00"), 3600)
    sinks.write_cache(rows(2, 10.0, None), "raster_cache", at("08:10:00"), 3600)  # the same key when rounded
    sinks.write_cache(rows(3, 11.0, 0.7), "raster_cache", at("07:00:00"), 3600)
    sinks.write_cache(rows(4, 12.0, 0.7), "raster_cache", at("08:00:00"), 0)
    got = {r["id"]: r["ndvi_mean_at_selection"] for r in sinks.read_cache(spark, "raster_cache", at("08:30:00")).collect()}
    assert got == {2: 0.5} and spark.table("raster_cache").count() == 3
    assert sinks.read_cache(spark, "raster_cache", at("09:10:00")).count() == 0
    spark.sql("DROP TABLE raster_cache")


def test_snap():
    border = [np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float), np.array([(4, 4), (6, 4), (6, 6), (4, 6)], float)]
    assert P.snapped(np.array([(0.3, 5), (2, 5), (3.5, 5)]), border, 1.0).tolist() == [[0, 5], [2, 5], [4, 5]]


def even_odd(p, rings):
    """By angles: how often the rings wind around a point, odd or not."""
    out = np.zeros(len(p), int)
    for r in rings:
        v = r[None] - p[:, None]
        a = np.arctan2(v[..., 1], v[..., 0])
        out += np.round(((np.diff(a, axis=1, append=a[:, :1]) + np.pi) % (2 * np.pi) - np.pi).sum(1) / (2 * np.pi)).astype(int)
    return out % 2 == 1


@pytest.mark.parametrize("seed", range(8))
def test_differences_of_areas(seed):
    rng = np.random.default_rng(seed)

    def star(n, x, y, size):
        a = np.sort(rng.uniform(0, 2 * np.pi, n))
        return np.stack([x + size * rng.uniform(0.3, 1, n) * np.cos(a), y + size * rng.uniform(0.3, 1, n) * np.sin(a)], 1)

    keep, cut = [star(9, 0, 0, 100)], [star(6, 20, 10, 50), star(5, -30, -20, 40), star(7, 0, 0, 160)[:4]]
    if seed % 2:
        keep.append(star(6, 10, 0, 30))
    t = P.Trapezoids(keep, cut)
    p = rng.uniform(-110, 110, (20_000, 2))
    want = even_odd(p, keep) & ~np.any([even_odd(p, [c]) for c in cut], axis=0)
    assert abs(t.areas().sum() - want.mean() * 220**2) < 4 * 220**2 * np.sqrt(0.25 / len(p))
    rings = t.rings()
    assert (P.inside(p, rings) == want).mean() > 0.9999
    signed = sum(P.area(r) for r in rings)
    assert abs(signed - t.areas().sum()) < 1e-6 * 220**2
    big = t.largest()
    assert big.areas().sum() <= t.areas().sum() + 1e-9 and (not len(big.rows) or abs(P.net_area(big.rings()) - big.areas().sum()) < 1e-3)


def test_severed_squares_and_holes():
    square, band, hole = (np.array(x, float) for x in (((0, 0), (10, 0), (10, 10), (0, 10)), ((3, -1), (4, -1), (4, 11), (3, 11)), ((6, 6), (8, 6), (8, 8), (6, 8))))
    t = P.Trapezoids([square], [band, hole])
    assert t.areas().sum() == pytest.approx(86) and len(set(t.pieces().tolist())) == 2
    big = t.largest().rings()
    assert [len(r) for r in big] == [4, 4] and P.net_area(big) == pytest.approx(56)
    assert P.Trapezoids([square], [square * 2 - 5]).rings() == [] and P.Trapezoids([]).largest().rings() == []
    wide = P.Trapezoids([square], P.widened(hole, 0.5)).areas().sum()
    assert 100 - 4 - 4 - np.pi * 0.25 * 1.1 < wide < 100 - 4 - 4 - np.pi * 0.25 * 0.9
    bow = np.array([(0, 0), (10, 10), (10, 0), (0, 6)], float)
    left = P.cleaned([bow * 10], [hole * 10])
    assert not any(P.self_crossing(r) for r in left) and 0 < P.net_area(left) < 10_000
    assert P.cleaned([square * 0.05]) == [] and P.cleaned([square], [square * 3 - 5]) == []


def test_parts_exclusions_and_flaws(spark):
    """The index is the share of the way east, so a zone's values say where on the raster it was read."""
    ring = lambda *xy: [{"lon": 10 + 0.004 * x, "lat": 50 + 0.0026 * y} for x, y in xy]
    whole, east = ring((0, 0), (1, 0), (1, 1), (0, 1)), ring((0.5, 0), (0.85, 0), (0.85, 1), (0.5, 1))
    band, corner = ring((0.2, -1), (0.3, -1), (0.3, 2), (0.2, 2)), ring((0.9, 0.9), (1.2, 0.9), (1.2, 1.2), (0.9, 1.2))
    bow = ring((0, 0), (1, 0), (0, 1), (1, 1))
    rows = [request(i) | {"polygon": p, "zone_polygon": z, "exclusion_polygons": e, "single_zone_override": None, "max_sample_points_per_zone": 4} for i, p, z, e in (
        (1, whole, None, None), (2, whole, east, None), (3, whole, None, [band, corner, whole[:2]]), (4, bow, None, None), (5, whole, east, [ring((-1, -1), (2, -1), (2, 2), (-1, 2))]), (6, ring((0, 0), (1, 1), (2, 2)), None, None), (7, whole, None, [ring((0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6))]))]
    fields = spark.createDataFrame(rows, KIND + ", zone_polygon array<struct<lon:double,lat:double>>")
    scenes = spark.sql("SELECT id AS field_id, id AS scene_id, timestamp'2024-05-01' AS acquired, 1.0D AS cloud_cover FROM range(1, 8)")
    grid = spark.range(64).selectExpr("int(id) AS r").crossJoin(spark.range(64).selectExpr("int(id) AS c"))
    pixels = scenes.select("field_id", "scene_id").crossJoin(grid).withColumn("ndvi", (F.col("c") + 0.5) / 29).withColumn("data_mask", F.lit(1))
    got = {r["field_id"]: r for r in api.compute_field_zones(fields, scenes, pixels, F.lit("2024-08-01 00:00:00").cast("timestamp")).collect()}
    assert {i: r["status"] for i, r in got.items()} == {1: "OK", 2: "OK", 3: "OK", 4: "OK", 5: "INVALID", 6: "INVALID", 7: "OK"}
    assert got[5]["message"] == "everything is excluded" and got[6]["message"] == "polygon has no area"
    docs = {i: json.loads(r["document"]) for i, r in got.items() if r["document"]}
    full = docs[1]["field_area_ha"]
    assert docs[1]["raster_size"] == docs[2]["raster_size"] == {"width": 29, "height": 29}
    for i, share in ((2, 0.35), (3, 0.7 - 0.01), (4, 0.25), (7, 0.96)):
        assert docs[i]["field_area_ha"] == pytest.approx(full * share, rel=2e-3), i
        assert sum(f["properties"]["area_ha"] for f in docs[i]["features"]) == pytest.approx(docs[i]["field_area_ha"], abs=1e-2)
    values = [f["properties"][k] for f in docs[2]["features"] for k in ("ndvi_min", "ndvi_max")]
    assert min(values) > 0.49 and max(values) < 0.86
    assert min(f["properties"]["ndvi_min"] for f in docs[3]["features"]) > 0.29
    for i, doc in docs.items():
        assert doc["type"] == "FeatureCollection" and all(f["type"] == "Feature" and f["geometry"]["type"] == "Polygon" and set(f) == {"type", "properties", "geometry"} for f in doc["features"])
        for f in doc["features"]:
            rings = [np.array(r)[:-1] for r in f["geometry"]["coordinates"]]
            assert not any(P.self_crossing(r) for r in rings)
            if i in (3, 7):
                cut = [np.array([(p["lon"], p["lat"]) for p in e]) for e in rows[i - 1]["exclusion_polygons"] if len(e) > 2]
                metres = np.array([P.METRES_A_DEGREE * np.cos(np.radians(50)), P.METRES_A_DEGREE])
                zone = P.Trapezoids([r * metres for r in rings]).areas().sum()
                assert P.Trapezoids([r * metres for r in rings], [c * metres for c in cut]).areas().sum() == pytest.approx(zone, abs=1.0)
