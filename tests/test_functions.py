import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from fieldweave.functions import geodesy as G
from fieldweave.functions import scalar as S
from fieldweave.operators import cache, raster
from fieldweave.sources import domain as D
from fieldweave.streaming import scene_stream


def test_meridian_arc_and_round_trip(spark):
    """The meridian arc to 45 degrees north is 4984944.378 m; the grid scales it by 0.9996."""
    df = spark.createDataFrame([(9.0, 45.0), (10.4, 51.2), (-170.2, -33.3)], "lon double, lat double")
    grid = G.utm(F.col("lon"), F.col("lat"))
    x, y = G.to_grid(F.col("lon"), F.col("lat"), grid)
    lon, lat = G.from_grid(F.col("x"), F.col("y"), grid)
    rows = df.withColumns({"x": x, "y": y}).select("*", lon.alias("lon2"), lat.alias("lat2")).collect()
    assert abs(rows[0]["y"] - 4982950.400) < 1e-3 and abs(rows[0]["x"] - 500000) < 1e-6
    assert all(abs(r["lon"] - r["lon2"]) < 1e-10 and abs(r["lat"] - r["lat2"]) < 1e-10 for r in rows)


def test_season(spark):
    days = [dt.datetime(2024, 3, 31), dt.datetime(2024, 4, 1), dt.datetime(2024, 7, 9), dt.datetime(2024, 12, 1)]
    w = S.season_window(F.col("d"))
    rows = spark.createDataFrame([(d,) for d in days], "d timestamp").select(w["from"].alias("a"), w["to"].alias("b")).collect()
    assert [(r["a"].year, r["b"].strftime("%m%d%H")) for r in rows] == [(2023, "093023"), (2024, "040123"), (2024, "070923"), (2024, "093023")]


def test_in_rings_with_a_hole_and_a_bow_tie(spark):
    def ring(*p):
        return [dict(x=float(a), y=float(b)) for a, b in p]

    kind = "x double, y double, rings array<array<struct<x:double,y:double>>>"
    donut = [ring((0, 0), (9, 0), (9, 9), (0, 9)), ring((3, 3), (6, 3), (6, 6), (3, 6))]
    tie = [ring((0, 0), (9, 9), (9, 0), (0, 9))]
    rows = [(1.0, 1.0, donut), (4.0, 4.0, donut), (8.0, 4.0, donut), (11.0, 4.0, donut), (1.0, 4.5, tie), (4.5, 1.0, tie)]
    got = spark.createDataFrame(rows, kind).select(S.in_rings(F.col("x"), F.col("y"), F.col("rings")).alias("i")).collect()
    assert [r["i"] for r in got] == [True, False, True, False, True, False]


def test_flat_raster_is_stretched_around_its_value(spark):
    df = spark.createDataFrame([(1, 0, c, 0.5, c < 3) for c in range(4)], "field_id long, r int, c int, ndvi double, valid boolean")
    rows = raster.colours(df).orderBy("c").collect()
    assert [r["alpha"] for r in rows] == [255, 255, 255, 0] and rows[0]["red"] == 255


def test_upsert_keeps_known_metadata(spark):
    log = spark.createDataFrame([(1, 7, 1.0, "m1", 5.0), (2, 7, 2.0, None, 6.0), (3, None, 3.0, None, 7.0)], "id long, field_id long, raster double, ndvi_metadata string, expires_at double")
    rows = {r["field_id"]: r for r in cache.upsert(log).collect()}
    assert rows[7]["raster"] == 2.0 and rows[7]["ndvi_metadata"] == "m1" and rows[7]["expires_at"] == 6.0 and rows[None]["raster"] == 3.0


def test_blur_equals_numpy(spark):
    rng = np.random.default_rng(3)
    a = rng.uniform(size=(6, 7))
    df = spark.createDataFrame([(1, r, c, float(a[r, c])) for r in range(6) for c in range(7)], "field_id long, r int, c int, ndvi double")
    for k in (1, 3):
        pad = np.pad(a, k, mode="edge")
        want = np.array([[pad[r : r + 2 * k + 1, c : c + 2 * k + 1].mean() for c in range(7)] for r in range(6)])
        got = {(r["r"], r["c"]): r["smoothed"] for r in raster.box_blur(df, k, 6, 7).collect()}
        assert all(abs(got[r, c] - want[r, c]) < 1e-12 for r in range(6) for c in range(7))


def test_wkt(spark):
    df = spark.createDataFrame([("POLYGON ((1.5 2, 3 4, -5 6e0, 1.5 2))",)], "w string")
    assert [(p["x"], p["y"]) for p in df.select(D.wkt_ring(F.col("w")).alias("p")).first()["p"]] == [(1.5, 2), (3, 4), (-5, 6), (1.5, 2)]


def test_streams(spark, tmp_path):
    rows = [(1, 10, dt.datetime(2024, 1, 1), 30.0), (1, 11, dt.datetime(2024, 1, 2), 10.0), (2, 12, dt.datetime(2024, 1, 3), 50.0), (1, 13, dt.datetime(2024, 1, 4), 20.0)]
    kind = "field_id long, scene_id long, acquired timestamp, cloud_cover double"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    for name, df, mode in (("best", scene_stream.best_scene_stream(source()), "update"), ("counts", scene_stream.windowed_counts(source()), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {(r["field_id"], r["scene_id"]) for r in spark.table("best").collect()} == {(1, 11), (2, 12)}
    assert sum(r["n"] for r in spark.table("counts").collect()) == 4


def test_late_scenes_and_expired_state(spark, tmp_path):
    """Scenes arrive file by file: one beyond the watermark is not counted, and a field without scenes for long starts anew."""
    kind = "field_id long, scene_id long, acquired timestamp, cloud_cover double"
    told, counted = [], {}

    def arrive(rows):
        spark.createDataFrame(rows, "field_id long, scene_id long, acquired string, cloud_cover double").selectExpr("field_id", "scene_id", "CAST(acquired AS TIMESTAMP) acquired", "cloud_cover").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for name, make, take in (
            ("best", scene_stream.best_scene_stream, lambda df, _: told.extend((r["field_id"], r["scene_id"], str(r["acquired"]), r["cloud_cover"]) for r in df.collect())),
            ("counts", scene_stream.windowed_counts, lambda df, _: counted.update({str(r["start"])[:10]: r["n"] for r in df.collect()})),
        ):
            q = make(spark.readStream.schema(kind).parquet(f"{tmp_path}/in")).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
            q.awaitTermination()

    arrive([(1, 10, "2024-05-10 00:00:00", 5.0), (2, 20, "2024-05-10 00:00:00", 9.0)])
    arrive([(1, 11, "2024-05-10 06:00:00", 50.0), (2, 21, "2024-05-10 07:00:00", 3.0)])  # only the second is better
    assert sorted(told) == [(1, 10, "2024-05-10 00:00:00", 5.0), (2, 20, "2024-05-10 00:00:00", 9.0), (2, 21, "2024-05-10 07:00:00", 3.0)]
    arrive([(2, 22, "2024-05-18 00:00:00", 1.0)])  # the watermark goes on to the 17th
    arrive([(2, 23, "2024-05-18 01:00:00", 2.0), (3, 30, "2024-05-01 00:00:00", 2.0)])  # the last is late for its window
    before = dict(counted)
    arrive([(1, 12, "2024-05-18 02:00:00", 60.0)])  # field 1 has expired, so this is its best
    assert told[-1] == (1, 12, "2024-05-18 02:00:00", 60.0)
    assert sum(before.values()) == 6 and not any(day < "2024-05-06" for day in counted)
