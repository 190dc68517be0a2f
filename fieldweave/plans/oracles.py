"""The registered queries as SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from ..functions import geodesy as G
from ..functions import scalar as S

PX = """px AS (SELECT l_suppkey AS field_id, CAST(l_orderkey % 16 AS INT) AS r, CAST(l_partkey % 16 AS INT) AS c,
  avg(l_extendedprice) AS b08, avg(CAST(l_quantity AS DOUBLE) * 500.0) AS b04 FROM lineitem GROUP BY 1, 2, 3),
nd AS (SELECT field_id, r, c, round((b08 - b04) / (b08 + b04 + 0.000001), 6) AS ndvi FROM px)"""
SC = "sc AS (SELECT user_id AS field_id, event_id AS scene_id, ts AS acquired, least(value, 100.0) AS cloud_cover FROM events)"
GRID = "fields AS (SELECT s_suppkey AS field_id FROM supplier), grid AS (SELECT field_id, CAST(a.range AS INT) AS r, CAST(b.range AS INT) AS c FROM fields, range(16) a, range(16) b)"
EDGE = """corner AS (SELECT field_id, 0 AS ring, k, 12 AS n, round(8.0 + (5.0 + (field_id * 7 + k * 13) % 5 * 0.6) * cos(2 * pi() * k / 12), 6) AS x,
  round(8.0 + (5.0 + (field_id * 7 + k * 13) % 5 * 0.6) * sin(2 * pi() * k / 12), 6) AS y FROM fields, (SELECT range AS k FROM range(12))
  UNION ALL SELECT field_id, 1, k, 4, x, y FROM fields, (VALUES (0, 7.2, 7.2), (1, 8.8, 7.2), (2, 8.8, 8.8), (3, 7.2, 8.8)) h(k, x, y)),
edge AS (SELECT a.field_id, a.ring, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM corner a JOIN corner b ON a.field_id = b.field_id AND a.ring = b.ring AND b.k = (a.k + 1) % a.n),
m AS (SELECT g.field_id, g.r, g.c, count(*) FILTER (WHERE (y1 > g.r + 0.5) <> (y2 > g.r + 0.5)
  AND g.c + 0.5 < (x2 - x1) * (g.r + 0.5 - y1) / CASE WHEN y2 = y1 THEN 1e-12 ELSE y2 - y1 END + x1) % 2 = 1 AS inside
  FROM grid g JOIN edge e USING (field_id) GROUP BY 1, 2, 3)"""
VALID = "v AS (SELECT nd.* FROM nd JOIN m USING (field_id, r, c) WHERE inside)"
HIGH = "hi AS (SELECT field_id, r, c FROM nd WHERE ndvi > 0.6)"
QUAD = "q AS (SELECT *, CAST((r // 8) * 2 + c // 8 AS INT) AS zone FROM nd)"
MOVES = "(VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) s(dr, dc)"
MOVES8 = "(VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) s(dr, dc)"
BLUR = """dense AS (SELECT g.field_id, g.r, g.c, coalesce(ndvi, 0.0) AS v FROM grid g LEFT JOIN nd USING (field_id, r, c)),
b1 AS (SELECT *, (sum(v) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + greatest(0, 2 - c) * first_value(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  + greatest(0, c + 2 - 15) * last_value(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 5 AS h FROM dense WINDOW w AS (PARTITION BY field_id, r ORDER BY c)),
b2 AS (SELECT *, (sum(h) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + greatest(0, 2 - r) * first_value(h) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  + greatest(0, r + 2 - 15) * last_value(h) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 5 AS s FROM b1 WINDOW w AS (PARTITION BY field_id, c ORDER BY r)),
bl AS (SELECT field_id, r, c, round(s, 6) AS smoothed FROM b2)"""
CAND = f"{SC}, cand AS (SELECT *, CAST(row_number() OVER (PARTITION BY field_id ORDER BY cloud_cover, acquired, scene_id) AS INT) AS rank FROM sc WHERE cloud_cover <= 60.0)"
PLACE = "pl AS (SELECT s_suppkey AS field_id, CAST(-170.0 + (s_suppkey * 37) % 340 AS DOUBLE) AS lon, CAST(-70.0 + (s_suppkey * 23) % 140 AS DOUBLE) AS lat FROM supplier)"
CACHE = """log AS (SELECT event_id AS id, CASE WHEN user_id % 5 > 0 THEN user_id END AS field_id, CAST(user_id % 9 AS DOUBLE) AS min_x, value AS raster,
  CASE WHEN event_id % 3 > 0 THEN CAST(event_id AS DOUBLE) END AS m, CASE WHEN event_id % 2 > 0 THEN event_type END AS md, ts + INTERVAL 6 HOURS AS expires_at,
  CASE WHEN user_id % 5 > 0 THEN NULL ELSE CAST(user_id % 9 AS DOUBLE) END AS box FROM events),
st AS (SELECT field_id, arg_max(min_x, id) AS min_x, max(id) AS id, arg_max(raster, id) AS raster, arg_max(m, id) FILTER (WHERE m IS NOT NULL) AS ndvi_mean_at_selection,
  arg_max(md, id) FILTER (WHERE md IS NOT NULL) AS ndvi_metadata, arg_max(expires_at, id) AS expires_at FROM log GROUP BY field_id, box)"""


def stats(source: str, keys: str, digits: int = 4) -> str:
    return f"SELECT {keys}, round(avg(ndvi), {digits}) AS ndvi_mean, round(min(ndvi), {digits}) AS ndvi_min, round(max(ndvi), {digits}) AS ndvi_max, count(*) AS n FROM {source} GROUP BY {keys}"


def ramp(k: int) -> str:
    stops = ", ".join(str(float(c[k])) for c in S.RAMP)
    low, high = f"([{stops}])[stop + 1]", f"([{stops}])[stop + 2]"
    return f"CAST(floor({low} + (norm * 10 - stop) * ({high} - {low})) AS INT)"


def projected(lon: str, lat: str, zone_lon: str, zone_lat: str) -> tuple[str, str]:
    """East and north of a point in the UTM grid of another, by the same series."""
    meridian = f"((floor(({zone_lon} + 180) / 6) + 1) * 6.0 - 183.0)"
    sin = f"sin(radians({lat}))"
    t = f"sinh(atanh({sin}) - {G._ROOT!r} * atanh({G._ROOT!r} * {sin}))"
    dl = f"radians({lon} - {meridian})"
    xi, eta = f"atan2({t}, cos({dl}))", f"atanh(sin({dl}) / sqrt(1 + {t} * {t}))"
    x = eta + "".join(f" + {a!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(G.ALPHA, 1))
    y = xi + "".join(f" + {a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(G.ALPHA, 1))
    k = 0.9996 * G._RADIUS
    return f"(500000.0 + {k!r} * ({x}))", f"(CASE WHEN {zone_lat} >= 0 THEN 0.0 ELSE 10000000.0 END + {k!r} * ({y}))"


def components(moves: str) -> str:
    return f"""WITH RECURSIVE {PX}, {HIGH}, reach(field_id, r, c, label) AS (SELECT field_id, r, c, r * 16 + c FROM hi
  UNION SELECT h.field_id, h.r, h.c, a.label FROM reach a, {moves}, hi h WHERE h.field_id = a.field_id AND h.r = a.r + dr AND h.c = a.c + dc AND a.label < h.r * 16 + h.c)
SELECT field_id, r, c, CAST(min(label) AS INT) AS component FROM reach GROUP BY field_id, r, c"""


def bisection(levels: list[dict[int, tuple[int, int]]]) -> str:
    """One CTE per level: zones (by first number) with their parts, the left parts and the cut."""
    out = [f"z0 AS (SELECT field_id, r, c, 0 AS zone, 5 AS parts FROM v)"]
    for i in range(3):
        out.append(f"""w{i} AS (SELECT *, count(*) OVER p AS n, max(r) OVER p - min(r) OVER p >= max(c) OVER p - min(c) OVER p AS tall, parts // 2 AS l FROM z{i} WINDOW p AS (PARTITION BY field_id, zone)),
o{i} AS (SELECT *, row_number() OVER (PARTITION BY field_id, zone ORDER BY CASE WHEN tall THEN r ELSE c END, CASE WHEN tall THEN c ELSE r END) AS i,
  CASE WHEN parts > 1 THEN greatest(1, least(n - 1, round_even(n * l / CAST(parts AS DOUBLE), 0))) END AS cut FROM w{i}),
z{i + 1} AS (SELECT field_id, r, c, zone + CASE WHEN parts > 1 AND i > cut THEN l ELSE 0 END AS zone, CASE WHEN parts <= 1 THEN parts WHEN i > cut THEN parts - l ELSE l END AS parts FROM o{i})""")
    return f"WITH {PX}, {GRID}, {EDGE}, {VALID}, " + ", ".join(out) + " SELECT field_id, r, c, CAST(zone AS INT) AS zone FROM z3"


_E, _N = projected("(lon + 0.3)", "lat", "lon", "lat")
_CORNERS = [projected(f"(lon + {dx})", f"(lat + {dy})", "lon", "lat") for dx, dy in ((-0.002, -0.0015), (0.002, -0.0015), (0.002, 0.0015), (-0.002, 0.0015))]
_RING = ", ".join(f"{x} AS x{i}, {y} AS y{i}" for i, (x, y) in enumerate(_CORNERS))
_SHOELACE = " + ".join(f"(x{i} * y{(i + 1) % 4} - x{(i + 1) % 4} * y{i})" for i in range(4))

SQL = {
    "ndvi_field_stats": f"WITH {PX}, raw AS (SELECT field_id, (b08 - b04) / (b08 + b04 + 0.000001) AS ndvi FROM px) {stats('raw', 'field_id')}",
    "scene_candidates_top6": f"WITH {CAND} SELECT field_id, scene_id, cloud_cover, rank FROM cand WHERE rank <= 6",
    "best_scene_least_cloud": f"WITH {CAND} SELECT field_id, scene_id, cloud_cover FROM cand WHERE rank = 1",
    "best_scene_latest": f"WITH {SC} SELECT field_id, scene_id, cloud_cover FROM sc WHERE cloud_cover <= 60.0 QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY acquired DESC, scene_id DESC) = 1",
    "best_vegetation_date": f"""WITH {CAND}, score AS (SELECT l_suppkey AS field_id, CAST(l_linenumber AS INT) AS rank,
        round(avg((l_extendedprice - CAST(l_quantity AS DOUBLE) * 500.0) / (l_extendedprice + CAST(l_quantity AS DOUBLE) * 500.0 + 0.000001)), 4) AS ndvi_mean FROM lineitem GROUP BY 1, 2),
        j AS (SELECT field_id, rank, ndvi_mean, count(*) OVER (PARTITION BY field_id) AS candidates FROM cand JOIN score USING (field_id, rank) WHERE rank <= 6)
        SELECT field_id, rank, ndvi_mean, candidates FROM j QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY ndvi_mean DESC, rank) = 1""",
    "season_window": """WITH d AS (SELECT DISTINCT o_orderdate AS d FROM orders), y AS (SELECT d, year(d) - CASE WHEN month(d) < 4 THEN 1 ELSE 0 END AS y FROM d)
        SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS day, strftime(make_timestamp(y, 4, 1, 0, 0, 0.0), '%Y-%m-%d %H:%M:%S') AS season_from,
        strftime(least(make_timestamp(y, 9, 30, 23, 59, 59.0), date_trunc('day', d) + INTERVAL '23:59:59'), '%Y-%m-%d %H:%M:%S') AS season_to FROM y""",
    "day_interval": f"WITH {SC} SELECT scene_id, strftime(date_trunc('day', acquired), '%Y-%m-%d %H:%M:%S') AS day_from, strftime(date_trunc('day', acquired) + INTERVAL '23:59:59', '%Y-%m-%d %H:%M:%S') AS day_to FROM sc",
    "pixel_mask_rings": f"WITH {GRID}, {EDGE} SELECT field_id, r, c, inside FROM m",
    "pixel_mask_edges": f"WITH {GRID}, {EDGE} SELECT field_id, r, c, inside FROM m",
    "valid_field_stats": f"WITH {PX}, {GRID}, {EDGE}, {VALID} {stats('v', 'field_id', 6)}",
    "field_status": f"WITH {PX}, {GRID}, {EDGE}, {VALID}, k AS (SELECT field_id, count(*) AS n FROM v GROUP BY 1) SELECT field_id, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) > 0 THEN 'OK' ELSE 'NOT_FOUND' END AS status FROM fields LEFT JOIN k USING (field_id)",
    "stretch_percentiles": f"WITH {PX} SELECT field_id, round(quantile_cont(ndvi, 0.02), 6) AS p02, round(quantile_cont(ndvi, 0.98), 6) AS p98 FROM nd GROUP BY field_id",
    "ndvi_rgba": f"""WITH {PX}, {GRID}, {EDGE}, {VALID}, p AS (SELECT field_id, quantile_cont(ndvi, 0.02) AS lo, quantile_cont(ndvi, 0.98) AS hi FROM v GROUP BY 1),
        w AS (SELECT field_id, CASE WHEN hi - lo < 1e-6 THEN lo - 0.05 ELSE lo END AS lo, CASE WHEN hi - lo < 1e-6 THEN hi + 0.05 ELSE hi END AS hi FROM p),
        x AS (SELECT nd.field_id, nd.r, nd.c, inside, greatest(0.0, least(1.0, (ndvi - lo) / (hi - lo))) AS norm FROM nd JOIN m USING (field_id, r, c) JOIN w USING (field_id)),
        y AS (SELECT *, CAST(least(9, floor(norm * 10)) AS INT) AS stop FROM x)
        SELECT field_id, r, c, {ramp(0)} AS red, {ramp(1)} AS green, {ramp(2)} AS blue, CASE WHEN inside THEN 255 ELSE 0 END AS alpha FROM y""",
    "box_blur": f"WITH {PX}, {GRID}, {BLUR} SELECT field_id, r, c, smoothed FROM bl",
    "distinct_values": f"WITH {PX}, {GRID}, {BLUR} SELECT field_id, count(DISTINCT smoothed) AS n FROM bl GROUP BY field_id",
    "zone_sizing": f"""WITH {PX}, {GRID}, {EDGE}, {VALID}, k AS (SELECT field_id, count(*) AS valid FROM v GROUP BY 1),
        a AS (SELECT field_id, valid, valid * (CAST(1.0 AS DOUBLE) + field_id % 7) / CAST(100.0 AS DOUBLE) * 4 AS area, CAST(0.5 AS DOUBLE) + field_id % 4 AS target FROM k),
        b AS (SELECT *, least(CAST(4.0 AS DOUBLE), target * CAST(1.25 AS DOUBLE)) AS most, target * CAST(0.75 AS DOUBLE) AS few, area / valid AS pixel FROM a)
        SELECT field_id, valid, CAST(greatest(CASE WHEN area <= target THEN 1 ELSE 2 END, least(greatest(12, ceil(area / most)), ceil(area / target))) AS INT) AS n_zones,
        CAST(greatest(1, floor(most / pixel)) AS INT) AS max_px, CAST(greatest(1, floor(few / pixel)) AS INT) AS min_px FROM b""",
    "raster_sizes": """WITH k AS (SELECT CAST(s_suppkey AS BIGINT) AS k, CAST(5.0 AS DOUBLE) + s_suppkey % 20 AS res FROM supplier),
        m AS (SELECT k, CAST(2.5 AS DOUBLE) * (k * 37 % 9000) / res AS w, CAST(2.5 AS DOUBLE) * (k * 91 % 9000) / res AS h FROM k)
        SELECT k AS field_id, CAST(least(512, greatest(16, round_even(w, 0))) AS INT) AS width, CAST(least(512, greatest(16, round_even(h, 0))) AS INT) AS height FROM m""",
    "bisection_zones": bisection([]),
    "mask_components4": components(MOVES),
    "mask_components8": components(MOVES8),
    "mask_runs": f"WITH {PX}, {HIGH}, i AS (SELECT *, c - row_number() OVER (PARTITION BY field_id, r ORDER BY c) AS g FROM hi) SELECT field_id, r, min(c) AS first, max(c) AS last FROM i GROUP BY field_id, r, g",
    "dilate4": f"WITH {PX}, {HIGH} SELECT DISTINCT field_id, r, c FROM (SELECT * FROM hi UNION ALL SELECT field_id, r + dr, c + dc FROM hi, {MOVES}) WHERE r BETWEEN 0 AND 15 AND c BETWEEN 0 AND 15",
    "outline_edges": f"""WITH {PX}, {HIGH}, e AS (SELECT field_id, c + a AS x1, r + b AS y1, c + d AS x2, r + f AS y2 FROM hi, (VALUES (0, 0, 1, 0), (1, 0, 1, 1), (0, 1, 1, 1), (0, 0, 0, 1)) s(a, b, d, f))
        SELECT field_id, x1, y1, x2, y2 FROM e GROUP BY ALL HAVING count(*) = 1""",
    "mask_sets": f"""WITH {PX}, {GRID}, {EDGE}, {VALID}, {HIGH}, i AS (SELECT field_id, r, c FROM v)
        SELECT *, 'both' AS part FROM (SELECT * FROM hi INTERSECT SELECT * FROM i) UNION ALL SELECT *, 'first' FROM (SELECT * FROM hi EXCEPT SELECT * FROM i) UNION ALL SELECT *, 'second' FROM (SELECT * FROM i EXCEPT SELECT * FROM hi)""",
    "zone_borders": f"""WITH {PX}, {QUAD}, n AS (SELECT a.field_id, a.zone, b.zone AS other FROM q a, {MOVES}, q b WHERE b.field_id = a.field_id AND b.r = a.r + dr AND b.c = a.c + dc AND a.zone <> b.zone)
        SELECT field_id, zone, other, count(*) AS contacts FROM n GROUP BY ALL""",
    "zone_rank": f"WITH {PX}, {QUAD}, s AS ({stats('q', 'field_id, zone')}) SELECT field_id, zone, CAST(row_number() OVER (PARTITION BY field_id ORDER BY ndvi_mean, zone) - 1 AS INT) AS zone_id, ndvi_mean FROM s",
    "zone_size_ratio": f"WITH {PX}, {QUAD}, s AS (SELECT field_id, zone, count(*) AS n FROM q GROUP BY 1, 2) SELECT field_id, round(max(n) / CAST(min(n) AS DOUBLE), 6) AS ratio, max(n) / CAST(min(n) AS DOUBLE) > 1.15 AS uneven FROM s GROUP BY 1",
    "zone_rollup": f"WITH {PX}, {QUAD} SELECT field_id, zone, round(avg(ndvi), 4) AS ndvi_mean, count(*) AS n FROM q GROUP BY ROLLUP (field_id, zone)",
    "safe_pixels": f"WITH {PX}, {QUAD}, p AS (SELECT field_id, zone, quantile_cont(ndvi, 0.2) AS e, count(*) AS n FROM q GROUP BY 1, 2) SELECT field_id, zone, r, c, n < 8 OR ndvi >= e AS safe FROM q JOIN p USING (field_id, zone)",
    "quantile_rows": f"""WITH {PX}, {QUAD}, p AS (SELECT field_id, zone, unnest(quantile_cont(CAST(r AS DOUBLE), [0.0, 0.25, 0.5, 0.75, 1.0])) AS e FROM q GROUP BY 1, 2)
        SELECT field_id, zone, string_agg(CAST(CAST(round(e * 4) AS INT) AS VARCHAR), ',' ORDER BY e) AS edges FROM (SELECT DISTINCT * FROM p) GROUP BY 1, 2""",
    "pca_axis": f"""WITH {PX}, {HIGH}, a AS (SELECT field_id, 0.5 * atan2(2 * covar_samp(c, r), var_samp(c) - var_samp(r)) AS t FROM hi GROUP BY 1)
        SELECT field_id, round(cos(t), 6) AS ax, round(sin(t), 6) AS ay FROM a""",
    "path_metrics": f"""WITH {PX}, o AS (SELECT field_id, row_number() OVER (PARTITION BY field_id ORDER BY ndvi DESC, r, c) AS seq, CAST(c AS DOUBLE) AS x, CAST(r AS DOUBLE) AS y FROM nd QUALIFY seq <= 5),
        s AS (SELECT *, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS byy FROM o WINDOW w AS (PARTITION BY field_id ORDER BY seq)),
        t AS (SELECT *, sqrt(ax * ax + ay * ay) AS step, sqrt(ax * ax + ay * ay) * sqrt(bx * bx + byy * byy) AS nn FROM s)
        SELECT field_id, round(sum(step), 6) AS length, round(max(step), 6) AS longest, round(max(CASE WHEN nn > 0 THEN degrees(acos(greatest(-1.0, least(1.0, (ax * bx + ay * byy) / nn)))) END), 4) AS turn, count(*) AS n FROM t GROUP BY 1""",
    "utm_project": f"WITH {PLACE} SELECT field_id, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6) + 1 AS INT) AS epsg, round({_E}, 3) AS east, round({_N}, 3) AS north FROM pl",
    "ring_area_utm": f"WITH {PLACE}, x AS (SELECT field_id, {_RING} FROM pl) SELECT field_id, round(abs(({_SHOELACE}) / 2) / 10000, 4) AS area_ha FROM x",
    "round_trip": f"WITH {PLACE} SELECT field_id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM pl",
    "coverage_area": f"WITH {GRID}, {EDGE} SELECT field_id, round(abs(sum(x1 * y2 - x2 * y1) / 2), 6) AS area FROM edge WHERE ring = 0 GROUP BY 1",
    "bounding_boxes": f"WITH {GRID}, {EDGE} SELECT field_id, round(min(x), 6) AS min_x, round(min(y), 6) AS min_y, round(max(x), 6) AS max_x, round(max(y), 6) AS max_y FROM corner WHERE ring = 0 GROUP BY 1",
    "cache_upsert_latest": f"WITH {CACHE} SELECT field_id, min_x, id, round(raster, 4) AS raster, ndvi_mean_at_selection, ndvi_metadata FROM st",
    "cache_live": f"WITH {CACHE} SELECT field_id, min_x, id FROM st WHERE expires_at > TIMESTAMP '2024-01-30 12:00:00'",
    "cache_lookup": f"""WITH {CACHE}, a AS (SELECT DISTINCT user_id, CASE WHEN user_id % 5 > 0 THEN user_id END AS field_id, CAST(user_id % 9 + user_id % 2 AS DOUBLE) AS x FROM events)
        SELECT user_id, st.id IS NOT NULL AS hit, st.id FROM a LEFT JOIN st ON a.field_id IS NOT DISTINCT FROM st.field_id AND a.x = st.min_x AND st.expires_at > TIMESTAMP '2024-01-01 00:00:00'""",
    "request_validation": """WITH q AS (SELECT c_custkey AS k, k * 13 % 3000 AS width, k * 7 % 2600 AS height, k % 120 - 10 AS cloud, k % 6 - 1 AS target, k % 110 AS resolution, k % 12 AS smoothing, k % 18 AS points, k * 3 % 400 - 200 AS lon FROM customer),
        e AS (SELECT k, concat_ws(',', CASE WHEN width NOT BETWEEN 1 AND 2500 THEN 'width' END, CASE WHEN height NOT BETWEEN 1 AND 2500 THEN 'height' END, CASE WHEN cloud NOT BETWEEN 0 AND 100 THEN 'max_cloud_cover' END,
          CASE WHEN target <= 0 THEN 'target_plot_size_ha' END, CASE WHEN resolution <= 0 OR resolution > 100 THEN 'resolution_m' END, CASE WHEN smoothing <= 0 OR smoothing > 10 THEN 'line_smoothing' END,
          CASE WHEN points NOT BETWEEN 0 AND 15 THEN 'max_sample_points_per_zone' END, CASE WHEN lon NOT BETWEEN -180 AND 180 THEN 'polygon' END, CASE WHEN k % 4 = 0 AND k % 3 = 0 THEN 'single_zone_override' END) AS errors FROM q)
        SELECT k AS request_id, errors, CASE WHEN errors = '' THEN 'OK' ELSE 'INVALID' END AS status FROM e""",
    "response_headers": f"""WITH {SC}, b AS (SELECT * FROM sc WHERE cloud_cover <= 20.0 QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY cloud_cover, acquired, scene_id) = 1)
        SELECT field_id, concat_ws(';', CASE WHEN cloud_cover > 5 THEN 'X-Cloud-Cover=' || CAST(CAST(floor(cloud_cover) AS BIGINT) AS VARCHAR) END, 'X-Scene=' || CAST(scene_id AS VARCHAR)) AS headers FROM b""",
    "scene_windows": f"""WITH {SC} SELECT strftime(time_bucket(INTERVAL 5 DAYS, acquired, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(round(avg(cloud_cover), 4), 3) AS cloud_cover FROM sc GROUP BY 1""",
    "raster_blobs": """WITH e AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, embedding, unnest(range(0, len(embedding) // 2)) AS i FROM embeddings)
        SELECT vec_id, CAST(i // 8 AS INT) AS r, CAST(i % 8 AS INT) AS c, round(CAST(embedding[2 * i + 1] AS DOUBLE), 6) AS ndvi, round(CAST(embedding[2 * i + 2] AS DOUBLE), 6) AS data_mask FROM e""",
    "gap_filled_cells": f"""WITH b AS ({bisection([])}), {GRID}, near AS (SELECT field_id, r + dr AS r, c + dc AS c, zone, count(*) AS n FROM b, {MOVES} GROUP BY ALL),
        best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY field_id, r, c ORDER BY n DESC, zone) = 1),
        o AS (SELECT g.field_id, g.r, g.c, coalesce(b.zone, best.zone) AS zone FROM grid g LEFT JOIN b USING (field_id, r, c) LEFT JOIN best ON best.field_id = g.field_id AND best.r = g.r AND best.c = g.c),
        far AS (SELECT o.field_id, o.r, o.c, b.zone FROM o JOIN b USING (field_id) WHERE o.zone IS NULL QUALIFY row_number() OVER (PARTITION BY o.field_id, o.r, o.c ORDER BY (o.r - b.r) ** 2 + (o.c - b.c) ** 2, b.zone) = 1)
        SELECT o.field_id, o.r, o.c, coalesce(o.zone, far.zone) AS zone FROM o LEFT JOIN far ON far.field_id = o.field_id AND far.r = o.r AND far.c = o.c WHERE coalesce(o.zone, far.zone) IS NOT NULL""",
    "bisection_tour": f"""WITH RECURSIVE b AS ({bisection([])}),
        p AS (SELECT field_id, zone, min(r * 100 + c) AS a, max(r * 100 + c) AS z FROM b GROUP BY 1, 2),
        e AS (SELECT field_id, zone, false AS rev, a // 100 AS sr, a % 100 AS sc, z // 100 AS er, z % 100 AS ec FROM p UNION ALL SELECT field_id, zone, true, z // 100, z % 100, a // 100, a % 100 FROM p),
        w AS (SELECT field_id, zone, 0 AS visit, rev, er, ec, [zone] AS seen FROM (SELECT * FROM e WHERE NOT rev QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY zone) = 1)
          UNION ALL SELECT field_id, zone, visit, rev, er, ec, seen FROM (SELECT e.field_id, e.zone, w.visit + 1 AS visit, e.rev, e.er, e.ec, list_append(w.seen, e.zone) AS seen,
            row_number() OVER (PARTITION BY e.field_id ORDER BY (e.sr - w.er) ** 2 + (e.sc - w.ec) ** 2, e.zone, e.rev) AS k FROM w JOIN e ON e.field_id = w.field_id AND NOT list_contains(w.seen, e.zone)) WHERE k = 1)
        SELECT field_id, zone, CAST(visit AS INT) AS visit, rev AS reversed FROM w""",
    "farthest_points": """WITH RECURSIVE p AS (SELECT CAST(label AS BIGINT) AS g, CAST(vec_id AS BIGINT) AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
        m AS (SELECT g, avg(x) AS mx, avg(y) AS my FROM p GROUP BY g),
        w AS (SELECT 0 AS seq, g, id, x, y, first_value(id) OVER f AS pick, (x - first_value(x) OVER f) ** 2 + (y - first_value(y) OVER f) ** 2 AS far FROM p JOIN m USING (g) WINDOW f AS (PARTITION BY g ORDER BY (x - mx) ** 2 + (y - my) ** 2 DESC, id)
          UNION ALL SELECT seq + 1, g, id, x, y, first_value(id) OVER f, least(far, (x - first_value(x) OVER f) ** 2 + (y - first_value(y) OVER f) ** 2) FROM w WHERE seq < 7 WINDOW f AS (PARTITION BY g ORDER BY far DESC, id)),
        n AS (SELECT g, seq, any_value(pick) AS id, max(far) AS far FROM w GROUP BY g, seq)
        SELECT g AS "group", CAST(n.seq AS INT) AS seq, n.id FROM n WHERE NOT EXISTS (SELECT 1 FROM n o WHERE o.g = n.g AND o.seq < n.seq AND o.far = 0)""",
    "wkt_outlines": """WITH p AS (SELECT * FROM (VALUES (0, 0.0, 0.0), (1, 0.004, 0.0), (2, 0.004, 0.003), (3, 0.0, 0.003), (4, 0.0, 0.0)) t(seq, x, y))
        SELECT s_suppkey AS field_id, CAST(seq AS INT) AS seq, round(CAST(16.0 + s_suppkey % 9 * 0.5 + x AS DOUBLE), 6) AS lon, round(CAST(50.5 + s_suppkey % 7 * 0.25 + y AS DOUBLE), 6) AS lat FROM supplier, p""",
}
