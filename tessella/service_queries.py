"""Queries of map services' addresses, frusta by their bounds, projections and quaternions, and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import projections, services
from tessella.functions.tiles import Quad
from tessella.functions.vectors import Vec, matrix, num, transform_point, view_matrix
from tessella.functions.volumes import Sphere, visibility
from tessella.queries import _TILES, DEGREES, _query, _read, _tiles

_PLAIN = "rtrim(rtrim(printf('%.12f', {}), '0'), '.')"
_W, _S, _E, _N = (_PLAIN.format(v) for v in ("-180 + x * 360.0 / (2 << level)", "-90 + y * 180.0 / (1 << level)", "-180 + (x + 1) * 360.0 / (2 << level)", "-90 + (y + 1) * 180.0 / (1 << level)"))


@_query(f"""
WITH {_TILES}, u AS (SELECT *, (1 << level) - 1 - y AS north FROM t)
SELECT id, 'https://maps.example.com/ows?SERVICE=WMS&VERSION=1.3.0&REQUEST=GetMap&LAYERS=land&CRS=EPSG:4326&BBOX=' || {_S} || ',' || {_W} || ',' || {_N} || ',' || {_E} || '&WIDTH=256&HEIGHT=256&FORMAT=image/png' AS wms,
  'https://maps.example.com/ows?SERVICE=WMS&VERSION=1.1.1&REQUEST=GetMap&LAYERS=land&SRS=EPSG:4326&BBOX=' || {_W} || ',' || {_S} || ',' || {_E} || ',' || {_N} || '&WIDTH=256&HEIGHT=256&FORMAT=image/png' AS wms_old,
  'https://maps.example.com/wmts?SERVICE=WMTS&REQUEST=GetTile&VERSION=1.0.0&LAYER=land&STYLE=default&TILEMATRIXSET=world&TILEMATRIX=' || CASE level WHEN 0 THEN 'far' WHEN 1 THEN 'near' ELSE CAST(level AS VARCHAR) END || '&TILEROW=' || y || '&TILECOL=' || x || '&FORMAT=image/jpeg&time=now' AS wmts,
  'https://' || CASE (x + y) % 2 WHEN 0 THEN 'a' ELSE 'b' END || '.example.com/land/default/world/' || level || '/' || y || '/' || x || '/now.jpg' AS wmts_path,
  'https://maps.example.com/tms/' || level || '/' || x || '/' || y || '.png' AS tms, 'https://maps.example.com/tms/' || level || '/' || x || '/' || north || '.jpg' AS tms_north,
  'https://maps.example.com/MapServer/tile/' || level || '/' || north || '/' || x AS map_server,
  'https://' || CASE (x + north) % 2 WHEN 0 THEN 't0' ELSE 't1' END || '.example.com/' || coalesce(list_aggregate(list_transform(range(level), lambda i: CAST(((x >> CAST(level - 1 - i AS INT)) & 1) + 2 * ((north >> CAST(level - 1 - i AS INT)) & 1) AS VARCHAR)), 'string_agg', ''), '') || '.jpeg' AS quadkey FROM u
""")
def map_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile's address in each kind of map service."""
    level, x, y = F.col("level"), F.col("x"), F.col("y")
    t = Quad.of()
    north, extent, host = t.flip_y().y, DEGREES.rectangle(t), "https://maps.example.com/"
    columns = {
        "wms": services.wms(host + "ows", extent, "land"),
        "wms_old": services.wms(host + "ows", extent, "land", version="1.1.1"),
        "wmts": services.wmts(host + "wmts", level, x, y, "land", "world", labels=["far", "near"], dimensions={"time": "now"}),
        "wmts_path": services.wmts("https://{s}.example.com/{Layer}/{style}/{TileMatrixSet}/{TileMatrix}/{tileRow}/{TileCol}/{time}.jpg", level, x, y, "land", "world", hosts=["a", "b"], dimensions={"time": "now"}),
        "tms": services.tms(host + "tms/", level, x, y),
        "tms_north": services.tms(host + "tms", level, x, y, "jpg", F.expr("shiftleft(1L, level)")),
        "map_server": services.map_server(host + "MapServer/", level, x, north),
        "quadkey": services.quadkey_url("https://{subdomain}.example.com/{quadkey}.jpeg", level, x, north, ["t0", "t1"]),
    }
    return _tiles(spark, sf_dir).select("id", *(c.alias(name) for name, c in columns.items()))


def _place() -> Vec:
    k = F.col("c_custkey")
    return Vec(k * 7919 % 161 - 80.0, k * 104729 % 151 - 75.0, k * 31 % 120 - 100.0)


_PLACE = "p AS (SELECT c_custkey AS id, (c_custkey * 7919 % 161) - 80.0 AS x, (c_custkey * 104729 % 151) - 75.0 AS y, (c_custkey * 31 % 120) - 100.0 AS z FROM customer), e AS (SELECT id, CAST(x - 1 AS DOUBLE) AS x, CAST(y - 2 AS DOUBLE) AS y, CAST(3 - z AS DOUBLE) AS d FROM p)"


def _judged(distances: str) -> str:
    return f"CASE WHEN least({distances}) < -2.34567 THEN 'outside' WHEN least({distances}) > 2.34567 THEN 'inside' ELSE 'intersecting' END"


@_query(f"""
WITH {_PLACE}
SELECT id, {_judged("(12 * x + 5 * d) / 13, (9 * d - 12 * x) / 15, (12 * y + 16 * d) / 20, (35 * d - 12 * y) / 37, d - 12")} AS window, {_judged("x + 40, 50 - x, y + 30, 60 - y, d - 5")} AS box FROM e
""")
def bounded_frusta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spheres against a lopsided perspective and against parallel rays."""
    ball = Sphere(_place(), num(2.34567))
    eye = (Vec.lit(1, 2, 3), Vec.lit(0, 0, -1), Vec.lit(0, 1, 0))
    window = projections.frustum_of_window(*eye, *map(num, (-5, 9, -16, 35, 12)))
    box = projections.frustum_of_box(*eye, *map(num, (-40, 50, -30, 60, 5)))
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), visibility(ball, window).alias("window"), visibility(ball, box).alias("box"))


@_query("""
WITH a AS (SELECT s_suppkey AS id, radians((s_suppkey * 37 % 360) - 179.5) AS a FROM supplier)
SELECT id, round(CASE WHEN cos(a) > -0.5 THEN sin(a / 2) * sign(cos(a / 2)) ELSE abs(sin(a / 2)) END, 9) AS z, round(CASE WHEN cos(a) > -0.5 THEN abs(cos(a / 2)) ELSE cos(a / 2) * sign(sin(a / 2)) END, 9) AS w,
  round(3 * cos(a) - 4 * sin(a), 9) AS turned_x, round(3 * sin(a) + 4 * cos(a), 9) AS turned_y, round(abs(2 * cos(a)) + abs(3 * sin(a)), 9) AS reach_x, round(-5 * cos(a), 9) AS lifted FROM a
""")
def quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns about z as quaternions, applied to a vector, to a box and, after a change of the upward axis, to a point."""
    angle = F.radians(F.col("s_suppkey") * 37 % 360 - 179.5)
    sin, cos, zero = F.sin(angle), F.cos(angle), num(0)
    df = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), projections.quaternion_of_frame(Vec(-sin, cos, zero), Vec(cos, sin, zero)).alias("q"))
    turned = projections.rotated(F.col("q"), Vec.lit(3, 4, 0))
    box = projections.box_of_rotation(Vec.lit(0, 0, 0), F.col("q"), Vec.lit(2, 3, 4)).to_aabb()
    # z goes to y, then y to the turned y.
    frame = projections.box_of_rotation(Vec.lit(0, 0, 0), F.col("q"), Vec.lit(1, 1, 1)).axes
    lifted = transform_point(projections.corrected(matrix(*frame, Vec.lit(0, 0, 0)), F.lit(2)), Vec.lit(0, 0, -5))
    columns = {"z": F.get("q", 2), "w": F.get("q", 3), "turned_x": turned.x, "turned_y": turned.y, "reach_x": box.max.x, "lifted": lifted.y}
    return df.select("id", *(F.round(c, 9).alias(name) for name, c in columns.items()))


@_query(f"""
WITH {_PLACE}
SELECT id, round(2 * 12 * x / (14 * d) - 4.0 / 14, 9) AS window_x, round(24 * y / (-51 * d) + 19.0 / 51, 9) AS window_y, round((12.0 / 188) * (200 / d - 1), 9) AS depth,
  round((2 * x - 10) / 90, 9) AS box_x, round((30 - 2 * y) / 90, 9) AS box_y, round((200 - d) / 195.0, 9) AS box_depth FROM e WHERE d > 1
""")
def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places before the eye on the screen: a lopsided perspective and parallel rays, both with a far plane at 200."""
    eye = view_matrix(Vec.lit(1, 2, 3), Vec.lit(0, 0, -1), Vec.lit(0, 1, 0))
    p = transform_point(eye, _place())
    far = num(200)
    window = transform_point(projections.perspective_bounds(*map(num, (-5, 9, -16, 35, 12)), far), p)
    box = transform_point(projections.orthographic(*map(num, (-40, 50, -30, 60, 5)), far), p)
    columns = {"window_x": window.x / -p.z, "window_y": window.y / -p.z, "depth": window.z / -p.z, "box_x": box.x, "box_y": box.y, "box_depth": box.z}
    return _read(spark, sf_dir, "customer").where(-p.z > 1).select(F.col("c_custkey").alias("id"), *(F.round(c, 9).alias(name) for name, c in columns.items()))
