"""The queries of the geospatial engine and the SQL they must agree with.

The tables have no geometry: positions are made from integer keys by the same arithmetic in both
engines (longitude and latitude in degrees). Floating results are rounded to what two engines'
mathematical libraries agree on.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import availability, codecs, geodesy, tiles, uris
from tessella.functions.geodesy import WGS84, GlobeRectangle, Projection, Region
from tessella.functions.tiles import Quad, QuadScheme
from tessella.functions.vectors import Vec, num
from tessella.functions.volumes import Aabb, Obb, Plane, Ray, Rectangle, Sphere, barycentric, in_polygon, polygon_boundary_distance
from tessella.operators import metadata, spatial, state
from tessella.plans import selection, trees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DEGREES = QuadScheme(-180.0, -90.0, 180.0, 90.0, 2, 1)


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _lon(k: str) -> Column:
    return F.col(k) * 7919 % 36000 / 100.0 - 180.0


def _lat(k: str) -> Column:
    return F.col(k) * 104729 % 17000 / 100.0 - 85.0


def _points(spark: SparkSession, sf_dir: str, table: str = "customer", key: str = "c_custkey") -> DataFrame:
    """id, lon and lat in degrees, and a height in metres."""
    return _read(spark, sf_dir, table).select(F.col(key).alias("id"), _lon(key).alias("lon"), _lat(key).alias("lat"), (F.col(key) % 97 * 10.0).alias("h"))


_P = "p AS (SELECT c_custkey AS id, (c_custkey * 7919 % 36000) / 100.0 - 180.0 AS lon, (c_custkey * 104729 % 17000) / 100.0 - 85.0 AS lat, (c_custkey % 97) * 10.0 AS h FROM customer)"
_Q = "r AS (SELECT id, radians(lon) AS l, radians(lat) AS f, h FROM p)"


def _rad(df: DataFrame) -> tuple[Column, Column]:
    return F.radians("lon"), F.radians("lat")


# Aggregation by tile


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_rollup(spark, sf_dir)


@_query("""
WITH t AS (SELECT CAST(least(floor(((c_custkey * 7919 % 36000) / 100.0) / 360.0 * 16), 15) AS BIGINT) AS x, CAST(least(floor(((c_custkey * 104729 % 17000) / 100.0 + 5.0) / 180.0 * 8), 7) AS BIGINT) AS y,
  (c_custkey * 7919 % 36000) / 100.0 - 180.0 AS lon, c_acctbal FROM customer)
SELECT x, y, count(*) AS n, round(sum(c_acctbal), 2) AS balance, round(min(lon), 6) AS west, round(max(lon), 6) AS east FROM t GROUP BY x, y
""")
def tile_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, balance and extent of every tile of level 3."""
    df = _read(spark, sf_dir, "customer").select(_lon("c_custkey").alias("lon"), _lat("c_custkey").alias("lat"), "c_acctbal")
    df = df.withColumn("tile", DEGREES.position(F.col("lon"), F.col("lat"), 3))
    grouped = df.groupBy("tile.x", "tile.y").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.round(F.min("lon"), 6).alias("west"), F.round(F.max("lon"), 6).alias("east"))
    return grouped.select("x", "y", "n", "balance", "west", "east")


@_query("""
WITH t AS (SELECT CAST(least(floor(((o_orderkey * 7919 % 36000) / 100.0) / 360.0 * 64), 63) AS BIGINT) AS x, CAST(least(floor(((o_orderkey * 104729 % 17000) / 100.0 + 5.0) / 180.0 * 32), 31) AS BIGINT) AS y, o_totalprice FROM orders),
  l AS (SELECT CAST(5 - k AS INT) AS level, x >> CAST(k AS INT) AS x, y >> CAST(k AS INT) AS y, o_totalprice FROM t, range(6) AS r(k))
SELECT level, x, y, count(*) AS n, round(max(o_totalprice), 2) AS top FROM l GROUP BY level, x, y
""")
def pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of every tile of levels 5 to 0, each level merged from the one below."""
    t = DEGREES.position(_lon("o_orderkey"), _lat("o_orderkey"), 5)
    df = _read(spark, sf_dir, "orders").select(t.alias("t"), "o_totalprice").select("t.x", "t.y", "o_totalprice")
    found = trees.rolled_up(df, [F.count("*").alias("n"), F.round(F.max("o_totalprice"), 2).alias("top")], [F.sum("n").alias("n"), F.max("top").alias("top")], 5)
    return found.select("level", "x", "y", "n", "top")


@_query("""
SELECT x, y, n FROM (SELECT CAST(least(floor(((c_custkey * 7919 % 36000) / 100.0) / 360.0 * 16), 15) AS BIGINT) AS x, CAST(least(floor(((c_custkey * 104729 % 17000) / 100.0 + 5.0) / 180.0 * 8), 7) AS BIGINT) AS y, count(*) AS n
FROM customer GROUP BY 1, 2) ORDER BY n DESC, x, y LIMIT 20
""")
def top_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty tiles of level 3 with most customers."""
    return tile_rollup(spark, sf_dir).select("x", "y", "n").orderBy(F.desc("n"), "x", "y").limit(20)


# Geodesy


@_query(f"""
WITH {_P}, {_Q}, n AS (SELECT *, 6378137.0 / sqrt(1 - 0.0066943799901413165 * sin(f) * sin(f)) AS n FROM r)
SELECT id, round((n + h) * cos(f) * cos(l), 3) + 0.0 AS x, round((n + h) * cos(f) * sin(l), 3) + 0.0 AS y, round((n * (1 - 0.0066943799901413165) + h) * sin(f), 3) + 0.0 AS z FROM n
""")
def ecef(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earth-centred coordinates."""
    df = _points(spark, sf_dir)
    p = WGS84.to_ecef(*_rad(df), F.col("h"))
    return df.select("id", *((F.round(c, 3) + 0.0).alias(k) for k, c in zip("xyz", p.parts())))


@_query(f"WITH {_P} SELECT id, round(lon, 7) AS lon, round(lat, 7) AS lat, round(h, 4) AS h FROM p")
def geodetic_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions to earth-centred points and back: what went in."""
    df = _points(spark, sf_dir).withColumn("p", WGS84.to_ecef(F.radians("lon"), F.radians("lat"), F.col("h")).col())
    lon, lat, h = WGS84.to_geodetic(Vec.of("p"))
    # Longitude -180 is 180 as well.
    turned = F.when((F.abs(F.degrees(lon)) > 179.9999999) & (F.col("lon") < 0), -180.0).otherwise(F.degrees(lon))
    return df.select("id", F.round(turned + 0.0, 7).alias("lon"), F.round(F.degrees(lat) + 0.0, 7).alias("lat"), F.round(h + 0.0, 4).alias("h"))


@_query(f"""
WITH {_P}, {_Q}
SELECT id, round(2 * 6378137.0 * asin(sqrt(least(1, pow(sin((0.7 - f) / 2), 2) + cos(f) * cos(0.7) * pow(sin((CASE WHEN 1.9 - l > pi() THEN 1.9 - l - 2 * pi() ELSE 1.9 - l END) / 2), 2)))), 2) AS d FROM r
""")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Great-circle distance to a fixed place."""
    df = _points(spark, sf_dir)
    lon, lat = _rad(df)
    return df.select("id", F.round(WGS84.haversine(lon, lat, num(1.9), num(0.7)), 2).alias("d"))


@_query("""
WITH s AS (SELECT s_suppkey AS id, radians((s_suppkey * 7919 % 36000) / 100.0 - 180.0) AS l, radians((s_suppkey * 104729 % 17000) / 100.0 - 85.0) AS f FROM supplier)
SELECT id, round(degrees(l), 6) AS lon, round(degrees(f), 6) AS lat, 50000.0 AS d FROM s
""")
def geodesic_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty kilometres along a bearing, and back along the bearing of the inverse problem: where it began, and the distance."""
    df = _points(spark, sf_dir, "supplier", "s_suppkey")
    lon, lat = _rad(df)
    df = df.withColumn("there", WGS84.direct(lon, lat, F.radians(F.col("id") % 350 + 3.0), num(50000)))
    df = df.withColumn("way", WGS84.inverse(F.col("there.lon"), F.col("there.lat"), lon, lat))
    df = df.withColumn("back", WGS84.direct(F.col("there.lon"), F.col("there.lat"), F.col("way.azimuth1"), F.col("way.distance")))
    # On the antimeridian the way back ends on either side of it by a last bit: longitudes run from -180, and 180 is -180.
    df = df.withColumn("lon", F.round(F.degrees("back.lon") + 0.0, 6))
    return df.select("id", F.when(F.col("lon") >= 180, F.col("lon") - 360).otherwise(F.col("lon")).alias("lon"), F.round(F.degrees("back.lat") + 0.0, 6).alias("lat"), F.round("way.distance", 3).alias("d"))


@_query(f"""
WITH {_P}, {_Q}
SELECT id, round(l * 6378137.0, 3) AS x, round(f * 6378137.0, 3) AS gy, round(6378137.0 * 0.5 * ln((1 + sin(greatest(least(f, 1.4844222297453327), -1.4844222297453327))) / (1 - sin(greatest(least(f, 1.4844222297453327), -1.4844222297453327)))), 3) AS my FROM r
""")
def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plate carree and Mercator coordinates."""
    df = _points(spark, sf_dir)
    g, m = (Projection(k).project(*_rad(df)) for k in ("geographic", "mercator"))
    return df.select("id", F.round(g.x, 3).alias("x"), F.round(g.y, 3).alias("gy"), F.round(m.y, 3).alias("my"))


@_query(f"WITH {_P} SELECT id, round(lon, 8) AS lon, round(greatest(least(lat, 85.0511287798066), -85.0511287798066), 8) AS lat FROM p")
def mercator_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _points(spark, sf_dir)
    p = Projection("mercator").project(*_rad(df))
    lon, lat, _ = Projection("mercator").unproject(p)
    return df.select("id", F.round(F.degrees(lon) + 0.0, 8).alias("lon"), F.round(F.degrees(lat) + 0.0, 8).alias("lat"))


@_query(f"""
WITH {_P}, {_Q}, e AS (SELECT id, -sin(l) AS ex, cos(l) AS ey, -sin(f) * cos(l) AS nx, -sin(f) * sin(l) AS ny, cos(f) AS nz FROM r)
SELECT id, round(ex, 9) + 0.0 AS ex, round(ey, 9) + 0.0 AS ey, round(nx, 9) + 0.0 AS nx, round(ny, 9) + 0.0 AS ny, round(nz, 9) + 0.0 AS nz FROM e
""")
def enu_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """East and north at each position on the ellipsoid."""
    df = _points(spark, sf_dir)
    df = df.withColumn("p", WGS84.to_ecef(*_rad(df)).col())
    east, north, _ = WGS84.enu(Vec.of("p"))
    cols = {"ex": east.x, "ey": east.y, "nx": north.x, "ny": north.y, "nz": north.z}
    return df.select("id", *((F.round(c, 9) + 0.0).alias(n) for n, c in cols.items()))


_RECTS = "g AS (SELECT s_suppkey AS sid, (s_suppkey * 7919 % 36000) / 100.0 - 180.0 AS w, (s_suppkey * 104729 % 15000) / 100.0 - 85.0 AS s, 4.0 + s_suppkey % 7 AS size FROM supplier), b AS (SELECT sid, w, s, CASE WHEN w + size > 180 THEN w + size - 360 ELSE w + size END AS e, s + size AS n FROM g)"


def _rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles in degrees at the suppliers; some cross the antimeridian."""
    k, size = F.col("s_suppkey"), 4.0 + F.col("s_suppkey") % 7
    df = _read(spark, sf_dir, "supplier").select(k.alias("sid"), _lon("s_suppkey").alias("w"), (k * 104729 % 15000 / 100.0 - 85.0).alias("s"), size.alias("size"))
    return df.select("sid", "w", "s", F.when(F.col("w") + F.col("size") > 180, F.col("w") + F.col("size") - 360).otherwise(F.col("w") + F.col("size")).alias("e"), (F.col("s") + F.col("size")).alias("n"))


def _globe() -> GlobeRectangle:
    return GlobeRectangle(*(F.radians(c) for c in ("w", "s", "e", "n")))


@_query(f"""
WITH {_RECTS}, o AS (SELECT o_custkey AS cid, CAST(o_custkey % 100 AS BIGINT) AS sid0, count(*) AS m FROM orders GROUP BY 1, 2),
  q AS (SELECT cid, sid0, (cid * 7919 % 36000) / 100.0 - 180.0 AS lon, (cid * 104729 % 17000) / 100.0 - 85.0 AS lat FROM o)
SELECT sid, count(*) AS n FROM q JOIN b ON CASE WHEN e < w THEN lon >= w OR lon <= e ELSE lon BETWEEN w AND e END AND lat BETWEEN s AND n GROUP BY sid
""")
def points_in_globe_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders in each rectangle, the antimeridian split before the tiles are met."""
    rects = _rectangles(spark, sf_dir).withColumn("part", F.explode(_in_degrees(GlobeRectangle(F.col("w"), F.col("s"), F.col("e"), F.col("n")))))
    points = _read(spark, sf_dir, "orders").select("o_custkey").distinct().select(F.col("o_custkey").alias("cid"), _lon("o_custkey").alias("lon"), _lat("o_custkey").alias("lat"))
    met = spatial.points_in_rectangles(points, rects.select("sid", "part"), "lon", "lat", "part", DEGREES, 5)
    return met.groupBy("sid").agg(F.countDistinct("cid").alias("n"))


def _in_degrees(r: GlobeRectangle) -> Column:
    whole = Rectangle(r.west, r.south, r.east, r.north).col()
    left, right = Rectangle(r.west, r.south, num(180), r.north).col(), Rectangle(num(-180), r.south, r.east, r.north).col()
    return F.when(r.east < r.west, F.array(left, right)).otherwise(F.array(whole))


@_query(f"""
WITH {_RECTS}
SELECT sid, round(CASE WHEN e < w THEN e - w + 360 ELSE e - w END, 6) AS width, round(CASE WHEN (w + CASE WHEN e < w THEN e + 360 ELSE e END) / 2 > 180 THEN (w + e + 360) / 2 - 360 ELSE (w + CASE WHEN e < w THEN e + 360 ELSE e END) / 2 END, 6) AS lon,
  round((s + n) / 2, 6) AS lat, CAST(CASE WHEN e < w THEN 2 ELSE 1 END AS INT) AS parts FROM b
""")
def globe_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width, centre and number of parts at the antimeridian."""
    r = _globe()
    lon, lat = r.center()
    return _rectangles(spark, sf_dir).select("sid", F.round(F.degrees(r.width()), 6).alias("width"), F.round(F.degrees(lon), 6).alias("lon"), F.round(F.degrees(lat), 6).alias("lat"), F.size(r.split()).alias("parts"))


@_query(f"""
WITH {_RECTS}, t AS (SELECT sid, w, s, e, n, unnest([-360, 0, 360]) AS k FROM b),
  x AS (SELECT sid, greatest(w, 150 + k) AS lo, least(CASE WHEN e < w THEN e + 360 ELSE e END, 210 + k) AS hi, greatest(s, -40.0) AS lo_y, least(n, 40.0) AS hi_y FROM t)
SELECT sid, round(hi - lo, 6) AS width, round(lo_y, 6) AS south, round(hi_y, 6) AS north FROM x WHERE lo < hi - 1e-9 AND lo_y < hi_y - 1e-9
""")
def globe_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rectangle shares with one that crosses the antimeridian."""
    band = GlobeRectangle.degrees(150, -40, -150, 40)
    df = _rectangles(spark, sf_dir).withColumn("x", _globe().intersection(band)).where("x is not null")
    r = GlobeRectangle.of("x")
    df = df.select("sid", F.round(F.degrees(r.width()), 6).alias("width"), F.round(F.degrees(r.south), 6).alias("south"), F.round(F.degrees(r.north), 6).alias("north"))
    return df.where("width > 1e-6 and north - south > 1e-6")


@_query("""
WITH p AS (SELECT c_nationkey AS nation, (c_custkey * 7919 % 6000) / 100.0 + 150.0 AS a, (c_custkey * 104729 % 17000) / 100.0 - 85.0 AS lat FROM customer)
SELECT nation, round(min(a) - CASE WHEN min(a) > 180 THEN 360 ELSE 0 END, 6) AS west, round(max(a) - CASE WHEN min(a) > 180 THEN 360 ELSE 0 END, 6) AS reach, round(min(lat), 6) AS south, round(max(lat), 6) AS north FROM p GROUP BY nation
""")
def extents_over_the_antimeridian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rectangle of each nation's positions between 150 east and 150 west, free of order."""
    east = F.col("c_custkey") * 7919 % 6000 / 100.0 + 150.0
    lon = F.when(east > 180, east - 360).otherwise(east)
    df = _read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.radians(lon).alias("lon"), F.radians(_lat("c_custkey")).alias("lat"))
    df = df.groupBy("nation").agg(*geodesy.extent_aggregate(F.col("lon"), F.col("lat"))).withColumn("r", geodesy.extent())
    r = GlobeRectangle.of("r")
    return df.select("nation", *(F.round(F.degrees(c), 6).alias(n) for n, c in {"west": r.west, "reach": r.west + r.width(), "south": r.south, "north": r.north}.items()))


@_query(f"""
WITH {_P}, {_Q} SELECT id, CASE WHEN cos(f) * cos(l) < 1.0 / 3 THEN true ELSE false END AS hidden FROM r
""")
def horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on a sphere that the horizon hides from a camera at three radii."""
    ball = geodesy.Ellipsoid(1.0, 1.0)
    df = _points(spark, sf_dir)
    p = ball.to_ecef(*_rad(df))
    return df.select("id", ball.is_occluded(Vec.lit(3, 0, 0), p).alias("hidden"))


# Volumes


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, k, label, x, y, z): consecutive triples of the embeddings."""
    df = _read(spark, sf_dir, "embeddings")
    at = F.explode(F.sequence(F.lit(0), F.floor(F.size("embedding") / 3).cast("int") - 1)).alias("k")
    df = df.select(F.col("vec_id").alias("id"), "label", "embedding", at)
    return df.select("id", "k", "label", *(F.get("embedding", F.col("k") * 3 + i).cast("double").alias(c) for i, c in enumerate("xyz")))


_T = "e AS (SELECT vec_id AS id, label, embedding, unnest(range(len(embedding) // 3)) AS i FROM embeddings), t AS (SELECT id, CAST(i AS INT) AS k, label, CAST(embedding[3 * i + 1] AS DOUBLE) AS x, CAST(embedding[3 * i + 2] AS DOUBLE) AS y, CAST(embedding[3 * i + 3] AS DOUBLE) AS z FROM e)"


def _xyz() -> Vec:
    return Vec(F.col("x"), F.col("y"), F.col("z"))


@_query(f"WITH {_T} SELECT label, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM t GROUP BY label")
def boxes_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.functions.volumes import aabb_aggregate

    return _triples(spark, sf_dir).groupBy("label").agg(*aabb_aggregate(_xyz()))


_D = "pow(greatest(0.1 - x, 0, x - 0.5), 2) + pow(greatest(-0.2 - y, 0, y - 0.2), 2) + pow(greatest(0.0 - z, 0, z - 0.3), 2)"


@_query(f"""
WITH {_T} SELECT id, k, round({_D}, 9) AS box, round(pow(greatest(sqrt(x * x + y * y + z * z) - 0.4, 0), 2), 9) AS ball,
  round(pow(greatest(abs(x + y) / sqrt(2) - 0.5, 0), 2) + pow(greatest(abs(x - y) / sqrt(2) - 0.25, 0), 2) + pow(greatest(abs(z) - 0.1, 0), 2), 9) AS turned,
  ({_D}) = 0 AS inside FROM t
""")
def distances_to_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distances to an aligned box, a ball and a turned box, and whether the box holds the point."""
    box, ball = Aabb(Vec.lit(0.1, -0.2, 0.0), Vec.lit(0.5, 0.2, 0.3)), Sphere(Vec.lit(0, 0, 0), num(0.4))
    r = math.sqrt(0.5)
    turned = Obb(Vec.lit(0, 0, 0), (Vec.lit(0.5 * r, 0.5 * r, 0), Vec.lit(0.25 * r, -0.25 * r, 0), Vec.lit(0, 0, 0.1)))
    p = _xyz()
    return _triples(spark, sf_dir).select("id", "k", *(F.round(v.distance_squared(p), 9).alias(n) for n, v in (("box", box), ("ball", ball), ("turned", turned))), box.contains(p).alias("inside"))


@_query(f"""
WITH {_T}, d AS (SELECT id, k, (x + 2 * y + 2 * z) / 3 - 0.1 AS d FROM t)
SELECT id, k, CASE WHEN d < -0.05 THEN 'outside' WHEN d > 0.05 THEN 'inside' ELSE 'intersecting' END AS ball, CASE WHEN d < -0.05 * 5 / 3 THEN 'outside' WHEN d > 0.05 * 5 / 3 THEN 'inside' ELSE 'intersecting' END AS box FROM d
""")
def plane_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ball and a cube around each point against a plane."""
    plane = Plane.coefficients(num(1), num(2), num(2), num(-0.3))
    p = _xyz()
    return _triples(spark, sf_dir).select("id", "k", Sphere(p, num(0.05)).plane(plane).alias("ball"), Aabb.around(p, Vec.lit(0.05, 0.05, 0.05)).plane(plane).alias("box"))


@_query(f"""
WITH {_T}, u AS (SELECT id, k, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM t) WHERE n > 0),
  s AS (SELECT *, -(2 * x) AS b, 4 - 1 AS c FROM (SELECT id, k, -x AS x, -y AS y, -z AS z FROM u)),
  h AS (SELECT id, k, x, y, z, b * b - c AS disc, -2 * x AS bb FROM s)
SELECT id, k, CASE WHEN disc >= 0 AND -2 * x - sqrt(greatest(disc, 0)) >= 0 THEN round(-2 * x - sqrt(greatest(disc, 0)), 8) END AS ball, CASE WHEN abs(x) >= 1e-15 AND -2 / x >= 0 THEN round(-2 / x, 6) END AS plane FROM h
""")
def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From (2, 0, 0) in the direction opposite to each triple: the unit ball and the plane x = 0."""
    away = _xyz().unit()
    df = _triples(spark, sf_dir).where(_xyz().length() > 0).withColumn("d", (-away).col())
    d = Vec.of("d")
    ray = Ray(Vec.lit(2, 0, 0), d)
    return df.select("id", "k", F.round(ray.sphere(Sphere(Vec.lit(0, 0, 0), num(1))), 8).alias("ball"), F.round(ray.plane(Plane(Vec.lit(1, 0, 0), num(0))), 6).alias("plane"))


_STAR = [(-100, -50), (-20, 60), (30, -10), (90, 70), (120, -60), (20, -30)]
_EDGES = ", ".join(f"({a[0]}.0, {a[1]}.0, {b[0]}.0, {b[1]}.0)" for a, b in zip(_STAR, _STAR[1:] + _STAR[:1]))


@_query(f"""
WITH {_P}, e(ax, ay, cx, cy) AS (VALUES {_EDGES}),
  w AS (SELECT id, sum(CASE WHEN ay <= lat AND cy > lat AND (cx - ax) * (lat - ay) - (lon - ax) * (cy - ay) > 0 THEN 1 WHEN ay > lat AND cy <= lat AND (cx - ax) * (lat - ay) - (lon - ax) * (cy - ay) < 0 THEN -1 ELSE 0 END) AS turns,
    min(sqrt(pow(lon - ax - greatest(0, least(1, ((lon - ax) * (cx - ax) + (lat - ay) * (cy - ay)) / (pow(cx - ax, 2) + pow(cy - ay, 2)))) * (cx - ax), 2) + pow(lat - ay - greatest(0, least(1, ((lon - ax) * (cx - ax) + (lat - ay) * (cy - ay)) / (pow(cx - ax, 2) + pow(cy - ay, 2)))) * (cy - ay), 2))) AS d FROM p, e GROUP BY id)
SELECT id, turns <> 0 AS inside, round(d, 6) AS edge FROM w
""")
def polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inside a polygon by the winding rule, and the distance to its edge."""
    corners = F.array(*(F.struct(num(x).alias("x"), num(y).alias("y")) for x, y in _STAR))
    return _points(spark, sf_dir).select("id", in_polygon(F.col("lon"), F.col("lat"), corners).alias("inside"), F.round(polygon_boundary_distance(F.col("lon"), F.col("lat"), corners), 6).alias("edge"))


@_query(f"WITH {_T} SELECT id, k, round(1 - x / 2 - y / 3, 9) AS a, round(x / 2, 9) AS b, round(y / 3, 9) AS c FROM t")
def triangle_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = barycentric(_xyz(), Vec.lit(0, 0, 0), Vec.lit(2, 0, 0), Vec.lit(0, 3, 0))
    return _triples(spark, sf_dir).select("id", "k", *(F.round(v, 9).alias(n) for n, v in zip("abc", w.parts())))


@_query("""
WITH s AS (SELECT s_suppkey AS sid, s_nationkey AS nation, (s_suppkey * 7919 % 36000) / 100.0 - 180.0 AS x0, (s_suppkey * 104729 % 15000) / 100.0 - 85.0 AS y0, 5.0 + s_suppkey % 9 AS n FROM supplier),
  r AS (SELECT sid, x0, y0, least(x0 + n, 180.0) AS x1, y0 + n AS y1 FROM s)
SELECT a.sid AS a, b.sid AS b FROM r a JOIN r b ON a.sid < b.sid AND greatest(a.x0, b.x0) < least(a.x1, b.x1) AND greatest(a.y0, b.y0) < least(a.y1, b.y1)
""")
def rectangle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs of rectangles, by the tiles that both meet."""
    k, size = F.col("s_suppkey"), 5.0 + F.col("s_suppkey") % 9
    x, y = _lon("s_suppkey"), k * 104729 % 15000 / 100.0 - 85.0
    df = _read(spark, sf_dir, "supplier").select(k.alias("sid"), Rectangle(x, y, F.least(x + size, F.lit(180.0)), y + size).col().alias("r"))
    met = spatial.rectangles_meeting(df.select(F.col("sid").alias("a"), F.col("r").alias("ra")), df.select(F.col("sid").alias("b"), F.col("r").alias("rb")), "ra", "rb", DEGREES, 5)
    return met.where("a < b").select("a", "b")


@_query("""
WITH s AS (SELECT s_suppkey AS sid, (s_suppkey * 7919 % 36000) / 100.0 - 180.0 AS x0, (s_suppkey * 104729 % 15000) / 100.0 - 85.0 AS y0, 5.0 + s_suppkey % 9 AS n FROM supplier),
  r AS (SELECT sid, x0, y0, least(x0 + n, 180.0) AS x1, y0 + n AS y1 FROM s), c AS (SELECT c_custkey AS cid, (c_custkey * 7919 % 36000) / 100.0 - 180.0 AS lon, (c_custkey * 104729 % 17000) / 100.0 - 85.0 AS lat FROM customer)
SELECT cid, sid FROM c JOIN r ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1
""")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in suppliers' rectangles."""
    k, size = F.col("s_suppkey"), 5.0 + F.col("s_suppkey") % 9
    x, y = _lon("s_suppkey"), k * 104729 % 15000 / 100.0 - 85.0
    rects = _read(spark, sf_dir, "supplier").select(k.alias("sid"), Rectangle(x, y, F.least(x + size, F.lit(180.0)), y + size).col().alias("r"))
    points = _points(spark, sf_dir).select(F.col("id").alias("cid"), "lon", "lat")
    return spatial.points_in_rectangles(points, rects, "lon", "lat", "r", DEGREES, 5).select("cid", "sid")


# Tiles


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile of level key % 12 for each order."""
    level = (F.col("o_orderkey") % 12).cast("int")
    t = DEGREES.position(_lon("o_orderkey"), _lat("o_orderkey"), level)
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), t.alias("t")).select("id", "t.level", "t.x", "t.y")


_TILES = "t AS (SELECT o_orderkey AS id, CAST(o_orderkey % 12 AS INT) AS level, CAST(least(floor(((o_orderkey * 7919 % 36000) / 100.0) / 360.0 * (2 << CAST(o_orderkey % 12 AS INT))), (2 << CAST(o_orderkey % 12 AS INT)) - 1) AS BIGINT) AS x, CAST(least(floor(((o_orderkey * 104729 % 17000) / 100.0 + 5.0) / 180.0 * (1 << CAST(o_orderkey % 12 AS INT))), (1 << CAST(o_orderkey % 12 AS INT)) - 1) AS BIGINT) AS y FROM orders)"
_MORTON = "CAST(list_sum(list_transform(range(13), lambda i: ((({x}) >> CAST(i AS INT)) & 1) * CAST(pow(4, i) AS BIGINT) + ((({y}) >> CAST(i AS INT)) & 1) * CAST(pow(4, i) AS BIGINT) * 2)) AS BIGINT)"


@_query(f"""
WITH {_TILES}
SELECT id, {_MORTON.format(x="x", y="y")} AS morton, CASE WHEN level > 0 THEN x >> 1 END AS px, CASE WHEN level > 0 THEN y >> 1 END AS py, level - level % 4 AS root, x >> (level % 4) AS root_x, y >> (level % 4) AS root_y,
  {_MORTON.format(x="x & ((1 << (level % 4)) - 1)", y="y & ((1 << (level % 4)) - 1)")} AS relative, (1 << level) - 1 - y AS flipped FROM t
""")
def tile_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Morton code, parent, subtree root, code within the subtree, and the row from the north."""
    t = Quad.of()
    root = t.subtree_root(4)
    return _tiles(spark, sf_dir).select(
        "id", t.morton().alias("morton"), t.parent()["x"].alias("px"), t.parent()["y"].alias("py"), root.level.alias("root"), root.x.alias("root_x"), root.y.alias("root_y"), t.relative_morton(4).alias("relative"), t.flip_y().y.alias("flipped")
    )


@_query(f"""
WITH {_TILES}
SELECT id, round(-180 + x * 360.0 / (2 << level), 9) AS minx, round(-90 + y * 180.0 / (1 << level), 9) AS miny, round(-180 + (x + 1) * 360.0 / (2 << level), 9) AS maxx, round(-90 + (y + 1) * 180.0 / (1 << level), 9) AS maxy FROM t
""")
def tile_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _tiles(spark, sf_dir).withColumn("r", DEGREES.tile_rectangle(Quad.of()))
    return df.select("id", *(F.round(F.col(f"r.{c}"), 9).alias(c) for c in ("minx", "miny", "maxx", "maxy")))


@_query(f"WITH {_TILES}, c AS (SELECT id, level, x, y, unnest([0, 1, 2, 3]) AS k FROM t) SELECT id, CAST(level + 1 AS INT) AS level, x * 2 + k % 2 AS x, y * 2 + k // 2 AS y FROM c")
def tile_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _tiles(spark, sf_dir).select("id", F.explode(Quad.of().children()).alias("c"))
    return df.select("id", "c.level", "c.x", "c.y")


@_query("""
WITH r AS (SELECT s_suppkey AS sid, (s_suppkey * 7919 % 30000) / 100.0 - 180.0 AS x0, (s_suppkey * 104729 % 12000) / 100.0 - 85.0 AS y0, 7.3 + s_suppkey % 11 AS n FROM supplier),
  i AS (SELECT sid, CAST(floor((x0 + 180) / 360 * 128) AS BIGINT) AS a, CAST(ceil((x0 + n + 180) / 360 * 128) AS BIGINT) - 1 AS b, CAST(floor((y0 + 90) / 180 * 64) AS BIGINT) AS c, CAST(ceil((y0 + n + 90) / 180 * 64) AS BIGINT) - 1 AS d FROM r)
SELECT sid, x, y FROM (SELECT sid, unnest(range(a, b + 1)) AS x, c, d FROM i) AS q, LATERAL (SELECT unnest(range(c, d + 1)) AS y)
""")
def tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiles of level 6 that each rectangle meets."""
    k = F.col("s_suppkey")
    x, y, n = k * 7919 % 30000 / 100.0 - 180.0, k * 104729 % 12000 / 100.0 - 85.0, 7.3 + k % 11
    df = _read(spark, sf_dir, "supplier").select(k.alias("sid"), F.explode(DEGREES.cover(Rectangle(x, y, x + n, y + n), 6)).alias("t"))
    return df.select("sid", "t.x", "t.y")


@_query(f"""
WITH {_TILES}, have AS (SELECT DISTINCT CAST(p_partkey % 6 AS INT) AS level, CAST(least(floor(((p_partkey * 7919 % 36000) / 100.0) / 360.0 * (2 << CAST(p_partkey % 6 AS INT))), (2 << CAST(p_partkey % 6 AS INT)) - 1) AS BIGINT) AS x,
  CAST(least(floor(((p_partkey * 104729 % 17000) / 100.0 + 5.0) / 180.0 * (1 << CAST(p_partkey % 6 AS INT))), (1 << CAST(p_partkey % 6 AS INT)) - 1) AS BIGINT) AS y FROM part),
  u AS (SELECT DISTINCT level, x, y FROM t)
SELECT u.level, u.x, u.y, max(h.level) AS ancestor_level FROM u LEFT JOIN have h ON h.level <= u.level AND h.x = u.x >> (u.level - h.level) AND h.y = u.y >> (u.level - h.level) GROUP BY u.level, u.x, u.y
""")
def ancestor_with_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest ancestor of each tile that has content: an as-of join along the tree."""
    level = (F.col("p_partkey") % 6).cast("int")
    have = _read(spark, sf_dir, "part").select(DEGREES.position(_lon("p_partkey"), _lat("p_partkey"), level).alias("t")).select("t.level", "t.x", "t.y")
    return spatial.nearest_ancestor(_tiles(spark, sf_dir).select("level", "x", "y").distinct(), have, 12)


@_query("""
WITH p AS (SELECT p_partkey AS id, md5(p_name || p_partkey) AS h, p_partkey * 37 % 140 AS pos FROM part),
  b AS (SELECT id, pos, h, list_transform(range(128), lambda i: ((instr('0123456789abcdef', substr(h, CAST(i // 8 * 2 + CASE WHEN i % 8 >= 4 THEN 1 ELSE 2 END AS BIGINT), 1)) - 1) >> CAST(i % 4 AS INT)) & 1) AS bits FROM p)
SELECT id, pos, CASE WHEN pos < 128 THEN bits[pos + 1] = 1 ELSE false END AS available, CAST(coalesce(list_sum(bits[1:pos]), 0) AS INT) AS before, CAST(list_sum(bits) AS INT) AS total FROM b
""")
def availability_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership, rank and count in bitstreams of 128 bits, some asked beyond their end."""
    df = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.unhex(F.md5(F.concat("p_name", F.col("p_partkey").cast("string")))).alias("bits"), (F.col("p_partkey") * 37 % 140).alias("pos"))
    b, at = F.col("bits"), F.col("pos")
    return df.select("id", "pos", availability.is_set(b, at).alias("available"), availability.rank(b, at).cast("int").alias("before"), availability.count_set(b).cast("int").alias("total"))


@_query(f"""
WITH {_TILES}, u AS (SELECT DISTINCT level, x, y FROM t), r AS (SELECT CAST(s_suppkey % 12 AS INT) AS level, s_suppkey * 31 % (2 << CAST(s_suppkey % 12 AS INT)) AS x0, s_suppkey * 17 % (1 << CAST(s_suppkey % 12 AS INT)) AS y0, s_suppkey % 90 AS n FROM supplier)
SELECT u.level, u.x, u.y, bool_or(r.level IS NOT NULL) AS available FROM u LEFT JOIN r ON r.level = u.level AND u.x BETWEEN r.x0 AND r.x0 + r.n AND u.y BETWEEN r.y0 AND r.y0 + r.n GROUP BY u.level, u.x, u.y
""")
def availability_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles in rectangles of tile ranges."""
    k = F.col("s_suppkey")
    level = (k % 12).cast("int")
    x, y = F.expr("s_suppkey * 31 % shiftleft(2L, cast(s_suppkey % 12 as int))"), F.expr("s_suppkey * 17 % shiftleft(1L, cast(s_suppkey % 12 as int))")
    ranges = _read(spark, sf_dir, "supplier").select(level.alias("level"), x.alias("start_x"), y.alias("start_y"), (x + k % 90).alias("end_x"), (y + k % 90).alias("end_y"))
    return availability.in_ranges(_tiles(spark, sf_dir).select("level", "x", "y").distinct(), ranges)


@_query(f"""
WITH {_TILES} SELECT id, round(8 * (0.25 * 6378137.0 / 65) * 2 * pi() / (2 * pow(2, level)), 3) AS error, CAST(least(greatest(round(log2(360.0 * 512 / 256 / (360.0 / (2 << level)))), 0), 30) AS INT) AS imagery FROM t
""")
def tile_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain error and the imagery level of 512 pixels for each tile."""
    width = 360.0 / F.expr("shiftleft(2L, level)")
    return _tiles(spark, sf_dir).select("id", F.round(geodesy.terrain_error(F.col("level")), 3).alias("error"), tiles.imagery_level(width, 360.0, 512).alias("imagery"))


@_query("SELECT c_custkey AS id, c_custkey + 1 AS cell, CAST(c_custkey % 29 + 1 AS INT) AS level, true AS up, true AS token FROM customer")
def s2_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 cells made of keys: level, parent of the first child, and the token's round trip."""
    k = F.col("c_custkey")
    low = F.pow(F.lit(2.0), 2 * (30 - (k % 29 + 1))).cast("long")
    # The cell's own place: any number of whole steps from the first cell of its level.
    cell = F.shiftleft(k % 6, 61).bitwiseOR(low)
    df = _read(spark, sf_dir, "customer").select(k.alias("id"), (k + 1).alias("cell"), cell.alias("c"))
    kids = tiles.s2_children(F.col("c"))
    up = tiles.s2_parent(F.get(kids, 2)) == F.col("c")
    token = tiles.s2_from_token(tiles.s2_token(F.col("c"))) == F.col("c")
    return df.select("id", "cell", tiles.s2_level(F.col("c")).alias("level"), up.alias("up"), token.alias("token"))


# Trees and views


@_query("""
WITH leaf AS (SELECT n_regionkey AS region, n_nationkey AS nation, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
  n AS (SELECT region, nation, count(*) AS held, max(c_acctbal) AS top, bool_and(c_acctbal > -900) AS every FROM leaf GROUP BY 1, 2)
SELECT 'nation ' || nation AS node, held, top, every FROM n
UNION ALL SELECT 'region ' || region, CAST(sum(held) AS BIGINT), max(top), bool_and(every) FROM n GROUP BY region
UNION ALL SELECT 'world', CAST(sum(held) AS BIGINT), max(top), bool_and(every) FROM n
""")
def bottom_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers folded up the tree of nations, regions and the world."""
    from tessella.storage import Scratch

    n, r = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    held = _read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("h"), F.max("c_acctbal").alias("t"), F.bool_and(F.col("c_acctbal") > -900).alias("e")).join(n, "n_nationkey")
    name = lambda kind, k: F.concat(F.lit(kind + " "), F.col(k).cast("string"))
    none = [F.lit(None).cast("long").alias("h"), F.lit(None).cast("double").alias("t"), F.lit(None).cast("boolean").alias("e")]
    nodes = held.select(name("nation", "n_nationkey").alias("node"), name("region", "n_regionkey").alias("parent"), F.lit(2).alias("depth"), "h", "t", "e")
    nodes = nodes.unionByName(r.join(held.select(F.col("n_regionkey").alias("r_regionkey")).distinct(), "r_regionkey", "left_semi").select(name("region", "r_regionkey").alias("node"), F.lit("world").alias("parent"), F.lit(1).alias("depth"), *none))
    nodes = nodes.unionByName(spark.range(1).select(F.lit("world").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), *none))
    pick = lambda mine, kids: F.coalesce(kids, mine)
    found = trees.fold_up(
        nodes, ["node"], ["parent"], "depth", {"held": F.col("h"), "top": F.col("t"), "every": F.col("e")}, {"held": F.sum, "top": F.max, "every": F.bool_and}, {"held": pick, "top": pick, "every": pick}, Scratch(spark, "bottom-up")
    )
    return found.select("node", "held", "top", "every")


LOD_LEVELS, LOD_ERROR = 6, 40000.0


def lod_tiles(spark: SparkSession, levels: int = LOD_LEVELS) -> DataFrame:
    """A quadtree of flat boxes over the degrees of the globe, its error halved at each level."""
    df = trees.quadtree(spark, levels, 2, 1)
    t = Quad.of()
    r = DEGREES.rectangle(t)
    box = Aabb(Vec(r.minx, r.miny, num(0)), Vec(r.maxx, r.maxy, num(0)))
    number = lambda level, x, y: F.shiftleft(level.cast("long"), 40) + tiles.morton_2d(x, y)
    return df.select(
        number(t.level, t.x, t.y).alias("tile_id"), F.when(t.level > 0, number(t.level - 1, F.shiftright("x", 1), F.shiftright("y", 1))).alias("parent_id"), "level", "x", "y",
        (LOD_ERROR / 1000.0 / F.pow(F.lit(2.0), t.level)).alias("geometric_error"), F.lit("replace").alias("refine"), (t.level < levels - 1).alias("has_children"),
        F.lit(True).alias("has_content"), F.lit(True).alias("ready"), F.lit(False).alias("unconditional"), box.col().alias("bounds"),
    )


def lod_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One camera for each supplier, above its place, looking down."""
    k = "s_suppkey"
    at = {"px": _lon(k), "py": _lat(k), "pz": 1.0 + F.col(k) % 40, "dx": num(0), "dy": num(0), "dz": num(-1), "ux": num(0), "uy": num(1), "uz": num(0), "height": num(600), "fov_x": num(math.pi / 2), "fov_y": num(math.pi / 2)}
    return _read(spark, sf_dir, "supplier").select(F.col(k).alias("frame"), F.lit(0).alias("view_id"), *(c.cast("double").alias(n) for n, c in at.items()))


_LOD = f"""
WITH RECURSIVE v AS (SELECT s_suppkey AS frame, (s_suppkey * 7919 % 36000) / 100.0 - 180.0 AS px, (s_suppkey * 104729 % 17000) / 100.0 - 85.0 AS py, 1.0 + s_suppkey % 40 AS pz FROM supplier),
  w AS (SELECT frame, px, py, pz, 0 AS level, x, CAST(0 AS BIGINT) AS y FROM v, (SELECT unnest([0::BIGINT, 1::BIGINT]) AS x)
    UNION ALL SELECT frame, px, py, pz, level + 1, x * 2 + k % 2, y * 2 + k // 2 FROM w, range(4) AS r(k)
    WHERE level < {LOD_LEVELS - 1} AND (level = 0 OR pow(greatest(-180 + x * 360.0 / (2 << level) - px, 0, px + 180 - (x + 1) * 360.0 / (2 << level)), 2) + pow(greatest(-90 + y * 180.0 / (1 << level) - py, 0, py + 90 - (y + 1) * 180.0 / (1 << level)), 2) + pz * pz <= 3600)
      AND {LOD_ERROR / 1000.0} / pow(2, level) * 600 / (sqrt(pow(greatest(-180 + x * 360.0 / (2 << level) - px, 0, px + 180 - (x + 1) * 360.0 / (2 << level)), 2) + pow(greatest(-90 + y * 180.0 / (1 << level) - py, 0, py + 90 - (y + 1) * 180.0 / (1 << level)), 2) + pz * pz) * 2) > 160),
  d AS (SELECT frame, level, x, y, sqrt(pow(greatest(-180 + x * 360.0 / (2 << level) - px, 0, px + 180 - (x + 1) * 360.0 / (2 << level)), 2) + pow(greatest(-90 + y * 180.0 / (1 << level) - py, 0, py + 90 - (y + 1) * 180.0 / (1 << level)), 2) + pz * pz) AS d FROM w)
"""


def _lod(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = selection.Options(threshold=160.0, levels=LOD_LEVELS, frustum=False, fog_density=math.sqrt(-math.log(1e-4)) / 60)
    grid = lod_tiles(spark)
    return selection.select_tiles(grid, lod_views(spark, sf_dir), options=options).join(grid.select("tile_id", "x", "y"), "tile_id")


@_query(_LOD + f"""SELECT frame, CAST(level AS INT) AS level, x, y, round(d, 6) AS distance FROM d WHERE d <= 60 AND (level = {LOD_LEVELS - 1} OR {LOD_ERROR / 1000.0} / pow(2, level) * 600 / (d * 2) <= 160)""")
def view_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles that each camera's frame shows at a screen-space error of 160 pixels, fog ending at 60 degrees."""
    return _lod(spark, sf_dir).where("selected").select("frame", "level", "x", "y", F.round("distance", 6).alias("distance"))


@_query(_LOD + "SELECT frame, CAST(level AS INT) AS level, count(*) AS visited, count(*) FILTER (d > 60) AS culled FROM d GROUP BY frame, level")
def view_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles visited and culled by level and frame."""
    return _lod(spark, sf_dir).groupBy("frame", "level").agg(F.count("*").alias("visited"), F.count(F.when(F.col("culled"), 1)).alias("culled"))


@_query(f"""
WITH t AS (SELECT o_orderkey AS tile_id, o_custkey % 50 AS frame, CASE WHEN o_orderkey % 5 = 0 THEN 255 WHEN o_orderkey % 3 = 0 THEN 64 ELSE 128 END AS load_group, o_orderkey % 9 AS a, o_totalprice AS b, (o_orderkey * 7919 % 1000) / 1000.0 AS c, 1 / (1.0 + o_orderkey % 77) AS e FROM orders),
  m AS (SELECT frame, min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1, min(c) AS c0, max(c) AS c1, min(e) AS e0, max(e) AS e1 FROM t GROUP BY frame),
  s AS (SELECT t.frame, tile_id, load_group, 4 * 0.25 * 1.0 - ((a - a0) * 1.0 / greatest(a1 - a0, 1.0) + (b - b0) / greatest(b1 - b0, 1e-10) + (c - c0) / greatest(c1 - c0, 1e-10) + (e - e0) / greatest(e1 - e0, 1e-10)) / 4 AS score FROM t JOIN m USING (frame)),
  q AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY load_group DESC, score DESC, tile_id) AS rank FROM s)
SELECT frame, tile_id, CAST(load_group AS INT) AS load_group, round(score, 9) AS score, CAST(rank AS INT) AS rank FROM q WHERE rank <= 20
""")
def load_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty loads of each frame, by group and normalised score."""
    k = F.col("o_orderkey")
    rows = _read(spark, sf_dir, "orders").select(
        k.alias("tile_id"), (F.col("o_custkey") % 50).alias("frame"), F.when(k % 5 == 0, 255).when(k % 3 == 0, 64).otherwise(128).alias("load_group"), (k % 9).alias("level"), F.col("o_totalprice").alias("distance"), (k * 7919 % 1000 / 1000.0).alias("off_axis"), (1.0 + k % 77).alias("sse")
    )
    return selection.load_queue(rows).withColumn("score", F.round("score", 9))


# State


_KIND = "CASE event_type WHEN 'purchase' THEN 'empty' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'retry' ELSE 'loaded' END"


def _load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    kind = F.when(e == "purchase", "empty").when(e == "error", "failed").when(e == "signup", "retry").otherwise("loaded")
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("tile_id"), "ts", "event_id", kind.alias("kind"), F.floor("value").cast("long").alias("size"))


@_query(f"""
WITH e AS (SELECT user_id AS tile_id, ts, event_id, {_KIND} AS kind, CAST(floor(value) AS BIGINT) AS size FROM events),
  o AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY ts, event_id) AS i, max(CASE WHEN kind IN ('loaded', 'empty') THEN 1 ELSE 0 END) OVER (PARTITION BY tile_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS settled FROM e),
  l AS (SELECT tile_id, arg_max(kind, i) AS kind, arg_max(size, i) AS size, least(count(*) FILTER (settled = 0 AND kind = 'retry'), 4) AS retries FROM o GROUP BY tile_id)
SELECT tile_id, CASE WHEN kind = 'retry' AND retries > 3 THEN 'failed' WHEN kind = 'retry' THEN 'retry' ELSE kind END AS state, CAST(retries AS INT) AS retries, CASE WHEN kind = 'loaded' THEN size ELSE 0 END AS bytes FROM l
""")
def tile_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each tile after all its load events, three retries allowed."""
    return state.fold_events(_load_events(spark, sf_dir), "tile_id", ["ts", "event_id"], F.col("kind"), F.col("size")).select("tile_id", "state", "retries", "bytes")


@_query(f"""
WITH e AS (SELECT user_id AS tile_id, {_KIND} AS kind, CAST(floor(value) AS BIGINT) AS size FROM events)
SELECT kind, count(*) AS n, CAST(sum(CASE WHEN kind = 'loaded' THEN size ELSE 0 END) AS BIGINT) AS bytes, count(DISTINCT tile_id) AS tiles FROM e GROUP BY kind
""")
def load_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load_events(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.when(F.col("kind") == "loaded", F.col("size")).otherwise(0)).alias("bytes"), F.countDistinct("tile_id").alias("tiles"))


@_query("""
SELECT user_id AS view_id, event_id, round(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 6) AS moved
FROM (SELECT *, (event_id * 7919 % 36000) / 100.0 AS x, (event_id * 104729 % 17000) / 100.0 AS y FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def camera_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each view's camera has moved since its frame before."""
    from pyspark.sql import Window

    k = F.col("event_id")
    df = _read(spark, sf_dir, "events").select(F.col("user_id").alias("view_id"), "event_id", "ts", (k * 7919 % 36000 / 100.0).alias("x"), (k * 104729 % 17000 / 100.0).alias("y"))
    w = Window.partitionBy("view_id").orderBy("ts", "event_id")
    d = lambda c: F.pow(F.col(c) - F.lag(c).over(w), 2)
    return df.select("view_id", "event_id", F.round(F.sqrt(d("x") + d("y")), 6).alias("moved"))


@_query("""
WITH RECURSIVE f AS (SELECT o_custkey AS view, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, o_totalprice AS used FROM orders),
  s AS (SELECT view, CAST(0 AS BIGINT) AS i, CAST(16 AS DOUBLE) AS t FROM (SELECT DISTINCT view FROM f) UNION ALL SELECT s.view, f.i, CASE WHEN f.used > 150000 THEN t * 1.02 ELSE greatest(16, t / 1.02) END FROM s JOIN f ON f.view = s.view AND f.i = s.i + 1)
SELECT view, round(arg_max(t, i), 9) AS threshold FROM s GROUP BY view
""")
def memory_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error threshold after each view's frames of memory use."""
    df = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("view")).agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))).alias("u"))
    return df.select("view", F.round(state.pressure(F.transform("u", lambda x: x["o_totalprice"]), 150000), 9).alias("threshold"))


# Codecs, properties, URIs


@_query("""
WITH v AS (SELECT l_orderkey AS id, l_linenumber AS n, CAST(l_quantity AS INT) AS q, l_partkey AS p FROM lineitem)
SELECT id, n, CAST(CASE WHEN q % 2 = 0 THEN q // 2 ELSE -(q // 2) - 1 END AS INT) AS zigzag, round(((p % 65536) >> 11) / 31.0, 9) AS r, round((((p % 65536) >> 5) & 63) / 63.0, 9) AS g, round(((p % 65536) & 31) / 31.0, 9) AS b, CAST(floor(greatest(least((q * 70.0 + 1000) / 10000, 1), 0) * 32767 + 0.5) AS INT) AS height, round(greatest((q - 25) / 127.0, -1), 9) AS norm FROM v
""")
def packed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = F.col("l_quantity").cast("int"), (F.col("l_partkey") % 65536).cast("int")
    c = codecs.rgb565(p)
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), codecs.zigzag_decode(q).alias("zigzag"), *(F.round(v, 9).alias(k) for k, v in zip("rgb", c.parts())), codecs.height_code(q * 70.0).alias("height"), F.round(codecs.normalized(q - 25, "i8"), 9).alias("norm")
    )


@_query("""
WITH o AS (SELECT l_orderkey AS id, l_linenumber AS n, CAST(l_quantity AS INT) AS q FROM lineitem)
SELECT id, CAST(sum(CASE WHEN q % 2 = 0 THEN q // 2 ELSE -(q // 2) - 1 END) AS INT) AS last, CAST(count(*) AS INT) AS n FROM o GROUP BY id
""")
def delta_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each order's zigzag deltas."""
    df = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("u"))
    done = codecs.delta_decode(F.transform("u", lambda x: x["q"]))
    return df.select("id", F.element_at(done, -1).alias("last"), F.size(done).alias("n"))


@_query("""
SELECT p_partkey AS id, round(CASE WHEN p_size % 10 = 0 THEN -1 ELSE p_size / 65535.0 * 200 + 5 END, 9) AS scaled, CASE WHEN lower(p_brand) LIKE '%1' THEN true WHEN lower(p_brand) LIKE '%2' THEN false END AS flag, CAST(CASE WHEN p_retailprice < 1000 THEN trunc(p_retailprice) END AS SMALLINT) AS small FROM part
""")
def property_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised, scaled and offset numbers with missing marks, booleans from texts, and checked narrowing."""
    size = F.col("p_size")
    raw = F.when(size % 10 == 0, 0).otherwise(size)
    text = F.when(F.col("p_brand").endswith("1"), "Yes").when(F.col("p_brand").endswith("2"), "NO").otherwise("perhaps")
    small = metadata.to_integer(F.when(F.col("p_retailprice") < 1000, F.col("p_retailprice")).otherwise(1e9), "smallint")
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(metadata.value(raw, "UINT16", True, 200.0, 5.0, 0.0, -1.0), 9).alias("scaled"), metadata.as_boolean(text).alias("flag"), small.alias("small"))


@_query("""
WITH b AS (SELECT l_orderkey AS tile, list(l_partkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS parts, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_returnflag) AS flags FROM lineitem GROUP BY 1)
SELECT tile, CAST(i - 1 AS INT) AS batch_id, parts[i] AS part, CASE WHEN tile % 7 <> 0 THEN flags[i] END AS flag, CASE WHEN tile % 7 = 0 THEN 'flag' ELSE '' END AS dropped FROM (SELECT tile, parts, flags, unnest(range(1, len(parts) + 1)) AS i FROM b)
""")
def batch_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of batch tables in JSON; arrays of the wrong length are named and dropped."""
    rows = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tile")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("u"))
    flags = F.transform("u", lambda x: x["l_returnflag"])
    flags = F.when(F.col("tile") % 7 == 0, F.array_append(flags, F.lit("x"))).otherwise(flags)
    tables = rows.select("tile", F.size("u").alias("length"), F.to_json(F.struct(F.transform("u", lambda x: x["l_partkey"]).alias("part"), flags.alias("flag"))).alias("json"))
    found = metadata.batch_table(tables, "json", "length", {"part": "bigint", "flag": "string"})
    return found.select("tile", "batch_id", "part", "flag", F.array_join("dropped", ",").alias("dropped"))


@_query(r"""
SELECT page_id AS id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.([^./]+)$', 1)) AS ext, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) AS host, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS file,
  regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) || '/tiles/' || page_id || '.glb' AS rooted FROM pages
""")
def uri_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    key = F.concat(F.lit("/a/../tiles/./"), F.col("page_id").cast("string"), F.lit(".glb"))
    return _read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), uris.extension(u).alias("ext"), uris.host(u).alias("host"), uris.file_name(u).alias("file"), uris.resolve(u, key).alias("rooted"))


@_query(f"WITH {_TILES} SELECT id, 'https://' || CASE (x + y) % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END || '.example.com/' || level || '/' || x || '/' || ((1 << level) - 1 - y) || '.png' AS url FROM t")
def tile_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.expr("shiftleft(1L, level)")
    url = uris.tile_url(F.lit("https://{s}.example.com/{z}/{x}/{reverseY}.png"), F.col("level"), F.col("x"), F.col("y"), rows, ["a", "b", "c"])
    return _tiles(spark, sf_dir).select("id", url.alias("url"))


@_query("SELECT event_id AS id, json_extract_string(props, '$.' || k) AS value, k AS name FROM events, (SELECT unnest(['page', 'ref', 'k']) AS k) WHERE json_extract_string(props, '$.' || k) IS NOT NULL")
def dynamic_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named properties of the events' JSON, a row for each that is present."""
    names = ("page", "ref", "k")
    each = F.array(*(F.struct(F.lit(n).alias("name"), F.get_json_object("props", f"$.{n}").alias("value")) for n in names))
    df = _read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.explode(each).alias("p"))
    return df.where("p.value is not null").select("id", "p.value", "p.name")


@_query("""
WITH s AS (SELECT s_suppkey AS id, radians((s_suppkey * 7919 % 30000) / 100.0 - 170.0) AS w, radians((s_suppkey * 104729 % 12000) / 100.0 - 65.0) AS s FROM supplier)
SELECT id, round(w, 9) AS west, round(s + 0.1, 9) AS north, true AS contains, CAST(0.0 AS DOUBLE) AS inside, 250000.0 AS above FROM s
""")
def region_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distance to a region from its middle, and from five hundred metres above its top."""
    k = F.col("s_suppkey")
    w, s = F.radians(k * 7919 % 30000 / 100.0 - 170.0), F.radians(k * 104729 % 12000 / 100.0 - 65.0)
    region = Region(GlobeRectangle(w, s, w + 0.1, s + 0.1), num(0), num(100))
    lon, lat, h = region.center()
    inside, above = region.distance_squared(lon, lat, h), region.distance_squared(lon, lat, num(600))
    return _read(spark, sf_dir, "supplier").select(k.alias("id"), F.round(w, 9).alias("west"), F.round(s + 0.1, 9).alias("north"), region.contains(lon, lat, h).alias("contains"), F.round(inside, 3).alias("inside"), F.round(above, 3).alias("above"))


from tessella import service_queries, source_queries  # noqa: E402, F401  registers the queries of map services and of the sources
