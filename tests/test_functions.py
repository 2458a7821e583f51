import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import availability, codecs, geodesy, projections, services, tiles, uris, vectors, volumes
from tessella.functions.geodesy import WGS84, GlobeRectangle
from tessella.functions.tiles import Oct, OctScheme, Quad, QuadScheme
from tessella.functions.vectors import Vec, num
from tessella.functions.volumes import Aabb, Bounds, Obb, Plane, Ray, Rectangle, Sphere


@pytest.fixture(scope="module")
def one(spark):
    """Evaluates columns, or dataclasses of columns, on a single row."""

    def run(*columns):
        row = spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()
        return row[0] if len(columns) == 1 else tuple(row)

    return run


def vec(one, v):
    return np.array(one(*v.parts()))


def test_known_places(one):
    assert np.allclose(vec(one, WGS84.to_ecef(num(0), num(0))), [6378137, 0, 0])
    assert np.allclose(vec(one, WGS84.to_ecef(num(0), num(math.pi / 2))), [0, 0, 6356752.314245179])
    # Published: Paris to New York by Vincenty, about 5,852.9 km.
    d = one(WGS84.inverse(*(F.radians(num(v)) for v in (2.3522, 48.8566, -74.0060, 40.7128)))["distance"])
    assert abs(d - 5852935) < 3000
    # Flinders Peak to Buninyong on WGS 84: 54,972.271 m, azimuth 306 52 05.37.
    a = [math.radians(v) for v in (144 + 25 / 60 + 29.52440 / 3600, -(37 + 57 / 60 + 3.72030 / 3600), 143 + 55 / 60 + 35.38390 / 3600, -(37 + 39 / 60 + 10.15610 / 3600))]
    found = one(WGS84.inverse(*map(num, a)))
    assert abs(found["distance"] - 54972.271) < 0.1 and abs(math.degrees(found["azimuth1"]) % 360 - 306.868158) < 1e-3


def test_geodesic_edge_cases(one):
    same = one(WGS84.inverse(num(0.3), num(0.2), num(0.3), num(0.2)))
    assert tuple(same) == (0, 0, 0)
    assert one(WGS84.inverse(num(0), num(0.1), num(math.pi), num(-0.1))["distance"]) is None  # opposite points: the iteration has no end
    assert one(WGS84.to_geodetic(Vec.lit(0, 0, 0))[2]) is None
    assert vec(one, WGS84.scale_to_geocentric_surface(Vec.lit(0, 0, 0)))[0] is None
    lon, lat, h = one(*WGS84.to_geodetic(Vec.lit(0, 0, 6356752.3142451793 - 50)))
    assert abs(lat - math.pi / 2) < 1e-9 and abs(h + 50) < 1e-6


def test_direct_iterates_once(spark):
    # Flinders Peak to Buninyong, as above; the plan holds one iteration, not one for every use of its result.
    a = [math.radians(v) for v in (144 + 25 / 60 + 29.52440 / 3600, -(37 + 57 / 60 + 3.72030 / 3600), 306 + 52 / 60 + 5.37 / 3600)]
    df = spark.range(1).select(WGS84.direct(*(F.col("id") + v for v in (*a, 54972.271))).alias("to"))
    to = df.first()["to"]
    assert abs(math.degrees(to["lon"]) - (143 + 55 / 60 + 35.38390 / 3600)) < 1e-6 and abs(math.degrees(to["lat"]) + (37 + 39 / 60 + 10.15610 / 3600)) < 1e-6
    assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_enu_is_orthonormal(one):
    for lon, lat in ((0.3, 0.7), (-2, -1.2), (0, math.pi / 2)):
        axes = [vec(one, a) for a in WGS84.enu(WGS84.to_ecef(num(lon), num(lat)))]
        assert np.allclose(np.array(axes) @ np.array(axes).T, np.eye(3), atol=1e-9)
        assert np.allclose(np.cross(axes[0], axes[1]), axes[2], atol=1e-9)


def test_matrices(one):
    a = vectors.compose(Vec.lit(1, 2, 3), tuple(map(num, (0, 0, math.sin(0.4), math.cos(0.4)))), Vec.lit(2, 3, 4))
    m = np.array(one(a)).reshape(4, 4).T
    assert np.allclose(m[:3, :3], [[2 * math.cos(0.8), -3 * math.sin(0.8), 0], [2 * math.sin(0.8), 3 * math.cos(0.8), 0], [0, 0, 4]])
    inverse = np.array(one(vectors.inverse_rigid(a))).reshape(4, 4).T
    assert np.allclose(inverse @ m, np.eye(4))
    assert np.allclose(np.array(one(vectors.multiply(a, a))).reshape(4, 4).T, m @ m)
    t, _, scale = vectors.decompose(a)
    assert np.allclose(vec(one, t), [1, 2, 3]) and np.allclose(vec(one, scale), [2, 3, 4])
    view = vectors.view_matrix(Vec.lit(0, 0, 5), Vec.lit(0, 0, -1), Vec.lit(0, 1, 0))
    assert np.allclose(vec(one, vectors.transform_point(view, Vec.lit(1, 2, 0))), [1, 2, -5])


def test_spheres(one):
    a, b = Sphere(Vec.lit(0, 0, 0), num(1)), Sphere(Vec.lit(4, 0, 0), num(1))
    u = a.union(b)
    assert np.allclose(vec(one, u.center), [2, 0, 0]) and one(u.radius) == 3
    assert one(a.union(Sphere(Vec.lit(0.1, 0, 0), num(0.2))).radius) == 1
    assert one(a.distance_squared(Vec.lit(3, 0, 0))) == 4 and one(a.distance_squared(Vec.lit(0.5, 0, 0))) == 0


def test_boxes(one):
    box = Aabb(Vec.lit(0, 0, 0), Vec.lit(2, 4, 6))
    assert one(box.to_sphere().radius) == pytest.approx(math.sqrt(14)) and one(box.contains(Vec.lit(2, 4, 6)))
    obb = Obb(Vec.lit(1, 1, 1), (Vec.lit(1, 1, 0), Vec.lit(-1, 1, 0), Vec.lit(0, 0, 2)))
    aabb = obb.to_aabb()
    assert np.allclose(vec(one, aabb.min), [-1, -1, -1]) and np.allclose(vec(one, aabb.max), [3, 3, 3])
    assert one(obb.contains(Vec.lit(2.9, 1, 1))) and not one(obb.contains(Vec.lit(2.9, 2.9, 1)))
    corners = np.array([vec(one, c) for c in obb.corners()])
    assert np.allclose(corners.min(0), [-1, -1, -1]) and np.allclose(corners.max(0), [3, 3, 3])
    back = Obb.from_array(obb.to_array())
    assert np.allclose(vec(one, back.axes[1]), [-1, 1, 0])


@pytest.mark.parametrize("kind", ["sphere", "obb", "aabb", "empty"])
def test_tagged_bounds(one, kind):
    shapes = {"sphere": Sphere(Vec.lit(0, 0, 0), num(1)).col(), "aabb": Aabb(Vec.lit(-1, -1, -1), Vec.lit(1, 1, 1)).col(), "obb": Obb(Vec.lit(0, 0, 0), (Vec.lit(1, 0, 0), Vec.lit(0, 1, 0), Vec.lit(0, 0, 1))).col(), "empty": volumes.empty()}
    b = Bounds(shapes[kind])
    plane = Plane(Vec.lit(1, 0, 0), num(-3))
    assert one(b.plane(plane)) == "outside"
    assert one(b.contains(Vec.lit(0, 0, 0.5))) == (kind != "empty")
    assert one(b.distance_squared(Vec.lit(3, 0, 0))) == (math.inf if kind == "empty" else 4)
    assert one(b.ray(Ray(Vec.lit(5, 0, 0), Vec.lit(-1, 0, 0)))) == (None if kind == "empty" else 4)


def test_rays(one):
    ray = Ray(Vec.lit(0, 0, 5), Vec.lit(0, 0, -1))
    assert one(ray.triangle(Vec.lit(-1, -1, 0), Vec.lit(1, -1, 0), Vec.lit(0, 1, 0))) == 5
    assert one(ray.triangle(Vec.lit(-1, -1, 0), Vec.lit(0, 1, 0), Vec.lit(1, -1, 0), cull=True)) is None
    assert one(*ray.ellipsoid((1, 1, 2))) == (3, 7)
    assert one(*Ray(Vec.lit(0, 0, 0), Vec.lit(1, 0, 0)).ellipsoid((2, 1, 1))) == (0, 2)
    assert one(Ray(Vec.lit(0, 0, 0), Vec.lit(0, 0, 1)).sphere(Sphere(Vec.lit(0, 0, -3), num(1)))) is None
    assert one(Ray(Vec.lit(0, 0, 0), Vec.lit(1, 0, 0)).plane(Plane(Vec.lit(0, 0, 1), num(-1)))) is None
    assert one(Ray(Vec.lit(0, 3, 0), Vec.lit(1, 0, 0)).aabb(Aabb(Vec.lit(1, -1, -1), Vec.lit(2, 1, 1)))) is None


def test_frusta(one):
    planes = volumes.frustum_from_fov(Vec.lit(0, 0, 0), Vec.lit(0, 0, -1), Vec.lit(0, 1, 0), num(math.pi / 2), num(math.pi / 2))
    at = lambda x, z: one(volumes.visibility(Sphere(Vec.lit(x, 0, z), num(1)), planes))
    assert (at(0, -10), at(10, -10), at(0, 10), at(30, -10)) == ("inside", "intersecting", "outside", "outside")
    masked = one(volumes.visibility_masked(Sphere(Vec.lit(10, 0, -10), num(1)), planes, F.lit(15)))
    assert masked["result"] == "intersecting" and masked["mask"].bit_count() == 1
    assert one(volumes.visibility_masked(Sphere(Vec.lit(30, 0, -10), num(1)), planes, F.lit(0)))["result"] == "inside"


def test_rectangles(one):
    a = Rectangle(*map(num, (0, 0, 4, 2)))
    assert one(a.signed_distance(num(2), num(1))) == -1 and one(a.signed_distance(num(7), num(6))) == 5
    assert one(a.intersection(Rectangle(*map(num, (4, 0, 5, 2))))) is None
    assert tuple(one(a.intersection(Rectangle(*map(num, (3, 1, 9, 9)))))) == (3, 1, 4, 2)


def test_globe_rectangles(one):
    cross = GlobeRectangle.degrees(170, -10, -170, 10)
    assert one(F.degrees(cross.width())) == pytest.approx(20)
    assert one(cross.contains(F.radians(num(179)), num(0))) and one(cross.contains(F.radians(num(-179)), num(0))) and not one(cross.contains(num(0), num(0)))
    west, *rest = (round(math.degrees(v), 6) for v in one(cross.intersection(GlobeRectangle.degrees(-180, 0, -175, 20))))
    assert abs(west) == 180 and rest == [0, -175, 10]
    u = cross.union(GlobeRectangle.degrees(160, 0, 172, 5))
    assert [round(math.degrees(v), 6) for v in one(u.col())] == [160, -10, -170, 10]
    assert len(one(cross.split())) == 2


def test_wrapping(one):
    for a in (-math.pi, math.pi, 0.0):
        assert one(geodesy.wrap_pi(num(a))) == a
    assert one(geodesy.wrap_pi(num(3 * math.pi / 2))) == pytest.approx(-math.pi / 2)
    assert one(geodesy.wrap_two_pi(num(2 * math.pi))) == 2 * math.pi and one(geodesy.wrap_two_pi(num(-0.5))) == pytest.approx(2 * math.pi - 0.5)


def test_horizon(one):
    eye = Vec.lit(2 * 6378137.0, 0, 0)
    assert not one(WGS84.is_occluded(eye, Vec.lit(6378137.0, 0, 0)))
    assert one(WGS84.is_occluded(eye, Vec.lit(-6378137.0, 0, 0)))
    assert not one(WGS84.is_occluded(eye, Vec.lit(0, 3 * 6378137.0, 0)))


def morton(values):
    return sum((v >> b & 1) << (b * len(values) + k) for k, v in enumerate(values) for b in range(31))


def test_morton_codes(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(map(int, r)) for r in rng.integers(0, 1 << 21, (200, 3))] + [(0, 0, 0), ((1 << 21) - 1,) * 3]
    df = spark.createDataFrame(rows, "x long, y long, z long")
    code = tiles.morton_2d(F.col("x"), F.col("y"))
    got = df.select("x", "y", "z", code.alias("m2"), tiles.morton_3d(F.col("x"), F.col("y"), F.col("z")).alias("m3"), tiles.unspread_2d(code).alias("ux"), tiles.unspread_2d(code, 1).alias("uy")).collect()
    for r in got:
        assert r.m2 == morton((r.x, r.y)) and r.m3 == morton((r.x, r.y, r.z)) and (r.ux, r.uy) == (r.x, r.y)


def test_tiles(one):
    t = Quad(F.lit(5), F.lit(19).cast("long"), F.lit(7).cast("long"))
    assert tuple(one(t.parent())) == (4, 9, 3) and one(Quad(F.lit(0), F.lit(0), F.lit(0)).parent()) is None
    assert [tuple(c) for c in one(t.children())] == [(6, 38, 14), (6, 39, 14), (6, 38, 15), (6, 39, 15)]
    assert tuple(one(t.subtree_root(3).col())) == (3, 4, 1) and one(t.relative_morton(3)) == morton((3, 3))
    o = Oct(F.lit(2), F.lit(1).cast("long"), F.lit(2).cast("long"), F.lit(3).cast("long"))
    assert one(o.morton()) == morton((1, 2, 3)) and len(one(o.children())) == 8 and tuple(one(o.parent())) == (1, 0, 1, 1)
    scheme = OctScheme((0, 0, 0), (8, 8, 8))
    assert tuple(one(scheme.position(Vec.lit(3, 5, 8), 2))) == (2, 1, 2, 3)
    assert np.allclose(vec(one, scheme.box(o).min), [2, 4, 6])
    g = QuadScheme.geographic()
    assert tuple(one(g.position(num(math.pi), num(math.pi / 2), 0))) == (0, 1, 0) and one(g.position(num(4), num(0), 0)) is None
    assert one(QuadScheme.web_mercator().tile_rectangle(Quad(F.lit(1), F.lit(2).cast("long"), F.lit(0).cast("long")))) is None
    assert one(g.cover(Rectangle(num(5), num(0), num(6), num(1)), 2)) == []


def test_s2(one):
    # Published tokens: 89c25 is a cell of level 8 over New York; face cells are 1, 3, 5, 7, 9, b.
    cell = tiles.s2_from_token(F.lit("89c25"))
    assert one(tiles.s2_level(cell)) == 8 and one(tiles.s2_face(cell)) == 4 and one(tiles.s2_token(cell)) == "89c25"
    assert [one(tiles.s2_level(tiles.s2_from_token(F.lit(t)))) for t in "1357"] == [0] * 4
    assert one(tiles.s2_from_token(F.lit("xyz"))) is None
    lon, lat = F.radians(num(-74.0060)), F.radians(num(40.7128))
    p = Vec(F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))
    assert one(tiles.s2_token(tiles.s2_from_point(p, 8))) == "89c25"
    kids = tiles.s2_children(cell)
    assert [one(tiles.s2_child_position(F.get(kids, k))) for k in range(4)] == [0, 1, 2, 3]
    assert all(one(tiles.s2_parent(F.get(kids, k)) == cell) for k in range(4))


def test_codes(one):
    assert [one(codecs.zigzag_decode(F.lit(v))) for v in range(6)] == [0, -1, 1, -2, 2, -3]
    assert [one(codecs.zigzag_encode(F.lit(v))) for v in (0, -1, 1, -2)] == [0, 1, 2, 3]
    assert one(codecs.delta_decode(F.array(*map(F.lit, (2, 2, 1))))) == [1, 2, 1]
    assert one(codecs.high_water_decode(F.array(*map(F.lit, (0, 0, 0, 1, 0, 2))))) == [0, 1, 2, 2, 3, 2]
    for x, y in ((128, 128), (255, 128), (0, 0), (30, 200)):
        assert np.linalg.norm(vec(one, codecs.oct_decode(num(x), num(y)))) == pytest.approx(1)
    assert one(codecs.wrap_texture(num(-0.25), "repeat")) == 0.75 and one(codecs.wrap_texture(num(1.25), "mirror")) == 0.75 and one(codecs.wrap_texture(num(3), "clamp")) == 1
    assert one(codecs.height_of_code(codecs.height_code(num(1234.0)))) == pytest.approx(1234, abs=0.2)


def test_availability(one):
    bits = F.lit(bytearray([0b00000101, 0b10000000]))
    assert [k for k in range(20) if one(availability.is_set(bits, F.lit(k)))] == [0, 2, 15]
    assert [one(availability.rank(bits, F.lit(k))) for k in (0, 1, 3, 15, 16)] == [0, 1, 2, 2, 3]
    assert one(availability.count_set(bits)) == 3 and one(availability.is_set(F.lit(None).cast("binary"), F.lit(3), F.lit(True)))
    assert [one(availability.level_offset(F.lit(k))) for k in range(4)] == [0, 1, 5, 21] and one(availability.bit_index(F.lit(1), F.lit(3), 8)) == 4


def test_subtree_join(spark):
    from tessella.plans.trees import quadtree

    subtrees = spark.createDataFrame([(0, 0, bytearray([0b10111]), None), (2, 3, None, True)], "root_level int, root_morton long, bits binary, constant boolean")
    got = {(r.level, r.x, r.y) for r in availability.with_availability(quadtree(spark, 4), subtrees, 2).where("available").collect()}
    assert {t for t in got if t[0] < 2} == {(0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 1, 1)}
    assert {t for t in got if t[0] >= 2} == {(2, 1, 1), (3, 2, 2), (3, 3, 2), (3, 2, 3), (3, 3, 3)}


@pytest.mark.parametrize("base, key, want", [
    ("https://a.b/c/d.json?k=1", "e.glb", "https://a.b/c/e.glb"), ("https://a.b/c/d.json", "../e.glb?x=2", "https://a.b/e.glb?x=2"), ("https://a.b/c/d.json", "/e", "https://a.b/e"),
    ("https://a.b/c/d.json", "http://x/y", "http://x/y"), ("https://a.b/c/", "./f", "https://a.b/c/f"), ("https://a.b/c", "//h/g", "https://h/g"), ("https://a.b/c", "data:text,x", "data:text,x"),
])
def test_resolve(one, base, key, want):
    assert one(uris.resolve(F.lit(base), F.lit(key))) == want


def test_uri_parts(one):
    u = F.lit("https://h.x/a/b.tar.GZ?q=1#f")
    assert one(uris.extension(u), uris.host(u), uris.path(u), uris.query(u), uris.file_name(u)) == ("gz", "h.x", "/a/b.tar.GZ", "q=1", "b.tar.GZ")
    assert one(uris.with_parameter(F.lit("http://h/p?a=1&b=2"), "a", F.lit("x y"))) == "http://h/p?b=2&a=x+y"
    assert one(uris.expand(F.lit("{z}/{x}/{w}"), {"z": F.lit(3), "x": F.lit(5)})) == "3/5/{w}"


def test_region_distance(one):
    region = geodesy.Region(GlobeRectangle.degrees(10, 20, 11, 21), num(0), num(1000))
    at = lambda lon, lat, h: one(F.sqrt(region.distance_squared(F.radians(num(lon)), F.radians(num(lat)), num(h))))
    assert at(10.5, 20.5, 500) == 0 and at(10.5, 20.5, 1500) == pytest.approx(500)
    # A degree of latitude beyond the north edge is about 110.7 km.
    assert at(10.5, 22, 500) == pytest.approx(110_700, rel=0.01)
    assert at(12, 20.5, 500) == pytest.approx(104_300, rel=0.02)
    assert at(9, 20.5, 500) == pytest.approx(104_300, rel=0.02)


def test_axes_turn_back(one):
    for a in "xyz":
        for b in "xyz":
            there_and_back = one(vectors.multiply(projections.up_axis(b, a), projections.up_axis(a, b)))
            assert np.allclose(there_and_back, np.eye(4).ravel())
            up = vec(one, vectors.transform_direction(projections.up_axis(a, b), Vec.lit(*(float(k == a) for k in "xyz"))))
            assert np.allclose(up, [k == b for k in "xyz"])


def test_quaternions_of_half_turns(one):
    """No part is picked that may be zero: turns by 180 degrees about each axis, and none."""
    frames = {(1, 0, 0, 0): (1, -1, -1), (0, 1, 0, 0): (-1, 1, -1), (0, 0, 1, 0): (-1, -1, 1), (0, 0, 0, 1): (1, 1, 1)}
    for q, (a, b, c) in frames.items():
        assert np.allclose(one(projections.quaternion(Vec.lit(a, 0, 0), Vec.lit(0, b, 0), Vec.lit(0, 0, c))), q)


def test_quaternion_agrees_with_compose(one):
    q = np.array([0.5, -0.1, 0.7, 0.2])
    q = q / np.linalg.norm(q)
    m = vectors.compose(Vec.lit(0, 0, 0), tuple(map(num, q)), Vec.lit(1, 1, 1))
    found = np.array(one(projections.quaternion(Vec.array(m), Vec.array(m, 4), Vec.array(m, 8))))
    assert np.allclose(found * np.sign(found @ q), q)
    turned = projections.rotated(F.array(*map(num, q)), Vec.lit(3, 4, 5))
    assert np.allclose(vec(one, turned), vec(one, vectors.transform_point(m, Vec.lit(3, 4, 5))))


def test_projections_without_far_plane(one):
    by_angle = one(projections.perspective(num(np.pi / 2), num(np.pi / 2), num(0.5)))
    assert np.allclose(by_angle, one(projections.perspective_bounds(*map(num, (-0.5, 0.5, -0.5, 0.5, 0.5)))))
    near = np.array(by_angle).reshape(4, 4).T @ [0, 0, -0.5, 1]
    assert np.allclose(near[2] / near[3], 1)
    flat = np.array(one(projections.orthographic(*map(num, (-1, 1, -1, 1, 0.5))))).reshape(4, 4).T
    assert np.allclose(flat @ [1, 1, -7, 1], [1, -1, 1, 1])


def test_box_of_extent(one):
    box = projections.box_of_extent(Aabb(Vec.lit(-1, 0, 2), Vec.lit(3, 4, 8)))
    assert np.allclose(one(box.to_array()), [1, 2, 5, 2, 0, 0, 0, 2, 0, 0, 0, 3])


def test_map_service_nulls_and_numbers(one):
    none = F.lit(None).cast("bigint")
    level, x = F.lit(3), F.lit(5).cast("bigint")
    assert one(services.quadkey(level, none, x)) is None and one(services.quadkey(F.lit(0), x, x)) == "" and one(services.quadkey(level, x, F.lit(3).cast("bigint"))) == "123"
    assert one(services.wms("u", Rectangle(none, x, x, x), "l")) is None
    assert one(services.wmts("u", level, none, x, "l", "m")) is None
    assert one(*(services.plain(num(v)) for v in (-0.0, 180, 1e-7, -85.05112878, 20037508.342789244))) == ("0", "180", "0.0000001", "-85.05112878", "20037508.342789244")
