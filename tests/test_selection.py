"""The view query against a plain interpreter of its rules on small random trees."""

import math
import random

import pytest

from tessella.functions.vectors import Vec, num
from tessella.functions.volumes import Sphere
from tessella.plans import selection as S

TILE = "tile_id long, parent_id long, level int, geometric_error double, refine string, has_children boolean, has_content boolean, ready boolean, unconditional boolean, cx double, cy double, cz double, r double"


def tree(rng, unready):
    rows = []

    def grow(parent, level, c, r):
        me = len(rows)
        kids = level < 4 and (level < 2 or rng.random() < 0.7)
        rows.append([me, parent, level, 64.0 / 2**level, "add" if rng.random() < 0.2 else "replace", kids, rng.random() < 0.9, rng.random() >= unready, level > 0 and rng.random() < 0.05, *c, r])
        if kids:
            for _ in range(rng.randint(2, 4)):
                grow(me, level + 1, [v + rng.uniform(-r, r) / 2 for v in c], r / 2)

    grow(None, 0, [0.0, 0.0, 0.0], 100.0)
    return rows


def plain(rows, view, last, o):
    """Selected, refined and queued tiles of one frame, walked node by node."""
    px, py, pz, dx, dy, dz, ux, uy, uz, height, fx, fy = view
    kids = {}
    for r in rows:
        kids.setdefault(r[1], []).append(r)
    right = (dy * uz - dz * uy, dz * ux - dx * uz, dx * uy - dy * ux)
    n = math.sqrt(sum(v * v for v in right))
    right = tuple(v / n for v in right)
    top = (right[1] * dz - right[2] * dy, right[2] * dx - right[0] * dz, right[0] * dy - right[1] * dx)
    tx, ty = math.tan(fx / 2), math.tan(fy / 2)
    normals = [tuple(a * t + s * b for a, b in zip((dx, dy, dz), side)) for t, side in ((tx, right), (ty, top)) for s in (1, -1)]
    normals = [tuple(v / math.sqrt(sum(w * w for w in m)) for v in m) for m in normals]
    out = {}

    def visit(r, ancestor_meets):
        number, _, level, error, refine, has_kids, content, ready, always, cx, cy, cz, radius = r
        to = (cx - px, cy - py, cz - pz)
        d = max(math.sqrt(sum(v * v for v in to)) - radius, 0)
        seen = d == 0 or all(sum(a * b for a, b in zip(m, to)) >= -radius for m in normals)
        sse = error * height / (max(d, 1e-6) * 2 * math.tan(fy / 2))
        was_refined, was_selected = last.get(number, (False, False))
        stop = not seen and level > 0
        wants = has_kids and (always or (sse > o.threshold and not ancestor_meets))
        holds = not wants and was_refined and not ready and has_kids
        refines = not stop and (wants or holds)
        chosen = seen and not stop and ready and content and (not refines or refine == "add")
        wanted = not stop and content and not ready and not ancestor_meets
        me = out[number] = {"level": level, "culled": not seen, "refined": refines, "selected": chosen, "wanted": wanted}
        shown = seen and content
        all_ready, any_before, missing = (ready if shown and not refines else True), (was_selected if shown else False), int(shown and not ready)
        below = []
        folded = None
        if refines:
            for c in kids.get(number, []):
                got, held = visit(c, ancestor_meets or holds)
                below += held
                folded = got if folded is None else (folded[0] and got[0], folded[1] or got[1], folded[2] + got[2])
        stands = refines and ready and content and refine == "replace" and not always and seen
        if folded:
            if stands and not folded[0] and not folded[1]:
                me["selected"] = True
                for b in below:
                    out[b]["selected"] = False
                    if missing + folded[2] > o.descendant_limit:
                        out[b]["wanted"] = False
                all_ready = True
            else:
                all_ready = all_ready and folded[0]
            any_before, missing = any_before or folded[1], missing + folded[2]
        return (all_ready, any_before, missing), [number, *below]

    for r in kids[None]:
        visit(r, False)
    return out


@pytest.mark.parametrize("seed, unready", [(1, 0.0), (2, 0.3), (3, 0.6), (4, 0.15)])
def test_against_the_interpreter(spark, seed, unready):
    rng = random.Random(seed)
    rows = tree(rng, unready)
    tiles = spark.createDataFrame(rows, TILE)
    tiles = tiles.withColumn("bounds", Sphere(Vec(tiles.cx, tiles.cy, tiles.cz), tiles.r).col()).drop("cx", "cy", "cz", "r")
    views = []
    for frame in range(3):
        e = [rng.uniform(-250, 250) for _ in range(3)]
        n = math.sqrt(sum(v * v for v in e))
        views.append((frame, 0, *e, *(-v / n for v in e), 0.0, 0.0, 1.0, 600.0, 0.9, 0.7))
    names = "frame int, view_id int, px double, py double, pz double, dx double, dy double, dz double, ux double, uy double, uz double, height double, fov_x double, fov_y double"
    last = {r[0]: (rng.random() < 0.3, rng.random() < 0.1) for r in rows}
    before = spark.createDataFrame([(f, k, *v) for f in range(3) for k, v in last.items()], "frame int, tile_id long, refined boolean, selected boolean")
    o = S.Options(threshold=16.0, levels=6, descendant_limit=3)
    got = S.select_tiles(tiles, spark.createDataFrame(views, names), before, o).collect()
    for frame, _, *view in views:
        want = plain(rows, view, last, o)
        mine = {r.tile_id: r for r in got if r.frame == frame}
        assert mine.keys() == want.keys()
        for k, w in want.items():
            r = mine[k]
            assert (r.culled, r.refined, r.selected, r.load_group is not None) == (w["culled"], w["refined"], w["selected"], w["wanted"]), (frame, k)


def test_no_views_or_tiles(spark):
    tiles = spark.createDataFrame([], TILE)
    tiles = tiles.withColumn("bounds", Sphere(Vec(tiles.cx, tiles.cy, tiles.cz), tiles.r).col())
    views = spark.createDataFrame([], "frame int, view_id int, " + ", ".join(f"{c} double" for c in S.VIEW))
    assert S.select_tiles(tiles, views, options=S.Options(levels=3)).count() == 0


def test_errors(spark):
    row = spark.range(1).select(S.sse(num(10), num(100), num(600), num(math.pi / 2)).alias("a"), S.sse_orthographic(num(10), num(50), num(100)).alias("b"), S.reduced(num(10), num(1e9), num(1), num(4)).alias("c")).first()
    assert row.a == pytest.approx(30) and row.b == 10 and row.c == 6
