"""The view query: which tiles of a tree cover the views of a frame at a bounded screen-space error.

Tiles: tile_id, parent_id, level, geometric_error, refine ('replace' or 'add'), has_children, has_content,
ready, unconditional, bounds (a tagged volume); views: frame, view_id, position, direction, up, viewport
height and fields of view. Views of a frame travel as one array beside each visited tile, so that the
maximum over views is no shuffle; the children of surviving tiles are joined by parent id, level by
level, and a culled or satisfied tile's subtree is never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.vectors import Vec
from tessella.functions.volumes import OUTSIDE, Bounds, Plane, frustum_from_fov, visibility
from tessella.plans.trees import descend
from tessella.storage import Scratch

VIEW = ("px", "py", "pz", "dx", "dy", "dz", "ux", "uy", "uz", "height", "fov_x", "fov_y")
#: Groups of load requests, least pressing first.
PRELOAD, DEFERRED, NORMAL, URGENT = 0, 64, 128, 255


@dataclass(frozen=True)
class Options:
    """What a view query asks for."""

    threshold: float = 16.0
    levels: int = 30
    frustum: bool = True
    fog_density: float = 0.0
    descendant_limit: int = 20
    min_distance: float = 1e-6
    prevent_holes: bool = True
    loads: int = 20
    prefer_leaves: bool = False


def sse(error: Column, distance: Column, height: Column, fov_y: Column, floor: float = 1e-6) -> Column:
    """Screen-space error in pixels under perspective."""
    return error * height / (F.greatest(distance, F.lit(floor)) * 2 * F.tan(fov_y / 2))


def sse_orthographic(error: Column, half_height: Column, height: Column) -> Column:
    pixel = 2 * half_height / height
    return F.when(pixel > 0, error / pixel).otherwise(0.0)


def reduced(value: Column, distance: Column, density: Column, factor: Column) -> Column:
    """Screen-space error less what distance forgives."""
    k = distance * density
    return F.greatest(F.lit(0.0), value - (1 - F.exp(-(k * k))) * factor)


def foveation(direction: Vec, position: Vec, center: Vec) -> Column:
    """1 less the cosine between the view's direction and the way to a tile: 0 straight ahead."""
    to = center - position
    return F.when(to.length() > 0, 1 - to.dot(direction) / to.length()).otherwise(0.0)


def _framed(views: DataFrame) -> DataFrame:
    """(frame, views): the views of each frame with the planes of their frusta, computed once for each view."""
    v = views.select("frame", "view_id", *(F.col(c).cast("double").alias(c) for c in VIEW))
    planes = frustum_from_fov(Vec.array(F.col("_p")), Vec.array(F.col("_d")), Vec.array(F.col("_u")), F.col("fov_x"), F.col("fov_y"))
    made = F.array(*(F.struct(p.normal.col().alias("n"), p.d.alias("d")) for p in planes))
    v = v.withColumns({"_p": F.array("px", "py", "pz"), "_d": F.array("dx", "dy", "dz"), "_u": F.array("ux", "uy", "uz")}).withColumn("planes", made)
    return v.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("view_id", *VIEW, "planes"))).alias("views"))


def _measured(rows: DataFrame, o: Options) -> DataFrame:
    """Visited tiles with their distance, error, and whether a view sees them."""
    bounds = Bounds("bounds")

    def one(v: Column) -> Column:
        eye, ahead = Vec(v["px"], v["py"], v["pz"]), Vec(v["dx"], v["dy"], v["dz"])
        d = F.sqrt(bounds.distance_squared(eye))
        seen = F.lit(True)
        if o.frustum:
            planes = [Plane(Vec.of(v["planes"][k]["n"]), v["planes"][k]["d"]) for k in range(4)]
            seen = (d == 0) | (visibility(bounds, planes) != OUTSIDE)
        clear = F.lit(True)
        if o.fog_density:
            clear = 1 - F.exp(-(d * o.fog_density) * (d * o.fog_density)) <= 0.9999
        error = sse(F.col("geometric_error"), d, v["height"], v["fov_y"], o.min_distance)
        return F.struct(d.alias("d"), error.alias("sse"), seen.alias("seen"), clear.alias("clear"), foveation(ahead, eye, bounds.center()).alias("off"))

    rows = rows.withColumn("_v", F.transform("views", one))
    return rows.withColumns({
        "distance": F.array_min(F.transform("_v", lambda v: v["d"])), "sse": F.array_max(F.transform("_v", lambda v: v["sse"])), "off_axis": F.array_min(F.transform("_v", lambda v: v["off"])),
        "culled": ~(F.exists("_v", lambda v: v["seen"]) & F.exists("_v", lambda v: v["clear"])),
    }).drop("_v")


def _judged(rows: DataFrame, o: Options) -> DataFrame:
    """Refinement and selection of visited tiles. A culled tile, unless a root, ends its branch."""
    rows = _measured(rows, o)
    stop = F.col("culled") & (F.col("level") > 0)
    meets = F.col("sse") <= o.threshold
    wants = F.col("has_children") & (F.col("unconditional") | (~meets & ~F.col("ancestor_meets")))
    holds = ~wants & F.col("was_refined") & ~F.col("ready") & F.col("has_children")
    rows = rows.withColumns({"refines": ~stop & (wants | holds), "passes_meets": F.col("ancestor_meets") | holds})
    return rows.withColumns({
        "selected": ~stop & ~F.col("culled") & F.col("ready") & F.col("has_content") & (~F.col("refines") | (F.col("refine") == "add")),
        "wanted": ~stop & F.col("has_content") & ~F.col("ready") & ~F.col("ancestor_meets"),
    })


_TILE = ["tile_id", "parent_id", "level", "geometric_error", "refine", "has_children", "has_content", "ready", "unconditional", "bounds"]


def visit(tiles: DataFrame, views: DataFrame, last: DataFrame | None = None, options: Options | None = None) -> DataFrame:
    """The tiles that a frame visits, judged, before descendants of unready tiles are withdrawn.

    ``last`` (frame, tile_id, refined, selected) is the frame before, under this frame's number.
    Frames are dealt by key; roots, which are few, are the only tiles that meet all frames.
    """
    o = options or Options()
    scratch = Scratch(tiles.sparkSession, "visit")
    frames = scratch.table(_framed(views), "frames")
    if last is None:
        past = lambda rows: rows.withColumns({"was_refined": F.lit(False), "was_selected": F.lit(False)})
    else:
        seen = last.select("frame", "tile_id", F.col("refined").alias("_r"), F.col("selected").alias("_s"))

        def past(rows: DataFrame) -> DataFrame:
            met = rows.join(seen, ["frame", "tile_id"], "left")
            return met.withColumns({"was_refined": F.coalesce("_r", F.lit(False)), "was_selected": F.coalesce("_s", F.lit(False))}).drop("_r", "_s")

    tiles = tiles.select(_TILE)
    roots = tiles.where("parent_id is null").withColumn("ancestor_meets", F.lit(False))
    start = _judged(past(frames.join(F.broadcast(roots))), o)

    def children(open_: DataFrame, _: int) -> DataFrame:
        parents = open_.select("frame", "views", F.col("tile_id").alias("parent_id"), F.col("passes_meets").alias("ancestor_meets"))
        return _judged(past(parents.join(tiles, "parent_id")), o)

    return descend(start, children, F.col("refines"), scratch, o.levels)


def select_tiles(tiles: DataFrame, views: DataFrame, last: DataFrame | None = None, options: Options | None = None) -> DataFrame:
    """One row for each visited tile of each frame: frame, tile_id, level, distance, sse, off_axis, culled, refined, selected, load_group (NULL: no load).

    A ready tile of which some descendant is not ready, and none was selected in the frame before, is
    shown in place of its selected descendants; if more than ``descendant_limit`` are missing, their
    loads are dropped.
    """
    o = options or Options()
    scratch = Scratch(tiles.sparkSession, "select")
    rows = visit(tiles, views, last, o).drop("views", "bounds")
    shown = ~F.col("culled") & F.col("has_content")
    own = {
        "all_ready": F.when(shown & ~F.col("refines"), F.col("ready")).otherwise(True),
        "any_before": F.when(shown, F.col("was_selected")).otherwise(False),
        "missing": F.when(shown & ~F.col("ready"), 1).otherwise(0).cast("long"),
        "kicks": F.lit(False),
    }
    stands = F.col("refines") & F.col("ready") & F.col("has_content") & (F.col("refine") == "replace") & ~F.col("unconditional") & ~F.col("culled")
    kick = stands & F.col("_g_all_ready").isNotNull() & ~F.col("_g_all_ready") & ~F.col("_g_any_before")
    settle = {
        "all_ready": lambda mine, kids: F.when(F.coalesce(kick, F.lit(False)), True).otherwise(mine & F.coalesce(kids, F.lit(True))),
        "any_before": lambda mine, kids: mine | F.coalesce(kids, F.lit(False)),
        "missing": lambda mine, kids: mine + F.coalesce(kids, F.lit(0)),
        "kicks": lambda mine, kids: F.coalesce(kick, F.lit(False)),
    }
    gather = {"all_ready": F.bool_and, "any_before": F.bool_or, "missing": F.sum, "kicks": F.bool_or}
    # At the deepest level there are no gathered columns to look at.
    rows = rows.withColumns({"_g_all_ready": F.lit(None).cast("boolean"), "_g_any_before": F.lit(None).cast("boolean")})
    if rows.where(shown & ~F.col("ready")).isEmpty():
        # Nothing shown is missing: no tile has to stand in for its descendants.
        kicked = rows.withColumns({"kicks": F.lit(False), "under_kick": F.lit(False), "dropped": F.lit(False)})
    else:
        kicked = _under_kicks(_fold(rows, own, gather, settle, scratch), o, scratch)
    selected = (F.col("selected") | F.col("kicks")) & ~F.col("under_kick")
    group = F.when(F.col("wanted") & ~F.col("dropped"), F.when(F.col("refines") & (F.col("was_refined") | F.lit(o.prevent_holes)), URGENT).otherwise(NORMAL))
    return kicked.select("frame", "tile_id", "parent_id", "level", "distance", "sse", "off_axis", "culled", F.col("refines").alias("refined"), selected.alias("selected"), group.alias("load_group"))


def _fold(rows: DataFrame, own: dict, gather: dict, settle: dict, scratch: Scratch) -> DataFrame:
    base = rows.drop("_g_all_ready", "_g_any_before")
    names = list(own)
    deepest = base.agg(F.max("level")).first()[0]
    if deepest is None:
        return base.withColumns(own)
    below, done = None, None
    for k in range(deepest, -1, -1):
        here = base.where(F.col("level") == k).withColumns({f"_{n}": c for n, c in own.items()})
        if below is None:
            here = here.withColumns({f"_g_{n}": F.lit(None).cast("long" if n == "missing" else "boolean") for n in names})
        else:
            kids = below.groupBy("frame", F.col("parent_id").alias("tile_id")).agg(*(gather[n](F.col(n)).alias(f"_g_{n}") for n in names))
            here = here.join(kids, ["frame", "tile_id"], "left")
        here = here.withColumns({n: settle[n](F.col(f"_{n}"), F.col(f"_g_{n}")) for n in names}).drop(*(f"_{n}" for n in names), *(f"_g_{n}" for n in names))
        below = scratch.table(here, f"fold-{k}")
        done = below if done is None else done.unionByName(below)
    return done


def _under_kicks(rows: DataFrame, o: Options, scratch: Scratch) -> DataFrame:
    """Rows with whether an ancestor stands in for them, and whether its missing descendants are too many to load."""
    deepest = rows.agg(F.max("level")).first()[0] or 0
    flags = {"under_kick": F.lit(False), "dropped": F.lit(False)}
    now = rows.where("level = 0").withColumns(flags)
    done = now
    for k in range(1, deepest + 1):
        over = F.col("kicks") & (F.col("missing") > o.descendant_limit)
        above = now.select("frame", F.col("tile_id").alias("parent_id"), (F.col("under_kick") | F.col("kicks")).alias("under_kick"), (F.col("dropped") | over).alias("dropped"))
        now = scratch.table(rows.where(F.col("level") == k).join(above, ["frame", "parent_id"]), f"kick-{k}")
        done = done.unionByName(now.select(done.columns))
    return done


def load_queue(chosen: DataFrame, options: Options | None = None) -> DataFrame:
    """The loads of each frame: frame, tile_id, load_group, score, rank, dispatched.

    The score is one less the mean of depth, distance, off-axis angle and inverse error, each scaled to
    0..1 over the frame's queue, higher first; groups go before scores. Extremes are joined from an aggregate, so
    that only the first ``loads`` of a group pass through one task. Ties: the smaller tile id.
    """
    o = options or Options()
    queue = chosen.where("load_group is not null").withColumns({"raw_depth": F.col("level") * (-1.0 if o.prefer_leaves else 1.0), "raw_sse": F.when(F.col("sse") > 0, 1 / F.col("sse")).otherwise(0.0)})
    raw = ["raw_depth", "distance", "off_axis", "raw_sse"]
    ends = queue.groupBy("frame").agg(*(f(c).alias(f"{n}_{c}") for c in raw for n, f in (("lo", F.min), ("hi", F.max))))
    met = queue.join(ends, "frame")
    floors = {"raw_depth": 1.0, "distance": 1e-10, "off_axis": 1e-10, "raw_sse": 1e-10}
    scaled = [(F.col(c) - F.col(f"lo_{c}")) / F.greatest(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(floors[c])) for c in raw]
    scored = met.withColumn("score", 1.0 - (scaled[0] + scaled[1] + scaled[2] + scaled[3]) / 4)
    order = Window.partitionBy("frame").orderBy(F.desc("load_group"), F.desc("score"), "tile_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= o.loads)
    return ranked.select("frame", "tile_id", "load_group", "score", "rank")


def view_toward(eye: Vec, target: Vec) -> Vec:
    return (target - eye).unit()


DEGREE = math.pi / 180
