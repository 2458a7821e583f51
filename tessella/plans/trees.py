"""Plans over trees: level-wise expansion from the roots, and folds from the leaves.

The driver loops over levels, of which there are few, never over tiles. A level's rows are a join of
the level before with its children by key; every level is written, so that neither a lost executor
nor the next level computes the ones above again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.storage import Scratch


def quadtree(spark: SparkSession, levels: int, root_x: int = 1, root_y: int = 1) -> DataFrame:
    """All tiles (level, x, y) of levels 0 to ``levels`` - 1, made by ranges: no tile is derived from another."""
    parts = []
    for level in range(levels):
        nx, ny = root_x << level, root_y << level
        parts.append(spark.range(nx * ny).select(F.lit(level).alias("level"), (F.col("id") % nx).alias("x"), F.floor(F.col("id") / nx).alias("y")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def descend(start: DataFrame, children: Callable[[DataFrame, int], DataFrame], opens: Column, scratch: Scratch, levels: int) -> DataFrame:
    """Rows of all levels: ``children`` makes the next level from the rows where ``opens`` holds.

    A tree that goes on beyond ``levels`` raises: a part of it would be taken for the whole.
    """
    now = scratch.table(start, "level-0")
    every = now
    for k in range(1, levels):
        now = scratch.table(children(now.where(opens), k), f"level-{k}")
        if now.isEmpty():
            break
        every = every.unionByName(now)
    else:
        if not children(now.where(opens), max(1, levels)).isEmpty():
            raise ValueError(f"the tree has more than {levels} levels: raise the number of levels")
    return every


def fold_up(rows: DataFrame, key: list[str], parent: list[str], level: str, own: dict[str, Column], gather: dict[str, Callable[[Column], Column]], settle: dict[str, Callable[[Column, Column], Column]], scratch: Scratch) -> DataFrame:
    """A value for each row from its own and those of its children, deepest level first.

    ``own`` gives a leaf's values; ``gather`` aggregates the children's; ``settle`` makes a row's value
    from its own and the gathered one, which is NULL without children.
    """
    names = list(own)
    rows = rows.withColumns({f"_{n}": c for n, c in own.items()})
    deepest = rows.agg(F.max(level)).first()[0]
    if deepest is None:
        return rows.withColumns({n: F.col(f"_{n}") for n in names}).drop(*(f"_{n}" for n in names))
    below, done = None, None
    for k in range(deepest, -1, -1):
        here = rows.where(F.col(level) == k)
        if below is None:
            here = here.withColumns({n: settle[n](F.col(f"_{n}"), F.lit(None)) for n in names})
        else:
            kids = below.groupBy(*[F.col(p).alias(f"_k{i}") for i, p in enumerate(parent)]).agg(*(gather[n](F.col(n)).alias(f"_g_{n}") for n in names))
            on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]
            joined = here.join(kids, on, "left")
            here = joined.withColumns({n: settle[n](F.col(f"_{n}"), F.col(f"_g_{n}")) for n in names}).drop(*(f"_k{i}" for i in range(len(key))), *(f"_g_{n}" for n in names))
        below = scratch.table(here.drop(*(f"_{n}" for n in names)), f"fold-{k}")
        done = below if done is None else done.unionByName(below)
    return done


def rolled_up(leaves: DataFrame, aggregates: list[Column], merge: list[Column], level: int) -> DataFrame:
    """A pyramid: ``aggregates`` of rows by tile at ``level``, merged upwards to level 0 from the level below each time."""
    now = leaves.groupBy("x", "y").agg(*aggregates).withColumn("level", F.lit(level))
    every = now
    for k in range(level - 1, -1, -1):
        now = now.withColumns({"x": F.shiftright("x", 1), "y": F.shiftright("y", 1)}).groupBy("x", "y").agg(*merge).withColumn("level", F.lit(k))
        every = every.unionByName(now)
    return every
