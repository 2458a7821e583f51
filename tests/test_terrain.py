import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.sources import terrain as T


@pytest.mark.parametrize("n, low, high", [(2, 0, 1), (5, -100, 0.4), (65, 10, 4000), (9, 7, 7), (300, 0, 50)])
def test_mesh_round_trip(n, low, high):
    rng = np.random.default_rng(n)
    heights = rng.uniform(low, high, (n, n)) if high > low else np.full((n, n), float(low))
    mesh = T.decode_mesh(T.encode_mesh(0.1, 0.2, 0.11, 0.21, heights))
    i, j = np.rint(mesh.u * (n - 1)).astype(int), np.rint(mesh.v * (n - 1)).astype(int)
    assert len(mesh.u) == n * n and len(set(zip(i, j))) == n * n
    assert np.abs(mesh.height - heights[j, i]).max() <= (high - low) / 32767 + 1e-3
    assert len(mesh.triangles) == 6 * (n - 1) ** 2
    p = np.stack([mesh.u, mesh.v], -1)[mesh.triangles.reshape(-1, 3)]
    a, b = p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]
    area = (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) / 2
    assert (area > 0).all() and area.sum() == pytest.approx(1, abs=1e-3)
    west, south, east, north = mesh.edges
    assert (mesh.u[west] == 0).all() and (mesh.v[south] == 0).all() and (mesh.u[east] == 1).all() and (mesh.v[north] == 1).all()


def test_malformed_tiles():
    raw = T.encode_mesh(0, 0, 1, 1, np.zeros((4, 4)))
    assert T.decode_mesh(b"") is None and T.decode_mesh(raw[:-3]) is None and T.decode_heightmap(b"") is None and T.decode_heightmap(b"\0" * 9) is None


def test_heightmaps():
    heights = np.linspace(-900, 8000, 25).reshape(5, 5)
    back, children = T.decode_heightmap(T.encode_heightmap(heights, 7))
    assert children == 7 and np.abs(back - heights).max() < 0.2


def test_raster_to_tiles(spark):
    raster = spark.range(100).select((F.col("id") % 10).alias("col"), F.floor(F.col("id") / 10).alias("row"), (F.col("id") * 1.0).alias("value"))
    tiles = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 8.0, 8.0), (1, 1, 0, 20.0, 20.0, 24.0, 24.0)], "level int, x long, y long, west double, south double, east double, north double")
    grids = T.sample(tiles, raster, F.col("lon"), F.col("lat") + 0.5, 5)
    rows = {r.level: np.array(r.heights).reshape(5, 5) for r in grids.collect()}
    j, i = np.mgrid[0:5, 0:5] * 2.0
    assert np.allclose(rows[0], (j + 0.5) * 10 + i) and not rows[1].any()
    made = T.encode(grids)
    assert made.count() == 2 and T.vertices(made).where("level = 0").agg(F.max("height")).first()[0] == pytest.approx(93, abs=0.01)
    assert T.encode(grids, "heightmap").count() == 2
    assert T.encode(grids.withColumn("heights", F.slice("heights", 1, 24))).count() == 0


def test_zoom(spark):
    assert [r[0] for r in spark.range(1).select(F.explode(F.array(T.zoom_for(F.lit(0.01)), T.zoom_for(F.lit(5.0))))).collect()] == [9, 0]
