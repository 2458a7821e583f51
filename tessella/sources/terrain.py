"""Terrain tiles: sampling of height rasters, height maps and quantized meshes.

A raster is rows (row, col, value), or blocks of them, and a tile's samples are joined to it by key, so
that no task needs the whole raster. A tile's grid is one row, encoded or decoded in one call.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.geodesy import WGS84_A, WGS84_B

#: The default grid, and the header of a quantized mesh (centre, heights, sphere, horizon point).
GRID = 65
_HEADER = struct.Struct("<3d2f4d3d")


def _ecef(lon: np.ndarray, lat: np.ndarray, h: np.ndarray) -> np.ndarray:
    e2 = 1 - (WGS84_B / WGS84_A) ** 2
    n = WGS84_A / np.sqrt(1 - e2 * np.sin(lat) ** 2)
    return np.stack([(n + h) * np.cos(lat) * np.cos(lon), (n + h) * np.cos(lat) * np.sin(lon), (n * (1 - e2) + h) * np.sin(lat)], -1)


def _zigzag(v: np.ndarray) -> np.ndarray:
    return ((v << 1) ^ (v >> 31)).astype("<u2")


def _unzigzag(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    return (v >> 1) ^ -(v & 1)


def _high_water(indices: np.ndarray) -> np.ndarray:
    """Codes of indices of which each new one is the next: distances from the highest so far plus one."""
    top = np.concatenate(([0], np.maximum.accumulate(indices)[:-1] + 1))
    return top - indices


def _from_high_water(codes: np.ndarray) -> np.ndarray:
    codes = codes.astype(np.int64)
    top = np.concatenate(([0], np.cumsum(codes == 0)[:-1]))
    return top - codes


def grid_triangles(n: int) -> np.ndarray:
    """Two triangles for each cell of an n by n grid, row by row from the south."""
    k = (np.arange(n - 1)[:, None] * n + np.arange(n - 1)).ravel()
    return np.stack([k, k + 1, k + n, k + 1, k + n + 1, k + n], -1).ravel()


def _first_met(triangles: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Vertices in the order in which triangles first name them, and each vertex's place in it."""
    _, first = np.unique(triangles, return_index=True)
    order = triangles[np.sort(first)]
    place = np.empty(n, np.int64)
    place[order] = np.arange(len(order))
    return order, place


def encode_mesh(west: float, south: float, east: float, north: float, heights: np.ndarray) -> bytes:
    """A quantized mesh of an n by n grid of heights, row by row from the south, over a rectangle in radians."""
    n = heights.shape[0]
    low, high = float(heights.min()), float(heights.max())
    u, v = np.meshgrid(np.linspace(0, 32767, n), np.linspace(0, 32767, n))
    h = (heights - low) / (high - low) * 32767 if high > low else np.zeros_like(heights, float)
    triangles = grid_triangles(n)
    order, place = _first_met(triangles, n * n)
    lon, lat = west + u / 32767 * (east - west), south + v / 32767 * (north - south)
    points = _ecef(lon.ravel(), lat.ravel(), heights.ravel().astype(float))
    center = (points.min(0) + points.max(0)) / 2
    radius = float(np.sqrt(((points - center) ** 2).sum(1).max()))
    scaled = points / [WGS84_A, WGS84_A, WGS84_B]
    ahead = center / [WGS84_A, WGS84_A, WGS84_B]
    ahead = ahead / np.linalg.norm(ahead)
    size = np.maximum(np.linalg.norm(scaled, axis=1), 1)
    cos = np.clip(scaled @ ahead / np.linalg.norm(scaled, axis=1), -1, 1)
    sin = np.sqrt(1 - cos * cos)
    along = 1 / np.maximum(cos / size - sin * np.sqrt(np.maximum(size * size - 1, 0)) / size, 1e-9)
    out = [_HEADER.pack(*center, low, high, *center, radius, *(ahead * along.max())), struct.pack("<I", n * n)]
    for values in (u, v, h):
        whole = np.rint(values.ravel()[order]).astype(np.int64)
        out.append(_zigzag(np.diff(whole, prepend=0)).tobytes())
    wide = n * n > 65536
    kind, align = ("<u4", 4) if wide else ("<u2", 2)
    out.append(b"\0" * (-sum(map(len, out)) % align))
    out += [struct.pack("<I", len(triangles) // 3), _high_water(place[triangles]).astype(kind).tobytes()]
    grid = np.arange(n * n).reshape(n, n)
    for edge in (grid[:, 0], grid[0], grid[:, -1], grid[-1]):
        out += [struct.pack("<I", n), place[edge].astype(kind).tobytes()]
    return b"".join(out)


@dataclass
class Mesh:
    """Decoded vertices (u, v from 0 to 1, height in metres), triangles, and the vertices of each edge."""

    u: np.ndarray
    v: np.ndarray
    height: np.ndarray
    triangles: np.ndarray
    edges: list[np.ndarray]


def decode_mesh(raw: bytes) -> Mesh | None:
    """None for a malformed tile."""
    try:
        *_, = _HEADER.unpack_from(raw)
        low, high = struct.unpack_from("<2f", raw, 24)
        at = _HEADER.size
        (n,) = struct.unpack_from("<I", raw, at)
        at += 4
        columns = []
        for _ in range(3):
            columns.append(np.cumsum(_unzigzag(np.frombuffer(raw, "<u2", n, at))))
            at += 2 * n
        kind, width = ("<u4", 4) if n > 65536 else ("<u2", 2)
        at += -at % width
        (count,) = struct.unpack_from("<I", raw, at)
        triangles = _from_high_water(np.frombuffer(raw, kind, 3 * count, at + 4))
        at += 4 + 3 * count * width
        edges = []
        for _ in range(4):
            (m,) = struct.unpack_from("<I", raw, at)
            edges.append(np.frombuffer(raw, kind, m, at + 4).astype(np.int64))
            at += 4 + m * width
    except (struct.error, ValueError):
        return None
    if len(triangles) and (triangles.min() < 0 or triangles.max() >= n):
        return None
    return Mesh(columns[0] / 32767, columns[1] / 32767, low + columns[2] / 32767 * (high - low), triangles, edges)


def encode_heightmap(heights: np.ndarray, children: int = 15, water: int = 0) -> bytes:
    """Fifteen-bit codes from the north-west, a mask of children and one water byte."""
    codes = np.floor(np.clip((heights[::-1] + 1000) / 10000, 0, 1) * 32767 + 0.5).astype("<u2")
    return codes.tobytes() + bytes([children, water])


def decode_heightmap(raw: bytes) -> tuple[np.ndarray, int] | None:
    """(heights from the south, mask of children); None where the samples are no square."""
    n = int(np.sqrt((len(raw) - 2) // 2)) if len(raw) > 2 else 0
    if not n or len(raw) not in (2 * n * n + 2, 2 * n * n + 1 + 65536):
        return None
    return np.frombuffer(raw, "<u2", n * n).reshape(n, n)[::-1] / 32767 * 10000 - 1000, raw[2 * n * n]


def encode(grids: DataFrame, kind: str = "mesh") -> DataFrame:
    """(level, x, y, content) from grids (level, x, y, west, south, east, north, heights: row by row from the south).

    Grids that are no square of two or more samples, or hold a null, give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for level, x, y, w, s, e, n, heights in zip(*(c.to_pylist() for c in batch.columns)):
                size = int(np.sqrt(len(heights or ())))
                if size < 2 or size * size != len(heights) or any(v is None for v in heights):
                    continue
                grid = np.array(heights, float).reshape(size, size)
                rows.append((level, x, y, encode_mesh(w, s, e, n, grid) if kind == "mesh" else encode_heightmap(grid)))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["level", "x", "y", "content"])

    return grids.select(F.col("level").cast("int"), F.col("x").cast("long"), F.col("y").cast("long"), "west", "south", "east", "north", "heights").mapInArrow(run, "level int, x long, y long, content binary")


def vertices(tiles: DataFrame) -> DataFrame:
    """(level, x, y, vertex, u, v, height) of quantized meshes (level, x, y, content); malformed ones give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for level, x, y, content in zip(*(c.to_pylist() for c in batch.columns)):
                mesh = decode_mesh(content or b"")
                if mesh is not None:
                    n = len(mesh.u)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([level] * n, pa.int32()), pa.array([x] * n, pa.int64()), pa.array([y] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(mesh.u), pa.array(mesh.v), pa.array(mesh.height)],
                        ["level", "x", "y", "vertex", "u", "v", "height"],
                    )

    return tiles.select(F.col("level").cast("int"), F.col("x").cast("long"), F.col("y").cast("long"), "content").mapInArrow(run, "level int, x long, y long, vertex int, u double, v double, height double")


def sample(tiles: DataFrame, raster: DataFrame, col: Column, row: Column, n: int = GRID) -> DataFrame:
    """Grids of tiles (level, x, y, west, south, east, north) from a raster (row, col, value), bilinear; missing pixels are 0 m.

    ``col`` and ``row`` give the pixel position, whole numbers at pixel centres, of columns lon and lat. Each
    sample asks for its four pixels by key: one shuffle of the samples, none of the raster but by its key.
    """
    steps = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = tiles.select("*", steps.alias("i")).select("*", steps.alias("j"))
    at = at.withColumns({"lon": F.col("west") + F.col("i") / (n - 1) * (F.col("east") - F.col("west")), "lat": F.col("south") + F.col("j") / (n - 1) * (F.col("north") - F.col("south"))})
    at = at.withColumns({"_c": col, "_r": row}).withColumns({"_c0": F.floor("_c"), "_r0": F.floor("_r")})
    weight = lambda f, d: f if d else 1 - f
    fx, fy = F.col("_c") - F.col("_c0"), F.col("_r") - F.col("_r0")
    corners = F.array(*(F.struct((F.col("_c0") + a).alias("c"), (F.col("_r0") + b).alias("r"), (weight(fx, a) * weight(fy, b)).alias("w")) for a in (0, 1) for b in (0, 1)))
    asked = at.select("level", "x", "y", "west", "south", "east", "north", "i", "j", F.explode(corners).alias("p")).where("p.w > 0")
    pixels = raster.select(F.col("col").cast("long").alias("_pc"), F.col("row").cast("long").alias("_pr"), "value")
    met = asked.join(pixels, (F.col("p.c") == F.col("_pc")) & (F.col("p.r") == F.col("_pr")), "left")
    key = ["level", "x", "y", "west", "south", "east", "north"]
    one = met.groupBy(*key, "i", "j").agg(F.sum(F.col("p.w") * F.coalesce("value", F.lit(0.0))).alias("h"))
    grid = one.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("j", "i", "h"))).alias("g"))
    return grid.select(*key, F.transform("g", lambda s: s["h"]).alias("heights"))


def zoom_for(resolution: Column, samples: int = GRID - 1) -> Column:
    """The level whose tiles sample a raster of this many degrees a pixel."""
    return F.greatest(F.ceil(F.log2((180.0 / samples) / resolution)), F.lit(0)).cast("int")
