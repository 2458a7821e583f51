"""GeoJSON documents to rows of features, points, lines and rings."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

_SIMPLE = {"Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon"}


def geometries(node: Any, feature: int | None = None, properties: Any = None, counter: list[int] | None = None) -> Iterator[tuple[int | None, Any, dict]]:
    """(feature number, properties, geometry) of all simple geometries of a GeoJSON object, collections opened, nulls passed over."""
    counter = [0] if counter is None else counter
    if not isinstance(node, dict):
        return
    kind = node.get("type")
    if kind == "FeatureCollection":
        for f in node.get("features") or []:
            yield from geometries(f, None, None, counter)
    elif kind == "Feature":
        number = counter[0]
        counter[0] += 1
        yield from geometries(node.get("geometry"), number, node.get("properties"), counter)
    elif kind == "GeometryCollection":
        for g in node.get("geometries") or []:
            yield from geometries(g, feature, properties, counter)
    elif kind in _SIMPLE:
        yield feature, properties, node


def repaired(ring: list[list[float]]) -> list[list[float]]:
    """A closed ring: a last point like the first is added where it is missing; fewer than three points are none."""
    if len(ring) < 3:
        return []
    return ring if ring[0] == ring[-1] else [*ring, ring[0]]


def pieces(geometry: dict) -> Iterator[tuple[str, int, list[list[float]]]]:
    """('point', 'line' or 'ring', ring number, positions): rings count from 0 for the outer one of each polygon."""
    kind, at = geometry["type"], geometry.get("coordinates") or []
    if kind == "Point":
        yield "point", 0, [at] if at else []
    elif kind == "MultiPoint":
        yield from (("point", 0, [p]) for p in at)
    elif kind == "LineString":
        yield "line", 0, at
    elif kind == "MultiLineString":
        yield from (("line", 0, line) for line in at)
    else:
        for polygon in [at] if kind == "Polygon" else at:
            yield from (("ring", k, repaired(ring)) for k, ring in enumerate(polygon))


def flatten(docs: DataFrame) -> DataFrame:
    """(uri, feature, properties, piece, ring, lon, lat arrays, bbox) for each point, line and ring of GeoJSON documents (uri, content).

    Geometries outside of features have a null feature. Malformed documents and empty pieces give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    node = json.loads(content.as_py() or b"null")
                except ValueError:
                    continue
                for feature, properties, geometry in geometries(node):
                    for piece, ring, points in pieces(geometry):
                        if points:
                            lon, lat = [float(p[0]) for p in points], [float(p[1]) for p in points]
                            rows.append((uri, feature, None if properties is None else json.dumps(properties, sort_keys=True), piece, ring, lon, lat, [min(lon), min(lat), max(lon), max(lat)]))
            numbers = pa.list_(pa.float64())
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), numbers, numbers, numbers)
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["uri", "feature", "properties", "piece", "ring", "lon", "lat", "bbox"])

    return docs.select("uri", "content").mapInArrow(run, "uri string, feature long, properties string, piece string, ring int, lon array<double>, lat array<double>, bbox array<double>")


def ear_clip(points: list[tuple[float, float]]) -> list[int]:
    """Triangles, as indices, of a simple polygon in either direction; empty for fewer than three points."""
    n = len(points)
    if n < 3:
        return []
    area = sum(points[k][0] * points[(k + 1) % n][1] - points[(k + 1) % n][0] * points[k][1] for k in range(n))
    left = list(range(n)) if area > 0 else list(range(n - 1, -1, -1))

    def turn(a: int, b: int, c: int) -> float:
        (ax, ay), (bx, by), (cx, cy) = points[a], points[b], points[c]
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    out: list[int] = []
    while len(left) > 3:
        for k in range(len(left)):
            a, b, c = left[k - 1], left[k], left[(k + 1) % len(left)]
            if turn(a, b, c) <= 0:
                continue
            if any(turn(a, b, p) >= 0 and turn(b, c, p) >= 0 and turn(c, a, p) >= 0 for p in left if p not in (a, b, c) and points[p] not in (points[a], points[b], points[c])):
                continue
            out += [a, b, c]
            del left[k]
            break
        else:
            return out  # no ear: the polygon crosses itself
    return out + left
