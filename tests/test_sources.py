import json
import struct

from tessella.functions.availability import is_set
from tessella.operators import metadata
from tessella.sources import tilesets as T
from tessella.sources import vectors as V

TILESET = {
    "asset": {"version": "1.1"}, "geometricError": 100,
    "root": {"boundingVolume": {"sphere": [0, 0, 0, 10]}, "geometricError": 50, "refine": "ADD", "transform": [2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 2, 0, 5, 0, 0, 1], "content": {"uri": "a.glb"},
             "children": [{"boundingVolume": {"box": [0] * 12}, "geometricError": 10, "transform": [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 1, 0, 0, 1]}, {"boundingVolume": {"region": [0, 0, 1, 1, 0, 5]}, "refine": "replace", "children": [{}]}]},
}


def test_tileset_rows():
    rows = T.flatten(json.dumps(TILESET))
    assert [(r["tile_id"], r["parent_id"], r["level"], r["refine"], r["kind"]) for r in rows] == [(0, None, 0, "add", "sphere"), (1, 0, 1, "add", "box"), (2, 0, 1, "replace", "region"), (3, 2, 2, "replace", "empty")]
    assert rows[1]["transform"][12] == 7 and rows[3]["geometric_error"] is None
    assert T.flatten("{") == T.flatten("[]") == T.flatten('{"root": 3}') == []
    again = T.flatten(json.dumps(T.nested(rows, 100)))
    assert [(r["kind"], r["volume"], r["refine"]) for r in again] == [(r["kind"], r["volume"], r["refine"]) for r in rows]


def test_files_are_read(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps(TILESET))
    (tmp_path / "bad.json").write_text("nothing")
    assert T.tiles(T.documents(spark, str(tmp_path), "*.json")).count() == 4


def test_subtrees(spark):
    raw = T.write_subtree({"tile": (None, b"\x05\x01"), "content": (True, None), "child": (False, None)})
    assert T.read_subtree(raw) == {"tile": (None, b"\x05\x01"), "content": (True, None), "child": (False, None)}
    for broken in (b"", raw[:30], b"xxxx" + raw[4:], raw[:24] + b"{" * 8 + raw[32:]):
        assert T.read_subtree(broken) is None
    df = spark.createDataFrame([("a", bytearray(raw)), ("b", bytearray(b"no")), ("c", None)], "uri string, content binary")
    rows = T.subtrees(df)
    assert rows.count() == 3
    from pyspark.sql import functions as F

    found = rows.where("part = 'tile'").select(*(is_set(F.col("bits"), F.lit(k)).alias(f"b{k}") for k in range(10))).first()
    assert [k for k, v in enumerate(found) if v] == [0, 2, 8]


def test_glb(spark):
    body = struct.pack("<6f", *range(6)) + struct.pack("<4H", 9, 8, 7, 6)
    model = {"accessors": [{"bufferView": 0, "componentType": 5126, "type": "VEC3", "count": 2}, {"bufferView": 1, "componentType": 5123, "type": "SCALAR", "count": 2}, {"componentType": 5126, "type": "SCALAR", "count": 1}, {"bufferView": 0, "componentType": 5126, "type": "VEC3", "count": 9}], "bufferViews": [{"byteLength": 24}, {"byteOffset": 24, "byteLength": 8, "byteStride": 4}]}
    raw = T.write_glb(json.dumps(model), body)
    assert len(raw) % 4 == 0 and T.read_glb(raw) == (json.dumps(model), body)
    for broken in (b"", raw[:20], b"\0" * 40):
        assert T.read_glb(broken) is None
    df = spark.createDataFrame([("a", bytearray(raw)), ("b", bytearray(raw[:-5]))], "uri string, content binary")
    got = {(r.accessor, r.element): r.value for r in T.accessors(df).where("reject is null").collect()}
    assert got == {(0, 0): [0, 1, 2], (0, 1): [3, 4, 5], (1, 0): [9], (1, 1): [7], (2, 0): [0]}


def test_layer_json(spark):
    from tessella.plans.trees import quadtree

    body = json.loads(T.layer_json(quadtree(spark, 3, 2, 1)))
    assert body["available"][2] == [{"startX": 0, "startY": 0, "endX": 7, "endY": 3}] and body["maxzoom"] == 2
    assert json.loads(T.layer_json(quadtree(spark, 1).where("level > 5")))["available"] == []


def test_geojson(spark):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"a": 1}, "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}, {"type": "LineString", "coordinates": [[0, 0], [3, 4]]}]}},
        {"type": "Feature", "properties": None, "geometry": None},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4]], [[1, 1], [2, 1]]]}},
    ]}
    df = spark.createDataFrame([("a", bytearray(json.dumps(doc).encode())), ("b", bytearray(b"{")), ("c", None)], "uri string, content binary")
    got = sorted((r.feature, r.piece, r.ring, len(r.lon), tuple(r.bbox)) for r in V.flatten(df).collect())
    assert got == [(0, "line", 0, 2, (0, 0, 3, 4)), (0, "point", 0, 1, (1, 2, 1, 2)), (2, "ring", 0, 4, (0, 0, 4, 4))]


def test_ear_clipping():
    def area(p):
        return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) / 2

    for points in ([(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], [(0, 4), (2, 1), (4, 4), (4, 0), (0, 0)]):
        t = V.ear_clip(points)
        assert len(t) == 3 * (len(points) - 2)
        assert abs(sum(abs(area([points[i] for i in t[k : k + 3]])) for k in range(0, len(t), 3)) - abs(area(points))) < 1e-9
    assert V.ear_clip([(0, 0), (1, 1)]) == []


def test_attribute_buffers(spark):
    rows = [("u16", bytearray(struct.pack("<3H", 1, 2, 65535))), ("odd", bytearray(b"abc")), ("none", None)]
    df = spark.createDataFrame(rows, "name string, content binary")
    got = [(r.name, r.feature_index, r.value) for r in metadata.decode_buffer(df, "UINT16").collect()]
    assert got == [("u16", 0, 1), ("u16", 1, 2), ("u16", 2, 65535)]
    wide = spark.createDataFrame([("v", bytearray(struct.pack("<4f", 1, 2, 3, 4)))], "name string, content binary")
    assert [r.value for r in metadata.decode_buffer(wide, "FLOAT32", 2).collect()] == [[1, 2], [3, 4]]
    big = spark.createDataFrame([("u", bytearray(struct.pack("<1Q", 2**64 - 1)))], "name string, content binary")
    assert int(metadata.decode_buffer(big, "UINT64").first().value) == 2**64 - 1
