import json
import struct

import numpy as np
import pytest

from tessella.sources import bodies as B
from tessella.sources import tilesets as T

CLOUD = {"POSITION": np.array([[1, 2, 3], [4, 5, 6]], "<f4"), "RGB": np.array([[255, 0, 51], [0, 255, 0]], "u1"), "BATCH_ID": np.array([7, 8], "<u2")}


def one(raw):
    (body,) = B.parse(raw)
    return body


def test_points():
    found = B.points(one(B.write("pnts", {"POINTS_LENGTH": 2, "RTC_CENTER": [10, 20, 30]}, CLOUD)))
    assert found["position"].tolist() == [[11, 22, 33], [14, 25, 36]] and found["batch_id"].tolist() == [7, 8]
    assert np.allclose(found["color"], [[1, 0, 0.2, 1], [0, 1, 0, 1]]) and "normal" not in found


def test_quantised_points_packed_colors_and_normals():
    arrays = {"POSITION_QUANTIZED": np.array([[0, 65535, 32768]], "<u2"), "RGB565": np.array([0xF81F], "<u2"), "NORMAL_OCT16P": np.array([[128, 128]], "u1")}
    found = B.points(one(B.write("pnts", {"POINTS_LENGTH": 1, "QUANTIZED_VOLUME_OFFSET": [1, 1, 1], "QUANTIZED_VOLUME_SCALE": [2, 2, 2]}, arrays)))
    assert np.allclose(found["position"], [[1, 3, 1 + 2 * 32768 / 65535]]) and np.allclose(found["color"], [[1, 0, 1, 1]])
    assert np.allclose(found["normal"], [[0, 0, 1]], atol=0.01)
    for v in ([0, 0, 1], [0.6, 0, -0.8], [-0.48, 0.6, -0.64]):
        x = np.array(v) / np.abs(v).sum()
        xy = x[:2] if x[2] >= 0 else (1 - np.abs(x[1::-1])) * np.where(x[:2] >= 0, 1, -1)
        assert np.allclose(B._octahedral(np.round((xy[None] + 1) / 2 * 65535), 65535.0)[0], v, atol=1e-4)


def test_instances():
    arrays = {"POSITION": np.zeros((2, 3), "<f4"), "SCALE": np.array([2, 3], "<f4"), "NORMAL_UP": np.array([[0, 1, 0], [0, 0, 1]], "<f4"), "NORMAL_RIGHT": np.array([[1, 0, 0], [1, 0, 0]], "<f4")}
    found = B.instances(one(B.write("i3dm", {"INSTANCES_LENGTH": 2}, arrays, model=b"glTF")))
    assert found["scale"].tolist() == [[2] * 3, [3] * 3] and found["forward"].tolist() == [[0, 0, 1], [0, -1, 0]]
    plain = B.instances(one(B.write("i3dm", {"INSTANCES_LENGTH": 1, "POSITION": [1, 2, 3]}, {}, model=b"glTF")))
    assert (plain["up"].tolist(), plain["right"].tolist(), plain["position"].tolist()) == ([[0, 1, 0]], [[1, 0, 0]], [[1, 2, 3]])


def test_headers_of_older_models():
    table, model = b'{"a":[1,2]} ', T.write_glb("{}")
    size = 20 + len(table) + len(model)
    body = one(b"b3dm" + struct.pack("<IIII", 1, size, 2, len(table)) + table + model)
    assert (body["features"], body["table"], body["model"]) == ({"BATCH_LENGTH": 2}, {"a": [1, 2]}, model)
    body = one(b"b3dm" + struct.pack("<IIIII", 1, size + 4, len(table), 0, 2) + table + model)
    assert (body["features"], body["table"], body["model"]) == ({"BATCH_LENGTH": 2}, {"a": [1, 2]}, model)


def test_composites_within_composites():
    cloud, model = B.write("pnts", {"POINTS_LENGTH": 2}, CLOUD), B.write("b3dm", {"BATCH_LENGTH": 0}, {}, model=T.write_glb("{}"))
    found = list(B.parse(B.write_composite([model, B.write_composite([cloud, model]), cloud])))
    assert [(b["path"], b["kind"]) for b in found] == [("0/0", "b3dm"), ("0/1/0", "pnts"), ("0/1/1", "b3dm"), ("0/2", "pnts")]


WHOLE = B.write("pnts", {"POINTS_LENGTH": 2}, CLOUD)


@pytest.mark.parametrize(
    "raw",
    [b"", b"pnts", b"xxxx" + WHOLE[4:], WHOLE[:4] + b"\2" + WHOLE[5:], WHOLE[:-8], B.write("pnts", {"POINTS_LENGTH": 9}, CLOUD), B.write("pnts", {"POINTS_LENGTH": -1}, CLOUD), B.write("pnts", {"POINTS_LENGTH": 2}, {}),
     B.write("pnts", {"POINTS_LENGTH": "two"}, CLOUD), WHOLE.replace(b'{"POINTS', b'["POINTS'), B.write_composite([WHOLE])[:-40]],
)
def test_malformed_bodies_give_a_reason(spark, raw):
    rows = B.point_rows(spark.createDataFrame([("bad", bytearray(raw)), ("good", bytearray(WHOLE)), ("null", None)], "uri string, content binary")).collect()
    assert sorted((r.uri, r.point, r.reject is None) for r in rows if r.uri != "null" and r.uri != "bad") == [("good", 0, True), ("good", 1, True)]
    assert all(r.reject and r.position is None for r in rows if r.uri != "good") and {r.uri for r in rows} == {"bad", "good", "null"}


def test_accessors(spark):
    body = np.array([0, 127, 255, 1], "u1").tobytes() + np.array([9], "<f4").tobytes()
    views = [{"buffer": 0, "byteLength": 3}, {"buffer": 0, "byteOffset": 3, "byteLength": 1}, {"buffer": 0, "byteOffset": 4, "byteLength": 4}, {"buffer": 1, "byteLength": 4}, {"buffer": 2, "byteLength": 4}]
    entries = [
        {"componentType": 5121, "type": "SCALAR", "count": 3, "bufferView": 0, "normalized": True},
        {"componentType": 5126, "type": "SCALAR", "count": 3, "sparse": {"count": 1, "indices": {"bufferView": 1, "componentType": 5121}, "values": {"bufferView": 2}}},
        {"componentType": 5126, "type": "SCALAR", "count": 1, "bufferView": 3},
        {"componentType": 5126, "type": "SCALAR", "count": 1, "bufferView": 4},
        {"componentType": 5126, "type": "SCALAR", "count": 9, "bufferView": 2},
        {"componentType": 5120, "type": "SCALAR", "count": 1, "bufferView": 0, "normalized": True},
    ]
    model = {"buffers": [{"byteLength": 8}, {"uri": "data:application/octet-stream;base64,AACAPw=="}, {"uri": "far.bin"}], "bufferViews": views, "accessors": entries}
    docs = [("a", bytearray(T.write_glb(json.dumps(model), body))), ("b", bytearray(T.write_glb("{", b""))), ("c", bytearray(b"no")), ("d", None), ("e", bytearray(T.write_glb("[]")))]
    rows = T.accessors(spark.createDataFrame(docs, "uri string, content binary")).collect()
    values = {k: [r.value[0] for r in rows if r.uri == "a" and r.accessor == k and r.value] for k in range(6)}
    assert np.allclose(values[0], [0, 127 / 255, 1]) and values[1] == [0, 9, 0] and values[2] == [1.0] and values[3] == values[4] == [] and values[5] == [0]
    assert {(r.uri, r.accessor) for r in rows if r.reject} == {("a", 3), ("a", 4), ("b", None), ("c", None), ("d", None), ("e", None)}


def test_tiles_of_odd_documents():
    root = {"boundingVolume": {"sphere": ["a", 0, 0, 1], "box": [0] * 12}, "geometricError": "x", "transform": ["1"] * 16, "content": "text", "contents": [{"uri": "a"}, {"uri": "b"}, 3], "children": {"not": "a list"}}
    (tile,) = T.flatten(json.dumps({"root": root}))
    assert (tile["kind"], tile["geometric_error"], tile["content_uri"], tile["content_uris"]) == ("box", None, "a", ["a", "b"])
    assert T.flatten(json.dumps({"root": {"boundingVolume": [1, 2]}}))[0]["kind"] == "empty"
    raw = T.write_subtree({"tile": (True, None), "content": (None, b"\1"), "child": (False, None)})
    assert list(T.read_subtree(raw)) == ["tile", "content", "child"]
