"""Readers and writers of tileset JSON, subtrees and binary glTF, over Spark's own file sources.

Documents are read by ``binaryFile``: any file system that Spark reads will do. A document is parsed in
one task; what it holds comes out as rows.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator
from typing import Any
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = "uri string, tile_id long, parent_id long, level int, geometric_error double, refine string, content_uri string, kind string, volume array<double>, transform array<double>, content_uris array<string>"


def documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(uri, content) of the files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("uri"), "content")


def _multiplied(a: list[float], b: list[float]) -> list[float]:
    return [sum(a[4 * k + r] * b[4 * c + k] for k in range(4)) for c in range(4) for r in range(4)]


_IDENTITY = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]


def _numbers(values: Any) -> bool:
    return isinstance(values, list) and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values)


def flatten(text: bytes | str) -> list[dict[str, Any]]:
    """Tiles of a tileset document, parents first: refinement is inherited, transforms are multiplied from the root.

    A document that is no tileset, or has no root, gives no tile. Numbers that are missing or are no
    numbers are null, volumes and transforms that are not all numbers are none. ``content_uri`` is the
    first content's, ``content_uris`` has all of them.
    """
    try:
        root = json.loads(text).get("root")
    except (ValueError, AttributeError):
        return []
    if not isinstance(root, dict):
        return []
    rows: list[dict[str, Any]] = []
    open_ = [(root, None, 0, "REPLACE", _IDENTITY)]
    while open_:
        tile, parent, level, refine, above = open_.pop()
        refine = str(tile.get("refine") or refine).upper()
        own = tile.get("transform")
        transform = _multiplied(above, own) if _numbers(own) and len(own) == 16 else above
        volume = tile.get("boundingVolume")
        volume = {k: v for k, v in volume.items() if _numbers(v)} if isinstance(volume, dict) else {}
        kind = next((k for k in ("box", "region", "sphere") if k in volume), "empty")
        several = tile.get("contents")
        contents = [c for c in [tile.get("content"), *(several if isinstance(several, list) else [])] if isinstance(c, dict)]
        uris = [u for c in contents if isinstance(u := c.get("uri") or c.get("url"), str)]
        error = tile.get("geometricError")
        number = len(rows)
        rows.append({
            "tile_id": number, "parent_id": parent, "level": level, "geometric_error": float(error) if _numbers([error]) else None, "refine": refine.lower(), "content_uri": uris[0] if uris else None, "content_uris": uris,
            "kind": kind, "volume": [float(v) for v in volume.get(kind, [])], "transform": [float(v) for v in transform],
        })
        kids = tile.get("children")
        open_ += [(c, number, level + 1, refine, transform) for c in reversed(kids if isinstance(kids, list) else []) if isinstance(c, dict)]
    return rows


def tiles(docs: DataFrame) -> DataFrame:
    """One row for each tile of each tileset document (uri, content)."""
    fields = ["tile_id", "parent_id", "level", "geometric_error", "refine", "content_uri", "kind", "volume", "transform", "content_uris"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = flatten(content.as_py() or b"")
                columns = [pa.array([r[f] for r in rows], k) for f, k in zip(fields, kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(rows), pa.string()), *columns], ["uri", *fields])

    return docs.select("uri", "content").mapInArrow(run, TILE)


def nested(rows: list[dict[str, Any]], error: float) -> dict[str, Any]:
    """A tileset document of flat tiles: the inverse of ``flatten``, with transforms left at the root's."""
    made: dict[int, dict[str, Any]] = {}
    root: dict[str, Any] = {}
    for r in rows:
        tile: dict[str, Any] = {"boundingVolume": {r["kind"]: r["volume"]} if r["kind"] != "empty" else {}, "geometricError": r["geometric_error"], "refine": r["refine"].upper()}
        uris = r.get("content_uris") or [r["content_uri"]] * bool(r["content_uri"])
        if len(uris) == 1:
            tile["content"] = {"uri": uris[0]}
        elif uris:
            tile["contents"] = [{"uri": u} for u in uris]
        made[r["tile_id"]] = tile
        if r["parent_id"] is None:
            root = tile
        else:
            made[r["parent_id"]].setdefault("children", []).append(tile)
    return {"asset": {"version": "1.1"}, "geometricError": error, "root": root}


#: The magic numbers of subtree and binary glTF files.
SUBTREE_MAGIC, GLB_MAGIC, JSON_CHUNK, BIN_CHUNK = 0x74627573, 0x46546C67, 0x4E4F534A, 0x004E4942


def read_subtree(raw: bytes) -> dict[str, tuple[bool | None, bytes | None]] | None:
    """Availability of tiles, contents and child subtrees, each a constant or a bitstream; None for a malformed file.

    Further contents of a tile are "content1", "content2" and so on.
    """
    if len(raw) < 24:
        return None
    magic, version, json_size, bin_size = struct.unpack_from("<IIQQ", raw)
    if magic != SUBTREE_MAGIC or version != 1 or 24 + json_size + bin_size > len(raw):
        return None
    try:
        head = json.loads(raw[24 : 24 + json_size])
        body = raw[24 + json_size : 24 + json_size + bin_size]
        views = head.get("bufferViews", [])

        def part(a: Any) -> tuple[bool | None, bytes | None]:
            if a is None:
                return None, None
            if "constant" in a:
                return bool(a["constant"]), None
            view = views[a["bitstream"] if "bitstream" in a else a["bufferView"]]
            start = view.get("byteOffset", 0)
            bits = body[start : start + view["byteLength"]]
            if len(bits) < view["byteLength"]:
                raise ValueError("a view beyond its buffer")
            return None, bits

        contents = head.get("contentAvailability")
        contents = contents if isinstance(contents, list) else [contents]
        several = {f"content{k}" if k else "content": part(c) for k, c in enumerate(contents or [None])}
        return {"tile": part(head.get("tileAvailability")), **several, "child": part(head.get("childSubtreeAvailability"))}
    except (ValueError, KeyError, IndexError, TypeError, AttributeError):
        return None


def write_subtree(parts: dict[str, tuple[bool | None, bytes | None]]) -> bytes:
    """A subtree file of constants and bitstreams; sections padded to eight bytes."""
    body, views, head = b"", [], {}
    for name, key in (("tile", "tileAvailability"), ("content", "contentAvailability"), ("child", "childSubtreeAvailability")):
        constant, bits = parts.get(name, (None, None))
        if bits is None and constant is None:
            continue
        if bits is None:
            entry: dict[str, Any] = {"constant": int(bool(constant))}
        else:
            views.append({"buffer": 0, "byteOffset": len(body), "byteLength": len(bits)})
            body += bits + b"\0" * (-len(bits) % 8)
            entry = {"bitstream": len(views) - 1, "availableCount": sum(b.bit_count() for b in bits)}
        head[key] = [entry] if name == "content" else entry
    if body:
        head |= {"buffers": [{"byteLength": len(body)}], "bufferViews": views}
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return struct.pack("<IIQQ", SUBTREE_MAGIC, 1, len(text), len(body)) + text + body


def subtrees(docs: DataFrame) -> DataFrame:
    """(uri, part, constant, bits) of subtree files: a row for each of tile, every content and child; malformed files give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(uri, name, *value) for uri, content in zip(batch.column(0).to_pylist(), batch.column(1)) for name, value in (read_subtree(content.as_py() or b"") or {}).items()]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.binary()))], ["uri", "part", "constant", "bits"])

    return docs.select("uri", "content").mapInArrow(run, "uri string, part string, constant boolean, bits binary")


def read_glb(raw: bytes) -> tuple[str, bytes] | None:
    """The JSON text and the binary chunk of a glTF container; None for a malformed one."""
    if len(raw) < 12:
        return None
    magic, version, size = struct.unpack_from("<III", raw)
    if magic != GLB_MAGIC or version != 2 or size > len(raw):
        return None
    at, text, body = 12, None, b""
    while at + 8 <= size:
        length, kind = struct.unpack_from("<II", raw, at)
        if at + 8 + length > size:
            return None
        chunk = raw[at + 8 : at + 8 + length]
        if kind == JSON_CHUNK and text is None:
            text = chunk.decode("utf-8", "replace").rstrip(" \0")
        elif kind == BIN_CHUNK and not body:
            body = chunk
        at += 8 + length
    return None if text is None else (text, body)


def write_glb(text: str, body: bytes = b"") -> bytes:
    """A glTF container; chunks padded to four bytes."""
    head = text.encode()
    head += b" " * (-len(head) % 4)
    body += b"\0" * (-len(body) % 4)
    chunks = struct.pack("<II", len(head), JSON_CHUNK) + head + (struct.pack("<II", len(body), BIN_CHUNK) + body if body else b"")
    return struct.pack("<III", GLB_MAGIC, 2, 12 + len(chunks)) + chunks


#: Bytes of a component by its glTF code, and components by type.
_COMPONENT = {5120: ("b", 1), 5121: ("B", 1), 5122: ("h", 2), 5123: ("H", 2), 5125: ("I", 4), 5126: ("f", 4)}
_WIDTH = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT2": 4, "MAT3": 9, "MAT4": 16}


def _buffer(model: dict[str, Any], body: bytes, number: int) -> bytes:
    """A buffer's bytes: the binary chunk for the first without a URI, a data URI's own; KeyError for one that stands elsewhere."""
    uri = model["buffers"][number].get("uri") if "buffers" in model else None
    if uri is None and number == 0:
        return body
    head, comma, data = (uri or "").partition(",")
    if not comma or not head.startswith("data:"):
        raise KeyError("an external buffer")
    return base64.b64decode(data) if head.endswith(";base64") else unquote_to_bytes(data)


def _elements(model: dict[str, Any], body: bytes, view: int, start: int, code: str, size: int, width: int, count: int) -> np.ndarray:
    """Elements of a buffer view, by its stride."""
    at = model["bufferViews"][view]
    raw, step = _buffer(model, body, at.get("buffer", 0)), at.get("byteStride") or size * width
    start += at.get("byteOffset", 0)
    if count and start + step * (count - 1) + size * width > len(raw):
        raise ValueError("a view beyond its buffer")
    if not count:
        return np.zeros((0, width))
    rows = np.lib.stride_tricks.as_strided(np.frombuffer(raw, np.uint8, offset=start), (count, size * width), (step, 1), writeable=False)
    return np.ascontiguousarray(rows).view(f"<{code}").reshape(count, width).astype(float)


def accessor_array(model: dict[str, Any], body: bytes, number: int) -> np.ndarray:
    """The elements of an accessor, sparse ones in their places, normalised integers in 0..1 or -1..1; zeros without a view."""
    a = model["accessors"][number]
    code, size = _COMPONENT[a["componentType"]]
    width, n = _WIDTH[a["type"]], int(a["count"])
    if n < 0:
        raise ValueError("a negative count")
    out = _elements(model, body, a["bufferView"], a.get("byteOffset", 0), code, size, width, n) if "bufferView" in a else np.zeros((n, width))
    if sparse := a.get("sparse"):
        m, at, to = int(sparse["count"]), sparse["indices"], sparse["values"]
        kind, wide = _COMPONENT[at["componentType"]]
        places = _elements(model, body, at["bufferView"], at.get("byteOffset", 0), kind, wide, 1, m)[:, 0].astype(np.int64)
        out = out.copy()
        out[places] = _elements(model, body, to["bufferView"], to.get("byteOffset", 0), code, size, width, m)
    if a.get("normalized") and code != "f":
        out = np.maximum(out / float((1 << 8 * size - code.islower()) - 1), -1.0)
    return out


def accessor_values(text: str, body: bytes, number: int) -> list[tuple[float, ...]]:
    """``accessor_array`` as tuples; empty where it cannot be read."""
    try:
        return [tuple(v) for v in accessor_array(json.loads(text), body, number).tolist()]
    except _UNREADABLE:
        return []


_UNREADABLE = (ValueError, KeyError, IndexError, TypeError, AttributeError)


def accessors(docs: DataFrame) -> DataFrame:
    """(uri, accessor, element, value, reject) of binary glTF files: every element of every accessor as an array of doubles.

    A file, or an accessor, that cannot be read has one row with the reason and no value; the rest is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["uri", "accessor", "element", "value", "reject"], (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string())
        for batch in batches:
            for uri, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found, rows = read_glb(content.as_py() or b""), []
                try:
                    model = json.loads(found[0]) if found else None
                    number = len(model.get("accessors", []))
                except _UNREADABLE:
                    number, rows = 0, [([None], [None], [None], "no binary glTF")]
                for k in range(number):
                    try:
                        values = accessor_array(model, found[1], k).tolist()
                        rows.append(([k] * len(values), range(len(values)), values, None))
                    except _UNREADABLE as e:
                        rows.append(([k], [None], [None], str(e) or type(e).__name__))
                for number_, element, value, reject in rows:
                    columns = ([uri] * len(value), number_, element, value, [reject] * len(value))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select("uri", "content").mapInArrow(run, "uri string, accessor int, element int, value array<double>, reject string")


def layer_json(tiles_: DataFrame, template: str = "{z}/{x}/{y}.terrain", kind: str = "quantized-mesh-1.0") -> str:
    """The manifest of a terrain tileset: ranges of columns and rows for each level, one row a level to the driver."""
    rows = tiles_.groupBy("level").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).orderBy("level").collect()
    levels: dict[int, list[dict[str, int]]] = {r[0]: [{"startX": r[1], "startY": r[2], "endX": r[3], "endY": r[4]}] for r in rows}
    top = max(levels, default=-1)
    return json.dumps({"tilejson": "2.1.0", "format": kind, "version": "1.0.0", "scheme": "tms", "tiles": [template], "minzoom": min(levels, default=0), "maxzoom": max(top, 0), "available": [levels.get(k, []) for k in range(top + 1)]})
