"""Queries of the sources: documents are made from the tables by each format's writer, read again as rows, and compared with SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import metadata
from tessella.queries import _query, _read
from tessella.sources import bodies, tilesets, vectors


def _documents(rows: DataFrame, key: str, make: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """(uri, content): a document for each value of ``key``."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"uri": [str(part[key].iloc[0])], "content": [make(part)]})

    return rows.groupBy(key).applyInPandas(run, "uri string, content binary")


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), k.alias("k"), (k * 0.25).alias("x"), (k % 97 * 0.5).alias("y"), (k % 31 * -0.125).alias("z"))


def _cloud(part: pd.DataFrame) -> bytes:
    part = part.sort_values("k")
    arrays = {"POSITION": part[["x", "y", "z"]].to_numpy("<f4"), "RGB": np.column_stack([part.k % 256, part.k % 7, part.k % 51]).astype("u1"), "BATCH_ID": (part.k % 1000).to_numpy("<u2")}
    return bodies.write("pnts", {"POINTS_LENGTH": len(part), "BATCH_LENGTH": 1000, "RTC_CENTER": [100.0, 200.0, 300.0]}, arrays)


def _copies(part: pd.DataFrame) -> bytes:
    part = part.sort_values("k")
    arrays = {"POSITION": part[["x", "y", "z"]].to_numpy("<f4"), "SCALE": (part.k % 5 + 1).to_numpy("<f4"), "BATCH_ID": (part.k % 1000).to_numpy("<u2")}
    return bodies.write("i3dm", {"INSTANCES_LENGTH": len(part)}, arrays, model=tilesets.write_glb("{}"))


def _batch(part: pd.DataFrame) -> bytes:
    part = part.sort_values("k")
    return bodies.write("b3dm", {"BATCH_LENGTH": len(part)}, {}, {"key": part.k.tolist(), "x": part.x.tolist()}, tilesets.write_glb("{}"))


_S = "s AS (SELECT s_nationkey AS nation, s_suppkey AS k, s_suppkey * 0.25 AS x, s_suppkey % 97 * 0.5 AS y, s_suppkey % 31 * -0.125 AS z, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier)"


@_query(f"""WITH {_S} SELECT CAST(nation AS VARCHAR) AS uri, i AS point, CAST(x + 100 AS DOUBLE) AS x, CAST(y + 200 AS DOUBLE) AS y, CAST(z + 300 AS DOUBLE) AS z,
  round((k % 256) / 255.0, 9) AS red, round((k % 7) / 255.0, 9) AS green, round((k % 51) / 255.0, 9) AS blue, k % 1000 AS batch_id FROM s""")
def point_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of a cloud for each nation."""
    p, c = F.col("position"), F.col("color")
    df = bodies.point_rows(_documents(_suppliers(spark, sf_dir), "nation", _cloud))
    return df.select("uri", "point", p[0].alias("x"), p[1].alias("y"), p[2].alias("z"), *(F.round(c[k], 9).alias(n) for k, n in enumerate(("red", "green", "blue"))), "batch_id")


@_query(f"WITH {_S} SELECT CAST(nation AS VARCHAR) AS uri, i AS instance, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, CAST(k % 5 + 1 AS DOUBLE) AS size, k % 1000 AS batch_id FROM s")
def instanced_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies of an instanced model for each nation."""
    p = F.col("position")
    df = bodies.instance_rows(_documents(_suppliers(spark, sf_dir), "nation", _copies))
    return df.select("uri", "instance", p[0].alias("x"), p[1].alias("y"), p[2].alias("z"), F.col("scale")[1].alias("size"), "batch_id")


@_query(f"WITH {_S} SELECT nation, CAST(i AS INT) AS batch_id, k AS key, CAST(x AS DOUBLE) AS x FROM s")
def batched_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of a batched model's table for each nation."""
    df = bodies.bodies(_documents(_suppliers(spark, sf_dir), "nation", _batch)).where("reject is null")
    df = df.select(F.col("uri").cast("int").alias("nation"), F.col("batch_length").cast("int").alias("batch_length"), "batch_table")
    return metadata.batch_table(df, "batch_table", "batch_length", {"key": "bigint", "x": "double"}).select("nation", "batch_id", "key", "x")


@_query("""
WITH s AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY s_nationkey), k AS (SELECT unnest(['b3dm', 'pnts', 'i3dm', 'b3dm']) AS kind, unnest(['0/0', '0/1', '0/2/0', '0/2/1']) AS path)
SELECT CAST(nation AS VARCHAR) AS uri, path, kind, CASE WHEN kind = 'pnts' THEN 1000 ELSE n END AS batch_length FROM s, k
""")
def composite_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bodies of a composite, one of them a composite itself, for each nation."""

    def make(part: pd.DataFrame) -> bytes:
        return bodies.write_composite([_batch(part), _cloud(part), bodies.write_composite([_copies(part), _batch(part)])])

    return bodies.bodies(_documents(_suppliers(spark, sf_dir), "nation", make)).select("uri", "path", "kind", "batch_length")


@_query("""
WITH n AS (SELECT n_regionkey AS region, n_nationkey AS nation, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation),
  t AS (SELECT region, 0 AS tile_id, NULL AS parent_id, 0 AS level, 512.0 AS error, NULL AS content FROM (SELECT DISTINCT region FROM n) UNION ALL SELECT region, i, 0, 1, 16.0 + nation, 'n' || nation || '.glb' FROM n)
SELECT CAST(region AS VARCHAR) AS uri, CAST(tile_id AS BIGINT) AS tile_id, CAST(parent_id AS BIGINT) AS parent_id, CAST(level AS INT) AS level, CAST(error AS DOUBLE) AS error, content, CAST(10 * level AS DOUBLE) AS east FROM t
""")
def tileset_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of a tileset document for each region, transforms multiplied from the root."""

    def make(part: pd.DataFrame) -> bytes:
        shift = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 10.0, 0, 0, 1.0]
        kids = [{"boundingVolume": {"sphere": [0, 0, 0, 1]}, "geometricError": 16.0 + int(k), "transform": shift, "content": {"uri": f"n{k}.glb"}} for k in sorted(part.nation)]
        return json.dumps({"asset": {"version": "1.0"}, "root": {"boundingVolume": {"sphere": [0, 0, 0, 9]}, "geometricError": 512, "refine": "ADD", "children": kids}}).encode()

    rows = _read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"))
    df = tilesets.tiles(_documents(rows, "region", make))
    return df.select("uri", "tile_id", "parent_id", "level", F.col("geometric_error").alias("error"), F.col("content_uri").alias("content"), F.col("transform")[12].alias("east"))


@_query(f"WITH {_S} SELECT CAST(nation AS VARCHAR) AS uri, CAST(i AS INT) AS element, CAST(x AS DOUBLE) AS x, CAST(CASE WHEN k % 3 = 0 THEN -1 ELSE y END AS DOUBLE) AS y FROM s")
def glb_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of a dense and of a sparse accessor in a binary glTF for each nation."""

    def make(part: pd.DataFrame) -> bytes:
        part = part.sort_values("k").reset_index(drop=True)
        some = np.flatnonzero(part.k % 3 == 0)
        arrays = [part.x.to_numpy("<f4"), part.y.to_numpy("<f4"), some.astype("<u4"), np.full(len(some), -1, "<f4")]
        body, views = b"", []
        for a in arrays:
            views.append({"buffer": 0, "byteOffset": len(body), "byteLength": a.nbytes})
            body += a.tobytes()
        sparse = {"sparse": {"count": len(some), "indices": {"bufferView": 2, "componentType": 5125}, "values": {"bufferView": 3}}} if len(some) else {}
        entry = {"componentType": 5126, "type": "SCALAR", "count": len(part)}
        return tilesets.write_glb(json.dumps({"buffers": [{"byteLength": len(body)}], "bufferViews": views, "accessors": [entry | {"bufferView": 0}, entry | {"bufferView": 1} | sparse]}), body)

    df = tilesets.accessors(_documents(_suppliers(spark, sf_dir), "nation", make)).select("uri", "accessor", "element", F.col("value")[0].alias("v"))
    return df.groupBy("uri", "element").agg(F.max(F.when(F.col("accessor") == 0, F.col("v"))).alias("x"), F.max(F.when(F.col("accessor") == 1, F.col("v"))).alias("y"))


@_query(f"WITH {_S} SELECT CAST(nation AS VARCHAR) AS name, CAST(i AS INT) AS feature_index, CAST(k * 3 AS BIGINT) AS value FROM s")
def attribute_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of an attribute buffer for each nation."""
    docs = _documents(_suppliers(spark, sf_dir), "nation", lambda part: (part.sort_values("k").k * 3).to_numpy("<u4").tobytes())
    return metadata.decode_buffer(docs.select(F.col("uri").alias("name"), "content"), "UINT32")


@_query(f"WITH {_S} SELECT CAST(nation AS VARCHAR) AS uri, i AS feature, CAST(x AS DOUBLE) AS lon, CAST(y AS DOUBLE) AS lat FROM s")
def geojson_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of a feature collection for each nation."""

    def make(part: pd.DataFrame) -> bytes:
        part = part.sort_values("k")
        return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"k": int(k)}, "geometry": {"type": "Point", "coordinates": [x, y]}} for k, x, y in zip(part.k, part.x, part.y)]}).encode()

    return vectors.flatten(_documents(_suppliers(spark, sf_dir), "nation", make)).select("uri", "feature", F.col("lon")[0].alias("lon"), F.col("lat")[0].alias("lat"))
