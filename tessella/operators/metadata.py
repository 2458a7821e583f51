"""Feature properties: typed columns from property tables, batch tables and attribute buffers."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Component types of buffers, as numpy kinds, and the Spark types that hold them.
COMPONENTS = {"INT8": ("<i1", "short"), "UINT8": ("<u1", "short"), "INT16": ("<i2", "int"), "UINT16": ("<u2", "int"), "INT32": ("<i4", "int"), "UINT32": ("<u4", "long"), "INT64": ("<i8", "long"), "UINT64": ("<u8", "decimal(20,0)"), "FLOAT32": ("<f4", "float"), "FLOAT64": ("<f8", "double")}
_TOP = {"INT8": 127.0, "UINT8": 255.0, "INT16": 32767.0, "UINT16": 65535.0, "INT32": 2147483647.0, "UINT32": 4294967295.0}


def value(raw: Column, component: str, normalized: bool = False, scale: float | None = None, offset: float | None = None, no_data: float | None = None, default: float | None = None) -> Column:
    """A property's value from its stored number: missing marks become the default, then norm, scale and offset apply."""
    out = raw.cast("double")
    if normalized:
        out = F.greatest(out / _TOP[component], F.lit(-1.0)) if component.startswith("I") else out / _TOP[component]
    if scale is not None:
        out = out * scale
    if offset is not None:
        out = out + offset
    if no_data is not None:
        out = F.when(raw != no_data, out)
    return out if default is None else F.coalesce(out, F.lit(default))


def decode_buffer(buffers: DataFrame, component: str, width: int = 1) -> DataFrame:
    """(name, feature_index, value) from buffers (name, content): fixed-width numbers, or vectors as arrays.

    A buffer that ends amid a feature gives no row here and one in ``broken``. Null contents are empty.
    Values leave in portions, so that a buffer of any length is read whole.
    """
    kind, sql = COMPONENTS[component]
    wide = component == "UINT64"
    arrow = pa.decimal128(20, 0) if wide else {"short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64()}[sql]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_py() or b""
                size = np.dtype(kind).itemsize * width
                if len(raw) % size:
                    continue
                for at in range(0, len(raw) // size, 1 << 16):
                    part = np.frombuffer(raw[at * size : (at + (1 << 16)) * size], kind)
                    rows = len(part) // width
                    values = pa.array([Decimal(int(v)) for v in part], arrow) if wide else pa.array(part.astype(arrow.to_pandas_dtype()), arrow)
                    if width > 1:
                        values = pa.ListArray.from_arrays(pa.array(range(0, len(part) + 1, width), pa.int32()), values)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * rows, pa.string()), pa.array(range(at, at + rows), pa.int32()), values], ["name", "feature_index", "value"])

    return buffers.select("name", "content").mapInArrow(run, f"name string, feature_index int, value {sql if width == 1 else f'array<{sql}>'}")


def broken(buffers: DataFrame, component: str, width: int = 1) -> DataFrame:
    """(name, size) of the buffers that end amid a feature."""
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    return buffers.where(size % (np.dtype(COMPONENTS[component][0]).itemsize * width) != 0).select("name", size.alias("size"))


def batch_table(rows: DataFrame, json_col: str, length_col: str, names: dict[str, str]) -> DataFrame:
    """Feature rows from batch tables in JSON, one array for each property in ``names`` (name: Spark type).

    An array whose length is not the batch length is NULL for all features, and named in ``dropped``.
    """
    schema = "struct<" + ",".join(f"`{n}`:array<{t}>" for n, t in names.items()) + ">"
    parsed = rows.withColumn("_p", F.from_json(json_col, schema))
    fits = {n: F.size(F.col("_p")[n]) == F.col(length_col) for n in names}
    dropped = F.array_compact(F.array(*(F.when(F.col("_p")[n].isNotNull() & ~fits[n], n) for n in names)))
    each = parsed.where(F.col(length_col) > 0).select("*", dropped.alias("dropped"), F.explode(F.sequence(F.lit(0), F.col(length_col) - 1)).alias("batch_id"))
    return each.select(*(c for c in rows.columns if c != json_col), "batch_id", "dropped", *(F.when(fits[n], F.get(F.col("_p")[n], F.col("batch_id"))).alias(n) for n in names))


def as_boolean(text: Column) -> Column:
    """'true', '1', 'yes' and 'false', '0', 'no', in any case; NULL otherwise."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)


def to_integer(v: Column, kind: str) -> Column:
    """A number cut to an integer type; NULL beyond its range."""
    low, high = {"tinyint": (-128, 127), "smallint": (-32768, 32767), "int": (-(2**31), 2**31 - 1)}.get(kind, (-(2.0**63), 2.0**63))
    whole = F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v))
    inside = (whole >= low) & (whole <= high if kind != "bigint" else whole < high)
    return F.when(inside, whole).try_cast(kind)
