"""Packing into length buckets that minimise padding, and token-budget batches inside each bucket.

Texts longer than ``window`` tokens are cut into consecutive segments, so lengths have at most
``window + 1`` values: the global histogram has a proven bound and is the only thing the driver
sees. Dynamic programming over it finds the bucket boundaries with the least total padding. A batch
holds ``budget // bucket length`` rows of one bucket, in the order of id and segment; rows are
numbered by range partitions and their counts, so a bucket with most rows is spread over all tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.quality import words
from tessella.llm.scratch import Scratch


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The ``buckets`` (or fewer) ascending bucket lengths with the least padding for this histogram.

    Ties: the smaller previous boundary. No length: no bucket.
    """
    if not lengths:
        return []
    order = np.argsort(lengths)
    size, count = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n, k = len(size), min(buckets, len(size))
    rows, tokens = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(size * count)))
    # cost[i, j]: padding when the lengths after the first i, up to the j-th, share a bucket.
    cost = size[None, :] * (rows[None, 1:] - rows[:-1, None]) - (tokens[None, 1:] - tokens[:-1, None])
    far = np.iinfo(np.int64).max // 4
    cost[np.tril_indices(n, -1)] = far
    best, back = cost[0].copy(), []
    for _ in range(1, k):
        total = np.full((n, n), far)
        total[1:] = np.minimum(best[:-1, None], far) + cost[1:]
        back.append(total.argmin(axis=0))
        best = total.min(axis=0)
    ends, j = [n - 1], n - 1
    for step in reversed(back):
        j = int(step[j]) - 1
        ends.append(j)
    return [int(size[e]) for e in reversed(ends)]


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null: 0."""
    return F.size(words(F.coalesce(text.cast("string"), F.lit(""))))


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", window: int = 2048, buckets: int = 8, budget: int = 16384) -> DataFrame:
    """Segments with their bucket and batch: doc_id, segment, start, n_tokens, bucket, bucket_len, batch, slot.

    ``length`` gives a row's tokens; null counts as 0, and such rows take a slot of the first bucket.
    ``start`` is the segment's first token in its text. ``batch`` counts on over all buckets, shortest
    first; ``slot`` counts inside the batch. Rows of equal id and segment are numbered in any order.
    Null ids come first. Other columns are not read. An empty table gives an empty table.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "packing")
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("n"))
    cut = whole.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / window) - 1).cast("int"))).alias("segment"))
    start = F.col("segment").cast("long") * window
    rows = scratch.table(cut.select("doc_id", "segment", start.alias("start"), F.least(F.lit(window).cast("long"), F.col("n") - start).alias("n_tokens")), "rows")
    histogram = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()
    ends = boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    n_tokens = F.col("n_tokens")
    bucket, size, first, capacity = F.lit(0), F.lit(0), F.lit(0), F.lit(1)
    low, batches = -1, 0
    for k, end in enumerate(ends):
        held = sum(r[1] for r in histogram if low < r[0] <= end)
        fits, room = n_tokens > low, max(1, budget // max(1, end))
        bucket, size = F.when(fits, k).otherwise(bucket), F.when(fits, end).otherwise(size)
        first, capacity = F.when(fits, batches).otherwise(first), F.when(fits, room).otherwise(capacity)
        low, batches = end, batches + -(-held // room)
    rows = rows.select("*", bucket.cast("int").alias("bucket"), size.cast("long").alias("bucket_len"), first.cast("long").alias("first"), capacity.cast("long").alias("room"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.table(rows.repartitionByRange(parts, "bucket", "doc_id", "segment").withColumn("part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("bucket", "part").agg(F.count("*").alias("n")).select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket", "part").orderBy("doc_id", "segment", "n_tokens")
    numbered = ranged.withColumn("row", F.row_number().over(inside) - 1).join(offsets, ["bucket", "part"])
    at = F.col("before") + F.col("row")
    return numbered.select(
        "doc_id", "segment", "start", "n_tokens", "bucket", "bucket_len", (F.col("first") + F.floor(at / F.col("room"))).cast("long").alias("batch"), F.pmod(at, F.col("room")).cast("int").alias("slot")
    )
