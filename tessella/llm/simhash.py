"""SimHash near-duplicates: exact comparison of all fingerprints within a Hamming radius.

A fingerprint's tile is the vector of population counts of its four 16-bit quarters. Two fingerprints
that differ in r bits have tiles at most r apart (sum of absolute differences), so all other tile
pairs are skipped without losing a link. There are at most 17^4 = 83,521 tiles: the table of their
sizes has a proven bound and may be broadcast. A tile with many fingerprints is split into blocks,
and each task compares one block with one block of each neighbouring tile by numpy exclusive-or and
bit counts. Copies share a fingerprint and are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.components import connected_components
from tessella.llm.scratch import Scratch
from tessella.llm.workers import lean

SEED = 42
QUARTERS = 4
#: Ids that are broadcast; beyond it the join shuffles.
BROADCAST_IDS = 4_000_000
#: Fingerprints in a block: one task holds one block, and one block of each of at most 21 tiles. What is shuffled
#: for a number of comparisons falls with the block: two blocks, 512 KB, for 268 million of them.
BLOCK = 1 << 14
#: Characters of a text that are split into words at once.
PIECE = 1 << 22
_PAIRS_AT_ONCE = 1 << 20


def _word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words between ASCII white space, in lists of bounded size."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end].split()
        at = end


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the lower-cased (A-Z) word shingles, repeats included; no word: 0."""
    from xxhash import xxh64_intdigest

    ones, total, tail = np.zeros(64, np.int64), 0, []
    for piece in _word_pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        words = tail + piece
        if len(words) >= width:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            hashes = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64)
            for at in range(0, len(hashes), 1 << 16):
                part = hashes[at : at + (1 << 16)]
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
        tail = words[-(width - 1) :] if width > 1 else []
    if not total:
        return xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long. Null text: no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


def _tile(fp: F.Column) -> F.Column:
    tile = F.lit(0)
    for k in range(QUARTERS):
        tile = tile * 17 + F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long")))
    return tile.cast("int")


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Tile offsets within the radius, one of each pair of opposite ones: zero, and those whose first non-zero part is positive."""
    near = [d for d in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, d)) <= radius]
    return [d for d in near if next((x for x in d if x), 1) > 0]


def _forest(u: np.ndarray, v: np.ndarray, label: np.ndarray) -> None:
    """Join the classes of u[i] and v[i] in ``label``, where a class is named by its smallest member."""
    while len(u):
        a, b = label[u], label[v]
        differ = a != b
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def linked(own: np.ndarray, others: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with own[i] and others[j] at most ``radius`` bits apart, a bounded tile at a time."""
    wide = min(len(others), 1 << 13)
    tall = max(1, _PAIRS_AT_ONCE // max(1, wide))
    for j in range(0, len(others), max(1, wide)):
        part = others[None, j : j + wide]
        for i in range(0, len(own), tall):
            near_i, near_j = np.nonzero(np.bitwise_count(own[i : i + tall, None] ^ part) <= radius)
            if len(near_i):
                yield near_i + i, near_j + j


def _compare(radius: int):
    def run(table: pa.Table) -> pa.Table:
        own = np.array(table.column("own_side").to_pylist(), bool)

        def flat(name: str, side: np.ndarray) -> np.ndarray:
            parts = [x.values.to_numpy() for x, s in zip(table.column(name), side) if s]
            return np.concatenate(parts) if parts else np.zeros(0, np.int64)

        prints, more = flat("fps", own).view(np.uint64), flat("fps", ~own).view(np.uint64)
        nodes = np.concatenate([flat("reps", own), flat("reps", ~own)])
        label = np.arange(len(nodes))
        for i, j in linked(prints, more, radius):
            _forest(i, j + len(prints), label)
        # A block met with itself stands on both sides: the same node twice, joined by distance zero.
        moved = np.nonzero(nodes[label] != nodes)[0]
        return pa.table({"a": nodes[moved], "b": nodes[label[moved]]})

    return run


def links(prints: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that join all rows of ``prints`` (fp, rep; fp distinct) within the radius.

    A spanning forest for each pair of blocks: as many edges as fingerprints at most, however large
    a group of near copies is, and the same components as all links.
    """
    rows = prints.where("rep is not null").withColumn("tile", _tile(F.col("fp")))
    sizes = rows.groupBy("tile").agg(F.ceil(F.count("*") / block).cast("int").alias("n_blocks"))
    blocks = (
        rows.join(F.broadcast(sizes), "tile")
        .groupBy("tile", F.pmod(F.xxhash64("fp"), F.col("n_blocks")).cast("int").alias("block"))
        .agg(F.collect_list(F.struct("fp", "rep")).alias("members"))
        .select("tile", "block", F.col("members.fp").alias("fps"), F.col("members.rep").alias("reps"))
    )
    digits = [F.pmod(F.floor(F.col("tile") / 17**k), F.lit(17)) for k in range(QUARTERS)]
    steps = []
    for d in _offsets(radius):
        inside = F.lit(True)
        for k, x in enumerate(d):
            if x:
                inside &= (digits[k] + x).between(0, 16)
        steps.append(F.when(inside, F.col("tile") + sum(x * 17**k for k, x in enumerate(d))))
    other = sizes.select(F.col("tile").alias("other"), F.col("n_blocks").alias("other_blocks"))
    pairs = sizes.select(F.col("tile").alias("own"), F.col("n_blocks").alias("own_blocks"), F.explode(F.array(*steps)).alias("other")).join(F.broadcast(other), "other")
    reach = pairs.groupBy("own").agg(F.max("other_blocks").alias("most"))
    sides = ["own", "i", "j", "own_side", "fps", "reps"]
    here = blocks.join(F.broadcast(reach), blocks.tile == reach.own).select("own", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("most") - 1)).alias("j"), F.lit(True).alias("own_side"), "fps", "reps")
    there = blocks.join(F.broadcast(pairs), blocks.tile == pairs.other).select("own", "other", F.explode(F.sequence(F.lit(0), F.col("own_blocks") - 1)).alias("i"), F.col("block").alias("j"), F.lit(False).alias("own_side"), "fps", "reps")
    there = there.where("own <> other or i <= j")
    return here.select(sides).unionByName(there.select(sides)).groupBy("own", "i", "j").applyInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id that links of at most ``radius`` differing bits reach, the
    row itself included. Null or empty texts, and texts of white space, have fingerprint 0 and are
    linked like any other. Fewer than ``width`` words: the whole sequence is the one shingle.
    Repeated rows give repeated results. Rows with a null id are fingerprinted; they take the
    component of the rows that share their fingerprint, null where there is none. Other columns of
    ``docs`` are not read. An empty table gives an empty table.
    """
    return _classed(docs, id_col, text_col, width, radius, block, Scratch(docs.sparkSession, "simhash"))


def _classed(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int, block: int, scratch: Scratch) -> DataFrame:
    every = scratch.table(fingerprints(docs, id_col, text_col, width), "prints")
    prints = scratch.table(every.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    classes = connected_components(links(prints, radius, block), scratch)
    named = prints.join(classes, prints.rep == classes.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    named = scratch.table(named, "named")
    scratch.drop("distinct")
    return every.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, unchanged, that stand for their component: those of its smallest id.

    Of rows of one id that would both stay, one does. Rows with a null id cannot be named and stay.
    """
    scratch = Scratch(docs.sparkSession, "representatives")
    found = scratch.table(_classed(docs, id_col, text_col, width, radius, block, scratch).where("doc_id is not null"), "found")
    gone = scratch.table(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    again = scratch.table(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    row = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = row.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti")
    if not again.isEmpty():
        once = kept.join(again, "doc_id").groupBy("doc_id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.join(again, "doc_id", "left_anti").unionByName(once)
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
