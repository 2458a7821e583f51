"""Near copies of whole texts: MinHash signatures of word shingles, banding, exact Jaccard, components.

SimHash distances grow quickly with the number of edits: texts that share four fifths of their
five-word shingles differ in up to 14 of 64 bits, where a comparison by tiles skips nothing. Texts are
therefore treated as ``linededup`` treats lines, with words for characters: candidates share a band,
are verified by exact Jaccard inside blocks of bounded size, and each component keeps its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.linededup import _BASE, _LONG, _held, _mix, _slices, _small, line_links, with_first
from tessella.llm.scratch import Scratch
from tessella.llm.workers import lean

#: Texts verified together, and texts, on average, that one call of the verification gets.
BLOCK, CALL = 128, 512
_HASHES_AT_ONCE = 1 << 14


def normal(text: str | None) -> bytes:
    """Lower case (A-Z); runs of ASCII white space become one space, and go at the ends."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles of a normalised text, ascending; a shorter text is its own only shingle."""
    from xxhash import xxh64_intdigest

    codes = np.array([xxh64_intdigest(w) for w in text.split()], np.uint64)
    w = min(width, len(codes))
    n = len(codes) - w + 1
    hashes = codes[:n] * _BASE[0]
    for k in range(1, w):
        hashes += codes[k : k + n] * _BASE[k]
    return np.unique(_mix(hashes))


def shingle_sets(texts: list[bytes], width: int) -> list:
    """The distinct shingle hashes of each text."""
    return [_held(shingle_hashes(t, width)) for t in texts]


class _Signer:
    """Band keys of one text after the other."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        random = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.times = random.integers(1 << 16, 1 << 32, (bands * rows, 1), dtype=np.uint32) | np.uint32(1)
        self.plus = random.integers(0, 1 << 32, (bands * rows, 1), dtype=np.uint32)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """``bands`` signed longs."""
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(short), _HASHES_AT_ONCE):
            np.minimum(least, (short[at : at + _HASHES_AT_ONCE] * self.times + self.plus).min(axis=1), out=least)
        least, keys = least.reshape(self.bands, self.rows), np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(self.rows):
            keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
        return keys.view(np.int64)


def _key(text: bytes) -> bytes:
    return md5(text, usedforsecurity=False).digest()


def _signatures(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _Signer(bands, rows)
        for batch in _slices(batches):
            ids, keys, sigs = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if text := normal(t.as_py()):
                    ids.append(i)
                    keys.append(_key(text))
                    sigs.append(signer.keys(shingle_hashes(text, width)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "key", "sig"])

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole texts asked for, normalised."""
    for batch in _slices(batches):
        texts = {_key(text): text for t in batch.column("text") if (text := normal(t.as_py()))}
        yield pa.RecordBatch.from_arrays([pa.array(list(texts), pa.binary()), pa.array(list(texts.values()), pa.binary())], ["key", "line"])


def gone(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, bands: int = 16, rows: int = 4, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(gone_id): the ids whose text is linked to that of a smaller id, directly or by others.

    Two texts are linked at a Jaccard coefficient of ``similarity`` or more of their ``width``-word
    shingles. A pair at 0.8 meets in a band with probability 0.9998. Texts without a word and rows with
    a null id take no part. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "nearcopies")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("doc_id is not null")
    every = scratch.table(docs.mapInArrow(lean(_signatures(width, bands, rows)), "doc_id long, key binary, sig array<long>"), "every")
    named = scratch.table(every.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", F.lit(0).alias("pos"))).alias("first")), "named")
    links = line_links(docs, every, named, scratch, width, similarity, block, _texts, "key binary, line binary", shingle_sets, CALL)
    classes = scratch.table(links, "classes")
    scratch.drop("sets", "wanted", "places", "lines", "edges", "marked", "pairs", "more")
    met = named.join(classes, named.key == classes.node, "left").where("n > 1 or component is not null")
    met = scratch.table(met.select("key", "first.doc_id", F.coalesce("component", "key").alias("component")), "met")
    named_ids = scratch.table(with_first(met, scratch, "component", "doc_id").select("key", "kept"), "kept")
    found = every.select("doc_id", "key").join(_small(named_ids), "key").where("doc_id <> kept")
    return scratch.table(found.select(F.col("doc_id").alias("gone_id")).distinct(), "gone")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, unchanged, whose ids ``gone`` does not name; rows with a null id stay, repeats of a row stay."""
    ids = gone(docs, id_col, text_col, **how)
    return docs.join(_small(ids, _LONG), docs[id_col].cast("long") == ids["gone_id"], "left_anti")
