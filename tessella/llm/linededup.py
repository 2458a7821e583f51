"""Fuzzy line deduplication: MinHash signatures of character shingles, banding, exact Jaccard, components.

Lines are normalised (lower case, white space runs to one space) and named by the MD5 of that form, so
equal lines are one line from the start. A line's signature has ``bands * rows`` minima; two lines are
candidates when a band agrees. Buckets with one line are dropped by a min/max aggregation that is
partial on the map side, so a bucket with a third of the lines costs one row a task. Candidates are
verified by exact Jaccard inside blocks of bounded size; pairs already connected are skipped, which
loses no component. Buckets of several blocks that are not yet one component are then compared block
by block. Each component keeps its first line, by document id and position.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.components import connected_components
from tessella.llm.quality import restored, without
from tessella.llm.scratch import Scratch
from tessella.llm.workers import lean

#: Lines verified together; a larger bucket is split.
BLOCK = 512
#: Lines, on average, that one call of the verification gets.
CALL = 4096
#: Bytes of a join's smaller side, by its counted rows, that are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20
#: Lines of a component beyond which its row is broadcast to them: one in so many lines at most, so few rows.
HOT = 10_000
_CHARS_AT_ONCE = 1 << 17
#: Shingles up to which a line's are held as a set of Python's, for quick intersections; more are a sorted array.
_SET = 4096
_LONG, _KEYED = 24, 128  # bytes of a broadcast row: a long, a key with a place
_SIGNATURE = "doc_id long, pos int, key binary, sig array<long>"


def normal(line: str) -> str:
    """Lower case; runs of ASCII white space become one space, and go at the ends."""
    return b" ".join(line.lower().encode("utf-8", "surrogatepass").split()).decode("utf-8", "surrogatepass")


def shingles(line: str, width: int) -> set[str]:
    """Character shingles of a normalised line; a shorter line is its own only shingle."""
    return {line[i : i + width] for i in range(max(1, len(line) - width + 1))}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = np.random.default_rng(5).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _hashes(lines: list[str], w: int, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of many lines, one line after the other, and where each line's begin.

    Short lines are padded to one shingle, by what is no character; shingles that reach from one line
    into the next are cut out again.
    """
    padded = [x if len(x) >= w else x + "\0" * (w - len(x)) for x in lines]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    ends = np.cumsum(sizes)
    for k, line in enumerate(lines):
        if len(line) < w:
            codes[ends[k] - w + len(line) : ends[k]] = 0
    n = len(codes) - w + 1
    hashes = codes[:n] * base[0]
    for k in range(1, w):
        hashes += codes[k : k + n] * base[k]
    whole = np.ones(n, bool)
    for k in range(1, w):
        cut = ends[:-1] - k
        whole[cut[cut >= 0]] = False
    return _mix(hashes)[whole], np.concatenate(([0], np.cumsum(sizes - w + 1)[:-1]))


def _portions(lines: list[str], width: int) -> Iterator[list[str]]:
    """The lines in portions of bounded size."""
    at = 0
    while at < len(lines):
        end, chars = at, 0
        while end < len(lines) and (end == at or chars + len(lines[end]) < _CHARS_AT_ONCE):
            chars += len(lines[end]) + width
            end += 1
        yield lines[at:end]
        at = end


def _held(hashes: np.ndarray):
    return frozenset(hashes.tolist()) if len(hashes) <= _SET else np.unique(hashes)


def shingle_sets(lines: list[str], width: int) -> list:
    """The distinct shingle hashes of each line; see ``_shared``."""
    out = []
    for some in _portions(lines, width):
        hashes, starts = _hashes(some, width, _BASE)
        out += map(_held, np.split(hashes, starts[1:]))
    return out


def _shared(a, b) -> int:
    """How many hashes two lines share."""
    if isinstance(a, frozenset) and isinstance(b, frozenset):
        return len(a & b)
    a, b = (np.array(list(x), np.uint64) if isinstance(x, frozenset) else x for x in (a, b))
    return len(np.intersect1d(a, b, assume_unique=True))


class _Signer:
    """Band keys of many lines at once."""

    def __init__(self, width: int, bands: int, rows: int, seed: int = 7):
        random = np.random.default_rng(seed)
        self.width, self.bands, self.rows = width, bands, rows
        self.times = random.integers(1 << 16, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.plus = random.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.base = random.integers(1 << 62, 1 << 63, width, dtype=np.uint64) | np.uint64(1)

    def keys(self, lines: list[str]) -> np.ndarray:
        """One row of ``bands`` signed longs for each line (none empty)."""
        out = [self._keys(some) for some in _portions(lines, self.width)]
        return np.concatenate(out) if out else np.zeros((0, self.bands), np.int64)

    def _keys(self, lines: list[str]) -> np.ndarray:
        hashes, starts = _hashes(lines, self.width, self.base)
        hashes = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.empty((len(lines), self.bands * self.rows), np.uint32)
        work = np.empty_like(hashes)
        for k in range(self.bands * self.rows):
            np.multiply(hashes, self.times[k], out=work)
            np.add(work, self.plus[k], out=work)
            least[:, k] = np.minimum.reduceat(work, starts)
        keys = np.empty((len(lines), self.bands), np.uint64)
        for b in range(self.bands):
            key = np.full(len(lines), b + 1, np.uint64)
            for k in range(b * self.rows, (b + 1) * self.rows):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
            keys[:, b] = key
        return keys.view(np.int64)


def _split(batch: pa.RecordBatch) -> Iterator[tuple[int, int, str]]:
    """(row, line number, normalised line) of all lines with a word."""
    for row, text in enumerate(batch.column(1)):
        for pos, line in enumerate((text.as_py() or "").split("\n")):
            if line := normal(line):
                yield row, pos, line


def _key(line: str) -> bytes:
    return md5(line.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches: what is made of a text takes several times its size."""
    for batch in batches:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def _occurrences(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _Signer(width, bands, rows)
        for batch in _slices(batches):
            found, held, seen = [], [], {}
            for row, pos, line in _split(batch):
                key = _key(line)
                if new := key not in seen:
                    seen[key] = None
                    held.append(line)
                found.append((row, pos, key, new))
            keys = iter(signer.keys(held))
            ids = batch.column(0).to_pylist()
            sig = [next(keys) if new else None for *_, new in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[x[0]] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.binary()), pa.array(sig, pa.list_(pa.int64()))], ["doc_id", "pos", "key", "sig"]
            )

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each text at the positions asked for."""
    for batch in batches:
        lines = {}
        for text, wanted in zip(batch.column("text"), batch.column("wanted")):
            parts = (text.as_py() or "").split("\n")
            for pos in set(wanted.as_py()):
                if pos < len(parts) and (line := normal(parts[pos])):
                    lines.setdefault(_key(line), line)
        yield pa.RecordBatch.from_arrays([pa.array(list(lines), pa.binary()), pa.array(list(lines.values()), pa.string())], ["key", "line"])


def _forest(edges: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """Edges of a star for each component of ``edges``, around its smallest node."""
    up: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [(x, r) for x in up if (r := root(x)) != x]


def _verify(width: int, similarity: float, sets_of=shingle_sets):
    """Edges that join the lines of a call that are linked, directly or by others; ``known`` names what is joined already.

    A line is compared with a class, nearest size first, until one member is near enough: the rest of
    that class can add nothing. Lines of one ``side``, if not negative, have been compared elsewhere.
    """

    def joined(lines: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        lines.sort(key=lambda x: (len(x[1]), x[0]))
        groups: list[list[int]] = []  # classes so far, members by ascending size
        for i, (key, own, side, known) in enumerate(lines):
            least, mine, others = similarity * len(own), [], []
            for group in groups:
                for j in reversed(group):
                    other = lines[j]
                    if known == other[3]:
                        mine.append(group)
                        break
                    if len(other[1]) < least or (side == other[2] and side >= 0):
                        continue
                    shared = _shared(own, other[1])
                    if shared >= similarity * (len(own) + len(other[1]) - shared):
                        yield key, other[0]
                        mine.append(group)
                        break
                else:
                    others.append(group)
            groups = [*others, sorted([*(j for g in mine for j in g), i]) if len(mine) > 1 else [*mine[0], i] if mine else [i]]

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("group", "key", "line", "side", "known"))))
        lines = {key: line for _, key, line, _, _ in rows}
        sets = dict(zip(lines, sets_of(list(lines.values()), width)))
        by_group: dict[int, list] = {}
        for group, key, _, side, known in rows:
            by_group.setdefault(group, []).append((key, sets[key], side, known))
        edges = _forest([e for members in by_group.values() for e in joined(members)])
        return pa.table({"a": pa.array([e[0] for e in edges], pa.binary()), "b": pa.array([e[1] for e in edges], pa.binary())})

    return run


def _verified(rows: DataFrame, width: int, similarity: float, total: int, sets_of=shingle_sets, call: int = CALL) -> DataFrame:
    """Edges of all groups; many small groups share a call, those that share lines preferably (column ``near``)."""
    calls = -(-total // call)
    rows = rows.select("group", "key", "line", "side", "known", F.pmod(F.col("near"), F.lit(max(1, calls))).alias("call"))
    return rows.groupBy("call").applyInArrow(_verify(width, similarity, sets_of), "a binary, b binary")


def _small(table: DataFrame, each: int = _KEYED, rows: int | None = None) -> DataFrame:
    """A written table, to be broadcast if its counted rows of ``each`` bytes allow; else joins with it shuffle."""
    return F.broadcast(table) if (table.count() if rows is None else rows) * each <= BROADCAST_BYTES else table


def _numbers(table: DataFrame, column: str) -> int:
    """Numbers in a table of ids with arrays of numbers."""
    return table.agg(F.sum(F.size(column) + 2)).first()[0] or 0


def with_first(met: DataFrame, scratch: Scratch, component: str, value: str) -> DataFrame:
    """``met`` with ``kept``, the least ``value`` of each row's component; a component with most rows is not joined in one task."""
    first = scratch.table(met.groupBy(component).agg(F.min(value).alias("kept"), F.count("*").alias("n")), "firsts")
    if first.count() * _KEYED <= BROADCAST_BYTES:
        return met.join(F.broadcast(first.drop("n")), component)
    hot = F.broadcast(first.where(F.col("n") > HOT).drop("n"))  # at most one row for each HOT rows of met
    return met.join(hot, component).unionByName(met.join(hot.select(component), component, "left_anti").join(first.drop("n"), component))


def line_links(docs: DataFrame, occurrences: DataFrame, named: DataFrame, scratch: Scratch, width: int, similarity: float, block: int, read=_texts, lines_as: str = "key binary, line string", sets_of=shingle_sets, call: int = CALL) -> DataFrame:
    """(node, component) of all lines that resemble another; ``named`` has a place of each line, to read it from.

    ``read`` takes the lines (``lines_as``) from texts, ``sets_of`` their shingles: ``nearcopies`` links whole texts.
    """
    bands = occurrences.where("sig is not null").select(F.explode("sig").alias("bucket"), "key")
    mark = F.xxhash64("key")
    live = bands.groupBy("bucket").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low <> high").select("bucket")
    live = scratch.table(live, "live")
    members = scratch.table(bands.join(_small(live, _LONG), "bucket", "left_semi").distinct(), "members")
    scratch.drop("live")
    # Bands that agree on the same lines say the same: one bucket of each set of lines is enough.
    sets = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(mark.cast("decimal(20,0)")).alias("mark"), F.min("key").alias("low"), F.max("key").alias("high"))
    sets = sets.groupBy("n", "mark", "low", "high").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.xxhash64("low").alias("low"))
    members = scratch.table(members.join(sets, "bucket"), "sets")
    scratch.drop("members")
    wanted = scratch.table(members.select("key").distinct(), "wanted")
    places = named.join(_small(wanted), "key", "left_semi").groupBy("first.doc_id").agg(F.collect_list("first.pos").alias("wanted"))
    places = scratch.table(places, "places")
    texts = docs.join(_small(places, _LONG, _numbers(places, "wanted")), "doc_id").select("text", "wanted")
    lines = texts.mapInArrow(lean(read), lines_as).groupBy("key").agg(F.first("line").alias("line"))
    lines = scratch.table(lines, "lines")
    part = F.pmod(F.xxhash64("key", "bucket"), F.col("blocks")).cast("int")
    members = members.withColumn("part", part)
    whole = members.join(lines, "key").select("key", "line", F.xxhash64("bucket", "part").alias("group"), F.xxhash64("low", "part").alias("near"), F.lit(-1).alias("side"), F.col("key").alias("known"))
    edges = scratch.table(_verified(whole, width, similarity, members.count(), sets_of, call), "edges")
    large = members.where("blocks > 1")
    if not large.isEmpty():
        classes = scratch.table(connected_components(edges, scratch, "first"), "early")
        marked = scratch.table(large.join(classes, large.key == classes.node, "left").select("bucket", "key", "part", "blocks", F.coalesce("component", "key").alias("known")), "marked")
        open_ = marked.groupBy("bucket").agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low <> high").select("bucket")
        # Each pair of blocks is a task of its own: (i, part) for i < part, and (part, j) for j > part.
        pairs = marked.join(open_, "bucket").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("other <> part")
        pairs = scratch.table(pairs.select("key", "known", F.col("part").alias("side"), F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("group")), "pairs")
        more = _verified(pairs.join(lines, "key").withColumn("near", F.col("group")), width, similarity, pairs.count(), sets_of, call)
        edges = edges.unionByName(scratch.table(more, "more"))
    return connected_components(edges, scratch, "last")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 7, bands: int = 9, rows: int = 4, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(doc_id, gone): the line numbers, from 0, to remove from each document that has any.

    Lines are what "\\n" separates; lines without a word are none. Two lines are linked at a Jaccard
    coefficient of ``similarity`` or more of their ``width``-character shingles; of each component the
    line that comes first by (doc_id, line number) stays. Null texts have no lines. Rows with a null
    id take no part. Rows of one id count as one document. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    every = scratch.table(docs.mapInArrow(lean(_occurrences(width, bands, rows)), _SIGNATURE), "occurrences")
    named = scratch.table(every.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first")), "named")
    classes = scratch.table(line_links(docs, every, named, scratch, width, similarity, block), "classes")
    scratch.drop("sets", "wanted", "places", "lines", "edges", "marked", "pairs", "more")
    # Of a line that occurs once and resembles no other there is nothing to remove; the rest is looked up.
    met = named.join(classes, named.key == classes.node, "left").where("n > 1 or component is not null")
    met = scratch.table(met.select("key", "n", "first", F.coalesce("component", "key").alias("line")), "met")
    repeated = with_first(met, scratch, "line", "first").where("n > 1 or first <> kept").select("key", "kept")
    gone = every.select("doc_id", "pos", "key").join(_small(scratch.table(repeated, "repeated")), "key").where(F.struct("doc_id", "pos") != F.col("kept"))
    return scratch.table(gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("gone")), "gone")


def joined(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` (doc_id, ...) with the line numbers to remove, null for none; ``gone`` is broadcast if all its numbers are few enough."""
    return docs.join(_small(gone, _LONG, _numbers(gone, "gone")), "doc_id", "left")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_lines (lines with a word), n_removed and clean_text for every row of ``docs``; see ``repeats``.

    A null text stays null. A text that loses nothing is unchanged to the byte.
    """
    gone = repeats(docs, id_col, text_col, **how)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return joined(rows, gone).select(
        "doc_id",
        F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike("[^ \\t-\\r]"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        without(F.col("text"), F.col("gone")).alias("clean_text"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with its columns, each text without the lines that ``repeats`` names; an emptied document stays, with an empty text.

    Null texts stay null. Rows of one id lose the lines of the same numbers; rows with a null id are
    unchanged. An empty table gives an empty table.
    """
    gone = repeats(docs, id_col, text_col, **how)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.col("row").getField(text_col)
    return restored(joined(rows, gone), docs.columns, without(text, F.col("gone")), text_col)
