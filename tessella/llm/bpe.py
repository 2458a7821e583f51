"""Byte-level BPE with content-defined chunk reuse.

A rolling hash over the bytes cuts every text into chunks whose ends depend on the near bytes only, so
that texts with a common passage have common chunks. A chunk that occurs twice or more is encoded
once, by the first document that holds it; every other occurrence takes its tokens. Where chunks
meet, the text around the joint is encoded again, from one place where a word must begin to another,
and the window grows until both ends fall on token ends of what it replaces. The ids are those of
encoding the whole text.

Only chunk names, and the tokens of shared chunks, are shuffled besides one shuffle of the texts.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.scratch import Scratch

#: A chunk ends, on average, once in 2 ** BITS bytes, and never within LEAST bytes of the last end.
BITS, LEAST = 10, 256
#: Owners and names of shared chunks that are broadcast to a scan; beyond it that join shuffles.
BROADCAST_ROWS = 1_000_000
#: Fixed value: the word pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary in the tokenizers library's JSON form.

    Texts are encoded by the faster tiktoken where the file says the same to both libraries (each
    merge makes the next id, the pre-tokenizer is the plain byte-level one, all added tokens are
    plain), else by tokenizers.
    """

    _loaded: dict[str, Codec] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        added = {x["content"]: x for x in spec.get("added_tokens", [])}
        self.bytes = [b""] * (1 + max([*vocab.values(), *(x["id"] for x in added.values())]))
        for token, k in vocab.items():
            if token not in added:
                self.bytes[k] = bytes(letters[c] for c in token)
        for token, x in added.items():
            self.bytes[x["id"]] = token.encode()
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.digits = [str(k) for k in range(len(self.bytes))]
        self.kind = "<u2" if len(self.bytes) <= 1 << 16 else "<u4"
        if self._plain(spec, vocab, added):
            import tiktoken

            ranks = {self.bytes[k]: k for token, k in vocab.items() if token not in added}
            fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t: x["id"] for t, x in added.items()})
            self._encode = lambda text: fast.encode(text, allowed_special="all", disallowed_special=())
        else:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(path)
            slow.no_truncation()
            slow.no_padding()
            self._encode = lambda text: slow.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _plain(spec: dict, vocab: dict[str, int], added: dict[str, dict]) -> bool:
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        return (
            model.get("type") == "BPE"
            and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and spec.get("normalizer") is None
            and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) == ("ByteLevel", False, True)
            and not any(x[k] for x in added.values() for k in ("single_word", "lstrip", "rstrip", "normalized"))
            and len(_byte_letters().keys() & vocab.keys()) == 256
            and all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
            and len(merges) + 256 == len([t for t in vocab if t not in added])
        )

    @classmethod
    def load(cls, path: str) -> Codec:
        """One for each worker and file."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode(self, text: str) -> list[int]:
        return self._encode(text)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _gear() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_ends(text: bytes, bits: int = BITS, least: int = LEAST) -> list[int]:
    """Ends of the chunks of a text, the last one its length; on character ends only."""
    if len(text) <= least:
        return [len(text)] if text else []
    codes = np.frombuffer(text, np.uint8)
    rolled = _GEAR[codes]
    for step in (1, 2, 4, 8, 16):
        shifted = rolled[:-step] << np.uint32(step)
        rolled[step:] = rolled[step:] + shifted
    ends, last = [], 0
    for at in (np.nonzero(rolled >> np.uint32(32 - bits) == 0)[0] + 1).tolist():
        while at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
        if at - last >= least and at < len(text):
            ends.append(at)
            last = at
    return [*ends, len(text)]


_GEAR = _gear()


def _name(chunk: bytes) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(chunk)


def _chunks(text: str | None) -> Iterator[tuple[bytes, int, int]]:
    """(text in UTF-8, start, end) of each chunk."""
    raw, at = (text or "").encode(), 0
    for end in chunk_ends(raw):
        yield raw, at, end
        at = end


def _must_begin(raw: bytes, at: int) -> bool:
    """Whether a word begins at ``at`` whatever else the text holds: a space between a visible ASCII character and an ASCII letter."""
    return 0 < at < len(raw) - 1 and raw[at] == 32 and 32 < raw[at - 1] < 127 and (65 <= raw[at + 1] <= 90 or 97 <= raw[at + 1] <= 122)


def _cut(raw: bytes, at: int, step: int) -> int:
    """The next sure word begin from ``at`` on in one direction, or the text's end there."""
    while 0 < at < len(raw) and not _must_begin(raw, at):
        at += step
    return min(max(at, 0), len(raw))


def encode_with(codec: Codec, text: str | None, known: dict[bytes, np.ndarray]) -> list[int]:
    """Ids of a text, with the tokens of the chunks in ``known`` taken from there."""
    if not text:
        return []
    raw, segments = text.encode(), []  # (start, end, ids or None); neighbours without ids are one
    if known:
        for _, start, end in _chunks(text):
            ids = known.get(_name(raw[start:end]))
            if ids is None and segments and segments[-1][2] is None:
                segments[-1] = (segments[-1][0], end, None)
            else:
                segments.append((start, end, ids))
    if len(segments) < 2 and not (segments and segments[0][2] is not None):
        return codec.encode(text)
    segments = [(s, e, np.asarray(codec.encode(raw[s:e].decode()) if ids is None else ids)) for s, e, ids in segments]
    ends = [s + np.cumsum(codec.sizes[ids]) for s, _, ids in segments]
    # Token ends of every segment: a window may begin and end at these only, or at the text's ends.
    whole, begins = {0, len(raw)}, [s for s, _, _ in segments]

    def agrees(at: int) -> bool:
        if at in whole:
            return True
        k = bisect_right(begins, at) - 1
        if at == begins[k]:
            return True
        i = int(np.searchsorted(ends[k], at))
        return i < len(ends[k]) and int(ends[k][i]) == at

    windows: list[list[int]] = []
    for _, joint, _ in segments[:-1]:
        low, high = _cut(raw, joint, -1), _cut(raw, joint, 1)
        while not agrees(low):
            low = _cut(raw, low - 1, -1)
        while not agrees(high):
            high = _cut(raw, high + 1, 1)
        while windows and low <= windows[-1][1]:
            before = windows.pop()
            low, high = min(low, before[0]), max(high, before[1])
        windows.append([low, high])
    out: list[int] = []
    at = k = 0
    for low, high in [*windows, [len(raw), len(raw)]]:
        if low > at:  # no joint lies between: one segment holds it all
            while segments[k][1] < low:
                k += 1
            start, _, ids = segments[k]
            i = int(np.searchsorted(ends[k], at, "right")) if at > start else 0
            out += ids[i : int(np.searchsorted(ends[k], low)) + 1].tolist()
        if high > low:
            out += codec.encode(raw[low:high].decode())
        at = high
    return out


def _refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, names = [], []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            held = {_name(raw[s:e]): None for raw, s, e in _chunks(text.as_py())}
            ids += [k] * len(held)
            names += held
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.binary(16)).cast(pa.binary())], ["doc_id", "name"])


def _encode_owned(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path)
        for batch in batches:
            found: dict[bytes, bytes] = {}
            for text, owned in zip(batch.column("text"), batch.column("owned")):
                wanted = set(owned.as_py())
                for raw, s, e in _chunks(text.as_py()):
                    if (name := _name(raw[s:e])) in wanted and name not in found:
                        found[name] = np.array(codec.encode(raw[s:e].decode()), codec.kind).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["name", "ids"])

    return run


def _assemble(path: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path)
        for batch in batches:
            columns: list[list] = [[], [], []]
            for text, names, tokens in zip(batch.column("text"), batch.column("names"), batch.column("tokens")):
                known = {n: np.frombuffer(t, codec.kind) for n, t in zip(names.as_py() or (), tokens.as_py() or ())}
                ids = encode_with(codec, text.as_py(), known)
                columns[0].append(len(ids))
                if digests:
                    columns[1].append(sha256(",".join(map(codec.digits.__getitem__, ids)).encode()).hexdigest())
                    columns[2].append(sha256(codec.decode(ids).encode()).hexdigest())
                else:
                    columns[1].append(ids)
            made = [batch.column("doc_id"), pa.array(columns[0], pa.int64())]
            if digests:
                yield pa.RecordBatch.from_arrays([*made, pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([*made, pa.array(columns[1], pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    return run


def _with_shared(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, names and tokens of the shared chunks of each row."""
    scratch = Scratch(docs.sparkSession, "bpe")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    refs = scratch.table(docs.where("doc_id is not null").mapInArrow(_refs, "doc_id long, name binary"), "refs")
    shared = refs.groupBy("name").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n > 1")
    owners = scratch.table(shared.groupBy("doc_id").agg(F.collect_list("name").alias("owned")), "owners")
    owned = docs.join(F.broadcast(owners) if owners.count() <= BROADCAST_ROWS else owners, "doc_id")
    tokens = owned.select("text", "owned").mapInArrow(_encode_owned(path), "name binary, ids binary")
    tokens = scratch.table(tokens.groupBy("name").agg(F.first("ids").alias("ids")), "tokens")
    names = tokens.select("name")
    used = refs.join(F.broadcast(names) if names.count() <= BROADCAST_ROWS else names, "name", "left_semi")
    held = used.join(tokens, "name").groupBy("doc_id").agg(F.collect_list(F.struct("name", "ids")).alias("held")).select("doc_id", F.col("held.name").alias("names"), F.col("held.ids").alias("tokens"))
    return docs.join(held, "doc_id", "left")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) for every row: the tokenizers library's ids for the whole text, without added ones.

    ``path`` is a byte-level BPE file that every executor can open. Null texts count as empty and
    have no ids. Rows with a null id are encoded without reuse; repeated ids and rows are fine.
    Other columns are not read. An empty table gives an empty table.
    """
    return _with_shared(docs, path, id_col, text_col).mapInArrow(_assemble(path, False), "doc_id long, n_tokens long, ids array<int>")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with SHA-256 digests of the ids (decimal, joined by commas) and of the decoded ids instead of the ids."""
    return _with_shared(docs, path, id_col, text_col).mapInArrow(_assemble(path, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from lists of ids; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
