"""The registered queries of the training-text operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, licenses, linededup, lm, packing, quality, scratch, sharding, simhash, sketch, toxicity

#: Where the vocabulary files of public tokenizers stand; never part of the repository.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: SimHash bit votes, alignments, lattices and tokenizers have no SQL form: brute-force versions in tests/llm check those.
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(_documents(spark, sf_dir), width=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the common-line rules for every document; a document's source is its host.

    The pipeline's limits: a line in more than ten texts of a host is common, on a small host in more than a tenth of them, three at least.
    """
    found = quality.assess(_documents(spark, sf_dir), min_docs=3, share=0.1, most_docs=10)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left")


ORACLES["op10_quality"] = r"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
  placed AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM docs WHERE len(words) > 2),
  windows AS (SELECT doc_id, i, words[i] || chr(32) || words[i + 1] || chr(32) || words[i + 2] AS w FROM placed),
  twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
  repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) AS r(k) GROUP BY doc_id),
  line AS (SELECT doc_id, source, text, raw, regexp_extract_all(raw, '[^\x20\x09-\x0D]+') AS parts FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw FROM docs)),
  keyed AS (SELECT doc_id, source, text, raw, len(parts) AS n, translate(array_to_string(parts, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line WHERE len(parts) > 0),
  dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM keyed GROUP BY doc_id),
  hosts AS (SELECT source, count(DISTINCT text) AS n_texts FROM docs GROUP BY source),
  common AS (SELECT k.source, k.key FROM keyed k JOIN hosts h ON k.source IS NOT DISTINCT FROM h.source GROUP BY k.source, k.key, h.n_texts HAVING count(DISTINCT k.text) > least(10, greatest(3, 0.1 * h.n_texts))),
  gone AS (SELECT k.doc_id, sum(k.n) AS n FROM keyed k JOIN common c ON k.source IS NOT DISTINCT FROM c.source AND k.key = c.key GROUP BY k.doc_id),
  base AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(words) - coalesce(gone.n, 0) AS BIGINT) AS n_left
    FROM docs d LEFT JOIN dup USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_left >= 0.5 * n_words AS kept FROM base
"""


@_query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of all documents, a token being a word."""
    return packing.pack(_documents(spark, sf_dir), packing.word_count(F.col("text")))


def _packing_sql(window: int = 2048, buckets: int = 8, budget: int = 16384) -> str:
    """One table of best boundaries for each number of buckets; ties take the smaller previous boundary."""
    steps = ["d1 AS (SELECT j, l * r - t AS cost, [l] AS ends FROM h)"]
    steps += [
        f"d{k} AS (SELECT h.j, min(d.cost + h.l * (h.r - i.r) - (h.t - i.t)) AS cost, list_append(arg_min(d.ends, CAST(d.cost + h.l * (h.r - i.r) - (h.t - i.t) AS HUGEINT) * 1000000 + i.j), any_value(h.l)) AS ends"
        f" FROM d{k - 1} d JOIN h i ON i.j = d.j JOIN h ON h.j > d.j GROUP BY h.j)"
        for k in range(2, buckets + 1)
    ]
    last = " UNION ALL ".join(f"SELECT {k} AS k, ends FROM d{k} WHERE j = (SELECT max(j) FROM h)" for k in range(1, buckets + 1))
    return f"""
WITH whole AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
  cut AS (SELECT doc_id, n, unnest(range(greatest(1, CAST(ceil(n / {window}.0) AS BIGINT)))) AS segment FROM whole),
  segments AS (SELECT doc_id, segment, segment * {window} AS start, least({window}, n - segment * {window}) AS n_tokens FROM cut),
  h AS (SELECT row_number() OVER (ORDER BY n_tokens) AS j, n_tokens AS l, CAST(sum(count(*)) OVER (ORDER BY n_tokens) AS BIGINT) AS r, CAST(sum(n_tokens * count(*)) OVER (ORDER BY n_tokens) AS BIGINT) AS t FROM segments GROUP BY n_tokens),
  {", ".join(steps)},
  best AS (SELECT ends FROM ({last}) ORDER BY k DESC LIMIT 1),
  bucket AS (SELECT CAST(k - 1 AS INT) AS bucket, ends[k] AS bucket_len, CASE WHEN k > 1 THEN ends[k - 1] ELSE -1 END AS low, greatest(1, {budget} // greatest(1, ends[k])) AS room FROM best, range(1, 1 + (SELECT len(ends) FROM best)) AS r(k)),
  numbered AS (SELECT s.*, b.bucket, b.bucket_len, b.room, row_number() OVER (PARTITION BY b.bucket ORDER BY doc_id, segment) - 1 AS pos FROM segments s JOIN bucket b ON s.n_tokens > b.low AND s.n_tokens <= b.bucket_len),
  many AS (SELECT bucket, max(pos // room) + 1 AS batches FROM numbered GROUP BY bucket),
  before AS (SELECT bucket, coalesce(sum(batches) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM many)
SELECT doc_id, CAST(segment AS INT) AS segment, CAST(start AS BIGINT) AS start, CAST(n_tokens AS BIGINT) AS n_tokens, bucket, CAST(bucket_len AS BIGINT) AS bucket_len,
  CAST(first + pos // room AS BIGINT) AS batch, CAST(pos % room AS INT) AS slot FROM numbered JOIN before USING (bucket)
"""


ORACLES["op2_packing"] = _packing_sql()


@_query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines and a digest of the remaining text for every document."""
    found = linededup.dedup_lines(_documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("clean_text", 256).alias("clean_sha256"))


def _tokenizer(name: str) -> str:
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return os.path.join(TOKENIZERS, name)
    return public_tokenizers.path(name)


@_query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count, and digests of the ids and of the decoded ids, of every document."""
    return bpe.digests(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def _remainder(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@_query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of three quarters of the ids."""
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(_remainder(4) != 2))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of every document under the subword lattice, learned from four fifths of the ids."""
    found = lm.score(_documents(spark, sf_dir), _remainder(5) != 1, lm.Pieces.read(_tokenizer("piece_bpe_32k.model")), kind=F.col("lang"))
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score")


@_query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    found = sketch.edited(_documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), sketch.as_hex(F.col("sketch")).alias("fingerprint"), sketch.as_hex(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketch.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), sketch.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


@_query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place in the documents where a license notice is covered to four fifths or more."""
    return licenses.scan(_documents(spark, sf_dir), coverage=0.8)


ARRIVALS = 8


@_query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through a shard store: eight arrivals by ranges of the id, compaction after each, read from the last manifest."""
    docs = _documents(spark, sf_dir)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // ARRIVALS))
    arrival = F.coalesce(F.floor((F.col("doc_id") - (low or 0)) / width), F.lit(0)).cast("int")
    store = sharding.ShardStore(spark, scratch.Scratch(spark, "shards").path, target=64 << 20)
    for k in range(ARRIVALS):
        # Bounds of the id itself, so that row groups outside them are not read.
        inside = (F.col("doc_id") >= (low or 0) + k * width) & (F.col("doc_id") < (low or 0) + (k + 1) * width)
        store.append(docs.where(inside | F.col("doc_id").isNull() if k == 0 else inside))
        store.compact(keep=1)
    return store.read().select("doc_id", arrival.alias("arrival"), "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


ORACLES["op4_sharding"] = f"""
WITH ends AS (SELECT min(doc_id) AS low, greatest(1, CAST(ceil((max(doc_id) - min(doc_id) + 1) / {ARRIVALS}.0) AS BIGINT)) AS width FROM documents)
SELECT doc_id, CAST(coalesce((doc_id - low) // width, 0) AS INT) AS arrival, lang, source, n_chars, md5(text) AS text_md5 FROM documents, ends
"""
