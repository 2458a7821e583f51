"""Document fingerprints: bottom-k sketches of word-shingle hashes, by DataFrame expressions alone.

A sketch is the ``k`` smallest distinct hashes of a text's shingles, ascending. Sketches of parts merge
into the sketch of the whole. Two sketches estimate resemblance (the share of common hashes among the
k smallest of the union), containment and the number of distinct shingles; a sketch of fewer than k
hashes holds them all, and its figures are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.quality import words
from tessella.llm.scratch import Scratch

K, WIDTH = 128, 5


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """Add column ``name``, the sketch of column ``text``: lower-cased words, shingles of ``width`` words.

    Fewer words: the whole sequence is the one shingle; none, or null: an empty sketch.
    """
    w = f"_{name}_w"
    df = df.withColumn(w, F.transform(words(F.lower(F.coalesce(F.col(text), F.lit("")))), lambda x: F.xxhash64(x)))
    n = F.size(w)
    zipped = F.arrays_zip(*[(F.slice(w, i + 1, n) if i else F.col(w)).alias(f"w{i}") for i in range(width)])
    shingles = F.transform(F.slice(zipped, 1, n - (width - 1)), lambda z: F.xxhash64(*[z[f"w{i}"] for i in range(width)]))
    none = F.array().cast("array<bigint>")
    hashes = F.when(n >= width, shingles).when(n > 0, F.array(F.xxhash64(w))).otherwise(none)
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop(w)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together; null if either is null."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, key: str, sketch: str = "sketch", k: int = K, fan: int = 64) -> DataFrame:
    """(key, sketch): one sketch for each key, merged in rounds of at most about ``fan`` sketches a task row, however many a key has.

    Null keys are a key of their own; null sketches add nothing; repeated sketches count once. Other
    columns are not read. An empty table gives an empty table.
    """
    now = df.select(key, F.col(sketch).alias("sketch"))
    while True:
        sizes = now.groupBy(key).agg(F.count("*").alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        part = F.pmod(F.xxhash64("sketch"), F.ceil(F.col("n") / fan)).cast("int") if most > fan else F.lit(0)
        met = now.alias("s").join(sizes.alias("z"), F.expr(f"s.`{key}` <=> z.`{key}`")).select(F.col(f"s.{key}").alias(key), "sketch", part.alias("part"))
        all_ = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_set("sketch")))), 1, k)
        now = Scratch(df.sparkSession, "sketches").table(met.groupBy(key, "part").agg(all_.alias("sketch")).select(key, "sketch"), "merged")
        if most <= fan:
            return now


def _smallest(a: Column, b: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard coefficient, 0 to 1; 1 for two empty sketches."""
    union = _smallest(a, b, k)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union))


def distinct(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash as a share of the range."""
    place = (F.get(a, k - 1).cast("double") + 2.0**63 + 1) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; 1 for an empty a."""
    union = distinct(_smallest(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct(a, k)))


def as_hex(sketch: Column) -> Column:
    """A sketch as text: 16 hex digits for each hash."""
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """(doc_id, sketch, n_distinct) for every row; null texts have an empty sketch. Null ids and repeated rows pass through."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_sketch(rows, "text", "sketch", k, width).select("doc_id", "sketch", distinct(F.col("sketch"), k).alias("n_distinct"))


def followers(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """``ids`` (id, mark, n; distinct) with next_id, next_mark and next_n of the following row by descending id and mark; the last is followed by the first.

    Rows are dealt by ranges; a row's follower is in its range, or heads the next one that has rows.
    Only the ranges' heads, one row a partition, meet in one task.
    """
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.struct("id", "mark", "n")
    ranged = scratch.table(ids.repartitionByRange(parts, F.desc("id"), F.desc("mark")).withColumn("part", F.spark_partition_id()), "ranged")
    heads = ranged.groupBy("part").agg(F.max(row).alias("head"))
    by_part = Window.orderBy("part")
    every = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("part", F.coalesce(F.lead("head").over(by_part), F.first("head").over(every)).alias("after"))
    inside = Window.partitionBy("part").orderBy(F.desc("id"), F.desc("mark"))
    after = F.coalesce(F.lead(row).over(inside), F.col("after"))
    return ranged.join(F.broadcast(heads), "part").select("id", "mark", "n", after.alias("after")).select("id", "mark", "n", F.col("after.id").alias("next_id"), F.col("after.mark").alias("next_mark"), F.col("after.n").alias("next_n"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Every text beside its edited form: doc_id, n_chars, edited_text, sketch, edited_sketch, next_sketch; a row for each row of ``docs``.

    In the edited text the last floor(n_chars / 2) code points are replaced by the first as many, or
    all, of the next document by descending id; the first document follows the last. Null texts
    count as empty. Rows with a null id come last. Rows equal in id and text are one document, whose
    result stands once for each of them; rows of one id and different texts follow each other by a
    hash of the text. Other columns are not read. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "sketch")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    single = rows.select("id", "mark", F.length("text").alias("n")).groupBy("id", "mark", "n").agg(F.count("*").alias("copies"))
    single = scratch.table(single, "ids")
    order = scratch.table(followers(single.select("id", "mark", "n"), scratch), "order")
    scratch.drop("ranged")
    # Each row with the one it follows: a row hands the head of its text to that one.
    before = order.select(F.col("next_id").alias("own_id"), F.col("next_mark").alias("own_mark"), F.col("id").alias("to_id"), F.col("mark").alias("to_mark"), F.floor(F.col("n") / 2).alias("take"))
    held = rows.join(before, F.expr("id <=> own_id and mark = own_mark")).drop("own_id", "own_mark")
    again = scratch.table(single.where("copies > 1").select(F.col("id").alias("again_id"), F.col("mark").alias("again_mark"), "copies"), "again")
    repeated = not again.isEmpty()
    if repeated:
        held = held.groupBy("id", "mark").agg(*(F.first(c).alias(c) for c in ("text", "to_id", "to_mark", "take")))
    # A sketch is made where the text is: carried with the text through the next join, it would add half its size to that shuffle.
    heads = with_sketch(held, "text", "next_sketch", k, width).select("to_id", "to_mark", F.expr("substring(text, 1, cast(take as int))").alias("head"), "next_sketch")
    met = held.select("id", "mark", "text").join(heads, F.expr("id <=> to_id and mark = to_mark")).drop("to_id", "to_mark")
    met = met.withColumn("n_chars", F.length("text").cast("long"))
    met = met.withColumn("edited_text", F.expr("concat(substring(text, 1, cast(n_chars - floor(n_chars / 2) as int)), head)"))
    met = with_sketch(with_sketch(met, "text", "sketch", k, width), "edited_text", "edited_sketch", k, width)
    out = ["n_chars", "edited_text", "sketch", "edited_sketch", "next_sketch"]
    if repeated:
        copies = F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int")))
        met = met.join(again, F.expr("id <=> again_id and mark = again_mark"), "left").select("id", *out, copies.alias("copy"))
    return met.select(F.col("id").alias("doc_id"), *out)
