"""Quality rules: per-document counts, and lines that too many documents of one host share.

Lines are normalised (A-Z lower-cased, white space runs to one space, ends trimmed) and hashed. A line
is common on a host when more than ``max(min_docs, share * distinct texts of the host)`` distinct
texts of that host hold it, or more than ``most_docs`` if that is less and given; copies of a text
count once, so a copied text does not condemn its own lines. Common lines are removed; a document that
keeps less than ``keep`` of its words is depleted.

All of it is DataFrame expressions. Counts are gathered by (host, line), so that a host with a third
of the rows is spread over all tasks. Common lines are (host, line) rows; joined with the lines of
the distinct texts they become the line numbers that each text loses and the words on them, so that
the scan of the texts themselves looks at no line again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.scratch import Scratch

#: ASCII white space, the separators of words.
SPACE = " \t\n\x0b\x0c\r"
SPACES = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
#: Rows of a join's smaller side that are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.array_remove(F.split(text, SPACES), "")


def _bare(text: Column) -> Column:
    return F.translate(text, SPACE, "")


def lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: _bare(x) != "")


def _normal(line: Column) -> Column:
    return F.translate(F.trim(F.regexp_replace(line, SPACES, " ")), _UPPER, _LOWER)


def line_key(line: Column) -> Column:
    """Hash of a normalised line."""
    return F.xxhash64(_normal(line))


def _line(line: Column, pos: Column) -> Column:
    """(line, pos, n): hash, line number and words of a line, null for one without a word; each line is normalised once."""

    def of(normal: Column) -> Column:
        n = F.length(normal) - F.length(F.translate(normal, " ", "")) + 1
        return F.when(normal != "", F.struct(F.xxhash64(normal).alias("line"), pos.alias("pos"), n.alias("n")))

    return F.get(F.transform(F.array(_normal(line)), of), 0)


def repeated_windows(df: DataFrame, width: int = 3) -> DataFrame:
    """Add n_repeat_words, from column ``words``: the words that stand in a window of ``width`` words found twice or more.

    Windows are hashed, sorted with their positions, and those equal to a neighbour are repeats; their
    positions, sorted again, cover ``min(width, distance to the next)`` words each. Texts without a
    repeat, most of them, stop at a count of distinct hashes.
    """
    hashed = df.withColumn("_w", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("_w")
    zipped = F.arrays_zip(*[(F.slice("_w", k + 1, n) if k else F.col("_w")).alias(f"w{k}") for k in range(width)])
    windows = F.when(n >= width, F.transform(F.slice(zipped, 1, n - (width - 1)), lambda z: F.xxhash64(*[z[f"w{k}"] for k in range(width)]))).otherwise(F.array().cast("array<bigint>"))
    hashed = hashed.withColumn("_h", windows)
    ranked = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    hashed = hashed.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), ranked))
    size = F.size("_s")
    beside = F.arrays_zip(F.col("_s").alias("at"), F.slice("_s", 2, size).alias("after"), F.concat(F.slice("_s", 1, 1), F.slice("_s", 1, size - 1)).alias("before"))
    repeats = F.filter(beside, lambda z, k: (z["at"]["x"] == z["after"]["x"]) | ((k > 0) & (z["at"]["x"] == z["before"]["x"])))
    hashed = hashed.withColumn("_p", F.when(size > 0, F.sort_array(F.transform(repeats, lambda z: z["at"]["i"]))))
    overlap = F.zip_with(F.slice("_p", 2, F.size("_p")), F.slice("_p", 1, F.size("_p") - 1), lambda b, a: F.greatest(F.lit(0), a + width - b))
    covered = F.size("_p") * width - F.aggregate(overlap, F.lit(0), lambda s, x: s + x)
    return hashed.withColumn("n_repeat_words", F.when(F.size("_p") > 0, covered).otherwise(0).cast("long")).drop("_w", "_h", "_s", "_p")


def texts_once(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(host, key, held): the distinct texts of each host, with (line, pos, n) of their lines that hold a word."""
    texts = docs.select(F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    held = F.filter(F.transform(F.split("text", "\n"), _line), lambda x: x.isNotNull())
    return texts.select("host", F.xxhash64("text").alias("key"), held.alias("held")).groupBy("host", "key").agg(F.first("held").alias("held"))


def common_lines(once: DataFrame, min_docs: int = 20, share: float = 0.1, most_docs: int | None = None) -> DataFrame:
    """(host, line): the hash of each common line of each host; ``once`` is of ``texts_once``."""
    limit = F.greatest(F.lit(float(min_docs)), F.col("n_texts") * share)
    limit = limit if most_docs is None else F.least(F.lit(float(most_docs)), limit)
    hosts = once.groupBy("host").agg(F.count("*").alias("n_texts"))
    least = min_docs if most_docs is None else min(min_docs, most_docs)
    found = once.select("host", F.explode(F.array_distinct("held.line")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > least)
    return found.alias("f").join(_small(hosts).alias("h"), F.expr("f.host <=> h.host")).where(F.col("n") > limit).select("f.host", "line")


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def common_in_texts(docs: DataFrame, text_col: str, host_col: str, min_docs: int, share: float, most_docs: int | None, scratch: Scratch) -> DataFrame:
    """(host, key, gone, n_gone): the numbers of the common lines of each distinct text that holds any, and the words on them."""
    once = scratch.table(texts_once(docs, text_col, host_col), "once")
    common = scratch.table(common_lines(once, min_docs, share, most_docs), "common")
    met = once.select("host", "key", F.explode("held").alias("at")).alias("t").join(_small(common).alias("c"), F.expr("t.host <=> c.host and t.at.line = c.line"))
    found = met.groupBy("t.host", "t.key").agg(F.collect_list("t.at.pos").alias("gone"), F.sum("t.at.n").alias("n_gone"))
    found = scratch.table(found, "found")
    scratch.drop("once", "common")
    return found


def without(text: Column, gone: Column) -> Column:
    """``text`` without the lines that ``gone`` numbers; null ``gone`` removes none. Linear in both."""

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    # The outer array binds the lines once; named twice, they would be split again for each of them.
    return F.when(gone.isNull(), text).otherwise(F.get(F.transform(F.array(F.split(text, "\n")), rest), 0))


def assess(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 20, share: float = 0.1, keep: float = 0.5, min_words: int = 50, repeat_percent: int = 50, with_text: bool = False, carry: bool = False, most_docs: int | None = None
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, counts, base_failed, n_left (words outside common lines), kept.

    ``with_text`` adds clean_text, the text without its common lines; ``carry`` adds row, a struct of the
    columns of ``docs``. Null texts have no words; null
    ids are passed on; rows with a null host are a host of their own; repeated rows give repeated
    results and count once. A text without words has failed. Other columns are not read. An empty
    table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    common = common_in_texts(docs, text_col, host_col, min_docs, share, most_docs, scratch)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("text"), *row)
    rows = rows.select("*", words(F.col("text")).alias("words"), lines(F.col("text")).alias("lines"))
    rows = repeated_windows(rows)
    rows = rows.select(
        "doc_id", "host", F.xxhash64("text").alias("key"), *(["text"] if with_text else []), *(["row"] if carry else []), "n_repeat_words",
        F.size("words").cast("long").alias("n_words"),
        F.length(_bare(F.col("text"))).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    met = rows.alias("r").join(_small(common).alias("c"), F.expr("r.host <=> c.host and r.key = c.key"), "left").drop(F.col("c.host"), F.col("c.key"))
    left = F.col("n_words") - F.coalesce("n_gone", F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    met = met.withColumn("n_left", left.cast("long")).withColumn("base_failed", failed)
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left"]
    kept = ~F.col("base_failed") & (F.col("n_left") >= F.col("n_words") * keep)
    if with_text:
        met = met.withColumn("clean_text", without(F.col("text"), F.col("gone")))
        out.append("clean_text")
    if carry:
        out.append("row")
    return met.select(*out, kept.alias("kept"))


def restored(rows: DataFrame, columns: list[str], text: Column, text_col: str = "text", length_col: str = "n_chars", size: Column | None = None) -> DataFrame:
    """The columns that ``row`` carries, with a new text, and its length (``size``) where there is a column for it."""
    size = F.length(text).cast("long") if size is None else size

    def value(c: str) -> Column:
        if c == text_col:
            return text
        held = F.col("row").getField(c)
        return size if c == length_col else held

    return rows.select(*(value(c).alias(c) for c in columns))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns, their texts without common lines; see ``assess``.

    Null texts, having no words, go; null ids and hosts, repeats and clashing names stay as they are.
    An empty table gives an empty table.
    """
    found = assess(docs, id_col, text_col, host_col, with_text=True, carry=True, **how)
    # Not a filter: pushed down, its expressions would be computed a second time for every row.
    kept = found.select(F.explode(F.when(F.col("kept"), F.array(F.struct("row", F.col("clean_text").alias("text"), F.length("clean_text").cast("long").alias("n"))))).alias("k")).select("k.row", "k.text", "k.n")
    return restored(kept, docs.columns, F.col("text"), text_col, size=F.col("n"))
