from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F

from tessella.llm import linededup, packing, quality, simhash, toxicity


def test_stages_are_the_asked_ones():
    assert [f.__module__ for _, f in P.STAGES] == ["corpus_pipeline"] * 5
    assert [n for n, _ in P.STAGES] == ["quality rules", "toxicity", "line dedup", "near dedup", "packing"]


def test_run_is_the_stages_in_turn(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, last, seen = docs.columns, docs, docs.count()
    for _, stage in P.STAGES[:-1]:
        last = spark.createDataFrame(stage(spark, last, data).toPandas(), docs.schema)
        assert last.columns == columns and last.count() <= seen
        seen = last.count()
    want = Counter(map(tuple, P.pack(spark, last, data).collect()))
    assert Counter(map(tuple, P.run(spark, data).collect())) == want


def test_each_stage_takes_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    good = P.quality_rules(spark, docs, data)
    kept = {r.doc_id for r in quality.assess(docs).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = toxicity.fit(good, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    civil = {r.doc_id for r in toxicity.score(good, model).where("score < 0.3").collect()}
    assert {r.doc_id for r in P.civil(spark, good, data).collect()} == civil
    gone = {r.doc_id: set(r.gone) for r in linededup.repeats(docs).collect()}
    for r in P.first_lines(spark, docs, data).join(docs.select("doc_id", F.col("text").alias("was")), "doc_id").collect():
        assert r.text == "\n".join(x for k, x in enumerate(r.was.split("\n")) if k not in gone.get(r.doc_id, ()))
    named = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {r.doc_id for r in P.near_duplicates(spark, docs, data).collect()} == named
    packed = P.pack(spark, docs, data).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert sum(r.n for r in packed) == docs.select(packing.word_count(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]


def test_odd_rows(spark, data, corpus):
    for rows in ([], corpus):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in P.STAGES[:-1]:
            assert stage(spark, df, data).columns == df.columns
            stage(spark, df, data).collect()
        P.pack(spark, df, data).collect()
