import pytest

from tessella.llm.scratch import Scratch
from tessella.llm.sharding import CommitConflict, ShardStore


@pytest.fixture
def store(spark):
    return ShardStore(spark, Scratch(spark, "store").path, target=1 << 20, fan=3)


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_every_version_reads_what_was_appended(store, docs):
    for k in range(3):
        assert store.append(docs) == k + 1
    for v in (1, 2, 3):
        assert store.read(v).count() == v * docs.count()
    assert rows(store.read(1)) == rows(docs)


def test_compaction_merges_similar_runs(store, docs):
    for _ in range(7):
        store.append(docs)
    before = rows(store.read())
    assert store.compact() >= 1 and not store.due()
    _, _, runs = store.manifest()
    assert len(runs) < 7 and rows(store.read()) == before
    tiers = [store.tier(r) for r in runs if len(r.files) > 1 or r.size < store.target]
    assert all(tiers.count(t) < store.fan for t in tiers)


def test_files_of_target_size(spark):
    store = ShardStore(spark, Scratch(spark, "store").path, target=20_000, fan=2)
    for k in range(4):
        store.append(spark.range(k * 20_000, (k + 1) * 20_000, numPartitions=6).selectExpr("id", "sha2(cast(id as string), 256) h"))
    store.compact()
    _, _, runs = store.manifest()
    sizes = [n for r in runs for _, n in r.files]
    assert len(runs) == 1 and sum(sizes) / len(sizes) > 20_000 / 2 and store.read().count() == 80_000


def test_vacuum_keeps_what_is_named(store, docs, spark):
    for _ in range(4):
        store.append(docs)
    store.compact()
    orphan = f"{store.root}/data/unfinished"
    docs.write.parquet(orphan)
    assert store.vacuum(keep=1) >= 3 and len(store.versions()) == 1
    assert store.read().count() == 4 * docs.count()
    assert spark.read.parquet(orphan).count() == docs.count()


def test_two_writers(store, docs, spark):
    other = ShardStore(spark, store.root, target=store.target, fan=store.fan)
    for _ in range(3):
        store.append(docs)
    (runs,) = store.due()
    other.merge(runs)
    with pytest.raises(CommitConflict):
        store.merge(runs)
    assert store.read().count() == 3 * docs.count()
    assert {other.append(docs), store.append(docs)} == {5, 6}


def test_empty_arrivals_and_columns(store, none, clashing, spark):
    with pytest.raises(ValueError):
        store.read()
    store.append(none)
    assert store.read().count() == 0 and store.read().columns == none.columns
    wide = ShardStore(spark, Scratch(spark, "store").path)
    wide.append(clashing)
    assert rows(wide.read()) == rows(clashing)


def test_nothing_is_left_behind(store, docs, spark, monkeypatch):
    for _ in range(3):
        store.append(docs)
    (runs,) = store.due()
    ShardStore(spark, store.root, target=store.target, fan=store.fan).merge(runs)
    folders = lambda: {x.getPath().getName() for x in store._fs.listStatus(store._path(f"{store.root}/data"))}
    before = folders()
    with pytest.raises(CommitConflict):
        store.merge(runs)
    assert folders() == before
    docs.write.parquet(f"{store.root}/data/unfinished")
    assert store.sweep(older=3600) == 0 and store.sweep(older=0) == 1 and folders() == before
