import glob
import os
import threading

import pytest
from pyspark.sql import functions as F

from rateframe.sources.keyed_store import KeyedStore

SCHEMA = "k string, n long, v string"


def newest(stored, incoming):
    """Highest n per key."""
    return stored.unionByName(incoming).groupBy("k").agg(F.max_by(F.struct("n", "v"), "n").alias("r")).select("k", "r.n", "r.v")


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, str(tmp_path / "store"), "k", buckets=8)


def rows(spark, *given):
    return spark.createDataFrame(list(given), SCHEMA)


def many(spark, first, last, n=1):
    return spark.range(first, last).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(n).cast("long").alias("n"), F.lit("x").alias("v"))


def stored_files(store):
    return set(glob.glob(f"{store.path}/data/*/bucket=*/*.parquet"))


def test_upserts_replace_and_add(spark, store):
    assert store.version() is None
    store.upsert(rows(spark, ("a", 1, "old"), ("b", 1, "old"), (None, 1, "no key")), newest)
    store.upsert(rows(spark, ("b", 2, "new"), ("c", 2, "new")), newest)
    found = {tuple(r) for r in store.read().collect()}
    assert found == {("a", 1, "old"), ("b", 2, "new"), ("c", 2, "new"), (None, 1, "no key")}
    assert {tuple(r) for r in store.read(1).collect()} == {("a", 1, "old"), ("b", 1, "old"), (None, 1, "no key")}
    assert store.versions() == [1, 2]


def test_a_small_batch_rewrites_only_its_buckets(spark, store):
    store.upsert(many(spark, 0, 500), newest)
    before = stored_files(store)
    assert len(before) == 8
    old = store.version()
    new = store.upsert(many(spark, 7, 8, n=5), newest)
    assert len(stored_files(store) - before) == 1 and before < stored_files(store)
    changed = {b for b in old.folders if old.folders[b] != new.folders[b]}
    assert len(changed) == 1
    assert store.read().count() == 500 and store.read().filter("n = 5").count() == 1


def test_a_failed_write_leaves_the_version_before(spark, store):
    store.upsert(many(spark, 0, 100), newest)

    def breaks(stored, incoming):
        late = F.when(F.col("k") == "k50", F.raise_error(F.lit("lost"))).otherwise(F.col("v"))
        return newest(stored, incoming).withColumn("v", late)

    with pytest.raises(Exception, match="lost"):
        store.upsert(many(spark, 0, 100, n=2), breaks)
    assert store.versions() == [1]
    assert store.read().agg(F.count("*"), F.max("n")).first()[:] == (100, 1)
    store.upsert(many(spark, 50, 60, n=3), newest)
    assert store.read().filter("n = 3").count() == 10 and store.read().count() == 100


def test_a_reader_keeps_its_version(spark, store):
    store.upsert(many(spark, 0, 50), newest)
    reading = store.read()
    store.upsert(many(spark, 0, 50, n=2), newest)
    assert reading.agg(F.max("n")).first()[0] == 1 and store.read().agg(F.min("n")).first()[0] == 2


def test_two_writers_both_count(spark, store):
    store.upsert(many(spark, 0, 20), newest)
    both = threading.Barrier(2)
    met = {0: False, 1: False}

    def writer(i):
        def merge(stored, incoming):
            if not met[i]:  # both have read version 1 before either writes
                met[i] = True
                both.wait(60)
            return newest(stored, incoming)

        store.upsert(many(spark, 100 * i, 100 * i + 40, n=2 + i), merge)

    threads = [threading.Thread(target=writer, args=(i,)) for i in met]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert store.versions() == [1, 2, 3]
    assert {r.n: r["count"] for r in store.read().groupBy("n").count().collect()} == {2: 40, 3: 40}


def test_lookup_reads_only_buckets_of_its_keys(spark, store):
    store.upsert(many(spark, 0, 300), newest)
    found = store.lookup(rows(spark, ("k5", 0, ""), ("unknown", 0, "")).limit(1))
    assert [r.k for r in found.collect()] == ["k5"]
    assert len(found.inputFiles()) == 1


def test_rebucket_and_vacuum(spark, store):
    for n in range(3):
        store.upsert(many(spark, 0, 60, n=n), newest)
    store.rebucket(3)
    assert store.read().count() == 60 and len(store.version().folders) == 3
    assert store.vacuum(keep=1) == []  # too young
    gone = store.vacuum(keep=1, older_than_seconds=-5)
    assert len(gone) == 3 and store.versions() == [4] and store.read().filter("n = 2").count() == 60
    assert len(os.listdir(f"{store.path}/data")) == 1
    store.upsert(many(spark, 0, 1, n=9), newest)
    assert store.read().filter("n = 9").count() == 1


def test_nothing_and_wrong_columns(spark, store):
    with pytest.raises(ValueError, match="nothing stored"):
        store.read()
    store.upsert(rows(spark), newest)
    assert store.read().count() == 0 and store.read().columns == ["k", "n", "v"]
    assert store.upsert(rows(spark), newest).number == 1
    with pytest.raises(ValueError, match="columns"):
        store.upsert(spark.createDataFrame([("a",)], "k string"), newest)
    with pytest.raises(ValueError, match="no version 7"):
        store.read(7)
