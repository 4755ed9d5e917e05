import math
import random

import pytest
from pyspark.sql import functions as F

from rateframe.llm import sharding, va_search

SCHEMA = "vec_id long, embedding array<float>, label int, query_id long, score string"


def brute_force(rows, k, every):
    whole = []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((i, tuple(math.floor(256 * x) for x in v)))
    whole = sorted(set(whole))
    result = []
    for q in sorted({i for i, _ in whole if i % every == 0}):
        best = {}
        for _, a in [w for w in whole if w[0] == q]:
            for i, b in whole:
                if i != q and len(a) == len(b):
                    best[i] = max(best.get(i, -(10**18)), sum(x * y for x, y in zip(a, b)))
        ranked = sorted(((-s, i) for i, s in best.items()))[:k]
        result += [(q, n, i, -s) for n, (s, i) in enumerate(ranked, 1)]
    return result


@pytest.mark.parametrize("blocks", [(2048, 16384), (3, 40)])
def test_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(va_search, "BLOCK_QUERIES", blocks[0])
    monkeypatch.setattr(va_search, "BLOCK_VECTORS", blocks[1])
    draw = random.Random(2)
    vector = lambda: [draw.randrange(-300, 300) / 256 for _ in range(6)]
    hot = vector()
    rows = [(i, vector()) for i in range(200)] + [(1000 + i, hot) for i in range(120)]
    rows += [(500, None), (501, []), (502, [1.0] * 5 + [None]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (None, hot)]
    rows += [(600, [0.5, 0.25]), (610, [0.5, 0.5]), (7, rows[7][1]), (20, vector())]
    rows += [(2000, [0.0] * 6), (2010, [0.0] * 6)]
    frame = spark.createDataFrame([(i, v, 1, 5, "own") for i, v in rows], SCHEMA)
    found = va_search.top_k(frame, F.col("vec_id") % 10 == 0, 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == brute_force(rows, 5, 10)


def test_no_vectors(spark):
    assert va_search.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0, 5).count() == 0


def test_shards_fit_and_only_full_buckets_are_split(spark):
    rows = [(i, "x" * (i % 50)) for i in range(600)] + [(7, "y" * i) for i in range(200)] + [(9, "same")] * 700
    rows += [(None, None)] * 3 + [(None, "")] * 3 + [(5000, "z" * 5000)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, sum long").repartition(3)
    limit = 1000
    found = sharding.shards(docs.select("doc_id", "text"), ["doc_id"], F.octet_length("text"), limit).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in found) == sorted((str(i), str(t)) for i, t in rows)
    sizes, members = {}, {}
    for r in found:
        sizes[r.shard, r.page] = sizes.get((r.shard, r.page), 0) + r.bytes
        members.setdefault((r.shard, r.page), []).append(r)
        assert r.depth == len(r.shard.replace("/", "")) and r.bytes == len(r.text or "")
    assert all(s <= limit or len(members[k]) == 1 for k, s in sizes.items())
    plain = {r.shard for r in found if "/" not in r.shard}
    for shard in plain:  # the bucket one bit shorter was over the limit
        if shard:
            assert sum(r.bytes for r in found if r.shard.startswith(shard[:-1])) > limit
    assert not any(a != b and b.startswith(a) for a in plain for b in plain)
    assert {r.shard.split("/")[0] for r in found if r.doc_id == 7} == {r.shard.split("/")[0] for r in found if r.doc_id == 7 and r.text}
    pages = {(r.shard, r.page) for r in found if r.text == "same"}
    assert len(pages) == 3 and all(sizes[p] <= limit for p in pages)  # 250 rows of 4 bytes fill a page


def test_shards_of_little_and_nothing(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    assert {(r.shard, r.depth, r.page) for r in sharding.shards(docs, ["doc_id"], F.octet_length("text"), 10).collect()} == {("", 0, 0)}
    assert sharding.shards(docs.limit(0), ["doc_id"], F.octet_length("text"), 10).count() == 0
    for name in ("page", "bucket", "sum", "partition", "base", "cell", "hash_key", "row"):
        docs = docs.withColumn(name, F.lit(name))
    for limit in (10, 1):
        found = sharding.shards(docs, ["doc_id"], F.octet_length("text"), limit)
        assert found.columns == [c if c != "page" else "own_page" for c in docs.columns] + ["bytes", "shard", "depth", "page"]
        assert {(r.own_page, r.bucket, r["sum"], r.partition, r.base) for r in found.collect()} == {("page", "bucket", "sum", "partition", "base")}


def test_written_shards_read_back(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * 30) for i in range(50)], "doc_id long, text string")
    found = sharding.shards(docs, ["doc_id"], F.octet_length("text"), 200)
    sharding.write_shards(found, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
