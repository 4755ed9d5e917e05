import re

import pytest
from pyspark.sql import functions as F

from rateframe.operators import documents, paging
from rateframe.plans.catalog import DOCUMENT_QUERIES
from rateframe.sources import derived_inputs as src


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(900)).alias("n"), "id").repartition(6)


@pytest.fixture
def many_ranges(spark):
    """Small ranges stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pages_are_slices_of_the_order(spark, numbers, many_ranges):
    expected = sorted((r.n, r.id) for r in numbers.collect())
    found = paging.sort_rows(numbers, F.asc("n"), F.asc("id"))
    assert found.total == 5000 and len(found.counts) > 1
    edges, base = [], 0
    for _, n in found.counts:
        base += n
        edges.append(base)
    for offset in [0, 1, 2499, 4990, 5000, 10**12, *[e - 5 for e in edges]]:
        assert [tuple(r) for r in found.slice(offset, 10).collect()] == expected[offset : offset + 10]


def test_falling_order_and_nulls(spark):
    rows = spark.createDataFrame([(3,), (None,), (1,), (2,), (2,)], "n int")
    found = paging.sort_rows(rows, F.desc("n"))
    assert [r.n for r in found.slice(0, 9).collect()] == [3, 2, 2, 1, None]
    assert paging.sort_rows(rows.limit(0), F.desc("n")).slice(0, 5).count() == 0


def test_deep_pages_of_documents(spark, data, monkeypatch):
    docs = src.analytics_docs(spark, data)
    shallow = documents.analytics_query(docs, page=3, size=7).collect()
    monkeypatch.setattr(documents, "SHALLOW_ROWS", 0)
    assert documents.analytics_query(docs, page=3, size=7).collect() == shallow
    wanted = documents.analytics_query(docs, sort_by="type", ascending=True, page=2, size=11).collect()
    monkeypatch.undo()
    assert documents.analytics_query(docs, sort_by="type", ascending=True, page=2, size=11).collect() == wanted


def test_no_plan_keeps_the_rows_before_a_deep_page(spark, data):
    deep = documents.analytics_query(src.analytics_docs(spark, data), **DOCUMENT_QUERIES["beyond_last_page"])
    shown = deep._jdf.queryExecution().executedPlan().toString()
    assert all(int(n) <= 20 for n in re.findall(r"limit=(\d+)", shown)) and "Limit" not in shown
    assert deep.count() == 0
