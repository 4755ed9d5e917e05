import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rateframe.llm import queries
from tests.llm.helpers import table


@pytest.fixture(scope="module")
def stages(spark, data):
    docs, found = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, data), f"test-{name}")
        found.append((name, before, docs))
    return found


def test_each_stage_does_its_part(stages, spark, data):
    by_name = {name: (before, after) for name, before, after in stages}
    names = spark.read.parquet(f"{data}/documents.parquet").columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for name in ("toxicity", "near_duplicates", "decontamination", "personal_data"):
        assert by_name[name][1].columns == names
    labels = spark.read.parquet(f"{data}/labels.parquet")
    toxic, clean = ids(labels.filter("toxic = 1")), ids(labels.filter("toxic = 0"))
    left = ids(by_name["toxicity"][1])
    assert len(toxic & left) <= 0.1 * len(toxic) and len(clean - left) <= 0.05 * len(clean)
    before, after = by_name["near_duplicates"]
    components = {r.component_id for r in corpus_pipeline.minhash.near_duplicates(before).collect()}
    assert ids(after) == components and after.count() == len(components)
    before, after = by_name["decontamination"]
    benchmark = queries.table(spark, data, "benchmark")
    assert ids(after) == ids(before) - ids(corpus_pipeline.decontamination.contaminated(before, benchmark))
    before, after = by_name["personal_data"]
    for row in after.collect():
        assert not re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]", row.text) and row.n_chars == len(row.text)
    assert ids(after) == ids(before) == ids(by_name["packing"][1])


def test_odd_rows_pass_every_stage(spark, data):
    rows = [(10**9, None), (10**9 + 1, ""), (None, None), (None, "no id"), (10**9 + 2, "twice " * 9), (10**9 + 2, "twice " * 9), (10**9 + 3, "TWICE " * 9)]
    clashing = ("spans", "candidates", "score", "kept", "component_id", "item_id", "id", "t", "row", "bucket", "sequence_id")
    docs = table(spark, rows, extra=True)
    docs = docs.select("*", *[F.lit(7).alias(c) for c in clashing if c not in docs.columns])
    names = set(docs.columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, data), "odd")
        assert set(docs.columns) == names and docs.filter("spans = 7").count() == docs.count()
    assert sorted(str(r.doc_id) for r in docs.collect()) == sorted(["None", "None", *(str(10**9 + k) for k in range(3))])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() == 5


def test_empty_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    assert docs.count() == 0
