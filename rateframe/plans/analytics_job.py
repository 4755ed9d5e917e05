"""The analytics job: run collectors over stored inputs and store one document per result."""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateframe.operators.documents import analytics_documents, analytics_upsert
from rateframe.plans.collectors import COLLECTORS, Collector, Inputs, union_all
from rateframe.session import materialize
from rateframe.sources.keyed_store import KeyedStore

log = logging.getLogger(__name__)

STATUS_SCHEMA = "collector string, status string, message string, documents bigint, metrics bigint"


def register_views(data: Inputs) -> None:
    """Movies and tags under their names for SQL text, where there are any."""
    for name, df in (("movies", data.movies), ("tags", data.tags)):
        if df is not None:
            df.createOrReplaceTempView(name)


def _run_one(
    collector: Collector, data: Inputs, run_id: str, generated_at_micros: int
) -> tuple[tuple, DataFrame | None]:
    try:
        if not collector.can_process(data):
            return (collector.name, "SKIPPED", "not enough input", 0, 0), None
        docs = analytics_documents(collector.collect(data), run_id, generated_at_micros)
        kept = materialize(docs, f"documents-{collector.name.lower()}")
        sizes = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("metrics")), F.lit(0)).alias("m")).first()
        return (collector.name, "SUCCESS", None, sizes.n, sizes.m), kept
    except Exception as error:
        log.exception("collector %s failed", collector.name)
        return (collector.name, "FAILURE", str(error).splitlines()[0], 0, 0), None


def run_collectors(
    data: Inputs,
    run_id: str,
    generated_at_micros: int,
    collectors: tuple[Collector, ...] = COLLECTORS,
    at_once: int = 4,
) -> tuple[DataFrame, DataFrame | None]:
    """Run the collectors, several at a time; one that fails or cannot run does not stop the others.

    Returns a status row per collector and the stored documents of those that succeeded.
    """
    spark = data.ratings.sparkSession
    register_views(data)
    data.prepare()
    with ThreadPoolExecutor(at_once) as pool:
        done = list(pool.map(lambda c: _run_one(c, data, run_id, generated_at_micros), collectors))
    stored = [docs for _, docs in done if docs is not None]
    statuses = spark.createDataFrame([status for status, _ in done], STATUS_SCHEMA)
    return statuses, union_all(stored) if stored else None


def document_store(spark: SparkSession, path: str) -> KeyedStore:
    return KeyedStore(spark, path, "analyticsId")


def store_documents(documents: DataFrame, path: str) -> None:
    """Documents into the store at ``path``; one with an id that is stored already replaces it."""
    document_store(documents.sparkSession, path).upsert(documents, analytics_upsert)
