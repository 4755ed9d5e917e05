"""Health of the data a job works on, and of the job itself."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rateframe.fixed_values import QUALITY_ADVICE, QUALITY_ADVICE_OTHERWISE
from rateframe.functions.expressions import ladder, percent, share

BYTES_PER_ROW = 32


def dataset_sizes(ratings: DataFrame, movies: DataFrame, tags: DataFrame) -> DataFrame:
    sizes = None
    for name, df in (("ratings", ratings), ("movies", movies), ("tags", tags)):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("dataset"), "n")
        sizes = one if sizes is None else sizes.unionByName(one)
    of = lambda name: F.coalesce(F.sum(F.when(F.col("dataset") == name, F.col("n"))), F.lit(0))
    return sizes.agg(
        of("ratings").alias("ratingsDatasetSize"),
        of("movies").alias("moviesDatasetSize"),
        of("tags").alias("tagsDatasetSize"),
        F.sum("n").alias("totalDatasetSize"),
    )


def null_records(seen: DataFrame) -> DataFrame:
    return seen.select(
        F.col("totalRows").alias("totalRecords"),
        "nullRecords",
        percent(F.col("totalRows") - F.col("nullRecords"), "totalRows").alias("dataQualityScore"),
    )


def valid_row_ratio(seen: DataFrame) -> DataFrame:
    ratio = share("validRows", "totalRows")
    return seen.select(
        F.col("validRows").alias("validRowsCount"),
        (F.col("totalRows") - F.col("validRows")).alias("invalidRowsCount"),
        ratio.alias("dataQualityRatio"),
        ((1.0 - ratio) * 100).alias("qualityImpactOnPerformance"),
        ladder(ratio, QUALITY_ADVICE, QUALITY_ADVICE_OTHERWISE).alias("performanceRecommendation"),
    )


def user_skew(profile: DataFrame) -> DataFrame:
    ratio = F.col("maxUserRatings") / F.greatest(F.col("minUserRatings"), F.lit(1)).cast("double")
    return profile.agg(
        F.min("totalRatings").alias("minUserRatings"),
        F.max("totalRatings").alias("maxUserRatings"),
        F.avg("totalRatings").alias("avgUserRatings"),
    ).select("*", ratio.alias("userDataSkewRatio"), (ratio > 100).alias("hasSignificantSkew"))


def partition_profile(df: DataFrame) -> DataFrame:
    """Rows per partition, empty ones included, folded to one row without moving any data."""
    partitions = F.lit(df.rdd.getNumPartitions()).cast("bigint")
    mean = F.col("totalRecords") / F.col("partitionCount")
    return (
        df.groupBy(F.spark_partition_id().alias("partition"))
        .agg(F.count("*").alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("totalRecords"),
            partitions.alias("partitionCount"),
            F.when(F.count("*") < partitions, 0).otherwise(F.min("n")).alias("minRecordsPerPartition"),
            F.max("n").alias("maxRecordsPerPartition"),
        )
        .select(
            "*",
            mean.alias("avgRecordsPerPartition"),
            ((mean > 1000) & (mean < 100000)).alias("isWellPartitioned"),
            (F.col("totalRecords") * BYTES_PER_ROW).alias("estimatedMemoryUsageBytes"),
        )
    )


def run_timing(df: DataFrame) -> DataFrame:
    """Run the plan once, discard the rows, and report how fast it went; then time a check of all values by itself.

    The score is the share of complete rows, with a bonus for a fast check and a penalty for a slow one.
    """
    seen = Observation()
    started = time.monotonic()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    elapsed = int((time.monotonic() - started) * 1000)
    complete = F.lit(True)
    for name in df.columns:
        complete = complete & F.col(f"`{name}`").isNotNull()
    started = time.monotonic()
    checked = df.agg(F.count("*").alias("rows"), F.count_if(complete).alias("valid")).first()
    check = int((time.monotonic() - started) * 1000)
    measured = df.sparkSession.createDataFrame(
        [(seen.get["rows"], elapsed, check, checked.rows, checked.valid)],
        "totalRecords bigint, processingTimeMs bigint, qualityCheckTimeMs bigint, checkedRows bigint, validRows bigint",
    )
    speed = F.col("totalRecords") / F.greatest(F.col("processingTimeMs"), F.lit(1)) * 1000
    bonus = F.when(F.col("qualityCheckTimeMs") < 1000, 10.0).when(F.col("qualityCheckTimeMs") > 5000, -10.0)
    score = percent("validRows", "checkedRows") + F.coalesce(bonus, F.lit(0.0))
    return measured.select(
        "totalRecords",
        "processingTimeMs",
        speed.alias("recordsPerSecond"),
        ladder(speed, ((1000.0, "High"), (100.0, "Medium")), "Low").alias("processingEfficiency"),
        "qualityCheckTimeMs",
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)).alias("processingEfficiencyScore"),
    )
