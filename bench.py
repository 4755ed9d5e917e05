"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs once to warm up and then three times (heavy ones once) over whole tables; the median counts.
Every result row is computed and discarded.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from rateframe.plans.catalog import QUERIES

HEADLINE = (
    "clean_ratings",
    "quarantine_ratings",
    "dq_completeness",
    "dq_duplicates",
    "dq_orphan_tags",
    "freshness_recent",
    "rating_stats",
    "rating_quartiles",
    "user_profile",
    "advanced_segments",
    "yearly_trends",
    "top_hours",
    "top_movies",
    "genre_stats",
    "content_performance_summary",
    "popular_tags",
    "genre_top_tags",
    "tag_rating_affinity",
    "analytics_summary",
    "recs_enriched",
    "item_similar_items",
    "rt_recommendations",
    "rt_processed_events",
)
# Timed as well, but not part of the sum: they train, build an index or write a store.
HEAVY = ("analytics_query", "analytics_upsert", "recs_upsert", "chart_rating_distribution", "als_recommend_all", "item_similar_items_ann")
REPEATS = 3
HEAVY_REPEATS = 1


def run_once(query, spark: SparkSession, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or (*HEADLINE, *HEAVY)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus.replace("*", "8"))
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in chosen:
        run_once(QUERIES[name], spark, sf_dir)
        repeats = HEAVY_REPEATS if name in HEAVY else REPEATS
        seconds[name] = round(statistics.median(run_once(QUERIES[name], spark, sf_dir) for _ in range(repeats)), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median seconds over headline queries",
                "value": round(sum(s for name, s in seconds.items() if name not in HEAVY), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
