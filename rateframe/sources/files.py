"""File sources and sinks with fixed schemas."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rateframe.operators.ingest import (
    clean_ratings,
    conform_columns,
    parse_prediction_pairs,
    require_rows,
    typed_movies,
    typed_tags,
)

RATINGS_SCHEMA = "userId string, movieId string, rating string, timestamp string"
MOVIES_SCHEMA = "movieId string, title string, genres string"
TAGS_SCHEMA = "userId string, movieId string, tag string, timestamp string"
HEADERS_AT_ONCE = 8


def _by_header(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files of a path by their header line. Files without any line are left out."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"').option("inferSchema", False)
    files = sorted(spark.read.text(path).inputFiles())
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:  # each reads the first line of one file
        headers = list(pool.map(lambda file: tuple(reader.csv(file).columns), files))
    found: dict[tuple[str, ...], list[str]] = {}
    for header, file in zip(headers, files):
        if header:
            found.setdefault(header, []).append(file)
    return found


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with headers, whose names decide which column is which, in any order and letter case, file by file.

    Rows that do not fit their file's header are left out, empty cells are null. A file without one of the expected columns
    has no rows.
    """
    expected = tuple(field.split()[0] for field in schema.split(", "))
    rows = None
    for header, files in _by_header(spark, path).items():
        in_file = T.StructType([T.StructField(name, T.StringType()) for name in header])
        reader = spark.read.schema(in_file).option("header", True).option("encoding", "UTF-8").option("escape", '"')
        part = reader.option("mode", "DROPMALFORMED").option("nullValue", "").option("emptyValue", "").csv(files)
        part = conform_columns(part, expected)
        rows = part if rows is None else rows.unionByName(part)
    return spark.createDataFrame([], schema) if rows is None else rows


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def load_raw_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Ratings as text. A missing path or an empty file is an error."""
    return require_rows(read_csv(spark, path, RATINGS_SCHEMA), f"ratings in {path}")


def load_ratings(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return require_rows(clean_ratings(load_raw_ratings(spark, path), strict), f"usable ratings in {path}")


def _optional(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    if path is None:
        return spark.createDataFrame([], schema)
    try:
        return read_csv(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_movies(spark: SparkSession, path: str | None) -> DataFrame:
    """Movies; without a file, a typed table of no rows."""
    return typed_movies(_optional(spark, path, MOVIES_SCHEMA))


def load_tags(spark: SparkSession, path: str | None) -> DataFrame:
    return typed_tags(_optional(spark, path, TAGS_SCHEMA))


def load_prediction_pairs(spark: SparkSession, path: str) -> DataFrame:
    return parse_prediction_pairs(spark.read.text(path))
