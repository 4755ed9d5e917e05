"""Interaction events to recommendations, as one function for batch and stream.

All work per event is a lookup in stored tables: known users, and a neighbour list per movie.
The lists are short arrays computed beforehand, so no event starts a search and no stream keeps state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rateframe.fixed_values import RATING_MAX, RATING_MIN
from rateframe.functions.expressions import (
    event_type_name,
    event_weight,
    rec_budget,
    score_multiplier,
    weighted_score,
)
from rateframe.sources.versions import VersionedFolder

EVENT_SCHEMA = (
    "eventId bigint, userId int, movieId int, eventType string, rating double, tsMicros bigint"
)


# --- single events --------------------------------------------------------------

def event_normalize(events: DataFrame) -> DataFrame:
    """Events with their type by name and its weight. Only rating events keep a rating."""
    named = events.withColumn("eventType", event_type_name("eventType")).withColumn("weight", event_weight("eventType"))
    if "rating" not in events.columns:
        return named
    return named.withColumn("rating", F.when(F.col("eventType") == "RATING_GIVEN", F.col("rating")))


def event_rec_budget(events: DataFrame) -> DataFrame:
    """Adds how many neighbours the event asks for and how it scales their scores."""
    return (
        event_normalize(events)
        .withColumn("k", rec_budget("weight"))
        .withColumn("multiplier", score_multiplier("weight"))
    )


def event_validate(events: DataFrame, ingested_at_micros: int | Column) -> DataFrame:
    """Every event with accepted or a reason. A missing time becomes the ingestion time.

    A missing movieId is accepted here; such an event yields no recommendations later.
    """
    now = F.lit(ingested_at_micros) if isinstance(ingested_at_micros, int) else ingested_at_micros
    rated = F.col("eventType") == "RATING_GIVEN"
    reason = (
        F.when(F.col("userId").isNull() | (F.col("userId") <= 0), "USER_NOT_POSITIVE")
        .when(F.col("eventType") == "UNKNOWN", "UNKNOWN_EVENT_TYPE")
        .when(F.col("movieId") <= 0, "MOVIE_NOT_POSITIVE")
        .when(rated & F.col("rating").isNull(), "RATING_MISSING")
        .when(rated & ~F.col("rating").between(RATING_MIN, RATING_MAX), "RATING_OUT_OF_RANGE")
    )
    return (
        event_normalize(events)
        .withColumn("reason", reason)
        .withColumn("accepted", F.col("reason").isNull())
        .withColumn("tsMicros", F.coalesce("tsMicros", now))
    )


# --- recommendations --------------------------------------------------------------

def salted_join(events: DataFrame, table: DataFrame, event_key: str, table_key: str, how: str, salts: int) -> DataFrame:
    """Look events up in a table with one row per key.

    In batch, adaptive execution splits a hot key, and ``salts=1`` is right. A stream's plan is
    fixed beforehand: with more salts each key is spread over that many tasks, and the much
    smaller table is repeated as often.
    """
    keyed = table.withColumnRenamed(table_key, "_key")
    if salts <= 1:
        return events.join(keyed, F.col(event_key) == F.col("_key"), how).drop("_key")
    left = events.withColumn("_salt", F.pmod(F.xxhash64("eventId"), F.lit(salts)).cast("int"))
    right = keyed.withColumn("_salt_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = (F.col(event_key) == F.col("_key")) & (F.col("_salt") == F.col("_salt_of"))
    return left.join(right, same, how).drop("_key", "_salt", "_salt_of")


def rt_processed_events(events: DataFrame, known_users: DataFrame, salts: int = 1) -> DataFrame:
    """Events that count as processed: known type, movie given, user known.

    Whether the movie is known does not matter here.
    """
    relevant = event_rec_budget(events).filter((F.col("weight") > 0) & F.col("movieId").isNotNull())
    users = known_users.select("userId").distinct()
    return salted_join(relevant, users, "userId", "userId", "left_semi", salts).withColumn("processed", F.lit(True))


def rt_recommendations(
    events: DataFrame,
    known_users: DataFrame,
    neighbors: DataFrame,
    salts: int = 1,
    exclude_seed_first: bool = False,
) -> DataFrame:
    """Processed events with their recommendations, best first, as one array per event.

    An event asks for its k nearest items and then drops the movie it is about, so it yields at
    most k - 1. ``exclude_seed_first`` drops the movie before counting to k instead; the
    neighbour lists must then be one longer.
    """
    processed = rt_processed_events(events, known_users, salts)
    found = salted_join(processed, neighbors, "movieId", "seedId", "inner", salts)
    other = lambda n: n["movieId"] != F.col("movieId")
    if exclude_seed_first:
        chosen = F.slice(F.filter("neighbors", other), F.lit(1), F.col("k"))
    else:
        chosen = F.filter(F.slice("neighbors", F.lit(1), F.col("k")), other)
    scored = F.transform(
        chosen,
        lambda n: F.struct(
            n["movieId"].alias("movieId"),
            weighted_score(n["cosine"], F.col("weight")).alias("predictedRating"),
        ),
    )
    return found.select("eventId", "userId", "movieId", "eventType", "tsMicros", scored.alias("recommendations"))


def recommendation_rows(recommended: DataFrame) -> DataFrame:
    return recommended.select(
        "eventId",
        "userId",
        F.col("movieId").alias("seedMovieId"),
        F.posexplode("recommendations").alias("pos", "rec"),
    ).select(
        "eventId",
        "userId",
        "seedMovieId",
        (F.col("pos") + 1).alias("position"),
        F.col("rec.movieId").alias("movieId"),
        F.col("rec.predictedRating").alias("score"),
    )


def rt_output_messages(recommended: DataFrame, digits: int = 4) -> DataFrame:
    """One message per event with recommendations: key is the user, value the list as JSON."""
    listed = F.transform(
        "recommendations",
        lambda r: F.struct(
            F.col("userId").alias("userId"),
            r["movieId"].alias("movieId"),
            F.round(r["predictedRating"], digits).alias("predictedRating"),
            F.col("tsMicros").alias("generatedAt"),
        ),
    )
    return recommended.filter(F.size("recommendations") > 0).select(
        "eventId", F.col("userId").cast("string").alias("key"), F.to_json(listed).alias("value")
    )


def rt_recs_for_user(messages: DataFrame, user_id: int) -> DataFrame:
    return messages.filter(F.col("key") == str(user_id))


# --- streams ------------------------------------------------------------------------

def checked_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events that pass validation, with a time, and the others with their reason."""
    checked = event_validate(events, F.unix_micros(F.current_timestamp()))
    accepted = checked.filter("accepted").select(*events.columns)
    return accepted, checked.filter("NOT accepted").select(*events.columns, "reason")


def read_event_files(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def parse_event_messages(messages: DataFrame) -> DataFrame:
    """Events out of JSON message values, without the messages that ``unparsable_messages`` has."""
    parsed = messages.select(F.from_json(F.col("value").cast("string"), EVENT_SCHEMA).alias("event"))
    return parsed.select("event.*").filter(_is_event(F.col("userId"), F.col("eventType")))


def unparsable_messages(messages: DataFrame) -> DataFrame:
    """Messages that are no event: what was read of them, the reason, and the message."""
    message = F.col("value").cast("string")
    parsed = messages.select(F.from_json(message, EVENT_SCHEMA).alias("event"), message.alias("message"))
    return parsed.filter(~_is_event(F.col("event.userId"), F.col("event.eventType"))).select(
        "event.*", F.lit("NO_EVENT").alias("reason"), "message"
    )


def _is_event(user: Column, kind: Column) -> Column:
    return user.isNotNull() & kind.isNotNull()


def _rejected(events: DataFrame | None, messages: DataFrame | None) -> DataFrame | None:
    """Rejected events, and those of ``messages`` that are none."""
    if messages is None:
        return events
    none = unparsable_messages(messages)
    return none if events is None else events.unionByName(none, allowMissingColumns=True)


def read_messages(spark: SparkSession, servers: str, topic: str, per_trigger: int = 1_000_000) -> DataFrame:
    """Messages of a Kafka topic; needs the Kafka connector on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", per_trigger)
        .load()
    )


def read_event_topic(spark: SparkSession, servers: str, topic: str, per_trigger: int = 1_000_000) -> DataFrame:
    """Events from a Kafka topic. Give ``read_messages`` of it to a stream instead to keep what is no event."""
    return parse_event_messages(read_messages(spark, servers, topic, per_trigger))


class ModelStore(VersionedFolder):
    """What events are looked up in, as numbered versions: known users, and a neighbour list per movie."""

    def publish(self, known_users: DataFrame, neighbors: DataFrame) -> int:
        """Stores a model as the newest version and returns its number. Streams use it from their next batch on."""
        folder = self.fresh_folder()
        known_users.select("userId").distinct().write.parquet(f"{self.data(folder)}/users")
        neighbors.write.parquet(f"{self.data(folder)}/neighbors")
        while True:
            number = max(self.versions(), default=0) + 1
            if self.commit(number, {"folder": folder}):
                return number

    def newest(self) -> tuple[int, DataFrame, DataFrame]:
        found = self.load()
        if found is None:
            raise ValueError(f"no model published in {self.path}")
        number, content = found
        folder = self.data(content["folder"])
        return number, self.spark.read.parquet(f"{folder}/users"), self.spark.read.parquet(f"{folder}/neighbors")


def outputs_of(
    batch: DataFrame, known_users: DataFrame, neighbors: DataFrame, salts: int = 1, validate: bool = False
) -> dict[str, DataFrame]:
    """All outputs of events, or of messages with a ``value`` that events are parsed from: ``messages``, ``processed``, and
    ``rejected`` if events are validated or messages may be none."""
    is_message = "value" in batch.columns and "userId" not in batch.columns
    events = parse_event_messages(batch) if is_message else batch
    rejected = None
    if validate:
        events, rejected = checked_events(events)
    rejected = _rejected(rejected, batch if is_message else None)
    outputs = {
        "messages": rt_output_messages(rt_recommendations(events, known_users, neighbors, salts)),
        "processed": rt_processed_events(events, known_users, salts),
    }
    return outputs if rejected is None else {**outputs, "rejected": rejected}


def _batch_log(spark: SparkSession, path: str, query_id: str) -> VersionedFolder:
    return VersionedFolder(spark, f"{path}/{query_id}")


def _store_batch(models: ModelStore, path: str, salts: int, validate: bool):
    """Stores all outputs of a micro-batch under one commit that has its number."""

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = _batch_log(spark, path, spark.sparkContext.getLocalProperty("sql.streaming.queryId"))
        if batch_id in log.versions():
            return  # committed before the stream noted it
        number, known_users, neighbors = models.newest()
        folder = log.fresh_folder()
        batch = batch.persist()
        try:
            outputs = outputs_of(batch, known_users, neighbors, salts, validate)
            for name, df in outputs.items():
                df.write.parquet(f"{log.data(folder)}/{name}")
        finally:
            batch.unpersist()
        log.commit(batch_id, {"folder": folder, "model": number, "outputs": sorted(outputs)})

    return store


def start_recommendation_stream(
    source: DataFrame,
    models: ModelStore,
    path: str,
    checkpoint: str,
    salts: int = 8,
    trigger: dict | None = None,
    validate: bool = False,
) -> StreamingQuery:
    """One stream of events or messages into all outputs; ``read_outputs`` reads them.

    Each micro-batch looks its events up in the newest model. Its outputs become visible together, by one commit under the
    batch's number. A batch that runs again after a failure is stored again if it was not committed and skipped if it was, so
    each event is in each output once. With ``validate`` only accepted events are looked up, and rejected ones are an output.
    """
    writer = source.writeStream.foreachBatch(_store_batch(models, path.rstrip("/"), salts, validate))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def committed_batches(spark: SparkSession, path: str) -> DataFrame:
    """(query, batch, model, folder, outputs) of all batches that streams have committed in ``path``."""
    at = F.input_file_name()
    content = F.from_json("value", "folder string, model long, outputs array<string>").alias("c")
    rows = spark.read.text(f"{path.rstrip('/')}/*/versions/*.json", wholetext=True).select(at.alias("at"), content)
    query, batch = F.regexp_extract("at", "/([^/]+)/versions/", 1), F.regexp_extract("at", "/versions/([0-9]+)", 1)
    folder = F.concat(query, F.lit("/data/"), F.col("c.folder"))
    return rows.select(query.alias("query"), batch.cast("bigint").alias("batch"), "c.model", folder.alias("folder"), "c.outputs")


def read_outputs(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One output of all committed batches in ``path``."""
    path = path.rstrip("/")
    folders = committed_batches(spark, path).filter(F.array_contains("outputs", name)).select("folder")
    found = [f"{path}/{r.folder}/{name}" for r in folders.toLocalIterator()]
    if not found:
        raise ValueError(f"no batch with {name} in {path}")
    return spark.read.parquet(*found)


def topic_rows(outputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Outputs as key and value: the user, and the row as JSON but for messages, whose value is theirs."""
    key = F.col("userId").cast("string").alias("key")
    return {
        name: df.select("key", "value") if name == "messages" else df.select(key, F.to_json(F.struct(*df.columns)).alias("value"))
        for name, df in outputs.items()
    }


def start_topic_outputs(
    source: DataFrame,
    models: ModelStore,
    servers: str,
    topics: dict[str, str],
    checkpoint: str,
    salts: int = 8,
    validate: bool = False,
) -> StreamingQuery:
    """The same outputs to Kafka topics, ``topics["messages"]``, ``topics["processed"]`` and ``topics["rejected"]``.

    Topics have no commit over all of them: a batch that runs again after a failure is sent again.
    """

    def send(batch: DataFrame, batch_id: int) -> None:
        _, known_users, neighbors = models.newest()
        batch = batch.persist()
        try:
            for name, rows in topic_rows(outputs_of(batch, known_users, neighbors, salts, validate)).items():
                rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topics[name]).save()
        finally:
            batch.unpersist()

    return source.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).start()
