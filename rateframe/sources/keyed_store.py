"""A table of rows with one key, kept in hash buckets, that is changed by whole versions.

A version names the folder that holds each bucket. An upsert reads and writes only the buckets that its keys fall in, each by
tasks of its own, and then commits. A write that fails or is killed leaves the version before it as it was, readers see
one version throughout, and of two writers at once the second merges again over what the first has stored.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rateframe.session import materialize
from rateframe.sources.versions import VersionedFolder

Merge = Callable[[DataFrame, DataFrame], DataFrame]
BUCKETS = 32
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Other writers came first as often as an upsert tries."""


@dataclass(frozen=True)
class Version:
    number: int
    buckets: int
    schema: StructType
    folders: dict[int, str]

    def content(self) -> dict:
        folders = {str(b): f for b, f in sorted(self.folders.items())}
        return {"buckets": self.buckets, "schema": self.schema.jsonValue(), "folders": folders}


class KeyedStore(VersionedFolder):
    """Rows by ``key``. The bucket count is fixed when the first rows are stored; ``rebucket`` changes it."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        super().__init__(spark, path)
        self.key, self.buckets = key, buckets

    def folders_of(self, content: dict) -> set[str]:
        return set(content["folders"].values())

    def version(self, number: int | None = None) -> Version | None:
        """The given version or the newest; None where nothing is stored."""
        found = self.load(number)
        if found is None:
            return None
        number, content = found
        return Version(number, content["buckets"], StructType.fromJson(content["schema"]), {int(b): f for b, f in content["folders"].items()})

    # --- reading -----------------------------------------------------------------------

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _rows(self, of: Version, only: set[int] | None = None) -> DataFrame:
        folders = [f"{self.data(f)}/bucket={b}" for b, f in of.folders.items() if only is None or b in only]
        if not folders:
            return self.spark.createDataFrame([], of.schema)
        return self.spark.read.schema(of.schema).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, by default the newest."""
        found = self.version(version)
        if found is None:
            raise ValueError(f"nothing stored in {self.path}")
        return self._rows(found)

    def lookup(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """Rows whose key is in ``keys``; only buckets that such keys fall in are read."""
        found = self.version(version)
        if found is None:
            raise ValueError(f"nothing stored in {self.path}")
        wanted = keys.select(F.col(self.key).cast(found.schema[self.key].dataType)).distinct()
        only = {r[0] for r in wanted.select(self._bucket(found.buckets)).distinct().collect()}
        return self._rows(found, only).join(wanted, self.key, "left_semi")

    # --- writing ---------------------------------------------------------------------------

    def _write(self, rows: DataFrame, buckets: int) -> tuple[str, set[int]]:
        """Rows as new bucket files; the folder they are in and the buckets it has."""
        write = self.fresh_folder()
        dealt = rows.withColumn("bucket", self._bucket(buckets))
        dealt.repartition("bucket").write.partitionBy("bucket").parquet(self.data(write))
        names = [name for name, _ in self._names(self.data(write))]
        return write, {int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")}

    def upsert(self, incoming: DataFrame, merge: Merge) -> Version:
        """Stores ``merge(stored, incoming)``, where both are the rows of the buckets that incoming keys fall in.

        ``merge`` must keep one row per key and no row with a key of neither. Incoming rows have the stored
        columns. Without incoming rows the version stays, unless it is the first.
        """
        incoming = materialize(incoming, "incoming")
        for attempt in range(ATTEMPTS):
            current = self.version()
            buckets = current.buckets if current else self.buckets
            schema = current.schema if current else incoming.schema
            if set(incoming.columns) != set(schema.names):
                raise ValueError(f"columns {incoming.columns} are not those stored: {schema.names}")
            touched = {r[0] for r in incoming.select(self._bucket(buckets)).distinct().collect()}
            if current and not touched:
                return current
            stored = self._rows(current, touched) if current else self.spark.createDataFrame([], schema)
            write, filled = self._write(merge(stored, incoming.select(*schema.names)).select(*schema.names), buckets)
            if not filled <= touched:
                raise ValueError(f"merge made rows in buckets {sorted(filled - touched)} that no incoming key falls in")
            kept = {b: f for b, f in current.folders.items() if b not in touched} if current else {}
            new = Version(current.number + 1 if current else 1, buckets, schema, kept | {b: write for b in filled})
            if self.commit(new.number, new.content()):
                return new
            time.sleep(min(0.05 * 2**attempt, 2))
        raise Conflict(f"{ATTEMPTS} other writers came first in {self.path}")

    def rebucket(self, buckets: int) -> Version:
        """The newest rows in another number of buckets, as a new version."""
        current = self.version()
        if current is None:
            raise ValueError(f"nothing stored in {self.path}")
        write, filled = self._write(self._rows(current), buckets)
        new = Version(current.number + 1, buckets, current.schema, {b: write for b in filled})
        if not self.commit(new.number, new.content()):
            raise Conflict(f"another writer came first in {self.path}")
        return new
