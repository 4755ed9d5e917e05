"""Folders of data that change by whole versions.

    path/data/<write>/...          what one write made, never changed once written
    path/versions/<number>.json    what a version consists of

A write first makes its data and then adds the version file. Adding it is the commit: the file appears whole or not at
all, and one number is added only once. Whatever a failed or killed write leaves behind belongs to no version.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class VersionedFolder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _at(self, path: str):
        return self._hadoop.Path(path)

    def _files(self):
        return self._at(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[tuple[str, int]]:
        """Names in a folder and when each last changed, in ms."""
        at, files = self._at(folder), self._files()
        if not files.exists(at):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in files.listStatus(at)]

    def _file(self, number: int) -> str:
        return f"{self.path}/versions/{number:08d}.json"

    def fresh_folder(self) -> str:
        return uuid.uuid4().hex

    def data(self, folder: str) -> str:
        return f"{self.path}/data/{folder}"

    def versions(self) -> list[int]:
        names = [name for name, _ in self._names(f"{self.path}/versions")]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def load(self, number: int | None = None) -> tuple[int, dict] | None:
        """A version's number and content, by default the newest; None where there is none."""
        known = self.versions()
        if number is None and not known:
            return None
        if number is not None and number not in known:
            raise ValueError(f"no version {number} in {self.path}")
        number = known[-1] if number is None else number
        return number, json.loads(self.spark.read.text(self._file(number), wholetext=True).first()[0])

    def commit(self, number: int, content: dict) -> bool:
        """Adds a version; False if its number is taken."""
        draft = self._at(f"{self.path}/versions/.{number:08d}-{uuid.uuid4().hex}")
        files = self._files()
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(content), "utf-8"))
        out.close()
        context = self._hadoop.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        never_replace = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._at(self._file(number)), never_replace)
        except Py4JJavaError as error:
            files.delete(draft, False)
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise
        return True

    def folders_of(self, content: dict) -> set[str]:
        """Data folders that a version consists of."""
        return {content["folder"]}

    def vacuum(self, keep: int = 2, older_than_seconds: float = 86400.0) -> list[str]:
        """Deletes all but the newest ``keep`` versions, and data that no version left refers to.

        Younger data is spared, as a writer may be about to commit it. A reader of a deleted version fails.
        """
        known = self.versions()
        files = self._files()
        used = set()
        for number in known[-keep:]:
            used |= self.folders_of(self.load(number)[1])
        for number in known[:-keep]:
            files.delete(self._at(self._file(number)), False)
        before = (time.time() - older_than_seconds) * 1000
        gone = [name for name, changed in self._names(f"{self.path}/data") if name not in used and changed <= before]
        for name in gone:
            files.delete(self._at(self.data(name)), True)
        return gone
