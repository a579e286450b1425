"""Tables whose writers don't lock: a manifest for each version, put only if it isn't there yet.

A version names the folders of Parquet files that it consists of. A writer
reads a version, writes new folders beside the old ones, and commits by creating
the next manifest; of two writers that started from one version only one can
create it, the other raises ``Conflict`` and its folders belong to no version.
Readers take the files of one manifest, so they see whole versions. Creating a
file that exists fails on HDFS and local file systems; a store that lacks this
needs a committer of its own.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds in which a change is tried on the newest version before it gives up.
ROUNDS = 20
#: How long a name may be taken without a manifest; taking and giving follow one another at once.
STALE_SECONDS = 600


class Conflict(Exception):
    """Another writer has committed since the version that a change was made from."""


class SnapshotTable:
    """FLT8-10, SNK3: a table at a path that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._hadoop(f"{self.path}/x").getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        """Numbers of all versions, ascending."""
        folder = self._hadoop(f"{self.path}/_versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """version, schema and folders of a version, the newest if none is given."""
        if version is None:
            version = max(self.versions(), default=None)
        if version is None:
            raise FileNotFoundError(f"no version of {self.path}")
        stream = self._fs.open(self._hadoop(f"{self.path}/_versions/{version}.json"))
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(raw) | {"version": version}

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; what is committed later doesn't change them."""
        found = self.manifest(version)
        reader = self.spark.read.schema(_schema(found["schema"]))
        return reader.parquet(*[f"{self.path}/{f}" for f in found["folders"]]) if found["folders"] else self.spark.createDataFrame([], _schema(found["schema"]))

    def commit(self, df: DataFrame, base: int | None, append: bool = False) -> int:
        """Make df (after the rows of ``base``, with ``append``) the version after ``base`` (None: the first); ``Conflict`` if there is one already."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        kept = self.manifest(base)["folders"] if append and base is not None else []
        version = 0 if base is None else base + 1
        text = json.dumps({"schema": df.schema.json(), "folders": [*kept, folder]})
        target, hidden = self._hadoop(f"{self.path}/_versions/{version}.json"), self._hadoop(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        self._fs.mkdirs(target.getParent())
        self._put(hidden, text)
        try:  # the manifest appears whole: its name is taken first, by a file that no reader counts, and then given to it
            self._put(self._hadoop(f"{self.path}/_versions/{version}.taken"), "")
        except Exception as e:
            self._fs.delete(hidden, False)
            self._fs.delete(self._hadoop(f"{self.path}/{folder}"), True)
            if "exists" in str(e):
                self._free(version)
                raise Conflict(f"version {version} of {self.path} was committed by another writer") from e
            raise
        self._fs.rename(hidden, target)
        return version

    def _free(self, version: int) -> None:
        """A driver that died between taking a name and giving it to its manifest leaves the name taken; after STALE_SECONDS it is free again."""
        mark = self._hadoop(f"{self.path}/_versions/{version}.taken")
        if not self._fs.exists(self._hadoop(f"{self.path}/_versions/{version}.json")) and self._fs.exists(mark) and time.time() - self._fs.getFileStatus(mark).getModificationTime() / 1000 > STALE_SECONDS:
            self._fs.delete(mark, False)

    def _put(self, path, text: str) -> None:
        out = self._fs.create(path, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _retried(self, change: Callable[[DataFrame], DataFrame]) -> int:
        for _ in range(ROUNDS):
            base = self.manifest()["version"]
            try:
                return self.commit(change(self.read(base)), base)
            except Conflict:
                continue
        raise Conflict(f"{self.path} changed {ROUNDS} times while a change was made")

    def update(self, where: Column, values: dict[str, Column]) -> int:
        """Set columns of the rows that a condition holds for, on the newest version; a conflict reads it anew."""
        return self._retried(lambda df: _set(df, where, values))

    def delete(self, where: Column) -> int:
        return self._retried(lambda df: df.where(~F.coalesce(where, F.lit(False))))

    def claim(self, where: Column, guard: Column, values: dict[str, Column]) -> int | None:
        """FLT8: set columns of the rows of ``where`` if ``guard`` holds for all of them and there is one, else do nothing (None).

        The guard is looked at again on the newest version after a conflict, so of
        two claims of the same rows one fails.
        """
        for _ in range(ROUNDS):
            base = self.manifest()["version"]
            df = self.read(base)
            wanted = df.where(F.coalesce(where, F.lit(False))).agg(F.count("*").alias("n"), F.count_if(~F.coalesce(guard, F.lit(False))).alias("failed")).first()
            if not wanted.n or wanted.failed:
                return None
            try:
                return self.commit(_set(df, where, values), base)
            except Conflict:
                continue
        raise Conflict(f"{self.path} changed {ROUNDS} times while rows were claimed")

    def put(self, rows: DataFrame, key: str) -> int:
        """SNK3: rows in place of those of their keys, others appended; keys of rows are unique. A conflict reads the newest version anew."""
        return self._retried(lambda df: df.join(rows.select(key), key, "left_anti").select(*df.columns).unionByName(rows.select(*df.columns)))


def _set(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """df with new values where a condition holds, types as before."""
    holds = F.coalesce(where, F.lit(False))
    return df.select(*[F.when(holds, values[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in values else F.col(c) for c in df.columns])


def _schema(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(text))
