"""Versioned state tables with an atomic pointer swap."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


#: No version is named.
ANY = "*"


class ConcurrentRun(RuntimeError):
    """Another run published a version after this one had read its base."""


class VersionedState:
    """A table kept as immutable version folders plus one pointer file.

    ``commit`` writes a complete new version first and only then swaps the pointer, by a rename that replaces the old
    pointer in one step. A run that dies at any point leaves the last version in force and at most an unreferenced
    folder behind, so a repeated run neither skips nor repeats records. Works on any Hadoop file system.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._jvm = jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self._conf)

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def current(self) -> str | None:
        """The folder name in force, None before the first commit."""
        return self._read("CURRENT") if self._fs.exists(self._p("CURRENT")) else None

    def _read(self, name: str) -> str | None:
        stream = self._fs.open(self._p(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8").strip() or None
        finally:
            stream.close()

    def read(self, name: str | None = ANY) -> DataFrame:
        """The version in force (or the named one), or no rows before the first commit."""
        name = self.current() if name is ANY else name
        if name is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}")

    def stage(self, rows: DataFrame) -> str:
        """Writes a version without putting it in force."""
        name = f"v-{uuid.uuid4().hex}"
        rows.select(*self.schema.fieldNames()).write.parquet(f"{self.path}/{name}")
        return name

    def _write(self, name: str, text: str, overwrite: bool) -> None:
        out = self._fs.create(self._p(name), overwrite)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def _swap(self, name: str) -> None:
        temporary = f"CURRENT.{uuid.uuid4().hex}"
        self._write(temporary, name, True)
        at = self._p(temporary)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else self._fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(at, self._p("CURRENT"), options)

    def publish(self, name: str, base: str | None = ANY) -> None:
        """Puts a staged version in force.

        With ``base``, the version it was made from (None: none), it does so only if no other run has published since: the
        successor of a version is claimed by creating one file, which only the first of several runs can. A run that
        died between its claim and the swap is completed here, its version being whole; the later run gets
        ``ConcurrentRun`` and is to be repeated from the version now in force."""
        if base is ANY:
            self._swap(name)
            return
        claim = f"NEXT-{base or 'first'}"
        if self.current() == base:
            try:
                self._write(claim, name, False)
            except Exception as taken:
                if not self._fs.exists(self._p(claim)):
                    raise
                winner = self._read(claim)
                if winner and self.current() == base:
                    self._swap(winner)
                raise ConcurrentRun(f"another run has followed {base}") from taken
            self._swap(name)
            return
        raise ConcurrentRun(f"{base} is no longer in force")

    def commit(self, rows: DataFrame, base: str | None = ANY) -> DataFrame:
        """Stages and publishes ``rows``; returns the new version as read from its files."""
        self.publish(self.stage(rows), base)
        return self.read()
