"""Tables as snapshots: folders that never change, and manifests that say which of them count.

Work is staged in new folders, which no reader sees. One commit then names them all in the next
manifest, so several tables change together or not at all: a driver lost before the commit leaves
nothing but folders that nobody reads, and two writers cannot both commit the same version. Rows
are taken back by key: a table of removed keys hides what earlier versions added.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adcorpus.operators.metrics import null_safe_join

MANIFESTS, END = "_manifests", "\nend\n"
#: Every row says which version added (or removed) it.
VERSION = "version"


class Snapshots:
    """The tables under ``path``. An object sees the newest version at every call."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _numbers(self) -> list[int]:
        folder = self._hadoop(f"{self.path}/{MANIFESTS}")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), reverse=True)

    def _manifest(self, number: int) -> dict | None:
        """What version ``number`` says; None when its writer was lost before the end."""
        stream = self._fs.open(self._hadoop(f"{self.path}/{MANIFESTS}/{number:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text.removesuffix(END)) if text.endswith(END) else None

    def _newest(self) -> tuple[int, dict[str, list[str]]]:
        """The next version's number and the folders of the newest complete version."""
        numbers = self._numbers()
        complete = (m for m in map(self._manifest, numbers) if m is not None)
        return (numbers[0] + 1 if numbers else 1), next(complete, {})

    def exists(self) -> bool:
        return bool(self._numbers())

    def next_version(self) -> int:
        return self._newest()[0]

    def stage(self, df: DataFrame, table: str, version: int, partition_by: Sequence[str] = ()) -> str:
        """Write ``df`` for ``table``; returns the folder, to be committed as ``version``."""
        folder = f"{table}/{version:012d}-{uuid.uuid4().hex}"
        df.withColumn(VERSION, F.lit(version).cast("bigint")).write.partitionBy(*partition_by).parquet(
            f"{self.path}/{folder}"
        )
        return folder

    def staged(self, folder: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    def commit(self, version: int, add: Mapping[str, Sequence[str]], replace: Mapping[str, Sequence[str]] | None = None) -> None:
        """Make staged folders count as of ``version``: ``add`` to a table's folders, or
        ``replace`` them. Raises when another writer has taken the version."""
        number, tables = self._newest()
        if number != version:
            raise RuntimeError(f"version {version} is taken; the next one is {number}")
        after = {**tables, **{t: list(folders) for t, folders in (replace or {}).items()}}
        for table, folders in add.items():
            after[table] = [*after.get(table, []), *folders]
        # creating the file fails if it exists; it counts once its last line is there
        out = self._fs.create(self._hadoop(f"{self.path}/{MANIFESTS}/{version:012d}.json"), False)
        try:
            out.write(bytearray((json.dumps(after, indent=1) + END).encode()))
        finally:
            out.close()

    def read(self, table: str, schema: T.StructType) -> DataFrame:
        """All rows of ``table`` with the version that added them."""
        full = T.StructType([*schema.fields, T.StructField(VERSION, T.LongType())])
        folders = self._newest()[1].get(table, [])
        if not folders:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", self.path).parquet(
            *[f"{self.path}/{folder}" for folder in folders]
        )

    def visible(self, table: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
        """Rows of ``table`` that no later version removed, without the version column."""
        rows = self.read(table, schema)
        gone = self.read(f"{table}_removed", T.StructType([schema[k] for k in keys]))
        gone = gone.groupBy(*keys).agg(F.max(VERSION).alias("_gone"))
        marked = null_safe_join(rows, gone, keys, "left")
        return marked.where(F.col("_gone").isNull() | (F.col("_gone") <= F.col(VERSION))).select(*schema.names)

    def compact(self, table: str, schema: T.StructType, keys: Sequence[str], partition_by: Sequence[str] = ()) -> None:
        """Rewrite ``table`` without its removed rows, as one folder."""
        version = self.next_version()
        folder = self.stage(self.visible(table, schema, keys), table, version, partition_by)
        self.commit(version, {}, {table: [folder], f"{table}_removed": []})
