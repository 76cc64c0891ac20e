"""What a store knows of its fields, and its files.

A :class:`Binding` lets any table act as a store: it names the event id and gives a Column for each field. A
:class:`Store` is a directory with events, postings, statistics and a small versioned catalog; new fields are added as
they arrive, never dropped.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .types import FieldId


@dataclass
class Binding:
    """A table with typed fields."""

    table: DataFrame
    event_id: Column
    fields: dict[FieldId, Column]
    tags: Column | None = None

    @staticmethod
    def of(table: DataFrame, event_id: str | Column, fields: dict[str, str | Column], tags: Column | None = None) -> Binding:
        as_column = lambda c: F.col(c) if isinstance(c, str) else c
        return Binding(table, as_column(event_id), {FieldId.of(k): as_column(c) for k, c in fields.items()}, tags)

    def knows(self, name: FieldId) -> bool:
        return name in self.fields

    def column(self, name: FieldId) -> Column:
        return self.fields[name]

    def named(self, fields: list[FieldId] | None = None) -> list[Column]:
        return [self.fields[f].alias(str(f)) for f in (self.fields if fields is None else fields)]

    def events(self, fields: list[FieldId] | None = None) -> DataFrame:
        return self.table.select(self.event_id.alias("event_id"), *self.named(fields))


class Files:
    """Small text files by Hadoop paths, so that any store Spark reaches will do."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        where, system = self._path(path)
        return system.exists(where)

    def read(self, path: str) -> str:
        where, system = self._path(path)
        stream = system.open(where)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str, replace: bool = True) -> bool:
        """Writes beside and renames, so that a reader sees the old file or the new one. Without ``replace`` a file that
        exists stays, and the answer is False."""
        beside = f"{path}.{uuid.uuid4().hex}.new"
        where, system = self._path(beside)
        out = system.create(where, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        target, _ = self._path(path)
        hadoop = self.jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        options[0] = getattr(getattr(hadoop, "Options$Rename"), "OVERWRITE" if replace else "NONE")
        try:
            hadoop.FileContext.getFileContext(system.getUri(), self.conf).rename(where, target, options)
        except Py4JJavaError:
            system.delete(where, False)
            if replace or not self.exists(path):
                raise
            return False
        return True

    def names(self, path: str) -> list[str]:
        """The names in a folder; none where there is no folder."""
        where, system = self._path(path)
        return sorted(f.getPath().getName() for f in system.listStatus(where)) if system.exists(where) else []

    def delete(self, path: str) -> None:
        where, system = self._path(path)
        system.delete(where, True)


@dataclass
class Store:
    """A named, isolated collection of events with its index and statistics."""

    spark: SparkSession
    name: str
    path: str
    created: dict[FieldId, float] = field(default_factory=dict)

    def __post_init__(self):
        self.files = Files(self.spark)
        if self.files.exists(self._catalog):
            self.created = {FieldId.of(k): v for k, v in json.loads(self.files.read(self._catalog))["fields"].items()}

    @property
    def _catalog(self) -> str:
        return f"{self.path}/catalog.json"

    def add_fields(self, names: list[FieldId]) -> list[FieldId]:
        """Adds unknown fields; returns them."""
        new = [n for n in dict.fromkeys(names) if n not in self.created]
        if new:
            self.created |= {n: time.time() for n in new}
            self.files.write(self._catalog, json.dumps({"fields": {str(k): v for k, v in self.created.items()}}))
        return new

    def append(self, events: DataFrame, fields: list[FieldId], index: bool = True, batch: str | None = None) -> None:
        """Writes events (``event_id`` and a column named ``type:name`` for each field), then their postings.

        Each batch has a folder of its own; a batch that is written again under its name replaces itself.
        """
        from .operators import postings

        self.add_fields(fields)
        columns = {f: F.col(f"`{f}`") for f in fields}
        ready = events.select(F.col("event_id").cast("string").alias("event_id"), *[c.cast(f.type.spark).alias(str(f)) for f, c in columns.items()])
        folder = f"batch={batch or uuid.uuid4().hex}"
        ready.write.mode("overwrite").parquet(f"{self.path}/events/{folder}")
        if index and fields:
            postings.write(postings.build(ready, columns), f"{self.path}/postings/{folder}", mode="overwrite")

    def has_events(self) -> bool:
        return self.files.exists(f"{self.path}/events")

    def binding(self) -> Binding:
        """All events so far; columns are those of the catalog, whatever each file holds."""
        from pyspark.sql import types as T

        schema = T.StructType([T.StructField("event_id", T.StringType()), *[T.StructField(str(f), f.type.spark) for f in self.created]])
        table = self.spark.read.schema(schema).parquet(f"{self.path}/events").drop("batch") if self.has_events() else self.spark.createDataFrame([], schema)
        return Binding(table, F.col("event_id"), {f: F.col(f"`{f}`") for f in self.created})

    def postings(self) -> DataFrame | None:
        where = f"{self.path}/postings"
        return self.spark.read.parquet(where).drop("batch") if self.files.exists(where) else None

    def analyze(self) -> None:
        """Recomputes the statistics table from the postings: terms of every type, in their text form."""
        from .operators import stats
        from .operators.postings import term_text

        rows = self.postings()
        if rows is not None:
            words = rows.withColumn("term", term_text()).withColumn("n", F.coalesce(F.size("positions"), F.lit(1)))
            words.groupBy("field", "term").agg(F.sum(F.greatest("n", F.lit(1))).alias("frequency")).write.mode("overwrite").parquet(f"{self.path}/frequencies")
            stats.hll(words.select("field", "term"), ["field"]).write.mode("overwrite").parquet(f"{self.path}/sketches")

    def frequencies(self):
        from .operators.stats import Frequencies

        where = f"{self.path}/frequencies"
        if not self.files.exists(where):
            return None
        return Frequencies(self.spark.read.parquet(where), self.binding().table.count())
