"""Streaming ingest: chunks of connections to typed events, routed into stores.

State is kept for each connection: bytes of an unfinished frame, the short names it declared and its tags. A connection
without data for ``idle`` is forgotten. The same functions run over a static table, which is how the two are compared.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..catalog import Store
from ..operators.routing import RoutingChain
from ..sources import syslog
from ..sources.framing import FramingError, datagram, decode_frames
from ..types import FieldId, FieldType

FRAMES = "conn_id string, seq long, n long, frame string, schema map<string,string>, tags array<string>"
_STATE = "leftover binary, sticky string"
#: Rows and characters that Python holds of a table at a time; partitions at least, so that few connections share one.
_ROWS, _CHARS, _PARTS = 4096, 4_000_000, 64
_ELEMENT = re.compile(r'\[(schema|source)@42785((?: +[^\s="\]]+="(?:[^"\\\]]|\\.)*")*) *\]')
_PARAM = re.compile(r'([^\s="\]]+)="((?:[^"\\\]]|\\.)*)"')


def _declare(frame: str, names: dict, tags: list) -> tuple[dict, list]:
    """The sticky state after a frame: declarations merge, tags are replaced."""
    for element, params in _ELEMENT.findall(frame):
        pairs = _PARAM.findall(params)
        if element == "schema":
            if not dict(pairs).items() <= names.items():  # most messages repeat what is known: they share one map
                names = names | dict(pairs)
        else:
            tags = list(dict.fromkeys(v for k, v in pairs if k == "tag"))
    return names, tags


class _Connection:
    """What is remembered of a connection between its chunks."""

    def __init__(self, leftover: bytes = b"", sticky: dict | None = None):
        sticky = sticky or {}
        self.leftover, self.names, self.tags, self.broken = leftover, sticky.get("names", {}), sticky.get("tags", []), sticky.get("broken", False)

    def take(self, data: bytes | None, framed: bool, limit: int) -> Iterator[tuple[str, dict, list]]:
        """(frame, names, tags) of the frames that the next chunk completes."""
        if self.broken or data is None:
            return
        try:
            frames, self.leftover = decode_frames(self.leftover, bytes(data), limit) if framed else (datagram(bytes(data)), b"")
        except FramingError:
            frames, self.leftover, self.broken = [], b"", True  # nothing after a bad frame can be trusted
        for raw in frames:
            frame = raw.decode("utf-8", "replace")
            self.names, self.tags = _declare(frame, self.names, self.tags)
            yield frame, self.names, self.tags

    def state(self) -> tuple[bytes, dict]:
        return self.leftover, {"names": self.names, "tags": self.tags, "broken": self.broken}


def advance(leftover: bytes, sticky: dict, chunks: pd.DataFrame, framed: bool, limit: int) -> tuple[bytes, dict, list[tuple]]:
    """One connection's chunks, in order of ``seq``: (leftover, state, rows of FRAMES without the connection)."""
    conn = _Connection(leftover, sticky)
    rows = [(seq, n, *found) for seq, data in chunks.sort_values("seq")[["seq", "data"]].itertuples(index=False) for n, found in enumerate(conn.take(data, framed, limit))]
    return *conn.state(), rows


def _output(conn: str, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(conn, *r) for r in rows], columns=["conn_id", "seq", "n", "frame", "schema", "tags"])


def _shared(values: list, kind: pa.DataType) -> pa.Array:
    """An array of values, of which those equal to the one before are built once."""
    own, at = [], []
    for v in values:
        if not own or (v is not own[-1] and v != own[-1]):
            own.append(v)
        at.append(len(own) - 1)
    return pa.array([list(v.items()) if isinstance(v, dict) else v for v in own], kind).take(pa.array(at, pa.int32()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    conn, seq, n, frame, names, tags = zip(*rows, strict=True)
    columns = [pa.array(conn, pa.string()), pa.array(seq, pa.int64()), pa.array(n, pa.int64()), pa.array(frame, pa.string()), _shared(names, pa.map_(pa.string(), pa.string())), _shared(tags, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["conn_id", "seq", "n", "frame", "schema", "tags"])


def _in_order(framed: bool, limit: int):
    """FRAMES of rows ordered by connection and ``seq``: holds a part of the chunks, and the state of one connection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, conn, rows, size = None, None, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                for own, seq, data in zip(*[c.to_pylist() for c in batch.slice(at, _ROWS).columns], strict=True):
                    if conn is None or own != key:
                        key, conn = own, _Connection()
                    for n, found in enumerate(conn.take(data, framed, limit)):
                        rows.append((own, seq, n, *found))
                        size += len(found[0])
                        if len(rows) >= _ROWS or size >= _CHARS:
                            yield _batch(rows)
                            rows, size = [], 0
        if rows:
            yield _batch(rows)

    return run


def frames(chunks: DataFrame, framed: bool = True, limit: int = 1_000_000, idle_ms: int | None = 600_000) -> DataFrame:
    """FRAMES of a stream or table ``(conn_id, seq, data)``.

    A table is sorted by connection and ``seq`` (Spark's sort, on disk where memory ends) and read on in that order, so
    that Python never holds a whole connection. ``idle_ms`` None keeps connections for ever: a timeout makes Spark run
    batches without data, so a query that is to end with its input must have none.
    """
    if not chunks.isStreaming:
        parts = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), _PARTS)
        ordered = chunks.select("conn_id", "seq", "data").repartition(parts, "conn_id").sortWithinPartitions("conn_id", F.asc_nulls_last("seq"))
        return ordered.mapInArrow(_in_order(framed, limit), FRAMES)

    def step(key, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        leftover, sticky = state.get if state.exists else (b"", "{}")
        conn = _Connection(bytes(leftover or b""), json.loads(sticky))
        rows, size = [], 0
        for seq, data in pd.concat(list(groups)).sort_values("seq")[["seq", "data"]].itertuples(index=False):
            for n, found in enumerate(conn.take(data, framed, limit)):
                rows.append((seq, n, *found))
                size += len(found[0])
                if len(rows) >= _ROWS or size >= _CHARS:
                    yield _output(key[0], rows)
                    rows, size = [], 0
        leftover, sticky = conn.state()
        state.update((leftover, json.dumps(sticky)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield _output(key[0], rows)

    return chunks.groupBy("conn_id").applyInPandasWithState(step, FRAMES, _STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def sticky_tags(messages: DataFrame) -> DataFrame:
    """Batch form of sticky tags over parsed messages ``(conn_id, seq, sd)``: the last declaration up to each row."""
    upto = Window.partitionBy("conn_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("tags", F.coalesce(F.last(syslog.tags(F.col("sd")), ignorenulls=True).over(upto), F.array().cast("array<string>")))


def events(framed: DataFrame) -> DataFrame:
    """Typed events of FRAMES: event_id, tags, the standard fields and a map ``<type>_values`` for each type.

    Messages that don't parse are dropped. The id derives from the place in the stream, so a retried batch makes the
    same events.
    """
    seen = syslog.parse(framed).observe("ingest", F.count(F.lit(1)).alias("frames"), F.count_if(~F.col("valid")).alias("unparsable"))
    parsed = seen.where("valid")
    declared = F.coalesce("schema", F.create_map().cast("map<string,string>"))
    typed = [c.alias(f"{k.value}_values") for k, c in syslog.typed_values(F.col("sd"), declared).items()]
    ident = F.sha2(F.concat_ws("/", "conn_id", "seq", "n", "frame"), 256).substr(1, 32)
    return parsed.select(ident.alias("event_id"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), *syslog.STANDARD, *typed)


def widened(batch: DataFrame) -> tuple[DataFrame, list[FieldId]]:
    """A batch of :func:`events` with a column ``type:name`` for each field present (field names are few)."""
    fields = [FieldId(k, n) for n, k in syslog.STANDARD.items()]
    columns = [F.col(f.name).alias(str(f)) for f in fields]
    maps = [F.transform(F.map_keys(f"{k.value}_values"), lambda n: n).alias(k.value) for k in FieldType]
    named = [F.collect_set("name").alias("names")]
    for k, m in zip(FieldType, maps, strict=True):
        names = batch.select(F.explode(m).alias("name")).agg(*named).first()["names"]
        for name in sorted(names):
            field = FieldId(k, name)
            value = F.element_at(f"{k.value}_values", name)
            if field in fields:
                at = fields.index(field)
                columns[at] = F.coalesce(value, columns[at]).alias(str(field))
            else:
                fields.append(field)
                columns.append(value.alias(str(field)))
    return batch.select("event_id", "tags", *columns), fields


def deliver(batch: DataFrame, chain: RoutingChain, stores: dict[str, Store], name: str | None = None) -> None:
    """Routes a batch of events and appends them to their stores, growing the catalogs. A batch that is delivered again
    under its name replaces what it wrote."""
    batch = batch.persist()
    try:
        wide, fields = widened(batch)
        routed = wide.withColumn("__to", chain.targets(F.col("tags"), list(stores))).persist()
        for target, store in stores.items():
            own = routed.where(F.array_contains("__to", target))
            if not own.isEmpty():
                store.append(own.drop("__to", "tags"), fields, batch=name)
        routed.unpersist()
    finally:
        batch.unpersist()


def start(stream: DataFrame, chain: RoutingChain, stores: dict[str, Store], checkpoint: str, *, framed: bool = True, limit: int = 1_000_000, idle_ms: int = 600_000, **trigger):
    """A running query that ingests ``stream(conn_id, seq, data)``. A batch that is retried replaces itself in the stores,
    so each event is there once. The query's progress holds the metrics ``ingest``: frames, unparsable ones.

    ``framed``: octet-counted frames, else each chunk is a datagram; ``limit``: the largest message; ``idle_ms``: how long
    a silent connection is remembered.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    ends = bool(trigger.get("availableNow") or trigger.get("once"))
    ready = events(frames(stream, framed, limit, None if ends else idle_ms))
    writer = ready.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: deliver(batch, chain, stores, f"q{run}-{n}"))
    return (writer.trigger(**trigger) if trigger else writer).start()


SCHEMA = T.StructType([T.StructField("conn_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("data", T.BinaryType())])
