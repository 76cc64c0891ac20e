"""The service: sources, stores, routes and searches behind one object."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Binding, Files, Store
from .functions.query import Clock, system_clock
from .functions.values import short_key
from .operators import search
from .operators.encode import keyed_json
from .operators.routing import Route, RoutingChain, from_json, to_json
from .plans.language import QueryError
from .sources.network import Listener
from .types import FieldId


KEPT_VERSIONS = 16


class EngineError(Exception):
    """An operation failed; ``status`` is the HTTP status that stands for it."""

    status = 500


class RetryLater(EngineError):
    status = 503


class BadRequest(EngineError):
    status = 400


class NotFound(EngineError):
    status = 404


@dataclass
class EventSet:
    """A page of a result."""

    fields: dict[str, FieldId]
    events: list[tuple[str, dict]]
    statistics: dict
    finished: bool

    def json(self) -> str:
        fields = {k: [f.type.name, f.name] for k, f in self.fields.items()}
        return json.dumps({"fields": fields, "events": self.events, "stats": self.statistics, "finished": self.finished})


class Result:
    """A query that was made: lazy until its first page, then kept (memory and disk) until closed."""

    def __init__(self, ident: str, frame: DataFrame, fields: list[FieldId], lifetime: float, clock=time.time):
        self.id, self.frame, self.fields, self.lifetime, self.clock = ident, frame, fields, lifetime, clock
        self.created, self.state, self.sent, self.total, self.runtime, self.finished_at = clock(), "created", 0, None, 0.0, None
        self.kept: DataFrame | None = None

    def _read(self) -> DataFrame:
        if self.state == "closed":
            raise NotFound(f"query {self.id} is closed")
        if self.kept is None:
            began = self.clock()
            at = F.monotonically_increasing_id().alias("__at")
            self.kept = self.frame.select("*", at).persist()  # partitions follow the order of the result
            self.total = self.kept.count()
            self.runtime, self.state, self.finished_at = self.clock() - began, "finished", self.clock()
        return self.kept

    def events(self, offset: int = 0, limit: int = 100) -> EventSet:
        """A page of at most ``limit`` events."""
        if offset < 0 or limit < 0:
            raise BadRequest("offset and limit are not negative")
        rows = self._read().orderBy("__at").offset(offset).limit(limit).select("event_id", "__json").collect()
        self.sent += len(rows)
        names = {short_key(i): f for i, f in enumerate(self.fields)}
        return EventSet(names, [(str(r[0]), json.loads(r[1])) for r in rows], self.describe(), offset + len(rows) >= self.total)

    def dataframe(self) -> DataFrame:
        return self.frame.drop("__json")

    def describe(self) -> dict:
        return {"id": self.id, "created": self.created, "state": self.state, "numRead": self.total or 0, "numSent": self.sent, "runtime": self.runtime}

    @property
    def expired(self) -> bool:
        return self.finished_at is not None and self.clock() - self.finished_at > self.lifetime

    def close(self) -> None:
        if self.kept is not None:
            self.kept.unpersist()
            self.kept = None
        self.state = "closed"


@dataclass
class Catalog:
    """Named listeners, stores and routes; each version is a file of its own."""

    version: int = 0
    sources: dict[str, Listener] = field(default_factory=dict)
    stores: dict[str, str] = field(default_factory=dict)
    routes: list[Route] = field(default_factory=list)


class Sources:
    def __init__(self, engine: Engine):
        self.engine = engine

    def list(self) -> list[Listener]:
        return list(self.engine.catalog.sources.values())

    def get(self, name: str) -> Listener:
        if name not in self.engine.catalog.sources:
            raise NotFound(f"no source {name!r}")
        return self.engine.catalog.sources[name]

    def create(self, **settings) -> Listener:
        try:
            made = Listener.of(settings)
        except (TypeError, ValueError) as error:
            raise BadRequest(str(error)) from None
        self.engine.refresh()
        if made.name in self.engine.catalog.sources:
            raise BadRequest(f"source {made.name!r} exists")
        self.engine.catalog.sources[made.name] = made
        self.engine.save()
        return made

    def delete(self, name: str) -> None:
        self.get(name)
        del self.engine.catalog.sources[name]
        self.engine.save()

    def stream(self, name: str) -> DataFrame:
        """The source's chunks (conn_id, seq, data) as a stream."""
        from .sources.network import SyslogTcp, SyslogUdp

        made = self.get(name)
        for kind in (SyslogTcp, SyslogUdp):
            self.engine.spark.dataSource.register(kind)
        options = {k: str(v) for k, v in (("host", made.host), ("port", made.port), ("idle_timeout", made.idle_timeout), ("max_connections", made.max_connections)) if v is not None}
        return self.engine.spark.readStream.format(made.kind).options(**options).load()


class Stores:
    def __init__(self, engine: Engine):
        self.engine, self.open = engine, {}

    def list(self) -> list[str]:
        return sorted(self.engine.catalog.stores)

    def get(self, name: str) -> Store:
        if name not in self.engine.catalog.stores:
            raise NotFound(f"no store {name!r}")
        if name not in self.open:
            self.open[name] = Store(self.engine.spark, name, self.engine.catalog.stores[name])
        return self.open[name]

    def create(self, name: str, path: str | None = None) -> Store:
        if not name or "/" in name:
            raise BadRequest(f"bad store name {name!r}")
        self.engine.refresh()
        if name in self.engine.catalog.stores:
            raise BadRequest(f"store {name!r} exists")
        self.engine.catalog.stores[name] = path or f"{self.engine.path}/stores/{name}"
        self.engine.save()
        return self.get(name)

    def delete(self, name: str) -> None:
        """Takes the store out of the catalog; its files stay."""
        self.get(name)
        del self.engine.catalog.stores[name], self.open[name]
        self.engine.save()

    def attach(self, name: str, binding: Binding, arrival: Sequence = ()) -> None:
        """Lets any table act as a store for searches of this engine."""
        self.engine.bound[name] = (binding, tuple(arrival))


class Routes:
    """Edits the chain; every edit is saved under a new version."""

    def __init__(self, engine: Engine):
        self.engine = engine

    @property
    def chain(self) -> RoutingChain:
        return RoutingChain(self.engine.catalog.routes)

    def list(self) -> list[Route]:
        return list(self.engine.catalog.routes)

    def _edit(self, change, version: int | None) -> None:
        self.engine.refresh()
        if version is not None and version != self.engine.catalog.version:
            raise RetryLater(f"the routes are at version {self.engine.catalog.version}")
        try:
            change(self.chain)
        except IndexError as error:
            raise BadRequest(str(error)) from None
        self.engine.save()

    def append(self, route: Route, version: int | None = None) -> None:
        self._edit(lambda c: c.append(route), version)

    def insert(self, index: int, route: Route, version: int | None = None) -> None:
        self._edit(lambda c: c.insert(index, route), version)

    def replace(self, index: int, route: Route, version: int | None = None) -> None:
        self._edit(lambda c: c.replace(index, route), version)

    def delete(self, index: int, version: int | None = None) -> None:
        self._edit(lambda c: c.delete(index), version)

    def flush(self, version: int | None = None) -> None:
        self._edit(lambda c: c.flush(), version)


class Engine:
    def __init__(self, spark: SparkSession, path: str, *, clock: Clock = system_clock, lifetime: float = 30.0):
        self.spark, self.path, self.clock, self.lifetime = spark, path.rstrip("/"), clock, lifetime
        self.files, self.bound, self.results = Files(spark), {}, {}
        self.catalog = self._load()
        self.sources, self.stores, self.routes = Sources(self), Stores(self), Routes(self)

    @property
    def _folder(self) -> str:
        return f"{self.path}/catalog"

    def _load(self) -> Catalog:
        versions = [n for n in self.files.names(self._folder) if n.endswith(".json") and n[:-5].isdigit()]
        if not versions:
            return Catalog()
        found = json.loads(self.files.read(f"{self._folder}/{max(versions)}"))
        return Catalog(found["version"], {k: Listener.of(v) for k, v in found["sources"].items()}, found["stores"], [from_json(r) for r in found["routes"]])

    def refresh(self) -> None:
        """Takes up what other engines have saved."""
        self.catalog = self._load()

    def save(self) -> None:
        """Saves the catalog as the next version, unless another engine was first."""
        c = self.catalog
        c.version += 1
        text = json.dumps({"version": c.version, "sources": {k: asdict(v) for k, v in c.sources.items()}, "stores": c.stores, "routes": [to_json(r) for r in c.routes]})
        if not self.files.write(f"{self._folder}/{c.version:012d}.json", text, replace=False):
            self.refresh()
            raise RetryLater(f"the catalog is at version {self.catalog.version}")
        if c.version > KEPT_VERSIONS:
            self.files.delete(f"{self._folder}/{c.version - KEPT_VERSIONS:012d}.json")

    def search(self, query: str, store: str, fields: Sequence[str] | None = None, sort_by: Sequence[str] = (), limit: int | None = None, reverse: bool = False, *, index: bool | None = None, top: bool = False, default_field: str = "message") -> Result:
        """Makes a query. ``index``: use the postings (by default: never for attached tables, and for stores only if
        the query names text or hostname terms and statistics say that they are rare)."""
        self.expire()
        postings = stats = None
        arrival: tuple = ()
        if store in self.bound:
            binding, arrival = self.bound[store]
        else:
            kept = self.stores.get(store)
            binding = kept.binding()
            if index is not False:
                postings, stats = self._postings(kept, binding, query, default_field, index)
        try:
            chosen = sorted(binding.fields, key=str) if fields is None else [FieldId.of(f) for f in fields]
            known = [f for f in chosen if binding.knows(f)]
            body = keyed_json(binding, known) if known else F.lit("{}")
            frame = search.select(binding, query, known, sort_by, limit, reverse, top=top, arrival=arrival, default_field=default_field, clock=self.clock, postings=postings, stats=stats, keep=[body.alias("__json")])
        except (QueryError, ValueError) as error:
            raise BadRequest(str(error)) from None
        result = Result(uuid.uuid4().hex, frame, known, self.lifetime)
        self.results[result.id] = result
        return result

    def _postings(self, store: Store, binding: Binding, query: str, default_field: str, index: bool | None):
        try:
            node = search.matcher(query, binding, default_field, self.clock)
        except ValueError as error:
            raise BadRequest(str(error)) from None
        stats = store.frequencies()
        if index:
            return store.postings(), stats
        if stats is None:
            return None, None
        stats.load(search.needed(node))
        from .plans.matchers import cost

        selective = cost(node, stats) * 100 < stats.events and any(pair[1] is not None for pair in search.needed(node))
        return (store.postings() if selective else None), stats

    def explain(self, query: str, store: str, default_field: str = "message") -> str:
        binding = self.bound[store][0] if store in self.bound else self.stores.get(store).binding()
        stats = None if store in self.bound else self.stores.get(store).frequencies()
        return search.explained(binding, query, default_field, stats)

    def query(self, ident: str) -> Result:
        self.expire()
        if ident not in self.results:
            raise NotFound(f"no query {ident}")
        return self.results[ident]

    def delete_query(self, ident: str) -> None:
        self.query(ident).close()
        del self.results[ident]

    def expire(self) -> None:
        """Closes results that were read more than ``lifetime`` seconds ago."""
        for ident in [k for k, r in self.results.items() if r.expired]:
            self.results.pop(ident).close()

    def ingest(self, source: str, checkpoint: str, **trigger):
        """A running query from a source through the routes into the stores."""
        from .streaming.ingest import start

        made = self.sources.get(source)
        idle = {} if made.idle_timeout is None else {"idle_ms": int(made.idle_timeout * 1000)}
        return start(self.sources.stream(source), self.routes.chain, {n: self.stores.get(n) for n in self.stores.list()}, checkpoint, framed=made.kind == "syslog_tcp", limit=made.max_message_size, **idle, **trigger)
