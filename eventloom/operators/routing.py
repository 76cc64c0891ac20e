"""Routing chains: ordered rules that send events to stores, compiled to one Column."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MatchAll:
    pass


@dataclass(frozen=True)
class MatchNone:
    pass


@dataclass(frozen=True)
class MatchTag:
    tag: str


@dataclass(frozen=True)
class Store:
    targets: tuple[str, ...]


@dataclass(frozen=True)
class StoreAll:
    pass


@dataclass(frozen=True)
class Drop:
    pass


@dataclass(frozen=True)
class Route:
    name: str
    matches: tuple
    action: object


@dataclass
class RoutingChain:
    """The first route that decides ends processing. Within a route the first statement that decides counts: a true
    one runs the action, a false one stops the chain without it."""

    routes: list[Route] = field(default_factory=list)

    def _checked(self, index: int, top: int) -> int:
        if not 0 <= index < top:
            raise IndexError(f"route {index} of {len(self.routes)}")
        return index

    def append(self, route: Route) -> None:
        self.routes.append(route)

    def insert(self, index: int, route: Route) -> None:
        self.routes.insert(self._checked(index, len(self.routes) + 1), route)

    def replace(self, index: int, route: Route) -> None:
        self.routes[self._checked(index, len(self.routes))] = route

    def delete(self, index: int) -> None:
        del self.routes[self._checked(index, len(self.routes))]

    def flush(self) -> None:
        self.routes.clear()

    def targets(self, tags: Column, stores: list[str]) -> Column:
        """An array of store names (empty: dropped). Unknown targets are ignored."""
        nowhere = F.array().cast("array<string>")

        def action(a) -> Column:
            if isinstance(a, StoreAll):
                return F.array(*map(F.lit, stores)) if stores else nowhere
            known = [t for t in dict.fromkeys(a.targets) if t in stores] if isinstance(a, Store) else []
            return F.array(*map(F.lit, known)) if known else nowhere

        def decided(route: Route) -> Column:
            rules = []
            for m in route.matches:
                if isinstance(m, MatchTag):
                    rules.append(F.when(F.array_contains(tags, m.tag), action(route.action)))
                else:
                    rules.append(action(route.action) if isinstance(m, MatchAll) else nowhere)
            return reduce(F.coalesce, rules) if rules else F.lit(None).cast("array<string>")

        return F.coalesce(*[decided(r) for r in self.routes], nowhere)


def to_json(route: Route) -> dict:
    def match(m):
        return {"matchType": "matches-tag", "tag": m.tag} if isinstance(m, MatchTag) else {"matchType": "matches-all" if isinstance(m, MatchAll) else "matches-none"}

    a = route.action
    action = {"actionType": "store-action", "targets": list(a.targets)} if isinstance(a, Store) else {"actionType": "store-all-action" if isinstance(a, StoreAll) else "drop-action"}
    return {"name": route.name, "matches": [match(m) for m in route.matches], "action": action}


def from_json(found: dict) -> Route:
    """Reads a route; a tag match under either of its names."""

    def match(m):
        kind = m.get("matchType")
        if kind in ("match-tag", "matches-tag"):
            if not isinstance(m.get("tag"), str):
                raise ValueError("a tag match needs a tag")
            return MatchTag(m["tag"])
        if kind not in ("matches-all", "matches-none"):
            raise ValueError(f"unknown matchType {kind!r}")
        return MatchAll() if kind == "matches-all" else MatchNone()

    a = found["action"]
    kind = a.get("actionType")
    if kind == "store-action":
        if not isinstance(a.get("targets"), list) or not all(isinstance(t, str) for t in a["targets"]):
            raise ValueError("a store action needs targets")
        action = Store(tuple(a["targets"]))
    elif kind in ("store-all-action", "drop-action"):
        action = StoreAll() if kind == "store-all-action" else Drop()
    else:
        raise ValueError(f"unknown actionType {kind!r}")
    return Route(found.get("name", ""), tuple(match(m) for m in found["matches"]), action)
