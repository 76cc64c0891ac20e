"""``python -m eventloom.cli --path DIR --store NAME [options] QUERY``: searches a store and prints JSON lines."""

from __future__ import annotations

import argparse
import json
import sys


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("query")
    parser.add_argument("--path", required=True, help="the engine's directory")
    parser.add_argument("--store", required=True)
    parser.add_argument("--fields", help="type:name, separated by commas")
    parser.add_argument("--sort-by", help="type:name, separated by commas")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--reverse", action="store_true")
    parser.add_argument("--explain", action="store_true")
    given = parser.parse_args(args)

    from pyspark.sql import SparkSession

    from .engine import Engine, EngineError

    engine = Engine(SparkSession.builder.getOrCreate(), given.path)
    listed = lambda text: [x for x in (text or "").split(",") if x]
    try:
        if given.explain:
            sys.stdout.write(engine.explain(given.query, given.store))
            return 0
        result = engine.search(given.query, given.store, listed(given.fields) or None, listed(given.sort_by), given.limit, given.reverse)
        at, finished = 0, False
        while not finished:
            page = result.events(at, 1000)
            names = {k: str(f) for k, f in page.fields.items()}
            for ident, values in page.events:
                print(json.dumps({"id": ident} | {names[k]: v for k, v in values.items()}))
            at, finished = at + len(page.events), page.finished
        return 0
    except EngineError as error:
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
