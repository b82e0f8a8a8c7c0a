"""python -m termloom.cli INDEX search|complete|eval|make-schema ...: a thin command line over a stored index."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from termloom.operators.context_types import ContextSchema
from termloom.operators.engine import Engine
from termloom.plans.compiler import QueryError
from termloom.sources import commands
from termloom.sources.documents import error_json, read_csv, write_json, write_output


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="termloom")
    p.add_argument("index")
    sub = p.add_subparsers(dest="what", required=True)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--offset", type=int, default=0)
    s.add_argument("--max", type=int, default=20)
    c = sub.add_parser("complete")
    c.add_argument("query")
    c.add_argument("--max", type=int, default=20)
    e = sub.add_parser("eval")
    e.add_argument("file")
    for name in ("make-schema", "make-insert"):
        m = sub.add_parser(name)
        m.add_argument("file")
    v = sub.add_parser("from-csv")
    v.add_argument("file")
    v.add_argument("--out", required=True)
    v.add_argument("--uri", required=True)
    v.add_argument("--index", required=True, help="columns that become contexts, comma-separated")
    v.add_argument("--description", default="", help="columns that become description fields")
    args = p.parse_args(argv)
    if args.what == "make-schema":
        records = json.load(open(args.file, encoding="utf-8"))
        names = sorted({n for r in records for n in r.get("index", {})})
        write_output([{"cmd": "insert-context", "context": n, "schema": ContextSchema().to_json()} for n in names])
        return 0
    if args.what == "make-insert":
        write_output([commands.insert(r) for r in json.load(open(args.file, encoding="utf-8"))])
        return 0
    if args.what == "from-csv":
        columns = lambda text: [c for c in text.split(",") if c]
        write_json(read_csv(SparkSession.builder.getOrCreate(), args.file, args.uri, columns(args.index), columns(args.description)), args.out)
        return 0
    engine = Engine(SparkSession.builder.getOrCreate())
    try:
        if args.what == "eval":
            result = engine.execute(json.load(open(args.file, encoding="utf-8")))
            engine.store(args.index)
        else:
            engine.load(args.index)
            result = engine.search(args.query, args.offset, args.max) if args.what == "search" else engine.completion(args.query, args.max)
    except QueryError as err:
        write_output(error_json(err.code, err.message))
        return 1
    if isinstance(result, dict) and "result" in result:
        result = result | {"result": [r.asDict(True) for r in result["result"].collect()]}
    elif hasattr(result, "collect"):
        result = [r.asDict(True) for r in result.collect()]
    write_output(result)
    return 0


if __name__ == "__main__":
    sys.exit(main())
