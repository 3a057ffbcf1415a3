"""Command line: python -m mnemospark --store PATH ingest|recall|ask|remember|reinforce|forget|status|watch|serve ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from mnemospark.memory import Memory, respond


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="mnemospark")
    out.add_argument("--store", required=True)
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("ingest", "watch"):
        p = sub.add_parser(name)
        p.add_argument("paths", nargs="+")
        p.add_argument("--force", action="store_true")
    for name in ("recall", "ask"):
        p = sub.add_parser(name)
        p.add_argument("query")
        p.add_argument("--limit", type=float)
        p.add_argument("--since")
        p.add_argument("--until")
        p.add_argument("--json", action="store_true")
    p = sub.add_parser("remember")
    p.add_argument("text")
    p.add_argument("--source", default="api")
    p.add_argument("--date")
    p = sub.add_parser("reinforce")
    p.add_argument("query")
    p.add_argument("source")
    sub.add_parser("forget").add_argument("needle")
    sub.add_parser("status")
    sub.add_parser("serve", help="JSON-RPC, a request a line, from standard input to standard output")
    return out


def run(memory: Memory, args: argparse.Namespace) -> None:
    window = {k: getattr(args, k) for k in ("since", "until") if getattr(args, k, None)}
    if args.command == "ingest":
        print(json.dumps(memory.ingest(args.paths, args.force)))
    elif args.command == "recall":
        print(memory.to_json(args.query, limit=args.limit, **window) if args.json else memory.passages(args.query, args.limit or 8, **window))
    elif args.command == "ask":
        print(memory.ask(args.query, args.limit or 6, **window))
    elif args.command == "remember":
        print(json.dumps(memory.remember(args.text, args.source, args.date)))
    elif args.command == "reinforce":
        print(json.dumps(memory.reinforce(args.query, args.source)))
    elif args.command == "forget":
        print(json.dumps({"removed": memory.forget(args.needle)}))
    elif args.command == "status":
        print(json.dumps(memory.status()))
    elif args.command == "watch":
        memory.watch(args.paths).awaitTermination()
    else:
        for line in sys.stdin:
            if line.strip() and (answer := respond(memory, line)) is not None:
                print(json.dumps(answer, default=str), flush=True)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run(Memory(spark, args.store), args)


if __name__ == "__main__":
    main()
