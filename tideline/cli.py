"""Command line: `python -m tideline.cli list` names the queries; `run NAME --data DIR` prints one's rows as CSV or writes them as Parquet."""

from __future__ import annotations

import argparse
import csv
import importlib
import sys
from collections.abc import Callable

from tideline.session import local_session, ship

MODULES = ("banks", "dealt", "evaluation", "features", "joins", "learning", "models", "more", "payload", "runs")


def catalogue() -> dict[str, Callable]:
    """Every query of the general part by name."""
    registry = importlib.import_module("tideline.queries.registry")
    found = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"tideline.queries.{name}"), "QUERIES", {})
    return {**registry.QUERIES, **found}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tideline")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name")
    run.add_argument("--data", required=True, help="folder of the Parquet tables")
    run.add_argument("--out", help="write Parquet here instead of CSV to the terminal")
    run.add_argument("--limit", type=int, default=1000, help="rows of the printed CSV")
    args = parser.parse_args(argv)
    known = catalogue()
    if args.command == "list":
        print("\n".join(sorted(known)))
        return 0
    if args.name not in known:
        print(f"no query {args.name}", file=sys.stderr)
        return 2
    spark = local_session()
    ship(spark)
    result = known[args.name](spark, args.data)
    if args.out:
        result.write.mode("errorifexists").parquet(args.out)
        return 0
    out = csv.writer(sys.stdout)
    out.writerow(result.columns)
    for row in result.limit(args.limit).toLocalIterator():
        out.writerow(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
