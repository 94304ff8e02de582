"""Command line: ingest, query, serve."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .plans.engine import Engine
from .surface import listing, mode_of


def session() -> SparkSession:
    spark = SparkSession.builder.appName("docloom").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docloom")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest", help="add a file or a folder to an index")
    a.add_argument("--index-path", required=True)
    a.add_argument("--content-path", required=True)
    a.add_argument("--mode", choices=["append", "replace"], default="append")
    a = sub.add_parser("query", help="search an index")
    a.add_argument("--index-path", required=True)
    a.add_argument("--query", required=True)
    a.add_argument("--max-results", type=int, default=10)
    a.add_argument("--sourceIds", nargs="*", default=None)
    a.add_argument("--search-mode", default="bm25")
    a = sub.add_parser("serve", help="answer tool calls on stdin and stdout")
    a.add_argument("--index-path", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "serve":
            from .serve import Server

            if not os.path.isdir(args.index_path):
                raise NotADirectoryError(f"Index directory not found: {args.index_path}")
            Server(Engine(spark or session(), args.index_path)).run(sys.stdin, sys.stdout)
            return 0
        if args.command == "ingest":
            if not os.path.exists(args.content_path):
                raise FileNotFoundError(f"Path not found: {args.content_path}")
            engine = Engine(spark or session(), args.index_path)
            if os.path.isdir(args.content_path):
                s = engine.ingest_folder(args.content_path, mode=args.mode)
                if not s.found:
                    print(f"No supported files found in {args.content_path}")
                for r in s.outcomes.orderBy("path").toLocalIterator() if s.outcomes else ():  # a part at a time
                    print({"indexed": f"Ingested {r.path} ({r.chunks} chunks)", "empty": f"Skipped (no content): {r.path}"}.get(r.outcome, f"Error ingesting {r.path}: {r.error}"))
                print(f"Indexed {s.chunks} chunks from {s.found} files")
            else:
                print(f"Indexed {engine.ingest_file(args.content_path, mode=args.mode)} chunks")
            return 0
        mode = mode_of(args.search_mode)
        rows = Engine(spark or session(), args.index_path).search(args.query, mode, args.max_results, args.sourceIds).collect()
        print(listing(rows, mode.value))
        return 0
    except Exception as e:  # noqa: BLE001 - the command line reports every error alike
        print(f"Error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
