"""Command line: fetch a data set, build an index, ask it.

    python -m lexivane download URL --output FILE
    python -m lexivane index CORPUS.jsonl --output FOLDER
    python -m lexivane search FOLDER QUERY [--ranker bm25|tfidf|boolean] [-k 10]
"""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lexivane", description=__doc__.splitlines()[0])
    commands = out.add_subparsers(dest="command")
    fetch = commands.add_parser("download")
    fetch.add_argument("url")
    fetch.add_argument("--output", required=True)
    build = commands.add_parser("index")
    build.add_argument("corpus")
    build.add_argument("--output", required=True)
    ask = commands.add_parser("search")
    ask.add_argument("folder")
    ask.add_argument("query")
    ask.add_argument("--ranker", choices=("bm25", "tfidf", "boolean"), default="bm25")
    ask.add_argument("-k", type=int, default=10)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command is None:
        parser().print_help()
        return 0
    if args.command == "download":
        from lexivane.sources.readers import download

        print(download(args.url, args.output))
        return 0
    from pyspark.sql import SparkSession

    from lexivane.operators import boolean, index, ranking
    from lexivane.sources.readers import read_corpus

    spark = SparkSession.builder.appName("lexivane").getOrCreate()
    if args.command == "index":
        built = index.store(index.build_index(read_corpus(spark, args.corpus), check=True), args.output)
        print(f"{built.num_docs()} documents")
        return 0
    opened = index.open_index(spark, args.folder)
    if args.ranker == "boolean":
        print("\n".join(boolean.search(opened, args.query)[: max(args.k, 0)]))
        return 0
    ranker = ranking.Bm25(opened) if args.ranker == "bm25" else ranking.TfIdf(opened)
    for doc_id, score in ranker.rank_text(args.query, args.k):
        print(f"{doc_id}\t{score:.6f}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
