"""``python -m throng.cli``: build an index of comments and ask it."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import functions as F

from throng.operators import evaluate, search
from throng.plans.answers import Answer, Comments
from throng.session import local_session
from throng.sources import records


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="throng")
    p.add_argument("--index", default="index")
    p.add_argument("--json", action="store_true")
    p.add_argument("--embedder", default="auto", help="a registered embedder")
    p.add_argument("--llm", default="extractive", help="a registered function that puts evidence into words")
    sub = p.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="read a CSV file and save an index")
    build.add_argument("--csv")
    build.add_argument("--export-csv")
    build.add_argument("--limit", type=int, help="keep the first so many comments")
    ask = sub.add_parser("ask", help="answer a question")
    ask.add_argument("question")
    sub.add_parser("overview", help="summarise the comments")
    sub.add_parser("eval", help="score exact answers and the nearest-text baseline")
    sub.add_parser("repl", help="answer questions until an empty line")
    return p


def show(answer: Answer, as_json: bool) -> None:
    if as_json:
        print(json.dumps(answer.to_dict(), ensure_ascii=False, default=str))
        return
    print(answer.text)
    print(f"({answer.kind}, coverage {answer.coverage:.1%}, cited {', '.join(answer.citations) or 'none'})")
    for w in answer.warnings:
        print(f"warning: {w}")


def run(args: argparse.Namespace) -> None:
    spark = local_session()
    if args.command == "build":
        if not args.csv:
            raise SystemExit("build needs --csv")
        comments = records.from_csv(spark, args.csv, time.time())
        if args.limit is not None:
            if args.limit < 1:
                raise ValueError("--limit must be positive")
            comments = comments.where(F.substring("cid", 2, 30).try_cast("long") < args.limit)
        embedder = search.get_embedder(args.embedder)
        records.save(comments, args.index, embedder.dim, embedder.name)
        if args.export_csv:
            records.to_csv(comments, args.export_csv)
        print(f"{comments.count()} comments saved to {args.index}")
        return
    try:
        corpus = Comments.load(spark, args.index, embedder=args.embedder, complete=args.llm)
    except FileNotFoundError as why:
        raise FileNotFoundError(f"{why}; make one with: throng build --csv FILE") from why
    if args.command == "ask":
        show(corpus.ask(args.question), args.json)
    elif args.command == "overview":
        print(json.dumps(corpus.overview(), ensure_ascii=False, default=str, indent=None if args.json else 2))
    elif args.command == "eval":
        cases = evaluate.exact_cases(corpus.table)
        for name, answer in (("proportions", lambda q: corpus.ask(q).text), ("nearest texts", lambda q: evaluate.nearest_texts(corpus.table, q))):
            right, total, missed = evaluate.accuracy(cases, answer)
            print(json.dumps({"system": name, "correct": right, "total": total, "missed": missed}) if args.json else f"{name}: {right}/{total}, missed: {', '.join(missed) or 'none'}")
    else:
        while line := sys.stdin.readline().strip():
            if line in ("exit", "quit"):
                break
            show(corpus.ask(line), args.json)


def main(argv: list[str] | None = None) -> int:
    """0 when all went well, 1 for input that can't be used, 130 when interrupted."""
    try:
        run(parser().parse_args(argv))
    except (ValueError, FileNotFoundError, ImportError) as why:
        print(f"error: {why}", file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130
    return 0


if __name__ == "__main__":
    sys.exit(main())
