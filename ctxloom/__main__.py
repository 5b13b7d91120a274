"""Command line: ingest, search, eval, status, projects, delete."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ctxloom.engine import ContextEngine
from ctxloom.operators.pack import render
from ctxloom.operators.usage import report
from ctxloom.plans.evaluate import quality, run_golden
from ctxloom.sources.ignore import IgnoreRules, Layer
from ctxloom.sources.repo import load_golden


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ctxloom")
    p.add_argument("--root", required=True, help="where indexes are kept")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("project")
    a.add_argument("folder")
    a.add_argument("--full", action="store_true")
    a.add_argument("--ignore", action="append", default=[])
    a = sub.add_parser("search")
    a.add_argument("project")
    a.add_argument("query", nargs="+")
    a.add_argument("--max-tokens", type=int, default=10_000)
    a.add_argument("--json", action="store_true")
    a = sub.add_parser("eval")
    a.add_argument("project")
    a.add_argument("golden", help="folder of JSON lines with cases")
    a.add_argument("--max-tokens", type=int, default=10_000)
    a.add_argument("--top-k", type=int, default=10)
    for name in ("status", "delete"):
        sub.add_parser(name).add_argument("project")
    sub.add_parser("projects")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("ctxloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = ContextEngine(spark, args.root)
    if args.what == "ingest":
        print(json.dumps(engine.ingest_repo(args.project, args.folder, IgnoreRules(Layer(args.ignore)), args.full).__dict__))
    elif args.what == "search":
        queries = spark.createDataFrame([(str(i), args.project, q) for i, q in enumerate(args.query)], "query_id string, project_id string, text string")
        for r in engine.search(queries, max_tokens=args.max_tokens).orderBy("query_id").collect():
            print(r.pack if args.json else render(json.loads(r.pack)))
    elif args.what == "eval":
        cases, bad = load_golden(spark, args.golden)
        results = run_golden(engine.index([args.project]), cases, args.project, engine.provider, max_tokens=args.max_tokens, top_k=args.top_k).cache()
        print(report(quality(results).collect(), "all cases"))
        print(report(quality(results, ["category"]).orderBy("category").collect(), "by category"))
        negative = results.where("passed is not null").agg(F.count(F.lit(1)), F.count_if("passed")).first()
        print(f"cases without expectations passed: {negative[1]} of {negative[0]}; lines that are no cases: {bad.count()}")
    elif args.what == "status":
        print(json.dumps(engine.status(args.project), default=str))
    elif args.what == "delete":
        engine.delete_project(args.project)
    else:
        print("\n".join(engine.list_projects()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
