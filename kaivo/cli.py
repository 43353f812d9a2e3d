"""python -m kaivo.cli eval|ask|queries: runs the grid and its gate, one question, or lists queries. The exit code is the gate."""

from __future__ import annotations

import argparse
import sys
import uuid

from kaivo.functions import text as T
from kaivo.operators import evaluate, index, rank
from kaivo.session import local, shared_dir
from kaivo.sources import records


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kaivo")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("eval")
    e.add_argument("data")
    e.add_argument("--k", type=int, default=rank.K)
    gate = e.add_mutually_exclusive_group()
    gate.add_argument("--baseline")
    gate.add_argument("--write-baseline")
    a = sub.add_parser("ask")
    a.add_argument("data")
    a.add_argument("question")
    a.add_argument("authority")
    sub.add_parser("queries")
    args = p.parse_args(argv)
    if args.command == "queries":
        from kaivo.plans import catalog

        print("\n".join(sorted(catalog.queries())))
        return 0
    spark = local()
    docs = spark.read.parquet(f"{args.data}/documents.parquet")
    if args.command == "ask":
        try:
            rank.ask(docs, args.question, args.authority).show(truncate=False)
        except ValueError as x:
            print(x, file=sys.stderr)
            return 1
        return 0
    bench = spark.read.parquet(f"{args.data}/benchmark.parquet")
    ix = index.store(docs, f"{shared_dir(spark)}/kaivo-index/{uuid.uuid4().hex}")
    need = evaluate.population(ix, bench)
    found = evaluate.metrics(evaluate.outcomes(ix, bench, need, evaluate.hits(ix, bench, T.ANALYSERS, k=args.k), T.ANALYSERS), *evaluate.CELL).cache()
    found.orderBy(*evaluate.CELL).show(100, truncate=False)
    if args.write_baseline:
        found.select(*(c.split()[0] for c in records.BASELINE.split(", "))).coalesce(1).write.mode("overwrite").json(args.write_baseline)
    if args.baseline:
        worse = evaluate.regressions(records.read_baseline(spark, args.baseline), found)
        problems = worse.collect()
        for r in problems:
            print(*r, file=sys.stderr)
        return int(bool(problems))
    return 0


if __name__ == "__main__":
    sys.exit(main())
