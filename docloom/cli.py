"""python -m docloom: run, inspect, graph, report, plan, ask, eval, cache, init. Exit codes: 0 done, 1 nothing to do, 2 error or no answer."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from docloom import config as settings
from docloom.model.client import Http, Offline
from docloom.session import session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docloom", description="Document collections to fine-tuning datasets on Spark.")
    top.add_argument("--master", default="local[*]")
    top.add_argument("--config")
    top.add_argument("--url", help="chat endpoint; without it the offline stand-in answers")
    top.add_argument("--model", default="")
    top.add_argument("--dialect", default="openai", choices=("openai", "anthropic", "ollama"))
    sub = top.add_subparsers(dest="command", required=True)
    for name, arguments in {"run": ("inputs", "out"), "inspect": ("inputs",), "graph": ("inputs",), "report": ("dataset",), "plan": ("inputs",), "ask": ("corpus", "question"), "eval": ("dataset",), "cache": ("folder",), "init": ("file",)}.items():
        p = sub.add_parser(name)
        for a in arguments:
            p.add_argument(a)
        if name == "cache":
            p.add_argument("--clear", action="store_true")
    return top


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    if args.command == "init":
        with open(args.file, "w", encoding="utf-8") as file:
            file.write(settings.dump(settings.Config()) + "\n")
        return 0
    try:
        chosen = settings.load(args.config)
    except (OSError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    backend = Http(args.url, args.model, dialect=args.dialect) if args.url else Offline()
    spark = session(args.master)
    spark.sparkContext.setLogLevel("ERROR")
    from docloom.operators import audit, evaluate, graph
    from docloom.pipeline import Pipeline, chunks_of
    from docloom.sources import files

    try:
        if args.command == "run":
            report = Pipeline(spark, chosen, backend).run(args.inputs, args.out)
            print(json.dumps(report, indent=2, ensure_ascii=False))
            return 0 if report["final"] else 1
        if args.command in ("inspect", "graph", "plan"):
            nodes, skipped = files.read_documents(spark, args.inputs)
            nodes = nodes.cache()
            if nodes.isEmpty():
                for r in skipped.limit(20).collect():
                    print(f"skipped {r['path']}: {r['reason']}", file=sys.stderr)
                return 1
            if args.command == "inspect":
                nodes.groupBy("doc_id", "kind").count().orderBy("doc_id", "kind").show(200, False)
                skipped.show(50, False)
            elif args.command == "graph":
                found, known, edges = graph.build(chunks_of(nodes))
                known.orderBy(F.desc("chunks"), "key").show(40, False)
                graph.bridging_pairs(found, known, edges).show(20, False)
            else:
                audit.cost_plan(chunks_of(nodes)).orderBy("stage").show(20, False)
            return 0
        if args.command == "report":
            rows = files.read_dataset(spark, args.dataset)
            if rows.isEmpty():
                return 1
            for frame in (audit.quality_summary(rows), audit.features(rows), audit.gate_counts(rows), audit.composition(rows)):
                frame.show(100, False)
            return 0
        if args.command == "ask":
            passages = files.read_corpus(spark, args.corpus)
            if passages.isEmpty():
                print("error: no corpus.jsonl below that path", file=sys.stderr)
                return 2
            row = evaluate.answers(passages, spark.createDataFrame([(0, args.question)], "query int, question string"), backend).first()
            print(row["answer"], *row["citations"], sep="\n")
            return 2 if row["refused"] else 0
        if args.command == "eval":
            rows = files.read_dataset(spark, args.dataset)
            if rows.isEmpty():
                return 1
            evaluate.summary(evaluate.evaluate(rows, backend)).orderBy("task").show(50, False)
            return 0
        from docloom.cache import Cache

        store = Cache(spark, args.folder)
        if args.clear:
            store.invalidate()
        print(json.dumps(store.stats()))
        return 0
    except ValueError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
