"""python -m quarryline index|status|search|context|report ROOT [WORDS...] [--approve] [--full] [--limit N] [--prefix P] [--state DIR] [--json]"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from quarryline.engine import Engine, NotApproved, NotIndexed


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarryline", description=__doc__)
    p.add_argument("command", choices=["index", "status", "search", "context", "report"])
    p.add_argument("root")
    p.add_argument("words", nargs="*")
    p.add_argument("--approve", action="store_true")
    p.add_argument("--full", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--prefix", default="")
    p.add_argument("--state")
    a = p.parse_args(argv)
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("quarryline").getOrCreate()
    e = Engine(spark, a.state)
    try:
        if a.command == "index":
            out = e.index(a.root, a.approve, a.prefix)
        elif a.command == "status":
            out = e.status(a.root, a.full, a.prefix)
        elif a.command == "search":
            out = [r.asDict() for r in e.search(a.root, [" ".join(a.words)], a.limit, a.prefix).orderBy("place").collect()]
        elif a.command == "context":
            out = [r.asDict() for r in e.context(a.root, a.words, a.limit, a.prefix).orderBy("request", "place").collect()]
        else:
            out = {k: [r.asDict() for r in df.collect()] for k, df in e.architecture(a.root, a.limit).items()}
    except (NotApproved, NotIndexed) as x:
        print(x, file=sys.stderr)
        return 2
    if a.json or not isinstance(out, list):
        print(json.dumps(out, default=str, indent=2))
        return 0
    for r in out:
        lines = f":{r['start_line']}-{r['end_line']}" if r.get("start_line") else ""
        print(f"{r['place']}. {r['path']}{lines}  " + (f"{r['score']:.1f} {r['source']}" if "score" in r else ", ".join(dict.fromkeys(x["kind"] for x in r["reasons"]))))
    return 0


if __name__ == "__main__":
    sys.exit(main())
