"""python -m tarn stats|verify|compact|reindex ROOT [COLLECTION] [ENGINE]: JSON out, exit 1 on error."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tarn.plans.collections import DocumentStore, EventLog
from tarn.plans.jobqueue import JobQueue
from tarn.sources.store import namespace

ENGINES = {"documents": DocumentStore, "log": EventLog, "queue": JobQueue}


def run(spark: SparkSession, command: str, root: str, collection: str = "default", engine: str = "documents") -> dict:
    store = ENGINES[engine](spark, f"{root.rstrip('/')}/{namespace(collection)}")
    if not hasattr(store, command):
        raise ValueError(f"{engine} has no {command}")
    return getattr(store, command)()


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tarn")
    parser.add_argument("command", choices=["stats", "verify", "compact", "reindex"])
    parser.add_argument("root")
    parser.add_argument("collection", nargs="?", default="default")
    parser.add_argument("engine", nargs="?", default="documents", choices=sorted(ENGINES))
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("tarn").getOrCreate()
    try:
        found = run(spark, a.command, a.root, a.collection, a.engine)
    except Exception as e:
        print(json.dumps({"ok": False, "error": str(e)}))
        return 1
    print(json.dumps(found))
    return 0 if found.get("ok", True) else 1


if __name__ == "__main__":
    sys.exit(main())
