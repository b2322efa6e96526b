"""Command line: ``python -m lodestone [--init | --status] [--local] [--watch] [--verbose] [path]``.

Indexes the project around ``path``. ``--watch`` streams the tree's events and
reindexes what changed until interrupted; a session brackets each run.
"""

from __future__ import annotations

import argparse
import os
import time

from pyspark.sql import SparkSession

from lodestone import tools
from lodestone.logs import session_log
from lodestone.plans.index import apply_events
from lodestone.project import Project
from lodestone.session import ship
from lodestone.sources import config as conf
from lodestone.sources.store import Store
from lodestone.sources.tree import tree_events
from lodestone.streaming.events import watch


def main() -> None:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    parser.add_argument("path", nargs="?", default=".")
    for flag in ("init", "status", "local", "watch", "verbose"):
        parser.add_argument(f"--{flag}", action="store_true")
    args = parser.parse_args()
    root = conf.project_root(args.path)
    if args.init:
        print(f"wrote {conf.init_config(root)}")
        return
    config = conf.load_config(root)
    at = conf.index_path(root, "local" if args.local else config.storage)
    log = session_log(os.path.join(at, "logs"), args.verbose)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    ship(spark)
    if args.status:
        print(tools.get_status(Store(spark, f"file://{os.path.abspath(at)}/tables").read()))
        return
    ms = lambda: int(time.time() * 1000)
    project = Project.open(spark, root, ms(), "local" if args.local else None)
    try:
        log.info("indexed %s", project.counts)
        print(tools.get_status(project.store.read()))
        if args.watch:
            state = os.path.join(at, f"watch-{project.session}")
            events = tree_events(spark, root, os.path.join(state, "listings"))
            watch(events, apply_events(spark, root, project.store, ms()), f"file://{os.path.abspath(state)}/checkpoint", gap_ms=300).awaitTermination()
    except KeyboardInterrupt:
        pass
    finally:
        project.close(ms())
        spark.stop()


if __name__ == "__main__":
    main()
