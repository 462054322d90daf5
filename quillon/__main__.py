"""Command line: ``python -m quillon verify|pin|init|explain``."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillon", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    v = sub.add_parser("verify", help="check a project")
    v.add_argument("--root", default=".")
    v.add_argument("--changed", action="append", default=[], help="check only what this file can reach")
    v.add_argument("--format", choices=("text", "compact", "json"), default="text")
    v.add_argument("--deny-warnings", action="store_true")
    n = sub.add_parser("pin", help="show stale pins, or record their hashes")
    n.add_argument("--root", default=".")
    n.add_argument("--update", action="store_true")
    i = sub.add_parser("init", help="deploy the skeleton")
    i.add_argument("--root", default=".")
    e = sub.add_parser("explain", help="what a code means")
    e.add_argument("code", nargs="?")
    a = p.parse_args(argv)

    from .operators import catalog

    if a.command == "explain":
        if a.code:
            print(catalog.explain(a.code) or f"unknown code {a.code}")
            return 0 if catalog.explain(a.code) else 2
        print(json.dumps(catalog.CODES, indent=1))
        return 0

    import os

    from .engine import FOLDER, Engine
    from .sources import project

    if a.command == "init":
        for path in project.init(a.root, FOLDER):
            print(path)
        return 0

    from pyspark.sql import SparkSession

    from .operators import documents, findings
    from .sources import frontmatter
    from .streaming.incremental import checkpointed

    if not os.path.isdir(a.root):
        print(json.dumps({"version": findings.VERSION, "status": "failed", "error": {"code": "E0070", "message": f"{a.root} is not a folder"}}), file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    try:
        engine = Engine(spark, os.path.abspath(a.root))
        if a.command == "pin":
            docs = frontmatter.documents(engine.all_files.where("state = 'ok'").select("path", "text"))
            stale = documents.pin_updates(docs, (engine.pins or ([], []))[0])
            for row in project.renew_pins(os.path.join(a.root, FOLDER), stale, dry_run=not a.update):
                print(*row)
            return 0
        if a.format == "json":
            report = engine.report(a.changed)
            print(report)
            counts = json.loads(report)["summary"]
        else:
            found = checkpointed(engine.check_changed(a.changed) if a.changed else engine.check())
            for r in findings.report_lines(findings.ordered(found), a.format).toLocalIterator():
                print(r.report)
            counts = findings.summary(found).first().asDict()
        return findings.exit_status(counts["errors"], counts["warnings"], a.deny_warnings)
    except Exception as e:  # noqa: BLE001 - whatever stops the run is its outcome
        print(json.dumps({"version": findings.VERSION, "status": "failed", "error": {"code": "E0080", "message": str(e).split("\n")[0]}}), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
