"""python -m querymill run -c CONFIG | report --metrics DIR --output DIR [--type TYPE]"""

from __future__ import annotations

import argparse
import sys

from querymill import session


def main(argv: list[str] | None = None) -> int:
    from querymill.plans import pipeline
    from querymill.sources import config

    parser = argparse.ArgumentParser(prog="querymill", description="Audits corpora of questions and SQL.")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run a pipeline")
    run.add_argument("-c", "--config", required=True)
    run.add_argument("--master")
    report = commands.add_parser("report", help="write reports from metric tables")
    report.add_argument("--config")
    report.add_argument("--metrics")
    report.add_argument("--output")
    report.add_argument("--type", default="all", choices=["all", *(r.replace("_", "-") for r in pipeline.REPORTS), "query-structure"])
    report.add_argument("--master")
    args = parser.parse_args(argv)
    spark = session.build(args.master)
    if args.command == "run":
        print(pipeline.run(spark, config.load(args.config)))
        return 0
    settings = config.load(args.config) if args.config else {}
    metrics = args.metrics or (settings.get("output") or {}).get("base_dir")
    if not metrics:
        parser.error("--metrics or a config with output.base_dir is needed")
    kind = {"query-structure": "query_structure_profile"}.get(args.type, args.type.replace("-", "_"))
    for path in pipeline.write_reports(spark, metrics, args.output or f"{metrics}/all_reports", pipeline.REPORTS if kind == "all" else (kind,)):
        print(path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
