"""Commands: ingest, health, investigate, report, run, reveal, sql, mcp, and the evaluations eval, eval-seeded, eval-ranking, eval-templating."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from incidentlens.agent import loop
from incidentlens.agent.server import Server
from incidentlens.operators import cases, health, redaction
from incidentlens.operators.store import Store
from incidentlens.plans import guard, report
from incidentlens.plans.ingest import Options, extend, ingest


def session() -> SparkSession:
    return SparkSession.builder.appName("incidentlens").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def _brief(text: str | None) -> str | None:
    return Path(text[1:]).read_text() if text and text.startswith("@") else text


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="incidentlens")
    top.add_argument("--root", default="incidents", help="folder of the incident tables")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("ingest", "run", "extend"):
        p = sub.add_parser(name)
        p.add_argument("source")
        p.add_argument("--incident", required=name == "extend")
        p.add_argument("--salt", default="", required=name == "extend", help="of the placeholders; the same one to extend an incident later")
        p.add_argument("--format")
        p.add_argument("--brief", help="text, or @file")
        p.add_argument("--vault")
        p.add_argument("--year", type=int)
        p.add_argument("--clf", action="store_true", help="read common log format's times")
        p.add_argument("--bootstrap", action="store_true")
        p.add_argument("--schemas", help="folder of inferred line schemas, for files to come")
    for name in ("health", "investigate", "report", "sql"):
        sub.add_parser(name).add_argument("incident")
    sub.choices["investigate"].add_argument("--restart", action="store_true")
    sub.choices["investigate"].add_argument("--ignore-health", action="store_true")
    sub.choices["sql"].add_argument("query")
    sub.choices["sql"].add_argument("--seconds", type=float, help="how long the query may run")
    for name in ("report", "run"):
        sub.choices[name].add_argument("--out", default="reports")
        sub.choices[name].add_argument("--as", dest="fmt", default="markdown", choices=sorted(report.FORMATS))
    p = sub.add_parser("eval", help="score investigations of the built-in cases")
    p.add_argument("--case", action="append")
    p.add_argument("--runs", type=int, default=1)
    p.add_argument("--method", default="skeleton", choices=["skeleton", "search"])
    p.add_argument("--out", default="evaluations")
    sub.add_parser("eval-seeded", help="which unsound conclusions the free checks catch").add_argument("incident")
    sub.add_parser("eval-ranking", help="where stored incidents rank the template that matters").add_argument("incidents", nargs="+")
    p = sub.add_parser("eval-templating", help="grouping accuracy on a labelled CSV file")
    p.add_argument("file")
    p.add_argument("--sim-th", type=float, default=0.4)
    p.add_argument("--depth", type=int, default=4)
    sub.add_parser("mcp", help="serve tools over standard input and output").add_argument("--allow", action="append", default=[], help="a folder that sources may lie in")
    p = sub.add_parser("reveal")
    p.add_argument("vault")
    p.add_argument("--token")
    p.add_argument("--all", action="store_true")
    return top


def _preflight(store: Store, ignore: bool) -> None:
    verdict = store.metrics().get(("health", "verdict"))
    if verdict == health.FAIL:
        if not ignore:
            raise SystemExit("the log's health check failed; fix the log or pass --ignore-health")
        store.record("investigate", {"health_overridden": True})


def evaluation(spark: SparkSession, args: argparse.Namespace) -> int:
    """Runs an evaluation and prints its figures; 1 if a built-in case or a seeded conclusion fails."""
    if args.command == "eval-templating":
        rows = spark.read.csv(args.file, header=True, multiLine=True, escape='"').withColumn("LineId", F.col("LineId").cast("long"))
        print(f"grouping accuracy {cases.score_labelled(rows, sim_th=args.sim_th, depth=args.depth).first()[0]:.4f}")
        return 0
    if args.command == "eval-ranking":
        for name, rank, leads in cases.rank_report({i: Store(spark, args.root, i) for i in args.incidents}):
            print(f"{name}: rank {rank or 'none'}, {'no notes' if leads is None else 'leads' if leads else 'does not lead'}")
        return 0
    if args.command == "eval-seeded":
        found = cases.Seeded().run(Store(spark, args.root, args.incident))
        for name, good in sorted(found.items()):
            print(f"{'ok  ' if good else 'miss'} {name}")
        return int(not all(found.values()))
    investigate = loop.skeleton if args.method == "skeleton" else cases.grep_note
    chosen = [c for c in cases.builtin() if not args.case or c.name in args.case]
    results = {c.name: cases.run_case(spark, c, Path(args.out), investigate, args.runs) for c in chosen}
    for name, runs in results.items():
        for check, rate in cases.rates(runs).items():
            print(f"{name}: {check} {rate}")
    print(cases.write_results(results, args.out))
    return int(any(c.passed is False for runs in results.values() for checks in runs for c in checks))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or session()
    if args.command in ("ingest", "run", "extend"):
        options = Options(salt=args.salt, reader=args.format, bootstrap=args.bootstrap, schemas=args.schemas, year=args.year, clf=args.clf, vault=args.vault, brief=_brief(args.brief))
        if args.command == "extend":
            got = extend(spark, args.source, Store(spark, args.root, args.incident), options)
        else:
            got = ingest(spark, args.source, args.root, args.incident, options)
        print(got.store.incident, got.counters, "health:", got.report.verdict)
        if args.command != "run":
            return 0
        if got.report.verdict == health.FAIL:
            return 1
        loop.run(got.store, restart=True)
        print(report.write(got.store, args.out, args.fmt))
        return 0
    if args.command == "reveal":
        for r in redaction.reveal(spark.read.parquet(args.vault), args.token, args.all).collect():
            print(r["token"], r["entity"], r["value"])
        return 0
    if args.command == "mcp":
        Server(spark, args.root, args.allow).serve()
        return 0
    if args.command.startswith("eval"):
        return evaluation(spark, args)
    store = Store(spark, args.root, args.incident)
    if args.command == "health":
        found = health.report(store.read("events"), store.read("templates"), {k[1]: float(v) for k, v in store.metrics().items() if k[0] == "ingest" and k[1] in ("lines_read", "parse_errors")})
        for name, status, message in found.checks:
            print(f"{status:4} {name}: {message}")
        return int(found.verdict == health.FAIL)
    if args.command == "investigate":
        _preflight(store, args.ignore_health)
        print(loop.run(store, restart=args.restart).text)
    elif args.command == "report":
        print(report.write(store, args.out, args.fmt))
    else:
        guard.run_readonly(spark, args.query, {"log_events": store.read("events"), "templates": store.read("templates")}, time_limit=args.seconds).show(50, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
