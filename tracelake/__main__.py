"""Command line over a case: python -m tracelake COMMAND ... Errors of use end with code 1 and one line on stderr."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from . import __version__, jobs
from .operators import sigma, views
from .operators.search import discover_fields, json_object_columns
from .plans.schemas import TABLES
from .session import build
from .sources.lake import Case, CaseAlreadyExistsError, CaseNotFoundError, NoSourcesFoundError

PREVIEW = 50
USE_ERRORS = (CaseAlreadyExistsError, CaseNotFoundError, NoSourcesFoundError, AnalysisException, ValueError, RuntimeError, OSError)


def pairs(given: list[str], split: bool = True) -> dict[str, list[str]]:
    """FIELD=VALUE arguments; a comma separates values, but not in patterns."""
    out: dict[str, list[str]] = {}
    for text in given:
        field, sign, value = text.partition("=")
        if not sign or not field.strip():
            raise ValueError(f"expected FIELD=VALUE, got {text!r}")
        out.setdefault(field.strip(), []).extend([v.strip() for v in value.split(",")] if split else [value])
    return out


def show(df: DataFrame, args: argparse.Namespace) -> None:
    """A CSV file of all rows, or a preview on stdout."""
    df = df if args.limit is None else df.limit(args.limit)
    if args.output:
        print(f"{views.to_csv(df, args.output)} rows -> {args.output}")
        return
    rows = df.take(PREVIEW + 1)
    print("\t".join(df.columns))
    for row in rows[:PREVIEW]:
        print("\t".join("" if v is None else str(v) for v in row))
    if len(rows) > PREVIEW:
        print(f"... first {PREVIEW} rows")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracelake")
    p.add_argument("--case-root", default="./cases")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *names: str, rows: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for n in names:
            c.add_argument(n)
        if rows:
            c.add_argument("--limit", type=int)
            c.add_argument("--output")
        return c

    for name in ("init", "info", "compact", "cleanup", "counts", "hosts", "channels", "sources", "jobs"):
        add(name, "case")
    for name in ("list", "version"):
        sub.add_parser(name)
    g = add("ingest", "case")
    g.add_argument("sources", nargs="+", help="PATH or PATH:HOST")
    g.add_argument("--keep-raw", action="store_true", help="keep event records as XML too")
    g.add_argument("--codec", help="codec of strings in event logs that are not Unicode")
    g.add_argument("--background", action="store_true", help="print a job's id and return at once")
    add("job-run", "case", "job").add_argument("sources", nargs="+")
    for name in ("job-status", "job-cancel"):
        add(name, "case", "job")
    for name in ("tasks", "auth", "registry"):
        add(name, "case", rows=True)
    add("query", "case", "sql", rows=True)
    add("table", "case", "name", rows=True)
    add("summary", "case", rows=True)
    add("fields", "case", "name", rows=True)
    s = add("search", "case", "name", rows=True)
    for option in ("--eq", "--contains", "--regex"):
        s.add_argument(option, action="append", default=[], metavar="FIELD=VALUE")
    s.add_argument("--match", choices=("all", "any"), default="all")
    s.add_argument("--case-sensitive", action="store_true")
    t = add("timeline", "case", rows=True)
    for option in ("--start", "--end", "--host", "--channel"):
        t.add_argument(option)
    t.add_argument("--event-id", type=int)
    h = add("hunt", "case", "rules", rows=True)
    h.add_argument("--min-level")
    h.add_argument("--save", help="folder for the matches")
    h.add_argument("--csv", help="file for the matches")
    add("validate", "rules")
    return p


def run(args: argparse.Namespace, spark: SparkSession | None = None) -> int:
    if args.command == "list":
        print("\n".join(Case.names(spark or build(), args.case_root)))
        return 0
    if args.command == "version":
        print(__version__)
        return 0
    if args.command in ("jobs", "job-status", "job-cancel"):
        where = (args.case_root, args.case)
        found = jobs.jobs(*where) if args.command == "jobs" else [(jobs.status if args.command == "job-status" else jobs.cancel)(*where, args.job)]
        for s in found:
            print(json.dumps(s))
        return 0
    if args.command == "ingest" and args.background:
        print(jobs.start(args.case_root, args.case, args.sources))
        return 0
    if args.command == "validate":
        rules, failures = sigma.load_rules(args.rules)
        print(f"{len(rules)} rules, {len(failures)} failed")
        for name, why in failures.items():
            print(f"{name}: {why}", file=sys.stderr)
        return int(bool(failures))
    if getattr(args, "name", None) not in (None, *TABLES):
        raise ValueError(f"no table {args.name!r}; tables: {', '.join(TABLES)}")
    spark = spark or build()
    if args.command == "init":
        print(Case.create(spark, args.case, args.case_root).root)
        return 0
    case = Case.open(spark, args.case, args.case_root)
    if args.command == "info":
        m = case.manifest()
        print(json.dumps({"name": m["name"], "id": m["id"], "files": len(m["ledger"]), "tables": case.counts()}))
    elif args.command == "counts":
        for table, n in sorted(case.counts().items()):
            print(f"{table}\t{n}")
    elif args.command == "compact":
        print(json.dumps(case.compact()))
    elif args.command == "cleanup":
        print("\n".join(case.cleanup()))
    elif args.command == "ingest":
        report = case.ingest(args.sources, args.keep_raw, args.codec)
        for r in report:
            print(f"{r['status']}\t{r['kind']}\t{r['rows']}\t{r['errors']}\t{r['source_path']}")
        return int(any(r["status"] == "failed" for r in report))
    elif args.command == "job-run":
        return jobs.run(args.case_root, args.case, args.job, lambda progress: case.ingest(args.sources, progress=progress))
    elif args.command in ("hosts", "channels"):
        print("\n".join(getattr(case, args.command)()))
    elif args.command == "sources":
        for one in case.sources():
            print("\t".join(one.values()))
    elif args.command in ("tasks", "auth", "registry"):
        show({"tasks": case.suspicious_tasks, "auth": case.auth_events, "registry": case.suspicious_registry}[args.command](), args)
    elif args.command == "query":
        show(case.query(args.sql), args)
    elif args.command == "table":
        show(case.table(args.name), args)
    elif args.command == "summary":
        show(views.summary(case.table("events")), args)
    elif args.command == "timeline":
        show(views.timeline(case.table("events"), start=args.start, end=args.end, host=args.host, channel=args.channel, event_id=args.event_id), args)
    elif args.command == "fields":
        df = case.table(args.name)
        show(discover_fields(df, json_object_columns(df, args.name)), args)
    elif args.command == "search":
        show(case.search(args.name, eq=pairs(args.eq), contains=pairs(args.contains), regex=pairs(args.regex, split=False), match=args.match, case_sensitive=args.case_sensitive), args)
    else:
        result = case.hunt(args.rules, args.min_level)
        show(result.summary, args)
        for name, why in result.failures.items():
            print(f"{name}: {why}", file=sys.stderr)
        if args.save:
            result.save(args.save)
        if args.csv:
            result.to_csv(args.csv)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args, spark)
    except USE_ERRORS as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
