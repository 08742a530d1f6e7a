"""The command line: ``python -m mudlark query|sniff|profile|validate|draft|fit|check|accept|schema|console``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from mudlark import session, sinks
from mudlark.operators import profile as profiles
from mudlark.plans import compiler, draft, pile, sniff
from mudlark.plans.target import load
from mudlark.spec import dumps, json_schema, to_dict


def spark_session() -> SparkSession:
    spark = SparkSession.builder.appName("mudlark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return session.configure(spark)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("mudlark", description="Spark SQL over messy files")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **more) -> argparse.ArgumentParser:
        s = sub.add_parser(name, **more)
        for a in args:
            s.add_argument(a)
        return s

    q = add("query", "sql")
    q.add_argument("--frozen", action="store_true", help="only files with fresh sidecars")
    q.add_argument("--output", help="a file; its extension names the format")
    q.add_argument("--format", choices=sorted(set(sinks.FORMATS.values())))
    q.add_argument("--root", help="no file outside this folder is read")
    s = add("sniff", "path")
    s.add_argument("--hint")
    s.add_argument("--quick", action="store_true")
    s.add_argument("--write", action="store_true")
    s.add_argument("--json", action="store_true")
    f = add("profile", "path")
    f.add_argument("--head", type=int)
    f.add_argument("--hint", help="a sheet or a JSON pointer")
    for name in ("fit", "check"):
        add(name, "target").add_argument("--json", action="store_true")
    add("accept", "target", "member")
    add("validate", "path")
    d = add("draft")
    d.add_argument("paths", nargs="+")
    d.add_argument("--name", default="pile")
    add("schema")
    c = add("console")
    c.add_argument("--frozen", action="store_true")
    return p


def profile_of(spark: SparkSession, path: str, head: int | None = None, hint: str | None = None) -> dict:
    """A profile of the framed text: by the sidecar if it is fresh, else as sniffed."""
    spec = session.load(path)[0] if hint is None and session.fresh(path) else sniff.infer(path, hint)
    frame = compiler.framed(spark, path, spec)
    na = tuple(sorted({w for c in spec.columns for w in c.na_values}))
    return profiles.report(frame.df, list(frame.names), na, "_row", head)


def run(args: argparse.Namespace, spark: SparkSession | None = None) -> str:
    """What a command prints."""
    if args.command == "schema":
        return sinks.data(json_schema())
    if args.command == "draft":
        return draft.draft(args.paths, args.name)
    if args.command == "accept":
        pile.accept(args.target, args.member)
        return f"{args.member}: accepted"
    if args.command == "check":
        found = pile.drift(load(args.target))
        return sinks.data({"drift": found}) if args.json else "\n".join(found) or "as locked"
    spark = spark or spark_session()
    if args.command == "sniff":
        spec = sniff.sniff(spark, args.path, args.hint, args.quick)
        if args.write:
            session.save(args.path, spec)
        return sinks.data(to_dict(spec)) if args.json else dumps(spec)
    if args.command == "profile":
        return sinks.data(profile_of(spark, args.path, args.head, args.hint))
    if args.command == "fit":
        report = pile.fit_pile(spark, args.target)
        return sinks.data(report.data()) if args.json else "\n".join(report.lines())
    if args.command == "validate":
        session.stamp(spark, args.path)
        return f"{args.path}: its spec holds"
    if args.command == "console":
        return console(spark, sys.stdin, sys.stdout, args.frozen)
    s = session.Session(spark, frozen=args.frozen, root=args.root)
    df = s.sql(args.sql)
    notes = "".join(f"-- {n}\n" for n in s.notes)
    if args.output:
        sinks.write(df, args.output, args.format)
        return notes + args.output
    return notes + sinks.table(df)


def console(spark: SparkSession, source, out, frozen: bool = False) -> str:
    """Lines of dot-commands and SQL that ends with a semicolon; a CREATE TABLE is checked as a target and kept beside the files."""
    s = session.Session(spark, frozen=frozen)
    held = ""
    at = Path.cwd()
    for line in source:
        line = line.rstrip("\n")
        if not held and line.startswith("."):
            words = line[1:].split()
            name, rest = (words or ["help"])[0], words[1:]
            try:
                if name in ("quit", "exit"):
                    break
                if name == "cd":
                    at = Path(session.inside(str(at / rest[0]), None))
                elif name == "ls":
                    print("\n".join(sorted(p.name for p in at.iterdir())), file=out)
                elif name == "show":
                    print(sinks.table(s.table(str(at / rest[0])).limit(20)), file=out)
                elif name == "help":
                    print(".sniff .profile .draft .fit .check .accept .validate .schema .show .ls .cd .quit", file=out)
                else:
                    paths = [str(at / r) if not r.startswith("-") and (at / r).exists() else r for r in rest]
                    print(run(parser().parse_args([name, *paths]), spark), file=out)
            except (Exception, SystemExit) as e:  # a console outlives its errors
                print(f"error: {e}", file=out)
            continue
        held += line + "\n"
        if line.rstrip().endswith(";"):
            text, held = held.strip().rstrip(";"), ""
            try:
                if text.lower().startswith("create table"):
                    from mudlark.plans.target import parse

                    t = parse(text)
                    (at / f"{t.name}.mud.sql").write_text(text + ";\n")
                    print(f"{t.name}.mud.sql written", file=out)
                else:
                    print(sinks.table(s.sql(text)), file=out)
            except Exception as e:
                print(f"error: {e}", file=out)
    return ""


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        print(run(args))
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
