"""Command line: ``python -m quillon diff|log|status|doctor|open ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import counts_phrase, short_id, timestamp_text
from .operators import diff as D
from .operators import history, render
from .plans import workflows as W
from .sources import repository


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillon")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("diff", "log", "status", "doctor", "open"):
        p = sub.add_parser(name)
        p.add_argument("--repo", default=".")
        p.add_argument("--format", choices=("text", "json"), default="text")
        p.add_argument("--store", help="folder that keeps decoded layouts between calls")
        p.add_argument("--level", choices=("summary", "detail", "full"), default="summary")
        if name == "diff":
            p.add_argument("a")
            p.add_argument("b")
            p.add_argument("path")
            p.add_argument("--threshold", type=float, default=0.01)
        if name in ("log", "status"):
            p.add_argument("paths", nargs="*")
        if name == "log":
            p.add_argument("-n", "--limit", type=int, default=20)
            p.add_argument("--start", help="commit to start from; HEAD unless given")
            p.add_argument("--author")
            p.add_argument("--since", type=int, help="seconds since the epoch")
            p.add_argument("--path-of", help="only commits that touch this file")
            p.add_argument("--type", action="append", default=[], help="only commits that change files of this format")
            p.add_argument("--element", help="only commits that change this component, net or cell")
            p.add_argument("--stat", action="store_true", help="counts of elements by format")
            p.add_argument("--metric", help="a measured value of the file of --path-of over time")
        if name == "status":
            p.add_argument("--include-unknown", action="store_true")
    return top


def show(df, column: str) -> None:
    for row in df.toLocalIterator():
        print(row[column])


def show_payload(schema: str, one: dict[str, DataFrame], many: dict[str, DataFrame]) -> None:
    """One JSON document: ``one`` gives single values or null, ``many`` lists, written row by row."""
    print(json.dumps({"schema": schema})[:-1], end="")
    for name, rows in one.items():
        first = rows.first()
        print(f', "{name}": {"null" if first is None else first["json"]}', end="")
    for name, rows in many.items():
        print(f', "{name}": [', end="")
        for k, row in enumerate(rows.toLocalIterator()):
            print("," * bool(k) + "\n" + row["json"], end="")
        print("]", end="")
    print("}")


def messages(warnings: DataFrame) -> DataFrame:
    text = F.to_json(F.array("message"))
    return warnings.orderBy("message").select(F.substring(text, F.lit(2), F.length(text) - 2).alias("json"))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "log" and args.metric and not args.path_of:
        parser().error("--metric needs --path-of")
    try:
        return run(args)
    except (ValueError, repository.RepositoryNotFound) as problem:
        print(f"[x] {problem}", file=sys.stderr)
        return 2


def run(args: argparse.Namespace) -> int:
    spark = SparkSession.builder.appName("quillon").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    options = W.Options(level=args.level, store=args.store)
    if args.command in ("doctor", "open"):
        rows = repository.environment_report(spark, args.repo) if args.command == "doctor" else repository.list_folder(spark, args.repo)
        show(rows.select(F.concat_ws("  ", *[F.col(c).cast("string") for c in rows.columns]).alias("t")), "t")
        return 0
    if args.command == "diff":
        options.threshold_um2 = args.threshold
        entries, warnings = W.diff(spark, args.repo, args.a, args.b, args.path, options)
        if args.format == "json":
            show(W.diff_payload(entries, warnings, args.path), "json")
        else:
            show(render.diff_text(entries.withColumn("params", D.param_diff(F.col("before"), F.col("after"))), ["path"]), "text")
        for row in warnings.toLocalIterator():
            print(f"[!] {row['message']}", file=sys.stderr)
        return 0
    options.patterns = args.paths
    if args.command == "log":
        options.limit = args.limit
        start = args.start or "HEAD"
        limit = None if args.author or args.since or args.path_of or args.type or args.element else args.limit
        options.kinds, options.element = tuple(args.type), args.element
        tables = repository.snapshot(spark, args.repo, options.size_cap, start, limit)
        if args.metric:
            rows = W.metric_history(tables, args.path_of, args.metric, options.size_cap)
            if args.format == "json":
                show_payload("metric/v1", {}, {"values": rows.select(F.to_json(F.struct("oid", "ts", "value")).alias("json"))})
            else:
                show(rows.select(F.concat_ws("  ", short_id(F.col("oid")), timestamp_text(F.col("ts")), F.col("value").cast("string")).alias("t")), "t")
            return 0
        if args.path_of:
            tables["commits"] = history.touches(tables["changed_files"], tables["tree_entries"], tables["commits"], args.path_of).select(*tables["commits"].columns)
        tables["commits"], _ = history.narrow(tables["commits"], tables["changed_files"], args.author, args.since)
        if args.stat:
            commits, files, entries, warnings = W.log_entries(tables, options)
            stats = history.stat(entries, ["oid"])
            if args.format == "json":
                per = stats.groupBy("oid").agg(F.collect_list(F.struct("format", "added", "removed", "modified")).alias("stat"))
                show_payload("log_stat/v1", {}, {"commits": render.envelope(commits.join(per, "oid", "left").orderBy(F.desc("ts"), "oid"), None), "warnings": messages(warnings)})
            else:
                show(render.stat_text(commits, files, stats).orderBy(F.desc("ts"), "oid"), "text")
            return 0
        commits, files, warnings = W.log(spark, tables, options)
        if args.format == "json":
            per = files.groupBy("oid").agg(F.collect_list(F.struct(*[c for c in files.columns if c != "oid"])).alias("files"))
            show_payload("log/v1", {}, {"commits": render.envelope(commits.join(per, "oid", "left").orderBy(F.desc("ts"), "oid"), None), "warnings": messages(warnings)})
        else:
            show(render.log_text(commits, files.select("oid", "path", counts_phrase(F.col("counts"), F.col("category")).alias("phrase"))).orderBy(F.desc("ts"), "oid"), "text")
        return 0
    branch, files, warnings = W.status(spark, args.repo, options)
    if args.format == "json":
        show_payload("status/v1", {"branch": render.envelope(branch, None)}, {"files": render.envelope(files, None), "warnings": messages(warnings)})
    else:
        show(render.status_header(branch), "text")
        show(render.status_lines(files, args.include_unknown).orderBy("section", "path"), "text")
    return W.exit_code(files)


if __name__ == "__main__":
    sys.exit(main())
