"""python -m tallyspark.cli process | import | report | status | history | cleanup."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks, state
from .operators import problems, stats
from .pipeline import batches, consolidate, consolidated, ingest
from .sources.accounts import accounts, load_config
from .sources.files import scan


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyspark")
    p.add_argument("--state", default="data/.state", help="folder of the state table")
    sub = p.add_subparsers(dest="command", required=True)
    process = sub.add_parser("process", help="ingest new and changed files")
    process.add_argument("folders", nargs="+")
    process.add_argument("-o", "--out", default="data")
    process.add_argument("--accounts", default="config/accounts.yaml")
    process.add_argument("--config", help="JSON or YAML: date formats, headers, institution names")
    process.add_argument("--batch", type=int, default=0, help="files per batch; the state is saved after each")
    process.add_argument("--errors", help="folder for the error rows")
    process.add_argument("--force", action="store_true")
    process.add_argument("--no-recursive", action="store_true")
    for name, about in (("import", "consolidate canonical files"), ("report", "HTML report of months")):
        s = sub.add_parser(name, help=about)
        s.add_argument("-d", "--data", default="data")
        s.add_argument("-o", "--out", required=True)
    sub.add_parser("status", help="summary of the last batch")
    for name, days in (("history", 30), ("cleanup", 90)):
        s = sub.add_parser(name)
        s.add_argument("--days", type=int, default=days)
        s.add_argument("--institution")
    return p


def _existing(spark: SparkSession, known: DataFrame) -> DataFrame:
    """Files that are still there, in the folders (a few) of the known ones."""
    out = known.select("file_path").limit(0)
    for (folder,) in known.select(F.regexp_extract("file_path", r"^(.*)/", 1)).distinct().collect():
        try:
            out = out.union(scan(spark, [folder], recursive=False).select("path"))
        except Exception as e:  # a folder that is gone has no files
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tallyspark").getOrCreate()
    now, log = dt.datetime.now(), state.Log(spark, a.state)
    known = log.read()
    if a.command == "process":
        config, wrong = load_config(a.config)
        for problem in wrong:
            print(f"configuration: {problem}; the defaults hold")
        done, errors = None, None
        for some in batches(spark, a.folders, a.batch, not a.no_recursive) if a.batch else [a.folders]:
            got = ingest(spark, some, now, accounts(spark, a.accounts)[1], known, force=a.force, recursive=not a.no_recursive, config=config, outputs=sinks.written(spark, a.out))
            if got is None:
                continue
            sinks.write_canonical(got.transactions, a.out)
            log.append(got.results.unionByName(got.touched))
            known = log.read()
            done = got.results if done is None else done.unionByName(got.results)
            errors = got.errors if errors is None else errors.unionByName(got.errors)
        if done is None:
            print("no files to process")
            return None
        if a.errors:
            sinks.write_json(errors, f"{a.errors}/rows")
            sinks.write_json(problems.report(errors), f"{a.errors}/report")
        out = stats.batch_summary(done)
    elif a.command == "import":
        out, counts = consolidated(spark, a.data)
        n = counts.first()
        print(f"{n['input_count']} rows read, {n['removed_count']} removed, {n['final_count']} kept")
        sinks.write_consolidated(out, a.out)
    elif a.command == "report":
        html = sinks.html_report(consolidate(spark, a.data), details=f"{a.out.rstrip('/')}-rows")
        spark.createDataFrame([(html,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(a.out)
        return None
    elif a.command == "status":
        out = stats.batch_summary(known)
    elif a.command == "history":
        out = state.history(known, now, a.days, a.institution)
    else:
        log.replace(out := state.cleaned(known, _existing(spark, known), now, a.days))
    out.show(50, truncate=False)
    return out


if __name__ == "__main__":
    main()
