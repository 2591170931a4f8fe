"""python -m folioflow PATH: budgeted text, JSON or statistics of a file, or of all files below a folder."""

from __future__ import annotations

import argparse
import json
import os
import stat
import sys

from .conf import BOUNDS, EngineConf

#: Exit codes.
OK, USAGE, UNSAFE, DAMAGED, MISSING = 0, 2, 4, 5, 6


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("folioflow", description=__doc__)
    p.add_argument("path", help="a file, a folder or a URI that Spark reads")
    p.add_argument("--pages", help='pages of pdf files, such as "1-3,8"')
    p.add_argument("--sheets", help='sheets of workbooks, such as "Sales,2-4"')
    p.add_argument("--format", dest="force", help="read every file as this format")
    p.add_argument("--max-tokens", type=int, help="token budget of a file's sections")
    p.add_argument("--full", action="store_true", help="show every section")
    p.add_argument("--json", action="store_true", help="print one JSON object per file")
    p.add_argument("--stats-only", action="store_true", help="leave the text out")
    p.add_argument("--out", help="write JSON lines below this path instead of printing")
    return p


def check_path(path: str) -> tuple[int, str | None]:
    """Exit code and message for a local path that can't be read; URIs are left to Spark."""
    if ":/" in path:
        return OK, None
    try:
        info = os.stat(path)
    except OSError:
        return MISSING, f"no such file: {path}"
    if stat.S_ISDIR(info.st_mode):
        return OK, None
    if not stat.S_ISREG(info.st_mode):
        return UNSAFE, f"not a regular file: {path}"
    return (OK, None) if info.st_size else (MISSING, f"the file is empty: {path}")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    code, message = check_path(args.path)
    if code:
        print(json.dumps({"ok": False, "error": message, "exit_code": code}) if args.json else f"folioflow: {message}", file=sys.stdout if args.json else sys.stderr)
        return code

    from pyspark.sql import SparkSession

    from .sources.ingest import envelopes
    from .sources.sinks import write_envelopes

    spark = SparkSession.builder.appName("folioflow").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    low, high = BOUNDS["budget_tokens"]
    budget = min(max(args.max_tokens or EngineConf.of(spark).budget_tokens, low), high)
    found = envelopes(spark, args.path, budget, args.full, args.pages, args.sheets, args.force, args.stats_only)
    if args.out:
        write_envelopes(found, args.out)
        return OK
    worst = OK
    for row in found.toLocalIterator():  # one file's object at a time
        one = json.loads(row.json)
        worst = max(worst, int(one.get("exit_code") or OK))
        if args.json or args.stats_only:
            print(row.json)
        elif one["ok"]:
            print(one["text"])
        else:
            print(f"folioflow: {one['error']}: {row.doc_id}", file=sys.stderr)
    return worst


if __name__ == "__main__":
    sys.exit(main())
