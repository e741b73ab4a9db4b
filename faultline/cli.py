"""Command line: ``check`` and ``fix``.  Exit status: 0 nothing found, 1 findings, 2 error."""

from __future__ import annotations

import argparse
import sys

from .api import Analysis, AnalysisError, Options
from .sources.scan import ScanError


def session():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.appName("faultline").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def main(argv: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="faultline")
    commands = parser.add_subparsers(dest="command")
    for name in ("check", "fix"):
        c = commands.add_parser(name)
        c.add_argument("paths", nargs="*", default=["."])
        c.add_argument("-e", "--exclude", action="append", default=[])
        c.add_argument("--types", choices=("exact", "structural"), default="structural")
        c.add_argument("--cache", default=None)
        c.add_argument("--max-files", type=int, default=None, help="analyse at most so many files; the rest is reported")
        if name == "check":
            c.add_argument("-f", "--format", default="text")
    a = parser.parse_args(argv)
    if a.command is None:
        print("Use --help for usage information")
        return 0
    try:
        if a.command == "check" and a.format.lower() not in ("text", "json"):
            raise ValueError(f"Invalid format: {a.format}")
        from .sources.scan import list_sources

        if not list_sources(a.paths, a.exclude):
            print("No TypeScript files found")
            return 0
        analysis = Analysis(spark or session(), a.paths, a.exclude, Options(types=a.types, cache_dir=a.cache, max_files=a.max_files))
        if analysis.left_out:
            print(f"warning: {analysis.left_out} files beyond --max-files are left out", file=sys.stderr)
        if a.command == "fix":
            print(f"Fixed {analysis.fix()} file(s)")
            return 0
        text, found = analysis.report(a.format)
        print(text, end="")
        return int(found)
    except (AnalysisError, ScanError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except Exception as e:  # a failure on the cluster is an error too: 1 means findings
        if type(e).__module__.partition(".")[0] not in ("pyspark", "py4j"):
            raise
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
