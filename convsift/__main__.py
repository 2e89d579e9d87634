"""Command line: one search over a stored history, printed as the text report.

    python -m convsift --history /shared/history --query storage --limit 20
    python -m convsift --history /shared/export --layout json_tree --file-path src/auth.ts
    python -m convsift --history /shared/history --query autentication --mode fuzzy --date "last 7 days"

The arguments mirror the search tool's: a file path wins over the query;
``--project-id`` scopes to one project (all projects when omitted, as with
``searchAllProjects``).
"""

from __future__ import annotations

import argparse
import sys

from .plans.search import search_report
from .session import get_spark
from .sources.history import load_history


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="convsift", description=__doc__.split("\n\n")[0])
    p.add_argument("--history", required=True, help="history location")
    p.add_argument("--layout", default="parquet", choices=["parquet", "tables", "json_tree"])
    p.add_argument("--query")
    p.add_argument("--file-path", "--filePath", dest="file_path")
    p.add_argument("--project-id", dest="project_id", help="one project; omit for all projects")
    p.add_argument("--mode", default="keyword", choices=["keyword", "fuzzy"])
    p.add_argument("--regex", action="store_true")
    p.add_argument("--case-sensitive", "--caseSensitive", dest="case_sensitive", action="store_true")
    p.add_argument("--fuzzy-threshold", "--fuzzyThreshold", dest="fuzzy_threshold", type=float)
    p.add_argument("--date")
    p.add_argument("--date-scope", dest="date_scope", default="result", choices=["result", "corpus"])
    p.add_argument("--limit", type=int)
    p.add_argument("--role", choices=["user", "assistant"])
    p.add_argument("--master", help="Spark master (default: from the environment)")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = parse_args(argv)
    if not a.query and not a.file_path:
        print("Either 'query' or 'filePath' must be provided.", file=sys.stderr)
        return 2
    spark = get_spark(a.master)
    spark.sparkContext.setLogLevel("ERROR")
    history = load_history(spark, a.history, layout=a.layout)
    text = search_report(history, query=a.query, file_path=a.file_path, mode=a.mode, regex=a.regex,
                         case_sensitive=a.case_sensitive, fuzzy_threshold=a.fuzzy_threshold,
                         date=a.date, limit=a.limit, role=a.role, project_id=a.project_id,
                         date_scope=a.date_scope)
    print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
