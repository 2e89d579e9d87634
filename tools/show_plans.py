"""Print the physical plans of the headline searches (Parquet layout).

Usage: python tools/show_plans.py [sf_dir]  > docs/PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from convsift.operators.trace import trace_files  # noqa: E402
from convsift.plans.search import search  # noqa: E402
from convsift.session import get_spark  # noqa: E402
from convsift.sources.driver_tables import driver_history  # noqa: E402
from convsift.sources.history import load_history, write_history  # noqa: E402


def tree(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    head = text.split("\n\n")[0]
    scans = re.findall(r"\(\d+\) Scan parquet.*?\nReadSchema: [^\n]*", text, re.S)
    pushed = [re.sub(r"\n(?!ReadSchema|PushedFilters)[^\n]*", "", s) for s in scans]
    return head + "\n\n" + "\n\n".join(p.strip() for p in pushed)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    out = tempfile.mkdtemp(prefix="convsift-plans-")
    write_history(driver_history(spark, sf_dir), out)
    h = load_history(spark, out)
    qs = spark.createDataFrame([("auth.ts",), ("src/shared.ts",)], "query string")
    cases = {
        "keyword search, project scope, limit 20": search(h, query="storage", limit=20, project_id="proj_1"),
        "fuzzy search, limit 20": search(h, query="storage", mode="fuzzy", limit=20),
        "file trace, limit 50": search(h, file_path="src/f12.ts"),
        "batch trace": trace_files(h, qs),
    }
    print("# Physical plans of the headline searches\n")
    print(f"Generated by `tools/show_plans.py` on `{sf_dir}` (Parquet layout written by "
          "`write_history`, AQE on, `local[8]`); initial plans, before AQE re-planning.  At this "
          "size the optimizer broadcasts sides (e.g. the candidate touches of the batch trace) "
          "that at scale are shuffled; broadcast hints in the code are only placed on sides of "
          "proven size.\n")
    for title, df in cases.items():
        print(f"## {title}\n\n```\n{tree(df)}\n```\n")


if __name__ == "__main__":
    main()
