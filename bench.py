"""Benchmark: ingest the benchmark tables once, then time the headline searches.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8), ``BENCH_REPEATS`` (default 3).  Prints one JSON line.
``value`` is the summed wall time of the searches, each the best of
``BENCH_REPEATS`` warm runs (one untimed run first); the one-off ingest
(adapters + JSON decoding + Parquet write of history and item table) is
reported separately as ``ingest``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
import uuid

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from convsift.operators.report import format_matches, format_traces  # noqa: E402
from convsift.operators.trace import trace_files  # noqa: E402
from convsift.plans.search import search  # noqa: E402
from convsift.session import get_spark, scratch_path  # noqa: E402
from convsift.sources.driver_tables import driver_history  # noqa: E402
from convsift.sources.history import load_history, write_history  # noqa: E402


REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def _timed(fn):
    t0 = time.perf_counter()
    out = fn()
    return time.perf_counter() - t0, out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", app_name="convsift-bench", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    out_dir = scratch_path(spark, f"bench-{uuid.uuid4().hex[:8]}")

    def ingest():
        h = driver_history(spark, sf_dir, ("conv", "evt", "page", "doc"))
        write_history(h, f"{out_dir}/history")

    t_ingest, _ = _timed(ingest)
    h = load_history(spark, f"{out_dir}/history")
    n_parts = h.parts.count()
    n_items = h.items.count()
    basenames = (spark.read.parquet(f"{sf_dir}/events.parquet")
                 .select(F.concat(F.lit("f"), F.get_json_object("props", "$.k"), F.lit(".ts")).alias("query"))
                 .distinct())

    queries = {
        "keyword_storage": lambda: search(h, query="storage", limit=20).collect(),
        "keyword_grep": lambda: search(h, query="grep", limit=20).collect(),
        "keyword_session_all": lambda: search(h, query="session", limit=50).collect(),
        "keyword_regex": lambda: search(h, query="wh[a-z]+n", regex=True, limit=50).collect(),
        "keyword_common_word": lambda: search(h, query="the", limit=50, role="assistant").collect(),
        "fuzzy_storage": lambda: search(h, query="storage", mode="fuzzy", limit=20).collect(),
        "fuzzy_typo": lambda: search(h, query="thatantion", mode="fuzzy", fuzzy_threshold=0.3,
                                     limit=50).collect(),
        "trace_file": lambda: search(h, file_path="src/f12.ts", limit=50).collect(),
        "trace_shared": lambda: search(h, file_path="shared.ts", limit=1000).collect(),
        "trace_batch": lambda: trace_files(h, basenames).write.format("noop").mode("overwrite").save(),
        "report_keyword": lambda: format_matches(search(h, query="tion", limit=50)),
        "report_trace": lambda: format_traces(search(h, file_path="f3.ts", limit=50)),
    }
    times = {}
    for name, fn in queries.items():
        fn()                      # warm-up (JIT, file listing cache)
        times[name] = min(_timed(fn)[0] for _ in range(REPEATS))
    total = sum(times.values())
    print(json.dumps({
        "metric": "search_total_sec",
        "value": round(total, 3),
        "unit": "sec",
        "queries": {**{k: round(v, 3) for k, v in times.items()}, "ingest": round(t_ingest, 3)},
        "sf": sf,
        "cpus": cpus,
        "repeats": REPEATS,
        "parts": n_parts,
        "items": n_items,
        "parts_per_sec_keyword": round(n_parts / times["keyword_storage"], 1) if times["keyword_storage"] else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
