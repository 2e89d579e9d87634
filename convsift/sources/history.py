"""One entry point for every layout (S7) and the Parquet ingest target.

``load_history`` returns the same three relations whatever the source:

* ``parquet``   — tables written by :func:`write_history` (the search layout);
* ``tables``    — raw row tables ``session``/``message``/``part`` stored as
  Parquet under ``path`` (any other table source can call
  :func:`normalise_tables` directly, e.g. with ``spark.read.jdbc``);
* ``json_tree`` — the one-object-per-file layout.

``write_history`` also stores the item table of fuzzy search, the touch table of file
traces and the validity intervals of the prompts before them.  Files are sized by bytes: rows are clustered by project (touches
by last path component) and rebalanced, so a scope opens few files and a large
project or long texts spread over many.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import History
from ..operators.items import build_items
from ..operators.trace import build_prompts, build_touches
from .tables import normalise_tables
from .tree import read_json_tree

TABLES = ("sessions", "messages", "parts")
DERIVED = ("items", "touches", "prompts")


def _stored(spark: SparkSession, path: str):
    """A stored table, or None where the history has none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_history(spark: SparkSession, path: str, layout: str = "parquet",
                 project_id: str | None = None, on_corrupt: str = "skip") -> History:
    if layout == "parquet":
        h = History(*[spark.read.parquet(os.path.join(path, t)) for t in TABLES],
                    *[_stored(spark, os.path.join(path, t)) for t in DERIVED])
        return h.scoped(project_id)
    if layout == "tables":
        raw = [spark.read.parquet(os.path.join(path, t)) for t in ("session", "message", "part")]
        return normalise_tables(*raw, on_corrupt=on_corrupt).scoped(project_id)
    if layout == "json_tree":
        return read_json_tree(spark, path, project_id, on_corrupt)
    raise ValueError("layout must be 'parquet', 'tables' or 'json_tree'")


def _write(df: DataFrame, path: str, keys: list[str], partitions: int | None, spread: list[str], mode: str,
           clustered: bool = False) -> None:
    """Files clustered by ``keys[0]`` and sorted by ``keys``.  Without a number of
    files Spark sizes them by bytes (splitting a large cluster, merging small ones), or
    rows that are ``clustered`` as they come stay where they are; with one, rows are
    dealt evenly by ``spread``."""
    if partitions:
        df = df.repartition(partitions, *spread)
    elif not clustered:
        df = df.hint("rebalance", F.col(keys[0]))
    df.sortWithinPartitions(*keys).write.mode(mode).parquet(path)


def write_history(history: History, path: str, partitions: int | None = None,
                  mode: str = "overwrite") -> None:
    """Write the relations and the derived tables as Parquet.

    The derived tables are built from the written parts, which are decoded by then.
    """
    spark = history.sessions.sparkSession
    _write(history.sessions, os.path.join(path, "sessions"), ["project_id", "session_id"], partitions, ["session_id"], mode)
    _write(history.messages, os.path.join(path, "messages"), ["project_id", "session_id", "created_ms"], partitions,
           ["message_id"], mode)
    _write(history.parts, os.path.join(path, "parts"), ["project_id", "session_id", "msg_created_ms", "created_ms"],
           partitions, ["session_id", "part_id"], mode)
    done = History(*[spark.read.parquet(os.path.join(path, t)) for t in TABLES])
    # Items come row by row from files that are clustered by project.
    write_items(build_items(done), os.path.join(path, "items"), partitions, mode, clustered=True)
    _write(build_touches(done.parts), os.path.join(path, "touches"), ["last_component", "file_path", "session_id"],
           partitions, ["last_component"], mode)
    _write(build_prompts(done.parts), os.path.join(path, "prompts"), ["session_id", "bucket", "from_ms"], partitions,
           ["session_id", "bucket"], mode)


def write_items(items: DataFrame, path: str, partitions: int | None = None, mode: str = "overwrite",
                clustered: bool = False) -> None:
    """Persist a fuzzy item table (see :func:`convsift.operators.items.build_items`), laid out like ``parts``."""
    _write(items, path, ["project_id", "session_id", "k_msg_ms"], partitions, ["session_id", "part_id", "k_slot", "k_ord"], mode,
           clustered)
