"""Schemas of the normalised history tables and of search results.

A history is three flat tables (project -> session -> message -> part is
held as columns, not as nesting):

* ``sessions``  one row per session
* ``messages``  one row per message, with its session's project
* ``parts``     one row per searchable part, denormalised at ingest with
  the owning message's role / creation time and the session's project,
  update time, title and directory, so that every search is one scan of
  ``parts`` (plus ``sessions`` for title matches) with no join at all.

Times are epoch milliseconds (BIGINT) everywhere; they are only turned into
timestamps for display.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SESSION_SCHEMA = T.StructType([
    T.StructField("session_id", T.StringType(), False),
    T.StructField("project_id", T.StringType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("directory", T.StringType(), True),
    T.StructField("created_ms", T.LongType(), True),
    T.StructField("updated_ms", T.LongType(), True),
])

MESSAGE_SCHEMA = T.StructType([
    T.StructField("message_id", T.StringType(), False),
    T.StructField("session_id", T.StringType(), False),
    T.StructField("project_id", T.StringType(), True),
    T.StructField("role", T.StringType(), True),
    T.StructField("agent", T.StringType(), True),
    T.StructField("created_ms", T.LongType(), True),
])

PART_SCHEMA = T.StructType([
    T.StructField("part_id", T.StringType(), False),
    T.StructField("message_id", T.StringType(), False),
    T.StructField("session_id", T.StringType(), False),
    T.StructField("project_id", T.StringType(), True),
    T.StructField("role", T.StringType(), True),
    T.StructField("msg_created_ms", T.LongType(), True),
    T.StructField("session_updated_ms", T.LongType(), True),
    T.StructField("session_title", T.StringType(), True),
    T.StructField("project_directory", T.StringType(), True),
    T.StructField("created_ms", T.LongType(), True),
    T.StructField("type", T.StringType(), False),
    T.StructField("text", T.StringType(), True),
    T.StructField("tool", T.StringType(), True),
    T.StructField("has_state", T.BooleanType(), True),
    T.StructField("input_json", T.StringType(), True),
    T.StructField("output", T.StringType(), True),
    T.StructField("state_title", T.StringType(), True),
    T.StructField("files", T.ArrayType(T.StringType()), True),
])

# Output shape of keyword and fuzzy search (one row per match).
MATCH_COLUMNS = [
    "session_id", "session_title", "timestamp", "match_type", "excerpt",
    "context", "message_id", "part_id", "project_directory",
]

# Output shape of the file trace (one row per touch).
TRACE_COLUMNS = [
    "session_id", "session_title", "timestamp", "first_touch", "user_prompt",
    "tool_name", "file_path",
]

# The part types a history keeps, and the match types.
PART_TYPES = ("text", "tool", "file", "patch")
MATCH_TYPES = ("title", "message", "tool", "filepath")
ROLES = ("user", "assistant")

# Slots order the rows one part can yield: text, tool name, tool I/O, patch files.
SLOT_TEXT, SLOT_TOOL, SLOT_TOOL_IO, SLOT_PATCH = 0, 1, 2, 3
PHASE_TITLE, PHASE_PARTS = 0, 1

# Column names of the scan key (see ``scan_order``).
SCAN_KEY = [
    "k_updated_ms", "session_id", "k_phase", "k_msg_ms", "message_id",
    "k_part_ms", "part_id", "k_slot", "k_ord",
]


def scan_order() -> list[Column]:
    """Total order in which a sequential walk over the history meets rows.

    Sessions newest-updated first, then inside a session the title, then
    messages oldest first, parts oldest first, the slots of a part, and the
    position inside a list.  Ids break every tie so the order is total.
    """
    return [
        F.col("k_updated_ms").desc_nulls_last(),
        F.col("session_id").asc(),
        F.col("k_phase").asc(),
        F.col("k_msg_ms").asc_nulls_first(),
        F.col("message_id").asc_nulls_first(),
        F.col("k_part_ms").asc_nulls_first(),
        F.col("part_id").asc_nulls_first(),
        F.col("k_slot").asc(),
        F.col("k_ord").asc(),
    ]


@dataclass(frozen=True)
class History:
    """The three normalised relations of one conversation archive.

    A stored history also carries tables derived from them at ingest: the ``items``
    of fuzzy search, the ``touches`` of file traces and the ``prompts`` before them.
    """

    sessions: DataFrame
    messages: DataFrame
    parts: DataFrame
    items: DataFrame | None = None
    touches: DataFrame | None = None
    prompts: DataFrame | None = None

    def scoped(self, project_id: str | None) -> "History":
        """Restrict to one project; ``None`` keeps all projects."""
        if project_id is None:
            return self
        p = F.lit(project_id)
        scoped = (None if t is None else t.where(F.col("project_id") == p) for t in (
            self.sessions, self.messages, self.parts, self.items, self.touches))
        return History(*scoped, self.prompts)  # prompts are found by session
