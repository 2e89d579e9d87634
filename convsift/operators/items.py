"""The searchable-item table of fuzzy search (G5, with G2/G3/U3).

One row per string the fuzzy search ranks: session titles, message texts,
tool labels (``tool + " " + title``), path-like tokens of tool input and
output, and patch file names.  Built from one pass over ``parts`` (an
``explode`` of a per-row array) plus ``sessions``; it carries the scan key
so it can be written once as Parquet and searched many times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import io_text, nonempty, tool_label, word_count
from ..model import (PHASE_PARTS, PHASE_TITLE, SLOT_PATCH, SLOT_TEXT, SLOT_TOOL, SLOT_TOOL_IO,
                     History)

# Fixed value: a path-like token is one or more "/name" runs, where a name
# excludes "/" and every character JavaScript's \s matches (written out,
# because Java's \s is ASCII-only).
JS_SPACE_CLASS = ("\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}"
                  "\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}")
PATH_TOKEN = "(?:/[^/" + JS_SPACE_CLASS + "]+)+"

ITEM_COLUMNS = [
    "project_id", "role", "session_id", "message_id", "part_id", "timestamp", "match_type",
    "content", "k_updated_ms", "k_phase", "k_msg_ms", "k_part_ms", "k_slot", "k_ord",
    "session_title", "project_directory", "n_words",
]

_ITEM_TYPE = "array<struct<k_slot:int,k_ord:int,match_type:string,content:string>>"


def _item(slot: int, ordinal: Column, match_type: str, content: Column) -> Column:
    return F.struct(F.lit(slot).alias("k_slot"), ordinal.cast("int").alias("k_ord"),
                    F.lit(match_type).alias("match_type"), content.alias("content"))


def _list_items(values: Column, slot: int) -> Column:
    return F.filter(F.transform(values, lambda v, i: F.when(v.isNotNull(), _item(slot, i, "filepath", v))),
                    lambda x: x.isNotNull())


def title_items(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        "project_id", F.lit(None).cast("string").alias("role"), "session_id",
        F.lit(None).cast("string").alias("message_id"), F.lit(None).cast("string").alias("part_id"),
        F.col("updated_ms").alias("timestamp"), F.lit("title").alias("match_type"),
        F.col("title").alias("content"), F.col("updated_ms").alias("k_updated_ms"),
        F.lit(PHASE_TITLE).alias("k_phase"), F.lit(None).cast("long").alias("k_msg_ms"),
        F.lit(None).cast("long").alias("k_part_ms"), F.lit(0).alias("k_slot"), F.lit(0).alias("k_ord"),
        F.col("title").alias("session_title"), F.col("directory").alias("project_directory"))


def part_items(parts: DataFrame) -> DataFrame:
    typ, text, tool = F.col("type"), F.col("text"), F.col("tool")
    is_tool = typ == "tool"
    has_state = F.coalesce(F.col("has_state"), F.lit(False))
    singles = F.array(
        F.when((typ == "text") & nonempty(text), _item(SLOT_TEXT, F.lit(0), "message", text)),
        F.when(is_tool & nonempty(tool), _item(SLOT_TOOL, F.lit(0), "tool", tool_label(tool, F.col("state_title")))),
    )
    tokens = F.when(is_tool & has_state, F.regexp_extract_all(io_text(F.col("input_json"), F.col("output")),
                                                               F.lit(PATH_TOKEN), 0))
    files = F.when(typ == "patch", F.col("files"))
    lists = F.concat(singles,
                     F.coalesce(_list_items(tokens, SLOT_TOOL_IO), F.array().cast(_ITEM_TYPE)),
                     F.coalesce(_list_items(files, SLOT_PATCH), F.array().cast(_ITEM_TYPE)))
    return (parts.select("project_id", "role", "session_id", "message_id", "part_id", "msg_created_ms",
                         "created_ms", "session_updated_ms", "session_title", "project_directory",
                         F.explode(F.array_compact(lists)).alias("it"))
            .select("project_id", "role", "session_id", "message_id", "part_id",
                    F.col("msg_created_ms").alias("timestamp"), F.col("it.match_type").alias("match_type"),
                    F.col("it.content").alias("content"), F.col("session_updated_ms").alias("k_updated_ms"),
                    F.lit(PHASE_PARTS).alias("k_phase"), F.col("msg_created_ms").alias("k_msg_ms"),
                    F.col("created_ms").alias("k_part_ms"), F.col("it.k_slot").alias("k_slot"),
                    F.col("it.k_ord").alias("k_ord"), "session_title", "project_directory"))


def build_items(history: History) -> DataFrame:
    """All searchable items of a history (``ITEM_COLUMNS``).

    ``role`` is the message role (null for titles, which every role sees);
    ``n_words`` (runs of non-space characters) is the ranking's length term,
    computed once here rather than by every search.
    """
    items = title_items(history.sessions).unionByName(part_items(history.parts))
    return with_word_count(items).select(*ITEM_COLUMNS)


def with_word_count(items: DataFrame) -> DataFrame:
    return items.withColumn("n_words", word_count(F.col("content")))
