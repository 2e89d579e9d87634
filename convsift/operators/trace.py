"""File trace: which assistant messages wrote or edited a file (C4, J5).

A *touch* is an assistant ``write``/``edit`` tool call whose input
``filePath`` matches, or an assistant patch part listing a matching file
(its first matching file only).  Touches are de-duplicated per (session,
message, path), tool calls winning over patches.  Exactly one touch — the
earliest over the whole result, before any limit — is flagged
``first_touch``; each touch carries the latest user text that precedes it
in its session.  Rows come newest first; the limit applies last.

Plan (single path): one pass over ``parts`` with the path rule as a
predicate (no union: a part is either a tool call or a patch), its touches written
down once for all that follows, or over the stored touches; the de-duplication is an aggregate with map-side combine; the
arg-min is a scalar subquery (one row, no cross join); ordering + limit is a
top-N, and without a limit (``ALL``) a sort over ranges; the prompt is found by
an equality and a range in the stored validity intervals (built in the same plan
where none are stored).  Session titles travel with the parts.  Results of any
length are also read page by page (:func:`trace_page`): a page starts after the
key of the last row of the one before, so no page sorts those before it.

Plan (batch, :func:`trace_files`): a table of queries is matched with one
equi-join on (key, exact) after each candidate is offered under its full
path and its last component, so the path rule becomes hash join keys; per-query arg-min is an aggregate joined back; per-query limits
use a two-stage top-N (salted, then per query) so one hot query never
lands whole in one task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import PathQuery, last_component, normalize_query_col
from ..model import TRACE_COLUMNS, History
from ..session import written
from .asof import latest_before, look_up, validity_intervals

DEFAULT_LIMIT = 50
#: Limit of a trace that keeps every touch.
ALL = "all"
TOUCH_TOOLS = ("write", "edit")
TOP_N_SALTS = 64


def trace_limit(limit: int | str | None) -> int | None:
    """``limit ?? 50``; zero is kept (no rows), negative is an error, ``ALL`` is None."""
    if limit == ALL:
        return None
    if limit is None:
        return DEFAULT_LIMIT
    if limit < 0:
        raise ValueError("limit must not be negative")
    return int(limit)


def _assistant_parts(parts: DataFrame) -> DataFrame:
    return parts.where((F.col("role") == "assistant") & F.col("type").isin("tool", "patch"))


def _tool_path() -> Column:
    return F.get_json_object(F.col("input_json"), "$.filePath")


def _touch_cols(path: Column) -> list[Column]:
    is_tool = F.col("type") == "tool"
    return [
        "session_id", "session_title", "message_id", "part_id",
        F.col("msg_created_ms").alias("timestamp"),
        F.col("created_ms").alias("part_created_ms"),
        F.when(is_tool, F.lit(0)).otherwise(F.lit(1)).alias("source_priority"),
        F.when(is_tool, F.col("tool")).alias("tool_name"),
        path.alias("file_path"),
    ]


def _stored(path: Column, normalize_stored: bool) -> Column:
    """A stored path as matched: as written, or with ``\\`` turned into ``/``
    (opt-in; by default only the query is normalised)."""
    return normalize_query_col(path) if normalize_stored else path


def build_touches(parts: DataFrame) -> DataFrame:
    """Every path that an assistant's write, edit or patch names, with its last
    component: the stored table of traces.  Inputs are parsed here, once."""
    return _batch_candidates(parts, project=True)


def stored_touches(touches: DataFrame, q: PathQuery) -> DataFrame:
    """Touches of one path from the stored table: an equality on the last component
    that the files are clustered by, then the path rule; of a patch its first file."""
    found = touches.where((F.col("last_component") == q.normalized.rsplit("/", 1)[-1]) & q.matches(F.col("file_path")))
    return _first_of_patch(found, [])


def touches_for(parts: DataFrame, q: PathQuery, normalize_stored: bool = False) -> DataFrame:
    """All touches of one path query (before de-duplication)."""
    is_tool = (F.col("type") == "tool") & F.col("tool").isin(*TOUCH_TOOLS)
    tp = _stored(_tool_path(), normalize_stored)
    files = F.transform(F.col("files"), lambda f: _stored(f, normalize_stored))
    first_file = F.get(F.filter(files, lambda f: f.isNotNull() & q.matches(f)), 0)
    path = (F.when(is_tool, F.when(q.matches(tp), tp))
            .when(F.col("type") == "patch", first_file))
    return (_assistant_parts(parts)
            .select(*_touch_cols(path))
            .where(F.col("file_path").isNotNull() & (F.length("file_path") > 0)))


def dedupe(touches: DataFrame, keys: list[str]) -> DataFrame:
    """Keep one touch per key: tool calls before patches, then part order."""
    best = F.min(F.struct("source_priority", "part_created_ms", "part_id", "tool_name", "timestamp",
                          "session_title"))
    return (touches.groupBy(*keys).agg(best.alias("b"))
            .select(*keys, "b.timestamp", "b.source_priority", "b.tool_name", "b.session_title"))


def _first_key() -> Column:
    return F.struct("timestamp", "source_priority", "session_id", "message_id", "file_path")


def _newest_first() -> list[Column]:
    return [F.col("timestamp").desc(), F.col("source_priority").asc(), F.col("session_id").asc(),
            F.col("message_id").asc(), F.col("file_path").asc()]


def user_prompts(parts: DataFrame) -> DataFrame:
    """User text parts, the candidates of the preceding-prompt lookup."""
    return parts.where((F.col("role") == "user") & (F.col("type") == "text")).select(
        "session_id", "msg_created_ms", "message_id", "created_ms", "part_id", "text")


def _prompt_key() -> list[Column | str]:
    # Latest message first (time, then id); within it the earliest part.
    return ["msg_created_ms", "message_id",
            (-F.coalesce(F.col("created_ms"), F.lit(0))).alias("neg_part_ms"), "part_id"]


def build_prompts(parts: DataFrame) -> DataFrame:
    """The stored table of preceding prompts: per session the intervals of time in which
    a user's text is the latest, in every bucket that an assistant touches files in.
    Only keys pass the windows; the texts are joined to the intervals that are left."""
    touches = _assistant_parts(parts).select("session_id", "msg_created_ms")
    found = validity_intervals(user_prompts(parts), "session_id", "msg_created_ms", F.struct(*_prompt_key()),
                               touches, "msg_created_ms")
    return _with_texts(found, user_prompts(parts), "value").select("session_id", "bucket", "from_ms", "to_ms", "user_prompt")


def _with_texts(df: DataFrame, prompts: DataFrame, key: str) -> DataFrame:
    # A session that two projects have gives each of its texts twice.
    texts = prompts.groupBy(F.col("session_id").alias("_ts"), F.col("message_id").alias("_tm"), F.col("part_id").alias("_tp")).agg(
        F.min("text").alias("user_prompt"))
    same = (F.col("session_id") == F.col("_ts")) & (F.col(f"{key}.message_id") == F.col("_tm")) & (F.col(f"{key}.part_id") == F.col("_tp"))
    return df.join(texts, same, "left").drop("_tm", "_tp", "_ts")


def attach_prompts(touches: DataFrame, history: History, row_bound: int | None) -> DataFrame:
    """The preceding user text of every touch: from the stored intervals, or else from
    those of the touches' own buckets.  For few touches these hold the texts; for an
    unbounded number only keys, and the texts are joined to the touches: the history is
    passed once for both, and only the touches' sessions are looked at."""
    if history.prompts is not None:
        return look_up(touches, history.prompts, "session_id", "timestamp", row_bound)
    value = F.struct(*_prompt_key(), *(["text"] if row_bound is not None else []))
    prompts = user_prompts(history.parts)
    if row_bound is None:
        prompts = written(prompts, "prompts")
        prompts = prompts.join(touches.select("session_id").distinct(), "session_id", "left_semi")
    out = latest_before(touches, prompts, "session_id", "timestamp", "msg_created_ms", value,
                        out_col="prompt", left_row_bound=row_bound)
    if row_bound is not None:
        return out.withColumn("user_prompt", F.col("prompt.text")).drop("prompt")
    return _with_texts(out, prompts, "prompt").drop("prompt")


def _flagged(history: History, q: PathQuery, corpus_range, normalize_stored: bool) -> DataFrame:
    """All touches of one path, without repeats, the earliest flagged."""
    found = (touches_for(history.parts, q, normalize_stored) if history.touches is None or normalize_stored
             else stored_touches(history.touches, q))
    if corpus_range is not None:
        found = found.where(F.col("timestamp").between(F.lit(corpus_range.start_ms),
                                                       F.lit(corpus_range.end_ms)))
    touches = dedupe(found, ["session_id", "message_id", "file_path"])
    if history.touches is None:
        touches = written(touches, "touches")
    first = touches.select(F.min(_first_key())).scalar()
    return touches.withColumn("first_touch", F.coalesce(_first_key() == first, F.lit(False)))


def trace_file(history: History, file_path: str, limit: int | str | None = None,
               project_id: str | None = None, corpus_range=None,
               normalize_stored: bool = False) -> DataFrame:
    """Touch history of one file; rows newest first (``TRACE_COLUMNS``).

    ``limit`` ``ALL`` keeps every touch.  ``corpus_range`` keeps only touches inside a
    :class:`DateRange` *before* the first-touch flag and the limit (prompts are still
    looked up over the whole session)."""
    n = trace_limit(limit)
    h = history.scoped(project_id)
    flagged = _flagged(h, PathQuery.of(file_path), corpus_range, normalize_stored)
    kept = flagged if n is None else flagged.orderBy(*_newest_first()).limit(n)
    return (attach_prompts(kept, h, n)
            .orderBy(*_newest_first())
            .select(*TRACE_COLUMNS))


# Columns of a row's place in a trace, newest first; only the first descends.
_PLACE = ["timestamp", "source_priority", "session_id", "message_id", "file_path"]


def _after(cursor: str) -> Column:
    """Rows that come after a cursor's row (rows without a time are the last)."""
    at = json.loads(cursor)
    rest = F.struct(*_PLACE[1:]) > F.struct(*(F.lit(at[c]).alias(c) for c in _PLACE[1:]))
    time = F.col("timestamp")
    if at["timestamp"] is None:
        return time.isNull() & rest
    return time.isNull() | (time < at["timestamp"]) | ((time == at["timestamp"]) & rest)


def flagged_touches(history: History, file_path: str, project_id: str | None = None) -> DataFrame:
    """All touches of a file, which the pages of one trace can share."""
    return _flagged(history.scoped(project_id), PathQuery.of(file_path), None, False)


def trace_page(history: History, file_path: str, after: str | None = None, size: int = 1000,
               project_id: str | None = None, touches: DataFrame | None = None) -> DataFrame:
    """``size`` rows of the whole trace of a file that come after the row with the cursor
    ``after`` (None: from the newest on), with the ``cursor`` of each.  The pages put
    together are the trace without a limit, the first touch flagged on its page.
    ``touches``: the file's :func:`flagged_touches`, where they have been found before."""
    n = trace_limit(size)
    h = history.scoped(project_id)
    rows = flagged_touches(h, file_path) if touches is None else touches
    if after is not None:
        rows = rows.where(_after(after))
    rows = rows.orderBy(*_newest_first()).limit(n)
    return (attach_prompts(rows, h, n).orderBy(*_newest_first())
            .select(*TRACE_COLUMNS, F.to_json(F.struct(*_PLACE), {"ignoreNullFields": "false"}).alias("cursor")))


def in_page_order(page: DataFrame) -> DataFrame:
    """Rows of a page that was written down, newest first again (by their cursors)."""
    place = F.from_json("cursor", "timestamp long, source_priority int, session_id string, message_id string, file_path string")
    return page.withColumn("_at", place).orderBy(F.col("_at.timestamp").desc(), *(f"_at.{c}" for c in _PLACE[1:])).drop("_at")


def _batch_candidates(parts: DataFrame, normalize_stored: bool = False, project: bool = False) -> DataFrame:
    """Every stored path a touch could match: tool inputs and patch files, in one
    pass (a part is either a tool call or a patch)."""
    is_tool = (F.col("type") == "tool") & F.col("tool").isin(*TOUCH_TOOLS)
    paths = F.when(is_tool, F.array(_tool_path())).when(F.col("type") == "patch", F.col("files"))
    return (_assistant_parts(parts)
            .select("*", F.posexplode(paths).alias("pos", "_f"))
            .select(*_touch_cols(_stored(F.col("_f"), normalize_stored)), "pos", *(["project_id"] if project else []))
            .where(F.col("file_path").isNotNull() & (F.length("file_path") > 0))
            .withColumn("last_component", last_component(F.col("file_path"))))


def _first_of_patch(found: DataFrame, by: list[str]) -> DataFrame:
    """A patch contributes only its first matching file (per ``by``)."""
    return (found.groupBy(*by, "session_id", "session_title", "message_id", "part_id", "timestamp",
                          "part_created_ms", "source_priority", "tool_name")
            .agg(F.min(F.struct("pos", "file_path")).alias("f"))
            .withColumn("file_path", F.col("f.file_path")).drop("f"))


def trace_files(history: History, queries: DataFrame, query_col: str = "query",
                limit_per_query: int | None = None, project_id: str | None = None,
                with_prompts: bool = True, normalize_stored: bool = False) -> DataFrame:
    """Trace every path of ``queries[query_col]`` at once.

    Same per-query semantics as :func:`trace_file` (first touch per query);
    ``limit_per_query=None`` keeps all touches.  Output: ``query`` plus
    ``TRACE_COLUMNS``.
    """
    h = history.scoped(project_id)
    qn = (queries.select(F.col(query_col).alias("query")).distinct()
          .withColumn("q", normalize_query_col(F.col("query")))
          .withColumn("exact", F.instr(F.col("q"), "/") > 0))
    cands = (_batch_candidates(h.parts, normalize_stored) if h.touches is None or normalize_stored
             else h.touches.drop("project_id"))
    # Each candidate is offered under two keys — its full path (for queries
    # with a "/") and its last component (for bare names) — so the path rule
    # is one equi-join on (key, exact).
    keyed = cands.select(*cands.columns, F.explode(F.array(
        F.struct(F.col("file_path").alias("key"), F.lit(True).alias("kexact")),
        F.struct(F.col("last_component").alias("key"), F.lit(False).alias("kexact")))).alias("_k"))
    keyed = keyed.select(*cands.columns, F.col("_k.key").alias("key"), F.col("_k.kexact").alias("kexact"))
    matched = (keyed.join(qn, (keyed["key"] == qn["q"]) & (keyed["kexact"] == qn["exact"]), "inner")
               .drop("q", "exact", "key", "kexact", "last_component"))
    per_part = _first_of_patch(matched, ["query"])
    touches = dedupe(per_part, ["query", "session_id", "message_id", "file_path"])
    if h.touches is None:
        touches = written(touches, "touches")
    firsts = touches.groupBy("query").agg(F.min(_first_key()).alias("_first"))
    flagged = (touches.join(firsts, "query", "inner")
               .withColumn("first_touch", _first_key() == F.col("_first")).drop("_first"))
    n = None if limit_per_query is None else trace_limit(limit_per_query)
    if n is not None:
        flagged = top_n_per_group(flagged, "query", _newest_first(), n)
    out = attach_prompts(flagged, h, None) if with_prompts else \
        flagged.withColumn("user_prompt", F.lit(None).cast("string"))
    return out.select("query", *TRACE_COLUMNS)


def top_n_per_group(df: DataFrame, group: str, order: list[Column], n: int,
                    salts: int = TOP_N_SALTS) -> DataFrame:
    """Exact top-``n`` rows per group without sorting a hot group in one task.

    Stage 1 keeps the top-n of each (group, salt) slice; the true top-n of a
    group is contained in the union of its slices, so stage 2 ranks at most
    ``salts * n`` rows per group.
    """
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != group]), F.lit(salts))
    w1 = Window.partitionBy(group, "_salt").orderBy(*order)
    w2 = Window.partitionBy(group).orderBy(*order)
    stage1 = (df.withColumn("_salt", salt)
              .withColumn("_rn", F.row_number().over(w1)).where(F.col("_rn") <= n))
    return (stage1.withColumn("_rn", F.row_number().over(w2)).where(F.col("_rn") <= n)
            .drop("_salt", "_rn"))
