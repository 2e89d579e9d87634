"""Keyword and regular-expression search over a history (C1, C2).

Semantics: walk sessions newest-updated first; a session's title may match,
then its messages (oldest first, optionally one role) and their parts
(oldest first).  A text part yields a ``message`` match, a tool part a
``tool`` match on its name and a ``filepath`` match on its input/output,
a patch part one ``filepath`` match per matching file.  The *first* ``limit``
matches of that walk are kept, then shown newest first.

Plan: ``parts`` is scanned once; each row's possible matches become one
array that is exploded, so no part is read twice.  Title matches come from
``sessions``.  The first-N of the walk is a top-N on the scan key, which
Spark runs as ``TakeOrderedAndProject`` (a bounded heap per task, no global
sort).  Excerpts and contexts (a second regex evaluation) are computed only
for the ≤ N surviving rows; session title and directory travel with each
part (denormalised at ingest), so no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import Matcher
from ..functions.text import (keyword_context, nonempty, or_else, tool_io_context,
                              tool_name_context)
from ..model import (MATCH_COLUMNS, PHASE_PARTS, PHASE_TITLE, SLOT_PATCH, SLOT_TEXT,
                     SLOT_TOOL, SLOT_TOOL_IO, History, scan_order)

DEFAULT_LIMIT = 50
#: Longest text that a match carries whole into the top-N.
CARRIED_CHARS = 2_000

_HIT_FIELDS = ("k_slot", "k_ord", "match_type", "src", "excerpt_fixed", "context_fixed")


def keyword_limit(limit: int | None) -> int:
    """``limit || 50``: missing or zero means 50; negative is an error."""
    if limit is None or limit == 0:
        return DEFAULT_LIMIT
    if limit < 0:
        raise ValueError("limit must not be negative")
    return int(limit)


def _hit(slot: int, ordinal: Column, match_type: str, src: Column | None,
         excerpt: Column | None, context: Column | None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit(slot).alias("k_slot"), ordinal.cast("int").alias("k_ord"),
        F.lit(match_type).alias("match_type"),
        (src if src is not None else null).alias("src"),
        (excerpt if excerpt is not None else null).alias("excerpt_fixed"),
        (context if context is not None else null).alias("context_fixed"))


def title_candidates(sessions: DataFrame, m: Matcher) -> DataFrame:
    """Sessions whose title matches (titles are searched whatever the role)."""
    t = F.col("title")
    return sessions.where(t.isNotNull() & m.test(t)).select(
        F.col("updated_ms").alias("k_updated_ms"), "session_id",
        F.lit(PHASE_TITLE).alias("k_phase"),
        F.lit(None).cast("long").alias("k_msg_ms"), F.lit(None).cast("string").alias("message_id"),
        F.lit(None).cast("long").alias("k_part_ms"), F.lit(None).cast("string").alias("part_id"),
        F.lit(0).alias("k_slot"), F.lit(0).alias("k_ord"),
        F.col("updated_ms").alias("timestamp"), F.lit("title").alias("match_type"),
        F.lit(None).cast("string").alias("src"), t.alias("excerpt_fixed"), t.alias("context_fixed"),
        t.alias("session_title"), F.col("directory").alias("project_directory"))


def part_candidates(parts: DataFrame, m: Matcher) -> DataFrame:
    """All matches of text, tool and patch parts, from one pass over ``parts``."""
    typ, text, tool = F.col("type"), F.col("text"), F.col("tool")
    title = F.col("state_title")
    in_s = F.coalesce(F.col("input_json"), F.lit("{}"))
    out_s = F.coalesce(or_else(F.col("output")), F.lit(""))

    # Long texts leave their excerpt and context behind, so the top-N carries no whole text.
    def long_excerpt(c):
        return F.when(F.length(c) > CARRIED_CHARS, m.first(c))

    def long_context(c):
        return F.when(F.length(c) > CARRIED_CHARS, keyword_context(c, m.first(c)))

    def carried(c):
        return F.when(F.length(c) <= CARRIED_CHARS, c)

    text_hit = (typ == "text") & nonempty(text) & m.test(text)
    tool_hit = (typ == "tool") & nonempty(tool) & m.test(tool)
    io = F.when(m.test(in_s), in_s).otherwise(out_s)
    io_hit = (typ == "tool") & F.coalesce(F.col("has_state"), F.lit(False)) & (m.test(in_s) | m.test(out_s))

    singles = F.array(
        F.when(text_hit, _hit(SLOT_TEXT, F.lit(0), "message", carried(text), long_excerpt(text), long_context(text))),
        F.when(tool_hit, _hit(SLOT_TOOL, F.lit(0), "tool", None, tool, tool_name_context(tool, title))),
        F.when(io_hit, _hit(SLOT_TOOL_IO, F.lit(0), "filepath",
                            carried(io), long_excerpt(io),
                            tool_io_context(tool, title))),
    )
    files = F.when(typ == "patch", F.col("files"))
    file_hits = F.filter(
        F.transform(files, lambda f, i: F.when(
            f.isNotNull() & m.test(f),
            _hit(SLOT_PATCH, i, "filepath", None, f, F.concat(F.lit("Modified file: "), f)))),
        lambda h: h.isNotNull())
    hits = F.array_compact(F.when(files.isNull(), singles).otherwise(F.concat(singles, file_hits)))
    return (
        parts
        .select("session_updated_ms", "session_id", "msg_created_ms", "message_id",
                "created_ms", "part_id", "session_title", "project_directory", F.explode(hits).alias("h"))
        .select(
            F.col("session_updated_ms").alias("k_updated_ms"), "session_id",
            F.lit(PHASE_PARTS).alias("k_phase"),
            F.col("msg_created_ms").alias("k_msg_ms"), "message_id",
            F.col("created_ms").alias("k_part_ms"), "part_id",
            F.col("h.k_slot").alias("k_slot"), F.col("h.k_ord").alias("k_ord"),
            F.col("msg_created_ms").alias("timestamp"),
            *[F.col(f"h.{f}").alias(f) for f in _HIT_FIELDS[2:]],
            "session_title", "project_directory"))


def first_matches(history: History, m: Matcher, limit: int, role: str | None = None,
                  corpus_range=None) -> DataFrame:
    """The first ``limit`` matches in walk order, with the scan key kept."""
    sessions, parts = history.sessions, history.parts
    if role is not None:
        parts = parts.where(F.col("role") == F.lit(role))
    if corpus_range is not None:
        lo, hi = F.lit(corpus_range.start_ms), F.lit(corpus_range.end_ms)
        sessions = sessions.where(F.col("updated_ms").between(lo, hi))
        parts = parts.where(F.col("msg_created_ms").between(lo, hi))
    cands = title_candidates(sessions, m).unionByName(part_candidates(parts, m))
    return cands.orderBy(*scan_order()).limit(limit)


def finish_matches(limited: DataFrame, m: Matcher) -> DataFrame:
    """Render excerpt / context for the ≤ limit rows, newest first.

    The top-N leaves one partition, so this final sort needs no exchange."""
    src = F.col("src")
    excerpt = F.coalesce(F.col("excerpt_fixed"), m.first(src))
    context = F.coalesce(F.col("context_fixed"), keyword_context(src, excerpt))
    # One flat projection keeps the limit a plain top-N below it.
    return (limited.select("*", excerpt.alias("excerpt"), context.alias("context"))
            .orderBy(F.col("timestamp").desc(), *scan_order()))


def search_keyword(history: History, m: Matcher, limit: int | None = None,
                   role: str | None = None, project_id: str | None = None,
                   corpus_range=None, keep_scan_key: bool = False) -> DataFrame:
    """Keyword / regex search; rows newest first.

    ``m`` comes from :func:`convsift.functions.patterns.build_matcher`.
    ``corpus_range`` (a :class:`DateRange`) filters *before* the limit; the
    reference behaviour filters after it (see :mod:`convsift.plans.search`).
    """
    n = keyword_limit(limit)
    if role is not None and role not in ("user", "assistant"):
        raise ValueError("role must be 'user' or 'assistant'")
    h = history.scoped(project_id)
    out = finish_matches(first_matches(h, m, n, role, corpus_range), m)
    if keep_scan_key:
        return out
    return out.select(*MATCH_COLUMNS)
