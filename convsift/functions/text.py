"""Column expressions for excerpts, contexts and tool-derived strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nonempty(c: Column) -> Column:
    """JavaScript truthiness of a string: not null and not empty."""
    return c.isNotNull() & (F.length(c) > 0)


def or_else(*cols: Column) -> Column:
    """``a || b || …``: the first non-empty string (null when all are falsy)."""
    return F.coalesce(*[F.when(nonempty(c), c) for c in cols])


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """``text.slice(start, end)`` with 0-based, already clamped bounds."""
    return F.when(end > start, F.substring(text, start + 1, end - start)).otherwise(F.lit(""))


def keyword_context(text: Column, matched: Column, radius: int = 100) -> Column:
    """Window of ``radius`` characters either side of the first occurrence of
    the matched string (not of the match itself)."""
    idx = F.instr(text, matched) - 1
    start = F.greatest(idx - radius, F.lit(0))
    end = F.least(F.length(text), idx + F.length(matched) + radius)
    return slice_text(text, start, end)


def around(text: Column, idx: Column, before: int, after: int) -> Column:
    """``text.slice(max(0, idx-before), min(len, idx+after))``."""
    start = F.greatest(idx - before, F.lit(0))
    end = F.least(F.length(text), idx + after)
    return slice_text(text, start, end)


def tool_label(tool: Column, state_title: Column) -> Column:
    """Fuzzy item text of a tool part: ``tool + " " + (title || "")``."""
    return F.concat(tool, F.lit(" "), F.coalesce(or_else(state_title), F.lit("")))


def tool_name_context(tool: Column, state_title: Column) -> Column:
    """Context of a tool-name match: ``state.title || tool``."""
    return F.coalesce(or_else(state_title, tool), tool)


def tool_io_context(tool: Column, state_title: Column) -> Column:
    """Context of a tool input/output match: ``state.title || tool || ""``."""
    return F.coalesce(or_else(state_title, tool), F.lit(""))


def io_text(input_json: Column, output: Column) -> Column:
    """Input JSON and output joined by one space, as fuzzy indexing reads them."""
    return F.concat(F.coalesce(input_json, F.lit("{}")), F.lit(" "), F.coalesce(output, F.lit("")))


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than the ASCII space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != ""))


def ms_to_text(ms: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Render epoch milliseconds in UTC regardless of the session time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.date_format(F.timestamp_add("MILLISECOND", ms, epoch), fmt)


def ntz_to_ms(ts: Column) -> Column:
    """Epoch milliseconds (truncated) of a TIMESTAMP_NTZ read as UTC."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MILLISECOND", epoch, ts)
