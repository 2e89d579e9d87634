"""Text reports of search and trace results (S8, S9).

Each result row gets its report block as an ``entry`` column built with
``concat_ws`` (null lines vanish), and a ``header`` column with the result
count.  The
full text is assembled on the driver from the ≤ limit rows of a finished
search — the only collect of texts in the library.  The reports of a batch of
queries are written by the executors, an ordered file for each query, with the
counts of an aggregate joined on the query.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ms_to_text, nonempty
from ..session import scratch_path

# The texts of both reports, in the order they are printed.
NO_MATCHES = "No matches found in conversation history."
MATCH_HEADER = "Found {n} matches in conversation history:"
MATCH_LINES = ("## {title}", "- Session ID: {session}", "- Project: {directory}", "- Date: {date}",
               "- Match Type: {type}", '- Excerpt: "{excerpt}"', "- Context: ...{context}...")
NO_TRACE_MATCHES = "No file trace matches found in conversation history."
TRACE_HEADER = "Found {n} file trace matches in conversation history:"
TRACE_LINES = ("## {title}", "- Session ID: {session}", "- Date: {date}", "- Status: {status}",
               "- File: {file}", "- Tool: {tool}", '- Preceding User Prompt: "{prompt}"')
STATUS_FIRST, STATUS_LATER = "First seen", "Later touch"


def _line(template: str, value: Column) -> Column:
    """One report line: the template's text around its single ``{…}`` slot."""
    before, rest = template.split("{", 1)
    after = rest.split("}", 1)[1]
    return F.concat(F.lit(before), F.coalesce(value, F.lit("")), F.lit(after))


def _count_line(template: str, n: Column) -> Column:
    before, after = template.split("{n}")
    return F.concat(F.lit(before), n.cast("string"), F.lit(after))


def _header(template: str) -> Column:
    """Header with the row count of the report.

    A report covers one finished search: at most ``limit`` rows that the
    top-N already left in a single partition, so a window over all rows adds
    no exchange and, unlike a scalar subquery, does not run the search twice.
    """
    return _count_line(template, F.count(F.lit(1)).over(Window.partitionBy()))


def _match_entry() -> Column:
    ctx, ex = F.col("context"), F.col("excerpt")
    title, session, directory, date, mtype, excerpt, context = MATCH_LINES
    return F.concat_ws(
        "\n",
        _line(title, F.col("session_title")),
        _line(session, F.col("session_id")),
        _line(directory, F.col("project_directory")),
        _line(date, ms_to_text(F.col("timestamp"))),
        _line(mtype, F.col("match_type")),
        _line(excerpt, ex),
        F.when(nonempty(ctx) & (ctx != F.coalesce(ex, F.lit(""))), _line(context, ctx)),
    )


def match_entries(matches: DataFrame) -> DataFrame:
    """Add ``entry`` and ``header`` to keyword / fuzzy results."""
    return matches.withColumn("entry", _match_entry()).withColumn("header", _header(MATCH_HEADER))


def _trace_entry() -> Column:
    title, session, date, status, file, tool, prompt = TRACE_LINES
    return F.concat_ws(
        "\n",
        _line(title, F.col("session_title")),
        _line(session, F.col("session_id")),
        _line(date, ms_to_text(F.col("timestamp"))),
        _line(status, F.when(F.col("first_touch"), F.lit(STATUS_FIRST)).otherwise(F.lit(STATUS_LATER))),
        _line(file, F.col("file_path")),
        F.when(nonempty(F.col("tool_name")), _line(tool, F.col("tool_name"))),
        F.when(nonempty(F.col("user_prompt")), _line(prompt, F.col("user_prompt"))),
    )


def trace_entries(traces: DataFrame) -> DataFrame:
    """Add ``entry`` and ``header`` to trace results."""
    return traces.withColumn("entry", _trace_entry()).withColumn("header", _header(TRACE_HEADER))


def batch_entries(traces: DataFrame, by: str = "query") -> DataFrame:
    """Add ``entry`` and ``header`` to the traces of many queries: each has the count of
    its own, from an aggregate joined on the query."""
    counts = traces.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n"))
    return (traces.withColumn("entry", _trace_entry()).join(counts, F.col(by).eqNullSafe(F.col("_by")))
            .withColumn("header", _count_line(TRACE_HEADER, F.col("_n"))).drop("_by", "_n"))


def write_batch_report(traces: DataFrame, path: str, by: str = "query", mode: str = "overwrite") -> None:
    """Text sink of a batch: below ``path`` a folder ``<by>=<query>`` whose files, in the order
    of their names, are the query's report.  Rows are dealt by ranges of (query, place in
    the report): a small report is one file, a long one spreads over several tasks."""
    spark = traces.sparkSession
    keys = [c for c in ("source_priority", "session_id", "message_id", "file_path") if c in traces.columns]
    scratch = scratch_path(spark, f"report-{uuid.uuid4().hex}")
    traces.select(by, "timestamp", *keys, _trace_entry().alias("value")).write.parquet(scratch)
    entries = spark.read.parquet(scratch).withColumn("_head", F.lit(1))
    heads = entries.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    heads = heads.select(by, _count_line(TRACE_HEADER, F.col("_n")).alias("value"), F.lit(0).alias("_head"))
    order = [F.col(by), F.col("_head"), F.col("timestamp").desc_nulls_last(), *(F.col(c) for c in keys)]
    rows = entries.unionByName(heads, allowMissingColumns=True).repartitionByRange(*order).sortWithinPartitions(*order)
    # The writer ends a row with a line feed; an empty line parts the blocks.
    rows.select(by, F.concat("value", F.lit("\n")).alias("value")).write.mode(mode).partitionBy(by).text(path)


def _render(entries: list[str], header: str, empty: str) -> str:
    if not entries:
        return empty
    return header + "\n\n" + "\n\n".join(entries) + "\n"


def write_report(entries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Text sink (S8/S9): one report block per line group, written by the
    executors (``match_entries`` / ``trace_entries`` output).  A finished
    search is one ordered partition, so its report lands in one ordered file;
    a batch result is written in parallel."""
    entries.select(F.concat(F.col("entry"), F.lit("\n")).alias("value")).write.mode(mode).text(path)


def format_matches(matches: DataFrame) -> str:
    """Full report text of a (limited) keyword or fuzzy result."""
    rows = match_entries(matches).select("entry").collect()
    entries = [r["entry"] for r in rows]
    return _render(entries, MATCH_HEADER.format(n=len(entries)), NO_MATCHES)


def format_traces(traces: DataFrame) -> str:
    """Full report text of a (limited) trace result."""
    rows = trace_entries(traces).select("entry").collect()
    entries = [r["entry"] for r in rows]
    return _render(entries, TRACE_HEADER.format(n=len(entries)), NO_TRACE_MATCHES)
