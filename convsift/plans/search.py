"""The unified search entry (C5) and the date-filter placement (C6).

``search`` mirrors the reference tool's arguments: a file path, when given,
wins (only limit, date and project scope then apply); otherwise the query
runs in keyword (default) or fuzzy mode.  The date filter is applied to the
*result*, after the limit, as the reference does; ``date_scope='corpus'``
filters the history first instead (and is pushed into the scan).
``search_report`` renders the text report of the same call.
"""

from __future__ import annotations

from datetime import datetime, timezone, tzinfo

from pyspark.sql import DataFrame, SparkSession

from ..functions.dates import filter_by_date, parse_date_filter
from ..functions.patterns import build_matcher
from ..model import History
from ..operators.fuzzy import search_fuzzy
from ..operators.keyword import search_keyword
from ..operators.report import format_matches, format_traces
from ..operators.trace import trace_file
from ..sources.store import load_matching, load_store

MODES = ("keyword", "fuzzy")
DATE_SCOPES = ("result", "corpus")


def search(history: History, query: str | None = None, file_path: str | None = None,
           mode: str = "keyword", regex: bool = False, case_sensitive: bool = False,
           fuzzy_threshold: float | None = None, date: str | None = None,
           limit: int | None = None, role: str | None = None, project_id: str | None = None,
           date_scope: str = "result", now: datetime | None = None, tz: tzinfo = timezone.utc,
           items: DataFrame | None = None) -> DataFrame:
    """Run one search; returns match rows, or trace rows when ``file_path``
    is given.  ``project_id=None`` searches all projects."""
    if not query and not file_path:
        raise ValueError("Either 'query' or 'filePath' must be provided.")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if date_scope not in DATE_SCOPES:
        raise ValueError(f"date_scope must be one of {DATE_SCOPES}")
    rng = parse_date_filter(date, now=now, tz=tz) if date else None
    corpus = rng if date_scope == "corpus" else None

    if file_path:
        out = trace_file(history, file_path, limit=limit, project_id=project_id, corpus_range=corpus)
    elif mode == "fuzzy":
        out = search_fuzzy(history, query, threshold=fuzzy_threshold, limit=limit, role=role,
                           project_id=project_id, items=items, corpus_range=corpus)
    else:
        spark = history.sessions.sparkSession
        m = build_matcher(query, regex=regex, case_sensitive=case_sensitive, spark=spark)
        out = search_keyword(history, m, limit=limit, role=role, project_id=project_id,
                             corpus_range=corpus)
    if rng is not None and date_scope == "result":
        out = filter_by_date(out, rng)
    return out


def search_store(spark: SparkSession, store: str, **kwargs) -> DataFrame:
    """:func:`search` in a store (:mod:`convsift.sources.store`); a keyword search reads only
    the slots that hold its pattern's trigrams."""
    query, project = kwargs.get("query"), kwargs.get("project_id")
    if query and not kwargs.get("file_path") and kwargs.get("mode", "keyword") == "keyword":
        history = load_matching(spark, store, query, kwargs.get("regex", False), project)
    else:
        history = load_store(spark, store, project)
    return search(history, **kwargs)


def search_report(history: History, **kwargs) -> str:
    """Text report of :func:`search` (the tool's return value)."""
    df = search(history, **kwargs)
    return format_traces(df) if kwargs.get("file_path") else format_matches(df)
