"""

Every query builds the history from the benchmark tables of ``sf_dir``
(through the raw-table adapters and the normaliser) and runs one operator
over all of it.  ``oracle_sql`` states the same result for DuckDB.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from convsift.functions.dates import filter_by_date, parse_date_filter
from convsift.functions.patterns import build_matcher
from convsift.functions.editdist import allowed_errors
from convsift.operators.fuzzy import MIN_MATCH_CHARS, search_fuzzy
from convsift.operators.items import PATH_TOKEN, build_items
from convsift.operators.keyword import search_keyword
from convsift.operators.report import batch_entries, match_entries, trace_entries
from convsift.operators.trace import ALL as ALL_TOUCHES
from convsift.operators.trace import flagged_touches, in_page_order, trace_file, trace_files, trace_page
from convsift.plans import oracle_sql as O
from convsift.plans.search import search, search_store
from convsift.sources.driver_tables import conversation_tables, driver_history, event_tables
from convsift.sources.history import load_history, write_history
from convsift.session import scratch_path, written
from convsift.sources.store import ingest_frames, load_store, rejects
from convsift.sources.tables import assemble, decode_parts
from convsift.sources.tree import decode_message_files, decode_part_files, decode_session_files

try:  # the training-data operators and their pipeline are optional
    import corpus_pipeline
    from convsift.llm import registry as llm_registry
except ModuleNotFoundError as error:
    if error.name not in ("corpus_pipeline", "convsift.llm"):
        raise
    corpus_pipeline = llm_registry = None

ALL = ("conv", "evt", "page", "doc")
SMOKE_DIR = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ helpers

def _hist(spark: SparkSession, sf_dir: str, sources=ALL):
    return driver_history(spark, sf_dir, sources)


def _kw(spark, sf_dir, *, query, sources=ALL, regex=False, case_sensitive=False, limit=50,
        role=None, project_id=None, date=None):
    h = _hist(spark, sf_dir, sources)
    m = build_matcher(query, regex=regex, case_sensitive=case_sensitive, spark=spark)
    out = search_keyword(h, m, limit=limit, role=role, project_id=project_id)
    if date is not None:
        out = filter_by_date(out, parse_date_filter(date))
    return out


def _kw_sql(*, query, sources=ALL, regex=False, case_sensitive=False, limit=50, role=None,
            project_id=None, date_bounds=None, report=False):
    return O.keyword_sql(O.SqlMatcher(query, regex, case_sensitive), limit, sources, role,
                         project_id, date_bounds, report)


def _trace(spark, sf_dir, *, path, limit=50, project_id=None, sources=("evt",)):
    return trace_file(_hist(spark, sf_dir, sources), path, limit=limit, project_id=project_id)


def _event_basenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace queries derived from the data: every file name the events touch,
    plus the shared file by full path."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    names = ev.select(F.concat(F.lit("f"), F.get_json_object("props", "$.k"), F.lit(".ts")).alias("query"))
    return names.unionByName(spark.range(1).select(F.lit("src/shared.ts").alias("query"))).distinct()


BATCH_QUERIES_SQL = ("SELECT DISTINCT concat('f', json_extract_string(props, '$.k'), '.ts') AS query FROM events "
                     "UNION SELECT 'src/shared.ts'")


# ------------------------------------------------------------------ queries

def q_normalise_sessions(spark, sf_dir):
    return _hist(spark, sf_dir).sessions


def q_normalise_messages(spark, sf_dir):
    return _hist(spark, sf_dir).messages


def q_normalise_parts(spark, sf_dir):
    return _hist(spark, sf_dir).parts.withColumn("files", F.to_json("files"))


def q_project_scope(spark, sf_dir):
    return _hist(spark, sf_dir, ("conv", "evt")).scoped("proj_1").parts.select(
        "part_id", "session_id", "project_id", "type", "msg_created_ms")


def q_role_filter(spark, sf_dir):
    m = _hist(spark, sf_dir, ("conv", "evt")).messages
    return m.where(F.col("role") == "assistant")


def q_date_filter_range(spark, sf_dir):
    m = _hist(spark, sf_dir, ("evt",)).messages.withColumnRenamed("created_ms", "timestamp")
    return filter_by_date(m, parse_date_filter("2024-01-05 to 2024-01-09"))


def q_date_filter_relative(spark, sf_dir):
    now = datetime(2024, 1, 20, 12, 30, tzinfo=timezone.utc)
    m = _hist(spark, sf_dir, ("evt",)).messages.withColumnRenamed("created_ms", "timestamp")
    return filter_by_date(m, parse_date_filter("last 1 week", now=now))


#: Date forms relative to a fixed moment, and the bounds that they mean.
NOW = datetime(2024, 1, 20, 12, 30, tzinfo=timezone.utc)
_DATE_FORMS = {
    "date_filter_today": ("today", "2024-01-20 00:00:00", "2024-01-20 23:59:59.999"),
    "date_filter_yesterday": ("yesterday", "2024-01-19 00:00:00", "2024-01-19 23:59:59.999"),
    "date_filter_days": ("last 3 days", "2024-01-17 00:00:00", "2024-01-20 12:30:00"),
    "date_filter_months": ("last 2 months", "2023-11-20 00:00:00", "2024-01-20 12:30:00"),
}


def _date_form(spark, sf_dir, *, form):
    m = _hist(spark, sf_dir, ("evt",)).messages.withColumnRenamed("created_ms", "timestamp")
    return filter_by_date(m, parse_date_filter(form, now=NOW))


# ------------------------------------------------- damaged and odd payloads

def _odd_parts(spark, sf_dir, case):
    """Parts of the events adapter, every fifth payload changed (by event number)."""
    raw = event_tables(spark, sf_dir)
    n = F.regexp_extract("message_id", "([0-9]+)$", 1).cast("long")
    data = F.col("data")
    changed = {
        "malformed": F.concat(data, F.lit("}")).substr(F.lit(2), F.length(data)),
        "mistyped": F.concat(F.lit('{"state":"done","files":"x",'), F.regexp_replace(data, '"(state|files)":', '"_$1":').substr(F.lit(2), F.length(data) + 2)),
        "other": F.lit('{"type":"step-start","text":"x","files":["a"]}'),
    }[case]
    part = raw.part.withColumn("data", F.when(n % 5 == 0, changed).otherwise(data))
    return decode_parts(part).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("files")).cast("long").alias("files"),
        F.sum(F.length("input_json")).cast("long").alias("input_chars"),
        F.sum(F.col("has_state").cast("int")).cast("long").alias("states"))


_ODD_SQL = {
    "malformed": ("n % 5 <> 0", "n % 5 <> 0"),
    "mistyped": ("true", "n % 5 <> 0"),
    "other": ("n % 5 <> 0", "n % 5 <> 0"),
}


def _odd_parts_sql(case):
    """Counts over the normalised parts; changed rows are gone or have lost their odd fields."""
    kept, whole = _ODD_SQL[case]
    return f"""{O.history_ctes(('evt',))},
p AS (SELECT *, regexp_extract(message_id, '([0-9]+)$', 1)::BIGINT AS n FROM parts)
SELECT type, count(*) AS n, sum(CASE WHEN {whole} THEN len(files) END)::BIGINT AS files,
       sum(CASE WHEN {whole} THEN length(input_json) WHEN type = 'tool' THEN 2 END)::BIGINT AS input_chars,
       sum((type = 'tool')::INT)::BIGINT AS states
FROM p WHERE {kept} GROUP BY type"""


# ------------------------------------------------------ one object per file

def _tree_files(spark, sf_dir) -> dict[str, DataFrame]:
    return _raw_files(event_tables(spark, sf_dir))


def _raw_files(raw) -> dict[str, DataFrame]:
    """An adapter's rows as the files of a JSON tree, a frame (id, folder, n, data) for each
    level; the folder names the owner, n is the number that the row's owner ends with."""
    def stamped(data, ident, times):
        head = F.concat(F.lit('{"id":"'), ident, F.lit('","time":{'), times, F.lit("}"))
        return F.concat(head, F.when(data == "{}", F.lit("}")).otherwise(F.concat(F.lit(","), data.substr(F.lit(2), F.length(data)))))

    created = F.concat(F.lit('"created":'), F.col("time_created").cast("string"))
    both = F.concat(created, F.lit(',"updated":'), F.col("time_updated").cast("string"))

    def files(rows, folder, owner, data):
        n = F.regexp_extract(owner, "([0-9]+)$", 1).cast("long").alias("n")
        return rows.select(F.col("id"), F.col(folder).alias("folder"), n, data.alias("data"))

    return {"session": files(raw.session, "project_id", "id", stamped(F.to_json(F.struct("title", "directory")), F.col("id"), both)),
            "message": files(raw.message, "session_id", "id", stamped(F.col("data"), F.col("id"), created)),
            "part": files(raw.part, "message_id", "message_id", stamped(F.col("data"), F.col("id"), created))}


def _tree(spark, sf_dir):
    """History of the tree; every seventh session file is torn, so its messages and parts go."""
    files = _tree_files(spark, sf_dir)
    torn = files["session"].withColumn("data", F.when(F.col("n") % 7 == 3, F.substring("data", 1, 20)).otherwise(F.col("data")))
    return assemble(decode_session_files(torn), decode_message_files(files["message"]), decode_part_files(files["part"]), trim_keys=True)


# ------------------------------------------------------- growing histories

def _grown(spark, sf_dir):
    """A store after two ingests of the tree, and the versions.  The first one sees draft
    titles, torn and missing session files, messages and parts that are not there yet, and
    files that will go; the second one sees the tree as it is."""
    n, now = F.col("n"), {}
    for level, files in _tree_files(spark, sf_dir).items():
        src = F.concat_ws("/", F.lit(level), "folder", "id")
        # The files are there before either ingest, which lists and reads them.
        there = scratch_path(spark, f"files-{uuid.uuid4().hex}")
        files.select(src.alias("src"), "folder", "data", "n").write.parquet(there)
        now[level] = spark.read.parquet(there).withColumn("modified", F.lit(2).cast("long"))
    same = F.lit(1).cast("long")
    sessions = now["session"].where(n % 11 != 4).withColumn("data", F.when(n % 7 == 3, F.substring("data", 1, 20)).when(
        n % 2 == 0, F.regexp_replace("data", '"title":"', '"title":"Draft: ')).otherwise(F.col("data")))
    messages = now["message"].where(n % 4 != 1)
    parts = now["part"].where(n % 6 != 5).withColumn("data", F.when(n % 9 == 0, F.lit('{"id":"x","type":"step"}')).otherwise(F.col("data")))
    extra = parts.where(n % 10 == 0).withColumn("src", F.concat("src", F.lit("-draft"))).withColumn(
        "data", F.regexp_replace("data", '^\\{"id":"', '{"id":"draft-'))
    before = {"session": sessions, "message": messages, "part": parts.unionByName(extra)}
    # Files that stay as they are keep their time.
    old = {level: f.withColumn("modified", same) for level, f in before.items()}
    now["message"] = now["message"].withColumn("modified", F.when(n % 4 != 1, same).otherwise(F.col("modified")))
    now["part"] = now["part"].withColumn("modified", F.when((n % 6 != 5) & (n % 9 != 0), same).otherwise(F.col("modified")))
    path = scratch_path(spark, f"grown-{uuid.uuid4().hex}")
    versions = [ingest_frames(spark, path, files, slots=16) for files in (old, now)]
    return path, versions


def q_grown_parts(spark, sf_dir):
    path, _ = _grown(spark, sf_dir)
    return load_store(spark, path).parts.withColumn("files", F.to_json("files"))


def q_grown_trace(spark, sf_dir):
    path, _ = _grown(spark, sf_dir)
    return trace_files(load_store(spark, path), _event_basenames(spark, sf_dir))


def q_grown_items(spark, sf_dir):
    path, _ = _grown(spark, sf_dir)
    return load_store(spark, path).items


def _conversation_store(spark, sf_dir) -> str:
    """A store of the conversations, one file a row."""
    raw = conversation_tables(spark, sf_dir)
    path = scratch_path(spark, f"conversations-{uuid.uuid4().hex}")
    files = {level: f.withColumn("src", F.concat_ws("/", F.lit(level), "folder", "id")).withColumn("modified", F.lit(1).cast("long"))
             for level, f in _raw_files(raw).items()}
    ingest_frames(spark, path, files, slots=16)
    return path


def _posted(spark, sf_dir, *, query, regex=False, limit=50):
    return search_store(spark, _conversation_store(spark, sf_dir), query=query, regex=regex, limit=limit)


def q_stored_history(spark, sf_dir):
    """A trace in tables that were written and loaded."""
    path = scratch_path(spark, f"stored-{uuid.uuid4().hex}")
    write_history(_hist(spark, sf_dir, ("evt",)), path)
    return trace_file(load_history(spark, path), "f7.ts", limit=ALL_TOUCHES)


def q_ingest_rejects(spark, sf_dir):
    """Files without a row by level and reason, after either ingest."""
    path, versions = _grown(spark, sf_dir)
    counts = [rejects(spark, path, v).groupBy("level", "reason").agg(F.count(F.lit(1)).alias("files")).withColumn("version", F.lit(v.number))
              for v in versions]
    return counts[0].unionByName(counts[1])


REJECTS_SQL = """
WITH s AS (SELECT DISTINCT user_id AS n FROM events),
p AS (SELECT event_id AS n, unnest(CASE WHEN event_type = 'purchase' THEN [0, 1] ELSE [0] END) FROM events)
SELECT 'session' AS level, 'malformed' AS reason, count(*) AS files, 1 AS version FROM s WHERE n % 7 = 3 AND n % 11 <> 4 HAVING count(*) > 0
UNION ALL
SELECT 'part', 'other type', count(*) + sum((n % 10 = 0)::INT)::BIGINT, 1 FROM p WHERE n % 9 = 0 AND n % 6 <> 5 HAVING count(*) > 0"""


def q_tree_parts(spark, sf_dir):
    return _tree(spark, sf_dir).parts.withColumn("files", F.to_json("files"))


_TREE_KEPT = "regexp_extract(session_id, '([0-9]+)$', 1)::BIGINT % 7 <> 3"


def q_date_filter_month(spark, sf_dir):
    s = _hist(spark, sf_dir, ("conv", "page")).sessions.withColumnRenamed("updated_ms", "timestamp")
    return filter_by_date(s, parse_date_filter("2024-02"))


def q_report_matches(spark, sf_dir):
    return match_entries(_kw(spark, sf_dir, query="tion", sources=("conv",), limit=20))


def q_report_trace(spark, sf_dir):
    return trace_entries(_trace(spark, sf_dir, path="f3.ts", limit=20))


def q_trace_pages(spark, sf_dir):
    """Three pages of 400 rows, each after the last row of the one before."""
    h, after, pages = _hist(spark, sf_dir, ("evt",)), None, []
    touches = flagged_touches(h, "shared.ts")
    for number in (1, 2, 3):
        page = in_page_order(written(trace_page(h, "shared.ts", after, 400, touches=touches), f"page-{number}"))
        pages.append(page.drop("cursor").withColumn("page", F.lit(number)))
        last = page.select("cursor").tail(1)
        if not last:
            break
        after = last[0].cursor
    return reduce(DataFrame.unionByName, pages)


def q_trace_batch(spark, sf_dir):
    h = _hist(spark, sf_dir, ("evt",))
    return trace_files(h, _event_basenames(spark, sf_dir))


def q_report_batch(spark, sf_dir):
    return batch_entries(q_trace_batch_limited(spark, sf_dir))


def q_trace_batch_limited(spark, sf_dir):
    h = _hist(spark, sf_dir, ("evt",))
    return trace_files(h, _event_basenames(spark, sf_dir), limit_per_query=5)


_KEYWORD = {
    "keyword_literal": dict(query="tion", sources=("conv",), limit=25),
    "keyword_case_sensitive": dict(query="The", sources=("conv",), case_sensitive=True, limit=40),
    "keyword_regex": dict(query="wh[a-z]+n", sources=("conv",), regex=True, limit=30),
    "keyword_role_titles": dict(query="the", sources=("conv",), role="assistant", limit=200),
    "keyword_tool_io": dict(query="f12.ts", sources=("evt",), limit=80),
    "keyword_patch_files": dict(query="/fr/", sources=("page",), limit=60),
    "keyword_limit_scan_order": dict(query="an", sources=("conv",), limit=7),
    "keyword_project_scope": dict(query="er", sources=("conv", "evt"), project_id="proj_1", limit=30),
    "keyword_all_sources": dict(query="at", sources=ALL, limit=50),
    "keyword_documents": dict(query="tion", sources=("doc",), limit=50),
    "keyword_documents_regex": dict(query="ver[a-z]+ung", sources=("doc",), regex=True, limit=40),
    "keyword_regex_dialect": dict(query=r'[{[]"k":\s*"?1[^]*}$', sources=("evt",), regex=True, limit=45),
    "keyword_default_limit": dict(query="e", sources=("conv",), limit=None),
    "keyword_documents_role": dict(query="keit", sources=("doc",), role="assistant", limit=30),
}
#: The same pattern in the SQL engine's dialect, where that differs.
_SQL_PATTERNS = {"keyword_regex_dialect": r'[{\[]"k":\s*"?1[\s\S]*\}\z'}
#: Searches that look their trigrams up first; the last one has none and reads everything.
_POSTED = {
    "keyword_postings": dict(query="reaument", limit=40),
    "keyword_postings_regex": dict(query="ver[a-z]+tion", regex=True, limit=40),
    "keyword_postings_none": dict(query="t.on", regex=True, limit=40),
}
_KEYWORD_DATE = {
    "keyword_limit_then_date": (dict(query="the", sources=("conv",), limit=40),
                                "2024-01-04",
                                ("2024-01-04 00:00:00", "2024-01-04 23:59:59.999")),
}
#: A query of 90 characters, so of two machine words, with two errors.
LONG_QUERY = "Thsh was tionlywh onershann, by thtion threea. Onth the ly ated ononea of with.\nOf shou an"
_FUZZY = {
    "fuzzy_substring": dict(query="thatantion", threshold=0.3, limit=30, sources=("conv",)),
    "fuzzy_topk": dict(query="reaument", threshold=0.25, limit=10, role="user", sources=("conv",)),
    "fuzzy_default_threshold": dict(query="whenever", limit=50, sources=("conv",)),
    "fuzzy_paths": dict(query="shared.ts", threshold=0.2, limit=40, sources=("evt",)),
    "fuzzy_default_limit": dict(query="the", limit=None, sources=("conv",), role="user"),
    "fuzzy_documents": dict(query="reaument", threshold=0.25, limit=20, sources=("doc",)),
    "fuzzy_long_query": dict(query=LONG_QUERY, threshold=0.03, limit=20, sources=("conv",)),
    "fuzzy_no_match": dict(query="qwertyuiop", threshold=0.1, limit=5, sources=("conv",)),
}
_TRACE = {
    "trace_exact": dict(path="src/f12.ts"),
    "trace_basename": dict(path="f7.ts", project_id="proj_1", limit=30),
    "trace_backslash": dict(path="src\\f7.ts", project_id="proj_1", limit=30),
    "trace_shared_patch_only": dict(path="src/shared.ts", limit=100),
    "trace_first_touch_all": dict(path="shared.ts", limit=ALL_TOUCHES),
    "trace_prompt_asof": dict(path="src/f7.ts", limit=ALL_TOUCHES),
    "trace_default_limit": dict(path="shared.ts", limit=None),
    "trace_first_touch": dict(path="f7.ts", project_id="proj_2", limit=3),
}


def _fz(spark, sf_dir, *, query, threshold=None, limit=50, role=None, project_id=None, sources=ALL):
    h = _hist(spark, sf_dir, sources)
    return search_fuzzy(h, query, threshold=threshold, limit=limit, role=role, project_id=project_id)


def _fz_sql(*, query, threshold=None, limit=50, role=None, project_id=None, sources=ALL):
    limit = 50 if limit is None else limit
    t = 0.4 if threshold is None else threshold
    m = len(query)
    k = min(allowed_errors(m, t), m - MIN_MATCH_CHARS)
    return O.fuzzy_sql(query, k, limit, PATH_TOKEN, sources, role, project_id)


def q_items_build(spark, sf_dir):
    return build_items(_hist(spark, sf_dir))


def q_items_paths(spark, sf_dir):
    it = build_items(_hist(spark, sf_dir, ("page",)))
    return it.where((F.col("match_type") == "filepath") & (F.col("k_slot") == 2))


def q_unified_trace_date(spark, sf_dir):
    return search(_hist(spark, sf_dir, ("evt",)), file_path="f12.ts", date="2024-01-10 to 2024-01-20")


def q_unified_keyword_corpus_date(spark, sf_dir):
    return search(_hist(spark, sf_dir, ("conv",)), query="the", limit=30, date="2024-01-03",
                  date_scope="corpus")


def q_unified_fuzzy_corpus_date(spark, sf_dir):
    return search(_hist(spark, sf_dir, ("conv",)), query="whenever", mode="fuzzy", limit=25,
                  date="2024-01-02 to 2024-01-03", date_scope="corpus")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "normalise_sessions": q_normalise_sessions,
        "normalise_messages": q_normalise_messages,
        "normalise_parts": q_normalise_parts,
        "project_scope": q_project_scope,
        "role_filter": q_role_filter,
        "date_filter_range": q_date_filter_range,
        "date_filter_relative": q_date_filter_relative,
        "date_filter_month": q_date_filter_month,
    }
    for name, (form, _, _) in _DATE_FORMS.items():
        out[name] = partial(_date_form, form=form)
    out["tree_sessions"] = lambda spark, sf_dir: _tree(spark, sf_dir).sessions
    out["tree_messages"] = lambda spark, sf_dir: _tree(spark, sf_dir).messages
    out["tree_parts"] = q_tree_parts
    out["grown_parts"] = q_grown_parts
    out["grown_trace"] = q_grown_trace
    out["grown_items"] = q_grown_items
    out["ingest_rejects"] = q_ingest_rejects
    out["json_malformed_skipped"] = partial(_odd_parts, case="malformed")
    out["json_mistyped_kept"] = partial(_odd_parts, case="mistyped")
    out["part_type_whitelist"] = partial(_odd_parts, case="other")
    for name, kw in _KEYWORD.items():
        out[name] = partial(_kw, **kw)
    for name, (kw, date, _) in _KEYWORD_DATE.items():
        out[name] = partial(_kw, date=date, **kw)
    for name, kw in _POSTED.items():
        out[name] = partial(_posted, **kw)
    out["stored_history"] = q_stored_history
    for name, kw in _TRACE.items():
        out[name] = partial(_trace, **kw)
    for name, kw in _FUZZY.items():
        out[name] = partial(_fz, **kw)
    out["items_build"] = q_items_build
    out["items_paths"] = q_items_paths
    out["unified_trace_date"] = q_unified_trace_date
    out["unified_keyword_corpus_date"] = q_unified_keyword_corpus_date
    out["unified_fuzzy_corpus_date"] = q_unified_fuzzy_corpus_date
    out["trace_pages"] = q_trace_pages
    out["trace_batch"] = q_trace_batch
    out["trace_batch_limited"] = q_trace_batch_limited
    out["report_batch"] = q_report_batch
    out["report_matches"] = q_report_matches
    out["report_trace"] = q_report_trace
    if llm_registry is not None:
        out.update(llm_registry.queries())
        out["pipeline"] = corpus_pipeline.run
    return out


def oracle_sql() -> dict[str, str]:
    all_h = O.history_ctes(ALL)
    out = {
        "normalise_sessions": f"{all_h} SELECT * FROM sessions",
        "normalise_messages": f"{all_h} SELECT * FROM messages",
        "normalise_parts": f"{all_h} SELECT * REPLACE (to_json(files)::VARCHAR AS files) FROM parts",
        "project_scope": f"{O.history_ctes(('conv', 'evt'))} SELECT part_id, session_id, project_id, type, "
                         "msg_created_ms FROM parts WHERE project_id = 'proj_1'",
        "role_filter": f"{O.history_ctes(('conv', 'evt'))} SELECT * FROM messages WHERE role = 'assistant'",
        "date_filter_range": f"{O.history_ctes(('evt',))} SELECT message_id, session_id, project_id, role, agent, "
                             "created_ms AS timestamp FROM messages WHERE created_ms BETWEEN "
                             "epoch_ms(TIMESTAMP '2024-01-05 00:00:00') AND epoch_ms(TIMESTAMP '2024-01-09 23:59:59.999')",
        "date_filter_relative": f"{O.history_ctes(('evt',))} SELECT message_id, session_id, project_id, role, agent, "
                                "created_ms AS timestamp FROM messages WHERE created_ms BETWEEN "
                                "epoch_ms(TIMESTAMP '2024-01-13 00:00:00') AND epoch_ms(TIMESTAMP '2024-01-20 12:30:00')",
        "date_filter_month": f"{O.history_ctes(('conv', 'page'))} SELECT session_id, project_id, title, directory, "
                             "created_ms, updated_ms AS timestamp FROM sessions WHERE updated_ms BETWEEN "
                             "epoch_ms(TIMESTAMP '2024-02-01 00:00:00') AND epoch_ms(TIMESTAMP '2024-02-29 23:59:59.999')",
    }
    for name, (_, lo, hi) in _DATE_FORMS.items():
        out[name] = (f"{O.history_ctes(('evt',))} SELECT message_id, session_id, project_id, role, agent, created_ms "
                     f"AS timestamp FROM messages WHERE created_ms BETWEEN epoch_ms(TIMESTAMP '{lo}') AND "
                     f"epoch_ms(TIMESTAMP '{hi}')")
    evt = O.history_ctes(("evt",))
    out["tree_sessions"] = f"{evt} SELECT * FROM sessions WHERE {_TREE_KEPT}"
    out["tree_messages"] = f"{evt} SELECT * FROM messages WHERE {_TREE_KEPT}"
    out["tree_parts"] = f"{evt} SELECT * REPLACE (to_json(files)::VARCHAR AS files) FROM parts WHERE {_TREE_KEPT}"
    out["grown_parts"] = f"{evt} SELECT * REPLACE (to_json(files)::VARCHAR AS files) FROM parts"
    out["grown_trace"] = O.trace_batch_sql(BATCH_QUERIES_SQL)
    out["grown_items"] = O.items_sql(PATH_TOKEN, ("evt",))
    out["ingest_rejects"] = REJECTS_SQL
    out["json_malformed_skipped"] = _odd_parts_sql("malformed")
    out["json_mistyped_kept"] = _odd_parts_sql("mistyped")
    out["part_type_whitelist"] = _odd_parts_sql("other")
    for name, kw in _KEYWORD.items():
        out[name] = _kw_sql(**{**kw, "limit": kw["limit"] or 50, "query": _SQL_PATTERNS.get(name, kw["query"])})
    for name, kw in _POSTED.items():
        out[name] = _kw_sql(sources=("conv",), **kw)
    out["stored_history"] = O.trace_sql("f7.ts", None, ("evt",), None)
    for name, (kw, _, bounds) in _KEYWORD_DATE.items():
        out[name] = _kw_sql(date_bounds=bounds, **kw)
    for name, kw in _TRACE.items():
        limit = None if kw.get("limit") == ALL_TOUCHES else kw.get("limit") or 50
        out[name] = O.trace_sql(kw["path"], limit, ("evt",), kw.get("project_id"))
    out["trace_pages"] = O.trace_sql("shared.ts", 1200, ("evt",), None, page_size=400)
    for name, kw in _FUZZY.items():
        out[name] = _fz_sql(**kw)
    out["items_build"] = O.items_sql(PATH_TOKEN, ALL)
    out["items_paths"] = (f"{O.history_ctes(('page',))},\n{O.items_cte(PATH_TOKEN)}\n"
                          f"SELECT *, {O.N_WORDS_SQL} FROM items WHERE match_type = 'filepath' AND k_slot = 2")
    out["unified_trace_date"] = O.trace_sql("f12.ts", 50, ("evt",), None,
                                            date_range=("2024-01-10 00:00:00", "2024-01-20 23:59:59.999"))
    out["unified_keyword_corpus_date"] = O.keyword_sql(O.SqlMatcher("the"), 30, ("conv",),
                      corpus_range=("2024-01-03 00:00:00", "2024-01-03 23:59:59.999"))
    k = min(allowed_errors(8, 0.4), 8 - MIN_MATCH_CHARS)
    out["unified_fuzzy_corpus_date"] = O.fuzzy_sql("whenever", k, 25, PATH_TOKEN, ("conv",),
                                                   corpus_range=("2024-01-02 00:00:00", "2024-01-03 23:59:59.999"))
    out["trace_batch"] = O.trace_batch_sql(BATCH_QUERIES_SQL)
    out["trace_batch_limited"] = O.trace_batch_sql(BATCH_QUERIES_SQL, limit_per_query=5)
    out["report_batch"] = O.trace_batch_sql(BATCH_QUERIES_SQL, limit_per_query=5, report=True)
    out["report_matches"] = _kw_sql(query="tion", sources=("conv",), limit=20, report=True)
    out["report_trace"] = O.trace_sql("f3.ts", 20, ("evt",), None, report=True)
    if llm_registry is not None:
        out.update(llm_registry.oracle_sql())
        if corpus_pipeline.ORACLE_SQL:
            out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: keyword search over the whole sf0.001 history (all sources)."""
    return _kw(spark, SMOKE_DIR, **_KEYWORD["keyword_all_sources"])
