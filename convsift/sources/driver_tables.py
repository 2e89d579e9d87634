"""Adapters from the benchmark tables to raw history tables.

The benchmark ships ``conversations``, ``events`` and ``pages`` rather than
an assistant history, so each is mapped onto raw ``session`` / ``message``
/ ``part`` tables with JSON ``data`` columns, exactly the shape a history
export has; :func:`normalise_tables` then decodes them like any other
export.  Every row of the source tables is used.

* conversations: a conversation is a session, each turn a message with one
  text part; the title is the first 60 characters of the first turn.
* events: a user is a session, an event a message.  ``click``/``view`` are
  user prompts (text), ``purchase`` writes ``src/f<k>.ts`` (tool part plus a
  patch also listing ``src/shared.ts``), ``signup`` edits it, ``error`` runs a
  shell command on it.
* pages: a host is a session; per page a user prompt, a ``webfetch`` tool
  call whose output is the HTML, and a patch naming the URL path.
* documents: a (source, language) pair is a session in project
  ``proj_<lang>``; each document is one message whose single text part is
  the whole document (English and French ones as user messages, the others
  as assistant messages).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ntz_to_ms
from ..model import History
from .tables import normalise_tables

# Fixed values of the mapping (shared with the SQL oracle).
CONV_BASE_MS = 1704067200000      # 2024-01-01T00:00:00Z
CONV_SESSION_STRIDE_MS = 3600000  # one hour between conversations
TURN_STRIDE_MS = 60000            # one minute between turns
PAGE_BASE_MS = 1706745600000      # 2024-02-01T00:00:00Z
PAGE_STRIDE_MS = 1000
DOC_BASE_MS = 1709251200000       # 2024-03-01T00:00:00Z
DOC_STRIDE_MS = 60000
DOC_USER_LANGS = ("en", "fr")
CONV_PROJECTS = 5
EVENT_PROJECTS = 3
USER_EVENTS = ("click", "view")


@dataclass(frozen=True)
class RawTables:
    session: DataFrame
    message: DataFrame
    part: DataFrame

    def union(self, other: "RawTables") -> "RawTables":
        return RawTables(self.session.unionByName(other.session),
                         self.message.unionByName(other.message),
                         self.part.unionByName(other.part))


def _s(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _str(c: Column) -> Column:
    return c.cast("string")


def _session_rows(df: DataFrame) -> DataFrame:
    return df.select("id", "project_id", "slug", "directory", "title", "version",
                     "time_created", "time_updated")


def conversation_tables(spark: SparkSession, sf_dir: str) -> RawTables:
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    cid = F.col("conv_id")
    created = F.lit(CONV_BASE_MS) + cid * F.lit(CONV_SESSION_STRIDE_MS)
    project = _s("proj_", _str(cid % CONV_PROJECTS))
    per_conv = conv.groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("first_text"), F.max("turn").alias("max_turn"))
    session = _session_rows(per_conv.select(
        _s("ses_c", _str(cid)).alias("id"),
        project.alias("project_id"),
        _s("conversation-", _str(cid)).alias("slug"),
        _s("/data/", project).alias("directory"),
        F.substring("first_text", 1, 60).alias("title"),
        F.lit("v1").alias("version"),
        created.alias("time_created"),
        (created + F.col("max_turn") * F.lit(TURN_STRIDE_MS)).alias("time_updated")))
    msg_ms = created + F.col("turn") * F.lit(TURN_STRIDE_MS)
    msg_id = _s("msg_c", _str(cid), "_", _str(F.col("turn")))
    agent = F.when(F.col("role") == "assistant", F.lit("build")).otherwise(F.col("role"))
    message = conv.select(
        msg_id.alias("id"), _s("ses_c", _str(cid)).alias("session_id"),
        msg_ms.alias("time_created"), msg_ms.alias("time_updated"),
        F.to_json(F.struct(F.col("role").alias("role"), agent.alias("agent"))).alias("data"))
    part = conv.select(
        _s("prt_c", _str(cid), "_", _str(F.col("turn"))).alias("id"),
        msg_id.alias("message_id"), _s("ses_c", _str(cid)).alias("session_id"),
        msg_ms.alias("time_created"), msg_ms.alias("time_updated"),
        F.to_json(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("data"))
    return RawTables(session, message, part)


def _tool_json(tool: str, input_struct: Column, output: Column, title: Column) -> Column:
    return F.to_json(F.struct(
        F.lit("tool").alias("type"), F.lit(tool).alias("tool"),
        F.struct(F.lit("completed").alias("status"), input_struct.alias("input"),
                 output.alias("output"), title.alias("title")).alias("state")))


def event_tables(spark: SparkSession, sf_dir: str) -> RawTables:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "ts", "user_id", "event_type", "props")
    ev = ev.withColumn("ms", ntz_to_ms(F.col("ts")))
    uid = F.col("user_id")
    project = _s("proj_", _str(uid % EVENT_PROJECTS))
    per_user = ev.groupBy("user_id").agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))
    session = _session_rows(per_user.select(
        _s("ses_u", _str(uid)).alias("id"), project.alias("project_id"),
        _s("user-", _str(uid)).alias("slug"), _s("/data/", project).alias("directory"),
        _s("user ", _str(uid), " activity").alias("title"), F.lit("v1").alias("version"),
        F.col("first_ms").alias("time_created"), F.col("last_ms").alias("time_updated")))

    et = F.col("event_type")
    is_user = et.isin(*USER_EVENTS)
    role = F.when(is_user, F.lit("user")).otherwise(F.lit("assistant"))
    agent = F.when(is_user, F.lit("user")).otherwise(F.lit("build"))
    msg_id = _s("msg_e", _str(F.col("event_id")))
    ses_id = _s("ses_u", _str(uid))
    message = ev.select(
        msg_id.alias("id"), ses_id.alias("session_id"), F.col("ms").alias("time_created"),
        F.col("ms").alias("time_updated"),
        F.to_json(F.struct(role.alias("role"), agent.alias("agent"))).alias("data"))

    k = F.get_json_object(F.col("props"), "$.k")
    path = _s("src/f", k, ".ts")
    file_input = F.struct(path.alias("filePath"))
    text_json = F.to_json(F.struct(F.lit("text").alias("type"), _s(et, " ", F.col("props")).alias("text")))
    write_json = _tool_json("write", file_input, _s("Wrote ", path), _s("Write ", path))
    edit_json = _tool_json("edit", file_input, _s("Updated ", path), _s("Edit ", path))
    bash_json = _tool_json("bash", F.struct(_s("cat ", path).alias("command")),
                           _s("exit code ", k), F.lit("Run command"))
    patch_json = F.to_json(F.struct(F.lit("patch").alias("type"),
                                    F.array(path, F.lit("src/shared.ts")).alias("files")))

    def item(n: int, data: Column) -> Column:
        return F.struct(F.lit(n).alias("n"), data.alias("data"))

    items = (F.when(is_user, F.array(item(0, text_json)))
             .when(et == "purchase", F.array(item(0, write_json), item(1, patch_json)))
             .when(et == "signup", F.array(item(0, edit_json)))
             .otherwise(F.array(item(0, bash_json))))
    part = (ev.select("event_id", "user_id", "ms", F.explode(items).alias("it"))
            .select(_s("prt_e", _str(F.col("event_id")), "_", _str(F.col("it.n"))).alias("id"),
                    msg_id.alias("message_id"), ses_id.alias("session_id"),
                    (F.col("ms") + F.col("it.n")).alias("time_created"),
                    (F.col("ms") + F.col("it.n")).alias("time_updated"),
                    F.col("it.data").alias("data")))
    return RawTables(session, message, part)


def page_tables(spark: SparkSession, sf_dir: str) -> RawTables:
    pg = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    host = F.regexp_extract(F.col("url"), r"^https?://([^/?#]+)", 1)
    upath = F.regexp_extract(F.col("url"), r"^https?://[^/]+(/[^?#]*)", 1)
    ms = F.lit(PAGE_BASE_MS) + F.col("page_id") * F.lit(PAGE_STRIDE_MS)
    pg = pg.select("page_id", "url", "html", host.alias("host"), upath.alias("upath"), ms.alias("ms"))
    ses_id = _s("ses_h", F.col("host"))
    per_host = pg.groupBy("host").agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))
    session = _session_rows(per_host.select(
        ses_id.alias("id"), F.lit("proj_web").alias("project_id"), F.col("host").alias("slug"),
        _s("/web/", F.col("host")).alias("directory"), F.col("host").alias("title"),
        F.lit("v1").alias("version"), (F.col("first_ms") - 500).alias("time_created"),
        F.col("last_ms").alias("time_updated")))
    pid = _str(F.col("page_id"))
    user_msg = _s("msg_p", pid, "_0")
    asst_msg = _s("msg_p", pid, "_1")
    message = pg.select(F.explode(F.array(
        F.struct(user_msg.alias("id"), (F.col("ms") - 500).alias("t"),
                 F.to_json(F.struct(F.lit("user").alias("role"), F.lit("user").alias("agent"))).alias("data")),
        F.struct(asst_msg.alias("id"), F.col("ms").alias("t"),
                 F.to_json(F.struct(F.lit("assistant").alias("role"), F.lit("build").alias("agent"))).alias("data")),
    )).alias("m"), ses_id.alias("session_id")).select(
        F.col("m.id").alias("id"), "session_id", F.col("m.t").alias("time_created"),
        F.col("m.t").alias("time_updated"), F.col("m.data").alias("data"))
    text_json = F.to_json(F.struct(F.lit("text").alias("type"), _s("fetch ", F.col("url")).alias("text")))
    fetch_json = _tool_json("webfetch", F.struct(F.col("url").alias("url")), F.col("html"), F.col("url"))
    patch_json = F.to_json(F.struct(F.lit("patch").alias("type"), F.array(F.col("upath")).alias("files")))
    part = pg.select(F.explode(F.array(
        F.struct(_s("prt_p", pid, "_0").alias("id"), user_msg.alias("mid"), (F.col("ms") - 500).alias("t"), text_json.alias("data")),
        F.struct(_s("prt_p", pid, "_1").alias("id"), asst_msg.alias("mid"), (F.col("ms") + 1).alias("t"), fetch_json.alias("data")),
        F.struct(_s("prt_p", pid, "_2").alias("id"), asst_msg.alias("mid"), (F.col("ms") + 2).alias("t"), patch_json.alias("data")),
    )).alias("p"), ses_id.alias("session_id")).select(
        F.col("p.id").alias("id"), F.col("p.mid").alias("message_id"), "session_id",
        F.col("p.t").alias("time_created"), F.col("p.t").alias("time_updated"), F.col("p.data").alias("data"))
    return RawTables(session, message, part)


def document_tables(spark: SparkSession, sf_dir: str) -> RawTables:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    ms = F.lit(DOC_BASE_MS) + F.col("doc_id") * F.lit(DOC_STRIDE_MS)
    ses_id = _s("ses_d", F.col("source"), "_", F.col("lang"))
    project = _s("proj_", F.col("lang"))
    docs = docs.withColumn("ms", ms)
    per = docs.groupBy("source", "lang").agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))
    session = _session_rows(per.select(
        ses_id.alias("id"), project.alias("project_id"), _s(F.col("source"), "-", F.col("lang")).alias("slug"),
        _s("/docs/", F.col("lang")).alias("directory"),
        _s(F.col("source"), " ", F.col("lang"), " archive").alias("title"), F.lit("v1").alias("version"),
        F.col("first_ms").alias("time_created"), F.col("last_ms").alias("time_updated")))
    is_user = F.col("lang").isin(*DOC_USER_LANGS)
    role = F.when(is_user, F.lit("user")).otherwise(F.lit("assistant"))
    msg_id = _s("msg_d", _str(F.col("doc_id")))
    message = docs.select(
        msg_id.alias("id"), ses_id.alias("session_id"), F.col("ms").alias("time_created"),
        F.col("ms").alias("time_updated"),
        F.to_json(F.struct(role.alias("role"), F.lit("reader").alias("agent"))).alias("data"))
    part = docs.select(
        _s("prt_d", _str(F.col("doc_id"))).alias("id"), msg_id.alias("message_id"), ses_id.alias("session_id"),
        F.col("ms").alias("time_created"), F.col("ms").alias("time_updated"),
        F.to_json(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("data"))
    return RawTables(session, message, part)


ADAPTERS = {"conv": conversation_tables, "evt": event_tables, "page": page_tables,
            "doc": document_tables}


def driver_raw_tables(spark: SparkSession, sf_dir: str, sources=("conv", "evt", "page")) -> RawTables:
    raw = None
    for name in sources:
        t = ADAPTERS[name](spark, sf_dir)
        raw = t if raw is None else raw.union(t)
    return raw


def driver_history(spark: SparkSession, sf_dir: str, sources=("conv", "evt", "page")) -> History:
    """History built from the benchmark tables named in ``sources``."""
    raw = driver_raw_tables(spark, sf_dir, sources)
    return normalise_tables(raw.session, raw.message, raw.part)
