"""Read the one-object-per-file JSON layout (S1–S3, P11).

::

    root/session/<project_id>/*.json   {"id","projectID","title","directory","time":{"created","updated"}}
    root/message/<session_id>/*.json   {"id","sessionID","role","agent","time":{"created"}}
    root/part/<message_id>/*.json      {"id","messageID","sessionID","type", …part fields}

Ownership comes from the *folder*, not the JSON fields: a session's project
is its folder name, a message belongs to the session whose trimmed id names
its folder, a part to such a message.  All files of a level are read in one
job (``wholetext``: one row per file, many small files packed per task);
unreadable files are skipped, a missing level is empty.

Being many small files, the layout is meant to be ingested once
(:func:`convsift.sources.history.write_history`) and searched as Parquet.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..model import PART_TYPES, History
from .tables import (JSON_OPTIONS, PART_JSON, _check_policy, _observed, _valid, assemble,
                     decode_part_payload, parse_once)

SESSION_FILE_JSON = ("id string, projectID string, title string, directory string, "
                     "time string, _corrupt_record string")
MESSAGE_FILE_JSON = "id string, sessionID string, role string, agent string, time string, _corrupt_record string"
PART_FILE_JSON = PART_JSON.replace("_corrupt_record string", "id string, time string, _corrupt_record string")


def _ms(field: str) -> Column:
    """Milliseconds of a ``time`` field, whatever way the number is written."""
    return F.get_json_object(F.col("j.time"), f"$.{field}").try_cast("double").cast("long")


def _state_start() -> Column:
    """A tool call without times of its own starts when its state does."""
    return F.get_json_object(F.col("j.state"), "$.time.start").try_cast("double").cast("long")


def _literal(name: str) -> str:
    """A folder name in a path pattern, its pattern characters escaped."""
    return re.sub(r"([\\\[\]{}*?,])", r"\\\1", name)


def _folder(path: Column) -> Column:
    """Name of the folder holding a file (the path arrives URL-encoded)."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(decoded, r"([^/]+)/[^/]+$", 1)


def _files(spark: SparkSession, pattern: str) -> DataFrame:
    """(folder, text) per file matching ``pattern``; empty when none exist."""
    try:
        df = spark.read.text(pattern, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "folder string, data string")
    return df.select(_folder(F.col("_metadata.file_path")).alias("folder"), F.col("value").alias("data"))


def _observed_levels(df: DataFrame, observation, name: str) -> DataFrame:
    ok = F.col("data").isNotNull() & F.col("j").isNotNull() & F.col("j._corrupt_record").isNull()
    return _observed(df, ok, observation, name)


def decode_session_files(files: DataFrame, on_corrupt: str = "skip", observation=None) -> DataFrame:
    """(folder, data) of session files → sessions; the folder is the project."""
    j = F.from_json(F.col("data"), SESSION_FILE_JSON, JSON_OPTIONS)
    return (_observed_levels(parse_once(files, j, ["folder", "data"]), observation, "corrupt_sessions")
            .where(_valid(F.col("j"), F.col("data"), on_corrupt) & F.col("j.id").isNotNull())
            .select(F.col("j.id").alias("session_id"), F.col("folder").alias("project_id"),
                    F.col("j.title").alias("title"), F.col("j.directory").alias("directory"),
                    _ms("created").alias("created_ms"), _ms("updated").alias("updated_ms")))


def decode_message_files(files: DataFrame, on_corrupt: str = "skip", observation=None) -> DataFrame:
    """(folder, data) of message files → messages; the folder is the session."""
    j = F.from_json(F.col("data"), MESSAGE_FILE_JSON, JSON_OPTIONS)
    return (_observed_levels(parse_once(files, j, ["folder", "data"]), observation, "corrupt_messages")
            .where(_valid(F.col("j"), F.col("data"), on_corrupt) & F.col("j.id").isNotNull())
            .select(F.col("j.id").alias("message_id"), F.col("folder").alias("session_id"),
                    F.col("j.role").alias("role"),
                    F.coalesce(F.when(F.length("j.agent") > 0, F.col("j.agent")), F.lit("")).alias("agent"),
                    _ms("created").alias("created_ms")))


def decode_part_files(files: DataFrame, on_corrupt: str = "skip", observation=None) -> DataFrame:
    """(folder, data) of part files → parts of the kept types; the folder is the message."""
    j = F.from_json(F.col("data"), PART_FILE_JSON, JSON_OPTIONS)
    return (_observed_levels(parse_once(files, j, ["folder", "data"]), observation, "corrupt_parts")
            .where(_valid(F.col("j"), F.col("data"), on_corrupt) & F.col("j.id").isNotNull())
            .where(F.col("j.type").isin(*PART_TYPES))
            .select(F.col("j.id").alias("part_id"), F.col("folder").alias("message_id"),
                    F.coalesce(_ms("created"), _ms("start"), _state_start()).alias("created_ms"),
                    *decode_part_payload(F.col("data"))))


#: Files of a level: schema of their JSON, and the columns decoded from it.
_LEVELS = {
    "session": (SESSION_FILE_JSON, "session_id", lambda: [
        F.col("folder").alias("project_id"), F.col("j.title").alias("title"), F.col("j.directory").alias("directory"),
        _ms("created").alias("created_ms"), _ms("updated").alias("updated_ms")]),
    "message": (MESSAGE_FILE_JSON, "message_id", lambda: [
        F.col("j.role").alias("role"), F.coalesce(F.when(F.length("j.agent") > 0, F.col("j.agent")), F.lit("")).alias("agent"),
        _ms("created").alias("created_ms")]),
    "part": (PART_FILE_JSON, "part_id", lambda: [
        F.coalesce(_ms("created"), _ms("start"), _state_start()).alias("created_ms"), *decode_part_payload(F.col("data"))]),
}
LEVELS = tuple(_LEVELS)
# Why a file gives no row.
EMPTY, MALFORMED, NO_ID, OTHER_TYPE = "empty", "malformed", "no id", "other type"


def staged_files(files: DataFrame, level: str) -> DataFrame:
    """(src, folder, data) of one level's files in one pass: every file with the reason
    ``reject`` that it gives no row and its ``data``, or (reject null) with its columns."""
    schema, ident, columns = _LEVELS[level]
    parsed = parse_once(files, F.from_json(F.col("data"), schema, JSON_OPTIONS), ["src", "folder", "data"])
    reason = (F.when(F.trim(F.coalesce("data", F.lit(""))) == "", EMPTY)
              .when(F.col("j").isNull() | F.col("j._corrupt_record").isNotNull(), MALFORMED)
              .when(F.col("j.id").isNull(), NO_ID))
    if level == "part":
        reason = reason.when(~F.coalesce(F.col("j.type").isin(*PART_TYPES), F.lit(False)), OTHER_TYPE)
    return parsed.select("src", "folder", reason.alias("reject"), F.when(reason.isNotNull(), F.col("data")).alias("data"),
                         F.col("j.id").alias(ident), *columns())


def list_files(spark: SparkSession, root: str, level: str) -> DataFrame:
    """(src, level, length, modified) of the files of one level; their contents are not read."""
    pattern = f"{_literal(root.rstrip('/'))}/{level}/*/*.json"
    try:
        files = spark.read.format("binaryFile").load(pattern)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "src string, level string, length bigint, modified bigint")
    return files.select(F.col("_metadata.file_path").alias("src"), F.lit(level).alias("level"),
                        F.col("_metadata.file_size").alias("length"),
                        F.unix_micros("_metadata.file_modification_time").alias("modified"))


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(src, folder, data) of files, whole."""
    path = F.col("_metadata.file_path")
    return spark.read.text(paths, wholetext=True).select(path.alias("src"), _folder(path).alias("folder"), F.col("value").alias("data"))


def read_json_tree(spark: SparkSession, root: str, project_id: str | None = None,
                   on_corrupt: str = "skip", observations: dict | None = None) -> History:
    """History of a JSON-tree export.  ``project_id`` narrows it to one project: its
    session folder is read first, then the message folders of its sessions, then the part
    folders of their messages (by name, up to ``MAX_FOLDERS`` of them; beyond, the level
    is listed whole and the other folders' rows fall out in the join).
    ``observations`` may map ``"sessions"``,
    ``"messages"`` and ``"parts"`` to :class:`pyspark.sql.Observation` objects
    that count the unreadable files skipped at that level (metric
    ``corrupt_<level>``)."""
    obs = observations or {}
    _check_policy(on_corrupt)
    proj = _literal(project_id) if project_id is not None else "*"
    root = _literal(root.rstrip("/"))
    sessions = decode_session_files(_files(spark, f"{root}/session/{proj}/*.json"), on_corrupt, obs.get("sessions"))
    within = (lambda level, owners, ident: _owned(spark, root, level, owners, ident)) if project_id is not None else (
        lambda level, owners, ident: _files(spark, f"{root}/{level}/*/*.json"))
    messages = decode_message_files(within("message", sessions, "session_id"), on_corrupt, obs.get("messages"))
    parts = decode_part_files(within("part", messages, "message_id"), on_corrupt, obs.get("parts"))
    return assemble(sessions, messages, parts, trim_keys=True)


#: Folders that a scoped read names one by one.
MAX_FOLDERS = 10_000


def _owned(spark: SparkSession, root: str, level: str, owners: DataFrame, ident: str) -> DataFrame:
    """Files in the folders that ``owners``' trimmed ids name."""
    names = owners.select(F.trim(F.col(ident)).alias("name")).distinct().limit(MAX_FOLDERS + 1).collect()
    if len(names) > MAX_FOLDERS:
        return _files(spark, f"{root}/{level}/*/*.json")
    there = [p for r in names if r.name and _exists(spark, p := f"{root}/{level}/{_literal(r.name)}/*.json")]
    if not there:
        return spark.createDataFrame([], "folder string, data string")
    df = spark.read.text(there, wholetext=True)
    return df.select(_folder(F.col("_metadata.file_path")).alias("folder"), F.col("value").alias("data"))


def _exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a pattern names any file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0
