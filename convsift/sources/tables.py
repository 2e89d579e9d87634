"""Normalise raw row tables (``session``, ``message``, ``part`` with JSON
``data`` columns) into the three history relations.

The JSON payloads are decoded once here with explicit schemas (never schema
inference, which would cost a second pass), part types outside the four
searchable ones are dropped, malformed JSON rows are skipped (or raise), and
each part is denormalised with its message's role / time and its session's
project / update time.  Reachability follows the reference walk: a message
counts only if its session exists, a part only if its message does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PART_SCHEMA, PART_TYPES, History
from ..functions.text import nonempty

MESSAGE_JSON = "role string, agent string, _corrupt_record string"
# Fields are read as text, whatever their JSON type, and decoded at second level:
# a field of an unexpected shape is null, and only unparsable text is corrupt.
PART_JSON = "type string, text string, tool string, state string, files string, _corrupt_record string"
STATE_JSON = "input string, output string, title string"
JSON_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def parse_once(df: DataFrame, decoded: Column, keep: list[str]) -> DataFrame:
    """Project ``keep`` plus the parsed struct ``j``, parsing each row once.

    Predicates on ``j`` would otherwise be pushed below the projection with
    ``from_json`` inlined into each of them (one parse per predicate).  A
    one-element ``inline`` is a generator, which predicates are not pushed
    through, so every later reference reads the already parsed struct.
    """
    return df.select(*keep, F.inline(F.array(F.struct(decoded.alias("j")))))


def _check_policy(on_corrupt: str) -> None:
    if on_corrupt not in ("skip", "fail"):
        raise ValueError("on_corrupt must be 'skip' or 'fail'")


def _observed(df: DataFrame, ok: Column, observation, name: str) -> DataFrame:
    """Attach a ``<name>`` count of rows dropped as malformed (P11).

    ``observation`` is a :class:`pyspark.sql.Observation`; its value is
    available after the first action on the result."""
    if observation is None:
        return df
    return df.observe(observation, F.sum(F.when(ok, 0).otherwise(1)).alias(name))


def _valid(decoded: Column, raw: Column, on_corrupt: str) -> Column:
    """True for a row whose JSON parsed; under ``fail`` a bad row aborts the job."""
    ok = raw.isNotNull() & decoded.isNotNull() & decoded["_corrupt_record"].isNull()
    if on_corrupt == "fail":
        return F.when(ok, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("Malformed JSON data: "), F.coalesce(raw, F.lit("null")))))
    return ok


def stringify_input(raw_input: Column, data: Column, path: str = "$.state.input") -> Column:
    """``JSON.stringify(state.input || {})`` from the copied JSON text.

    ``from_json`` with a string field hands back nested objects as compact
    JSON in source key order, but a JSON *string* comes back unquoted and a
    falsy scalar needs the ``{}`` default, so non-object inputs are typed
    with a VARIANT probe (only those: objects skip the probe).
    """
    looks_structured = raw_input.startswith("{") | raw_input.startswith("[")
    vtype = F.schema_of_variant(F.try_variant_get(F.try_parse_json(data), path, "variant"))
    quoted = F.regexp_extract(F.to_json(F.array(raw_input)), r"^\[(.*)\]$", 1)
    numeric_zero = vtype.rlike("^(DECIMAL|BIGINT|INT|DOUBLE|FLOAT)") & \
        (raw_input.try_cast("double") == F.lit(0.0))
    return (
        F.when(raw_input.isNull(), F.lit("{}"))
        .when(looks_structured, raw_input)
        .when(vtype == "STRING", F.when(raw_input == "", F.lit("{}")).otherwise(quoted))
        .when((vtype == "BOOLEAN") & (raw_input == "false"), F.lit("{}"))
        .when(numeric_zero, F.lit("{}"))
        .when(vtype == "VOID", F.lit("{}"))
        .otherwise(raw_input)
    )


def decode_sessions(session: DataFrame) -> DataFrame:
    """Raw ``session`` rows → ``sessions``."""
    return session.select(
        F.col("id").cast("string").alias("session_id"),
        F.col("project_id").cast("string").alias("project_id"),
        F.col("title").cast("string").alias("title"),
        F.col("directory").cast("string").alias("directory"),
        F.col("time_created").cast("long").alias("created_ms"),
        F.col("time_updated").cast("long").alias("updated_ms"),
    )


def decode_messages(message: DataFrame, on_corrupt: str = "skip", observation=None) -> DataFrame:
    """Raw ``message`` rows → (message_id, session_id, role, agent, created_ms)."""
    _check_policy(on_corrupt)
    j = F.from_json(F.col("data"), MESSAGE_JSON, JSON_OPTIONS)
    staged = message.select(
        F.col("id").cast("string").alias("message_id"),
        F.col("session_id").cast("string").alias("session_id"),
        F.col("time_created").cast("long").alias("created_ms"), F.col("data"))
    parsed = parse_once(staged, j, ["message_id", "session_id", "created_ms", "data"])
    ok = F.col("data").isNotNull() & F.col("j").isNotNull() & F.col("j._corrupt_record").isNull()
    return (
        _observed(parsed, ok, observation, "corrupt_messages")
        .where(_valid(F.col("j"), F.col("data"), on_corrupt))
        .select(
            "message_id", "session_id",
            F.col("j.role").alias("role"),
            F.coalesce(F.when(nonempty(F.col("j.agent")), F.col("j.agent")), F.lit("")).alias("agent"),
            "created_ms")
    )


def decode_part_payload(data: Column) -> list[Column]:
    """Columns of one part decoded from its JSON ``data`` (``j`` must be in scope)."""
    t = F.col("j.type")
    is_tool = t == "tool"
    state = F.when(F.col("j.state").startswith("{"), F.from_json(F.col("j.state"), STATE_JSON))
    files = F.when(F.col("j.files").startswith("["), F.from_json(F.col("j.files"), "array<string>"))
    has_state = is_tool & F.col("j.state").isNotNull() & ~F.col("j.state").isin("", "0", "false")
    raw_input = state["input"]
    return [
        t.alias("type"),
        F.when(t == "text", F.col("j.text")).alias("text"),
        F.when(is_tool, F.col("j.tool")).alias("tool"),
        F.coalesce(has_state, F.lit(False)).alias("has_state"),
        F.when(has_state, stringify_input(raw_input, data)).alias("input_json"),
        F.when(is_tool, state["output"]).alias("output"),
        F.when(is_tool, state["title"]).alias("state_title"),
        F.when(t == "patch", files).alias("files"),
    ]


def decode_parts(part: DataFrame, on_corrupt: str = "skip", observation=None) -> DataFrame:
    """Raw ``part`` rows → decoded parts of the four kept types."""
    _check_policy(on_corrupt)
    j = F.from_json(F.col("data"), PART_JSON, JSON_OPTIONS)
    raw = part.select(
        F.col("id").cast("string").alias("part_id"),
        F.col("message_id").cast("string").alias("message_id"),
        F.col("time_created").cast("long").alias("created_ms"), F.col("data"))
    parsed = parse_once(raw, j, ["part_id", "message_id", "created_ms", "data"])
    ok = F.col("data").isNotNull() & F.col("j").isNotNull() & F.col("j._corrupt_record").isNull()
    staged = (
        _observed(parsed, ok, observation, "corrupt_parts")
        .where(_valid(F.col("j"), F.col("data"), on_corrupt))
        .where(F.col("j.type").isin(*PART_TYPES))
    )
    return staged.select("part_id", "message_id", "created_ms", *decode_part_payload(F.col("data")))


def assemble(sessions: DataFrame, messages: DataFrame, parts: DataFrame,
             trim_keys: bool = False) -> History:
    """Attach ownership: messages get their session's project, parts get the
    role/time of their message and the project/update time of the session.

    ``messages.session_id`` / ``parts.message_id`` hold the parent reference;
    with ``trim_keys`` it is compared with the trimmed parent id (the file
    layout looks a parent up by ``id.trim()``).  Inner joins keep only what a
    walk from sessions can reach.  Both are plain equi-joins: AQE broadcasts a
    side that is small at run time and splits skewed keys otherwise.
    """
    key = (lambda c: F.trim(F.col(c))) if trim_keys else F.col
    s = sessions.select(key("session_id").alias("_sref"), "session_id", "project_id",
                        F.col("updated_ms").alias("session_updated_ms"),
                        F.col("title").alias("session_title"), F.col("directory").alias("project_directory"))
    msgs = (messages.withColumnRenamed("session_id", "_sref")
            .join(s, "_sref", "inner").drop("_sref"))
    messages_out = msgs.select("message_id", "session_id", "project_id", "role", "agent", "created_ms")
    m = msgs.select(key("message_id").alias("_mref"), "message_id", "session_id", "project_id", "role",
                    F.col("created_ms").alias("msg_created_ms"), "session_updated_ms",
                    "session_title", "project_directory")
    parts_out = (parts.withColumnRenamed("message_id", "_mref")
                 .join(m, "_mref", "inner")
                 .select(*PART_SCHEMA.fieldNames()))
    return History(sessions, messages_out, parts_out)


def normalise_tables(session: DataFrame, message: DataFrame, part: DataFrame,
                     on_corrupt: str = "skip", message_observation=None,
                     part_observation=None) -> History:
    """Raw row tables → :class:`History`.

    Pass :class:`pyspark.sql.Observation` objects to count the malformed
    messages / parts that were skipped."""
    return assemble(decode_sessions(session),
                    decode_messages(message, on_corrupt, message_observation),
                    decode_parts(part, on_corrupt, part_observation))
