"""A history store that grows: incremental ingest in whole versions.

A store is a folder of tables.  Every ingest compares the listing of the source files
(path, length, time of modification) with the manifest of those it has read, reads the
new and changed ones only, and derives anew what they touch:

* a row belongs to the *session reference* of its folder (a message's folder, or that of
  a part's message), and a table's rows lie in slots, folders by the reference's hash
  (``SLOTS`` of them, or as many as the first ingest says);
* the slots that hold a touched session are put together from their stored rows, less
  those of changed or removed files, and the new ones: roles, titles and times that parts
  and derived tables carry are attached again there; other slots stay as they are;
* messages without their session, and parts without their message, wait in the tables
  (no session id; parts in the slot ``PENDING``) until a later ingest brings it.

``<store>/<table>/batch=<b>/slot=<s>`` holds what an ingest wrote; ``<store>/versions``
gets one row at its very end, with the batch that each slot of each table is read from.
Readers take the newest version, so they see all of an ingest or nothing of it, and an
ingest that stopped leaves only folders that no version names.  One ingest runs at a time.

``grams`` lists the trigrams of each slot's parts: a keyword search reads only the slots
that hold all trigrams which its pattern must contain (:func:`load_matching`).

Files that give no row are kept in ``rejects`` with the reason and their content; a mended
file is a changed one, so its reject goes when its row comes.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grams import mark_grams, plain, required_grams
from ..model import MESSAGE_SCHEMA, PART_SCHEMA, SESSION_SCHEMA, History
from ..operators.items import build_items
from ..operators.trace import build_prompts, build_touches
from ..session import ship_package
from .tree import LEVELS, list_files, read_files, staged_files

#: Slots of a new store: a slot should hold what one ingest may well write again.
SLOTS = 64
PENDING = -1
#: Changed files that are read by name; of more, the level is read and the others dropped.
MAX_NAMED = 50_000

LISTING = "src string, level string, length bigint, modified bigint"
_REJECTS = "src string, level string, reject string, data string"
_OWN = {"sessions": SESSION_SCHEMA, "messages": MESSAGE_SCHEMA, "parts": PART_SCHEMA}
#: Columns that a stored row has from its own file, besides src and the folder.
_DECODED = {
    "session": ["session_id", "project_id", "title", "directory", "created_ms", "updated_ms"],
    "message": ["message_id", "role", "agent", "created_ms"],
    "part": ["part_id", "created_ms", "type", "text", "tool", "has_state", "input_json", "output", "state_title", "files"],
}


def _nullable(schema: T.StructType, *extra: str) -> T.StructType:
    fields = [T.StructField(f.name, f.dataType, True) for f in schema.fields]
    return T.StructType(fields + [T.StructField(c, T.StringType(), True) for c in extra])


#: Stored tables: the model's columns, the file of the row, and its references.
_SCHEMAS = {
    "sessions": _nullable(SESSION_SCHEMA, "src", "sref"),
    "messages": _nullable(MESSAGE_SCHEMA, "src", "sref"),
    "parts": _nullable(PART_SCHEMA, "src", "mref", "sref"),
}
#: Derived tables, their builders and the columns that their files are sorted by.
_DERIVED: dict[str, tuple[Callable[[History], DataFrame] | None, list[str]]] = {
    "items": (build_items, ["project_id", "session_id", "k_msg_ms"]),
    "touches": (lambda h: build_touches(h.parts), ["last_component", "file_path", "session_id"]),
    "prompts": (lambda h: build_prompts(h.parts), ["session_id", "bucket", "from_ms"]),
    "grams": (None, ["gram"]),  # needs the slots: build_grams
}
#: Derived tables whose rows each come from one row of a table in slots.
_ROW_BY_ROW = ("items", "touches")
#: Derived tables that a history has.
_LOADED = ("items", "touches", "prompts")
_SORTED = {"sessions": ["project_id", "session_id"], "messages": ["project_id", "session_id", "created_ms"],
           "parts": ["project_id", "session_id", "msg_created_ms", "created_ms"]}


def slot_of(ref: Column, n_slots: int) -> Column:
    return F.when(ref.isNull(), F.lit(PENDING)).otherwise(F.pmod(F.xxhash64(ref), F.lit(n_slots)).cast("int"))


def build_grams(parts: DataFrame) -> DataFrame:
    """(gram, slot): the trigrams of all that keyword search looks at in the parts of a ``slot``."""
    import numpy as np
    import pyarrow as pa

    def codes(batches):
        held: dict[int, np.ndarray] = {}  # rows come slot by slot

        def flush():
            for slot, seen in held.items():
                found = np.flatnonzero(seen).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), slot, np.int32))], names=["gram", "slot"])
            held.clear()

        for b in batches:
            slots = b.column(0).to_numpy()
            for slot in np.unique(slots):
                mine = slots == slot
                texts = b.column(1) if mine.all() else b.column(1).filter(pa.array(mine))
                if slot not in held:
                    if len(held) >= 8:
                        yield from flush()
                    held[int(slot)] = np.zeros(1 << 21, bool)
                mark_grams(texts.flatten(), held[int(slot)])
        yield from flush()

    fields = F.array("text", "tool", F.coalesce("input_json", F.lit("{}")), "output")
    fields = F.transform(F.concat(fields, F.coalesce("files", F.array().cast("array<string>"))), plain)
    found = parts.select("slot", fields.alias("texts"))
    ship_package(parts.sparkSession)
    return found.mapInArrow(codes, "gram int, slot int").distinct()


# ------------------------------------------------------------------ versions

@dataclass(frozen=True)
class Version:
    """Number, slots of the store, batches of the manifest and rejects, and per table the
    batch of each slot."""

    number: int
    n_slots: int
    batches: list[str]
    slots: dict[str, dict[int, str]]


def latest_version(spark: SparkSession, store: str) -> Version | None:
    try:
        rows = spark.read.parquet(f"{store}/versions")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    row = rows.orderBy(F.col("number").desc()).head()
    if row is None:
        return None
    found = json.loads(row.content)
    return Version(row.number, found["n_slots"], found["batches"], {t: {int(s): b for s, b in x.items()} for t, x in found["slots"].items()})


def _publish(spark: SparkSession, store: str, version: Version) -> None:
    """Name a version: one row in one file, which appears when its job is committed."""
    content = json.dumps({"n_slots": version.n_slots, "batches": version.batches, "slots": version.slots})
    row = spark.createDataFrame([(version.number, content)], "number bigint, content string").coalesce(1)
    row.write.mode("append").parquet(f"{store}/versions")


def _read(spark: SparkSession, store: str, version: Version | None, table: str, schema: T.StructType,
          slots: set[int] | None = None) -> DataFrame:
    """Rows of a table in a version, of the given slots or all, with ``slot``."""
    at = {} if version is None else version.slots.get(table, {})
    paths = [f"{store}/{table}/batch={b}/slot={s}" for s, b in sorted(at.items()) if slots is None or s in slots]
    full = T.StructType([*schema.fields, T.StructField("slot", T.IntegerType())])
    if not paths:
        return spark.createDataFrame([], full)
    with_batch = T.StructType([*full.fields, T.StructField("batch", T.StringType())])
    return spark.read.schema(with_batch).option("basePath", f"{store}/{table}").parquet(*paths).drop("batch")


def _write(df: DataFrame, store: str, table: str, batch: str, keys: list[str], clustered: bool = False) -> dict[int, str]:
    """Write rows with ``slot`` as a batch; the slots that it has.  Rows that are
    ``clustered`` come row by row from files of one slot each, and stay where they are."""
    spark, path = df.sparkSession, f"{store}/{table}/batch={batch}"
    dealt = df if clustered else df.hint("rebalance", F.col("slot"))
    dealt.sortWithinPartitions("slot", *keys).write.partitionBy("slot").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return {r.slot: batch for r in back.select("slot").distinct().collect()}  # at most one more than the store's slots


def _batch_frames(spark: SparkSession, store: str, version: Version | None, table: str, schema: str) -> DataFrame:
    """Rows of an append-only table in a version's batches, with the batch's place."""
    if version is None or not version.batches:
        return spark.createDataFrame([], f"{schema}, place int")
    rows = spark.read.schema(f"{schema}, batch string").option("basePath", f"{store}/{table}").parquet(
        *(f"{store}/{table}/batch={b}" for b in version.batches))
    place = F.array_position(F.array(*(F.lit(b) for b in version.batches)), F.col("batch")).cast("int")
    return rows.withColumn("place", place).drop("batch")


def manifest(spark: SparkSession, store: str, version: Version | None) -> DataFrame:
    """The files that a version has read: src, level, length, modified and their batch's place."""
    rows = _batch_frames(spark, store, version, "manifest", f"{LISTING}, gone boolean")
    last = rows.groupBy("src").agg(F.max(F.struct("place", "level", "length", "modified", "gone")).alias("f"))
    return last.where("NOT f.gone").select("src", "f.level", "f.length", "f.modified", "f.place")


def rejects(spark: SparkSession, store: str, version: Version | None = None) -> DataFrame:
    """Files that give no row: src, level, reason and content."""
    version = version or latest_version(spark, store)
    rows = _batch_frames(spark, store, version, "rejects", _REJECTS)
    now = manifest(spark, store, version).select(F.col("src").alias("_s"), F.col("place").alias("_p"))
    # A file's reject counts if it is from the batch that read the file last.
    kept = rows.join(now, (F.col("src") == F.col("_s")) & (F.col("place") == F.col("_p")))
    return kept.select("src", "level", F.col("reject").alias("reason"), "data")


# ------------------------------------------------------------------ ingest

def ingest(spark: SparkSession, store: str, listing: DataFrame, fetch: Callable[[str, DataFrame], DataFrame],
           slots: int | None = None) -> Version:
    """Bring a store to the state of a source, and return its version (the old one where
    nothing changed).

    ``listing`` (``LISTING``) names every file that there is now; ``fetch(level, changed)``
    returns (src, folder, data) of the files of a level whose ``src`` is in ``changed``.
    A file with another length or time of modification is read again.  ``slots`` is the
    number of slots of a new store."""
    store = store.rstrip("/")
    old = latest_version(spark, store)
    number = 1 if old is None else old.number + 1
    n_slots = (slots or SLOTS) if old is None else old.n_slots
    batch = f"{number:06d}-{uuid.uuid4().hex[:8]}"
    known = None if old is None else manifest(spark, store, old).select(
        F.col("src").alias("_s"), "length", "modified", F.col("level").alias("_l"))
    changes = _write_changes(listing, known, f"{store}/manifest/batch={batch}")
    if not changes.head(1):
        return old if old is not None else _first(spark, store, batch, n_slots)

    staged = {}
    for level in LEVELS:
        wanted = changes.where((F.col("level") == level) & ~F.col("gone")).select("src")
        path = f"{store}/staged/batch={batch}/{level}"
        staged_files(fetch(level, wanted), level).write.parquet(path)
        staged[level] = spark.read.parquet(path)
    bad = [d.where("reject IS NOT NULL").select("src", F.lit(level).alias("level"), "reject", "data") for level, d in staged.items()]
    bad[0].unionByName(bad[1]).unionByName(bad[2]).hint("rebalance").write.parquet(f"{store}/rejects/batch={batch}")
    new = {level: d.where("reject IS NULL").drop("reject", "data") for level, d in staged.items()}

    touched = _touched_slots(spark, store, old, changes.select("src"), new, n_slots)
    tables = _assemble_slots(spark, store, old, changes.select("src"), new, touched, n_slots)
    written = {}
    for table, df in tables.items():
        written[table] = _write(df, store, table, batch, _SORTED[table])
    # Derived tables come from what has just been written.
    h = _history(spark, store, Version(number, n_slots, [], written))
    slot = slot_of(F.trim("session_id"), n_slots)
    for table, (build, keys) in _DERIVED.items():
        rows = build_grams(h.parts.withColumn("slot", slot)) if table == "grams" else build(h).withColumn("slot", slot)
        written[table] = _write(rows, store, table, batch, keys, table in _ROW_BY_ROW)
    kept = {} if old is None else old.slots
    merged = {t: {s: b for s, b in kept.get(t, {}).items() if s not in touched} | found for t, found in written.items()}
    version = Version(number, n_slots, [*([] if old is None else old.batches), batch], merged)
    _publish(spark, store, version)
    return version


def _first(spark: SparkSession, store: str, batch: str, n_slots: int) -> Version:
    """The version of a source without files."""
    spark.createDataFrame([], _REJECTS).write.parquet(f"{store}/rejects/batch={batch}")
    version = Version(1, n_slots, [batch], {t: {} for t in (*_SCHEMAS, *_DERIVED)})
    _publish(spark, store, version)
    return version


def _write_changes(listing: DataFrame, known: DataFrame | None, path: str) -> DataFrame:
    """New, changed and removed files: one full join of the listing with the manifest, or
    the listing itself where there is none yet."""
    spark = listing.sparkSession
    if known is None:
        listing.select("src", "level", "length", "modified", F.lit(False).alias("gone")).where("src IS NOT NULL").write.parquet(path)
        return spark.read.schema(f"{LISTING}, gone boolean").parquet(path)
    now = listing.select("src", "level", F.col("length").alias("_n"), F.col("modified").alias("_m"))
    both = now.join(known, F.col("src") == F.col("_s"), "full")
    gone = F.col("src").isNull()
    same = F.col("_s").isNotNull() & ~gone & F.col("_n").eqNullSafe(F.col("length")) & F.col("_m").eqNullSafe(F.col("modified"))
    both.where(~same).select(F.coalesce("src", "_s").alias("src"), F.coalesce("level", "_l").alias("level"),
                             F.when(gone, F.col("length")).otherwise(F.col("_n")).alias("length"),
                             F.when(gone, F.col("modified")).otherwise(F.col("_m")).alias("modified"),
                             gone.alias("gone")).write.parquet(path)
    return spark.read.schema(f"{LISTING}, gone boolean").parquet(path)


def _touched_slots(spark: SparkSession, store: str, old: Version | None, changed: DataFrame, new: dict, n_slots: int) -> set[int]:
    """Slots of the sessions that changed files belong, or belonged, to.

    The new rows' own references come first: they need no join, and a large ingest has
    touched every slot with them."""
    def slots(refs: list[DataFrame]) -> set[int]:
        found = refs[0]
        for r in refs[1:]:
            found = found.unionByName(r)
        return {r.slot for r in found.select(slot_of(F.col("sref"), n_slots).alias("slot")).distinct().collect()}

    touched = slots([new["session"].select(F.trim("session_id").alias("sref")), new["message"].select(F.col("folder").alias("sref"))]) | {PENDING}
    if old is None or len(touched) > n_slots:
        return touched
    refs = []
    for table in _SCHEMAS:  # what the files gave before
        refs.append(_read(spark, store, old, table, _SCHEMAS[table]).select("src", "sref").join(changed, "src", "left_semi").select("sref"))
    # Parts reach their session through the message that their folder names; other
    # messages with the id of a new one share its parts.
    mrefs = new["part"].select(F.col("folder").alias("_m")).unionByName(new["message"].select(F.trim("message_id").alias("_m"))).distinct()
    owners = _read(spark, store, old, "messages", _SCHEMAS["messages"]).select(F.trim("message_id").alias("_m"), "sref")
    refs.append(owners.join(mrefs, "_m", "left_semi").select("sref"))
    return touched | slots(refs)


def _assemble_slots(spark: SparkSession, store: str, old: Version | None, changed: DataFrame, new: dict,
                    touched: set[int], n_slots: int) -> dict[str, DataFrame]:
    """The touched slots' rows: kept and new ones, with their owners attached again."""
    def pool(table: str, level: str, folder: str, *more: str) -> DataFrame:
        fresh = new[level].select("src", "folder", *_DECODED[level])
        if old is None:
            return fresh
        stored = _read(spark, store, old, table, _SCHEMAS[table], touched).join(changed, "src", "left_anti")
        stored = stored.withColumn("folder", F.col(folder)).select("src", "folder", *_DECODED[level])
        # A row that several owners share is stored once for each.
        return (stored.dropDuplicates(["src"]) if level != "session" else stored).unionByName(fresh)

    sessions = pool("sessions", "session", "project_id").withColumn("sref", F.trim("session_id"))
    owners = sessions.select(F.col("sref").alias("_s"), "session_id", "project_id", F.col("updated_ms").alias("session_updated_ms"),
                             F.col("title").alias("session_title"), F.col("directory").alias("project_directory"))
    messages = pool("messages", "message", "sref").withColumnRenamed("folder", "sref")
    messages = messages.join(owners, F.col("sref") == F.col("_s"), "left").drop("_s")
    above = messages.select(F.trim("message_id").alias("_m"), "message_id", "sref", "session_id", "project_id", "role",
                            F.col("created_ms").alias("msg_created_ms"), "session_updated_ms", "session_title", "project_directory")
    parts = pool("parts", "part", "mref").withColumnRenamed("folder", "mref")
    parts = parts.join(above, F.col("mref") == F.col("_m"), "left").drop("_m")
    frames = {"sessions": sessions, "messages": messages, "parts": parts}
    return {t: f.select(*_SCHEMAS[t].fieldNames(), slot_of(F.col("sref"), n_slots).alias("slot")) for t, f in frames.items()}


# ------------------------------------------------------------------ reading

def _history(spark: SparkSession, store: str, version: Version, part_slots: set[int] | None = None) -> History:
    def rows(table, slots=None):
        found = _read(spark, store, version, table, _SCHEMAS[table], slots).where("session_id IS NOT NULL")
        return found.select(*_OWN[table].fieldNames())

    return History(rows("sessions"), rows("messages"), rows("parts", part_slots))


def _version(spark: SparkSession, store: str, version: Version | None) -> Version:
    version = version or latest_version(spark, store)
    if version is None:
        raise ValueError(f"no history is stored in {store}")
    return version


def load_store(spark: SparkSession, store: str, project_id: str | None = None, version: Version | None = None) -> History:
    """The history of a store's newest version (or of one that was returned before)."""
    store = store.rstrip("/")
    version = _version(spark, store, version)
    h = _history(spark, store, version)
    empty = History(*(t.limit(0) for t in (h.sessions, h.messages, h.parts)))
    derived = [_read(spark, store, version, t, _DERIVED[t][0](empty).schema).drop("slot") for t in _LOADED]
    return History(h.sessions, h.messages, h.parts, *derived).scoped(project_id)


def matching_slots(spark: SparkSession, store: str, version: Version, query: str, regex: bool = False) -> set[int] | None:
    """Slots whose parts hold every trigram that a match must contain; None: any may match."""
    grams = required_grams(query, regex)
    if not grams:
        return None
    rows = _read(spark, store, version, "grams", T.StructType([T.StructField("gram", T.IntegerType())]))
    found = rows.where(F.col("gram").isin(grams)).groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
    return {r.slot for r in found.collect()}  # at most the store's slots


def load_matching(spark: SparkSession, store: str, query: str, regex: bool = False, project_id: str | None = None,
                  version: Version | None = None) -> History:
    """The history for one keyword search: of the parts only the slots that can match are
    read (one lookup in ``grams``); the search itself still tests every row of these."""
    store = store.rstrip("/")
    version = _version(spark, store, version)
    return _history(spark, store, version, matching_slots(spark, store, version, query, regex)).scoped(project_id)


# ------------------------------------------------------------------ sources

def ingest_tree(spark: SparkSession, root: str, store: str, slots: int | None = None) -> Version:
    """Bring a store to the state of a JSON tree (:mod:`convsift.sources.tree`)."""
    listing = list_files(spark, root, LEVELS[0])
    for level in LEVELS[1:]:
        listing = listing.unionByName(list_files(spark, root, level))

    def fetch(level: str, changed: DataFrame) -> DataFrame:
        named = [r.src for r in changed.limit(MAX_NAMED + 1).collect()]
        if not named:
            return spark.createDataFrame([], "src string, folder string, data string")
        if len(named) <= MAX_NAMED:
            return read_files(spark, [_plain(p) for p in named])
        return read_files(spark, os.path.join(root, level, "*", "*.json")).join(changed, "src", "left_semi")

    return ingest(spark, store, listing, fetch, slots)


def _plain(path: str) -> str:
    """A file's path from its URL, pattern characters escaped."""
    from urllib.parse import unquote

    from .tree import _literal

    return _literal(unquote(path))


def ingest_frames(spark: SparkSession, store: str, files: dict[str, DataFrame], slots: int | None = None) -> Version:
    """Bring a store to the state of frames (src, folder, data, modified), one a level."""
    def listed(level: str) -> DataFrame:
        return files[level].select("src", F.lit(level).alias("level"), F.octet_length("data").cast("long").alias("length"), "modified")

    listing = listed(LEVELS[0])
    for level in LEVELS[1:]:
        listing = listing.unionByName(listed(level))
    everything = latest_version(spark, store.rstrip("/")) is None  # nothing to leave out

    def fetch(level: str, changed: DataFrame) -> DataFrame:
        found = files[level].select("src", "folder", "data").where("src IS NOT NULL")
        return found if everything else found.join(changed, "src", "left_semi")

    return ingest(spark, store, listing, fetch, slots)
