"""Shared helpers: scratch tables, skew-safe lookups, vectorised word cutting."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convsift.session import scratch_path, ship_package

#: Words are runs of code points other than space and the controls 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: A key above this share of all rows is looked up by broadcast (so at most
#: ``HOT_SHARE`` such keys exist, whatever the input size).
HOT_SHARE = 400
#: Texts are processed in groups of about this many UTF-8 bytes per numpy step.
GROUP_BYTES = 1 << 20


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` once below the shared checkpoint folder and reread it."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0), without building an array of them:
    a word starts at every non-space that is first or follows a space."""
    spaces = "\t\n\u000b\u000c\r"
    flat = F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), spaces, " " * len(spaces)))
    squeezed = F.regexp_replace(flat, " +", " ")
    blanks = F.length(squeezed) - F.length(F.translate(squeezed, " ", ""))
    return (blanks - F.when(squeezed.endswith(" "), 1).otherwise(0)).cast("long")


def skew_lookup(left: DataFrame, table: DataFrame, key: str, values: list[str], weight: str) -> DataFrame:
    """Left join of ``left`` with ``table`` (one row per ``key``) on ``key``.

    ``weight`` is the number of left rows of a key.  Keys above 1/HOT_SHARE of
    all rows, at most HOT_SHARE of them, are broadcast; the left rows that
    found theirs get a spread-out join key, so no task receives a hot key.
    Null keys match nothing.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = (table.where(F.col(weight) * HOT_SHARE > F.lit(max(total, HOT_SHARE)))
           .select(F.col(key).alias("_hk"), F.struct(*values).alias("_hv")).limit(HOT_SHARE))
    cold = table.select(F.col(key).cast("string").alias("_ck"), F.struct(*values).alias("_cv"))
    out = left.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    spread = F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))
    out = out.withColumn("_jk", F.when(F.col("_hk").isNotNull() | F.col(key).isNull(), spread)
                         .otherwise(F.col(key).cast("string")))
    out = out.join(cold, F.col("_jk") == F.col("_ck"), "left")
    for v in values:
        out = out.withColumn(v, F.coalesce(F.col(f"_hv.{v}"), F.col(f"_cv.{v}")))
    return out.drop("_hk", "_hv", "_jk", "_ck", "_cv")


# ------------------------------------------------------------------ numpy side

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (multiply and xor-shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9FB21C651E98DF25


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled:filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
        filled += step
    return out


class Words:
    """Words of a group of UTF-8 texts: byte ranges, owners and 64-bit hashes."""

    def __init__(self, texts: list[bytes], lower: bool):
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.doc_start = np.concatenate([[0], np.cumsum(sizes)])
        buf = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
        self.bytes = _LOWER[buf] if lower else buf
        solid = ~_SPACE[buf]
        edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.n_docs = len(texts)
        self.owner = np.searchsorted(self.doc_start, self.start, "right") - 1
        self.first = np.searchsorted(self.owner, np.arange(self.n_docs + 1))
        self.solid = solid

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        power = _powers(_P, int(length.max()))
        at = np.flatnonzero(self.solid)
        within = at - np.repeat(self.start, length)
        terms = _BYTE[self.bytes[at]] * power[within]
        sums = np.add.reduceat(terms, np.concatenate([[0], np.cumsum(length)[:-1]]))
        return mix64(sums + length.astype(np.uint64))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(width):
        acc = acc * np.uint64(_P) + h[j:j + n]
    return mix64(acc)


def groups_by_bytes(texts: list[bytes], limit: int = GROUP_BYTES):
    """Index ranges of consecutive texts with about ``limit`` bytes each (at least one text)."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def release() -> None:
    """Give memory that a task has freed back to the system: idle Python workers
    stay, and an executor's limit counts what they keep."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(function):
    """``function`` over an iterator of batches, with ``release`` at its end."""
    def run(batches):
        yield from function(batches)
        release()

    return run


def text_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column (null: empty)."""
    import pyarrow as pa

    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def text_groups(column, limit: int = GROUP_BYTES):
    """(from, to, texts) of consecutive rows of an Arrow string column, about ``limit``
    bytes each; only one group is held as Python objects (null: empty)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > lo and held + size > limit:
            yield lo, i, text_bytes(column.slice(lo, i - lo))
            lo, held = i, 0
        held += size
    if lo < len(sizes):
        yield lo, len(sizes), text_bytes(column.slice(lo))


__all__ = ["WORD", "materialise", "documents", "n_words", "skew_lookup", "mix64", "Words", "windows",
           "groups_by_bytes", "text_bytes", "text_groups", "tidy", "release", "ship_package"]
