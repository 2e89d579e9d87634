"""Line deduplication by content-defined chunks of lines.

A rolling hash over the last line hashes decides after which lines a text is cut, so
the cuts of a passage stay where they are when lines before it come or go; a line is
likelier to end with a cut the more words it has, and a line of ``LONG_LINE`` words or
more is always a chunk of its own.  From every cut a chunk grows until it has two worded
lines and ``MIN_WORDS`` words, and ends at the next cut.  Texts are cut once for each of
``LEVELS``, with different hashes.  Chunks are compared over the whole corpus: the
occurrence with the smallest doc_id (then the first in its text) stays, the others go;
equal hashes are confirmed on the chunks' bytes.  Before its first cut and after its last
one a passage has lines that no chunk holds, so a repeated chunk is extended over the
neighbouring lines, of up to ``EXTEND_WORDS`` words, that are those of the first occurrence,
byte by byte (not over empty lines at its edge, which separate).  A line only goes when
an earlier place has it, so the first place of every line stays.

Defined results: null and empty texts stay as they are; equal rows (same doc_id
and text) keep the same text; a null doc_id counts as larger than all others; a
text may become empty; an empty table gives an empty result; other columns pass
through, unless a name is one of the results'.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType
from xxhash import xxh3_64_intdigest

from convsift.llm.common import documents, materialise, release, ship_package, skew_lookup, text_groups, tidy

#: Lines that the rolling hash of each level covers.
LEVELS = (1, 1, 1, 1, 2)
#: A cut comes after a line with a chance of its words in this number, at most MAX_CUT.
CUT_WORDS, MAX_CUT = 20, 0.7
LONG_LINE = 20
MIN_WORDS = 12
MAX_LINES = 64
EXTEND_WORDS = 60
_M64 = (1 << 64) - 1
_P = 0x9FB21C651E98DF25


def _cut_below(words: int) -> int:
    return int(min(MAX_CUT, words / CUT_WORDS) * (1 << 32))


def cuts(hashes: list[int], words: list[int], level: int) -> list[int]:
    """Ascending places (numbers of lines before them) at which a text of ``len(words)``
    lines is cut, its end included; ``MAX_LINES`` without a cut end with one."""
    out, window = [], LEVELS[level]
    salt = (2 * level + 1) * _P & _M64
    for i, n in enumerate(words):
        if n >= LONG_LINE:
            if i and (not out or out[-1] < i):
                out.append(i)
            out.append(i + 1)
        elif n:
            rolling = 0
            for h in hashes[max(0, i + 1 - window):i + 1]:
                rolling = (rolling * _P + h) & _M64
            rolling = rolling * salt & _M64
            if (rolling ^ rolling >> 29) * _P >> 32 & 0xFFFFFFFF < _cut_below(n) or i + 1 - (out[-1] if out else 0) >= MAX_LINES:
                out.append(i + 1)
    if words and (not out or out[-1] < len(words)):
        out.append(len(words))
    return out


def spans(hashes: list[int], words: list[int]) -> set[tuple[int, int]]:
    """(first line, line after the last) of every chunk that is compared, of all levels."""
    n = len(words)
    total, worded = [0], [0]
    for x in words:
        total.append(total[-1] + x)
        worded.append(worded[-1] + (x > 0))
    # Enough lines from each line on (a chunk of short lines ends before a long one).
    enough, end = [], 0
    for start in range(n):
        end = max(end, start)
        while end < n and not (worded[end] - worded[start] > 1 and total[end] - total[start] >= MIN_WORDS):
            end += 1
        full = worded[end] - worded[start] > 1 and total[end] - total[start] >= MIN_WORDS
        enough.append(end if full else n + 1)
    long = [i for i, x in enumerate(words) if x >= LONG_LINE] + [n]
    out = {(i, i + 1) for i in long[:-1]}
    for level in range(len(LEVELS)):
        ends = cuts(hashes, words, level)
        k = j = 0
        for start in [0, *ends[:-1]]:
            while long[j] < start:
                j += 1
            need = enough[start]
            while k < len(ends) and ends[k] < need:
                k += 1
            stop = min(ends[k] if k < len(ends) else n + 1, max(need, start + MAX_LINES))
            if stop <= long[j]:
                out.add((start, stop))
    return out


def chunks(text: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(first line, line after the last, bytes) of every chunk that is compared."""
    lines = text.split(b"\n")
    hashes, words = [xxh3_64_intdigest(x) for x in lines], [len(x.split()) for x in lines]
    for a, b in sorted(spans(hashes, words)):
        yield a, b, b"\n".join(lines[a:b])


def _compared(rows: DataFrame) -> DataFrame:
    """_lid, _lrow (hash of the text), pos, stop and chash of every chunk that is compared."""
    import pyarrow as pa

    def cut(batches):
        for b in batches:
            ids, keys = b.column("_lid").to_pylist(), b.column("_lrow").to_pylist()
            for lo, hi, texts in text_groups(b.column("text")):
                out = [(i, r, first, stop, xxh3_64_intdigest(body) - (1 << 63))
                       for i, r, t in zip(ids[lo:hi], keys[lo:hi], texts) for first, stop, body in chunks(t)]
                columns = list(zip(*out)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                                 names=["_lid", "_lrow", "pos", "stop", "chash"])

    return rows.select("_lid", "_lrow", "text").mapInArrow(
        tidy(cut), "_lid bigint, _lrow bigint, pos int, stop int, chash bigint")


def _neighbours(lines: list[bytes], at: range) -> list[bytes]:
    """The lines at the given places: up to a long one, and until they have EXTEND_WORDS words."""
    out, words = [], 0
    for i in at:
        n = len(lines[i].split())
        if n >= LONG_LINE or words >= EXTEND_WORDS:
            break
        out.append(lines[i])
        words += n
    return out


_LINES = ArrayType(BinaryType())


@F.pandas_udf(ArrayType(StructType().add("body", "binary").add("before", _LINES).add("after", _LINES)))
def _bodies(text: pd.Series, wanted: pd.Series) -> pd.Series:
    """Bytes of the wanted spans of lines of a text; for those that stay also the lines
    before (nearest first) and after."""
    out = []
    for t, places in zip(text, wanted):
        lines, rows = (t or "").encode().split(b"\n"), []
        for s in places:
            a, b = s["pos"], s["stop"]
            before = after = []
            if s["stays"]:
                before = _neighbours(lines, range(a - 1, max(a - 1 - MAX_LINES, -1), -1))
                after = _neighbours(lines, range(b, min(b + MAX_LINES, len(lines))))
            rows.append({"body": b"\n".join(lines[a:b]), "before": before, "after": after})
        out.append(rows)
    release()
    return pd.Series(out)


@F.pandas_udf(ArrayType(StructType().add("pos", "integer").add("stop", "integer").add("left", "long").add("right", "long")))
def _stretches(wanted: pd.Series) -> pd.Series:
    """Spans that touch, joined; with the hashes of the first and the last one."""
    out = []
    for places in wanted:
        rows: list[dict] = []
        for s in sorted(places, key=lambda s: (s["pos"], -s["stop"])):
            if rows and s["pos"] <= rows[-1]["stop"]:
                if s["stop"] > rows[-1]["stop"]:
                    rows[-1].update(stop=s["stop"], right=s["chash"])
            else:
                rows.append({"pos": s["pos"], "stop": s["stop"], "left": s["chash"], "right": s["chash"]})
        out.append(rows)
    return pd.Series(out)


def _more(lines: list[bytes], at: range, first: list[bytes] | None) -> int:
    """How many of the lines at ``at`` are those of ``first``; empty ones at the end don't count."""
    n = 0
    for k, (i, line) in enumerate(zip(at, first if first is not None else ()), 1):
        if lines[i] != line:
            break
        if line.split():
            n = k
    return n


@F.pandas_udf(StringType())
def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    """A text without the given stretches of lines and their neighbours that the first
    occurrence has too."""
    out = []
    for t, places in zip(text, gone):
        if t is not None and places is not None and len(places):
            drop: set[int] = set()
            lines = t.encode().split(b"\n")
            for s in places:
                a = s["pos"] - _more(lines, range(s["pos"] - 1, -1, -1), s["before"])
                b = s["stop"] + _more(lines, range(s["stop"], len(lines)), s["after"])
                drop.update(range(a, b))
            t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop)
        out.append(t)
    release()
    return pd.Series(out, dtype=object)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``, and the number of stretches of
    them that went as ``removed_chunks``."""
    ship_package(docs.sparkSession)
    own = [c for c in docs.columns if c != "removed_chunks"]
    # Rows are told apart by id and text; a null id sorts last.
    docs = docs.select(*own, F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("_lid"),
                       F.xxhash64("text").alias("_lrow"))
    found = materialise(_compared(docs), "chunks")
    first = found.groupBy("chash").agg(F.min(F.struct("_lid", "_lrow", "pos")).alias("_first"),
                                       F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialise(first, "repeated-chunks")
    again = skew_lookup(found, first, "chash", ["_first"], "n").where("_first IS NOT NULL")
    mine = F.struct("_lid", "_lrow", "pos") == F.col("_first")
    again = materialise(again.select("_lid", "_lrow", "pos", "stop", "chash", mine.alias("stays")), "repeats")

    # Bytes are compared by their least and greatest under a hash, which pre-aggregate.
    per_doc = again.groupBy(F.col("_lid").alias("_pi"), F.col("_lrow").alias("_pr")).agg(
        F.array_sort(F.collect_set(F.struct("pos", "stop", "chash", "stays"))).alias("_again"))
    some = docs.select("_lid", "_lrow", "text").join(per_doc.hint("merge"), (F.col("_lid") == F.col("_pi")) & (F.col("_lrow") == F.col("_pr")))
    some = some.select("_lid", "_lrow", "_again", _bodies("text", F.col("_again")).alias("_b"))
    some = some.select("_lid", "_lrow", F.explode(F.arrays_zip("_again", "_b")).alias("z"))
    some = some.select("_lid", "_lrow", "z._again.*", "z._b.*")
    beside = F.max(F.when(F.col("stays"), F.struct("before", "after")))
    info = some.groupBy("chash").agg(F.min("body").alias("lo"), F.max("body").alias("hi"), beside.alias("beside"), F.count(F.lit(1)).alias("n"))
    info = materialise(info.select("chash", (F.col("lo") != F.col("hi")).alias("apart"), "beside.before", "beside.after", "n"), "first-chunks")
    gone = again.where("NOT stays").select("_lid", "_lrow", "pos", "stop", "chash")
    if info.where("apart").head(1):
        # Different bytes under one hash: the first occurrence of the same bytes stays, not extended.
        apart = info.where("apart").select(F.col("chash").alias("_a"))
        alike = some.join(apart, F.col("chash") == F.col("_a")).withColumn("at", F.struct("_lid", "_lrow", "pos"))
        least = alike.groupBy(F.col("chash").alias("_lc"), F.col("body").alias("_lb")).agg(F.min("at").alias("_first"))
        alike = alike.join(least, (F.col("chash") == F.col("_lc")) & (F.col("body") == F.col("_lb"))).where("at <> _first")
        gone = gone.join(apart, F.col("chash") == F.col("_a"), "left_anti").unionByName(
            alike.select("_lid", "_lrow", "pos", "stop", F.lit(None).cast("long").alias("chash")))
    rows = gone.groupBy("_lid", "_lrow").agg(F.collect_set(F.struct("pos", "stop", "chash")).alias("_spans"))
    rows = materialise(rows.select("_lid", "_lrow", F.inline(_stretches("_spans"))), "stretches")
    for side, lines in (("left", "before"), ("right", "after")):
        rows = skew_lookup(rows, info.select(F.col("chash").alias(side), lines, "n"), side, [lines], "n")
    gone = rows.groupBy(F.col("_lid").alias("_gi"), F.col("_lrow").alias("_gr")).agg(
        F.collect_list(F.struct("pos", "stop", "before", "after")).alias("_gone"))
    out = docs.join(gone.hint("merge"), (F.col("_lid") == F.col("_gi")) & (F.col("_lrow") == F.col("_gr")), "left")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(_without("text", "_gone"))
    return out.select(*(c for c in own if c != "text"), text.alias("text"),
                      F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("removed_chunks")).select(*own, "removed_chunks")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "text", "removed_chunks")


ORACLE_SQL = None
