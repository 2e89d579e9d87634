"""Detection of periodic runs of words, by a sparse diagonal programme.

A run is a maximal stretch of words with smallest period q and at least
``max(MIN_WORDS, 2 q)`` words.  Words i and i - lag being equal is a cell of the
diagonal ``lag``; a diagonal counts its consecutive cells, and one that ends after
at least ``lag`` of them (and enough words) emits its stretch.  Every word looks at
its occurrences up to ``NEAR`` - 1 words before.  Farther ones would make a cell for
every pair of a frequent word, so they are taken a block at a time: a run with a lag
in [2h, 4h) repeats at least one whole aligned block of h words at that lag, so the
cells of that scale are the lags at which an aligned block occurs again; a block that
goes on at its predecessor's lag lengthens the diagonal by h, and where it ends, the
rest of the match (under h words on either side) is added by halving.  A block is
compared with two blocks' worth of places, so a scale costs at most two cells a word
and the whole text n log n, whatever repeats in it.  Cells inside a run whose period
is at most h lie on multiples of that period and are left out.

Blocks meet by 64-bit hashes, and every emitted run is compared word by word, with
the words beside it; were two hashes to agree by chance, the text is done anew with
other ones.  Results are exact.

Defined results: a null, empty or blank text has no words and no runs; repeated rows
and null ids are judged row by row; an empty table gives an empty result; other
columns are ignored, whatever their names.  A text is held in memory whole, with about
100 bytes a word beside it.
"""

from __future__ import annotations

from itertools import chain, count

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convsift.llm.common import documents, mix64, ship_package, text_groups, tidy

MIN_WORDS = 12
#: Lags below this are compared word by word; a power of two.
NEAR = 16
_STEP = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------------ runs of a sequence

def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true cells."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _chains(block: np.ndarray, lag: np.ndarray, n_blocks: int):
    """Diagonals of cells (block, lag): lag, first and last block of each unbroken one."""
    key = np.sort(lag * (n_blocks + 2) + block)
    new = np.flatnonzero(np.diff(key, prepend=-2) != 1)
    last = key[np.append(new[1:], len(key)) - 1]
    first = key[new]
    return first // (n_blocks + 2), first % (n_blocks + 2), last % (n_blocks + 2)


def _covered(found: dict, most: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether [start, end) lies in a found run with a period of at most ``most``."""
    runs = sorted(k for k, q in found.items() if q <= most)
    if not runs:
        return np.zeros(len(start), bool)
    starts, ends = np.array(runs).T
    reach = np.concatenate([[0], np.maximum.accumulate(ends)])
    return reach[np.searchsorted(starts, start, "right")] >= end


def find_runs(words: np.ndarray, longest: int | None = None, least: int = MIN_WORDS, seed: int = 0) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a sequence of word numbers, by start, then period.

    ``longest`` bounds the length of any run (several texts may be joined if they
    share no numbers)."""
    n = len(words)
    longest = n if longest is None else min(longest, n)
    found: dict[tuple[int, int], int] = {}  # (start, end) -> period; smaller lags come first
    for lag in range(1, min(NEAR, longest // 2 + 1)):
        lo, hi = _stretches(words[lag:] == words[:-lag])
        keep = hi - lo >= max(lag, least - lag)
        for s, e in zip(lo[keep].tolist(), hi[keep].tolist()):
            found.setdefault((s, e + lag), lag)
    level = {1: mix64(words.astype(np.uint64) * _STEP + np.uint64(seed * 2 + 1))}
    h = 1
    while 4 * h <= longest:
        if 2 * h >= NEAR:
            _far(words, level, h, least, found)
        a = level[h]
        level[2 * h] = mix64(a[:-h] * _STEP + (a[h:] ^ np.uint64(seed + 1)))
        h *= 2
    for (s, e), q in found.items():
        inside = np.array_equal(words[s:e - q], words[s + q:e])
        if not inside or s and words[s - 1] == words[s - 1 + q] or e < n and words[e] == words[e - q]:
            return find_runs(words, longest, least, seed + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def _far(words: np.ndarray, level: dict, h: int, least: int, found: dict) -> None:
    """Runs with lags in [2h, 4h)."""
    n, windows = len(words), level[h]
    rows = -(-len(windows) // h)
    grid = np.zeros(rows * h, np.uint64)
    grid[:len(windows)] = windows
    grid = grid.reshape(rows, h)
    blocks, lags = [], []
    for gap in (2, 3):
        if rows > gap:
            at = np.flatnonzero(grid[gap:] == grid[:-gap, :1])
            at = at[at + gap * h < len(windows)]
            blocks.append(at // h)
            lags.append(gap * h + at % h)
    if not blocks or not sum(map(len, blocks)):
        return
    lag, first, last = _chains(np.concatenate(blocks), np.concatenate(lags), rows)
    start, end = first * h, (last + 1) * h
    keep = end - start + 2 * (h - 1) >= lag
    lag, start, end = lag[keep], start[keep], end[keep]
    keep = ~_covered(found, h, start, start + h + lag)
    lag, start, end = lag[keep], start[keep], end[keep]
    g = h // 2
    while g:
        w = level[g]
        before = np.maximum(start - g, 0)
        more = (start >= g) & (w[before] == w[before + lag])
        start = np.where(more, start - g, start)
        beside = np.minimum(end + lag, len(w) - 1)
        more = (end + lag + g <= n) & (w[np.minimum(end, len(w) - 1)] == w[beside])
        end = np.where(more, end + g, end)
        g //= 2
    keep = (end - start >= lag) & (end - start + lag >= least)
    for s, e, q in zip(start[keep].tolist(), end[keep].tolist(), lag[keep].tolist()):
        found.setdefault((s, e + q), q)


# ------------------------------------------------------------------ texts

def runs_of_texts(texts: list[bytes], least: int = MIN_WORDS) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs of each text.  A word's number is the place of its first
    occurrence, over all texts, so texts share no numbers."""
    words = [t.split() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
    numbers = (map({}.setdefault, w, count(int(s))) for w, s in zip(words, starts))
    ids = np.fromiter(chain.from_iterable(numbers), np.int64, int(starts[-1]))
    out = [(w, []) for w in words]
    for s, length, q in find_runs(ids, max(map(len, words), default=0), least):
        owner = int(np.searchsorted(starts, s, "right")) - 1
        out[owner][1].append((s - int(starts[owner]), length, q))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for s, length, q in runs:
            gone[s + q] += 1
            gone[s + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
    return b" ".join(words)


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def detect_runs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Per row: doc_id, runs by start and period, and the collapsed text."""
    import pyarrow as pa

    ship_package(docs.sparkSession)

    def detect(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for lo, hi, group in text_groups(texts):
                ends, flat, collapsed = [0], [], []
                for words, runs in runs_of_texts(group, least):
                    flat.extend(runs)
                    ends.append(len(flat))
                    collapsed.append(collapse(words, runs))
                parts = np.array(flat, np.int64).reshape(-1, 3).T
                fields = pa.StructArray.from_arrays([pa.array(p) for p in parts], names=["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)
                collapsed = pa.array(collapsed, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), runs, collapsed], names=["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(tidy(detect), f"doc_id bigint, runs {RUNS}, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The query's texts: one document in ten, by the checksum of its id, repeats a
    stretch of its own words from a place on (a null id: never)."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    def repeat(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(ws, lambda _, i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # The words are bound once, as the only element of an array.
    repeated = F.element_at(F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, repeat(ws))), 1)
    return F.when(h % 10 == 0, repeated).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    doc_id = F.col("doc_id").cast("long")
    found = detect_runs(docs.select(doc_id.alias("doc_id"), planted(doc_id, F.col("text")).alias("text")))
    # The longest run; of several the one that starts first, then that of the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"),
                                                              (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"),
                       F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                       F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("_best.length"), -F.col("_best.period")
    return out.select("doc_id", "n_runs", (-F.col("_best.start")).alias("start"), length.alias("length"),
                      period.alias("period"), F.expr("(1000 * _best.length) div (-_best.period)").alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256")


_CRC_BYTE = ("list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda e, z: xor(e >> 1, 3988292384 * (e & 1)))")

ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, b: {_CRC_BYTE}), 4294967295) AS h FROM documents),
e AS (SELECT *, len(ws)::BIGINT AS n, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM e),
t AS (SELECT *, 1 + (n - a) // (3 + coalesce(g, 0) % 8) AS p FROM f),
w AS (SELECT r, i, ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS word
      FROM (SELECT r, ws, a, p, unnest(range(0, n)) AS i FROM t)),
cells AS (SELECT x.r, y.i, y.i - x.i AS lag FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND x.i < y.i),
marked AS (SELECT *, i - row_number() OVER (PARTITION BY r, lag ORDER BY i) AS stretch FROM cells),
diagonals AS (SELECT r, lag, min(i) - lag AS start, count(*) + lag AS length FROM marked GROUP BY r, lag, stretch
              HAVING count(*) >= lag AND count(*) + lag >= {MIN_WORDS}),
runs AS (SELECT r, start, length, min(lag) AS period FROM diagonals GROUP BY r, start, length),
lists AS (SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines,
                 arg_min({{'start': start, 'length': length, 'period': period}}, {{'a': -length, 'b': start, 'c': period}}) AS best
          FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT w.r, string_agg(word, ' ' ORDER BY w.i) AS collapsed FROM w ANTI JOIN gone ON w.r = gone.r AND w.i = gone.i GROUP BY w.r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length,
       best.period::BIGINT AS period, (1000 * best.length // best.period)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM d LEFT JOIN lists USING (r) LEFT JOIN kept USING (r)
"""
