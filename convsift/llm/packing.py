"""Best-fit packing by length patterns and non-negative least squares.

Pieces (documents, or cuts of long ones) are counted by length.  Patterns of up
to ``DEPTH`` coarse lengths that fill a sequence are enumerated, repeat counts
are fitted to the coarse histogram by non-negative least squares and rounded
down, and the lengths that no pattern took go best-fit into the open ends,
longest first.  The plan works on counts of lengths only, at most ``capacity``
of them, so it fits the driver whatever the corpus size; the pieces are then
dealt to it by their rank within their length.

Defined results: a null or empty text is a single end token; repeated rows and
null ids are packed as often as they occur; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convsift.llm.common import Words, documents, materialise, ship_package, text_groups, tidy

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Coarse lengths a sequence is divided into, and documents in a pattern.
COARSE = 32
DEPTH = 4
#: Share of all tokens, in the shortest lengths, that patterns leave to fill the open ends.
RESERVE = 0.25
#: Rows that one rank group of a length holds, about.
GROUP_ROWS = 800
#: Runs and pieces whose ids a worker keeps.
CACHE_PIECES = 150_000
CACHE_WORDS = 600_000


# ------------------------------------------------------------------ the plan

def nnls(a: np.ndarray, b: np.ndarray, steps: int = 600) -> np.ndarray:
    """min |a x - b| over x >= 0, by accelerated projected gradient."""
    gram, target = a.T @ a, a.T @ b
    rate = 1.0 / max(np.linalg.norm(gram, 2), 1e-12)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - rate * (gram @ y - target))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def fit_patterns(coarse: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(pattern of coarse lengths, repeats): patterns that fill a whole sequence."""
    units = len(coarse) - 1
    present = [u for u in range(1, units + 1) if coarse[u]]
    patterns = [p for d in range(1, depth + 1) for p in combinations_with_replacement(present, d) if sum(p) == units]
    if not patterns:
        return []
    a = np.zeros((units + 1, len(patterns)))
    for j, p in enumerate(patterns):
        for u in p:
            a[u, j] += 1
    scale = max(coarse.max(), 1)
    left, out = coarse.astype(np.int64).copy(), []
    for j, x in sorted(enumerate(nnls(a, coarse / scale) * scale), key=lambda v: (-v[1], v[0])):
        need = a[:, j].astype(np.int64)
        r = min([int(x + 1e-6), *(int(left[u] // need[u]) for u in set(patterns[j]))])
        if r > 0:
            left -= r * need
            out.append((patterns[j], r))
    return out


class _Open:
    """Open sequences by free room: runs of (first sequence, number) for each room."""

    def __init__(self):
        self.rooms: list[int] = []
        self.runs: dict[int, list[list[int]]] = {}

    def add(self, room: int, first: int, n: int) -> None:
        if room <= 0:
            return
        if room not in self.runs:
            bisect.insort(self.rooms, room)
            self.runs[room] = []
        self.runs[room].append([first, n])

    def best(self, length: int, most: int):
        """Up to ``most`` sequences with the smallest room that holds ``length``, or None."""
        i = bisect.bisect_left(self.rooms, length)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        run = self.runs[room][-1]
        first, n = run[0], min(run[1], most)
        run[0] += n
        run[1] -= n
        if not run[1]:
            self.runs[room].pop()
            if not self.runs[room]:
                del self.runs[room]
                del self.rooms[i]
        return room, first, n


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, rank, n, sequence, offset): the pieces of a length with rank
    ``rank``.. ``rank + n - 1`` go to sequences ``sequence``.. at ``offset``."""
    unit = -(-capacity // COARSE)
    left = {l: c for l, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    opened, sequences = _Open(), 0

    def place(length: int, n: int, first: int, offset: int) -> None:
        rows.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    if left.get(capacity):
        n = left[capacity]
        place(capacity, n, 0, 0)
        sequences = n
    # Lengths of each coarse bin, longest last; a coarse bin u holds ((u - 1) * unit, u * unit].
    bins: dict[int, list[int]] = {}
    keep = RESERVE * sum(l * c for l, c in left.items())
    for l in sorted(left):
        keep -= l * left[l]
        if left[l] and keep < 0:
            bins.setdefault(-(-l // unit), []).append(l)
    coarse = np.zeros(COARSE + 1)
    for u, ls in bins.items():
        coarse[u] = sum(left[l] for l in ls)
    for pattern, repeats in fit_patterns(coarse):
        while repeats:
            # The longest left of each bin; as many repeats as all of them last.
            lengths, need = [], {}
            for u in pattern:
                ls = bins[u]
                while ls and left[ls[-1]] <= 0:
                    ls.pop()
                lengths.append(ls[-1])
                need[ls[-1]] = need.get(ls[-1], 0) + 1
            n = min([repeats, *(left[l] // k for l, k in need.items() if left[l] >= k)])
            if any(left[l] < k for l, k in need.items()):
                # Fewer left of this length than the pattern takes: step down within the bin.
                lengths, n = _one_by_one(pattern, bins, left), 1
                if lengths is None:
                    break
            offset = 0
            for l in sorted(lengths, reverse=True):
                place(l, n, sequences, offset)
                offset += l
            opened.add(capacity - offset, sequences, n)
            sequences += n
            repeats -= n
    for l in sorted(left, reverse=True):
        while left[l] > 0:
            found = opened.best(l, left[l])
            if found is None:
                deep = capacity // l
                n = max(1, left[l] // deep) if left[l] >= deep else 1
                room, first = capacity, sequences
                sequences += n
            else:
                room, first, n = found
            # Stack copies while they fit: best fit would choose the same room again.
            offset = capacity - room
            while room >= l and left[l] >= n:
                place(l, n, first, offset)
                offset += l
                room -= l
            opened.add(room, first, n)
    return np.array(rows, np.int64).reshape(-1, 5)


def _one_by_one(pattern, bins, left):
    taken: dict[int, int] = {}
    out = []
    for u in pattern:
        l = next((l for l in reversed(bins[u]) if left[l] - taken.get(l, 0) > 0), None)
        if l is None:
            return None
        taken[l] = taken.get(l, 0) + 1
        out.append(l)
    return out


# ------------------------------------------------------------------ tokens

#: Characters that NFC leaves alone and that lower-case one by one.
_PLAIN = re.compile("[\x21-\x7e\xa1-\u012f\u0132-\u0148\u014a-\u017e]+")


def _visible_bytes() -> dict[int, int]:
    """Byte-level vocabularies show bytes that do not print as code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


_VISIBLE = _visible_bytes()


_NONE = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _merged(a: tuple, b: tuple) -> tuple:
    hashes, places = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(hashes, kind="stable")
    return hashes[order], places[order]


class Encoder:
    """Token ids of texts; ids of a blank-separated run never depend on its
    neighbours (the tokenizer drops white space), so runs, known by their 64-bit
    hashes, are encoded once.

    Runs of plain Latin characters are lower-cased and cut here, in the
    tokenizer's own way, and only their pieces go through its merges; all other
    runs go through the whole tokenizer.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cutters = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.cut = None
        if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cutters] == ["Split", "ByteLevel"]:
            self.cut = regex.compile(cutters[0]["pattern"]["Regex"]).findall
        self._forget()

    def _forget(self) -> None:
        self.pieces: dict[str, bytes] = {}
        # Known runs: sorted hashes with their places, old ones and recent ones apart.
        self.known = [_NONE, _NONE]
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def _run(self, run: str) -> bytes:
        if self.cut is None or not _PLAIN.fullmatch(run):
            return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for piece in self.cut(run.lower()):
            ids = self.pieces.get(piece)
            if ids is None:
                if len(self.pieces) > CACHE_PIECES:
                    self.pieces = {}
                merged = self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(_VISIBLE))
                ids = self.pieces[piece] = array("I", [t.id for t in merged]).tobytes()
            out.append(ids)
        return b"".join(out)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """Places of runs by their hashes, -1 where a run is not known."""
        out = np.full(len(hashes), -1, np.int64)
        for known, places in self.known:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                out = np.where(known[at] == hashes, places[at], out)
        return out

    def _learn(self, runs: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Encode new runs (ascending hashes); their places."""
        ids = [self._run(r.decode("utf-8", "replace")) for r in runs]
        size = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        places = len(self.size) + np.arange(len(ids))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
        old, recent = self.known
        recent = _merged(recent, (hashes, places))
        self.known = [old, recent] if 8 * len(recent[0]) < len(old[0]) else [_merged(old, recent), _NONE]
        return places

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of every text, with END_ID at its end."""
        if len(self.size) > CACHE_WORDS or len(self.flat) > 10 * CACHE_WORDS:
            self._forget()
        w = Words(texts, lower=False)
        hashes, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        place = self._places(hashes)
        new = np.flatnonzero(place < 0)
        if len(new):
            raw = w.bytes.tobytes()
            place[new] = self._learn([raw[w.start[i]:w.end[i]] for i in first[new]], hashes[new])
        which = place[back]
        size = self.size[which]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[which] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[w.first]
        return [np.append(ids[a:b], np.array([END_ID], "<u4")) for a, b in zip(cuts[:-1], cuts[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; what it knows serves the worker's later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    import pyarrow as pa

    ship_package(docs.sparkSession)

    def cut(batches):
        encode = encoder(tokenizer_path).ids
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            rows = []
            for lo, hi, texts in text_groups(b.column("text")):
                for doc, tokens in zip(ids[lo:hi], encode(texts)):
                    for k, at in enumerate(range(0, len(tokens), capacity)):
                        piece = tokens[at:at + capacity]
                        rows.append((doc, k, at, len(piece), zlib.crc32(piece.tobytes())))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        tidy(cut), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


# ------------------------------------------------------------------ dealing

def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a column ``length`` of 1 to ``capacity``) plus sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_packing(histogram, capacity)
    # A piece's rank in its length: rows of the groups before its own, plus its place in the group.
    groups = spark.createDataFrame([(l, -(-n // GROUP_ROWS)) for l, n in histogram.items()] or [(0, 1)],
                                   "_gl long, _ng long")
    rows = pieces.join(F.broadcast(groups), F.col("length") == F.col("_gl"))
    rows = rows.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_ng")))
    before = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("length", "_g").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(F.col("length").alias("_sl"), F.col("_g").alias("_sg"),
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("length", "_g").orderBy("doc_id", "piece")
    rows = rows.withColumn("_r", F.row_number().over(inside) - 1)
    rows = rows.join(sizes, (F.col("length") == F.col("_sl")) & (F.col("_g") == F.col("_sg")))
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = plan[order]
    starts = (plan[:, 0] << 40) + plan[:, 1]
    shared = spark.sparkContext.broadcast((starts, plan[:, 1], plan[:, 3], plan[:, 4]))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        starts, first, sequence, offset = shared.value
        rank = rank.to_numpy(np.int64)
        at = np.searchsorted(starts, (length.to_numpy(np.int64) << 40) + rank, "right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank - first[at], "offset": offset[at]})

    rows = rows.withColumn("_p", place("length", (F.col("_r") + F.col("_o")).cast("long")))
    return rows.select(*pieces.columns, "_p.sequence_id", "_p.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of ``docs`` with their places in sequences of at most ``capacity`` tokens."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    return pack(materialise(token_pieces(docs, str(tokenizer_path), capacity), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


ORACLE_SQL = None
