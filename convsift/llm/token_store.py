"""Token ids of documents as compressed binary shards with one shared dictionary.

The ids of a bounded sample of documents train a zstandard dictionary.  Every whole
document is encoded, its ids are laid out as little-endian words of the width that
the vocabulary needs, and compressed as a frame of its own with that dictionary, so
that one short document can be read without its neighbours.

``<path>/dictionary``: the dictionary and a line feed.
``<path>/shards``: files in ascending order of ids, each of

* a header of 64 bytes: magic, shard number, bytes a token, SHA-256 of the dictionary;
* blocks of frames, each block with a line feed behind it;
* the index: for every document its id, 1 for a null id, the frame's place and size and
  the number of tokens, as five columns of 64-bit words, and a line feed;
* a trailer of 64 bytes: magic, place of the index, documents, tokens, CRC-32 of the
  index, first and last id (the greatest number for a null one).

Spark's text writer puts the line feeds there: a row is the header, a block, the index
or the trailer.  Shards are ranges of (id, checksum of the ids, row), so a repeated id
spreads over as many shards as it needs.

Defined results: a null or empty text is the end token alone; repeated rows are kept,
with one id in the order of their tokens' checksums; null ids come last; an empty table
gives an empty result; other columns are ignored, whatever their names.  With too few
documents to train on, the sampled ids themselves are the dictionary.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convsift.llm.common import Words, documents, materialise, mix64, ship_package, text_groups, tidy
from convsift.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Documents sampled for the dictionary, ids taken of one, bytes of the dictionary.
SAMPLE_ROWS, SAMPLE_IDS, DICTIONARY_BYTES = 2000, 4096, 64 << 10
LEVEL = 3
#: Bytes of frames and index in a shard, about, and of frames in a block.
SHARD_BYTES, BLOCK_BYTES = 8 << 20, 1 << 20
#: Units whose ids a worker keeps, units left when it forgets those used least, and units
#: in one text for the tokenizer.
CACHE_RUNS, CACHE_WORDS, JOINT_WORDS = 700_000, 350_000, 500

MAGIC, END_MAGIC = b"IDSHARD1", b"IDINDEX1"
_HEADER = "<8sIH32s"
_TRAILER = "<8sQQQIqq"
FIXED = 64


# ------------------------------------------------------------------ token ids

#: Units of a text with unusual white space: a run of visible characters with the space or
#: line feed before it; where several blanks, a tab etc. stand between two runs, or blanks
#: at an end, they are one unit.
_UNIT = re.compile(r"(?:\A\s+|[ \n])?\S+(?:(?:\s{2,}|[^\S \n])\S+)*(?:\s+\Z)?|\A\s+\Z")
_HEAD, _SPACE, _LINE = 0, 1, 2
#: White space that does not part runs.
_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: The first n bytes of a little-endian word; units beyond LONG bytes have a digest of the rest.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG = 64
_SIGN, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_ALNUM[[c for c in range(33, 127) if chr(c).isalnum()]] = True


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """64-bit hashes of units and what stands before them, eight bytes at a time."""
    length = end - start
    words = np.ndarray(len(data), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    out = mix64((length << 2 | kind).astype(np.uint64) + np.uint64(1))
    left, done = np.arange(len(start)), 0
    while len(left) and done < LONG:
        more = length[left] - done
        out[left] = mix64(out[left] ^ (words[start[left] + done] & _FIRST[np.minimum(more, 8)]))
        done += 8
        left = left[more > 8]
    for i in left.tolist():
        rest = hashlib.blake2b(data[start[i] + done:end[i]], digest_size=8).digest()
        out[i:i + 1] = mix64(out[i:i + 1] ^ np.frombuffer(rest, "<u8"))
    return out


def _tails(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where the signs at the end of a run begin, if what stands before them is a letter or digit
    (ASCII, or Latin letters of two bytes); else the run's end."""
    out = end.copy()
    which = np.flatnonzero(_SIGN[data[end - 1]])
    sign = _SIGN[data]
    turns = np.append(-1, np.flatnonzero(~sign[:-1] & sign[1:]))
    last = turns[np.searchsorted(turns, end[which]) - 1]
    which, last = which[last >= start[which]], last[last >= start[which]]
    lead, byte = data[last - 1], data[last]
    latin = (last > start[which]) & (lead >= 0xC3) & (lead <= 0xC9) & (byte >= 0x80) & (byte <= 0xBF)
    latin &= (lead != 0xC3) | ((byte != 0x97) & (byte != 0xB7))
    good = _ALNUM[byte] | latin
    out[which[good]] = last[good] + 1
    return out


def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """``array`` with ``values`` at ``at``, twice as long where they need more room."""
    if at + len(values) > len(array):
        array = np.concatenate([array[:at], np.zeros(max(len(array), 2 * len(values)), array.dtype)])
    array[at:at + len(values)] = values
    return array


class Encoder:
    """Ids of texts.  This byte-level tokenizer always cuts before a space, and before and
    after a line feed, that stands alone between two visible characters, and between a
    letter or digit and the signs that end the run.  So units (runs of visible characters,
    and the signs at their ends), known by 64-bit hashes, their lengths and what stands
    before them, are encoded once, unknown ones together; texts with other white space go
    through the tokenizer whole.  Of known units those used least are forgotten."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        shown = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(shown.values()) + 1, bool)
        self.spaced[[i for token, i in shown.items() if token.startswith("Ġ")]] = True
        self.line = self._ids(["\n"])[0]
        self._forget()

    def _forget(self) -> None:
        # Hash, length, place and number of ids of every known unit, how often groups of texts
        # used it again, and the ids; with room to grow.
        self.runs, self.used = 0, 0
        self.hash = np.zeros(1 << 10, np.uint64)
        self.chars, self.start, self.size = (np.zeros(1 << 10, np.int32) for _ in range(3))
        self.uses = np.zeros(1 << 10, np.uint8)
        self.flat = np.zeros(1 << 12, self.dtype)
        self._slots()

    def _slots(self) -> None:
        """Slots of the known units, at least two for each; -1 in a free one."""
        self.slot = np.full(1 << max(12, (2 * self.runs).bit_length()), -1, np.int32)
        self._enter(np.arange(self.runs, dtype=np.int32))

    def _enter(self, places: np.ndarray) -> None:
        """Put units into the first free slot from their hash on."""
        last = len(self.slot) - 1
        at = (self.hash[places] & np.uint64(last)).astype(np.int64)
        while len(places):
            free = self.slot[at] < 0
            self.slot[at[free]] = places[free]
            lost = self.slot[at] != places
            at, places = at[lost] + 1 & last, places[lost]

    def _places(self, hashes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Places of units by hash and length, -1 where a unit is not known."""
        last = len(self.slot) - 1
        at = (hashes & np.uint64(last)).astype(np.int64)
        out = self.slot[at]
        left = np.flatnonzero((out >= 0) & ((self.hash[out] != hashes) | (self.chars[out] != chars)))
        while len(left):
            at[left] = at[left] + 1 & last
            out[left] = place = self.slot[at[left]]
            left = left[(place >= 0) & ((self.hash[place] != hashes[left]) | (self.chars[place] != chars[left]))]
        return out

    def _forget_rare(self) -> None:
        """Keep the units used most, at most ``CACHE_WORDS``."""
        uses = self.uses[:self.runs]
        above = np.append(np.cumsum(np.bincount(uses, minlength=256)[::-1])[::-1][1:], 0)
        keep = uses > np.argmax(above <= CACHE_WORDS)
        size = self.size[:self.runs][keep]
        ends = np.cumsum(size, dtype=np.int64)
        if not len(size) or ends[-1] > 5 * CACHE_RUNS:
            return self._forget()
        self.flat = self.flat[np.repeat(self.start[:self.runs][keep] - (ends - size), size) + np.arange(ends[-1])]
        self.hash, self.chars = self.hash[:self.runs][keep], self.chars[:self.runs][keep]
        self.start, self.size, self.uses = (ends - size).astype(np.int32), size, uses[keep] >> 1
        self.runs, self.used = len(size), int(ends[-1])
        self._slots()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units with a blank (space or line feed) before each: all ids, the number of
        each unit's, and which units were encoded: not those with white space in them."""
        good = np.ones(len(start), bool)
        length = end - start
        ends = np.cumsum(length)
        # The units' bytes, each unit behind a blank.
        joined = np.full(int(ends[-1]) + len(start), blank, np.uint8)
        solid = np.ones(len(joined), bool)
        at = ends - length + np.arange(len(start))
        solid[at] = False
        joined[solid] = data[np.repeat(start - (ends - length), length) + np.arange(ends[-1])]
        joined = joined.tobytes()
        at = np.append(at, len(joined)).tolist()
        groups = [(lo, min(lo + JOINT_WORDS, len(start))) for lo in range(0, len(start), JOINT_WORDS)]
        texts = [joined[at[lo]:at[hi]].decode("utf-8", "replace") for lo, hi in groups]
        for (lo, hi), text in zip(groups, texts):
            if _BLANK.search(text):
                good[lo:hi] = [not _BLANK.search(joined[a + 1:b].decode("utf-8", "replace")) for a, b in zip(at[lo:hi], at[lo + 1:hi + 1])]
        if not good.all():
            if not good.any():
                return np.zeros(0, self.dtype), np.zeros(0, np.int64), good
            ids, size, _ = self._together(data, start[good], end[good], blank)
            return ids, size, good
        all_ids, sizes = self._ids(texts), []
        for i, (lo, hi) in enumerate(groups):
            first = np.flatnonzero(self.spaced[all_ids[i]] if blank == 32 else all_ids[i] == self.line[0])
            if len(first) != hi - lo or first[0]:
                each = self._ids([joined[a:b].decode("utf-8", "replace") for a, b in zip(at[lo:hi], at[lo + 1:hi + 1])])
                first, all_ids[i] = np.cumsum([0, *map(len, each[:-1])]), np.concatenate(each)
            sizes.append(np.diff(first, append=len(all_ids[i])))
        return np.concatenate(all_ids), np.concatenate(sizes), good

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, kinds: np.ndarray, hashes: np.ndarray) -> None:
        """Take in new units; those with white space in them stay unknown."""
        before = self.runs
        for blank in (32, 10):
            which = np.flatnonzero((kinds == _SPACE) == (blank == 32))
            if not len(which):
                continue
            ids, size, good = self._together(data, start[which], end[which], blank)
            which = which[good]
            head = kinds[which] == _HEAD
            if head.any():  # the line feed before these is not theirs
                ids = np.delete(ids, (np.cumsum(size) - size)[head])
                size = size - head
            self.hash = _put(self.hash, self.runs, hashes[which])
            self.chars = _put(self.chars, self.runs, (end - start)[which])
            self.start = _put(self.start, self.runs, self.used + np.cumsum(size) - size)
            self.size = _put(self.size, self.runs, size)
            self.uses = _put(self.uses, self.runs, np.zeros(len(which), np.uint8))
            self.flat = _put(self.flat, self.used, ids)
            self.runs += len(which)
            self.used += len(ids)
        if 2 * self.runs > len(self.slot):
            self._slots()
        else:
            self._enter(np.arange(before, self.runs, dtype=np.int32))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text, as bytes."""
        if self.runs > CACHE_RUNS or self.used > 10 * CACHE_RUNS:
            self._forget_rare()
        w = Words(texts, lower=False)
        # What stands before every run, and texts where that is neither nothing nor one blank.
        odd = np.zeros(len(texts), bool)
        blank = np.diff(w.doc_start) > 1
        filled = np.flatnonzero(np.diff(w.first))
        odd[blank] = True
        odd[filled] = False
        head = w.first[filled]
        gap = w.start - np.append(0, w.end[:-1])
        before = w.bytes[w.start - 1] if len(w.start) else np.zeros(0, np.uint8)
        kind = np.where(before == 10, _LINE, _SPACE)
        bad = (gap != 1) | ((before != 32) & (before != 10))
        kind[head], bad[head] = _HEAD, w.start[head] != w.doc_start[filled]
        odd[w.owner[bad]] = True
        odd[filled] |= w.end[w.first[filled + 1] - 1] != w.doc_start[filled + 1] - 1
        odd |= len(self.line) > 1

        # Signs at the end of a run become units of their own, with nothing before them.
        tail = _tails(w.bytes, w.start, w.end)
        cut = tail < w.end
        before_it = np.append(0, np.cumsum(cut))
        at = np.arange(len(cut)) + before_it[:-1]
        start, end, kinds = (np.empty(len(cut) + before_it[-1], np.int64) for _ in range(3))
        start[at], end[at], kinds[at] = w.start, tail, kind
        at = at[cut] + 1
        start[at], end[at], kinds[at] = tail[cut], w.end[cut], _HEAD
        first = w.first + before_it[w.first]
        owner = np.repeat(np.arange(len(texts)), np.diff(first))

        hashes, chars = _hashes(w.bytes, start, end, kinds), end - start
        which = self._places(hashes, chars)
        seen = which[which >= 0]
        uses = self.uses[seen]
        self.uses[seen] = uses + (uses < 255)
        new = np.flatnonzero((which < 0) & ~odd[owner])
        if len(new):
            one = new[np.unique(hashes[new], return_index=True)[1]]
            self._learn(w.bytes, start[one], end[one], kinds[one], hashes[one])
            which[new] = self._places(hashes[new], chars[new])
        odd[owner[which < 0]] = True
        size = np.where(which < 0, 0, self.size[which])
        ends = np.cumsum(size, dtype=np.int64)
        ids = self.flat[np.repeat(self.start[which] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.append(0, ends)[first].tolist()
        return [self._unusual(t) if o else ids[a:b].tobytes() for t, o, a, b in zip(texts, odd.tolist(), cuts, cuts[1:])]

    def _unusual(self, text: bytes) -> bytes:
        return b"".join([x.tobytes() for x in self._ids(_UNIT.findall(text.decode("utf-8", "replace")))])


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(file: str) -> Encoder:
    """The worker's encoder; what it knows serves the worker's later tasks."""
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


def encode_rows(docs: DataFrame, file: str, end_id: int, finish, schema: str) -> DataFrame:
    """``finish(encoder)`` gives a function of (column of keys, list of id bytes) -> arrays of ``schema``."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship_package(docs.sparkSession)
    names = to_arrow_schema(StructType.fromDDL(schema)).names

    def run(batches):
        encoder = encoder_of(file)
        last = np.array([end_id], encoder.dtype).tobytes()
        make = finish(encoder)
        for b in batches:
            for lo, hi, group in text_groups(b.column(1)):
                ids = [x + last for x in encoder.encode(group)]
                yield pa.RecordBatch.from_arrays(make(b.column(0).slice(lo, hi - lo), ids), names=names)

    return docs.mapInArrow(tidy(run), schema)


# ------------------------------------------------------------------ dictionary

def train_dictionary(docs: DataFrame, file: str, end_id: int) -> bytes:
    """A dictionary from ids of about ``SAMPLE_ROWS`` documents with the least hashes:
    of a longer one, ``SAMPLE_IDS`` ids from a place that the hash chooses."""
    import pyarrow as pa
    import zstandard

    top = 1 << 40
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(top))
    drawn = docs.select(h.alias("h"), "text").where(F.col("h") < F.lit(int(share * top)))

    def finish(encoder):
        def pieces(keys, ids):
            out, most = [], SAMPLE_IDS * encoder.dtype.itemsize
            for key, data in zip(keys.to_pylist(), ids):
                at = key % max(1, -(-len(data) // most)) * most
                out.append(data[at:at + most])
            return [keys, pa.array(out, pa.binary())]
        return pieces

    sample = encode_rows(drawn, file, end_id, finish, "h bigint, piece binary")
    # Copies of a row are one sample, joined as partial aggregates.
    rows = sample.groupBy("h").agg(F.min("piece").alias("piece")).orderBy("h").limit(2 * SAMPLE_ROWS).collect()
    pieces = [bytes(r.piece) for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[:DICTIONARY_BYTES]


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


# ------------------------------------------------------------------ writing

def write_tokens(docs: DataFrame, path: str, file: str, end_id: int = END_ID) -> None:
    """Write the ids of (doc_id, text) rows as a dictionary and shards below ``path``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(docs, file, end_id)
    spark.createDataFrame([(bytearray(dictionary),)], "value binary").coalesce(1).select(
        F.col("value").cast("string")).write.text(f"{path}/dictionary")
    frames = materialise(compress(docs, file, end_id, dictionary).withColumn("_row", F.monotonically_increasing_id()),
                         f"frames-{uuid.uuid4().hex}")
    size = frames.agg(F.sum(F.length("frame") + 40)).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("_row")]
    ordered = frames.repartitionByRange(max(1, -(-size // SHARD_BYTES)), *order).sortWithinPartitions(*order)
    write_shards(ordered, f"{path}/shards", dictionary, _width(file))


def _width(file: str) -> int:
    return encoder_of(file).dtype.itemsize


def compress(docs: DataFrame, file: str, end_id: int, dictionary: bytes) -> DataFrame:
    """doc_id, n_tokens, tie (checksum of the ids) and the frame of each document."""
    import pyarrow as pa
    import zstandard

    def finish(encoder):
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_dict_id=False)

        def frames(keys, ids):
            sizes = pa.array([len(x) // encoder.dtype.itemsize for x in ids], pa.int64())
            ties = pa.array([zlib.crc32(x) for x in ids], pa.int64())
            return [keys, sizes, ties, pa.array([squeeze.compress(x) for x in ids], pa.binary())]
        return frames

    return encode_rows(docs, file, end_id, finish, "doc_id bigint, n_tokens bigint, tie bigint, frame binary")


def write_shards(ordered: DataFrame, path: str, dictionary: bytes, width: int) -> None:
    """One shard a partition, rows in their order."""
    import pyarrow as pa

    check = hashlib.sha256(dictionary).digest()
    ship_package(ordered.sparkSession)

    def row(data: bytes):
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["value"])

    def serialise(batches):
        shard = TaskContext.get().partitionId()
        yield row(struct.pack(_HEADER, MAGIC, shard, width, check).ljust(FIXED - 1, b"\0"))
        at, block, held, index = FIXED, [], 0, []
        for b in batches:
            ids = b.column("doc_id")
            index.append(np.zeros((5, b.num_rows), "<i8"))
            index[-1][0] = ids.fill_null(0).to_numpy()
            index[-1][1] = ids.is_null().to_numpy(zero_copy_only=False)
            index[-1][4] = b.column("n_tokens").to_numpy()
            for i, frame in enumerate(b.column("frame")):
                frame = frame.as_buffer().to_pybytes()
                if held and held + len(frame) > BLOCK_BYTES:
                    yield row(b"".join(block))
                    at, block, held = at + held + 1, [], 0
                index[-1][2:4, i] = at + held, len(frame)
                block.append(frame)
                held += len(frame)
        if block:
            yield row(b"".join(block))
            at += held + 1
        whole = np.concatenate(index, axis=1) if index else np.zeros((5, 0), "<i8")
        data = whole.tobytes()
        ends = np.where(whole[1], np.iinfo(np.int64).max, whole[0])
        first, last = (ends[0], ends[-1]) if len(ends) else (0, 0)
        yield row(data)
        yield row(struct.pack(_TRAILER, END_MAGIC, at, whole.shape[1], int(whole[4].sum()), zlib.crc32(data), first, last).ljust(FIXED - 1, b"\0"))

    text = ordered.select("doc_id", "n_tokens", "frame").mapInArrow(tidy(serialise), "value binary")
    text.select(F.col("value").cast("string")).write.text(path)


# ------------------------------------------------------------------ reading

def read_header(data: bytes, dictionary: bytes) -> tuple[int, np.dtype]:
    """Shard number and type of its ids; the dictionary must be the one it was written with."""
    magic, shard, width, check = struct.unpack_from(_HEADER, data)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    if check != hashlib.sha256(dictionary).digest():
        raise ValueError("the shard was written with another dictionary")
    return shard, np.dtype(f"<u{width}")


def read_trailer(data: bytes) -> tuple[int, int, int, int]:
    """Place of the index, documents, tokens, and CRC-32 of the index."""
    magic, at, n, tokens, crc, _, _ = struct.unpack_from(_TRAILER, data)
    if magic != END_MAGIC:
        raise ValueError("the shard ends without a trailer")
    return at, n, tokens, crc


def read_index(data: bytes, n: int, crc: int) -> np.ndarray:
    """Rows doc_id, null, place, size, tokens; a column for each document."""
    if len(data) != n * 40 or zlib.crc32(data) != crc:
        raise ValueError("the shard's index is damaged")
    return np.frombuffer(data, "<i8").reshape(5, n)


def shard_documents(data: bytes, dictionary: bytes) -> Iterator[tuple[int, int | None, int, np.ndarray]]:
    """(shard, doc_id, tokens before it in the shard, its ids) of every document."""
    import zstandard

    shard, dtype = read_header(data, dictionary)
    at, n, _, crc = read_trailer(data[-FIXED:])
    expand = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
    start, view = 0, memoryview(data)
    for doc_id, null, place, size, tokens in read_index(data[at:at + n * 40], n, crc).T.tolist():
        ids = np.frombuffer(expand.decompress(view[place:place + size]), dtype)
        if len(ids) != tokens:
            raise ValueError(f"document {doc_id} has {len(ids)} ids, not {tokens}")
        yield shard, None if null else doc_id, start, ids
        start += tokens


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    rows = spark.read.format("binaryFile").load(f"{path}/dictionary").select("content").collect()
    return bytes(rows[0].content)[:-1] if rows else b""


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, shard, start (ids before it in its shard), n_tokens, ids_crc32
    (checksum of the ids as 32-bit words) and ids (unless only the others are wanted)."""
    import pyarrow as pa

    ship_package(spark)
    dictionary = read_dictionary(spark, path)
    schema = "doc_id bigint, shard bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def batch(rows):
        shard, doc_id, start, ids = zip(*rows)
        wide = [x.astype("<u4") for x in ids]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        columns = [pa.array(doc_id, pa.int64()), pa.array(shard, pa.int64()), pa.array(start, pa.int64()),
                   pa.array(np.diff(ends), pa.int64()), pa.array([zlib.crc32(x) for x in wide], pa.int64())]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(wide).astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def parse(batches):
        for b in batches:
            for content in b.column("content"):
                rows, held = [], 0
                for row in shard_documents(content.as_buffer().to_pybytes(), dictionary):
                    rows.append(row)
                    held += len(row[3]) + 16
                    if held > 1 << 19:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").load(f"{path}/shards").select("content")
    return files.mapInArrow(tidy(parse), schema)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, before): ids in all shards before it, added up in groups of 1,000 shards."""
    import pyarrow as pa

    def parse(batches):
        for b in batches:
            shards = [struct.unpack_from(_HEADER, x.as_buffer())[1] for x in b.column("head")]
            totals = [read_trailer(x.as_buffer())[2] for x in b.column("tail")]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(totals, pa.int64())], names=["shard", "n"])

    files = spark.read.format("binaryFile").load(f"{path}/shards")
    ends = files.select(F.substring("content", 1, FIXED).alias("head"), F.substring("content", -FIXED, FIXED).alias("tail"))
    totals = ends.mapInArrow(parse, "shard bigint, n bigint").withColumn("part", F.floor(F.col("shard") / 1000))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier.orderBy("part")), F.lit(0)).alias("first"))
    within = F.coalesce(F.sum("n").over(earlier.partitionBy("part").orderBy("shard")), F.lit(0))
    return totals.select("part", "shard", within.alias("within")).join(parts, "part").select(
        "shard", (F.col("first") + F.col("within")).cast("long").alias("before"))


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """The ids of one document (the first of that id), or None: trailers of about log2(shards)
    files, one index and one frame are read."""
    import zstandard

    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/shards")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")),
                   key=lambda f: f.getPath().getName())

    def read(file, at: int, n: int) -> bytes:
        stream = fs.open(file.getPath())
        try:
            stream.seek(at)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
        finally:
            stream.close()

    def ends(file):
        """Trailer and the first and last id; null ids come after all others."""
        tail = read(file, file.getLen() - FIXED, FIXED)
        return read_trailer(tail), struct.unpack_from(_TRAILER, tail)[5:7]

    lo, hi = 0, len(files)
    while lo < hi:  # the first shard whose last id is not smaller
        mid = (lo + hi) // 2
        (_, n, _, _), (_, last) = ends(files[mid])
        if n and last < doc_id:
            lo = mid + 1
        else:
            hi = mid
    if lo == len(files):
        return None
    file = files[lo]
    dictionary = read_dictionary(spark, path)
    _, dtype = read_header(read(file, 0, FIXED), dictionary)
    (at, n, _, crc), _ = ends(file)
    index = read_index(read(file, at, n * 40), n, crc)
    place = int(np.searchsorted(np.where(index[1], np.iinfo(np.int64).max, index[0]), doc_id))
    if place == n or index[0, place] != doc_id or index[1, place]:
        return None
    frame = read(file, int(index[2, place]), int(index[3, place]))
    expand = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
    return np.frombuffer(expand.decompress(frame), dtype).tolist()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, f"tokens-{uuid.uuid4().hex}")
    write_tokens(documents(spark, sf_dir), path, str(public_tokenizers.path(TOKENIZER)))
    back = materialise(read_tokens(spark, path, with_ids=False), f"tokens-back-{uuid.uuid4().hex}")
    starts = shard_starts(spark, path).withColumnRenamed("shard", "_shard")
    out = back.join(starts, F.col("shard") == F.col("_shard"))
    return out.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


#: The tokenizer has no SQL form.
ORACLE_SQL = None
