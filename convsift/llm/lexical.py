"""Ranked lexical search by dense blocked matrix products.

Queries ("items") come in batches of bounded size.  The distinct terms of a batch
are its compact vocabulary; a pass over the documents keeps, of every whole text,
its number of terms and the counts of vocabulary terms, as a written table.  The
impacts of ``TILE_DOCS`` documents make a dense tile, the weights of up to
``TILE_ITEMS`` items another, cut along the vocabulary (commonest terms first, so
that tiles of rare terms are mostly empty and skipped); their float64 products are
whole numbers below 2^53, hence exact, and are added as 64-bit integers.  A tile
whose weights could go beyond is multiplied in parts.  Every task keeps the ``k``
best documents of an item (ties by id), and two rankings, by item and salt and then
by item, join the tasks' lists.

Defined results: null or term-less texts hold no term and are never found; every row
is a document, also with a repeated id, and a null id comes after all others among
equal scores; rows of items with one id and text are one item, other texts under an
id are items of their own; items without a known term and empty tables give no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convsift.llm.common import documents, materialise, release, ship_package, text_groups, tidy

TOP = 10
#: Characters and rows of items in a batch: the bound of what a task gets with its code.
BATCH_CHARS = 4 << 20
BATCH_ITEMS = 20_000
TILE_ITEMS, TILE_TERMS, TILE_DOCS = 256, 2048, 512
#: Impacts are at most this, and a product's partial sums stay below 2^53.
MAX_IMPACT = 1_000_000
MAX_WEIGHTS = ((1 << 53) - 1) // MAX_IMPACT
#: First-level groups of an item's candidates.
SALTS = 256

#: Bytes of terms keep their place in UTF-8: all above 0x7F, digits, letters (A-Z lower-cased).
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# ------------------------------------------------------------------ documents

def count_terms(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Per document: doc_id, n (terms with repeats), and places in ``vocabulary`` with their counts."""
    import pyarrow as pa

    spark = docs.sparkSession
    ship_package(spark)
    known = spark.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    lists = pa.list_(pa.int32())

    def count(batches):
        place = known.value
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for lo, hi, group in text_groups(texts):
                sizes, ends, flat, times = [], [0], [], []
                for text in group:
                    found = terms(text)
                    sizes.append(len(found))
                    for t, c in Counter(found).items():
                        if t in place:
                            flat.append(place[t])
                            times.append(c)
                    ends.append(len(flat))
                offsets = pa.array(ends, pa.int32())
                columns = [ids.slice(lo, hi - lo), pa.array(sizes, pa.int64())]
                columns += [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())).cast(lists) for v in (flat, times)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "term", "tf"])

    schema = "doc_id bigint, n bigint, term array<int>, tf array<int>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(count), schema)


def document_counts(counted: DataFrame) -> DataFrame:
    """(term, df): a task adds up its own documents first."""
    import pyarrow as pa

    def add(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            found = np.bincount(b.column(0).flatten().to_numpy(), minlength=len(total)).astype(np.int64)
            found[:len(total)] += total
            total = found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["term", "df"])

    partial = counted.select("term").mapInArrow(add, "term bigint, df bigint")
    return partial.groupBy("term").agg(F.sum("df").alias("df"))


# ------------------------------------------------------------------ products

class Tiles:
    """Weights of a batch's items as dense tiles over their own terms."""

    def __init__(self, items: list[dict[int, int]], df: np.ndarray):
        self.items, self.n_terms = items, len(df)
        self.groups = []
        for lo in range(0, len(items), TILE_ITEMS):
            own = np.array(sorted({t for item in items[lo:lo + TILE_ITEMS] for t in item}), np.int64)
            own = own[np.argsort(-df[own], kind="stable")]
            self.groups.append((lo, min(lo + TILE_ITEMS, len(items)), own))
        self.place = lru_cache(8)(self._place)
        self.weights = lru_cache(32)(self._weights)

    def _place(self, group: int) -> np.ndarray:
        """Column of each term of the batch within the group, or -1."""
        own = self.groups[group][2]
        out = np.full(self.n_terms, -1, np.int64)
        out[own] = np.arange(len(own))
        return out

    def _weights(self, group: int, at: int) -> list[np.ndarray]:
        """Parts whose sum is the tile of columns ``at``.., each safe to multiply."""
        lo, hi, own = self.groups[group]
        place = self.place(group)
        width = min(TILE_TERMS, len(own) - at)
        tile = np.zeros((hi - lo, width), np.int64)
        for row, item in enumerate(self.items[lo:hi]):
            if item:
                column = place[np.fromiter(item, np.int64, len(item))] - at
                value = np.fromiter(item.values(), np.int64, len(item))
                inside = (column >= 0) & (column < width)
                tile[row, column[inside]] = value[inside]
        parts = max(1, -(-int(tile.sum(axis=1).max(initial=0)) // (MAX_WEIGHTS - TILE_TERMS)))
        # floor((x + i) / parts) over i adds up to x.
        return [((tile + i) // parts).astype(np.float64) for i in range(parts)]

    def scores(self, group: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        lo, hi, own = self.groups[group]
        out = np.zeros((hi - lo, n_docs), np.int64)
        column = self.place(group)[term]
        for at in range(0, len(own), TILE_TERMS):
            inside = (column >= at) & (column < at + TILE_TERMS)
            if inside.any():
                tile = np.zeros((min(TILE_TERMS, len(own) - at), n_docs))
                tile[column[inside] - at, doc[inside]] = impact[inside]
                for part in self.weights(group, at):
                    out += (part @ tile).astype(np.int64)
        return out


class Best:
    """The k best (score, id) of each item so far; among equal scores smaller ids, nulls last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.ones(n_items, np.int64)
        self.rows = np.zeros((0, 4), np.int64)  # item, -score, id is null, id

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        least = self.least[first:first + len(scores)]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        item, doc = np.nonzero(scores >= least[:, None])
        if not len(item):
            return
        new = np.stack([item + first, -scores[item, doc], nulls[doc], ids[doc]], axis=1)
        rows = np.concatenate([self.rows, new])
        rows = rows[np.lexsort(rows.T[::-1])]
        start = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
        rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
        self.rows = rows[rank < self.k]
        full = rows[rank == self.k - 1]
        self.least[full[:, 0]] = -full[:, 1]


def best_documents(counted: DataFrame, items: list[dict[int, int]], df: np.ndarray, n_docs: int, n_terms: int,
                   k: int) -> DataFrame:
    """(item, doc_id, score): the best ``k`` of every task."""
    import pyarrow as pa

    spark = counted.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast((items, df))

    def search(batches):
        tiles = Tiles(*sent.value)
        best = Best(len(tiles.items), k)
        for b in batches:
            for lo in range(0, b.num_rows, TILE_DOCS):
                part = b.slice(lo, TILE_DOCS)
                ids, size, term, tf = part.columns
                nulls = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                ids = ids.fill_null(0).to_numpy()
                m = np.array([25 + (75 * n * n_docs) // n_terms for n in size.to_pylist()], np.int64)
                doc = np.repeat(np.arange(part.num_rows), np.diff(term.offsets.to_numpy()))
                tf = tf.flatten().to_numpy().astype(np.int64)
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
                term = term.flatten().to_numpy()
                for group, (first, _, _) in enumerate(tiles.groups):
                    best.add(first, tiles.scores(group, doc, term, impact, part.num_rows), ids, nulls)
        item, score, null, ids = best.rows.T
        doc_id = pa.array(ids, pa.int64(), mask=null.astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(item), doc_id, pa.array(-score)], names=["item", "doc_id", "score"])
        release()

    return counted.select("doc_id", "n", "term", "tf").mapInArrow(search, "item bigint, doc_id bigint, score bigint")


# ------------------------------------------------------------------ the search

def item_batches(items: DataFrame) -> Iterator[list]:
    """Rows (item_id, text) without repeats, in lists of bounded size."""
    rows = items.select("item_id", "text").where("text IS NOT NULL").distinct()
    count, chars = rows.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    n = max(1, -(-count // BATCH_ITEMS), -(-(chars or 0) // BATCH_CHARS))
    for b in range(n):
        found = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        if found:
            yield found


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Per item its ``k`` best documents: item_id, text, rank, doc_id, score."""
    spark = docs.sparkSession
    schema = "item_id bigint, text string, item bigint, doc_id bigint, score bigint"
    parts = []
    for batch in item_batches(items):
        queries = [Counter(terms(row.text.encode("utf-8", "surrogatepass"))) for row in batch]
        vocabulary = sorted(set().union(*queries))
        counted = materialise(count_terms(docs, vocabulary), f"lexical-{uuid.uuid4().hex}")
        n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_docs:
            break
        df = np.zeros(len(vocabulary), np.int64)
        for row in document_counts(counted).collect():  # at most one row a term of the batch
            df[row.term] = row.df
        place = {t: i for i, t in enumerate(vocabulary)}
        weighted = [{place[t]: c * weight(n_docs, int(df[place[t]])) for t, c in q.items() if df[place[t]]} for q in queries]
        found = best_documents(counted, weighted, df, n_docs, n_terms, k)
        found = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        for keys in (["item", "_salt"], ["item"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            found = found.where(F.col("rank") <= k)
        names = spark.createDataFrame([(row.item_id, row.text, i) for i, row in enumerate(batch)],
                                      "item_id bigint, text string, item bigint")
        parts.append(found.join(names, "item").select("item_id", "text", "item", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(1)).where("false")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return rank_documents(documents(spark, sf_dir), items).select("item_id", "rank", "doc_id", "score")


_SQL_TERMS = (r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term")

ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
words AS (SELECT r, {_SQL_TERMS} FROM d),
counts AS (SELECT r, term, count(*) AS tf FROM words GROUP BY r, term),
sizes AS (SELECT r, sum(tf)::BIGINT AS n FROM counts GROUP BY r),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2.0 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM counts, corpus GROUP BY term, docs),
items AS (SELECT item_id, dense_rank() OVER (ORDER BY item_id, text) AS i, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT i, item_id, {_SQL_TERMS} FROM items),
wanted AS (SELECT i, item_id, term, count(*) AS c FROM asked GROUP BY ALL),
scored AS (
  SELECT i, item_id, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (r), corpus GROUP BY i, item_id, r),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
  FROM scored JOIN d USING (r) WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {TOP}
"""
