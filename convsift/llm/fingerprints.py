"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A fingerprint is the ascending list of the ``K`` smallest 64-bit hashes of a
text's distinct shingles (five lower-cased words; a shorter text is one
shingle).  Sketches merge: the sketch of two parts' shingles together is the
bottom K of both sketches.  Everything here is built-in column functions.

Defined results: a null text is an empty one; a text without words has an empty
fingerprint, like (1.0) another empty one and unlike (0.0) any other; rows with
one doc_id are each edited with the next id's document, of which the one with the
smallest text counts; a null doc_id follows all others and is nobody's next
document; a single document is its own next; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convsift.llm.common import documents, materialise

K = 128
SHINGLE = 5
#: Ids that one ordering partition holds, about; no more than MAX_PARTS partitions.
PART_IDS = 100_000
MAX_PARTS = 4_000
_RANGE = float(1 << 64)
_LOWEST = float(-(1 << 63))


# ------------------------------------------------------------------ sketches

def with_sketch(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """``df`` with the sketch (array of long) of column ``text`` as column ``out``."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("_h")
    runs = F.transform(F.sequence(F.lit(0), n - SHINGLE),
                       lambda i: F.xxhash64(*(F.get("_h", i + j) for j in range(SHINGLE))))
    short = F.array(F.aggregate("_h", n.cast("long"), lambda a, x: F.xxhash64(a, x)))
    shingles = F.when(n >= SHINGLE, runs).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)).drop("_h")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One merged sketch per key group: k smallest of all parts, never more than k values a key."""
    values = df.select(*keys, F.explode(sketch).alias("_v")).distinct()
    # Salted top-k first, so one hot key is not gathered whole.
    salt = F.pmod(F.xxhash64("_v"), F.lit(64))
    first = Window.partitionBy(*keys, salt).orderBy("_v")
    some = values.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    merged = some.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("_v")), 1, k).alias(sketch))
    return merged


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; exact where both sets have at most k shingles."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.greatest(F.size(both), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    reach = (F.element_at(a, -1).cast("double") - F.lit(_LOWEST)) / F.lit(_RANGE)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((F.lit(k) - 1) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    inside = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), inside))


def to_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def from_text(s: Column) -> Column:
    """The sketch that ``to_text`` wrote."""
    at = F.sequence(F.lit(0), (F.length(s) / 16).cast("int") - 1)
    part = F.transform(at, lambda i: s.substr(i * 16 + 1, F.lit(16)))
    high = F.transform(part, lambda p: F.shiftleft(F.conv(p.substr(1, 8), 16, 10).cast("long"), 32)
                       + F.conv(p.substr(9, 8), 16, 10).cast("long"))
    return F.when(F.length(s) > 0, high).otherwise(F.array().cast("array<bigint>"))


# ------------------------------------------------------------------ neighbours

def next_ids(docs: DataFrame) -> DataFrame:
    """_id, _next and _need (most characters a row of _id takes from _next), for every id.

    Ids are dealt by range; each partition finds its own successors, and the
    first id of the next partition follows its last (one row per partition).
    """
    ids = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.floor(F.col("n_chars") / 4)).alias("_need"))
    n = ids.count()
    parts = max(1, min(MAX_PARTS, -(-n // PART_IDS)))
    ids = materialise(ids.repartitionByRange(parts, "_id").withColumn("_p", F.spark_partition_id()), "ids")
    inner = ids.withColumn("_n", F.lead("_id").over(Window.partitionBy("_p").orderBy("_id")))
    heads = ids.groupBy("_p").agg(F.min("_id").alias("_head"))
    heads = heads.select(F.col("_p").alias("_hp"), F.lead("_head").over(Window.orderBy("_p")).alias("_follow"),
                         F.min("_head").over(Window.partitionBy()).alias("_first"))
    out = inner.join(F.broadcast(heads), F.col("_p") == F.col("_hp"))
    return out.select("_id", F.coalesce("_n", "_follow", "_first").alias("_next"), "_need")


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) plus n_chars and the next document's head and sketch.

    The texts are dealt by doc_id once, for both sides: to meet the id before
    them, to whom only a head and a sketch go, and to receive the next one's.
    """
    counted = docs.agg(F.count("doc_id").alias("n"), F.countDistinct("doc_id").alias("d"),
                       F.count(F.lit(1)).alias("all"), F.min("doc_id").alias("first")).first()
    after = next_ids(docs.select("doc_id", F.length("text").alias("n_chars")))
    after = after.select(F.col("_id").alias("_before"), F.col("_next").alias("_id"), "_need").hint("merge")
    # Both sides read the same columns of the same rows, so one exchange serves both.
    dealt = docs.select("doc_id", "text").where("doc_id IS NOT NULL").join(after, F.col("doc_id") == F.col("_id"))
    right = with_sketch(dealt, "text", "_sketch").select(
        F.col("_before").alias("_to"), F.substring(F.col("text"), F.lit(1), F.col("_need").cast("int")).alias("_head"),
        "_sketch")
    if counted["n"] != counted["d"]:
        right = right.groupBy("_to").agg(F.min(F.struct("_head", "_sketch")).alias("_m")).select(
            "_to", "_m._head", "_m._sketch")
    out = dealt.select("doc_id", "text").join(right.hint("merge"), F.col("doc_id") == F.col("_to"), "left").drop("_to")
    if counted["n"] != counted["all"]:
        # One row: the first document, which follows the rows without an id.
        first = docs.where(F.col("doc_id") == F.lit(counted["first"]).cast("bigint")).agg(F.min("text").alias("_head"))
        lost = docs.select("doc_id", "text").where("doc_id IS NULL").join(F.broadcast(with_sketch(first, "_head", "_sketch")))
        out = out.unionByName(lost)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                           F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs)
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut),
                      F.substring(F.coalesce("_head", F.lit("")), F.lit(1), cut))
    docs = docs.withColumn("_edited", edited)
    docs = with_sketch(with_sketch(docs, "text", "_own"), "_edited", "_new")
    other = F.coalesce("_sketch", F.array().cast("array<bigint>"))
    return docs.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
                       to_text(F.col("_own")).alias("fingerprint"), to_text(F.col("_new")).alias("edited_fingerprint"),
                       resemblance(F.col("_own"), F.col("_new")).alias("near_edited"),
                       resemblance(F.col("_own"), other).alias("near_next"))


ORACLE_SQL = None
