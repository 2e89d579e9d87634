"""Near-duplicate documents: circulant MinHash, banding, exact verification.

Two fixed permutations of the 64-bit words, one of them shifted in a circle, give
all signature coordinates.  Documents with equal shingle sets form a class; classes
that share a band are candidates.  Candidates are verified on their full sets:

* candidate groups of bounded size are verified whole, one group a task;
* in larger groups a pair can only reach the threshold if its shingles that are
  rarest in the group meet (prefix filter), so members are dealt by these; members
  that meet in a very common one are verified block against block.

Only a spanning forest of links leaves a task, never a group's pairs.  Shingles are
compared as 64-bit hashes.

Defined results: null, empty and wordless texts have no shingles and no links;
rows with one doc_id are one document, linked by any of its texts; a null doc_id
counts as larger than all others and its component_id is null unless it reaches
another; equal rows give equal rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convsift.llm.common import (Words, documents, materialise, mix64, ship_package, skew_lookup,
                                 text_groups, tidy, windows)

SHINGLE = 5
#: A pair links when 100 * intersection >= percent * union; this is the query's percent.
PERCENT = 85
#: Coordinates of a signature, and the probability that a pair at the threshold misses all bands.
COORDINATES = 240
MISS = 1e-8
#: Candidate groups up to this size are verified whole.
GROUP_MEMBERS = 1_000
GROUP_SHINGLES = 2_000_000
#: Members of a block, where blocks are verified against each other.
BLOCK = 500
#: Rows without an id get one above this, from their text.
NO_ID = (1 << 63) - 1 - (1 << 40)
_PI_A = np.uint64(0xA0761D6478BD642F)
_PI_B = np.uint64(0xE7037ED1A0B428DB)
_STEP = 1 << 15


# ------------------------------------------------------------------ signatures

def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text after text in ascending order,
    and where each text's begin (one more entry than texts)."""
    w = Words(texts, lower=True)
    h = w.hashes()
    count = np.diff(w.first)
    runs = windows(h, SHINGLE)
    inside = np.flatnonzero(w.owner[:len(runs)] == w.owner[len(h) - len(runs):])
    keys, owner = runs[inside], w.owner[inside]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        keys = np.concatenate([keys, [_whole(h[w.first[i]:w.first[i + 1]]) for i in short]])
        owner = np.concatenate([owner, short])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    if len(keys):
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])])
        keys, owner = keys[new], owner[new]
    return keys.astype(np.uint64), np.searchsorted(owner, np.arange(len(texts) + 1))


def _whole(words: np.ndarray) -> np.uint64:
    """Hash of a sequence of fewer than SHINGLE words."""
    acc = np.array([len(words)], np.uint64)
    for x in words:
        acc = mix64(acc * np.uint64(0x9FB21C651E98DF25) + x)
    return acc[0]


def signatures(keys: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least of pi(sigma(x) + k).

    sigma and pi are two fixed permutations of the 64-bit words; adding k shifts
    pi in a circle, so two permutations give all ``size`` coordinates.  Texts
    without shingles get all ones.
    """
    out = np.full((len(first) - 1, size), np.uint64(0xFFFFFFFFFFFFFFFF))
    some = np.flatnonzero(np.diff(first))
    lo = 0
    while lo < len(some):
        # Texts whose shingles stay in the processor's cache together.
        hi = max(lo + 1, int(np.searchsorted(first[some + 1], first[some[lo]] + _STEP, "right")))
        a, b = first[some[lo]], first[some[hi - 1] + 1]
        sigma = mix64(keys[a:b])
        starts = first[some[lo:hi]] - a
        x, y = np.empty_like(sigma), np.empty_like(sigma)
        rows = some[lo:hi]
        for k in range(size):
            np.add(sigma, np.uint64(k), out=x)
            x *= _PI_A
            np.right_shift(x, np.uint64(32), out=y)
            x ^= y
            x *= _PI_B
            out[rows, k] = np.minimum.reduceat(x, starts)
        lo = hi
    return out

def band_rows(percent: int) -> int:
    """Most coordinates a band may have: 6 (40 bands) for 85 percent, 5 (48 bands) for 80."""
    fits = [r for r in range(1, COORDINATES) if (1 - (percent / 100) ** r) ** (COORDINATES // r) < MISS]
    return max(fits, default=1)


def _bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band, different for equal values in different bands."""
    out = np.empty((len(sig), sig.shape[1] // rows), np.uint64)
    for j in range(out.shape[1]):
        acc = np.full(len(sig), np.uint64(j + 1))
        for r in range(rows):
            acc = mix64(acc * np.uint64(0x9FB21C651E98DF25) + sig[:, j * rows + r])
        out[:, j] = acc
    return out


def _sketch(docs: DataFrame, percent: int) -> DataFrame:
    """_id, n (set size), key (of the set) and bands of every row."""
    import pyarrow as pa

    width = band_rows(percent)
    count = COORDINATES // width

    def sketch(batches):
        for b in batches:
            ids = b.column("_id")
            for lo, hi, texts in text_groups(b.column("text")):
                keys, first = shingle_sets(texts)
                n = np.diff(first)
                # The set's key: two sums over its members, which do not depend on their order.
                sums = np.zeros((hi - lo, 2), np.uint64)
                some = np.flatnonzero(n)
                if len(some):
                    for c, salt in enumerate((0x2545F4914F6CDD1D, 0x589965CC75374CC3)):
                        sums[some, c] = np.add.reduceat(mix64(keys ^ np.uint64(salt)), first[some])
                bands = _bands(signatures(keys, first, width * count), width).view(np.int64)
                arrays = pa.ListArray.from_arrays(np.arange(0, (hi - lo + 1) * count, count, dtype=np.int32), bands.ravel())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n.astype(np.int64)),
                     pa.array([f"{a:016x}{c:016x}" for a, c in sums.tolist()]), arrays],
                    names=["_id", "n", "key", "bands"])

    return docs.mapInArrow(tidy(sketch), "_id bigint, n bigint, key string, bands array<bigint>")


# ------------------------------------------------------------------ components

def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of the nodes of ``edges`` (a, b).

    Large-star and small-star steps in turn; every step is written, so no lineage
    grows, and nodes with very many neighbours are looked up by broadcast.
    """
    def stars(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = e.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("c"))
        least = least.withColumn("m", F.least("a", "m"))
        met = skew_lookup(e, least, "a", ["m"], "c")
        if large:
            out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select("a", F.col("m").alias("b")))
        return materialise(out.where("a <> b").distinct(), "stars")

    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, before = materialise(edges, "edges"), None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        edges = stars(stars(edges, True), False)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


# ------------------------------------------------------------------ verification

def forest(reps: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges (member, smallest member) of the linked groups among ``sets``."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    if m < 2:
        return []
    owner = np.repeat(np.arange(m), n)
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[token] > 1
    owner, token = owner[shared], (np.cumsum(df > 1) - 1)[token[shared]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    inter = np.zeros((m, m), np.int64)
    width = 4096
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, [lo, lo + width])
        part = np.zeros((m, width), np.float32)
        part[owner[a:b], token[a:b] - lo] = 1
        inter += (part @ part.T).astype(np.int64)
    union = n[:, None] + n[None, :] - inter
    linked = (100 * inter >= percent * union) & (n[:, None] > 0) & (n[None, :] > 0)
    linked |= reps[:, None] == reps[None, :]
    left, out = np.ones(m, bool), []
    for i in np.argsort(reps, kind="stable"):
        if left[i]:
            group = np.zeros(m, bool)
            edge = group.copy()
            edge[i] = True
            while edge.any():
                group |= edge
                edge = linked[edge].any(axis=0) & ~group
            left &= ~group
            out += [(int(r), int(reps[i])) for r in reps[group] if r != reps[i]]
    return out


def _verify(units: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside every unit of columns unit, rep, keys."""
    def links(group: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(k, np.int64) for k in group["keys"]]
        return pd.DataFrame(forest(group["rep"].to_numpy(np.int64), sets, percent), columns=["a", "b"], dtype="int64")

    return units.select("unit", "rep", "keys").groupBy("unit").applyInPandas(links, "a bigint, b bigint")


def _large_units(sets: DataFrame, percent: int) -> DataFrame:
    """unit, rep: units that together hold every pair of one group that can link.

    Of two linked sets, the first shared shingle in any fixed order of the group's
    shingles lies among the first n - ceil(percent n / 100) + 1 of both; the order here is
    rarest first, so these rarely are common ones.
    """
    tokens = sets.select("comp", "rep", "n", "cap", F.explode("keys").alias("token"))
    tokens = tokens.withColumn("ct", F.xxhash64("comp", "token"))
    common = materialise(tokens.groupBy("ct").agg(F.count(F.lit(1)).alias("df")), "token-counts")
    ranked = skew_lookup(tokens, common.withColumn("w", F.col("df")), "ct", ["df"], "w")
    ranked = ranked.groupBy("rep", "comp", "n", "cap").agg(F.array_sort(F.collect_list(F.struct("df", "ct"))).alias("o"))
    reach = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    prefix = ranked.select("rep", "comp", "cap", F.explode(F.slice("o", F.lit(1), reach)).alias("o")).where("o.df > 1")
    prefix = materialise(prefix.select("rep", "comp", "cap", "o.ct"), "prefixes")
    sizes = prefix.groupBy("ct").agg(F.count(F.lit(1)).alias("met"), F.sum(F.xxhash64("rep") % (1 << 40)).alias("who"))
    met = skew_lookup(prefix, sizes.withColumn("w", F.col("met")), "ct", ["met", "who"], "w").where("met > 1")
    # Shingles with the same holders make the same unit; one of them is enough.
    small = met.where("met <= cap").select(F.xxhash64("comp", "met", "who").alias("unit"), "rep").distinct()
    crowd = materialise(met.where("met > cap").select("comp", "rep", "cap").distinct(), "crowds")
    blocks = crowd.groupBy("comp").agg(F.count(F.lit(1)).alias("c"), F.max("cap").alias("x"))
    blocks = blocks.withColumn("nb", F.ceil(F.col("c") / F.col("x")).cast("int"))
    crowd = skew_lookup(crowd, blocks, "comp", ["nb"], "c")
    crowd = crowd.withColumn("i", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    crowd = crowd.select("comp", "rep", "i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"))
    pairs = crowd.select(F.xxhash64("comp", F.least("i", "j"), F.greatest("i", "j"), F.lit("block")).alias("unit"), "rep")
    return small.unionByName(pairs.distinct())


# ------------------------------------------------------------------ the operator

def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``; texts whose
    resemblance is at least ``percent`` link."""
    import pyarrow as pa

    ship_package(docs.sparkSession)
    own = F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), own).alias("_id"), "text")
    rows = materialise(_sketch(docs, percent), "sketches")
    classes = materialise(rows.where("n > 0").groupBy("key").agg(
        F.min("_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
        F.first("bands").alias("bands")), "classes")

    # Candidate groups: a star in every band bucket, joined.
    dealt = classes.select("rep", F.explode("bands").alias("band"))
    buckets = materialise(dealt.groupBy("band").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last"),
                                                    F.count(F.lit(1)).alias("c")).where("pivot < last"), "buckets")
    stars = skew_lookup(dealt, buckets, "band", ["pivot"], "c").where("pivot < rep")
    groups = components(stars.select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
    sizes = classes.groupBy("rep").agg(F.max("n").alias("size"))
    groups = groups.join(sizes, F.col("node") == F.col("rep")).select("rep", F.col("component").alias("comp"), "size")
    groups = materialise(groups, "groups")
    totals = groups.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("s"), F.max("size").alias("x"))
    groups = materialise(skew_lookup(groups, totals.withColumn("w", F.col("m")), "comp", ["m", "s", "x"], "w"), "sized")

    # Full sets of the candidates, from a second look at their texts.
    def full(batches):
        for b in batches:
            for lo, hi, texts in text_groups(b.column("text")):
                keys, first = shingle_sets(texts)
                lists = pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(lo, hi - lo) for c in ("rep", "comp", "m", "s", "x")),
                     pa.array(np.diff(first).astype(np.int64)), lists.cast(pa.list_(pa.int64()))],
                    names=["rep", "comp", "m", "s", "x", "n", "keys"])

    sets = docs.join(groups.hint("merge"), F.col("_id") == F.col("rep")).select("rep", "comp", "m", "s", "x", "text")
    sets = sets.mapInArrow(tidy(full), "rep bigint, comp bigint, m bigint, s bigint, x bigint, n bigint, keys array<bigint>")
    sets = materialise(sets.where("n > 0"), "sets")
    whole = (F.col("m") <= GROUP_MEMBERS) & (F.col("s") <= GROUP_SHINGLES)
    links = _verify(sets.where(whole).withColumn("unit", F.col("comp")), percent)
    large = sets.where(~whole)
    if large.head(1):
        cap = F.greatest(F.lit(2), F.least(F.lit(BLOCK), F.floor(F.lit(GROUP_SHINGLES) / F.col("x")))).cast("int")
        units = materialise(_large_units(large.withColumn("cap", cap), percent), "units").withColumnRenamed("rep", "_r")
        links = links.unionByName(_verify(units.join(large, F.col("_r") == F.col("rep")), percent))

    # A document with several texts belongs to the classes of all of them.
    member = skew_lookup(rows.where("n > 0"), classes, "key", ["rep"], "copies").select("_id", "rep")
    several = member.groupBy("_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    several = several.join(member.withColumnRenamed("_id", "_d"), F.col("_id") == F.col("_d"))
    links = links.unionByName(several.where("_id <> rep").select(F.col("_id").alias("a"), F.col("rep").alias("b")))
    labels = components(links).withColumnsRenamed({"node": "_n", "component": "_c"})
    classes = classes.select("key", "rep", "copies").join(labels, F.col("rep") == F.col("_n"), "left")
    classes = materialise(classes.select("key", F.coalesce("_c", "rep").alias("least"), "copies"), "labelled")
    out = skew_lookup(rows.select("_id", "n", "key"), classes, "key", ["least"], "copies")
    least = F.coalesce("least", "_id")

    def given(c):
        return F.when(c < NO_ID, c)

    return out.select(given(F.col("_id")).alias("doc_id"), F.col("n").alias("n_shingles"),
                      given(least).alias("component_id"), (F.col("_id") == least).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
c AS (SELECT min(doc_id) AS rep, list_sort(g) AS g, list(doc_id) AS ids FROM s WHERE len(g) > 0 GROUP BY list_sort(g)),
t AS (SELECT rep, unnest(g) AS x, len(g) AS n FROM c),
p AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM t a JOIN t b ON a.x = b.x AND a.rep < b.rep GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(x, y) AS (SELECT a, a FROM u UNION SELECT reach.x, u.b FROM reach JOIN u ON reach.y = u.a),
m AS (SELECT x, min(y) AS least FROM reach GROUP BY x),
f AS (SELECT unnest(ids) AS doc_id, coalesce(least, rep) AS component_id FROM c LEFT JOIN m ON rep = x)
SELECT n.doc_id, n AS n_shingles, coalesce(component_id, n.doc_id) AS component_id,
       n.doc_id = coalesce(component_id, n.doc_id) AS kept
FROM n LEFT JOIN f ON n.doc_id = f.doc_id
"""
