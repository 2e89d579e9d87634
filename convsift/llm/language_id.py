"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed character n-grams (1 to 3 letters, word borders
included), weighted log(1 + tf) * idf and normalised.  The labelled sample of
every language, at most ``SAMPLE`` documents and ``SAMPLE_ALL`` together, is
clustered on the unit sphere into ``CLUSTERS`` centroids.  A text gets the
language of the centroid with the largest cosine, and is rejected when that
cosine lies far below what training texts of its length reach.

Defined results: a null text and one without a letter are ``und`` with score 0,
and rejected; ties go to the language that sorts first; rows with a null doc_id
or lang are never learned from, and the former count as held out; repeated rows
are predicted each; without any learned language everything is ``und``; other
columns pass through, unless a name is one of the results'.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convsift.llm.common import documents, mix64, release, ship_package, tidy

DIMENSIONS = 8192
SAMPLE = 600
SAMPLE_ALL = 2400
#: More languages than this are refused: every language has centroids in the model.
MAX_LANGUAGES = 500
CLUSTERS = 4
#: A text is rejected below this share of the low quantile of its length class.
REJECT_SHARE = 0.5
REJECT_QUANTILE = 0.01
_GROUP_CHARS = 400_000


# ------------------------------------------------------------------ vectors

def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; each run of other characters is one 0."""
    flat = "".join(c if c.isalpha() else " " for c in set(text.lower()))
    known = set(flat) - {" "}
    lowered = text.lower()
    table = {ord(c): " " for c in set(lowered) - known}
    runs = lowered.translate(table).split()
    if not runs:
        return np.zeros(0, np.uint32)
    return np.frombuffer((" " + " ".join(runs) + " ").encode("utf-32-le"), np.uint32)


def _buckets(c: np.ndarray) -> np.ndarray:
    """Hash bucket of every 1-, 2- and 3-gram that has a letter."""
    x = c.astype(np.uint64)
    two = x[:-1] | (x[1:] << np.uint64(21))
    three = two[:-1] | (x[2:] << np.uint64(42))
    grams = np.concatenate([x[x != 32], two, three])
    return (mix64(grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)).astype(np.int64)


def count_vectors(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Dense n-gram counts (texts x DIMENSIONS) and the number of letters' n-grams per text."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    size = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            c = _letters(t)
            if len(c):
                b = _buckets(c)
                out[i] = np.bincount(b, minlength=DIMENSIONS)
                size[i] = len(b)
    return out, size


def _normalised(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _groups(texts: list):
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and (size > _GROUP_CHARS or i - lo >= 256):
            yield lo, i
            lo, size = i, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


# ------------------------------------------------------------------ the model

class Model:
    """Centroids, their languages, idf, and the rejection bound per length class."""

    def __init__(self, languages, owner, centroids, idf, bounds):
        self.languages, self.owner, self.centroids = languages, owner, centroids
        self.idf, self.bounds = idf, bounds

    def predict(self, texts: list):
        """language, score (0 to 1), rejected and best cosine of every text."""
        n = len(texts)
        lang = np.full(n, "und", object)
        score, cosine = np.zeros(n), np.zeros(n)
        rejected = np.ones(n, bool)
        for lo, hi in _groups(texts) if self.languages else ():
            counts, size = count_vectors(texts[lo:hi])
            near = _normalised(counts, self.idf) @ self.centroids.T
            best = np.stack([near[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)
            top = best.argmax(axis=1)
            cosine[lo:hi] = best.max(axis=1)
            share = np.exp(20.0 * (best - best.max(axis=1, keepdims=True)))
            has = size > 0
            score[lo:hi] = np.where(has, 1.0 / share.sum(axis=1), 0.0)
            lang[lo:hi] = np.where(has, np.array(self.languages, object)[top], "und")
            rejected[lo:hi] = ~has | (cosine[lo:hi] < self.bounds[_length_class(size)])
        return lang, score, rejected, cosine


def _length_class(size: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(size, 1)).astype(np.int64), 31)


def _cluster(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the vectors farthest from those chosen."""
    mean = x.mean(axis=0)
    chosen = [int((x @ mean).argmax())]
    far = x @ x[chosen[0]]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(int(far.argmin()))
        far = np.maximum(far, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(steps):
        at = (x @ centres.T).argmax(axis=1)
        centres = np.stack([x[at == j].sum(axis=0) if (at == j).any() else centres[j] for j in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    # Small clusters are odd texts; the language's own mean serves instead.
    sizes = np.bincount((x @ centres.T).argmax(axis=1), minlength=len(centres))
    centres = centres[sizes >= max(2, len(x) // 50)]
    return np.concatenate([centres, (mean / max(np.linalg.norm(mean), 1e-12))[None]])


def fit(labelled: DataFrame) -> Model:
    """Learn from columns ``doc_id``, ``text`` and ``lang`` of labelled rows (a bounded sample of them)."""
    import pyarrow as pa

    ship_package(labelled.sparkSession)
    rows = labelled.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
             .limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Model([], np.zeros(0, int), np.zeros((0, DIMENSIONS), np.float32), None, None)
    each = max(1, min(SAMPLE, SAMPLE_ALL // len(sizes)))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    share = F.create_map(*(F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, each / n))))
    rows = rows.where(draw < F.element_at(share, F.col("lang"))).select("doc_id", "lang", "text")

    def vectors(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in _groups(texts):
                counts, size = count_vectors(texts[lo:hi])
                cells = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), b.column("lang").slice(lo, hi - lo), pa.array(size),
                     pa.array([at.astype(np.int16).tobytes() for at in cells]),
                     pa.array([c[at].astype(np.float32).tobytes() for c, at in zip(counts, cells)])],
                    names=["doc_id", "lang", "size", "at", "n"])

    schema = "doc_id bigint, lang string, size bigint, at binary, n binary"
    got = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text").mapInArrow(tidy(vectors), schema)
    got = sorted(got.where("size > 0").limit(2 * SAMPLE_ALL).collect(), key=lambda r: (r["doc_id"], r["lang"]))
    names = sorted({r["lang"] for r in got})
    counts = np.zeros((len(got), DIMENSIONS), np.float32)
    for i, r in enumerate(got):
        counts[i, np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["n"], np.float32)
    size = np.array([r["size"] for r in got], np.int64)
    lang = np.array([names.index(r["lang"]) for r in got], int)
    idf = (np.log((1 + len(got)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    # In place: the sample's vectors are the largest thing on the driver.
    x = np.log1p(counts, out=counts)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    parts = [_cluster(x[lang == k], CLUSTERS) for k in range(len(names))]
    owner = np.repeat(np.arange(len(names)), [len(p) for p in parts])
    centroids = np.concatenate(parts) if parts else np.zeros((0, DIMENSIONS), np.float32)
    near = (x @ centroids.T).max(axis=1) if len(got) else np.zeros(0)
    classes, bounds, last = _length_class(size), np.zeros(32, np.float32), 0.02
    for k in range(32):
        if (classes == k).sum() >= 20:
            last = REJECT_SHARE * float(np.quantile(near[classes == k], REJECT_QUANTILE))
        bounds[k] = last
    del got, counts, x
    release()
    return Model(names, owner, centroids.astype(np.float32), idf, bounds)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus lang_pred, score and rejected, from ``text`` alone."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        lang, score, rejected, _ = shared.value.predict([t if isinstance(t, str) else "" for t in texts])
        release()
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": rejected})

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return docs.select(*kept, predict("text").alias("_p")).select(*kept, "_p.lang_pred", "_p.score", "_p.rejected")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.where("NOT held_out"))
    out = identify(docs.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


ORACLE_SQL = None
