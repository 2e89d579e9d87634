"""Typo-tolerant search (C3) with an approximate-substring score (M1).

Score: the smallest Levenshtein distance between the lower-cased query
(length m) and any substring of the lower-cased item, divided by m.  An
item matches when that distance ``d`` is within the threshold (at most
``k`` errors, the greatest e with e/m <= threshold) and at least two query
characters align exactly (m - d >= 2).  Ranking: score, then items with
fewer words, then walk order.  Excerpt and context are cut around the start
of the leftmost best alignment.

Plan:
1. items (G5) scoped by project / role;
2. each text is cut once, in linear time, into chunks of at least ``WINDOW``
   characters; a window is a chunk and the head of the next one, so every
   candidate substring lies wholly in a window and the whole text stays behind;
3. exact prefilter (Wu–Manber partition lemma): a substring with ≤ k errors
   contains one of k + 1 query pieces intact, so windows containing none of
   them are dropped with native ``contains``;
4. one Arrow ``pandas_udf`` lower-cases and scores the surviving windows
   (bit-parallel, whole batch at once, :mod:`convsift.functions.editdist`) and
   returns distance and start in the window's own characters, packed in a long;
5. best window per item: the least of these longs, combined map-side;
6. top-k by (score, words, walk order); only then the ≤ k items are looked up
   again and their excerpt and context cut, newest first.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.editdist import allowed_errors, best_alignment
from ..functions.broadcast import broadcast_if_bounded
from ..functions.text import around, word_count
from ..model import MATCH_COLUMNS, History, scan_order
from ..session import ship_package
from .items import build_items

DEFAULT_THRESHOLD = 0.4
DEFAULT_LIMIT = 50
MIN_MATCH_CHARS = 2
WINDOW = 1024
CONTEXT_BEFORE, CONTEXT_AFTER = 100, 200
EXCERPT_BEFORE, EXCERPT_AFTER = 20, 80

_KEY = ["session_id", "k_phase", "message_id", "part_id", "k_slot", "k_ord"]
_RANK = ["k_updated_ms", "k_msg_ms", "k_part_ms", "n_words"]
_DIST_SHIFT = 40


def fuzzy_limit(limit: int | None) -> int:
    """``limit ?? 50``; zero gives no rows, negative is an error."""
    if limit is None:
        return DEFAULT_LIMIT
    if limit < 0:
        raise ValueError("limit must not be negative")
    return int(limit)


def query_pieces(q: str, k: int) -> list[str]:
    """k + 1 contiguous pieces of ``q`` (empty list when k + 1 > len(q))."""
    m = len(q)
    if k + 1 > m:
        return []
    bounds = [round(i * m / (k + 1)) for i in range(k + 2)]
    return [q[bounds[i]:bounds[i + 1]] for i in range(k + 1)]


def _folded(text: str) -> tuple[str, list[int] | None]:
    """Lower-cased text, and where each of its characters comes from if lengths differ."""
    low = text.lower()
    if len(low) == len(text):
        return low, None
    chars = [c.lower() for c in text]
    return "".join(chars), [i for i, c in enumerate(chars) for _ in c]


def alignment_udf(query: str, max_dist: int):
    """Arrow UDF: window text, offset → dist << 40 | start in the whole text, or null."""

    @F.pandas_udf(LongType())
    def align(texts: pd.Series, offsets: pd.Series) -> pd.Series:
        folded = [_folded(t) for t in texts]
        dist, start = best_alignment([low for low, _ in folded], query, max_dist)
        out = [None if d < 0 else (int(d) << _DIST_SHIFT) | int(off + (back[s] if back else s))
               for (_, back), d, s, off in zip(folded, dist, start, offsets)]
        return pd.Series(out, dtype="Int64")

    return align


def _windows(items: DataFrame, m: int, k: int) -> DataFrame:
    """One row per window: ``win`` and its offset ``off``, without the whole text."""
    width = max(WINDOW, m + k)
    # The chunks are a column of their own; inside the function over them the
    # text would be cut again for every chunk.
    chunks = F.regexp_extract_all("content", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    cut = items.select(*_KEY, *_RANK, chunks.alias("_c"))
    windows = F.transform("_c", lambda c, i: F.struct(
        (i * width).cast("long").alias("off"),
        F.concat(c, F.substring(F.coalesce(F.get("_c", i + 1), F.lit("")), 1, m + k)).alias("win")))
    return cut.select(*_KEY, *_RANK, F.inline(windows))


def _prefilter(win: Column, pieces: list[str]) -> Column | None:
    if not pieces:
        return None
    cond = None
    for p in dict.fromkeys(pieces):
        c = F.lower(win).contains(F.lit(p))
        cond = c if cond is None else (cond | c)
    return cond


def fuzzy_scores(items: DataFrame, query: str, threshold: float) -> DataFrame | None:
    """Keys, ranks, ``dist``, ``start`` and ``score`` of the matching items."""
    q = query.lower()
    m = len(q)
    k = min(allowed_errors(m, threshold), m - MIN_MATCH_CHARS)
    if m < MIN_MATCH_CHARS or k < 0:
        return None
    if "n_words" not in items.columns:
        items = items.withColumn("n_words", word_count(F.col("content")))
    # Lower-casing may lengthen a text (at most threefold), so only shorter ones are out.
    w = _windows(items.where(F.col("content").isNotNull() & (3 * F.length("content") >= m - k)), m, k)
    pre = _prefilter(F.col("win"), query_pieces(q, k))
    if pre is not None:
        w = w.where(pre)
    # The score comes out of a one-element generator: a filter on generator
    # output is never pushed below it, so the UDF runs once per window (a
    # filter on a plain projection would be pushed down with the UDF inlined,
    # running it twice).  The UDF stays deterministic, so a lost executor's
    # shuffle output is simply recomputed.
    ship_package(items.sparkSession)
    al = F.struct(alignment_udf(q, k)(F.col("win"), F.col("off")).alias("al"))
    scored = w.select(*_KEY, *_RANK, F.inline(F.array(al))).where(F.col("al").isNotNull())
    best = scored.groupBy(*_KEY, *_RANK).agg(F.min("al").alias("b"))
    dist = F.shiftright("b", _DIST_SHIFT).cast("int")
    return best.select(*_KEY, *_RANK, dist.alias("dist"),
                       F.col("b").bitwiseAND(F.lit((1 << _DIST_SHIFT) - 1)).cast("int").alias("start"),
                       (dist / F.lit(m)).alias("score"))


def _rank() -> list[Column]:
    return [F.col("dist").asc(), F.col("n_words").asc(), *scan_order()]


def search_fuzzy(history: History, query: str, threshold: float | None = None,
                 limit: int | None = None, role: str | None = None,
                 project_id: str | None = None, items: DataFrame | None = None,
                 corpus_range=None) -> DataFrame:
    """Fuzzy search; rows newest first (``MATCH_COLUMNS``).

    ``items`` may be a pre-built item table; otherwise the history's stored one
    is read, or one is derived from its parts.
    """
    t = DEFAULT_THRESHOLD if threshold is None else float(threshold)
    if not 0.0 <= t <= 1.0:
        raise ValueError("threshold must be within [0, 1]")
    n = fuzzy_limit(limit)
    if role is not None and role not in ("user", "assistant"):
        raise ValueError("role must be 'user' or 'assistant'")
    h = history.scoped(project_id)
    it = items if items is not None else h.items if h.items is not None else build_items(h)
    if items is not None and project_id is not None:
        it = it.where(F.col("project_id") == F.lit(project_id))
    if role is not None:
        # Titles have no role and are searched whatever the role.
        it = it.where((F.col("match_type") == "title") | (F.col("role") == F.lit(role)))
    if corpus_range is not None:
        it = it.where(F.col("timestamp").between(F.lit(corpus_range.start_ms), F.lit(corpus_range.end_ms)))
    scores = fuzzy_scores(it, query, t)
    spark = history.sessions.sparkSession
    if scores is None or n == 0:
        return spark.createDataFrame([], _empty_schema())
    top = scores.orderBy(*_rank()).limit(n).select(*_KEY, "dist", "start")
    # At most n keys come back to the items for their texts.
    keys = broadcast_if_bounded(top.withColumnsRenamed({c: f"_{c}" for c in _KEY}), n)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _KEY]
    if "n_words" not in it.columns:
        it = it.withColumn("n_words", word_count(F.col("content")))
    found = it.join(keys, reduce(lambda a, b: a & b, same))
    q = F.lit(query)
    ex = around(F.col("content"), F.col("start"), EXCERPT_BEFORE, EXCERPT_AFTER)
    cx = around(F.col("content"), F.col("start"), CONTEXT_BEFORE, CONTEXT_AFTER)
    excerpt = F.when(F.length(ex) > 0, ex).otherwise(q)
    context = F.when(F.length(cx) > 0, cx).otherwise(excerpt)
    return (found.withColumns({"excerpt": excerpt, "context": context})
            .orderBy(F.col("timestamp").desc(), *_rank())
            .select(*MATCH_COLUMNS))


def _empty_schema() -> str:
    return ("session_id string, session_title string, timestamp bigint, match_type string, "
            "excerpt string, context string, message_id string, part_id string, project_directory string")
