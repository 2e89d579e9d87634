"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources that hold them).
A flow routes every pattern's words to the quotas of its sources; the k-th
repetition of a pattern costs 2k - 1 per word, so repetitions spread before any
pattern is repeated again.  Each pattern then lays the copies of its documents,
in seeded order, on a line and takes those whose middle lies within its flow;
one document a pattern is added or left out to come closest.

The patterns, at most ``MAX_PATTERNS`` of them, are solved on the driver; the
documents never leave the executors.

Defined results: a null or empty text has size 0 and takes 0 words; a document
without a source belongs to the null source, which sorts last; repeated rows are
separate documents; ties in the seeded order are taken by size; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convsift.llm.common import documents, materialise, n_words

SEED = 17
MAX_REPEAT = 3
#: More membership patterns than this are refused (they are solved on the driver).
MAX_PATTERNS = 20_000
#: Rows that one ordered bucket of a pattern holds, about.
BUCKET_ROWS = 800


def fill_targets(sizes: list[int], weights: list[float], max_repeat: int = MAX_REPEAT) -> list[float]:
    """Share ``sum(sizes)`` by weight; no target above ``max_repeat`` times its size.

    Targets grow together, in proportion to the weights, and stop at their caps.
    """
    caps = [float(max_repeat * s) for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: (caps[i] / weights[i], i))
    left, share, level = float(sum(sizes)), float(sum(weights)), 0.0
    for i in order:
        level = left / share
        if caps[i] / weights[i] > level:
            break
        left -= caps[i]
        share -= weights[i]
        level = left / share if share else caps[i] / weights[i]
    return [min(c, level * w) for c, w in zip(caps, weights)]


def route(supply: list[int], members: list[list[int]], quotas: list[int],
          max_repeat: int = MAX_REPEAT) -> list[dict[int, int]]:
    """Words that each pattern sends to each source: the cheapest largest flow."""
    n, m = len(supply), len(quotas)
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    ends, room, cost = [], [], []
    source, sink = n + m, n + m + 1

    def edge(a: int, b: int, capacity: int, price: int) -> None:
        for u, v, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[u].append(len(ends))
            ends.append(v)
            room.append(c)
            cost.append(p)

    for p in range(n):
        for k in range(max_repeat):
            edge(source, p, supply[p], 2 * k + 1)
    arcs = {}
    for p in range(n):
        for s in members[p]:
            arcs[p, s] = len(ends)
            edge(p, n + s, max_repeat * supply[p], 0)
    for s in range(m):
        edge(n + s, sink, quotas[s], 0)
    while True:
        best = {source: 0}
        via: dict[int, int] = {}
        queue, queued = deque([source]), {source}
        while queue:
            u = queue.popleft()
            queued.discard(u)
            for e in graph[u]:
                v = ends[e]
                if room[e] > 0 and best[u] + cost[e] < best.get(v, 1 << 60):
                    best[v] = best[u] + cost[e]
                    via[v] = e
                    if v not in queued:
                        queued.add(v)
                        queue.append(v)
        if sink not in via:
            break
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = ends[via[v] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    flows: list[dict[int, int]] = [{} for _ in range(n)]
    for (p, s), e in arcs.items():
        if room[e ^ 1]:
            flows[p][s] = room[e ^ 1]
    return flows


def _patterns(rows: DataFrame) -> list:
    found = rows.groupBy("members").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    got = found.limit(MAX_PATTERNS + 1).collect()
    if len(got) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    return sorted(got, key=lambda r: [(s is None, s or "") for s in r["members"]])


def mix_sources(docs: DataFrame, size: Column, members: Column, weights=None, max_repeat: int = MAX_REPEAT,
                seed: int = SEED) -> DataFrame:
    """All rows of ``docs`` with size, members, source_size, target, copies and copy_sources.

    ``members`` is an array of source names; ``weights`` maps names to weights
    (default: 1, 2, 3, repeating, over the names by code point, null last).
    ``source_size`` and ``target`` are those of the first member.
    """
    spark = docs.sparkSession
    own = docs.columns
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = materialise(docs.withColumns({"size": size, "members": F.array_sort(F.array_distinct(members)),
                                         "_key": key}).select(*own, "size", "members", "_key"), "mix-sizes")
    patterns = _patterns(rows)
    names = sorted({s for r in patterns for s in r["members"]}, key=lambda s: (s is None, (s or "").encode()))
    at = {s: i for i, s in enumerate(names)}
    w = [float((weights or {}).get(s, 0) if weights else 1 + i % 3) for i, s in enumerate(names)]
    # A source counts every word that it holds; the total counts each document once.
    source_size = [sum(r["size"] for r in patterns if s in r["members"]) for s in names]
    total = sum(r["size"] for r in patterns)
    targets = fill_targets(source_size, w, max_repeat) if total else [0.0] * len(names)
    targets = [t * (total / sum(source_size)) if sum(source_size) != total else t for t in targets]
    flows = route([r["size"] for r in patterns], [[at[s] for s in r["members"]] for r in patterns],
                  [int(t + 0.5) for t in targets], max_repeat)

    # One row a pattern, at most MAX_PATTERNS: safe to broadcast.
    plan = [(r["members"], r["size"], sum(f.values()), max(1, -(-r["n"] // BUCKET_ROWS)),
             source_size[at[r["members"][0]]] if r["members"] else 0,
             targets[at[r["members"][0]]] if r["members"] else 0.0,
             [(names[s], v) for s, v in sorted(f.items())]) for r, f in zip(patterns, flows)]
    plan = spark.createDataFrame(plan, "members array<string>, _all long, _flow long, _nb long, source_size long, "
                                       "target double, _parts array<struct<source: string, words: long>>")
    rows = rows.join(F.broadcast(plan.withColumnRenamed("members", "_m")), F.col("members").eqNullSafe(F.col("_m")))
    bucket = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.col("_nb") / F.lit(1 << 32))
    rows = rows.withColumn("_b", bucket.cast("long"))
    sums = rows.groupBy("_m", "_b").agg(F.sum("size").alias("_s"))
    before = Window.partitionBy("_m").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_m", "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_m", "_b").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_c", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sums = sums.withColumnsRenamed({"_m": "_sm", "_b": "_sb"})
    # (pattern, bucket) has about BUCKET_ROWS rows on the left and one on the right.
    rows = rows.join(sums, (F.col("_m") == F.col("_sm")) & (F.col("_b") == F.col("_sb")))
    rows = rows.withColumn("_c", F.col("_c") + F.col("_o"))
    # Copy k of a document is taken if the middle of its place, k * _all + _c + size / 2, lies before _flow.
    reach = F.ceil((2 * (F.col("_flow") - F.col("_c")) - F.col("size")) / (2 * F.col("_all")))
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(reach, F.lit(max_repeat))))
                           .otherwise(0).cast("int"))
    rows = materialise(rows.drop("_sm", "_sb", "_o", "_b", "_key", "_nb"), "mix-copies")

    # One document a pattern closes what the rounding left open.
    got = rows.groupBy("_m").agg(F.sum(F.col("copies") * F.col("size")).alias("_got"), F.max("_flow").alias("_want"))
    got = got.select("_m", (F.col("_want") - F.col("_got")).alias("_d"))
    open_ = rows.join(F.broadcast(got.withColumnRenamed("_m", "_g")), F.col("_m") == F.col("_g"))
    can = F.when(F.col("_d") > 0, F.col("copies") < max_repeat).otherwise((F.col("_d") < 0) & (F.col("copies") > 0))
    off = F.abs(F.col("size") - F.abs(F.col("_d")))
    pick = (open_.where(can & (F.col("size") > 0) & (off < F.abs(F.col("_d")))).groupBy("_m")
            .agg(F.min(F.struct(off.alias("off"), F.col("_c").alias("c"), F.signum("_d").cast("int").alias("s"))).alias("_p")))
    pick = pick.select(F.col("_m").alias("_pm"), F.col("_p.c").alias("_pc"), F.col("_p.s").alias("_ps"))
    rows = rows.join(F.broadcast(pick), (F.col("_m") == F.col("_pm")) & (F.col("_c") == F.col("_pc"))
                     & (F.col("size") > 0), "left")
    rows = rows.withColumn("copies", F.col("copies") + F.coalesce(F.col("_ps"), F.lit(0)))

    def owner(k: Column) -> Column:
        """The source whose part of the pattern's flow holds the middle of copy k."""
        middle = k * F.col("_all") + F.col("_c") + F.col("size") / 2
        ends = F.aggregate("_parts", F.struct(F.lit(None).cast("string").alias("s"), F.lit(0.0).alias("end")),
                           lambda a, x: F.struct(
                               F.when((a["end"] > middle) & (a["end"] > 0), a["s"]).otherwise(x["source"]).alias("s"),
                               F.when((a["end"] > middle) & (a["end"] > 0), a["end"])
                               .otherwise(a["end"] + x["words"]).alias("end")))
        return ends["s"]

    copies = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), owner)) \
        .otherwise(F.array().cast("array<string>"))
    return rows.select(*own, "size", "members", "source_size", "target", "copies", copies.alias("copy_sources"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    docs = docs.select("doc_id", F.array("source").alias("sources"), n_words(F.col("text")).alias("words"))
    out = mix_sources(docs, F.col("words"), F.col("sources"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight,
         (3 * source_size)::DOUBLE AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM s),
r AS (
  SELECT *, (SELECT sum(source_size) FROM s)::DOUBLE
            - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM w WINDOW o AS (ORDER BY cap / weight, i)),
level AS (SELECT coalesce((SELECT left_ / share FROM r WHERE cap / weight > left_ / share
                           ORDER BY cap / weight, i LIMIT 1), 1e300) AS l),
t AS (
  SELECT source, source_size, least(cap, l * weight) AS target,
         floor(least(cap, l * weight) + 0.5)::BIGINT AS flow FROM r, level),
c AS (
  SELECT doc_id, size, source_size, target, flow, t.source AS src, k,
         coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY k, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (
  SELECT *, CASE WHEN size > 0 THEN greatest(0, least(3, ceil(
              (2 * (flow - before) - size) / (2.0 * source_size))))::BIGINT ELSE 0 END AS copies FROM c),
g AS (SELECT *, flow - sum(copies * size) OVER (PARTITION BY src) AS gap FROM n),
p AS (
  SELECT *, row_number() OVER (PARTITION BY src, size > 0 AND abs(size - abs(gap)) < abs(gap)
                                 AND ((gap > 0 AND copies < 3) OR (gap < 0 AND copies > 0))
                               ORDER BY abs(size - abs(gap)), before) AS place,
         size > 0 AND abs(size - abs(gap)) < abs(gap)
           AND ((gap > 0 AND copies < 3) OR (gap < 0 AND copies > 0)) AS may FROM g)
SELECT doc_id, size, source_size, target,
       ((copies + CASE WHEN may AND place = 1 THEN sign(gap) ELSE 0 END) * size)::BIGINT AS taken
FROM p
"""
