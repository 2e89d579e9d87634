import random

import pytest
from pyspark.sql import functions as F

from convsift.operators.asof import BUCKET_MS, DAY_MS, NO_TIME, latest_before, validity_intervals


@pytest.mark.parametrize("seed,bound,spread", [(1, None, 200), (2, 500, 200), (3, None, 3 * BUCKET_MS), (4, 500, 5 * BUCKET_MS),
                                               (5, None, 3 * DAY_MS), (6, 500, 400 * DAY_MS), (7, None, 1)])
def test_latest_strictly_before_matches_brute_force(spark, seed, bound, spread):
    rnd = random.Random(seed)

    def time():
        # Times collide often, also at the edges of buckets and days, and may be negative.
        t = rnd.randint(-spread, spread)
        return rnd.choice([t, t // 7 * 7, t // BUCKET_MS * BUCKET_MS, t // DAY_MS * DAY_MS - 1])

    left = [(i, rnd.choice(["hot", "hot", "hot", "a", "b"]), time()) for i in range(300)]
    left += [(300 + i, g, None) for i, g in enumerate(["hot", "a", "b", "b"])]
    right = [(rnd.choice(["hot", "hot", "a", "c"]), time(), f"v{j}") for j in range(400)] + [("hot", None, "never")]
    ldf = spark.createDataFrame(left, "id int, g string, t long")
    rdf = spark.createDataFrame(right, "g string, rt long, val string")
    out = latest_before(ldf, rdf, "g", "t", "rt", F.struct("rt", "val"), left_row_bound=bound)
    assert out.columns == ["id", "g", "t", "asof"]
    rows = out.collect()
    got = {r.id: (None if r.asof is None else (r.asof.rt, r.asof.val)) for r in rows}
    for i, g, t in left:
        cands = [(rt, v) for gg, rt, v in right if gg == g and t is not None and rt is not None and rt < t]
        assert got[i] == (max(cands) if cands else None), (i, g, t)
    assert len(got) == len(rows) == len(left)


def test_intervals_cover_each_bucket_once(spark):
    right = spark.createDataFrame([("a", 5, 1), ("a", BUCKET_MS + 9, 2), ("a", 9 * BUCKET_MS, 3), ("b", 1, 4)], "g string, t long, v int")
    left = spark.createDataFrame([("a", 7), ("a", BUCKET_MS * 3), ("c", 8), ("a", None)], "g string, t long")
    rows = validity_intervals(right, "g", "t", F.struct("v"), left, "t").collect()
    found = sorted((r.g, r.bucket, r.from_ms, r.to_ms, r.value.v if r.value else None) for r in rows if r.bucket != NO_TIME)
    assert found == [("a", 0, -1, 5, None), ("a", 0, 5, BUCKET_MS - 1, 1),
                     ("a", 3 * BUCKET_MS, 3 * BUCKET_MS - 1, 4 * BUCKET_MS - 1, 2), ("c", 0, -1, BUCKET_MS - 1, None)]
    assert [(r.g, r.from_ms, r.value) for r in rows if r.bucket == NO_TIME] == [("a", None, None)]


def test_a_group_of_one_time_is_reduced_first(spark):
    """Rows of one millisecond meet as partial aggregates, before any window."""
    df = spark.range(1000).selectExpr("'hot' AS g", "5L AS t", "id AS v")
    plan = latest_before(df, df.withColumnRenamed("t", "rt"), "g", "t", "rt", F.struct("v"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan
