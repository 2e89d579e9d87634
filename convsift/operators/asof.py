"""As-of lookup by validity intervals: for each left row, the latest right row of
the same group that lies strictly earlier (J3).

A right row is valid after its own time, up to and including the next one's.  Time is
cut into buckets of ``BUCKET_MS``; the intervals of a group start anew in every
bucket that a left row asks for, with the value carried into it, so a lookup is an
equality on (group, bucket) and a range: one interval holds for every left row.

Nothing here sorts a whole group: rows of one millisecond are first reduced to the
greatest, so a (group, bucket) has at most ``BUCKET_MS`` of them; the values carried
into buckets run over one row per bucket within a day, and over one row per day.  No
group needs counting beforehand, and building a lookup runs no job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.broadcast import broadcast_if_bounded

BUCKET_MS = 600_000
DAY_MS = 86_400_000
#: Bucket of left rows without a time; nothing is earlier than these.
NO_TIME = -(1 << 62)


def bucket_of(ts: Column, width: int = BUCKET_MS) -> Column:
    """Start of the bucket that holds a time."""
    return F.coalesce(ts - F.pmod(ts, F.lit(width)), F.lit(NO_TIME))


def within(ts: Column) -> Column:
    """Whether an interval of the time's bucket holds it."""
    return F.col("from_ms").isNull() | ((ts > F.col("from_ms")) & (ts <= F.col("to_ms")))


def validity_intervals(right: DataFrame, by: str, right_ts: str, value: Column, left: DataFrame, left_ts: str) -> DataFrame:
    """``by``, bucket, from_ms (exclusive), to_ms (inclusive) and value of the intervals
    in all buckets that ``left`` has times in; the value is null before the first."""
    rows = (right.where(F.col(right_ts).isNotNull())
            .select(F.col(by), F.col(right_ts).alias("from_ms"), value.alias("value"))
            .withColumn("bucket", bucket_of(F.col("from_ms")))
            .groupBy(by, "bucket", "from_ms").agg(F.max("value").alias("value")))
    asked = left.select(F.col(by), bucket_of(F.col(left_ts)).alias("bucket")).distinct()

    # One row per bucket: its last value, and whether it is asked for.
    kind = rows.schema["value"].dataType
    last = rows.groupBy(by, "bucket").agg(F.max_by("value", "from_ms").alias("last"))
    buckets = (last.withColumn("asked", F.lit(False))
               .unionByName(asked.select(by, "bucket", F.lit(None).cast(kind).alias("last"), F.lit(True).alias("asked")))
               .groupBy(by, "bucket").agg(F.max("last").alias("last"), F.max("asked").alias("asked"))
               .withColumn("day", bucket_of(F.col("bucket"), DAY_MS)))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    days = buckets.where("last IS NOT NULL").groupBy(by, "day").agg(F.max_by("last", "bucket").alias("last"))
    days = buckets.select(by, "day").distinct().join(days, [by, "day"], "left")
    days = days.withColumn("before", F.last("last", ignorenulls=True).over(earlier.partitionBy(by).orderBy("day")))
    carried = F.last("last", ignorenulls=True).over(earlier.partitionBy(by, "day").orderBy("bucket"))
    carry = (buckets.withColumn("inside", carried).where("asked")
             .join(days.select(by, "day", "before"), [by, "day"])
             .select(by, "bucket", (F.col("bucket") - 1).alias("from_ms"), F.coalesce("inside", "before").alias("value"),
                     F.lit(True).alias("asked")))

    bucket = Window.partitionBy(by, "bucket")
    end = F.coalesce(F.lead("from_ms").over(bucket.orderBy("from_ms")), F.col("bucket") + (BUCKET_MS - 1))
    # A bucket's carried value comes first in it; buckets without one were not asked for.
    return (rows.withColumn("asked", F.lit(False)).select(carry.columns).unionByName(carry)
            .withColumn("to_ms", end).withColumn("asked", F.max("asked").over(bucket)).where("asked")
            .select(by, "bucket", F.when(F.col("bucket") != NO_TIME, F.col("from_ms")).alias("from_ms"), "to_ms", "value"))


def look_up(left: DataFrame, intervals: DataFrame, by: str, left_ts: str, left_row_bound: int | None = None) -> DataFrame:
    """``left`` with the columns of the one interval that holds each row's time.

    ``intervals`` must cover the buckets of ``left``.  A left side of proven small size
    is broadcast, so the intervals are scanned once and not shuffled."""
    # Both sides may come from the same rows, so the left columns get names of their own.
    at = left.select(*(F.col(c).alias(f"_l_{c}") for c in left.columns), bucket_of(F.col(left_ts)).alias("_bucket"))
    if left_row_bound is not None:
        at = broadcast_if_bounded(at, left_row_bound)
    values = [c for c in intervals.columns if c not in (by, "bucket", "from_ms", "to_ms")]
    same = (F.col(by) == F.col(f"_l_{by}")) & (F.col("bucket") == F.col("_bucket")) & within(F.col(f"_l_{left_ts}"))
    return intervals.join(at, same).select(*(F.col(f"_l_{c}").alias(c) for c in left.columns), *values)


def latest_before(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, right_value: Column,
                  out_col: str = "asof", left_row_bound: int | None = None) -> DataFrame:
    """``left`` with ``out_col`` = max ``right_value`` over right rows with the same ``by``
    and ``right_ts < left_ts`` (null when none; rows without a group are dropped).

    ``right_value`` must be a struct whose leading fields order the rows.  When
    ``left_row_bound`` proves ``left`` small, right rows are first restricted to the
    groups present on the left (a broadcast semi-join)."""
    if left_row_bound is not None:
        groups = broadcast_if_bounded(left.select(F.col(by)).distinct(), left_row_bound)
        right = right.join(groups, by, "left_semi")
    intervals = validity_intervals(right, by, right_ts, right_value, left, left_ts)
    return look_up(left, intervals.withColumnRenamed("value", out_col), by, left_ts, left_row_bound)
