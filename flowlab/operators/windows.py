"""Inter-flow gaps per source.

The reference diffs timestamps of consecutive flows of a source in file
order (``flow_id``), first gap 0, and averages over all n flows (Q7).

A plain ``Window.partitionBy('src_ip')`` puts all flows of a source into one
task; one busy host can hold a third of the data. E1 therefore windows over
``(period, src_ip, flow_id div bucket_size)``: no window partition holds more than
``bucket_size`` flows. The last timestamp of the source's previous non-empty
bucket, found on a per-bucket summary (one row per source and bucket), is
carried into each bucket as its opening row: a segmented scan.

E2 needs no window at all: the gaps telescope, so their sum is
``ts(last flow) - ts(first flow)`` in flow_id order, and
``avg_gap = (last - first) / n`` is an ordinary, partially aggregated
``max_by``/``min_by``/``count``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import idiv

DEFAULT_BUCKET = 1 << 20       # flow ids per bucket: at most this many flows per window partition
TIMESTAMP_BUCKET = 1 << 10     # ticks per bucket (about 10 s) when ordering by time


def flow_gap(flows: DataFrame, order_by: str = "flow_id", bucket_size: int | None = None) -> DataFrame:
    """``(flow_id, period, src_ip, gap)``; gap to the source's previous flow
    of the same period (each period is a capture with its own ids and ticks).

    In flow_id order a bucket holds at most ``bucket_size`` flows (ids are
    unique within a period). In time order (``order_by='timestamp'``) ticks repeat, so a
    bucket holds one source's flows of ``bucket_size`` ticks; keep it small.
    """
    if bucket_size is None:
        bucket_size = TIMESTAMP_BUCKET if order_by == "timestamp" else DEFAULT_BUCKET
    if order_by == "timestamp":
        # total order: (timestamp, flow_id); bucket on the timestamp
        key = F.struct("timestamp", "flow_id")
        bucket = idiv("timestamp", bucket_size)
    else:
        key = F.col("flow_id")
        bucket = idiv("flow_id", bucket_size)
    f = flows.select("flow_id", "period", "src_ip", "timestamp", bucket.alias("_b"), key.alias("_k"), F.lit(1).alias("_flow"))
    # the last timestamp before each bucket opens it as an extra row, so the flows
    # are exchanged once and nothing is joined back onto them
    last_in_bucket = f.groupBy("period", "src_ip", "_b").agg(F.max_by("timestamp", "_k").alias("_last"))
    earlier = Window.partitionBy("period", "src_ip").orderBy("_b")
    carried = last_in_bucket.withColumn("timestamp", F.lag("_last").over(earlier)).where(F.col("timestamp").isNotNull())
    opening = carried.select(F.lit(None).cast("bigint").alias("flow_id"), "period", "src_ip", "timestamp", "_b",
                             F.lit(None).cast(f.schema["_k"].dataType).alias("_k"), F.lit(0).alias("_flow"))
    in_bucket = Window.partitionBy("period", "src_ip", "_b").orderBy("_flow", "_k")
    gap = F.coalesce(F.col("timestamp") - F.lag("timestamp").over(in_bucket), F.lit(0))
    return (f.unionByName(opening).withColumn("gap", gap).where(F.col("_flow") == 1)
            .select("flow_id", "period", "src_ip", "gap"))


def avg_flow_gap(flows: DataFrame, order_by: str = "flow_id") -> DataFrame:
    """Mean gap per period and source, largest first (divides by n, the first 0 included)."""
    key = F.col("flow_id") if order_by == "flow_id" else F.struct("timestamp", "flow_id")
    agg = flows.groupBy("period", "src_ip").agg(
        F.max_by("timestamp", key).alias("_last"), F.min_by("timestamp", key).alias("_first"),
        F.count(F.lit(1)).alias("_n"))
    return (agg.select("period", "src_ip", ((F.col("_last") - F.col("_first")) / F.col("_n")).alias("avg_gap"))
            .orderBy(F.col("avg_gap").desc(), "period", "src_ip"))


def avg_flow_gap_window(flows: DataFrame, order_by: str = "flow_id") -> DataFrame:
    """E2 through E1 (for cross-checking the telescoped form)."""
    gaps = flow_gap(flows, order_by=order_by)
    return gaps.groupBy("period", "src_ip").agg(F.avg("gap").alias("avg_gap"))
