"""Edge summary: flows pre-aggregated per (period, src, dst, proto, port).

Every per-host detector depends only on sums and counts per edge, so running
several detectors over one summary replaces one scan and shuffle of all flows
per detector with a single partially aggregated shuffle; the summary holds one
row per distinct edge, orders of magnitude fewer than flows.

Operators that count flows use ``n_flows`` / ``n_flows_if``: a plain row count
on flows, a sum of ``flow_count`` on a summary, so the same operator code runs
on either. That holds for every detector and for the joins and aggregates under
them; the other operators count rows and must be given flows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHT = "flow_count"
EDGE_KEYS = ["period", "src_ip", "dst_ip", "proto", "port"]


def is_summary(df: DataFrame) -> bool:
    return WEIGHT in df.columns


def n_flows(df: DataFrame) -> Column:
    """Number of flows behind the rows of ``df`` (an aggregate expression)."""
    return F.sum(WEIGHT) if is_summary(df) else F.count(F.lit(1))


def n_flows_if(df: DataFrame, cond: Column) -> Column:
    """Number of flows satisfying ``cond`` (an aggregate expression)."""
    if is_summary(df):
        return F.coalesce(F.sum(F.when(cond, F.col(WEIGHT))), F.lit(0)).cast("bigint")
    return F.count_if(cond)


def edge_summary(flows: DataFrame) -> DataFrame:
    """``EDGE_KEYS`` + parsed addresses + ``flow_count``, ``up_bytes``, ``down_bytes``."""
    keys = EDGE_KEYS + [c for c in ("src_ip_num", "dst_ip_num") if c in flows.columns]
    return flows.groupBy(*keys).agg(
        n_flows(flows).alias(WEIGHT), F.sum("up_bytes").alias("up_bytes"),
        F.sum("down_bytes").alias("down_bytes"))


def shared(agg: DataFrame, *measures: str) -> DataFrame:
    """``agg`` in a form that several readers of one query have in common.

    Spark computes an exchange once for all readers whose plans are equal up to
    it. Column pruning would give readers of different measures different
    plans; this test, true for every row, keeps all measures in use in each. At
    least one of ``measures`` must never be null but be nullable to Spark (a
    sum, not a count, over rows that exist).
    """
    test = F.greatest(*measures) if len(measures) > 1 else F.col(measures[0])
    return agg.where(test.isNotNull())


def flow_sum(df: DataFrame) -> Column:
    """``n_flows`` as a sum on flows too, for ``shared``."""
    return F.sum(WEIGHT) if is_summary(df) else F.sum(F.lit(1).cast("bigint"))


def checkpointed_summary(flows: DataFrame) -> DataFrame:
    """The edge summary written once to the shared checkpoint folder (lineage
    cut, so later detectors and a lost executor never re-read the flows)."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(flows.sparkSession)
    return edge_summary(flows).checkpoint(eager=True)
