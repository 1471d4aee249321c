"""Set operations on countries.

They take flows with ``dst_cc`` or, far cheaper, the rows of
``rangejoin.country_edges``. Country sets are small in practice but bounded only
by the range table, so joins with them carry no hint: AQE broadcasts them by
their measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BASELINE, TEST
from . import filters as B
from .summary import shared


IN_TEST, IN_BASELINE = 1, 2


def _periods_seen(df: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``seen``, the periods a key occurs in as bits: one column, so
    that all readers share one plan."""
    bit = F.when(F.col("period") == TEST, IN_TEST).when(F.col("period") == BASELINE, IN_BASELINE).otherwise(0)
    return df.groupBy(*keys).agg(F.bit_or(bit).alias("seen"))


def _new(seen: DataFrame) -> DataFrame:
    per = seen.groupBy("dst_cc").agg(F.bit_or("seen").alias("seen"))
    return per.where(F.col("seen") == IN_TEST).select("dst_cc")


def new_countries(flows_cc: DataFrame) -> DataFrame:
    """G1: test countries minus baseline countries, in one pass."""
    return _new(_periods_seen(B.drop_null_cc(flows_cc), "dst_cc"))


def new_country_flows(flows_cc: DataFrame) -> DataFrame:
    """Distinct (src, dst, cc) of test flows to a new country. The distinct
    rows with their periods serve both as the rows and to find the new countries."""
    seen = _periods_seen(B.drop_null_cc(flows_cc), "src_ip", "dst_ip", "dst_cc")
    test = seen.where(F.col("seen").bitwiseAND(IN_TEST) != 0)
    return test.join(_new(seen), "dst_cc", "left_semi").select("src_ip", "dst_ip", "dst_cc")


def new_country_sources(flows_cc: DataFrame) -> DataFrame:
    """Distinct (src, cc) with a new country."""
    return new_country_flows(flows_cc).select("src_ip", "dst_cc").distinct()


def new_country_source_ips(flows_cc: DataFrame) -> DataFrame:
    """G3 variant: the distinct sources alone."""
    return new_country_flows(flows_cc).select("src_ip").distinct()


def country_list_diff(a: DataFrame, b: DataFrame, col: str = "cc", order_col: str | None = None) -> DataFrame:
    """Entries of list ``a`` not in list ``b``, keeping ``a``'s order column.

    A true set difference (Q5), not the reference's remove-while-iterating
    loop, which skips the element after each removal.
    """
    out = a.join(b.select(col).distinct(), col, "left_anti")
    return out.orderBy(order_col) if order_col else out


def country_lists(edges_cc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The countries of each period as lists: ``(cc, first_flow_id)`` of the test
    period, in order of first contact, and ``(cc,)`` of the baseline; both from
    one aggregate over ``country_edges`` with ``first_flow_id``."""
    per = edges_cc.groupBy(F.col("dst_cc").alias("cc")).agg(
        F.min(F.when(F.col("period") == TEST, F.col("first_flow_id"))).alias("first_flow_id"),
        F.max(F.when(F.col("period") == BASELINE, F.lit(1).cast("bigint"))).alias("in_baseline"))
    per = shared(per, "first_flow_id", "in_baseline")
    return (per.where(F.col("first_flow_id").isNotNull()).select("cc", "first_flow_id"),
            per.where(F.col("in_baseline").isNotNull()).select("cc"))
