"""Sorts, limits and top-k.

Every ordering carries a key tie-break (Q10), so limits are deterministic.
``orderBy(...).limit(k)`` plans as ``TakeOrderedAndProject``: each task keeps
its own k best rows and no global sort happens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import defaults as K
from ..functions import net
from . import aggregates as D
from . import joins as J


def _order(col: str, keys, desc: bool):
    first = F.col(col).desc() if desc else F.col(col).asc()
    return [first, *[F.col(k).asc() for k in keys]]


def sort_desc(df: DataFrame, col: str, keys=()) -> DataFrame:
    """descending, ties by key."""
    return df.orderBy(*_order(col, keys, True))


def sort_asc(df: DataFrame, col: str, keys=()) -> DataFrame:
    return df.orderBy(*_order(col, keys, False))


def first_per(df: DataFrame, by, order, k: int) -> DataFrame:
    """The first ``k`` rows of each ``by`` value. Each task keeps its own k best of
    a period before the shuffle (WindowGroupLimit), so no period gathers in one."""
    rank = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order))
    return df.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def top_k_hosts(flows: DataFrame, net_prefix: str = net.DEFAULT_NET, k: int = K.TOP_HOSTS, by=D.PER_PERIOD) -> DataFrame:
    """the k most active internal addresses (J1) of each period."""
    return first_per(J.host_activity(flows, net_prefix, by), by, _order("flows", ["ip"], True), k)


def tail_k(agg: DataFrame, col: str, k: int, keys=()) -> DataFrame:
    """the last k of an ascending sort, i.e. the k largest."""
    return agg.orderBy(*_order(col, keys, True)).limit(k)


def peak_hour(flows: DataFrame, by=D.PER_PERIOD) -> DataFrame:
    """hour with most upload and with most download in each period; the earlier
    hour wins a tie (``idxmax``). Both picks come from one aggregate of 24 rows a period."""
    hourly = D.hourly_bytes(flows, by)
    # one pass: the largest (bytes, earlier hour first) per metric; hours are 'HH'
    earlier = -F.col("hour").cast("int")
    best = hourly.groupBy(*by).agg(
        F.max_by("hour", F.struct("up_bytes", earlier)).alias("up_bytes"),
        F.max_by("hour", F.struct("down_bytes", earlier)).alias("down_bytes"))
    return best.select(*by, F.explode(F.array(
        F.struct(F.lit("up_bytes").alias("metric"), F.col("up_bytes").alias("hour")),
        F.struct(F.lit("down_bytes").alias("metric"), F.col("down_bytes").alias("hour")))).alias("r")) \
        .select(*by, "r.metric", "r.hour").where(F.col("hour").isNotNull())


def last_entries(flows: DataFrame, n: int = 10) -> DataFrame:
    """the flows with the highest flow_id (end of file order)."""
    return flows.orderBy(F.col("flow_id").desc()).limit(n)


def preview(df: DataFrame, order_col: str, keys=(), n: int = 5, desc: bool = True) -> DataFrame:
    """``head(n)`` after an explicit sort."""
    return df.orderBy(*_order(order_col, keys, desc)).limit(n)


def skip_first_n(agg: DataFrame, col: str, skip: int, by=D.PER_PERIOD) -> DataFrame:
    """each period without the first ``skip`` rows of an ascending sort
    (``[500:]``). For aggregates over time: a period's rows are ranked in one task."""
    rank = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col(col).asc()))
    return agg.withColumn("_r", rank).where(F.col("_r") > skip).drop("_r").orderBy(*by, col)


def last_seconds(flows: DataFrame, n: int = K.LAST_SECONDS, by=D.PER_PERIOD) -> DataFrame:
    """F7 variant: uploaded bytes of the last n seconds of each period (``[-60:]`` by key)."""
    return first_per(D.bytes_by_second(flows, by=by), by, [F.col("second").desc()], n)
