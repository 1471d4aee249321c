"""Point-in-range lookup of IPv4 addresses by a sweep (J6, J7), and flat range tables.

Range starts, range ends and the distinct addresses to look up are events on
the address line. One shuffle deals them by blocks of 2^18 addresses; inside a
block a running sum of starts and ends gives each event its nesting depth, and
the last start at that depth is the innermost range open there
(``last(ignorenulls)``). Ranges that reach over the edge of a block are opened
again at the start of the next one, so every block stands by itself. A block
holds at most 2^18 distinct addresses, whatever the traffic, and its edges
depend on the address alone: the plan is lazy, has no size switch and no hint,
and gives the same answers however often or in how many tasks it runs.

Ranges may nest to any depth and need not be CIDR-aligned: the most specific one
wins. Of equal ranges the smallest value counts. Ranges that cross (overlap
without nesting), end before they begin or leave the IPv4 space stop the query
with an error that names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net
from .summary import WEIGHT, flow_sum, shared

BLOCK_BITS = 18
ADDRESSES = 1 << 32
END, START, POINT = 0, 1, 2


def _block(pos: Column) -> Column:
    return F.shiftright(pos, BLOCK_BITS)


def _refuse(what: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"range table: {what} near lo="), F.col("lo").cast("string"),
                                  F.lit(", hi="), F.col("hi").cast("string"))).cast("boolean")


def _range_events(ranges: DataFrame, value_col: str) -> DataFrame:
    """``(block, pos, kind, lo, hi, value)``: each range's start, its start again
    in every later block it reaches, and its end unless a block edge ends it."""
    lo, hi = F.col("lo"), F.col("hi")
    sound = ranges.where(F.when((hi < lo) | (lo < 0) | (hi >= ADDRESSES), _refuse("inverted or out of bounds")).otherwise(True))
    one = sound.groupBy("lo", "hi").agg(F.min(value_col).alias("value"))

    def event(pos: Column, kind: int) -> Column:
        return F.struct(_block(pos).alias("block"), pos.alias("pos"), F.lit(kind).alias("kind"))

    none = F.array().cast("array<struct<block:bigint,pos:bigint,kind:int>>")
    again = F.when(_block(hi) > _block(lo), F.transform(
        F.sequence(_block(lo) + 1, _block(hi)), lambda b: event(b * (1 << BLOCK_BITS), START))).otherwise(none)
    end = F.when(_block(hi + 1) == _block(hi), F.array(event(hi + 1, END))).otherwise(none)
    events = F.explode(F.concat(F.array(event(lo, START)), end, again))
    return one.select(events.alias("e"), "lo", "hi", "value").select("e.*", "lo", "hi", "value")


def innermost(points: DataFrame, ranges: DataFrame, value_col: str) -> DataFrame:
    """``(num, lo, hi, value)``: for each of the distinct addresses in ``points``
    (one column ``num``) the most specific range that holds it, or nulls."""
    asked = points.select(_block(F.col("num")).alias("block"), F.col("num").alias("pos"), F.lit(POINT).alias("kind"),
                          *[F.lit(None).cast("bigint").alias(c) for c in ("lo", "hi")], F.lit(None).cast("string").alias("value"))
    events = _range_events(ranges, value_col).unionByName(asked)
    start, end = F.col("kind") == START, F.col("kind") == END
    # ends before starts before points; outer ranges open first and close last
    order = ["pos", "kind", F.when(start, F.col("lo")).when(end, -F.col("lo")), F.when(start, -F.col("hi"))]
    so_far = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(F.when(start, 1).when(end, -1).otherwise(0)).over(so_far)
    # an end belongs to the depth it closes
    leveled = events.withColumn("level", depth + F.when(end, 1).otherwise(0))
    same_level = Window.partitionBy("block", "level").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = leveled.withColumn("open", F.last(F.when(start, F.struct("lo", "hi", "value")), ignorenulls=True).over(same_level))
    closes = F.coalesce((F.col("open.lo") == F.col("lo")) & (F.col("open.hi") == F.col("hi")), F.lit(False))
    kept = found.where(F.when(end, F.when(closes, False).otherwise(_refuse("ranges cross"))).otherwise(F.col("kind") == POINT))
    return kept.select(F.col("pos").alias("num"), "open.lo", "open.hi", "open.value")


def flatten(ranges: DataFrame, value_col: str) -> DataFrame:
    """A3/A4: a nested range table as disjoint ranges ``(lo, hi, value_col)``, each
    the longest run of addresses whose most specific range is the same one."""
    cuts = (ranges.select(F.explode(F.array("lo", F.col("hi") + 1)).alias("num")).distinct()
            .where(F.col("num") < ADDRESSES).withColumn("block", _block(F.col("num"))))
    # the first cut after a block: at most one row per block
    firsts = cuts.groupBy("block").agg(F.min("num").alias("first"))
    following = firsts.select(F.col("block").alias("b"), F.lead("first").over(Window.orderBy("block")).alias("following"))
    here = F.lead("num").over(Window.partitionBy("block").orderBy("num"))
    until = (cuts.withColumn("here", here).join(following, F.col("block") == F.col("b"))
             .select(F.col("num").alias("cut"), F.coalesce("here", "following", F.lit(ADDRESSES)).alias("until")))
    held = innermost(cuts.select("num"), ranges, value_col).where(F.col("lo").isNotNull())
    return held.join(until, F.col("num") == F.col("cut")).select(
        F.col("num").alias("lo"), (F.col("until") - 1).alias("hi"), F.col("value").alias(value_col))


def check_ranges(ranges: DataFrame) -> None:
    """Read the whole table once and raise if ranges cross, are inverted or leave
    the address space (lookups raise too, while they run)."""
    value = next(c for c in ranges.columns if c not in ("lo", "hi"))
    innermost(ranges.select(F.col("lo").alias("num")).distinct(), ranges, value).write.format("noop").mode("overwrite").save()


def range_lookup(df: DataFrame, ip_col: str, ranges: DataFrame, value_col: str, out_col: str) -> DataFrame:
    """Append ``out_col``: the ``value_col`` of the most specific range that holds
    ``ip_col``; null where there is none or the address is malformed.

    The sweep sees every distinct address once; the answers are joined back on
    the integer address, and AQE broadcasts them when their measured size
    allows or splits a hot address.
    """
    keyed, num = net.with_addr_num(df, ip_col)
    points = keyed.select(num.alias("num")).where(F.col("num").isNotNull()).distinct()
    found = innermost(points, ranges, value_col).where(F.col("value").isNotNull())
    answers = found.select(F.col("num").alias("_num"), F.col("value").alias("_value"))
    joined = keyed.join(answers, num == F.col("_num"), "left")
    return joined.select(*[c for c in df.columns if c != out_col], F.col("_value").alias(out_col))


def geo_country(flows: DataFrame, geo: DataFrame, cidr: str = net.DEFAULT_CIDR) -> DataFrame:
    """``dst_cc`` for every flow: null for internal destinations, '' for unknown
    external. Internal flows take no part in the lookup and are not shuffled.
    Where flows are aggregated anyway, ``country_edges`` does far less."""
    keyed, num = net.with_addr_num(flows, "dst_ip")
    outside = net.outside_cidr(num, cidr)
    looked = range_lookup(keyed.where(outside), "dst_ip", geo, "cc", "dst_cc")
    external = looked.withColumn("dst_cc", F.coalesce("dst_cc", F.lit("")))
    internal = keyed.where(~outside).withColumn("dst_cc", F.lit(None).cast("string"))
    return external.unionByName(internal).select(*[c for c in flows.columns if c != "dst_cc"], "dst_cc")


def geo_org(flows: DataFrame, asn: DataFrame) -> DataFrame:
    """``dst_org``: the organisation of the destination, null if unknown."""
    return range_lookup(flows, "dst_ip", asn, "org", "dst_org")


#: What an edge can carry, as aggregates over its flows.
MEASURES = {"up_bytes": F.sum, "down_bytes": F.sum, "first_flow_id": F.min}
UNKNOWN = -1  # stands for a malformed destination, so that the key is never null


def external_edges(flows: DataFrame, cidr: str = net.DEFAULT_CIDR, measures=()) -> DataFrame:
    """One row per (period, source, external destination ``dst_ip``, ``dst_num``),
    with ``flow_count`` and the named ``measures``. Internal flows are pruned by
    the scan."""
    keyed, num = net.with_addr_num(flows, "dst_ip")
    keys = ["period", "src_ip", "dst_ip", F.coalesce(num, F.lit(UNKNOWN)).alias("dst_num")]
    outside = keyed.where(net.outside_cidr(num, cidr))
    aggs = [MEASURES[m]("flow_id" if m == "first_flow_id" else m).alias(m) for m in measures]
    return shared(outside.groupBy(*keys).agg(flow_sum(flows).alias(WEIGHT), *aggs), WEIGHT, *measures)


def with_country(edges: DataFrame, geo: DataFrame, *, many_readers: bool = False) -> DataFrame:
    """``edges`` with ``dst_cc``, '' where unknown: every distinct destination is
    looked up once. The edges are read twice, for their destinations and for
    themselves, by plans that share the aggregate and with it the scan.
    ``many_readers`` fixes the join (by sorting, hot destinations split by AQE), so
    that readers of the result can share it too: a join that AQE changes while the
    query runs differs from reader to reader."""
    found = innermost(edges.select(F.col("dst_num").alias("num")).distinct(), geo, "cc").where(F.col("value").isNotNull())
    dimension = found.select(F.col("num").alias("_num"), F.col("value").alias("_cc"))
    if many_readers:
        dimension = dimension.hint("merge")
    return (edges.join(dimension, F.col("dst_num") == F.col("_num"), "left")
            .select(*edges.columns, F.coalesce("_cc", F.lit("")).alias("dst_cc")))


def country_edges(flows: DataFrame, geo: DataFrame, cidr: str = net.DEFAULT_CIDR, measures=()) -> DataFrame:
    """``external_edges`` with ``dst_cc``: aggregate below the lookup, look up each
    destination once, aggregate again above it. Every operator that takes flows
    with countries and sums, counts distinct values or tests presence takes
    these rows instead."""
    return with_country(external_edges(flows, cidr, measures), geo)


def _destination_values(flows: DataFrame, keep: Column, ranges: DataFrame, value_col: str) -> DataFrame:
    """``value`` of each distinct destination among the flows that ``keep`` selects."""
    keyed, num = net.with_addr_num(flows, "dst_ip")
    return innermost(keyed.where(keep).select(num.alias("num")).distinct(), ranges, value_col).select("value")


def destination_countries(flows: DataFrame, geo: DataFrame, cidr: str = net.DEFAULT_CIDR) -> DataFrame:
    """``dst_cc`` of every distinct external destination (D14, D48): '' where unknown."""
    outside = net.outside_cidr(net.addr_num(flows, "dst_ip"), cidr)
    return _destination_values(flows, outside, geo, "cc").select(F.coalesce("value", F.lit("")).alias("dst_cc"))


def destination_orgs(flows: DataFrame, asn: DataFrame) -> DataFrame:
    """``dst_org`` of every distinct destination (D15): null where unknown."""
    return _destination_values(flows, F.lit(True), asn, "org").select(F.col("value").alias("dst_org"))
