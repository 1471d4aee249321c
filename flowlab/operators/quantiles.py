"""Exact, interpolated quantiles by radix selection.

Spark's exact ``percentile`` merges every distinct value into one buffer for a
global aggregate. Here each wanted rank is narrowed down by 16 bits at a time:

1. minimum, maximum and count of each column (one row) say how many of the 64
   bits differ at all;
2. the values are counted by their highest 16 such bits; the running sum of at
   most 65,536 counts names the count that holds each wanted rank;
3. the values under that prefix are counted by the next 16 bits, and so on: four
   rounds, whatever the data. Every round is one partially aggregated count,
   and at most 65,536 numbers a rank are shuffled a task; distinct values never are.

All rounds make up one lazy plan. What is broadcast from round to round is one
row per column, quantile and side. Integers are ranked as 64-bit integers (exact
beyond 2^53), floating-point values by the order of their bits; NaN counts as
missing, as in pandas. Linear interpolation between the two ranks around
``p * (n - 1)``, as pandas ``quantile`` does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DESCRIBE_PERCENTILES = (0.25, 0.5, 0.75)
DIGIT_BITS, ROUNDS = 16, 4
_LOW_BITS = (1 << 63) - 1


def _is_fractional(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType, T.DecimalType))


def _to_key(df: DataFrame, col: str) -> Column:
    """A 64-bit integer in the order of the values; null for null and NaN."""
    c = F.col(col)
    if not _is_fractional(df, col):
        return c.cast("bigint")
    x = c.cast("double") + F.lit(0.0)  # -0.0 and 0.0 are one value
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x).cast("bigint")
    return F.when(x.isNotNull() & ~F.isnan(x), F.when(bits < 0, bits.bitwiseXOR(F.lit(_LOW_BITS))).otherwise(bits))


def _from_key(df: DataFrame, cols, key: Column, series: Column) -> Column:
    """The value of a key as a double."""
    fractional = [c for c in cols if _is_fractional(df, c)]
    if not fractional:
        return key.cast("double")
    bits = F.when(key < 0, key.bitwiseXOR(F.lit(_LOW_BITS))).otherwise(key)
    as_double = F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), F.coalesce(bits, F.lit(0))).cast("double")
    return F.when(series.isin(*fractional), F.when(key.isNotNull(), as_double)).otherwise(key.cast("double"))


def _shift(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value, by)


def _bits(x: Column) -> Column:
    """Number of bits up to the highest one set."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def _with_wanted(stats: DataFrame, probs) -> DataFrame:
    """``(series, p, side, frac, rank, shift, prefix)``: the ranks around each quantile,
    before any bit is known (``prefix`` is common to all values)."""
    n = F.col("n")
    at = [F.struct(F.lit(float(p)).alias("p"), (F.lit(float(p)) * (n - 1)).alias("pos")) for p in probs]
    rows = stats.where(n > 0).select("series", "n", _bits(F.col("mn").bitwiseXOR(F.col("mx"))).alias("shift"), "mn", F.explode(F.array(*at)).alias("at"))
    low = F.floor("at.pos").cast("bigint")
    frac = F.col("at.pos") - low
    sides = F.array(F.struct(F.lit(0).alias("side"), low.alias("rank")), F.struct(F.lit(1).alias("side"), F.least(low + 1, n - 1).alias("rank")))
    out = rows.select("series", F.col("at.p").alias("p"), frac.alias("frac"), "shift", "mn", F.explode(sides).alias("s"))
    # a shift by all 64 bits would be none: no bits are known, and none are asked
    prefix = F.when(F.col("shift") < 64, _shift(F.col("mn"), F.least("shift", F.lit(63)))).otherwise(F.lit(0))
    return out.select("series", "p", "s.side", "frac", "s.rank", "shift", prefix.alias("prefix"))


def _narrow(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``DIGIT_BITS`` more bits of its prefixes known and ranks
    counted from the first value under the longer prefix."""
    w = wanted.select(F.col("series").alias("_series"), *[c for c in wanted.columns if c != "series"])
    fits = F.when(F.col("shift") < 64, _shift(F.col("key"), F.least("shift", F.lit(63))) == F.col("prefix")).otherwise(True)
    next_shift = F.greatest(F.col("shift") - DIGIT_BITS, F.lit(0))
    # one row per column, quantile and side
    held = values.join(F.broadcast(w), (F.col("series") == F.col("_series")) & fits)
    target = ["series", "p", "side", "frac", "rank", "shift"]
    counts = held.groupBy(*target, _shift(F.col("key"), next_shift).alias("prefix")).agg(F.count(F.lit(1)).alias("c"))
    so_far = Window.partitionBy("series", "p", "side").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("before", F.sum("c").over(so_far) - F.col("c"))
    hit = ranked.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c")))
    return hit.select("series", "p", "side", "frac", (F.col("rank") - F.col("before")).alias("rank"), next_shift.alias("shift"), "prefix")


def _keys(df: DataFrame, cols) -> DataFrame:
    """``(series, key)`` of every value of every column."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("series"), _to_key(df, c).alias("key")) for c in cols])).alias("s"))
    return stacked.select("s.series", "s.key").where(F.col("key").isNotNull())


def order_statistics(df: DataFrame, cols, probs) -> DataFrame:
    """``(series, p, lower, upper, frac, value)``: for each column and quantile the two
    values around it as 64-bit keys (the values themselves for integers), and the
    interpolated value. A column without values has no rows."""
    cols = list(cols)
    values = _keys(df, cols)
    stats = values.groupBy("series").agg(F.min("key").alias("mn"), F.max("key").alias("mx"), F.count(F.lit(1)).alias("n"))
    wanted = _with_wanted(stats, probs)
    for _ in range(ROUNDS):
        wanted = _narrow(values, wanted)
    both = wanted.groupBy("series", "p", "frac").agg(
        F.max(F.when(F.col("side") == 0, F.col("prefix"))).alias("lower"), F.max(F.when(F.col("side") == 1, F.col("prefix"))).alias("upper"))
    lo, hi = (_from_key(df, cols, F.col(c), F.col("series")) for c in ("lower", "upper"))
    # equal neighbours need no step (and infinite ones allow none)
    value = F.when(F.col("lower") == F.col("upper"), lo).otherwise(lo + (hi - lo) * F.col("frac"))
    return both.select("series", "p", "lower", "upper", "frac", value.alias("value"))


def exact_quantiles(df: DataFrame, col: str, probs) -> dict[float, float | None]:
    """The quantiles of one column as a dict (None without values)."""
    found = {r.p: r.value for r in order_statistics(df, [col], probs).collect()}  # one row per quantile
    return {p: found.get(float(p)) for p in probs}


STATS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def describe(df: DataFrame, cols) -> DataFrame:
    """Count, mean, std, min, quartiles, max per column, as rows
    ``(stat, <col>...)`` like pandas ``describe``; one lazy plan."""
    cols = list(cols)
    clean = {c: F.when(~F.isnan(c), F.col(c)) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(c) for c in cols}
    moments = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(*[fn(clean[c]).cast("double").alias(f"{name}_{c}") for name, fn in moments.items() for c in cols])

    def line(stat: str) -> Column:
        return F.struct(F.lit(stat).alias("stat"), *[(F.col(f"{stat}_{c}") if stat in moments else F.lit(None).cast("double")).alias(c) for c in cols])

    basic = row.select(F.explode(F.array(*map(line, STATS))).alias("r")).select("r.*")
    label = reduce(lambda acc, p: acc.when(F.col("p") == p, f"{round(p * 100)}%"), DESCRIBE_PERCENTILES[1:],
                   F.when(F.col("p") == DESCRIBE_PERCENTILES[0], f"{round(DESCRIBE_PERCENTILES[0] * 100)}%"))
    ranked = order_statistics(df, cols, DESCRIBE_PERCENTILES).select(
        label.alias("stat"), *[F.when(F.col("series") == c, F.col("value")).alias(c) for c in cols])
    return basic.unionByName(ranked).groupBy("stat").agg(*[F.max(c).alias(c) for c in cols])
