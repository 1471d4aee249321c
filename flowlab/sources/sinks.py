"""Sinks: CSV results (A5) and the merged block list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A5: header, no index; ``\\N`` marks null so '' and 'NA' stay distinct."""
    (df.write.mode(mode).option("header", True).option("nullValue", "\\N")
     .option("emptyValue", '""').csv(path))


def read_csv_result(spark, path: str, schema) -> DataFrame:
    return (spark.read.schema(schema).option("header", True)
            .option("nullValue", "\\N").option("emptyValue", "").csv(path))


def detections(df: DataFrame, reason: str, ip_col: str = "src_ip") -> DataFrame:
    """One detector's flagged addresses as ``(ip, reason)`` rows."""
    return df.select(F.col(ip_col).alias("ip"), F.lit(reason).alias("reason")).where(F.col("ip").isNotNull())


def blocklist(*flagged: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Merge ``(ip, reason)`` frames (and an existing list) idempotently.

    Output ``(ip, reasons)`` with reasons sorted and de-duplicated, so merging
    the same detections twice yields the same list. The reason set per address
    is bounded by the number of detectors, so the array stays small.
    """
    parts = list(flagged)
    if existing is not None:
        parts.append(existing.select("ip", F.explode("reasons").alias("reason")))
    if not parts:
        raise ValueError("blocklist needs at least one detection frame")
    merged = reduce(DataFrame.unionByName, parts)
    return merged.groupBy("ip").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def write_blocklist(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
