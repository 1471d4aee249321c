"""Per-host detector aggregates on Structured Streaming.

Test-period flows arrive as files; per event-time tumbling window (with a
watermark, so window state is dropped once late data can no longer arrive)
each source's traffic is aggregated and compared with that source's baseline
profile, a static frame computed once from stored baseline flows (a
stream-static join):

* exfiltration: average internet bytes per flow above ``factor`` x baseline;
* C2 growth: flows to internal hosts above the baseline rate for the window
  length by more than ``min_increase`` %;
* fan-out: more distinct internal destinations than ``min_fanout`` (the set
  per window and source is bounded by the size of the internal block).

Event time is ``period_start + ticks / 100`` seconds. The query checkpoint
lives under the session's shared ``spark.checkpoint.dir``, so a restarted
driver resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import defaults as K
from ..functions import arith, net
from ..functions.timeparts import TICKS_PER_SECOND
from ..operators import filters as B
from ..schema import BASELINE, FLOW_COLUMNS, FLOW_FILE_SCHEMA, TEST
from ..session import ensure_checkpoint_dir


def read_flow_stream(spark: SparkSession, path: str, period: str = "test",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Flow files of one period as a stream (explicit schema, no inference)."""
    reader = spark.readStream.schema(FLOW_FILE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path).withColumn("period", F.lit(period)).select(*FLOW_COLUMNS)


def with_event_time(flows: DataFrame, period_start: str) -> DataFrame:
    start = F.unix_seconds(F.to_timestamp(F.lit(period_start)))
    return flows.withColumn(
        "event_time", F.timestamp_seconds(start + F.col("timestamp") / TICKS_PER_SECOND))


def windowed_host_rates(flows: DataFrame, period_start: str, window: str = "1 minute",
                        watermark: str = "10 minutes", net_prefix: str = net.DEFAULT_NET) -> DataFrame:
    """Internet flows, bytes and per-flow averages per (window, source)."""
    timed = with_event_time(B.to_internet_flows(flows, net_prefix), period_start)
    agg = (timed.withWatermark("event_time", watermark)
           .groupBy(F.window("event_time", window).alias("w"), "src_ip")
           .agg(F.count(F.lit(1)).alias("flows"), F.sum("up_bytes").alias("up_bytes"),
                F.sum("down_bytes").alias("down_bytes")))
    return agg.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "src_ip",
        "flows", "up_bytes", "down_bytes",
        arith.per_flow("up_bytes", "flows").alias("avg_up_bytes"),
        arith.per_flow("down_bytes", "flows").alias("avg_down_bytes"))


def baseline_profile(baseline: DataFrame, net_prefix: str = net.DEFAULT_NET) -> DataFrame:
    """Static per-source baseline: average internet bytes per flow."""
    base = B.to_internet_flows(B.in_period(baseline, BASELINE), net_prefix)
    agg = base.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"), F.sum("up_bytes").alias("u"),
                                     F.sum("down_bytes").alias("d"))
    return agg.select("src_ip", arith.per_flow("u", "n").alias("avg_up_bytes_normal"),
                      arith.per_flow("d", "n").alias("avg_down_bytes_normal"))


def flag_windows(rates: DataFrame, profile: DataFrame, factor: float = K.PERIOD_FACTOR) -> DataFrame:
    """Windows whose average up or down bytes per flow exceed ``factor`` x the
    source's baseline (sources without a baseline drop out, as in R7)."""
    joined = rates.join(profile, "src_ip")
    return joined.where((F.col("avg_up_bytes") > F.col("avg_up_bytes_normal") * factor)
                        | (F.col("avg_down_bytes") > F.col("avg_down_bytes_normal") * factor))


def windowed_internal_contacts(flows: DataFrame, period_start: str, window: str = "1 minute",
                               watermark: str = "10 minutes", net_prefix: str = net.DEFAULT_NET) -> DataFrame:
    """Flows to internal hosts per (window, source)."""
    timed = with_event_time(flows.where(net.in_prefix("dst_ip", net_prefix)), period_start)
    agg = (timed.withWatermark("event_time", watermark)
           .groupBy(F.window("event_time", window).alias("w"), "src_ip")
           .agg(F.count(F.lit(1)).alias("counts_window")))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "src_ip", "counts_window")


def baseline_contact_rate(baseline: DataFrame, net_prefix: str = net.DEFAULT_NET) -> DataFrame:
    """Static per-source baseline: flows to internal hosts and flows per second
    of the baseline's observed span."""
    base = B.in_period(baseline, BASELINE)
    span = base.agg(((F.max("timestamp") - F.min("timestamp")) / TICKS_PER_SECOND + 1).alias("s"))
    seconds = span.select("s").scalar()
    inside = base.where(net.in_prefix("dst_ip", net_prefix)).groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("counts"))
    return inside.select("src_ip", "counts", (F.col("counts") / seconds).alias("rate_per_second"))


def flag_contact_growth(contacts: DataFrame, rates: DataFrame, window_seconds: int,
                        min_increase: float = K.C2_MIN_INCREASE,
                        min_baseline: int = K.C2_MIN_BASELINE) -> DataFrame:
    """Windows whose internal contacts exceed the baseline rate for the window
    by more than ``min_increase`` %; baseline counts above ``min_baseline``."""
    joined = contacts.join(rates, "src_ip")
    expected = F.col("rate_per_second") * window_seconds
    return (joined.withColumn("increase", (F.col("counts_window") - expected) / expected * 100)
            .where((F.col("increase") > min_increase) & (F.col("counts") > min_baseline)))


def windowed_fanout(flows: DataFrame, period_start: str, window: str = "1 minute",
                    watermark: str = "10 minutes", cidr: str = net.DEFAULT_CIDR) -> DataFrame:
    """Distinct internal destinations per (window, source): duplicates are
    dropped by key, then counted, so state is one row per (window, source,
    destination), spread by key, and no group is held as one value."""
    inside = flows.where(net.in_cidr("dst_ip", cidr))
    timed = with_event_time(inside, period_start).withWatermark("event_time", watermark)
    agg = (timed.select(F.window("event_time", window).alias("w"), "src_ip", "dst_ip").dropDuplicates()
           .groupBy("w", "src_ip").agg(F.count(F.lit(1)).alias("n_peers")))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "src_ip", F.col("n_peers").cast("bigint").alias("n_peers"))


def _start(df: DataFrame, spark: SparkSession, output_path: str, available_now: bool, checkpoint: str | None):
    """Append finished windows to Parquet files at ``output_path`` (exactly once
    with the checkpoint)."""
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/flowlab-streams/{output_path.strip('/').replace('/', '_')}"
    writer = (df.writeStream.outputMode("append").option("checkpointLocation", ckpt)
              .format("parquet").option("path", output_path))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def live_exfiltration(spark: SparkSession, stream_path: str, baseline: DataFrame, period_start: str,
                      output_path: str, factor: float = K.PERIOD_FACTOR, window: str = "1 minute",
                      watermark: str = "10 minutes", net_prefix: str = net.DEFAULT_NET,
                      available_now: bool = False, checkpoint: str | None = None):
    """Start the streaming exfiltration detector; flagged windows are appended
    as Parquet to ``output_path``."""
    profile = baseline_profile(baseline, net_prefix).cache()
    rates = windowed_host_rates(read_flow_stream(spark, stream_path, TEST), period_start, window,
                                watermark, net_prefix)
    return _start(flag_windows(rates, profile, factor), spark, output_path, available_now, checkpoint)


def live_c2_growth(spark: SparkSession, stream_path: str, baseline: DataFrame, period_start: str,
                   output_path: str, window_seconds: int = 60, watermark: str = "10 minutes",
                   min_increase: float = K.C2_MIN_INCREASE, min_baseline: int = K.C2_MIN_BASELINE,
                   net_prefix: str = net.DEFAULT_NET,
                   available_now: bool = False, checkpoint: str | None = None):
    """Start the streaming C2-growth detector (see ``flag_contact_growth``)."""
    rates = baseline_contact_rate(baseline, net_prefix).cache()
    contacts = windowed_internal_contacts(read_flow_stream(spark, stream_path, TEST), period_start,
                                          f"{window_seconds} seconds", watermark, net_prefix)
    flagged = flag_contact_growth(contacts, rates, window_seconds, min_increase, min_baseline)
    return _start(flagged, spark, output_path, available_now, checkpoint)


def live_fanout(spark: SparkSession, stream_path: str, period_start: str, output_path: str,
                min_fanout: int = K.MIN_FANOUT, window: str = "1 minute", watermark: str = "10 minutes",
                cidr: str = net.DEFAULT_CIDR, available_now: bool = False, checkpoint: str | None = None):
    """Start the streaming fan-out (botnet) detector."""
    fan = windowed_fanout(read_flow_stream(spark, stream_path, TEST), period_start, window, watermark, cidr)
    return _start(fan.where(F.col("n_peers") > min_fanout), spark, output_path, available_now, checkpoint)
