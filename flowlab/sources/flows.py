"""Flow sources (A1, A2) and the adapter deriving flows from ``events``.

Stored flows are one Parquet dataset per period. At scale the preferred layout
is one dataset written ``partitionBy('period')``; ``read_flows`` on such a
directory gets partition pruning for free when a query filters on ``period``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import fresh, idiv
from ..functions.net import ip_to_num
from ..schema import BASELINE, FLOW_COLUMNS, FLOW_FILE_SCHEMA, NUM_COLUMNS, TEST


def read_flows(spark: SparkSession, path: str, period: str | None = None) -> DataFrame:
    """A1: scan a flow Parquet dataset, its columns cast to the flow schema.

    A directory written with ``partitionBy('period')`` keeps its partition
    column; single-period files get ``period`` as a literal. Files without
    ``flow_id`` get it from their order (``with_file_order``).
    """
    df = spark.read.parquet(path)
    present = set(df.columns)
    if period is None and "period" not in present:
        raise ValueError(f"flow dataset {path} lacks columns ['period']")
    fields = [f for f in FLOW_FILE_SCHEMA.fields if f.name != "flow_id"]
    missing = [f.name for f in fields if f.name not in present]
    if missing:
        raise ValueError(f"flow dataset {path} lacks columns {missing}")
    if "flow_id" not in present:
        index = next((c for c in PANDAS_INDEX_COLUMNS if c in present), None)
        if index and len(df.inputFiles()) == 1:
            df = df.withColumn("flow_id", F.col(index))
        else:
            df = with_file_order(df, "flow_id", by=[] if period is not None else ["period"])
    df = df.withColumn("period", F.lit(period)) if period is not None else df
    # read as stored, then cast: writers differ in integer widths
    cols = [F.col("flow_id").cast("bigint").alias("flow_id"), "period", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]]
    return df.select(*cols, *[c for c in NUM_COLUMNS if c in present]).select(*FLOW_COLUMNS, *[c for c in NUM_COLUMNS if c in present])


# Where pandas keeps a frame's row index in Parquet, in order of preference. It
# numbers the rows of one file, so it serves where there is one.
PANDAS_INDEX_COLUMNS = ("__index_level_0__", "index")


def file_offsets(files: DataFrame, by=()) -> DataFrame:
    """``(file, offset)``, one row per file of a table read from files: how many rows
    lie in the files before it, in order of their paths (for each value of the
    partition columns ``by``)."""
    by = list(by)
    sizes = (files.select(*by, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
             .groupBy(*by, "file").agg((F.max("at") + 1).alias("n")))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def with_file_order(files: DataFrame, name: str, by=(), offsets: DataFrame | None = None) -> DataFrame:
    """``files``, a table read from files, with ``name``: each row's position, files
    in order of their paths and rows as they lie in a file, from 0 on (for each
    value of the partition columns ``by``).

    A file's rows are numbered by the reader (``_metadata.row_index``); the rows of
    the files before it are a running sum over one row per file (``offsets``, made
    here unless given). So the numbers depend on the files alone, not on how a scan
    splits them.
    """
    file, at, of, offset = (fresh(files.columns, x) for x in ("_file", "_at", "_of", "_offset"))
    placed = files.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
    known = (file_offsets(files, by) if offsets is None else offsets).select(F.col("file").alias(of), F.col("offset").alias(offset))
    # one row per file, which the driver lists anyway
    joined = placed.join(F.broadcast(known), F.col(file) == F.col(of))
    return joined.select(*files.columns, (F.col(offset) + F.col(at)).alias(name))


def read_periods(spark: SparkSession, baseline_path: str, test_path: str) -> DataFrame:
    """A2: baseline and test files as one frame with a ``period`` column."""
    return read_flows(spark, baseline_path, BASELINE).unionByName(
        read_flows(spark, test_path, TEST))


def with_address_numbers(flows: DataFrame) -> DataFrame:
    """Parse both addresses once, at ingest; CIDR and range predicates then
    compare integers (and reach Parquet's min/max statistics)."""
    todo = {f"{c}_num": ip_to_num(c) for c in ("src_ip", "dst_ip") if f"{c}_num" not in flows.columns}
    return flows.withColumns(todo) if todo else flows


def write_flows(flows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store flows partitioned by period (the layout ``read_flows`` prunes),
    with the addresses parsed into ``src_ip_num``/``dst_ip_num``.

    Rows are sorted by (src_ip, dst_ip) inside each task before writing (no
    shuffle; the writer sorts by period anyway), so Parquet row-group min/max
    statistics let host ``IN`` and prefix filters skip row groups.
    """
    (with_address_numbers(flows).sortWithinPartitions("period", "src_ip", "dst_ip")
     .write.mode(mode).partitionBy("period").parquet(path))


def _pick(key: Column, mapping: dict[int, object]) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr


def flows_from_events(events: DataFrame) -> DataFrame:
    """Derive one flow per event by modular arithmetic (FIXTURES.md section 2).

    A pure projection: no shuffle, runs inside one codegen stage, and reads
    only ``event_id, ts, user_id, value`` from the events scan.
    """
    e = F.col("event_id")
    h = F.col("user_id") % 20
    is_test = F.col("period") == TEST
    day = F.dayofmonth("ts")

    step1 = events.select(
        e.alias("e"),
        h.alias("h"),
        F.col("ts"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    ).withColumn(
        "period",
        F.when(F.col("h") == 7, F.when(F.col("e") % 6 == 0, BASELINE).otherwise(TEST))
        .when(F.dayofmonth("ts") <= 15, BASELINE).otherwise(TEST),
    )
    e, h = F.col("e"), F.col("h")
    step2 = step1.withColumn(
        "kind",
        F.when(h.isin(3, 11, 17) & (e % 10 == 9) & is_test, "peer")
        .when(e % 8 < 6, "server").otherwise("ext"),
    )
    q = idiv(e, 8)
    step3 = step2.withColumn(
        "g",
        F.when(is_test & (h == 13), q % 12)
        .when(is_test & (h == 14), 8 + q % 4)
        .otherwise(q % 4),
    )
    kind, g = F.col("kind"), F.col("g")
    server, ext = kind == "server", kind == "ext"
    mult = (F.when(ext & is_test & (h == 5), 40)
            .when(ext & is_test & (h == 14) & (g >= 10), 20)
            .when(server & (e % 2 == 0) & is_test & (h == 9), 3)
            .otherwise(1))
    port = F.when(server & (e % 2 == 0), 53).otherwise(443)
    step4 = step3.select(
        "*",
        F.when((server & (e % 2 == 0)) | (ext & (e % 5 == 0)), "udp").otherwise("tcp").alias("proto"),
        port.cast("int").alias("port"),
        ((100 + F.col("cents")) * mult).cast("bigint").alias("up_bytes"),
    )
    ts = F.col("ts")
    timestamp = (((day - 1) % 15) * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
                 + F.second(ts)) * 100 + e % 100
    prefix = F.lit("192.168.109.")
    server_host = _pick(e % 4, {0: 224, 1: 225, 2: 227, 3: 230})
    ext_ip = F.concat_ws(".", (20 + g).cast("string"), (e % 7).cast("string"),
                         (h % 5).cast("string"), (1 + e % 3).cast("string"))
    first_peer = e % 20 == 9
    peer_host = (F.when(h == 3, F.when(first_peer, 12).otherwise(18))
                 .when(h == 11, F.when(first_peer, 4).otherwise(18))
                 .otherwise(F.when(first_peer, 4).otherwise(12)))
    dst_ip = (F.when(server, F.concat(prefix, server_host.cast("string")))
              .when(ext, ext_ip)
              .otherwise(F.concat(prefix, peer_host.cast("string"))))
    down = F.when(F.col("port") == 53, F.floor(F.col("up_bytes") * 23 / 10.0)) \
        .otherwise(500 + 8 * F.col("cents"))
    return step4.select(
        e.alias("flow_id"),
        "period",
        timestamp.cast("bigint").alias("timestamp"),
        F.concat(prefix, (h + 1).cast("string")).alias("src_ip"),
        dst_ip.alias("dst_ip"),
        "proto",
        "port",
        "up_bytes",
        down.cast("bigint").alias("down_bytes"),
    )


def events_path(sf_dir: str) -> str:
    return f"{sf_dir.rstrip('/')}/events.parquet"


def derive_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of a test-data scale factor, derived on the fly from ``events``."""
    events = spark.read.parquet(events_path(sf_dir)).select("event_id", "ts", "user_id", "value")
    return flows_from_events(events)


def derived_flow_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Paths of a scale factor's baseline and test flows as a capture tool leaves
    them: several Parquet files each, in flow order, without ids or period.
    Written once beside the stored flow table."""
    from .store import flows_table_path, read_flow_table, table_path
    source = flows_table_path(spark, sf_dir)

    def write(period: str):
        def run(path: str) -> None:
            flows = read_flow_table(spark, source).where(F.col("period") == period)
            ordered = flows.repartitionByRange(5, "flow_id").sortWithinPartitions("flow_id")
            ordered.select(*[f.name for f in FLOW_FILE_SCHEMA.fields if f.name != "flow_id"]).write.parquet(path)
        return run

    return tuple(table_path(spark, f"files-{p}", source, write(p)) for p in (BASELINE, TEST))


def load_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of a scale factor as a stored, period-partitioned table
    (materialised once in the checkpoint folder, see ``store``)."""
    from .store import flows_table
    return flows_table(spark, sf_dir)
