"""Helpers shared by the text operators.

The operators tell rows apart by their place in the input and read it more than
once. ``with_row`` numbers the rows so that every pass gives a row the same
number: by file and row where the input is a table read from Parquet files (with
filters and projections at most), else by storing the input with its numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import fresh  # noqa: F401  (used by the operators)
from ..session import ensure_checkpoint_dir
from ..sources.flows import file_offsets, with_file_order
from ..sources.store import _fs, delete_at_end


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def text_column(name: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def id_fold(modulus: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % modulus, F.lit(0))


#: Plan nodes under which a row of a file stays that row.
_ROWWISE = ("Project", "Filter", "SubqueryAlias", "LogicalRelation")


def _read_from_parquet(df: DataFrame) -> bool:
    """Whether ``df`` is a Parquet table with filters and projections at most."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in _ROWWISE and node.children().size() == 1:
        node = node.children().head()
    if not node.nodeName().startswith("LogicalRelation") or node.children().size():
        return False
    return "parquet" in node.toString().lower() and "_metadata" not in {c.lower() for c in df.columns}


def with_row(df: DataFrame, name: str = "row") -> DataFrame:
    """``df`` with the number ``name`` of each row, the same in every pass however
    the scan is split; it grows with the place in the input."""
    if not _read_from_parquet(df):
        return stored(df.withColumn(name, F.monotonically_increasing_id()), "rows")
    return with_file_order(df, name, offsets=stored(file_offsets(df), "offsets"))


#: What a Python worker keeps between tasks, by owner: functions that let go of it.
KEPT: dict[str, Callable[[], None]] = {}


def release_memory(keep: str | None = None) -> None:
    """Let a Python worker let go of what it keeps (but for the owner ``keep``), and give
    freed memory back to the system: workers live on between tasks and operators,
    beside the executor's own heap."""
    import ctypes

    import pyarrow as pa

    for owner, forget in KEPT.items():
        if owner != keep:
            forget()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


_BATCH, _DEFAULT, _BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session sends Python at most 4 MB at once where it is not set
    otherwise. Texts are held several times over in an executor and its workers,
    and Spark's 64 MB of them are too much for small ones; short rows still come
    by the thousand."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) == _DEFAULT:
        conf.set(_BATCH, _BYTES)
    return df


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned and that nothing reads any more."""
    for table in tables:
        folder = getattr(table, "_stored_at", None)
        if folder:
            fs, path = _fs(table.sparkSession, folder)
            fs.delete(path, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read
    it back: lineage ends there, and a lost executor costs only its own tasks.

    Tables live under ``flowlab-llm/<application id>``; operators drop those that
    are read no more (``drop_tables``), and the rest go when the application ends.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/flowlab-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    delete_at_end(spark, path)
    # what was shuffled for the table is read by nothing else: its files go once it is written
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    if _SCOPE is not None:
        _SCOPE.append(table)
    return table


_SCOPE: list[DataFrame] | None = None


class Scope:
    """The tables stored inside a ``with`` block, to be dropped together when the
    block's result has been written: ``previous.drop()``."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __enter__(self) -> Scope:
        global _SCOPE
        self._outer, _SCOPE = _SCOPE, self.tables
        return self

    def __exit__(self, *_) -> None:
        global _SCOPE
        _SCOPE = self._outer

    def drop(self) -> None:
        drop_tables(*self.tables)
        self.tables.clear()
