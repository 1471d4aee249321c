"""Materialised flow tables in the shared checkpoint folder.

Deriving flows from ``events`` is one narrow projection. Queries, though,
should read flows the way a deployment stores them: Parquet partitioned by
``period``, so predicates on addresses, protocol and port reach the scan as
pushed filters and ``period`` prunes whole directories. The derived table is
written once per source file (keyed by path, size and modification time) to
``spark.checkpoint.dir``, a folder every executor can read, and reused by all
later queries and sessions; a partial write has no ``_SUCCESS`` marker and is
never read.
"""

from __future__ import annotations

import hashlib
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..schema import FLOW_COLUMNS, FLOW_SCHEMA, NUM_COLUMNS
from ..session import ensure_checkpoint_dir
from .flows import events_path, flows_from_events, write_flows

ADAPTER_VERSION = "3"
_LOCK = threading.Lock()
_PATHS: dict[tuple[str, str], str] = {}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the application ends."""
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _source_key(spark: SparkSession, src: str) -> str:
    """Identity of the source data: a file by size and mtime; a directory (a
    multi-file dataset) by total bytes, file count and newest file."""
    fs, p = _fs(spark, src)
    st = fs.getFileStatus(p)
    if st.isDirectory():
        summary = fs.getContentSummary(p)
        newest, files = 0, fs.listFiles(p, True)
        while files.hasNext():
            newest = max(newest, files.next().getModificationTime())
        stamp = f"{summary.getLength()}|{summary.getFileCount()}|{newest}"
    else:
        stamp = f"{st.getLen()}|{st.getModificationTime()}"
    ident = f"{fs.makeQualified(p).toString()}|{stamp}|{ADAPTER_VERSION}"
    return hashlib.sha1(ident.encode()).hexdigest()[:16]


def _completed(spark: SparkSession, pattern: str) -> list[str]:
    """Table folders matching ``pattern`` whose write committed (``_SUCCESS``)."""
    fs, p = _fs(spark, f"{pattern}/_SUCCESS")
    found = fs.globStatus(p) or []
    return sorted(st.getPath().getParent().toString() for st in found)


def flows_table_path(spark: SparkSession, sf_dir: str) -> str:
    """Path of the materialised flows of ``sf_dir``; written on first use.

    Every writer uses its own folder ``flows-<key>-<id>``; a reader takes any
    committed one. Concurrent sessions can at worst write the table twice,
    never into each other's files, and an interrupted write (no
    ``_SUCCESS``) is never read.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    src = events_path(sf_dir)
    key = _source_key(spark, src)
    with _LOCK:
        cached = _PATHS.get((base, key))
        if cached and _exists(spark, f"{cached}/_SUCCESS"):
            return cached
        done = _completed(spark, f"{base}/flowlab-tables/flows-{key}-*")
        if done:
            path = done[0]
        else:
            path = f"{base}/flowlab-tables/flows-{key}-{uuid.uuid4().hex[:12]}"
            events = spark.read.parquet(src).select("event_id", "ts", "user_id", "value")
            write_flows(flows_from_events(events), path)
        _PATHS[(base, key)] = path
        return path


def table_path(spark: SparkSession, name: str, source: str, write) -> str:
    """Path of the table ``name`` made from ``source``; ``write(path)`` makes it on
    first use, under the same rules as the flow table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    key = hashlib.sha1(f"{source.rstrip('/').rsplit('/', 1)[-1]}|{ADAPTER_VERSION}".encode()).hexdigest()[:16]
    pattern = f"{base}/flowlab-tables/{name}-{key}-*"
    with _LOCK:
        if not _completed(spark, pattern):
            write(f"{base}/flowlab-tables/{name}-{key}-{uuid.uuid4().hex[:12]}")
        return _completed(spark, pattern)[0]


def read_flow_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FLOW_SCHEMA).parquet(path).select(*FLOW_COLUMNS, *NUM_COLUMNS)


_FRAMES: dict[str, tuple[SparkSession, DataFrame]] = {}


def flows_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored flows as a DataFrame, shared by all queries of a session
    (DataFrames are immutable; sharing one keeps one file listing)."""
    path = flows_table_path(spark, sf_dir)
    with _LOCK:
        owner, df = _FRAMES.get(path, (None, None))
        if owner is not spark:
            df = read_flow_table(spark, path)
            _FRAMES[path] = (spark, df)
        return df
