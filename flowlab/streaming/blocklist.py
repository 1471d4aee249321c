"""A6 on a stream: detections merged into the stored block list batch by batch.

The list is kept as one Parquet folder per micro-batch, ``batch=<id>``. A batch is
merged into the newest list of an earlier batch and written under its own id, so
a batch that is run again (a restarted driver, a lost commit) starts from the
same list and writes the same one. A folder without ``_SUCCESS`` is never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..schema import BLOCKLIST_SCHEMA
from ..session import ensure_checkpoint_dir
from ..sources.sinks import blocklist, detections
from ..sources.store import _completed, _fs

PREFIX = "batch="


def _lists(spark: SparkSession, path: str) -> dict[int, str]:
    return {int(p.rsplit(PREFIX, 1)[-1]): p for p in _completed(spark, f"{path.rstrip('/')}/{PREFIX}*")}


def read_blocklist(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest stored list (of a batch earlier than ``before``), or None."""
    found = {k: p for k, p in _lists(spark, path).items() if before is None or k < before}
    return spark.read.schema(BLOCKLIST_SCHEMA).parquet(found[max(found)]) if found else None


def merge_batch(found: DataFrame, batch_id: int, path: str) -> None:
    """Merge one batch of ``(ip, reason)`` into the list at ``path``, and drop the lists
    before the one it started from: this batch may run again, earlier ones don't."""
    spark = found.sparkSession
    merged = blocklist(found.select("ip", "reason").distinct(), existing=read_blocklist(spark, path, before=batch_id))
    merged.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{PREFIX}{batch_id}")
    earlier = {k: p for k, p in _lists(spark, path).items() if k < batch_id}
    for k in sorted(earlier)[:-1]:
        fs, folder = _fs(spark, earlier[k])
        fs.delete(folder, True)


def live_blocklist(spark: SparkSession, flagged: dict[str, str], path: str, checkpoint: str | None = None,
                   available_now: bool = False):
    """Start the merge of live detections: ``flagged`` names, per reason, the Parquet
    folder a live detector appends its windows to (its ``output_path``, which must
    exist); the list grows at ``path``."""
    def stream(reason: str, folder: str) -> DataFrame:
        return detections(spark.readStream.schema("src_ip string").parquet(folder), reason)

    found = reduce(DataFrame.unionByName, [stream(r, f) for r, f in sorted(flagged.items())])
    writer = (found.writeStream.option("checkpointLocation", checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/flowlab-streams/blocklist")
              .foreachBatch(lambda df, batch_id: merge_batch(df, batch_id, path)))
    return (writer.trigger(availableNow=True) if available_now else writer).start()

