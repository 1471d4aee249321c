"""Best-fit packing of tokenised documents into sequences.

``pieces`` encodes every document and cuts only those longer than a sequence.
``pack`` is a vector best-fit: a piece needs (tokens, one document slot, its
squared length as attention cost), a sequence has a capacity of each, and of the
sequences in which all three fit the one is taken whose residual vector suits
best, by the norm of what would be left (``norm``) or by the dot product of need
and residual (``dot``), weighted per dimension. Pieces come largest first.

Pieces that fill a sequence stand alone. The others are dealt by a hash of
their key into shards of about ``shard_pieces`` and each shard is packed in one
task; a shard leaves at most a few sequences part empty, out of hundreds.
The same input always gives the same packing, so a lost task can be repeated.

Defined results: a null or empty text is one piece holding only the end token;
texts are read whole; repeated rows are pieces of their own with equal keys;
an empty table gives no pieces.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, sections_of, word_store
from .common import release_memory, small_batches, stored

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(64)]


def id_bytes(ids: list[int]) -> bytes:
    """The ids as little-endian unsigned 32-bit numbers."""
    return _PACKERS[len(ids)](*ids) if len(ids) < len(_PACKERS) else struct.pack(f"<{len(ids)}I", *ids)


def pieces(df: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece of each document's ids followed by ``end_id``; ``row``
    tells apart rows of equal ``doc_id``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(tokenizer_path)
        store = word_store(tokenizer_path, "bytes", id_bytes)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            at = 0
            ids, marks = batch.doc_id.tolist(), batch.row.tolist()
            for part in sections_of(bpe, store, batch.text.tolist()):
                for got in part:
                    data = b"".join(map(store.__getitem__, got)) + end
                    n = len(data) // 4
                    for k, start in enumerate(range(0, n, capacity)):
                        cut = data[4 * start:4 * (start + capacity)]
                        rows.append((ids[at], marks[at], k, start, len(cut) // 4, zlib.crc32(cut)))
                    at += 1
            yield pd.DataFrame(rows, columns=["doc_id", "row", "piece", "start", "length", "ids_crc32"])
        release_memory(keep="bpe")

    marked = df.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return small_batches(marked).mapInPandas(run, PIECES)


def fill(needs: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str) -> np.ndarray:
    """The bin of each item; items in the order given. Ties go to the oldest bin."""
    scaled = needs / capacity
    weights = np.asarray(weights, float)
    left = np.empty((64, needs.shape[1]))
    used = 0
    bins = np.empty(len(needs), np.int64)
    open_bins = np.empty(0, np.int64)
    smallest = np.minimum.accumulate(scaled[::-1], axis=0)[::-1] if len(scaled) else scaled
    eps = 1e-12
    for i, x in enumerate(scaled):
        if i % 256 == 0 and len(open_bins):  # bins in which no later item fits
            open_bins = open_bins[(left[open_bins] + eps >= smallest[i]).all(axis=1)]
        rest = left[open_bins] - x
        fits = np.flatnonzero((rest >= -eps).all(axis=1))
        if len(fits):
            r = rest[fits]
            value = -(r * r) @ weights if rule == "norm" else ((r + x) * x) @ weights
            b = open_bins[fits[int(value.argmax())]]
        else:
            if used == len(left):
                left = np.vstack([left, np.empty_like(left)])
            b, used = used, used + 1
            left[b] = 1.0
            open_bins = np.append(open_bins, b)
        left[b] -= x
        bins[i] = b
    return bins


def pack(parts: DataFrame, *, capacity: int = 4096, max_documents: int | None = None,
         max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
         rule: str = "norm", shard_pieces: int = 16_384) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces.

    ``max_documents`` and ``max_attention`` default to what a sequence full of
    tokens can need at most, so that by default only tokens bind.
    """
    limits = np.array([capacity, max_documents or capacity, max_attention or capacity * capacity], float)
    if rule not in ("norm", "dot"):
        raise ValueError(f"rule {rule!r}")
    if parts.filter((F.col("length") > limits[0]) | (F.col("length") * F.col("length") > limits[2])).limit(1).count():
        raise ValueError("a piece exceeds the capacity of an empty sequence")
    spark = parts.sparkSession
    n = parts.filter(F.col("length") < capacity).count()
    shards = max(1, math.ceil(n / shard_pieces))
    whole = (parts.filter(F.col("length") == capacity)
             .withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_memory()
        got = [b for b in batches if len(b)]
        if not got:
            return
        every = pd.concat(got)
        for shard, rows in every.groupby("shard", sort=True):
            rows = rows.sort_values(["length", "doc_id", "row", "piece"], ascending=[False, True, True, True])
            size = rows.length.to_numpy()
            bins = fill(np.stack([size, np.ones(len(size)), size.astype(float) ** 2], 1), limits, np.array(weights), rule)
            order = np.argsort(bins, kind="stable")
            total = np.cumsum(size[order]) - size[order]
            first = np.r_[True, bins[order][1:] != bins[order][:-1]]
            offset = np.empty(len(size), np.int64)
            offset[order] = total - np.maximum.accumulate(np.where(first, total, 0))
            yield rows.drop(columns="shard").assign(sequence_id=((bins * shards + shard) * 2), offset=offset)

    schema = PIECES + ", sequence_id long, offset long"
    dealt = (parts.filter(F.col("length") < capacity)
             .withColumn("shard", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(shards)))
             .repartition(shards, "shard").mapInPandas(run, schema))
    return whole.select(*dealt.columns).unionByName(dealt)


def pack_documents(df: DataFrame, tokenizer_path: str, *, capacity: int = 4096, **options) -> DataFrame:
    """Encode, cut and pack whole documents; the pieces are stored in between."""
    parts = stored(pieces(df, tokenizer_path, capacity=capacity), "pieces")
    return pack(parts, capacity=capacity, **options).drop("row")
