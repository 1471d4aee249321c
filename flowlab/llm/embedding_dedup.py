"""Embedding near-dedup by iterative quantisation.

``fit`` learns, on a bounded sample, principal axes and a rotation of them that
makes the signs of the rotated coordinates the best balanced binary code
(several codes, each from its own start). Every vector is coded. Codes are cut
into substrings, each a table of a multi-index; a vector looks up its own
substrings and all at one flipped bit. Pairs whose first ``n_codes`` codes are
close enough in Hamming distance are then compared exactly, in double precision,
with the original vectors. Equal vectors are one class throughout and are
counted, not paired.

The sample (``sample`` vectors, lowest hash of the id first) only shapes the
codes; every vector is indexed and looked up. Substrings grow with the number of
vectors, so that buckets stay small, and the number of codes follows: it grows
until the tables meet the share ``found`` of pairs at the limit, as counted on
sample pairs in the coded space. Where ``MOST_CODES`` are not enough, substrings
get shorter, which costs more comparisons but no pairs.

Defined results: vectors that are null, empty, zero, of another length than
most, or with null or non-finite components are linked with nothing; repeated
rows are classes of their own size; a null id can never be the smallest; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, with_row
from .graph import components


MOST_CODES = 32


@dataclass(frozen=True)
class Codes:
    """Mean, principal axes of centred unit vectors, and per code a rotation of them."""
    mean: np.ndarray
    axes: np.ndarray
    turns: tuple[np.ndarray, ...]

    def of(self, x: np.ndarray) -> list[np.ndarray]:
        """One boolean matrix per code, a column for each bit."""
        v = (x - self.mean) @ self.axes
        return [v @ t > 0 for t in self.turns]


def learn_rotation(v: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """The orthogonal matrix that brings v @ r closest to its own signs."""
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        b = np.where(v @ r > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(v.T @ b)
        r = left @ right
    return r


def learn_codes(x: np.ndarray, *, codes: int, max_bits: int = 64) -> Codes:
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    centred = x - mean
    axes = np.linalg.svd(centred, full_matrices=False)[2].T if len(x) >= x.shape[1] else np.eye(x.shape[1])
    return more_codes(Codes(mean, axes[:, :max_bits], ()), x, codes)


def more_codes(model: Codes, x: np.ndarray, codes: int, rounds: int = 40) -> Codes:
    v = (x - model.mean) @ model.axes
    return Codes(model.mean, model.axes, model.turns + tuple(
        learn_rotation(v, rounds, seed) for seed in range(len(model.turns), codes)))


def limit_pairs(x: np.ndarray, cosine: float, *, heads: int = 2000, wanted: int = 1000, band: float = 0.03) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the sample at the limit or a little above, the nearest to it
    first; where they are few, also vectors turned to the limit towards others."""
    x = x[np.abs(x).max(axis=1, initial=0.0) > 0]
    met = []
    for at in range(0, min(heads, len(x)), 500):
        near = x[at:at + 500] @ x.T
        i, j = np.nonzero((near >= cosine) & (near < min(cosine + band, 1 - 1e-9)))
        i, j, c = i[j > i + at] + at, j[j > i + at], near[i[j > i + at], j[j > i + at]]
        some = np.argsort(c, kind="stable")[:wanted]
        met.append(np.stack([i[some], j[some], c[some]], 1))
    pairs = np.concatenate(met) if met else np.empty((0, 3))
    pairs = pairs[np.argsort(pairs[:, 2], kind="stable")[:wanted]]
    a, b = x[pairs[:, 0].astype(int)], x[pairs[:, 1].astype(int)]
    if 2 * len(pairs) < wanted and len(x) > 1:
        i, j = np.random.default_rng(0).integers(len(x), size=(2, wanted - len(pairs)))
        away = x[j] - np.einsum("ij,ij->i", x[i], x[j])[:, None] * x[i]
        norm = np.linalg.norm(away, axis=1)
        i, away = i[norm > 1e-6], away[norm > 1e-6] / norm[norm > 1e-6, None]
        a, b = np.r_[a, x[i]], np.r_[b, cosine * x[i] + math.sqrt(max(0.0, 1 - cosine * cosine)) * away]
    return a, b


def share_met(flips: list[np.ndarray], width: int) -> float:
    """Of pairs whose codes differ where ``flips`` says, the share that some table
    of substrings finds with at most one flip."""
    met = np.zeros(len(flips[0]), bool)
    for code in flips:
        for t in range(code.shape[1] // width):
            met |= code[:, t * width:(t + 1) * width].sum(axis=1) <= 1
    return float(met.mean()) if len(met) else 1.0


def plan(x: np.ndarray, cosine: float, width: int, *, n_codes: int, found: float) -> tuple[Codes, int, int]:
    """(codes, width, most): enough codes for a pair at the limit to be met with
    probability ``found``, and the distance of the first ``n_codes`` that such
    pairs keep within."""
    model = learn_codes(x, codes=n_codes)
    a, b = limit_pairs(x, cosine)
    width = min(width, model.axes.shape[1])
    while True:
        flips = [p != q for p, q in zip(model.of(a), model.of(b))]
        if share_met(flips, width) >= found:
            break
        if len(model.turns) < MOST_CODES:
            model = more_codes(model, x, len(model.turns) + 1)
        else:
            width -= 1  # at a width of one, every pair is met
    # codes that a shorter width made needless
    enough = next(k for k in range(n_codes, len(flips) + 1) if share_met(flips[:k], width) >= found)
    apart = sum(f.sum(axis=1) for f in flips[:n_codes])
    most = math.ceil(max(apart.max(), apart.mean() + 4 * apart.std())) + 2 if len(apart) else n_codes * model.axes.shape[1]
    return Codes(model.mean, model.axes, model.turns[:enough]), width, most


def unit_rows(vectors: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(usable, unit vectors in double precision; zeros where not usable)."""
    good = np.array([v is not None and len(v) == dim for v in vectors], bool)
    out = np.zeros((len(vectors), dim))
    if good.any():
        out[good] = np.array([np.asarray(v, dtype=float) for v in vectors[good]])
    good &= np.isfinite(out).all(axis=1)
    out[~good] = 0.0
    # scale first, so that neither tiny nor huge components lose the norm
    top = np.abs(out).max(axis=1, initial=0.0)
    good &= top > 0
    out[good] /= top[good, None]
    norm = np.linalg.norm(out[good], axis=1)
    out[good] /= norm[:, None]
    out[~good] = 0.0
    return good, out


def classes(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, class, embedding) of usable vectors; equal vectors share a class."""
    usable = (F.col("embedding").isNotNull() & (F.size("embedding") > 0)
              & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
              & F.exists("embedding", lambda x: x != 0))
    # -0.0 and 0.0 are the same number
    same = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
    name = F.sha2(F.array_join(F.transform(same, lambda x: F.hex(x.cast("string"))), ","), 256)
    return vectors.filter(usable).select("row", "vec_id", name.alias("class"), F.col("embedding").cast("array<double>").alias("embedding"))


def hamming_tables(coded: DataFrame, n_codes: int, bits: int, width: int, kept: int) -> tuple[DataFrame, DataFrame]:
    """(index, probes): rows (table, substring, c, the first codes); probes also with each bit flipped."""
    tables = []
    for code in range(n_codes):
        for t in range(bits // width):
            part = F.shiftrightunsigned(F.element_at("codes", code + 1), t * width).bitwiseAND((1 << width) - 1)
            tables.append(F.struct(F.lit(code * 64 + t).alias("table"), part.alias("substring")))
    index = coded.select("c", F.slice("codes", 1, kept).alias("codes"), F.explode(F.array(*tables)).alias("at")).select("c", "codes", "at.*")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(width)))
    probes = index.withColumn("flip", F.explode(flips)).withColumn("substring", F.col("substring").bitwiseXOR(F.col("flip"))).drop("flip")
    return index, probes


def _distance(a: str, b: str, n_codes: int) -> Column:
    total = F.lit(0)
    for i in range(n_codes):
        total = total + F.bit_count(F.element_at(f"{a}.codes", i + 1).bitwiseXOR(F.element_at(f"{b}.codes", i + 1)))
    return total


def links(vectors: DataFrame, *, cosine: float = 0.9, sample: int = 20_000, n_codes: int = 3,
          found: float = 0.98, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members(row, vec_id, c) of usable vectors, c the number
    of the class of equal vectors; pairs(a, b) of different classes, a < b, whose
    cosine is at least ``cosine``. ``width`` is that of substrings, if not to
    follow from the number of vectors; ``n_codes`` are the fewest codes."""
    spark = vectors.sparkSession
    named = stored(classes(vectors), "vectors")
    dims = named.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    empty = spark.createDataFrame([], "a long, b long")
    if dims is None:
        return named.select("row", "vec_id", F.lit(0).cast("long").alias("c")), empty
    dim = dims["dim"]
    named = named.filter(F.size("embedding") == dim)
    # a class is numbered by the first of its rows
    numbers = named.groupBy("class").agg(F.min("row").alias("c"))
    members = stored(named.select("row", "vec_id", "class").join(numbers, "class").select("row", "vec_id", "c"), "members")
    distinct = stored(named.join(numbers.select(F.col("c").alias("row")), "row", "left_semi").select(F.col("row").alias("c"), "embedding"), "distinct")
    n = distinct.count()

    rows = distinct.orderBy(F.xxhash64("c"), "c").limit(sample).toPandas()
    width = width or min(24, max(4, math.ceil(math.log2(max(n, 2)))))
    model, width, most = plan(unit_rows(rows.embedding, dim)[1], cosine, width, n_codes=n_codes, found=found)
    bits = model.axes.shape[1]
    shared = spark.sparkContext.broadcast(model)
    weights = (np.uint64(1) << np.arange(bits, dtype=np.uint64))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            _, x = unit_rows(batch.embedding, dim)
            words = [(b.astype(np.uint64) @ weights).astype(np.uint64).view(np.int64) for b in shared.value.of(x)]
            yield pd.DataFrame({"c": batch.c, "codes": list(np.stack(words, 1))})

    coded = stored(distinct.mapInPandas(code, "c long, codes array<long>"), "codes")
    index, probes = hamming_tables(coded, len(model.turns), bits, width, n_codes)
    # each row became dozens, which size estimates miss: neither side is to be broadcast
    a, b = index.hint("merge").alias("a"), probes.hint("merge").alias("b")
    near = (a.join(b, ["table", "substring"]).filter((F.col("a.c") < F.col("b.c")) & (_distance("a", "b", n_codes) <= most))
            .select(F.col("a.c").alias("a"), F.col("b.c").alias("b")).distinct())

    def rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok_a, x = unit_rows(batch.xa, dim)
            ok_b, y = unit_rows(batch.xb, dim)
            keep = ok_a & ok_b & (np.einsum("ij,ij->i", x, y) >= cosine)
            yield batch.loc[keep, ["a", "b"]]

    full = (near.join(distinct.select(F.col("c").alias("a"), F.col("embedding").alias("xa")), "a")
            .join(distinct.select(F.col("c").alias("b"), F.col("embedding").alias("xb")), "b"))
    pairs = stored(full.select("a", "b", "xa", "xb").mapInPandas(rerank, "a long, b long"), "pairs")
    return members, pairs


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.9, **options) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding)."""
    rows = with_row(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "row")
    members, pairs = links(rows, cosine=cosine, **options)
    sizes = stored(members.groupBy("c").agg(F.count("*").alias("size"), F.min("vec_id").alias("first_id")), "sizes")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outside = (both.join(sizes.select(F.col("c").alias("b"), "size"), "b").groupBy(F.col("a").alias("c")).agg(F.sum("size").alias("outside")))
    grouped = components(pairs).withColumnRenamed("node", "c")
    labels = sizes.join(grouped, "c", "left").withColumn("component", F.coalesce("component", "c")).join(outside, "c", "left")
    smallest = labels.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = labels.join(smallest, "component").select(
        "c", (F.col("size") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"), "component_id")
    found = members.join(labels, "c").select("row", "n_links", "component_id")
    out = rows.select("row", "vec_id").join(found, "row", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
