"""Centroid clustering (k-means) in integer arithmetic, as JVM expressions.

Every component x becomes the integer floor(scale * x), so that distances and
sums are exact and every run, partitioning and engine gives the same clusters.
The centroids are literal arrays in the plan: ``zip_with`` and ``aggregate`` give
the squared distance of a vector to each, ``array_min`` over structs of (distance,
number) picks the nearest with ties to the smaller number, and one sum per
component and cluster updates the centroids. A round is one scan and one partially
aggregated shuffle of at most k rows a task, whatever the share of a cluster; only
k rows of sums reach the driver. The integer vectors are written once, and each
round reads that table, so a lost executor costs only its own tasks.

Defined results: vectors that are null, of another length, or that hold null or
non-finite components are left out, as are those with a component of magnitude
2^17 / (scale / 1024) or more, whose squared distances would not fit in a long.
With fewer vectors than k each is a centroid; an empty table gives an empty
result. A cluster that loses all its vectors keeps its centroid. Repeated rows
count each; a null id seeds as an empty one; ties of seeds go by the vector.
Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Components below this magnitude keep 64 squared differences within a long.
LIMIT = 1 << 27


def integer_vectors(df: DataFrame, *, vector: str, dims: int, scale: int, keep: list[str]) -> DataFrame:
    """``keep`` and ``v``, the integer components of the vectors that qualify."""
    x = F.col(vector)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < LIMIT))
    qualifies = F.when(F.size(x) == dims, sound).otherwise(F.lit(False))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return df.filter(F.coalesce(qualifies, F.lit(False))).select(*keep, v.alias("v"))


def first_by_hash(vectors: DataFrame, k: int, id_col: str, salt: str) -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``salt`` and their id, in that order."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r.v) for r in vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()]


def nearest(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``vectors`` with ``near``, the (distance, cluster) of the nearest centroid."""
    def to(centre: Column, number: Column) -> Column:
        squares = F.zip_with("v", centre, lambda a, b: (a - b) * (a - b))
        return F.struct(F.aggregate(squares, F.lit(0).cast("long"), lambda total, s: total + s).alias("distance"),
                        number.cast("int").alias("cluster"))

    literal = F.array(*[F.array(*[F.lit(c).cast("long") for c in centre]) for centre in centroids])
    return vectors.withColumn("near", F.array_min(F.transform(literal, to)))


def updated(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floor of each cluster's mean; a cluster without vectors stays."""
    sums = [F.sum(F.col("v")[d]).alias(f"s{d}") for d in range(len(centroids[0]))]
    rows = (nearest(vectors, centroids).groupBy(F.col("near.cluster").alias("cluster"))
            .agg(F.count("*").alias("n"), *sums).collect())  # at most k rows
    out = [list(c) for c in centroids]
    for r in rows:
        out[r.cluster] = [r[f"s{d}"] // r.n for d in range(len(out[r.cluster]))]
    return out


@dataclass(frozen=True)
class Clusters:
    """The integer vectors with their ids, and the centroids after the last round."""
    vectors: DataFrame
    centroids: list[list[int]]

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]

    def assigned(self) -> DataFrame:
        """Every kept row with ``cluster``, ``distance``, ``cluster_inertia``,
        ``inertia`` and ``centroid_sha256``."""
        rows = self.vectors.drop("v")
        if not self.centroids:
            return rows.select(*rows.columns, *(F.lit(None).cast(t).alias(c) for c, t in (
                ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
        near = nearest(self.vectors, self.centroids).select(*rows.columns, "near.cluster", "near.distance")
        sums = {r.cluster: r.d for r in near.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most k rows
        each = F.array(*[F.lit(sums.get(c, 0)).cast("long") for c in range(len(self.centroids))])
        return near.select("*", F.element_at(each, F.col("cluster") + 1).alias("cluster_inertia"),
                           F.lit(sum(sums.values())).cast("long").alias("inertia"),
                           F.element_at(F.array(*map(F.lit, self.digests())), F.col("cluster") + 1).alias("centroid_sha256"))


def cluster(df: DataFrame, *, k: int, rounds: int, dims: int, id_col: str = "vec_id", vector: str = "embedding",
            scale: int = 1024, salt: str = "3:", centroids: list[list[int]] | None = None) -> Clusters:
    """Cluster the vectors of ``df`` around ``k`` centroids in ``rounds`` rounds,
    from ``centroids`` if given, else from the first k by salted hash of the id."""
    vectors = stored(integer_vectors(df, vector=vector, dims=dims, scale=scale, keep=[id_col]), "vectors")
    if centroids is None:
        centroids = first_by_hash(vectors, k, id_col, salt)
    for _ in range(rounds if centroids else 0):
        after = updated(vectors, centroids)
        if after == centroids:  # settled: further rounds change nothing
            break
        centroids = after
    return Clusters(vectors, centroids)
