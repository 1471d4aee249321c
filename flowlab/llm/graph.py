"""Connected components of large graphs of links.

Links are first contracted within each partition by union-find; then large-star
and small-star rounds (each node's neighbours are linked to the smallest one)
run until nothing changes. Every round is a pair of joins and aggregates keyed
by node, stored in the shared folder; no component ever meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, stored


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of a partition as stars around each local component's smallest node."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def stars():
        rows = [(x, root(x)) for x in list(parent) if root(x) != x]
        parent.clear()
        return pd.DataFrame(rows, columns=["a", "b"]).astype("int64")

    for batch in batches:
        for a, b in zip(batch.a.tolist(), batch.b.tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > 1_000_000:  # bounded memory: what is left joins later rounds
            yield stars()
    yield stars()


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Links (a > b). Large-star: larger neighbours of each node go to its
    smallest neighbour (or itself); small-star: smaller ones do, and the node."""
    if small:
        low = links.groupBy("a").agg(F.min("b").alias("m"))
        out = links.join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        out = out.unionByName(low.select(F.col("a").alias("x"), F.col("m").alias("y")))
    else:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        out = both.filter("b > a").join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    return out.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; component is the
    smallest node that links reach. ``links`` has two long columns a and b;
    nulls and links of a node to itself are ignored."""
    clean = (links.select("a", "b").filter("a is not null and b is not null and a <> b")
             .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    now = stored(clean.mapInPandas(_contract, "a long, b long"), "links")

    def mark(links: DataFrame):
        return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = mark(now)
    for _ in range(max_rounds):
        last, now = now, stored(_star(_star(now, small=False), small=True), "links")
        drop_tables(last)
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
