"""Prefix trie of conversations: which beginnings are shared, and what that saves.

1. Dictionary: equal turns (role, text) get one number; only 32-byte digests of the
   turns are shuffled, never their texts. Turns that make up more than a
   thousandth of all rows, at most 1,000, are numbered by a broadcast join, so a
   very common turn is never dealt to one task.
2. Every conversation becomes its list of turn numbers. The lists are dealt in
   ranges of (list, conversation id), so copies of one conversation spread over
   shards, and each node of the trie is a run of neighbouring lists.
3. In each shard a ternary search tree takes the distinct lists, the median of each
   interval first, which balances it. An iterative traversal adds up members,
   leaves and savings from the leaves to the root.
4. Nodes on the first or last path of a shard may go on in the next one. Their
   parts are added up by node, and one pass in trie order with a stack as deep as
   the trie completes them: at most two paths a shard.

``prefix_trie`` returns one row per node: hi, lo (128 bits that name its path),
up_hi, up_lo (its parent's), depth, conv_id (smallest member), parent_conv_id, n_convs, n_children,
n_leaves, saved_tokens, ends_sha256.

Defined results: turns are ordered by turn (null first), equal ones by digest; a
null role or text is empty; repeated rows are repeated turns; rows without a
conversation id belong to no conversation; an empty table has no nodes; a
conversation without turns is a member of the root. Other columns are not read.
A conversation's turn numbers (12 bytes a turn) have to fit in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
#: A turn in more than one of this many rows is numbered by the broadcast join.
COMMON = 1000
#: Turn numbers in a shard, about.
SHARD_TURNS = 1 << 17
#: Conversation ids in one piece of a digest that spans shards.
ENDS = 4096
ROOT = (0, 0)


def turn_numbers(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, tie, number, words) of every turn: equal (role, text) have
    equal numbers."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length(role), role, text).cast("binary"), 256))
    turns = stored(conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")), "turns")
    seen = turns.groupBy("digest").agg(F.count("*").alias("n"))
    dictionary = stored(seen.withColumn("number", F.monotonically_increasing_id()), "dictionary")
    common = F.broadcast(dictionary.filter(F.col("n") * COMMON > turns.count()).select("digest", "number"))  # fewer than COMMON rows
    rare = dictionary.join(common, "digest", "left_anti").select("digest", "number")
    numbered = turns.join(common, "digest").unionByName(turns.join(common, "digest", "left_anti").join(rare, "digest"))
    return numbered.select("conv_id", "turn", F.xxhash64("digest").alias("tie"), "number", "words")


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words): the turn numbers of each conversation in order, and
    the words of those turns."""
    turn = F.struct("turn", "tie", "number", "words")
    lists = turn_numbers(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return lists.select("conv_id", F.col("turns.number").alias("path"), F.col("turns.words").alias("words"))


class Tree:
    """A ternary search tree over lists of numbers; node 0 is the root of the trie.

    ``low``, ``high`` lead to siblings, ``down`` to the first child."""

    def __init__(self) -> None:
        self.number, self.low, self.high, self.down = [0], [-1], [-1], [-1]
        self.words, self.ends = [0], [-1]

    def _new(self, number: int, words: int) -> int:
        self.number.append(number)
        self.words.append(words)
        for links in (self.low, self.high, self.down, self.ends):
            links.append(-1)
        return len(self.number) - 1

    def insert(self, path: list[int], words: list[int], group: int) -> None:
        number, low, high, down = self.number, self.low, self.high, self.down
        at = 0
        for x, w in zip(path, words):
            links, node = down, at
            while (to := links[node]) >= 0 and number[to] != x:
                links, node = (low if x < number[to] else high), to
            if to < 0:
                to = links[node] = self._new(x, w)
            at = to
        self.ends[at] = group

    def traverse(self) -> tuple[list[int], list[int]]:
        """Nodes in trie order (each before its descendants, siblings ascending),
        and the parent of every node."""
        parent = [-1] * len(self.number)
        order, stack = [], [(0, True)]
        while stack:
            node, whole = stack.pop()
            if whole and self.high[node] >= 0:  # larger siblings come last
                parent[self.high[node]] = parent[node]
                stack.append((self.high[node], True))
            if whole and self.low[node] >= 0:
                parent[self.low[node]] = parent[node]
                stack.append((node, False))
                stack.append((self.low[node], True))
                continue
            order.append(node)
            if self.down[node] >= 0:
                parent[self.down[node]] = node
                stack.append((self.down[node], True))
        return order, parent


def medians(n: int) -> Iterator[int]:
    """0 .. n-1, the middle of every interval before its halves."""
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            todo += [(a, m), (m + 1, b)]


def path_key(key: tuple[int, int], number: int) -> tuple[int, int]:
    """128 bits that name the path of ``key`` with ``number`` added, as two longs."""
    x = xxhash.xxh3_128_intdigest(np.array([*key, number], np.int64).tobytes())
    hi, lo = np.array([x >> 64, x & 0xFFFFFFFFFFFFFFFF], np.uint64).view(np.int64).tolist()
    return hi, lo


def frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows as a frame, longs kept exact where some are null."""
    names = [c.split() for c in schema.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(names)
    return pd.DataFrame({name: pd.Series(list(c), dtype="Int64" if kind == "long" else None if rows else object)
                         for (name, kind), c in zip(names, columns)})


PARTS = ("hi long, lo long, up_hi long, up_lo long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, words long, edge boolean, parent_edge boolean, shard int, first long, piece int, ends string")


def shard_nodes(batches: Iterator[pd.DataFrame], shard: int) -> Iterator[pd.DataFrame]:
    """The nodes of one shard, its rows sorted by (path, conv_id). Counts of an
    edge node leave out its edge children and itself."""
    paths, words, members = [], [], []
    for batch in batches:
        for conv, path, w in zip(batch.conv_id.tolist(), batch.path, batch.words):
            path = [] if path is None else path.tolist()
            if paths and paths[-1] == path:
                members[-1].append(conv)
            else:
                paths.append(path)
                words.append([] if w is None else w.tolist())
                members.append([conv])
    if not paths:
        return
    tree = Tree()
    for m in medians(len(paths)):
        tree.insert(paths[m], words[m], m)
    order, parent = tree.traverse()
    size = len(order)
    depth, keys = [0] * size, [ROOT] * size
    first = [len(paths)] * size
    count, smallest = [0] * size, [None] * size
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for node in order[1:]:
        up = parent[node]
        depth[node] = depth[up] + 1
        keys[node] = path_key(keys[up], tree.number[node])
    edge = [False] * size
    edge[0] = True
    for path in (paths[0], paths[-1]):
        at = 0
        for x in path:
            to = tree.down[at]
            while tree.number[to] != x:
                to = tree.low[to] if x < tree.number[to] else tree.high[to]
            edge[to] = True
            at = to
    for node in reversed(order):  # children before parents
        group = tree.ends[node]
        if group >= 0:
            first[node] = min(first[node], group)
            count[node] += len(members[group])
            least = members[group][0]
            smallest[node] = least if smallest[node] is None else min(least, smallest[node])
        if not edge[node]:
            leaves[node] += children[node] == 0
            saved[node] += (count[node] - 1) * tree.words[node]
        up = parent[node]
        if up >= 0:
            first[up] = min(first[up], first[node])
            count[up] += count[node]
            smallest[up] = smallest[node] if smallest[up] is None else min(smallest[up], smallest[node])
            if not edge[node]:
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]

    def rows() -> Iterator[tuple]:
        for node in order:
            up, group = parent[node], tree.ends[node]
            ids = members[group] if group >= 0 else []
            row = (*keys[node], *(keys[up] if up >= 0 else (None, None)), depth[node], smallest[node], smallest[up] if up >= 0 else None,
                   count[node], children[node], leaves[node], saved[node], tree.words[node], edge[node], up >= 0 and edge[up], shard, first[node])
            if not edge[node]:
                yield *row, 0, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
                continue
            yield *row, 0, ",".join(map(str, ids[:ENDS]))
            for piece, at in enumerate(range(ENDS, len(ids), ENDS), 1):
                yield *row, piece, ",".join(map(str, ids[at:at + ENDS]))

    block = []
    for r in rows():
        block.append(r)
        if len(block) == 10000:
            yield frame(block, PARTS)
            block = []
    yield frame(block, PARTS)


def completed(edges: DataFrame) -> DataFrame:
    """The whole counts of edge nodes (hi, lo, depth, conv_id, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens), whose parts have been added up: one pass
    in trie order."""
    schema = ("hi long, lo long, up_hi long, up_lo long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
              "n_leaves long, saved_tokens long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        stack, done = [], []

        def close() -> None:
            r = stack.pop()
            r["n_leaves"] += r["n_children"] == 0
            r["saved_tokens"] += (r["n_convs"] - 1) * r["words"]
            for own, of_parent in (("up_hi", "hi"), ("up_lo", "lo"), ("parent_conv_id", "conv_id")):
                r[own] = stack[-1][of_parent] if stack else None
            if stack:
                for c in ("n_leaves", "saved_tokens"):
                    stack[-1][c] += r[c]
            done.append([r[c] for c in names])

        def block() -> pd.DataFrame:
            out = frame(done, schema)
            done.clear()
            return out

        for batch in batches:
            for r in batch.to_dict("records"):
                while stack and stack[-1]["depth"] >= r["depth"]:
                    close()
                if stack:
                    stack[-1]["n_children"] += 1
                stack.append(r)
            yield block()
        while stack:
            close()
        yield block()

    parts = edges.filter("piece = 0").groupBy("hi", "lo", "depth", "words").agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.min(F.struct("shard", "first")).alias("place"))
    # two paths a shard at most; the stack is as deep as the trie
    return parts.repartition(1).sortWithinPartitions("place", "depth").drop("place").mapInPandas(run, schema)


def end_digests(edges: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of edge nodes: the pieces of their ids in order."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest, some = None, None, False
        for batch in batches:
            done = []
            for hi, lo, ends in zip(batch.hi.tolist(), batch.lo.tolist(), batch.ends):
                if (hi, lo) != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest, some = (hi, lo), hashlib.sha256(), False
                if ends:
                    digest.update(("," + ends if some else ends).encode())
                    some = True
            yield pd.DataFrame(done, columns=["hi", "lo", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, digest.hexdigest())], columns=["hi", "lo", "ends_sha256"])

    sorted_pieces = edges.select("hi", "lo", "shard", "piece", "ends").repartition("hi", "lo").sortWithinPartitions("hi", "lo", "shard", "piece")
    return sorted_pieces.mapInPandas(run, "hi long, lo long, ends_sha256 string")


def prefix_trie(paths: DataFrame, *, shards: int | None = None) -> DataFrame:
    """One row per node of the trie over ``paths`` (conv_id, path, words), as
    ``sequences`` makes them. ``shards`` changes nothing but the work's division."""
    paths = stored(paths.select("conv_id", "path", "words"), "paths")
    if shards is None:
        turns = paths.agg(F.sum(F.size("path"))).first()[0] or 0
        shards = max(paths.sparkSession.sparkContext.defaultParallelism, -(-turns // SHARD_TURNS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        yield from shard_nodes(batches, TaskContext.get().partitionId())

    ranged = paths.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    nodes = stored(ranged.mapInPandas(run, PARTS), "nodes")
    edges = nodes.filter("edge")
    whole = stored(completed(edges).join(end_digests(edges), ["hi", "lo"]), "edges")
    # inner nodes below an edge node take its smallest member, known only now
    inner = nodes.filter("not edge")
    parents = whole.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("up_conv_id"))
    below = inner.filter("parent_edge").join(parents, ["up_hi", "up_lo"]).withColumn("parent_conv_id", F.col("up_conv_id"))
    out = ["hi", "lo", "up_hi", "up_lo", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return (whole.select(*out).unionByName(below.withColumnRenamed("ends", "ends_sha256").select(*out))
            .unionByName(inner.filter("not parent_edge").withColumnRenamed("ends", "ends_sha256").select(*out)))
