"""Exact set-similarity joins of text units on Spark.

A unit (a whole text, or one line of it) is the set of its distinct k-word
shingles; with fewer words the whole sequence is its one shingle; without words
it is empty. Words are what ASCII white space separates, A-Z lower-cased.
Shingles are 64-bit hashes. Units with equal sets are one *node*, named by a
64-bit hash of the set.

All shingles have one order: rare first (counts gathered from the whole input),
then by hash. Two sets can only be as similar as asked for if the first few
shingles of each (the prefix) share one. ``shared_postings`` gives the prefix
postings (token, node, n, pos) of every token that two nodes of fitting sizes
have in their prefixes; everything after it works on those alone.

Counting: each task counts the shingles of what it reads and passes on those
it saw twice or more; the counts are added up and the ``FREQUENT`` largest
make up the frequent end of the order, which is broadcast (16 bytes each). Any
order gives right results; the counts only keep posting lists short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, release_memory, small_batches, stored, with_row

FREQUENT = 200_000
CHUNK_BYTES = 1 << 20
COUNT_TOKENS = 1 << 21
POSTINGS = 1 << 19  # postings that a task packs at once; several times their 24 bytes are held then
SHORT_LIST, LONG_LIST = 64, 1024  # postings all compared with each other; times seen from which a list is dealt out
TOKEN_BITS = 48  # postings keep the leading bits of a shingle: they name candidates only
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes with A-Z lower-cased and all white space as blanks.
_PLAIN = bytes(32 if _SPACE[c] else c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_BLOCK = 1 << 16
_UP, _DOWN = powers(_BASE, 2 * _BLOCK), powers(_INVERSE, 2 * _BLOCK)


def hash_words(texts: list[bytes], *, ends: bool = False) -> tuple[np.ndarray, ...]:
    """64-bit hash of each word of the texts, and which text it is of; with
    ``ends`` also the last two bytes of each word as one number."""
    data = np.frombuffer((b" " + b" ".join(texts) + b" ").translate(_PLAIN), np.uint8)
    inside = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begins, stops = edges[::2], edges[1::2]
    lengths = stops - begins
    sums = np.empty(len(begins), np.uint64)
    # words by blocks of bytes: letters times powers by place in the block, added up and taken back to the word's begin
    cuts = np.r_[np.searchsorted(begins, np.arange(0, len(data), _BLOCK)), len(begins)].tolist()
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        low, size = begins[a], int(stops[b - 1] - begins[a])
        up, down = (_UP, _DOWN) if size <= len(_UP) else (powers(_BASE, size), powers(_INVERSE, size))
        at = begins[a:b] - low
        sums[a:b] = np.add.reduceat(_LETTER[data[low:low + size]] * up[:size], at) * down[at]
    n_words = np.diff(np.r_[0, np.searchsorted(begins, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))])
    found = mix(sums + lengths.astype(np.uint64)), np.repeat(np.arange(len(texts)), n_words)
    if not ends:
        return found
    return *found, data[stops - 1].astype(np.int64) * 256 + np.where(lengths > 1, data[stops - 2], 0)


def hash_words_and_ends(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`hash_words`, and the last two bytes of each word as one number."""
    return hash_words(texts, ends=True)


def by_owner(h: np.ndarray, owner: np.ndarray, n_owners: int) -> np.ndarray:
    """The order by owner, then hash, by one sort of owner and leading hash bits."""
    bits = np.uint64(max(1, n_owners.bit_length()))
    key = (owner.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits)
    order = np.argsort(key)
    key, h_sorted = key[order], h[order]
    tied = np.flatnonzero(key[1:] == key[:-1])
    if (h_sorted[tied + 1] != h_sorted[tied]).any():  # different hashes alike in the leading bits
        return np.lexsort((h, owner))
    return order


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, bounds, nodes): the distinct shingles of text i, sorted, are
    ``tokens[bounds[i]:bounds[i + 1]]``; its node is ``nodes[i]`` (0 if empty)."""
    words, owner = hash_words(texts)
    n_words = np.bincount(owner, minlength=len(texts))
    first = np.r_[0, np.cumsum(n_words)[:-1]]
    rolled = np.zeros(len(words), np.uint64)
    scale = np.uint64(1)
    for j in range(min(k, len(words))):
        rolled[:len(words) - j] += words[j:] * scale
        scale = np.uint64((int(scale) * int(_STEP)) % 2**64)
    in_text = np.arange(len(words)) - first[owner]
    size = n_words[owner]
    full = in_text + k <= size
    # texts of fewer words: their whole sequence, at their first word
    short = (size < k) & (in_text == 0)
    if short.any():
        few = np.flatnonzero(size < k)
        part = words[few] * powers(_STEP, k)[in_text[few]]
        at = np.flatnonzero(in_text[few] == 0)
        rolled[few[at]] = np.add.reduceat(part, at) + np.uint64(0x51ED270B) * size[few[at]].astype(np.uint64)
    keep = full | short
    h, owner = mix(rolled[keep]), owner[keep]
    h = h[by_owner(h, owner, len(texts))]  # owners are in order as they are
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.empty(0, bool)
    h, owner = h[new], owner[new]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    nodes = np.zeros(len(texts), np.uint64)
    filled = np.flatnonzero(np.diff(bounds))
    if len(filled):
        nodes[filled] = mix(np.add.reduceat(mix(h ^ _STEP), bounds[filled]) + np.diff(bounds)[filled].astype(np.uint64))
    return h, bounds, nodes


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


class Levels:
    """A sorted array of evenly spread 64-bit hashes with a number each, looked up
    from where hashes of the same leading bits begin."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray, bits: int = 19):
        self.hashes, self.numbers, self.shift = hashes, numbers, np.uint64(64 - bits)
        self.begin = np.searchsorted(hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """The number of each of ``h``; 0 for those that are not there."""
        out = np.zeros(len(h), np.int64)
        lead = (h >> self.shift).astype(np.int32)
        at, end = self.begin[lead], self.begin[lead + 1]
        left = np.flatnonzero(at < end)
        at, end, wanted = at[left], end[left], h[left]
        while len(left):
            here = self.hashes[at]
            hit = here == wanted
            out[left[hit]] = self.numbers[at[hit]]
            at = at + 1
            more = np.flatnonzero((here < wanted) & (at < end))
            left, at, end, wanted = left[more], at[more], end[more], wanted[more]
        return out


@dataclass(frozen=True)
class Units:
    """What a unit is, and how similar two must be (``percent`` of the union)."""
    lines: bool = False
    k: int = 5
    percent: int = 75

    def least(self, n):
        """The fewest shingles a set of n shares with a similar set."""
        return (self.percent * n + 99) // 100

    def overlap(self, a, b):
        """The fewest shared shingles that make sets of a and b similar."""
        return (self.percent * (a + b) + 99 + self.percent) // (100 + self.percent)

    def overlap_column(self, a: str, b: str) -> Column:
        return F.expr(f"({self.percent} * ({a} + {b}) + {99 + self.percent}) div {100 + self.percent}")

    def split(self, text: str | None) -> list[bytes]:
        data = (text or "").encode("utf-8", "replace")
        return data.split(b"\n") if self.lines else [data]

    def chunks(self, batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """(batch, places in it, units, tokens, bounds, nodes) of a few texts at a time."""
        release_memory()
        for batch in batches:
            rows, numbers, texts, size = [], [], [], 0
            for row, text in enumerate(batch.text.tolist()):
                for i, t in enumerate(self.split(text)):
                    rows.append(row)
                    numbers.append(i)
                    texts.append(t)
                    size += len(t)
                if size >= CHUNK_BYTES:
                    yield (batch, np.array(rows), np.array(numbers), *shingle_sets(texts, self.k))
                    rows, numbers, texts, size = [], [], [], 0
            if texts:
                yield (batch, np.array(rows), np.array(numbers), *shingle_sets(texts, self.k))


class Met:
    """Nodes that a task has handled already; forgets all at a bound, after
    which work may repeat, to no effect on results."""

    def __init__(self, bound: int = 500_000):
        self.seen: set[int] = set()
        self.bound = bound

    def new(self, nodes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if len(self.seen) > self.bound:
            self.seen.clear()
        seen, out = self.seen, np.zeros(len(nodes), bool)
        for i in np.flatnonzero(wanted):
            x = int(nodes[i])
            if x not in seen:
                seen.add(x)
                out[i] = True
        return out


def with_rows(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, text and ``row``, the place in the input (a column of ``docs`` or
    numbered here), which tells apart rows of equal ids in every pass."""
    small_batches(docs)
    if row is None:
        docs, row = with_row(docs.select("doc_id", "text"), "row"), "row"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"), "text")


def describe(rows: DataFrame, kind: Units) -> tuple[DataFrame, DataFrame]:
    """(units, counts): units(doc_id, row, unit, n, node) of every unit, and
    counts(token, seen) of shingles that some task saw more than once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met, held, n_held = Met(), [], 0

        def counted():
            tokens, seen = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            tokens, seen = tokens[seen > 1], seen[seen > 1]
            held.clear()
            return pd.DataFrame({"doc_id": None, "row": np.full(len(tokens), -1, np.int64), "unit": np.zeros(len(tokens), np.int32),
                                 "n": seen.astype(np.int64), "node": signed(tokens)})

        for batch, at, unit, tokens, bounds, nodes in kind.chunks(batches):
            n = np.diff(bounds)
            yield pd.DataFrame({"doc_id": batch.doc_id.to_numpy()[at], "row": batch.row.to_numpy()[at], "unit": unit.astype(np.int32), "n": n, "node": signed(nodes)})
            fresh = met.new(nodes, n > 2)
            held.append(tokens[np.repeat(fresh, n)])
            n_held += int(n[fresh].sum())
            if n_held > COUNT_TOKENS:
                yield counted()
                n_held = 0
        yield counted()
        release_memory()

    both = stored(rows.mapInPandas(run, "doc_id long, row long, unit int, n long, node long"), "units")
    units = both.filter("row >= 0")
    counts = both.filter("row < 0").groupBy(F.col("node").alias("token")).agg(F.sum("n").alias("seen"))
    return units, counts


def _spread(node: np.ndarray, place: np.ndarray, buckets: int) -> np.ndarray:
    """How far from its token's bucket a posting lies: lists that are dealt out go by node."""
    return np.where(place & 1 == 1, mix(node.view(np.uint64)) % np.uint64(buckets), np.uint64(0)).astype(np.int64)


def _token_bytes(buckets: int) -> int:
    """Bytes that a token needs besides its bucket."""
    return -(-(TOKEN_BITS - buckets.bit_length() + 1) // 8)


def in_buckets(rows: np.ndarray, buckets: int) -> pd.DataFrame:
    """Postings (token, node, place) by the bucket of their token, long lists dealt
    over all buckets by node; each bucket's as one value, without what the bucket
    tells of the token, and byte by byte where bytes are alike."""
    token, node, place = rows
    bucket = (token % buckets + _spread(node, place, buckets)) % buckets
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    bucket, width = bucket[order], _token_bytes(buckets)
    begins = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][:len(bucket)])
    ends = np.r_[begins[1:], len(bucket)]
    rest, nodes, places = (np.ascontiguousarray(column[order]).view(np.uint8).reshape(-1, 8) for column in (token // buckets, node, place))
    values = [b"".join([rest[a:b, :width].tobytes(), nodes[a:b].tobytes(), places[a:b].T.tobytes()]) for a, b in zip(begins.tolist(), ends.tolist())]
    return pd.DataFrame({"bucket": bucket[begins].astype(np.int32), "postings": values})


def packed(parts: Iterator[np.ndarray], buckets: int) -> Iterator[pd.DataFrame]:
    """Postings ``in_buckets``, about ``POSTINGS`` of them at a time."""
    held, n_held = [], 0
    for part in parts:
        held.append(part)
        n_held += part.shape[1]
        if n_held > POSTINGS:
            yield in_buckets(np.concatenate(held, axis=1), buckets)
            held, n_held = [], 0
    if held:
        yield in_buckets(np.concatenate(held, axis=1), buckets)


def unpacked(bucket: int, packed: bytes, buckets: int) -> np.ndarray:
    """The postings of one value of ``in_buckets``."""
    data, width = np.frombuffer(packed, np.uint8), _token_bytes(buckets)
    n = len(data) // (width + 16)
    rest = np.zeros((n, 8), np.uint8)
    rest[:, :width] = data[:width * n].reshape(n, width)
    rest = rest.view(np.int64).reshape(-1)
    node = data[width * n:(width + 8) * n].copy().view(np.int64)
    place = np.ascontiguousarray(data[(width + 8) * n:].reshape(8, n).T).view(np.int64).reshape(-1)
    return np.stack([rest * buckets + (bucket - _spread(node, place, buckets)) % buckets, node, place])


def having_partners(rows: np.ndarray, kind: Units) -> np.ndarray:
    """Of whole lists of postings (token, node, place), in any order, one a node:
    those with a partner that passes the length and positional filters, and all
    of lists that are long or dealt out.

    Two similar sets have their first common shingle in both prefixes, with all
    that they share from there on, so their postings of it are partners.
    """
    rows = rows[:, np.argsort(rows[0])]
    again = rows[0, 1:] == rows[0, :-1]
    # most lists have one posting
    listed = (rows[2] & 1).astype(bool)
    listed[1:] |= again
    listed[:-1] |= again
    rows = rows[:, listed]
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
    rows = rows[:, new]
    token, _, place = rows
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    begins = np.flatnonzero(first)
    lengths = np.diff(np.r_[begins, len(token)])
    after = np.repeat(begins + lengths, lengths) - np.arange(len(token))  # postings of the list from here on
    wanted = (place & 1).astype(bool) | (np.repeat(lengths, lengths) > SHORT_LIST)
    n = place >> 32
    left = n - ((place >> 1) & 0x7FFFFFFF)
    at = np.flatnonzero(~wanted)
    for step in range(1, SHORT_LIST):
        at = at[after[at] > step]
        if not len(at):
            break
        other = at + step
        a, b = n[at], n[other]
        fits = (100 * np.minimum(a, b) >= kind.percent * np.maximum(a, b)) & (np.minimum(left[at], left[other]) >= kind.overlap(a, b))
        wanted[at[fits]] = True
        wanted[other[fits]] = True
    return rows[:, wanted]


def shared_postings(rows: DataFrame, counts: DataFrame, kind: Units) -> DataFrame:
    """Prefix postings (token, node, n, pos) that have a partner: another node's
    posting of the token whose size and position allow the similarity. Long lists
    are kept whole. Sets of one or two shingles are similar only to equal ones and
    have none (at 67 percent or more)."""
    top = counts.orderBy(F.desc("seen"), "token").limit(FREQUENT).toPandas()
    tokens = top.token.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    # levels 1, 2, ... for ever larger counts; 0 for all other tokens
    counted, levels = np.unique(top.seen.to_numpy(np.int64)[order], return_inverse=True)
    long_from = int(np.searchsorted(counted, LONG_LIST)) + 1
    frequent = rows.sparkSession.sparkContext.broadcast((tokens[order], levels.astype(np.int64) + 1))
    least_size = 1 if kind.percent < 67 else 3

    # the lists of a bucket are put together in one task, a few buckets a partition
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, min(8 * parts, 2048))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        known = Levels(*frequent.value)
        met = Met()
        for _, _, _, h, bounds, nodes in kind.chunks(batches):
            n = np.diff(bounds)
            fresh = met.new(nodes, n >= least_size)
            take = np.repeat(fresh, n)
            h, owner = h[take], np.repeat(np.arange(len(n)), n)[take]
            if not len(h):
                continue
            f = known.look_up(h)
            # stable, so that equal counts stay in hash order
            order = np.argsort(owner * (len(known.hashes) + 1) + f, kind="stable")
            h, f = h[order], f[order]  # owners are in order as they are
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            pos = np.arange(len(h)) - np.repeat(begins, np.diff(np.r_[begins, len(h)]))
            size = n[owner]
            keep = pos <= size - kind.least(size)
            # size, position and whether the list is dealt out, in one number
            place = (size[keep].astype(np.int64) << 32) | (pos[keep] << 1) | (f[keep] >= long_from)
            yield np.stack([(h[keep] >> np.uint64(64 - TOKEN_BITS)).view(np.int64), signed(nodes[owner[keep]]), place])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from packed(prefixes(batches), buckets)
        release_memory()

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of packed postings sorted by bucket: those that ``having_partners`` keeps."""
        held, bucket = [], None
        for batch in batches:
            for now, value in zip(batch.bucket.tolist(), batch.postings):
                if now != bucket and held:
                    yield result(*having_partners(np.concatenate(held, axis=1), kind))
                    held = []
                bucket = now
                held.append(unpacked(now, value, buckets))
        if held:
            yield result(*having_partners(np.concatenate(held, axis=1), kind))
        release_memory()

    def result(token, node, place):
        return pd.DataFrame({"token": token, "node": node, "n": (place >> 32).astype(np.int32),
                             "pos": ((place >> 1) & 0x7FFFFFFF).astype(np.int32)})

    postings = rows.select("row", "text").mapInPandas(run, "bucket int, postings binary")
    dealt = postings.repartition("bucket").sortWithinPartitions("bucket")
    return stored(dealt.mapInPandas(shared, "token long, node long, n int, pos int"), "postings")


def among(rows: DataFrame, wanted: DataFrame, of: str = "row", bits: int = 1 << 23, mark: str | None = None) -> DataFrame:
    """The rows whose column ``of`` is a ``row`` of ``wanted``, and few others; with
    ``mark`` all rows, and that test as a column of this name.

    A bit table of fixed size (131,072 words of 64 bits, broadcast), filled from all of
    ``wanted``. It only spares shuffling texts that a join would drop: when it is full it
    spares none, and the join after it gives the same result.
    """
    word, held = (fresh([*rows.columns, mark or ""], name) for name in ("__word", "__held"))

    def place(column: str) -> tuple[Column, Column]:
        spot = F.pmod(F.xxhash64(column), F.lit(bits))
        return (spot / 64).cast("int"), F.pmod(spot, F.lit(64)).cast("int")

    row_word, row_bit = place("row")
    words = (wanted.select(row_word.alias(word), row_bit.alias("bit"))
             .groupBy(word).agg(F.expr("bit_or(shiftleft(1L, bit))").alias(held)))
    of_word, of_bit = place(of)
    if mark is None:
        return rows.join(F.broadcast(words), of_word == F.col(word)).filter(F.getbit(held, of_bit) == 1).drop(word, held)
    met = rows.join(F.broadcast(words), of_word == F.col(word), "left")
    return met.withColumn(mark, F.coalesce(F.getbit(held, of_bit) == 1, F.lit(False))).drop(word, held)


SKETCH_WORDS = 8


def sketches(texts: DataFrame, kind: Units) -> DataFrame:
    """(node, n, s0, s1, ...) of each (node, text): how many shingles, and 512 bits,
    bit b the parity of the shingles whose hash ends in b."""
    bits = 64 * SKETCH_WORDS
    names = [f"s{i}" for i in range(SKETCH_WORDS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at:at + 500]
                h, bounds, _ = shingle_sets([(t or "").encode("utf-8", "replace") for t in part.text.tolist()], kind.k)
                spot = np.repeat(np.arange(len(part)), np.diff(bounds)) * bits + (h & np.uint64(bits - 1)).astype(np.int64)
                odd = (np.bincount(spot, minlength=len(part) * bits) & 1).astype(np.uint8).reshape(len(part), bits)
                words = np.packbits(odd, axis=1).view(np.int64).reshape(len(part), SKETCH_WORDS)
                yield pd.DataFrame(words, columns=names).assign(node=part.node.to_numpy(), n=np.diff(bounds).astype(np.int32))
        release_memory()

    schema = "node long, n int, " + ", ".join(f"{n} long" for n in names)
    return texts.select("node", "text").mapInPandas(run, schema)


def near_enough(left: str, right: str, kind: Units) -> Column:
    """Bitmap filter: where two sketches differ, so do the sets, and at least
    that often. Similar sets always pass; large sets fill their sketch and pass too."""
    differ = " + ".join(f"bit_count({left}.s{i} ^ {right}.s{i})" for i in range(SKETCH_WORDS))
    need = kind.overlap_column(f"{left}.n", f"{right}.n")
    return F.expr(f"{left}.n + {right}.n - ({differ})") >= 2 * need


def plausible(pairs: DataFrame, sketched: DataFrame, kind: Units) -> DataFrame:
    """The pairs (x, y) that sketches do not rule out, before any text is moved."""
    a, b = sketched.alias("a"), sketched.alias("b")
    return (pairs.select("x", "y").join(a, F.col("x") == F.col("a.node")).join(b, F.col("y") == F.col("b.node"))
            .filter(near_enough("a", "b", kind)).select("x", "y"))


def fitting(left: str, right: str, kind: Units) -> Column:
    """Length and positional filters for postings of one token: the sizes allow
    the similarity, and so do the shingles that are left from here on."""
    a, b = f"{left}.n", f"{right}.n"
    need = kind.overlap_column(a, b)
    return F.expr(f"100 * least({a}, {b}) >= {kind.percent} * greatest({a}, {b})") & (
        F.expr(f"least({a} - {left}.pos, {b} - {right}.pos)") >= need)


def size_blocks(n: str, kind: Units) -> tuple[Column, Column]:
    """The block of a set of ``n`` shingles, and the blocks that similar sets lie in: its
    own and the one nearer to it, as blocks are twice as wide as similar sets can be
    apart (both neighbours in the middle of a block)."""
    place = F.log(F.col(n).cast("double")) / F.log(F.lit(100 / kind.percent)) / 2
    block = F.floor(place + 1e-9)
    within = place - block
    near = F.array(block, F.when(within < 0.5 + 1e-6, block - 1), F.when(within > 0.5 - 1e-6, block + 1))
    return block, F.array_compact(near)


def leader_pairs(shared: DataFrame, kind: Units, rank: str, salts: int = 8) -> DataFrame:
    """Pairs (x, y) of each posting with the lowest-ranked of its token's list,
    and of one of ``salts`` parts of that list: no more than two per posting."""
    out = None
    for key in (F.lit(-1).cast("long"), F.pmod(F.xxhash64("node", "token"), F.lit(salts))):
        rows = shared.withColumn("part", key)
        low = rows.groupBy("token", "part").agg(F.min(F.struct(F.col(rank).alias("rank"), "node", "n", "pos")).alias("low"))
        low = low.select("token", "part", "low.rank", "low.node", "low.n", "low.pos")
        pairs = (rows.alias("b").join(low.alias("a"), ["token", "part"])
                 .filter(F.expr("a.node <> b.node") & fitting("a", "b", kind))
                 .select(F.col("a.node").alias("x"), F.col("b.node").alias("y")))
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def unit_texts(rows: DataFrame, units: DataFrame, kind: Units) -> DataFrame:
    """(node, text) of the given (row, unit, node), read from the rows once."""
    units = stored(units.select("row", "unit", "node"), "wanted")
    found = among(rows.select("row", "text"), units)
    if not kind.lines:
        return stored(found.join(units, "row").select("node", "text"), "texts")
    # other lines of these rows need not be shuffled either
    lines = found.select("row", F.posexplode(F.split("text", "\n", -1)).alias("unit", "text"))
    place = F.xxhash64("row", "unit")
    lines = among(lines.withColumn("place", place), units.select(place.alias("row")), of="place")
    return stored(lines.join(units, ["row", "unit"]).select("node", "text"), "texts")


def verify(pairs: DataFrame, texts: DataFrame, kind: Units, *, differences: bool = False) -> DataFrame:
    """(x, y, nx, ny, both, linked) of each pair, ``both`` the shared shingles,
    counted exactly; with ``differences`` also, of pairs that have half of their
    shingles in common, what y lacks of x (places in x's sorted set) and has
    besides (hashes), as bytes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at:at + 500]
                names, index = np.unique(np.r_[part.x.to_numpy(), part.y.to_numpy()], return_inverse=True)
                place = np.zeros(len(names), np.int64)
                place[index] = np.arange(2 * len(part))
                texts_of = part.xt.tolist() + part.yt.tolist()
                h, bounds, _ = shingle_sets([(texts_of[p] or "").encode("utf-8", "replace") for p in place], kind.k)
                rows = []
                for i, (ix, iy) in enumerate(zip(index[:len(part)], index[len(part):])):
                    a, b = h[bounds[ix]:bounds[ix + 1]], h[bounds[iy]:bounds[iy + 1]]
                    where = np.minimum(np.searchsorted(a, b), max(len(a) - 1, 0))
                    has = a[where] == b if len(a) else np.zeros(len(b), bool)
                    both = int(has.sum())
                    row = [int(names[ix]), int(names[iy]), len(a), len(b), both, 100 * both >= kind.percent * (len(a) + len(b) - both)]
                    if differences and 2 * both >= len(a) + len(b) - both:
                        lacks = np.ones(len(a), bool)
                        lacks[where[has]] = False
                        row += [np.flatnonzero(lacks).astype("<u4").tobytes(), b[~has].astype("<u8").tobytes()]
                    elif differences:
                        row += [None, None]
                    rows.append(row)
                yield pd.DataFrame(rows, columns=names_out)
        release_memory()

    schema = "x long, y long, nx long, ny long, both long, linked boolean" + (", lacks binary, extra binary" if differences else "")
    names_out = [c.split()[0] for c in schema.split(", ")]
    # `both` in SQL is a word of its own, so columns are only used through the API
    pairs = stored(pairs.select("x", "y"), "pairs")
    full = pairs
    for side in ("x", "y"):
        # texts of other sets need not be shuffled
        asked = among(texts, pairs.select(F.col(side).alias("row")), of="node")
        full = full.join(asked.select(F.col("node").alias(side), F.col("text").alias(f"{side}t")), side)
    return full.select("x", "y", "xt", "yt").mapInPandas(run, schema)
