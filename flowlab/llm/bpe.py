"""BPE encoding and decoding by speculation and verification.

For every new word a greedy longest match proposes tokens. Adjacent tokens are
then checked for compatibility, all pairs of a batch at once in numpy: a token
sequence is what merging would give exactly when every adjacent pair is what
merging gives for the pair alone. Only words with a failing pair (or without a
proposal) are merged exactly.

Words repeat, so each Python worker keeps the encoded words it has met; the
store is emptied when it holds ``MAX_WORDS``. Texts are read whole. A null or
empty text has no tokens: 0 ids, and the digests of the empty string. Repeated
rows give equal rows.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, small_batches

MAX_WORDS = 1_000_000
#: Characters below this are split by the pattern here; the library's own
#: pre-tokenizer splits texts that hold others.
PLAIN_BELOW = 0x250


#: White space below PLAIN_BELOW.
SPACE = "\\t-\\r \\x85\\xa0"


def _class(kind: str) -> str:
    """Characters below PLAIN_BELOW of a general category, for a regex class."""
    return "".join(re.escape(chr(c)) for c in range(PLAIN_BELOW) if unicodedata.category(chr(c))[0] == kind)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies write it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + i)
    return [letters[b] for b in range(256)]


class PairRules:
    """Merges as arrays: ids in merge order, the parts of each token, and for a
    pair of tokens the token it merges to."""

    def __init__(self, n_ids: int, merges: list[tuple[int, int, int]]):
        ids = np.arange(n_ids, dtype=np.int64)
        self.rank = np.full(n_ids, -1, np.int64)
        self.left, self.right = ids.copy(), ids.copy()
        for r, (a, b, c) in enumerate(merges):
            if self.rank[c] < 0:
                self.rank[c], self.left[c], self.right[c] = r, a, b
        keys = np.array([a * n_ids + b for a, b, _ in merges], np.int64)
        ranks = np.arange(len(merges))
        order = np.argsort(keys)
        self.n_ids, self.keys, self.ranks = n_ids, keys[order], ranks[order]
        self.made = np.array([c for _, _, c in merges], np.int64)
        self.never = len(merges)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which each pair merges; ``never`` where it does not."""
        if not len(self.keys):
            return np.full(len(a), self.never)
        key = a * self.n_ids + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.never)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the letters of a and b gives just a and b.

        Undo merges of the two tokens latest first: at the seam, the parts that
        meet must never have been able to merge before the merge that hid them.
        A merge across the seam beats the hiding merge on the left when its rank
        is lower, or equal with the seam to the left of it (merges run from
        left to right), hence the two kinds of limits, doubled to stay integers.
        """
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), 2 * self.never, np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            seam = 2 * self.pair_rank(x, y)
            bad = seam < limit[live]
            ok[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            rx, ry = self.rank[x], self.rank[y]
            more = (rx >= 0) | (ry >= 0)
            live, x, y, rx, ry = live[more], x[more], y[more], rx[more], ry[more]
            # the right token's merge came last, or with an equal rank after the left one's
            undo_right = ry >= rx
            # left token undone: a seam merge of equal rank starts further right, so it comes later
            limit[live] = np.where(undo_right, 2 * ry + 1, 2 * rx)
            a[live] = np.where(undo_right, x, self.right[x])
            b[live] = np.where(undo_right, self.left[y], y)
        return ok


class SpeculativeBPE:
    """Encoder and decoder of one ``tokenizers`` file of word-end BPE."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n_ids = max([*self.vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * n_ids
        for s, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = s
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rules = PairRules(n_ids, [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs])
        self.letters = byte_letters()
        self._trie()
        self.special_at = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        letter, number = _class("L"), _class("N")
        # the file's pattern for characters below PLAIN_BELOW
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{SPACE}{letter}{number}]+")
        self.beyond = re.compile(f"[^\\x00-\\u{PLAIN_BELOW - 1:04x}]|\u0130")
        self.fine: dict[int, bool] = {}
        self.proposed = self.merged = 0

    # -- words ------------------------------------------------------------------

    def _trie(self) -> None:
        """All tokens as byte strings (the word end is symbol 256) in a trie of
        sorted arrays: key node * 257 + symbol, child, and the token that ends there."""
        back = {c: b for b, c in enumerate(self.letters)}
        self.byte_id, self.byte_end_id = np.zeros(256, np.int64), np.zeros(256, np.int64)
        children: dict[int, int] = {}
        ends, nodes = {}, 1
        for s, i in self.vocab.items():
            if s in self.special:
                continue
            ended = s.endswith(self.end) and len(s) > len(self.end)
            symbols = [back[c] for c in (s[:-len(self.end)] if ended else s)]
            if len(symbols) == 1:
                (self.byte_end_id if ended else self.byte_id)[symbols[0]] = i
            node = 0
            for c in [*symbols, 256] if ended else symbols:
                child = children.setdefault(node * 257 + c, nodes)
                nodes += child == nodes
                node = child
            ends[node] = i
        keys = np.array(sorted(children), np.int64)
        self.trie_keys, self.trie_child = keys, np.array([children[k] for k in keys.tolist()], np.int64)
        self.trie_token = np.full(nodes, -1, np.int64)
        self.trie_token[list(ends)] = list(ends.values())

    def propose(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match in every row of ``symbols`` (``size`` of them count)
        at once: tokens, and their number, -1 where a rest matches no token."""
        n, width = symbols.shape
        out, count = np.zeros((n, width), np.int64), np.zeros(n, np.int64)
        rows = np.arange(n)
        start, depth, node = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        best, token = np.zeros(n, np.int64), np.zeros(n, np.int64)
        while len(rows):
            at = start + depth
            c = symbols[rows, np.minimum(at, width - 1)]
            key = node * 257 + c
            k = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
            hit = (self.trie_keys[k] == key) & (at < size[rows])
            node = np.where(hit, self.trie_child[k], 0)
            depth = np.where(hit, depth + 1, 0)
            ended = hit & (self.trie_token[node] >= 0)
            token = np.where(ended, self.trie_token[node], token)
            best = np.where(ended, depth, best)
            miss = np.flatnonzero(~hit)
            if len(miss):
                r = rows[miss]
                out[r, count[r]] = token[miss]
                count[r] += 1
                start[miss] += best[miss]
                stuck = best[miss] == 0
                count[r[stuck]] = -1
                best[miss] = 0
                stay = np.ones(len(rows), bool)
                stay[miss[stuck | (start[miss] >= size[r])]] = False
                if not stay.all():
                    rows, start, depth, node, best, token = (x[stay] for x in (rows, start, depth, node, best, token))
        return out, count

    def learn(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Token ids of words: propose, check all adjacent pairs, mend."""
        made: dict[bytes, list[int]] = {}
        by_size = sorted(words, key=len)
        at = 0
        while at < len(by_size):
            # a block's words differ little in length and fill about 2^18 cells
            least, to = len(by_size[at]), at
            while to < len(by_size) and len(by_size[to]) <= least + 2 + least // 4 and (to - at) * least <= 1 << 18:
                to += 1
            made.update(self.learn_block(by_size[at:to]))
            at = to
        return made

    def learn_block(self, words: list[bytes]) -> dict[bytes, list[int]]:
        size = np.array([len(w) for w in words])
        width = int(size.max()) + 1
        symbols = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width).astype(np.int64)
        rows = np.arange(len(words))
        symbols[rows, size] = 256
        out, count = self.propose(symbols, size + 1)
        n = self.rules.n_ids
        pairs = out[:, :-1] * n + out[:, 1:]
        real = np.arange(1, width)[None, :] < count[:, None]
        flat = pairs[real]
        known, where = np.unique(flat, return_inverse=True)
        fine = self.fine
        new = np.array([p for p in known.tolist() if p not in fine], np.int64)
        if len(new):
            fine.update(zip(new.tolist(), self.rules.compatible(new // n, new % n).tolist()))
        good = count > 0
        verdict = np.array([fine[p] for p in known.tolist()], bool)
        good[np.nonzero(real)[0][~verdict[where]]] = False
        if len(fine) > 2_000_000:
            fine.clear()
        fits = np.flatnonzero(good)
        flat = out[fits][np.arange(out.shape[1])[None, :] < count[fits][:, None]].tolist()
        ends = np.cumsum(count[fits]).tolist()
        made = {words[k]: flat[a:b] for k, a, b in zip(fits.tolist(), [0, *ends], ends)}
        failing = np.flatnonzero(~good)
        self.proposed += len(words)
        self.merged += len(failing)
        if len(failing):
            letters = self.byte_id[np.minimum(symbols[failing, :-1], 255)]
            last = size[failing] - 1
            k = np.arange(len(failing))
            letters[k, last] = self.byte_end_id[symbols[failing, last]]
            made.update(zip([words[f] for f in failing], self.merge_block(letters, size[failing])))
        return made

    def merge_block(self, rows: np.ndarray, size: np.ndarray) -> list[list[int]]:
        """Exact merging of rows of single-letter tokens: the lowest-ranked pair
        of each row, leftmost first, one merge in every row at a time."""
        rules, never = self.rules, self.rules.never
        width, size = rows.shape[1], size.copy()
        ids = np.hstack([rows, np.zeros((len(rows), 1), np.int64)])
        cols = np.arange(width + 1)
        rank = np.full(ids.shape, never, np.int64)
        inside = cols[None, :] < size[:, None] - 1
        a, b = ids[:, :-1][inside[:, :-1]], ids[:, 1:][inside[:, :-1]]
        rank[inside] = rules.pair_rank(a, b)
        made: list[list[int]] = [[]] * len(rows)
        names = np.arange(len(rows))
        while len(names):
            j = rank.argmin(axis=1)
            k = np.arange(len(names))
            low = rank[k, j]
            done = low == never
            if done.any():
                for i in np.flatnonzero(done):
                    made[names[i]] = ids[i, :size[i]].tolist()
                go = ~done
                ids, rank, size, names, j, low = ids[go], rank[go], size[go], names[go], j[go], low[go]
                k = np.arange(len(names))
                if not len(names):
                    break
            ids[k, j] = rules.made[low]
            # close the gap that the merged pair leaves
            shift = np.minimum(cols[None, :] + (cols[None, :] > j[:, None]), width)
            ids = np.take_along_axis(ids, shift, 1)
            rank = np.take_along_axis(rank, shift, 1)
            rank[:, -1] = never
            size -= 1
            for at, has in ((j, j + 1 < size), (j - 1, j > 0)):
                kk, jj = k[has], at[has]
                rank[kk, jj] = rules.pair_rank(ids[kk, jj], ids[kk, jj + 1])
            last = j + 1 >= size
            rank[k[last], j[last]] = never
        return made

    # -- texts ------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """The words of a text between special tokens, as the library splits it."""
        if text.isascii() or (self.beyond.search(text) is None and unicodedata.is_normalized("NFC", text)):
            return self.split.findall(text.lower())
        back = {c: b for b, c in enumerate(self.letters)}
        norm = self.library.normalizer.normalize_str(text)
        return [bytes(back[c] for c in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]

    def sections(self, text: str) -> list[str]:
        """Words, and special tokens marked by a line break before them."""
        if not text:
            return []
        if self.special_at is None or "<" not in text:
            return self.words(text)
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += self.words(text[at:m.start()])
            out.append("\n" + m.group())
            at = m.end()
        return out + self.words(text[at:])

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """Ids of the words that :meth:`sections` gives."""
        marked = {w for w in words if w[0] == "\n"} if self.special else set()
        plain = list(words - marked)
        out = dict(zip(plain, map(self.learn(encoded := [w.encode() for w in plain]).__getitem__, encoded)))
        out.update((w, [self.special[w[1:]]]) for w in marked)
        return out

    def encode(self, text: str | None) -> list[int]:
        got = self.sections(text or "")
        ids = self.encode_words(set(got))
        return [i for w in got for i in ids[w]]

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: the tokens joined by spaces."""
        return " ".join(self.tokens[i] for i in ids if 0 <= i < len(self.tokens) and self.tokens[i])


class WordStore(dict):
    """word -> ``render(ids)``, filled for a batch of texts at a time."""

    def __init__(self, bpe: SpeculativeBPE, render):
        self.bpe, self.render = bpe, render

    def meet(self, words: set[str]) -> None:
        if len(self) > MAX_WORDS:
            self.clear()
        new = words.difference(self)
        if not new:
            return
        # a list a word, none in a cycle: the collector would walk through them again and again
        collects = gc.isenabled()
        gc.disable()
        try:
            learned = self.bpe.encode_words(new)
            self.update(zip(learned, map(self.render, learned.values())))
        finally:
            if collects:
                gc.enable()


_ENCODERS: dict[str, SpeculativeBPE] = {}
_STORES: dict[tuple[str, str], WordStore] = {}


def encoder(path: str) -> SpeculativeBPE:
    if path not in _ENCODERS:
        _ENCODERS[path] = SpeculativeBPE(path)
    return _ENCODERS[path]


def word_store(path: str, kind: str, render) -> WordStore:
    """The worker's store of one kind of rendering of words."""
    if (path, kind) not in _STORES:
        _STORES[path, kind] = WordStore(encoder(path), render)
    return _STORES[path, kind]


def forget_words() -> None:
    """Empty the worker's stores and encoders, before other work."""
    _STORES.clear()
    _ENCODERS.clear()


KEPT["bpe"] = forget_words


def sections_of(bpe: SpeculativeBPE, store: WordStore, texts, step: int = 1000) -> Iterator[list[list[str]]]:
    """The sections of the texts, a few texts at a time, all words in the store."""
    for i in range(0, len(texts), step):
        got = [bpe.sections(t or "") for t in texts[i:i + step]]
        store.meet(set().union(*got))
        yield got


def encode(df: DataFrame, tokenizer_path: str, *, text: str = "text", column: str = "ids") -> DataFrame:
    """Add the token ids of a text column as an array of int."""
    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        bpe = encoder(tokenizer_path)
        store = word_store(tokenizer_path, "ids", tuple)
        return pd.Series([[i for w in got for i in store[w]]
                          for part in sections_of(bpe, store, texts.tolist()) for got in part])
    return small_batches(df).withColumn(column, ids(F.col(text)))


def decode(df: DataFrame, tokenizer_path: str, *, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """Add the text of a column of token ids (null ids: empty text)."""
    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        bpe = encoder(tokenizer_path)
        return pd.Series([bpe.decode([] if r is None else list(r)) for r in rows])
    return df.withColumn(column, text(F.col(ids)))


def digests(df: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) without ever holding the
    ids of more than one document."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(tokenizer_path)
        store = word_store(tokenizer_path, "strings", lambda i: (
            len(i), " ".join(map(str, i)), " ".join(bpe.tokens[t] for t in i)))
        for batch in batches:
            rows = []
            for part in sections_of(bpe, store, batch.text.tolist()):
                for got in part:
                    found = list(map(store.__getitem__, got))
                    n, ids, toks = zip(*found) if found else ((), (), ())
                    rows.append((sum(n), hashlib.sha256(" ".join(ids).encode()).hexdigest(),
                                 hashlib.sha256(" ".join(toks).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch.doc_id.to_numpy())
            yield out
    return small_batches(df).select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
