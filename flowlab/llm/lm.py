"""Document log-likelihood under a gated recurrent language model.

Words are runs without ASCII white space, A-Z lower-cased; each text ends with
an end token. The most frequent words and the end are tokens of their own (words
seen ``OFTEN`` times or more that make up at least one token in ``KNOWN``, and
the ``VOCABULARY`` most frequent ones in any case); all other words belong to one
of ``RARE`` classes by their last two bytes. The share bounds what is broadcast:
no more than ``KNOWN`` words can have it. The output softmax is factored, in
classes of about as many words as there are classes: the probability of a class given the
state, times that of the word in its class, which for frequent words depends on
the state and for rare words is their smoothed share of the class's count. One
slot per rare class is left for words never seen, so probabilities add up to 1.

Counts of words and classes are taken from all training rows by Spark. The
recurrent weights are learned in the tasks from all training rows, on top of
biases set from the counts: in each round every partition runs truncated
backpropagation over all its texts, piece by piece, from the weights of the last
round, and the results are averaged by their tokens, ``TOGETHER_MODELS`` at a
time, in tasks as well. Each window updates only the inputs and the classes it
met, so its cost follows its tokens, not the vocabulary. Only the average passes
through the driver. Scoring runs in the tasks: about ``POOL`` tokens of texts go
down lanes side by side, one text after the other, window after window, with
their states carried on, so every token of every text counts. States stand in
columns, led by a one for the biases; activations are worked on in blocks that
stay in the cache.

Words beyond the ``KNOWN`` most frequent are not sent to the tasks; their
counts are joined by hash (64 bits) afterwards, summed up per text.

Defined results: a null or empty text is its end token alone; texts of any
length are read whole; repeated rows get equal scores; without training rows
every token has probability 1 in the base and the score equals the base.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, fresh, release_memory, small_batches, stored, text_column, with_row
from .setjoin import CHUNK_BYTES, COUNT_TOKENS, Levels, by_owner, hash_words_and_ends, signed

VOCABULARY, CLASS_SIZE, RARE, KNOWN = 1023, 32, 8, 100_000
HIDDEN, WINDOW, TOGETHER = 16, 64, 512
END = VOCABULARY  # the end token's number in the smallest vocabulary; rare classes follow
OFTEN = 1000  # a word seen as often has enough to learn from
PIECE, LANES, TOGETHER_MODELS = 1 << 18, 256, 16
BLOCK = 1 << 17  # activations worked on at once
POOL, STATES = 1 << 21, 1 << 16  # tokens of texts scored together, and states whose outputs are


def rare_class(tails: np.ndarray) -> np.ndarray:
    return (tails * 2654435761 >> 7) % RARE


def class_size(vocabulary: int) -> int:
    """Words a class: the power of two next to the vocabulary's square root."""
    return max(CLASS_SIZE, 1 << round(math.log2(vocabulary + 1) / 2))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.minimum(x, 30, out=x)
    np.exp(x, out=x)
    x += 1.0
    return np.reciprocal(x, out=x)


def _framed(weights: np.ndarray, biases: np.ndarray) -> np.ndarray:
    """Outputs' weights with the biases above and ones below. For states in columns,
    led by a one, ``framed[:-1].T @ states`` are the activations; for their exponentials
    e, ``framed[1:] @ e`` are the weights summed up by e and, as last row, the sums of e."""
    out = np.empty((*weights.shape[:-2], HIDDEN + 2, weights.shape[-1]), weights.dtype)
    out[..., 0, :], out[..., 1:-1, :], out[..., -1, :] = biases, weights, 1
    return out


def _plain(framed: np.ndarray, most: float = 1.0) -> bool:
    """Whether activations from states in [-most, most] are so small that their
    exponentials and sums of them need no shift by the largest."""
    reach = most * np.abs(framed[..., 1:-1, :]).sum(axis=-2)
    return bool((framed[..., 0, :] + reach).max() < 60 and (framed[..., 0, :] - reach).max(axis=-1).min() > -60)


def _blocks(outputs: int, states: int) -> Iterator[slice]:
    """Blocks of states whose activations stay in the cache."""
    most = max(64, BLOCK // outputs)
    return (slice(a, min(a + most, states)) for a in range(0, states, most))


def _log_softmax_at(framed: np.ndarray, hs: np.ndarray, place: np.ndarray, most: float) -> np.ndarray:
    """For each column of ``hs``, of numbers up to ``most``, the log of the share of the output ``place[i]``."""
    out, plain = np.empty(len(place), hs.dtype), _plain(framed, most)
    for part in _blocks(framed.shape[-1], len(place)):
        x = framed[:-1].T @ hs[:, part]
        if not plain:
            x -= x.max(axis=0)
        out[part] = x[place[part], np.arange(x.shape[1])]
        np.exp(x, out=x)
        out[part] -= np.log(x.sum(axis=0))
    return out


def _log_sums(framed: np.ndarray, hs: np.ndarray, plain: bool, sums: np.ndarray, grad: np.ndarray) -> None:
    """Of the logs of the summed exponentials, which are a softmax's loss but for the
    activations aimed at: ``sums`` gets the gradient by the states times the sums of the
    exponentials, and these as last row; to ``grad`` that by biases and weights is added."""
    for part in _blocks(framed.shape[-1], hs.shape[1]):
        e = framed[:-1].T @ hs[:, part]
        if not plain:
            e -= e.max(axis=0)
        np.exp(e, out=e)
        got = np.matmul(framed[1:], e, out=sums[:, part])
        grad += (hs[:, part] / got[-1]) @ e.T


def _order(numbers: np.ndarray) -> np.ndarray:
    """The stable order of token numbers; small ones are sorted by digits."""
    return np.argsort(numbers.astype(np.uint16) if numbers.max(initial=0) < 1 << 16 else numbers, kind="stable")


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts and stops."""
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return starts, np.r_[starts[1:], len(ordered)]


@dataclass
class Network:
    """Gated recurrent units with a class-factored output. Inputs are numbers of
    frequent words, the end, and rare classes. The first classes hold equally
    many tokens each in order of frequency, the last ``RARE`` none."""
    weights: dict[str, np.ndarray]

    @staticmethod
    def start(class_mass: np.ndarray, token_mass: np.ndarray, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        n_in, n_class = len(token_mass) + RARE, len(class_mass)
        plain = n_class - RARE
        each = len(token_mass) // plain

        def small(*shape):
            return (rng.standard_normal(shape) * 0.1).astype(np.float32)

        return Network({"x": small(n_in, 3 * HIDDEN), "u": small(HIDDEN, 3 * HIDDEN), "g": np.zeros(3 * HIDDEN, np.float32),
                        "c": np.zeros((HIDDEN, n_class), np.float32), "cb": np.log(class_mass).astype(np.float32),
                        "w": np.zeros((plain, HIDDEN, each), np.float32),
                        "wb": np.log(token_mass).reshape(plain, each).astype(np.float32)})

    @property
    def end(self) -> int:
        """The number of the end token."""
        return self.weights["wb"].size - 1

    def cell(self, a: np.ndarray, h: np.ndarray, kept: tuple | None = None) -> np.ndarray:
        """The next states (in columns) from what the inputs add to the gates and the
        states; ``kept`` gets both gates, the candidate and the state's part in it."""
        zr, n, bn = kept or (None, None, None)
        b = self.weights["u"].T @ h
        zr = _sigmoid(np.add(a[:2 * HIDDEN], b[:2 * HIDDEN], out=zr))
        if bn is not None:
            bn[:] = b[2 * HIDDEN:]
        n = np.multiply(zr[HIDDEN:], b[2 * HIDDEN:], out=n)
        n += a[2 * HIDDEN:]
        np.tanh(n, out=n)
        new = h - n
        new *= zr[:HIDDEN]
        new += n
        return new

    def inputs(self, token: np.ndarray) -> np.ndarray:
        """What the inputs add to the gates: by step, gates in rows, tokens in columns."""
        fed = np.ascontiguousarray(np.moveaxis(self.weights["x"][token], -1, -2))
        fed += self.weights["g"][:, None]
        return fed

    def step(self, token: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        return self.cell(self.inputs(token), np.ascontiguousarray(h.T)).T, ()

    def class_of(self, token: np.ndarray) -> np.ndarray:
        plain, each = self.weights["wb"].shape
        return np.where(token <= self.end, token // each, plain + token - self.end - 1)

    def log_probability(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of each target's class, and of the token in it if frequent."""
        p, order = self.weights, _order(target)
        plain, each = p["wb"].shape
        hs, target = np.empty((HIDDEN + 1, len(target)), h.dtype), target[order]
        hs[0], hs[1:] = 1, np.take(h.T, order, axis=1)
        k, place = self.class_of(target), target % each
        most = float(np.abs(hs).max(initial=1))
        got = _log_softmax_at(_framed(p["c"], p["cb"]), hs, k, most).astype(float)
        for a, b in zip(*_runs(k)):
            c = k[a]
            if c >= plain:
                break
            got[a:b] += _log_softmax_at(_framed(p["w"][c], p["wb"][c]), hs[:, a:b], place[a:b], most)
        out = np.empty_like(got)
        out[order] = got
        return out

    def train(self, pieces: Iterator[np.ndarray], *, lanes: int = LANES, window: int = 16, rate: float = 0.01) -> int:
        """Truncated backpropagation over every token of streams, each cut into
        lanes; the number of tokens learned from."""
        p = self.weights
        first = {k: np.zeros_like(v) for k, v in p.items()}
        second = {k: np.zeros_like(v) for k, v in p.items()}
        t = seen = 0
        for stream in pieces:
            targets = len(stream) - 1
            if targets < 1:
                continue
            seen += targets
            n = max(1, min(lanes, targets // (2 * window)))
            length = -(-targets // n)
            # lanes overlap by one token; the last is filled up from the beginning
            rows = stream[(np.arange(n)[:, None] * length + np.arange(length + 1)) % len(stream)]
            h = np.zeros((n, HIDDEN), np.float32)
            for s in range(0, length, window):
                x, y = rows[:, s:s + window], rows[:, s + 1:s + window + 1]
                grad, h = self.gradient(x[:, :y.shape[1]], y, h)
                t += 1
                norm = math.sqrt(sum(float(np.vdot(g, g)) for _, g in grad.values()))
                # moments without their factors 0.1 and 0.01, which are in rate and floor
                root = math.sqrt(0.01 / (1 - 0.99 ** t))
                pace, floor = rate * 0.1 / (1 - 0.9 ** t) / root, 1e-6 / root
                for k, (at, g) in grad.items():
                    # moments and weights of the rows met alone
                    if norm > 5.0:
                        g *= 5.0 / norm
                    m, v = first[k][at], second[k][at]
                    m *= 0.9
                    m += g
                    g *= g
                    v *= 0.99
                    v += g
                    if not isinstance(at, slice):
                        first[k][at], second[k][at] = m, v
                    change = np.sqrt(v, out=g)
                    change += floor
                    np.divide(m, change, out=change)
                    change *= pace
                    p[k][at] -= change
        return seen

    def packed(self) -> bytes:
        return np.concatenate([self.weights[k].astype(np.float32).ravel() for k in sorted(self.weights)]).tobytes()

    def unpacked(self, packed: np.ndarray) -> Network:
        """A network of this shape with other weights."""
        out, at = {}, 0
        for k in sorted(self.weights):
            w = self.weights[k]
            out[k] = packed[at:at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
        return Network(out)

    def gradient(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[dict[str, tuple], np.ndarray]:
        """Of the mean loss of one window, by weight as (rows, gradient of those
        rows), all others being zero; the state after it, to carry on."""
        p, whole = self.weights, slice(None)
        n_lane, n_step = x.shape
        met, target = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T).reshape(-1)
        fed = self.inputs(met)
        going = (met != self.end)[:, None].astype(fed.dtype)  # a text starts without memory
        before, n, bn = (np.empty((n_step, HIDDEN, n_lane), fed.dtype) for _ in range(3))
        zr = np.empty((n_step, 2 * HIDDEN, n_lane), fed.dtype)
        hs = np.ones((HIDDEN + 1, n_step, n_lane), fed.dtype)
        h = np.ascontiguousarray(h.T)
        for j in range(n_step):
            np.multiply(h, going[j], out=before[j])
            h = self.cell(fed[j], before[j], (zr[j], n[j], bn[j]))
            hs[1:, j] = h
        # the loss is the mean of the logs of summed exponentials less the activations aimed at
        plain, each = p["wb"].shape
        order = _order(target)
        hs, target = np.take(hs.reshape(HIDDEN + 1, -1), order, axis=1), target[order]
        starts, _ = _runs(target)
        kinds, of_kind = target[starts], np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(target)]))
        class_of_kind = self.class_of(kinds)
        aimed = np.add.reduceat(hs, starts, axis=1)
        of_classes = _framed(p["c"], p["cb"])
        toward = of_classes[1:-1, class_of_kind]
        dh, grad_c = np.empty_like(hs), np.zeros_like(of_classes[:-1])
        _log_sums(of_classes, hs, _plain(of_classes), dh, grad_c)
        dh[:-1] /= dh[-1]
        firsts, _ = _runs(class_of_kind)
        grad_c[:, class_of_kind[firsts]] -= np.add.reduceat(aimed, firsts, axis=1)
        classes = class_of_kind[firsts]
        classes = classes[classes < plain]
        of_words = np.zeros((len(classes), HIDDEN + 1, each), fed.dtype)
        if len(classes):
            bounds = np.r_[starts[firsts], len(target)][:len(classes) + 1].tolist()
            framed = _framed(p["w"][classes], p["wb"][classes])
            sums, no_shift = np.empty_like(hs[:, :bounds[-1]]), _plain(framed)
            for f, g, a, b in zip(framed, of_words, bounds, bounds[1:]):
                _log_sums(f, hs[:, a:b], no_shift, sums[:, a:b], g)
            sums[:-1] /= sums[-1]
            dh[:-1, :bounds[-1]] += sums[:-1]
            frequent = int(np.searchsorted(kinds, self.end, side="right"))
            at, place = np.searchsorted(classes, class_of_kind[:frequent]), kinds[:frequent] % each
            toward[:, :frequent] += framed[at, 1:-1, place].T
            of_words[at, :, place] -= aimed[:, :frequent].T
        dh = dh[:-1]
        dh -= np.take(toward, of_kind, axis=1)
        for g in (dh, grad_c, of_words):
            g *= 1 / len(target)
        grad = {"c": (whole, grad_c[1:]), "cb": (whole, grad_c[0])}
        if len(classes) == plain:
            classes = whole
        grad["w"], grad["wb"] = (classes, of_words[:, 1:]), (classes, of_words[:, 0])
        back_to = np.empty_like(order)
        back_to[order] = np.arange(len(order))
        ahead = np.take(dh, back_to, axis=1).reshape(HIDDEN, n_step, n_lane)
        # what a step's gradient is times, for all steps at once
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        to_n = 1 - z
        to_z = before - n
        to_z *= z
        to_z *= to_n
        to_n *= 1 - n * n
        to_r = bn
        to_r *= r
        to_r *= 1 - r
        back = 0.0
        da, db_n = np.empty_like(fed), np.empty_like(before)
        both = np.empty((3 * HIDDEN, n_lane), fed.dtype)
        for j in range(n_step - 1, -1, -1):
            g = ahead[:, j] + back
            dn = np.multiply(g, to_n[j], out=da[j, 2 * HIDDEN:])
            np.multiply(g, to_z[j], out=da[j, :HIDDEN])
            np.multiply(dn, to_r[j], out=da[j, HIDDEN:2 * HIDDEN])
            np.multiply(dn, r[j], out=db_n[j])
            both[:2 * HIDDEN], both[2 * HIDDEN:] = da[j, :2 * HIDDEN], db_n[j]
            back = p["u"] @ both
            g *= z[j]
            back += g
            back *= going[j]
        flat = np.ascontiguousarray(da.transpose(0, 2, 1)).reshape(-1, 3 * HIDDEN)
        grad["g"] = whole, flat.sum(axis=0)
        da[:, 2 * HIDDEN:] = db_n
        grad["u"] = whole, np.matmul(before, da.transpose(0, 2, 1)).sum(axis=0)
        token = met.reshape(-1)
        order = _order(token)
        starts, _ = _runs(token[order])
        grad["x"] = token[order[starts]], np.add.reduceat(flat[order], starts, axis=0)
        return grad, h.T

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Sum of log probabilities of each text's tokens (the last is the end)."""
        out = np.zeros(len(texts))
        if not texts:
            return out
        sizes = np.array([len(t) for t in texts])
        # texts go one after the other down lanes of about the same length
        lanes: list[list[int]] = [[] for _ in range(max(1, min(TOGETHER, int(sizes.sum() // sizes.max()))))]
        filled = [(0, i) for i in range(len(lanes))]
        for i in np.argsort(-sizes, kind="stable").tolist():
            n, lane = filled[0]
            lanes[lane].append(i)
            heapq.heapreplace(filled, (n + int(sizes[i]), lane))
        lanes = [lanes[lane] for _, lane in sorted(filled, reverse=True)]
        n = np.array([sizes[lane].sum() for lane in lanes])
        flat = np.concatenate([texts[i] for lane in lanes for i in lane])
        text = np.repeat(np.concatenate(lanes).astype(np.int32), sizes[np.concatenate(lanes)])
        begins = np.r_[0, np.cumsum(n)[:-1]]
        h = np.zeros((HIDDEN, len(lanes)), self.weights["u"].dtype)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for a in range(0, int(n[0]), WINDOW):
            # lanes are in order of size: those still going are the first
            live = int((n > a).sum())
            steps = a + np.arange(min(WINDOW, int(n[0]) - a))
            going = np.searchsorted(-n[:live], -steps, side="left")
            at = np.minimum(begins[:live] + steps[:, None], len(flat) - 1)
            starting = (text[at] != text[at - 1]) | (at == begins[:live])
            some = starting.any(axis=1).tolist()
            h, fed = h[:, :live], self.inputs(np.where(starting, self.end, flat[at - 1]))
            met = at[np.arange(live) < going[:, None]]
            states, done = np.empty((HIDDEN, len(met)), h.dtype), 0
            for j, m in enumerate(going.tolist()):
                if some[j]:
                    h[:, starting[j]] = 0
                h[:, :m] = states[:, done:done + m] = self.cell(fed[j, :, :m], h[:, :m])
                done += m
            held.append((states, met))
            waiting += done
            if waiting >= STATES or a + WINDOW >= n[0]:
                met = np.concatenate([at for _, at in held])
                out += np.bincount(text[met], self.log_probability(np.concatenate([of for of, _ in held], axis=1).T, flat[met]), len(texts))
                held, waiting = [], 0
        return out


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int, list[bytes]]]:
    part, at, size = [], 0, 0
    for i, t in enumerate(texts):
        part.append((t or "").encode("utf-8", "replace"))
        size += len(part[-1])
        if size >= CHUNK_BYTES:
            yield at, i + 1, part
            part, at, size = [], i + 1, 0
    if part:
        yield at, len(texts), part


def word_counts(train: DataFrame) -> DataFrame:
    """(word, rare, count) of all words of all training texts, words as hashes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_memory()
        held, n = [], 0

        def counted():
            words = np.concatenate([w for w, _ in held]) if held else np.empty(0, np.uint64)
            rare = np.concatenate([r for _, r in held]) if held else np.empty(0, np.int64)
            held.clear()
            w, first, c = np.unique(words, return_index=True, return_counts=True)
            return pd.DataFrame({"word": signed(w), "rare": rare[first], "count": c})

        for batch in batches:
            for _, _, part in _chunks(batch.text.tolist()):
                words, _, tails = hash_words_and_ends(part)
                held.append((words, rare_class(tails)))
                n += len(words)
                if n > COUNT_TOKENS:
                    yield counted()
                    n = 0
        yield counted()
        release_memory()

    each = small_batches(train).select("text").mapInPandas(run, "word long, rare long, count long")
    return stored(each.groupBy("word").agg(F.first("rare").alias("rare"), F.sum("count").alias("count")), "words")


@dataclass
class Model:
    """Counts of the most frequent words (sorted by hash; ``number`` is the token
    number of the most frequent, -1 for others) and what the rest needs."""
    words: np.ndarray
    counts: np.ndarray
    number: np.ndarray
    end_count: int
    total: int
    distinct: int
    rare_mass: np.ndarray
    end: int
    network: Network | None
    levels: Levels | None = None

    def look_up(self, words: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, token) of words; a count of -1 is still to be joined."""
        if self.levels is None:
            self.levels = Levels(self.words, np.arange(1, len(self.words) + 1))
        at = self.levels.look_up(words) - 1  # the last, at -1, stands for words that are not there
        count, number = np.r_[self.counts, -1][at], np.r_[self.number, -1][at]
        return count, np.where(number >= 0, number, self.end + 1 + rare_class(tails))


def learned(train: DataFrame, model: Model, network: Network, rate: float) -> Network:
    """One round: ``network`` trained by every partition on all its texts, and averaged."""
    shared = train.sparkSession.sparkContext.broadcast((model, network))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, start = shared.value
        own = start.unpacked(np.frombuffer(start.packed(), np.float32))

        def pieces() -> Iterator[np.ndarray]:
            held, n = [np.array([model.end])], 0
            for batch in batches:
                for _, _, part in _chunks(batch.text.tolist()):
                    words, owner, tails = hash_words_and_ends(part)
                    ends = np.cumsum(np.bincount(owner, minlength=len(part)))
                    held.append(np.insert(model.look_up(words, tails)[1], ends, model.end))
                    n += len(held[-1])
                    if n >= PIECE:
                        stream = np.concatenate(held)
                        at = 0
                        while len(stream) - at > PIECE:
                            yield stream[at:at + PIECE + 1]
                            at += PIECE
                        held, n = [stream[at:]], len(stream) - at - 1
            yield np.concatenate(held)

        seen = own.train(pieces(), rate=rate)
        if seen:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "tokens": [seen], "weights": [own.packed()]})
        release_memory()

    def average(group: pd.DataFrame) -> pd.DataFrame:
        group, total = group.sort_values("part"), int(group.tokens.sum())
        mean = np.zeros(len(group.weights.iloc[0]) // 4)
        for w, n in zip(group.weights, group.tokens):
            mean += np.frombuffer(w, np.float32) * (n / total)
        return pd.DataFrame({"part": [int(group.part.iloc[0]) // TOGETHER_MODELS], "tokens": [total],
                             "weights": [mean.astype(np.float32).tobytes()]})

    schema = "part long, tokens long, weights binary"
    parts = stored(train.select("text").mapInPandas(run, schema), "networks")
    while parts.count() > 1:
        fewer = stored(parts.groupBy(F.floor(F.col("part") / TOGETHER_MODELS)).applyInPandas(average, schema), "networks")
        drop_tables(parts)
        parts = fewer
    packed = parts.first()["weights"]
    drop_tables(parts)
    shared.destroy()
    return network.unpacked(np.frombuffer(packed, np.float32))


def fit(train: DataFrame, *, rates: tuple[float, ...] = (0.01, 0.003)) -> tuple[Model, DataFrame]:
    """(model, counts). ``train`` needs text; it is read once for the counts and
    once for each round of training, at the rates given."""
    counts = word_counts(train)
    n_texts = train.count()
    top = counts.orderBy(F.desc("count"), "word").limit(KNOWN).toPandas()
    sums = counts.agg(F.sum("count").alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(sums["n"] or 0) + n_texts, int(sums["v"]) + (n_texts > 0)
    by_class = {r["rare"]: (int(r["n"]), int(r["v"])) for r in
                counts.groupBy("rare").agg(F.sum("count").alias("n"), F.count("*").alias("v")).collect()}
    # words seen often enough, in number and in share (so that they are all in ``top``)
    often = int(((top["count"] >= OFTEN) & (top["count"] * KNOWN >= total)).sum())
    each = class_size(max(VOCABULARY, often))
    # whole classes, the end being the last token
    size = -(-(max(VOCABULARY, often) + 1) // each) * each - 1
    frequent = top.head(size)
    gone = frequent.groupby("rare")["count"].agg(["sum", "count"])
    tokens, kinds = np.zeros(RARE), np.zeros(RARE)
    for k in range(RARE):
        n, v = by_class.get(k, (0, 0))
        tokens[k] = n - (gone["sum"].get(k, 0))
        kinds[k] = v - (gone["count"].get(k, 0))
    order = np.argsort(top.word.to_numpy(np.int64).view(np.uint64))
    number = np.where(np.arange(len(top)) < size, np.arange(len(top)), -1)
    model = Model(top.word.to_numpy(np.int64).view(np.uint64)[order], top["count"].to_numpy(np.int64)[order], number[order],
                  n_texts, total, distinct, tokens + kinds + 1, size, None)
    if not n_texts:
        return model, counts
    mass = np.zeros(size + 1)
    mass[:len(frequent)] = frequent["count"]
    mass[size] = n_texts
    mass = mass + 0.1
    by_group = mass.reshape(-1, each)
    classes = np.r_[by_group.sum(axis=1), tokens + kinds + 1]
    network = Network.start(classes / classes.sum(), (by_group / by_group.sum(axis=1, keepdims=True)).ravel())
    for rate in rates:
        network = learned(train, model, network, rate)
    model.network = network
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score")
    key = fresh(rows.columns, "__row")
    rows = with_row(rows, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        log_rare = np.log10(m.rare_mass)
        held: list[tuple[pd.DataFrame, list[np.ndarray]]] = []

        def pooled() -> Iterator[pd.DataFrame]:
            """What is held, texts scored together."""
            scores = m.network.score([t for _, texts in held for t in texts]) / np.log(10) if m.network is not None else None
            at = 0
            for frame, _ in held:
                if scores is not None:
                    frame["share"] += scores[at:at + len(frame)]
                at += len(frame)
                yield frame
            held.clear()

        waiting = 0
        for batch in batches:
            for a, b, part in _chunks(batch.text.tolist()):
                words, owner, tails = hash_words_and_ends(part)
                count, token = m.look_up(words, tails)
                n = np.bincount(owner, minlength=len(part))
                found = count >= 0
                logs = np.where(found, np.log10(np.maximum(count, 0) + 1.0), 0.0)
                rare = token > m.end
                base = np.bincount(owner, logs, len(part)) + np.log10(m.end_count + 1.0)
                known = np.bincount(owner[found & (count > 0)], minlength=len(part)) + (m.end_count > 0)
                share = np.bincount(owner, np.where(rare, logs - log_rare[np.maximum(token - m.end - 1, 0)], 0.0), len(part))
                texts = np.split(np.insert(token.astype(np.int32), np.cumsum(n), m.end), np.cumsum(n + 1)[:-1])
                # the distinct words of each text that are still to be joined
                word, of = words[~found], owner[~found]
                order = by_owner(word, of, len(part))
                word, of = word[order], of[order]
                first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (of[1:] != of[:-1])][:len(word)])
                cuts = np.searchsorted(of[first], np.arange(1, len(part)))
                held.append((pd.DataFrame({"row": batch.row.to_numpy()[a:b], "n_tokens": n + 1, "known": known, "base": base, "share": share,
                                           "words": np.split(signed(word[first]), cuts),
                                           "times": np.split(np.diff(np.r_[first, len(word)]), cuts)}), texts))
                waiting += len(token)
                if waiting >= POOL:
                    yield from pooled()
                    waiting = 0
        yield from pooled()
        release_memory()

    schema = "row long, n_tokens long, known long, base double, share double, words array<long>, times array<long>"
    parts = stored(rows.select(F.col(key).alias("row"), text_column().alias("text")).mapInPandas(run, schema), "scores")
    tail = (parts.filter(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "times")).alias("t"))
            .select("row", F.col("t.words").alias("word"), F.col("t.times").alias("times")))
    joined = (tail.join(counts.select("word", "count"), "word").groupBy("row")
              .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("count") + 1.0)).alias("logs")))
    whole = parts.drop("words", "times").join(joined, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    per_token = float(np.log10(model.total + model.distinct + 1))
    base = F.col("base") + logs - F.col("n_tokens") * F.lit(per_token)
    final = whole.select(F.col("row").alias(key), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                         F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"),
                         (F.col("share") + logs if model.network is not None else base).alias("score"))
    return rows.join(final, key).drop(key)
