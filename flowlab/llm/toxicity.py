"""Toxicity score: a weighted lexicon matched by an Aho-Corasick automaton.

Text is folded first (case, accents, homoglyphs, digit substitutions), then one
automaton finds every lexicon entry that starts a word; the weights of the
entries found, normalised by text length, go through a logistic curve.
Exception phrases cancel the hits they cover.

``fit`` learns the lexicon, its weights, learned exceptions and the curve from
labelled documents: at most ``max_per_class`` rows of each label (chosen by a
hash of the id) take part, four fifths for the lexicon and the rest for the curve,
so that weights are not judged on the rows they were learned from.

Defined results: a null or empty text has no hits and gets the score of a text
without any; texts of any length are read whole; repeated rows get equal scores;
rows labelled twice count once per label row; with no labelled rows of either
kind the score is 0 for every text. Columns of the input are kept; the score
replaces a column of the same name.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release_memory, small_batches

#: Letters of other scripts and signs that are read as Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "@": "a", "$": "s", "€": "e", "£": "l", "ı": "i", "ø": "o", "ł": "l", "ß": "ss",
}
#: Digits that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "circus clown", "clown fish")

MIN_PREFIX, MAX_PREFIX = 4, 8


def _fold_table() -> dict[int, str | None]:
    """Code point -> folded text for everything below U+2100 and the full-width
    forms: letters lose case and accents, digits and homoglyphs become letters,
    marks and zero-width characters go, all else separates words."""
    table: dict[int, str | None] = {}
    for c in [*range(0x2100), *range(0xFF01, 0xFF5F)]:
        ch = chr(c)
        base = "".join(x for x in unicodedata.normalize("NFKD", ch.lower()) if not unicodedata.combining(x))
        if unicodedata.category(ch) in ("Mn", "Me", "Cf"):
            table[c] = None
            continue
        base = "".join(HOMOGLYPHS.get(x, DIGITS.get(x, x)) for x in base)
        table[c] = base if base and all(x.isalnum() for x in base) else " "
    return table


class _Fold(dict):
    def __missing__(self, c):
        ch = chr(c)
        self[c] = ch if ch.isalnum() else " "
        return self[c]


FOLD = _Fold(_fold_table())


def fold(text: str | None) -> str:
    """Folded words, each with one space before it and one at the end."""
    return " " + " ".join((text or "").translate(FOLD).split()) + " "


def entries_of(word: str) -> Iterator[str]:
    """Lexicon entries a folded word can match: itself, and its beginnings."""
    yield f" {word} "
    for k in range(MIN_PREFIX, min(MAX_PREFIX, len(word)) + 1):
        yield f" {word[:k]}"


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = ()
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_automaton": None}

    def automaton(self):
        import ahocorasick

        if self._automaton is None:
            a = ahocorasick.Automaton()
            for entry, w in self.weights.items():
                a.add_word(entry, (len(entry), w))
            for phrase in self.exceptions:
                p = fold(phrase)
                if p.strip():
                    a.add_word(p, (len(p), 0.0))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def features(self, text: str | None) -> tuple[float, float, float]:
        """(log of the summed weight, weight per square root of words, largest weight)."""
        a = self.automaton()
        if not len(a) or not text:
            return 0.0, 0.0, 0.0
        folded = fold(text)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in a.iter(folded):
            start = end - n + 1
            if w == 0.0:
                spared.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        if spared and best:
            best = {s: w for s, w in best.items() if not any(x <= s < y for x, y in spared)}
        if not best:
            return 0.0, 0.0, 0.0
        total = sum(best.values())
        words = folded.count(" ") - 1
        return math.log1p(total), total / math.sqrt(words), max(best.values())

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.curve:
            return np.zeros(len(x))
        b = np.asarray(self.curve)
        return 1.0 / (1.0 + np.exp(-np.clip(b[0] + x @ b[1:], -30, 30)))


def score_column(model: ToxicityModel, text: Column) -> Column:
    """Score between 0 and 1 of a text column."""
    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        x = np.array([model.features(t) for t in texts], dtype=float).reshape(-1, 3)
        return pd.Series(model.probability(x))
    return toxicity(text)


def score(df: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    return small_batches(df).withColumn(column, score_column(model, F.col("text")))


def training_rows(docs: DataFrame, labels: DataFrame, max_per_class: int) -> DataFrame:
    """(doc_id, toxic, fold, text) of at most ``max_per_class`` labelled rows of
    each label, those with the lowest hash of their id."""
    chosen = None
    seen = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    for value in (0, 1):
        part = (seen.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class))
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)))
    # at most 2 * max_per_class ids, so the texts need not be shuffled
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def _count_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    toxic: Counter[str] = Counter()
    clean: Counter[str] = Counter()

    release_memory()

    def flush():
        keys = list(toxic.keys() | clean.keys())
        out = pd.DataFrame({"entry": pd.Series(keys, dtype=object), "toxic_docs": [toxic[k] for k in keys], "clean_docs": [clean[k] for k in keys]})
        toxic.clear()
        clean.clear()
        return out

    for batch in batches:
        for text, y in zip(batch.text, batch.toxic):
            (toxic if y else clean).update({e for w in set(fold(text).split()) for e in entries_of(w)})
            if len(toxic) + len(clean) > 300_000:  # bounded memory; counts are added up later
                yield flush()
    yield flush()
    release_memory()


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method."""
    design = np.hstack([np.ones((len(x), 1)), x])
    b = np.zeros(design.shape[1])
    penalty = ridge * np.eye(len(b))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ b, -30, 30)))
        grad = design.T @ (p - y) + penalty @ b
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty + 1e-9 * np.eye(len(b)), grad)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def fit(docs: DataFrame, labels: DataFrame, *, max_per_class: int = 8000, max_entries: int = 3000,
        min_docs: int = 3, min_evidence: float = 20.0, exceptions: tuple[str, ...] = EXCEPTIONS) -> ToxicityModel:
    """Learn from ``docs`` that ``labels`` marks (``toxic`` 0 or 1).

    ``max_per_class`` bounds the labelled rows of each label that take part,
    ``max_entries`` the lexicon; an entry needs ``min_docs`` toxic documents
    and a log-likelihood ratio of ``min_evidence``.
    """
    rows = training_rows(small_batches(docs), labels, max_per_class)
    counts = (rows.filter("fold > 0").select("text", "toxic")
              .mapInPandas(_count_entries, "entry string, toxic_docs long, clean_docs long")
              .groupBy("entry").agg(F.sum("toxic_docs").alias("t"), F.sum("clean_docs").alias("c")))
    totals = {r["toxic"]: r["n"] for r in rows.filter("fold > 0").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel({}, exceptions)

    def term(k, n, rate):
        return F.when(k > 0, k * F.log(k / (n * rate))).otherwise(0.0)

    t, c = F.col("t"), F.col("c")
    rate = (t + c) / F.lit(n1 + n0)
    evidence = 2 * (term(t, n1, rate) + term(c, n0, rate))
    weight = F.log((t + 0.5) / F.lit(n1 + 1.0)) - F.log((c + 0.5) / F.lit(n0 + 1.0))
    scored = counts.withColumn("w", weight).withColumn("g", evidence)
    lexicon = (scored.filter((t >= min_docs) & (F.col("w") > 1.5) & (F.col("g") >= min_evidence))
               .orderBy(F.desc("g"), "entry").limit(max_entries).select("entry", "w").collect())
    weights = {r["entry"]: float(r["w"]) for r in lexicon}
    prefixes = [e for e in weights if not e.endswith(" ")]
    learned: list[str] = []
    if prefixes:
        begins = None
        for k in range(MIN_PREFIX, MAX_PREFIX + 1):
            of_k = [e for e in prefixes if len(e) == k + 1]
            if of_k:
                test = F.substring("entry", 1, k + 1).isin(of_k)
                begins = test if begins is None else begins | test
        learned = [r["entry"].strip() for r in
                   scored.filter(F.col("entry").endswith(" ") & begins & (c >= 5) & (F.col("w") < 0))
                   .orderBy(F.desc("c"), "entry").limit(max_entries).select("entry").collect()]
    model = ToxicityModel(weights, tuple(exceptions) + tuple(learned))

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([list(model.features(x)) for x in texts])

    held = rows.filter("fold = 0").select("toxic", features("text").alias("x")).collect()
    y = np.array([r["toxic"] for r in held], dtype=float)
    if len(y) and 0 < y.sum() < len(y):
        model.curve = _logistic(np.array([r["x"] for r in held], dtype=float), y)
    return model
