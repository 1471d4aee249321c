"""Substring dedup by hashing lines and the sentences in them.

A unit is a line, cut further after sentence ends (., ! or ? before white
space), so that passages inside longer lines are found too. Units are
normalised: lower case, white space collapsed, punctuation at the ends left
out. Their 128-bit digests are grouped over the whole corpus; the occurrence
that ranks first by (doc_id, place in the input, unit) stays. A line that repeats
an earlier line as a whole always goes. Other later occurrences, sentences in
lines that are new as a whole, go where they make up a run of neighbouring
repeated units of at least ``min_words`` words, so that chance repeats of short
sentences stay.

Removed spans keep their offsets in the original text (code points, end
exclusive). Defined results: blank units never repeat; null and empty texts
lose nothing (a null text stays null); null ids rank first; a repeated row is a
later occurrence of all its units; an empty table gives an empty result; other
columns are kept, ``removed`` replaces a column of that name.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches, stored, with_row

BOUNDARY = re.compile(r"\n|[.!?]+(?=\s)")
ENDS = " \t.,;:!?\"'()[]"


def units_of(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised) of the units of a text that hold words."""
    at = 0
    for m in [*BOUNDARY.finditer(text), None]:
        end = len(text) if m is None else m.end()
        plain = " ".join(text[at:end].lower().split()).strip(ENDS)
        if plain:
            yield at, end, plain
        at = end


def pieces_of(text: str) -> Iterator[tuple[int, int, int, int, bool, str]]:
    """(first unit, last unit, start, end, whole line, normalised) of the units
    and, where a line holds several, of the line."""
    line, k = [], 0

    def whole() -> Iterator[tuple[int, int, int, int, bool, str]]:
        for i, (a, b, plain) in enumerate(line, k - len(line)):
            yield i, i, a, b, len(line) == 1, plain
        if len(line) > 1:
            a, b = line[0][0], line[-1][1]
            yield k - len(line), k - 1, a, b, True, " ".join(text[a:b].lower().split()).strip(ENDS)

    for u in units_of(text):
        if line and "\n" in text[line[-1][1] - 1:u[0]]:
            yield from whole()
            line = []
        line.append(u)
        k += 1
    yield from whole()


def unit_table(rows: DataFrame) -> DataFrame:
    """(doc_id, row, unit, last, start, end, words, whole, hi, lo)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at:at + 1000]
                found, owner = [], []
                for i, text in enumerate(part.text.tolist()):
                    for k, last, a, b, whole, plain in pieces_of(text or ""):
                        x = xxhash.xxh3_128_intdigest(plain)
                        found.append((k, last, a, b, plain.count(" ") + 1, whole, x >> 64, x & 0xFFFFFFFFFFFFFFFF))
                        owner.append(i)
                kinds = (*[np.int32] * 5, bool, np.uint64, np.uint64)
                columns = [np.array(c, t) for c, t in zip(zip(*found), kinds)] if found else [np.empty(0, t) for t in kinds]
                out = pd.DataFrame(dict(zip(("unit", "last", "start", "end", "words", "whole"), columns)))
                out["hi"], out["lo"] = columns[6].view(np.int64), columns[7].view(np.int64)
                owner = np.array(owner, int)
                out.insert(0, "row", part.row.to_numpy()[owner])
                out.insert(0, "doc_id", part.doc_id.to_numpy()[owner])
                yield out
    schema = "doc_id long, row long, unit int, last int, start int, end int, words int, whole boolean, hi long, lo long"
    return stored(small_batches(rows).mapInPandas(run, schema), "units")


def removed_spans(docs: DataFrame, *, min_words: int = 20, row: str | None = None) -> DataFrame:
    """(row, removed) of rows that lose something: spans in order. ``row`` names a
    column of row numbers, if there is one."""
    if row is None:
        docs, row = with_row(docs.select("doc_id", "text"), "row"), "row"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"), "text")
    units = unit_table(rows)
    place = F.struct("doc_id", "row", "unit")
    repeated = (units.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.min(F.when(F.col("whole"), place)).alias("line"), F.count("*").alias("n"))
                .filter("n > 1").select("hi", "lo", F.col("first.row").alias("first_row"), F.col("first.unit").alias("first_unit"),
                                        F.col("line.row").alias("line_row"), F.col("line.unit").alias("line_unit")))
    later = (units.select("row", "unit", "last", "start", "end", "words", "whole", "hi", "lo").join(repeated, ["hi", "lo"])
             .filter("row <> first_row or unit <> first_unit")
             .withColumn("whole", F.expr("whole and (row <> line_row or unit <> line_unit)")))
    by_row = later.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("unit", "last", "start", "end", "words", "whole"))).alias("units"))

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def runs(lists: pd.Series) -> pd.Series:
        def spans_of(run: list) -> Iterator[dict]:
            if sum(x["words"] for x in run) >= min_words:
                yield {"start": int(run[0]["start"]), "end": int(run[-1]["end"])}
                return
            for whole, some in itertools.groupby(run, lambda x: bool(x["whole"])):
                if whole:
                    some = list(some)
                    yield {"start": int(some[0]["start"]), "end": int(some[-1]["end"])}

        out = []
        for units in lists:
            spans, run, at = [], [], -1
            # a line comes before the units it covers
            for u in [*sorted(units, key=lambda u: (u["unit"], -u["last"])), None]:
                if u is not None and u["last"] <= at:
                    continue
                if run and (u is None or u["unit"] != at + 1):
                    spans += spans_of(run)
                    run = []
                if u is not None:
                    run.append(u)
                    at = u["last"]
            out.append(spans)
        return pd.Series(out)

    return by_row.select("row", runs("units").alias("removed")).filter(F.size("removed") > 0)


def dedup_substrings(docs: DataFrame, *, min_words: int = 20) -> DataFrame:
    """``docs`` with ``removed``, the spans that repeat earlier text, and without
    them in ``text``."""
    docs = docs.drop("removed")
    key = fresh(docs.columns, "__row")
    marked = with_row(docs, key)
    gone = removed_spans(marked, min_words=min_words, row=key).withColumnRenamed("row", key)
    joined = marked.join(gone, key, "left").drop(key)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, some in zip(texts, spans):
            if text is not None and some is not None and len(some):
                kept, at = [], 0
                for s in some:
                    kept.append(text[at:s["start"]])
                    at = s["end"]
                text = "".join(kept) + text[at:]
            out.append(text)
        return pd.Series(out, dtype=object)

    none = F.array().cast("array<struct<start:int,end:int>>")
    return (joined.withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(cut("text", "removed")))
            .withColumn("removed", F.coalesce("removed", none)))
