"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct five-word shingles (with fewer words, the
whole line), ordered by rarity. Prefix, positional and length filters leave few
candidate pairs; their Jaccard similarity is counted exactly. A line is removed
when an earlier line of the corpus has the same tokens or at least ``percent``
hundredths of them in common; earlier is by (doc_id, place in the input, line
number). The rest of each text stays as it was.

Equal sets are settled by one aggregate. Of the others only the question
whether *some* earlier line matches matters, so each is first compared with the
earliest lines of its posting lists, and only lines without a match so far are
compared with all earlier ones.

Defined results: blank lines and null or empty texts never match and stay
(a null text stays null); null ids rank first; rows of equal id rank by their
place in the input; a text all of whose lines go becomes empty and its row
stays; an empty table gives an empty result. Lines end at a line feed. Columns
of the input are kept; ``removed_lines`` replaces a column of that name.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import Scope, drop_tables, fresh, stored, with_row
from .setjoin import Units, among, describe, fitting, leader_pairs, plausible, shared_postings, size_blocks, sketches, unit_texts, verify, with_rows


def later_matches(postings: DataFrame, texts: DataFrame, kind: Units) -> DataFrame:
    """Nodes with an earlier similar node; ``postings`` carry ``rank``."""
    ranks = postings.groupBy("node").agg(F.first("rank").alias("rank"))

    def late(answers: DataFrame) -> DataFrame:
        linked = answers.filter("linked").select("x", "y")
        return (linked.join(ranks.select(F.col("node").alias("x"), F.col("rank").alias("xr")), "x")
                .join(ranks.select(F.col("node").alias("y"), F.col("rank").alias("yr")), "y")
                .select(F.when(F.col("xr") < F.col("yr"), F.col("y")).otherwise(F.col("x")).alias("node")).distinct())

    leaders = stored(leader_pairs(postings, kind, "rank"), "pairs")
    sketched = stored(sketches(texts, kind), "sketches")
    found = stored(late(verify(plausible(leaders, sketched, kind), texts, kind)), "matched")
    # size blocks, as part of the key
    block, near = size_blocks("n", kind)
    rows = postings.withColumn("block", block)
    left = postings.join(found, "node", "left_anti").withColumn("block", F.explode(near))
    pairs = (left.alias("b").join(rows.alias("a"), ["token", "block"])
             .filter(F.expr("a.rank < b.rank") & fitting("a", "b", kind))
             .select(F.col("a.node").alias("x"), F.col("b.node").alias("y")).distinct()
             .join(leaders, ["x", "y"], "left_anti"))
    rest = plausible(pairs, sketched, kind)
    return found.unionByName(late(verify(rest, texts, kind))).distinct()


def removed_lines(docs: DataFrame, *, k: int = 5, percent: int = 75, row: str | None = None) -> DataFrame:
    """(row, removed_lines) of the rows of ``docs`` that lose lines, with the
    numbers of those lines in order. ``row`` names a column of row numbers, if
    there is one."""
    kind = Units(lines=True, k=k, percent=percent)
    rows = with_rows(docs, row)
    units, counts = describe(rows, kind)
    units = units.filter("n > 0")
    with Scope() as work:
        postings = shared_postings(rows, counts, kind)
        sharing = postings.select("node").distinct().withColumn("shares", F.lit(True))
        sets = units.groupBy("node").agg(F.min(F.struct("doc_id", "row", "unit")).alias("rank"), F.count("*").alias("copies"))
        # sets with neither copies nor shared postings are settled: they stay
        sets = stored(sets.join(sharing, "node", "left").filter("copies > 1 or shares"), "sets")
        ranked = stored(postings.join(sets.select("node", "rank"), "node"), "postings")
        drop_tables(postings)
        wanted = ranked.groupBy("node").agg(F.first("rank").alias("rank")).select("rank.row", "rank.unit", "node")
        texts = unit_texts(rows, wanted, kind)
        matched = later_matches(ranked, texts, kind).withColumn("late", F.lit(True))
    bad = sets.join(matched, "node", "left").filter("copies > 1 or late").select(
        "node", F.col("rank.row").alias("first_row"), F.col("rank.unit").alias("first_unit"), F.coalesce("late", F.lit(False)).alias("late"))
    bad = stored(bad, "bad")
    work.drop()
    # lines of other sets need not be shuffled
    gone = among(units, bad.select(F.col("node").alias("row")), of="node").join(bad, "node").filter("late or row <> first_row or unit <> first_unit")
    return gone.groupBy("row").agg(F.array_sort(F.collect_list("unit")).alias("removed_lines"))


@F.pandas_udf(StringType())
def without_lines(texts: pd.Series, numbers: pd.Series) -> pd.Series:
    """Each text without the lines of the given numbers (null: none)."""
    out = []
    for text, gone in zip(texts, numbers):
        if text is not None and gone is not None:
            gone = set(gone)
            text = "\n".join([line for i, line in enumerate(text.split("\n")) if i not in gone])
        out.append(text)
    return pd.Series(out, dtype=object)


def dedup_lines(docs: DataFrame, *, k: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with later similar lines taken out of ``text``, and the numbers
    of those lines in ``removed_lines``."""
    docs = docs.drop("removed_lines")
    key = fresh(docs.columns, "__row")
    base = with_row(docs, key)
    gone = removed_lines(base, k=k, percent=percent, row=key).withColumnRenamed("row", key)
    numbers = F.col("removed_lines")
    # texts that lose nothing need not be shuffled
    gone = stored(gone, "removed")
    loses = fresh(base.columns, "__loses")
    marked = among(base, gone.select(F.col(key).alias("row")), of=key, mark=loses)
    joined = marked.filter(F.col(loses)).join(gone, key, "left")
    changed = (joined.withColumn("text", F.when(numbers.isNull(), F.col("text")).otherwise(without_lines("text", numbers)))
               .withColumn("removed_lines", F.coalesce(numbers, F.array().cast("array<int>"))))
    same = marked.filter(~F.col(loses)).withColumn("removed_lines", F.array().cast("array<int>"))
    return changed.unionByName(same).drop(key, loses)
