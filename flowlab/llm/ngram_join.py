"""N-gram Jaccard join by set relations: documents whose shingle sets are
similar, and the components that these links make.

Two levels skip work. In the index, posting lists are cut into blocks by set
size and every posting knows its position: blocks whose sizes do not fit are
never met (the block is part of the join key), and postings too far down a
prefix are dropped; pairs whose 512-bit parity sketches differ in more places
than similar sets can are never emitted. Among answers, each set is first compared with one or two
leaders per posting list; for a set that resembles a leader the difference to
it is kept, and later comparisons of two sets that resemble the same leader are
derived from the two differences, without their texts. Pairs that are connected
already are not compared at all, which changes no component.

Defined results: null, empty and white-space texts have no shingles and are
linked with nothing; texts of any length are read whole; rows of equal text or
equal id are kept as rows; a null doc_id takes part and can never be the
smallest; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, fresh, stored, with_row
from .graph import components
from .setjoin import Units, among, describe, fitting, leader_pairs, near_enough, plausible, shared_postings, size_blocks, sketches, verify, with_rows


def derived(pairs: DataFrame, references: DataFrame, kind: Units) -> tuple[DataFrame, DataFrame]:
    """(answers, rest): the linked flag of pairs whose sets have differences to
    the same reference, and the pairs that have not."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            linked = []
            for n, la, ea, lb, eb in zip(batch.n, batch.xl, batch.xe, batch.yl, batch.ye):
                la, lb = np.frombuffer(la, "<u4"), np.frombuffer(lb, "<u4")
                ea, eb = np.frombuffer(ea, "<u8"), np.frombuffer(eb, "<u8")
                a, b = n - len(la) + len(ea), n - len(lb) + len(eb)
                same = n - len(np.union1d(la, lb)) + len(np.intersect1d(ea, eb, assume_unique=True))
                linked.append(100 * same >= kind.percent * (a + b - same))
            yield pd.DataFrame({"x": batch.x, "y": batch.y, "linked": np.array(linked, bool)})

    def side(name: str) -> DataFrame:
        asked = among(references, pairs.select(F.col(name).alias("row")), of="node")
        return asked.select(F.col("node").alias(name), F.col("ref").alias(f"{name}r"), F.col("n").alias(f"{name}n"),
                            F.col("lacks").alias(f"{name}l"), F.col("extra").alias(f"{name}e"))

    met = pairs.join(side("x"), "x", "left").join(side("y"), "y", "left")
    same = F.coalesce(F.col("xr") == F.col("yr"), F.lit(False))
    answers = (met.filter(same).select("x", "y", F.col("xn").alias("n"), "xl", "xe", "yl", "ye")
               .mapInPandas(run, "x long, y long, linked boolean"))
    return answers, met.filter(~same).select("x", "y")


def crossing_rows(postings: DataFrame, joined: DataFrame) -> DataFrame:
    """Postings of tokens in which components meet, with ``component`` and the
    list's largest component, ``main``. ``joined`` is (node, component)."""
    rows = postings.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = rows.groupBy("token", "component").agg(F.count("*").alias("size"))
    lists = (sizes.groupBy("token").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("parts"))
             .filter("parts > 1").select("token", "main"))
    return rows.join(lists, "token")


def crossing_pairs(rows: DataFrame, kind: Units) -> DataFrame:
    """All pairs of ``crossing_rows`` (with sketches) of one token that pass the
    filters and are not connected yet."""
    block, near = size_blocks("n", kind)
    # every pair between two components has a side outside the list's main one
    outside = rows.filter("component <> main").withColumn("block", F.explode(near))
    a, b = outside.alias("a"), rows.withColumn("block", block).alias("b")
    return (a.join(b, ["token", "block"]).filter(F.expr("a.component <> b.component") & fitting("a", "b", kind) & near_enough("a", "b", kind))
            .select(F.least("a.node", "b.node").alias("x"), F.greatest("a.node", "b.node").alias("y")).distinct())


def ngram_components(docs: DataFrame, *, k: int = 5, percent: int = 75, row: str | None = None) -> DataFrame:
    """(row, doc_id, n_shingles, component, component_id) of every row of ``docs``:
    rows are linked when 100 * shared shingles >= percent * shingles of both.
    ``component`` names the component even where no row of it has an id; it is
    null for empty texts. ``row`` names a column of row numbers, if there is one."""
    kind = Units(lines=False, k=k, percent=percent)
    rows = with_rows(docs, row)
    units, counts = describe(rows, kind)
    # one row per set: the first of its rows, and its smallest id
    sets = units.filter("n > 0").groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("first_id"))
    sets = stored(sets, "sets")
    # from here on a set goes by its first row, so that its text is read from the input
    found = shared_postings(rows, counts, kind)
    postings = stored(found.join(sets.select("node", "row"), "node").select("token", F.col("row").alias("node"), "n", "pos"), "postings")
    drop_tables(found)
    wanted = stored(postings.select(F.col("node").alias("row")).distinct(), "wanted")
    texts = rows.select(F.col("row").alias("node"), "text")

    leaders = stored(leader_pairs(postings, kind, "node"), "pairs")
    sketched = stored(sketches(among(texts, wanted, of="node"), kind), "sketches")
    # of those that sketches leave, pairs that have half of their shingles in common serve as references
    checked = stored(verify(plausible(leaders, sketched, kind), texts, kind, differences=True), "answers")
    first = components(checked.filter("linked").select(F.col("x").alias("a"), F.col("y").alias("b")))
    alike = checked.filter(2 * F.col("both") >= F.col("nx") + F.col("ny") - F.col("both"))
    best = alike.groupBy("y").agg(F.max_by("x", F.struct("both", "x")).alias("x"))
    references = alike.join(best, ["x", "y"]).select(F.col("y").alias("node"), F.col("x").alias("ref"), F.col("nx").alias("n"), "lacks", "extra")

    def settle(pairs: DataFrame) -> DataFrame:
        """The linked ones of pairs: derived where both sides have a reference, else counted."""
        answers, others = derived(stored(pairs, "pairs"), references, kind)
        return stored(answers.filter("linked").select("x", "y").unionByName(
            verify(others, texts, kind).filter("linked").select("x", "y")), "answers")

    crossing = stored(crossing_rows(postings, first), "crossing")
    more = settle(crossing_pairs(crossing.join(sketched.drop("n"), "node"), kind).join(
        leaders.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), ["x", "y"], "left_anti"))
    links = (first.select(F.col("node").alias("a"), F.col("component").alias("b"))
             .unionByName(more.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    groups = components(links).withColumnRenamed("component", "grouped")
    # the components are stored: only units and sets are read from here on
    drop_tables(postings, wanted, leaders, sketched, checked, crossing)
    labels = (sets.join(groups.withColumnRenamed("node", "row"), "row", "left")
              .withColumn("grouped", F.coalesce("grouped", "row")))
    smallest = labels.groupBy("grouped").agg(F.min("first_id").alias("component_id"))
    labels = labels.join(smallest, "grouped").select("node", "component_id", "grouped")
    return (units.join(labels, "node", "left")
            .select("row", "doc_id", F.col("n").alias("n_shingles"), F.col("grouped").alias("component"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component, the first by (doc_id, place; null
    ids last), and all rows without words."""
    key = fresh(docs.columns, "__row")
    marked = with_row(docs, key)
    labels = stored(ngram_components(marked, row=key, **options).filter("component is not null").select("row", "doc_id", "component"), "labels")
    first = labels.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"))
    gone = stored(labels.join(first, "component").filter("row <> first.row").select("row"), "gone")
    # only rows that may go are shuffled
    may_go = fresh(marked.columns, "__may_go")
    marked = among(marked, gone, of=key, mark=may_go)
    kept = marked.filter(F.col(may_go)).join(gone.withColumnRenamed("row", key), key, "left_anti")
    return marked.filter(~F.col(may_go)).unionByName(kept).select(*docs.columns)
