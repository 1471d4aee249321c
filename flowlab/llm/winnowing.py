"""Document fingerprints by winnowing, in DataFrame functions only.

A text is a row of words (runs without white space, cut after 16 characters).
Every ``GRAM`` words in a row have a hash, rolled up from hashes of shorter runs;
of every ``WINDOW`` hashes in a row the smallest is kept, the rightmost of equal
ones. A hash kept is packed with its position into one long, so that taking
minima breaks ties by itself. Any passage of ``GRAM + WINDOW - 1`` words that two
texts share leaves them a hash in common, and the positions say where.

Defined results: null and empty texts have an empty fingerprint and two of them
a likeness of 1; a text of fewer words than a gram has one hash, of all its
words; texts are read whole (positions are modulo 2^23 words); equal texts have
equal fingerprints; rows of equal ids are told apart by their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored, with_row

GRAM, WINDOW = 5, 8
POSITION_BITS = 23
_LAST = (1 << POSITION_BITS) - 1
_HASH = (1 << (63 - POSITION_BITS)) - 1


def _shifted(array: str, by: int) -> Column:
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def with_fingerprint(df: DataFrame, text: str, column: str) -> DataFrame:
    """Add ``column``, the fingerprint: an array of longs, hash above position."""
    names = [fresh(df.columns, f"__{x}") for x in ("w", "h", "g2", "g4", "p", "m2", "m4")]
    w, h, g2, g4, p, m2, m4 = names
    pair = lambda a, b: F.xxhash64(a, b)
    out = df.withColumn(w, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S{1,16}+"), F.lit(0)))
    out = out.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    out = out.withColumn(g2, F.zip_with(h, _shifted(h, 1), pair))
    out = out.withColumn(g4, F.zip_with(g2, _shifted(g2, 2), pair))
    # ends that ran over the last word are cut off
    grams = F.slice(F.zip_with(g4, _shifted(h, GRAM - 1), pair), 1, F.greatest(F.size(h) - (GRAM - 1), F.lit(0)))
    grams = F.when(F.size(h).between(1, GRAM - 1), F.array(F.xxhash64(h))).otherwise(grams)
    out = out.withColumn(p, F.transform(grams, lambda x, i: F.shiftleft(x.bitwiseAND(_HASH), POSITION_BITS).bitwiseOR(
        F.lit(_LAST) - i.bitwiseAND(_LAST).cast("long"))))
    low = lambda a, b: F.least(a, b)  # noqa: E731  nulls past the end are passed over
    out = out.withColumn(m2, F.zip_with(p, _shifted(p, 1), low))
    out = out.withColumn(m4, F.zip_with(m2, _shifted(m2, 2), low))
    smallest = F.zip_with(m4, _shifted(m4, 4), low)
    windows = F.slice(smallest, 1, F.greatest(F.size(p) - (WINDOW - 1), F.lit(1)))
    return out.withColumn(column, F.array_distinct(windows)).drop(*names)


def hashes(fingerprint: Column) -> Column:
    return F.transform(fingerprint, lambda x: F.shiftright(x, POSITION_BITS))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints; 1 for two empty ones."""
    shared = F.size(F.array_intersect(hashes(a), hashes(b)))
    every = F.size(F.array_distinct(hashes(a))) + F.size(F.array_distinct(hashes(b))) - shared
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(shared / every)


def as_text(fingerprint: Column) -> Column:
    """hash:position of each entry, in hexadecimal and decimal, in text order."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(
        F.lower(F.hex(F.shiftright(x, POSITION_BITS))), F.lit(":"), (F.lit(_LAST) - x.bitwiseAND(_LAST)).cast("string"))), " ")


def next_rows(ids: DataFrame) -> DataFrame:
    """(row, next_row) by descending doc_id (null last), rows of equal id by
    place; the last row's next is the first.

    Ids are range-partitioned; only one row per partition meets in one place.
    """
    order = [F.desc_nulls_last("doc_id"), F.asc("row")]
    parts = stored(ids.select("doc_id", "row").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ids")
    within = Window.partitionBy("part").orderBy(*order)
    linked = parts.withColumn("next_row", F.lead("row").over(within))
    heads = (parts.withColumn("place", F.row_number().over(within)).filter("place = 1").select("part", F.col("row").alias("head")))
    following = heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")),
                                                F.first("head").over(Window.orderBy("part"))).alias("following"))
    return (linked.join(F.broadcast(following), "part")  # one row per partition
            .select("row", F.coalesce("next_row", "following").alias("next_row")))


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text (the last third replaced by
    the beginning of the next document) and of the next text."""
    rows = with_row(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "row")
    sizes = stored(rows.select("doc_id", "row", F.length("text").cast("long").alias("n_chars")), "sizes")
    nexts = next_rows(sizes).join(sizes.select("row", F.floor(F.col("n_chars") / 3).cast("int").alias("cut")), "row")
    # the same two columns by the same key on both sides: one shuffle of the texts serves both
    texts = rows.select("row", "text")
    before = nexts.withColumnRenamed("row", "before")
    tails = (texts.join(before, texts["row"] == before["next_row"])
             .select(F.col("before").alias("row"), "cut", F.substring(F.col("text"), F.lit(1), F.col("cut")).alias("tail"), F.col("text").alias("next_text")))
    tails = with_fingerprint(tails, "next_text", "next_fingerprint").drop("next_text")
    both = texts.join(tails, "row").withColumn(
        "edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - F.col("cut")), "tail"))
    both = with_fingerprint(with_fingerprint(both, "text", "fingerprint"), "edited", "edited_fingerprint")
    done = both.select("row", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "next_fingerprint")
    return sizes.join(done, "row").drop("row")
