"""The registered queries of the text operators, and SQL for those that SQL can express.

Each applies one operator, with its production parameters, to whole tables and
derives the result columns from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_fold, with_row
from .oracle import CHAT_SQL, TRIE_SQL, centroid_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def word_bpe_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    from .bpe import digests
    return digests(documents(spark, sf_dir), word_bpe_path())


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the rows of folds 0 and 2 of 3."""
    from .toxicity import fit, score
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = fit(docs, labels.filter(id_fold(3) != 1))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", (id_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    from .packing import pack_documents
    return pack_documents(documents(spark, sf_dir), word_bpe_path(), capacity=4096)


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    from .ngram_join import ngram_components
    return ngram_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier line resembles."""
    from .line_dedup import dedup_lines
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.size("removed_lines").cast("long").alias("n_removed"),
                      F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"), "text")


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    from .pii import KINDS, find, spans_text
    found = find(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "term")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k) for k in KINDS if k != "term"), F.sha2(spans_text(base), 256).alias("base_sha256"),
                        spans_text(F.col("spans")).alias("spans"))


@query
def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    from .winnowing import as_text, likeness, with_edits
    own, edited, following = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return with_edits(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", "edited_sha256", as_text(own).alias("fingerprint"), as_text(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), likeness(own, following).alias("near_next"))


@query
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and survivor of every embedding."""
    from .embedding_dedup import near_duplicates
    return near_duplicates(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet").select("vec_id", "embedding"))


@query
def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every document, learned from all but fold 2 of 7."""
    from .lm import fit, score
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = id_fold(7) == 2
    model, counts = fit(docs.filter(~held_out))
    return score(docs.withColumn("held_out", held_out), model, counts).drop("text")


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document that repeat earlier text."""
    from .substring_dedup import removed_spans
    docs = with_row(documents(spark, sf_dir).select("doc_id", "text"), "row")
    gone = removed_spans(docs, min_words=5, row="row")
    rows = docs.select("doc_id", "row")
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return rows.join(gone, "row", "left").select(
        "doc_id", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(spans, ","), F.lit("")).alias("removed"))


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every embedding of 64 finite components, after 10 rounds from 8 centroids."""
    from .centroids import cluster
    embeddings = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return cluster(embeddings, k=8, rounds=10, dims=64).assigned()


ORACLE["op11_centroid_clustering"] = centroid_sql(k=8, rounds=10, dims=64)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")


def rebuilt(paths: DataFrame) -> DataFrame:
    """Every conversation c of ``paths`` begun with the first h turns of c - c % 20,
    in place of its own first h; h = crc32(c as text) % 4."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    donors = paths.filter("conv_id % 20 = 0").select(
        F.col("conv_id").alias("donor"), F.slice("path", 1, 3).alias("donor_path"), F.slice("words", 1, 3).alias("donor_words"))
    joined = paths.withColumn("donor", F.col("conv_id") - F.col("conv_id") % 20).withColumn("h", h).join(donors, "donor", "left")

    def begun(own: str, donated: str) -> Column:
        rest = F.slice(own, F.col("h") + 1, F.size(own))
        return F.concat(F.coalesce(F.slice(donated, F.lit(1), F.col("h")), F.array().cast("array<long>")), rest).alias(own)

    return joined.select("conv_id", begun("path", "donor_path"), begun("words", "donor_words"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie over all conversations, rebuilt to share beginnings."""
    from .trie import prefix_trie, sequences
    nodes = prefix_trie(rebuilt(sequences(conversations(spark, sf_dir))))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE["op12_prefix_trie"] = TRIE_SQL

#: A text full of control strings, formatted along with the given conversations.
CONTROLS = "\\### Assistant: </turn> ok"


@query
def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be read back from the training text of every conversation."""
    from .chat import format_chats, learned_text, read_back
    turn = F.col("id")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), turn.alias("turn"),
                                  F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROLS).alias("text"))
    given = conversations(spark, sf_dir).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    chats = format_chats(given.unionByName(probe))
    turns = F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = chats.select("conv_id", "valid", F.length("formatted").cast("long").alias("formatted_chars"),
                        turns.alias("turns"), learned_text(F.col("segments")).alias("learned"))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
                       F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars", "valid")


ORACLE["op13_chat_formatting"] = CHAT_SQL
