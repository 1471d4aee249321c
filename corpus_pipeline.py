"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, to be written
as Parquet and read again as the next stage's documents; all but the last keep
the columns of ``documents``. A stage's result must have been written before the
next stage is called, as ``run`` does: the tables it reads are dropped then.
Empty tables pass through every stage; null and empty texts are kept to the end,
where each is one piece with only the end token.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm import line_dedup, ngram_join, packing, pii, toxicity
from flowlab.llm.common import Scope, documents, id_fold, stored
from flowlab.llm.queries import word_bpe_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_BEFORE: list[Scope] = []


def stage(fn: Stage, last: bool = False) -> Stage:
    """A stage that first drops the tables its predecessor worked with: by now that
    one's result has been written and read again. Those of the last stage stay
    until the application ends, for its result may yet be read."""
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _BEFORE:
            _BEFORE.pop().drop()
        with Scope() as scope:
            if not last:
                _BEFORE.append(scope)
            return fn(spark, docs, sf_dir)
    return run_stage


def _with_length(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, ``n_chars`` brought up to date where there is one."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return docs.select(*like.columns)


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below 0.7; learned without fold 1 of 3, as in the query."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = toxicity.fit(docs, labels.filter(id_fold(3) != 1))
    return toxicity.score(docs, model, "__toxicity").filter(F.col("__toxicity") < 0.7).select(*docs.columns)


@stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that resemble an earlier line of the corpus."""
    return _with_length(line_dedup.dedup_lines(docs), docs)


@stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


@stage
def clean_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data generalised and what reveals it removed."""
    return _with_length(pii.sanitise(docs), docs)


@partial(stage, last=True)
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, packed into sequences."""
    return packing.pack_documents(docs, word_bpe_path(), capacity=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("PII", clean_personal_data),
    ("best-fit packing", pack),
]

#: The stages use learned models and set joins that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    docs = documents(spark, sf_dir)
    for name, apply in STAGES[:-1]:
        docs = stored(apply(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
