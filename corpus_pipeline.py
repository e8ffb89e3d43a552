"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame; ``run`` writes each result as Parquet and reads it back for the
next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.base import ready, table
from strata.llm.language import UNDECIDED, identify, train
from strata.llm.near_text import near_duplicates
from strata.llm.overlap import decontaminated
from strata.llm.packing import pack_documents
from strata.llm.private_spans import redact
from strata.session import Scratch, closing

#: Encoding and language models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
_KEY = "_document_key"
#: A language is not taken for one when another is more likely beyond three to one.
LEAST_SCORE = 0.25


def _keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds the document's number; a row without one, or whose number another text has too, is known by a hash of both."""
    own = F.xxhash64("doc_id", "text")
    texts = F.xxhash64("text")
    shared = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(texts).alias("a"), F.max(texts).alias("b")).where("a <> b")
    shared = scratch.table(shared.select("doc_id", F.lit(True).alias("_shared")), "shared")
    alone = F.col("doc_id").isNotNull() & F.col("_shared").isNull()
    key = F.when(alone, F.col("doc_id").cast("long")).otherwise(own)
    return docs.join(shared, "doc_id", "left").select(*docs.columns, key.alias(_KEY))


def _numbered(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.col(_KEY).alias("doc_id"), "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that operator 10 finds in no language.

    Those are null, empty and letterless texts, and texts whose language has a score
    below ``LEAST_SCORE``. Where no language could be learned, texts with a letter stay.
    """
    ready(spark)
    model = train(docs)
    if model.families is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = identify(docs, model)
    return told.where((F.col("lang_pred") != UNDECIDED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest number stays.

    Rows with the same number and text are one document, of which one row stays. Rows
    with the same number and other texts are documents of their own, and come by a hash.
    """
    ready(spark)
    scratch = Scratch(spark)
    keyed = _keyed(docs, scratch)
    found = scratch.table(near_duplicates(_numbered(keyed), scratch), "found")
    # written, so that their size is known where they meet the texts, which are shuffled once at most
    marks = found.groupBy(F.col("doc_id").alias(_KEY)).agg(F.max(~F.col("kept")).alias("gone"), F.count(F.lit(1)).alias("n"))
    marks = scratch.table(marks.where("gone or n > 1").select(_KEY, "gone"), "marks")
    again = scratch.table(marks.where("not gone").select(_KEY), "again")
    once = keyed.join(again, _KEY, "left_semi").dropDuplicates([_KEY, "text"])
    return keyed.join(marks.select(_KEY), _KEY, "left_anti").unionByName(once).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    ready(spark)
    scratch = Scratch(spark)
    keyed = _keyed(docs, scratch)
    found = decontaminated(_numbered(keyed), table(spark, sf_dir, "benchmark"), scratch)
    bad = scratch.table(found.where("contaminated").select(F.col("doc_id").alias(_KEY)).distinct(), "contaminated")
    return keyed.join(bad, _KEY, "left_anti").select(*docs.columns)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind; every document stays."""
    ready(spark)
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of encoded documents with their places in sequences of 2048 ids."""
    ready(spark)
    return pack_documents(docs, Scratch(spark))


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("pii", privacy),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage leaves goes once the next one is written."""
    ready(spark)
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with closing():
            made = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
