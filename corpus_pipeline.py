"""A corpus pipeline of five operators: each stage works on all rows that the one before it kept.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``. Rows with a null id pass
the filters, null texts stay null until they are encoded as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionsift.llm import bpe, decontaminate, ngram_join, pii, toxicity
from ionsift.llm.common import forget, fresh, materialize, table

#: Near-duplicate stage: five-word shingles, similarity of 0.8 or more.
WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier takes for toxic go; null texts count as empty, null ids and repeated rows are judged like any."""
    score = fresh(docs, "score")
    judged = toxicity.with_score(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), score)
    return judged.where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; rows that repeat it stay too, and rows with a null id."""
    linked = ngram_join.link(docs.select("doc_id", "text"), PERCENT, WORDS)
    gone = linked.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark item leaks into go, with all rows of their id; rows with a null id stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in brackets; ``n_chars`` follows. All rows stay, null texts as null."""
    done = pii.redact(docs)
    return (done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of ids and decoded text."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("pii", redact_personal_data),
    ("bpe", encode),
]
#: The first, third and fourth stages have no SQL form; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
