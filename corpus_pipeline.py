"""A training corpus in five stages, each one operator over all documents that the stage before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; what one returns is written as Parquet and read again as the
docs of the next. All but the last return the columns of documents, and the rows that stay.

Defined results, of each stage as of its operator: a null text counts as empty, scores 0, has no item of the benchmark and is
packed as one end token. Rows equal but for white space are one; a row with a null doc_id comes after all others there, and
is no near copy. Texts are taken whole. Empty tables give no rows, and without labels of both kinds no text is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantaloom.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from quantaloom.llm._common import cut, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window scores below the operator's threshold."""
    net = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, net, toxicity.THRESHOLD)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the one with the smallest doc_id."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 or more on five-word shingles, the one with the smallest doc_id."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found, up to edits of a fifth of its words."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The network, the fingerprints and the tokenizer can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
