"""A corpus pipeline of the operators: language ID, near-dedup, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clickloom.functions.storage import discard, scratch, written_at
from clickloom.llm import language_id, mixing, simhash, token_store, winnowing
from clickloom.llm.common import table
from clickloom.llm.queries import default_tokenizer


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, ``lang`` set to the predicted one; those without a letter or that no language fits go.

    Null and empty texts go; repeated rows are judged alike; without labelled text all with a letter stay as they are.
    """
    return language_id.with_language(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least doc_id; of its repeated rows one stays.

    Null and empty texts are one group; rows without doc_id stay.
    """
    return simhash.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item; null and empty texts share none, repeated rows are alike."""
    return winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document stays out, or comes once or twice, as its source's target asks.

    Texts without a word are not taken; a null source is a source; an empty table gives none.
    """
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files, read back: doc_id, start, n_tokens, ids_crc32; a row for each row, null texts as empty ones."""
    return token_store.tokenise(docs, default_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("simhash_near_dedup", one_of_each),
    ("benchmark_decontamination", without_benchmark),
    ("mix_sources", mixed),
    ("token_ids", token_ids),
]

#: Language models, fingerprints by XXH64 and a tokenizer are not expressible in SQL; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage has read is deleted when its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch():  # a stage's own tables go when its result is written
            docs, path = written_at(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        if before:
            discard(before)
        before = path
    return docs
