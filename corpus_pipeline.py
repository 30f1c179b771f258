"""From raw documents to token digests: quality rules, line dedup, near-duplicate removal, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next one's ``docs``. All but the last return the columns of documents. When
a stage begins, what the one before left in the shared folder is deleted, unless ``docs``
still reads it. In every stage nulls are allowed in any column, rows that repeat are rows
of their own, and an empty table gives an empty result; the operators' docstrings say
what becomes of each.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from graphstrata.llm.bpe import digest_documents, vocabulary_path
from graphstrata.llm.jaccard import keep_one
from graphstrata.llm.lines import drop_lines
from graphstrata.llm.mixing import sample
from graphstrata.llm.quality import keep_good
from graphstrata.runtime import delete, discard, materialize, recorded

_left: list[str] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _left else []
        delete(spark, [p for p in _left if not any(p in file for file in read)])
        with recorded() as made:
            out = f(spark, docs, sf_dir)
        _left[:] = made
        return out

    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or whose host is rejected, go. A null text has no words, so it fails; a null source is no host."""
    return keep_good(docs)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; every document stays. A null text stays null; repeated rows count each."""
    return drop_lines(docs, 10)


@_stage
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest id; a null id is smallest only among nulls. Texts without words all stay."""
    return keep_one(docs)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay with the probabilities that raked weights give. Null sources and languages are a value of their own; rows that share an id go together."""
    return sample(docs)


@_stage
def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; a null text is empty."""
    return digest_documents(docs, vocabulary_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", mixing),
    ("BPE encoding and decoding", bpe),
]

#: SQL can't express raking to convergence nor the vocabulary's merges; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all stages leave of ``documents``, each one's result written before the next."""
    docs, spent = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        kept = materialize(stage(spark, docs, sf_dir))
        if spent is not None:
            discard(spent)
        docs = spent = kept
    return docs
