"""From raw documents to token ids: language, near copies, benchmark leaks, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. run() writes every stage's rows
as Parquet to the shared folder and reads them again, so that each is computed once and survives lost executors.
In every stage an empty table gives an empty one, repeated rows fare alike unless a stage says otherwise, columns of
other names are carried along, and very long texts are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelark.llm import bpe, decontaminate, langid, pii, simhash
from tidelark.llm.common import table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: NULL, empty and letterless texts, and those in which none stands out."""
    return langid.keep_identified(docs, langid.fit_languages(docs, langid.learned()))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies, and one row of each repeated id.

    NULL and wordless texts are near copies of each other. A NULL id stays.
    """
    return simhash.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage; NULL and wordless texts hold none."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def masked_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind and sets n_chars anew; NULL texts stay NULL."""
    return pii.mask_pii(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left, one row a row; NULL texts count as empty, which have no tokens."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("benchmark", no_benchmark),
    ("personal_data", masked_personal_data),
    ("encoding", encoded),
]

#: SQL can't express the kernel classifier or the merges; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
