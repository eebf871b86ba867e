"""A training-data pipeline of five stages over ``documents``.

Every stage reads the whole output of the one before, as a written table; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratalake.llm import bpe, decontaminate, langid, ngram_join, pii
from stratalake.llm.common import read, stored
from stratalake.llm.queries import PII_KEY

#: Documents go whose best language has a smaller share of their words than this many even shares; ``und`` ones go as well.
EVEN_SHARES = 1.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those that look like no learned language."""
    model = langid.learn(docs.select("doc_id", "text", "lang"))
    least = EVEN_SHARES / len(model.langs) if len(model.langs) > 1 else 0.0
    return langid.identify(docs, model).where(f"lang_pred <> '{langid.UNKNOWN}' and score >= {least}").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of similar texts."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put pseudonyms for personal data; ``n_chars`` follows the text."""
    changed = pii.pseudonymise_documents(docs, PII_KEY)
    if "n_chars" in docs.columns:
        changed = changed.selectExpr(*("if(size(pii_kinds) > 0, length(text), n_chars) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns))
    return changed.select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode to ids, with digests of the ids and of what they decode to."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: SQL has no conditional random field and no byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the written output of the one before."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
