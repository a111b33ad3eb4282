"""From raw documents to packed sequences, a stage at a time.

Toxic documents go, then documents that fail quality rules, then all but one of
each near-duplicate group (five-word shingles, Jaccard 0.8); secrets in the rest
are replaced by a mark, and what remains is packed into sequences.

Defined cases, stage by stage: a null or empty text isn't toxic, but fails the
quality rules. Verdicts go by row, so null and repeated ids neither save nor cost
a document. Of rows that are equal, or whose texts are linked, one stays; texts
without words would stay each, by id and text. Texts of any length are read
whole. An empty table gives an empty table at every stage. All stages but the
last keep all columns, also those whose names occur inside the operators; the
size column ``n_chars`` follows redacted texts where it is an integer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import jaccard, packing, quality, secrets, toxicity
from tablewright.llm.common import read
from tablewright.llm.queries import tokenizer_file
from tablewright.scratch import clean, settle, settled_so_far


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("ngram_jaccard", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: The classifier and the tokenizer can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written before the next reads it; what a stage leaves behind goes."""
    docs, mark = read(spark, sf_dir, "documents"), settled_so_far()
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
        clean(spark, mark, keep=(docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
