"""A corpus pipeline of five stages, each an operator of ``framewright.llm`` at work on what the last kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as Parquet in the
shared folder and the next stage reads it.  All stages but the last return the columns of ``documents``.

Defined results, as the operators have them: null text counts as empty; repeated rows and null ids are of the
class of their text, of which one row stays; an empty table gives an empty one; columns that are named like an
operator's own pass through, up to the last stage, which returns ids, counts and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import bpe, decontam, near_dup, pii, quality
from framewright.llm.queries import DEMONSTRATION_KEY, table, tokenizer_path
from framewright.llm.scratch import discard, materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, learned from the labelled rows of the stage's documents; rejected ones go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2; one document of each class stays."""
    return near_dup.NearDuplicates(docs).keep_one()


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8; documents with any benchmark window go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5; every document stays, with pseudonyms in its text."""
    return pii.pseudonymise(docs, DEMONSTRATION_KEY)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7; ids of every document, and digests of them and of their decoded text."""
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_private),
    ("bpe", tokenize),
]

#: SQL expresses neither the learned stage nor the sampled one; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            discard(before)  # the next stage's table is whole
    return docs
