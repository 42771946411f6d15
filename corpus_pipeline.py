"""Corpus preparation: the stages that turn ``documents`` into token ids.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame`` on all rows its
predecessor kept; ``run`` writes every stage's result as Parquet under the
shared checkpoint folder and reads it again as the next stage's input. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kbweave.llm import decontaminate, linedup, quality, simhash
from kbweave.llm import sentencepiece_codec as spm
from kbweave.llm.common import saved
from kbweave.llm.queries import MODEL
from kbweave.sources.tables import load_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is in their language's range.

    Null and empty texts are judged like other short ones, a null language is one of its
    own, rows of one id (a null id too) stay or go together; an empty table stays empty."""
    verdict = quality.quality_classifier(docs, load_table(spark, sf_dir, "labels"))
    return quality.drop_rejected(docs, verdict)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later copies of maximal repeated line runs of 50 characters or more.

    A null text stays null, one whose lines all go becomes empty; rows equal in id and
    text keep the same lines; ``n_chars`` follows a changed text."""
    return linedup.drop_repeated_lines(docs, min_lines=1, min_chars=50)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (smallest id) of every SimHash group.

    Texts without words (null, empty) have fingerprint zero and are one group; rows of
    the id that stays all stay."""
    return simhash.near_dedup(docs, shingle=4, max_bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold or paraphrase no benchmark item.

    Null and empty texts match nothing; rows of one id go together; an empty table or
    benchmark drops nothing."""
    return decontaminate.drop_contaminated(docs, load_table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids instead of text, with count, parity and round trip.

    A null or empty text has no ids; every row stays, with all its other columns."""
    return spm.encode(docs, MODEL)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", tokenize),
]

# Perplexities, fingerprints and token ids are not expressible in SQL; the tests
# hold every stage against a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
