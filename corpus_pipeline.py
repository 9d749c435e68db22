"""A training corpus from raw documents: toxic texts go, then exact copies, then near copies; sources are mixed, and texts encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import exact_dedup, mixing, ngram_join, sentencepiece_bpe, toxicity
from strandline.llm.common import remove_table, written_table
from strandline.llm.queries import model_path, ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones, doesn't call toxic.

    Null and empty texts are scored as empty ones; repeated rows and null ids stay as they are; without labels all stay; an empty table gives none.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal without white space: the longest, of several the smallest id.

    A null text is equal to an empty one; of rows that repeat an id and a text one stays; a null id comes after all others; an empty table gives none.
    """
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share four fifths of their five-word shingles, that of the smallest id.

    Texts without words are linked with nothing and stay, as do null texts; rows of one id go by their own text; an empty table gives none.
    """
    return ngram_join.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them.

    Rows with a null source are a source of their own; texts without words appear once for each whole pass over their source; an empty table gives none.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, for each row of the mix, repeats included; null texts are empty; an empty table gives none."""
    return sentencepiece_bpe.tokenize_documents(docs, model_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("SentencePiece", encode),
]

#: SQL can't express the classifier, the components or the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written once, as a compressed table that goes when the next stage's is there.

    The table before the last stage stays in the shared folder, as the result is read from it.
    """
    docs, before = ship(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, folder = written_table(stage(spark, docs, sf_dir))
        if before is not None:
            remove_table(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
