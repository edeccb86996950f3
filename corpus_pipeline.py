"""From raw documents to packed sequences: the language of each document, near duplicates, repeated passages, the mix of sources, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as Parquet and
read again. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedira.llm import jaccard, langid, mixing, packing, substrings
from sedira.llm.common import WORD, Scratch, read

#: A document whose spans are no surer of their languages than this (however many languages they are), or that has no letters, is rejected.
LEAST_SURE = 0.25
#: SQL cannot express the stages (Viterbi, a least-squares packing); tests hold their operators against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. The model is learned from a bounded sample of the labelled ones."""
    model = langid.fit(langid.sample(docs))
    found = langid.identify(docs, model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("sure") >= LEAST_SURE)).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: five words, a similarity of 0.8."""
    return jaccard.deduplicate(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences of passages that occur earlier; those of which nothing is left go."""
    cut = substrings.remove(docs)
    kept = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))  # line breaks before the first sentence are nothing
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return kept.select(*(new[c].alias(c) if new.get(c) is not None else F.col("doc")[c].alias(c) for c in docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the weights of the sources say."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, and where each stands in which sequence."""
    return packing.pack_documents(docs, packing.default_tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packed", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in sf_dir; each stage's result is written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
