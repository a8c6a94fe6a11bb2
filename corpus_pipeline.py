"""The corpus pipeline: documents that pass the quality classifier lose lines that many share, one document of each
near-duplicate group stays, contaminated documents go, and what is kept is encoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.llm import quality_classifier
from signalspark.llm.bpe import token_digests
from signalspark.llm.common import in_fold, stored
from signalspark.llm.decontaminate import drop_contaminated
from signalspark.llm.line_dedup import drop_common_lines
from signalspark.llm.queries import tokenizer_files
from signalspark.llm.simhash import keep_one
from signalspark.session import table


def _apart(docs: DataFrame) -> DataFrame:
    """What the operators look at, and the other columns in one: an operator's columns don't replace a row's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*others).alias("own")] if others else []))


def _together(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    return rows.select(*(changed.get(c, F.col(c) if c in ("doc_id", "text") else F.col("own").getField(c)).alias(c) for c in columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more; the model learns from the labels outside the held-out fold."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"), learn_from=~in_fold("doc_id", 3, 1))
    return _together(quality_classifier.scored(_apart(docs), model).filter("predicted = 1"), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that ten or more documents share; n_chars follows the text."""
    kept = drop_common_lines(_apart(docs), min_docs=10, min_chars=1)
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else "long"
    return _together(kept, docs.columns, n_chars=F.length("text").cast(kind))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return keep_one(docs, shingle_words=3, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold benchmark passages in a twentieth of their words or more."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=13, hits_per_100=5)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token count and digests of every document that is left."""
    vocabulary, pattern = tokenizer_files()
    return token_digests(docs.select("doc_id", "text"), vocabulary=vocabulary, pattern=pattern).drop("text")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encoding),
]

#: A learned score, XXH64 fingerprints and BPE merges have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each keeps is stored before the next, which may read its input more than once."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
