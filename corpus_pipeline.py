"""A pipeline from raw documents to packed training sequences, stage by stage.

Every stage but the last returns the columns of its input. It works on all rows that the stage
before kept; what it rejects is gone, what it changes in a text stays changed. Between stages the
rows are written to the shared folder and read again, so a lost executor costs tasks of one stage.

Defined cases: documents without text or letters go in the first stage; rows with a null doc_id are
kept where their text is; of repeated rows one stays; an empty table gives no sequences; further
columns of the documents are carried to the last stage and may have any name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm import jaccard, language, lines, packing, pii
from fieldtally.llm.shared import fresh, named, table, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Least score of a document, as a part of the usual score of its language's labelled documents.
LEAST_SCORE = 0.4
END_ID = 1


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars after a change of the texts, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language known from the labelled ones."""
    model = language.fit(docs)
    found, score = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    judged = language.identify(docs, model, lang_out=found, score_out=score)
    of, usual = fresh("language", judged.columns), fresh("usual", judged.columns)
    limits = language.usual_scores(docs, model).select(F.col("language").alias(of), F.col("usual").alias(usual))
    judged = judged.join(limits, F.col(found) == F.col(of), "left")
    least = LEAST_SCORE * F.coalesce(usual, F.lit(1.0))
    known = (F.col(found) != language.UNKNOWN) & (F.col(score) >= least)
    return judged.where(known).select(*named(docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted, without their frequent lines.

    A line's count of documents decides alone: a share would let it grow with its host.
    """
    return _sized(lines.cleaned(docs, share=None))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of copies and near copies."""
    return jaccard.without_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return _sized(pii.redact(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, VOCABULARY, end_id=END_ID)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", sequences),
]

#: Learned models, similarity over any number of links and tokenizers are beyond SQL; the stages are
#: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
