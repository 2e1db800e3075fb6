"""A training corpus from documents: five stages over the operators of tidemark.llm.

Every stage takes (spark, docs, sf_dir) and returns the columns of docs for the rows that it
keeps, or, for the last one, the packed pieces. Column names and order are those of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, langid, mixing, packing, quality
from tidemark.llm.common import drop, scratch, table, written

#: SQL can't express a trained model's decisions, hash-seeded choices or the tokenizer.
ORACLE_SQL = None

#: Near duplicates by the convention for shingles: five words, similarity of 0.8 or more.
NEAR = {"width": 5, "num": 80, "den": 100}


def _rows(docs: DataFrame, *others: str) -> DataFrame:
    """Every row whole, as the struct ``row``, beside the columns that an operator reads."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(F.col(f"`{c}`") for c in others))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those that the classifier rejects go.

    Null and empty texts and texts without letters go; of repeated rows all go or stay; without
    labelled rows nothing is known, and all go; no rows give no rows.
    """
    model = langid.train(docs)
    return langid.identify(_rows(docs, "text"), model, ["row"]).filter("NOT rejected").select("row.*")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a quality of at least the classifier's threshold; the others go.

    Null texts are judged as empty ones, and a row without doc_id like any other; a score equal to
    the threshold stays; of repeated rows all go or stay; no rows give no rows.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.score(_rows(docs, "text"), model, ["row"]).filter(F.col("score") >= quality.THRESHOLD).select("row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates.

    Where that doc_id has several texts in the group, the one of the smallest hash stays; of
    repeated rows one. Null and wordless texts are near no other doc_id's; rows without doc_id stay.
    """
    return jaccard.deduplicated(docs, **NEAR)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to three times.

    A null source is a source, null texts are of size 0, repeated rows are taken each for itself.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens; a null text is one piece, its end."""
    return packing.digest(docs)


STAGES = [("language", language), ("quality", good), ("near_duplicates", distinct), ("mixture", mixture), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again.

    What a stage wrote besides, and its input, is deleted when its result has been written.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs, path = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last:
            drop(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
