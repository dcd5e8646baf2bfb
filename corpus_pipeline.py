"""Training-data pipeline over the documents table: quality, line dedup, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next stage's
docs. All but the last return the columns of documents. Fingerprints, links and components stay in the cluster.

In every stage a null text counts as empty, a very long one is read whole, repeated rows are rows like others, further
columns are left behind, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelake.llm.common import staged, table
from mergelake.llm.line_dedup import dedup_lines
from mergelake.llm.ngram_join import jaccard_components, without_ids
from mergelake.llm.packing import pack
from mergelake.llm.quality import fit_quality, keep_good
from mergelake.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go. It is fitted on labelled rows of the stage's own input.

    Null and empty texts get the score of no difference and stay or go by it, alike; rows without doc_id are scored too;
    without labels of both classes all stay (score 0.5)."""
    model = fit_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return keep_good(docs.select(*COLUMNS), model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in one. No document goes; one that loses all lines has an empty text.

    Null texts become empty ones; a null doc_id holds lines but is never the largest."""
    kept = dedup_lines(docs, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest doc_id stays; rows without doc_id stay."""
    dropped = jaccard_components(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return without_ids(docs.select(*COLUMNS), staged(dropped, "dropped-documents"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids; a null or empty text is its end id alone, null doc_ids are packed too."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", packing)]
#: SQL can't express the classifier, nor the order along the curve; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
