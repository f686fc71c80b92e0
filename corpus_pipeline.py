"""Quality classifier, near-duplicate removal, substring removal and packing over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import circulant, packing, quality, substring
from quarrymill.llm.shared import drop, stage, table


#: Coordinates of a band and bands: a pair at 0.8 shares none with probability 2e-7, as one at 0.85 does in op8.
ROWS, BANDS = 6, 51


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.3. Null and empty texts get the prior, so they stay."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).where("predicted = 1").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every component of five-word shingle similarity 0.8. Rows without doc_id stay, and
    repeated rows of one doc_id go or stay together."""
    gone = circulant.near_duplicates(docs, percent=80, rows=ROWS, bands=BANDS).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document holds too; n_chars follows. A
    document that loses all its words stays, with what white space is left."""
    cut = substring.cut(docs, length=50, outputs=("kept_text",)).withColumn("text", F.col("kept_text")).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a document: its bucket, batch and slot. Null and empty texts have length 0; an empty table gives no rows."""
    return packing.pack(packing.lengths(docs))


STAGES = [("quality", keep_quality), ("near duplicates", drop_near_duplicates), ("repeated passages", drop_repeats), ("packing", pack)]

#: The classifier and the boundary search can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the table of each is deleted when the next has read it."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        before, docs = docs, stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
        if hasattr(before, "_staged_at"):
            drop(before)
    return docs
