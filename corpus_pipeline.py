"""A corpus pipeline: stages applied one after the other, each written to the shared folder and reread.

toxicity: documents that the classifier calls toxic go. near_duplicates: of each class the document with the smallest
id stays (rows are told apart even where they repeat an id or have none). decontamination: documents of which a twentieth or more stands in benchmark passages go. personal_data: every
span is replaced by its kind. packing: what is left is cut and packed into token windows, one row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.llm.decontamination import decontaminate
from volpanel.llm.near_duplicates import near_duplicates as find_near_duplicates
from volpanel.llm.packing import pack
from volpanel.llm.personal_data import find_personal_data, redacted
from volpanel.llm.queries import table, tokenizer_path
from volpanel.llm.toxicity import score_toxicity
from volpanel.session import scratch_path, small_batches


ROW = "row_of_stage"


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """Documents whose id is not in ``bad``, with their columns in order; documents without an id stay."""
    return docs.join(bad.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Labels belong to ids, so rows of one id are judged alike: all go if one of their texts is toxic."""
    small_batches(spark)
    return without(docs, score_toxicity(docs, table(spark, folder, "labels")).where("predicted = 1"))


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number that tells rows of equal or no id apart; the same whenever the stage's input is read."""
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each class one row stays: that with the smallest id, of equal or missing ids the first one. A row whose text
    has no words is a class of its own."""
    small_batches(spark)
    rows = numbered(docs)
    classes = find_near_duplicates(rows, id=ROW).select(ROW, "class_id")
    first = rows.select(ROW, "doc_id").join(classes, ROW).groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))[ROW].alias(ROW))
    return rows.join(first, ROW, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    small_batches(spark)
    rows = numbered(docs)
    bad = decontaminate(rows, table(spark, folder, "benchmark"), id=ROW).where("contaminated").select(ROW)
    return rows.join(bad, ROW, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    small_batches(spark)
    found = find_personal_data(docs, keep=tuple(docs.columns))
    masked = found.select("row.*", "spans").withColumn("text", F.expr(redacted("text", "spans")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.expr("length(text)").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    small_batches(spark)
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]
#: Viterbi decoding, alignment and tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
