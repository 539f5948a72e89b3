"""A corpus from raw documents to packed training sequences, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestruct.llm._common import materialise, table
from lodestruct.llm.linededup import drop_common_lines
from lodestruct.llm.mixing import mix
from lodestruct.llm.nearcopies import one_of_each
from lodestruct.llm.packing import pack
from lodestruct.llm.quality import accepted

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this stage's labelled documents, accepts; null and empty texts are scored like others."""
    return accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines found in ten or more of them; n_chars is that of the new text, a null text becomes empty."""
    found = drop_common_lines(docs, carry=("lang", "source"))
    return found.select("doc_id", "text", "carried.lang", "carried.source", F.char_length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies (similarity of 5-word shingles 0.8 or more): that of least doc_id, nulls last, ties by a hash of id and text."""
    return one_of_each(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole time (at most three); documents without words are not taken.

    Rows of equal id, text and source are taken equally often, by their mean.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("tie"))  # ids may repeat or be null where texts differ
    taken = mix(keyed.withColumn("doc_id", F.struct("doc_id", "tie"))).filter("size > 0").groupBy("doc_id", "source").agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("times"))
    taken = taken.filter("times > 0").select(F.col("doc_id.doc_id").alias("taken_id"), F.col("doc_id.tie").alias("taken_tie"), F.col("source").alias("taken_source"), "times")
    found = keyed.join(taken, keyed.doc_id.eqNullSafe(taken.taken_id) & (keyed.tie == taken.taken_tie) & keyed.source.eqNullSafe(taken.taken_source))
    return found.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents along the curve; a document that the mix repeats is packed each time."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: Trained models, fingerprints and vocabularies are beyond SQL; tests hold each stage against plain Python on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
