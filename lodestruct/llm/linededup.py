"""Removal of lines that recur in many documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ASCII_SPACE, LOWER, UPPER, ascii_lower, materialise, table


def line_key(line: Column) -> Column:
    """What makes two lines equal: ASCII white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, carry: Sequence[str] = ()) -> DataFrame:
    """Documents without the lines whose key is found in at least ``min_docs`` documents.

    Returns doc_id, text (kept lines joined by a line feed), n_lines, n_dropped and, if columns are to be carried along,
    a struct ``carried`` of them, one row per row of ``docs``. A null or
    empty text is one empty line. Keys shorter than ``min_chars`` code points never count. Rows of equal doc_id are
    one document when documents are counted, as are all rows without an id. Other columns are not read. An empty table gives an empty result.

    The count needs two aggregates (distinct key and document, then documents per key), which a line in a third of all
    documents passes spread over all tasks. The common lines' hashes are then a table: a small one is broadcast, within
    Spark's own limit, and for a large one the skew join splits the partition of a line that many documents have. Only
    hashes travel there; each text travels once, to its flags.
    """
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    body = docs.select("doc_id", lines.alias("lines"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), F.col("text")).alias("t2"), F.struct(*[F.col(c) for c in carry]).alias("carried"))
    key = line_key(F.col("line"))
    spread = (
        body.select("doc_id", "t1", "t2", F.posexplode("lines").alias("pos", "line"))
        .withColumn("key", key)
        .select("doc_id", "t1", "t2", "pos", F.when(F.char_length("key") >= min_chars, F.xxhash64("key")).alias("h1"), F.when(F.char_length("key") >= min_chars, F.xxhash64(F.lit("line"), F.col("key"))).alias("h2"))
    )
    common = (
        spread.filter("h1 is not null").select("h1", "h2", "doc_id").distinct()
        .groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2")
    )
    common = materialise(common, "common_lines")
    hits = spread.join(common, ["h1", "h2"]).select("doc_id", "t1", "t2", "pos")
    flags = hits.groupBy("doc_id", "t1", "t2").agg(F.collect_set("pos").alias("drop"))
    flags = flags.select(F.col("doc_id").alias("f_id"), F.col("t1").alias("f1"), F.col("t2").alias("f2"), F.size("drop").alias("n_dropped"), F.array_sort("drop").alias("drop"))
    joined = body.join(flags, body.doc_id.eqNullSafe(flags.f_id) & (body.t1 == flags.f1) & (body.t2 == flags.f2), "left")
    # runs of kept lines between dropped positions, so the work is linear in the number of lines
    kept = F.expr(
        "flatten(transform(sequence(0, size(drop)), i -> slice(lines, if(i = 0, 1, drop[i - 1] + 2), "
        "if(i = size(drop), size(lines), drop[i]) - if(i = 0, 0, drop[i - 1] + 1))))"
    )
    return joined.select(
        "doc_id",
        F.when(F.col("drop").isNull(), F.concat_ws("\n", "lines")).otherwise(F.concat_ws("\n", kept)).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        *(["carried"] if carry else []),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_common_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (SELECT *, translate(trim(line, {_SPACE_SQL}), '{UPPER}', '{LOWER}') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id
"""
