"""Exact de-duplication: group by a 128-bit content hash, then compare bytes inside groups.

Texts are equal when they match after every ASCII white-space character is
deleted. One aggregate over (hash, normalised text) forms the classes: rows that
share a hash but not their bytes fall apart there, and map-side combining leaves
one text of each class per task, so a large group of copies costs little. Rows
then find their class by hash and SHA-256, without their text; two classes that
share both stop the job instead of being mixed.

Of a class, the row with most code points stays, then the one with the smallest
id; a null id comes after all others. A null text counts as empty; all empty
texts form one class. In `classes`, rows that repeat the id of the row that stays count
as kept; `only_kept` returns one row of each class, with the columns of its input: of rows
that repeat id and text, the one whose hash is smallest. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelwise.llm import tables

Hash = Callable[[Column], Column]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def md5_128(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def _found(rows: DataFrame, content_hash: Hash, proof: Hash) -> DataFrame:
    """hash, proof, group_size, keep_id and keep_chars of every class of `rows` (doc_id, n_chars, norm), written."""
    # The smallest triple: the longest text, then the smallest id.
    first = F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"))
    exact = (
        rows.groupBy(content_hash(F.col("norm")).alias("hash"), "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(first).alias("best"))
        .select("hash", proof(F.col("norm")).alias("proof"), "group_size", "best.doc_id", (-F.col("best.shorter")).alias("n_chars"))
    )
    found = (
        exact.groupBy("hash", "proof")
        .agg(F.count(F.lit(1)).alias("n"), F.min("group_size").alias("group_size"), F.min("doc_id").alias("keep_id"), F.min("n_chars").alias("keep_chars"))
        .withColumn("group_size", F.when(F.col("n") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share both hashes")).cast("bigint")))
        .drop("n")
    )
    # From a written table both sides of the join are plain exchanges, which adaptive execution splits where a class is hot.
    return tables.written(found, "classes")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select("doc_id", F.char_length("text").alias("n_chars"), normalised(F.col("text")).alias("norm"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", content_hash: Hash = md5_128, proof: Hash = sha256) -> DataFrame:
    """One row per row of `docs`: doc_id, n_chars, keep_id, group_size, kept, text_sha256."""
    rows = _rows(docs, key, text)
    found = _found(rows, content_hash, proof).drop("keep_chars")
    slim = rows.select("doc_id", "n_chars", content_hash(F.col("norm")).alias("hash"), proof(F.col("norm")).alias("proof"))
    return slim.join(found, ["hash", "proof"]).select(
        "doc_id", "n_chars", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("proof")).alias("text_sha256")
    )


def only_kept(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with the columns of `docs`."""
    found = _found(_rows(docs, key, text), md5_128, sha256)
    full = F.struct(*docs.columns).alias("row")
    norm = normalised(F.col(text))
    tagged = docs.select(full, F.col(key).alias("doc_id"), F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("n_chars"), md5_128(norm).alias("hash"), sha256(norm).alias("proof"))
    stay = (F.col("doc_id").eqNullSafe(F.col("keep_id"))) & (F.col("n_chars") == F.col("keep_chars"))
    # Only rows that repeat both id and text are left beside each other.
    kept = tagged.join(found, ["hash", "proof"]).where(stay)
    first = Window.partitionBy("hash", "proof").orderBy(F.xxhash64("row"))
    return kept.withColumn("place", F.row_number().over(first)).where(F.col("place") == 1).select("row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(tables.documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLES = {
    "op5_exact_dedup": r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-len, doc_id)) AS keep_id FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g USING (norm)""",
}
