"""What the operators share: reading a table, clashing names, hash folds, scratch tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.session import scratch_folder, tune

#: Rows or bytes that Spark hands to a Python task at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    tune(spark)
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    return spark


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: later jobs start from the files."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def unique_name(columns: list[str], name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in columns}
    return name if name.lower() not in taken else f"{name}_{uuid.uuid4().hex[:8]}"


def drawn(rows: DataFrame, per_label: int) -> DataFrame:
    """About `per_label` rows of each label, drawn by a hash of `key`; adds that hash as `draw`.

    The expected size is at most `per_label` times the number of labels, whatever the input.
    """
    # One row per label; a model has a column for each, so they fit the driver anyway.
    counts = F.broadcast(rows.groupBy("label").agg(F.count(F.lit(1)).alias("total")))
    draw = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(10)), F.lit(1 << 40))
    share = F.least(F.lit(1.0), F.lit(float(per_label)) / F.col("total"))
    return rows.withColumn("draw", draw).join(counts, "label").where(F.col("draw") < share * float(1 << 40)).drop("total")
