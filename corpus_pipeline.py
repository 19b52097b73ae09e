"""Documents to packed training sequences, stage by stage.

Each stage reads all that its predecessor kept, written as Parquet in the shared
folder; a lost executor costs a stage's tasks, not the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm import exact_dedup, language_id, near_dedup, packing, pii, tables


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; those without a letter or below the threshold go."""
    tables.prepared(spark)
    model = language_id.train(language_id.training_rows(docs, F.lit(False)))
    names = tuple(tables.unique_name(docs.columns, x) for x in language_id.NAMES)
    return language_id.identify(docs, model, names=names).where(~F.col(names[2])).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    tables.prepared(spark)
    return exact_dedup.only_kept(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at similarity 0.8 or more."""
    tables.prepared(spark)
    return near_dedup.only_kept(docs, n=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind; n_chars follows the new text."""
    tables.prepared(spark)
    names = tuple(tables.unique_name(docs.columns, x) for x in pii.NAMES)
    clean = F.col(names[1])
    changed = {"text": clean, "n_chars": F.char_length(clean).cast("bigint")}
    return pii.detect(docs, names=names).select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    tables.prepared(spark)
    return packing.packed(packing.pieces(docs, packing.tokenizer_path()))


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("personal_data", personal_data), ("sequences", sequences)]

#: The tokenizer and the trained language model have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = tables.written(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
