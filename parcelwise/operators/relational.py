"""Keyed table operators: upsert, diff, resume, back-fill, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert_latest(base: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Union of both with the newest row per key; updates win equal versions."""
    cols = base.columns
    both = base.withColumn("_src", F.lit(0)).unionByName(updates.select(*cols).withColumn("_src", F.lit(1)))
    rest = [c for c in cols if c not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_src")).alias("_row"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in cols])


def backfill_columns(target: DataFrame, staged: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """UPDATE … FROM: staged values replace the target's where the key matches."""
    side = staged.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = target.join(side, keys, "left")
    for c in columns:
        old = F.col(c) if c in target.columns else F.lit(None)
        joined = joined.withColumn(c, F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(old))
    return joined.drop("_hit", *[f"_new_{c}" for c in columns])


def table_diff(new: DataFrame, old: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full-outer comparison: status new / removed / changed / same and deltas."""
    a = new.select(*keys, F.lit(True).alias("_in_new"), *[F.col(v).alias(f"new_{v}") for v in values])
    b = old.select(*keys, F.lit(True).alias("_in_old"), *[F.col(v).alias(f"old_{v}") for v in values])
    j = a.join(b, keys, "full_outer")
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(f"new_{v}").eqNullSafe(F.col(f"old_{v}"))
    status = (
        F.when(F.col("_in_old").isNull(), "new")
        .when(F.col("_in_new").isNull(), "removed")
        .when(changed, "changed")
        .otherwise("same")
    )
    deltas = [(F.col(f"new_{v}") - F.col(f"old_{v}")).alias(f"delta_{v}") for v in values]
    sides = [c for v in values for c in (f"new_{v}", f"old_{v}")]
    return j.select(*keys, status.alias("status"), *sides, *deltas)


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return todo.join(done.select(*keys), keys, "left_anti")


def append_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows to append under ON CONFLICT DO NOTHING: unseen keys, once each, the smallest row of a key."""
    return not_done(keep_first(incoming, [key], [c for c in incoming.columns if c != key]), existing, [key])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def guarded(df: DataFrame, limit: int, sample: int = 5) -> tuple[DataFrame, int]:
    """Result-size guard: everything up to ``limit`` rows, else a small sample; and the full count."""
    n = df.count()
    return (df, n) if n <= limit else (df.limit(sample), n)


def arithmetic_hash(key: Column, seed: int, modulus: int = 1_000_003) -> Column:
    """Small multiplicative hash that any SQL engine can repeat."""
    return F.pmod((F.pmod(key, F.lit(modulus)) + seed) * 48_271, F.lit(modulus))


def sample_per_group(df: DataFrame, group: list[str], key: str, n: int, seed: int) -> DataFrame:
    """n rows per group in hash order: a repeatable shuffle."""
    from .spatial import top_k_per_key

    hashed = df.withColumn("_h", arithmetic_hash(F.col(key), seed))
    return top_k_per_key(hashed, group, [F.col("_h"), F.col(key)], n).drop("_h", "rank")


def prefer_then_fill(df: DataFrame, group: list[str], preference: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows per group, lower ``preference`` classes first, hash order inside."""
    from .spatial import top_k_per_key

    hashed = df.withColumn("_h", arithmetic_hash(F.col(key), seed))
    return top_k_per_key(hashed, group, [F.col(preference), F.col("_h"), F.col(key)], n).drop("_h", "rank")


def stratified_split(df: DataFrame, stratum: str, key: str, fraction: float, seed: int, name: str = "is_val") -> DataFrame:
    """Exact share per stratum: the first round(fraction·n) rows in hash order.

    A stratum is ranked in pieces of the hash range with offsets, so one that
    holds most rows is still spread over many tasks.
    """
    pieces = 256
    modulus = 1_000_003
    h = df.withColumn("_h", arithmetic_hash(F.col(key), seed, modulus)).withColumn(
        "_p", F.floor(F.col("_h") * pieces / modulus)
    )
    per_piece = h.groupBy(stratum, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(stratum).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_piece.select(
        stratum,
        "_p",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(W.partitionBy(stratum)).alias("_total"),
    )
    pos = F.col("_off") + F.row_number().over(W.partitionBy(stratum, "_p").orderBy("_h", key))
    return (
        h.join(offsets, [stratum, "_p"])
        .withColumn(name, pos <= F.round(F.col("_total") * fraction))
        .drop("_h", "_p", "_off", "_total")
    )


def ranked_batch(df: DataFrame, score: str, excluded: str, key: str) -> DataFrame:
    """Batch list order: not excluded first, score descending (null as −1), key."""
    s = F.coalesce(F.col(score), F.lit(-1.0))
    return df.orderBy(F.col(excluded).asc(), s.desc(), F.col(key).asc())
