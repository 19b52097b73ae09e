"""Audit events and methodology hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import relational as R

EVENT_FIELDS = ("execution_id", "seq", "kind", "name", "value", "source")


def event(kind: str, name: str, value: Column, source: str | None = None, when: Column | None = None) -> Column:
    row = F.struct(
        F.lit(kind).alias("kind"),
        F.lit(name).alias("name"),
        value.cast("string").alias("value"),
        F.lit(source).cast("string").alias("source"),
    )
    return row if when is None else F.when(when, row)


def audit_events(scored: DataFrame, key: str, events: list[Column]) -> DataFrame:
    """Long trail of a scored table: one row per event, numbered per execution."""
    trail = F.array_compact(F.array(*events))
    return scored.select(F.col(key).cast("string").alias("execution_id"), F.posexplode(trail).alias("seq", "_e")).select(
        "execution_id", "seq", "_e.*"
    )


def flood_trail(scored: DataFrame, key: str) -> DataFrame:
    """Steps, factors and advisories of a flood run."""
    return audit_events(
        scored,
        key,
        [
            event("data_source", "flood_zones", F.lit("polygon layer")),
            event("step", "flood_zone_lookup", F.coalesce("flood_zone", F.lit("none")), "flood_zones"),
            event("advisory", "bfe_unavailable", F.lit("nominal depth used"), "flood_zones",
                  F.col("in_sfha") & F.coalesce(F.col("static_bfe") <= -9000.0, F.lit(True))),
            event("step", "damage_lookup", F.col("ddf_class"), "damage_curves"),
            event("factor", "risk_tier", F.col("risk_tier")),
        ],
    )


def append_trail(existing: DataFrame, incoming: DataFrame, key: str = "execution_id") -> DataFrame:
    return R.append_new(existing, incoming, key)


def module_history(trails: DataFrame, module: str) -> DataFrame:
    return trails.filter(F.col("module") == module).orderBy(F.desc("started_at"))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON text with keys in sorted order."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


# fixed values: keys that change from run to run and stay out of the hash
RUN_KEYS = ("run_id", "generated_at", "trained_at", "started_at", "finished_at")


def methodology_hash(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json({k: v for k, v in fields.items() if k not in RUN_KEYS}), 256)
