"""Data selection: which source backs each criterion, and how far to trust it.

The criterion trees are small catalog rows, so each one compiles to CASE
expressions over availability columns: selecting data for a location is a
projection with no join and no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scoring as S
from ..operators import counts, overlap
from ..operators import spatial as X
from ..sources import catalog
from ..sources.catalog import Criterion


def has(source_id: str) -> str:
    return f"has_{source_id}"


# ── availability ────────────────────────────────────────────────────────────
def catalog_availability() -> dict[str, Column | None]:
    """Per source: a constant when its catalog row decides, None when a probe does."""
    out: dict[str, Column | None] = {"euclidean_buffer": F.lit(True)}
    for sid, method, *_rest in catalog.SOURCES:
        reliability = _rest[2]
        if method == "postgis_table":
            out[sid] = None
        else:
            out[sid] = F.lit(reliability == "verified")
    return out


def coverage_availability(locations: DataFrame, key: str, state: str, sources=catalog.SOURCES) -> DataFrame:
    """Availability and quality of every source from its coverage and reliability."""
    literal = F.array(
        *[
            F.struct(
                F.lit(sid).alias("source_id"),
                F.lit(cov).alias("coverage_type"),
                (F.array(*[F.lit(s) for s in states]) if states else F.array().cast("array<string>")).alias("states"),
                F.lit(rel).alias("reliability"),
                F.lit(
                    bool(fb) and not (status or "").upper().startswith("UNVERIFIED") and "DEGRADED" not in (status or "").upper()
                ).alias("usable_fallback"),
            )
            for sid, _m, cov, states, rel, _cat, _wf, fb, status in sources
        ]
    )
    rows = locations.select(key, F.col(state).alias("_state"), F.explode(literal).alias("_s")).select(key, "_state", "_s.*")
    national, local = F.col("coverage_type") == "national", F.col("coverage_type").isin("state", "regional")
    covered = F.coalesce(F.array_contains("states", F.col("_state")), F.lit(False))
    quality = (
        F.when(national & (F.col("reliability") == "verified"), "full")
        .when(national & (F.col("reliability") == "degraded"), "degraded")
        .when(national, "unavailable")
        .when(local & covered & (F.col("reliability") == "verified"), "full")
        .when(local & covered, F.col("reliability"))
        .when((local | (F.col("coverage_type") == "county")) & F.col("usable_fallback"), "fallback")
        .when(local | (F.col("coverage_type") == "county"), "out_of_coverage")
        .otherwise("unknown")
    )
    usable = quality.isin("full", "degraded", "fallback") | (local & covered)
    return rows.select(key, "source_id", quality.alias("quality"), usable.alias("available"))


def probe_sources(points: DataFrame, features: DataFrame, key: str, radii: dict[str, float] = K.PROBE_RADIUS_M) -> DataFrame:
    """Probe of all table sources: (key, source_id, n, nearest_m), with n = 0 where nothing is near.

    ``features`` is the union of the layers with a ``source_id``; each source is
    searched in its own radius. Copies of a position count by weight.
    """
    spots = features.groupBy("source_id", "f_lng", "f_lat").agg(F.count(F.lit(1)).alias("_w"))
    at, out = points.select(key, "lng", "lat"), None
    # One grid per radius: a short-range source is never searched on a long-range grid.
    for radius in sorted({r for r in radii.values() if r > 0}):
        names = [s for s, r in radii.items() if r == radius]
        pairs = X.within_radius(at, spots.filter(F.col("source_id").isin(*names)), radius)
        part = pairs.groupBy(key, "source_id").agg(F.sum("_w").alias("n"), F.min("dist").alias("nearest_m"))
        out = part if out is None else out.unionByName(part)
    asked = points.select(key, F.explode(F.array(*[F.lit(s) for s, r in radii.items() if r > 0])).alias("source_id"))
    return asked.join(out, [key, "source_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def probe_layers(
    locations: DataFrame, key: str, points: DataFrame, lines: DataFrame, polygons: DataFrame, known: DataFrame, named: dict[str, list[str]], cell: float,
    radii: dict[str, float] = K.PROBE_RADIUS_M,
) -> DataFrame:
    """Probe of sources of every kind: (key, source_id, n, nearest_m), with n = 0 where nothing is near.

    ``points``, ``lines`` and ``polygons`` (with ``feature_id``) carry a ``source_id`` and are searched
    within its radius; a polygon that holds the location is at distance 0. ``known`` lists the
    (key, source_id) whose table or raster has a value at the location. ``named`` lists the sources of
    each of the four.
    """
    at = locations.select(key, "lng", "lat")
    parts = [probe_sources(locations, points, key, {s: radii[s] for s in named["points"]}).filter("n > 0")]
    for radius in sorted({radii[s] for s in named["lines"]}):
        names = [s for s in named["lines"] if radii[s] == radius]
        n = counts.segments_near(at, lines.filter(F.col("source_id").isin(names)), key, radius, ["source_id"])
        nearest = reduce(DataFrame.unionByName, [X.line_distance_within(at, lines.filter(F.col("source_id") == s), key, "source_id", radius) for s in names])
        parts.append(n.join(nearest.withColumnRenamed("dist", "nearest_m"), [key, "source_id"], "left"))
    for radius in sorted({radii[s] for s in named["polygons"]}):
        names = [s for s in named["polygons"] if radii[s] == radius]
        parts.append(overlap.boundary_counts(at, polygons.filter(F.col("source_id").isin(names)), key, "feature_id", "source_id", radius, cell))
    parts.append(known.groupBy(key, "source_id").agg(F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("nearest_m")))
    found = reduce(DataFrame.unionByName, parts)
    every = F.explode(F.array(*[F.lit(s) for names in named.values() for s in names])).alias("source_id")
    return locations.select(key, every).join(found, [key, "source_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def availability_columns(locations: DataFrame, probes: DataFrame, key: str, probed: list[str]) -> DataFrame:
    """Wide form: ``has_<source>`` and ``nearest_<source>`` per location.

    Sources decided by the catalog become constants; probed ones come from one
    pivoting aggregate.
    """
    wide = probes.groupBy(key).agg(
        *[F.max(F.when(F.col("source_id") == s, F.col("nearest_m"))).alias(f"nearest_{s}") for s in probed],
        *[F.bool_or((F.col("source_id") == s) & (F.col("n") > 0)).alias(has(s)) for s in probed],
    )
    out = locations.join(wide, key, "left")
    fixed = {has(s): c for s, c in catalog_availability().items() if c is not None and s not in probed}
    fill = {has(s): F.coalesce(F.col(has(s)), F.lit(False)) for s in probed}
    missing = {
        has(s): F.lit(s == "hazus_ddfs") for s, c in catalog_availability().items() if c is None and s not in probed
    }
    return out.withColumns({**fixed, **missing, **fill})


# ── tree traversal ──────────────────────────────────────────────────────────
def _available(source_id: str) -> Column:
    return F.coalesce(F.col(has(source_id)), F.lit(False))


def _least(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


def confidence(criterion: Criterion) -> Column:
    if criterion.tree_type == "alternative":
        rules = [(_available(n.source_id), n.confidence) for n in criterion.tree if n.relationship == "alternative"]
        return S.case_ladder(rules, 0.0).cast("double")
    if criterion.tree_type == "component":
        parts = [n for n in criterion.tree if n.relationship == "component"]
        none = F.lit(None).cast("double")
        have = _least([F.when(_available(n.source_id), F.lit(n.confidence)).otherwise(none) for n in parts])
        lack = _least([F.when(~_available(n.source_id), F.lit(n.missing or 0.0)).otherwise(none) for n in parts])
        return F.when(have.isNull(), 0.0).otherwise(F.least(have, lack))
    return F.lit(0.0)


def selected_source(criterion: Criterion) -> Column:
    """First available node of the tree's own relationship."""
    nodes = [n for n in criterion.tree if n.relationship == criterion.tree_type]
    none = F.lit(None).cast("string")
    return S.case_ladder([(_available(n.source_id), n.source_id) for n in nodes], none) if nodes else none


def selected_quality(criterion: Criterion) -> Column:
    nodes = [n for n in criterion.tree if n.relationship == criterion.tree_type]
    none = F.lit(None).cast("string")
    return S.case_ladder([(_available(n.source_id), n.quality) for n in nodes], none) if nodes else none


def missing_components(criterion: Criterion) -> Column:
    parts = [n for n in criterion.tree if n.relationship == "component"]
    return F.array_compact(F.array(*[F.when(~_available(n.source_id), n.source_id) for n in parts]))


def select_data(locations: DataFrame, workflow: str) -> DataFrame:
    """Adds ``conf_<criterion>`` and ``src_<criterion>`` for one workflow."""
    specs = catalog.criteria_for(workflow)
    return locations.withColumns(
        {f"conf_{c.criterion_id}": confidence(c) for c in specs}
        | {f"src_{c.criterion_id}": selected_source(c) for c in specs}
    )


def selection_rows(locations: DataFrame, workflow: str, key: str) -> DataFrame:
    """Long form: one row per (location, criterion)."""
    structs = [
        F.struct(
            F.lit(c.criterion_id).alias("criterion_id"),
            F.lit(c.kind).alias("criterion_type"),
            F.lit(c.tree_type).alias("relationship"),
            F.lit(c.weight).cast("double").alias("weight_default"),
            confidence(c).alias("confidence"),
            selected_source(c).alias("selected_source"),
            selected_quality(c).alias("quality"),
        )
        for c in catalog.criteria_for(workflow)
    ]
    return (
        locations.select(key, F.explode(F.array(*structs)).alias("_c"))
        .select(key, "_c.*")
        .withColumn("tier", S.confidence_tier("confidence"))
    )


# ── composite ───────────────────────────────────────────────────────────────
def composite_confidence(workflow: str, only: set[str] | None = None) -> Column:
    """Weighted scored confidence × (0.5 + 0.5 · weakest exclusion)."""
    specs = [c for c in catalog.criteria_for(workflow) if only is None or c.criterion_id in only]
    scored = [c for c in specs if c.kind == "scored"]
    screens = [c for c in specs if c.kind == "exclusion"]
    total = sum(c.weight for c in scored)
    mean = reduce(lambda a, b: a + b, [F.col(f"conf_{c.criterion_id}") * c.weight for c in scored]) / total
    worst = _least([F.col(f"conf_{c.criterion_id}") for c in screens]) if screens else F.lit(1.0)
    return mean * (worst * 0.5 + 0.5)


def completeness(workflow: str) -> Column:
    specs = catalog.criteria_for(workflow)

    def available(kind: str) -> tuple[Column, int]:
        chosen = [c for c in specs if c.kind == kind]
        hits = [F.when(F.col(f"conf_{c.criterion_id}") > 0, 1).otherwise(0) for c in chosen]
        return (reduce(lambda a, b: a + b, hits) if hits else F.lit(0)), len(chosen)

    s, ns = available("scored")
    e, ne = available("exclusion")
    return F.format_string("%d of %d scored criteria, %d of %d exclusion criteria", s, F.lit(ns), e, F.lit(ne))


def criteria_where(workflow: str, test) -> Column:
    """Criterion ids whose confidence passes the test, in catalog order."""
    picks = [F.when(test(F.col(f"conf_{c.criterion_id}")), c.criterion_id) for c in catalog.criteria_for(workflow)]
    return F.array_compact(F.array(*picks))


def gaps(workflow: str) -> Column:
    return criteria_where(workflow, lambda c: c == 0)


def strongest(workflow: str) -> Column:
    return criteria_where(workflow, lambda c: c >= 0.85)


def weakest(workflow: str) -> Column:
    return criteria_where(workflow, lambda c: (c > 0) & (c < 0.65))


def critical_gaps(workflow: str) -> Column:
    """Critical criteria with nothing left in their tree."""
    hits = [F.when(F.col(f"conf_{cid}") == 0, cid) for wf, cid, _ in catalog.CRITICAL if wf == workflow]
    return F.array_compact(F.array(*hits))


def statement(workflow: str) -> Column:
    """One sentence per tier naming what was partial or missing."""
    score = composite_confidence(workflow)
    partial = F.array_join(criteria_where(workflow, lambda c: (c > 0) & (c < 0.85)), ", ")
    missing = F.array_join(gaps(workflow), ", ")
    low = criteria_where(workflow, lambda c: c < 0.4)
    return (
        F.when((score >= 0.85) & (partial == ""), "Authoritative data for all major criteria.")
        .when(score >= 0.85, F.concat(F.lit("Authoritative data for most criteria; proxy or partial: "), partial, F.lit(".")))
        .when(score >= 0.65, F.concat(F.lit("Proxy or partial data for "), partial, F.lit("; verify these.")))
        .when(
            score >= 0.40,
            F.concat(F.lit("Significant gaps in "), F.size(low).cast("string"), F.lit(" criteria: "), F.array_join(low, ", "), F.lit(".")),
        )
        .otherwise(F.concat(F.lit("Insufficient data. Missing: "), missing, F.lit(".")))
    )


def confidence_report(selected: DataFrame, workflow: str, key: str) -> DataFrame:
    score = composite_confidence(workflow)
    return selected.select(
        key,
        F.round(score, 4).alias("composite"),
        S.confidence_tier(score, "INSUFFICIENT").alias("tier"),
        completeness(workflow).alias("completeness"),
        F.array_join(gaps(workflow), ",").alias("gaps"),
        F.array_join(weakest(workflow), ",").alias("weakest"),
        F.size(strongest(workflow)).alias("n_strong"),
        F.array_join(critical_gaps(workflow), ",").alias("critical_gaps"),
        statement(workflow).alias("statement"),
    )


def display_name(criterion: Column) -> Column:
    """Reader-facing name; an unknown id stays as it is."""
    return F.coalesce(S.lookup(criterion, catalog.CRITERION_NAMES), criterion)


def gap_rows(selected: DataFrame, workflow: str, key: str) -> DataFrame:
    """One row per exhausted criterion with its name and message."""
    rows = selected.select(key, F.explode(gaps(workflow)).alias("criterion_id"))
    name = display_name(F.col("criterion_id"))
    return rows.withColumns(
        {"display_name": name, "message": F.concat(name, F.lit(" has no data here."))}
    )


# ── catalog queries ─────────────────────────────────────────────────────────
def sources_for_workflow(sources: DataFrame, workflow: str) -> DataFrame:
    return sources.filter(F.array_contains("applicable_workflows", workflow)).orderBy("data_category", "source_id")


def distinct_sources(criteria: DataFrame, workflow: str) -> DataFrame:
    return (
        criteria.filter(F.col("workflow_type") == workflow)
        .select(F.explode("data_tree").alias("n"))
        .select("n.source_id")
        .distinct()
    )


def catalog_order(criteria: DataFrame) -> DataFrame:
    """Scored first, heaviest first, then id."""
    return criteria.orderBy(
        (F.col("criterion_type") != "scored").asc(), F.desc_nulls_last("weight_default"), "criterion_id"
    )


def methodology_document(criteria: DataFrame) -> DataFrame:
    """One row per workflow with its criteria; bounded by the catalog."""
    entry = F.struct("criterion_type", "criterion_id", "weight_default", "weight_min", "weight_max", "data_tree")
    return criteria.groupBy("workflow_type").agg(F.array_sort(F.collect_list(entry)).alias("criteria"))
