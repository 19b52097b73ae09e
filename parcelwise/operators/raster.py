"""Raster operators on cell tables (row, col, value).

Neighbourhood work is done per square tile: each cell goes to its own tile and,
near an edge, to the tiles whose margin it fills. A group is one tile plus its
margin, so its size is fixed by the tile edge and never by the data.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import spatial as X

# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TILE = 256


def with_margin(cells: DataFrame, margin: int, tile: int = TILE) -> DataFrame:
    """Each cell once per tile that needs it: ``_tr, _tc`` are tile numbers."""

    def tiles(axis: str) -> Column:
        low = F.floor((F.col(axis) - margin) / tile).cast("long")
        high = F.floor((F.col(axis) + margin) / tile).cast("long")
        return F.sequence(low, high)

    return cells.withColumn("_tr", F.explode(tiles("row"))).withColumn("_tc", F.explode(tiles("col")))


def raster_extent(cells: DataFrame) -> DataFrame:
    return cells.agg(
        F.struct(
            F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")
        ).alias("extent")
    )


def _grid(pdf: pd.DataFrame, tr: int, tc: int, tile: int, margin: int, value: str) -> np.ndarray:
    size = tile + 2 * margin
    grid = np.full((size, size), np.nan)
    rows = pdf["row"].to_numpy() - tr * tile + margin
    cols = pdf["col"].to_numpy() - tc * tile + margin
    grid[rows, cols] = pdf[value].to_numpy(dtype=float)
    return grid


def slope_aspect(cells: DataFrame, value: str, px: float, py: float, tile: int = TILE) -> DataFrame:
    """Slope (degrees) and downslope aspect per cell.

    Central differences inside, one-sided at the raster's outer edge. A missing
    neighbour leaves the cell null; so does a slope below 1e-4 for the aspect.
    Rows grow south.
    """
    spread = with_margin(cells.select("row", "col", value), 1, tile).withColumn("_e", raster_extent(cells).scalar())
    spread = spread.select("*", "_e.*").drop("_e")

    def per_tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(key[0]), int(key[1])
        r0, r1, c0, c1 = (int(pdf[k].iloc[0]) for k in ("r0", "r1", "c0", "c1"))
        z = _grid(pdf, tr, tc, tile, 1, value)
        own = pdf[(pdf["row"] // tile == tr) & (pdf["col"] // tile == tc)]
        row, col = own["row"].to_numpy(), own["col"].to_numpy()
        i, j = row - tr * tile + 1, col - tc * tile + 1

        def difference(before_i, before_j, after_i, after_j, first, last, step):
            lo = np.where(first, z[i, j], z[before_i, before_j])
            hi = np.where(last, z[i, j], z[after_i, after_j])
            return (hi - lo) / (step * np.where(first | last, 1.0, 2.0))

        dz_dx = difference(i, j - 1, i, j + 1, col == c0, col == c1, px)
        dz_dsouth = difference(i - 1, j, i + 1, j, row == r0, row == r1, py)
        grade = np.where(np.isnan(z[i, j]), np.nan, np.hypot(dz_dx, dz_dsouth))
        aspect = (np.degrees(np.arctan2(-dz_dx, dz_dsouth)) + 360.0) % 360.0
        return pd.DataFrame(
            {
                "row": row,
                "col": col,
                "slope_deg": np.degrees(np.arctan(grade)),
                "aspect_deg": np.where(np.isnan(grade) | (grade < 1e-4), np.nan, aspect),
            }
        )

    out = spread.groupBy("_tr", "_tc").applyInPandas(per_tile, "row long, col long, slope_deg double, aspect_deg double")
    return out.select("row", "col", F.nanvl("slope_deg", F.lit(None)).alias("slope_deg"), F.nanvl("aspect_deg", F.lit(None)).alias("aspect_deg"))


def disk_offsets(radius_px: float) -> list[tuple[int, int]]:
    r = int(np.ceil(radius_px))
    return [
        (dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dx * dx + dy * dy <= radius_px * radius_px
    ]


def focal_means(cells: DataFrame, value: str, radii_px: dict[str, float], tile: int = TILE) -> DataFrame:
    """Mean over valid cells in each disk, null where the cell itself is missing.

    All radii share one shuffle; the margin is the largest radius.
    """
    kernels = {n: disk_offsets(max(r, 1.0)) for n, r in radii_px.items()}
    margin = max(int(np.ceil(max(r, 1.0))) for r in radii_px.values())
    spread = with_margin(cells.select("row", "col", value), margin, tile)

    def per_tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(key[0]), int(key[1])
        z = _grid(pdf, tr, tc, tile, margin, value)
        valid = ~np.isnan(z)
        filled = np.where(valid, z, 0.0)
        inner = slice(margin, margin + tile)
        out = {}
        own = pdf[(pdf["row"] // tile == tr) & (pdf["col"] // tile == tc)]
        row, col = own["row"].to_numpy(), own["col"].to_numpy()
        i, j = row - tr * tile, col - tc * tile
        for name, offsets in kernels.items():
            num, den = np.zeros((tile, tile)), np.zeros((tile, tile))
            for dy, dx in offsets:
                ys, xs = slice(margin + dy, margin + dy + tile), slice(margin + dx, margin + dx + tile)
                num += filled[ys, xs]
                den += valid[ys, xs]
            mean = np.divide(num, den, out=np.full_like(num, np.nan), where=den > 0)
            out[name] = np.where(valid[inner, inner], mean, np.nan)[i, j]
        return pd.DataFrame({"row": row, "col": col, **out})

    schema = "row long, col long, " + ", ".join(f"{n} double" for n in kernels)
    grouped = spread.groupBy("_tr", "_tc").applyInPandas(per_tile, schema)
    return grouped.select("row", "col", *[F.nanvl(n, F.lit(None)).alias(n) for n in kernels])


def distance_to(cells: DataFrame, is_target: Column, px_m: float, margin: int = 64, tile: int = TILE) -> DataFrame:
    """Metres from every cell centre to the nearest target cell; 0 on a target.

    Distances up to the margin are exact within a tile and its margin. Cells with
    nothing that near take the unbounded nearest join.
    """
    tagged = cells.select("row", "col", is_target.cast("int").alias("_t"))
    near = _tile_distance(tagged, margin, tile)
    targets = tagged.filter("_t = 1").select(
        F.col("col").cast("double").alias("f_lng"), F.col("row").cast("double").alias("f_lat"), F.lit(0).alias("tid")
    )
    far = near.filter(F.col("d").isNull()).select(
        "row", "col", F.struct("row", "col").alias("_id"), F.col("col").cast("double").alias("lng"), F.col("row").cast("double").alias("lat")
    )
    rest = X.nearest(far, targets, "_id", "tid", [], cell=float(margin), metric=geo.DEGREE, extent=float(2**24))
    found = near.filter(F.col("d").isNotNull()).select("row", "col", (F.col("d") * px_m).alias("distance_m"))
    return found.unionByName(rest.select("row", "col", (F.col("dist") * px_m).alias("distance_m")))


def _tile_distance(tagged: DataFrame, margin: int, tile: int) -> DataFrame:
    """Cell distance ``d`` where it is at most ``margin``, else null."""
    spread = with_margin(tagged, margin, tile)

    def per_tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(key[0]), int(key[1])
        hit = _grid(pdf, tr, tc, tile, margin, "_t") == 1
        size = hit.shape[1]
        at = np.arange(size)
        big = 4.0 * size
        before = np.maximum.accumulate(np.where(hit, at, -big), axis=1)
        after = np.minimum.accumulate(np.where(hit, at, big)[:, ::-1], axis=1)[:, ::-1]
        along_row = np.minimum(at - before, after - at) ** 2
        inner = slice(margin, margin + tile)
        best = np.full((tile, tile), np.inf)
        for dy in range(-margin, margin + 1):
            np.minimum(best, along_row[margin + dy : margin + dy + tile, inner] + dy * dy, out=best)
        own = pdf[(pdf["row"] // tile == tr) & (pdf["col"] // tile == tc)]
        row, col = own["row"].to_numpy(), own["col"].to_numpy()
        d = np.sqrt(best[row - tr * tile, col - tc * tile])
        return pd.DataFrame({"row": row, "col": col, "d": np.where(d <= margin, d, np.nan)})

    out = spread.groupBy("_tr", "_tc").applyInPandas(per_tile, "row long, col long, d double")
    return out.select("row", "col", F.nanvl("d", F.lit(None)).alias("d"))


# ── sampling and resampling ─────────────────────────────────────────────────
def cell_of(points: DataFrame, x0: float, y0: float, px: float, py: float, x: str = "lng", y: str = "lat") -> DataFrame:
    """Row and column of each point by the inverse affine and floor; y goes down."""
    return points.withColumns(
        {"row": F.floor((F.lit(y0) - F.col(y)) / py).cast("long"), "col": F.floor((F.col(x) - x0) / px).cast("long")}
    )


def sample(points: DataFrame, cells: DataFrame, values: list[str], nodata: float, **affine: float) -> DataFrame:
    """Cell values at points; outside the raster or nodata gives null."""
    side = cells.select("row", "col", *[F.when(F.col(v) != nodata, F.col(v)).alias(v) for v in values])
    return X.meet(cell_of(points, **affine), side, ["row", "col"], "left")


def resample_nearest(targets: DataFrame, source: DataFrame, value: str, nodata: float, **affine: float) -> DataFrame:
    """Value of the source cell that holds each target centre (lng, lat)."""
    return sample(targets, source, [value], nodata, **affine)


def resample_bilinear(
    targets: DataFrame, key: list[str], source: DataFrame, value: str, nodata: float, x0: float, y0: float, px: float, py: float
) -> DataFrame:
    """Mean of the four surrounding centres weighted by distance; missing ones
    drop out and the rest are rescaled; a target without any is null."""
    fx, fy = (F.col("lng") - x0) / px - 0.5, (F.lit(y0) - F.col("lat")) / py - 0.5
    base = targets.withColumns({"_c": F.floor(fx), "_r": F.floor(fy), "_u": fx - F.floor(fx), "_v": fy - F.floor(fy)})
    corner = F.explode(
        F.array(
            *[
                F.struct(
                    (F.col("_r") + dr).cast("long").alias("row"),
                    (F.col("_c") + dc).cast("long").alias("col"),
                    ((F.col("_v") if dr else 1.0 - F.col("_v")) * (F.col("_u") if dc else 1.0 - F.col("_u"))).alias("w"),
                )
                for dr in (0, 1)
                for dc in (0, 1)
            ]
        )
    )
    four = base.select(*key, corner.alias("_k")).select(*key, F.col("_k.row").alias("_sr"), F.col("_k.col").alias("_sc"), F.col("_k.w").alias("_w"))
    side = source.filter(F.col(value) != nodata).select(F.col("row").alias("_sr"), F.col("col").alias("_sc"), F.col(value).alias("_val"))
    hit = X.meet(four, side, ["_sr", "_sc"], "left")
    known = F.when(F.col("_val").isNotNull(), F.col("_w"))
    return hit.groupBy(*key).agg(F.try_divide(F.sum(F.col("_w") * F.col("_val")), F.sum(known)).alias(value))
