"""Geographic layers derived from the test tables.

The tables carry no coordinates, so each layer places its rows by integer
arithmetic on the key. The SELECT text below runs unchanged in Spark and DuckDB
(`{table}` is the source), which keeps inputs identical on both sides; the
queries themselves are written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.functions import geo
from parcelwise.session import TABLE_CONF, tune

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

LAYERS: dict[str, tuple[str, str]] = {
    # buildings with hazard features
    "structures": (
        "orders",
        """SELECT o_orderkey AS fd_id,
  -1.25e2 + ((o_orderkey * 7919) % 58000) / 1e3 AS lng,
  2.5e1 + ((o_orderkey * 104729) % 24000) / 1e3 AS lat,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'RES1-1SNB' WHEN '2-HIGH' THEN 'RES1-2SWB'
    WHEN '3-MEDIUM' THEN 'RES2' WHEN '4-NOT SPECIFIED' THEN 'COM1' ELSE 'IND2' END AS occtype,
  CASE WHEN o_orderkey % 29 = 0 THEN 0e0 ELSE o_totalprice END AS val_struct,
  o_totalprice * 5e-1 AS val_cont,
  CASE WHEN o_orderkey % 13 = 0 THEN 0e0 ELSE ((o_orderkey * 31) % 997) / 1e5 END AS burn_probability,
  ((o_orderkey * 17) % 200) / 1e0 AS distance_to_fuel_m,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE ((o_orderkey * 13) % 101) / 1e0 END AS canopy_cover_100m,
  ((o_orderkey * 7) % 450) / 1e1 AS slope_degrees,
  concat('06097', lpad(CAST((o_orderkey * 37) % 199 AS STRING), 6, '0'), lpad(CAST(o_orderkey % 9999 AS STRING), 4, '0')) AS cbfips,
  concat('06097', lpad(CAST((o_orderkey * 37) % 199 AS STRING), 6, '0')) AS tract,
  CASE WHEN o_orderkey % 3 = 0 THEN 'B' ELSE 'S' END AS found_type,
  CAST(1 + o_orderkey % 3 AS INT) AS num_story,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE (o_orderkey % 5) / 2e0 END AS found_ht,
  CASE o_orderkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'S' WHEN 2 THEN 'C' ELSE 'W' END AS bldgtype,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(1930 + (o_orderkey * 3) % 90 AS INT) END AS med_yr_blt,
  ((o_orderkey * 41) % 700) / 1e1 AS ground_elv_ft,
  ((o_orderkey * 53) % 900) / 1e3 AS bedrock_pga_g,
  ((o_orderkey * 59) % 600) / 1e4 AS slope_m_per_m,
  o_custkey AS owner_id, o_orderstatus AS segment
FROM {orders}""",
    ),
    # candidate sites
    "sites": (
        "customer",
        """SELECT c_custkey AS loc_id,
  -1.25e2 + ((c_custkey * 6311 + 17) % 58000) / 1e3 AS lng,
  2.5e1 + ((c_custkey * 86243 + 11) % 24000) / 1e3 AS lat,
  greatest(c_acctbal, 0e0) / 1e1 AS acreage,
  c_mktsegment AS segment,
  c_nationkey AS nation_id,
  ((c_custkey * 29) % 120) / 1e1 + 1.2e1 AS capacity_factor_pct,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE ((c_custkey * 43) % 260) / 1e1 END AS slope_pct,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE ((c_custkey * 71) % 3600) / 1e1 END AS aspect_deg,
  CASE c_custkey % 9 WHEN 0 THEN 11 WHEN 1 THEN 21 WHEN 2 THEN 23 WHEN 3 THEN 31 WHEN 4 THEN 42
    WHEN 5 THEN 52 WHEN 6 THEN 71 WHEN 7 THEN 82 ELSE 81 END AS nlcd_code,
  CASE c_custkey % 6 WHEN 0 THEN 'Well drained' WHEN 1 THEN 'Moderately well drained'
    WHEN 2 THEN 'Somewhat poorly drained' WHEN 3 THEN 'Poorly drained' WHEN 4 THEN 'Excessively drained' ELSE NULL END AS drainage_class,
  CASE WHEN c_custkey % 10 = 3 THEN 'Yes' ELSE 'No' END AS hydric_rating,
  CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE ((c_custkey * 67) % 101) / 1e0 END AS ej_percentile,
  4e0 + ((c_custkey * 19) % 30) / 1e1 AS ghi,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(1 + c_custkey % 8 AS INT) END AS soil_class,
  CASE c_custkey % 5 WHEN 0 THEN 'A-1' WHEN 1 THEN 'R-1' WHEN 2 THEN 'C-2' WHEN 3 THEN 'M-1' ELSE 'E(5)' END AS zone_code
FROM {customer}""",
    ),
    # insured properties, most of them close to a structure
    "properties": (
        "customer",
        """SELECT c_custkey AS property_id,
  -1.25e2 + ((c_custkey * 7 * 7919) % 58000 + ((c_custkey % 9) - 4) * 2) / 1e3 AS lng,
  2.5e1 + ((c_custkey * 7 * 104729) % 24000 + (c_custkey % 5) - 2) / 1e3 AS lat,
  c_mktsegment AS segment
FROM {customer}""",
    ),
    # four-cornered polygons of unequal size; more rows cover every place more often
    "zones": (
        "supplier",
        """SELECT s_suppkey AS zone_id,
  -1.24e2 + ((s_suppkey * 15485863) % 56000) / 1e3 AS x,
  2.6e1 + ((s_suppkey * 32452843) % 22000) / 1e3 AS y,
  2e-1 + ((s_suppkey * 13) % 10) / 1e1 AS size,
  CASE s_suppkey % 6 WHEN 0 THEN 'AE' WHEN 1 THEN 'VE' WHEN 2 THEN 'X' WHEN 3 THEN 'X' WHEN 4 THEN 'A' ELSE 'D' END AS flood_zone,
  CASE s_suppkey % 6 WHEN 2 THEN '0.2 PCT ANNUAL CHANCE' ELSE NULL END AS zone_subtype,
  CASE WHEN s_suppkey % 6 = 0 THEN 2e1 + (s_suppkey % 50) WHEN s_suppkey % 6 = 1 THEN -9.999e3 ELSE NULL END AS static_bfe,
  CASE s_suppkey % 3 WHEN 0 THEN 'wetland' WHEN 1 THEN 'protected' ELSE 'habitat' END AS kind,
  CAST(1 + s_suppkey % 4 AS INT) AS gap_status,
  1.98e3 + (s_suppkey % 45) AS year_num,
  s_acctbal AS gis_acres, s_name AS zone_name
FROM {supplier}""",
    ),
    # disjoint tiles over the whole area
    "tiles": (
        "nation",
        """SELECT n_nationkey AS tile_id, n_name AS tile_name, n_regionkey AS region_id,
  -1.25e2 + (n_nationkey % 5) * 1.16e1 AS x0,
  2.5e1 + CAST(floor(n_nationkey / 5e0) AS INT) * 4.8e0 AS y0,
  -1.25e2 + (n_nationkey % 5 + 1) * 1.16e1 AS x1,
  2.5e1 + (CAST(floor(n_nationkey / 5e0) AS INT) + 1) * 4.8e0 AS y1
FROM {nation}""",
    ),
    # points of interest, spread over the whole area
    "pois": (
        "part",
        """SELECT p_partkey AS poi_id,
  -1.25e2 + ((p_partkey * 9973 + 5) % 58000) / 1e3 AS lng,
  2.5e1 + ((p_partkey * 70001 + 3) % 24000) / 1e3 AS lat,
  CASE p_partkey % 10 WHEN 0 THEN 'amenity:cafe' WHEN 1 THEN 'amenity:pharmacy' WHEN 2 THEN 'amenity:restaurant'
    WHEN 3 THEN 'amenity:fast_food' WHEN 4 THEN 'amenity:bank' WHEN 5 THEN 'leisure:fitness_centre'
    WHEN 6 THEN 'shop:supermarket' WHEN 7 THEN 'shop:convenience' WHEN 8 THEN 'amenity:clinic' ELSE 'healthcare:doctor' END AS category,
  p_name AS poi_name, p_brand AS brand, p_type AS layer, p_retailprice AS price, p_size AS size_class
FROM {part}""",
    ),
    # points of interest inside one county-sized box
    "city_pois": (
        "part",
        """SELECT p_partkey AS poi_id,
  -9.7e1 + ((p_partkey * 7919) % 5400) / 1e4 AS lng,
  3.254e1 + ((p_partkey * 104729) % 4800) / 1e4 AS lat,
  CASE p_partkey % 10 WHEN 0 THEN 'amenity:cafe' WHEN 1 THEN 'amenity:pharmacy' WHEN 2 THEN 'amenity:restaurant'
    WHEN 3 THEN 'amenity:fast_food' WHEN 4 THEN 'amenity:bank' WHEN 5 THEN 'leisure:fitness_centre'
    WHEN 6 THEN 'shop:supermarket' WHEN 7 THEN 'shop:convenience' WHEN 8 THEN 'amenity:clinic' ELSE 'healthcare:doctor' END AS category
FROM {part}""",
    ),
    # census tracts: a tiling of the same box, with people and jobs
    "tracts": (
        "supplier",
        """SELECT s_suppkey AS tract_id,
  -9.7e1 + (s_suppkey % 10) * 5.4e-2 AS x0,
  3.254e1 + (CAST(floor(s_suppkey / 1e1) AS BIGINT) % 10) * 4.8e-2 AS y0,
  -9.7e1 + (s_suppkey % 10 + 1) * 5.4e-2 AS x1,
  3.254e1 + (CAST(floor(s_suppkey / 1e1) AS BIGINT) % 10 + 1) * 4.8e-2 AS y1,
  CASE WHEN s_suppkey % 31 = 0 THEN NULL ELSE 2e3 + (s_suppkey * 37) % 6000 END AS population,
  8e2 + (s_suppkey * 31) % 2000 AS households,
  CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE 3e4 + (s_suppkey * 977) % 70000 END AS median_income,
  5e2 + (s_suppkey * 53) % 4000 AS age_18_34,
  1e3 + (s_suppkey * 89) % 9000 AS jobs
FROM {supplier}""",
    ),
    # candidate stores inside the same box
    "stores": (
        "customer",
        """SELECT c_custkey AS loc_id,
  -9.695e1 + ((c_custkey * 6311) % 4400) / 1e4 AS lng,
  3.259e1 + ((c_custkey * 86243) % 3800) / 1e4 AS lat,
  c_mktsegment AS segment, c_nationkey AS nation_id, c_acctbal AS balance
FROM {customer}""",
    ),
    # straight line segments with free-text voltages
    "lines": (
        "part",
        """SELECT p_partkey AS line_id,
  -1.25e2 + ((p_partkey * 12347) % 58000) / 1e3 AS ax,
  2.5e1 + ((p_partkey * 54323) % 24000) / 1e3 AS ay,
  -1.25e2 + ((p_partkey * 12347) % 58000) / 1e3 + ((p_partkey * 37) % 800 - 400) / 1e3 AS bx,
  2.5e1 + ((p_partkey * 54323) % 24000) / 1e3 + ((p_partkey * 41) % 600 - 300) / 1e3 AS by,
  CASE p_partkey % 5 WHEN 0 THEN '115000' WHEN 1 THEN '230 kV' WHEN 2 THEN '500000;230000' WHEN 3 THEN NULL ELSE '69' END AS voltage,
  p_brand AS owner
FROM {part}""",
    ),
    "substations": (
        "supplier",
        """SELECT s_suppkey AS sub_id,
  -1.25e2 + ((s_suppkey * 48611) % 58000) / 1e3 AS lng,
  2.5e1 + ((s_suppkey * 31337) % 24000) / 1e3 AS lat,
  CASE s_suppkey % 4 WHEN 0 THEN '115000' WHEN 1 THEN '345 kV' WHEN 2 THEN NULL ELSE '138000;69000' END AS voltage,
  s_name AS sub_name
FROM {supplier}""",
    ),
    # generation queue projects
    "queue": (
        "orders",
        """SELECT o_orderkey AS queue_id,
  -1.25e2 + ((o_orderkey * 5003 + 9) % 58000) / 1e3 AS lng,
  2.5e1 + ((o_orderkey * 60013 + 7) % 24000) / 1e3 AS lat,
  CASE o_orderstatus WHEN 'F' THEN 'Active' WHEN 'O' THEN 'Withdrawn' ELSE 'Completed' END AS status,
  CASE o_orderkey % 4 WHEN 0 THEN 'Solar' WHEN 1 THEN 'solar+storage' WHEN 2 THEN 'Wind' ELSE NULL END AS fuel_type,
  CASE o_orderkey % 6 WHEN 0 THEN 'CAISO' WHEN 1 THEN 'ERCOT' WHEN 2 THEN 'CAISO' WHEN 3 THEN 'MISO' WHEN 4 THEN 'PJM' ELSE 'SPP' END AS iso,
  o_totalprice / 1e3 AS capacity_mw,
  CAST(o_orderdate AS DATE) AS queue_date
FROM {orders}""",
    ),
    # operating plants
    "plants": (
        "part",
        """SELECT p_partkey AS plant_id,
  -1.25e2 + ((p_partkey * 21001 + 1) % 58000) / 1e3 AS lng,
  2.5e1 + ((p_partkey * 33001 + 2) % 24000) / 1e3 AS lat,
  p_retailprice / 1e1 AS capacity_mw,
  CASE WHEN p_partkey % 5 = 0 THEN 'SB' ELSE 'OP' END AS operating_status
FROM {part}""",
    ),
    # a raster 120 cells wide whose height grows with the table
    "raster": (
        "orders",
        """SELECT CAST(floor(o_orderkey / 1.2e2) AS BIGINT) AS "row", o_orderkey % 120 AS "col",
  CASE WHEN o_orderkey % 53 = 0 THEN -9.999e3 ELSE o_totalprice / 1e3 END AS dem,
  CASE WHEN o_orderkey % 47 = 0 THEN -9.999e3 ELSE (o_orderkey * 13) % 101 END AS canopy,
  CASE o_orderkey % 9 WHEN 0 THEN 91 WHEN 1 THEN 98 WHEN 2 THEN 102 WHEN 3 THEN 99 ELSE 121 + o_orderkey % 60 END AS fbfm40
FROM {orders}""",
    ),
    # insurance claims
    "claims": (
        "events",
        """SELECT event_id AS claim_id, user_id AS tract_id, event_type AS zone_class, value AS paid,
  value * 25e-2 AS paid_contents, CAST(ts AS DATE) AS loss_date, ts AS loss_ts
FROM {events}""",
    ),
}

# Corner offsets of a zone polygon, in units of its size.
ZONE_CORNERS = ((-1.0, -1.0), (1.2, -0.8), (0.6, 1.1), (-0.9, 0.7))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark, TABLE_CONF).read.parquet(f"{sf_dir}/{name}.parquet")


def layer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark, TABLE_CONF)
    source, text = LAYERS[name]
    return spark.sql(text.replace('"row"', "row").replace('"col"', "col"), **{source: table(spark, sf_dir, source)})


def zone_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = layer(spark, sf_dir, "zones")
    corners = [(F.col("x") + F.col("size") * dx, F.col("y") + F.col("size") * dy) for dx, dy in ZONE_CORNERS]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return z.withColumns(
        {
            "rings": geo.ring(corners),
            "x0": F.least(*xs),
            "y0": F.least(*ys),
            "x1": F.greatest(*xs),
            "y1": F.greatest(*ys),
        }
    ).drop("x", "y", "size")


def box_polygons(df: DataFrame) -> DataFrame:
    return df.withColumn("rings", geo.box_rings("x0", "y0", "x1", "y1"))


RASTER_AFFINE = {"x0": -125.0, "y0": 49.0, "px": 58.0 / 120, "py": 0.192}


def catchments(stores: DataFrame) -> DataFrame:
    """Four-cornered catchments of unequal size around every store."""
    half = 0.02 + F.pmod(F.col("loc_id"), F.lit(5)) * 0.002
    corners = [(F.col("lng") + half * dx, F.col("lat") + half * dy) for dx, dy in ZONE_CORNERS]
    return stores.withColumn("rings", geo.ring(corners)).withColumns(geo.ring_extent("rings"))


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square parcels around every site; a site without acreage has an empty one."""
    sites = layer(spark, sf_dir, "sites").select("loc_id", "lng", "lat", (F.col("acreage") * 4000.0).alias("acres"))
    sized = sites.withColumn("rings", geo.parcel_rings("lng", "lat", "acres"))
    return sized.withColumns(geo.ring_extent("rings"))


def as_features(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("lng", "f_lng").withColumnRenamed("lat", "f_lat")


# ── DuckDB side ─────────────────────────────────────────────────────────────
def cte(name: str) -> str:
    source, text = LAYERS[name]
    return f"{name} AS ({text.replace('{' + source + '}', source)})"


_CORNER_ROWS = ", ".join(
    f"({i}, {ax:e}, {ay:e}, {bx:e}, {by:e})"
    for i, ((ax, ay), (bx, by)) in enumerate(zip(ZONE_CORNERS, ZONE_CORNERS[1:] + ZONE_CORNERS[:1]))
)
ZONE_EDGES = f"""zone_edges AS (
  SELECT z.*, x + size * dax AS ax, y + size * day AS ay, x + size * dbx AS bx, y + size * dby AS by
  FROM zones z CROSS JOIN (VALUES {_CORNER_ROWS}) AS c(k, dax, day, dbx, dby))"""
CROSSES = "((e.ay > p.lat) <> (e.by > p.lat)) AND p.lng < (e.bx - e.ax) * ((p.lat - e.ay) / nullif(e.by - e.ay, 0)) + e.ax"


def with_ctes(*names_or_text: str, body: str) -> str:
    parts = [cte(n) if n in LAYERS else n for n in names_or_text]
    return "WITH " + ",\n".join(parts) + "\n" + body


def inside(points: str, point_key: str, name: str = "zone_hits", where: str = "TRUE") -> str:
    """Brute-force containment CTE: edge crossings counted per pair."""
    return f"""{name} AS (
  SELECT p.{point_key}, e.zone_id FROM {points} p JOIN zone_edges e ON {CROSSES}
  WHERE {where} GROUP BY p.{point_key}, e.zone_id HAVING count(*) % 2 = 1)"""


def hav(lng1: str, lat1: str, lng2: str, lat2: str) -> str:
    return (
        f"(2e0 * 6371000e0 * asin(least(1e0, sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2e0), 2) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2e0), 2)))))"
    )


PARCELS = """parcels AS (
  SELECT *, lng - hx AS x0, lat - hy AS y0, lng + hx AS x1, lat + hy AS y1 FROM (
    SELECT loc_id, lng, lat, acreage * 4000e0 AS acres, sqrt(acreage * 4000e0 * 4046.8564224e0) / (greatest(cos(radians(lat)), 1e-1) * 111320e0) / 2e0 AS hx,
      sqrt(acreage * 4000e0 * 4046.8564224e0) / 111320e0 / 2e0 AS hy FROM sites))"""


def strip_areas(name: str, windows: str, key: str, parts: str, outlines: str) -> str:
    """Brute-force CTEs: exact area, per window and part, under the union of its convex outlines.

    ``windows`` has the key and a box; ``parts`` joins ``w`` (windows) to part and shape; ``outlines``
    has shape, ax, ay, bx, by. Every edge end and crossing starts a strip, in which all bounds are straight.
    """
    group = f"{key}, part"
    return f"""{name}_near AS (SELECT w.{key}, w.x0, w.y0, w.x1, w.y1, part, shape FROM {windows} w JOIN {parts}),
{name}_segs AS (SELECT n.*, least(e.ax, e.bx) AS sx, greatest(e.ax, e.bx) AS tx, CASE WHEN e.ax < e.bx THEN e.ay ELSE e.by END AS sy, CASE WHEN e.ax < e.bx THEN e.by ELSE e.ay END AS ty
  FROM {name}_near n JOIN {outlines} e USING (shape) WHERE e.ax <> e.bx),
{name}_events AS (SELECT DISTINCT {group}, x FROM (
  SELECT {group}, x0, x1, unnest([x0, x1, sx, tx, CASE WHEN sy <> ty THEN sx + (y0 - sy) * (tx - sx) / (ty - sy) END, CASE WHEN sy <> ty THEN sx + (y1 - sy) * (tx - sx) / (ty - sy) END]) AS x FROM {name}_segs
  UNION ALL SELECT {group}, x0, x1, (p - q - m * px + n * qx) / (n - m) AS x FROM (
    SELECT a.{key}, a.part, a.x0, a.x1, a.sx AS px, a.sy AS p, (a.ty - a.sy) / (a.tx - a.sx) AS m, b.sx AS qx, b.sy AS q, (b.ty - b.sy) / (b.tx - b.sx) AS n
    FROM {name}_segs a JOIN {name}_segs b ON a.{key} = b.{key} AND a.part = b.part AND a.shape < b.shape AND a.sx < b.tx AND b.sx < a.tx) WHERE m <> n)
  WHERE x BETWEEN x0 AND x1),
{name}_strips AS (SELECT * FROM (SELECT {group}, x AS xa, lead(x) OVER (PARTITION BY {group} ORDER BY x) AS xb FROM {name}_events) WHERE xb > xa),
{name}_bands AS (SELECT {group}, xa, xb, shape, greatest(min(y), any_value(y0)) AS lo, least(max(y), any_value(y1)) AS hi FROM (
  SELECT s.*, g.shape, g.y0, g.y1, g.sy + (g.ty - g.sy) / (g.tx - g.sx) * ((xa + xb) / 2e0 - g.sx) AS y
  FROM {name}_strips s JOIN {name}_segs g ON g.{key} = s.{key} AND g.part = s.part AND g.sx < (xa + xb) / 2e0 AND g.tx > (xa + xb) / 2e0) GROUP BY {group}, xa, xb, shape),
{name}_seen AS (SELECT *, max(hi) OVER (PARTITION BY {group}, xa ORDER BY lo, shape ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {name}_bands WHERE lo < hi),
{name} AS (SELECT {group}, sum(greatest(0e0, hi - greatest(lo, coalesce(top, lo))) * (xb - xa)) AS area FROM {name}_seen GROUP BY {group})"""


#: Catchments of the stores (see `catchments`): half sizes, edges from west to east, extents.
CATCHMENTS = f"""halves AS (SELECT *, 0.02e0 + (loc_id % 5) * 0.002e0 AS half FROM stores),
sides AS (SELECT loc_id, lng + half * least(dax, dbx) AS sx, lat + half * CASE WHEN dax < dbx THEN day ELSE dby END AS sy, lng + half * greatest(dax, dbx) AS tx, lat + half * CASE WHEN dax < dbx THEN dby ELSE day END AS ty
  FROM halves CROSS JOIN (VALUES {_CORNER_ROWS}) AS c(k, dax, day, dbx, dby)),
extents AS (SELECT loc_id, any_value(segment) AS segment, min(sx) AS x0, max(tx) AS x1, min(least(sy, ty)) AS y0, max(greatest(sy, ty)) AS y1 FROM sides JOIN halves USING (loc_id) GROUP BY loc_id)"""
#: Area of a catchment of half size 1, by the shoelace rule.
CATCHMENT_AREA = sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ZONE_CORNERS, ZONE_CORNERS[1:] + ZONE_CORNERS[:1])) / 2.0

#: The raster's elevation at a 5 × 5 lattice over every parcel, and slopes at the inner points.
TERRAIN = """lat_pts AS (SELECT loc_id, side, i, j, lng - hx + hx * 2e0 * j / 4 AS plng, lat - hy + hy * 2e0 * i / 4 AS plat
  FROM (SELECT *, sqrt(acres * 4046.8564224e0) AS side FROM parcels WHERE acres > 0) CROSS JOIN (SELECT unnest(range(5)) AS i) CROSS JOIN (SELECT unnest(range(5)) AS j)),
elevations AS (SELECT loc_id, side, i, j, CASE WHEN dem <> -9999 THEN dem END AS z FROM (
  SELECT *, CAST(floor((49e0 - plat) / 0.192e0) AS BIGINT) AS r, CAST(floor((plng + 125e0) / (58e0 / 120)) AS BIGINT) AS c FROM lat_pts) LEFT JOIN raster ON "row" = r AND "col" = c),
inner_points AS (SELECT c.loc_id, (e.z - w.z) / (c.side / 4 * 2e0) AS dx, (n.z - s.z) / (c.side / 4 * 2e0) AS dy FROM elevations c
  JOIN elevations e ON e.loc_id = c.loc_id AND e.i = c.i AND e.j = c.j + 1 JOIN elevations w ON w.loc_id = c.loc_id AND w.i = c.i AND w.j = c.j - 1
  JOIN elevations n ON n.loc_id = c.loc_id AND n.j = c.j AND n.i = c.i + 1 JOIN elevations s ON s.loc_id = c.loc_id AND s.j = c.j AND s.i = c.i - 1
  WHERE c.z IS NOT NULL AND e.z IS NOT NULL AND w.z IS NOT NULL AND n.z IS NOT NULL AND s.z IS NOT NULL)"""
#: Outlines of the zones for `strip_areas`, and the zones near a window.
ZONE_SHAPES = """zone_shapes AS (SELECT zone_id AS shape, e.ax, e.ay, e.bx, e.by FROM zone_edges e),
zone_boxes AS (SELECT zone_id AS shape, any_value(kind) AS kind, any_value(flood_zone) AS flood_zone, min(ax) AS zx0, min(ay) AS zy0, max(ax) AS zx1, max(ay) AS zy1 FROM zone_edges GROUP BY zone_id)"""
NEAR_ZONE = "zx0 < w.x1 AND zx1 > w.x0 AND zy0 < w.y1 AND zy1 > w.y0"
