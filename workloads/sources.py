"""Reader and writer queries and their SQL twins.

Each query writes text, CSV, JSON or Parquet made from a test table to a scratch
folder in a source's own format and reads it back through the source's reader.
The twin computes the same rows from the table directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import geo
from parcelwise.operators import overlap
from parcelwise.operators import relational
from parcelwise.plans import portfolio as P
from parcelwise.session import scratch_folder
from parcelwise.sources import catalog, readers, sinks

from .layers import ZONE_CORNERS, layer, table, with_ctes, zone_polygons
from .solar import home_state


def text_lines(df: DataFrame, name: str) -> str:
    """Write a one-column frame as text; the folder's path."""
    path = scratch_folder(df.sparkSession, name)
    df.write.text(path)
    return path


def csv_lines(df: DataFrame, name: str, **options) -> str:
    path = scratch_folder(df.sparkSession, name)
    df.write.options(header=True, **options).csv(path)
    return path


def geojson_structures(spark, sf_dir):
    """Point features with typed properties, names lower-cased, export columns dropped."""
    s = layer(spark, sf_dir, "structures").select("fd_id", "occtype", F.col("val_struct").alias("VAL_STRUCT"), F.lit(1).alias("Shape_Area"), "lng", "lat")
    path = text_lines(sinks.point_features(s, ["fd_id", "occtype", "VAL_STRUCT", "Shape_Area"]), "structures")
    got = sinks.lower_case(readers.read_geojson(spark, path, "fd_id bigint, occtype string, VAL_STRUCT double, Shape_Area int", whole_file=False))
    return got.select("fd_id", "occtype", F.round("val_struct", 2).alias("val_struct"), F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), (F.size(F.array(*map(F.lit, got.columns)))).alias("n_columns"))


def perimeter_layer(spark, sf_dir):
    """Polygon features without null or empty geometries, cut to an envelope."""
    z = zone_polygons(spark, sf_dir).select("zone_id", "rings")
    z = z.withColumn("rings", F.when(F.col("zone_id") % 7 == 0, F.lit(None)).when(F.col("zone_id") % 7 == 1, F.array().cast("array<array<struct<x:double,y:double>>>")).otherwise(F.col("rings")))
    got = readers.drop_empty(readers.read_geojson(spark, text_lines(sinks.polygon_features(z, ["zone_id"]), "perimeters"), "zone_id bigint", whole_file=False))
    hit = overlap.bbox_filter(got, -115.0, 28.0, -85.0, 44.0)
    return hit.select("zone_id", F.round(geo.polygon_area_deg2("rings"), 9).alias("area_deg2"), F.round("x0", 6).alias("x0"), F.round("y1", 6).alias("y1"))


def nested_buildings(spark, sf_dir):
    """Parquet with a nested box, rows that meet an envelope."""
    z = zone_polygons(spark, sf_dir)
    path = scratch_folder(spark, "buildings")
    z.select("zone_id", F.struct(F.col("x0").alias("xmin"), F.col("y0").alias("ymin"), F.col("x1").alias("xmax"), F.col("y1").alias("ymax")).alias("bbox")).write.parquet(path)
    return readers.bbox_scan(spark, path, -110.0, 30.0, -90.0, 42.0).select("zone_id", F.round("bbox.xmin", 6).alias("xmin"))


def nested_places(spark, sf_dir):
    """S3: places with nested names, categories and addresses."""
    p = layer(spark, sf_dir, "pois")
    path = scratch_folder(spark, "places")
    addresses = F.when(F.col("poi_id") % 3 == 0, F.array().cast("array<struct<freeform:string>>")).otherwise(F.array(F.struct(F.concat(F.col("poi_id"), F.lit(" Main")).alias("freeform"))))
    p.select(
        F.col("poi_id").cast("string").alias("id"), F.struct(F.col("poi_name").alias("primary")).alias("names"), F.struct(F.col("category").alias("primary")).alias("categories"),
        addresses.alias("addresses"), (F.col("size_class") / 50.0).alias("confidence"),
        F.struct(F.col("lng").alias("xmin"), F.col("lng").alias("xmax"), F.col("lat").alias("ymin"), F.col("lat").alias("ymax")).alias("bbox"),
    ).write.parquet(path)
    got = readers.nested_places(spark.read.parquet(path))
    return got.select("id", "name", "category", "address", F.round("confidence", 4).alias("confidence"), F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


def pipe_records(spark, sf_dir):
    """Headerless pipe-delimited text, filtered by a suffix."""
    p = table(spark, sf_dir, "part")
    path = text_lines(p.select(F.concat_ws("|", "p_partkey", "p_name", "p_brand", "p_size").alias("value")), "pipes")
    raw = readers.read_pipe_records(spark, path, ["id", "name", "brand", "size"])
    return raw.filter(F.col("brand").endswith("1")).select(F.col("id").try_cast("bigint").alias("id"), "name", F.col("size").try_cast("int").alias("size"))


def wide_csv(spark, sf_dir):
    """Named columns of a wide CSV with a zero-padded id."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ID"), F.round("c_acctbal", 2).alias("PCT"), "c_name", F.col("c_nationkey").alias("STATE"), "c_mktsegment")
    got = readers.read_wide_csv(spark, csv_lines(c, "wide"), {"ID": "string", "PCT": "double", "STATE": "int"}, "ID")
    return got.select("id", "pct", "state")


def block_jobs(spark, sf_dir):
    """Workplace blocks of one county with their tract."""
    o = table(spark, sf_dir, "orders")
    code = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "48113").otherwise("48085"), F.lpad((F.col("o_orderkey") % 1_000_000).cast("string"), 6, "0"), F.lpad((F.col("o_orderkey") % 9999).cast("string"), 4, "0"))
    rows = o.select(code.alias("w_geocode"), *[(F.col("o_orderkey") % m).cast("int").alias(n) for n, m in (("C000", 997), ("CE01", 101), ("CE02", 103), ("CE03", 107))])
    return readers.jobs_by_tract(spark, csv_lines(rows, "jobs"), "48113")


def solar_generators(spark, sf_dir):
    """Solar generators with one coordinate row per plant."""
    p = table(spark, sf_dir, "part")
    gens = p.select(
        (F.col("p_partkey") % 400).alias("plant_code"), F.col("p_partkey").alias("generator_id"), F.when(F.col("p_partkey") % 11 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("capacity_mw"),
        F.when(F.col("p_partkey") % 3 == 0, "Solar Photovoltaic").otherwise("Onshore Wind").alias("technology"),
    )
    plants = p.filter(F.col("p_partkey") % 5 != 0).select((F.col("p_partkey") % 400).alias("plant_code"), (F.col("p_partkey") % 90).cast("string").alias("latitude"), (-(F.col("p_partkey") % 170)).cast("string").alias("longitude"))
    return readers.generators_with_plants(gens, plants).select("plant_code", "generator_id", "capacity_mw", "lat", "lng")


def queue_extract(spark, sf_dir):
    """Active solar requests, and their county centroid by code from a tab-delimited gazetteer."""
    o = table(spark, sf_dir, "orders")
    raw = o.select(
        F.col("o_orderkey").cast("string").alias("q_id"), F.lit("ISO").alias("entity"), F.when(F.col("o_orderstatus") == "F", "Active").otherwise("withdrawn").alias("q_status"),
        F.when(F.col("o_orderkey") % 2 == 0, "Solar+Battery").otherwise("Wind").alias("type_clean"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("P"), F.col("o_orderkey"))).alias("project_name"),
        (F.col("o_orderkey") % 300).cast("string").alias("mw1"), F.concat(F.lit("County"), F.col("o_orderkey") % 991).alias("county"), F.lit("TX").alias("state"), (F.col("o_orderkey") % 997).cast("string").alias("fips_codes"),
    )
    s = table(spark, sf_dir, "supplier")
    lines = s.select(F.col("s_suppkey").cast("string").alias("GEOID"), F.lit("TX").alias("USPS"), F.concat(F.lit("County"), F.col("s_suppkey")).alias("NAME"), (F.col("s_suppkey") % 90 / 2.0).alias("INTPTLAT"), (-(F.col("s_suppkey") % 180)).alias("INTPTLONG"))
    centroids = readers.read_gazetteer(spark, csv_lines(lines, "gazetteer", sep="\t"))
    located, unlocated = readers.locate_queue(readers.active_solar_queue(raw), centroids)
    return located.unionByName(unlocated).select("queue_id", "project_name", "capacity_mw", "county", "fips", "lat", "lng")


def rdb_flows(spark, sf_dir):
    """Commented tab text with a type row."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("\t", F.concat(F.lit("site"), F.col("event_id")), F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("user_id").cast("string")), "event_type").alias("value"))
    marks = e.filter(F.col("value").startswith("site1")).select(F.lit("# a comment").alias("value")).unionByName(e.limit(1).select(F.lit("5s\t14n\t10d").alias("value"))).unionByName(e.limit(1).select(F.lit("site_no\tpeak\tkind").alias("value")))
    got = readers.read_rdb(spark, text_lines(marks.unionByName(e), "rdb"), ["site_no", "peak", "kind"])
    return got.select("site_no", F.col("peak").try_cast("bigint").alias("peak"), "kind")


def gtfs_stops(spark, sf_dir):
    """Stops of two feeds, one of them without a location type."""
    p = table(spark, sf_dir, "part")
    a = p.filter(F.col("p_partkey") % 2 == 0).select(F.col("p_partkey").alias("stop_id"), F.concat(F.lit(" "), "p_name", F.lit(" ")).alias(" Stop_Name"), (F.col("p_partkey") % 90).alias("stop_lat"), (F.col("p_partkey") % 180).alias("stop_lon"), (F.col("p_partkey") % 4).alias("location_type"))
    b = p.filter(F.col("p_partkey") % 2 == 1).select(F.col("p_partkey").alias("stop_id"), F.col("p_name").alias("stop_name"), F.when(F.col("p_partkey") % 5 == 0, "x").otherwise((F.col("p_partkey") % 90).cast("string")).alias("stop_lat"), (F.col("p_partkey") % 180).alias("stop_lon"))
    got = readers.read_gtfs_stops(spark, {"A": csv_lines(a, "gtfs-a"), "B": csv_lines(b, "gtfs-b")})
    return got.select("agency", F.col("stop_id").cast("bigint").alias("stop_id"), "stop_name", "lat", "lng")


def osm_text(spark, sf_dir, name: str) -> DataFrame:
    """Elements of every part: nodes, ways with a centre, ways with vertices."""
    p = table(spark, sf_dir, "part")
    at = lambda k: F.struct((k % 90).cast("double").alias("lat"), (k % 180).cast("double").alias("lon"))
    k = F.col("p_partkey")
    tags = F.when(k % 6 == 0, F.create_map(F.lit("power"), F.lit("substation"), F.lit("voltage"), (k * 1000).cast("string"), F.lit("name"), F.col("p_name"))).when(
        k % 6 == 1, F.create_map(F.lit("shop"), F.col("p_brand"), F.lit("amenity"), F.lit("cafe"))
    ).when(k % 6 == 2, F.create_map(F.lit("highway"), F.lit("primary"))).otherwise(F.create_map(F.lit("shop"), F.col("p_brand"), F.lit("name"), F.col("p_name")))
    node = k % 4 != 0
    element = F.struct(
        k.alias("id"), F.when(k % 6 == 2, "way").otherwise("node").alias("type"), F.when(node, (k % 90).cast("double")).alias("lat"), F.when(node, (k % 180).cast("double")).alias("lon"),
        F.when(k % 8 == 0, at(k)).alias("center"), tags.alias("tags"), F.when(k % 6 == 2, F.slice(F.array(at(k), at(k + 1), at(k + 2)), 1, (k % 3 + 1).cast("int"))).alias("geometry"),
    )
    return readers.read_osm(spark, text_lines(p.select(F.to_json(element).alias("value")), name), whole_file=False)


def osm_points(spark, sf_dir):
    """Nodes and way centres; the first present key gives the category."""
    return readers.osm_points(osm_text(spark, sf_dir, "osm-points"))


def osm_substations(spark, sf_dir):
    """Substations with their voltage."""
    return readers.osm_substations(osm_text(spark, sf_dir, "osm-subs"), "TX").select("osm_id", "state", "name", "voltage", "lng", "lat")


def osm_lines(spark, sf_dir):
    """Ways with two or more vertices."""
    lines = readers.osm_lines(osm_text(spark, sf_dir, "osm-lines"))
    return readers.exploded_segments(lines, ["osm_id", "highway"])


def inundation_tiles(spark, sf_dir):
    """Tile boxes and risk levels from file and layer names, tiles that meet the box of the states."""
    s = table(spark, sf_dir, "supplier")
    path = F.concat(F.lit("inundation_history_"), F.col("s_suppkey") % 60, F.lit("_"), -(F.col("s_suppkey") % 180), F.lit("_"), F.col("s_suppkey") % 60 + 1, F.lit("_"), -(F.col("s_suppkey") % 180) + 1, F.lit(".geojson"))
    name = F.when(F.col("s_suppkey") % 3 == 0, "Inundation_High").when(F.col("s_suppkey") % 3 == 1, "inundation medium").when(F.col("s_suppkey") % 4 == 0, "other").otherwise("Low")
    return readers.inundation_tiles(s.select("s_suppkey", path.alias("path"), name.alias("layer")), box=(-125.0, 24.0, -66.0, 49.0)).select("s_suppkey", "x0", "y0", "x1", "y1", "risk_level", "wet_pct")


def claim_rename(spark, sf_dir):
    """Renamed and typed claim columns; what does not parse is null."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 9 == 0, "?").otherwise(F.col("user_id").cast("string")).alias("amountPaidOnBuildingClaim"), F.to_date("ts").cast("string").alias("dateOfLoss"))
    return readers.claim_rows(e, {"id": ("claim_id", "bigint"), "amountPaidOnBuildingClaim": ("paid_building", "double"), "dateOfLoss": ("date_of_loss", "date")})


def census_tracts(spark, sf_dir):
    """Tract ids, summed age cells, sentinels to null, share with a degree, joined to the tracts that exist."""
    c = table(spark, sf_dir, "customer")
    raw = c.select(
        F.lit("48").alias("state"), F.lit("113").alias("county"), F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("tract"),
        F.when(F.col("c_custkey") % 7 == 0, "-666666666").otherwise((F.col("c_custkey") % 900).cast("string")).alias("a1"), (F.col("c_custkey") % 31).cast("string").alias("a2"),
        F.when(F.col("c_custkey") % 5 == 0, "-666666666").otherwise((F.col("c_custkey") * 10).cast("string")).alias("income"), (F.col("c_custkey") % 13).cast("string").alias("ba"), (F.col("c_custkey") % 4 * 25).cast("string").alias("grown"),
    )
    tracts = readers.acs_tracts(raw, ["a1", "a2"], ["income", "ba", "grown"])
    known = layer(spark, sf_dir, "tracts").select(F.concat(F.lit("48113"), F.lpad(F.col("tract_id").cast("string"), 6, "0")).alias("geoid"))
    return tracts.withColumn("pct_degree", readers.percent_of(["ba"], "grown")).join(known, "geoid").select("geoid", "age_18_34", "income", "pct_degree")


def epa_facilities(spark, sf_dir):
    """Two facility lists in one, degrees from decimal or packed form."""
    c = table(spark, sf_dir, "customer")
    primary = c.filter(F.col("c_custkey") % 2 == 0).select(
        (F.col("c_custkey") % 500).alias("facility_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).otherwise((F.col("c_custkey") % 20 + 30).cast("string")).alias("pref_latitude"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).otherwise((-(F.col("c_custkey") % 40) - 80).cast("string")).alias("pref_longitude"), (F.col("c_custkey") % 10 * 10000 + 303000).cast("string").alias("fac_latitude"), (F.col("c_custkey") % 10 * 10000 + 903000).cast("string").alias("fac_longitude"),
    )
    secondary = c.filter(F.col("c_custkey") % 2 == 1).select(F.col("c_custkey").alias("facility_id"), "c_name", (F.col("c_custkey") % 80).cast("string").alias("lat"), (-(F.col("c_custkey") % 150)).cast("string").alias("lng")).withColumnRenamed("c_name", "name")
    return readers.facilities(primary, secondary, (-125.0, 24.0, -66.0, 50.0)).select("facility_id", "name", "facility_type", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


def seismic_features(spark, sf_dir):
    """Faults and earthquakes in one layer."""
    faults = layer(spark, sf_dir, "lines").select(F.col("line_id").alias("feature_id"), F.col("owner").alias("name"))
    quakes = layer(spark, sf_dir, "substations").select(F.col("sub_id").alias("feature_id"), (F.col("sub_id") % 80 / 10.0).alias("magnitude"))
    return readers.seismic(faults, quakes).select("feature_type", "feature_id", "name", "magnitude")


def filtered_roads(spark, sf_dir):
    """An attribute-filtered layer with renamed columns."""
    p = layer(spark, sf_dir, "lines").withColumn("MTFCC", F.when(F.col("line_id") % 3 == 0, "S1100").when(F.col("line_id") % 3 == 1, "S1200").otherwise("S1400"))
    return readers.filter_layer(p, F.col("MTFCC").isin("S1100", "S1200"), {"MTFCC": "road_class", "owner": "road_name"}).select("line_id", "road_class", "road_name")


def projected_wetlands(spark, sf_dir):
    """Wetlands whose box meets the projected envelope of a lng/lat box, attribute renamed."""
    z = zone_polygons(spark, sf_dir).filter(F.col("kind") == "wetland")
    boxed = readers.projected_envelope(z)
    frame = readers.projected_envelope(spark.createDataFrame([(-110.0, 30.0, -90.0, 42.0)], "x0 double, y0 double, x1 double, y1 double")).first()
    hit = boxed.filter((F.col("px0") <= frame.px1) & (F.col("px1") >= frame.px0) & (F.col("py0") <= frame.py1) & (F.col("py1") >= frame.py0))
    return hit.withColumnRenamed("flood_zone", "wetland_type").select("zone_id", "wetland_type")


def portfolio_upload(spark, sf_dir):
    """An uploaded CSV with header synonyms; rows and bad rows together."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(" Prop_ID"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("ADDR"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise((F.col("c_custkey") % 90).cast("string")).alias("Lat"), (F.col("c_custkey") % 180).alias("Long")
    )
    rows, bad = readers.read_portfolio(spark, csv_lines(c, "portfolio"))
    both = rows.withColumn("bad", F.lit(False)).unionByName(bad.withColumn("bad", F.lit(True)))
    return both.select(F.col("property_id").cast("bigint").alias("property_id"), "address", "lat", "lng", "bad")


def parcel_upload(spark, sf_dir):
    """The first identifier a parcel has."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey")).alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("APN"), F.col("p_partkey"))).alias("apn"), *[F.lit(float(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    got = readers.parcel_ids(p)
    return got.select("k", F.when(F.col("id").isNull() & F.col("apn").isNull(), F.substring("parcel_id", 1, 7)).otherwise(F.col("parcel_id")).alias("parcel_id"))


def location_lines(spark, sf_dir):
    """Locations as coordinates with a name, or as an address."""
    c = table(spark, sf_dir, "customer")
    line = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("Street "), F.col("c_custkey"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.col("c_custkey") % 90, F.lit(", -"), F.col("c_custkey") % 180)).otherwise(F.concat(F.lit(" "), F.col("c_custkey") % 90, F.lit(".5,"), F.col("c_custkey") % 180, F.lit(" , "), F.col("c_name")))
    head = c.limit(1).select(F.lit("lat,lng,name").alias("value"))
    return readers.read_locations(spark, text_lines(head.unionByName(c.select(line.alias("value"))), "locations"))


def region_of_sites(spark, sf_dir):
    """Sites by the region of their state."""
    s = layer(spark, sf_dir, "sites").withColumn("state", home_state())
    return s.join(catalog.region_states(spark), "state").groupBy("region").agg(F.count(F.lit(1)).alias("n"))


def layer_write(spark, sf_dir):
    """K1: a layer written by grid cell, names lower-cased, export columns dropped."""
    z = zone_polygons(spark, sf_dir).select("zone_id", F.col("kind").alias("KIND"), F.lit(1).alias("OBJECTID_1"), "x0", "y0", "x1", "y1")
    path = scratch_folder(spark, "layer")
    sinks.write_layer(z, path)
    got = spark.read.parquet(path)
    return got.select("zone_id", "kind", F.round("x0", 6).alias("x0"), F.lit(len(got.columns)).alias("n_columns"))


def report_csv(spark, sf_dir):
    """K6: a report written as CSV with a header."""
    n = layer(spark, sf_dir, "structures").groupBy("occtype").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("val_struct"), 0).cast("bigint").alias("value"))
    path = scratch_folder(spark, "report")
    sinks.write_report(n, path)
    return spark.read.csv(path, header=True, schema="occtype string, n bigint, value bigint")


def guarded_result(spark, sf_dir):
    """an aggregate of all orders stays under the limit and comes as it is; all orders are over it and give their count and a sample of five."""
    o = table(spark, sf_dir, "orders")
    small, n_small = relational.guarded(o.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last")), 1000)
    large, n_large = relational.guarded(o, 10)
    checked = small.agg(F.count(F.lit(1)).alias("rows_small"), F.sum("n").alias("orders_small"), F.max("last").alias("last_small"))
    return checked.select("rows_small", F.lit(n_small).alias("n_small"), F.coalesce("orders_small", F.lit(0)).cast("long").alias("orders_small"), "last_small", F.lit(large.count()).alias("rows_large"), F.lit(n_large).alias("n_large"))


def benchmark_mean(spark, sf_dir):
    """Mean and count of known losses."""
    s = layer(spark, sf_dir, "structures").select(F.when(F.col("val_struct") > 0, F.col("val_struct") * F.col("burn_probability")).alias("expected_annual_loss"))
    return P.benchmark_mean(s).select(F.round("mean_eal", 6).alias("mean_eal"), "n_structures")


QUERIES = {f.__name__: f for f in (
    geojson_structures, perimeter_layer, nested_buildings, nested_places, pipe_records, wide_csv, block_jobs, solar_generators, queue_extract,
    rdb_flows, gtfs_stops, osm_points, osm_substations, osm_lines, inundation_tiles, claim_rename, census_tracts, epa_facilities, seismic_features,
    filtered_roads, projected_wetlands, portfolio_upload, parcel_upload, location_lines, region_of_sites, layer_write, report_csv, guarded_result, benchmark_mean,
)}

# ── SQL twins ───────────────────────────────────────────────────────────────
_AREA = abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ZONE_CORNERS, ZONE_CORNERS[1:] + ZONE_CORNERS[:1]))) / 2.0
_XS, _YS = [c[0] for c in ZONE_CORNERS], [c[1] for c in ZONE_CORNERS]
_BOXES = f"""boxes AS (SELECT *, x + size * {min(_XS)!r} AS x0, y + size * {min(_YS)!r} AS y0, x + size * {max(_XS)!r} AS x1, y + size * {max(_YS)!r} AS y1 FROM zones)"""
_OSM = """osm AS (SELECT p_partkey AS k, p_name, p_brand, CASE WHEN p_partkey % 4 <> 0 OR p_partkey % 8 = 0 THEN (p_partkey % 90)::DOUBLE END AS lat,
  CASE WHEN p_partkey % 4 <> 0 OR p_partkey % 8 = 0 THEN (p_partkey % 180)::DOUBLE END AS lng FROM part)"""
_N = "CASE WHEN nation_id < 6 THEN 'CA' WHEN nation_id < 12 THEN 'TX' WHEN nation_id < 18 THEN 'OH' END"


def _regions() -> str:
    from parcelwise.functions import constants as K

    return ", ".join(f"('{s}', '{r}')" for s, r in K.STATE_REGION.items())


def _albers(lng: str, lat: str) -> tuple[str, str]:
    s = f"sin(radians({lat}))"
    q = f"(({s} / (1 - {s} * {s} * {geo._E2!r}) - ln((1 - {s} * {geo._E!r}) / (1 + {s} * {geo._E!r})) / {2 * geo._E!r}) * {1 - geo._E2!r})"
    rho = f"(sqrt({geo._C!r} - {q} * {geo._N!r}) * {geo._A / geo._N!r})"
    theta = f"(radians({lng} - ({geo._LAM0!r})) * {geo._N!r})"
    return f"({rho} * sin({theta}))", f"({geo._RHO0!r} - {rho} * cos({theta}) + ({geo._FALSE_NORTHING!r}))"


def _envelope() -> str:
    xs, ys = zip(*(_albers(x, y) for x in ("x0", "x1") for y in ("y0", "y1")))
    return f"least({', '.join(xs)}) AS px0, least({', '.join(ys)}) AS py0, greatest({', '.join(xs)}) AS px1, greatest({', '.join(ys)}) AS py1"


ORACLES = {
    "geojson_structures": with_ctes("structures", body="""
SELECT fd_id, occtype, round(val_struct, 2) AS val_struct, round(lng, 6) AS lng, round(lat, 6) AS lat, 13 AS n_columns FROM structures"""),
    "perimeter_layer": with_ctes("zones", _BOXES, body=f"""
SELECT zone_id, round({_AREA!r} * size * size, 9) AS area_deg2, round(x0, 6) AS x0, round(y1, 6) AS y1 FROM boxes
WHERE zone_id % 7 > 1 AND x0 <= -85 AND x1 >= -115 AND y0 <= 44 AND y1 >= 28"""),
    "nested_buildings": with_ctes("zones", _BOXES, body="""
SELECT zone_id, round(x0, 6) AS xmin FROM boxes WHERE x0 <= -90 AND x1 >= -110 AND y0 <= 42 AND y1 >= 30"""),
    "nested_places": with_ctes("pois", body="""
SELECT CAST(poi_id AS STRING) AS id, poi_name AS name, category, CASE WHEN poi_id % 3 <> 0 THEN concat(poi_id, ' Main') END AS address,
  round(size_class / 50e0, 4) AS confidence, round(lng, 6) AS lng, round(lat, 6) AS lat FROM pois"""),
    "pipe_records": "SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part WHERE p_brand LIKE '%1'",
    "wide_csv": "SELECT lpad(CAST(c_custkey AS STRING), 12, '0') AS id, round(c_acctbal, 2) AS pct, c_nationkey AS state FROM customer",
    "block_jobs": """
SELECT code AS w_geocode, substr(code, 1, 11) AS tract_geoid, (k % 997)::INT AS c000, (k % 101)::INT AS ce01, (k % 103)::INT AS ce02, (k % 107)::INT AS ce03
FROM (SELECT o_orderkey AS k, concat('48113', lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0'), lpad(CAST(o_orderkey % 9999 AS STRING), 4, '0')) AS code FROM orders WHERE o_orderkey % 2 = 0)""",
    "solar_generators": """
WITH plants AS (SELECT p_partkey % 400 AS plant_code, CAST(p_partkey % 90 AS STRING) AS la, CAST(-(p_partkey % 170) AS STRING) AS lo FROM part WHERE p_partkey % 5 <> 0),
one AS (SELECT * FROM plants QUALIFY row_number() OVER (PARTITION BY plant_code ORDER BY la, lo) = 1)
SELECT p_partkey % 400 AS plant_code, p_partkey AS generator_id, CASE WHEN p_partkey % 11 <> 0 THEN p_size::DOUBLE END AS capacity_mw, la::DOUBLE AS lat, lo::DOUBLE AS lng
FROM part JOIN one ON plant_code = p_partkey % 400 WHERE p_partkey % 3 = 0""",
    "queue_extract": """
WITH q AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0), s AS (SELECT s_suppkey AS g FROM supplier)
SELECT concat('Q-', substr(sha256(concat(k, '|ISO')), 1, 16)) AS queue_id, CASE WHEN k % 3 <> 0 THEN concat('P', k) ELSE CAST(k AS STRING) END AS project_name, (k % 300)::DOUBLE AS capacity_mw,
  concat('County', k % 991) AS county, lpad(CAST(k % 997 AS STRING), 5, '0') AS fips, coalesce(a.g, b.g) % 90 / 2e0 AS lat, -(coalesce(a.g, b.g) % 180)::DOUBLE AS lng
FROM q LEFT JOIN s a ON a.g = k % 997 LEFT JOIN s b ON b.g = k % 991""",
    "rdb_flows": "SELECT concat('site', event_id) AS site_no, CASE WHEN event_id % 4 <> 0 THEN user_id END AS peak, event_type AS kind FROM events",
    "gtfs_stops": """
SELECT 'A' AS agency, p_partkey AS stop_id, trim(p_name) AS stop_name, (p_partkey % 90)::DOUBLE AS lat, (p_partkey % 180)::DOUBLE AS lng FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 4 IN (0, 1)
UNION ALL SELECT 'B', p_partkey, trim(p_name), (p_partkey % 90)::DOUBLE, (p_partkey % 180)::DOUBLE FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 5 <> 0""",
    "osm_points": f"""WITH {_OSM}
SELECT k AS osm_id, CASE WHEN k % 6 >= 3 THEN p_name END AS name, CASE WHEN k % 6 = 1 THEN 'amenity:cafe' ELSE concat('shop:', p_brand) END AS category, lng, lat
FROM osm WHERE lat IS NOT NULL AND k % 6 NOT IN (0, 2)""",
    "osm_substations": f"""WITH {_OSM}
SELECT k AS osm_id, 'TX' AS state, p_name AS name, CAST(k * 1000 AS STRING) AS voltage, lng, lat FROM osm WHERE lat IS NOT NULL AND k % 6 = 0""",
    "osm_lines": """
SELECT p_partkey AS osm_id, 'primary' AS highway, ((p_partkey + i) % 180)::DOUBLE AS ax, ((p_partkey + i) % 90)::DOUBLE AS ay, ((p_partkey + i + 1) % 180)::DOUBLE AS bx, ((p_partkey + i + 1) % 90)::DOUBLE AS by
FROM part CROSS JOIN (VALUES (0), (1)) AS v(i) WHERE p_partkey % 6 = 2 AND i < p_partkey % 3""",
    "inundation_tiles": """
SELECT s_suppkey, -(s_suppkey % 180)::DOUBLE AS x0, (s_suppkey % 60)::DOUBLE AS y0, -(s_suppkey % 180)::DOUBLE + 1 AS x1, (s_suppkey % 60)::DOUBLE + 1 AS y1,
  CASE s_suppkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk_level, CASE s_suppkey % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 1.0 ELSE 0.5 END AS wet_pct
FROM supplier WHERE -(s_suppkey % 180) < -66 AND -(s_suppkey % 180) + 1 > -125 AND s_suppkey % 60 < 49 AND s_suppkey % 60 + 1 > 24 AND NOT (s_suppkey % 3 = 2 AND s_suppkey % 4 = 0)""",
    "claim_rename": "SELECT event_id AS claim_id, CASE WHEN event_id % 9 <> 0 THEN user_id::DOUBLE END AS paid_building, ts::DATE AS date_of_loss FROM events",
    "census_tracts": with_ctes("tracts", body="""
SELECT concat('48113', lpad(CAST(c_custkey AS STRING), 6, '0')) AS geoid, CASE WHEN c_custkey % 7 = 0 THEN 0e0 ELSE (c_custkey % 900)::DOUBLE END + c_custkey % 31 AS age_18_34,
  CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey * 10)::DOUBLE END AS income, round(100e0 * (c_custkey % 13) / nullif(c_custkey % 4 * 25, 0), 1) AS pct_degree
FROM customer JOIN tracts ON tract_id = c_custkey"""),
    "epa_facilities": """
WITH a AS (SELECT c_custkey % 500 AS facility_id, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 20 + 30 AS STRING) END AS pla, CASE WHEN c_custkey % 3 <> 0 THEN CAST(-(c_custkey % 40) - 80 AS STRING) END AS plo,
    CAST(c_custkey % 10 * 10000 + 303000 AS STRING) AS fla, CAST(c_custkey % 10 * 10000 + 903000 AS STRING) AS flo FROM customer WHERE c_custkey % 2 = 0),
one AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY name, pla NULLS FIRST, plo NULLS FIRST, fla, flo) = 1),
u AS (SELECT facility_id, name, 'TRI' AS facility_type, coalesce(pla::DOUBLE, fla::BIGINT // 10000 + 0.5e0) AS lat, coalesce(plo::DOUBLE, -(flo::BIGINT // 10000 + 0.5e0)) AS lng FROM one
  UNION ALL SELECT c_custkey, c_name, 'ECHO', (c_custkey % 80)::DOUBLE, -(c_custkey % 150)::DOUBLE FROM customer WHERE c_custkey % 2 = 1)
SELECT facility_id, name, facility_type, round(lat, 6) AS lat, round(lng, 6) AS lng FROM u WHERE lat BETWEEN 24 AND 50 AND lng BETWEEN -125 AND -66""",
    "seismic_features": with_ctes("lines", "substations", body="""
SELECT 'fault' AS feature_type, line_id AS feature_id, owner AS name, NULL::DOUBLE AS magnitude FROM lines UNION ALL SELECT 'earthquake', sub_id, NULL, sub_id % 80 / 10e0 FROM substations"""),
    "filtered_roads": with_ctes("lines", body="""
SELECT line_id, CASE line_id % 3 WHEN 0 THEN 'S1100' ELSE 'S1200' END AS road_class, owner AS road_name FROM lines WHERE line_id % 3 < 2"""),
    "projected_wetlands": with_ctes("zones", _BOXES, body=f"""
, f AS (SELECT {_envelope()} FROM (SELECT -110e0 AS x0, 30e0 AS y0, -90e0 AS x1, 42e0 AS y1)), w AS (SELECT zone_id, flood_zone, {_envelope()} FROM boxes WHERE kind = 'wetland')
SELECT zone_id, flood_zone AS wetland_type FROM w WHERE px0 <= (SELECT px1 FROM f) AND px1 >= (SELECT px0 FROM f) AND py0 <= (SELECT py1 FROM f) AND py1 >= (SELECT py0 FROM f)"""),
    "portfolio_upload": """
SELECT c_custkey AS property_id, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS address, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 90)::DOUBLE END AS lat, (c_custkey % 180)::DOUBLE AS lng,
  c_custkey % 12 = 0 AS bad FROM customer""",
    "parcel_upload": "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS STRING) WHEN p_partkey % 2 = 0 THEN concat('APN', p_partkey) ELSE 'parcel_' END AS parcel_id FROM part",
    "location_lines": """
SELECT CASE WHEN c_custkey % 4 = 1 THEN (c_custkey % 90)::DOUBLE WHEN c_custkey % 4 > 1 THEN c_custkey % 90 + 0.5e0 END AS lat, CASE WHEN c_custkey % 4 = 1 THEN -(c_custkey % 180)::DOUBLE WHEN c_custkey % 4 > 1 THEN (c_custkey % 180)::DOUBLE END AS lng,
  CASE WHEN c_custkey % 4 > 1 THEN c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN concat('Street ', c_custkey) END AS address FROM customer""",
    "region_of_sites": with_ctes("sites", body=f"""
SELECT region, count(*) AS n FROM sites JOIN (VALUES {_regions()}) AS r(state, region) ON r.state = {_N} GROUP BY region"""),
    "layer_write": with_ctes("zones", _BOXES, body="SELECT zone_id, kind, round(x0, 6) AS x0, 6 AS n_columns FROM boxes"),
    "report_csv": with_ctes("structures", body="SELECT occtype, count(*) AS n, round(sum(val_struct), 0)::BIGINT AS value FROM structures GROUP BY occtype"),
    "guarded_result": """
WITH g AS (SELECT count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY o_orderstatus, o_orderpriority)
SELECT (SELECT count(*) FROM g) AS rows_small, (SELECT count(*) FROM g) AS n_small, (SELECT coalesce(sum(n), 0)::BIGINT FROM g) AS orders_small, (SELECT max(last) FROM g) AS last_small, 5 AS rows_large, count(*) AS n_large FROM orders""",
    "benchmark_mean": with_ctes("structures", body="""
SELECT round(avg(val_struct * burn_probability) FILTER (WHERE val_struct > 0), 6) AS mean_eal, count(*) FILTER (WHERE val_struct > 0) AS n_structures FROM structures"""),
}
