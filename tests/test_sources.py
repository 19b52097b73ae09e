import json
import os

from pyspark.sql import functions as F

from parcelwise.functions import geo
from parcelwise.functions import scoring as S
from parcelwise.operators import relational
from parcelwise.sources import readers, sinks
from parcelwise.streaming import audit_stream


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


FEATURES = [
    {"type": "Feature", "id": "a", "properties": {"name": "pt", "acres": 1.5}, "geometry": {"type": "Point", "coordinates": [-97.0, 33.0]}},
    {"type": "Feature", "id": "b", "properties": {"name": "poly", "acres": 2.0},
     "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [1, 2], [2, 2], [2, 1], [1, 1]]]}},
    {"type": "Feature", "id": "c", "properties": {"name": "multi", "acres": None},
     "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}},
    {"type": "Feature", "id": "d", "properties": {"name": "line", "acres": 0.0}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1], [2, 0]]}},
    {"type": "Feature", "id": "e", "properties": {"name": "none", "acres": 0.0}, "geometry": None},
]


def test_geojson_whole_and_lines(spark, folder):
    whole = put(folder, "all.geojson", json.dumps({"type": "FeatureCollection", "features": FEATURES}))
    lines = put(folder, "lines.geojsonl", "\n".join(json.dumps(f) for f in FEATURES))
    for path, mode in ((whole, True), (lines, False)):
        df = readers.read_geojson(spark, path, "name string, acres double", mode)
        rows = {r.feature_id: r for r in readers.drop_empty(df).collect()}
        assert set(rows) == set("abcd")
        assert (rows["a"].lng, rows["a"].lat, rows["a"].acres) == (-97.0, 33.0, 1.5)
        assert len(rows["b"].rings) == 2 and (rows["b"].x1, rows["b"].y1) == (4.0, 4.0)
        assert len(rows["c"].rings) == 2 and rows["c"].x1 == 6.0
        assert len(rows["d"].paths[0]) == 3
    segs = readers.exploded_segments(df.filter("feature_id = 'd'"), ["feature_id"]).collect()
    assert [(s.ax, s.bx) for s in segs] == [(0.0, 1.0), (1.0, 2.0)]


def test_bbox_parquet_prunes_columns(spark, folder):
    rows = [("p1", ("One",), ("cafe",), [("1 Main",)], 0.9, (-97.1, -97.0, 33.0, 33.1)), ("p2", ("Two",), None, [], 0.2, (10.0, 10.1, 5.0, 5.1))]
    schema = ("id string, names struct<primary:string>, categories struct<primary:string>, addresses array<struct<freeform:string>>, "
              "confidence double, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>")
    spark.createDataFrame(rows, schema).write.parquet(folder + "/p")
    hit = readers.nested_places(readers.bbox_scan(spark, folder + "/p", -98, 32, -96, 34))
    r = hit.collect()
    assert [(x.id, x.name, x.address) for x in r] == [("p1", "One", "1 Main")]
    assert readers.nested_places(spark.read.parquet(folder + "/p")).filter("id = 'p2'").first().address is None


def test_delimited_readers(spark, folder):
    pipe = put(folder, "s.txt", "1|Lincoln|CA\n2|Grant|TX\n")
    assert readers.read_pipe_records(spark, pipe, ["id", "name", "st"]).filter("st = 'CA'").first().name == "Lincoln"
    wide = put(folder, "w.csv", "﻿ID,PCT,SKIP\n12345,7.5,x\n99,bad,y\n")
    got = readers.read_wide_csv(spark, wide, {"ID": "string", "PCT": "double"}, "ID").collect()
    assert [(r.id, r.pct) for r in got] == [("000000012345", 7.5), ("000000000099", None)]
    jobs = put(folder, "j.csv", "w_geocode,C000,CE01,CE02,CE03\n481130001001000,5,1,2,2\n060010001001000,9,1,1,7\n")
    j = readers.jobs_by_tract(spark, jobs, "48113").collect()
    assert [(r.tract_geoid, r.c000) for r in j] == [("48113000100", 5)]
    gaz = put(folder, "g.txt", "USPS\tGEOID\tNAME\tINTPTLAT\tINTPTLONG   \nCA\t6029\tKern\t35.3\t-118.7  \n")
    g = readers.read_gazetteer(spark, gaz).first()
    assert (g.fips, g.lat, g.lng) == ("06029", 35.3, -118.7)
    rdb = put(folder, "q.rdb", "# note\nagency\tsite\tpeak\n5s\t15s\t8s\nUSGS\t0123\t450\nUSGS\t0124\t\n")
    r = readers.read_rdb(spark, rdb, ["agency", "site", "peak"]).collect()
    assert [(x.site, x.peak) for x in r] == [("0123", "450"), ("0124", None)]


def test_gtfs_feeds(spark, folder):
    a = put(folder, "a.txt", "stop_id, Stop_Name,stop_lat,stop_lon,location_type\n1, Main ,33.0,-97.0,\n2,Gate,33.1,-97.1,2\n")
    b = put(folder, "b.txt", "stop_id,stop_name,stop_lat,stop_lon\n9,Bay,37.0,-122.0\n10,Bad,x,-122\n")
    got = readers.read_gtfs_stops(spark, {"A": a, "B": b}).orderBy("agency").collect()
    assert [(r.agency, r.stop_id, r.stop_name) for r in got] == [("A", "1", "Main"), ("B", "9", "Bay")]


def test_osm_elements(spark, folder):
    els = [
        {"id": 1, "type": "node", "lat": 33.0, "lon": -97.0, "tags": {"shop": "books", "name": "X"}},
        {"id": 2, "type": "way", "center": {"lat": 34.0, "lon": -98.0}, "tags": {"power": "substation", "voltage": "115000"}},
        {"id": 3, "type": "way", "tags": {"highway": "primary"}, "geometry": [{"lat": 1.0, "lon": 2.0}, {"lat": 1.5, "lon": 2.5}]},
        {"id": 4, "type": "way", "tags": {"highway": "primary"}, "geometry": [{"lat": 1.0, "lon": 2.0}]},
    ]
    df = readers.read_osm(spark, put(folder, "osm.json", json.dumps({"elements": els})))
    assert [(r.osm_id, r.category) for r in readers.osm_points(df).collect()] == [(1, "shop:books")]
    sub = readers.osm_substations(df, "TX").first()
    assert (sub.osm_id, sub.lat, sub.voltage) == (2, 34.0, "115000")
    assert [r.osm_id for r in readers.osm_lines(df).collect()] == [3]


def test_agency_tables(spark):
    gens = spark.createDataFrame([(1, "5.5"), (1, "x"), (2, "3")], "plant_code int, capacity_mw string")
    plants = spark.createDataFrame([(1, "33", "-97"), (1, "33", "-97"), (2, None, None)], "plant_code int, latitude string, longitude string")
    assert {(r.plant_code, r.capacity_mw) for r in readers.generators_with_plants(gens, plants).collect()} == {(1, 5.5), (1, None)}
    assert readers.generators_with_plants(gens, plants).count() == 2
    comp = spark.createDataFrame([("m", "k2", 40), ("m", "k1", 40), ("m", "k3", 20)], "mukey string, cokey string, comppct_r int")
    assert readers.dominant_component(comp).first().cokey == "k1"
    acs = spark.createDataFrame([("48", "113", "000100", "10", "-666666666", "5")], "state string, county string, tract string, pop string, inc string, a1 string")
    r = readers.acs_tracts(acs, ["a1", "a1"], ["pop", "inc"]).first()
    assert (r.geoid, r.pop, r.inc, r.age_18_34) == ("48113000100", 10.0, None, 10.0)
    tri = spark.createDataFrame([("F1", "A", None, "373823", None, "1220000"), ("F1", "A", None, "373823", None, "1220000")],
                                "facility_id string, name string, pref_latitude string, fac_latitude string, pref_longitude string, fac_longitude string")
    echo = spark.createDataFrame([("E1", "B", 37.5, -122.0), ("E2", "C", 10.0, 10.0)], "facility_id string, name string, lat double, lng double")
    f = {x.facility_id: x for x in readers.facilities(tri, echo, (-123, 37, -121, 38.5)).collect()}
    assert set(f) == {"F1", "E1"} and abs(f["F1"].lat - (37 + 38 / 60 + 23 / 3600)) < 1e-9 and f["F1"].lng == -122.0
    q = spark.createDataFrame([("q1", None, "active", "Solar", "10", "E", "Kern", "CA", "6029.0"), ("q2", "P", "withdrawn", "Solar", "5", "E", "Kern", "CA", "6029")],
                              "q_id string, project_name string, q_status string, type_clean string, mw1 string, entity string, county string, state string, fips_codes string")
    act = readers.active_solar_queue(q)
    cent = spark.createDataFrame([("06029", "Kern", "CA", 35.3, -118.7)], "fips string, county string, state string, lat double, lng double")
    located, lost = readers.locate_queue(act, cent)
    assert located.count() == 1 and lost.count() == 0 and located.first().project_name == "q1"


def test_tiles_and_labels(spark):
    df = spark.createDataFrame([("x/inundation_history_32.0_-98.5_33.5_-97.0.geojson", "High risk")], "path string, layer string")
    r = readers.inundation_tiles(df).first()
    assert (r.x0, r.y0, r.x1, r.y1, r.risk_level) == (-98.5, 32.0, -97.0, 33.5, "high")


def test_uploads(spark, folder):
    path = put(folder, "p.csv", "Prop_ID,Street,Lat,Lon\n1,,33.0,-97.0\n2,5 Elm,,\n,,,\n3,,,\n")
    rows, bad = readers.read_portfolio(spark, path)
    assert sorted(r.property_id for r in rows.collect()) == ["1", "2"] and [r.property_id for r in bad.collect()] == ["3"]
    loc = put(folder, "l.csv", "35.35,-119.05,Kern\n12 Oak St\n-1.5, 2\n")
    got = {(r.lat, r.lng, r.name, r.address) for r in readers.read_locations(spark, loc).collect()}
    assert got == {(35.35, -119.05, "Kern", None), (None, None, None, "12 Oak St"), (-1.5, 2.0, None, None)}


def test_scalar_text(spark):
    df = spark.createDataFrame([("500000;230000",), ("230 kV",), ("none",), (None,)], "v string")
    assert [r[0] for r in df.select(S.voltage_kv("v")).collect()] == [500.0, 230.0, None, None]
    lat, lng = S.coordinate_pair("v")
    c = spark.createDataFrame([("35.35, -119.05",), ("95, 10",), ("x",)], "v string").select(lat.alias("a"), lng.alias("b")).collect()
    assert [(r.a, r.b) for r in c] == [(35.35, -119.05), (None, None), (None, None)]


def test_layer_write_registry_and_features(spark, folder):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, 9), (2, 5.0, 5.0, 6.0, 6.0, 9)], "ID int, X0 double, Y0 double, X1 double, Y1 double, Shape_Area int")
    low = sinks.lower_case(df)
    sinks.write_layer(low, folder + "/layer")
    back = spark.read.parquet(folder + "/layer")
    assert back.count() == 2 and "shape_area" not in back.columns
    entry = sinks.registry_row(back, "demo", "local")
    again = sinks.upsert_registry(entry, sinks.registry_row(back, "demo", "moved"))
    assert again.count() == 1 and again.first().row_count == 2
    pts = spark.createDataFrame([(7, -97.0, 33.0)], "k int, lng double, lat double")
    doc = json.loads(sinks.point_features(pts, ["k"]).first().value)
    assert doc["geometry"] == {"type": "Point", "coordinates": [-97.0, 33.0]} and doc["properties"] == {"k": 7}
    sinks.write_features(sinks.point_features(pts, ["k"]), folder + "/out")
    assert readers.read_geojson(spark, folder + "/out", "k int", False).first().k == 7
    sinks.write_report(pts, folder + "/rep")
    assert spark.read.csv(folder + "/rep", header=True).count() == 1


def test_append_audit_is_idempotent(spark, folder):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "execution_id string, v int")
    sinks.append_audit(df, None, folder + "/a")
    more = spark.createDataFrame([("b", 9), ("c", 3), ("c", 3)], "execution_id string, v int")
    sinks.append_audit(more, spark.read.parquet(folder + "/a"), folder + "/a")
    assert {(r.execution_id, r.v) for r in spark.read.parquet(folder + "/a").collect()} == {("a", 1), ("b", 2), ("c", 3)}


def test_stream_keeps_one_per_execution_over_two_runs(spark, folder):
    schema = "execution_id long, ts timestamp"
    rows = spark.range(40).select((F.col("id") % 10).alias("execution_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"))
    rows.coalesce(1).write.parquet(folder + "/in")
    for _ in range(2):
        events = audit_stream.read_events(spark, folder + "/in", schema)
        q = audit_stream.append_audit(events, folder + "/out", folder + "/state")
        q.awaitTermination()
        rows.coalesce(1).write.mode("append").parquet(folder + "/in")
    assert spark.read.parquet(folder + "/out").count() == 10


def test_stream_keeps_rows_that_come_late(spark, folder):
    schema = "execution_id long, ts timestamp"
    for k, day in ((1, 20_000), (2, 10), (3, 19_000)):  # the second file is fifty years older
        spark.range(1).select(F.lit(k).cast("long").alias("execution_id"), F.timestamp_seconds(F.lit(day * 86_400)).alias("ts")).write.mode("append").parquet(folder + "/in")
        events = audit_stream.read_events(spark, folder + "/in", schema)
        audit_stream.append_audit(events, folder + "/out", folder + "/state").awaitTermination()
    assert sorted(r.execution_id for r in spark.read.parquet(folder + "/out").collect()) == [1, 2, 3]


def test_rings_are_turned_at_read(spark, folder):
    shell, hole = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]
    cases = {"Polygon": [shell, hole], "MultiPolygon": [[shell, hole[::-1]], [[[x + 20, y] for x, y in shell[::-1]]]]}
    features = [{"id": k, "properties": {"name": k}, "geometry": {"type": k, "coordinates": v}} for k, v in cases.items()]
    os.makedirs(folder, exist_ok=True)
    with open(folder + "/f.geojson", "w") as f:
        json.dump({"type": "FeatureCollection", "features": features}, f)
    got = readers.read_geojson(spark, folder + "/f.geojson", "name string").select("name", geo.polygon_area_deg2("rings").alias("a")).collect()
    assert {r.name: r.a for r in got} == {"Polygon": 96.0, "MultiPolygon": 196.0}


def test_first_row_of_a_repeated_key_is_ordered(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "execution_id string, v int")
    got = relational.append_new(df.limit(0), df.repartition(3), "execution_id").collect()
    assert {(r.execution_id, r.v) for r in got} == {("a", 1), ("b", 2)}
