"""Expected values, rule by rule."""

import json
import math
import random
import statistics
from datetime import datetime, timedelta

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions import catalogue, geo, text, vectors
from larkspur.operators import cohort, coverage, gates, history, location, quality, resolve, search, upserts, verdict
from larkspur.scratch import written
from larkspur.sources import files, records


def column(spark, expr, *values, names=("a", "b", "c")):
    kinds = ", ".join(f"{n} {'double' if all(isinstance(v[i], float) or v[i] is None for v in values) else 'string'}" for i, n in zip(range(len(values[0])), names, strict=False))
    return [r[0] for r in spark.createDataFrame(list(values), kinds).select(expr).collect()]


@given(st.lists(st.tuples(st.text("abcdeé ", min_size=1, max_size=9), st.text("abcdeé ", min_size=1, max_size=9)), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_jaro_winkler(pairs):
    for a, b in pairs:
        want = duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
        if a.isascii() and b.isascii():
            assert text._jaro_winkler(a, b) == pytest.approx(want, abs=1e-9)


def test_text(spark):
    assert column(spark, text.fold(F.col("a")), ("  São João ",), ("ÀÉÎÕÜç",), (None,)) == ["sao joao", "aeiouc", None]
    assert column(spark, text.listing_type(F.col("a")), ("Aluguel",), ("à la",), ("AMBOS",), (None,)) == ["rent", None, "both", None]
    assert column(spark, text.price_type(F.col("a")), ("ambos",), ("Venda",)) == [None, "sale"]
    assert column(spark, text.property_type(F.col("a")), ("Casa em Condomínio",), ("APTO",), ("villa",)) == ["condo_house", "apartment", None]
    assert column(spark, text.brazilian_number(F.col("a")), ("R$ 1.234,56",), ("x",), ("0",), (None,)) == [1234.56, None, None, None]
    assert column(spark, text.clock_seconds(F.col("a")), ("25:01:02",), ("1:00",), ("",)) == [90062, None, None]
    assert text.expand_query("casa com quintal") == "casa com quintal backyard" == text.expand_query(text.expand_query("casa com quintal"))
    kind = text.listing_type_from(F.col("a"), F.col("b").cast("double"), F.col("c"))
    assert column(spark, kind, ("Alugo casa", None, None), ("Casa em Venda Nova", None, None), ("à venda", "1000.0", None), ("vendo", None, None), ("x", "50000.0", "rent")) == ["rent", "sale", "rent", "sale", "rent"]
    s = spark.createDataFrame([("Casa linda", "Casa linda"), ("", "x"), (None, "x"), ("b a", "a b")], "a string, b string")
    assert [r[0] for r in s.select(text.similarity(F.col("a"), F.col("b"), "token_sort")).collect()] == [1.0, 0.0, 0.0, 1.0]
    assert [r[0] for r in s.select(text.similarity(F.col("a"), F.col("b"), "none")).collect()] == [0.0] * 4


def test_geo(spark):
    sq = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    areas = spark.createDataFrame([("b", "b", sq), ("a", "a", [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)])], "id string, name string, ring array<struct<lon:double,lat:double>>")
    pts = spark.createDataFrame([("in", 0.5, 0.5, None), ("both", 1.5, 1.5, None), ("edge", 2.0, 0.5, None), ("out", 5.0, 5.0, "old"), ("none", None, 1.0, "old")], "id string, lon double, lat double, old_area string")
    assert {r.id: r.area_id for r in quality.assign_areas(pts, areas).collect()} == {"in": "b", "both": "a", "edge": "b", "out": None, "none": "old"}
    c = areas.select("id", geo.centroid(F.col("ring")).alias("c")).where("id = 'b'").first().c
    assert (c.lon, c.lat) == pytest.approx((1, 1))
    d = spark.range(1).select(geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))).first()[0]
    assert d == pytest.approx(6_371_000 * math.pi / 180)


@given(st.lists(st.tuples(st.floats(-0.01, 0.01), st.floats(-0.01, 0.01)), min_size=1, max_size=15))
@settings(max_examples=10, deadline=None)
def test_radius_join_misses_nothing(spark, places):
    rows = [(i, x, y) for i, (x, y) in enumerate(places)]
    a = spark.createDataFrame(rows, "id long, lon double, lat double")
    b = a.select(F.col("id").alias("r_id"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    want = a.crossJoin(b).where(geo.haversine_m(F.col("lon"), F.col("lat"), F.col("r_lon"), F.col("r_lat")) <= 400).count()
    assert geo.within_radius(a, b, 400).count() == want


def listings(spark, rows):
    return spark.createDataFrame([(*r, True) for r in rows], "property_id string, listing_type string, price double, active boolean")


def test_cohorts(spark):
    props = spark.createDataFrame([(f"p{i}", None, a, True, "x", False, False) for i, a in enumerate([100.0, 100.0, 50.0])] + [("old", 4800.0, 100.0, True, "x", False, True), ("flat", None, 0.0, True, "x", True, False)], "id string, price double, area_m2 double, active boolean, cohort string, for_rent boolean, for_sale boolean")
    rows = listings(spark, [("p0", "rent", 4700.0), ("p0", "rent", 9000.0), ("p0", "sale", 400000.0), ("p1", "rent", 5000.0), ("flat", "rent", 1.0)])
    got = {(r.property_id, r.listing_type): r for r in cohort.scored(cohort.statistics(cohort.typed_prices(props, rows))).collect()}
    assert got["p0", "rent"].ppm == 47 and got["p0", "rent"].mean == 48.5 and got["p0", "sale"].mean == 2024  # with the one of its own price
    assert got["old", "sale"].ppm == 48 and ("flat", "rent") not in got
    assert got["p0", "rent"].stat_score > 0.5 > got["p1", "rent"].stat_score
    same = listings(spark, [("p0", "rent", 10.0), ("p1", "rent", 10.0)])
    assert {r.stat_score for r in cohort.scored(cohort.statistics(cohort.typed_prices(props.where("id IN ('p0', 'p1')"), same))).collect()} == {0.5}
    pivot = {r.property_id: r for r in cohort.pivoted(cohort.statistics(cohort.typed_prices(props, rows))).collect()}
    assert pivot["p0"].primary_type == "rent" and pivot["old"].primary_type == "sale"
    with pytest.raises(ValueError):
        cohort.Weights(0.5, 0.5, 0.5)
    assert [b for (b,) in spark.createDataFrame([(z,) for z in (-1.0, -0.2, 0.2, 1.0)], "z double").select(cohort.band(F.col("z"))).collect()] == ["slightly_undervalued", "average", "slightly_overvalued", "highly_overvalued"]


def test_search_rules(spark):
    base = spark.createDataFrame([("a", True, 1.0, None), ("b", True, 2.0, ["pets"]), ("c", False, 3.0, []), ("d", True, None, [])], "id string, active boolean, combined double, amenities array<string>").withColumns({"price": F.lit(5.0), "first_seen": F.lit("2024-01-01").cast("timestamp"), "public_id": F.lit(1)})
    rows = listings(spark, [("a", "rent", 1.0), ("a", "sale", 9e5)]).withColumn("accepts_pets", F.lit(False))
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(search.matches(base, rows, search.Search(max_price=10))) == ["a"]
    assert ids(search.matches(base, rows, search.Search(max_price=10, price_type="sale"))) == []
    assert ids(search.matches(base, rows, search.Search(pets=True))) == ["b"]
    assert ids(search.matches(base, rows, search.Search(pets=False))) == ["d"]  # unknown amenities are in neither
    assert ids(search.search(base, rows, search.Search())) == ["b", "a", "d"]
    assert ids(search.by_refs(base, ["c", "a", "c"])) == ["c", "a"]
    for bad in ([], ["1", "a"], list("abcde")):
        with pytest.raises(ValueError):
            search.by_refs(base, bad)
    assert ids(search.top_deals(base.withColumn("combined", F.coalesce("combined", F.lit(9.0))), F.lit("2024-01-02").cast("timestamp"), least=2.5)) == ["d", "c"]
    assert search.top_deals(base, F.lit("2024-01-02").cast("timestamp"), limit=0).count() == 0
    own = spark.createDataFrame([("p", "sale", 5.0, "z", True), ("p", "rent", 5.0, "z", True), ("p", "rent", 5.0, "b", True), ("p", "rent", 1.0, "a", False), ("p", "x", None, "a", True)], "property_id string, listing_type string, price double, platform string, active boolean")
    assert search.primary_listing(own).first().primary.asDict() == {"listing_type": "rent", "price": 5.0, "platform": "b"}
    label = search.neighborhood_label(F.col("a"), F.col("b"), F.col("c"))
    assert column(spark, label, (None, "savassi-norte", "x"), ("Centro", None, "centro"), ("S", "t", None)) == ["Savassi Norte", None, "S"]


def test_history(spark):
    t0 = datetime(2024, 1, 1)
    empty = spark.createDataFrame([], "property_id string, listing_type string, platform string, property_listing_id string, price double, start_ts timestamp, end_ts timestamp")
    table = empty
    for day, rows in enumerate([[("p", "rent", "x", None, 10.0)], [("p", "rent", "x", None, 10.0)], [("p", "rent", "x", None, 9.0), ("p", "sale", "x", None, 5.0)]]):
        now = spark.createDataFrame(rows, "property_id string, listing_type string, platform string, property_listing_id string, price double")
        table = history.apply_prices(table, now, F.lit(t0 + timedelta(days=day)).cast("timestamp"))
    got = sorted((r.listing_type, r.price, r.start_ts.day, r.end_ts and r.end_ts.day) for r in table.collect())
    assert got == [("rent", 9.0, 3, None), ("rent", 10.0, 1, 3), ("sale", 5.0, 3, None)]
    changes = spark.createDataFrame([("p", 100.0, 94.0)], "property_id string, old_price double, price double")
    watch = lambda pct, last: spark.createDataFrame([("p", pct, last)], "property_id string, min_drop_pct double, last_notified_price double")
    assert [history.drops(changes, watch(*x)).count() for x in ((None, None), (10.0, None), (5.0, 94.0), (5.0, 96.0), (5.0, 0.0))] == [1, 0, 0, 0, 1]
    rows = listings(spark, [("p", "rent", 3.0), ("p", "sale", 2.0)])
    assert history.evaluate_watches(watch(5.0, None), rows).count() == 0 and history.evaluate_watches(watch(5.0, 4.0), rows).count() == 1
    alerts = spark.createDataFrame([("p", t0 + timedelta(minutes=m)) for m in (0, 30, 59, 60, 100, 121)], "property_id string, ts timestamp")
    assert sorted(r.ts for r in history.debounced(alerts).collect()) == [t0 + timedelta(minutes=m) for m in (0, 60, 121)]
    attempts = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 1, False), ("b", 2, False)], "id string, ts int, ok boolean")
    assert [r.id for r in history.quarantined(attempts, 2).collect()] == ["b"]


def test_gates(spark):
    city, state = gates.city_state(F.col("a"), F.col("b"), F.col("c"))
    rows = [("BH", None, "x"), (None, None, "Rua A, 5, Belo Horizonte - MG"), (None, None, "Rua, Contagem, mg"), (None, None, "Rua A, Betim"), (None, None, "Rua A, SP"), (None, None, None)]
    assert column(spark, F.struct(city, state), *rows) == [("BH", None), ("Belo Horizonte", "MG"), ("Contagem", "MG"), ("Betim", None), (None, "SP"), (None, None)]
    why = gates.outside(F.col("a"), F.col("b"), ["Belo Horizonte"], ["MG"])
    assert column(spark, why, ("bh", None), (None, "MG"), ("Betim", "MG"), ("BH", "SP"), names=("a", "b")) == [None, "city_missing", "city_not_allowed:Betim", "state_not_allowed:SP"]
    folded = gates.outside(F.col("a"), F.col("b"), ["São Paulo", "", " "], ["sp"])
    assert column(spark, folded, ("São Paulo", "SP"), ("sao paulo", None), ("SÃO PAULO", "MG"), names=("a", "b")) == [None, None, "state_not_allowed:MG"]
    assert (gates.photos_needed(), gates.photos_needed(8, 20, 0.5), gates.photos_needed(3, 0, 1)) == (8, 10, 3)
    urls = spark.createDataFrame([(["a", " ", "b"],), (None,)], "u array<string>")
    assert [r[0] for r in urls.select(gates.too_few_photos(F.col("u"), 2)).collect()] == [None, "too_few_photos:0<2"]
    assert column(spark, gates.invalid(F.col("a"), F.col("b").cast("double")), ("x", "1"), ("", "1"), ("x", "0"), ("x", None), names=("a", "b")) == [None, "platform_id_missing", "price_not_positive", "price_not_positive"]


def test_transit_scores_of_all_points(spark):
    from larkspur.plans import registry

    sf = "/root/testdata/sf0.001"
    points = registry.points(spark, sf)
    mode = F.when(F.col("id") % 2 == 0, "metro").otherwise("bus")
    got = {r.id: r for r in quality.transit_scores(points, points.where("id % 7 = 0").withColumn("mode", mode)).collect()}  # the query rounds
    assert {r.id: r.transit_score for r in registry.queries()["transit_scores"](spark, sf).collect()} == {i: pytest.approx(r.transit_score, abs=5.1e-7) for i, r in got.items()}
    p = [(r.id, r.lon, r.lat) for r in registry.points(spark, sf).collect()]
    assert sorted(got) == sorted(i for i, *_ in p)
    stops = [(x, y, 1.0 if i % 2 == 0 else 0.55) for i, x, y in p if i % 7 == 0]
    for i, x, y in p[::5]:
        far = lambda a, b: 2 * 6_371_000 * math.asin(math.sqrt(math.sin(math.radians(b - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(b)) * math.sin(math.radians(a - x) / 2) ** 2))  # noqa: B023, E731
        near = [(far(a, b), w) for a, b, w in stops if far(a, b) <= 1200]
        best = max(((1 - m / 1200) * w for m, w in near), default=0.0)
        want = min(1.0, 0.7 * best + 0.3 * min(1.0, sum(w for m, w in near if m <= 400) / 8))
        assert (got[i].n_stops, got[i].transit_score) == (len(near), pytest.approx(want, abs=1e-9))


def test_quality(spark):
    c = spark.createDataFrame([("n", 0.0, 0.0), ("far", 1.0, 1.0)], "id string, lon double, lat double")
    stops = spark.createDataFrame([("metro", 0.004, 0.0), ("bus", 0.002, 0.0), ("bus", 0.5, 0.0)], "mode string, lon double, lat double")
    got = {r.id: r for r in quality.transit_scores(c, stops).collect()}
    d = 6_371_000 * math.radians(0.004)
    assert got["n"].nearest_m == pytest.approx(d) and got["n"].n_stops == 2 and got["far"].transit_score == 0
    assert got["n"].transit_score == pytest.approx(0.7 * (1 - d / 1200) + 0.3 * 0.55 / 8)
    st_ = spark.createDataFrame([("s1", "t", x) for x in (0, 600, 1200, 1800)] + [("s2", "u", 0)], "stop_id string, trip_id string, departure_s int")
    fr = spark.createDataFrame([("u", 900)], "trip_id string, headway_secs int")
    assert {r.stop_id: (r.headway_s, r.method) for r in quality.headways(st_, fr).collect()} == {"s1": (600.0, "stop_times"), "s2": (900.0, "frequencies")}
    tags = spark.createDataFrame([({"Shop": "Supermarket"},), ({"amenity": "clinic"},), ({"landuse": "recreation_ground"},), ({"category": "school"},), ({"shop": "bakery"},), (None,)], "t map<string,string>")
    assert [r[0] for r in tags.select(quality.category(F.col("t"))).collect()] == ["shop", "healthcare", "park", "school", None, None]
    hits = spark.createDataFrame([("n", "flood", "low"), ("n", "flood", "0.9"), ("n", "industrial", None)], "id string, risk_type string, severity string")
    r = quality.risk_flags(hits).first()
    assert r.risk_flags == ["flood", "industrial"] and r.severities == {"flood": "high", "industrial": None}
    rates = spark.createDataFrame([("Á", "X", "mg", 10.0, 0), ("b", "X", "mg", 30.0, 1), ("unknown", "X", "mg", 50.0, 2)], "name string, city string, state string, rate_per_100k double, row_nth int")
    n = spark.createDataFrame([("1", "a", "x", "MG"), ("2", "B", "x", "MG")], "id string, name string, city string, state string")
    assert {r.id: r.safety_score for r in quality.safety_scores(n, rates).collect()} == {"1": 1.0, "2": 0.5}
    merged = spark.range(1).select(quality.merge_flags(F.array(F.lit("noise"), F.lit("flood")), F.array(F.lit("industrial")), ["flood", "industrial"])).first()[0]
    assert merged == ["noise", "industrial"]
    times = spark.createDataFrame([("s", "t1"), ("s", "t2"), ("q", "t3")], "stop_id string, trip_id string")
    trips = spark.createDataFrame([("t1", "r1"), ("t2", "r2"), ("t3", "gone")], "trip_id string, route_id string")
    routes = spark.createDataFrame([("r1", 3), ("r2", 1)], "route_id string, route_type int")
    assert {r.stop_id: r.mode for r in quality.stop_modes(times, trips, routes).collect()} == {"s": "metro", "q": "bus"}
    hubs = spark.createDataFrame([("X", "near", 0.01, 0.0), ("x", "far", 0.2, 0.0), ("y", "other", 0.0, 0.0)], "city string, name string, lon double, lat double")
    a = quality.access_scores(c.withColumn("city", F.lit("x")).where("id = 'n'"), hubs).first()
    assert a.hub == "near" and a.access_score == pytest.approx(1 - a.minutes / 45)
    claims = spark.createDataFrame([("n", ["Noisy ", "noisy", "dark"]), ("n", ["Dark"])], "id string, f array<string>")
    assert [(r.flag, r.n, r.rank) for r in quality.top_flags(claims, "f", 2).orderBy("rank").collect()] == [("dark", 2, 1), ("noisy", 2, 2)]


def test_resolve(spark):
    schema = "id string, platform string, platform_id string, title string, area_m2 double, bedrooms int, bathrooms int, parking int, lon double, lat double, active boolean"
    known = spark.createDataFrame([("k1", "a", "1", "apartamento centro bonito", 70.0, 2, 1, None, 0.1, 0.1, True), ("k2", "a", "2", "apartamento centro bonito", 70.0, 3, 1, 1, 0.1, 0.1, True)], schema)
    new = spark.createDataFrame([("c1", "a", "2", "x", 1.0, 1, 1, 1, None, None, True), ("c2", "b", "9", "apartamento centro bonita", 72.0, 2, None, 1, 0.1001, 0.1001, True), ("c3", "b", "3", "casa jardim", 90.0, 4, 1, 1, 0.1, 0.1, True), ("c4", "d", "4", "casa jardins", 92.0, 4, 1, 1, 0.1, 0.1, True), ("c5", "d", "5", "galpão", None, 4, 1, 1, None, None, True)], schema)
    got = {r.id: (r.property_id, r.how) for r in resolve.match(new, known).collect()}
    assert got == {"c1": ("k2", "exact"), "c2": ("k1", "fuzzy"), "c3": ("c3", "new"), "c4": ("c3", "new"), "c5": ("c5", "new")}
    u = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 4)], "k string, n int")
    assert sorted((r.k or "", r.n) for r in resolve.unique_by(u, "k", "n").collect()) == [("", 3), ("", 4), ("a", 1)]


def test_coverage(spark):
    rows = spark.createDataFrame([("1", '{"visual": {"a": 1}}'), ("1", '{"visual": 2}'), ("2", '{"visual": null}'), ("3", "5"), ("4", None), ("5", "{bad")], "id string, meta string")
    assert tuple(coverage.signal_counts(rows, "meta", ["visual"]).first()) == (5, 1)
    t0 = datetime(2024, 1, 2)
    snaps = spark.createDataFrame([(t0 - timedelta(hours=h), e) for h, e in ((40.0, 10), (20.0, 1000), (2.0, 4000), (1.0, 4100), (0.5, None))], "ts timestamp, enriched_properties int")
    at = F.lit(t0).cast("timestamp")
    assert coverage.throughput_per_day(snaps, at).first()[0] == pytest.approx(3100 / (19 / 24))
    assert coverage.throughput_per_day(snaps, at, F.lit(t0 - timedelta(hours=3)).cast("timestamp")).first()[0] == pytest.approx(2400)
    assert coverage.throughput_per_day(snaps.limit(1), at).first()[0] is None


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (4, "d")], "k int, v string")
    changes = upserts.diff(old, new, ["k"], F.col("v") == F.col("n_v"))
    assert {r.k: r.action for r in changes.collect()} == {1: "kept", 2: "updated", 3: "unchanged", 4: "inserted"}
    assert sorted(map(tuple, upserts.applied(changes, ["k"], ["v"]).collect())) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    only = upserts.applied(upserts.diff(old, new, ["k"], F.col("v") == F.col("n_v"), insert=False), ["k"], ["v"])
    assert sorted(map(tuple, only.collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(map(tuple, upserts.last_wins([old, new], ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    ls = spark.createDataFrame([("p", "1", "rent", 5.0, 9.0, 1), ("p", "1", "sale", 7.0, 8.0, 2), ("p", "2", "rent", 5.0, 6.0, 3)], "platform string, platform_listing_id string, listing_type string, price double, base_price double, n int")
    got = sorted((r.platform_listing_id, r.listing_type, r.price) for r in upserts.rekeyed(ls, F.lit("sale"), "n").collect())
    assert got == [("1", "sale", 7.0), ("2", "sale", 6.0)]


def test_sources(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("stop_name,stop_id,stop_lat,stop_lon\nA,s,1.5,2.5\n")
    (tmp_path / "routes.txt").write_text("route_id,route_type\nr,1\n")
    (tmp_path / "trips.txt").write_text("route_id,service_id,trip_id\nr,x,t\n")
    (tmp_path / "stop_times.txt").write_text("trip_id,departure_time,stop_id\nt,25:00:00,s\n")
    (tmp_path / "frequencies.txt").write_text("trip_id,start_time,end_time,headway_secs\nt,0,1,600\n")
    g = files.gtfs(spark, str(tmp_path))
    assert g["stops"].first().lon == 2.5 and g["stop_times"].first().departure_s == 90000
    (tmp_path / "trips.txt").write_text("route_id\nr\n")
    with pytest.raises(ValueError):
        files.gtfs(spark, str(tmp_path))
    (tmp_path / "x.geojson").write_text('{"type":"FeatureCollection","features":[{"properties":{"name":"P"},"geometry":{"type":"Point","coordinates":[1,2]}},{"properties":{"name":"Q"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"properties":{"name":"M"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[7,5],[7,7],[5,5]]],[]]}}]}')
    f = files.features(spark, str(tmp_path / "x.geojson")).collect()
    assert [r.properties["name"] for r in f] == ["P", "Q", "M"] and f[0].lon == 1 and f[1].ring[1].lon == 1 and f[2].ring[0].lon == 5
    (tmp_path / "r.yaml").write_text("provider: x\ndefaults: {city: C, state: MG}\nrates:\n- {name: A, rate_per_100k: 3}\n- {name: B, rate_per_100k: 4, city: D}\n")
    assert [(r.name, r.city) for r in files.rates(spark, str(tmp_path / "r.yaml")).orderBy("row_nth").collect()] == [("A", "C"), ("B", "D")]
    page = '<html><script type="application/ld+json">{"description": "Bela &amp; <b>ampla</b> , casa"}</script></html>'
    assert column(spark, files.description(F.col("a")), (page,), ("<p>x</p>",)) == ["Bela & ampla, casa", None]
    pages = spark.createDataFrame([(404, "", "u", "u"), (200, page, "u", "u"), (200, "Anúncio não encontrado", "u", "u"), (503, page, "u", "u"), (200, page, "u", "v"), (None, None, "u", None)], "s int, h string, u string, f string")
    assert [r[0] for r in pages.select(files.availability(F.col("s"), F.col("h"), F.col("u"), F.col("f"))).collect()] == ["gone", "active", "gone", "unknown", "unknown", "unknown"]
    assert files.split_band(1, 4) == ((1, 2), (3, 4)) and files.split_band(3, 3) is None
    assert files.saturated(5, 5, 8, 8) and not files.saturated(4, 5, 30, 30) and files.saturated(5, 5, 21, 30)


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("a", None, True, ["x", "y"])], "id string, n int, b boolean, l array<string>")
    search.export_csv(df, str(tmp_path / "c"))
    line = next((tmp_path / "c").glob("*.csv")).read_text().splitlines()
    assert line[0] == "id,n,b,l" and line[1] == 'a,,true,"[""x"",""y""]"'
    assert search.export_json(df, str(tmp_path / "j")) == {"total": 1, "truncated": False}


@given(st.lists(st.tuples(st.one_of(st.floats(-180, 180), st.sampled_from([-180.0, 180.0, 179.999])), st.one_of(st.floats(-90, 90), st.sampled_from([90.0, 89.99, -90.0, 0.0]))), min_size=2, max_size=25), st.sampled_from([1000.0, 50_000.0, 3_000_000.0]))
@settings(max_examples=12, deadline=None)
def test_radius_join_at_poles_and_date_line(spark, places, radius):
    a = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)], "id int, lon double, lat double")
    b = a.select(F.col("id").alias("r_id"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    far = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("r_lon"), F.col("r_lat"))
    want = sorted(tuple(r) for r in a.crossJoin(b).where(far <= radius).select("id", "r_id").collect())
    assert sorted(tuple(r) for r in geo.within_radius(a, b, radius).select("id", "r_id").collect()) == want


def test_areas(spark):
    sq = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    a = spark.createDataFrame([("big", sq(0.0, 0.0, 1.0)), ("far", sq(5.0, 5.0, 0.1)), ("null", None)], "id string, ring array<struct<lon:double,lat:double>>")
    b = spark.createDataFrame([("in", sq(0.4, 0.4, 0.01)), ("touch", sq(1.0, 1.0, 0.2)), ("cross", sq(0.9, -0.05, 0.1)), ("out", sq(1.01, 0.0, 0.2)), ("around", sq(4.0, 4.0, 3.0))], "r_id string, r_ring array<struct<lon:double,lat:double>>")
    assert sorted(tuple(r) for r in geo.areas_meeting(a, b).select("id", "r_id").collect()) == [("big", "cross"), ("big", "in"), ("big", "touch"), ("far", "around")]
    horseshoe = [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (2.0, 3.0), (2.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0)]
    u = spark.createDataFrame([("u", horseshoe), ("flat", [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)])], a.schema).select("id", "ring", geo.point_on_surface(F.col("ring")).alias("p"))
    got = {r.id: (r.p, r.inside) for r in u.withColumn("inside", geo.covers(F.col("ring"), F.col("p.lon"), F.col("p.lat"))).collect()}
    assert got["u"][1] and got["u"][0].lon in (0.5, 2.5) and got["flat"][0] is None


def read(spark, shape, *raws):
    rows = spark.createDataFrame([(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(raws)], "k int, raw string").withColumn("Price", F.lit("clash"))
    return [r.asDict(True) for r in shape(rows).orderBy("k").collect()]


def test_records_with_totals(spark):
    full = {"id": 7, "type": "Apartamento", "neighbourhood": "Lourdes", "address": {"address": "Rua X", "city": "Belo Horizonte"}, "rentPrice": 1000, "totalCost": 1500.5, "photos": ["p.jpg", {"url": "http://z/q.jpg"}, {}], "location": {"lat": -19.9, "lng": -43.9}, "amenities": ["PODE_TER_ANIMAIS_DE_ESTIMACAO"], "bedrooms": 2}
    a, bundle, broken, null = read(spark, lambda d: records.from_totals(d, "https://a"), full, {"id": "8", "rentPrice": 900, "condoIptu": 300, "city_slug": "x-campinas"}, "nonsense", None)
    assert (a["title"], a["price"], a["type"], a["state"], a["image_urls"], a["address"], a["lon"]) == ("Apartamento in Lourdes", 1500.5, "apartment", "MG", ["https://a/img/p.jpg", "http://z/q.jpg"], "Rua X, Lourdes, Belo Horizonte", -43.9)
    (offer,) = a["listings"]
    assert (offer["base_price"], offer["condo_fee"], offer["fees_bundled"], offer["accepts_pets"], offer["url"]) == (1000, 500.5, True, True, "https://a/imovel/7")
    assert (bundle["price"], bundle["city"], bundle["listings"][0]["fees_bundled"]) == (1200, "Campinas", True)
    assert broken["reason"] == null["reason"] == "no_id" and broken["listings"] == []


def test_records_with_sides(spark):
    both = {"id": "9", "prices": {"rental": {"value": "2000", "condominium": 100, "iptu": 0}, "sale": {"value": 300000}}, "amenities": {"usableAreas": ["70"], "values": ["PETS_ALLOWED"]}, "address": {"city": "X", "state": "Minas Gerais"}, "medias": {"images": [{"dangerousSrc": "http://i/{width}/{height}"}, "ftp"]}}
    a, free = read(spark, lambda d: records.from_sides(d, "https://c"), both, {"id": 1, "prices": {"rental": {}, "sale": None}})
    assert (a["price"], a["area_m2"], a["state"], a["image_urls"], [x["price"] for x in a["listings"]]) == (2000, 70, "MG", ["http://i/614/297"], [2000, 300000])
    assert a["listings"][0]["iptu"] is None and a["listings"][1]["condo_fee"] == 100 and free["reason"] == "no_price"
    product = {"name": "N", "url": "https://c/x-id-123/", "offers": {"price": 900, "potentialAction": {"@type": "BuyAction"}, "additionalProperty": {"name": "Condominio", "value": 50}}, "image": "http://i", "floorSize": {"value": 40}, "address": {"addressLocality": "Campinas", "addressRegion": "SP"}}
    (p,) = read(spark, lambda d: records.from_sides(records.product_sides(d), "https://c"), product)
    assert (p["platform_id"], p["for_sale"], p["for_rent"], p["area_m2"], p["image_urls"], p["listings"][0]["condo_fee"]) == ("123", True, False, 40, ["http://i"], 50)


def test_records_with_labels(spark):
    one = {"listId": 5, "subject": "Alugo apto", "price": "R$ 1.200", "properties": [{"label": "Quartos", "value": "2 quartos"}, {"name": "condominio", "value": "R$ 300"}, {"label": "Área", "value": "70m²"}, {"name": "furnished", "value": "Sim"}], "location": {"neighbourhood": "N", "municipality": "BH", "uf": "MG", "lat": 0.0}, "images": [{"original": "u1"}, "u2"]}
    a, b, c = read(spark, lambda d: records.from_labels(d, "https://b"), one, {"id": 6, "pricingInfos": [{"period": "monthly", "value": 1000}, {"value": 250000}], "location": "Centro", "url": "https://b/x/casas/y"}, {"id": 7, "subject": "Casa"})
    assert (a["price"], a["bedrooms"], a["area_m2"], a["type"], a["address"], a["lat"], a["image_urls"]) == (1500, 2, 70, "apartment", "N, BH, MG", None, ["u1", "u2"])
    assert (a["listings"][0]["base_price"], a["listings"][0]["is_furnished"]) == (1200, True)
    assert (b["type"], b["address"], [x["price"] for x in b["listings"]], c["reason"]) == ("house", "Centro", [1000, 250000], "no_price")


def test_verdict_and_saved_filters(spark):
    none = [F.lit(None).cast(x) for x in ("string", "string", "double", "array<string>", "boolean", "array<string>", "array<string>")]
    red, empty = F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>")
    said = spark.range(1).select(verdict.verdict(F.lit("Highly Undervalued"), F.lit("unheard of"), F.lit(0.725), F.array(F.lit("flood")), F.lit(True), red, red), verdict.verdict(*none[:4], F.lit(True), empty, empty), verdict.verdict(*none, "pt-BR")).first()
    assert list(said) == ["Highly undervalued — average condition, neighbourhood quality 72%, 1 neighbourhood risk (flood), 2 listing claim concerns, 2 positive listing claims", "no listing claim alerts", "Dados insuficientes para um veredito"]
    raw = '{"sortBy":"price","neighbourhood":["a"," ","b"],"city":"x","listingType":"Aluguel","furnished":false,"pets":true,"minPrice":"","maxPrice":"12.5","propertyType":"villa","other":1}'
    got = column(spark, search.saved_filters(F.col("a")), (raw,), ("x",), (None,))
    assert [json.loads(x) for x in got] == [{"sort_by": "price", "listing_type": "rent", "property_type": "villa", "max_price": 12.5, "neighborhood": "a,b", "city": "x", "accepts_pets": True}, {}, {}]


def test_progress(spark):
    c = spark.createDataFrame([(0, 0, 3)], "total long, a long, b long")
    at = lambda active, rate: [tuple(r) for r in coverage.progress(c, ["a", "b"], F.lit("2026-01-31").cast("date"), F.lit(active), F.lit(5), F.lit(rate)).select("signal", "fraction", "remaining", "eta_days", F.col("done_on").cast("string")).collect()]
    assert at(True, 4.0) == [("a", None, 5, 1.25, "2026-02-02"), ("b", None, 5, 1.25, "2026-02-02")]
    assert at(False, 4.0) == at(True, 0.0) == [("a", None, 5, None, None), ("b", None, 5, None, None)]


def test_expanded_queries_fold_accents_and_take_null():
    assert text.expand_query(None) == text.expand_query("  ") == ""
    assert text.expand_query("  perto do metro ") == "perto do metro subway metrô"
    assert text.expand_query("METRÔ") == "METRÔ metro subway"


def test_an_alert_is_not_sent_twice(spark):
    watch = spark.createDataFrame([(1, None, None), (2, None, 70.0)], "property_id long, min_drop_pct double, last_notified_price double")
    changes = spark.createDataFrame([(1, 100.0, 90.0, 1), (1, 90.0, 80.0, 2)], "property_id long, old_price double, price double, ts long")
    told = history.notified(watch, history.drops(changes, watch))
    assert sorted((r.property_id, r.last_notified_price) for r in told.collect()) == [(1, 80.0), (2, 70.0)]
    assert history.drops(changes.where("ts = 2"), told).count() == 0


PLACES = "title string, description string, city string, state string, neighborhood string, address string"


def located(spark, *rows):
    out = location.reconciled(spark.createDataFrame(list(rows), PLACES), ["Belo Horizonte", "Contagem"], ["MG"], ["Itapoã", "Savassi"])
    return [r.located for r in out.collect()]


def test_places_are_read_from_the_text(spark):
    kept, nothing, moved, abroad, seller = located(
        spark,
        ("Casa na Savassi", None, "BH", "MG", "Savassi", "Rua 1"),
        (None, None, None, None, None, None),
        ("Cobertura", "fica no bairro ITAPOA", "Belo Horizonte", "MG", "Savassi", "Rua 1"),
        ("Vendo casa em Cabo Frio", "", "Belo Horizonte", "MG", "Savassi", "Rua 1"),
        ("Cobertura no Itapoã", "", "Contagem", "Minas Gerais", "Belo Horizonte", None),
    )
    assert (kept.action, kept.reason, kept.clear_coords, kept.address) == ("unchanged", "ok", False, "Rua 1")
    assert (nothing.action, nothing.reason, nothing.city) == ("unchanged", "ok", None)
    assert (moved.action, moved.neighborhood, moved.address, moved.confidence) == ("corrected", "Itapoã", "Itapoã, Belo Horizonte, MG", 0.55)
    assert (abroad.action, abroad.city, abroad.reason, abroad.clear_coords) == ("out_of_geo", "Cabo Frio", "city_not_allowed:Cabo Frio", True)
    assert (seller.action, seller.reason, seller.city) == ("out_of_geo", "state_not_allowed:Minas Gerais", "Belo Horizonte")


def test_places_of_empty_tables_and_catalogues(spark):
    none = spark.createDataFrame([], PLACES)
    assert location.reconciled(none, [], [], []).count() == 0
    row = spark.createDataFrame([("Casa", None, "X", None, None, None)], PLACES)
    assert location.reconciled(row, [], [], []).first().located.reason == "neighborhood_missing"


def test_names_give_neighbourhoods(spark):
    p = spark.createDataFrame([(1, "itapoa", None, None), (2, "Itapoã", "BH", 7), (3, None, "BH", 7), (4, "Itapoã", "Vila Velha", None)], "id int, neighborhood string, city string, neighborhood_id long")
    areas = spark.createDataFrame([(5, "Itapoã", "Vila Velha"), (6, "ITAPOA ", None), (9, None, None)], "area_id long, name string, city string")
    out = location.assigned_by_name(p, areas)
    assert out.columns == p.columns
    assert sorted((r.id, r.neighborhood_id) for r in out.collect()) == [(1, 5), (2, 6), (3, 7), (4, 5)]


@given(st.lists(st.text("abc", min_size=1, max_size=5), max_size=12), st.text("abc", max_size=12))
@settings(max_examples=200, deadline=None)
def test_catalogue_index(names, token):
    """Against a look at every name."""
    ix = catalogue.Index([(n, n, n) for n in names])
    first = [i for i, n in enumerate(names) if n not in names[:i]]
    assert ix.within(token) == {i for i in first if names[i] in token}
    if token and names:
        assert ix.around(token) == next((i for i, n in enumerate(names) if token in n), None)
    want = next((i for i, n in enumerate(names) if n in token or token in n), None) if len(token) >= 3 else None
    assert ix.known(token) == want


def test_catalogue(spark):
    names = location.catalogue(spark.range(1), ["", "Itapoã", "São João", "ITAPOA", "Centro Sul", "BH"])
    rows = spark.createDataFrame([(0, "itapoa perto do centro sul"), (1, "sao joao itapoa"), (2, None), (3, "centro"), (4, "xx"), (5, "bh")], "k int, t string")
    got = rows.select("k", names.mentioned(F.col("t")).alias("m"), names.known(F.col("t")).alias("n"), names.listed(F.col("t")).alias("l"), names.known_each(F.split("t", " ")).alias("e")).orderBy("k").collect()
    assert [[x.name for x in r.m] for r in got] == [["Itapoã", "Centro Sul"], ["Itapoã", "São João"], [], [], [], []]
    assert [r.n for r in got] == ["Itapoã", "Itapoã", None, "Centro Sul", None, None]
    assert [r.l for r in got] == [False] * 6 and location.catalogue(rows, ["BH"]).names == [("BH", "bh", "belo horizonte")]
    assert got[2].e is None and [x.name for x in got[1].e] == ["São João", "São João", "Itapoã"]
    with pytest.raises(ValueError):
        location.catalogue(rows, ["x" * 5_000_000])
    none = location.catalogue(rows, [])
    assert {(r.n, r.l) for r in rows.select(none.known(F.col("t")).alias("n"), none.listed(F.col("t")).alias("l")).collect()} == {(None, False)}


def test_statistics_of_hot_cohorts(spark):
    """Ties of a third of all rows, nulls, groups of one; against plain Python."""
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), "rent", rng.choice([5.0, rng.randint(0, 20) / 2, None])) for i in range(400)] + [(1000, "one", "sale", 3.0), (1001, None, "rent", 1.0), (1002, None, "rent", 4.0), (1003, "null", "rent", None)]
    typed = spark.createDataFrame(rows, "property_id long, cohort string, listing_type string, ppm double").repartition(3)
    for r in cohort.statistics(typed).collect():
        same = [p for _, c, t, p in rows if (c, t) == (r.cohort, r.listing_type)]
        known = [p for p in same if p is not None]
        below = sum(r.ppm is None or p < r.ppm for p in known)
        assert r.pct == pytest.approx(below / (len(same) - 1) if len(same) > 1 else 0)
        assert r.median == (statistics.median(known) if known else None) and r["mean"] == (pytest.approx(statistics.mean(known)) if known else None)
        assert r.stddev == (pytest.approx(statistics.stdev(known)) if len(known) > 1 else None)
    assert cohort.statistics(typed).count() == len(rows) and cohort.statistics(typed.limit(0)).count() == 0


@pytest.mark.parametrize("seconds", [60, 3600, 500_000])
def test_debounced_against_a_loop(spark, seconds):
    rng = random.Random(5)
    rows = [(k, datetime(2024, 1, 1) + timedelta(seconds=t)) for k in (1, 2, None) for t in (sorted(rng.randint(0, 3_000_000) for _ in range(150)) if k != 2 else range(0, 40_000, 30))]
    rows += rows[:5] + [(3, datetime(2024, 1, 1)), (4, None)]
    want, last = set(), {}
    for k, t in sorted((r for r in rows if r[1]), key=lambda r: r[1]):
        if k not in last or (t - last[k]).total_seconds() >= seconds:
            want.add((k, t))
            last[k] = t
    got = [tuple(r) for r in history.debounced(spark.createDataFrame(rows, "property_id long, ts timestamp"), seconds).collect()]
    assert len(got) == len(want) and set(got) == want


def test_jaro_winkler_bound(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc é") for _ in range(rng.randint(0, 8)))
    a, b = F.col("a"), F.col("b")
    rows = spark.createDataFrame([(word(), word()) for _ in range(3000)], "a string, b string").select(text.similarity(a, b).alias("s"), text.jaro_winkler_at_most(a, b).alias("most")).collect()
    assert all(r.s <= r.most + 1e-9 for r in rows)


def test_vectors_in_blocks(spark, monkeypatch):
    """Many small blocks, zero vectors, ties and equal groups against all pairs."""
    monkeypatch.setattr(vectors, "QUERIES", 3)
    monkeypatch.setattr(vectors, "VECTORS", 7)
    rng = random.Random(3)
    rows = [(i, rng.choice("xyz"), [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(60)] + [(60, "x", [0.0, 0.0, 0.0]), (61, "alone", [1.0, 0.0, 0.0])]
    e = spark.createDataFrame(rows, "id long, group string, v array<double>")

    def distance(a, b):
        n = math.hypot(*a) * math.hypot(*b)
        return None if n == 0 else round(1 - sum(x * y for x, y in zip(a, b, strict=True)) / n, 9)

    near, rank = {}, {}
    for i, g, v in rows[::4] + rows[-1:]:
        order = sorted((d, j, h) for j, h, w in rows if j != i and (d := distance(v, w)) is not None)
        near[i] = [(d, j) for d, j, _ in order[:5]]
        rank |= {i: next(n for n, (_, _, h) in enumerate(order, 1) if h == g)} if any(h == g for _, _, h in order) else {}
    q = e.where("id % 4 = 0 OR id = 61")
    got = {}
    for r in vectors.nearest(q, e, 5).collect():
        got.setdefault(r.query, []).append((r.distance + 0.0, r.id))
    assert {i: sorted(x) for i, x in got.items()} == {i: [(d + 0.0, j) for d, j in x] for i, x in near.items() if x}
    assert {r.query: r.rank for r in vectors.first_relevant(q, e).collect()} == rank
    assert vectors.nearest(q.limit(0), e, 5).count() == vectors.nearest(q, e.limit(0), 5).count() == 0


def test_titles_are_compared_once_for_all_rows_that_bear_them(spark):
    rng = random.Random(5)
    titles = ["".join(rng.choices("abc", k=rng.randint(3, 7))) for _ in range(25)] + [" Old Plate", "old plate ", "", None]
    rows = [(i, rng.choice(titles), rng.choice([1.0, 2.5, 3.0, 4.9, 7.0]), rng.choice(["São", "sao", "x", None])) for i in range(150)]
    got = resolve.corrected_duplicates(spark.createDataFrame(rows, "id long, title string, area_m2 double, city string"), 0.8, 2.0)
    plain = lambda t: (t or "").strip().lower()
    town = {"São": "sao", "sao": "sao", "x": "x"}
    like = lambda a, b: text._jaro_winkler(a, b) if a and b else 0.0
    want = {(a[0], b[0]): like(plain(a[1]), plain(b[1])) for a in rows for b in rows if a[0] < b[0] and a[3] and b[3] and town[a[3]] == town[b[3]] and abs(a[2] - b[2]) <= 2}
    assert {(r.id, r.r_id): r.similarity for r in got.collect()} == {k: v for k, v in want.items() if v >= 0.8}
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()  # no comparison letter by letter for each pair of rows


def test_distances_are_taken_once_for_all_rows_of_a_position(spark):
    a = spark.createDataFrame([(i, 0.001 * (i % 3), -0.0 if i % 2 else 0.0) for i in range(30)] + [(99, None, 0.0)], "id long, lon double, lat double")
    b = spark.createDataFrame([(i, 0.001 * (i % 4), 0.0) for i in range(40)] + [(98, 0.0, None)], "r_id long, r_lon double, r_lat double")
    got = geo.within_radius(a, b, 150, digits=1)
    assert sorted((r.id, r.r_id, r.distance_m) for r in got.collect()) == sorted((i, j, round(abs(i % 3 - j % 4) * math.radians(0.001) * geo.RADIUS_M, 1)) for i in range(30) for j in range(40) if abs(i % 3 - j % 4) <= 1)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ASIN") > plan.rindex("Join Inner", 0, plan.index("ASIN"))  # below the joins that bring the rows
    assert plan[: plan.index("ASIN")].count("Join Inner") >= 2


@pytest.mark.parametrize("seed", [1, 2])
def test_entities_of_many_copies_against_brute_force(spark, seed):
    rng = random.Random(seed)
    titles = ["old plate", "Old plates", "new ring", "large bolt", " large bolts", "", None]
    spots = [(0.1, 0.1), (0.1003, 0.1), (0.1006, 0.1), (0.0, 0.1), (0.0003, 0.1), (None, 0.1)]
    row = lambda i, who: (f"{who}{i:03}", who, str(i), rng.choice(titles), rng.choice([None, 0.0, 10.0, 14.0, 20.0, 25.0, 33.0]), rng.choice([1, 1, None]), rng.choice([1, 2]), 1, *rng.choice(spots), rng.random() < 0.7)
    new, known = [row(i, "c") for i in range(90)], [row(i, "k") for i in range(8)]
    schema = "id string, platform string, platform_id string, title string, area_m2 double, bedrooms int, bathrooms int, parking int, lon double, lat double, active boolean"

    def like(a, b):
        if None in (a[8], b[8]) or a[8] == 0 or abs(a[8] - b[8]) * math.radians(1) * geo.RADIUS_M > 50:
            return 0.0
        if (a[4] and b[4] and abs(a[4] - b[4]) > 5) or any(a[k] is not None and b[k] is not None and a[k] != b[k] for k in (5, 6, 7)):
            return 0.0
        x, y = ((r[3] or "").strip().lower() for r in (a, b))
        return text._jaro_winkler(x, y) if x and y else 0.0

    want, rest = {}, []
    for a in new:
        best = min(((-like(a, b), b[0]) for b in known if b[10] and like(a, b) >= 0.65), default=None)
        want[a[0]] = (best[1], "fuzzy") if best else None
        rest += [] if best else [a]
    name = {a[0]: a[0] for a in rest}
    for _ in rest:
        for a in rest:
            for b in rest:
                if like(a, b) >= 0.65:
                    name[a[0]] = name[b[0]] = min(name[a[0]], name[b[0]])
    want |= {k: (v, "new") for k, v in name.items()}
    got = {r.id: (r.property_id, r.how) for r in resolve.match(spark.createDataFrame(new, schema), spark.createDataFrame(known, schema)).collect()}
    assert got == want and {how for _, how in want.values()} == {"fuzzy", "new"}


def test_every_step_of_entity_matches_decides(spark):
    """Against brute force; without any one of its steps the query would return something else."""
    from larkspur.plans import registry

    parts = sorted(tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey", "p_name", "p_size").collect())
    # id, title, area, bedrooms, lon, lat
    rows = [(k, name.strip().lower(), size, k // 7 % 3, None if k % 13 == 0 else 0.1 + k // 60 % 1000 / 500 + k % 4 / 5000, 0.1 + k // 60 // 1000 / 500 + k % 5 / 5000) for k, name, size in parts]
    steps = {"key", "distance", "rooms", "area", "title", "links"}

    def resolved(without=None):
        def like(a, b):
            if a[4] is None or b[4] is None or (without != "area" and a[2] and b[2] and abs(a[2] - b[2]) > 5) or (without != "rooms" and a[3] != b[3]):
                return 0.0
            x, y = math.radians(a[4] - b[4]) * math.cos(math.radians(a[5])), math.radians(a[5] - b[5])
            if without != "distance" and math.hypot(x, y) * geo.RADIUS_M > 50:
                return 0.0
            return text._jaro_winkler(a[1], b[1]) if without != "title" else 1.0

        known = [r for r in rows if r[0] % 3 == 0]
        want, new = {}, []
        for a in (r for r in rows if r[0] % 3 > 0 or r[0] % 5 == 0):
            if without != "key" and a in known:
                want[a[0]] = (a[0], "exact")
                continue
            best = min(((-like(a, b), str(b[0]), b[0]) for b in known if b[0] % 11 > 0 and like(a, b) >= 0.65), default=None)
            want[a[0]] = (best[2], "fuzzy") if best else (a[0], "new")
            new += [] if best else [a]
        name = {a[0]: str(a[0]) for a in new}
        pairs = [(a[0], b[0]) for a in new for b in new if a[0] != b[0] and like(a, b) >= 0.65] if without != "links" else []
        while any(name[a] != name[b] for a, b in pairs):
            for a, b in pairs:
                name[a] = name[b] = min(name[a], name[b])
        return {str(k): (str(v), how) for k, (v, how) in want.items()} | {str(k): (v, "new") for k, v in name.items()}

    got = {r.id: (r.property_id, r.how) for r in registry.queries()["entity_matches"](spark, "/root/testdata/sf0.001").collect()}
    assert got == resolved()
    assert {how for _, how in got.values()} == {"exact", "fuzzy", "new"}
    assert all(resolved(step) != got for step in steps)


def test_only_sites_that_ask_look_around(spark):
    rows = spark.createDataFrame([(i, 0.1, 0.1, i, 1, 1, i > 1) for i in range(4)] + [(9, 0.1001, 0.1, 3, 1, 1, False)], "site long, lon double, lat double, bedrooms int, bathrooms int, parking int, asks boolean")
    assert sorted(tuple(r) for r in resolve._near_sites(rows, 50).collect()) == [(2, 2), (3, 3), (3, 9)]


def test_copies_of_entities_are_compared_once(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(resolve, "written", lambda df, name: made.setdefault(name, written(df, name)))
    k = F.col("id")
    p = spark.range(3000).select(k.cast("string").alias("id"), F.lit("a").alias("platform"), k.cast("string").alias("platform_id"), F.lit("old plate").alias("title"), (10.0 + k % 20).alias("area_m2"), F.lit(1).alias("bedrooms"), F.lit(1).alias("bathrooms"), F.lit(1).alias("parking"), F.lit(0.1).alias("lon"), F.lit(0.1).alias("lat"), F.lit(True).alias("active"))
    assert {r.property_id for r in resolve.match(p, p.limit(0)).collect()} == {"0"}
    assert made["kind"].count() == 20 and made["links"].count() == 1  # not 3,000 by 3,000 rows


def test_spellings_are_folded_once_and_meet_unsorted(spark):
    from larkspur.plans import registry

    rows = spark.createDataFrame([("São", 3), ("sao", 2), ("SAO", 5), ("sao", 1), ("São", 0), ("x", 7), (None, 0), (" ", 4)], "n string, at int")
    assert {r.key: r.name for r in resolve.folded_names(rows, "n", "at").collect()} == {"sao": "São", "x": "x"}
    plan = registry.queries()["fold_distinct"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[name" in plan and "SortAggregate(keys=[name" not in plan


@pytest.mark.parametrize("block", [3, 50_000])
def test_waits_are_followed_within_blocks(spark, monkeypatch, block):
    rng = random.Random(4)
    rows = [(k, i, rng.randint(0, 200) * 1_000_000, rng.choice([0, 1, 2, 5, 12, None])) for k in ("a", None) for i in range(60)]
    rows += [("full", i, 0, 9) for i in range(300)]
    want = {}
    for key in {r[0] for r in rows}:
        open_, now = [], 0
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            need, base = r[3] or 0, max(now, r[2])
            free = lambda at: sum(n for t, n in open_ if t > at - 60_000_000) + need <= 9 or not any(t > at - 60_000_000 for t, _ in open_)  # noqa: B023, E731
            now = min(at for at in [base, *(t + 60_000_000 for t, _ in open_)] if at >= base and free(at))
            open_.append((now, need))
            want[key, r[1]] = now - r[2]
    made = []
    monkeypatch.setattr(history, "BLOCK", block)
    monkeypatch.setattr(history, "written", lambda df, name: made.append(name) or written(df, name))
    got = history.launches(spark.createDataFrame(rows, "platform string, id long, at long, need long"), 9)
    assert {(r.platform, r.id): r.wait for r in got.collect()} == want
    assert block == 3 or len(made) == 3  # no round between blocks where there is one
