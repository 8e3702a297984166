"""Scores of neighbourhoods: transit, headways, amenities, access, safety, risks and what listings claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.geo import haversine_m, points_in_areas, points_near_areas, within_radius
from larkspur.functions.text import flag_text, fold, unit_clamp

# Weights of transit modes, modes of route types, rank of modes.
MODE_WEIGHTS = {"metro": 1.0, "brt": 0.9, "rail": 0.85, "bus": 0.55, "other": 0.4}
ROUTE_MODES = {0: "brt", 1: "metro", 2: "rail", 3: "bus", 5: "brt"}
MODE_RANKS = {"metro": 5, "brt": 4, "rail": 3, "bus": 2, "other": 1}
# Tags of points of interest by category, and how many of each make a full score.
SHOPS = ("supermarket", "convenience", "mall", "department_store", "greengrocer")
PARKS = ("park", "garden")
SCHOOLS = ("school", "kindergarten", "university", "college")
HEALTH = ("hospital", "clinic", "pharmacy", "doctors")
TARGETS = {"shop": 3.0, "park": 1.0, "school": 1.0, "healthcare": 2.0}
SEVERITIES = ("low", "medium", "high")


def _map(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def stop_modes(stop_times: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """(stop_id, mode): the best mode that serves a stop; a route that isn't known or has no type is a bus."""
    kind = routes.select("route_id", _map(ROUTE_MODES, F.coalesce("route_type", F.lit(3)), "other").alias("mode"))
    served = stop_times.select("stop_id", "trip_id").join(trips.select("trip_id", "route_id"), "trip_id").join(kind, "route_id", "left").withColumn("mode", F.coalesce("mode", F.lit("bus")))
    return served.groupBy("stop_id").agg(F.max_by("mode", _map(MODE_RANKS, F.col("mode"), 1)).alias("mode"))


def transit_scores(centroids: DataFrame, stops: DataFrame, max_m: float = 1200.0, near_m: float = 400.0, nearest: float = 0.7, cap: float = 8.0) -> DataFrame:
    """(id, transit_score, nearest_m, n_stops) of centroids (id, lon, lat): nearness of the best stop and weight of those close by.

    nearest_m belongs to the stop of the greatest weighted nearness; it is null where that is 0. Centroids at one
    place are scored once, stops of a mode at one place are counted.
    """
    at_one = stops.groupBy(F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"), "mode").agg(F.count(F.lit(1)).alias("n"))
    pairs = within_radius(centroids.select("lon", "lat").distinct(), at_one, max_m)
    w = _map(MODE_WEIGHTS, F.col("mode"), MODE_WEIGHTS["other"])
    pairs = pairs.withColumns({"w": w, "near": (1 - F.col("distance_m") / max_m) * w})
    got = pairs.groupBy("lon", "lat").agg(F.max("near").alias("best"), F.sum(F.when(F.col("distance_m") <= near_m, F.col("w") * F.col("n")).otherwise(0.0)).alias("close"), F.max_by("distance_m", F.struct("near", -F.col("distance_m"))).alias("at"), F.sum("n").alias("n_stops"))
    score = unit_clamp(nearest * F.greatest("best", F.lit(0.0)) + (1 - nearest) * F.least(F.lit(1.0), F.col("close") / cap))
    out = centroids.select("id", "lon", "lat").join(got, ["lon", "lat"], "left")
    return out.select("id", F.when(F.col("best").isNull(), 0.0).otherwise(score).alias("transit_score"), F.when(F.col("best") > 0, F.col("at")).alias("nearest_m"), F.coalesce("n_stops", F.lit(0)).cast("long").alias("n_stops"))


def headways(stop_times: DataFrame, frequencies: DataFrame, least: int = 120, most: int = 7200, gaps: int = 3) -> DataFrame:
    """(stop_id, headway_s, method): the median of frequencies where there are any, else of the gaps between departures.

    stop_times: stop_id, trip_id, departure_s. Gaps outside [least, most] don't count; fewer than `gaps` say nothing.
    """
    f = frequencies.where("headway_secs > 0").join(stop_times.select("trip_id", "stop_id"), "trip_id").groupBy("stop_id").agg(F.percentile(F.col("headway_secs").cast("double"), F.lit(0.5)).alias("f"))
    gap = F.col("departure_s") - F.lag("departure_s").over(Window.partitionBy("stop_id").orderBy("departure_s"))
    g = stop_times.where("departure_s IS NOT NULL").withColumn("gap", gap).where(F.col("gap").between(least, most)).groupBy("stop_id").agg(F.percentile(F.col("gap").cast("double"), F.lit(0.5)).alias("g"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= gaps)
    out = f.join(g, "stop_id", "full")
    return out.select("stop_id", F.coalesce("f", "g").alias("headway_s"), F.when(F.col("f").isNotNull(), "frequencies").otherwise("stop_times").alias("method"))


def area_headways(stops_of_area: DataFrame) -> DataFrame:
    """(id, minutes, method) from (id, headway_s, method): median of stops, half-even minutes."""
    return stops_of_area.groupBy("id").agg(F.bround(F.percentile("headway_s", F.lit(0.5)) / 60).cast("long").alias("minutes"), F.when(F.bool_or(F.col("method") == "frequencies"), "frequencies").otherwise("stop_times").alias("method"))


def category(tags: Column) -> Column:
    """Of a point of interest's tags (map); null if none counts."""
    t = F.map_from_entries(F.transform(F.map_entries(tags), lambda e: F.struct(F.lower(F.trim(e.key)).alias("key"), F.lower(F.trim(e.value)).alias("value"))))
    get = lambda k: F.coalesce(F.try_element_at(t, F.lit(k)), F.lit(""))
    out = F.when(get("shop").isin(*SHOPS) | (get("amenity") == "marketplace"), "shop").when(get("leisure").isin(*PARKS) | (get("landuse") == "recreation_ground"), "park")
    return out.when(get("amenity").isin(*SCHOOLS), "school").when(get("amenity").isin(*HEALTH), "healthcare").when(get("category").isin(*TARGETS), get("category"))


def saturation(count: Column, target: float) -> Column:
    return F.least(F.lit(1.0), count / target) if target > 0 else F.lit(0.0)


def amenity_scores(areas: DataFrame, pois: DataFrame, targets: dict[str, float] = TARGETS, buffer_m: float = 0.0) -> DataFrame:
    """(id, <category>_n, amenity_score) of areas (id, ring, holes where there are any), widened by `buffer_m`: mean of the saturations of the categories."""
    shapes = areas.select("id", "ring", *[c for c in areas.columns if c == "holes"])
    found = points_near_areas(pois.withColumn("category", category(F.col("tags"))).where("category IS NOT NULL").select("lon", "lat", "category"), shapes, buffer_m)
    n = found.groupBy("id").pivot("category", list(targets)).agg(F.count(F.lit(1)))
    out = areas.select("id").join(n, "id", "left").na.fill(0, list(targets))
    score = sum((saturation(F.col(c), t) for c, t in targets.items()), F.lit(0.0)) / len(targets)
    return out.select("id", *[F.col(c).cast("long").alias(f"{c}_n") for c in targets], score.alias("amenity_score"))


def access_scores(centroids: DataFrame, hubs: DataFrame, kmh: float = 30.0, most_minutes: float = 45.0) -> DataFrame:
    """(id, hub, minutes, access_score): the hub of the own city that is fewest minutes away; centroids of cities without hubs drop."""
    h = hubs.select(F.lower("city").alias("city_key"), F.col("name").alias("hub"), F.col("lon").alias("h_lon"), F.col("lat").alias("h_lat"))
    pairs = centroids.withColumn("city_key", F.lower("city")).join(h, "city_key")
    minutes = haversine_m(F.col("lon"), F.col("lat"), F.col("h_lon"), F.col("h_lat")) / 1000 / kmh * 60
    best = pairs.withColumn("minutes", minutes).groupBy("id").agg(F.min(F.struct("minutes", "hub")).alias("b"))
    return best.select("id", "b.hub", "b.minutes", unit_clamp(1 - F.col("b.minutes") / most_minutes).alias("access_score"))


def inverted_range(rows: DataFrame, value: str, by: list[str], out: str = "score") -> DataFrame:
    """1 for the least value of a group, 0 for the greatest, 0.5 where all are equal. Bounds are summed in parts and joined back."""
    bounds = rows.groupBy(*by).agg(F.min(value).alias("range_low"), F.max(value).alias("range_high"))
    wide = F.col("range_high") - F.col("range_low")
    return rows.join(bounds, by).withColumn(out, F.when(wide == 0, 0.5).otherwise(1 - (F.col(value) - F.col("range_low")) / wide)).drop("range_low", "range_high")


def safety_scores(neighborhoods: DataFrame, rates: DataFrame) -> DataFrame:
    """(id, safety_score). Rates of unknown names move the bounds; of repeated names the last row counts (`row_nth`)."""
    key = [fold(F.col("name")).alias("k_name"), fold(F.col("city")).alias("k_city"), F.upper(F.trim("state")).alias("k_state")]
    r = inverted_range(rates, "rate_per_100k", ["city", "state"], "safety_score").select(*key, "safety_score", "row_nth")
    r = r.groupBy("k_name", "k_city", "k_state").agg(F.max_by("safety_score", "row_nth").alias("safety_score"))
    return neighborhoods.select("id", *key).join(r, ["k_name", "k_city", "k_state"]).select("id", "safety_score")


def regional_rates(regions: DataFrame, counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rates of regions handed to their neighbourhoods; a pair without a region's count is an error."""
    rate = F.col("count") * 100_000 / F.col("population")
    r = regions.join(counts, "regional").select("regional", rate.alias("rate_per_100k"))
    out = pairs.join(r, "regional", "left")
    return out.withColumn("rate_per_100k", F.when(F.col("rate_per_100k").isNull(), F.raise_error(F.concat(F.lit("no count for regional "), F.col("regional"))).cast("double")).otherwise(F.col("rate_per_100k")))


def crime_extract(rows: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """(key, name, total) of (name, amount: text with a decimal comma, row_nth): sums by folded name, first spelling."""
    r = rows.withColumns({"key": fold(F.col("name")), "amount": F.replace("amount", F.lit(","), F.lit(".")).try_cast("double")}).where("key <> '' AND amount IS NOT NULL")
    if allowed is not None:
        r = r.where(F.col("key").isin(allowed))
    return r.groupBy("key").agg(F.min_by("name", "row_nth").alias("name"), F.sum("amount").alias("total"))


def severity(text: Column, number: Column | None = None) -> Column:
    """low, medium or high; numbers in [0, 1] by thirds; null else."""
    n = number if number is not None else text.try_cast("double")
    label = F.lower(F.trim(text))
    return F.when(n.between(0, 1), F.when(n >= 2 / 3, "high").when(n >= 1 / 3, "medium").otherwise("low")).when(label.isin(*SEVERITIES), label)


def risk_flags(hits: DataFrame) -> DataFrame:
    """(id, risk_flags, severities) of (id, risk_type, severity): types in order, with the greatest severity of each."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.coalesce(severity(F.col("severity")), F.lit("")))
    top = hits.groupBy("id", "risk_type").agg(F.max(rank).alias("rank"))
    label = F.when(F.col("rank") > 0, F.try_element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("rank").cast("int")))
    items = F.sort_array(F.collect_list(F.struct("risk_type", label.alias("severity"))))
    return top.groupBy("id").agg(items.alias("items")).select("id", F.transform("items", lambda x: x.risk_type).alias("risk_flags"), F.map_from_entries("items").alias("severities"))


def merge_flags(old: Column, new: Column, managed: list[str]) -> Column:
    """Old flags that aren't managed by this run, then the new ones in order."""
    mine = F.array(*[F.lit(x) for x in managed])
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.filter(F.coalesce(old, empty), lambda x: ~F.array_contains(mine, x)), F.sort_array(F.coalesce(new, empty))))


def top_flags(rows: DataFrame, flags: str, top: int = 5, least_rows: int = 1) -> DataFrame:
    """(id, n_rows, flag, n, rank): the most frequent flags of each id's rows; repeats within a row count."""
    size = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= least_rows)
    n = rows.select("id", F.explode(flags).alias("flag")).withColumn("flag", flag_text(F.col("flag"))).where("flag <> ''").groupBy("id", "flag").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "flag"))
    return n.withColumn("rank", rank).where(F.col("rank") <= top).join(size, "id").select("id", "n_rows", "flag", "n", "rank")


def assign_areas(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Each point (id, lon, lat, old_area) with area_id: of the covering areas that of the lowest name; no place keeps the old one."""
    placed = points.where("lon IS NOT NULL AND lat IS NOT NULL")
    inside = points_in_areas(placed.select("id", "lon", "lat"), areas.select(F.col("id").alias("area_id"), "name", "ring"))
    best = inside.groupBy("id").agg(F.min_by("area_id", F.struct("name", "area_id")).alias("area_id"))
    return points.join(best, "id", "left").withColumn("area_id", F.when(F.col("lon").isNull() | F.col("lat").isNull(), F.col("old_area")).otherwise(F.col("area_id")))
