"""Entity resolution: exact keys, fuzzy spatial matches, clusters of what is new; keyed dedup."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.geo import near_places
from larkspur.functions.text import fold, jaro_winkler_at_most, similarity
from larkspur.scratch import dealt, scratch_dir, written


@dataclass(frozen=True)
class Rules:
    radius_m: float = 50.0
    text: float = 0.65
    area: float = 5.0
    algorithm: str = "jaro_winkler"


ROOMS = ["bedrooms", "bathrooms", "parking"]


def _numbered(rows: DataFrame, columns: list[str], number: str) -> DataFrame:
    """Adds `number`, one for all rows alike in `columns`, nulls too."""
    kinds = written(rows.select(*columns).distinct().withColumn(number, F.monotonically_increasing_id()), number)  # written: the numbers stay
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in columns])
    return rows.join(kinds.withColumnsRenamed({c: f"of_{c}" for c in columns}), same).drop(*[f"of_{c}" for c in columns])


def _near_sites(rows: DataFrame, radius_m: float) -> DataFrame:
    """(site, r_site) of those of `rows` (site, lon, lat, rooms, asks) that lie near each other and whose known rooms agree; a site at 0, or one without rows that ask, asks for none."""
    columns = ["site", "lon", "lat", *ROOMS]
    asks = rows.where("asks AND lon <> 0 AND lat <> 0").select(*columns).distinct()
    others = rows.select(*columns).distinct().withColumnsRenamed({c: f"r_{c}" for c in columns})
    near = near_places(asks, others, radius_m).withColumnsRenamed({"lon": "of_lon", "lat": "of_lat", "r_lon": "to_lon", "r_lat": "to_lat"})
    here = dealt(near.join(asks, (F.col("lon") == F.col("of_lon")) & (F.col("lat") == F.col("of_lat"))), "to_lon", "to_lat")
    pairs = here.join(others, (F.col("to_lon") == F.col("r_lon")) & (F.col("to_lat") == F.col("r_lat")))
    rooms = [F.coalesce(F.col(c) == F.col(f"r_{c}"), F.lit(True)) for c in ROOMS]
    return pairs.where(rooms[0] & rooms[1] & rooms[2]).select("site", "r_site")


def _similar(left: DataFrame, right: DataFrame, near: DataFrame, rules: Rules) -> DataFrame:
    """Pairs of `left` and `right` (both site, text, low, high; right's with r_) of near sites, with areas that come as near as allowed or aren't known, and of similar texts; adds similarity."""
    asks = dealt(left.join(near, "site"), "r_site")
    area = F.coalesce((F.col("low") - F.col("r_high") <= rules.area) & (F.col("r_low") - F.col("high") <= rules.area), F.lit(True))
    pairs = asks.join(right, "r_site").where(area).withColumn("similarity", similarity(F.col("text"), F.col("r_text"), rules.algorithm))
    return pairs.where(F.col("similarity") >= rules.text)


def match(candidates: DataFrame, properties: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(id, property_id, how): exact by platform and platform_id, else the most similar active property near by, else new.

    New candidates that are alike form one property, named by the least id among them (components of the links between
    them, by repeated minima; each step is checkpointed). Ties go to the least id.

    Rows alike in all that is compared are one kind and compared once. Among new ones, kinds of one site and text whose areas follow each other closely are one
    run, which links like its members do: where two runs come near enough, so do two of their areas.
    """
    key = ["platform", "platform_id"]
    exact = candidates.select("id", *key).join(properties.groupBy(*key).agg(F.min("id").alias("property_id")), key).select("id", "property_id", F.lit("exact").alias("how"))
    columns = ["id", "lon", "lat", *ROOMS, F.lower(F.trim("title")).alias("text"), F.nullif("area_m2", F.lit(0.0)).alias("area")]
    rest = candidates.join(exact, "id", "left_anti").select(*columns, F.lit(True).alias("asks"))
    rows = rest.unionByName(properties.where("active").select(*columns, F.lit(False).alias("asks")))
    rows = written(_numbered(_numbered(rows, ["lon", "lat", *ROOMS], "site"), ["site", "text", "area"], "kind"), "rows")
    near = written(_near_sites(rows, rules.radius_m), "near-sites")
    kinds = lambda some: some.groupBy("kind", "site", "text", "area").agg(F.min("id").alias("first")).withColumns({"low": F.col("area"), "high": F.col("area")})
    renamed = lambda some: some.select(*[F.col(c).alias(f"r_{c}") for c in some.columns])
    known = renamed(kinds(rows.where("NOT asks")))
    best = _similar(kinds(rows.where("asks")), known, near, rules).groupBy("kind").agg(F.min_by("r_first", F.struct(-F.col("similarity"), "r_first")).alias("property_id"))
    best = written(best, "best")
    asks = rows.where("asks").select("id", "kind")
    fuzzy = asks.join(best, "kind").select("id", "property_id", F.lit("fuzzy").alias("how"))
    new = _runs(kinds(rows.where("asks").join(best, "kind", "left_anti")), rows, rules)
    runs = new.groupBy("run", "site", "text").agg(F.min("area").alias("low"), F.max("area").alias("high"), F.min("first").alias("first"))
    links = written(_similar(runs, renamed(runs), near, rules).select(F.col("run").alias("id"), F.col("r_run").alias("r_id")), "links")
    linked = links.select("id").union(links.select("r_id")).distinct()  # also those whose rows link among themselves only
    roots = clusters(linked, links.where("id <> r_id")).join(runs.select(F.col("run").alias("id"), "first"), "id")
    named = roots.groupBy("property_id").agg(F.min("first").alias("name"))
    named = roots.join(named, "property_id").select(F.col("id").alias("run"), "name")
    created = asks.join(new.select("kind", "run"), "kind").join(named, "run", "left").select("id", F.coalesce("name", "id").alias("property_id"), F.lit("new").alias("how"))
    return exact.unionByName(fuzzy).unionByName(created)


def _runs(kinds: DataFrame, rows: DataFrame, rules: Rules) -> DataFrame:
    """Adds `run` to kinds, written: one for kinds of a site and text that link, each with the next by area; rows: (site, lon, lat). A kind without area or without links of its own is alone."""
    asking = rows.where("lon <> 0 AND lat <> 0").select(F.col("site").alias("of_site")).distinct()
    k = kinds.join(asking, F.col("site") == F.col("of_site"), "left")
    k = k.withColumn("own", F.col("of_site").isNotNull() & (similarity(F.col("text"), F.col("text"), rules.algorithm) >= rules.text)).drop("of_site")
    w = Window.partitionBy("site", "text").orderBy("area", "kind")
    follows = F.coalesce(F.col("own") & (F.col("area") - F.lag("area").over(w) <= rules.area), F.lit(False))
    starts = k.withColumn("start", F.when(~follows, F.col("kind")))
    return written(starts.withColumn("run", F.last("start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("start", "own", "low", "high"), "runs")


def _saved(df: DataFrame) -> DataFrame:
    sc, named = df.sparkSession.sparkContext, scratch_dir(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return df.checkpoint()


def clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, property_id): the least id that links (id, r_id), in both directions, reach."""
    both = _saved(links.union(links.select("r_id", "id")).distinct())
    now = _saved(nodes.withColumn("property_id", F.col("id")))
    while True:
        low = both.join(now.withColumnRenamed("id", "r_id"), "r_id").groupBy("id").agg(F.min("property_id").alias("low"))
        nxt = now.join(low, "id", "left").select("id", F.least("property_id", F.coalesce("low", "property_id")).alias("property_id"))
        jump = nxt.select(F.col("id").alias("property_id"), F.col("property_id").alias("far"))  # roots of roots
        nxt = _saved(nxt.join(jump, "property_id", "left").select("id", F.coalesce("far", "property_id").alias("property_id")))
        if nxt.join(now.withColumnRenamed("property_id", "was"), "id").where("property_id <> was").isEmpty():
            return nxt
        now = nxt


def corrected_duplicates(rows: DataFrame, threshold: float, area: float, algorithm: str = "jaro_winkler") -> DataFrame:
    """(id, r_id, similarity), id < r_id, of rows of one city whose known areas and titles agree; blocked by city and area.

    Titles are compared once for all rows of a city and block that bear them, and only rows of titles that agree meet, so the work grows with the distinct titles
    and with the pairs returned. By Jaro-Winkler a pair is compared letter by letter only if its lengths and first letters allow the threshold.
    """
    step = max(area, 1e-9)
    a = rows.where("area_m2 > 0").select("id", F.lower(F.trim("title")).alias("text"), "area_m2", fold(F.col("city")).alias("city_key"), F.floor(F.col("area_m2") / step).alias("bucket")).where("city_key IS NOT NULL")
    kinds = written(a.select("city_key", "bucket", "text").distinct().withColumn("kind", F.monotonically_increasing_id()), "titles")  # written: the numbers stay
    own = kinds.select(F.col("city_key").alias("of_city"), F.col("bucket").alias("of_bucket"), F.col("text").alias("of_text"), "kind")
    members = written(a.join(own, (F.col("city_key") == F.col("of_city")) & (F.col("bucket") == F.col("of_bucket")) & F.col("text").eqNullSafe(F.col("of_text"))).select("id", "area_m2", "kind"), "members")
    left = dealt(kinds).withColumn("at", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)))
    right = own.withColumnsRenamed({"of_text": "r_text", "kind": "r_kind"})
    pairs = left.join(right, (F.col("city_key") == F.col("of_city")) & (F.col("at") == F.col("of_bucket"))).where((F.col("at") > F.col("bucket")) | (F.col("kind") <= F.col("r_kind")))
    if algorithm == "jaro_winkler" and threshold > 0:
        pairs = pairs.where(jaro_winkler_at_most(F.col("text"), F.col("r_text")) >= threshold - 1e-9)
    # a similarity may differ by which of the two comes first
    pairs = pairs.withColumns({"there": similarity(F.col("text"), F.col("r_text"), algorithm), "back": similarity(F.col("r_text"), F.col("text"), algorithm)})
    links = written(pairs.where(F.greatest("there", "back") >= threshold).select("kind", "r_kind", "there", "back"), "links")
    asks = dealt(members.join(links, "kind"), "r_kind")
    others = members.select(F.col("id").alias("other"), F.col("area_m2").alias("r_area"), F.col("kind").alias("r_kind"))
    met = asks.join(others, "r_kind").where((F.abs(F.col("area_m2") - F.col("r_area")) <= area) & F.when(F.col("kind") == F.col("r_kind"), F.col("id") < F.col("other")).otherwise(F.col("id") != F.col("other")))
    first = F.col("id") < F.col("other")
    met = met.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("r_id"), F.when(first, F.col("there")).otherwise(F.col("back")).alias("similarity"))
    return met.where(F.col("similarity") >= threshold)


def unique_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by `order`; rows without key all pass."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    return first.unionByName(rows.where(F.col(key).isNull()))


def merged_windows(rows: DataFrame) -> DataFrame:
    """One row for an ad seen in both the rent and the sale window: (id, rent_price, sale_price)."""
    one = lambda k: F.min(F.when(F.col("listing_type") == k, F.col("price"))).alias(f"{k}_price")
    return rows.groupBy("id").agg(one("rent"), one("sale"))


def folded_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """(key, name): distinct folded names with their first spelling. A spelling is folded once for all its rows; where `order` is a number these meet in a hash table, unsorted."""
    spelled = rows.groupBy(name).agg(F.min(order).alias("at")).withColumnRenamed(name, "name")
    return spelled.withColumn("key", fold(F.col("name"))).where("key <> ''").groupBy("key").agg(F.min_by("name", "at").alias("name"))
