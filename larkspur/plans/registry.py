"""All registered queries of the engine over the driver's tables, with the SQL that checks them.

The tables hold no listings, so each query maps columns of theirs to an operator's: parts are properties,
lines of orders are offers, brands are cohorts, return flags are listing types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import geo, text, vectors
from larkspur.operators import cohort, coverage, gates, history, location, quality, reruns, resolve, search, upserts, verdict
from larkspur.sources import files, flight, records
from larkspur.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def offers(s: SparkSession, d: str) -> DataFrame:
    """Lines as active offers: R and A are rent and sale, N is neither."""
    kind = F.when(F.col("l_returnflag") == "R", "rent").when(F.col("l_returnflag") == "A", "sale").otherwise("other")
    return t(s, d, "lineitem").select(F.col("l_partkey").alias("property_id"), kind.alias("listing_type"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_linestatus").alias("platform"), F.lit(True).alias("active"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("listing_id"))


OFFERS = """offers AS (SELECT l_partkey AS property_id, CASE l_returnflag WHEN 'R' THEN 'rent' WHEN 'A' THEN 'sale' ELSE 'other' END AS listing_type,
  l_extendedprice / l_quantity AS price, l_linestatus AS platform, l_orderkey * 10 + l_linenumber AS listing_id FROM lineitem)"""


def properties(s: SparkSession, d: str) -> DataFrame:
    p = t(s, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("area_m2"), (F.col("p_partkey") % 11 != 0).alias("active"), F.col("p_brand").alias("cohort"), (F.col("p_partkey") % 3 == 0).alias("for_rent"), (F.col("p_partkey") % 2 == 0).alias("for_sale"))


TYPED = (
    OFFERS
    + """, low AS (SELECT property_id, listing_type, min(price) AS price FROM offers WHERE price > 0 AND listing_type IN ('rent', 'sale') GROUP BY ALL),
props AS (SELECT p_partkey AS property_id, p_retailprice AS own, p_size::DOUBLE AS area, p_brand AS cohort,
    CASE WHEN p_partkey % 3 = 0 THEN 'rent' WHEN p_partkey % 2 = 0 THEN 'sale' ELSE 'rent' END AS kind
  FROM part WHERE p_partkey % 11 <> 0 AND p_size > 0),
typed AS (SELECT p.property_id, cohort, listing_type, price / area AS ppm FROM props p JOIN low USING (property_id)
  UNION ALL SELECT property_id, cohort, kind, own / area FROM props p WHERE own > 0 AND NOT EXISTS (SELECT 1 FROM low l WHERE l.property_id = p.property_id)),
stats AS (SELECT *, avg(ppm) OVER w AS mean, quantile_cont(ppm, 0.5) OVER w AS median, stddev_samp(ppm) OVER w AS stddev,
    percent_rank() OVER (PARTITION BY cohort, listing_type ORDER BY ppm NULLS LAST) AS pct FROM typed WINDOW w AS (PARTITION BY cohort, listing_type))"""
)
R = lambda c: F.round(c, 6).alias(c)  # noqa: E731  sums of doubles differ in their last places


def stats_of(s: SparkSession, d: str) -> DataFrame:
    return cohort.statistics(cohort.typed_prices(properties(s, d), offers(s, d)))


@query(f"WITH {TYPED} SELECT property_id, cohort, listing_type, round(ppm, 6) AS ppm, round(mean, 6) AS mean, round(median, 6) AS median, round(stddev, 6) AS stddev, round(pct, 6) AS pct FROM stats")
def cohort_price_stats(s, d):
    return stats_of(s, d).select("property_id", "cohort", "listing_type", *map(R, ("ppm", "mean", "median", "stddev", "pct")))


SCORED = """scored AS (SELECT *, CASE WHEN stddev > 0 THEN (ppm - mean) / stddev ELSE 0 END AS z FROM stats)"""


@query(
    f"""WITH {TYPED}, {SCORED} SELECT property_id, cohort, listing_type, round(z, 6) AS z, round(1 / (1 + exp(z)), 6) AS stat_score,
  CASE WHEN z < -1 THEN 'highly_undervalued' WHEN z < -0.2 THEN 'slightly_undervalued' WHEN z < 0.2 THEN 'average' WHEN z < 1 THEN 'slightly_overvalued' ELSE 'highly_overvalued' END AS band,
  round(0.4 / (1 + exp(z)) + 0.4 * ((property_id % 10) / 10.0) + 0.2 * 0.5, 6) AS combined FROM scored"""
)
def cohort_value_score(s, d):
    p = properties(s, d)
    ai = p.select(F.col("id").alias("property_id"), ((F.col("id") % 10) / 10).alias("ai_score"))
    none = p.select(F.col("id").alias("property_id"), F.lit(0.5).alias("quality")).where("property_id < 0")
    out = cohort.score_properties(p, offers(s, d), ai, none)
    return out.select("property_id", "cohort", "listing_type", R("z"), R("stat_score"), "band", R("combined"))


@query(
    f"""WITH {TYPED} SELECT property_id, round(max(ppm) FILTER (listing_type = 'rent'), 6) AS ppm_rent, round(max(ppm) FILTER (listing_type = 'sale'), 6) AS ppm_sale,
  round(max(mean) FILTER (listing_type = 'rent'), 6) AS mean_rent, round(max(mean) FILTER (listing_type = 'sale'), 6) AS mean_sale,
  CASE WHEN max(ppm) FILTER (listing_type = 'rent') IS NOT NULL THEN 'rent' ELSE 'sale' END AS primary_type FROM stats GROUP BY property_id"""
)
def dual_type_pivot(s, d):
    return cohort.pivoted(stats_of(s, d)).select("property_id", *map(R, ("ppm_rent", "ppm_sale", "mean_rent", "mean_sale")), "primary_type")


@query(f"WITH {TYPED} SELECT property_id, cohort, listing_type, round(ppm, 6) AS ppm FROM typed")
def legacy_fallback_union(s, d):
    return cohort.typed_prices(properties(s, d), offers(s, d)).select("property_id", "cohort", "listing_type", R("ppm"))


@query(
    f"""WITH {TYPED} SELECT cohort, listing_type, coalesce(round(avg(ppm), 6), 0) AS mean, coalesce(round(quantile_cont(ppm, 0.5), 6), 0) AS median,
  coalesce(round(stddev_samp(ppm), 6), 0) AS stddev, count(ppm) AS n FROM typed GROUP BY cohort, listing_type"""
)
def cohort_summary(s, d):
    return cohort.cohort_summary(cohort.typed_prices(properties(s, d), offers(s, d))).select("cohort", "listing_type", R("mean"), R("median"), R("stddev"), "n")


@query(
    """SELECT p_partkey AS id, round(0.5 * s + 0.3 * ai + 0.2 * q, 6) AS combined, round(0.5 * rent + 0.3 * ai + 0.2 * q, 6) AS combined_rent FROM
  (SELECT p_partkey, (p_size % 7) / 7.0 AS s, CASE WHEN p_size % 2 = 0 THEN (p_size % 5) / 5.0 END AS rent, (p_partkey % 10) / 10.0 AS ai, (p_partkey % 4) / 4.0 AS q FROM part)"""
)
def reblend(s, d):
    m = t(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 7 / 7).alias("stat_score"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") % 5 / 5).alias("stat_score_rent"), F.lit(None).cast("double").alias("stat_score_sale"), (F.col("p_partkey") % 10 / 10).alias("ai_score"), (F.col("p_partkey") % 4 / 4).alias("quality"))
    return cohort.reblend(m, cohort.Weights(0.5, 0.3, 0.2)).select("id", R("combined"), R("combined_rent"))


def base(s: SparkSession, d: str) -> DataFrame:
    """Orders as properties with metrics, customers' nations as neighbourhoods."""
    o = t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return o.select(
        F.col("o_orderkey").alias("id"), F.lit(True).alias("active"), F.col("o_orderpriority").alias("platform"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 5).cast("int").alias("bedrooms"),
        F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderkey") % 4).cast("int").alias("parking"), F.col("n_name").alias("neighborhood_name"), F.col("c_mktsegment").alias("props_neighborhood"), F.col("n_name").alias("neighborhood_city"), F.col("c_mktsegment").alias("props_city"),
        (F.col("o_custkey") % 10 / 10).alias("combined"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 8 / 8).alias("combined_rent"), F.lit(None).cast("double").alias("combined_sale"), (F.col("o_orderkey") % 3 == 0).alias("for_rent"), F.lit(True).alias("for_sale"), F.when(F.col("o_orderkey") % 2 == 0, "casa").otherwise("Apto").alias("type"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 3 == 1).alias("furnished"), (F.col("o_orderkey") % 360 - 180).cast("double").alias("lon"), (F.col("o_custkey") % 180 - 90).cast("double").alias("lat"), F.col("o_orderdate").alias("first_seen"), F.lit(0.5).alias("quality"),
    )


def order_listings(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "rent").otherwise("sale")
    return t(s, d, "lineitem").select(F.col("l_orderkey").alias("property_id"), kind.alias("listing_type"), F.col("l_extendedprice").alias("price"), F.col("l_linestatus").alias("platform"), (F.col("l_linenumber") < 6).alias("active"), (F.col("l_suppkey") % 4 == 0).alias("accepts_pets"))


BASE = """base AS (SELECT o_orderkey AS id, o_orderpriority AS platform, o_totalprice AS price, o_orderkey % 5 AS bedrooms, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 4 END AS parking,
    n_name, c_mktsegment AS seg, (o_custkey % 10) / 10.0 AS combined, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 8) / 8.0 END AS combined_rent, o_orderkey % 3 = 0 AS for_rent,
    CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 = 1 END AS furnished, o_orderkey % 360 - 180 AS lon, o_custkey % 180 - 90 AS lat, o_orderdate AS first_seen
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
lst AS (SELECT l_orderkey AS property_id, CASE l_returnflag WHEN 'R' THEN 'rent' ELSE 'sale' END AS listing_type, l_extendedprice AS price, l_linestatus AS platform, l_linenumber < 6 AS active, l_suppkey % 4 = 0 AS pets FROM lineitem)"""


@query(
    f"""WITH {BASE} SELECT id FROM base b WHERE bedrooms >= 1 AND parking >= 1 AND (n_name ILIKE '%a%' OR seg ILIKE '%a%' OR n_name ILIKE '%BUILD%' OR seg ILIKE '%BUILD%')
  AND coalesce(combined_rent, combined, 0) >= 0.2 AND for_rent AND lon > -170 AND lon < 170 AND lat > -80 AND lat < 80
  AND EXISTS (SELECT 1 FROM lst l WHERE l.property_id = b.id AND active AND listing_type = 'rent' AND l.price <= 30000)"""
)
def faceted_search(s, d):
    q = search.Search(min_bedrooms=1, min_parking=1, neighborhoods="a, BUILD", min_score=0.2, listing_type="rent", bbox="-170,-80,170,80", max_price=30000)
    return search.matches(base(s, d), order_listings(s, d), q).select("id")


@query(f"WITH {BASE} SELECT id FROM base b WHERE furnished = false AND id % 2 = 0 AND coalesce(n_name, seg) ILIKE '%i%' AND EXISTS (SELECT 1 FROM lst l WHERE l.property_id = b.id AND active AND pets)")
def boolean_search(s, d):
    b = base(s, d).withColumn("amenities", F.array().cast("array<string>"))
    return search.matches(b, order_listings(s, d), search.Search(furnished=False, pets=True, property_type="House", cities="i")).select("id")


@query(
    f"""WITH {BASE}, low AS (SELECT property_id, min(price) AS p FROM lst WHERE active AND listing_type = 'sale' GROUP BY 1)
SELECT id, round(coalesce(p, price), 6) AS sort_key FROM base LEFT JOIN low ON id = property_id ORDER BY coalesce(p, price) ASC NULLS LAST, id LIMIT 20 OFFSET 40"""
)
def typed_price_sort_page(s, d):
    q = search.Search(sort="price", descending=False, price_type="sale", page=3)
    return search.search(base(s, d), order_listings(s, d), q).select("id", R("sort_key"))


@query(f"WITH {BASE} SELECT n_name AS facet_city, n_name AS facet_name, count(*) AS n, max(0.5) AS quality FROM base WHERE n_name IS NOT NULL GROUP BY ALL")
def facet_counts(s, d):
    return search.neighborhood_facet(base(s, d))


@query(f"WITH {BASE} SELECT n_name AS city, count(*) AS n FROM base GROUP BY ALL")
def city_facet(s, d):
    return search.city_facet(base(s, d))


@query(
    f"""WITH {BASE} SELECT property_id, listing_type, price, platform FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY price NULLS LAST, CASE listing_type WHEN 'rent' THEN 0 WHEN 'sale' THEN 1 ELSE 2 END, platform) AS n FROM lst WHERE active) WHERE n = 1"""
)
def primary_offer_argmin(s, d):
    return search.primary_listing(order_listings(s, d)).select("property_id", "primary.listing_type", "primary.price", "primary.platform")


@query(f"WITH {BASE} SELECT property_id, count(*) AS n, round(sum(price), 4) AS total, round(arg_min(price, (CASE listing_type WHEN 'rent' THEN 0 ELSE 1 END, price)), 4) AS first_price FROM lst WHERE active GROUP BY 1")
def nested_offers(s, d):
    n = search.nested_listings(order_listings(s, d))
    return n.select("property_id", F.size("listings").cast("long").alias("n"), F.round(F.aggregate("listings", F.lit(0.0), lambda a, x: a + x.price), 4).alias("total"), F.round(F.col("listings")[0].price, 4).alias("first_price"))


@query("SELECT p_partkey AS id, round(CASE WHEN n = 0 THEN 0.5 ELSE tot / n END, 6) AS q FROM (SELECT p_partkey, (CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END) AS n, (CASE WHEN p_size % 2 = 0 THEN p_size / 50.0 ELSE 0 END) + (CASE WHEN p_size % 3 = 0 THEN p_size / 60.0 ELSE 0 END) AS tot FROM part)")
def quality_mean_nonnull(s, d):
    a, b = F.when(F.col("p_size") % 2 == 0, F.col("p_size") / 50), F.when(F.col("p_size") % 3 == 0, F.col("p_size") / 60)
    return t(s, d, "part").select(F.col("p_partkey").alias("id"), F.round(cohort.quality_mean(a, b), 6).alias("q"))


@query("SELECT s_suppkey, s_nationkey, round(CASE WHEN hi = lo THEN 0.5 ELSE 1 - (s_acctbal - lo) / (hi - lo) END, 6) AS score FROM (SELECT *, min(s_acctbal) OVER w AS lo, max(s_acctbal) OVER w AS hi FROM supplier WINDOW w AS (PARTITION BY s_nationkey))")
def minmax_invert_group(s, d):
    return quality.inverted_range(t(s, d, "supplier"), "s_acctbal", ["s_nationkey"]).select("s_suppkey", "s_nationkey", R("score"))


@query("SELECT l_partkey, round((least(1, a / 3.0) + least(1, b / 1.0) + least(1, c / 10.0)) / 3, 6) AS score FROM (SELECT l_partkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS b, count(*) FILTER (l_returnflag = 'R') AS c FROM lineitem GROUP BY 1)")
def saturating_score(s, d):
    n = t(s, d, "lineitem").groupBy("l_partkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1))).na.fill(0)
    score = sum((quality.saturation(F.col(c), x) for c, x in (("A", 3.0), ("N", 1.0), ("R", 10.0))), F.lit(0.0)) / 3
    return n.select("l_partkey", F.round(score, 6).alias("score"))


def all_vectors(s: SparkSession, d: str) -> DataFrame:
    """Vectors without nulls; a null label is a group that no other is like."""
    e = t(s, d, "embeddings").where("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")
    return e.select(F.col("vec_id").cast("long").alias("id"), F.coalesce(F.col("label").cast("string"), F.concat(F.lit("none "), F.col("vec_id"))).alias("group"), F.col("embedding").cast("array<double>").alias("v"))


@query(
    """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
r AS (SELECT query, vec_id, round(list_cosine_distance(embedding::DOUBLE[], e), 9) AS distance FROM q, embeddings WHERE vec_id <> query)
SELECT query, vec_id, distance FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) <= 20"""
)
def knn_cosine(s, d):
    """The 20 nearest of every vector whose id is divisible by 50, of all vectors."""
    e = all_vectors(s, d)
    return vectors.nearest(e.where("id % 50 = 0"), e, 20).withColumnRenamed("id", "vec_id")


@query(
    """WITH q AS (SELECT vec_id AS query, label AS ql, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
r AS (SELECT query, ql = label AS relevant, row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_distance(embedding::DOUBLE[], e), 9), vec_id) AS rank FROM q, embeddings WHERE vec_id <> query),
f AS (SELECT query, min(rank) AS rank FROM r WHERE relevant GROUP BY 1) SELECT round(avg((rank = 1)::DOUBLE), 6) AS top1, round(avg(1.0 / rank), 6) AS mrr FROM f"""
)
def mrr_eval(s, d):
    e = all_vectors(s, d)
    return coverage.retrieval(vectors.first_relevant(e.where("id % 50 = 0"), e)).select(R("top1"), R("mrr"))


@query(
    """WITH c AS (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS was FROM events WHERE value IS NOT NULL)
SELECT user_id, event_type, value AS price, ts AS start_ts, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS end_ts FROM c WHERE was IS NULL OR was <> value"""
)
def price_intervals(s, d):
    return history.intervals(t(s, d, "events"), ["user_id", "event_type"], "ts", "value", "event_id").drop("old_price")


@query(
    """WITH c AS (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS was FROM events WHERE value IS NOT NULL),
w AS (SELECT c_custkey AS property_id, CASE WHEN c_custkey % 2 = 0 THEN 20.0 END AS least, CASE WHEN c_custkey % 3 = 0 THEN 50.0 END AS told FROM customer),
j AS (SELECT user_id AS property_id, event_id, value AS price, coalesce(told, was) AS reference, least, told FROM c JOIN w ON user_id = w.property_id WHERE was <> value)
SELECT property_id, event_id, round((reference - price) * 100 / reference, 6) AS drop_pct FROM j WHERE reference <> 0 AND (reference - price) * 100 / reference >= coalesce(least, 5) AND NOT coalesce(abs(price - told) <= 0.001, false)"""
)
def price_drop_alerts(s, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    c = t(s, d, "events").where("value IS NOT NULL").withColumn("old_price", F.lag("value").over(w)).where("old_price <> value").select(F.col("user_id").alias("property_id"), "event_id", F.col("value").alias("price"), "old_price")
    k = F.col("c_custkey")
    watch = t(s, d, "customer").select(k.alias("property_id"), F.when(k % 2 == 0, 20.0).alias("min_drop_pct"), F.when(k % 3 == 0, 50.0).alias("last_notified_price"))
    return history.drops(c, watch).select("property_id", "event_id", R("drop_pct"))


@query("SELECT c_custkey AS id, price, kind AS listing_type FROM customer, LATERAL (SELECT o_totalprice AS price, o_orderstatus AS kind FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice, o_orderstatus LIMIT 1)")
def watch_lateral_top1(s, d):
    w = t(s, d, "customer").select(F.col("c_custkey").alias("property_id"))
    o = t(s, d, "orders").select(F.col("o_custkey").alias("property_id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("listing_type"))
    return history.watched_prices(w, o).select(F.col("property_id").alias("id"), "price", "listing_type")


@query(f"WITH {BASE} SELECT id, round(combined, 6) AS deal_score FROM base WHERE first_seen >= TIMESTAMP '1998-01-01' - INTERVAL 1000 DAY AND combined >= 0.3 ORDER BY combined DESC, first_seen DESC, id LIMIT 10")
def top_deals(s, d):
    return search.top_deals(base(s, d), F.lit("1998-01-01").cast("timestamp"), hours=24000, least=0.3).select("id", R("deal_score"))


@query(f"WITH {BASE} SELECT id, row_number() OVER (ORDER BY first_seen NULLS LAST, id) AS public_id FROM base")
def public_id(s, d):
    return search.public_ids(base(s, d).select("id", "first_seen")).select("id", "public_id")


@query("WITH g AS (SELECT event_type, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) AS gap FROM events) SELECT event_type AS stop_id, round(quantile_cont(gap, 0.5), 6) AS headway_s FROM g WHERE gap BETWEEN 1 AND 7200 GROUP BY 1 HAVING count(*) >= 3")
def headway_median(s, d):
    e = t(s, d, "events").select(F.col("event_type").alias("stop_id"), F.col("event_id").alias("trip_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("departure_s"))
    none = s.createDataFrame([], "trip_id long, headway_secs int")
    return quality.headways(e, none, least=1).select("stop_id", R("headway_s"))


@query(
    """WITH b AS (SELECT max(ts) AS t FROM events), g AS (SELECT count(*) AS n, arg_min(event_id, ts) AS a, arg_max(event_id, ts) AS z, epoch(max(ts)) - epoch(min(ts)) AS s FROM events, b WHERE ts >= t - INTERVAL 24 HOUR)
SELECT round(CASE WHEN n >= 2 AND z > a AND s >= 900 THEN (z - a) / (s / 86400) END, 6) AS per_day FROM g"""
)
def throughput_window(s, d):
    e = t(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("enriched_properties"))
    return coverage.throughput_per_day(e, F.lit(e.agg(F.max("ts")).first()[0])).select(R("per_day"))


@query("WITH b AS (SELECT max(ts) AS t FROM events) SELECT round(count(*) FILTER (ts > t - INTERVAL 300 SECOND) / 5.0, 1) AS per_minute, round(avg(value), 2) AS mean_duration, count(*) AS total FROM events, b")
def sliding_rate(s, d):
    e = t(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("duration"))
    return coverage.sliding_rate(e, F.lit(e.agg(F.max("ts")).first()[0]))


@query("SELECT time_bucket(INTERVAL 30 SECOND, ts) AS start_ts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_snapshot(s, d):
    e = t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.tumbling(e).withColumn("total", F.round("total", 4)).withColumn("start_ts", F.col("start_ts").cast("timestamp_ntz"))


@query("SELECT count(DISTINCT event_id) AS total, count(DISTINCT event_id) FILTER (json_type(p) = 'OBJECT' AND json_type(p->'k') <> 'NULL') AS k FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{\"k\": null}' ELSE props END::JSON AS p FROM events)")
def json_coverage(s, d):
    e = t(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit('{"k": null}')).otherwise(F.col("props")).alias("meta"))
    return coverage.signal_counts(e, "meta", ["k"], "event_id")


@query("SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def latency_summary(s, d):
    return coverage.latency_summary(t(s, d, "events"), ["event_type"], "value").select("event_type", "n", R("p50"), R("p95"), R("mean"))


@query("SELECT round(avg(CASE WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN (quality = toxic)::INT::DOUBLE END), 6) AS agreement, round(avg(toxic - quality), 6) AS mean_delta, round(avg(abs(toxic - quality)), 6) AS mean_abs_delta FROM labels")
def paired_agreement(s, d):
    y = t(s, d, "labels")
    side = lambda c: y.select("doc_id", F.col(c).alias("category"), F.col(c).alias("score"))
    return coverage.agreement(side("quality"), side("toxic"), "doc_id").select(R("agreement"), R("mean_delta"), R("mean_abs_delta"))


@query(
    """WITH r AS (SELECT coalesce(toxic = 1, false) AS bl, coalesce(quality = 0, false) AS qu, n_chars > 1000 AS en FROM documents LEFT JOIN labels USING (doc_id))
SELECT count(*) AS candidates, count(*) FILTER (bl) AS blocked, count(*) FILTER (NOT bl AND qu) AS quarantined, count(*) FILTER (NOT bl AND NOT qu AND NOT en) AS remaining, count(*) FILTER (NOT bl AND NOT qu) AS enrichable,
  round(count(*) FILTER (NOT bl AND NOT qu AND en) / count(*) FILTER (NOT bl AND NOT qu), 6) AS pct FROM r"""
)
def census_buckets(s, d):
    r = t(s, d, "documents").select("doc_id", "n_chars").join(t(s, d, "labels"), "doc_id", "left")
    return coverage.census(r.select((F.col("toxic") == 1).alias("blocked"), (F.col("quality") == 0).alias("quarantined"), (F.col("n_chars") > 1000).alias("enriched")))


@query(
    r"""WITH w AS (SELECT lang AS id, lower(unnest(string_split_regex(text, '\s+'))) AS flag FROM documents), n AS (SELECT id, flag, count(*) AS n FROM w WHERE flag <> '' GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, flag) AS rank FROM n) SELECT k.id, (SELECT count(*) FROM documents d WHERE d.lang = k.id) AS n_rows, flag, n, rank FROM k WHERE rank <= 5"""
)
def topn_flags(s, d):
    r = t(s, d, "documents").select(F.col("lang").alias("id"), F.split("text", r"\s+").alias("flags"))
    return quality.top_flags(r, "flags")


POINTS = "pts AS (SELECT event_id AS id, (event_id * 37 % 1000) / 20000.0 AS lon, (event_id * 91 % 1000) / 20000.0 AS lat FROM events)"


def points(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") * 37 % 1000 / 20000).alias("lon"), (F.col("event_id") * 91 % 1000 / 20000).alias("lat"))


@query(
    f"""WITH {POINTS}, a AS (SELECT * FROM pts WHERE id % 50 = 0) SELECT a.id, p.id AS r_id, round(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(p.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - a.lon) / 2), 2)))), 4) AS distance_m
FROM a, pts p WHERE 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(p.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - a.lon) / 2), 2)))) <= 150"""
)
def radius_match(s, d):
    p = points(s, d)
    right = p.select(F.col("id").alias("r_id"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    return geo.within_radius(p.where("id % 50 = 0"), right, 150, digits=4).select("id", "r_id", "distance_m")


@query(f"WITH {POINTS} SELECT p.id, n_nationkey AS area FROM pts p, nation WHERE lon BETWEEN n_nationkey * 0.002::DOUBLE AND n_nationkey * 0.002::DOUBLE + 0.003::DOUBLE AND lat BETWEEN 0.01::DOUBLE AND 0.02::DOUBLE")
def point_in_box(s, d):
    w = F.col("n_nationkey") * 0.002
    corner = lambda x, y: F.struct(x.alias("lon"), F.lit(y).alias("lat"))
    areas = t(s, d, "nation").select(F.col("n_nationkey").alias("area"), F.array(corner(w, 0.01), corner(w + 0.003, 0.01), corner(w + 0.003, 0.02), corner(w, 0.02)).alias("ring"))
    return geo.points_in_areas(points(s, d), areas, step=0.01).select("id", "area")


@query("WITH a AS (SELECT p_partkey AS id, lower(trim(p_name)) AS title, p_size::DOUBLE AS area, lower(p_brand) AS city FROM part WHERE p_size > 0) SELECT a.id, b.id AS r_id FROM a JOIN a b ON a.city = b.city AND a.id < b.id AND abs(a.area - b.area) <= 2 WHERE jaro_winkler_similarity(a.title, b.title) >= 0.8")
def fuzzy_title_dupes(s, d):
    p = t(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_size").cast("double").alias("area_m2"), F.col("p_brand").alias("city"))
    return resolve.corrected_duplicates(p, 0.8, 2.0).select("id", "r_id")


@query("SELECT n_name, r_name, levenshtein(n_name, r_name) AS distance, round(1 - levenshtein(n_name, r_name) / greatest(length(n_name), length(r_name)), 6) AS similarity FROM nation, region")
def levenshtein_pairs(s, d):
    pairs = t(s, d, "nation").crossJoin(F.broadcast(t(s, d, "region")))  # five rows
    return pairs.select("n_name", "r_name", F.levenshtein("n_name", "r_name").cast("long").alias("distance"), F.round(text.similarity(F.col("n_name"), F.col("r_name"), "levenshtein"), 6).alias("similarity"))


@query(
    r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[ \t\n\r]+')) AS name, generate_subscripts(string_split_regex(text, '[ \t\n\r]+'), 1) AS pos FROM documents)
SELECT lower(strip_accents(name)) AS key, arg_min(name, (doc_id, pos)) AS name FROM w WHERE name <> '' GROUP BY 1"""
)
def fold_distinct(s, d):
    # a document's words in order of their first places; document and place as one number
    w = t(s, d, "documents").select((F.col("doc_id").cast("decimal(20,0)") * 2**31).alias("doc"), F.posexplode(F.array_distinct(F.split("text", r"[ \t\n\r]+"))).alias("pos", "name"))
    return resolve.folded_names(w.select("name", (F.col("doc") + F.col("pos")).alias("at")), "name", "at")


@query(r"SELECT page_id, nullif(regexp_extract(url, '(\d{4,})(?:\.html?|/)?(?:[?#].*)?$', 1), '') AS listing_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages")
def page_extract(s, d):
    title = F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    return t(s, d, "pages").select("page_id", files.url_id(F.col("url")).alias("listing_id"), title.alias("title"))


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderkey % 3 > 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 2 = 0)
SELECT CASE WHEN o.k IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'kept' WHEN abs(o.p - n.p) < 1e-9 THEN 'unchanged' ELSE 'updated' END AS action, count(*) AS n FROM o FULL JOIN n USING (k) GROUP BY 1"""
)
def keyed_upsert(s, d):
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    new = o.where("k % 2 = 0").withColumn("p", F.when(F.col("k") % 5 == 0, F.col("p") + 1).otherwise(F.col("p")))
    return upserts.counts(upserts.diff(o.where("k % 3 > 0"), new, ["k"], F.abs(F.col("p") - F.col("n_p")) < 1e-9))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS v FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def insert_ignore(s, d):
    c = t(s, d, "customer").select(F.col("c_custkey").alias("k"))
    return upserts.insert_ignore(c.where("k % 2 = 0").withColumn("v", F.lit("old")), c.where("k % 3 = 0").withColumn("v", F.lit("new")), ["k"])


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW), 4) AS used FROM events")
def budget_60s(s, d):
    return history.rolling_sum(t(s, d, "events"), 60, ["user_id"], amount="value").select("event_id", F.round("used", 4).alias("used"))


@query(
    """WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'BH' WHEN o_orderkey % 5 = 0 THEN 'São João' ELSE 'Contagem' END AS city, CASE WHEN o_orderkey % 2 = 0 THEN 'MG' ELSE 'SP' END AS st, o_orderkey % 12 AS n FROM orders),
q AS (SELECT id, CASE WHEN city IS NULL THEN 'city_missing' WHEN city = 'Contagem' THEN 'city_not_allowed' WHEN st <> 'MG' THEN 'state_not_allowed' WHEN n < 8 THEN 'too_few_photos' END AS reason FROM r)
SELECT reason, count(*) AS n FROM q WHERE reason IS NOT NULL GROUP BY 1"""
)
def gate_reasons(s, d):
    k = F.col("o_orderkey")
    city = F.when(k % 7 == 0, None).when(k % 3 == 0, "BH").when(k % 5 == 0, "São João").otherwise("Contagem")
    state = F.when(k % 2 == 0, "MG").otherwise("SP")
    urls = F.when(k % 12 > 0, F.array_repeat(F.lit("u"), (k % 12).cast("int"))).otherwise(F.array().cast("array<string>"))
    rows = t(s, d, "orders").select(k.alias("id"), city.alias("city"), state.alias("state"), urls.alias("urls"))
    c, st = gates.city_state(F.col("city"), F.when(F.col("city").isNotNull(), F.col("state")), F.lit(None).cast("string"))
    return gates.reason_histogram(gates.gate(rows, gates.outside(c, st, ["Belo Horizonte", "SÃO JOÃO", " "], ["mg"]), gates.too_few_photos(F.col("urls"), gates.photos_needed())))


@query("SELECT user_id, event_type AS reason, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, event_type, run HAVING count(*) >= 2")
def breaker_runs(s, d):
    e = t(s, d, "events").withColumns({"reason": F.col("event_type"), "at": F.struct("ts", "event_id")})
    return history.tripped(e, 2, "user_id", "at").select("user_id", "reason", "n")


@query(
    """WITH RECURSIVE sent AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
  UNION ALL SELECT e.user_id, min(e.ts) FROM sent s JOIN events e ON e.user_id = s.user_id AND e.ts >= s.ts + INTERVAL 1 HOUR GROUP BY e.user_id, s.ts)
SELECT user_id AS property_id, epoch_us(ts) AS us FROM sent"""
)
def debounced_alerts(s, d):
    sent = history.debounced(t(s, d, "events").select(F.col("user_id").alias("property_id"), F.col("ts").cast("timestamp").alias("ts")))
    return sent.select("property_id", F.unix_micros("ts").alias("us"))


@query()
def entity_matches(s, d):
    """Parts as listings: every third is known, the others and each fifth of the known are resolved against them.

    Sixty parts stand some 220 m from the next sixty, at places 22 m apart, some at none; neither place nor rooms tell what is known, so that each step
    (key, distance, rooms, area, title, links) decides about rows.
    """
    k = F.col("p_partkey")
    at = F.floor(k / 60)
    lon, lat = 0.1 + at % 1000 / 500 + k % 4 / 5000, 0.1 + F.floor(at / 1000) / 500 + k % 5 / 5000
    p = t(s, d, "part").select(k.cast("string").alias("id"), F.col("p_brand").alias("platform"), k.cast("string").alias("platform_id"), F.col("p_name").alias("title"), F.col("p_size").cast("double").alias("area_m2"), (F.floor(k / 7) % 3).cast("int").alias("bedrooms"), F.lit(None).cast("int").alias("bathrooms"), F.lit(1).alias("parking"), F.when(k % 13 > 0, lon).alias("lon"), lat.alias("lat"), (k % 11 > 0).alias("active"))
    return resolve.match(p.where((k_mod("id") > 0) | (k_mod("id", 5) == 0)), p.where(k_mod("id") == 0))


def k_mod(c: str, n: int = 3):
    return F.col(c).cast("long") % n


FAR = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2))))"


@query(
    f"""WITH {POINTS}, places AS (SELECT DISTINCT lon, lat FROM pts), stops AS (SELECT lon, lat, CASE WHEN id % 2 = 0 THEN 1.0 ELSE 0.55 END::DOUBLE AS w FROM pts WHERE id % 7 = 0),
near AS (SELECT p.lon, p.lat, w, {FAR} AS m FROM places p JOIN stops q ON q.lat BETWEEN p.lat - 0.0109 AND p.lat + 0.0109 WHERE {FAR} <= 1200),
got AS (SELECT lon, lat, max((1 - m / 1200) * w) AS best, sum(CASE WHEN m <= 400 THEN w ELSE 0 END) AS close, count(*) AS n FROM near GROUP BY lon, lat)
SELECT id, round(CASE WHEN best IS NULL THEN 0 ELSE greatest(0, least(1, 0.7 * greatest(best, 0) + 0.3 * least(1, close / 8))) END, 6) AS transit_score, coalesce(n, 0) AS n_stops FROM pts LEFT JOIN got USING (lon, lat)"""
)
def transit_scores(s, d):
    """Every point is a centroid; each seventh plays a stop too."""
    p = points(s, d)
    stops = p.where("id % 7 = 0").withColumn("mode", F.when(F.col("id") % 2 == 0, "metro").otherwise("bus"))
    return quality.transit_scores(p, stops).select("id", R("transit_score"), "n_stops")


@query("SELECT a.n_nationkey AS id, b.n_nationkey AS r_id FROM nation a, nation b WHERE b.n_nationkey * 0.25 <= a.n_nationkey * 0.5 + 0.75 AND b.n_nationkey * 0.25 + 0.5 >= a.n_nationkey * 0.5 AND b.n_nationkey % 3 <= a.n_nationkey % 4 + 1 AND b.n_nationkey % 3 + 0.5 >= a.n_nationkey % 4")
def area_overlaps(s, d):
    k = F.col("n_nationkey")
    box = lambda x, y, w, h: F.array(*[F.struct((x + i).cast("double").alias("lon"), (y + j).cast("double").alias("lat")) for i, j in ((0.0, 0.0), (w, 0.0), (w, h), (0.0, h))])
    n = t(s, d, "nation")
    pairs = geo.areas_meeting(n.select(k.alias("id"), box(k * 0.5, k % 4, 0.75, 1.0).alias("ring")), n.select(k.alias("r_id"), box(k * 0.25, k % 3, 0.5, 0.5).alias("r_ring")), step=0.6)
    return pairs.select("id", "r_id")


def raw_orders(s: SparkSession, d: str, record: dict[str, str]) -> DataFrame:
    """Orders as a portal's JSON: the fields' SQL expressions by name; fields that are null aren't there."""
    return t(s, d, "orders").select("o_orderkey", F.to_json(F.struct(*[F.expr(v).alias(k) for k, v in record.items()])).alias("raw"))


PRICED = """SELECT platform_id, price, rent, sale, fee, reason FROM (SELECT *, CASE WHEN rent > 0 THEN rent WHEN sale > 0 THEN sale END AS price, CASE WHEN coalesce(rent, 0) <= 0 AND coalesce(sale, 0) <= 0 THEN 'no_price' END AS reason FROM r)"""


def priced(rows: DataFrame) -> DataFrame:
    of = lambda kind: F.round(F.get(F.filter("listings", lambda x: x.listing_type == kind), F.lit(0)).price, 4).alias("rent" if kind == "rent" else "sale")
    return rows.select("platform_id", F.round("price", 4).alias("price"), of("rent"), of("sale"), F.round(F.get("listings", F.lit(0)).condo_fee, 4).alias("fee"), "reason")


@query(
    f"""WITH o AS (SELECT o_orderkey::VARCHAR AS platform_id, o_orderkey AS k, o_totalprice AS p FROM orders),
q AS (SELECT platform_id, CASE WHEN k % 3 = 0 THEN p ELSE 0 END AS part, CASE WHEN k % 5 = 0 THEN p * 100 ELSE 0 END AS sale, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN p + 250 END AS total, CASE WHEN k % 7 = 0 AND k % 3 = 0 THEN 300.0 END AS condo FROM o),
t AS (SELECT *, coalesce(total, part + coalesce(condo, 0)) AS all_in FROM q),
r AS (SELECT platform_id, CASE WHEN all_in > 0 THEN round(all_in, 4) END AS rent, CASE WHEN sale > 0 THEN round(sale, 4) END AS sale, CASE WHEN all_in > 0 OR sale > 0 THEN round(CASE WHEN condo IS NULL AND part > 0 AND all_in > part THEN round(all_in - part, 2) ELSE condo END, 4) END AS fee FROM t)
{PRICED}"""
)
def records_totals(s, d):
    k = "o_orderkey"
    raw = raw_orders(s, d, {"id": k, "rentPrice": f"CASE WHEN {k} % 3 = 0 THEN o_totalprice END", "salePrice": f"CASE WHEN {k} % 5 = 0 THEN o_totalprice * 100 END", "totalCost": f"CASE WHEN {k} % 2 = 0 AND {k} % 3 = 0 THEN o_totalprice + 250 END", "condoFee": f"CASE WHEN {k} % 7 = 0 AND {k} % 3 = 0 THEN 300.0D END"})
    return priced(records.from_totals(raw, "https://portal.example"))


@query(
    f"""WITH o AS (SELECT o_orderkey::VARCHAR AS platform_id, o_orderkey AS k, o_totalprice AS p FROM orders),
r AS (SELECT platform_id, CASE WHEN k % 3 = 0 THEN round(p, 4) END AS rent, CASE WHEN k % 5 = 0 THEN round(p * 100, 4) END AS sale, CASE WHEN k % 3 = 0 THEN 120.0 WHEN k % 5 = 0 THEN 80.0 END AS fee FROM o) {PRICED}"""
)
def records_sides(s, d):
    k = "o_orderkey"
    raw = raw_orders(s, d, {"id": k, "prices": f"named_struct('rental', CASE WHEN {k} % 3 = 0 THEN named_struct('value', o_totalprice, 'condominium', '120') END, 'sale', CASE WHEN {k} % 5 = 0 THEN named_struct('value', string(o_totalprice * 100), 'condominium', '80') END)"})
    return priced(records.from_sides(raw, "https://portal.example"))


@query(
    f"""WITH o AS (SELECT o_orderkey::VARCHAR AS platform_id, o_orderkey AS k, (o_orderkey % 900 + 100)::DOUBLE AS p FROM orders),
r AS (SELECT platform_id, CASE WHEN k % 4 = 0 THEN p + 50 END AS rent, CASE WHEN k % 4 <> 0 AND k % 4 <> 3 THEN p * 1000 END AS sale, CASE WHEN k % 4 <> 3 THEN 50.0 END AS fee FROM o) {PRICED}"""
)
def records_labels(s, d):
    k = "o_orderkey"
    raw = raw_orders(s, d, {"listId": k, "subject": f"CASE WHEN {k} % 4 = 0 THEN 'Alugo casa' ELSE 'Casa em Venda Nova' END", "price": f"CASE WHEN {k} % 4 = 0 THEN concat('R$ ', {k} % 900 + 100, ',00') WHEN {k} % 4 < 3 THEN concat('R$ ', {k} % 900 + 100, '.000') END", "properties": "array(named_struct('label', 'Condomínio', 'value', 'R$ 50'))"})
    return priced(records.from_labels(raw, "https://portal.example"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 4 AND o_orderkey % 3 > 0 AND o_orderkey % 4 > 0 THEN 'Not enough data for a deal verdict' ELSE
  concat_ws(' — ', nullif(list_extract(l, 1), ''), nullif(array_to_string(list_slice(l, 2, 9), ', '), '')) END AS verdict FROM (SELECT o_orderkey, list_filter([
    CASE o_orderkey % 5 WHEN 0 THEN 'Highly undervalued' WHEN 1 THEN 'Slightly undervalued' WHEN 2 THEN 'Priced near the neighbourhood average' WHEN 3 THEN 'strange' END,
    CASE WHEN o_orderkey % 3 = 0 THEN 'needs renovation' END, CASE WHEN o_orderkey % 4 = 0 THEN 'neighbourhood quality ' || (o_orderkey % 100) || '%' END,
    CASE WHEN o_orderkey % 4 = 0 THEN '1 neighbourhood risk (flood)' END], lambda x: x IS NOT NULL) AS l FROM orders)"""
)
def verdict_texts(s, d):
    k = F.col("o_orderkey")
    band = F.when(k % 5 == 0, "Highly Undervalued").when(k % 5 == 1, "slightly_undervalued").when(k % 5 == 2, "Average").when(k % 5 == 3, "strange")
    some = lambda c: F.when(k % 4 == 0, c)
    none = F.lit(None).cast("array<string>")
    said = verdict.verdict(band, F.when(k % 3 == 0, "Needs Renovation"), some(k % 100 / 100), some(F.array(F.lit("flood"))), F.lit(False), none, none)
    return t(s, d, "orders").select(k.alias("id"), said.alias("verdict"))


@query("SELECT count(*) AS active, count(*) FILTER (p_name <> '' AND p_partkey % 3 > 0) AS with_text, count(*) FILTER (p_size > 25) AS embedded, count(*) FILTER (p_name <> '' AND p_partkey % 3 > 0 AND p_size <= 25) AS missing FROM part WHERE p_partkey % 2 = 0")
def backlog_counts(s, d):
    k = F.col("p_partkey")
    p = t(s, d, "part").select(F.when(k % 3 > 0, F.col("p_name")).otherwise(" ").alias("title"), F.lit(None).cast("string").alias("description"), F.when(F.col("p_size") > 25, F.array(F.lit(1.0))).alias("embedding"), (k % 2 == 0).alias("active"))
    return coverage.backlog(p)


@query(
    """WITH c AS (SELECT count(DISTINCT doc_id) AS total, count(DISTINCT CASE WHEN n_chars > 1000 THEN doc_id END) AS long FROM documents)
SELECT 'long' AS signal, long AS enriched, total, round(long / total, 6) AS fraction, total - long AS remaining, 7.0 AS per_day, round((total - long) / 7.0::DOUBLE, 2) AS eta_days, DATE '2026-01-01' + ceil((total - long) / 7.0::DOUBLE)::INT AS done_on FROM c"""
)
def coverage_progress(s, d):
    c = t(s, d, "documents").agg(F.count_distinct("doc_id").alias("total"), F.count_distinct(F.when(F.col("n_chars") > 1000, F.col("doc_id"))).alias("long"))
    return coverage.progress(c, ["long"], F.lit("2026-01-01").cast("date"), F.lit(True), F.col("total") - F.col("enriched"), F.lit(7.0))


@query(f"WITH {BASE} SELECT id, first_seen FROM base WHERE id % 3 = 0 AND (id % 9 = 0 OR first_seen < TIMESTAMP '1996-01-01') ORDER BY CASE WHEN id % 9 = 0 THEN NULL ELSE first_seen END NULLS FIRST, id LIMIT 50")
def probe_queue(s, d):
    k = F.col("id")
    b = base(s, d).select("id", "first_seen", (k % 3 == 0).alias("active"), F.lit("u").alias("url"), F.when(k % 9 > 0, F.col("first_seen")).alias("last_seen"))
    return coverage.probe_order(b, F.lit("1996-01-01").cast("timestamp"), 50).select("id", "first_seen")


@query("SELECT l_orderkey AS property_id, bool_or(l_linenumber > 3) AS active FROM lineitem GROUP BY 1")
def still_active(s, d):
    return upserts.still_active(t(s, d, "lineitem").select(F.col("l_orderkey").alias("property_id"), (F.col("l_linenumber") > 3).alias("active")))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retained_rows(s, d):
    e = t(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return upserts.retained(e, F.lit(e.agg(F.max("ts")).first()[0]), 7).select("event_id")


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 = 0 THEN o_custkey // 2 ELSE o_custkey END AS property_id FROM orders")
def moved_children(s, d):
    k = F.col("c_custkey")
    merges = t(s, d, "customer").where(k % 4 == 0).select(k.alias("orphan"), (k / 2).cast("long").alias("keeper"))
    return upserts.moved(t(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("long").alias("property_id")), merges)


@query("SELECT l_partkey AS id, min(l_extendedprice) FILTER (l_returnflag = 'R') AS rent_price, min(l_extendedprice) FILTER (l_returnflag <> 'R') AS sale_price FROM lineitem GROUP BY 1")
def merged_windows(s, d):
    kind = F.when(F.col("l_returnflag") == "R", "rent").otherwise("sale")
    return resolve.merged_windows(t(s, d, "lineitem").select(F.col("l_partkey").alias("id"), kind.alias("listing_type"), F.col("l_extendedprice").alias("price")))


@query("SELECT k, min(event_id) AS event_id FROM (SELECT CASE WHEN user_id % 3 > 0 THEN user_id END AS k, event_id FROM events) WHERE k IS NOT NULL GROUP BY k UNION ALL SELECT NULL, event_id FROM events WHERE user_id % 3 = 0")
def unique_first(s, d):
    k = F.when(F.col("user_id") % 3 > 0, F.col("user_id"))
    return resolve.unique_by(t(s, d, "events").select(k.alias("k"), "event_id"), "k", "event_id")


@query(
    f"""WITH p AS (SELECT s_suppkey AS id, s_nationkey % 5 AS city, (s_suppkey % 97) / 500.0::DOUBLE AS lon, (s_suppkey % 89) / 500.0::DOUBLE AS lat FROM supplier),
q AS (SELECT n_regionkey AS city, n_name AS hub, n_nationkey / 200.0::DOUBLE AS lon, n_nationkey / 300.0::DOUBLE AS lat FROM nation WHERE n_regionkey < 4),
m AS (SELECT p.id, q.hub, {FAR} / 1000 / 30.0 * 60 AS minutes FROM p JOIN q USING (city))
SELECT id, round(min(minutes), 6) AS minutes, round(greatest(0, least(1, 1 - min(minutes) / 45)), 6) AS access_score FROM m GROUP BY id"""
)
def access_scores(s, d):
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    c = t(s, d, "supplier").select(k.alias("id"), (F.col("s_nationkey") % 5).cast("string").alias("city"), (k % 97 / 500).alias("lon"), (k % 89 / 500).alias("lat"))
    hubs = t(s, d, "nation").where("n_regionkey < 4").select(F.col("n_regionkey").cast("string").alias("city"), F.col("n_name").alias("name"), (n / 200).alias("lon"), (n / 300).alias("lat"))
    return quality.access_scores(c, hubs).select("id", R("minutes"), R("access_score"))


@query("SELECT lower(n_name) AS key, n_name AS name, sum(s_suppkey + 0.5)::DOUBLE AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def crime_totals(s, d):
    """Amounts with a decimal comma, names spelt two ways; the first spelling stays."""
    r = t(s, d, "supplier").join(t(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    first = F.row_number().over(Window.partitionBy("n_name").orderBy("s_suppkey"))
    name = F.when(F.col("row_nth") == 1, F.col("n_name")).otherwise(F.concat(F.lit(" "), F.lower("n_name")))
    return quality.crime_extract(r.withColumn("row_nth", first).select(name.alias("name"), F.concat(F.col("s_suppkey").cast("string"), F.lit(",5")).alias("amount"), "row_nth"))


@query(
    """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'skip_mode' WHEN o_orderkey % 3 = 0 THEN 'skip_images' WHEN o_orderkey % 5 = 0 THEN 'skip_photos' WHEN o_orderkey % 7 = 0 THEN 'skip_prior' ELSE 'queue' END AS action, count(*) AS n
FROM orders GROUP BY 1"""
)
def rerun_actions(s, d):
    k = F.col("o_orderkey")
    action = gates.rerun_action(k % 2 == 0, "missing", F.lit(False), k % 3, True, k % 5 > 0, k % 7 > 0)
    return t(s, d, "orders").groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH ok AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_id % 9 = 0 GROUP BY 1)
SELECT e.user_id AS id, count(*) AS attempts FROM events e LEFT JOIN ok USING (user_id) WHERE event_id % 9 > 0 AND (last IS NULL OR event_id > last) GROUP BY 1 HAVING count(*) >= 3"""
)
def quarantine(s, d):
    return history.quarantined(t(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ts"), (F.col("event_id") % 9 == 0).alias("ok")), 3)


@query("SELECT round(sum(p50), 6) AS per_row_s, round(26000 * sum(p50) / 2 / 3600, 6) AS hours, 78000 AS requests, ceil(78000 / 14000.0)::BIGINT AS days FROM (SELECT quantile_cont(value, 0.5) AS p50 FROM events GROUP BY event_type)")
def enrichment_feasibility(s, d):
    f = coverage.feasibility(coverage.latency_summary(t(s, d, "events"), ["event_type"], "value"), 26_000, 2, 3, 14_000)
    return f.select(R("per_row_s"), R("hours"), "requests", F.col("days").cast("long").alias("days"))


@query(
    """WITH r AS (SELECT *, min(s_acctbal) OVER w AS lo, max(s_acctbal) OVER w AS hi, max(s_suppkey) OVER (PARTITION BY s_nationkey, s_suppkey % 3) AS last FROM supplier WINDOW w AS (PARTITION BY s_nationkey)),
x AS (SELECT s_nationkey AS n, s_suppkey % 3 AS k, CASE WHEN hi = lo THEN 0.5 ELSE 1 - (s_acctbal - lo) / (hi - lo) END AS score FROM r WHERE s_suppkey = last)
SELECT c_custkey AS id, round(score, 6) AS safety_score FROM customer JOIN x ON c_nationkey = n AND c_custkey % 3 = k"""
)
def safety_by_name(s, d):
    """Rates of suppliers, three names in each nation, the last row of a name counts; customers are the neighbourhoods."""
    name = lambda k: F.element_at(F.array(F.lit("São José"), F.lit("Centro"), F.lit("Água")), (F.col(k) % 3 + 1).cast("int"))
    rates = t(s, d, "supplier").select(F.lower(name("s_suppkey")).alias("name"), F.col("s_nationkey").cast("string").alias("city"), F.lit("mg").alias("state"), F.col("s_acctbal").alias("rate_per_100k"), F.col("s_suppkey").alias("row_nth"))
    n = t(s, d, "customer").select(F.col("c_custkey").alias("id"), name("c_custkey").alias("name"), F.col("c_nationkey").cast("string").alias("city"), F.lit("MG").alias("state"))
    return quality.safety_scores(n, rates).select("id", R("safety_score"))


@query(
    """WITH c AS (SELECT c_custkey AS id, n_name AS nb, n_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT id, CASE WHEN id % 5 = 0 THEN -1 WHEN n % 4 = 0 OR id % 3 = 0 OR id % 2 = 0 THEN n ELSE -1 END AS neighborhood_id FROM c"""
)
def assigned_by_name(s, d):
    """Customers lie in quarters named like nations: every fifth has no name, a third no city, half of the rest the wrong one."""
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    name = F.when(k % 5 > 0, F.concat(F.lit(" "), F.lower("n_name"))).otherwise(" ")
    city = F.when(k % 3 == 0, None).when(k % 2 == 0, F.concat(F.lit("SÃO "), F.col("n_regionkey"))).otherwise("elsewhere")
    p = t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == n).select(k.alias("id"), name.alias("neighborhood"), city.alias("city"), F.lit(-1).cast("long").alias("neighborhood_id"))
    areas = t(s, d, "nation").select(n.cast("long").alias("area_id"), F.col("n_name").alias("name"), F.when(n % 4 > 0, F.concat(F.lit("são "), F.col("n_regionkey"))).alias("city"))
    return location.assigned_by_name(p, areas).select("id", "neighborhood_id")


@query(
    """SELECT CASE k WHEN 0 THEN 'corrected' WHEN 2 THEN 'out_of_geo' WHEN 3 THEN 'corrected' ELSE 'unchanged' END AS action,
  CASE k WHEN 2 THEN 'Cabo Frio' WHEN 3 THEN 'Belo Horizonte' ELSE 'BH' END AS city, CASE k WHEN 0 THEN 'Itapoã' WHEN 3 THEN 'Savassi' WHEN 4 THEN NULL ELSE 'Savassi' END AS neighborhood,
  CASE k WHEN 0 THEN 'Itapoã, BH, MG' WHEN 2 THEN 'Savassi, Cabo Frio, MG' WHEN 3 THEN 'Savassi, Belo Horizonte, MG' ELSE 'Rua 1' END AS address,
  CASE k WHEN 0 THEN 'neighborhood_mismatch' WHEN 2 THEN 'city_not_allowed:Cabo Frio' WHEN 3 THEN 'neighborhood_is_city' WHEN 4 THEN 'neighborhood_missing' ELSE 'ok' END AS reason, k IN (0, 2, 3) AS clear_coords, count(*) AS n
FROM (SELECT o_orderkey % 6 AS k FROM orders) GROUP BY ALL"""
)
def reconciled_places(s, d):
    """Orders as listings of six kinds: named quarter, nothing said, city elsewhere, city as quarter, no quarter, no text."""
    k = F.col("o_orderkey") % 6
    title = F.when(k == 0, "Cobertura no Itapoã").when(k == 1, "Casa").when(k == 2, "Vendo casa em Cabo Frio").when(k == 3, "Apto na savassi").when(k == 4, "Casa boa")
    nb = F.when(k == 3, "Contagem").when(k != 4, "Savassi")
    rows = t(s, d, "orders").select(title.alias("title"), F.lit(None).cast("string").alias("description"), F.lit("BH").alias("city"), F.lit("MG").alias("state"), nb.alias("neighborhood"), F.lit("Rua 1").alias("address"))
    out = location.reconciled(rows, ["Belo Horizonte", "Contagem"], ["MG"], ["Centro", "Savassi", "Itapoã"])
    return out.groupBy(*[F.col(f"located.{c}").alias(c) for c in ("action", "city", "neighborhood", "address", "reason", "clear_coords")]).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH p AS (SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 3 > 0 THEN (s_suppkey % 10) / 10.0::DOUBLE END AS a, CASE WHEN s_suppkey % 7 < 6 THEN (s_suppkey % 7) / 5.0::DOUBLE END AS b FROM supplier),
q AS (SELECT id, a, CASE WHEN b <= 1 THEN b END AS b FROM p)
SELECT id, round(coalesce((coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0), 0.5), 6) AS score, CASE WHEN id::BIGINT % 2 = 0 THEN 1 ELSE 0 END AS flags, CASE WHEN id::BIGINT % 4 = 0 THEN 'quiet' END AS notes FROM q"""
)
def quality_profiles(s, d):
    k, none = F.col("s_suppkey"), F.lit(None).cast("double")
    flags = F.when(k % 2 == 0, F.array(F.lit(" flood "), F.lit(" "), F.lit(None).cast("string")))
    areas = t(s, d, "supplier").select(k.alias("id"), F.when(k % 3 > 0, k % 10 / 10).alias("amenity_score"), (k % 7 / 5).alias("transit_score"), none.alias("access_score"), F.lit(-0.1).alias("safety_score"), flags.alias("risk_flags"), F.when(k % 4 == 0, " quiet ").otherwise(" ").alias("quality_notes"))
    return search.quality_profile(areas).select("id", F.round("neighbourhood_score", 6).alias("score"), F.size("risk_flags").alias("flags"), F.col("quality_notes").alias("notes"))


#: Word pairs of the benchmark's passages, which are a fixed set, as a catalogue in order of their first places.
PAIRS = """ps AS (SELECT name, row_number() OVER (ORDER BY first) - 1 AS i FROM (SELECT w[i] || ' ' || w[i + 1] AS name, min((item_id, i)) AS first
  FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark)) GROUP BY 1)),
pf AS (SELECT i, name, lower(name) AS f FROM ps)"""


def word_pairs(s: SparkSession, d: str) -> list[str]:
    words = t(s, d, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w")).where("size(w) > 1")
    pairs = words.select("item_id", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("i")).select(F.expr("concat_ws(' ', w[i - 1], w[i])").alias("name"), "item_id", "i")
    return [r.name for r in pairs.groupBy("name").agg(F.min(F.struct("item_id", "i")).alias("first")).orderBy("first").collect()]


@query(
    f"""WITH {PAIRS}, d AS (SELECT doc_id, lower(strip_accents(coalesce(text, ''))) AS f FROM documents)
SELECT doc_id, (SELECT name FROM ps WHERE ps.i = m) AS mentioned FROM (SELECT doc_id, min(i) AS m FROM d LEFT JOIN pf ON length(pf.f) >= 4 AND contains(d.f, pf.f) GROUP BY doc_id)"""
)
def catalogue_mentions(s, d):
    """The first word pair of the benchmark that stands in a document, accents aside."""
    return location.mentions(t(s, d, "documents"), "text", word_pairs(s, d)).select("doc_id", "mentioned")


@query(
    f"""WITH {PAIRS}, u AS (SELECT conv_id, turn, lower(strip_accents(regexp_extract(text, '[A-Za-z]+( [A-Za-z]+)?'))) AS f FROM conversations)
SELECT conv_id, turn, (SELECT name FROM ps WHERE ps.i = m) AS known FROM (SELECT conv_id, turn, min(i) AS m FROM u LEFT JOIN pf ON length(u.f) >= 3 AND (contains(u.f, pf.f) OR contains(pf.f, u.f)) GROUP BY conv_id, turn)"""
)
def catalogue_tokens(s, d):
    """The first word pair of the benchmark that equals, holds or lies in a turn's first words."""
    names = location.catalogue(t(s, d, "benchmark"), word_pairs(s, d))
    head = text.fold(F.regexp_extract("text", "[A-Za-z]+( [A-Za-z]+)?", 0))
    return t(s, d, "conversations").select("conv_id", "turn", names.known(head).alias("known"))


@query(
    """SELECT page_id, 2::BIGINT AS n_ads, (page_id + 1) || ',x' AS ids, url || ' \\ "q" ]} é' AS title FROM pages WHERE url IS NOT NULL AND html IS NOT NULL"""
)
def pushed_page_ads(s, d):
    """Ads that each page pushes behind its own text, cut in two at a place of the page's, inside an escape or a string too."""
    title = F.concat("url", F.lit(' \\ "q" ]} é'))
    ads = F.concat(F.lit('5:{"before":[1],"ads":[{"listId":'), (F.col("page_id") + 1).cast("string"), F.lit(',"title":'), F.substring(F.to_json(F.struct(title.alias("t"))), 6, 1_000_000), F.lit(',{"advertisingId":1},7,{"id":"x"},{"title":"no id"}],"after":"]"}'))
    pages = t(s, d, "pages").where("url IS NOT NULL AND html IS NOT NULL").withColumn("text", ads)
    script = lambda c: F.concat(F.lit('<script>self.__next_f.push([1,"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"])</script>'))
    at = (F.col("page_id") % F.length("text") + 1).cast("int")
    html = F.concat("html", script(F.substring(F.col("text"), F.lit(1), at)), script(F.substring(F.col("text"), at + 1, F.length("text"))))
    found = flight.with_ads(pages.select("page_id", html.alias("html"))).select("page_id", "ads")
    ids = F.array_join(F.transform("ads", lambda a: F.coalesce(F.get_json_object(a, "$.listId"), F.get_json_object(a, "$.id"))), ",")
    return found.select("page_id", F.size("ads").cast("long").alias("n_ads"), ids.alias("ids"), F.get_json_object(F.get("ads", F.lit(0)), "$.title").alias("title"))


@query(
    """WITH RECURSIVE r AS (SELECT event_type AS k, event_id AS id, epoch_us(ts) AS t0, 1 + event_id % 5 AS need, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nth FROM events),
l AS (SELECT k, id, t0, need, nth, t0 AS start, [{'t': t0, 'n': need}] AS open FROM r WHERE nth = 1
  UNION ALL SELECT k, id, t0, need, nth, start, list_append(list_filter(open, lambda o: o.t > start - 3600000000), {'t': start, 'n': need}) FROM (
    SELECT r.*, l.open, list_min(list_filter(list_append(list_transform(l.open, lambda o: o.t + 3600000000), greatest(r.t0, l.start)), lambda c: c >= greatest(r.t0, l.start)
      AND coalesce(list_sum(list_transform(list_filter(l.open, lambda o: o.t > c - 3600000000), lambda o: o.n)), 0) + r.need <= 9)) AS start
    FROM l JOIN r ON r.k = l.k AND r.nth = l.nth + 1))
SELECT id AS event_id, (start - t0)::BIGINT AS wait_us FROM l"""
)
def budget_waits(s, d):
    """Each event asks for one to five units of its type's nine an hour; the SQL lets them in one after the other."""
    e = t(s, d, "events").select(F.col("event_type").alias("platform"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (1 + F.col("event_id") % 5).alias("need"))
    return history.launches(e, 9, seconds=3600).select(F.col("id").alias("event_id"), F.col("wait").alias("wait_us"))


DIAMONDS = """q AS (SELECT p.id, n_nationkey AS area, abs(lon - (n_nationkey * 0.002::DOUBLE + 0.001::DOUBLE)) AS u, abs(lat - 0.015::DOUBLE) AS v, 40 / (111320.0 * cos(radians(0.015::DOUBLE))) AS reach FROM pts p, nation)"""


def diamonds(s: SparkSession, d: str) -> DataFrame:
    x = F.col("n_nationkey") * 0.002 + 0.001
    corner = lambda dx, dy: F.struct((x + dx).alias("lon"), F.lit(0.015 + dy).alias("lat"))
    turned = lambda r: F.array(corner(-r, 0.0), corner(0.0, -r), corner(r, 0.0), corner(0.0, r))
    square = lambda h: F.array(corner(-h, -h), corner(h, -h), corner(h, h), corner(-h, h))
    return t(s, d, "nation").select(F.col("n_nationkey").alias("area"), turned(0.00332).alias("ring"), F.array(square(0.00072)).alias("holes"))


@query(
    f"""WITH {POINTS}, {DIAMONDS}, f AS (SELECT *, greatest(0, least(0.00332::DOUBLE, (v - u + 0.00332::DOUBLE) / 2)) AS t FROM q)
SELECT id, area FROM f WHERE u + v <= 0.00332::DOUBLE OR sqrt(pow(u - (0.00332::DOUBLE - t), 2) + pow(v - t, 2)) <= reach"""
)
def buffered_points(s, d):
    """Points in diamonds or within 40 m of them."""
    return geo.points_near_areas(points(s, d), diamonds(s, d).drop("holes"), 40, step=0.01).select("id", "area")


@query(f"WITH {POINTS}, {DIAMONDS} SELECT id, area FROM q WHERE u + v <= 0.00332::DOUBLE AND NOT (u < 0.00072::DOUBLE AND v < 0.00072::DOUBLE)")
def points_outside_holes(s, d):
    """Points in diamonds with a square hole."""
    return geo.points_near_areas(points(s, d), diamonds(s, d), 0, step=0.01).select("id", "area")


@query(
    """WITH c AS (SELECT o_orderkey AS id, [o_orderkey % 7, o_orderkey % 11, o_custkey % 7, o_custkey % 11, o_orderkey % 13, o_custkey % 13, (o_orderkey + o_custkey) % 7, (o_orderkey + o_custkey) % 5] AS v FROM orders),
e AS (SELECT id, i, v[2 * i + 1] AS ax, v[2 * i + 2] AS ay, v[2 * ((i + 1) % 4) + 1] AS bx, v[2 * ((i + 1) % 4) + 2] AS b_y FROM c, (SELECT unnest([0, 1, 2, 3]) AS i)),
ok AS (SELECT id FROM e GROUP BY id HAVING bool_and(ax <> bx OR ay <> b_y)),
p AS (SELECT e.id, e.i, f.i AS j, e.ax, e.ay, e.bx, e.b_y, f.ax AS cx, f.ay AS cy, f.bx AS dx, f.b_y AS dy,
  sign((e.bx - e.ax) * (f.ay - e.ay) - (e.b_y - e.ay) * (f.ax - e.ax)) AS sc, sign((e.bx - e.ax) * (f.b_y - e.ay) - (e.b_y - e.ay) * (f.bx - e.ax)) AS sd,
  sign((f.bx - f.ax) * (e.ay - f.ay) - (f.b_y - f.ay) * (e.ax - f.ax)) AS sa, sign((f.bx - f.ax) * (e.b_y - f.ay) - (f.b_y - f.ay) * (e.bx - f.ax)) AS sb FROM e JOIN e f ON e.id = f.id AND e.i < f.i),
bad AS (SELECT DISTINCT id FROM p WHERE CASE WHEN j - i = 2 THEN (sc * sd <= 0 AND sa * sb <= 0 AND greatest(ax, bx) >= least(cx, dx) AND greatest(cx, dx) >= least(ax, bx) AND greatest(ay, b_y) >= least(cy, dy) AND greatest(cy, dy) >= least(ay, b_y))
  ELSE sc = 0 AND sd = 0 AND (bx - ax) * (dx - cx) + (b_y - ay) * (dy - cy) < 0 END)
SELECT id, id NOT IN (FROM bad) AS valid FROM ok"""
)
def ring_validity(s, d):
    """Four corners from each order's numbers; those with a repeated corner are left out, as the SQL has no rule for them."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    corner = lambda x, y: F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    rings = t(s, d, "orders").select(k.alias("id"), F.array(corner(k % 7, k % 11), corner(c % 7, c % 11), corner(k % 13, c % 13), corner((k + c) % 7, (k + c) % 5)).alias("ring"))
    apart = F.forall(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get("ring", i) != F.get("ring", (i + 1) % 4))
    return geo.with_validity(rings.where(apart)).select("id", "valid")


@query(
    """SELECT l_orderkey AS id, coalesce(count(*) FILTER (l_extendedprice BETWEEN 10000 AND 50000 AND l_extendedprice > 0) / nullif(count(*) FILTER (l_extendedprice > 0), 0) >= 0.5, false) AS holds FROM lineitem GROUP BY 1"""
)
def price_band_holds(s, d):
    return t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(flight.band_holds(F.col("l_extendedprice"), 10_000, 50_000).alias("holds"))


@query(
    """WITH p AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 14) AS nth, (l_partkey % 14)::INT AS n, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem), q AS (SELECT * FROM p WHERE nth <= 3),
b AS (SELECT id, min(least(c, 3)) AS c, min(nth) FILTER (n < 10) AS bad FROM q GROUP BY 1), e AS (SELECT b.id, coalesce(b.bad - CASE WHEN q.n = 0 THEN 1 ELSE 0 END, b.c) AS pages, b.bad FROM b LEFT JOIN q ON q.id = b.id AND q.nth = b.bad)
SELECT e.id, e.pages, coalesce((SELECT sum(n) FROM q WHERE q.id = e.id AND q.nth <= e.pages), 0)::BIGINT AS n_rows, e.bad IS NULL AND e.pages = 3 AS saturated FROM e"""
)
def window_pages(s, d):
    """Lines as pages of 0 to 13 rows, three read at most."""
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 14).cast("int").alias("n")))), lambda x: x.n)
    w = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(sizes.alias("sizes")).select("id", flight.pages_read(F.col("sizes"), 3).alias("w"))
    return w.select("id", F.col("w.pages").cast("long").alias("pages"), F.col("w.rows").cast("long").alias("n_rows"), "w.saturated")


RERUNS = """p AS (SELECT o_orderkey AS id, o_orderkey % 11 <> 0 AS active, o_orderstatus AS platform, o_custkey % 25 AS area_id, CASE WHEN o_orderkey % 8 = 0 THEN '{}' WHEN o_orderkey % 9 = 0 THEN '[]' ELSE '["a", " ", null' || repeat(', "b"', (o_orderkey % 4)::INT) || ']' END AS urls FROM orders),
m AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 4 = 1 THEN NULL ELSE value END AS ai_score, event_id % 3 > 0 AS sentiment, event_id % 5 = 2 AS no_verdict, ts - CASE WHEN event_id % 2 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS moment, event_id % 7 = 0 AS undated FROM events),
c AS (SELECT p.*, m.id AS mid, m.ai_score, m.sentiment, m.no_verdict, m.moment, m.undated, CASE WHEN o % 8 = 0 OR o % 9 = 0 THEN 0 ELSE 1 + o % 4 END AS photos, NOT (o % 8 = 0 OR o % 9 = 0) AS has_urls FROM (SELECT *, id AS o FROM p) p LEFT JOIN m USING (id))"""


def rerun_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as properties, events as metrics of the same id; moments with zones and without."""
    k, e = F.col("o_orderkey"), F.col("event_id")
    urls = F.when(k % 8 == 0, "{}").when(k % 9 == 0, "[]").otherwise(F.concat(F.lit('["a", " ", null'), F.repeat(F.lit(', "b"'), (k % 4).cast("int")), F.lit("]")))
    p = t(s, d, "orders").select(k.alias("id"), (k % 11 != 0).alias("active"), F.col("o_orderstatus").alias("platform"), (F.col("o_custkey") % 25).alias("area_id"), urls.alias("image_urls"))
    text = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    at = F.when(e % 7 == 0, '"soon"').otherwise(F.concat(F.lit('"'), text, F.when(e % 2 == 0, "+02:00").when(e % 3 == 0, "Z").otherwise(""), F.lit('"')))
    meta = F.concat(F.lit('{"visual": {"a": 1}, "sentiment": '), F.when(e % 3 == 0, "null").otherwise('{"flags": []}'), F.when(e % 5 == 0, ', "deal_verdict": null').when(e % 5 != 2, ', "deal_verdict": "good"').otherwise(""), F.lit(', "enriched_at": '), at, F.lit("}"))
    score = F.when(e % 4 == 0, 0.0).when(e % 4 != 1, F.col("value"))
    return p, t(s, d, "events").select(e.alias("property_id"), score.alias("ai_score"), meta.alias("meta"))


@query(
    f"""WITH {RERUNS}, r AS (SELECT 'missing' AS mode, c.* FROM c WHERE active AND coalesce(ai_score, 0) = 0 UNION ALL SELECT 'force', c.* FROM c WHERE platform = 'F' UNION ALL SELECT 'stale_before', c.* FROM c WHERE active AND area_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND (mid IS NULL OR undated OR moment < TIMESTAMP '2024-01-11 12:00:00'))
SELECT mode, CASE WHEN mode = 'force' THEN CASE WHEN coalesce(sentiment, false) THEN 'queue' ELSE 'skip_prior' END WHEN NOT has_urls THEN 'skip_images' WHEN photos < 3 THEN 'skip_photos' ELSE 'queue' END AS action, count(*) AS n, sum(id)::BIGINT AS ids FROM r GROUP BY ALL"""
)
def rerun_candidates(s, d):
    p, m = rerun_tables(s, d)
    areas = t(s, d, "nation").select(F.col("n_nationkey").alias("area_id"), F.col("n_regionkey").cast("string").alias("city"))
    missing = reruns.classified(reruns.candidates(p, m, "missing"), "all", 3)
    force = reruns.classified(reruns.candidates(p, m, "force", platform="F", active_only=False), "verdict_only", 3)
    stale = reruns.classified(reruns.candidates(p, m, "stale_before", before=F.lit("2024-01-11T12:00:00Z").cast("timestamp"), areas=areas, city="1"), "visual+sentiment", 3)
    every = [x.select(F.lit(mode).alias("mode"), "action", "id") for mode, x in (("missing", missing), ("force", force), ("stale_before", stale))]
    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("mode", "action").agg(F.count(F.lit(1)).alias("n"), F.sum("id").cast("long").alias("ids"))


@query(f"WITH {RERUNS} SELECT id FROM c WHERE active AND mid IS NOT NULL AND no_verdict")
def verdict_backlog(s, d):
    return reruns.without_verdict(*rerun_tables(s, d)).select("id")


@query(f"WITH {RERUNS} SELECT area_id, count(*) AS n FROM c WHERE mid IS NOT NULL GROUP BY 1")
def sentiment_rows(s, d):
    """A sentiment of JSON null is one."""
    return reruns.with_sentiment(*rerun_tables(s, d)).groupBy("area_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {RERUNS} SELECT (SELECT count(*) FROM c WHERE active AND coalesce(ai_score, 0) = 0 AND photos >= 3) AS remaining, (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM m WHERE ai_score > 0) AS enriched,
  (SELECT nullif(count(*), 0) * 24.0::DOUBLE FROM m WHERE NOT undated AND moment > (SELECT max(ts) FROM events) - INTERVAL 4 HOUR) AS per_day"""
)
def enrichment_health(s, d):
    """The rate is that of the hour three hours before the last event on, as moments in zones lie two hours back."""
    p, m = rerun_tables(s, d)
    last = t(s, d, "events").agg(F.date_format(F.max("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).first()[0]
    as_of = F.lit(last).cast("timestamp") - F.expr("interval 3 hours")
    return reruns.remaining(p, m, 3).crossJoin(reruns.health(p, m)).crossJoin(reruns.observed_per_day(m, as_of))  # one row each


@query("SELECT n_nationkey AS area_id, n_name AS name, count(o_orderkey) FILTER (o_orderkey % 11 <> 0) AS property_count FROM nation LEFT JOIN orders ON o_custkey % 30 = n_nationkey GROUP BY 1, 2")
def area_details(s, d):
    areas = t(s, d, "nation").select(F.col("n_nationkey").alias("area_id"), F.col("n_name").alias("name"))
    p = t(s, d, "orders").select((F.col("o_custkey") % 30).alias("area_id"), (F.col("o_orderkey") % 11 != 0).alias("active"))
    return reruns.area_detail(areas, p)


@query(
    """WITH o AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 3 > 0 AND o_orderstatus IN ('F', 'O')),
l AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber = 4 THEN ' ' ELSE l_linestatus || l_partkey END AS url, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_shipdate END AS seen FROM lineitem WHERE l_returnflag <> 'R')
SELECT id, arg_min(url, (seen IS NULL, -epoch_us(seen::TIMESTAMP), url)) AS url FROM l JOIN o USING (id) WHERE trim(url) <> '' GROUP BY 1"""
)
def empty_descriptions(s, d):
    k = F.col("o_orderkey")
    p = t(s, d, "orders").select(k.alias("id"), (k % 11 != 0).alias("active"), F.col("o_orderstatus").alias("platform"), F.when(k % 3 == 0, "text").when(k % 3 == 1, "  ").alias("description"))
    url = F.when(F.col("l_linenumber") == 4, " ").otherwise(F.concat("l_linestatus", F.col("l_partkey").cast("string")))
    u = t(s, d, "lineitem").select(F.col("l_orderkey").alias("property_id"), (F.col("l_returnflag") != "R").alias("active"), url.alias("url"), F.when(F.col("l_linenumber") != 2, F.col("l_shipdate").cast("timestamp")).alias("last_seen"))
    return reruns.without_description(p, u, ["F", "O"]).select("id", "url")


@query("SELECT sha256(text) AS sha256, min(doc_id) AS id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def contents_once(s, d):
    return reruns.images_once(t(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
