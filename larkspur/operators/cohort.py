"""Cohort statistics of prices per square metre, and value scores blended from them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.scratch import written

#: Upper bounds of the bands of z, exclusive.
BANDS = ((-1.0, "highly_undervalued"), (-0.2, "slightly_undervalued"), (0.2, "average"), (1.0, "slightly_overvalued"))


@dataclass(frozen=True)
class Weights:
    stat: float = 0.4
    ai: float = 0.4
    neighborhood: float = 0.2

    def __post_init__(self):
        if abs(self.stat + self.ai + self.neighborhood - 1) > 0.001:
            raise ValueError("weights must sum to 1")


def cheapest(listings: DataFrame) -> DataFrame:
    """(property_id, listing_type, price): the least active price of each type."""
    good = listings.where("active AND price > 0 AND listing_type IN ('rent', 'sale')")
    return good.groupBy("property_id", "listing_type").agg(F.min("price").alias("price"))


def cohort_key(polygon_name: Column, props_name: Column) -> Column:
    """The city isn't part of it."""
    return F.coalesce(polygon_name, props_name, F.lit("Unknown"))


def typed_prices(properties: DataFrame, listings: DataFrame) -> DataFrame:
    """(property_id, cohort, listing_type, ppm) of active properties with an area.

    properties: id, price, area_m2, active, cohort, for_rent, for_sale. A property without a listing that counts
    has its own price: for rent if it is, else for sale if it is, else rent.
    """
    p = properties.where("active AND area_m2 > 0").select(F.col("id").alias("property_id"), "cohort", "area_m2", F.col("price").alias("own_price"), "for_rent", "for_sale")
    low = cheapest(listings)
    typed = p.join(low, "property_id").select("property_id", "cohort", "listing_type", (F.col("price") / F.col("area_m2")).alias("ppm"))
    kind = F.when(F.col("for_rent"), "rent").when(F.col("for_sale"), "sale").otherwise("rent")
    legacy = p.join(low, "property_id", "left_anti").where("own_price > 0").select("property_id", "cohort", kind.alias("listing_type"), (F.col("own_price") / F.col("area_m2")).alias("ppm"))
    return typed.unionByName(legacy)


def ranked(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """values (by, value, n: rows of that value; each value once) with `below`: rows of the group with a lesser value, nulls last.

    Values are dealt out by range, over group and value, so that one large group lies on as many tasks as its values need. Within a range they are
    counted up, and each range of a group adds what the ranges before it hold.
    """
    placed = written(values.repartitionByRange(*by, F.col(value).asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranges")
    here = Window.partitionBy("part", *by).orderBy(F.col(value).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ahead = placed.groupBy("part", *by).agg(F.sum("n").alias("sum")).withColumn("ahead", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    counted = placed.withColumn("below", F.coalesce(F.sum("n").over(here), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in ("part", *by)]
    ahead = ahead.select("ahead", *[F.col(c).alias(f"of_{c}") for c in ("part", *by)])
    return counted.join(ahead, reduce(lambda x, y: x & y, same)).select(*values.columns, (F.col("below") + F.col("ahead")).alias("below"))


def statistics(typed: DataFrame) -> DataFrame:
    """Adds mean, median, stddev (sample) and pct (0: cheapest) of ppm within cohort and listing type.

    A cohort may hold a third of all rows, or one price of it: all is counted by distinct prices first, a partial aggregate, and the ranks of these
    come from `ranked`, the median from the two ranks in the middle. Nulls have no part in mean, median and deviation and rank last.
    """
    by = ["cohort", "listing_type"]
    ranks = written(ranked(typed.groupBy(*by, "ppm").agg(F.count(F.lit(1)).alias("n")), by, "ppm"), "ranks")
    known = F.col("ppm").isNotNull()
    sums = ranks.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum(F.when(known, F.col("n"))).alias("prices"), (F.sum(F.col("n") * F.col("ppm")) / F.sum(F.when(known, F.col("n")))).alias("mean"))
    named = sums.select(*[F.col(c).alias(f"of_{c}") for c in by], "rows", "prices", "mean")
    within = F.col("cohort").eqNullSafe(F.col("of_cohort")) & F.col("listing_type").eqNullSafe(F.col("of_listing_type"))
    r = ranks.join(named, within).drop("of_cohort", "of_listing_type")
    # of the prices in order those at (prices - 1) / 2, rounded down and up, lie in the middle
    low, high = F.floor((F.col("prices") - 1) / 2), F.ceil((F.col("prices") - 1) / 2)
    at = lambda i: F.max(F.when(known & (F.col("below") <= i) & (i < F.col("below") + F.col("n")), F.col("ppm")))
    off = F.sum(F.col("n") * (F.col("ppm") - F.col("mean")) * (F.col("ppm") - F.col("mean")))
    spread = r.groupBy(*by).agg(((at(low) + at(high)) / 2).alias("median"), F.when(F.max("prices") > 1, F.sqrt(off / (F.max("prices") - 1))).alias("stddev"))
    spread = spread.select(*[F.col(c).alias(f"of_{c}") for c in by], "median", "stddev")
    pct = F.when(F.col("rows") > 1, F.col("below") / (F.col("rows") - 1)).otherwise(0.0)
    r = r.join(spread, within).select(*[F.col(c).alias(f"of_{c}") for c in (*by, "ppm")], "mean", "median", "stddev", pct.alias("pct"))
    # back to the rows by price; AQE splits what one price makes large
    return typed.join(r, within & F.col("ppm").eqNullSafe(F.col("of_ppm"))).drop("of_cohort", "of_listing_type", "of_ppm")


def z_score(x: Column, mean: Column, stddev: Column) -> Column:
    return F.when(stddev > 0, (x - mean) / stddev).otherwise(0.0)


def stat_score(z: Column) -> Column:
    """Cheaper is higher."""
    return 1 / (1 + F.exp(z))


def band(z: Column) -> Column:
    out = None
    for top, name in BANDS:
        out = F.when(z < top, name) if out is None else out.when(z < top, name)
    return out.otherwise("highly_overvalued")


def quality_mean(*scores: Column) -> Column:
    """The mean of those that are known, 0.5 for none."""
    known = F.filter(F.array(*scores), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)).otherwise(0.5)


def blend(stat: Column, ai: Column, quality: Column, w: Weights = Weights()) -> Column:
    return w.stat * stat + w.ai * ai + w.neighborhood * quality


def scored(stats: DataFrame) -> DataFrame:
    z = z_score(F.col("ppm"), F.col("mean"), F.col("stddev"))
    out = stats.withColumn("z", z).withColumn("pct", F.coalesce("pct", F.lit(0.5)))
    return out.withColumns({"stat_score": stat_score(F.col("z")), "band": band(F.col("z"))})


def pivoted(stats: DataFrame) -> DataFrame:
    """A row for each property with the figures of rent and sale side by side, and primary_type (rent before sale)."""
    one = lambda c, k: F.max(F.when(F.col("listing_type") == k, F.col(c))).alias(f"{c}_{k}")
    out = stats.groupBy("property_id").agg(*[one(c, k) for c in ("ppm", "mean", "median", "stddev", "pct") for k in ("rent", "sale")])
    return out.withColumn("primary_type", F.when(F.col("ppm_rent").isNotNull(), "rent").when(F.col("ppm_sale").isNotNull(), "sale"))


def score_properties(properties: DataFrame, listings: DataFrame, ai: DataFrame, quality: DataFrame, w: Weights = Weights()) -> DataFrame:
    """Everything for each property and type: ai (property_id, ai_score), quality (property_id, quality)."""
    s = scored(statistics(typed_prices(properties, listings)))
    s = s.join(ai, "property_id", "left").join(quality, "property_id", "left")
    return s.withColumn("combined", blend(F.col("stat_score"), F.coalesce("ai_score", F.lit(0.0)), F.coalesce("quality", F.lit(0.5)), w))


def reblend(metrics: DataFrame, w: Weights = Weights()) -> DataFrame:
    """New combined scores from stat_score, stat_score_rent, stat_score_sale, ai_score and quality; a missing type stays null."""
    new = {f"combined{s}": blend(F.col(f"stat_score{s}"), F.coalesce("ai_score", F.lit(0.0)), F.coalesce("quality", F.lit(0.5)), w) for s in ("", "_rent", "_sale")}
    return metrics.withColumns(new)


def cohort_summary(typed: DataFrame) -> DataFrame:
    """Mean, median, stddev and count of each cohort and listing type; nulls are 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return typed.groupBy("cohort", "listing_type").agg(zero(F.avg("ppm")).alias("mean"), zero(F.percentile("ppm", F.lit(0.5))).alias("median"), zero(F.stddev_samp("ppm")).alias("stddev"), F.count("ppm").alias("n"))


def rescore_one(stats: DataFrame, property_id: str) -> DataFrame:
    """One property against its cohort; its percent rank is taken as 0.5."""
    return scored(stats.where(F.col("property_id") == property_id).withColumn("pct", F.lit(0.5)))
