"""Faceted search: filters, sorts, pages, facets, vector search and export."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.functions.geo import in_box
from larkspur.functions.text import property_type_spellings
from larkspur.functions.vectors import cosine_distance
from larkspur.operators.cohort import quality_mean

#: Rows of an export at most.
EXPORT_ROWS = 5000


@dataclass(frozen=True)
class Search:
    platform: str | None = None
    price_type: str | None = None
    max_price: float | None = None
    min_bedrooms: int | None = None
    min_parking: int | None = None
    neighborhoods: str | None = None
    cities: str | None = None
    min_score: float | None = None
    listing_type: str | None = None
    property_type: str | None = None
    furnished: bool | None = None
    pets: bool | None = None
    bbox: str | None = None
    query_vector: tuple[float, ...] | None = None
    sort: str = "combined_score"
    descending: bool = True
    page: int = 1
    size: int = 20


def typed_price_kind(s: Search) -> str:
    """price_type, else listing_type if rent or sale, else rent."""
    return s.price_type or (s.listing_type if s.listing_type in ("rent", "sale") else "rent")


def score_of(kind: str | None) -> Column:
    return F.coalesce(*([f"combined_{kind}"] if kind in ("rent", "sale") else []), "combined", F.lit(0.0))


def _any_like(texts: list[Column], names: str) -> Column | None:
    """Any of the comma-separated names within any of the texts; % and _ in names are wildcards."""
    wanted = [x.strip() for x in names.split(",") if x.strip()]
    return reduce(Column.__or__, [t.ilike(f"%{x}%") for x in wanted for t in texts]) if wanted else None


def _box(text: str | None) -> tuple[float, ...] | None:
    try:
        box = tuple(float(x) for x in (text or "").split(","))
    except ValueError:
        return None
    return box if len(box) == 4 else None


def matches(base: DataFrame, listings: DataFrame, s: Search) -> DataFrame:
    """Rows of `base` (properties with metrics and neighbourhood columns) that pass every filter given.

    Missing bedrooms, parking or furnished never match. pets=False leaves out rows without amenities.
    """
    where = [F.col("active")]
    if s.query_vector is not None:
        where.append(F.col("embedding").isNotNull())
    if s.platform:
        where.append(F.col("platform") == s.platform)
    for column, least in (("bedrooms", s.min_bedrooms), ("parking", s.min_parking)):
        if least is not None:
            where.append(F.col(column) >= least)
    if s.neighborhoods and (c := _any_like([F.col("neighborhood_name"), F.col("props_neighborhood")], s.neighborhoods)) is not None:
        where.append(c)
    if s.cities and (c := _any_like([F.coalesce("neighborhood_city", "props_city")], s.cities)) is not None:
        where.append(c)
    if s.min_score is not None:
        where.append(score_of(s.listing_type) >= s.min_score)
    if s.listing_type in ("rent", "sale"):
        where.append(F.col(f"for_{s.listing_type}"))
    if s.property_type:
        where.append(F.lower("type").isin(property_type_spellings(s.property_type)))
    if s.furnished is not None:
        where.append(F.col("furnished") == s.furnished)
    if box := _box(s.bbox):
        where.append(in_box(F.col("lon"), F.col("lat"), *box))
    out = base.where(reduce(Column.__and__, where))
    if s.max_price is not None:
        cheap = listings.where(F.col("active") & (F.col("listing_type") == typed_price_kind(s)) & (F.col("price") <= s.max_price))
        out = out.join(cheap.select(F.col("property_id").alias("id")), "id", "left_semi")
    if s.pets is not None:
        ok = listings.where("active AND accepts_pets").select(F.col("property_id").alias("id")).distinct().withColumn("pet_listing", F.lit(True))
        pets = F.coalesce("pet_listing", F.lit(False)) | F.array_contains("amenities", "pets")
        out = out.join(ok, "id", "left").where(pets if s.pets else ~pets).drop("pet_listing")
    return out


def ordered(found: DataFrame, listings: DataFrame, s: Search) -> DataFrame:
    """Nulls first when descending, last when ascending; ties by id. A query vector orders by distance."""
    if s.query_vector is not None:
        d = cosine_distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in s.query_vector]))
        return found.withColumn("distance", d).orderBy(F.col("distance").asc_nulls_last(), "id")
    if s.sort == "price":
        kind = s.price_type or (s.listing_type if s.listing_type in ("rent", "sale") else None)
        if kind:
            low = listings.where(F.col("active") & (F.col("listing_type") == kind)).groupBy(F.col("property_id").alias("id")).agg(F.min("price").alias("typed_price"))
            found = found.join(low, "id", "left")
        key = F.coalesce("typed_price", "price") if kind else F.col("price")
    else:
        key = {"combined_score": score_of(s.listing_type), "first_seen": F.col("first_seen"), "created_at": F.col("first_seen"), "area_m2": F.col("area_m2")}[s.sort]
    return found.withColumn("sort_key", key).orderBy(F.col("sort_key").desc_nulls_first() if s.descending else F.col("sort_key").asc_nulls_last(), "id")


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    return rows.offset((number - 1) * min(size, 100)).limit(min(size, 100))


def search(base: DataFrame, listings: DataFrame, s: Search) -> DataFrame:
    return page(ordered(matches(base, listings, s), listings, s), s.page, s.size)


def by_refs(base: DataFrame, refs: list[str]) -> DataFrame:
    """1 to 4 references, all public ids or all ids, in the order given, repeats once."""
    refs = list(dict.fromkeys(r.strip() for r in refs if r.strip()))
    digits = {r.isdigit() for r in refs}
    if not 1 <= len(refs) <= 4 or len(digits) > 1:
        raise ValueError("one to four references of one kind are needed")
    key = F.col("public_id").cast("string") if digits == {True} else F.col("id")
    return base.where(key.isin(refs)).orderBy(F.array_position(F.array(*[F.lit(r) for r in refs]), key))


def primary_listing(listings: DataFrame) -> DataFrame:
    """Each property's cheapest active listing: by price, rent before sale before others, platform."""
    rank = F.when(F.col("listing_type") == "rent", 0).when(F.col("listing_type") == "sale", 1).otherwise(2)
    order = F.struct(F.col("price").isNull(), "price", rank.alias("rank"), "platform")
    whole = F.struct(*[c for c in listings.columns if c not in ("property_id", "active")])
    return listings.where("active").groupBy("property_id").agg(F.min_by(whole, order).alias("primary"))


def nested_listings(listings: DataFrame) -> DataFrame:
    """Active listings of each property in one array, ordered by type, price and platform; no row for none."""
    rank = F.when(F.col("listing_type") == "rent", 0).when(F.col("listing_type") == "sale", 1).otherwise(2)
    item = F.struct(rank.alias("rank"), F.coalesce(F.nullif("price", F.lit(0.0)), F.lit(float("inf"))).alias("order"), "platform", "listing_type", "price")
    items = F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x.platform.alias("platform"), x.listing_type.alias("listing_type"), x.price.alias("price")))
    return listings.where("active").groupBy("property_id").agg(items.alias("listings"))


def decision_price(own: Column, primary: Column) -> Column:
    """The primary listing's price, else the property's own."""
    return F.coalesce(primary, own).cast("double")


def unit_score(c: Column) -> Column:
    """A score within 0 and 1; anything else is null."""
    x = c.try_cast("double")
    return F.when(x.between(0.0, 1.0), x)


def quality_profile(areas: DataFrame) -> DataFrame:
    """areas (id, four scores, risk_flags, quality_notes) as shown: scores outside 0 to 1 null, flags trimmed and blank ones gone, blank notes null.

    neighbourhood_score is the mean of the scores there are, 0.5 without any.
    """
    scores = [unit_score(F.col(c)).alias(c) for c in ("amenity_score", "transit_score", "access_score", "safety_score")]
    flags = F.filter(F.transform(F.coalesce("risk_flags", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    out = areas.select(F.col("id").cast("string").alias("id"), *scores, flags.alias("risk_flags"), F.nullif(F.trim("quality_notes"), F.lit("")).alias("quality_notes"))
    return out.withColumn("neighbourhood_score", quality_mean(*map(F.col, ("amenity_score", "transit_score", "access_score", "safety_score"))))


def neighborhood_label(polygon: Column, slug: Column, city: Column) -> Column:
    """The polygon's name, else the slug in words; null if it says the same as the city."""
    name = F.coalesce(polygon, F.initcap(F.trim(F.regexp_replace(slug, r"[\-_]+", " "))))
    return F.when(F.lower(F.trim(name)).eqNullSafe(F.lower(F.trim(city))), None).otherwise(name)


def location_label(neighborhood: Column, city: Column) -> Column:
    return F.nullif(F.concat_ws(", ", F.nullif(neighborhood, F.lit("")), F.nullif(city, F.lit(""))), F.lit(""))


def neighborhood_facet(base: DataFrame) -> DataFrame:
    active = base.where("active").withColumns({"facet_city": F.coalesce("neighborhood_city", "props_city"), "facet_name": F.coalesce("neighborhood_name", "props_neighborhood")})
    out = active.where("facet_name IS NOT NULL").groupBy("facet_city", "facet_name").agg(F.count(F.lit(1)).alias("n"), F.max("quality").alias("quality"))
    return out.orderBy(F.col("facet_city").asc_nulls_last(), "facet_name")


def city_facet(base: DataFrame) -> DataFrame:
    return base.where("active").groupBy(F.coalesce("neighborhood_city", "props_city").alias("city")).agg(F.count(F.lit(1)).alias("n")).where("city IS NOT NULL").orderBy(F.desc("n"), "city")


def top_deals(base: DataFrame, as_of, hours: int = 168, kind: str | None = None, least: float = 0.0, limit: int = 10) -> DataFrame:
    """Seen first within `hours` of `as_of`, best score first; inactive rows count too."""
    score = F.col(f"combined_{kind}" if kind in ("rent", "sale") else "combined")
    some = base.where((F.col("first_seen") >= F.lit(as_of) - F.make_interval(hours=F.lit(hours))) & score.isNotNull() & (score >= least))
    return some.withColumn("deal_score", score).orderBy(F.desc("deal_score"), F.desc("first_seen"), "id").limit(max(0, limit))


def public_ids(properties: DataFrame) -> DataFrame:
    """Numbers from 1 by first_seen (missing last), then id. Days are counted first, so no task sorts all rows."""
    day = F.coalesce(F.date_trunc("day", "first_seen"), F.lit("9999-12-31").cast("timestamp"))
    p = properties.withColumn("seen_day", day)
    per_day = p.groupBy("seen_day").agg(F.count(F.lit(1)).alias("day_rows"))
    before = per_day.withColumn("before", F.coalesce(F.sum("day_rows").over(Window.orderBy("seen_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("seen_day").orderBy(F.col("first_seen").asc_nulls_last(), "id"))
    return p.withColumn("nth", nth).join(before.select("seen_day", "before"), "seen_day").withColumn("public_id", (F.col("before") + F.col("nth")).cast("long")).drop("seen_day", "nth", "before")


def export_csv(rows: DataFrame, path: str) -> None:
    """Nulls are empty, booleans true or false, arrays and structs JSON text."""
    flat = [F.coalesce((F.to_json(c) if t.startswith(("array", "struct", "map")) else F.col(c).cast("string")), F.lit("")).alias(c) for c, t in rows.dtypes]
    rows.limit(EXPORT_ROWS).select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def export_json(rows: DataFrame, path: str) -> dict:
    total = rows.count()
    rows.limit(EXPORT_ROWS).write.mode("overwrite").json(path)
    return {"total": total, "truncated": total > EXPORT_ROWS}


#: Spellings of a saved search's fields.
ALIASES = {
    "sort_by": ("sortBy",), "sort_dir": ("sortDir",), "listing_type": ("listingType",), "property_type": ("propertyType",), "platform": (), "min_price": ("minPrice",), "max_price": ("maxPrice",), "price_type": ("priceType",),
    "min_bedrooms": ("minBedrooms",), "max_bedrooms": ("maxBedrooms",), "min_parking": ("minParking",), "neighborhood": ("neighbourhood", "neighborhood_name"), "city": ("city_name", "cityName"), "is_furnished": ("isFurnished", "furnished"), "accepts_pets": ("acceptsPets", "pets"), "min_score": ("minScore",), "q": (),
}


def saved_filters(raw: Column) -> Column:
    """A saved search's JSON in one form: fields by one name, blanks and false flags gone, place lists joined by commas, types by their codes.

    Other fields are dropped; text that is no object gives an empty one.
    """
    v = F.try_parse_json(raw)
    got = lambda name, kind: F.coalesce(*[F.try_variant_get(v, f"$.{k}", kind) for k in (name, *ALIASES[name])])
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    out = {}
    for name in ALIASES:
        if name in ("is_furnished", "accepts_pets"):
            out[name] = F.when(got(name, "boolean"), True)
        elif name.startswith(("min_", "max_")):
            out[name] = got(name, "int" if name.endswith(("bedrooms", "parking")) else "double")
        elif name in ("neighborhood", "city"):
            listed = F.array_join(F.filter(F.transform(got(name, "array<string>"), lambda x: F.trim(x)), lambda x: x != ""), ",")
            out[name] = blank(F.coalesce(listed, got(name, "string")))
        else:
            out[name] = blank(got(name, "string"))
    for name, code in (("listing_type", text.listing_type), ("price_type", text.price_type), ("property_type", text.property_type)):
        out[name] = F.coalesce(code(out[name]), out[name])
    return F.to_json(F.struct(*[c.alias(k) for k, c in out.items()]))


def favourites(marks: DataFrame, base: DataFrame, owner: str) -> DataFrame:
    """An owner's marked properties, newest mark first."""
    mine = marks.where(F.col("owner") == owner).select(F.col("property_id").alias("id"), "created_at")
    return mine.join(base, "id").orderBy(F.desc("created_at"), "id")
