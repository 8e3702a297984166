"""Portals' raw listings, one JSON text a row in the column `raw`, as records of one shape.

Portals differ in how they write prices: as totals with fees apart, as sides of rent and sale, or as one
price with a list of labelled attributes. Each function reads one such shape with a single projection. A
record that can't be used has a `reason` (`no_id` or `no_price`, else null); nothing is dropped. Text that isn't
JSON reads as an empty record. Columns beside `raw` are kept, but for those that a record's columns replace.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.functions.columns import settled

# Cities that a slug names, and the one of all others.
CITIES = (("campinas", "Campinas", "SP"), ("sao-paulo", "São Paulo", "SP"), ("são-paulo", "São Paulo", "SP"))
HOME = ("Belo Horizonte", "MG")
# Labels of attributes, the earlier first.
AREA = ("área", "área construída", "area", "area_total", "area_util", "size")
BEDROOMS = ("quartos", "dormitórios", "bedrooms", "rooms")
BATHROOMS = ("banheiros", "bathrooms")
PARKING = ("vagas", "vagas na garagem", "garagem", "parking", "parking_spaces", "garage_spaces")
CONDO_FEE = ("condo", "condomínio", "condominio", "taxa de condomínio")
PETS = ("aceita animais", "aceita pets", "aceita_animais", "pets", "re_complex_features")
FURNISHED = ("mobiliado", "furnished")
KIND = ("categoria", "category", "tipo do imóvel", "tipo_do_imovel", "tipo do imovel", "real_estate_type", "property_type")
RENT_WORDS, SALE_WORDS = ("month", "mês", "mes", "rent", "aluguel"), ("sale", "sell", "venda", "year", "ano")
PET_AMENITY = ("PODE_TER_ANIMAIS_DE_ESTIMACAO", "PETS_ALLOWED")
#: What stands in an image's address template.
IMAGE_SLOTS = (("{description}", "foto"), ("{action}", "fit-in"), ("{width}", "614"), ("{height}", "297"))

LISTING = "struct<listing_type:string,price:double,base_price:double,condo_fee:double,iptu:double,url:string,is_furnished:boolean,accepts_pets:boolean,fees_bundled:boolean,fees_note:string>"
FIELDS = ["platform_id", "title", "description", "price", "area_m2", "bedrooms", "bathrooms", "parking", "lon", "lat", "address", "image_urls", "type", "neighborhood", "city", "state", "amenities", "for_rent", "for_sale", "listings", "reason"]


def _parsed(rows: DataFrame) -> DataFrame:
    """With the text parsed once; null for what isn't JSON."""
    return settled(rows, _v=F.try_parse_json("raw"))


def _get(path: str) -> Column:
    """A field as text; null for JSON null and blank text."""
    got = F.try_variant_get("_v", f"$.{path}", "string")
    return F.when(F.trim(got) != "", got)


def _one(*paths: str) -> Column:
    return F.coalesce(*map(_get, paths))


def positive(c: Column) -> Column:
    """A number above 0, else null."""
    x = c.try_cast("double")
    return F.when((x > 0) & ~F.isnan(x), x)


def _list(path: str) -> Column:
    """An array's items as text, objects as JSON; empty for what is no array."""
    return F.coalesce(F.try_variant_get("_v", f"$.{path}", "array<string>"), F.array().cast("array<string>"))


def _whole(c: Column) -> Column:
    """A number, or the first of a list of numbers, without what is behind the point."""
    return F.coalesce(c, F.lit("")).try_cast("double").cast("int")


def city_of_slug(slug: Column) -> tuple[Column, Column]:
    """City and state that a search's slug names."""
    s = F.lower(F.coalesce(slug, F.lit("")))
    pick = lambda i: reduce(lambda out, c: F.when(s.contains(c[0]), c[i]).otherwise(out), reversed(CITIES), F.lit(HOME[i - 1]))
    return pick(1), pick(2)


def state_code(state: Column) -> Column:
    s = F.lower(state)
    return F.when((F.length(state) > 2) & s.startswith("minas"), "MG").when((F.length(state) > 2) & s.contains("paulo"), "SP").otherwise(state)


def image_url(c: Column) -> Column:
    return reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), IMAGE_SLOTS, c)


def _images(items: Column, keys: tuple[str, ...]) -> Column:
    """Texts as they are, of objects the first of `keys` that they have."""
    obj = lambda x: x.startswith("{")
    urls = F.transform(items, lambda x: F.when(obj(x), F.coalesce(*[F.nullif(F.get_json_object(x, f"$.{k}"), F.lit("")) for k in keys])).otherwise(x))
    return F.filter(urls, lambda u: u.isNotNull() & (u != ""))


def _joined(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *[F.when(p != "", p) for p in parts]), F.lit(""))


def _offers(rent: Column, sale: Column, rent_base: Column, sale_base: Column, condo: Column, iptu: Column, url: Column, furnished: Column, pets: Column, bundled: Column, note: Column) -> Column:
    offer = lambda kind, price, base: F.struct(F.lit(kind), price, base, condo, iptu, url, furnished, pets, bundled, note).cast(LISTING)
    both = F.array(F.when(rent > 0, offer("rent", rent, rent_base)), F.when(sale > 0, offer("sale", sale, sale_base)))
    return F.filter(both, lambda x: x.isNotNull())


def _record(rows: DataFrame, beside: list[str] | None = None, **c: Column) -> DataFrame:
    """beside: columns to keep, where `rows` has others that are only steps."""
    rent, sale = c.pop("rent"), c.pop("sale")
    c["for_rent"], c["for_sale"] = F.coalesce(rent > 0, F.lit(False)), F.coalesce(sale > 0, F.lit(False))
    c["price"] = F.when(rent > 0, rent).when(sale > 0, sale)
    c["reason"] = F.when(c["platform_id"].isNull(), "no_id").when(c["price"].isNull(), "no_price")
    kept = [f"`{x}`" for x in beside or rows.columns if x.lower() not in {"raw", "_v", "_pairs", "_prices", *FIELDS}]
    return rows.select(*kept, *[c[x].alias(x) for x in FIELDS])


def from_totals(rows: DataFrame, site: str) -> DataFrame:
    """Rent as a total cost, or as rent and fees: fees come apart, bundled, or as what the total leaves."""
    partial, sale = F.coalesce(_get("rentPrice").try_cast("double"), F.lit(0.0)), F.coalesce(_get("salePrice").try_cast("double"), F.lit(0.0))
    apart, iptu, both = positive(_get("condoFee")), positive(_get("iptu")), positive(_get("condoIptu"))
    one = apart.isNotNull() | iptu.isNotNull()
    total = _get("totalCost").try_cast("double")
    condo = F.when(one, apart).otherwise(both)
    rent = F.when(total != 0, total).otherwise(partial + F.coalesce(condo, F.lit(0.0)) + F.coalesce(iptu, F.lit(0.0)))
    rest = condo.isNull() & iptu.isNull() & (partial > 0) & (rent > partial)
    bundled = rest | (~one & both.isNotNull())
    note = F.when(rest, "condo and IPTU: total cost less rent").when(bundled, "condo and IPTU in one field")
    fee = F.when(rest, F.round(rent - partial, 2)).otherwise(condo)
    slug_city, slug_state = city_of_slug(_get("city_slug"))
    city, area = F.coalesce(_get("address.city"), slug_city), _get("neighbourhood")
    amenities = F.concat(_list("amenities"), _list("installations"))
    pets = F.when(F.arrays_overlap(amenities, F.array(*map(F.lit, PET_AMENITY[:1]))) | (_get("acceptsPets") == "true") | (_get("petsAllowed") == "true"), True)
    images = F.transform(_images(_list("photos"), ("url", "imagePath")), lambda u: F.when(u.startswith("http"), u).otherwise(F.concat(F.lit(f"{site}/img/"), u)))
    lat, lon = _get("location.lat").try_cast("double"), _one("location.lon", "location.lng").try_cast("double")
    placed = lat.isNotNull() & lon.isNotNull()
    count = lambda *paths: F.coalesce(_whole(_one(*paths)), F.lit(0))
    return _record(
        _parsed(rows), rent=rent, sale=sale, platform_id=_get("id"), title=F.concat(F.coalesce(_get("type"), F.lit("Property")), F.lit(" in "), F.coalesce(area, city)), description=F.trim(F.coalesce(_one("description", "remarks"), F.lit(""))),
        area_m2=F.coalesce(_get("area").try_cast("double"), F.lit(0.0)), bedrooms=count("bedrooms"), bathrooms=count("bathrooms"), parking=count("parkingSpots", "parkingSpaces"), lon=F.when(placed, lon), lat=F.when(placed, lat),
        address=F.coalesce(_joined(_get("address.address"), area, _get("address.city")), F.lit("Address unavailable")), image_urls=images, type=text.property_type(_get("type")), neighborhood=area, city=city, state=F.coalesce(_one("address.state", "address.uf", "address.region"), slug_state), amenities=amenities,
        listings=_offers(rent, sale, F.when(partial != 0, partial), F.lit(None), fee, iptu, F.concat(F.lit(f"{site}/imovel/"), _get("id")), _get("isFurnished").try_cast("boolean"), pets, bundled, note),
    )


def from_sides(rows: DataFrame, site: str) -> DataFrame:
    """Prices as sides of rent and sale; fees are those of the rent, if it has a side."""
    rent, sale = positive(_get("prices.rental.value")), positive(_get("prices.sale.value"))
    rented = F.coalesce(_get("prices.rental") != "{}", F.lit(False))
    fee = lambda name: F.when(rented, positive(_get(f"prices.rental.{name}"))).otherwise(positive(_get(f"prices.sale.{name}")))
    condo, iptu = fee("condominium"), fee("iptu")
    slug_city, slug_state = city_of_slug(_get("city_slug"))
    area, city = _get("address.neighborhood"), F.coalesce(_get("address.city"), slug_city)
    lat, lon = _get("address.coordinates.latitude").try_cast("double"), _get("address.coordinates.longitude").try_cast("double")
    placed = lat.isNotNull() & lon.isNotNull()
    amenities = F.filter(_list("amenities.values"), lambda x: x.isNotNull())
    pets = F.when(F.arrays_overlap(amenities, F.array(*map(F.lit, PET_AMENITY[1:]))) | (_get("petsAllowed") == "true"), True)
    first = lambda name: _whole(_one(f"amenities.{name}[0]", f"amenities.{name}"))
    url = F.coalesce(F.trim(_get("href")), F.concat(F.lit(f"{site}/imovel/id-"), _get("id"), F.lit("/")))
    images = F.filter(F.transform(_images(_list("medias.images"), ("dangerousSrc", "url", "src")), image_url), lambda u: u.startswith("http"))
    return _record(
        _parsed(rows), rent=rent, sale=sale, platform_id=_get("id"), title=F.trim(F.coalesce(_get("title"), F.concat(F.lit("Property in "), F.coalesce(area, city)))), description=F.trim(F.coalesce(_get("description"), F.lit(""))),
        area_m2=first("usableAreas").cast("double"), bedrooms=first("bedrooms"), bathrooms=first("bathrooms"), parking=first("parkingSpaces"), lon=F.when(placed, lon), lat=F.when(placed, lat),
        address=_joined(_get("address.street"), _get("address.streetNumber"), area, city), image_urls=images, type=text.property_type(_get("unitType")), neighborhood=area, city=city, state=state_code(F.coalesce(_one("address.stateAcronym", "address.state"), slug_state)), amenities=amenities,
        listings=_offers(rent, sale, rent, sale, condo, iptu, url, F.lit(None), pets, F.lit(False), F.lit(None)),
    )


def product_sides(rows: DataFrame) -> DataFrame:
    """Linked-data products in `raw` as the records that `from_sides` reads."""
    sale = F.lower(F.coalesce(_get("offers.potentialAction['@type']"), F.lit(""))).startswith("buy")
    extra = F.when(F.lower(_get("offers.additionalProperty.name")).contains("condo"), positive(_get("offers.additionalProperty.value")))
    price = positive(_get("offers.price"))
    side = F.when(price.isNotNull(), F.struct(price.alias("value"), extra.alias("condominium")))
    some = lambda path: F.array_compact(F.array(_get(path)))
    images = F.when(_get("image").startswith("["), _list("image")).otherwise(F.array_compact(F.array(_get("image"))))
    number = F.nullif(F.regexp_extract(_get("url"), r"id-(\d+)", 1), F.lit(""))
    record = F.struct(
        F.coalesce(F.try_variant_get("_v", "$['@id']", "string"), number).alias("id"), _get("name").alias("title"), _get("url").alias("href"), _get("description").alias("description"), F.lit("APARTMENT").alias("unitType"), F.struct(F.when(~sale, side).alias("rental"), F.when(sale, side).alias("sale")).alias("prices"),
        F.struct(_get("address.addressLocality").alias("city"), _get("address.addressRegion").alias("stateAcronym"), _get("address.streetAddress").alias("street")).alias("address"),
        F.struct(some("floorSize.value").alias("usableAreas"), some("numberOfBedrooms").alias("bedrooms"), some("numberOfBathroomsTotal").alias("bathrooms")).alias("amenities"), F.struct(images.alias("images")).alias("medias"),
    )
    return _parsed(rows).withColumn("raw", F.to_json(record)).drop("_v")


def path_type(url: Column) -> Column:
    """rent or sale, if a segment of the path says so."""
    u = F.lower(url)
    return F.when(u.contains("/aluguel/") | u.startswith("aluguel/") | u.contains("/alugar/"), "rent").when(u.contains("/venda/") | u.startswith("venda/"), "sale")


def _priced(e: Column) -> Column:
    """(kind, amount) of a price entry: by its period and business, else by the price bands."""
    get = lambda k: F.lower(F.coalesce(F.get_json_object(e, f"$.{k}"), F.lit("")))
    business = F.coalesce(F.nullif(get("businessType"), F.lit("")), F.nullif(get("business_type"), F.lit("")), get("priceType"))
    blob = F.concat_ws(" ", get("period"), business)
    has = lambda words: reduce(lambda a, b: a | b, [blob.contains(w) for w in words])
    amount = F.coalesce(positive(F.get_json_object(e, "$.value")), positive(F.get_json_object(e, "$.price")))
    bare = F.when(F.trim(blob) == "", F.when(amount >= text.SALE_FLOOR, "sale").when(amount < text.RENT_CEILING, "rent"))
    return F.struct(F.when(has(RENT_WORDS), "rent").when(has(SALE_WORDS), "sale").otherwise(bare).alias("kind"), amount.alias("amount"))


def from_labels(rows: DataFrame, site: str) -> DataFrame:
    """One price, or several entries, and a list of labelled attributes; the rent's total is the price and both fees.

    The fields and labels that the rules below ask for are read once, and what several rules use is settled before them: the whole as one expression
    would compute a field anew for each of its hundreds of uses.
    """
    fields: dict[str, str] = {}
    labels: dict[str, str] = {}

    def field(path: str) -> Column:
        name = fields.setdefault(path, f"_field{len(fields)}")
        return F.when(F.trim(name) != "", F.col(name))

    def label(keys: tuple[str, ...], parse) -> Column:
        return F.coalesce(*[parse(F.col(labels.setdefault(k, f"_label{len(labels)}"))) for k in keys])

    one = lambda *paths: F.coalesce(*map(field, paths))
    decimal = lambda keys: label(keys, lambda v: F.coalesce(text.brazilian_number(v), F.regexp_replace(v, r"[^\d.]", "").try_cast("double")))
    integer = lambda keys: label(keys, lambda v: F.regexp_replace(v, r"\D", "").try_cast("int"))
    yes = lambda keys: label(keys, lambda v: F.lower(v).contains("sim") | F.lower(v).contains("permit"))
    number = lambda *keys: F.coalesce(*[positive(field(k)) for k in keys])
    place = lambda *keys: F.coalesce(*[F.coalesce(field(f"locationDetails.{k}"), F.when(field("locationDetails").isNull(), field(f"location.{k}"))) for k in keys])
    degrees = lambda *paths: F.nullif(one(*paths).try_cast("double"), F.lit(0.0))

    segment = F.nullif(F.regexp_extract(F.lower(F.coalesce(field("url"), F.lit(""))), r"(?:^|/)(apartamentos|casas|kitnets?)(?:/|$)", 1), F.lit(""))
    step = {
        "_id": one("list_id", "listId", "id", "ad_id"),
        "_title": F.coalesce(one("subject", "title"), F.lit("Imóvel")),
        "_single": F.coalesce(number("value", "price", "pricingInfos[0].value", "pricingInfos[0].price"), *[text.brazilian_number(field(k)) for k in ("priceValue", "price", "price_str", "value_str", "subject")]),
        "_stamp": F.when(field("listing_type").isin("rent", "sale"), field("listing_type")),
        "_path": path_type(field("url")),
        "_rents": positive(field("window_prices.rent")),
        "_sells": positive(field("window_prices.sale")),
        "_condo": decimal(CONDO_FEE),
        "_iptu": decimal(("iptu",)),
        "_lat": degrees("location.lat", "location.latitude", "coordinates.lat"),
        "_lon": degrees("location.lon", "location.lng", "location.longitude", "coordinates.lon", "coordinates.lng"),
        "_area": place("neighborhood", "neighborhoodName", "neighbourhood"),
        "_city": place("city", "cityName", "municipality"),
        "_state": place("uf", "state"),
        "_street": place("address", "street"),
        "_sort": F.coalesce(text.property_type(field("property_type")), field("property_type"), text.property_type(segment)),
        "_kind_label": F.coalesce(*[label((k,), text.property_type) for k in KIND]),
    }
    col = F.col
    kind = F.coalesce("_stamp", "_path", text.listing_type_from(col("_title"), col("_single"), F.lit(None).cast("string")))
    of = lambda k: F.get(F.filter("_prices", lambda p: p.kind == k), F.lit(0)).amount
    windows, typed = col("_rents").isNotNull() | col("_sells").isNotNull(), F.size("_prices") > 0
    side = lambda k, w: F.when(windows, w).when(typed, of(k)).when(col("_kind") == k, col("_single"))
    before = F.coalesce("_city", "_area", "_street", F.lit(""))
    address = F.coalesce(_joined(col("_street"), col("_area"), col("_city"), F.when(~before.contains(col("_state")), col("_state"))), F.when(~field("location").startswith("{"), field("location")))
    record = {
        "platform_id": col("_id"), "title": col("_title"), "description": F.trim(F.coalesce(one("body", "description"), F.lit(""))), "area_m2": decimal(AREA), "bedrooms": integer(BEDROOMS), "bathrooms": integer(BATHROOMS),
        "parking": integer(PARKING), "lon": F.when(col("_lat").isNotNull(), col("_lon")), "lat": F.when(col("_lon").isNotNull(), col("_lat")), "address": address, "type": F.coalesce("_sort", "_kind_label", text.property_type_in(one("subject", "title"))),
        "neighborhood": col("_area"), "city": col("_city"), "state": col("_state"), "amenities": F.array().cast("array<string>"),
    }
    url = F.coalesce(field("url"), F.concat(F.lit(f"{site}/detalhes/"), col("_id")))
    furnished, pets = yes(FURNISHED), yes(PETS)

    # all fields and labels are known by now
    items = F.filter(F.concat(_list("properties"), _list("attributes")), lambda x: x.startswith("{"))
    get = lambda x, k: F.nullif(F.get_json_object(x, f"$.{k}"), F.lit(""))
    pairs = F.flatten(F.transform(items, lambda x: F.array(*[F.struct(F.lower(get(x, k)).alias("k"), F.coalesce(get(x, "value"), get(x, "text")).alias("v")) for k in ("label", "name")])))
    priced = F.filter(F.transform(_list("pricingInfos"), _priced), lambda p: p.kind.isNotNull() & p.amount.isNotNull())
    images = _images(F.when(F.size(_list("images")) > 0, _list("images")).otherwise(_list("photos")), ("src", "url", "path", "original", "originalWebp"))
    read = {name: F.try_variant_get("_v", f"$.{path}", "string") for path, name in fields.items()}
    wide = settled(_parsed(rows), _pairs=F.filter(pairs, lambda p: p.k.isNotNull() & p.v.isNotNull()), _prices=priced, _images=images, **read)

    def last(key: str) -> Column:
        return F.try_element_at(F.filter("_pairs", lambda p: p.k == key), F.lit(-1)).v  # of equal labels the last

    wide = settled(wide, **{name: last(key) for key, name in labels.items()})
    wide = settled(wide, **step)
    wide = settled(wide, _kind=kind, _furnished=furnished, _pets=pets, _url=url)
    wide = settled(wide, _base=side("rent", col("_rents")), _sale=side("sale", col("_sells")))
    wide = settled(wide, _rent=col("_base") + F.coalesce("_condo", F.lit(0.0)) + F.coalesce("_iptu", F.lit(0.0)))
    offers = _offers(col("_rent"), col("_sale"), col("_base"), F.lit(None), col("_condo"), col("_iptu"), col("_url"), col("_furnished"), col("_pets"), F.lit(False), F.lit(None))
    return _record(wide, rows.columns, rent=col("_rent"), sale=col("_sale"), image_urls=col("_images"), listings=offers, **record)
