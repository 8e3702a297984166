"""Where a listing is, by its text rather than by its seller's address, and which neighbourhood it belongs to by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.catalogue import Catalogue
from larkspur.functions.columns import settled
from larkspur.functions.text import fold
from larkspur.operators.gates import canonical_city, city_state, outside

#: Fixed value: words after which a place stands, and the place.
PLACE_PHRASE = r"(?iU)\b(?:em|no|na|nos|nas|bairro(?:\s+do|\s+da)?)\s+([A-Za-zÀ-ÿ0-9][A-Za-zÀ-ÿ0-9\s\-']{1,40})"
#: A state whose listings named after a city belong to its capital.
CAPITAL_STATES, CAPITAL = ("mg", "minas gerais"), "belo horizonte"
#: How sure a correction by text alone is.
BY_TEXT = 0.55


def _text(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def catalogue(rows: DataFrame, names: Sequence[str] | Catalogue) -> Catalogue:
    return names if isinstance(names, Catalogue) else Catalogue(rows.sparkSession, names, canonical_city)


def suspects(rows: DataFrame, cities: Sequence[str] | Catalogue, neighborhoods: Sequence[str] | Catalogue) -> DataFrame:
    """Adds `place`: (suspected, city, neighborhood, reason), what title and description hint at against the scraped fields.

    rows: title, description, city, neighborhood. Without text nothing is suspected (`empty_text`); a missing neighbourhood
    always is. A row's cost doesn't depend on the size of the catalogues; of several names the first counts.
    """
    allowed, known = catalogue(rows, cities), catalogue(rows, neighborhoods)
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit("")))
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    city, nb = _text("city"), _text("neighborhood")
    city_f, nb_f = F.coalesce(canonical_city(city), F.lit("")), F.coalesce(fold(nb), F.lit(""))
    named_city = F.coalesce((F.trim(nb) != "") & allowed.listed(canonical_city(nb)), F.lit(False))
    r = settled(rows.withColumn("place_named_city", named_city), place_text=text, place_folded=fold(text), place_city=city_f, place_nb=nb_f)
    city_f, nb_f, named_city = F.col("place_city"), F.col("place_nb"), F.col("place_named_city")
    other = lambda folded: (folded != nb_f) | named_city
    direct = F.get(F.filter(known.mentioned(F.col("place_folded")), lambda n: other(n.folded)), F.lit(0)).getField("name")
    phrases = F.transform(F.regexp_extract_all("place_text", F.lit(PLACE_PHRASE), F.lit(1)), strip)
    r = settled(r, place_direct=direct, place_phrases=phrases)
    folded = F.transform("place_phrases", fold)
    r = r.withColumns({"place_cities": allowed.known_each(folded), "place_nbs": known.known_each(folded)})
    nth = lambda of, i, field: F.get(F.col(of), i).getField(field)
    said = F.transform("place_phrases", lambda p, i: F.struct(p.alias("phrase"), nth("place_cities", i, "name").alias("city"), nth("place_cities", i, "listed").alias("listed"), nth("place_nbs", i, "name").alias("nb")))
    r = settled(r, place_said=said)

    def hear(got: Column, p: Column) -> Column:
        f = fold(p.phrase)
        elsewhere = p.city.isNull() & p.nb.isNull() & (city_f != "") & (f != city_f) & ~p.listed & (F.length(f) >= 5)
        hint = F.when(p.city.isNotNull() & (canonical_city(p.city) != city_f), p.city).otherwise(F.coalesce(got.city, F.when(elsewhere, p.phrase)))
        return F.struct(hint.alias("city"), F.coalesce(got.nb, F.when(other(fold(p.nb)), p.nb)).alias("nb"))

    start = F.struct(F.lit(None).cast("string").alias("city"), F.col("place_direct").alias("nb"))
    r = settled(r, place_hint=F.aggregate("place_said", start, hear))
    hint_city, hint_nb = F.col("place_hint.city"), F.col("place_hint.nb")
    seller = F.when((city_f != "") & (city_f != canonical_city(nb)), city).otherwise(nb)
    answer = lambda yes, c, n, why: F.struct(F.lit(yes).alias("suspected"), c.alias("city"), n.alias("neighborhood"), F.lit(why).alias("reason"))
    none = F.lit(None).cast("string")
    place = (
        F.when(strip(F.col("place_text")) == "", answer(False, none, none, "empty_text"))
        .when(named_city, answer(True, F.coalesce(hint_city, seller), hint_nb, "neighborhood_is_city"))
        .when(nb.isNull(), answer(True, hint_city, hint_nb, "neighborhood_missing"))
        .when(fold(hint_nb) != nb_f, answer(True, hint_city, hint_nb, "neighborhood_mismatch"))
        .when(canonical_city(hint_city) != city_f, answer(True, hint_city, hint_nb, "city_mismatch"))
        .otherwise(answer(False, none, none, "ok"))
    )
    return settled(r, place=place).drop("place_text", "place_folded", "place_city", "place_nb", "place_named_city", "place_direct", "place_phrases", "place_cities", "place_nbs", "place_said", "place_hint")


def reconciled(rows: DataFrame, cities: Sequence[str] | Catalogue, states: Sequence[str], neighborhoods: Sequence[str] | Catalogue) -> DataFrame:
    """rows (title, description, city, state, neighborhood, address) with `located`: what to keep of place and coordinates.

    located: action (unchanged, corrected, out_of_geo), city, state, neighborhood, address, clear_coords, suspected, reason,
    confidence. A corrected place is spelt as in the catalogue; a place outside the allowed cities or states is out_of_geo.
    """
    allowed, known = catalogue(rows, cities), catalogue(rows, neighborhoods)
    city, state, nb = _text("city"), _text("state"), _text("neighborhood")
    r = suspects(rows, allowed, known)
    suspected, why, hint_nb = F.col("place.suspected"), F.col("place.reason"), F.col("place.neighborhood")
    named_city = why == "neighborhood_is_city"
    to_capital = F.coalesce(named_city & hint_nb.isNotNull() & fold(state).isin(*CAPITAL_STATES), F.lit(False))
    capital = F.lit(next((name for name, _, form in allowed.names if form == CAPITAL), None)).cast("string")
    new_nb = F.coalesce(hint_nb, F.when(~named_city, nb))
    r = settled(
        r,
        place_city=F.coalesce(F.when(to_capital, capital), F.col("place.city"), city),
        place_nb=new_nb,
        place_by_text=F.col("place.city").isNotNull() | hint_nb.isNotNull() | named_city,
    )
    r = r.withColumn("place_nb", F.coalesce(known.known(fold(F.col("place_nb"))), F.col("place_nb")))
    new_city, new_nb = F.col("place_city"), F.col("place_nb")
    geo_city, geo_state = city_state(new_city, state, F.col("address"))
    r = settled(r, place_geo=F.struct(geo_city.alias("city"), geo_state.alias("state")))
    r = r.withColumn("place_listed", allowed.listed(canonical_city(F.col("place_geo.city"))))
    geo = outside(F.col("place_geo.city"), F.col("place_geo.state"), [name for name, *_ in allowed.names], list(states), F.col("place_listed"))
    last = F.coalesce(new_city, new_nb)
    said_state = F.when(last.isNull() | ~fold(last).contains(fold(state)), state)
    address = F.coalesce(F.nullif(F.concat_ws(", ", new_nb, new_city, said_state), F.lit("")), F.col("address"), F.lit(""))
    changed = (F.coalesce(canonical_city(new_city), F.lit("")) != F.coalesce(canonical_city(city), F.lit(""))) | (F.coalesce(fold(new_nb), F.lit("")) != F.coalesce(fold(nb), F.lit("")))
    sure = F.when(F.col("place_by_text"), BY_TEXT).otherwise(0.0)

    def outcome(action: str, clear: Column, sus: Column, reason: Column, confidence: Column, new: bool) -> Column:
        where = (new_city, state, new_nb, address) if new else (F.col("city"), F.col("state"), F.col("neighborhood"), F.col("address"))
        place = [c.alias(n) for c, n in zip(where, ("city", "state", "neighborhood", "address"), strict=True)]
        return F.struct(F.lit(action).alias("action"), *place, clear.alias("clear_coords"), sus.alias("suspected"), reason.alias("reason"), confidence.alias("confidence"))

    yes, no, zero = F.lit(True), F.lit(False), F.lit(0.0)
    r = settled(r, place_outside=geo, place_address=address, place_changed=changed)
    address, changed = F.col("place_address"), F.col("place_changed")
    located = (
        F.when(~suspected, outcome("unchanged", no, no, F.lit("ok"), zero, False))
        .when(F.col("place_outside").isNotNull(), outcome("out_of_geo", yes, yes, F.col("place_outside"), sure, True))
        .when(~changed, outcome("unchanged", no, yes, why, zero, False))
        .otherwise(outcome("corrected", yes, yes, why, sure, True))
    )
    return r.withColumn("located", located).drop("place", "place_city", "place_nb", "place_by_text", "place_geo", "place_listed", "place_outside", "place_address", "place_changed")


def mentions(rows: DataFrame, text: str, names: Sequence[str] | Catalogue, least: int = 4) -> DataFrame:
    """Adds `mentioned`: the first name of the catalogue, of `least` letters or more, that stands in a text, without accents and case; null for none."""
    found = catalogue(rows, names).mentioned(F.coalesce(fold(F.col(text)), F.lit("")), least)
    return rows.withColumn("mentioned", F.get(found, F.lit(0)).getField("name"))


def assigned_by_name(properties: DataFrame, areas: DataFrame) -> DataFrame:
    """properties (neighborhood, city, neighborhood_id) with the id of the area (area_id, name, city) of the same folded name.

    Cities must agree where both sides have one; of several areas the least id counts. Rows without a match or a name keep
    what they had. Names are matched once for each distinct pair of name and city, so a common one is no hot key.
    """
    key = lambda c: F.coalesce(fold(F.col(c)), F.lit(""))
    rows = properties.withColumns({"name_key": key("neighborhood"), "city_key": key("city")})
    wanted = rows.where("name_key <> ''").select("name_key", "city_key").distinct()
    a = areas.where("name IS NOT NULL").select(fold(F.col("name")).alias("area_key"), key("city").alias("area_city"), "area_id")
    fits = (F.col("name_key") == F.col("area_key")) & ((F.col("city_key") == "") | (F.col("area_city") == "") | (F.col("city_key") == F.col("area_city")))
    found = wanted.join(a, fits).groupBy("name_key", "city_key").agg(F.min("area_id").alias("found_id"))
    out = rows.join(found, ["name_key", "city_key"], "left").withColumn("neighborhood_id", F.coalesce("found_id", "neighborhood_id"))
    return out.select(*properties.columns)
