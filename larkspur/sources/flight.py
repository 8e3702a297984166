"""JSON that a page pushes in script strings, piece by piece, and the ads in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.columns import settled
from larkspur.sources.files import NEXT_DATA

# How pages push their pieces, and the places of an ad list in a page's state, first match first.
PUSHED = r'(?s)self\.__next_f\.push\(\[1,"((?:[^"\\]|\\.)*+)"\]\)'
STATE_PATHS = ("search.ads", "search", "ads", "searchResult.ads", "searchResult", "listings", "data.ads", "data")
PROPS_PATHS = ("ads", "listings", "data")
AD_IDS = ("listId", "list_id", "id")


def unescaped(script: Column) -> Column:
    r"""A script string without its escapes: \n, \r, \t, \", \\ and \uXXXX are read; of any other the backslash goes."""
    known = F.regexp_replace(script, r'(?s)(\\[nrt"\\]|\\u[0-9A-Fa-f]{4})|\\(.)', "$1$2")
    text = F.concat(F.lit('{"s":"'), known, F.lit('"}'))
    return F.from_json(text, "s string", {"allowUnquotedControlChars": "true"})["s"]


def pushed(html: Column) -> Column:
    """What a page pushed, in one text: pieces are joined once unescaped, so a value or an escape inside it may go on in the next piece. Empty without any; null of null."""
    return F.array_join(F.transform(F.regexp_extract_all(html, F.lit(PUSHED), 1), unescaped), "")


def values_after(text: Column, marker: str, opens: str) -> Column:
    """The JSON value behind each `marker` (a key with its quotes), from the next `opens` ([ or {) on, in order; what isn't whole is left out.

    Where the value ends is for the JSON parser to say, which knows brackets from those in strings. A text of n markers is read n times.
    """
    # a name within a lambda is computed once, so the text is split once
    rests = lambda parts: F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), f"{marker}:"))
    starts = F.transform(F.flatten(F.transform(F.array(F.split(text, rf"{marker}\s*:")), rests)), lambda r: F.when(F.contains(r, F.lit(opens)), F.substring(r, F.locate(opens, r), F.length(r))))
    found = F.transform(starts, lambda r: F.get_json_object(r, "$"))
    return F.filter(found, lambda v: v.isNotNull() & F.startswith(v, F.lit(opens)))


def real_ads(items: Column) -> Column:
    """Of a JSON array's text the objects with an id, as JSON; slots for advertising and what is no object go. Null for no array."""
    array = F.when(F.startswith(F.trim(items), F.lit("[")), F.from_json(items, "array<string>"))
    has = lambda x, k: ~F.coalesce(F.get_json_object(x, f"$.{k}"), F.lit("")).isin("", "0", "false", "{}", "[]")
    ad = lambda x: F.coalesce(F.startswith(x, F.lit("{")) & (has(x, AD_IDS[0]) | has(x, AD_IDS[1]) | has(x, AD_IDS[2])), F.lit(False))
    return F.filter(array, ad)


def page_props(html: Column) -> Column:
    """The properties in a page's app state, as JSON; null without."""
    return F.get_json_object(F.nullif(F.regexp_extract(html, NEXT_DATA, 1), F.lit("")), "$.props.pageProps")


def state_ads(props: Column) -> Column:
    """The ads in `page_props`: the first of the known places that holds an array decides, even one without ads; null where none does."""
    full = lambda c: F.when(~c.isin("{}", "[]", "", "0", "false"), c)
    state = F.coalesce(full(F.get_json_object(props, "$.initialState")), full(F.get_json_object(props, "$.state")))
    array = lambda c: F.when(F.startswith(c, F.lit("[")), c)
    places = [array(F.get_json_object(state, f"$.{p}")) for p in STATE_PATHS] + [array(F.get_json_object(props, f"$.{p}")) for p in PROPS_PATHS]
    return real_ads(F.coalesce(array(state), *places))


def pushed_ads(text: Column) -> Column:
    """The ads of the first list in `pushed` that has any; null without."""
    lists = F.filter(F.transform(values_after(text, '"ads"', "["), real_ads), lambda ads: F.size(ads) > 0)
    return F.get(lists, F.lit(0))


def with_ads(pages: DataFrame, html: str = "html", name: str = "ads") -> DataFrame:
    """Adds a search page's ads as JSON objects: those in its app state, else those that it pushed, else none. Each page is searched once."""
    props, text, own = "page props of ads", "pushed text of ads", "own ads"
    rows = settled(pages, **{props: page_props(F.col(html)), text: pushed(F.col(html))})
    rows = settled(rows, **{own: state_ads(F.col(f"`{props}`"))})
    ads = F.coalesce(F.when(F.size(f"`{own}`") > 0, F.col(f"`{own}`")), pushed_ads(F.col(f"`{text}`")), F.array().cast("array<string>"))
    return settled(rows, **{name: ads}).drop(props, text, own)


def band_holds(price: Column, low: int, high: int) -> Column:
    """Of a group: whether a portal kept to a price band, that is at least half of the priced rows (positive) lie in it; false without any."""
    priced = F.count_if(price > 0)
    return F.when(priced > 0, F.count_if((price > 0) & price.between(low, high)) / priced >= 0.5).otherwise(F.lit(False))


def pages_read(sizes: Column, most: int, full: int = 10) -> Column:
    """(pages, rows, saturated) of a window from its pages' sizes in order: reading ends before an empty page and after one below `full` rows; `most` full pages may hide more."""
    n = F.size(F.slice(sizes, 1, most))
    seen = F.slice(sizes, 1, most)
    stop = F.coalesce(F.array_min(F.transform(F.filter(F.transform(seen, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p.x < full), lambda p: p.i + F.when(p.x > 0, 1).otherwise(0))), n)
    kept = F.slice(seen, 1, stop)
    return F.struct(stop.alias("pages"), F.aggregate(kept, F.lit(0), lambda a, x: a + x.cast("int")).alias("rows"), ((stop == most) & (F.coalesce(F.array_min(kept), F.lit(0)) >= full)).alias("saturated"))
