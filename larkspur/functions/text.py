"""Text functions on columns; only Jaro-Winkler needs an Arrow UDF."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of listing types, price types and property types.
LISTING_TYPES = {"rent": "rent", "aluguel": "rent", "alugar": "rent", "sale": "sale", "venda": "sale", "vender": "sale", "comprar": "sale", "both": "both", "ambos": "both"}
PRICE_TYPES = {"rent": "rent", "aluguel": "rent", "alugar": "rent", "sale": "sale", "venda": "sale", "vender": "sale", "comprar": "sale"}
PROPERTY_TYPES = {
    "apartment": "apartment", "apartamento": "apartment", "apartamentos": "apartment", "apto": "apartment", "apt": "apartment",
    "house": "house", "casa": "house", "casas": "house",
    "condo_house": "condo_house", "casa_condominio": "condo_house", "casacondominio": "condo_house", "casa_em_condominio": "condo_house", "casaemcondominio": "condo_house",
    "studio": "studio", "kitnet": "studio", "kitinete": "studio", "kit": "studio",
}
#: Words that stand for each other in a search.
SYNONYMS = (("penthouse", "cobertura"), ("backyard", "quintal"), ("doorman", "portaria"), ("townhouse", "sobrado"), ("luxury", "luxo"), ("metro", "subway", "metrô"), ("garage", "garagem"))
#: Title cues and price bands of rent and sale.
RENT_CUES = ("alugo", "aluguel", "para alugar", "aluga-se", "aluga se", "para locação", "para locacao", "locação", "locacao")
SALE_CUES = ("à venda", "a venda", "vende-se", "vende se", "para venda")
SALE_FLOOR, RENT_CEILING = 80_000.0, 30_000.0

_MARKS = "".join(chr(c) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFKD", chr(c))) > 1 and ord(unicodedata.normalize("NFKD", chr(c))[0]) < 128)
_PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in _MARKS)


def fold(c: Column) -> Column:
    """Trimmed, lower case, without accents of Latin letters or combining marks."""
    return F.lower(F.translate(F.regexp_replace(F.trim(c), "[\\u0300-\\u036f]", ""), _MARKS, _PLAIN))


def fold_key(c: Column) -> Column:
    return F.regexp_replace(fold(c), r"[\s\-]+", "_")


def _lookup(table: dict[str, str], c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    key = fold_key(c)
    return F.coalesce(F.try_element_at(known, F.coalesce(key, F.lit(""))), F.try_element_at(known, F.coalesce(F.replace(key, F.lit("_"), F.lit("")), F.lit(""))))


def listing_type(c: Column) -> Column:
    return _lookup(LISTING_TYPES, c)


def price_type(c: Column) -> Column:
    return _lookup(PRICE_TYPES, c)


def property_type(c: Column) -> Column:
    return _lookup(PROPERTY_TYPES, c)


def property_type_in(c: Column) -> Column:
    """The type of the longest spelling that stands in a text as whole words; null if none does."""
    key = F.concat(F.lit("_"), fold_key(c), F.lit("_"))
    longest_first = sorted(PROPERTY_TYPES, key=len, reverse=True)
    return F.coalesce(*[F.when(key.contains(f"_{x}_"), PROPERTY_TYPES[x]) for x in longest_first])


def property_type_spellings(raw: str) -> list[str]:
    """All lower-case spellings that a filter on `raw` accepts."""
    key = re.sub(r"[\s\-]+", "_", raw.strip().lower())
    kind = PROPERTY_TYPES.get(key)
    return sorted({raw.strip().lower()} | ({k for k, v in PROPERTY_TYPES.items() if v == kind} | {k.replace("_", " ") for k, v in PROPERTY_TYPES.items() if v == kind} if kind else set()))


#: A quarter whose name reads like a cue, and whole words of sale.
MASKED, SALE_WORDS = r"(?i)venda[\s\-]*nova", (r"\bvendo\b", r"\bvenda\b")


def listing_type_from(title: Column, price: Column, current: Column) -> Column:
    """Title cues, else price band; where they differ the price; else the current type; else sale."""
    t = F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), MASKED, " "))
    has = lambda cues: F.greatest(*[t.contains(x) for x in cues])
    rent, sale = has(RENT_CUES), has(SALE_CUES) | t.rlike(SALE_WORDS[0]) | t.rlike(SALE_WORDS[1])
    by_title = F.when(rent & sale, None).when(rent, "rent").when(sale, "sale")
    by_price = F.when(price >= SALE_FLOOR, "sale").when((price > 0) & (price < RENT_CEILING), "rent")
    return F.coalesce(by_price, by_title, F.when(current.isin("rent", "sale"), current), F.lit("sale"))


def brazilian_number(c: Column) -> Column:
    """R$ 1.234,56 -> 1234.56; null for none above 0."""
    x = F.regexp_replace(F.regexp_replace(c, r"[^0-9,.]", ""), r"\.", "")
    x = F.replace(x, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(x > 0, x)


def clock_seconds(c: Column) -> Column:
    """H:MM:SS to seconds, hours over 23 too; null if it isn't one."""
    part = lambda i: F.regexp_extract(F.trim(c), r"^(\d+):([0-5]?\d):([0-5]?\d)$", i).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def flag_text(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def unit_clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def embedding_text(title: Column, description: Column, limit: int = 8000) -> Column:
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.substring(F.concat_ws("\n", blank(title), blank(description)), 1, limit)


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.strip()) if not unicodedata.combining(c)).casefold()


def expand_query(text: str | None) -> str:
    """Appends the counterparts of the words that `SYNONYMS` knows; a second call adds nothing. Null is an empty text.

    A group is known by any of its words without accents; a counterpart stays out only if it stands there with its accents.
    """
    query = (text or "").strip()
    holds = lambda where, t: re.search(rf"(?<!\w){re.escape(t)}(?!\w)", where) is not None
    plain, written = _plain(query), query.casefold()
    more = [t for group in SYNONYMS if any(holds(plain, _plain(t)) for t in group) for t in group if not holds(written, t.casefold())]
    return " ".join([query, *more])


@lru_cache(maxsize=100_000)  # titles of one market repeat
def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, t in zip(b, taken, strict=True) if t]
    m = len(left)
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def _jaro_winklers(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_jaro_winkler(x, y) if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype=float)


def jaro_winkler_at_most(a: Column, b: Column) -> Column:
    """What `similarity` by Jaro-Winkler can't exceed, from the lengths and the first four letters alone: a shorter text has no more letters in common than its own."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    jaro = (2 + F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))) / 3
    same = [F.substring(x, 1, n) == F.substring(y, 1, n) for n in (4, 3, 2, 1)]
    prefix = F.when(same[0], 4).when(same[1], 3).when(same[2], 2).when(same[3], 1).otherwise(0)
    return F.when((F.length(x) > 0) & (F.length(y) > 0), jaro + 0.1 * prefix * (1 - jaro)).otherwise(0.0)


def jaro_winkler(a: Column, b: Column) -> Column:
    """0 for null or empty strings."""
    return F.pandas_udf(_jaro_winklers, "double")(a, b)


def similarity(a: Column, b: Column, algorithm: str = "jaro_winkler") -> Column:
    """In [0, 1]; 0 for null or empty strings and for an unknown algorithm."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    if algorithm == "levenshtein":
        longest = F.greatest(F.length(x), F.length(y))
        got = 1 - F.levenshtein(x, y) / F.nullif(longest, F.lit(0))
        return F.when((F.length(x) > 0) & (F.length(y) > 0), got).otherwise(0.0)
    if algorithm == "token_sort":
        tokens = lambda c: F.array_join(F.array_sort(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")), " ")
        return jaro_winkler(tokens(x), tokens(y))
    return jaro_winkler(x, y) if algorithm == "jaro_winkler" else F.lit(0.0)
