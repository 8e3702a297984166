"""Categories of enrichment, and a verdict in words that needs no model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories.
BANDS = ("highly_undervalued", "slightly_undervalued", "average", "slightly_overvalued", "highly_overvalued")
CONDITIONS = ("pristine", "good", "average", "needs_renovation", "poor")
DESIRABILITY = ("highly_desirable", "good", "average", "undesirable", "poor")
# Phrases of the verdict by language.
PHRASES = {
    "en": {
        "bands": ("Highly undervalued", "Slightly undervalued", "Priced near the neighbourhood average", "Slightly above neighbourhood average", "Highly above neighbourhood average"),
        "conditions": ("excellent condition", "good condition", "average condition", "needs renovation", "poor condition"),
        "quality": "neighbourhood quality %s%%", "one_risk": "1 neighbourhood risk (%s)", "risks": "%s neighbourhood risks",
        "no_concern": "no listing claim alerts", "one_concern": "1 listing claim concern", "concerns": "%s listing claim concerns", "praises": "%s positive listing claims", "empty": "Not enough data for a deal verdict",
    },
    "pt-BR": {
        "bands": ("Muito abaixo do mercado", "Ligeiramente abaixo do mercado", "Preço próximo à média do bairro", "Ligeiramente acima da média do bairro", "Muito acima da média do bairro"),
        "conditions": ("excelente estado", "bom estado", "estado médio", "precisa de reforma", "mau estado"),
        "quality": "qualidade do bairro %s%%", "one_risk": "1 risco de bairro (%s)", "risks": "%s riscos de bairro",
        "no_concern": "sem alertas nas reivindicações do anúncio", "one_concern": "1 preocupação nas reivindicações do anúncio", "concerns": "%s preocupações nas reivindicações do anúncio", "praises": "%s reivindicações positivas do anúncio", "empty": "Dados insuficientes para um veredito",
    },
}


def category(raw: Column, codes: tuple[str, ...], default: str | None = None, also: dict[str, str] | None = None) -> Column:
    """A code by its own or its spaced spelling, in any case; else `default`, or the trimmed text where there is none."""
    key = F.replace(F.replace(F.lower(F.trim(raw)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    found = F.when(key.isin(*codes), key)
    for spelling, code in (also or {}).items():
        found = F.coalesce(found, F.when(key == spelling, code))
    return F.coalesce(found, F.lit(default) if default else F.nullif(F.trim(raw), F.lit("")))


def band_code(raw: Column) -> Column:
    return category(raw, BANDS)


def condition_code(raw: Column) -> Column:
    return category(raw, CONDITIONS, "average")


def desirability_code(raw: Column) -> Column:
    return category(raw, DESIRABILITY, "average", {"standard": "average"})


def verdict(band: Column, condition: Column, quality: Column, risks: Column, claims: Column, red: Column, green: Column, language: str = "en") -> Column:
    """A sentence of what is known; `claims` says whether the listing's claims were judged at all.

    Null inputs give no part; an unknown band is quoted as it is; an unknown language reads as English.
    """
    p = PHRASES.get(language, PHRASES["en"])
    worded = lambda c, codes, words: F.coalesce(*[F.when(c == x, w) for x, w in zip(codes, words, strict=True)], c)
    many = lambda n, phrase: F.format_string(phrase, n.cast("string"))
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    judged = F.coalesce(claims, F.lit(False))
    parts = F.array_compact(
        F.array(
            worded(band_code(band), BANDS, p["bands"]),
            F.when(F.trim(condition) != "", worded(condition_code(condition), CONDITIONS, p["conditions"])),
            F.when(quality.isNotNull(), many(F.bround(quality * 100).cast("long"), p["quality"])),
            F.when(size(risks) == 1, F.format_string(p["one_risk"], F.get(risks, F.lit(0)))).when(size(risks) > 1, many(size(risks), p["risks"])),
            F.when(judged, F.when(size(red) == 0, p["no_concern"]).when(size(red) == 1, p["one_concern"]).otherwise(many(size(red), p["concerns"]))),
            F.when(judged & (size(green) >= 2), many(size(green), p["praises"])),
        )
    )
    rest = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), ", ")
    return F.when(F.size(parts) == 0, p["empty"]).when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(F.concat(F.get(parts, F.lit(0)), F.lit(" — "), rest))
