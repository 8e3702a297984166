"""Search in texts for the names of a catalogue, however many it holds.

The names are folded by Spark, go to the workers as one broadcast of checked size, and are put into two indexes there, once for a worker: an
Aho-Corasick automaton that finds all names in a text in one pass, and the sorted suffixes of the names, where those that hold a token stand side by
side. A row's cost depends on its text, not on the catalogue. Of several names the first in the catalogue's order counts.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Sequence
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from larkspur import on_workers
from larkspur.functions.text import fold

#: Characters of a catalogue at most; its indexes then take some hundred MB in a worker.
MOST = 4_000_000


class Index:
    """Over names (name, folded, city), in order."""

    def __init__(self, names: list[tuple[str, str, str]]):
        self.names = names

    @cached_property
    def cities(self) -> set[str]:
        return {city for _, _, city in self.names}

    @cached_property
    def _automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, (_, folded, _) in enumerate(self.names):
            if folded not in found:  # the first of equal names
                found.add_word(folded, i)
        found.make_automaton()
        return found

    @cached_property
    def _suffixes(self) -> tuple[list[str], list[list[int]]]:
        """Sorted suffixes, and for each power of two the least name of so many suffixes in a row."""
        pairs = sorted((folded[i:], at) for at, (_, folded, _) in enumerate(self.names) for i in range(len(folded)))
        least = [[at for _, at in pairs]]
        while len(least[-1]) > (step := 1 << (len(least) - 1)):
            least.append([min(a, b) for a, b in zip(least[-1], least[-1][step:], strict=False)])
        return [s for s, _ in pairs], least

    def within(self, text: str) -> set[int]:
        """Names that stand in a text, the first of equal ones."""
        return {i for _, i in self._automaton.iter(text)} if len(self.names) else set()

    def around(self, token: str) -> int | None:
        """The first name that a token stands in."""
        suffixes, least = self._suffixes
        a, b = bisect_left(suffixes, token), bisect_left(suffixes, token + "\U0010ffff")
        if a >= b:
            return None
        k = (b - a).bit_length() - 1
        return min(least[k][a], least[k][b - (1 << k)])

    def known(self, token: str | None) -> int | None:
        """The first name that equals, holds or lies in a token of three letters or more."""
        if token is None or len(token) < 3 or not self.names:
            return None
        some = self.within(token)
        around = self.around(token)
        return min(some | {around} if around is not None else some, default=None)


#: The indexes of a worker, by catalogue; the oldest goes where there are many.
_made: dict[str, Index] = {}


def _index(shared, key: str) -> Index:
    if key not in _made:
        if len(_made) >= 8:
            _made.pop(next(iter(_made)))
        _made[key] = Index(shared.value)
    return _made[key]


class Catalogue:
    """Names in order, blank ones left out, with their folded and canonical forms (`canonical`, of a folded name).

    A catalogue of over 4 million characters is refused: it is a parameter, such as the cities and quarters of a market, and no table of documents.
    """

    def __init__(self, spark: SparkSession, names: Sequence[str], canonical=lambda c: fold(c)):
        names = [n for n in names if n and n.strip()]
        if sum(map(len, names)) > MOST:
            raise ValueError(f"a catalogue has {MOST} characters at most")
        on_workers(spark)
        rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
        made = rows.select("i", "name", fold(F.col("name")).alias("folded"), canonical(F.col("name")).alias("city")).collect()
        self.names = [(r.name, r.folded, r.city) for r in sorted(made, key=lambda r: r.i) if r.folded]
        self._shared = spark.sparkContext.broadcast(self.names)
        self._key = uuid.uuid4().hex

    def mentioned(self, folded: Column, least: int = 4) -> Column:
        """The first two names (name, folded) of `least` letters or more, unlike each other, that stand in a folded text; an array, empty for none."""
        shared, key = self._shared, self._key

        def run(texts: pd.Series) -> pd.Series:
            ix = _index(shared, key)
            pick = lambda t: [ix.names[i][:2] for i in sorted(i for i in ix.within(t or "") if len(ix.names[i][1]) >= least)[:2]]
            return texts.map(lambda t: [{"name": n, "folded": f} for n, f in pick(t)])

        return F.pandas_udf(run, "array<struct<name:string,folded:string>>")(folded)

    def known(self, folded: Column) -> Column:
        """The first name that equals, holds or lies in a folded token of three letters or more; else null."""
        shared, key = self._shared, self._key

        def run(tokens: pd.Series) -> pd.Series:
            ix = _index(shared, key)
            return tokens.map(lambda t: None if (i := ix.known(t)) is None else ix.names[i][0])

        return F.pandas_udf(run, "string")(folded)

    def known_each(self, folded: Column) -> Column:
        """`known` of each token of an array, with whether it is one of the canonical forms: an array of (name, listed)."""
        shared, key = self._shared, self._key

        def one(ix: Index, t: str | None) -> dict:
            i = ix.known(t)
            return {"name": None if i is None else ix.names[i][0], "listed": t in ix.cities}

        def run(tokens: pd.Series) -> pd.Series:
            ix = _index(shared, key)
            return tokens.map(lambda ts: None if ts is None else [one(ix, t) for t in ts])

        return F.pandas_udf(run, "array<struct<name:string,listed:boolean>>")(folded)

    def listed(self, city: Column) -> Column:
        """Whether a canonical form is one of the catalogue's; false for null."""
        shared, key = self._shared, self._key

        def run(cities: pd.Series) -> pd.Series:
            ix = _index(shared, key)
            return cities.map(lambda c: c in ix.cities)

        return F.pandas_udf(run, "boolean")(city)
