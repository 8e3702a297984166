"""Columns that are computed once for a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Columns of a step. Of more the generated method would be too large for the JVM to compile.
STEP = 8


def settled(rows: DataFrame, **new: Column) -> DataFrame:
    """`rows` with these columns, of which none is inlined into the expressions that use it.

    The optimizer merges projections, and a column that ten others use is then computed ten times, more where these are used in turn. Here the columns
    come out of generators of one row, which it doesn't merge. New columns don't see each other.
    """
    names = list(new)
    if len(names) > STEP and set(names) & set(rows.columns):
        raise ValueError("steps can't replace columns that a later one may use")
    for i in range(0, len(names), STEP):
        some = {name: new[name] for name in names[i : i + STEP]}
        kept = [F.col(f"`{c}`") for c in rows.columns if c not in some]
        rows = rows.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in some.items()]))))
    return rows
