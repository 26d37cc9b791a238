"""Columns that are computed once and not inlined into the filters above them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add (or replace) derived columns behind a one-row generator.

    Filters are pushed through projections by substituting the expressions, which
    repeats long byte-decoding expressions many times over. They are not pushed
    through a generator whose output they read.
    """
    kept = [c for c in df.columns if c not in columns]
    made = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_settled")
    return df.select(*df.columns, made).select(*kept, "_settled.*")
