"""Evaluate derived columns exactly once.

A filter or join above a projection is pushed below it with the projected
expression copied into it, which re-evaluates long expressions (address parsing,
point encoding) several times per row. A one-element ``inline`` is a boundary the
optimizer keeps: the columns are computed once, still inside code generation,
and filters on any other column are still pushed to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
