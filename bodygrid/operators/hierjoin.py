"""Hierarchical joins on cell keys.

Cells are nested or disjoint, so "overlaps" is two equi-joins: the ancestors
(or self) of the left cell against the right keys, and the strict ancestors of
the right cell against the left keys. Strictness makes the legs disjoint.
No range condition is left for the join itself, so Spark plans hash or
sort-merge joins and adaptive execution can turn either into a broadcast join
when the measured side is small, or split a skewed partition when it is not.

Coarse keys are the ones that can be hot (every cell of a hemisphere has the
same root). They are salted: the exploded side is spread over ``SALTS`` buckets
and the few rows of the other side at those rungs are repeated once per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bodygrid.functions import address as ad

SALTS = 8
COARSE_RUNG = 2  # rungs 0..2 may be hot; deeper keys are left to adaptive execution


def _rungs_present(df: DataFrame, key: str) -> Column:
    """The at most 14 rungs that occur on a side, as an uncorrelated subquery."""
    return df.select(F.collect_set(ad.key_rung(F.col(key)))).scalar()


def _salted_probe(key: Column, salts: int, by: Column) -> Column:
    return F.when(ad.key_rung(key) <= COARSE_RUNG, F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0)).cast("int")


def _salted_build(key: Column, salts: int) -> Column:
    return F.when(ad.key_rung(key) <= COARSE_RUNG, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))


def ancestor_join(
    fine: DataFrame,
    coarse: DataFrame,
    fine_key: str,
    coarse_key: str,
    *,
    by: Sequence[str] = (),
    strict: bool = False,
    how: str = "inner",
    salts: int = SALTS,
    prune: bool = False,
) -> DataFrame:
    """Join each ``fine`` row to the ``coarse`` rows whose cell contains it.

    ``by`` are extra equality columns, by the same name on both sides. ``how``
    may be ``inner`` or ``left_semi``; a semi join can repeat a fine row once per
    matching rung, so callers that need one row take ``distinct``. ``prune`` explodes
    only to rungs that occur in ``coarse``; it scans that side once more, so it is for
    stored tables such as a published index.
    """
    rungs = _rungs_present(coarse, coarse_key) if prune else None
    f = fine
    if rungs is not None:
        f = f.withColumn("_rungs", rungs)
    f = f.withColumn(
        # outer: no inferred "array is not empty" filter re-evaluating the keys; the join drops NULL keys
        "_anc", F.explode_outer(ad.ancestor_keys(F.col(fine_key), not strict, F.col("_rungs") if prune else None))
    ).drop("_rungs")
    c = coarse.withColumn("_anc", F.col(coarse_key))
    on = ["_anc", *by]
    if salts > 1:
        f = f.withColumn("_salt", _salted_probe(F.col("_anc"), salts, F.col(fine_key)))
        c = c.withColumn("_salt", F.explode(_salted_build(F.col("_anc"), salts)))
        on.append("_salt")
    return f.join(c, on, how).drop("_anc", "_salt")


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    *,
    by: Sequence[str] = (),
    salts: int = SALTS,
    prune_left: bool = False,
) -> DataFrame:
    """Every (left, right) pair whose cells overlap, with the finer cell's key.

    Column names other than ``by`` must be distinct. ``prune_left`` explodes the left
    side only to rungs the (stored) right side has. Adds ``finer_key``: the
    intersection of the pair.
    """
    inside = ancestor_join(left, right, left_key, right_key, by=by, salts=salts, prune=prune_left).withColumn(
        "finer_key", F.col(left_key)
    )
    around = ancestor_join(right, left, right_key, left_key, by=by, strict=True, salts=salts).withColumn(
        "finer_key", F.col(right_key)
    )
    return inside.unionByName(around)


def rolled_join(cells: DataFrame, rolled: DataFrame, key: str, above_key: str, spread: Sequence[str] = (), *, salts: int = SALTS) -> DataFrame:
    """``cells`` next to the sums a roll-up has for the same key.

    A coarse key has a row for nearly every group of the roll-up: those rows are spread by the columns ``spread``.
    """
    if not spread:
        return cells.join(rolled, cells[key] == rolled[above_key])
    c = cells.withColumn("_salt", F.explode(_salted_build(F.col(key), salts))).withColumn("_at", F.col(key))
    r = rolled.withColumn("_at", F.col(above_key))
    r = r.withColumn("_salt", F.when(ad.key_rung(F.col(above_key)) <= COARSE_RUNG, F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    return c.join(r, ["_at", "_salt"]).drop("_at", "_salt")


def contained_semi(
    probe: DataFrame, covering: DataFrame, probe_key: str, covering_key: str, *, by: Sequence[str] = ()
) -> DataFrame:
    """Probe rows wholly inside some covering cell, each once per matching rung."""
    cov = covering.select(F.col(covering_key), *by).distinct()
    return ancestor_join(probe, cov, probe_key, covering_key, by=by, how="left_semi")


def overlap_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Distinct left keys (with ``by``) that some right cell overlaps.

    Works on distinct keys of both sides, so repeated cells cost nothing.
    """
    lk = left.select(F.col(left_key).alias("_lk"), *by).distinct()
    rk = right.select(F.col(right_key).alias("_rk"), *by).distinct()
    inside = ancestor_join(lk, rk, "_lk", "_rk", by=by, how="left_semi")
    above = (
        ancestor_join(rk, lk, "_rk", "_lk", by=by, strict=True).select("_lk", *by)
    )
    return inside.select("_lk", *by).unionByName(above).distinct().withColumnRenamed("_lk", left_key)


def overlap_semi(left: DataFrame, right: DataFrame, left_key: str, right_key: str, *, by: Sequence[str] = ()) -> DataFrame:
    return left.join(overlap_keys(left, right, left_key, right_key, by=by), [left_key, *by], "left_semi")


def overlap_anti(left: DataFrame, right: DataFrame, left_key: str, right_key: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Left rows that no right cell overlaps."""
    return left.join(overlap_keys(left, right, left_key, right_key, by=by), [left_key, *by], "left_anti")


# ---- scans of a stored cell table --------------------------------------------


def descendant_scan(df: DataFrame, address: str, cell: str = "cell") -> DataFrame:
    """Rows at or below one cell: a range filter that reaches Parquet statistics."""
    lo, hi = ad.prefix_range(address)
    return df.filter((F.col(cell) >= lo) & (F.col(cell) < hi))


def strict_ancestors(address: str) -> list[str]:
    """Containing addresses of one canonical literal, frame root first."""
    frame, *rest = address.split("-")
    stem = {"BD": 10, "BV": 4, "BR": 4}[frame]
    out = [address[:6]] if frame == "BD" else [] if frame == "BR" else [address[:4]]
    if frame == "BD" and len(address) >= 10:
        out.append(address[:10])
    out += [address[:k] for k in range(stem + 2, len(address) + 1)]
    return [a for a in out if a != address]


def ancestor_scan(df: DataFrame, address: str, cell: str = "cell") -> DataFrame:
    keys = strict_ancestors(address)
    return df.filter(F.col(cell).isin(*keys)) if keys else df.filter(F.lit(False))


def overlap_scan(df: DataFrame, address: str, cell: str = "cell") -> DataFrame:
    """Rows overlapping one cell in either direction: one pushed-down filter."""
    lo, hi = ad.prefix_range(address)
    keys = strict_ancestors(address)
    cond = (F.col(cell) >= lo) & (F.col(cell) < hi)
    return df.filter(cond | F.col(cell).isin(*keys) if keys else cond)


def covering_scan(df: DataFrame, covering: DataFrame, key: str = "cell_key", covering_key: str = "cell_key") -> DataFrame:
    """Rows overlapping any cell of a covering table, each row once."""
    cov = covering.select(F.col(covering_key).alias("_ck"))
    return overlap_semi(df, cov, key, "_ck")
