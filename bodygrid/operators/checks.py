"""Problems are rows: rule, the row they are about, and a message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problem(rows: DataFrame, rule: str, row_id: Column, message: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), row_id.cast("string").alias("row_id"), message.cast("string").alias("message"))


def all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def broken_rules(df: DataFrame, rules: dict[str, Column], row_id: Column, path: Column | None = None) -> DataFrame:
    """One output row per (row, broken rule): all row-local rules in a single scan of the table."""
    checks = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()])
    out = df.select(row_id.cast("string").alias("row_id"), F.explode(F.array_compact(checks)).alias("rule"))
    return out


def verdicts(df: DataFrame, unverified: Column, vacuous: Column, passed: Column) -> DataFrame:
    """Three-valued outcome: a check that could not run or had nothing to check is never a pass."""
    return df.withColumn(
        "verdict",
        F.when(unverified, "unverified").when(vacuous, "vacuous").when(passed, "pass").otherwise("fail"),
    )


def assert_no_problems(problems: DataFrame) -> None:
    first = problems.limit(20).collect()
    if first:
        raise ValueError("; ".join(f"{r['rule']} {r['row_id']}" for r in first))


def drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows only in one of two tables with the same columns, with their counts on each side.

    One shuffle on the row itself; duplicates are compared by count.
    """
    cols = expected.columns
    e = expected.select(*cols, F.lit(1).alias("_e"), F.lit(0).alias("_a"))
    a = actual.select(*cols, F.lit(0).alias("_e"), F.lit(1).alias("_a"))
    g = e.unionByName(a).groupBy(*cols).agg(F.sum("_e").alias("n_expected"), F.sum("_a").alias("n_actual"))
    return g.filter("n_expected <> n_actual")
