"""Driver tables read as anatomy tables.

The driver's tables hold no anatomy, so each stand-in is a deterministic integer
projection of a whole table that DuckDB can repeat: the ``*_SQL`` constants are
the same projections as SQL for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bodygrid import frames as fr
from bodygrid.functions import address as ad


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _octal(n, width):
    return F.lpad(F.conv(n.cast("string"), 10, 8), width, "0")


def _levels():
    return F.array(*[F.lit(x) for x in fr.LEVELS])


LEVELS_SQL = "[" + ",".join(f"'{x}'" for x in fr.LEVELS) + "]"


LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def lineitem_cells(spark, sf_dir) -> DataFrame:
    """One canonical cell per lineitem row: BD for a third of the suppliers, BR for a tenth, BV for the rest."""
    return ad.with_key(with_line_cell(table(spark, sf_dir, "lineitem").select(*LINE_KEYS)))


def with_line_cell(li: DataFrame) -> DataFrame:
    """Adds the cell that the keys of a lineitem row, and nothing else, decide."""
    d = 1 + F.col("l_linenumber") % 4
    octal = F.substring(F.reverse(_octal(F.col("l_partkey"), 6)), F.lit(1), d)
    hemi = F.when(F.col("l_orderkey") % 2 == 0, "L").otherwise("R")
    s = F.col("l_suppkey") % 24
    bd = F.concat(
        F.lit("BD-"),
        F.element_at(_levels(), (F.col("l_orderkey") % 29 + 1).cast("int")),
        F.lit("-"),
        F.lpad((F.floor(s / 2) + 1).cast("string"), 2, "0"),
        F.when(s % 2 == 1, "O").otherwise("I"),
        F.lit("-"),
        octal,
    )
    br = F.concat(F.lit("BR-"), hemi, F.lit("-"), F.conv((F.col("l_suppkey") % 12).cast("string"), 10, 16), octal)
    bv = F.concat(F.lit("BV-"), hemi, F.lit("-"), octal)
    cell = F.when(F.col("l_suppkey") % 3 == 0, bd).when(F.col("l_suppkey") % 10 == 1, br).otherwise(bv)
    return li.withColumn("cell", cell)


OCT6 = "reverse(lpad(to_base(l_partkey, 8), 6, '0'))"
LINEITEM_CELLS_SQL = f"""lineitem_cells AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_suppkey % 3 = 0 THEN
      'BD-' || {LEVELS_SQL}[CAST(l_orderkey % 29 + 1 AS INT)] || '-'
        || lpad(CAST((l_suppkey % 24) // 2 + 1 AS VARCHAR), 2, '0')
        || CASE WHEN (l_suppkey % 24) % 2 = 1 THEN 'O' ELSE 'I' END || '-' || left({OCT6}, CAST(1 + l_linenumber % 4 AS INT))
    WHEN l_suppkey % 10 = 1 THEN
      'BR-' || CASE WHEN l_orderkey % 2 = 0 THEN 'L' ELSE 'R' END || '-' || to_base(l_suppkey % 12, 16)
        || left({OCT6}, CAST(1 + l_linenumber % 4 AS INT))
    ELSE 'BV-' || CASE WHEN l_orderkey % 2 = 0 THEN 'L' ELSE 'R' END || '-' || left({OCT6}, CAST(1 + l_linenumber % 4 AS INT))
    END AS cell
  FROM lineitem)"""


def part_structures(spark, sf_dir) -> DataFrame:
    """Parts as named structures."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("S:"), F.col("p_partkey")).alias("structure_id"),
        F.col("p_name").alias("structure_name"),
        F.col("p_brand").alias("source"),
        F.col("p_partkey").alias("pos"),
    )


PART_STRUCTURES_SQL = """structures AS (
  SELECT 'S:' || p_partkey AS structure_id, p_name AS structure_name, p_brand AS source, p_partkey AS pos FROM part)"""


def part_structure_cells(spark, sf_dir) -> DataFrame:
    """Three raw cells per part (not normalised): BV at 1 to 4 digits, one nested pair, one BD cell."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    octal = F.reverse(_octal(F.col("p_partkey"), 6))
    hemi = F.when(F.col("p_size") % 2 == 0, "L").otherwise("R")
    d = 1 + F.col("p_size") % 4
    a = F.concat(F.lit("BV-"), hemi, F.lit("-"), F.substring(octal, F.lit(1), d))
    b = F.concat(F.lit("BV-"), hemi, F.lit("-"), F.substring(octal, F.lit(1), d + 1))
    c = F.concat(
        F.lit("BD-"),
        F.element_at(_levels(), (F.col("p_partkey") % 29 + 1).cast("int")),
        F.when(
            F.col("p_size") % 5 > 0,
            F.concat(
                F.lit("-"),
                F.lpad((F.col("p_size") % 12 + 1).cast("string"), 2, "0"),
                F.when(F.col("p_partkey") % 2 == 1, "O").otherwise("I"),
            ),
        ).otherwise(""),
    )
    cells = p.select(F.concat(F.lit("S:"), F.col("p_partkey")).alias("structure_id"), F.explode(F.array(a, b, c)).alias("cell"))
    return ad.with_key(cells)


POCT = "reverse(lpad(to_base(p_partkey, 8), 6, '0'))"
PART_CELLS_SQL = f"""structure_cells_raw AS (
  SELECT 'S:' || p_partkey AS structure_id, unnest([
    'BV-' || CASE WHEN p_size % 2 = 0 THEN 'L' ELSE 'R' END || '-' || left({POCT}, CAST(1 + p_size % 4 AS INT)),
    'BV-' || CASE WHEN p_size % 2 = 0 THEN 'L' ELSE 'R' END || '-' || left({POCT}, CAST(2 + p_size % 4 AS INT)),
    'BD-' || {LEVELS_SQL}[CAST(p_partkey % 29 + 1 AS INT)] || CASE WHEN p_size % 5 > 0 THEN
      '-' || lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') || CASE WHEN p_partkey % 2 = 1 THEN 'O' ELSE 'I' END ELSE '' END
  ]) AS cell FROM part),
structure_cells AS (
  SELECT DISTINCT structure_id, cell FROM structure_cells_raw a
  WHERE NOT EXISTS (SELECT 1 FROM structure_cells_raw b WHERE b.structure_id = a.structure_id
    AND starts_with(a.cell, b.cell) AND b.cell <> a.cell))"""

INDEX_VERSION = "parts-1"

# Measure of a cell in units of 1/(24 * 8^12) of its frame root, from its text only.
UNITS_SQL = """CASE
  WHEN {c} LIKE 'BD%' THEN CASE WHEN length({c}) = 6 THEN 24 * (1::BIGINT << 36) ELSE (1::BIGINT << (36 - 3 * greatest(length({c}) - 11, 0))) END
  WHEN {c} LIKE 'BV%' THEN 24 * (1::BIGINT << (36 - 3 * greatest(length({c}) - 5, 0)))
  ELSE 24 * (1::BIGINT << (36 - 4 * (length({c}) - 6))) END"""


def units(c: str) -> str:
    return UNITS_SQL.format(c=c)
