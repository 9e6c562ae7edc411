"""Published tables and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bodygrid.functions import address as ad
from bodygrid.operators.coverings import root_units


def fingerprint(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Order-independent content fingerprint per group: row count and the sum of row hashes.

    It is a map-side-combined sum, so it needs no sorted list of the whole table.
    """
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row).alias("fingerprint"))


def publish_index(structures: DataFrame, index: DataFrame, path: str) -> None:
    """Structures and coverings of each index version, cells sorted so constant-cell scans skip files."""
    cells = index.withColumn("cell", ad.cell_text(F.col("cell_key")))
    cells.repartitionByRange("index_version", "cell").sortWithinPartitions("index_version", "cell").write.mode("overwrite").partitionBy(
        "index_version"
    ).parquet(f"{path}/structure_cells")
    structures.write.mode("overwrite").partitionBy("index_version").parquet(f"{path}/structures")
    report = index_report(structures, index)
    report.write.mode("overwrite").partitionBy("index_version").parquet(f"{path}/report")


def index_report(structures: DataFrame, index: DataFrame) -> DataFrame:
    """Per structure: cells, exact measure in root units, depth range, frames."""
    k = F.col("cell_key")
    lo = ad.key_lo(k)
    frame = F.when(lo < ad.fr.BV_START, "BD").when(lo < ad.fr.BR_START, "BV").otherwise("BR")
    g = index.groupBy("index_version", "structure_id").agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum(root_units(k)).alias("root_units"),
        F.min(ad.key_rung(k)).alias("coarsest"),
        F.max(ad.key_rung(k)).alias("finest"),
        F.array_join(F.sort_array(F.collect_set(frame)), ",").alias("frames"),
    )
    return structures.select("index_version", "structure_id").join(g, ["index_version", "structure_id"], "left")


def publish_documents(pages: DataFrame, path: str) -> None:
    """Document pages as JSON text, one directory per kind; bodies are already JSON."""
    pages.select("kind", F.col("body").alias("value")).write.mode("overwrite").partitionBy("kind").text(path)


def citation_markdown(summary: DataFrame) -> str:
    """The outcome table as Markdown. One row per status, so collecting it is bounded."""
    rows = summary.orderBy("status").collect()
    lines = ["| status | papers | corroborated | contradicted |", "| --- | --- | --- | --- |"]
    return "\n".join(lines + [f"| {r['status']} | {r['n']} | {r['corroborated']} | {r['contradicted']} |" for r in rows])
