"""Geometric regions and point sets to coverings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bodygrid import frames as fr
from bodygrid.functions import address as ad
from bodygrid.functions import points as pt
from bodygrid.operators import coverings as cv
from bodygrid.operators.refine import child_keys
from bodygrid.session import cut_lineage


def covering_from_points(points: DataFrame, covering_id: str, x: str, y: str, z: str, tpl: dict, digits: int):
    """Encoded points as one covering per id, with the clamp count and the distinct notes.

    Returns (cells, report). Refused (NaN) points count in the report and give no cell.
    """
    e = pt.encode_brain(points.select(covering_id, x, y, z), x, y, z, tpl, digits)
    cells = cv.normalize(e.filter(F.col("cell_key").isNotNull()), [covering_id])
    report = e.groupBy(covering_id).agg(
        F.count_if(F.col("clamped")).alias("clamped_points"),
        F.count_if(F.col("error_code").isNotNull()).alias("refused_points"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("clamp_note") != "", F.col("clamp_note")))), " | ").alias("notes"),
    )
    return cells, report


def brain_roots(ids: DataFrame) -> DataFrame:
    roots = F.array(F.lit(fr.BV_START * 16), F.lit((fr.BV_START + fr.OCT12) * 16))
    return ids.withColumn("cell_key", F.explode(roots))


def covering_from_balls(
    balls: DataFrame, region_id: str, tpl: dict, max_digits: int, *, on_partial: str = "include", max_cells: int = 200_000
) -> DataFrame:
    """Coverings of many balls at once by subdivision.

    ``balls``: region_id, cx, cy, cz, radius. The frontier of every region is
    classified by one expression per digit; inside cells are kept, partial cells are
    opened. The depth is fixed, so the loop is too; a region examining more than
    ``max_cells`` cells fails the job instead of being cut short.
    """
    if on_partial not in ("include", "exclude"):
        raise ValueError(on_partial)
    frontier = brain_roots(balls)
    kept = []
    examined = None
    keep = balls.columns
    for d in range(max_digits + 1):
        f = pt.locate_brain(frontier, "cell_key", tpl)
        dist = F.sqrt(
            (F.col("x_mm") - F.col("cx")) * (F.col("x_mm") - F.col("cx"))
            + (F.col("y_mm") - F.col("cy")) * (F.col("y_mm") - F.col("cy"))
            + (F.col("z_mm") - F.col("cz")) * (F.col("z_mm") - F.col("cz"))
        )
        reach = (
            F.sqrt(
                F.col("extent_lateral") * F.col("extent_lateral")
                + F.col("extent_ap") * F.col("extent_ap")
                + F.col("extent_si") * F.col("extent_si")
            )
            / 2
        )
        f = f.select(*keep, "cell_key", dist.alias("_d"), reach.alias("_e"))
        f = f.withColumn(
            "_side",
            F.when(F.col("_d") + F.col("_e") <= F.col("radius"), "inside")
            .when(F.col("_d") - F.col("_e") >= F.col("radius"), "outside")
            .otherwise("partial"),
        )
        f = cut_lineage(f.select(*keep, "cell_key", "_side"))
        n = f.groupBy(region_id).agg(F.count(F.lit(1)).alias("_n"))
        examined = n if examined is None else examined.unionByName(n)
        last = d == max_digits
        done = F.col("_side").isin("inside", "partial") if last and on_partial == "include" else F.col("_side") == "inside"
        kept.append(f.filter(done).select(region_id, "cell_key"))
        if not last:
            frontier = f.filter("_side = 'partial'").select(*keep, F.explode(child_keys(F.col("cell_key"))).alias("cell_key"))
    over = (
        examined.groupBy(region_id).agg(F.sum("_n").alias("_n")).filter(F.col("_n") > max_cells).select(F.max(region_id).alias("r"))
    )
    worst = over.first()["r"]  # one row
    if worst is not None:
        raise ValueError(f"region {worst} examined more than {max_cells} cells; raise max_cells or lower max_digits")
    return cv.union(kept, [region_id])


def body_roots(templates: DataFrame) -> DataFrame:
    """Level roots each body template realises. ``templates``: template_id, label."""
    out = ad.canonicalize(templates.withColumn("_raw", F.concat(F.lit("BD-"), "label")), "_raw")
    return out.select("template_id", "cell").distinct()
