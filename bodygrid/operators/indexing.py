"""Build a name index from closed solids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bodygrid.operators import coverings as cv
from bodygrid.operators import mesh as ms
from bodygrid.session import cut_lineage


def index_from_solids(
    vertices: DataFrame, triangles: DataFrame, parts: DataFrame, encode: Callable[[DataFrame], DataFrame], step: float, cell: float, least_step: float = 1.0, min_span: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """(cells: solid_id, cell_key; report per solid) of solids made of surfaces.

    ``parts``: solid_id, mesh_id. ``encode`` adds ``cell_key`` and ``clamped`` to points. A solid is the union of its
    parts: the points of one lattice through the origin that lie in a part's box are tested against that part alone. The
    step is halved, down to ``least_step``, until a solid has a point. Points that span less than ``min_span`` of the
    solid on an axis longer than two steps did not resolve it: such a solid, and one without a point, falls back to its
    vertices. Only the closed parts are sampled; a part that isn't closed counts by its vertices alone. Vertices without
    triangle are no part of a solid. Clamped points are counted and have no cell. ``ambiguous`` counts points on which the rays disagree.
    """
    if step < least_step:
        raise ValueError("the first step is less than the least one")
    vertices = ms.drawn(vertices, triangles)
    triangles, unfit = ms.solids(triangles)
    axes = [(w, f, ax) for ax in "xyz" for w, f in (("lo", F.min), ("hi", F.max))]
    box = vertices.groupBy("mesh_id").agg(*[f(ax).alias(f"{w}_{ax}") for w, f, ax in axes])
    box = cut_lineage(parts.select("solid_id", "mesh_id").join(box, "mesh_id"))
    closed = cut_lineage(box.join(unfit, "mesh_id", "left_anti"))
    open_, found, s = closed, None, step
    while s >= least_step:
        lat = ms.lattice(open_.withColumn("box_id", F.struct("solid_id", "mesh_id")), s)
        p = lat.select(F.struct("box_id.solid_id", "x", "y", "z").alias("point_id"), "box_id.mesh_id", "x", "y", "z")
        hit = ms.points_in_solids(p, vertices, triangles.join(open_.select("mesh_id").distinct(), "mesh_id", "left_semi"), cell, own=True)
        hit = hit.groupBy("point_id").agg(F.max("votes").alias("votes")).select("point_id.*", "votes", F.lit(s).alias("step"))
        hit = cut_lineage(hit)
        found = hit if found is None else found.unionByName(hit)
        open_ = cut_lineage(open_.join(hit.select("solid_id").distinct(), "solid_id", "left_anti"))
        if open_.isEmpty():
            break
        s /= 2
    whole = box.groupBy("solid_id").agg(*[f(f"{w}_{ax}").alias(f"{w}_{ax}") for w, f, ax in axes])
    span = found.groupBy("solid_id", "step").agg(*[(F.max(ax) - F.min(ax)).alias(f"s_{ax}") for ax in "xyz"]).join(whole, "solid_id")
    size = lambda ax: F.col(f"hi_{ax}") - F.col(f"lo_{ax}")
    share = F.least(*[F.when(size(ax) > 2 * F.col("step"), F.col(f"s_{ax}") / size(ax)).otherwise(1.0) for ax in "xyz"])
    good = cut_lineage(span.filter(share >= min_span).select("solid_id"))
    solid = found.join(good, "solid_id", "left_semi").select("solid_id", "x", "y", "z", "step", (F.col("votes") < len(ms.RAYS)).alias("unsure"), F.lit("solid").alias("basis"))
    rest = box.join(good, "solid_id", "left_anti").select("solid_id", "mesh_id")
    surface = vertices.join(rest, "mesh_id").select("solid_id", "x", "y", "z", F.lit(None).cast("double").alias("step"), F.lit(False).alias("unsure"), F.lit("surface").alias("basis"))
    e = encode(solid.unionByName(surface))
    report = e.groupBy("solid_id").agg(
        F.min("basis").alias("basis"), F.min("step").alias("step"), F.count(F.lit(1)).alias("points"), F.count_if("clamped").alias("clamped"),
        F.count_if("unsure").alias("ambiguous"), F.avg((~F.col("clamped")).cast("double")).alias("in_frame_fraction"),
    )
    return cv.normalize(e.filter("not clamped"), ["solid_id"]), report
