"""Same place across subjects, within a stated tolerance.

A located cell is: id, cell_key, template_id, x_mm, y_mm, z_mm, e0, e1, e2 (extents),
axes (three unit vectors), folded, placed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bodygrid.functions import address as ad
from bodygrid.functions.once import once
from bodygrid.operators import coverings as cv
from bodygrid.operators.hierjoin import overlap_join

C = F.col
COLS = ["x_mm", "y_mm", "z_mm", "e0", "e1", "e2", "axes", "template_id", "folded", "cell_key"]


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _reach(p: str, v) -> Column:
    return sum(
        (C(f"{p}e{i}") / 2 * F.abs(_dot([C(f"{p}axes")[i][k] for k in range(3)], v)) for i in range(1, 3)),
        C(f"{p}e0") / 2 * F.abs(_dot([C(f"{p}axes")[0][k] for k in range(3)], v)),
    )


def _prepare(d: DataFrame, p: str, id_: str, classes: Column) -> DataFrame:
    """Prefix a side's columns and give it its size class and the other side's classes."""
    rad = F.sqrt(C("e0") * C("e0") + C("e1") * C("e1") + C("e2") * C("e2")) / 2
    own = F.greatest(F.lit(-10), F.ceil(F.log2(F.greatest(rad, F.lit(1e-3))))).cast("int")
    d = d.filter("placed").select(C(id_).alias(f"{p}id"), *[C(c).alias(f"{p}{c}") for c in COLS], own.alias(f"{p}cls"))
    return d.withColumn("_other", classes)


def size_classes(d: DataFrame) -> Column:
    """Powers of two of the cell radii that occur on a side: at most a few dozen values."""
    rad = F.sqrt(C("e0") * C("e0") + C("e1") * C("e1") + C("e2") * C("e2")) / 2
    own = F.greatest(F.lit(-10), F.ceil(F.log2(F.greatest(rad, F.lit(1e-3))))).cast("int")
    return d.filter("placed").select(F.collect_set(own)).scalar()


def measured(j: DataFrame, tolerance_mm: float) -> DataFrame:
    """Pairs of prepared cells with ``gap_mm``, ``budget_mm``, ``separation_mm`` and ``same``."""
    dl = [C(f"a_{ax}_mm") - C(f"b_{ax}_mm") for ax in "xyz"]
    j = once(j, {"_dx": dl[0], "_dy": dl[1], "_dz": dl[2], "gap_mm": F.sqrt(_dot(dl, dl))})
    dl = [C("_dx"), C("_dy"), C("_dz")]
    direction = [F.when(C("gap_mm") > 0, x / C("gap_mm")).otherwise(0.0) for x in dl]
    along = lambda p: sum(
        (F.pow(F.greatest(F.lit(0.0), F.abs(_dot(dl, v)) - _reach("a_", v) - _reach("b_", v)), F.lit(2.0)) for v in ([C(f"{p}axes")[i][k] for k in range(3)] for i in range(3))),
        F.lit(0.0),
    )
    j = once(j, {"_ra": _reach("a_", direction), "_rb": _reach("b_", direction), "_ta": F.sqrt(along("a_")), "_tb": F.sqrt(along("b_"))})
    j = once(
        j,
        {
            "budget_mm": tolerance_mm + C("_ra") + C("_rb"),
            "separation_mm": F.greatest(F.lit(0.0), C("gap_mm") - C("_ra") - C("_rb"), C("_ta"), C("_tb")),
        },
    )
    same = C("separation_mm") <= tolerance_mm
    if tolerance_mm == 0:
        # Disjoint cells of one template share no point, however close their centres are.
        apart = (C("a_template_id") == C("b_template_id")) & ~(C("a_folded") | C("b_folded")) & ~ad.overlaps(C("a_cell_key"), C("b_cell_key"))
        same = same & ~apart
    return j.withColumn("same", same)


def tolerance_join(a: DataFrame, b: DataFrame, tolerance_mm: float, a_id: str = "id", b_id: str = "id") -> DataFrame:
    """Pairs that may be the same place: separation of the two boxes at most ``tolerance_mm``.

    Grids are per pair of size classes, so a coarse cell never inflates the grid of fine ones:
    with edge = tolerance + both class radii, every partner is in the same or an
    adjacent grid cell. Only the smaller b side is repeated over the 27 neighbours.
    Both sides must be of one frame; cells a template cannot place match nothing.
    """
    if not tolerance_mm >= 0 or tolerance_mm == float("inf"):
        raise ValueError("tolerance_mm must be a finite, non-negative number of millimetres")
    left = _prepare(a, "a_", a_id, size_classes(b)).withColumn("b_cls", F.explode("_other")).drop("_other")
    right = _prepare(b, "b_", b_id, size_classes(a)).withColumn("a_cls", F.explode("_other")).drop("_other")
    edge = F.lit(float(tolerance_mm)) + F.pow(F.lit(2.0), C("a_cls")) + F.pow(F.lit(2.0), C("b_cls"))
    shifts = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    for ax in "xyz":
        left = left.withColumn(f"_g{ax}", F.floor(C(f"a_{ax}_mm") / edge))
        right = right.withColumn("_sh", F.explode(shifts)).withColumn(f"_g{ax}", F.floor(C(f"b_{ax}_mm") / edge) + C("_sh")).drop("_sh")
    j = left.join(right, ["a_cls", "b_cls", "_gx", "_gy", "_gz"])
    return measured(j, tolerance_mm).filter("same").select("a_id", "b_id", "gap_mm", "budget_mm", "separation_mm")


def unplaced(a: DataFrame, id_: str = "id") -> DataFrame:
    """Cells a template cannot place: never the same place as anything, and said so."""
    return a.filter("not placed").select(C(id_).alias("id"), F.lit("names a level absent from its template").alias("note"))


def coverings_same_place(a: DataFrame, b: DataFrame, pairs: DataFrame, tolerance_mm: float | None) -> DataFrame:
    """Asked covering pairs: whether they are the same place, decided by their closest cells of one frame.

    The closest pair is reported even where it is too far apart; NULL where nothing compares.

    a, b: covering_id plus located columns. ``tolerance_mm`` None compares exactly within
    one template (any shared cell). pairs: a, b.
    """
    if tolerance_mm is None:
        left = pairs.join(a.select(C("covering_id").alias("a"), C("cell_key").alias("ka")), "a").select("a", "b", "ka")
        right = pairs.join(b.select(C("covering_id").alias("b"), C("cell_key").alias("kb")), "b").select("a", "b", "kb")
        n = overlap_join(left, right, "ka", "kb", by=["a", "b"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
        d = pairs.join(n, ["a", "b"], "left")
        return d.select("a", "b", C("shared").isNotNull().alias("same"), F.lit("exact").alias("basis"), F.coalesce("shared", F.lit(0)).alias("shared"))
    if not tolerance_mm >= 0 or tolerance_mm == float("inf"):
        raise ValueError("tolerance_mm must be a finite, non-negative number of millimetres")

    def side(d: DataFrame, p: str) -> DataFrame:
        lo = ad.key_lo(C("cell_key"))
        frame = F.when(lo < ad.fr.BV_START, "BD").when(lo < ad.fr.BR_START, "BV").otherwise("BR")
        return d.filter("placed").select(C("covering_id").alias(p), frame.alias("_frame"), F.struct(*[C(c).alias(f"{p}_{c}") for c in COLS]).alias(f"_{p}"))

    asked = pairs.select("a", "b").distinct()
    j = asked.join(side(a, "a"), "a").join(side(b, "b"), ["b", "_frame"])
    gap = F.sqrt(_dot(*[[C(f"_a.a_{ax}_mm") - C(f"_b.b_{ax}_mm") for ax in "xyz"]] * 2))
    # Only the closest pair is measured further; equal gaps go by cell.
    order = F.struct(F.round(gap, 9).alias("g"), C("_a.a_cell_key").alias("ka"), C("_b.b_cell_key").alias("kb"))
    best = j.groupBy("a", "b").agg(F.min_by(F.struct("_a", "_b"), order).alias("_m")).select("a", "b", "_m._a.*", "_m._b.*")
    best = measured(best, tolerance_mm).select("a", "b", C("same").alias("_same"), "gap_mm", "separation_mm", "a_cell_key", "b_cell_key")
    d = pairs.join(best, ["a", "b"], "left")
    return d.select("a", "b", F.coalesce("_same", F.lit(False)).alias("same"), F.lit("tolerance").alias("basis"), "gap_mm", "separation_mm", "a_cell_key", "b_cell_key")


def survival(pairs: DataFrame, digits: list[int]) -> DataFrame:
    """Share of observed pairs whose addresses agree at each digit count. pairs: key_a, key_b (at full depth)."""
    d = pairs.withColumn("digits", F.explode(F.array(*[F.lit(k) for k in digits])))
    at = lambda k: ad.key_at(ad.key_lo(C(k)), C("digits") + F.when(ad.key_lo(C(k)) < ad.fr.BV_START, 1).otherwise(0))
    return d.groupBy("digits").agg(F.count(F.lit(1)).alias("pairs"), F.avg((at("key_a") == at("key_b")).cast("double")).alias("agreement"))
