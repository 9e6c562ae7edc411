"""The body frame: vertebral templates, points to cells and back, fold and margin audits.

slabs: template_id, pos, label, origin, axial, anterior (arrays of 3), height_mm, radii (array).
A template has at most 32 slabs (the grammar's levels), so a template's geometry is
one small array; points meet it by a left join on template_id and everything after
that is row-local or per point, so no point is lost or merged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bodygrid import frames as fr
from bodygrid.functions import address as ad
from bodygrid.functions import points as pt
from bodygrid.functions.once import once
from bodygrid.session import broadcast_if_small

C = F.col
TWO_PI = 2 * math.pi


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _vec(c: Column):
    return [c[0], c[1], c[2]]


def _arr(v):
    return F.array(*v)


def _unit(v):
    n = F.sqrt(_dot(v, v))
    n = F.when(n == 0, 1.0).otherwise(n)
    return [x / n for x in v]


def _cross(a, b):
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def spine_levels(slabs: DataFrame) -> DataFrame:
    """Per level: its two nodes and bisector normals, direction, length and azimuth frame."""
    w = Window.partitionBy("template_id").orderBy("pos")
    face = lambda s: _arr([C("origin")[i] + C("axial")[i] * (s * C("height_mm") / 2) for i in range(3)])
    d = once(slabs, {"_cr": face(-1), "_ca": face(1)})
    mid = lambda p, q: _arr([(p[i] + q[i]) / 2 for i in range(3)])
    prev, nxt = F.lag("_ca").over(w), F.lead("_cr").over(w)
    d = d.withColumn("_p", prev).withColumn("_q", nxt)
    d = once(
        d,
        {
            "n0": F.when(C("_p").isNull(), C("_cr")).otherwise(mid(C("_p"), C("_cr"))),
            "n1": F.when(C("_q").isNull(), C("_ca")).otherwise(mid(C("_ca"), C("_q"))),
        },
    )
    seg = [C("n1")[i] - C("n0")[i] for i in range(3)]
    d = once(d, {"len": F.sqrt(_dot(seg, seg)), "dir": _arr(_unit(seg))})
    k = _dot(_vec(C("anterior")), _vec(C("dir")))
    d = once(d, {"ant": _arr(_unit([C("anterior")[i] - C("dir")[i] * k for i in range(3)]))})
    d = once(d, {"lft": _arr(_unit(_cross(_vec(C("dir")), _vec(C("ant")))))})
    d = d.withColumn("_dp", F.lag("dir").over(w)).withColumn("_dn", F.lead("dir").over(w))
    both = lambda p, q: _arr(_unit([p[i] + q[i] for i in range(3)]))
    d = once(
        d,
        {
            "m0": F.when(C("_dp").isNull(), C("dir")).otherwise(both(C("_dp"), C("dir"))),
            "m1": F.when(C("_dn").isNull(), C("dir")).otherwise(both(C("dir"), C("_dn"))),
            "prev_dir": C("_dp"),
            "next_dir": C("_dn"),
        },
    )
    # Neighbour lengths, for curvature.
    d = d.withColumn("prev_len", F.lag("len").over(w)).withColumn("next_len", F.lead("len").over(w))
    return d.drop("_cr", "_ca", "_p", "_q", "_dp", "_dn")


def geometry(levels: DataFrame) -> DataFrame:
    """One row per template: its levels in order, as an array of at most 32 structs."""
    s = F.struct("pos", "label", "n0", "n1", "m0", "m1", "dir", "len", "ant", "lft", C("radii").alias("radii"))
    return levels.groupBy("template_id").agg(F.array_sort(F.collect_list(s)).alias("levels"))


def radius_at(radii: Column, t: Column) -> Column:
    n = F.size(radii)
    x = F.pmod(t, F.lit(1.0)) * n
    i = F.floor(x).cast("int")
    a, b = F.get(radii, i % n), F.get(radii, (i + 1) % n)
    return a + (b - a) * (x - i)


def _sides(p, s):
    sin = _dot([p[i] - s["n0"][i] for i in range(3)], _vec(s["m0"]))
    sout = _dot([p[i] - s["n1"][i] for i in range(3)], _vec(s["m1"]))
    return sin, sout


def _turn(ca, sa):
    t = F.atan2(sa, ca) / TWO_PI
    t = F.when(t < 0, t + 1).otherwise(t)
    return F.when(t >= 1, 0.0).otherwise(t)


def _point():
    return [C("x"), C("y"), C("z")]


def flat_levels(levels: DataFrame) -> DataFrame:
    """Levels with their vectors as plain columns, so that the geometry runs in generated code."""
    flat = [C(n)[i].alias(f"{n}{i}") for n in ("n0", "n1", "m0", "m1", "dir", "ant", "lft") for i in range(3)]
    last = F.max("pos").over(Window.partitionBy("template_id"))
    d = levels.select("template_id", C("pos").alias("_pos"), C("label").alias("_label"), C("len").alias("_len"), C("radii").alias("_radii"), *flat, last.alias("_last"))
    # At most 32 short rows per template.
    return broadcast_if_small(d, 32_000)


def point_levels(points: DataFrame, levels: DataFrame) -> DataFrame:
    """Every point with every level of its template: plane distances, axis distance, azimuth and depth.

    A point of an unknown template stays, once and without a level.
    """
    p = _point()
    v = lambda n: [C(f"{n}{i}") for i in range(3)]
    j = points.join(flat_levels(levels), "template_id", "left")
    rel = [p[i] - C(f"n0{i}") for i in range(3)]
    j = j.withColumn("_a", _dot(rel, v("m0"))).withColumn("_b", _dot([p[i] - C(f"n1{i}") for i in range(3)], v("m1"))).withColumn("_al", _dot(rel, v("dir")))
    on = F.least(C("_len"), F.greatest(F.lit(0.0), C("_al")))
    off = [rel[i] - C(f"dir{i}") * on for i in range(3)]
    perp = [rel[i] - C(f"dir{i}") * C("_al") for i in range(3)]
    j = once(j, {"_d": F.sqrt(_dot(off, off)), "_ca": _dot(perp, v("ant")), "_sa": _dot(perp, v("lft"))})
    j = once(j, {"_t": _turn(C("_ca"), C("_sa"))})
    surface = radius_at(C("_radii"), C("_t"))
    j = once(j, {"_r": F.when(surface > 0, F.sqrt(C("_ca") * C("_ca") + C("_sa") * C("_sa")) / surface).otherwise(0.0)})
    return j.withColumn("_claim", (C("_a") >= 0) & (C("_b") < 0)).withColumn("_back", (C("_a") < 0) & (C("_b") >= 0))


def levels_claiming(points: DataFrame, levels: DataFrame) -> DataFrame:
    """Labels of the levels claiming each point, and of those with an in-body address for it (at most 32 each)."""
    j = point_levels(points, levels)
    names = lambda cond: F.transform(F.array_sort(F.collect_set(F.when(cond, F.struct("_pos", "_label")))), lambda s: s["_label"])
    g = j.groupBy(*points.columns).agg(
        _copies().alias("_copies"), names(C("_claim")).alias("claiming"), names((C("_claim") | C("_back")) & (C("_r") <= 1)).alias("addressing")
    )
    return _repeated(g).select(*points.columns, "claiming", "addressing")


def _copies() -> Column:
    """Equal rows among points that met their levels: each has one first level, or none at all."""
    return F.count_if(F.coalesce("_pos", F.lit(0)) == 0)


def _repeated(d: DataFrame) -> DataFrame:
    return d.withColumn("_copy", F.explode(F.sequence(F.lit(1), C("_copies").cast("int"))))


def encode_body(points: DataFrame, levels: DataFrame, digits: int) -> DataFrame:
    """Points to BD cells with clamp and fold flags. points: template_id, x, y, z and anything else.

    Equal input rows are brought together first, meet their template's levels as rows once, which are reduced
    to one row per point where they are, and are kept as often as they occur. A point of an
    unknown template has no cell and the error ``no_template``; a NaN or missing coordinate
    is refused too.
    """
    keep = points.columns
    j = point_levels(points.groupBy(*keep).agg(F.count(F.lit(1)).alias("_copies")), levels)
    own = F.struct(C("_pos").alias("pos"), C("_label").alias("label"), C("_a").alias("a"), C("_b").alias("b"), C("_t").alias("t"), C("_r").alias("r"), (C("_back") & (C("_r") <= 1)).alias("back"))
    near = F.struct(C("_d").alias("d"), C("_pos").alias("p"), own.alias("s"))
    g = j.groupBy(*keep).agg(
        F.max("_copies").alias("_copies"),
        F.max(C("_claim").cast("int")).alias("_any"),
        F.count_if("_claim").alias("_nc"),
        F.count_if("_back").alias("_nb"),
        F.count_if(C("_back") & (C("_r") <= 1)).alias("_reach"),
        F.min(F.when(C("_claim"), near)).alias("_best"),
        F.min(near).alias("_near"),
        F.max(F.when(C("_pos") == 0, own)).alias("_first"),
        F.max(F.when(C("_pos") == C("_last"), own)).alias("_end"),
    )
    case = F.when(C("_any") == 1, "claimed").when(C("_first.a") < 0, "above").when(C("_end.b") >= 0, "below").otherwise("gap")
    g = g.withColumn("_case", case)
    s = F.when(C("_case") == "claimed", C("_best.s")).when(C("_case") == "above", C("_first")).when(C("_case") == "below", C("_end")).otherwise(C("_near.s"))
    g = g.select(*keep, "_case", "_nc", "_nb", "_reach", "_copies", s.alias("_s"))
    names = ["pos", "label", "a", "b", "t", "r", "back"]
    g = g.select(*[c for c in g.columns if c != "_s"], *[C(f"_s.{x}").alias(f"_{x}") for x in names])
    edge = F.lit(pt.NEAR_ONE)
    part = F.when(C("_a") - C("_b") != 0, C("_a") / (C("_a") - C("_b"))).otherwise(0.0)
    u = F.when(C("_case") == "claimed", part).when(C("_case") == "above", 0.0).when(C("_case") == "below", edge).otherwise(F.least(edge, F.greatest(F.lit(0.0), part)))
    rival = (C("_nc") > 1) | (C("_reach") - C("_back").cast("int") > 0)
    bad = F.isnan("x") | F.isnan("y") | F.isnan("z") | C("x").isNull() | C("y").isNull() | C("z").isNull()
    known = C("_label").isNotNull()
    g = once(
        g,
        {
            "folded": F.when(known, (C("_case") == "gap") | (((C("_nc") > 1) | (C("_nb") > 0)) & rival)),
            "clamped": F.when(known, (C("_case") != "claimed") | (C("_r") > 1)),
            "level": C("_label"),
            "u": F.when(known, u),
            "t": C("_t"),
            "r": F.when(C("_r") > 1, edge).otherwise(C("_r")),
            "error_code": F.when(~known, "no_template").when(bad, "nan_coordinate"),
        },
    )
    g = with_local_key(g, digits)
    return _repeated(g).select(*keep, "cell_key", "clamped", "folded", "level", "u", "t", "r", "error_code")


def with_local_key(d: DataFrame, digits: int) -> DataFrame:
    """Add the BD ``cell_key`` of (level, u, t, r), one stage per derived value so none is evaluated twice.

    Azimuth bounds are multiples of 1/24 turn, so they are bisected, not scaled.
    """

    def halve(acc, _i):
        m = (acc["lo"] + acc["hi"]) / 2
        up = acc["x"] >= m
        return F.struct(
            F.when(up, m).otherwise(acc["lo"]).alias("lo"),
            F.when(up, acc["hi"]).otherwise(m).alias("hi"),
            acc["x"].alias("x"),
            (acc["bits"] * 2 + F.when(up, 1).otherwise(0)).cast("long").alias("bits"),
        )

    d = once(d, {"_clock": pt.turn_to_clock(C("t")), "_x": F.pmod(C("t"), F.lit(1.0))})
    lo, hi = pt.clock_to_turns(C("_clock"))
    d = once(d, {"_lo": lo, "_hi": hi})
    d = once(d, {"_x": F.when(C("_x") > C("_hi"), C("_x") - 1).otherwise(C("_x"))})
    d = once(d, {"_x": F.when(C("_x") < C("_lo"), C("_x") + 1).otherwise(C("_x"))})
    zero = F.struct(C("_lo").alias("lo"), C("_hi").alias("hi"), C("_x").alias("x"), F.lit(0).cast("long").alias("bits"))
    outer = C("r") >= 0.5
    idx = (F.array_position(F.array(*[F.lit(x) for x in fr.LEVELS]), C("level")) - 1).cast("long")
    d = once(
        d,
        {
            "_tb": F.aggregate(F.sequence(F.lit(1), F.lit(12)), zero, halve)["bits"],
            "_ub": F.floor(C("u") * 4096),
            "_rb": F.floor(F.when(outer, C("r") - 0.5).otherwise(C("r")) * 8192),
            "_sector": idx * 24 + (C("_clock") - 1) * 2 + F.when(outer, 1).otherwise(0),
        },
    )
    left = lambda v, n: F.call_function("shiftleft", v, F.lit(n))
    d = once(d, {c: pt._spread(C(c), 3) for c in ("_ub", "_tb", "_rb")})
    d = once(d, {"_lo": C("_sector") * F.lit(fr.OCT12) + left(C("_ub"), 2).bitwiseOR(left(C("_tb"), 1)).bitwiseOR(C("_rb"))})
    d = once(d, {"cell_key": F.when(C("error_code").isNull(), ad.key_at(C("_lo"), F.lit(digits + 1)))})
    return d.drop("_clock", "_x", "_lo", "_hi", "_tb", "_ub", "_rb", "_sector")


def local_to_mm(d: DataFrame, s: str, u: Column, t: Column, r: Column) -> DataFrame:
    """Exact inverse: the axial offset solves one linear equation of the two bisector planes."""
    lv = C(s)
    c, sn = F.cos(t * TWO_PI), F.sin(t * TWO_PI)
    d = once(d, {"_e": _arr([lv["ant"][i] * c + lv["lft"][i] * sn for i in range(3)]), "_rho": radius_at(lv["radii"], t) * r})
    c0, c1 = _dot(_vec(lv["dir"]), _vec(lv["m0"])), _dot(_vec(lv["dir"]), _vec(lv["m1"]))
    e0, e1 = _dot(_vec(C("_e")), _vec(lv["m0"])), _dot(_vec(C("_e")), _vec(lv["m1"]))
    den = (1 - u) * c0 + u * c1
    a = F.when(F.abs(den) >= 1e-9, (u * lv["len"] * c1 - C("_rho") * ((1 - u) * e0 + u * e1)) / den)
    d = once(d, {"_a": a})
    mm = lambda i: lv["n0"][i] + lv["dir"][i] * C("_a") + C("_e")[i] * C("_rho")
    return d.withColumn("x", mm(0)).withColumn("y", mm(1)).withColumn("z", mm(2)).drop("_e", "_rho", "_a")


def locate_body(cells: DataFrame, geo: DataFrame, max_useful_digits: int) -> DataFrame:
    """BD cells to centre, extents and homology. cells: template_id, cell_key and anything else.

    A level the template lacks gives NULL millimetres: ``variant`` for a recognised
    count anomaly, ``absent`` otherwise.
    """
    keep = cells.columns
    lo, rung = ad.key_lo(C("cell_key")), ad.key_rung(C("cell_key"))
    unit = F.call_function("shiftright", lo, F.lit(36))
    labels = F.array(*[F.lit(x) for x in fr.LEVELS])
    d = once(cells, {"_unit": unit, "_m": lo % F.lit(fr.OCT12), "_rung": rung})
    d = once(d, {"level": F.element_at(labels, F.floor(C("_unit") / 24).cast("int") + 1), "_sec": C("_unit") % 24, "_dg": F.greatest(C("_rung") - 1, F.lit(0))})
    n = F.call_function("shiftleft", F.lit(1).cast("long"), C("_dg")).cast("double")
    right = lambda v, k: F.call_function("shiftright", v, F.lit(k) if isinstance(k, int) else k)
    ax = lambda k: right(pt._compact(right(C("_m"), k), 3), 12 - C("_dg")).cast("double")
    clock = F.floor(C("_sec") / 2) + 1
    t0, _ = pt.clock_to_turns(clock)
    whole = C("_rung") == 0
    r0 = F.when(C("_sec") % 2 == 1, 0.5).otherwise(0.0)
    d = once(
        d,
        {
            "_uu": F.when(whole, 0.5).otherwise((ax(2) + 0.5) / n),
            "_tt": F.when(whole, 0.5).otherwise(t0 + (ax(1) + 0.5) / n / 12),
            "_rr": F.when(whole, 0.5).otherwise(r0 + (ax(0) + 0.5) / n / 2),
            "_du": F.when(whole, 1.0).otherwise(1 / n),
            "_dt": F.when(whole, 1.0).otherwise(1 / n / 12),
            "_dr": F.when(whole, 1.0).otherwise(0.5 / n),
        },
    )
    # At most 32 levels per template.
    d = d.join(broadcast_if_small(geo, 1_000), "template_id", "left")
    d = once(d, {"_s": F.get(F.filter("levels", lambda s: s["label"] == C("level")), F.lit(0))})
    d = local_to_mm(d, "_s", C("_uu"), C("_tt"), C("_rr"))
    surface = radius_at(C("_s")["radii"], C("_tt"))
    p = _point()
    claim = F.transform(F.filter("levels", lambda s: (_sides(p, s)[0] >= 0) & (_sides(p, s)[1] < 0)), lambda s: s["label"])
    d = once(
        d,
        {
            "extent_axial": C("_du") * C("_s")["len"],
            "extent_arc": C("_dt") * TWO_PI * surface * C("_rr"),
            "extent_radial": C("_dr") * surface,
            "homology": F.when(C("_s").isNotNull(), "exact").when(C("level").isin(*fr.ANOMALOUS_LEVELS), "variant").otherwise("absent"),
            "over_precise": C("_dg") > max_useful_digits,
            "folded": F.when(C("_s").isNotNull(), ~F.coalesce((F.size(claim) == 1) & (F.get(claim, F.lit(0)) == C("level")), F.lit(False))),
            "axes": F.array(
                C("_s")["dir"],
                *[
                    _arr([C("_s")["ant"][i] * F.cos((C("_tt") + o) * TWO_PI) + C("_s")["lft"][i] * F.sin((C("_tt") + o) * TWO_PI) for i in range(3)])
                    for o in (0.25, 0.0)
                ],
            ),
        },
    )
    out = [F.col(c).alias(f"{c}_mm") for c in "xyz"]
    return d.select(*keep, "level", *out, "extent_axial", "extent_arc", "extent_radial", "homology", "over_precise", "folded", "axes")


def coarsest_resolvable(cells: DataFrame, geo: DataFrame) -> DataFrame:
    """Coarsest ancestor (or self) of each cell that the template can place; NULL when none can.

    A cell and its ancestors are of one level, and what can be placed is decided by the level alone: it is the whole level, or nothing.
    """
    d = cells.select("template_id", "cell_key").filter("cell_key is not null").distinct()
    has = geo.select("template_id", F.transform("levels", lambda s: s["label"]).alias("_has"))
    lo = ad.key_lo(C("cell_key"))
    level = F.element_at(F.array(*[F.lit(x) for x in fr.LEVELS]), F.floor(F.call_function("shiftright", lo, F.lit(36)) / 24).cast("int") + 1)
    d = d.join(broadcast_if_small(has, 1_000), "template_id", "left")
    return d.select("template_id", "cell_key", F.when(F.array_contains("_has", level), ad.key_at(lo, F.lit(0))).alias("coarsest"))


REGION = {"C": "cervical", "T": "thoracic", "L": "lumbar", "S": "sacral"}


def bands(points: DataFrame, slabs: DataFrame) -> DataFrame:
    """Body band of each point: its level's region, cranial above the first level, caudal past the last.

    points: template_id, x, y, z. Tested level by level in order, so the first that
    decides wins; between levels the nearest centre does. NULL for an unknown template.
    """
    s = F.struct("pos", "label", "origin", "axial", "height_mm")
    t = slabs.groupBy("template_id").agg(F.array_sort(F.collect_list(s)).alias("_sl"))
    d = points.join(broadcast_if_small(t, 1_000), "template_id", "left")
    p = _point()
    u = lambda s: _dot([p[i] - s["origin"][i] for i in range(3)], _vec(s["axial"])) / s["height_mm"]
    d = once(d, {"_us": F.transform("_sl", lambda s: F.struct(s["pos"].alias("pos"), F.substring(s["label"], 1, 1).alias("r"), u(s).alias("u")))})
    region = lambda c: F.when(c == "C", "cervical").when(c == "T", "thoracic").when(c == "L", "lumbar").otherwise("sacral")
    inside = F.get(F.filter("_us", lambda s: (s["u"] >= 0) & (s["u"] < 1)), F.lit(0))
    near = F.array_min(F.transform("_us", lambda s: F.struct(F.abs(s["u"] - 0.5).alias("d"), s["pos"].alias("pos"), s["r"].alias("r"))))["r"]
    band = F.when(F.get("_us", F.lit(0))["u"] < 0, "cranial").when(inside.isNotNull(), region(inside["r"])).when(F.element_at("_us", -1)["u"] >= 1, "caudal").otherwise(region(near))
    return d.withColumn("band", F.when(C("_us").isNotNull(), band)).select(*points.columns, "band")


# ---- audits ------------------------------------------------------------------------


def skin_samples(levels: DataFrame, azimuths: int, us: list[float], rs: list[float]) -> DataFrame:
    """Every template's skin grid: at least each radius knot, ``azimuths`` or more per level."""
    knots = F.size("radii")
    per = F.greatest(F.lit(1), F.ceil(F.lit(azimuths) / knots)).cast("int")
    d = levels.withColumn("_k", F.explode(F.sequence(F.lit(0), knots * per - 1))).withColumn("st", C("_k") / (knots * per))
    arr = lambda v: F.array(*[F.lit(float(x)) for x in v])
    return d.withColumn("su", F.explode(arr(us))).withColumn("sr", F.explode(arr(rs))).drop("_k")


def scan_folds(levels: DataFrame, azimuths: int = 240, us=(0.02, 0.5, 0.98), rs=(0.5, 0.9, 1.0)) -> DataFrame:
    """Skin points whose own level is not the single claimant: counts per template and level, by kind."""
    g = skin_samples(levels, azimuths, list(us), list(rs))
    s = F.struct("pos", "label", "n0", "n1", "m0", "m1", "dir", "len", "ant", "lft", "radii")
    key = ["template_id", "label", "su", "st", "sr"]
    g = local_to_mm(g.select(*key, s.alias("_s")), "_s", C("su"), C("st"), C("sr")).filter("x is not null").select(*key, "x", "y", "z")
    # Sample x level rows in generated code; the claims of a sample are summed before any shuffle.
    flat = [C(n)[i].alias(f"{n}{i}") for n in ("n0", "n1", "m0", "m1") for i in range(3)]
    lv = levels.select("template_id", C("label").alias("other"), *flat)
    j = g.join(broadcast_if_small(lv, 32_000), "template_id")
    side = lambda n, m: _dot([c - C(f"{n}{i}") for i, c in enumerate(_point())], [C(f"{m}{i}") for i in range(3)])
    j = j.withColumn("_c", (side("n0", "m0") >= 0) & (side("n1", "m1") < 0))
    per = j.groupBy(*key).agg(F.count_if("_c").alias("n"), F.bool_or(C("_c") & (C("other") == C("label"))).alias("own"))
    kind = F.when((C("n") == 1) & C("own"), "sound").when(C("n") > 1, "ambiguous").when(C("n") == 0, "unclaimed").otherwise("lost")
    return per.groupBy("template_id", "label").agg(
        F.count(F.lit(1)).alias("probed"), *[F.count_if(kind == k).alias(k) for k in ("ambiguous", "unclaimed", "lost")]
    )


def audit_margins(levels: DataFrame, azimuths: int = 360) -> DataFrame:
    """Per level: fold radius, utilisation and margin at its worst azimuth, and the superseded curvature verdict."""
    d = levels.withColumn("_az", F.explode(F.sequence(F.lit(0), F.lit(azimuths - 1)))).withColumn("_t", C("_az") / azimuths)
    c0, c1 = _dot(_vec(C("dir")), _vec(C("m0"))), _dot(_vec(C("dir")), _vec(C("m1")))
    e = [C("ant")[i] * F.cos(C("_t") * TWO_PI) + C("lft")[i] * F.sin(C("_t") * TWO_PI) for i in range(3)]
    den = F.when((F.abs(c0) > 1e-9) & (F.abs(c1) > 1e-9), _dot(e, _vec(C("m1"))) / c1 - _dot(e, _vec(C("m0"))) / c0)
    d = once(d, {"_fold": F.when(den > 1e-12, C("len") / den), "_rad": radius_at(C("radii"), C("_t"))})
    turn = lambda other: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(_vec(C("dir")), _vec(C(other))))))
    curve = lambda o, l: F.when(turn(o) > 1e-9, (C("len") + C(l)) / 2 / (2 * F.sin(turn(o) / 2)))
    worst = F.max(F.when(C("_fold").isNotNull(), F.struct((C("_rad") / C("_fold")).alias("utilisation"), (-C("_t")).alias("nt"), C("_fold").alias("fold"), C("_rad").alias("rad"))))
    g = d.groupBy("template_id", "pos", "label").agg(
        worst.alias("w"), F.max(F.array_max("radii")).alias("max_radius_mm"), F.min(F.least(curve("prev_dir", "prev_len"), curve("next_dir", "next_len"))).alias("curvature_radius_mm")
    )
    return g.select(
        "template_id", "label", "max_radius_mm", "curvature_radius_mm",
        C("w.fold").alias("fold_radius_mm"), F.coalesce("w.utilisation", F.lit(0.0)).alias("utilisation"),
        (C("w.fold") - C("w.rad")).alias("margin_mm"), F.coalesce(-C("w.nt"), F.lit(0.0)).alias("worst_turns"),
        F.coalesce(C("w.fold") - C("w.rad") > 0, F.lit(True)).alias("admissible"),
        F.coalesce(C("curvature_radius_mm") - C("max_radius_mm") > 0, F.lit(True)).alias("worst_case_admissible"),
    )


def round_trip(samples: DataFrame, levels: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Local coordinates to millimetres and back: failures per level and the worst error of the good ones.

    samples: template_id, label, su, st, sr.
    """
    s = F.struct("pos", "label", "n0", "n1", "m0", "m1", "dir", "len", "ant", "lft", "radii").alias("_s")
    d = samples.join(levels.select("template_id", "label", s), ["template_id", "label"])
    d = local_to_mm(d, "_s", C("su"), C("st"), C("sr")).drop("_s")
    e = encode_body(d, levels, 0)
    turn = F.abs(C("t") - C("st"))
    turn = F.least(turn, 1 - turn)
    # At the axis itself the azimuth means nothing.
    err = F.greatest(F.abs(C("u") - C("su")), F.when(C("sr") > 1e-9, turn).otherwise(0.0), F.abs(C("r") - C("sr")))
    bad = (C("level") != C("label")) | (err > tolerance)
    return e.groupBy("template_id", "label").agg(F.count(F.lit(1)).alias("samples"), F.count_if(bad).alias("failures"), F.max(F.when(~bad, err)).alias("worst_good_error"))


def accept_templates(slabs: DataFrame, folds: DataFrame, margins: DataFrame, trips: DataFrame) -> DataFrame:
    """Verdict per template and stage, and overall: accepted only if every stage passes."""
    pre = slabs.groupBy("template_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("k"), F.min("height_mm").alias("h"), F.min(F.size("radii")).alias("r"), F.min(F.array_min("radii")).alias("rr")
    )
    pre = pre.select("template_id", ((C("n") == C("k")) & (C("h") > 0) & (C("r") >= 3) & (C("rr") > 0)).alias("preconditions"))
    a = margins.groupBy("template_id").agg(F.bool_and("admissible").alias("audit"))
    p = trips.groupBy("template_id").agg((F.sum("failures") == 0).alias("probe"))
    f = folds.groupBy("template_id").agg((F.sum(C("ambiguous") + C("unclaimed") + C("lost")) == 0).alias("folds"))
    d = pre.join(a, "template_id", "left").join(p, "template_id", "left").join(f, "template_id", "left")
    ok = lambda c: F.coalesce(C(c), F.lit(False))
    return d.withColumn("accepted", ok("preconditions") & ok("audit") & ok("probe") & ok("folds"))


def useful_digits(levels_mm: DataFrame) -> DataFrame:
    """Digits a template's mesh justifies: log2 of level length over the upper-median edge, clipped to 0..12.

    levels_mm: template_id, len, edge_mm. A template has at most 32 levels.
    """
    w = Window.partitionBy("template_id").orderBy("edge_mm")
    n = Window.partitionBy("template_id")
    d = levels_mm.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(n))
    m = d.groupBy("template_id").agg(F.max(F.when(C("_r") == F.floor(C("_n") / 2) + 1, C("edge_mm"))).alias("edge"), F.min("len").alias("len"))
    return m.select("template_id", F.greatest(F.lit(0), F.least(F.lit(12), F.floor(F.log2(C("len") / C("edge"))))).cast("int").alias("digits"))
