"""Triangle and voxel tables.

vertices: mesh_id, vid, x, y, z        triangles: mesh_id, tid, a, b, c
voxels: volume_id, i, j, k, value      points: point_id, x, y, z
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bodygrid.functions.once import once
from bodygrid.operators.checks import problem
from bodygrid.operators.corpus import rank_large
from bodygrid.session import cut_lineage

C = F.col


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a, b):
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _sub(a, b):
    return [a[i] - b[i] for i in range(3)]


def _v(p: str):
    return [C(f"{p}x"), C(f"{p}y"), C(f"{p}z")]


def corners(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Triangles with their nine coordinates: one join on exploded corners instead of three."""
    e = triangles.select("mesh_id", "tid", F.posexplode(F.array("a", "b", "c")).alias("corner", "vid"))
    j = e.join(vertices, ["mesh_id", "vid"])
    aggs = [F.max(F.when(C("corner") == i, C(ax))).alias(f"{n}{ax}") for i, n in enumerate("abc") for ax in "xyz"]
    return j.groupBy("mesh_id", "tid").agg(*aggs)


# ---- clean-up ------------------------------------------------------------------


def weld(vertices: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge identical positions onto their lowest vertex id; drop triangles repeating a vertex."""
    keep = vertices.groupBy("mesh_id", "x", "y", "z").agg(F.min("vid").alias("vid"))
    to = vertices.join(keep.withColumnRenamed("vid", "new"), ["mesh_id", "x", "y", "z"]).select("mesh_id", "vid", "new")
    e = triangles.select("mesh_id", "tid", F.posexplode(F.array("a", "b", "c")).alias("corner", "vid")).join(to, ["mesh_id", "vid"])
    t = e.groupBy("mesh_id", "tid").agg(*[F.max(F.when(C("corner") == i, C("new"))).alias(n) for i, n in enumerate("abc")])
    return keep.select("mesh_id", "vid", "x", "y", "z"), t.filter("a <> b and b <> c and a <> c")


def vertex_normals(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Area-weighted unit normals; an unused vertex points up."""
    t = corners(vertices, triangles)
    n = _cross(_sub(_v("b"), _v("a")), _sub(_v("c"), _v("a")))
    n = t.select("mesh_id", "tid", *[c.alias(f"n{i}") for i, c in zip("xyz", n)])
    e = triangles.select("mesh_id", "tid", F.explode(F.array("a", "b", "c")).alias("vid")).join(n, ["mesh_id", "tid"])
    s = e.groupBy("mesh_id", "vid").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in "xyz"])
    d = vertices.select("mesh_id", "vid").join(s, ["mesh_id", "vid"], "left")
    size = F.sqrt(C("nx") * C("nx") + C("ny") * C("ny") + C("nz") * C("nz"))
    unit = lambda i, up: F.when(F.coalesce(size, F.lit(0.0)) > 0, C(f"n{i}") / size).otherwise(float(up)).alias(f"n{i}")
    return d.select("mesh_id", "vid", unit("x", 0), unit("y", 0), unit("z", 1))


# ---- measures -------------------------------------------------------------------


def surface_stats(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    t = corners(vertices, triangles)
    length = lambda p, q: F.sqrt(_dot(_sub(_v(p), _v(q)), _sub(_v(p), _v(q))))
    n = _cross(_sub(_v("b"), _v("a")), _sub(_v("c"), _v("a")))
    same = lambda p, q: (C(f"{p}x") == C(f"{q}x")) & (C(f"{p}y") == C(f"{q}y")) & (C(f"{p}z") == C(f"{q}z"))
    low = lambda ax: F.min(F.least(f"a{ax}", f"b{ax}", f"c{ax}")).alias(f"drawn_lo_{ax}")
    high = lambda ax: F.max(F.greatest(f"a{ax}", f"b{ax}", f"c{ax}")).alias(f"drawn_hi_{ax}")
    s = t.groupBy("mesh_id").agg(
        (F.sum(F.sqrt(_dot(n, n))) / 2).alias("area"),
        F.count(F.lit(1)).alias("triangles"),
        (F.sum(length("a", "b") + length("b", "c") + length("c", "a")) / (F.count(F.lit(1)) * 3)).alias("mean_edge"),
        F.count_if(same("a", "b") | same("b", "c") | same("a", "c")).alias("degenerate"),
        *[low(ax) for ax in "xyz"],
        *[high(ax) for ax in "xyz"],
    )
    v = vertices.groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("vertices"), *[F.min(ax).alias(f"lo_{ax}") for ax in "xyz"], *[F.max(ax).alias(f"hi_{ax}") for ax in "xyz"]
    )
    used = triangles.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vid")).distinct().groupBy("mesh_id").agg(F.count(F.lit(1)).alias("used"))
    return s.join(v, "mesh_id").join(used, "mesh_id").withColumn("unused", C("vertices") - C("used")).drop("used")


def volumes(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Signed volume, volume centroid about the vertex mean, area centroid and the share of open edges."""
    mean = vertices.groupBy("mesh_id").agg(*[F.avg(ax).alias(f"m{ax}") for ax in "xyz"])
    t = corners(vertices, triangles).join(mean, "mesh_id")
    m = [C("mx"), C("my"), C("mz")]
    a, b, c = (_sub(_v(p), m) for p in "abc")
    six = _dot(a, _cross(b, c))
    n = _cross(_sub(b, a), _sub(c, a))
    t = t.select(
        "mesh_id", "mx", "my", "mz", six.alias("s"), F.sqrt(_dot(n, n)).alias("w"),
        *[((a[i] + b[i] + c[i]) * six / 4).alias(f"v{ax}") for i, ax in enumerate("xyz")],
        *[((C(f"a{ax}") + C(f"b{ax}") + C(f"c{ax}")) / 3).alias(f"g{ax}") for ax in "xyz"],
    )
    g = t.groupBy("mesh_id").agg(
        (F.sum("s") / 6).alias("volume"),
        *[(F.first(f"m{ax}") + F.sum(f"v{ax}") / F.sum("s")).alias(f"centroid_{ax}") for ax in "xyz"],
        *[(F.sum(C("w") * C(f"g{ax}")) / F.sum("w")).alias(f"area_centroid_{ax}") for ax in "xyz"],
    )
    e = edge_report(triangles).select("mesh_id", (C("open_edges") / C("edges")).alias("open_share"))
    return g.join(e, "mesh_id", "left")


def edge_report(triangles: DataFrame) -> DataFrame:
    """Open, over-shared and inconsistently wound edges per mesh."""
    pair = lambda p, q: F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"), F.when(C(p) < C(q), 1).otherwise(-1).alias("d"))
    e = triangles.select("mesh_id", F.inline(F.array(pair("a", "b"), pair("b", "c"), pair("c", "a"))))
    per = e.groupBy("mesh_id", "u", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("d"))
    return per.groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("edges"),
        F.count_if(C("n") == 1).alias("open_edges"),
        F.count_if(C("n") > 2).alias("over_shared"),
        F.count_if((C("n") == 2) & (C("d") != 0)).alias("inconsistent"),
    )


def solids(triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triangles of closed surfaces; mesh_id, reason of the others), decided from the edges.

    A triangle that repeats a corner has no area and is dropped first. A surface is closed if every edge has two triangles that
    run along it in opposite directions.
    """
    t = triangles.filter("a <> b and b <> c and a <> c")
    why = F.when(C("open_edges") > 0, "open").when(C("over_shared") > 0, "over-shared edge").when(C("inconsistent") > 0, "inconsistent winding")
    bad = edge_report(t).select("mesh_id", why.alias("reason")).filter("reason is not null")
    return t.join(bad, "mesh_id", "left_anti"), bad


def drawn(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Vertices that a triangle uses."""
    return vertices.join(triangles.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vid")), ["mesh_id", "vid"], "left_semi")


def components(triangles: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected component of every used vertex: (mesh_id, vid, component = lowest vertex id).

    Labels take the least neighbour label, then jump to the label of their label, so
    the number of rounds grows with the logarithm of the longest path. Every round is
    two map-side-combined minima over a checkpointed table; it stops when no label moves.
    """
    pair = lambda p, q: F.struct(C(p).alias("u"), C(q).alias("v"))
    both = F.array(pair("a", "b"), pair("b", "a"), pair("b", "c"), pair("c", "b"), pair("a", "a"), pair("b", "b"), pair("c", "c"))
    edges = cut_lineage(triangles.select("mesh_id", F.inline(both)).distinct())
    labels = cut_lineage(edges.groupBy("mesh_id", C("u").alias("vid")).agg(F.min("v").alias("label")))
    for _ in range(max_rounds):
        near = edges.join(labels.select("mesh_id", C("vid").alias("v"), "label"), ["mesh_id", "v"])
        step = near.groupBy("mesh_id", C("u").alias("vid")).agg(F.min("label").alias("label"))
        jump = step.join(labels.select("mesh_id", C("vid").alias("label"), C("label").alias("far")), ["mesh_id", "label"], "left")
        new = jump.select("mesh_id", "vid", F.least("label", F.coalesce("far", "label")).alias("label"))
        moved = new.join(labels.withColumnRenamed("label", "old"), ["mesh_id", "vid"]).withColumn("moved", C("label") < C("old"))
        moved = cut_lineage(moved)
        labels = moved.select("mesh_id", "vid", "label")
        if moved.filter("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise ValueError(f"components did not settle in {max_rounds} rounds")


def ranked_components(triangles: DataFrame, keep: int | None = None) -> DataFrame:
    """Components by triangle count, largest first; ``keep`` the largest k of each mesh."""
    c = components(triangles)
    t = triangles.join(c.select("mesh_id", C("vid").alias("a"), "component"), ["mesh_id", "a"])
    n = t.groupBy("mesh_id", "component").agg(F.count(F.lit(1)).alias("triangles"))
    w = Window.partitionBy("mesh_id").orderBy(F.desc("triangles"), "component")
    n = n.withColumn("rank", F.row_number().over(w))
    return n if keep is None else n.filter(C("rank") <= keep)


def split_by_label(vertices: DataFrame, labels: DataFrame, triangles: DataFrame) -> DataFrame:
    """Each triangle takes the majority label of its corners (b and c agreeing win, else a); unlabelled keep NULL."""
    e = triangles.select("mesh_id", "tid", F.posexplode(F.array("a", "b", "c")).alias("corner", "vid")).join(labels, ["mesh_id", "vid"], "left")
    g = e.groupBy("mesh_id", "tid").agg(*[F.max(F.when(C("corner") == i, C("label"))).alias(f"l{n}") for i, n in enumerate("abc")])
    return g.select("mesh_id", "tid", F.when(C("lb").eqNullSafe(C("lc")), C("lb")).otherwise(C("la")).alias("label"))


# ---- point in solid ----------------------------------------------------------------

# Three skew ray directions (1, s, t); a majority of them decides.
RAYS = [(0.0137, 0.0071), (-0.0093, 0.0211), (0.0173, -0.0157)]


def points_in_solids(points: DataFrame, vertices: DataFrame, triangles: DataFrame, cell: float, rays=RAYS, own: bool = False) -> DataFrame:
    """(point_id, mesh_id, votes) for every closed surface a majority of rays says contains the point.

    Each ray is sheared onto the x axis, so "may be hit" is an equi-join of grid
    squares in the sheared y/z plane; the exact triangle test follows. Hits at one
    distance count once, so an edge crossed twice does not flip the parity. ``own``: the
    points have a ``mesh_id`` and are tested against that surface alone.
    """
    by = ["mesh_id"] if own else []
    t = corners(vertices, triangles)
    parts = []
    for r, (s, u) in enumerate(rays):
        yz = lambda p: (C(f"{p}y") - s * C(f"{p}x"), C(f"{p}z") - u * C(f"{p}x"))
        ys, zs = [yz(p)[0] for p in "abc"], [yz(p)[1] for p in "abc"]
        rng = lambda v: F.sequence(F.floor(F.least(*v) / cell), F.floor(F.greatest(*v) / cell))
        g = t.withColumn("_gy", F.explode_outer(rng(ys))).withColumn("_gz", F.explode_outer(rng(zs)))
        p = points.select("point_id", *by, "x", "y", "z").withColumn("_gy", F.floor((C("y") - s * C("x")) / cell)).withColumn("_gz", F.floor((C("z") - u * C("x")) / cell))
        h = p.join(g, ["_gy", "_gz", *by])
        d = [F.lit(1.0), F.lit(s), F.lit(u)]
        e1, e2 = _sub(_v("b"), _v("a")), _sub(_v("c"), _v("a"))
        q = _cross(d, e2)
        det = _dot(e1, q)
        h = once(h, {"_det": det, "_u": _dot(_sub(_v(""), _v("a")), q)})
        w = _cross(_sub(_v(""), _v("a")), e1)
        h = once(h, {"_uu": C("_u") / C("_det"), "_vv": _dot(d, w) / C("_det"), "_t": _dot(e2, w) / C("_det")})
        h = h.filter((F.abs("_det") > 1e-12) & (C("_uu") >= 0) & (C("_vv") >= 0) & (C("_uu") + C("_vv") <= 1) & (C("_t") > 0))
        parts.append(h.select("point_id", "mesh_id", F.lit(r).alias("ray"), F.round(C("_t") * 1e7).alias("_t")))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    odd = hits.distinct().groupBy("point_id", "mesh_id", "ray").agg((F.count(F.lit(1)) % 2).alias("odd")).filter("odd = 1")
    votes = odd.groupBy("point_id", "mesh_id").agg(F.count(F.lit(1)).alias("votes"))
    return votes.filter(C("votes") * 2 > len(rays))


# ---- nearest surface ---------------------------------------------------------------

#: Decimals of a distance in millimetres that decide what is nearest; what differs after them is rounding and counts as equal.
TIE_DIGITS = 9


def _triangle_distance(d: DataFrame) -> DataFrame:
    """Exact distance from (x, y, z) to the triangle in the same row, as ``_d``."""
    p, a, b, c = _v(""), _v("a"), _v("b"), _v("c")

    def segment(s, e):
        ed, ap = _sub(e, s), _sub(p, s)
        n = _dot(ed, ed)
        t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(ap, ed) / n))).otherwise(0.0)
        r = [ap[i] - ed[i] * t for i in range(3)]
        return _dot(r, r)

    e1, e2, ap = _sub(b, a), _sub(c, a), _sub(p, a)
    d = once(
        d,
        {
            "_e": F.least(segment(a, b), segment(b, c), segment(c, a)),
            "_11": _dot(e1, e1), "_12": _dot(e1, e2), "_22": _dot(e2, e2), "_p1": _dot(ap, e1), "_p2": _dot(ap, e2),
            "_nn": _dot(_cross(e1, e2), _cross(e1, e2)), "_np": _dot(ap, _cross(e1, e2)),
        },
    )
    den = F.nullif(C("_11") * C("_22") - C("_12") * C("_12"), F.lit(0.0))  # null without area: its edges decide
    v = (C("_22") * C("_p1") - C("_12") * C("_p2")) / den
    w = (C("_11") * C("_p2") - C("_12") * C("_p1")) / den
    inside = (den > 0) & (v >= 0) & (w >= 0) & (v + w <= 1)
    d = d.withColumn("_d", F.sqrt(F.when(inside, F.least(C("_np") * C("_np") / C("_nn"), C("_e"))).otherwise(C("_e"))))
    return d.drop("_e", "_11", "_12", "_22", "_p1", "_p2", "_nn", "_np")


def nearest_surface(
    points: DataFrame, vertices: DataFrame, triangles: DataFrame, radius: float, by: list[str] | None = None, max_rounds: int = 40
) -> DataFrame:
    """(point_id, mesh_id, tid, distance) of the nearest triangle, exactly; of equally near ones the least (mesh_id, tid).

    Round k looks at grid cells of edge R = radius * 2^k: every triangle within R of a
    point lies in the point's cell or one beside it, so a distance of at most R is
    proven and the point is done; only unproven points go on with R doubled. The loop
    ends when no point is left. ``by`` restricts candidates to equal columns (for
    example one mesh), which points and triangles then both carry.
    """
    by = by or []
    t = cut_lineage(corners(vertices, triangles))
    if t.isEmpty():
        raise ValueError("nearest_surface needs at least one triangle")
    left = points.select("point_id", *by, "x", "y", "z")
    if by:
        left = left.join(t.select(*by).distinct(), by, "left_semi")
    done = None
    r = float(radius)
    for _ in range(max_rounds):
        span = lambda ax: F.sequence(F.floor(F.least(f"a{ax}", f"b{ax}", f"c{ax}") / r) - 1, F.floor(F.greatest(f"a{ax}", f"b{ax}", f"c{ax}") / r) + 1)
        g = t
        for ax in "xyz":
            g = g.withColumn(f"_g{ax}", F.explode_outer(span(ax)))
        p = left
        for ax in "xyz":
            p = p.withColumn(f"_g{ax}", F.floor(C(ax) / r))
        j = _triangle_distance(p.join(g, [*by, "_gx", "_gy", "_gz"]))
        best = j.groupBy("point_id").agg(F.min(F.struct(F.round("_d", TIE_DIGITS).alias("_d"), "mesh_id", "tid")).alias("m"), F.min("_d").alias("distance"))
        best = cut_lineage(best.filter(C("distance") <= r).select("point_id", "m.mesh_id", "m.tid", "distance"))
        done = best if done is None else done.unionByName(best)
        left = cut_lineage(left.join(best, "point_id", "left_anti"))
        if left.isEmpty():
            return done
        r *= 2
    raise ValueError(f"points left unproven after {max_rounds} rounds")


def exact_quantile(df: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """Element floor(q * n) of each group's sorted values, for groups of any size."""
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    r = rank_large(df.select(group, value), group, [F.asc(value)], "_rank").join(n, group)
    return r.filter(C("_rank") == F.least(F.floor(C("_n") * q) + 1, C("_n"))).select(group, C(value).alias("quantile"))


def one_sided_distance(points: DataFrame, vertices: DataFrame, triangles: DataFrame, radius: float) -> DataFrame:
    """Per mesh: maximum, mean and p95 of the distance from its points to the other surface of the same mesh_id."""
    d = nearest_surface(points, vertices, triangles, radius, by=["mesh_id"])
    d = cut_lineage(d.select("mesh_id", "distance"))
    s = d.groupBy("mesh_id").agg(F.max("distance").alias("max_mm"), F.avg("distance").alias("mean_mm"), F.count(F.lit(1)).alias("n"))
    return s.join(exact_quantile(d, "mesh_id", "distance", 0.95).withColumnRenamed("quantile", "p95_mm"), "mesh_id")


def surface_deviation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Symmetric maximum and mean from both one-sided tables."""
    r = b.select("mesh_id", C("max_mm").alias("m2"), C("mean_mm").alias("a2"), C("n").alias("n2"))
    j = a.join(r, "mesh_id")
    return j.select("mesh_id", F.greatest("max_mm", "m2").alias("hausdorff_mm"), ((C("mean_mm") * C("n") + C("a2") * C("n2")) / (C("n") + C("n2"))).alias("mean_mm"))


def depth_report(points: DataFrame, inside: DataFrame, depth: DataFrame, thresholds: list[float], deepest: int = 5) -> tuple[DataFrame, DataFrame]:
    """Points inside each reference solid by depth, and the deepest few of each."""
    d = inside.select("point_id", "mesh_id").join(depth.select("point_id", "mesh_id", C("distance").alias("depth")), ["point_id", "mesh_id"])
    counts = d.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("inside"), *[F.count_if(C("depth") > t).alias(f"deeper_than_{t:g}") for t in thresholds])
    w = Window.partitionBy("mesh_id").orderBy(F.desc("depth"), "point_id")
    return counts, d.withColumn("rank", F.row_number().over(w)).filter(C("rank") <= deepest)


def pick(rays: DataFrame, vertices: DataFrame, triangles: DataFrame, cell: float, reach: float) -> DataFrame:
    """Every mesh each ray hits within ``reach``, nearest first.

    rays: ray_id, ox, oy, oz, dx, dy, dz. A ray is cut into slabs along its dominant
    axis; within a slab it can touch at most two grid cells per other axis, so the
    candidates are an equi-join on grid cells.
    """
    t = corners(vertices, triangles)
    g = t
    for ax in "xyz":
        g = g.withColumn(f"_g{ax}", F.explode_outer(F.sequence(F.floor(F.least(f"a{ax}", f"b{ax}", f"c{ax}") / cell), F.floor(F.greatest(f"a{ax}", f"b{ax}", f"c{ax}") / cell))))
    n = F.sqrt(C("dx") * C("dx") + C("dy") * C("dy") + C("dz") * C("dz"))
    r = rays.withColumn("_n", n)
    big = F.greatest(F.abs("dx"), F.abs("dy"), F.abs("dz"))
    step = F.lit(float(cell)) / big  # parameter length that moves one cell along the dominant axis
    r = r.withColumn("_step", step).withColumn("_k", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(float(reach)) / C("_n") / C("_step")).cast("int"))))
    for ax in "xyz":
        p0 = C(f"o{ax}") + C(f"d{ax}") * C("_k") * C("_step")
        p1 = C(f"o{ax}") + C(f"d{ax}") * (C("_k") + 1) * C("_step")
        r = r.withColumn(f"_g{ax}", F.explode(F.sequence(F.floor(F.least(p0, p1) / cell), F.floor(F.greatest(p0, p1) / cell))))
    r = r.drop("_step", "_k").distinct()
    h = r.join(g, ["_gx", "_gy", "_gz"]).drop("_gx", "_gy", "_gz").distinct()
    d = [C("dx"), C("dy"), C("dz")]
    o = [C("ox"), C("oy"), C("oz")]
    e1, e2 = _sub(_v("b"), _v("a")), _sub(_v("c"), _v("a"))
    q = _cross(d, e2)
    h = once(h, {"_det": _dot(e1, q), "_u": _dot(_sub(o, _v("a")), q)})
    w = _cross(_sub(o, _v("a")), e1)
    h = once(h, {"_uu": C("_u") / C("_det"), "_vv": _dot(d, w) / C("_det"), "t": _dot(e2, w) / C("_det")})
    h = h.filter((F.abs("_det") >= 1e-12) & C("_uu").between(0, 1) & (C("_vv") >= 0) & (C("_uu") + C("_vv") <= 1) & (C("t") > 1e-6) & (C("t") * C("_n") <= reach))
    per = h.groupBy("ray_id", "mesh_id").agg(F.min("t").alias("t"))
    win = Window.partitionBy("ray_id").orderBy("t", "mesh_id")
    return per.withColumn("rank", F.row_number().over(win))


# ---- checks --------------------------------------------------------------------------


def laterality(vertices: DataFrame, witnesses: DataFrame) -> DataFrame:
    """Witness structures whose mean x has the wrong sign. witnesses: mesh_id, sign."""
    m = vertices.join(witnesses, "mesh_id").groupBy("mesh_id", "sign").agg(F.avg("x").alias("mean_x"))
    return m.filter(F.signum("mean_x") != C("sign"))


def tier_problems(full: DataFrame, tier: DataFrame, published: DataFrame) -> DataFrame:
    """A reduced tier against the full one: same ids, at least four triangles, axis share and area ratio in range, published errors as measured."""
    j = full.alias("f").join(tier.alias("t"), "mesh_id", "full_outer").join(published, "mesh_id", "left")
    ext = lambda s, ax: C(f"{s}.drawn_hi_{ax}") - C(f"{s}.drawn_lo_{ax}")
    share = F.least(*[ext("t", ax) / ext("f", ax) for ax in "xyz"])
    ratio = C("t.area") / C("f.area")
    out = lambda cond, rule, msg: problem(j.filter(cond), rule, C("mesh_id"), msg)
    return (
        out(C("f.area").isNull() | C("t.area").isNull(), "ids_differ", F.lit(""))
        .unionByName(out(C("t.triangles") < 4, "too_few_triangles", C("t.triangles")))
        .unionByName(out(share < 0.5, "axis_share", F.round(share, 3)))
        .unionByName(out((ratio < 0.75) | (ratio > 1.25), "area_ratio", F.round(ratio, 3)))
        .unionByName(out(F.abs(C("published_area") - C("t.area")) > 1e-6, "published_differs", F.round(C("published_area"), 3)))
    )


# The surface match rule, millimetres and shares.
MAX_MEAN_SYMMETRIC_MM, MAX_P95_MM, MIN_LABEL_AGREEMENT, MAX_CONTROL_PASS_SHARE = 1.5, 3.0, 0.9, 0.05


def origin_summary(scored: DataFrame) -> DataFrame:
    """One verdict: every structure matches its own reference and few controls pass; no rows is vacuous."""
    g = scored.agg(
        F.count(F.lit(1)).alias("structures"),
        F.count_if("matched").alias("matched"),
        F.avg(F.col("control_passes").cast("double")).alias("control_pass_share"),
    )
    ok = (C("matched") == C("structures")) & (C("control_pass_share") <= MAX_CONTROL_PASS_SHARE)
    return g.withColumn("verdict", F.when(C("structures") == 0, "vacuous").when(ok, "pass").otherwise("fail"))


def nearest_other(points: DataFrame, targets: DataFrame, radius: float, max_rounds: int = 30) -> DataFrame:
    """(mesh_id, other, distance): for each point the nearest target of another name; none if there is no other.

    As for surfaces, a round proves distances up to its grid's edge, and only unproven points go on with a grid twice as wide.
    """
    left, done, r = points.select("mesh_id", "x", "y", "z"), None, float(radius)
    t = cut_lineage(targets.select(C("mesh_id").alias("other"), *[C(ax).alias(f"t{ax}") for ax in "xyz"]))
    for _ in range(max_rounds):
        g, p = t, left
        for ax in "xyz":
            g = g.withColumn(f"_g{ax}", F.explode(F.sequence(F.floor(C(f"t{ax}") / r) - 1, F.floor(C(f"t{ax}") / r) + 1)))
            p = p.withColumn(f"_g{ax}", F.floor(C(ax) / r))
        d = F.sqrt(sum(((C(ax) - C(f"t{ax}")) * (C(ax) - C(f"t{ax}")) for ax in "yz"), (C("x") - C("tx")) * (C("x") - C("tx"))))
        near = p.join(g, ["_gx", "_gy", "_gz"]).filter("other <> mesh_id").withColumn("d", d).filter(C("d") <= r)
        best = near.groupBy("mesh_id").agg(F.min(F.struct(F.round("d", TIE_DIGITS).alias("d"), "other")).alias("m"), F.min("d").alias("distance"))
        best = cut_lineage(best.select("mesh_id", "m.other", "distance"))
        done = best if done is None else done.unionByName(best)
        left = cut_lineage(left.join(best, "mesh_id", "left_anti"))
        if left.isEmpty():
            break
        r *= 2
    return done


def origin_scores(vertices: DataFrame, triangles: DataFrame, ref_vertices: DataFrame, ref_triangles: DataFrame, radius: float) -> DataFrame:
    """Each surface against the reference of its name, and as negative control against the nearest reference of another name.

    (mesh_id, against, and own_ and other_ mean, p95, agreement): the symmetric mean of both one-sided vertex distances, the p95
    from the surface to the reference, and the share of vertices whose nearest reference, of all, is this one. A surface without
    reference of its name has no own figures; vertices that no triangle uses are left out.
    """
    v, rv = drawn(vertices, triangles), drawn(ref_vertices, ref_triangles)
    center = lambda d: d.groupBy("mesh_id").agg(*[F.avg(ax).alias(ax) for ax in "xyz"])
    control = nearest_other(center(v), center(rv), radius * 4)
    own = v.select("mesh_id").distinct().join(rv.select("mesh_id").distinct(), "mesh_id").select("mesh_id", C("mesh_id").alias("ref"), F.lit("own").alias("role"))
    pairs = cut_lineage(own.unionByName(control.select("mesh_id", C("other").alias("ref"), F.lit("other").alias("role"))).withColumn("pair", F.concat_ws("/", "mesh_id", "role")))

    def of(d, key):  # a table of one side, once for each pair that it is in
        return d.withColumnRenamed("mesh_id", key).join(pairs.select(key, "pair") if key == "ref" else pairs.select(C("mesh_id").alias(key), "pair"), key).drop(key).withColumnRenamed("pair", "mesh_id")

    pts = lambda d: d.select(F.concat_ws("/", "mesh_id", "vid").alias("point_id"), "mesh_id", "x", "y", "z")
    there = one_sided_distance(pts(of(v, "own")), of(rv, "ref"), of(ref_triangles, "ref"), radius)
    back = one_sided_distance(pts(of(rv, "ref")), of(v, "own"), of(triangles, "own"), radius)
    nearest = nearest_surface(v.select(F.concat_ws("/", "mesh_id", "vid").alias("point_id"), "x", "y", "z"), rv, ref_triangles, radius)
    label = nearest.join(v.select(F.concat_ws("/", "mesh_id", "vid").alias("point_id"), C("mesh_id").alias("of")), "point_id").groupBy("of", C("mesh_id").alias("ref")).agg(F.count(F.lit(1)).alias("hits"))
    b = back.select("mesh_id", C("mean_mm").alias("back"), C("n").alias("n_back"))
    d = there.join(b, "mesh_id").join(pairs.withColumnRenamed("mesh_id", "of"), there["mesh_id"] == C("pair")).join(label, ["of", "ref"], "left")
    d = d.select(
        "of", "ref", "role", ((C("mean_mm") * C("n") + C("back") * C("n_back")) / (C("n") + C("n_back"))).alias("mean"), C("p95_mm").alias("p95"), (F.coalesce("hits", F.lit(0)) / C("n")).alias("agreement")
    )
    side = lambda r, n: F.max(F.when(C("role") == r, C(n)))
    return d.groupBy(C("of").alias("mesh_id")).agg(side("other", "ref").alias("against"), *[side(r, n).alias(f"{r}_{n}") for r in ("own", "other") for n in ("mean", "p95", "agreement")])


def origin_verdict(scores: DataFrame) -> DataFrame:
    """Own match against nearest-other control per structure, and the share of controls that pass.

    scores: name, own_mean, own_p95, own_agreement, other_mean, other_p95, other_agreement.
    """
    ok = lambda m, p, a: (C(m) <= MAX_MEAN_SYMMETRIC_MM) & (C(p) <= MAX_P95_MM) & (C(a) >= MIN_LABEL_AGREEMENT)
    d = scores.withColumn("matched", ok("own_mean", "own_p95", "own_agreement")).withColumn("control_passes", ok("other_mean", "other_p95", "other_agreement"))
    return d


def anchor_problems(centroids: DataFrame, recorded: DataFrame, tolerance_mm: float = 1.0) -> DataFrame:
    """Recorded level points more than a millimetre from the centroid re-derived from the shipped mesh."""
    j = centroids.join(recorded, "mesh_id")
    d = F.sqrt(sum(((C(f"centroid_{ax}") - C(f"r{ax}")) * (C(f"centroid_{ax}") - C(f"r{ax}")) for ax in "yz"), (C("centroid_x") - C("rx")) * (C("centroid_x") - C("rx"))))
    return j.withColumn("off_mm", d).filter(C("off_mm") > tolerance_mm)


# ---- voxels ----------------------------------------------------------------------------


def mask_bounds(voxels: DataFrame, volumes_: DataFrame, threshold: float) -> DataFrame:
    """Bounding box and count of voxels above a threshold; an empty mask has NULLs, not a box."""
    m = voxels.filter(C("value") > threshold).groupBy("volume_id").agg(
        F.count(F.lit(1)).alias("n"), *[f(ax).alias(f"{w}_{ax}") for ax in "ijk" for w, f in (("lo", F.min), ("hi", F.max))]
    )
    return volumes_.select("volume_id").join(m, "volume_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def weighted_centroids(voxels: DataFrame, members: DataFrame) -> DataFrame:
    """Probability-weighted centroid per landmark and side; a voxel's summed probability is capped at 1, the midline is left out.

    voxels: label, x, y, z, value. members: landmark, label.
    """
    per = voxels.join(members, "label").filter("x <> 0").groupBy("landmark", "x", "y", "z").agg(F.least(F.sum("value"), F.lit(1.0)).alias("w"))
    side = F.when(C("x") < 0, "left").otherwise("right").alias("side")
    return per.groupBy("landmark", side).agg(*[(F.sum(C("w") * C(ax)) / F.sum("w")).alias(f"c{ax}") for ax in "xyz"], F.sum("w").alias("weight"))


def trilinear(points: DataFrame, voxels: DataFrame) -> DataFrame:
    """Value at each point (in voxel coordinates) from its eight neighbours; outside counts as 0."""
    half = lambda o: F.struct(F.lit(o & 1).alias("a"), F.lit(o >> 1 & 1).alias("b"), F.lit(o >> 2 & 1).alias("c"))
    p = points.select("point_id", "volume_id", "x", "y", "z", F.inline(F.array(*[half(o) for o in range(8)])))
    w = F.lit(1.0)
    for ax, o, n in (("x", "a", "i"), ("y", "b", "j"), ("z", "c", "k")):
        f = C(ax) - F.floor(ax)
        w = w * F.when(C(o) == 1, f).otherwise(1 - f)
        p = p.withColumn(n, (F.floor(ax) + C(o)).cast("long"))
    p = p.withColumn("_w", w)
    v = voxels.select("volume_id", *[C(n).cast("long").alias(n) for n in "ijk"], "value")
    j = p.join(v, ["volume_id", "i", "j", "k"], "left")
    return j.groupBy("point_id", "volume_id").agg(F.sum(C("_w") * F.coalesce("value", F.lit(0.0))).alias("value"))


def lattice(boxes: DataFrame, step: Column | float) -> DataFrame:
    """Points of one lattice through the origin that lie in each box, bounds included. boxes: box_id, lo_x .. hi_z.

    The phase does not depend on the box, so neighbours share their points.
    """
    s = F.lit(float(step)) if isinstance(step, (int, float)) else step
    d = boxes
    for ax in "xyz":
        first, last = F.ceil(C(f"lo_{ax}") / s), F.floor(C(f"hi_{ax}") / s)
        d = d.withColumn(f"_{ax}", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    return d.select("box_id", *[(C(f"_{ax}") * s).alias(ax) for ax in "xyz"])


# ---- fits ------------------------------------------------------------------------------


def _group_sums(pairs: DataFrame, group: str) -> DataFrame:
    cols = {"n": F.count(F.lit(1)).cast("double")}
    src = ["x", "y", "z"]
    for i, a in enumerate(src):
        cols[f"s_{a}"] = F.sum(a)
        for b in src[i:]:
            cols[f"s_{a}{b}"] = F.sum(C(a) * C(b))
        for t in ("tx", "ty", "tz"):
            cols[f"s_{a}_{t}"] = F.sum(C(a) * C(t))
    for t in ("tx", "ty", "tz"):
        cols[f"s_{t}"] = F.sum(t)
    return pairs.groupBy(group).agg(*[e.alias(n) for n, e in cols.items()])


def _normal(sums):
    """Stacked 4x4 normal matrices and 4x3 right sides of a frame of sums."""
    import numpy as np

    m = np.empty((len(sums), 4, 4))
    t = np.empty((len(sums), 4, 3))
    for i, a in enumerate("xyz"):
        for j, b in enumerate("xyz"):
            m[:, i, j] = sums[f"s_{min(a, b)}{max(a, b)}"]
        m[:, i, 3] = m[:, 3, i] = sums[f"s_{a}"]
        for k, d in enumerate(("tx", "ty", "tz")):
            t[:, i, k] = sums[f"s_{a}_{d}"]
    m[:, 3, 3] = sums["n"]
    for k, d in enumerate(("tx", "ty", "tz")):
        t[:, 3, k] = sums[f"s_{d}"]
    return m, t


def fit_affine(pairs: DataFrame, group: str) -> DataFrame:
    """Least-squares affine per group from (x, y, z) -> (tx, ty, tz): 12 coefficients m00..m23.

    The points are reduced to normal-equation sums by map-side aggregation; only one
    row of sums per group reaches the 4x4 solve.
    """
    return _solved(pairs, group).select(group, *AFFINE)


AFFINE = [f"m{i}{j}" for i in range(3) for j in range(4)]
INVERSE = [f"v{i}{j}" for i in range(4) for j in range(4)]


def _solved(pairs: DataFrame, group: str) -> DataFrame:
    """Coefficients m00..m23 and the (pseudo)inverse v00..v33 of the normal matrix, one row per group."""
    sums = _group_sums(pairs, group)
    schema = f"{group} {dict(sums.dtypes)[group]}, " + ", ".join(f"{n} double" for n in AFFINE + INVERSE)

    def solve(batches):
        import numpy as np

        for pdf in batches:
            m, t = _normal(pdf)
            v = np.linalg.pinv(m, rcond=1e-13, hermitian=True)
            c = np.swapaxes(v @ t, 1, 2).reshape(len(pdf), -1)
            out = pd.DataFrame(np.hstack([c, v.reshape(len(pdf), -1)]), columns=AFFINE + INVERSE)
            out.insert(0, group, pdf[group].to_numpy())
            yield out

    return sums.mapInPandas(solve, schema)


def affine_residuals(pairs: DataFrame, fit: DataFrame, group: str, keep: list[str] | None = None) -> DataFrame:
    """Residual of every pair under its group's affine, in target units."""
    j = pairs.join(fit, group)
    r = [C(f"m{i}0") * C("x") + C(f"m{i}1") * C("y") + C(f"m{i}2") * C("z") + C(f"m{i}3") - C(t) for i, t in enumerate(("tx", "ty", "tz"))]
    return j.select(*pairs.columns, *(keep or []), F.sqrt(_dot(r, r)).alias("residual"))


def leave_one_out(pairs: DataFrame, group: str) -> DataFrame:
    """Residual of every pair under the affine of the other pairs of its group, as ``loo_residual``.

    One solve per group: a pair's leverage h = s'(M^-1)s turns its residual r into r / (1 - h). NULL for a pair of
    leverage 1, which the others say nothing about.
    """
    j = affine_residuals(pairs, _solved(pairs, group), group, keep=INVERSE)
    at = [C("x"), C("y"), C("z"), F.lit(1.0)]
    h = sum((at[i] * C(f"v{i}{k}") * at[k] for i in range(4) for k in range(4)), F.lit(0.0))
    j = once(j, {"_rest": 1 - h})
    return j.select(*pairs.columns, F.when(C("_rest") > 1e-9, C("residual") / C("_rest")).alias("loo_residual"))


def fit_similarity(pairs: DataFrame, group: str) -> DataFrame:
    """Scale, rotation and translation per group from paired points, from covariance sums."""
    sums = _group_sums(pairs, group)
    names = ["scale"] + [f"r{i}{j}" for i in range(3) for j in range(3)] + ["t0", "t1", "t2"]
    schema = f"{group} {dict(sums.dtypes)[group]}, " + ", ".join(f"{n} double" for n in names)

    def solve(batches):
        import numpy as np

        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                n = r["n"]
                mx = np.array([r[f"s_{a}"] for a in "xyz"]) / n
                mt = np.array([r[f"s_{t}"] for t in ("tx", "ty", "tz")]) / n
                cov = np.array([[r[f"s_{a}_{t}"] for a in "xyz"] for t in ("tx", "ty", "tz")]) / n - np.outer(mt, mx)
                var = (r["s_xx"] + r["s_yy"] + r["s_zz"]) / n - mx @ mx
                u, d, vt = np.linalg.svd(cov)
                s = np.eye(3)
                if np.linalg.det(u) * np.linalg.det(vt) < 0:
                    s[2, 2] = -1
                rot = u @ s @ vt
                scale = float(np.trace(np.diag(d) @ s) / var) if var > 0 else 1.0
                out.append([r[group], scale, *rot.reshape(-1), *(mt - scale * rot @ mx)])
            yield pd.DataFrame(out, columns=[group, *names])

    return sums.mapInPandas(solve, schema)


def principal_axes(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Area-weighted principal axis lengths per mesh, longest first."""
    t = corners(vertices, triangles)
    n = _cross(_sub(_v("b"), _v("a")), _sub(_v("c"), _v("a")))
    t = t.select("mesh_id", F.sqrt(_dot(n, n)).alias("w"), *[((C(f"a{ax}") + C(f"b{ax}") + C(f"c{ax}")) / 3).alias(ax) for ax in "xyz"])
    aggs = [F.sum("w").alias("w")] + [F.sum(C("w") * C(a)).alias(f"s_{a}") for a in "xyz"]
    aggs += [F.sum(C("w") * C(a) * C(b)).alias(f"s_{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    sums = t.groupBy("mesh_id").agg(*aggs)

    def solve(batches):
        import numpy as np

        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                m = np.array([r["s_x"], r["s_y"], r["s_z"]]) / r["w"]
                c = np.array([[r["s_xx"], r["s_xy"], r["s_xz"]], [r["s_xy"], r["s_yy"], r["s_yz"]], [r["s_xz"], r["s_yz"], r["s_zz"]]]) / r["w"] - np.outer(m, m)
                e = np.sort(np.linalg.eigvalsh(c))[::-1]
                out.append([r["mesh_id"], *[float(v) for v in e]])
            yield pd.DataFrame(out, columns=["mesh_id", "e0", "e1", "e2"])

    return sums.mapInPandas(solve, f"mesh_id {dict(vertices.dtypes)['mesh_id']}, e0 double, e1 double, e2 double")
