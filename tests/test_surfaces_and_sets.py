"""Closed surfaces, origin scores and owner sets against brute force."""

import itertools
import math
import random

from pyspark.sql import functions as F

from bodygrid.operators import mesh as ms
from bodygrid.operators import refine as rf
from bodygrid.plans.q_geometry import BOX


def box(name, lo, size, faces=12):
    v = [(name, i, *[float(lo[k] + size[k] * (i >> k & 1)) for k in range(3)]) for i in range(8)]
    return v, [(name, t, *BOX[t]) for t in range(faces)]


def tables(spark, boxes):
    v, t = zip(*boxes)
    return spark.createDataFrame(list(itertools.chain(*v)), "mesh_id string, vid int, x double, y double, z double"), spark.createDataFrame(list(itertools.chain(*t)), "mesh_id string, tid int, a int, b int, c int")


def test_closed_surfaces_are_decided_from_edges(spark):
    whole, open_, double = box("whole", (0, 0, 0), (1, 2, 3)), box("open", (5, 0, 0), (1, 1, 1), 11), box("double", (9, 0, 0), (1, 1, 1))
    double[1].append(("double", 12, 0, 2, 1))
    flat, turned = box("flat", (0, 9, 0), (1, 1, 1)), box("turned", (0, 0, 9), (1, 1, 1))
    flat[1].append(("flat", 12, 3, 3, 5))  # no area: left out, the surface stays closed
    turned[1][0] = ("turned", 0, 0, 1, 2)
    v, t = tables(spark, [whole, open_, double, flat, turned])
    closed, why = ms.solids(t)
    assert {r.mesh_id for r in closed.select("mesh_id").distinct().collect()} == {"whole", "flat"}
    assert {tuple(r) for r in why.collect()} == {("open", "open"), ("double", "over-shared edge"), ("turned", "inconsistent winding")}
    assert closed.filter("mesh_id = 'flat'").count() == 12


def test_origin_scores_and_control(spark):
    refs = [box("a", (0, 0, 0), (4, 4, 4)), box("b", (20, 0, 0), (4, 4, 4)), box("c", (0, 30, 0), (4, 4, 4))]
    moved = [box("a", (0.1, 0.2, 0.3), (4, 4, 4)), box("b", (0.2, 30.1, 0.1), (4, 4, 4)), box("d", (50, 0, 0), (4, 4, 4))]
    v, t = tables(spark, moved)
    got = {r.mesh_id: r for r in ms.origin_verdict(ms.origin_scores(v, t, *tables(spark, refs), 2.0)).collect()}
    assert got["a"].matched and not got["a"].control_passes and got["a"].against == "b"
    assert got["b"].against == "c" and got["b"].control_passes and not got["b"].matched  # it is really c
    assert got["d"].own_mean is None and got["d"].against == "b"

    def distance(p, lo, size):  # to the surface of a box
        out = [max(lo[k] - p[k], 0, p[k] - lo[k] - size[k]) for k in range(3)]
        return math.hypot(*out) if any(out) else min(min(p[k] - lo[k], lo[k] + size[k] - p[k]) for k in range(3))

    there = [distance(p[2:], (0, 0, 0), (4, 4, 4)) for p in moved[0][0]]
    back = [distance(p[2:], (0.1, 0.2, 0.3), (4, 4, 4)) for p in refs[0][0]]
    assert math.isclose(got["a"].own_mean, (sum(there) + sum(back)) / 16, abs_tol=1e-9) and math.isclose(got["a"].own_p95, sorted(there)[7], abs_tol=1e-9)
    assert got["a"].own_agreement == 1


def test_nearest_other(spark):
    rng = random.Random(4)
    pts = [(f"m{i}", *[rng.uniform(-50, 50) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(pts, "mesh_id string, x double, y double, z double")
    got = {r.mesh_id: r.other for r in ms.nearest_other(df, df, 1.0).collect()}
    assert got == {p[0]: min((math.dist(p[1:], q[1:]), q[0]) for q in pts if q[0] != p[0])[1] for p in pts}
    assert ms.nearest_other(df.limit(1), df.limit(1), 1.0, max_rounds=3).count() == 0


def test_owner_sets_are_those_of_the_atoms(spark):
    from bodygrid.functions import address as ad

    rng = random.Random(1)
    cells = ["BV-L-" + "".join(str(rng.randint(0, 7)) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rows = [(g, f"o{rng.randint(0, 5)}", c) for g in ("x", "y") for c in cells if rng.random() < 0.6]
    cov = ad.with_key(spark.createDataFrame(rows, "g string, owner string, cell string")).drop("cell")
    layers, sets = rf.owner_sets(cov, "owner", "g")
    atoms = rf.owned_atoms(cov, "owner", "g").groupBy("g", "atom_key").agg(F.array_sort(F.collect_set("owner")).alias("o")).select("g", "o").distinct()
    want = sorted((r.g, tuple(r.o)) for r in atoms.collect())
    got = sorted((r.g, tuple(r.o)) for r in sets.groupBy("g", "set_id").agg(F.array_sort(F.collect_list("owner")).alias("o")).collect())
    assert got == want
    assert {(r.g, r.owner_count) for r in layers.select("g", "owner_count").distinct().collect()} == {(g, len(o)) for g, o in want}
    selected = spark.createDataFrame([("x", f"o{i}") for i in range(8)], "g string, owner string")
    assert {r.owner for r in rf.without_geometry(selected, cov, ["g", "owner"]).collect()} == {f"o{i}" for i in range(8)} - {o for g, o, _ in rows if g == "x"}


def test_equally_near_surfaces_are_decided_by_name(spark):
    v, t = tables(spark, [box("a", (7, 35, -18), (6, 7, 6)), box("b", (10, 37, -12), (4, 6, 7))])  # both have a face at z = -12
    p = spark.createDataFrame([("p", 10.85, 40.137, -13.709)], "point_id string, x double, y double, z double")
    r = ms.nearest_surface(p, v, t, 4.0).first()
    assert r.mesh_id == "a" and math.isclose(r.distance, 1.709)
    spots = spark.createDataFrame([("m", 0.0, 0.0, 0.0), ("n", 0.1, 0.2, 0.3), ("o", 0.3, 0.1, 0.2)], "mesh_id string, x double, y double, z double")
    assert ms.nearest_other(spots.filter("mesh_id = 'm'"), spots, 1.0).first().other == "n"
