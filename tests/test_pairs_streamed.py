"""Pairs of cells and structures leave the join that finds them: nothing groups, sorts or deals them out again."""

import random

from bodygrid.functions import address as ad
from bodygrid.operators import coverings as cv
from bodygrid.operators import names as nm

INDEX = [("a", "BV-L-1"), ("a", "BV-L-22"), ("b", "BV-L-12"), ("b", "BV-L-13"), ("c", "BD-T01"), ("d", "BV-L-1"), ("e", "BV-L-123")]
CELLS = ["BV-L", "BV-L-1", "BV-L-12", "BV-L-123", "BV-L-1234", "BV-L-2", "BV-L-3", "BD-T01-01I", "BV-R"]


def keyed(spark, rows, schema):
    return ad.with_key(spark.createDataFrame(rows, schema))


def over(df):
    """What the plan does with the rows of its joins."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_pairs_are_not_grouped(spark):
    index = keyed(spark, INDEX, "structure_id string, cell string").drop("cell")
    cells = keyed(spark, [(c,) for c in CELLS * 2], "cell string")
    inside = {(c, s) for c in CELLS for s, o in INDEX if c.startswith(o)}
    both = inside | {(c, s) for c in CELLS for s, o in INDEX if o.startswith(c)}
    probes = cells.withColumnRenamed("cell_key", "probe_key")
    r = cv.address_vs_covering(probes, index, "structure_id", disjoint=True)
    assert sorted((x["cell"], x["structure_id"], x["contained"]) for x in r.collect()) == sorted((*p, p in inside) for p in both)
    m = cv.measure_within(index, cells.withColumnRenamed("cell_key", "outer_key"), "structure_id")
    share = {(x["cell"], x["structure_id"]): x["fraction"] for x in m.collect()}
    assert set(share) == both and share["BV-L-1", "b"] == 0.25 and share["BV-L", "a"] == 1 / 8 + 1 / 64 and share["BV-L-1234", "a"] == 1
    h = nm.containing_structures(cells, index)
    assert sorted((x["cell"], x["structure_id"]) for x in h.collect()) == sorted(inside)
    assert all("Aggregate" not in over(d) for d in (r, m, h))


def test_nested_coverings_have_one_row_a_pair(spark):
    index = keyed(spark, [("a", "BV-L-1"), ("a", "BV-L-12"), ("a", "BV-L-12")], "structure_id string, cell string").drop("cell")
    r = cv.address_vs_covering(keyed(spark, [("BV-L-123",), ("BV-L",)], "cell string").withColumnRenamed("cell_key", "probe_key"), index, "structure_id")
    assert sorted((x["cell"], x["contained"]) for x in r.collect()) == [("BV-L", False), ("BV-L-123", True)]


def covered(cell, cells):
    """Share of a cell of BV that disjoint cells hold."""
    digits = lambda c: len(c.split("-")[2]) if c.count("-") == 2 else 0
    return 1.0 if any(cell.startswith(c) for c in cells) else sum(8.0 ** (digits(cell) - digits(c)) for c in cells if c.startswith(cell))


def random_index(rng):
    name = lambda: "BV-L-" + "".join(rng.choice("0123") for _ in range(rng.randint(1, 3)))
    picked = {(f"s{rng.randint(1, 14)}", name()) for _ in range(60)}
    return [(s, c) for s, c in picked if not any(t == s and o != c and c.startswith(o) for t, o in picked)]


def test_ranks_come_from_lists_of_the_index(spark):
    rng = random.Random(5)
    rows = random_index(rng)
    index = keyed(spark, rows, "structure_id string, cell string").drop("cell")
    names = spark.createDataFrame([(f"s{i}", f"name {i}") for i in range(1, 14)], "structure_id string, structure_name string")  # s14 has none
    cells = sorted({c + t for _, c in rows for t in ("", "0", "01")} | {"BV-L", "BV-L-0", "BV-L-7", "BV-R", "BD-T01"})
    q = keyed(spark, [(c, n) for c in cells for n in (1, 2)], "cell string, n int")
    for limit, least in ((None, 0.0), (3, 0.1), (0, 0.0)):
        d = nm.resolve(q, index, names, "v", limit=limit, min_fraction=least)
        got = sorted((r["cell"], r["n"], r["rank"] or 0, r["structure_id"] or "", r["structure_name"] or "", r["fraction"] or 0.0) for r in d.collect())
        want = []
        for c in cells:
            hits = [(-covered(c, [o for t, o in rows if t == s]), s) for s in {s for s, _ in rows}]
            hits = sorted(h for h in hits if h[0] < 0 and -h[0] >= least)[:limit]
            told = [(k, s, f"name {s[1:]}" if s != "s14" else "", -f) for k, (f, s) in enumerate(hits, 1)] or [(0, "", "", 0.0)]
            want += [(c, n, *t) for t in told for n in (1, 2)]
        assert got == sorted(want)
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan.split("Join")[0]  # as each pair would be sorted


def test_versions_are_compared_before_cells_meet_them(spark):
    rng = random.Random(6)
    old = random_index(rng)
    moved = {(s, c[:6] if s in ("s1", "s2", "s3") else c) for s, c in old if s not in ("s4", "s5")} | {("s6", "BV-L-4"), ("s15", "BV-L-1")}
    new = [(s, c) for s, c in moved if not any(t == s and o != c and c.startswith(o) for t, o in moved)]
    cells = sorted({c + t for _, c in old + new for t in ("", "0", "01", "3")} | {"BV-L", "BV-L-0", "BV-R"})
    table = lambda rows: keyed(spark, rows, "structure_id string, cell string").drop("cell")
    d = nm.revision_diff(keyed(spark, [(c,) for c in cells * 2], "cell string"), table(old), table(new))
    got = sorted((r["cell"], r["structure_id"], r["change"]) for r in d.collect())
    want = []
    for s in {s for s, _ in old + new}:
        for c in cells:
            a, b = (covered(c, [o for t, o in rows if t == s]) for rows in (old, new))
            if a != b:
                want.append((c, s, "added" if not a else "removed" if not b else "changed"))
    assert got == sorted(want) and {w[2] for w in want} == {"added", "removed", "changed"}
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan


def test_intersections_need_no_rolling_up_of_pairs(spark):
    rng = random.Random(7)
    eight = [("s1", f"BV-L-1{i}") for i in range(8)] + [("s2", f"BV-L-12{i}") for i in range(8)]
    a, b = [(s, c) for s, c in random_index(rng)] + [("s20", c) for _, c in eight], [(s, c) for s, c in random_index(rng) + eight]
    table = lambda rows, name: keyed(spark, rows, f"{name} string, cell string").drop("cell")
    left, right = table(a, "a"), table(b, "b")
    d = cv.intersect(left, right, "a", "b")
    want = cv.normalize(d, ["a", "b"])
    got = sorted(map(tuple, d.select("a", "b", "cell_key").collect()))
    assert got == sorted(map(tuple, want.select("a", "b", "cell_key").collect())) and len(got) == len(set(got))
    share = lambda rows, i: [c for j, c in rows if j == i]
    finest = [f"BV-L-{i:03o}" for i in range(512)]  # no cell of these is finer
    held = {(i, j, f) for i in {x for x, _ in a} for j in {x for x, _ in b} for f in finest if any(f.startswith(c) for c in share(a, i)) and any(f.startswith(c) for c in share(b, j))}
    text = d.select("a", "b", ad.cell_text(d["cell_key"]).alias("c")).collect()
    assert {(r["a"], r["b"], f) for r in text for f in finest if f.startswith(r["c"])} == held
    assert "Aggregate" not in over(d)
