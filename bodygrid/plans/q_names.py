"""Coverings, refinement and name resolution over the driver tables."""

from pyspark.sql import functions as F

from bodygrid.functions import address as ad
from bodygrid.operators import checks as ck
from bodygrid.operators import coverings as cv
from bodygrid.operators import names as nm
from bodygrid.operators import refine as rf
from bodygrid.plans import tables as T
from bodygrid.plans.registry import ctes, query
from bodygrid.session import written

LI, PC, PS = T.LINEITEM_CELLS_SQL, T.PART_CELLS_SQL, T.PART_STRUCTURES_SQL
PROBE = "probe AS (SELECT DISTINCT cell FROM lineitem_cells)"
U = T.units


def stored(name, write=True):
    """Keep a built table for the session: written once to the shared folder, then only read. ``write``: not if the build does it."""

    def wrap(build):
        def get(spark, sf):
            key = (spark.sparkContext.applicationId, sf, name)
            if key not in _STORED:
                built = build(spark, sf)
                _STORED[key] = written(built) if write else built
            return _STORED[key]

        return get

    return wrap


_STORED = {}


@stored("index")
def index_of(spark, sf):
    """The parts index: normalised structure coverings."""
    return cv.normalize(T.part_structure_cells(spark, sf), ["structure_id"])


@stored("union")
def union_of(spark, sf):
    return nm.index_union(index_of(spark, sf))


@stored("rolled")
def rolled_of(spark, sf):
    return nm.rollup(index_of(spark, sf), ["structure_id"])


@stored("rolled_union")
def rolled_union_of(spark, sf):
    return nm.rollup(union_of(spark, sf), [])


def published(spark, sf):
    """What is published with the index for resolution."""
    return {"union": union_of(spark, sf), "rolled": rolled_of(spark, sf), "rolled_union": rolled_union_of(spark, sf)}


def text(key="cell_key"):
    return ad.cell_text(F.col(key))


def supplier_cells(spark, sf):
    li = T.lineitem_cells(spark, sf)
    return li.select(F.col("l_suppkey").alias("covering_id"), "cell_key").distinct()


# Normal form by definition, on text only: fill parents whose members' shares add
# up to the whole, then drop everything below another member.
def normalize_sql(src: str, ids: str, out: str, how: str = "") -> str:
    j = " AND ".join(f"b.{i.strip()} = a.{i.strip()}" for i in ids.split(","))
    return f"""{out}_m AS {how}(SELECT DISTINCT {ids}, cell FROM {src}),
{out}_d AS {how}(SELECT a.* FROM {out}_m a WHERE NOT EXISTS (SELECT 1 FROM {out}_m b WHERE {j} AND b.cell <> a.cell AND starts_with(a.cell, b.cell))),
{out}_e AS (SELECT {ids}, {U('cell')} AS u, unnest(list_transform(range(CASE WHEN cell LIKE 'BV%' THEN 4 ELSE 6 END, length(cell)), lambda k: left(cell, k))) AS anc FROM {out}_d),
{out}_f AS (SELECT {ids}, anc AS cell FROM {out}_e WHERE anc NOT LIKE '%-' AND NOT regexp_full_match(anc, 'BD-...-..?') GROUP BY {ids}, anc HAVING sum(u) = {U('anc')}),
{out}_u AS {how}(SELECT * FROM {out}_d UNION SELECT * FROM {out}_f),
{out} AS (SELECT a.* FROM {out}_u a WHERE NOT EXISTS (SELECT 1 FROM {out}_u b WHERE {j} AND b.cell <> a.cell AND starts_with(a.cell, b.cell)))"""


SUP = "sup AS (SELECT DISTINCT l_suppkey AS covering_id, cell FROM lineitem_cells)"
NORM_SUP = normalize_sql("sup", "covering_id", "ns")


@query(ctes(LI, SUP, NORM_SUP) + "SELECT covering_id, cell FROM ns")
def normalized_coverings(spark, sf):
    """Each supplier's cells as the smallest equivalent covering."""
    return cv.normalize(supplier_cells(spark, sf), ["covering_id"]).select("covering_id", text().alias("cell"))


NATION_SUP = """nat AS (SELECT s_nationkey AS covering_id, cell FROM lineitem_cells JOIN supplier ON s_suppkey = l_suppkey)"""


@query(ctes(LI, NATION_SUP, normalize_sql("nat", "covering_id", "un")) + "SELECT covering_id, cell FROM un")
def covering_unions(spark, sf):
    """Union of the supplier coverings of each nation."""
    sup = T.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    c = supplier_cells(spark, sf).join(sup, F.col("covering_id") == F.col("s_suppkey"))
    c = c.select(F.col("s_nationkey").alias("covering_id"), "cell_key")
    return cv.union([c.filter("covering_id < 12"), c.filter("covering_id >= 12")], ["covering_id"]).select(
        "covering_id", text().alias("cell")
    )


# Materialised: the optimizer of DuckDB fails on its own cache of strings otherwise.
INTER = """ix AS MATERIALIZED (SELECT DISTINCT s.structure_id, n.covering_id, CASE WHEN length(s.cell) >= length(n.cell) THEN s.cell ELSE n.cell END AS cell
  FROM structure_cells s JOIN nat n ON starts_with(s.cell, n.cell) OR starts_with(n.cell, s.cell))"""


@query(ctes(LI, PC, NATION_SUP.replace("nat AS (SELECT", "nat AS MATERIALIZED (SELECT DISTINCT"), INTER, normalize_sql("ix", "structure_id, covering_id", "xx", "MATERIALIZED ")) + "SELECT structure_id, covering_id, cell FROM xx")
def covering_intersections(spark, sf):
    """Exact intersection of every structure with every nation's covering."""
    sup = T.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nat = supplier_cells(spark, sf).join(sup, F.col("covering_id") == F.col("s_suppkey"))
    nat = nat.select(F.col("s_nationkey").alias("covering_id"), "cell_key").distinct()
    x = cv.intersect(index_of(spark, sf), nat, "structure_id", "covering_id", normal=True)
    return x.select("structure_id", "covering_id", text().alias("cell"))


@query(
    ctes(LI, PC, SUP)
    + """SELECT DISTINCT structure_id FROM structure_cells s WHERE EXISTS (SELECT 1 FROM sup WHERE covering_id % 5 = 1
      AND (starts_with(s.cell, sup.cell) OR starts_with(sup.cell, s.cell)))"""
)
def overlapping_coverings(spark, sf):
    """Structures sharing any volume with the chosen suppliers' coverings."""
    chosen = supplier_cells(spark, sf).filter("covering_id % 5 = 1")
    return cv.overlapping_ids(index_of(spark, sf), chosen, ["structure_id"])


@query(
    ctes(LI, PC, PROBE)
    + """SELECT p.cell, s.structure_id, bool_or(starts_with(p.cell, s.cell)) AS contained FROM probe p JOIN structure_cells s
      ON starts_with(p.cell, s.cell) OR starts_with(s.cell, p.cell) GROUP BY ALL"""
)
def cells_against_coverings(spark, sf):
    probes = T.lineitem_cells(spark, sf).select("cell", F.col("cell_key").alias("probe_key"))
    return cv.address_vs_covering(probes, index_of(spark, sf), "structure_id", disjoint=True).select("cell", "structure_id", "contained")


@query(
    ctes(LI, PC, PROBE)
    + f"""SELECT p.cell, s.structure_id, round(sum(CASE WHEN starts_with(p.cell, s.cell) THEN {U('p.cell')} ELSE {U('s.cell')} END) / ({U('p.cell')}), 9) AS fraction
      FROM probe p JOIN structure_cells s ON starts_with(p.cell, s.cell) OR starts_with(s.cell, p.cell) GROUP BY p.cell, s.structure_id"""
)
def covering_share_of_cells(spark, sf):
    """Fraction of each cell that each structure occupies."""
    outers = T.lineitem_cells(spark, sf).select("cell", F.col("cell_key").alias("outer_key"))
    m = cv.measure_within(index_of(spark, sf), outers, "structure_id")
    return m.select("cell", "structure_id", F.round("fraction", 9).alias("fraction"))


@query(ctes(LI, SUP, NORM_SUP) + f"SELECT covering_id, round(sum({U('cell')}) / (24.0 * 68719476736), 9) AS measure FROM ns GROUP BY covering_id")
def covering_measures(spark, sf):
    m = cv.measure(cv.maximal_cells(supplier_cells(spark, sf), ["covering_id"]), ["covering_id"])
    return m.select("covering_id", F.round("measure", 9).alias("measure"))


@query(
    ctes(LI, "cut AS (SELECT DISTINCT l_suppkey AS covering_id, CASE WHEN cell LIKE 'BD%' THEN left(cell, 12) ELSE left(cell, 6) END AS cell FROM lineitem_cells)",
         normalize_sql("cut", "covering_id", "ru"))
    + "SELECT covering_id, cell FROM ru"
)
def rolled_up_coverings(spark, sf):
    return cv.roll_up(supplier_cells(spark, sf), ["covering_id"], 1).select("covering_id", text().alias("cell"))


@query(
    ctes(LI, SUP)
    + "SELECT covering_id, string_agg(DISTINCT left(cell, 2), ',' ORDER BY left(cell, 2)) AS frames FROM sup GROUP BY covering_id"
)
def covering_frames(spark, sf):
    f = cv.covering_frames(supplier_cells(spark, sf), ["covering_id"])
    return f.withColumn("frames", F.array_join("frames", ","))


# ---- refinement: selections of suppliers by nation ----------------------------

# An atom is a member, or a child of an opened cell, that no member lies strictly inside and some member contains.
KIDS = """CASE WHEN cell LIKE 'BR%' THEN list_transform(range(0, 16), lambda i: cell || to_base(i, 16))
  WHEN length(cell) = 6 AND cell LIKE 'BD%' THEN list_transform(range(0, 24), lambda i: cell || '-' || lpad(CAST(i // 2 + 1 AS VARCHAR), 2, '0') || CASE WHEN i % 2 = 0 THEN 'I' ELSE 'O' END)
  WHEN regexp_full_match(cell, 'B.-[LR]|BD-...-...') THEN list_transform(range(0, 8), lambda i: cell || '-' || i)
  ELSE list_transform(range(0, 8), lambda i: cell || i) END"""


@query(
    ctes(LI, "every AS (SELECT DISTINCT cell AS covering_id, cell FROM lineitem_cells)", f"kids AS (SELECT covering_id, unnest({KIDS}) AS cell FROM every)",
         "one AS (SELECT covering_id, min(cell) AS cell FROM kids GROUP BY ALL)", f"filled AS (SELECT * FROM kids UNION ALL SELECT covering_id, ({KIDS})[2] FROM one)")
    + "SELECT DISTINCT covering_id, covering_id AS cell FROM filled"
)
def complete_siblings_roll_up(spark, sf):
    """All children of every cell of every frame, plus one nested in the first of them, come back as that one cell."""
    c = T.lineitem_cells(spark, sf).select("cell", "cell_key").distinct()
    kids = c.select(F.col("cell").alias("covering_id"), rf.child_keys(F.col("cell_key")).alias("kids"))
    nested = kids.select("covering_id", F.get(rf.child_keys(F.get("kids", F.lit(0))), F.lit(1)).alias("cell_key"))
    return cv.normalize(kids.select("covering_id", F.explode("kids").alias("cell_key")).unionByName(nested), ["covering_id"]).select("covering_id", text().alias("cell"))


ATOMS = f"""sel AS (SELECT DISTINCT s_nationkey AS g, CAST(s_suppkey AS VARCHAR) AS owner, cell FROM lineitem_cells JOIN supplier ON s_suppkey = l_suppkey),
mem AS (SELECT DISTINCT g, cell FROM sel),
anc AS (SELECT DISTINCT g, unnest(list_transform(range(CASE WHEN cell LIKE 'BV%' THEN 4 ELSE 6 END, length(cell)), lambda k: left(cell, k))) AS cell FROM mem),
opened AS (SELECT a.* FROM anc a WHERE a.cell NOT LIKE '%-' AND NOT regexp_full_match(a.cell, 'BD-...-..?')
  AND EXISTS (SELECT 1 FROM mem m WHERE m.g = a.g AND starts_with(a.cell, m.cell))),
kid AS (SELECT g, unnest({KIDS}) AS cell FROM opened),
cand AS (SELECT * FROM mem UNION SELECT * FROM kid),
atoms AS (SELECT c.* FROM cand c ANTI JOIN opened o ON o.g = c.g AND o.cell = c.cell),
own AS (SELECT a.g, a.cell, string_agg(DISTINCT CAST(s.owner AS VARCHAR), ',' ORDER BY CAST(s.owner AS VARCHAR)) AS owners, count(DISTINCT s.owner) AS owner_count
  FROM atoms a JOIN sel s ON s.g = a.g AND starts_with(a.cell, s.cell) GROUP BY a.g, a.cell)"""


def selections(spark, sf):
    sup = T.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    c = supplier_cells(spark, sf).join(sup, F.col("covering_id") == F.col("s_suppkey"))
    return c.select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").cast("string").alias("owner"), "cell_key")


@query(ctes(LI, ATOMS) + "SELECT g, cell, owners FROM own")
def common_refinement(spark, sf):
    """Disjoint atoms of each nation's suppliers with the full owner set of each atom."""
    oa = rf.owned_atoms(selections(spark, sf), "owner", "g")
    o = oa.groupBy("g", "atom_key").agg(F.array_join(F.array_sort(F.collect_set("owner")), ",").alias("owners"))
    return o.select("g", text("atom_key").alias("cell"), "owners")


@query(ctes(LI, ATOMS, normalize_sql("own", "g, owners, owner_count", "ly")) + "SELECT g, owners, owner_count, cell FROM ly")
def owner_set_layers(spark, sf):
    return rf.owner_layers(selections(spark, sf), "owner", "g").select("g", "owners", "owner_count", text().alias("cell"))


@query(
    ctes(LI, ATOMS) + """, st AS (SELECT g, owners, owner_count, count(*) AS atoms FROM own GROUP BY ALL)
    SELECT g, owners, owner_count, unnest(string_split(owners, ',')) AS owner, NULL AS problem FROM st
    UNION ALL SELECT s_nationkey, NULL, NULL, CAST(s_suppkey AS VARCHAR), 'no geometry' FROM supplier WHERE NOT EXISTS (SELECT 1 FROM sel WHERE g = s_nationkey AND owner = CAST(s_suppkey AS VARCHAR))"""
)
def owner_set_members(spark, sf):
    """Members of each distinct owner set, once a set, and selected suppliers that have no cells."""
    c = selections(spark, sf)
    layers, sets = rf.owner_sets(c, "owner", "g")
    size = layers.select("g", "set_id", "owner_count").distinct()
    names = sets.groupBy("g", "set_id").agg(F.array_join(F.array_sort(F.collect_set("owner")), ",").alias("owners"))
    told = sets.join(size, ["g", "set_id"]).join(names, ["g", "set_id"]).select("g", "owners", "owner_count", "owner")
    every = T.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").cast("string").alias("owner"))
    none = rf.without_geometry(every, c, ["g", "owner"]).withColumn("problem", F.lit("no geometry"))
    return told.unionByName(none, allowMissingColumns=True)


@query(ctes(LI, ATOMS, "many AS (SELECT g, cell FROM own WHERE owner_count > 1)", normalize_sql("many", "g", "hx")) + "SELECT g, cell FROM hx")
def shared_extents(spark, sf):
    """Everything two or more members of a selection occupy."""
    layers = rf.owner_layers(selections(spark, sf), "owner", "g")
    return rf.shared_extent(layers, "g").select("g", text().alias("cell"))


@query(
    """WITH sel AS (SELECT n_nationkey % 5 AS selection_id, 'p' || s_suppkey AS paper_id, min(s_suppkey) AS pos FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2),
    prev AS (SELECT selection_id, 'p' || ((selection_id * 17 + slot * 5) % 60) AS paper_id, slot FROM (SELECT DISTINCT selection_id FROM sel), (SELECT unnest([2, 5, 7]) AS slot)),
    kept AS (SELECT s.*, p.slot FROM sel s JOIN prev p USING (selection_id, paper_id)),
    fresh AS (SELECT s.*, row_number() OVER (PARTITION BY selection_id ORDER BY pos, paper_id) AS r FROM sel s ANTI JOIN prev p USING (selection_id, paper_id)),
    free AS (SELECT selection_id, slot, row_number() OVER (PARTITION BY selection_id ORDER BY slot) AS r FROM (SELECT DISTINCT selection_id FROM sel), (SELECT unnest(range(1, 9)) AS slot)
      WHERE (selection_id, slot) NOT IN (SELECT selection_id, slot FROM kept))
    SELECT selection_id, paper_id, slot FROM kept UNION ALL SELECT f.selection_id, f.paper_id, e.slot FROM fresh f LEFT JOIN free e USING (selection_id, r)"""
)
def stable_slots(spark, sf):
    sup = T.table(spark, sf, "supplier")
    sel = sup.select((F.col("s_nationkey") % 5).alias("selection_id"), F.concat(F.lit("p"), "s_suppkey").alias("paper_id"), F.col("s_suppkey").alias("pos"))
    prev = (
        sel.select("selection_id").distinct().withColumn("slot", F.explode(F.array(F.lit(2), F.lit(5), F.lit(7))))
        .withColumn("paper_id", F.concat(F.lit("p"), ((F.col("selection_id") * 17 + F.col("slot") * 5) % 60).cast("string")))
    )
    return rf.assign_slots(sel, prev).select("selection_id", "paper_id", "slot")


@query(ctes(PC, normalize_sql("structure_cells_raw", "structure_id", "nx")) + "SELECT structure_id, cell FROM nx")
def name_index(spark, sf):
    """Build the index from raw cells (not the stored copy the other queries read)."""
    return cv.normalize(T.part_structure_cells(spark, sf), ["structure_id"]).select("structure_id", text().alias("cell"))


# ---- names ---------------------------------------------------------------------

OVER = f"""ov AS (SELECT p.cell, s.structure_id, sum(CASE WHEN starts_with(p.cell, s.cell) THEN {U('p.cell')} ELSE {U('s.cell')} END) AS u
  FROM probe p JOIN structure_cells s ON starts_with(p.cell, s.cell) OR starts_with(s.cell, p.cell) GROUP BY p.cell, s.structure_id),
un AS (SELECT DISTINCT a.cell FROM structure_cells a WHERE NOT EXISTS (SELECT 1 FROM structure_cells b WHERE b.cell <> a.cell AND starts_with(a.cell, b.cell))),
cl AS (SELECT p.cell, sum(CASE WHEN starts_with(p.cell, s.cell) THEN {U('p.cell')} ELSE {U('s.cell')} END) AS cu
  FROM probe p JOIN un s ON starts_with(p.cell, s.cell) OR starts_with(s.cell, p.cell) GROUP BY p.cell)"""
RESOLVED = OVER + f""", rk AS (SELECT *, u / ({U('cell')}) AS f, row_number() OVER (PARTITION BY cell ORDER BY u DESC, structure_id) AS rank FROM ov)
SELECT p.cell, rank, r.structure_id, structure_name, round(f, 9) AS fraction, round(1 - coalesce(cu, 0) / ({U('p.cell')}), 9) AS unclaimed_fraction,
  '{T.INDEX_VERSION}' AS index_version FROM probe p LEFT JOIN cl ON cl.cell = p.cell LEFT JOIN rk r ON r.cell = p.cell {{where}}
  LEFT JOIN structures USING (structure_id)"""


def _resolved(df):
    return df.select(
        "cell",
        "rank",
        "structure_id",
        "structure_name",
        F.round("fraction", 9).alias("fraction"),
        F.round("unclaimed_fraction", 9).alias("unclaimed_fraction"),
        "index_version",
    )


@query(ctes(LI, PC, PS, PROBE) + ", " + RESOLVED.format(where=""))
def resolve_cells(spark, sf):
    """Flagship: which structures occupy each cell, in what fraction, and how much is unclaimed."""
    r = nm.resolve(T.lineitem_cells(spark, sf).select("cell", "cell_key"), index_of(spark, sf), T.part_structures(spark, sf), T.INDEX_VERSION, **published(spark, sf))
    return _resolved(r)


@query(ctes(LI, PC, PS, PROBE) + ", " + RESOLVED.format(where="AND r.rank <= 3 AND r.f >= 0.1"))
def resolve_top_three(spark, sf):
    """Top three names of each cell holding at least a tenth of it; dropped names keep their claim."""
    r = nm.resolve(
        T.lineitem_cells(spark, sf).select("cell", "cell_key"), index_of(spark, sf), T.part_structures(spark, sf), T.INDEX_VERSION, **published(spark, sf), min_fraction=0.1, limit=3
    )
    return _resolved(r)


@query(
    ctes(LI, PC, SUP, NORM_SUP)
    + f""", un AS (SELECT DISTINCT a.cell FROM structure_cells a WHERE NOT EXISTS (SELECT 1 FROM structure_cells b WHERE b.cell <> a.cell AND starts_with(a.cell, b.cell))),
    tot AS (SELECT covering_id, sum({U('cell')}) AS t FROM ns GROUP BY covering_id),
    cl AS (SELECT covering_id, sum(CASE WHEN starts_with(p.cell, s.cell) THEN {U('p.cell')} ELSE {U('s.cell')} END) AS cu FROM ns p JOIN un s ON starts_with(p.cell, s.cell) OR starts_with(s.cell, p.cell) GROUP BY covering_id),
    ov AS (SELECT covering_id, structure_id, sum(CASE WHEN starts_with(p.cell, s.cell) THEN {U('p.cell')} ELSE {U('s.cell')} END) AS u
      FROM ns p JOIN structure_cells s ON starts_with(p.cell, s.cell) OR starts_with(s.cell, p.cell) GROUP BY covering_id, structure_id)
    SELECT covering_id, structure_id, CASE WHEN structure_id IS NOT NULL THEN row_number() OVER (PARTITION BY covering_id ORDER BY u DESC, structure_id) END AS rank, round(u / t, 9) AS fraction, round(1 - coalesce(cu, 0) / t, 9) AS unclaimed_fraction
    FROM tot LEFT JOIN cl USING (covering_id) LEFT JOIN ov USING (covering_id)"""
)
def resolve_supplier_coverings(spark, sf):
    """Measure-weighted names of each supplier's covering."""
    c = cv.normalize(supplier_cells(spark, sf), ["covering_id"])
    r = nm.resolve_coverings(c, "covering_id", index_of(spark, sf), **published(spark, sf))
    return r.select("covering_id", "structure_id", "rank", F.round("fraction", 9).alias("fraction"), F.round("unclaimed_fraction", 9).alias("unclaimed_fraction"))


@query(
    ctes(PC, normalize_sql("structure_cells_raw", "structure_id", "nx"))
    + """, asked AS (SELECT DISTINCT 'S:' || (l_partkey * 2) AS structure_id FROM lineitem)
    SELECT structure_id, cell, false AS unknown FROM nx SEMI JOIN asked USING (structure_id)
    UNION ALL SELECT structure_id, NULL, true FROM asked ANTI JOIN nx USING (structure_id)"""
)
def structure_coverings_by_id(spark, sf):
    ids = T.table(spark, sf, "lineitem").select(F.concat(F.lit("S:"), F.col("l_partkey") * 2).alias("structure_id")).distinct()
    known, unknown = nm.structure_covering(ids, index_of(spark, sf))
    return known.select("structure_id", text().alias("cell"), F.lit(False).alias("unknown")).unionByName(
        unknown.select("structure_id", F.lit(None).cast("string").alias("cell"), F.lit(True).alias("unknown"))
    )


RUNG = "CASE WHEN {c} LIKE 'BD%' THEN CASE WHEN length({c}) = 6 THEN 0 ELSE 1 + greatest(length({c}) - 11, 0) END ELSE greatest(length({c}) - 5, 0) END"


@query(
    ctes(LI, PC, PROBE)
    + f"SELECT p.cell, s.structure_id, min({RUNG.format(c='s.cell')}) AS rung FROM probe p JOIN structure_cells s ON starts_with(p.cell, s.cell) GROUP BY ALL"
)
def structures_containing_cells(spark, sf):
    r = nm.containing_structures(T.lineitem_cells(spark, sf).select("cell", "cell_key"), index_of(spark, sf))
    return r.select("cell", "structure_id", "rung")


@query(
    """WITH needles AS (SELECT DISTINCT lower(p_type) AS needle FROM part UNION SELECT 'widget' UNION SELECT 's:17' UNION SELECT ' Red '),
    hit AS (SELECT trim(lower(needle)) AS needle, 'S:' || p_partkey AS structure_id, row_number() OVER (PARTITION BY trim(lower(needle)) ORDER BY p_partkey) AS rank
      FROM part, needles WHERE contains(lower(p_name), trim(lower(needle))) OR lower('S:' || p_partkey) = trim(lower(needle)))
    SELECT * FROM hit WHERE rank <= 20"""
)
def find_names(spark, sf):
    extra = spark.sql("SELECT explode(array('widget', 's:17', ' Red ')) AS needle")
    needles = T.table(spark, sf, "part").select(F.lower("p_type").alias("needle")).distinct().unionByName(extra)
    return nm.find_structures(T.part_structures(spark, sf), needles, 20).select("needle", "structure_id", "rank")


@query(
    """SELECT 'S:' || p_partkey AS structure_id, p_name AS structure_name FROM part WHERE contains(lower(p_name), 'ring') AND contains(lower(p_name), 's')
    ORDER BY CASE WHEN starts_with(lower(p_name), 's ring') THEN 0 ELSE 1 END, length(p_name), p_name, structure_id LIMIT 12"""
)
def search_names(spark, sf):
    return nm.search_structures(T.part_structures(spark, sf), "s ring", 12).select("structure_id", "structure_name")


@query(
    "SELECT p_name AS title, string_agg(DISTINCT p_brand || ' not cleared', '; ' ORDER BY p_brand || ' not cleared') AS reasons FROM part WHERE p_size > 40 GROUP BY p_name"
)
def withheld_names(spark, sf):
    p = T.table(spark, sf, "part")
    held = p.select(F.col("p_name").alias("title"), F.when(F.col("p_size") > 40, F.concat("p_brand", F.lit(" not cleared"))).alias("reason"))
    return nm.withheld(held)


@query(
    ctes(LI, PC, PS, "asked AS (SELECT DISTINCT cell AS full_cell, CASE WHEN cell LIKE 'BD%' THEN left(cell, 12) ELSE left(cell, 7) END AS cell FROM lineitem_cells)", "probe AS (SELECT DISTINCT cell FROM asked)", OVER)
    + f""", best AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY u DESC, structure_id) AS rank FROM ov)
    SELECT a.full_cell AS cell, a.cell AS shown_cell, a.full_cell <> a.cell AS demoted, left(a.cell, 2) IN (SELECT left(cell, 2) FROM structure_cells) AS frame_indexed,
      b.rank, b.structure_id, round(b.u / ({U('a.cell')}), 9) AS fraction FROM asked a LEFT JOIN best b USING (cell)"""
)
def names_at_display_precision(spark, sf):
    """Names after cutting each cell to its template's useful digits, with frames the index does not cover."""
    q = T.lineitem_cells(spark, sf).select("cell").distinct()
    digits = F.when(ad.frame_of(F.col("cell")) == "BD", 1).otherwise(2)
    r = nm.names_at_precision(q, digits, index_of(spark, sf), T.part_structures(spark, sf), T.INDEX_VERSION, **published(spark, sf))
    return r.select("cell", "shown_cell", "demoted", "frame_indexed", "rank", "structure_id", F.round("fraction", 9).alias("fraction"))


REV2 = """rev2 AS (SELECT structure_id, CASE WHEN CAST(substr(structure_id, 3) AS INT) % 7 = 0 AND cell LIKE 'BV%' THEN left(cell, 6) ELSE cell END AS cell FROM structure_cells
  WHERE CAST(substr(structure_id, 3) AS INT) % 11 <> 0)"""


@query(
    ctes(LI, PC, PROBE, REV2, normalize_sql("structure_cells_raw", "structure_id", "v1"), normalize_sql("rev2", "structure_id", "v2"))
    + f""", a AS (SELECT p.cell, structure_id, sum(CASE WHEN starts_with(p.cell, s.cell) THEN {U('p.cell')} ELSE {U('s.cell')} END) AS u FROM probe p JOIN v1 s ON starts_with(p.cell, s.cell) OR starts_with(s.cell, p.cell) GROUP BY ALL),
    b AS (SELECT p.cell, structure_id, sum(CASE WHEN starts_with(p.cell, s.cell) THEN {U('p.cell')} ELSE {U('s.cell')} END) AS u FROM probe p JOIN v2 s ON starts_with(p.cell, s.cell) OR starts_with(s.cell, p.cell) GROUP BY ALL)
    SELECT cell, structure_id, CASE WHEN a.u IS NULL THEN 'added' WHEN b.u IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM a FULL JOIN b USING (cell, structure_id) WHERE a.u IS DISTINCT FROM b.u"""
)
def index_revision_diff(spark, sf):
    """Same cells under two index versions: names added, removed or re-weighted."""
    old = index_of(spark, sf)
    n = F.substring("structure_id", 3, 12).cast("int")
    moved = F.when((n % 7 == 0) & (ad.key_lo(F.col("cell_key")) >= ad.fr.BV_START), ad.key_at(ad.key_lo(F.col("cell_key")), F.least(ad.key_rung(F.col("cell_key")), F.lit(1))))
    new = cv.normalize(old.filter(n % 11 != 0).withColumn("cell_key", F.coalesce(moved, F.col("cell_key"))), ["structure_id"])
    d = nm.revision_diff(T.lineitem_cells(spark, sf).select("cell", "cell_key"), old, new)
    return d.select("cell", "structure_id", "change")


@query(
    ctes(PC)
    + """SELECT 'nested_cell' AS rule, a.structure_id AS row_id, a.cell AS message FROM (SELECT DISTINCT * FROM structure_cells_raw) a
      WHERE EXISTS (SELECT 1 FROM structure_cells_raw b WHERE b.structure_id = a.structure_id AND b.cell <> a.cell AND starts_with(a.cell, b.cell))"""
)
def index_audit(spark, sf):
    """Invariants of an index as violating rows; raw coverings break one, the built index none."""
    raw = T.part_structure_cells(spark, sf).select("structure_id", "cell_key").distinct()
    return nm.audit_index(raw).unionByName(nm.audit_index(index_of(spark, sf)))


DOCS_SQL = """nm AS (SELECT CASE WHEN p_partkey % 50 = 3 THEN 'parts-0' ELSE 'parts-1' END AS v, 'S:' || p_partkey AS id FROM part WHERE p_partkey % 40 <> 5
    UNION ALL SELECT 'parts-1', 'S:' || p_partkey FROM part WHERE p_size = 50),
  co AS (SELECT 'parts-1' AS v, 'S:' || p_partkey AS id FROM part WHERE p_partkey % 30 <> 7 UNION ALL SELECT 'parts-1', 'S:' || p_partkey FROM part WHERE p_size = 49)"""


@query(
    "WITH " + DOCS_SQL
    + """ SELECT 'mixed_versions' AS rule, v AS row_id, 'only in ' || min(side) AS message FROM (SELECT DISTINCT v, 'names' AS side FROM nm UNION SELECT DISTINCT v, 'coverings' FROM co) GROUP BY v HAVING count(*) = 1
    UNION ALL SELECT 'no_covering', id, 'name without covering' FROM (SELECT DISTINCT id FROM nm) WHERE id NOT IN (SELECT id FROM co)
    UNION ALL SELECT 'no_name', id, 'covering without name' FROM (SELECT DISTINCT id FROM co) WHERE id NOT IN (SELECT id FROM nm)
    UNION ALL SELECT 'duplicate_name', id, count(*) || ' rows' FROM nm GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 'duplicate_covering', id, count(*) || ' rows' FROM co GROUP BY id HAVING count(*) > 1"""
)
def name_index_join(spark, sf):
    """Names and coverings documents joined by id: mixed versions, orphans and duplicates as rows."""
    p = T.table(spark, sf, "part")
    k, sid = F.col("p_partkey"), F.concat(F.lit("S:"), "p_partkey").alias("structure_id")
    v = F.when(k % 50 == 3, "parts-0").otherwise("parts-1").alias("index_version")
    one = F.lit("parts-1").alias("index_version")
    names = p.filter(k % 40 != 5).select(v, sid).unionByName(p.filter("p_size = 50").select(one, sid))
    covs = p.filter(k % 30 != 7).select(one, sid).unionByName(p.filter("p_size = 49").select(one, sid))
    return nm.join_problems(names, covs)


@query(
    """SELECT 'duplicate_structure' AS rule, 'S:' || (p_partkey - p_partkey % 100) AS row_id, count(*) || ' rows' AS message FROM part WHERE p_partkey % 100 < 2 GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'bad_structure', 'S:' || p_partkey, 'a structure has no name' FROM part WHERE p_partkey % 100 = 9
    UNION ALL SELECT 'bad_structure_covering', 'S:' || p_partkey, 'bad_digit: BV-L-8' FROM part WHERE p_partkey % 100 = 12"""
)
def index_build_problems(spark, sf):
    """Everything that would refuse an index build, one row per reason."""
    p = T.table(spark, sf, "part").select("p_partkey", "p_name")
    k = F.col("p_partkey")
    sid = F.concat(F.lit("S:"), F.when(k % 100 == 1, k - 1).otherwise(k).cast("string"))
    s = p.select(F.lit("parts-1").alias("index_version"), sid.alias("structure_id"), F.when(k % 100 == 9, "").otherwise(F.col("p_name")).alias("structure_name"))
    cells = p.select(F.concat(F.lit("S:"), k).alias("structure_id"), F.when(k % 100 == 12, "BV-L-8").otherwise("BV-L-4").alias("cell"))
    return nm.index_problems(s, cells)


@query(
    ctes(PC, normalize_sql("structure_cells_raw", "structure_id", "v1"), REV2, normalize_sql("rev2", "structure_id", "v2"))
    + """SELECT coalesce(a.structure_id, b.structure_id) AS structure_id, coalesce(a.cell, b.cell) AS cell, CASE WHEN a.cell IS NULL THEN 0 ELSE 1 END AS n_expected, CASE WHEN b.cell IS NULL THEN 0 ELSE 1 END AS n_actual
    FROM v1 a FULL JOIN v2 b ON a.structure_id = b.structure_id AND a.cell = b.cell WHERE a.cell IS NULL OR b.cell IS NULL"""
)
def regenerated_index_drift(spark, sf):
    """Rows by which a regenerated index differs from the stored one."""
    old = index_of(spark, sf)
    n = F.substring("structure_id", 3, 12).cast("int")
    lo, rung = ad.key_lo(F.col("cell_key")), ad.key_rung(F.col("cell_key"))
    moved = F.when((n % 7 == 0) & (lo >= ad.fr.BV_START), ad.key_at(lo, F.least(rung, F.lit(1))))
    new = cv.normalize(old.filter(n % 11 != 0).withColumn("cell_key", F.coalesce(moved, F.col("cell_key"))), ["structure_id"])
    d = ck.drift(old, new)
    return d.select("structure_id", text().alias("cell"), "n_expected", "n_actual")
