"""Address columns, scans and hierarchical joins over the driver tables."""

import uuid

from pyspark.sql import functions as F

from bodygrid import frames as fr
from bodygrid.functions import address as ad
from bodygrid.functions import text as tx
from bodygrid.operators import coverings as cv
from bodygrid.operators import hierjoin as hj
from bodygrid.operators import names as nm
from bodygrid.plans import tables as T
from bodygrid.plans.registry import ctes, query
from bodygrid.session import shared_folder

LI, PC = T.LINEITEM_CELLS_SQL, T.PART_CELLS_SQL
DISTINCT_LI = "probe AS (SELECT DISTINCT cell FROM lineitem_cells)"

CHECK_SQL = (
    "substr('" + fr.CROCKFORD + "', CAST(list_sum(list_transform(range(1, length({c}) + 1), lambda i: "
    "(2 * i - 1) * instr('" + fr.CHECK_ALPHABET + "', substr({c}, i, 1)))) % 32 AS INT) + 1, 1)"
)

# What a keyboard, a form or a scanner does to an address, by row.
NOISE_SQL = f"""noisy AS (
  SELECT l_orderkey, l_linenumber, cell, CASE l_orderkey % 13
    WHEN 0 THEN lower(cell) WHEN 1 THEN '  ' || cell || ' '
    WHEN 2 THEN cell || '~' || {CHECK_SQL.format(c='cell')}
    WHEN 3 THEN cell || '~' || CASE WHEN {CHECK_SQL.format(c='cell')} = '0' THEN '1' ELSE '0' END
    WHEN 4 THEN cell || '9' WHEN 5 THEN replace(cell, '-', '--') WHEN 6 THEN replace(cell, '-', '_')
    WHEN 7 THEN 'X' || cell WHEN 8 THEN cell || '01234567012345' WHEN 9 THEN substr(cell, 1, 2)
    WHEN 10 THEN cell || '-1' WHEN 11 THEN replace(cell, '-0', '-') ELSE cell || '~UU' END AS raw
  FROM lineitem_cells)"""


def noisy_cells(spark, sf):
    c, k = F.col("cell"), F.col("l_orderkey") % 13
    sym = ad.check_symbol(c)
    noise = [
        F.lower(c),
        F.concat(F.lit("  "), c, F.lit(" ")),
        F.concat(c, F.lit("~"), sym),
        F.concat(c, F.lit("~"), F.when(sym == "0", "1").otherwise("0")),
        F.concat(c, F.lit("9")),
        F.replace(c, F.lit("-"), F.lit("--")),
        F.replace(c, F.lit("-"), F.lit("_")),
        F.concat(F.lit("X"), c),
        F.concat(c, F.lit("01234567012345")),
        F.substring(c, 1, 2),
        F.concat(c, F.lit("-1")),
        F.replace(c, F.lit("-0"), F.lit("-")),
    ]
    raw = F.when(k == 0, noise[0])
    for i, e in enumerate(noise[1:], 1):
        raw = raw.when(k == i, e)
    return T.lineitem_cells(spark, sf).withColumn("raw", raw.otherwise(F.concat(c, F.lit("~UU"))))


# Independent statement of the grammar: one full-match pattern per frame.
PARSE_SQL = ctes(LI, NOISE_SQL) + """, up AS (SELECT *, upper(trim(raw)) AS t FROM noisy),
body AS (SELECT *, split_part(t, '~', 1) AS b, CASE WHEN contains(t, '~') THEN substr(t, instr(t, '~') + 1) END AS chk FROM up),
lev AS (SELECT *, regexp_extract(b, '^BD-([CTLS])([0-9]{1,2})', ['a','n']) AS m, regexp_extract(b, '^BD-[^-]*-([0-9]{1,2})([IO])', ['k','d']) AS z FROM body),
can AS (SELECT *, CASE WHEN b LIKE 'BD-%' THEN
    regexp_replace(regexp_replace(b, '^BD-[CTLS][0-9]{1,2}', 'BD-' || m.a || lpad(m.n, 2, '0')), '^(BD-[A-Z0-9]+)-[0-9]{1,2}[IO]', '\\1-' || lpad(z.k, 2, '0') || z.d)
    ELSE b END AS canon FROM lev),
coded AS (SELECT *, CASE
  WHEN chk IS NOT NULL AND NOT regexp_full_match(chk, '[0-9A-HJKMNP-TV-Z]') THEN 'bad_check'
  WHEN regexp_matches(b, '(^|-)(-|$)') THEN 'empty_segment'
  WHEN NOT regexp_full_match(b, '[0-9A-Z-]+') THEN 'bad_segment'
  WHEN split_part(b, '-', 1) NOT IN ('BD','BV','BR') THEN 'unknown_frame'
  WHEN NOT contains(b, '-') THEN 'missing_anchor'
  WHEN length(b) - length(replace(b, '-', '')) > CASE WHEN b LIKE 'BD%' THEN 3 ELSE 2 END THEN 'too_many_segments'
  WHEN (b LIKE 'BD%' AND regexp_matches(b, '^BD-[^-]*-[^-]*-[^-]{13}')) OR (b LIKE 'BV%' AND regexp_matches(b, '^BV-[^-]*-[^-]{13}'))
    OR (b LIKE 'BR%' AND regexp_matches(b, '^BR-[^-]*-[^-]{8}')) THEN 'bad_precision'
  WHEN NOT regexp_full_match(b, 'BD-[^-]*(-[^-]*(-[0-7]*)?)?|BV-[^-]*(-[0-7]*)?|BR-[^-]*(-[0-9A-F]*)?') THEN 'bad_digit'
  WHEN b LIKE 'BD%' AND NOT list_contains(""" + T.LEVELS_SQL + """, substr(canon, 4, 3)) THEN 'bad_level'
  WHEN b LIKE 'BD%' AND NOT regexp_full_match(canon, 'BD-...(-(0[1-9]|1[0-2])[IO](-.*)?)?') THEN 'bad_azimuth'
  WHEN chk IS NOT NULL AND chk <> """ + CHECK_SQL.format(c="canon") + """ THEN 'check_failed' END AS error_code FROM can)
SELECT l_orderkey, l_linenumber, raw, CASE WHEN error_code IS NULL THEN canon END AS cell, error_code FROM coded"""


@query(PARSE_SQL)
def canonical_cells(spark, sf):
    """A raw address column to canonical cells, rejects with the first broken rule."""
    return ad.canonicalize(noisy_cells(spark, sf), "raw").select("l_orderkey", "l_linenumber", "raw", "cell", "error_code")


@query(
    "SELECT doc_id, CASE WHEN regexp_matches(text, '[^\\x20-\\x7e]') THEN 'non_ascii' WHEN trim(text, ' ') = '' THEN 'empty' "
    "WHEN length(trim(text, ' ')) > 64 THEN 'too_long' ELSE 'other' END AS error_class FROM documents"
)
def prose_is_rejected(spark, sf):
    """Whole document texts through the parser: nothing in prose may pass as an address."""
    d = ad.canonicalize(T.table(spark, sf, "documents").select("doc_id", "text"), "text")
    known = F.col("error_code").isin("non_ascii", "empty", "too_long")
    return d.select("doc_id", F.when(known, F.col("error_code")).otherwise("other").alias("error_class"))


@query(ctes(LI, DISTINCT_LI) + f"SELECT cell, cell || '~' || {CHECK_SQL.format(c='cell')} AS with_check FROM probe")
def check_symbols(spark, sf):
    c = T.lineitem_cells(spark, sf).select("cell").distinct()
    return c.withColumn("with_check", F.concat("cell", F.lit("~"), ad.check_symbol(F.col("cell"))))


@query(
    ctes(LI, DISTINCT_LI)
    + """SELECT cell, left(cell, 2) AS frame, CASE WHEN cell LIKE 'BD%' THEN split_part(cell,'-',2) || '/' || split_part(cell,'-',3) ELSE split_part(cell,'-',2) END AS anchors,
  split_part(cell, '-', CASE WHEN cell LIKE 'BD%' THEN 4 ELSE 3 END) AS digits,
  CASE WHEN cell LIKE 'BD%' THEN 1 + length(split_part(cell,'-',4)) WHEN cell LIKE 'BV%' THEN length(split_part(cell,'-',3)) ELSE 2 * length(split_part(cell,'-',3)) - 2 END AS level,
  cell LIKE 'BR%' AS experimental FROM probe"""
)
def address_parts(spark, sf):
    c = T.lineitem_cells(spark, sf).select("cell").distinct()
    out = c.select("cell", *[e.alias(n) for n, e in ad.describe_columns(F.col("cell")).items()])
    return out.withColumn("anchors", F.array_join("anchors", "/"))


@query(
    ctes(LI, DISTINCT_LI)
    + """SELECT cell, CASE WHEN cell LIKE 'BR%' AND length(cell) = 6 THEN NULL WHEN regexp_matches(cell, '-.$|-[^-]{1}$') AND NOT cell LIKE 'BR%'
    THEN regexp_replace(cell, '-[^-]*$', '') ELSE left(cell, length(cell) - 1) END AS parent,
  CASE WHEN cell LIKE 'BD%' THEN left(cell, 13) ELSE left(cell, 7) END AS demoted FROM probe"""
)
def parents_and_demotion(spark, sf):
    c = T.lineitem_cells(spark, sf).select("cell").distinct()
    return c.select("cell", ad.parent_of(F.col("cell")).alias("parent"), ad.demote(F.col("cell"), 2).alias("demoted"))


ANCESTORS_SQL = """anc AS (
  SELECT cell, unnest(CASE WHEN cell LIKE 'BD%' THEN list_concat([left(cell, 6), left(cell, 10)], list_transform(range(12, length(cell) + 1), lambda k: left(cell, k)))
    WHEN cell LIKE 'BV%' THEN list_concat([left(cell, 4)], list_transform(range(6, length(cell) + 1), lambda k: left(cell, k)))
    ELSE list_transform(range(6, length(cell) + 1), lambda k: left(cell, k)) END) AS ancestor FROM probe)"""


@query(ctes(LI, DISTINCT_LI, ANCESTORS_SQL) + "SELECT DISTINCT cell, ancestor FROM anc")
def containing_cells(spark, sf):
    """Every cell with each containing address, itself included."""
    c = T.lineitem_cells(spark, sf).select("cell_key").distinct()
    e = c.select("cell_key", F.explode_outer(ad.ancestor_keys(F.col("cell_key"), True)).alias("a"))
    return e.select(ad.cell_text(F.col("cell_key")).alias("cell"), ad.cell_text(F.col("a")).alias("ancestor"))


@query(
    ctes(PC)
    + """SELECT DISTINCT cell, cell || s.x AS child FROM structure_cells_raw, LATERAL (SELECT unnest(CASE
    WHEN length(cell) = 6 AND cell LIKE 'BD%' THEN list_transform(range(0, 24), lambda i: '-' || lpad(CAST(i // 2 + 1 AS VARCHAR), 2, '0') || CASE WHEN i % 2 = 0 THEN 'I' ELSE 'O' END)
    WHEN length(cell) = 10 AND cell LIKE 'BD%' THEN list_transform(range(0, 8), lambda i: '-' || i)
    ELSE list_transform(range(0, 8), lambda i: CAST(i AS VARCHAR)) END) AS x) s"""
)
def child_cells(spark, sf):
    c = T.part_structure_cells(spark, sf).select("cell").distinct()
    return c.select("cell", F.explode(ad.children_of(F.col("cell"))).alias("child"))


@query(
    ctes(LI)
    + """SELECT CASE WHEN cell LIKE 'BV%' THEN left(cell, 4) ELSE left(cell, 6) END AS frame_root, count(*) AS n_rows, count(DISTINCT cell) AS n_cells
    FROM lineitem_cells GROUP BY 1"""
)
def frame_roots(spark, sf):
    c = T.lineitem_cells(spark, sf)
    per_cell = c.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))  # distinct count without a second shuffle of all rows
    return per_cell.groupBy(ad.frame_root_of(F.col("cell")).alias("frame_root")).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_cells")
    )


@query(
    ctes(LI, PC, DISTINCT_LI, "sc AS (SELECT DISTINCT cell FROM structure_cells_raw)")
    + "SELECT sc.cell AS outer_cell, probe.cell AS inner_cell, round("
    + f"({T.units('probe.cell')}) / ({T.units('sc.cell')}), 12) AS relative_measure "
    + "FROM sc, probe WHERE starts_with(probe.cell, sc.cell)"
)
def relative_measures(spark, sf):
    """Share of each structure cell that each contained row cell takes up."""
    probe = T.lineitem_cells(spark, sf).select("cell_key").distinct()
    outer = T.part_structure_cells(spark, sf).select(F.col("cell_key").alias("outer_key")).distinct()
    p = hj.ancestor_join(probe, outer, "cell_key", "outer_key")
    return p.select(
        ad.cell_text(F.col("outer_key")).alias("outer_cell"),
        ad.cell_text(F.col("cell_key")).alias("inner_cell"),
        F.round(ad.relative_measure(F.col("outer_key"), F.col("cell_key")), 12).alias("relative_measure"),
    )


WORDS_SQL = "['one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve']"
SPELL = "['zero','one','two','three','four','five','six','seven','eight','nine','alpha','bravo','charlie','delta','echo','foxtrot']"
READABLE_SQL = f"""said AS (SELECT cell, split_part(cell, '-', CASE WHEN cell LIKE 'BD%' THEN 4 ELSE 3 END) AS dg,
  CASE WHEN cell LIKE 'BD%' THEN 'body, ' || substr(cell,4,1) || CAST(CAST(substr(cell,5,2) AS INT) AS VARCHAR) || ' level, '
    || {WORDS_SQL}[CAST(substr(cell,8,2) AS INT)] || ' o''clock, ' || CASE WHEN substr(cell,10,1)='I' THEN 'inner' ELSE 'outer' END
  ELSE CASE WHEN cell LIKE 'BV%' THEN 'brain, ' ELSE '' END || CASE WHEN substr(cell,4,1)='L' THEN 'left' ELSE 'right' END
    || CASE WHEN cell LIKE 'BV%' THEN ' hemisphere' ELSE ' cortical surface' END END || ', cell ' AS head FROM probe),
spoken AS (SELECT cell, head || dg AS readable, head || array_to_string(list_transform(string_split(dg, ''),
  lambda c: {SPELL}[instr('0123456789ABCDEF', c)]), ' ') AS spoken FROM said)"""


@query(ctes(LI, DISTINCT_LI, READABLE_SQL) + "SELECT * FROM spoken")
def readable_and_spoken(spark, sf):
    c = T.lineitem_cells(spark, sf).select("cell").distinct()
    return c.select("cell", tx.to_readable(F.col("cell")).alias("readable"), tx.to_spoken(F.col("cell")).alias("spoken"))


@query(
    ctes(LI, DISTINCT_LI, READABLE_SQL)
    + """SELECT CASE length(cell) % 4 WHEN 0 THEN upper(spoken) WHEN 1 THEN replace(readable, ', ', '; ') WHEN 2 THEN replace(spoken, 'zero', 'oh')
      ELSE replace(readable, 'cell ', 'cell number ') END AS said, cell, NULL AS error_code FROM spoken"""
)
def dictated_addresses(spark, sf):
    """Dictated forms of every row's cell read back into the same cell."""
    c = T.lineitem_cells(spark, sf).select("cell").distinct()
    n = F.length("cell") % 4
    r, s = tx.to_readable(F.col("cell")), tx.to_spoken(F.col("cell"))
    said = (
        F.when(n == 0, F.upper(s))
        .when(n == 1, F.replace(r, F.lit(", "), F.lit("; ")))
        .when(n == 2, F.replace(s, F.lit("zero"), F.lit("oh")))
        .otherwise(F.replace(r, F.lit("cell "), F.lit("cell number ")))
    )
    return tx.from_readable(c.select(said.alias("said")), "said").select("said", "cell", "error_code")


@query(
    r"""WITH p AS (SELECT conv_id, turn, text, list_filter(list_transform(string_split(translate(lower(text), '.;', ',,'), ','),
      lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM conversations)
    SELECT conv_id, turn, CASE WHEN length(text) > 512 THEN 'too_long' WHEN len(parts) = 0 THEN 'empty' WHEN len(parts) > 8 THEN 'too_many_segments'
      WHEN parts[1] IN ('body', 'brain', 'brain volume') THEN 'other' ELSE 'unknown_frame' END AS error_code FROM p"""
)
def conversation_is_not_dictation(spark, sf):
    d = tx.from_readable(T.table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text")
    return d.select("conv_id", "turn", "error_code")


@query(
    ctes(LI, DISTINCT_LI, READABLE_SQL)
    + """, d AS (SELECT cell, CASE WHEN cell LIKE 'BD%' THEN 'body' WHEN cell LIKE 'BV%' THEN 'brain volume' ELSE 'cortical surface' END AS l0,
      CASE WHEN cell LIKE 'BD%' THEN split_part(head, ', ', 2) WHEN cell LIKE 'BV%' THEN split_part(head, ', ', 2) ELSE split_part(head, ', ', 1) END AS l1,
      split_part(head, ', ', 3) || ', ' || split_part(head, ', ', 4) AS l2, dg FROM said)
    SELECT cell, 0 AS pos, left(cell, 2) AS segment, 'frame' AS kind, l0 AS label FROM d
    UNION ALL SELECT cell, 1, split_part(cell, '-', 2), CASE WHEN cell LIKE 'BD%' THEN 'level' ELSE 'hemisphere' END, l1 FROM d
    UNION ALL SELECT cell, 2, split_part(cell, '-', 3), 'azimuth', l2 FROM d WHERE cell LIKE 'BD%'
    UNION ALL SELECT cell, CASE WHEN cell LIKE 'BD%' THEN 3 ELSE 2 END, dg, 'refinement', 'cell ' || dg FROM d"""
)
def address_descriptions(spark, sf):
    return tx.describe(T.lineitem_cells(spark, sf).select("cell").distinct())


@query(
    ctes(LI, PC)
    + """SELECT left(cell, 2) AS frame, count(*) AS n_rows, left(cell, 2) IN (SELECT left(cell, 2) FROM structure_cells) AS indexed
    FROM lineitem_cells GROUP BY 1"""
)
def frames_indexed(spark, sf):
    """Row counts per frame, telling a frame without an index from a cell without a match."""
    rows = T.lineitem_cells(spark, sf).groupBy(ad.frame_of(F.col("cell")).alias("frame")).agg(F.count(F.lit(1)).alias("n_rows"))
    idx = nm.indexed_frames(T.part_structure_cells(spark, sf)).withColumn("indexed", F.lit(True))
    return rows.join(idx, "frame", "left").withColumn("indexed", F.coalesce("indexed", F.lit(False)))


# ---- scans -------------------------------------------------------------------

_SORTED = {}


def sorted_cells(spark, sf):
    """The cells of lineitem as a stored table in the order of cells, written once a session and then only scanned."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SORTED:
        path = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
        nm.write_cells(T.lineitem_cells(spark, sf).select("l_orderkey", "l_linenumber", "cell"), path)
        _SORTED[key] = path
    return spark.read.parquet(_SORTED[key])


@query(ctes(LI) + "SELECT l_orderkey, l_linenumber, cell FROM lineitem_cells WHERE starts_with(cell, 'BV-L-4')")
def descendant_scan(spark, sf):
    return hj.descendant_scan(sorted_cells(spark, sf), "BV-L-4").select("l_orderkey", "l_linenumber", "cell")


@query(ctes(LI) + "SELECT l_orderkey, l_linenumber, cell FROM lineitem_cells WHERE starts_with('BV-L-4732', cell) AND cell <> 'BV-L-4732'")
def ancestor_scan(spark, sf):
    return hj.ancestor_scan(sorted_cells(spark, sf), "BV-L-4732").select("l_orderkey", "l_linenumber", "cell")


@query(
    ctes(LI)
    + "SELECT l_orderkey, l_linenumber, cell FROM lineitem_cells WHERE starts_with('BD-T07-04I-5', cell) OR starts_with(cell, 'BD-T07-04I-5')"
)
def overlap_scan(spark, sf):
    return hj.overlap_scan(sorted_cells(spark, sf), "BD-T07-04I-5").select("l_orderkey", "l_linenumber", "cell")


NATION_COVERING_SQL = """nation_cells AS (SELECT n_nationkey, 'BV-' || CASE WHEN n_nationkey % 2 = 0 THEN 'L' ELSE 'R' END || '-'
  || to_base(n_nationkey, 8) || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE '0' END AS cell FROM nation)"""


def nation_cells(spark, sf):
    n = T.table(spark, sf, "nation")
    cell = F.concat(
        F.when(F.col("n_nationkey") % 2 == 0, "BV-L-").otherwise("BV-R-"),
        F.conv(F.col("n_nationkey").cast("string"), 10, 8),
        F.when(F.col("n_nationkey") % 3 == 0, "").otherwise("0"),
    )
    return ad.with_key(n.select("n_nationkey", "n_regionkey", cell.alias("cell")))


@query(
    ctes(LI, NATION_COVERING_SQL)
    + """SELECT l_orderkey, l_linenumber, cell FROM lineitem_cells l WHERE EXISTS (SELECT 1 FROM nation_cells n
      WHERE starts_with(l.cell, n.cell) OR starts_with(n.cell, l.cell))"""
)
def covering_scan(spark, sf):
    rows = hj.covering_scan(T.lineitem_cells(spark, sf), nation_cells(spark, sf))
    return rows.select("l_orderkey", "l_linenumber", "cell")


@query(
    ctes(LI, NATION_COVERING_SQL)
    + """SELECT DISTINCT l.cell FROM lineitem_cells l, nation_cells n WHERE starts_with(l.cell, n.cell) OR starts_with(n.cell, l.cell)"""
)
def sorted_distinct_scan(spark, sf):
    """A plan run over a stored cell table: ascending, each cell once."""
    cells = T.lineitem_cells(spark, sf).select("cell", "cell_key").distinct()
    return hj.covering_scan(cells, nation_cells(spark, sf)).select("cell").orderBy("cell")


@query(ctes(LI, NATION_COVERING_SQL) + "SELECT count(*) AS n_rows FROM lineitem_cells WHERE 1 = 0")
def empty_plan_selects_nothing(spark, sf):
    none = nation_cells(spark, sf).filter("n_nationkey < 0")
    return hj.covering_scan(T.lineitem_cells(spark, sf), none).agg(F.count(F.lit(1)).alias("n_rows"))


# ---- joins -------------------------------------------------------------------


@query(
    ctes(LI, PC, DISTINCT_LI, "sc AS (SELECT DISTINCT cell FROM structure_cells_raw)")
    + """SELECT probe.cell AS left_cell, sc.cell AS right_cell, CASE WHEN length(probe.cell) >= length(sc.cell) THEN probe.cell ELSE sc.cell END AS finer
    FROM probe, sc WHERE starts_with(probe.cell, sc.cell) OR starts_with(sc.cell, probe.cell)"""
)
def overlapping_cell_pairs(spark, sf):
    """Hierarchical overlap join of row cells and structure cells, either direction."""
    left = T.lineitem_cells(spark, sf).select(F.col("cell_key").alias("l")).distinct()
    right = T.part_structure_cells(spark, sf).select(F.col("cell_key").alias("r")).distinct()
    p = hj.overlap_join(left, right, "l", "r")
    return p.select(
        ad.cell_text(F.col("l")).alias("left_cell"),
        ad.cell_text(F.col("r")).alias("right_cell"),
        ad.cell_text(F.col("finer_key")).alias("finer"),
    )


@query(
    ctes(LI, PC)
    + """SELECT l_orderkey, l_linenumber, cell FROM lineitem_cells l WHERE EXISTS
      (SELECT 1 FROM structure_cells_raw s WHERE starts_with(l.cell, s.cell))"""
)
def rows_inside_structures(spark, sf):
    """Containment semi join; the test runs once per distinct cell, not per row."""
    li = T.lineitem_cells(spark, sf)
    inside = hj.contained_semi(
        li.select("cell_key").distinct(), T.part_structure_cells(spark, sf).withColumnRenamed("cell_key", "s"), "cell_key", "s"
    ).distinct()
    return li.join(inside, "cell_key", "left_semi").select("l_orderkey", "l_linenumber", "cell")


@query(
    ctes(LI, PC)
    + """SELECT l_orderkey, l_linenumber, cell FROM lineitem_cells l WHERE NOT EXISTS
      (SELECT 1 FROM structure_cells_raw s WHERE starts_with(l.cell, s.cell) OR starts_with(s.cell, l.cell))"""
)
def rows_nothing_overlaps(spark, sf):
    li = T.lineitem_cells(spark, sf)
    s = T.part_structure_cells(spark, sf).select(F.col("cell_key").alias("s"))
    return hj.overlap_anti(li, s, "cell_key", "s").select("l_orderkey", "l_linenumber", "cell")


# Papers to compare: suppliers, each asked against the next one.
PAIR_SQL = """sup AS (SELECT DISTINCT l_suppkey AS s, cell FROM lineitem_cells),
pairs AS (SELECT s_suppkey AS a, (s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS b FROM supplier)"""


def supplier_pairs(spark, sf):
    sup = T.table(spark, sf, "supplier").select("s_suppkey")
    n = sup.select(F.count(F.lit(1))).scalar()
    return sup.select(F.col("s_suppkey").alias("a"), ((F.col("s_suppkey") * 7 + 3) % n).alias("b"))


@query(
    ctes(LI, PAIR_SQL)
    + """SELECT p.a, p.b, x.cell AS cell_a, y.cell AS cell_b FROM pairs p JOIN sup x ON x.s = p.a JOIN sup y ON y.s = p.b
    WHERE starts_with(x.cell, y.cell) OR starts_with(y.cell, x.cell)"""
)
def shared_cells_of_pairs(spark, sf):
    """Overlapping cells of the asked pairs only, at unequal precision, keeping both cells."""
    cells = T.lineitem_cells(spark, sf).select(F.col("l_suppkey").alias("s"), "cell_key").distinct()
    pairs = supplier_pairs(spark, sf)
    left = pairs.join(cells.withColumnRenamed("s", "a"), "a").select("a", "b", F.col("cell_key").alias("ka"))
    right = pairs.join(cells.withColumnRenamed("s", "b"), "b").select("a", "b", F.col("cell_key").alias("kb"))
    p = hj.overlap_join(left, right, "ka", "kb", by=["a", "b"])
    return p.select("a", "b", ad.cell_text(F.col("ka")).alias("cell_a"), ad.cell_text(F.col("kb")).alias("cell_b"))
