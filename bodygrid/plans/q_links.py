"""Entity linking: parts as structures of several representations, mappings as terms."""

import re

from pyspark.sql import functions as F

from bodygrid.functions import points as pt
from bodygrid.operators import crosswalk as xw
from bodygrid.plans import q_corpus as qp
from bodygrid.plans import tables as T
from bodygrid.plans.q_names import stored
from bodygrid.plans.registry import ctes, query
from bodygrid.session import cut_lineage


def representations(spark, sf):
    r = T.table(spark, sf, "region").select("r_regionkey")
    k = F.col("r_regionkey")
    return r.select(
        F.concat(F.lit("rep-"), k).alias("representation"),
        F.lit("v1").alias("version"),
        k.alias("pos"),
        F.when(k == 0, "S").alias("id_scheme"),
        F.when(k == 3, "none").otherwise("named-structures").alias("labels"),
        F.when(k == 3, F.array(F.lit("MNI152"))).alias("hosts_spaces"),
        F.when(k == 2, 8.55).alias("precision_mm"),
        (k != 4).alias("supplied"),
    )


def all_structures(spark, sf):
    p = T.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    k = F.col("p_partkey")
    return p.select(
        F.concat(F.lit("rep-"), k % 3).alias("representation"),
        F.when(k % 3 == 0, F.concat(F.lit("S:"), k)).otherwise(k.cast("string")).alias("structure_id"),
        F.concat("p_name", F.lit(" "), k).alias("name"),
        F.concat(F.lit("label "), F.floor(k / 6)).alias("label"),
        F.when(k % 2 == 0, "left").otherwise("right").alias("side"),
        F.concat("p_brand", F.lit(" not cleared")).alias("because"),
        (F.col("p_size") > 40).alias("is_held"),
    )


def structures(spark, sf):
    return all_structures(spark, sf).filter("not is_held").drop("because", "is_held")


def held(spark, sf):
    return all_structures(spark, sf).filter("is_held").select("representation", "name", "label", "side", "because")


def entries(spark, sf):
    k = F.col("p_partkey")
    p = T.table(spark, sf, "part").select("p_partkey").filter(k % 7 != 3)
    return p.select(
        F.concat(F.when(k % 3 == 0, "U:").otherwise("S:"), k).alias("term"),
        F.when(k % 47 == 1, "").otherwise(F.concat(F.lit("term "), k)).alias("label"),
        F.when(k % 43 == 2, "guess").when(k % 2 == 0, "exact-term").otherwise("crosswalk").alias("how"),
        F.when(k % 5 == 0, "none").when(k % 5 == 1, "same").when(k % 5 == 2, "parts").when(k % 5 == 3, "overlaps").otherwise("same").alias("completeness"),
        F.when(k % 37 != 4, F.concat(F.lit("because "), k % 9)).alias("why"),
        k.alias("pos"),
    )


def targets(spark, sf):
    k = F.col("p_partkey")
    p = T.table(spark, sf, "part").select("p_partkey").filter((k % 7 != 3) & ((k % 5 != 0) | (k % 41 == 5)))
    t = lambda i, rep, label: F.struct(F.lit(i).alias("pos"), F.concat(F.lit("rep-"), rep).alias("representation"), F.concat(F.lit("label "), label).alias("label"))
    return p.select(
        F.concat(F.when(k % 3 == 0, "U:").otherwise("S:"), k).alias("term"),
        F.inline(F.array(t(0, k % 3, F.floor(k / 6)), t(1, F.when(k % 13 == 0, 9).when(k % 4 == 0, 4).otherwise(1), F.when(k % 53 == 6, k + 100000).otherwise(F.floor(k / 12))))),
    )


LINK_SQL = """reps AS (SELECT 'rep-' || r_regionkey AS representation, CASE WHEN r_regionkey = 0 THEN 'S' END AS id_scheme, r_regionkey <> 4 AS supplied, CASE WHEN r_regionkey = 3 THEN 'none' ELSE 'named-structures' END AS labels FROM region),
alls AS (SELECT 'rep-' || p_partkey % 3 AS representation, CASE WHEN p_partkey % 3 = 0 THEN 'S:' ELSE '' END || p_partkey AS structure_id, p_name || ' ' || p_partkey AS name, 'label ' || p_partkey // 6 AS label, CASE WHEN p_partkey % 2 = 0 THEN 'left' ELSE 'right' END AS side, p_brand || ' not cleared' AS because, p_size > 40 AS is_held FROM part),
st AS (SELECT * FROM alls WHERE NOT is_held), hd AS (SELECT * FROM alls WHERE is_held),
en AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'U:' ELSE 'S:' END || p_partkey AS term, CASE WHEN p_partkey % 43 = 2 THEN 'guess' WHEN p_partkey % 2 = 0 THEN 'exact-term' ELSE 'crosswalk' END AS how,
  ['none','same','parts','overlaps','same'][CAST(p_partkey % 5 + 1 AS INT)] AS completeness, CASE WHEN p_partkey % 37 <> 4 THEN 'because ' || p_partkey % 9 END AS why FROM part WHERE p_partkey % 7 <> 3),
tg AS (SELECT term, k, 'rep-' || k % 3 AS representation, 'label ' || k // 6 AS label FROM en WHERE k % 5 <> 0 OR k % 41 = 5
  UNION ALL SELECT term, k, 'rep-' || CASE WHEN k % 13 = 0 THEN 9 WHEN k % 4 = 0 THEN 4 ELSE 1 END, 'label ' || CASE WHEN k % 53 = 6 THEN k + 100000 ELSE k // 12 END FROM en WHERE k % 5 <> 0 OR k % 41 = 5)"""
TERMS = """, mm AS (SELECT m.mapping_id, m.finding_id, f.paper_id, m.structure_id AS term, m.pk, m.kind, m.frame, m.sk, m.cell, m.ok FROM mappings m JOIN findings f USING (finding_id)),
term AS (SELECT DISTINCT term FROM mm),
idn AS (SELECT t.term, s.* FROM term t JOIN st s ON s.representation = 'rep-0' AND s.structure_id = t.term),
rst AS (SELECT t.term, e.how, e.completeness, e.why FROM term t LEFT JOIN en e USING (term) WHERE t.term NOT IN (SELECT term FROM idn)),
shp AS (SELECT r.term, s.representation, s.structure_id, s.name, s.side, r.how, r.completeness, r.why FROM rst r JOIN tg USING (term) JOIN st s ON s.representation = tg.representation AND s.label = tg.label WHERE r.completeness <> 'none'),
hh AS (SELECT r.term, string_agg(DISTINCT h.label, '; ' ORDER BY h.label) AS held_targets, string_agg(DISTINCT h.because, ' | ' ORDER BY h.because) AS because FROM rst r JOIN tg USING (term) JOIN hd h ON h.representation = tg.representation AND h.label = tg.label WHERE r.completeness <> 'none' GROUP BY r.term),
ab AS (SELECT r.term, string_agg(DISTINCT tg.representation, ', ' ORDER BY tg.representation) AS absent FROM rst r JOIN tg USING (term) WHERE r.completeness <> 'none' AND tg.representation NOT IN (SELECT representation FROM reps WHERE supplied) GROUP BY r.term),
tl AS (SELECT term, representation, structure_id, name, side, 'exact-term' AS how, 'exact' AS "precision", NULL AS why, NULL AS completeness, NULL AS held_targets FROM idn
  UNION ALL SELECT term, representation, structure_id, name, side, how, CASE WHEN how = 'exact-term' THEN 'exact' ELSE 'approximate' END, CASE WHEN how <> 'exact-term' THEN coalesce(why, '') END, completeness, coalesce(held_targets, '') FROM shp LEFT JOIN hh USING (term)),
tr AS (SELECT term, 'not-in-representation' AS code, term || ' is not in rep-0 v1' AS detail FROM rst WHERE completeness IS NULL
  UNION ALL SELECT term, 'not-in-representation', coalesce(why, '') FROM rst WHERE completeness = 'none'
  UNION ALL SELECT term, CASE WHEN held_targets IS NOT NULL THEN 'structure-held' ELSE 'representation-absent' END, CASE WHEN held_targets IS NOT NULL THEN held_targets || ': ' || because ELSE absent END
    FROM (SELECT DISTINCT term FROM rst JOIN tg USING (term) WHERE completeness <> 'none') LEFT JOIN hh USING (term) LEFT JOIN ab USING (term) WHERE term NOT IN (SELECT term FROM shp) AND (held_targets IS NOT NULL OR absent IS NOT NULL))"""
def _materialised(sql: str, *names: str) -> str:
    """The statement with each named part evaluated once; DuckDB otherwise inlines them wherever they are used."""
    for n in names:
        sql = re.sub(rf"(?<!\w){n} AS \(", f"{n} AS MATERIALIZED (", sql, count=1)
    return sql


BASE = ctes(T.LINEITEM_CELLS_SQL, qp.FINDINGS_SQL, qp.MAPPINGS_SQL, LINK_SQL).rstrip() + TERMS
BASE = _materialised(BASE, "findings", "mappings", "mm", "term", "idn", "rst", "shp", "tl", "tr")


@query(
    ctes(T.LINEITEM_CELLS_SQL, qp.FINDINGS_SQL, qp.MAPPINGS_SQL, LINK_SQL)
    + """SELECT rule, row_id, '' AS message FROM (SELECT term AS row_id, unnest(list_filter([CASE WHEN k % 47 = 1 THEN 'no_label' END, CASE WHEN how = 'guess' THEN 'bad_how' END, CASE WHEN how = 'exact-term' AND completeness = 'overlaps' THEN 'exact_but_overlaps' END,
      CASE WHEN k % 41 = 5 AND k % 5 = 0 THEN 'none_and_targets_disagree' END, CASE WHEN (how = 'crosswalk' OR completeness = 'none') AND why IS NULL THEN 'no_reason' END], lambda x: x IS NOT NULL)) AS rule FROM en)
    UNION ALL SELECT 'unknown_representation', term, representation FROM tg WHERE representation = 'rep-9'
    UNION ALL SELECT 'target_does_not_exist', term, representation || '/' || label FROM tg WHERE representation IN (SELECT representation FROM reps WHERE supplied) AND (representation, label) NOT IN (SELECT representation, label FROM alls)"""
)
def crosswalk_validation(spark, sf):
    return xw.validate_crosswalk(entries(spark, sf), targets(spark, sf), representations(spark, sf), structures(spark, sf), held(spark, sf), qp.owned_mappings(spark, sf))


@stored("term_links")
def term_links(spark, sf):
    m = qp.owned_mappings(spark, sf)
    terms = m.select(F.col("structure_source").alias("scheme"), F.col("structure_id").alias("term")).distinct()
    tl, tr = xw.route_terms(terms, representations(spark, sf), structures(spark, sf), held(spark, sf), entries(spark, sf), targets(spark, sf))
    # One stored table for both outcomes: the routes are shared work.
    return xw.link_terms(m, tl, tr)


def links(spark, sf):
    return term_links(spark, sf).filter("is_link")


def reasons(spark, sf):
    return term_links(spark, sf).filter("not is_link").select("mapping_id", "finding_id", "paper_id", "route", "code", "detail")


@query(BASE + ' SELECT mapping_id, paper_id, representation, structure_id, name, side, how, "precision", why, completeness, held_targets FROM mm JOIN tl USING (term)')
def term_route_links(spark, sf):
    """Identity first, then crosswalk; every mapping of a term shares the term's route."""
    return links(spark, sf).select("mapping_id", "paper_id", "representation", "structure_id", "name", "side", "how", "precision", "why", "completeness", "held_targets")


@query(BASE + " SELECT mapping_id, paper_id, code, detail FROM mm JOIN tr USING (term)")
def term_route_reasons(spark, sf):
    return reasons(spark, sf).select("mapping_id", "paper_id", "code", "detail")


@query(
    BASE
    + """, ce AS (SELECT mapping_id, unnest([cell, CASE WHEN ok % 59 = 3 THEN 'BV-L-9' ELSE cell || '0' END]) AS address FROM mm WHERE kind = 'cells')
    SELECT mapping_id, NULL AS address, 0.0 AS extra_mm, NULL AS code FROM mm WHERE kind = 'coordinates' AND sk % 5 <> 0 UNION ALL SELECT mapping_id, NULL, NULL, 'space-not-registered' FROM mm WHERE kind = 'coordinates' AND sk % 5 = 0
    UNION ALL SELECT mapping_id, address, round(sqrt(power(72.5 / power(2, length(address) - 5), 2) + power(CASE WHEN CAST(substr(address, 6, 1) AS INT) // 2 % 2 = 1 THEN 147 ELSE 217 END / power(2, length(address) - 5), 2) + power(CASE WHEN CAST(substr(address, 6, 1) AS INT) % 2 = 1 THEN 165 ELSE 145 END / power(2, length(address) - 5), 2)) / 2, 6), NULL FROM ce WHERE address LIKE 'BV%' AND address <> 'BV-L-9'
    UNION ALL SELECT mapping_id, address, NULL, 'frame-has-no-mesh' FROM ce WHERE address NOT LIKE 'BV%'"""
)
def points_to_place(spark, sf):
    """Coordinates in hosted spaces, and brain cells as centre with half diagonal; the rest with a reason."""
    tpl = pt.literal_template(pt.ICBM152)
    p, r = xw.points_to_place(qp.owned_mappings(spark, sf), representations(spark, sf), True, lambda d: pt.locate_brain(d, "cell_key", tpl))
    null = lambda t: F.lit(None).cast(t)
    return p.select("mapping_id", "address", F.round("extra_mm", 6).alias("extra_mm"), null("string").alias("code")).unionByName(
        r.select("mapping_id", F.when(F.col("code") == "frame-has-no-mesh", F.col("detail")).alias("address"), null("double").alias("extra_mm"), "code")
    )


IDX = BASE + """, lk AS (SELECT mm.*, tl.* EXCLUDE (term) FROM mm JOIN tl USING (term)), rs AS (SELECT mm.mapping_id, mm.paper_id, code, detail FROM mm JOIN tr USING (term)),
pr AS (SELECT paper_id, representation || '/' || structure_id AS region_key, count(*) AS links, bool_or(how = 'exact-term') AS exact FROM lk GROUP BY ALL), """ + qp.PAPERS_SQL
IDX = _materialised(IDX, "lk", "rs", "pr", "papers")


def index(spark, sf):
    return xw.region_index(qp.papers(spark, sf), links(spark, sf), reasons(spark, sf))


@query(IDX + " SELECT * FROM pr")
def regions_of_papers(spark, sf):
    return index(spark, sf)[0].select("paper_id", "region_key", "links", "exact")


@query(IDX + " SELECT region_key, count(*) AS papers FROM pr GROUP BY region_key")
def papers_of_regions(spark, sf):
    return index(spark, sf)[1].select("region_key", "papers")


@query(IDX + " SELECT paper_id, code, detail, count(DISTINCT mapping_id) AS mappings FROM rs WHERE paper_id NOT IN (SELECT paper_id FROM pr) GROUP BY ALL")
def empty_paper_reasons(spark, sf):
    return index(spark, sf)[2]


@query(
    IDX
    + """ SELECT count(*) AS mappings, count(*) FILTER (mapping_id IN (SELECT mapping_id FROM lk)) AS linked, count(*) FILTER (mapping_id IN (SELECT mapping_id FROM lk WHERE how = 'exact-term')) AS by_exact_term,
      count(*) FILTER (mapping_id IN (SELECT mapping_id FROM lk WHERE how = 'crosswalk')) AS by_crosswalk, 0 AS by_coordinate, (SELECT count(*) FROM papers) AS papers, (SELECT count(*) FROM papers WHERE paper_id IN (SELECT paper_id FROM pr)) AS papers_with_region,
      (SELECT count(*) FROM papers WHERE paper_id NOT IN (SELECT paper_id FROM pr) AND paper_id IN (SELECT paper_id FROM rs)) AS papers_empty_with_reason FROM mm"""
)
def link_coverage(spark, sf):
    return xw.coverage(qp.owned_mappings(spark, sf), qp.papers(spark, sf), links(spark, sf), reasons(spark, sf))


@query(
    IDX
    + """, inv AS (SELECT * FROM pr WHERE links <> 3) SELECT 'mapping_vanished' AS rule, mapping_id AS row_id, '' AS message FROM mm ANTI JOIN lk USING (mapping_id) ANTI JOIN rs USING (mapping_id)
    UNION ALL SELECT 'crosswalk_not_approximate', mapping_id, '' FROM lk WHERE how = 'crosswalk' AND coalesce(why, '') = ''
    UNION ALL SELECT 'paper_without_region_or_reason', paper_id, '' FROM papers ANTI JOIN pr USING (paper_id) ANTI JOIN rs USING (paper_id)
    UNION ALL SELECT 'forward_not_inverted', paper_id || ' ' || region_key, '3' FROM pr WHERE links = 3"""
)
def region_index_invariants(spark, sf):
    """Round trip of links and both indexes; an inverted index missing rows must be caught."""
    pairs = cut_lineage(index(spark, sf)[0])
    broken = pairs.filter("links <> 3")
    return xw.check_index(qp.owned_mappings(spark, sf), qp.papers(spark, sf), links(spark, sf), reasons(spark, sf), pairs, broken, representations(spark, sf))


@query(
    IDX
    + """ SELECT mapping_id, representation, structure_id, CASE WHEN "precision" = 'exact' THEN 'exact' ELSE 'approximate: ' || coalesce(why, '') END AS precision_text, 'part ' || pk || ' (' || term || ')' AS source_text,
      concat_ws('; ', CASE completeness WHEN 'parts' THEN 'the term names a whole; this structure is one of its parts' WHEN 'overlaps' THEN 'the term and this structure only overlap' END,
      CASE WHEN coalesce(held_targets, '') <> '' THEN 'also maps to held structures not drawn here: ' || held_targets END, 'the paper names no side; ' || side || ' is one of the structure''s sides') AS notes FROM lk"""
)
def described_links(spark, sf):
    return xw.describe_links(links(spark, sf))


@query(
    IDX
    + """, pg AS (SELECT region_key, paper_id, links, (SELECT bool_or("precision" = 'exact') FROM lk WHERE lk.paper_id = pr.paper_id AND lk.representation || '/' || lk.structure_id = pr.region_key) AS ex FROM pr)
    , n AS (SELECT region_key, CAST(ceil(count(*) / 1000.0) AS INT) AS pages FROM pg GROUP BY region_key), pp AS (SELECT pg.*, CAST(CAST('0x' || substr(md5(paper_id), 1, 8) AS BIGINT) % pages AS INT) AS page FROM pg JOIN n USING (region_key))
    SELECT region_key, page, '{"kind":"region","region_key":"' || region_key || '","papers":[' || string_agg('{"paper_id":"' || paper_id || '","links":' || links || ',"exact":' || ex || '}', ',' ORDER BY paper_id) || ']}' AS body FROM pp GROUP BY region_key, page"""
)
def region_documents(spark, sf):
    """Query answers as documents; large regions are paged."""
    return xw.region_pages(links(spark, sf)).select("region_key", "page", "body")


@query(
    IDX
    + """, n AS (SELECT region_key, CAST(ceil(count(*) / 1000.0) AS INT) AS pages FROM pr GROUP BY region_key)
    SELECT 'regions/' || region_key || '/' || page || '.json' AS href, unnest(CASE WHEN length(region_key) % 5 = 0 THEN ['unknown_field:extra'] WHEN length(region_key) % 5 = 1 THEN ['missing_field:papers'] WHEN length(region_key) % 5 = 2 THEN ['unknown_kind'] ELSE [] END) AS problem
    FROM (SELECT DISTINCT region_key, CAST(CAST('0x' || substr(md5(paper_id), 1, 8) AS BIGINT) % pages AS INT) AS page FROM pr JOIN n USING (region_key))"""
)
def document_validation(spark, sf):
    """Documents against their field lists; unknown and missing fields are errors."""
    d = xw.region_pages(links(spark, sf))
    n = F.length("region_key") % 5
    body = (
        F.when(n == 0, F.concat(F.lit('{"extra":1,'), F.expr("substring(body, 2)")))
        .when(n == 1, F.to_json(F.struct(F.lit("region").alias("kind"), "region_key")))
        .when(n == 2, F.replace("body", F.lit('"kind":"region"'), F.lit('"kind":"regoin"')))
        .otherwise(F.col("body"))
    )
    docs = d.select(F.concat(F.lit("regions/"), "region_key", F.lit("/"), "page", F.lit(".json")).alias("href"), body.alias("body"))
    return xw.document_problems(docs, {"region": ["kind", "region_key", "papers"], "paper": ["kind", "paper_id", "regions"]})


@query(IDX + " SELECT DISTINCT 'papers/' || paper_id AS from_href, 'regions/' || region_key AS href FROM pr WHERE length(region_key) % 5 = 1")
def document_links(spark, sf):
    """Links between documents that lead nowhere."""
    pairs = index(spark, sf)[0]
    docs = pairs.filter(F.length("region_key") % 5 != 1).select(F.concat(F.lit("regions/"), "region_key").alias("href"))
    hrefs = pairs.select(F.concat(F.lit("papers/"), "paper_id").alias("from_href"), F.concat(F.lit("regions/"), "region_key").alias("href"))
    return xw.broken_links(hrefs, docs).select("from_href", "href")


@query(
    IDX
    + """ SELECT 'mappings_linked' AS criterion, (SELECT count(DISTINCT mapping_id) FROM lk)::DOUBLE AS value, 109.0 AS floor, 'pass' AS verdict UNION ALL SELECT 'papers_with_region', (SELECT count(*) FROM papers WHERE paper_id IN (SELECT paper_id FROM pr))::DOUBLE, 29.0, 'pass'
    UNION ALL SELECT 'held_out_landmarks', 2.0, 3.0, 'fail' UNION ALL SELECT 'claimed_precision_mm', 8.55, 8.55, 'vacuous'"""
)
def crosswalk_gate(spark, sf):
    cov = xw.coverage(qp.owned_mappings(spark, sf), qp.papers(spark, sf), links(spark, sf), reasons(spark, sf))
    return xw.floors(cov, 109, 29, 2, 3, 8.55, 8.55)


@query(
    """WITH s AS (SELECT 'label ' || p_partkey // 4 AS label, CASE WHEN p_partkey % 2 = 0 THEN 'left' ELSE 'right' END AS side, CAST(CASE WHEN p_partkey % 2 = 0 THEN 100 ELSE 200 END + p_partkey // 4 AS VARCHAR) AS id FROM part WHERE p_partkey % 4 < 2 OR p_partkey % 12 = 2),
    g AS (SELECT label, side, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT DISTINCT 'label ' || p_partkey // 3 AS label, p_partkey // 3 AS v FROM part)
    SELECT 'sided_target' AS rule, t.label || '/' || sd AS row_id, coalesce(n, 0) || ' structures' AS message FROM t, (SELECT unnest(['left', 'right']) AS sd) LEFT JOIN g ON g.label = t.label AND g.side = sd WHERE n IS DISTINCT FROM 1"""
)
def sided_targets(spark, sf):
    k = F.col("p_partkey")
    p = T.table(spark, sf, "part").select("p_partkey")
    s = p.filter((k % 4 < 2) | (k % 12 == 2)).select(
        F.concat(F.lit("label "), F.floor(k / 4)).alias("label"),
        F.when(k % 2 == 0, "left").otherwise("right").alias("side"),
        (F.when(k % 2 == 0, 100).otherwise(200) + F.floor(k / 4)).cast("string").alias("structure_id"),
    )
    t = p.select(F.concat(F.lit("label "), F.floor(k / 3)).alias("label"), F.floor(k / 3).alias("value")).distinct()
    return xw.sided_target_problems(t, s, t)
