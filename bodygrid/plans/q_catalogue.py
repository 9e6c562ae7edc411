"""Catalogue checks over parts, customers, suppliers and pages."""

from pyspark.sql import functions as F

from bodygrid.operators import catalogue as ca
from bodygrid.plans import tables as T
from bodygrid.plans.registry import query

def pk():
    return F.col("p_partkey")


MATS = ["Artery", "Cartilage", "Nerve", "Cortex", "Lobe", "Chalk"]  # the last one is on no list


def structures(spark, sf):
    p = T.table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    m = lambda k: F.get(F.array(*[F.lit(x) for x in MATS]), (k % 6).cast("int"))
    mats = F.when(pk() % 5 == 0, F.array().cast("array<string>")).when(pk() % 5 == 1, F.array(m(F.col("p_size")))).otherwise(F.array(m(F.col("p_size") % 2), m(pk() % 4)))
    return p.select(
        pk().alias("id"), F.concat("p_name", F.lit(" "), pk()).alias("name"), mats.alias("materials"),
        F.when(pk() % 5 == 0, F.when(pk() % 3 == 0, "atlas-a").otherwise("atlas-z")).when(pk() % 29 == 1, "elsewhere").otherwise("own").alias("bx_source"),
        F.when(pk() % 2 == 0, "parent").alias("bx_parent"),
    )


def materials(spark, sf):
    return spark.sql("SELECT * FROM VALUES ('Artery','own'),('Cartilage','own'),('Nerve','nerve'),('Cortex','undeclared'),('Lobe','alone') AS t(material, class)")


def atlases(spark, sf):
    return spark.sql("SELECT 'atlas-a' AS bx_source, 'a-2018' AS source_id")


CLS = """p AS (SELECT p_partkey AS k, p_name || ' ' || p_partkey AS name, CASE WHEN p_partkey % 5 = 0 THEN [] WHEN p_partkey % 5 = 1 THEN [['Artery','Cartilage','Nerve','Cortex','Lobe','Chalk'][CAST(p_size % 6 + 1 AS INT)]]
  ELSE [['Artery','Cartilage'][CAST(p_size % 2 + 1 AS INT)], ['Artery','Cartilage','Nerve','Cortex'][CAST(p_partkey % 4 + 1 AS INT)]] END AS m, CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'atlas-a' ELSE 'atlas-z' END WHEN p_partkey % 29 = 1 THEN 'elsewhere' ELSE 'own' END AS src FROM part),
c AS (SELECT k AS id, name, CASE WHEN list_contains(m, 'Chalk') THEN 'unknown_material' WHEN len(m) = 0 AND src <> 'atlas-a' THEN 'no_recognised_atlas' WHEN len(m) > 0 AND src <> 'own' THEN 'unexpected_source' END AS error, m,
  list_contains(m, 'Nerve') AS nv, list_contains(m, 'Cortex') OR (len(m) = 1 AND list_contains(m, 'Lobe')) AS hd FROM p),
g AS (SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN nv THEN 'nerves' WHEN hd THEN 'undeclared' ELSE 'cleared' END AS "group" FROM c)"""


@query("WITH " + CLS + """ SELECT id, name, "group", error FROM g""")
def provenance_groups(spark, sf):
    return ca.classify_structures(structures(spark, sf), materials(spark, sf), atlases(spark, sf), "own").select("id", "name", "group", "error")


def overridden(spark, sf):
    s = ca.classify_structures(structures(spark, sf), materials(spark, sf), atlases(spark, sf), "own")
    p = T.table(spark, sf, "part")
    name = F.concat("p_name", F.lit(" "), pk()).alias("name")
    measured = p.filter(pk() % 3 == 0).select(name, F.when(pk() % 2 == 0, "held-out").otherwise("fit").alias("role"), (pk() % 4 == 0).alias("matched"), (pk() % 90 == 0).alias("control_passes"))
    repl = p.filter(pk() % 7 == 0).select(name, F.lit("body-index").alias("source"))
    holds = p.filter(pk() % 11 == 0).select(F.when(pk() % 55 == 0, F.concat(F.lit("gone "), pk())).otherwise(F.concat("p_name", F.lit(" "), pk())).alias("name"), F.lit("source unsettled").alias("reason"))
    return ca.apply_overrides(s, measured, repl, holds)


@query(
    "WITH " + CLS
    + """, o AS (SELECT *, CASE WHEN id % 6 = 0 AND (id % 4 = 0 OR id % 7 = 0) THEN 'cleared' ELSE "group" END AS g1 FROM g)
    SELECT id, CASE WHEN g1 = 'cleared' AND id % 11 = 0 AND id % 55 <> 0 THEN 'held-by-decision' ELSE g1 END AS "group", CASE WHEN id % 6 = 0 AND id % 4 <> 0 AND id % 7 = 0 THEN 'body-index' ELSE 'own' END AS ships_from FROM o"""
)
def provenance_overrides(spark, sf):
    """Measurements, then decisions, over the material rules."""
    return overridden(spark, sf)[0].select("id", "group", "ships_from")


@query("SELECT 'hold_matches_nothing' AS rule, 'gone ' || p_partkey AS row_id, 'source unsettled' AS message FROM part WHERE p_partkey % 55 = 0")
def stale_decisions(spark, sf):
    return overridden(spark, sf)[1]


@query(
    "WITH " + CLS
    + """ SELECT id, 'group' AS field, 'cleared' AS stored, "group" AS derived FROM g WHERE id % 13 = 1 AND id % 17 <> 2 AND "group" IS DISTINCT FROM 'cleared' UNION ALL SELECT id, 'missing_from_manifest', NULL, NULL FROM g WHERE id % 17 = 2"""
)
def manifest_drift(spark, sf):
    d = ca.classify_structures(structures(spark, sf), materials(spark, sf), atlases(spark, sf), "own").select("id", "name", "group")
    stored = d.filter("id % 17 <> 2").withColumn("group", F.when(F.col("id") % 13 == 1, "cleared").otherwise(F.col("group")))
    return ca.manifest_differences(stored, d, ["name", "group"])


def files(spark, sf):
    p = T.table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    named = F.when(pk() % 7 != 3, F.concat(F.lit("C"), F.floor(pk() / 4)))
    return p.select(F.concat(F.lit("f"), pk()).alias("file"), named.alias("concept"), F.when(pk() % 7 != 3, F.concat(F.when(F.floor(pk() / 4) % 3 == 0, "Left part ").otherwise("part "), F.floor(pk() / 4))).alias("name"))


@query(
    """WITH f AS (SELECT p_partkey AS k, 'f' || p_partkey AS file, 'C' || p_partkey // 4 AS el, CASE WHEN p_partkey % 7 <> 3 THEN 'C' || p_partkey // 4 END AS concept, p_size, p_partkey % 23 = 4 AS ex FROM part),
    ok AS (SELECT el FROM f GROUP BY el HAVING count(*) >= 2 AND count(concept) > 0), own AS (SELECT *, coalesce(concept, CASE WHEN el IN (SELECT el FROM ok) THEN el END) AS o FROM f WHERE NOT ex)
    SELECT o AS concept, CASE WHEN bool_or(p_size < 5) THEN 'bone' WHEN bool_or(p_size < 20) THEN 'muscle' ELSE 'other' END AS category, CASE WHEN count(concept) > 0 AND CAST(substr(o, 2) AS INT) % 3 = 0 THEN 'left' END AS side, count(*) AS n_files FROM own WHERE o IS NOT NULL GROUP BY o"""
)
def grouped_structures(spark, sf):
    """Files grouped into structures; blank headers resolved by the smallest consistent concept."""
    p = T.table(spark, sf, "part").select("p_partkey", "p_size")
    f = F.concat(F.lit("f"), pk()).alias("file")
    elements = p.select(F.concat(F.lit("C"), F.floor(pk() / 4)).alias("concept"), f)
    excluded = p.filter(pk() % 23 == 4).select(f, F.lit("in an excluded concept").alias("reason"))
    cats = p.filter("p_size < 5").select(F.lit("bone").alias("category"), F.lit(0).alias("precedence"), f).unionByName(
        p.filter("p_size < 20").select(F.lit("muscle").alias("category"), F.lit(1).alias("precedence"), f)
    )
    return ca.group_files(files(spark, sf), elements, excluded, cats)[0].select("concept", "category", "side", "n_files")


def population(spark, sf):
    c = T.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    k = F.col("c_custkey")
    return c.select(k.alias("id"), F.col("c_mktsegment").alias("category"), F.concat(F.lit("U"), F.floor(k / 2)).alias("label"), (F.col("c_acctbal") < 0).alias("held"))


@query(
    """WITH n AS (SELECT c_mktsegment AS category, count(*) AS n FROM customer WHERE c_acctbal >= 0 GROUP BY 1), s AS (SELECT *, (40 - 2 * (SELECT count(*) FROM n)) * n / (SELECT sum(n) FROM n) AS share FROM n),
    b AS (SELECT *, 2 + floor(share) AS base, row_number() OVER (ORDER BY share - floor(share) DESC, category) AS r FROM s) SELECT category, n, CAST(least(base + CASE WHEN r <= 40 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END, n) AS BIGINT) AS quota FROM b"""
)
def sample_quotas(spark, sf):
    return ca.quotas(population(spark, sf).filter("not held"), 40, 2)


@query(
    """WITH p AS (SELECT c_custkey AS id, c_mktsegment AS category, 'U' || c_custkey // 2 AS label FROM customer WHERE c_acctbal >= 0), n AS (SELECT category, count(*) AS n FROM p GROUP BY 1), s AS (SELECT *, (40 - 2 * (SELECT count(*) FROM n)) * n / (SELECT sum(n) FROM n) AS share FROM n),
    b AS (SELECT *, 2 + floor(share) AS base, row_number() OVER (ORDER BY share - floor(share) DESC, category) AS r FROM s), q AS (SELECT category, least(base + CASE WHEN r <= 40 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END, n) AS quota FROM b),
    u AS (SELECT category, label, count(*) AS m, label = 'U3' AS must, row_number() OVER (PARTITION BY category ORDER BY label <> 'U3', md5('7|' || category || '|' || label)) AS r FROM p GROUP BY category, label),
    t AS (SELECT u.*, quota, coalesce((SELECT sum(m) FROM u x WHERE x.category = u.category AND x.r < u.r), 0) AS before FROM u JOIN q USING (category)), k AS (SELECT *, before + m > quota AND NOT must AND before >= 2 AS over FROM t WHERE before < quota OR must),
    d AS (SELECT *, (SELECT sum(m) FROM k) AS total, sum(CASE WHEN over THEN m ELSE 0 END) OVER (ORDER BY quota DESC, category, r) AS dropped FROM k)
    SELECT p.* FROM p JOIN d USING (category, label) WHERE NOT (over AND total - dropped >= 40)"""
)
def stratified_sample(spark, sf):
    """Forty structures, whole units, at least two per category, in the order of a hash."""
    return ca.draw_sample(population(spark, sf).filter("not held").drop("held"), 40, 2, ["U3"], 7)


@query(
    """WITH s AS (SELECT c_custkey AS id, c_mktsegment AS category, c_custkey // 2 AS u, c_acctbal < 0 AS held FROM customer), p AS (SELECT * FROM s WHERE NOT held), smp AS (SELECT * FROM s WHERE id % 3 = 0)
    SELECT 'wrong_size' AS rule, '' AS row_id, CAST(count(*) AS VARCHAR) AS message FROM smp HAVING count(*) <> 40 UNION ALL SELECT 'does_not_ship', CAST(id AS VARCHAR), '' FROM smp WHERE held
    UNION ALL SELECT 'sampled_without_sibling', CAST(p.id AS VARCHAR), '' FROM p WHERE id % 3 <> 0 AND EXISTS (SELECT 1 FROM smp WHERE smp.u = p.u AND smp.category = p.category) UNION ALL SELECT 'required_missing', CAST(id AS VARCHAR), '' FROM p WHERE u = 5 AND id % 3 <> 0
    UNION ALL SELECT 'held_structure_sampled', CAST(id AS VARCHAR), '' FROM smp WHERE held"""
)
def sample_check(spark, sf):
    d = population(spark, sf)
    return ca.check_sample(d.filter("id % 3 = 0").drop("held"), d.filter("not held").drop("held"), d.filter("held"), 40, 2, ["U5"])


PAGE = "regexp_replace(url, '^https?://', '')"


@query(
    """WITH f AS (SELECT 'p/' || page_id AS path FROM pages WHERE page_id % 9 <> 2), e AS (SELECT 'p/' || page_id AS path FROM pages WHERE page_id % 8 <> 3 UNION ALL SELECT 'p/' || page_id FROM pages WHERE page_id % 10 = 4), n AS (SELECT path, count(*) AS n FROM e GROUP BY path)
    SELECT CASE WHEN f.path IS NULL THEN 'listed_but_missing' WHEN n IS NULL THEN 'not_attributed' ELSE 'attributed_twice' END AS rule, coalesce(f.path, n.path) AS row_id, CAST(coalesce(n, 0) AS VARCHAR) AS message FROM f FULL JOIN n ON f.path = n.path WHERE f.path IS NULL OR n IS NULL OR n > 1"""
)
def attribution_coverage(spark, sf):
    p = T.table(spark, sf, "pages").select("page_id")
    k = F.col("page_id")
    path = F.concat(F.lit("p/"), k).alias("path")
    e = p.filter(k % 8 != 3).unionByName(p.filter(k % 10 == 4)).select(k.alias("entry_id"), path)
    return ca.attribution_coverage(p.filter(k % 9 != 2).select(path), e)


@query(
    """WITH u AS (SELECT 'src' || s_suppkey AS source, s_suppkey % 10 <> 3 AS cleared, s_suppkey % 4 = 1 AS sa, s_suppkey % 6 = 2 AS nc FROM supplier WHERE s_suppkey % 20 <> 7), e AS (SELECT p_partkey AS k, p_partkey % 2 = 0 AS sa, p_partkey % 3 = 0 AS nc, p_partkey % 5 = 0 AS fp, CASE WHEN p_partkey % 7 = 0 THEN [] ELSE ['src' || p_partkey % 100, 'src' || (p_partkey * 3) % 100] END AS s FROM part),
    x AS (SELECT k, sa, nc, unnest(s) AS source FROM e), j AS (SELECT x.*, u.cleared, u.sa AS usa, u.nc AS unc FROM x LEFT JOIN u USING (source))
    SELECT 'unknown_source' AS rule, CAST(k AS VARCHAR) AS row_id, source AS message FROM j WHERE cleared IS NULL UNION ALL SELECT 'source_not_cleared', CAST(k AS VARCHAR), source FROM j WHERE NOT cleared
    UNION ALL SELECT 'share_alike_not_passed_on', CAST(k AS VARCHAR), '' FROM j GROUP BY k, sa HAVING bool_or(usa) AND NOT sa UNION ALL SELECT 'non_commercial_not_passed_on', CAST(k AS VARCHAR), '' FROM j GROUP BY k, nc HAVING bool_or(unc) AND NOT nc
    UNION ALL SELECT 'cites_nothing', CAST(k AS VARCHAR), '' FROM e WHERE NOT fp AND len(s) = 0"""
)
def inherited_terms(spark, sf):
    k = F.col("s_suppkey")
    up = T.table(spark, sf, "supplier").filter(k % 20 != 7).select(F.concat(F.lit("src"), k).alias("source"), (k % 10 != 3).alias("cleared"), (k % 4 == 1).alias("share_alike"), (k % 6 == 2).alias("non_commercial"))
    src = F.when(pk() % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("src"), pk() % 100), F.concat(F.lit("src"), pk() * 3 % 100)))
    e = T.table(spark, sf, "part").select(pk().alias("entry_id"), (pk() % 5 == 0).alias("first_party"), (pk() % 2 == 0).alias("share_alike"), (pk() % 3 == 0).alias("non_commercial"), src.alias("sources"))
    return ca.inherited_terms(e, up)


@query(
    """WITH m AS (SELECT p_partkey AS sid, CASE WHEN p_partkey % 9 = 2 THEN 'undeclared' ELSE 'cleared' END AS g, ['a' || p_partkey % 3, 'b'] AS s FROM part WHERE p_partkey % 31 <> 8), c AS (SELECT DISTINCT 'file' || l_suppkey AS path, l_suppkey AS sk, l_partkey AS sid FROM lineitem),
    j AS (SELECT c.*, m.g, list_filter(m.s, lambda x: NOT list_contains(CASE WHEN sk % 4 = 0 THEN ['b'] ELSE ['a' || sk % 3, 'b'] END, x)) AS miss FROM c LEFT JOIN m USING (sid))
    SELECT 'not_in_manifest' AS rule, path || '#' || sid AS row_id, '' AS message FROM j WHERE g IS NULL UNION ALL SELECT 'not_cleared', path || '#' || sid, g FROM j WHERE g <> 'cleared' UNION ALL SELECT 'source_not_cited', path || '#' || sid, array_to_string(miss, ',') FROM j WHERE len(miss) > 0"""
)
def contents_cited(spark, sf):
    m = T.table(spark, sf, "part").filter(pk() % 31 != 8).select(pk().alias("structure_id"), F.when(pk() % 9 == 2, "undeclared").otherwise("cleared").alias("group"), F.array(F.concat(F.lit("a"), pk() % 3), F.lit("b")).alias("sources"))
    sk = F.col("l_suppkey")
    path = F.concat(F.lit("file"), sk).alias("path")
    li = T.table(spark, sf, "lineitem")
    e = li.select("l_suppkey").distinct().select(path, F.when(sk % 4 == 0, F.array(F.lit("b"))).otherwise(F.array(F.concat(F.lit("a"), sk % 3), F.lit("b"))).alias("sources"))
    return ca.contents_cited(li.select(path, F.col("l_partkey").alias("structure_id")).distinct(), m, e)


@query(
    """WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 1 THEN '/x/' || page_id WHEN 2 THEN 'a/../b/' || page_id WHEN 3 THEN 'held/' || page_id || '/f' WHEN 4 THEN 'held-not/' || page_id ELSE 'ok/' || page_id END AS path FROM pages)
    SELECT 'not_normalised' AS rule, path AS row_id, '' AS message FROM p WHERE page_id % 6 IN (1, 2) UNION ALL SELECT 'inside_restricted', path, 'held' FROM p WHERE page_id % 6 = 3"""
)
def payload_paths(spark, sf):
    k = F.col("page_id")
    path = F.when(k % 6 == 1, F.concat(F.lit("/x/"), k)).when(k % 6 == 2, F.concat(F.lit("a/../b/"), k)).when(k % 6 == 3, F.concat(F.lit("held/"), k, F.lit("/f"))).when(k % 6 == 4, F.concat(F.lit("held-not/"), k)).otherwise(F.concat(F.lit("ok/"), k))
    p = T.table(spark, sf, "pages").select(path.alias("path"))
    return ca.path_problems(p, spark.sql("SELECT 'held/' AS dir"))
