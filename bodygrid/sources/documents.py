"""Readers of the JSON, TSV and stanza-text inputs, with explicit schemas, and their flat tables.

Large inputs are JSON lines (one document per line); ``multiline=True`` reads a
single pretty-printed document per file. Array positions are kept: document order
is part of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bodygrid.operators.checks import all_of, problem

PROVENANCE = "STRUCT<assertedBy STRING, assertedOn STRING, basis STRING, confidence STRING, note STRING>"
CORPUS_SCHEMA = f"""schema STRING, version STRING, structureIdSources ARRAY<STRING>,
 authoredAgainst STRUCT<status STRING, nameIndexVersion STRING, partitions ARRAY<STRUCT<id STRING, status STRING, nameIndexVersion STRING, structureIds ARRAY<STRING>, reason STRING>>>,
 papers ARRAY<STRUCT<id STRING, title STRING, authors ARRAY<STRING>, year INT, venue STRING, identifier STRUCT<kind STRING, value STRING>, sourceUrl STRING, provenance {PROVENANCE}>>,
 findings ARRAY<STRUCT<id STRING, paperId STRING, statement STRING, topics ARRAY<STRING>, provenance {PROVENANCE}, mappings ARRAY<STRUCT<id STRING, structureId STRING, structureIdSource STRING, structureLabel STRING,
   spatial STRUCT<kind STRING, reason STRING, cells ARRAY<STRING>, method STRING, digits INT, space STRING, frame STRING, pointsMm ARRAY<ARRAY<DOUBLE>>, note STRING>,
   evidence STRUCT<summary STRING, kind STRING, locator STRING, locatorStatus STRING>, provenance {PROVENANCE}>>>>"""
NAMES_SCHEMA = "version STRING, structures ARRAY<STRUCT<id STRING, name STRING, source STRING, cells ARRAY<STRING>>>"
CROSSWALK_SCHEMA = """schema STRING, version STRING, entries ARRAY<STRUCT<term STRING, label STRING, how STRING, completeness STRING, why STRING, reference STRING, targets ARRAY<STRUCT<representation STRING, label STRING>>>>"""
VEC = "ARRAY<DOUBLE>"
BRAIN_SCHEMA = f"""id STRING, units STRING, acMm {VEC}, left {VEC}, anterior {VEC}, superior {VEC}, extents STRUCT<left DOUBLE, right DOUBLE, anterior DOUBLE, posterior DOUBLE, superior DOUBLE, inferior DOUBLE>, maxUsefulDigits INT"""
BODY_SCHEMA = f"""id STRING, units STRING, maxUsefulDigits INT, slabs ARRAY<STRUCT<label STRING, origin {VEC}, axial {VEC}, anterior {VEC}, left {VEC}, heightMm DOUBLE, surfaceRadiiMm {VEC}>>"""
STRUCTURES_SCHEMA = "id STRING, version STRING, structures ARRAY<STRUCT<id STRING, name STRING, label STRING, side STRING, heldBecause ARRAY<STRING>>>"
CROSSREF_SCHEMA = """DOI STRING, title ARRAY<STRING>, author ARRAY<STRUCT<family STRING, name STRING>>, issued STRUCT<`date-parts` ARRAY<ARRAY<INT>>>, `container-title` ARRAY<STRING>, volume STRING, issue STRING, page STRING, publisher STRING"""
PUBMED_SCHEMA = "title STRING, pubdate STRING, fulljournalname STRING, source STRING, volume STRING, issue STRING, pages STRING, authors ARRAY<STRUCT<name STRING>>, articleids ARRAY<STRUCT<idtype STRING, value STRING>>"


def read_json(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multiline).option("mode", "FAILFAST").json(path)


def name_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(structures, raw cells) of name index documents."""
    s = docs.select(F.col("version").alias("index_version"), F.posexplode("structures").alias("pos", "s"))
    structures = s.select("index_version", "pos", F.col("s.id").alias("structure_id"), F.col("s.name").alias("structure_name"), F.col("s.source").alias("source"))
    return structures, s.select("index_version", F.col("s.id").alias("structure_id"), F.explode("s.cells").alias("cell"))


def _prov(p: str) -> list:
    names = {"assertedBy": "asserted_by", "assertedOn": "asserted_on", "basis": "basis", "confidence": "confidence", "note": "note"}
    return [F.col(f"{p}.provenance.{k}").alias(v) for k, v in names.items()]


def corpus_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """papers, findings, mappings, partitions, members and declared sources of corpus documents."""
    v = F.col("version").alias("dataset_version")
    p = docs.select(v, F.posexplode("papers").alias("pos", "p"))
    papers = p.select(
        "dataset_version", "pos", F.col("p.id").alias("paper_id"), "p.title", "p.authors", "p.year", "p.venue",
        F.col("p.identifier.kind").alias("id_kind"), F.col("p.identifier.value").alias("id_value"), F.col("p.sourceUrl").alias("source_url"), *_prov("p"),
    )
    f = docs.select(v, F.posexplode("findings").alias("pos", "f"))
    findings = f.select("dataset_version", "pos", F.col("f.id").alias("finding_id"), F.col("f.paperId").alias("paper_id"), "f.statement", "f.topics", *_prov("f"))
    m = f.select("dataset_version", F.col("pos").alias("finding_pos"), F.col("f.id").alias("finding_id"), F.col("f.paperId").alias("paper_id"), F.posexplode("f.mappings").alias("pos", "m"))
    sp = lambda n, a=None: F.col(f"m.spatial.{n}").alias(a or n)
    mappings = m.select(
        "dataset_version", "finding_pos", "pos", "finding_id", "paper_id", F.col("m.id").alias("mapping_id"), F.col("m.structureId").alias("structure_id"),
        F.col("m.structureIdSource").alias("structure_source"), F.col("m.structureLabel").alias("structure_label"),
        sp("kind"), sp("reason"), sp("cells"), sp("method"), sp("digits"), sp("space"), sp("frame"), sp("pointsMm", "points"),
        F.col("m.evidence.summary").alias("summary"), F.col("m.evidence.kind").alias("evidence_kind"), F.col("m.evidence.locator").alias("locator"), F.col("m.evidence.locatorStatus").alias("locator_status"),
        *_prov("m"),
    )
    a = docs.select(v, F.explode("authoredAgainst.partitions").alias("a"))
    partitions = a.select("dataset_version", F.col("a.id").alias("partition_id"), "a.status", F.col("a.nameIndexVersion").alias("index_version"), "a.reason")
    members = a.select("dataset_version", F.col("a.id").alias("partition_id"), F.explode("a.structureIds").alias("structure_id"))
    sources = docs.select(v, F.posexplode("structureIdSources").alias("pos", "structure_source"))
    return {"papers": papers, "findings": findings, "mappings": mappings, "partitions": partitions, "members": members, "sources": sources}


def crosswalk_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    e = docs.select(F.col("version").alias("crosswalk_version"), F.posexplode("entries").alias("pos", "e"))
    entries = e.select("crosswalk_version", "pos", "e.term", "e.label", "e.how", "e.completeness", "e.why", "e.reference")
    t = e.select("crosswalk_version", F.col("e.term").alias("term"), F.posexplode_outer("e.targets").alias("pos", "t")).filter("t is not null")
    return entries, t.select("crosswalk_version", "term", "pos", "t.representation", "t.label")


def representation_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shipped and held structures; a label is the name without its side suffix."""
    s = docs.select(F.col("id").alias("representation"), "version", F.explode("structures").alias("s"))
    base = s.select(
        "representation", "version", F.col("s.id").alias("structure_id"), F.col("s.name").alias("name"),
        F.coalesce("s.label", F.regexp_replace("s.name", "\\.[lr]$", "")).alias("label"),
        F.when(F.col("s.side").isin("left", "right", "median"), F.col("s.side")).alias("side"), F.col("s.heldBecause").alias("why"),
    )
    is_held = F.coalesce(F.size("why"), F.lit(0)) > 0
    held = base.filter(is_held).select("representation", "name", "label", "side", F.concat_ws("; ", "why").alias("because"))
    return base.filter(~is_held).drop("why"), held


def template_problems(brain: DataFrame, body: DataFrame) -> DataFrame:
    """Units, positive extents, radii, unique labels and digit caps."""
    ext = ["left", "right", "anterior", "posterior", "superior", "inferior"]
    digits = ~F.coalesce(F.col("maxUsefulDigits").between(0, 16), F.lit(False))
    units = ~F.coalesce(F.col("units") == "mm", F.lit(False))
    bad_ext = F.exists(F.array(*[F.coalesce(F.col(f"extents.{e}"), F.lit(0.0)) for e in ext]), lambda x: x <= 0)
    s = body.select("id", F.posexplode("slabs").alias("pos", "s"))
    rid = F.col("id")
    none = F.lit("")
    return all_of(
        [
            problem(brain.filter(units), "units", rid, F.col("units")),
            problem(body.filter(units), "units", rid, F.col("units")),
            problem(brain.filter(digits), "digit_cap", rid, F.col("maxUsefulDigits")),
            problem(body.filter(digits), "digit_cap", rid, F.col("maxUsefulDigits")),
            problem(brain.filter(bad_ext), "extent", rid, none),
            problem(body.filter(F.coalesce(F.size("slabs"), F.lit(0)) <= 0), "no_slabs", rid, none),
            problem(s.filter("coalesce(size(s.surfaceRadiiMm), 0) < 3"), "too_few_radii", rid, F.col("s.label")),
            problem(s.filter("coalesce(s.heightMm, 0) <= 0"), "height", rid, F.col("s.label")),
            problem(s.groupBy("id", "s.label").count().filter("count > 1"), "duplicate_label", rid, F.col("label")),
        ]
    )


def body_slabs(body: DataFrame) -> DataFrame:
    """Slab rows with unit axes, as the body frame takes them."""
    d = body.select(F.col("id").alias("template_id"), F.posexplode("slabs").alias("pos", "s"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = lambda c: F.transform(c, lambda x: x / norm(c))
    return d.select(
        "template_id", "pos", "s.label", "s.origin", unit(F.col("s.axial")).alias("axial"), unit(F.col("s.anterior")).alias("anterior"),
        F.col("s.heightMm").alias("height_mm"), F.col("s.surfaceRadiiMm").alias("radii"),
    )


def read_concepts(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Concept tables: concept, representation, and either an element file or an English name."""
    return spark.read.schema(f"concept STRING, representation STRING, {value} STRING").csv(path, sep="\t", header=True)


def read_stanzas(spark: SparkSession, path: str) -> DataFrame:
    """Ontology text as one row per stanza, split by the reader so that a file is not one task."""
    return spark.read.option("lineSep", "\n[").text(path).withColumnRenamed("value", "stanza")


def stanza_xrefs(stanzas: DataFrame) -> DataFrame:
    """Cross-references of term stanzas, one row per (id, xref)."""
    t = stanzas.filter(F.col("stanza").rlike("^\\[?Term\\]"))
    d = t.select(
        F.regexp_extract("stanza", "(?m)^id: *(\\S+)", 1).alias("id"),
        F.regexp_extract("stanza", "(?m)^name: *(.*)$", 1).alias("name"),
        F.explode(F.regexp_extract_all("stanza", F.lit("(?m)^xref: *(\\S+)"), 1)).alias("xref"),
    )
    return d.filter("id <> ''").distinct()


def crossref_records(landed: DataFrame, json: str = "body") -> DataFrame:
    """Landed Crossref messages flattened to the record shape."""
    m = F.from_json(json, CROSSREF_SCHEMA)
    d = landed.withColumn("m", m)
    a = F.get(F.col("m.author"), F.lit(0))
    return d.select(
        *landed.columns,
        F.lit("crossref").alias("source"),
        F.col("m.DOI").alias("doi"),
        F.get(F.col("m.title"), F.lit(0)).alias("title"),
        F.coalesce(a["family"], a["name"]).alias("first_author_family"),
        F.coalesce(F.greatest(F.size("m.author"), F.lit(0)), F.lit(0)).alias("author_count"),
        F.get(F.get(F.col("m.issued.date-parts"), F.lit(0)), F.lit(0)).alias("year"),
        F.coalesce(F.get(F.col("m.container-title"), F.lit(0)), F.col("m.publisher")).alias("container_title"),
    )


def pubmed_records(landed: DataFrame, json: str = "body") -> DataFrame:
    d = landed.withColumn("m", F.from_json(json, PUBMED_SCHEMA))
    doi = F.get(F.filter("m.articleids", lambda i: i["idtype"] == "doi"), F.lit(0))["value"]
    year = F.regexp_extract("m.pubdate", "\\b(\\d{4})\\b", 1)
    return d.select(
        *landed.columns,
        F.lit("pubmed").alias("source"),
        doi.alias("doi"),
        F.col("m.title").alias("title"),
        F.get(F.col("m.authors"), F.lit(0))["name"].alias("first_author_family"),
        F.coalesce(F.greatest(F.size("m.authors"), F.lit(0)), F.lit(0)).alias("author_count"),
        F.when(year != "", year.cast("int")).alias("year"),
        F.coalesce("m.fulljournalname", "m.source").alias("container_title"),
    )
