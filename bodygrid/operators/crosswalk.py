"""Terms and coordinates to structures in several representations.

representations: representation, version, pos, id_scheme, labels, to_mni, hosts_spaces, precision_mm, precision_basis, supplied
structures: representation, structure_id, name, label, side       held: representation, name, label, side, because
entries: term, label, how, completeness, why                       targets: term, pos, representation, label
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bodygrid.functions import address as ad
from bodygrid.operators.checks import all_of, problem
from bodygrid.session import cut_lineage

# Link kinds and schemes that are never the structures they project onto.
HOWS = ["exact-term", "crosswalk"]
COMPLETENESS = ["same", "parts", "overlaps", "none"]
CROSSWALK_ONLY_SCHEMES = ["HCP-MMP1"]


def validate_crosswalk(entries: DataFrame, targets: DataFrame, reps: DataFrame, structures: DataFrame, held: DataFrame, mappings: DataFrame) -> DataFrame:
    e = entries.join(targets.groupBy("term").agg(F.count(F.lit(1)).alias("n_targets")), "term", "left").withColumn(
        "n_targets", F.coalesce("n_targets", F.lit(0))
    )
    none = F.col("completeness") == "none"
    scheme = F.substring_index("term", ":", 1)
    rule = lambda name, cond: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rows = e.select(
        "term",
        F.explode(
            F.array_compact(
                F.array(
                    rule("no_label", blank("label")),
                    rule("bad_how", ~F.coalesce(F.col("how").isin(*HOWS), F.lit(False))),
                    rule("bad_completeness", ~F.coalesce(F.col("completeness").isin(*COMPLETENESS), F.lit(False))),
                    rule("scheme_is_crosswalk_only", scheme.isin(*CROSSWALK_ONLY_SCHEMES) & (F.col("how") != "crosswalk")),
                    rule("exact_but_overlaps", (F.col("how") == "exact-term") & (F.col("completeness") == "overlaps")),
                    rule("none_and_targets_disagree", none != (F.col("n_targets") == 0)),
                    rule("no_reason", ((F.col("how") == "crosswalk") | none) & blank("why")),
                )
            )
        ).alias("rule"),
    ).select("rule", F.col("term").alias("row_id"), F.lit("").alias("message"))
    dup = entries.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    t = targets.join(reps.select("representation", "labels", "supplied"), "representation", "left")
    names = structures.select("representation", "label").unionByName(held.select("representation", "label")).distinct()
    lost = t.filter("supplied and labels = 'named-structures'").join(names, ["representation", "label"], "left_anti")
    keyed = reps.filter("id_scheme is not null").select(F.col("id_scheme").alias("structure_source")).distinct()
    gap = mappings.join(entries.select(F.col("term").alias("structure_id")), "structure_id", "left_anti").join(keyed, "structure_source", "left_anti")
    return all_of(
        [
            rows,
            problem(dup, "listed_twice", F.col("term"), F.lit("")),
            problem(t.filter("labels is null"), "unknown_representation", F.col("term"), F.col("representation")),
            problem(t.filter("labels <> 'named-structures'"), "names_no_structures", F.col("term"), F.col("representation")),
            problem(lost, "target_does_not_exist", F.col("term"), F.concat_ws("/", "representation", "label")),
            problem(gap, "term_without_entry", F.col("mapping_id"), F.col("structure_id")),
        ]
    )


def route_terms(terms: DataFrame, reps: DataFrame, structures: DataFrame, held: DataFrame, entries: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (scheme, term) to structures: identity first, then the crosswalk, else a coded reason.

    Returns (links per term, reasons per term). Terms are routed once however many
    mappings use them.
    """
    sup = reps.filter("supplied")
    keyed = sup.filter("id_scheme is not null").select("representation", "version", "pos", F.col("id_scheme").alias("scheme"))
    same = terms.join(keyed, "scheme").join(structures.withColumn("term", F.col("structure_id")), ["representation", "term"])
    same = same.groupBy("scheme", "term").agg(F.min_by(F.struct("representation", "structure_id", "name", "side"), "pos").alias("s"))
    cols = ["scheme", "term", "representation", "structure_id", "name", "side", "how", "precision", "why", "completeness", "held_targets"]
    null = lambda n: F.lit(None).cast("string").alias(n)
    identity = same.select(
        "scheme", "term", "s.*", F.lit("exact-term").alias("how"), F.lit("exact").alias("precision"), null("why"), null("completeness"), null("held_targets")
    ).select(*cols)
    rest = terms.join(same.select("scheme", "term"), ["scheme", "term"], "left_anti")
    # Read by several branches below, so written once: a plan that repeats them sorts each anew in one task.
    e = cut_lineage(rest.join(entries.select("term", "how", "completeness", "why"), "term", "left"))
    lists = keyed.groupBy("scheme").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "representation", "version"))), ", ").alias("keyed_by"))
    miss_entry = e.filter("completeness is null").join(lists, "scheme", "left")
    no_entry = miss_entry.select(
        "scheme",
        "term",
        F.when(F.col("keyed_by").isNotNull(), "not-in-representation").otherwise("no-crosswalk-entry").alias("code"),
        F.when(F.col("keyed_by").isNotNull(), F.concat("term", F.lit(" is not in "), "keyed_by")).otherwise(F.concat(F.lit("no entry for "), "term")).alias("detail"),
    )
    none = e.filter("completeness = 'none'").select("scheme", "term", F.lit("not-in-representation").alias("code"), F.coalesce("why", F.lit("")).alias("detail"))
    t = cut_lineage(
        e.filter("completeness <> 'none'")
        .join(targets.select("term", F.col("pos").alias("target_pos"), "representation", F.col("label").alias("target_label")), "term")
        .join(sup.select("representation", F.lit(True).alias("_sup")), "representation", "left")
    )
    key = lambda d: d.withColumnRenamed("label", "target_label")
    shipped = t.join(key(structures), ["representation", "target_label"])
    h = t.join(key(held).select("representation", "target_label", "because"), ["representation", "target_label"])
    # Distinct labels and reasons of one term: bounded by its own target list.
    h = h.groupBy("scheme", "term").agg(
        F.array_join(F.array_sort(F.collect_set("target_label")), "; ").alias("held_targets"),
        F.array_join(F.array_sort(F.collect_set("because")), " | ").alias("because"),
    )
    absent = t.filter("_sup is null").groupBy("scheme", "term").agg(F.array_join(F.array_sort(F.collect_set("representation")), ", ").alias("absent"))
    linked = shipped.join(h.select("scheme", "term", "held_targets"), ["scheme", "term"], "left").select(
        "scheme", "term", "representation", "structure_id", "name", "side", "how",
        F.when(F.col("how") == "exact-term", "exact").otherwise("approximate").alias("precision"),
        F.when(F.col("how") != "exact-term", F.coalesce("why", F.lit(""))).alias("why"),
        "completeness",
        F.coalesce("held_targets", F.lit("")).alias("held_targets"),
    )
    unlinked = t.select("scheme", "term").distinct().join(shipped.select("scheme", "term").distinct(), ["scheme", "term"], "left_anti")
    u = unlinked.join(h, ["scheme", "term"], "left").join(absent, ["scheme", "term"], "left")
    u = u.filter("held_targets is not null or absent is not null").select(
        "scheme",
        "term",
        F.when(F.col("held_targets").isNotNull(), "structure-held").otherwise("representation-absent").alias("code"),
        F.when(F.col("held_targets").isNotNull(), F.concat("held_targets", F.lit(": "), "because")).otherwise(F.col("absent")).alias("detail"),
    )
    return identity.unionByName(linked), all_of([no_entry, none, u])


def link_terms(mappings: DataFrame, term_links: DataFrame, term_reasons: DataFrame) -> DataFrame:
    """Mappings next to the links and reasons of their terms, told apart by ``is_link``: mappings meet both in one join."""
    m = mappings.select("mapping_id", "finding_id", "paper_id", F.col("structure_source").alias("scheme"), F.col("structure_id").alias("term"), F.col("structure_label").alias("source_label"))
    links = term_links.withColumn("side_from_source", F.lit(False)).withColumn("precision_mm", F.lit(None).cast("double"))
    reasons = term_reasons.withColumn("route", F.lit("term"))
    routes = links.withColumn("is_link", F.lit(True)).unionByName(reasons.withColumn("is_link", F.lit(False)), allowMissingColumns=True)
    return m.join(cut_lineage(routes), ["scheme", "term"])


def points_to_place(mappings: DataFrame, reps: DataFrame, have_template: bool, locate) -> tuple[DataFrame, DataFrame]:
    """Points of mappings with geometry: coordinates in hosted spaces, and BV cells as centre plus half diagonal.

    ``locate`` is a DataFrame function adding x_mm, y_mm, z_mm and extents to a frame
    with ``cell_key``.
    """
    base = ["mapping_id", "finding_id", "paper_id"]
    hosted = reps.filter("hosts_spaces is not null").select(F.explode("hosts_spaces").alias("space")).distinct()
    c = mappings.filter("kind = 'coordinates'")
    pts = c.join(hosted, "space", "left_semi").select(*base, F.explode("points").alias("p"))
    pts = pts.select(*base, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), F.col("p")[2].alias("z"), F.lit(0.0).alias("extra_mm"), F.lit(None).cast("string").alias("address"))
    space = c.join(hosted, "space", "left_anti").select(*base, F.lit("coordinate").alias("route"), F.lit("space-not-registered").alias("code"), F.concat(F.lit("no representation hosts "), "space").alias("detail"))
    cells = mappings.filter("kind = 'cells'").select(*base, F.explode("cells").alias("address"))
    is_bv = F.startswith("address", F.lit("BV")) & F.lit(have_template)
    good = ad.canonicalize(cells.filter(is_bv), "address").filter("cell is not null")
    placed = locate(ad.with_key(good))
    half = F.sqrt(F.col("extent_lateral") * F.col("extent_lateral") + F.col("extent_ap") * F.col("extent_ap") + F.col("extent_si") * F.col("extent_si")) / 2
    placed = placed.select(*base, F.col("x_mm").alias("x"), F.col("y_mm").alias("y"), F.col("z_mm").alias("z"), half.alias("extra_mm"), F.col("cell").alias("address"))
    frame = cells.filter(~is_bv).select(*base, F.lit("coordinate").alias("route"), F.lit("frame-has-no-mesh").alias("code"), F.col("address").alias("detail"))
    return pts.unionByName(placed), space.unionByName(frame)


def link_coordinates(points: DataFrame, inside: DataFrame, nearest: DataFrame, structures: DataFrame, representation: str, precision_mm: float) -> tuple[DataFrame, DataFrame]:
    """Link points to the structures that contain them, never to the nearest one.

    ``points``: point_id, mapping_id, finding_id, paper_id, extra_mm. ``inside``:
    point_id, structure_id. ``nearest``: point_id, nearest_id, distance_mm. The stated
    precision is the registration error plus the cell's half diagonal, two decimals half up.
    """
    s = structures.filter(F.col("representation") == representation).select("structure_id", "name", "side")
    links = points.join(inside, "point_id").join(s, "structure_id").select(
        "mapping_id", "finding_id", "paper_id", "structure_id", "name", "side",
        F.lit(representation).alias("representation"),
        F.lit("coordinate").alias("how"),
        (F.floor((precision_mm + F.col("extra_mm")) * 100 + 0.5) / 100).alias("precision_mm"),
        F.lit(True).alias("side_from_source"),
    )
    miss = points.join(inside.select("point_id").distinct(), "point_id", "left_anti").join(nearest, "point_id", "left")
    reasons = miss.select(
        "mapping_id", "finding_id", "paper_id", F.lit("coordinate").alias("route"), F.lit("coordinate-outside-shipped-structures").alias("code"),
        F.concat_ws(" ", F.lit("nearest"), "nearest_id").alias("detail"),
    )
    return links, reasons


def region_index(papers: DataFrame, links: DataFrame, reasons: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paper, region) pairs with link counts, (region, paper counts), and reasons of papers without any region."""
    key = F.concat_ws("/", "representation", "structure_id")
    pairs = links.withColumn("region_key", key).groupBy("paper_id", "region_key").agg(
        F.count(F.lit(1)).alias("links"), F.min("name").alias("name"), F.bool_or(F.col("how") == "exact-term").alias("exact")
    )
    regions = pairs.groupBy("region_key").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("papers"))
    empty = papers.select("paper_id").join(pairs.select("paper_id").distinct(), "paper_id", "left_anti")
    because = reasons.join(empty, "paper_id").select("paper_id", "code", "detail", "mapping_id").distinct()
    because = because.groupBy("paper_id", "code", "detail").agg(F.count(F.lit(1)).alias("mappings"))
    return pairs, regions, because


def coverage(mappings: DataFrame, papers: DataFrame, links: DataFrame, reasons: DataFrame) -> DataFrame:
    how = lambda h: F.max(F.col("how") == h)
    per = links.groupBy("mapping_id").agg(how("exact-term").alias("e"), how("crosswalk").alias("c"), how("coordinate").alias("k"))
    m = mappings.select("mapping_id").join(per, "mapping_id", "left").agg(
        F.count(F.lit(1)).alias("mappings"),
        F.count_if(F.col("e").isNotNull()).alias("linked"),
        F.count_if("e").alias("by_exact_term"),
        F.count_if("c").alias("by_crosswalk"),
        F.count_if("k").alias("by_coordinate"),
    )
    has = links.select("paper_id").distinct().withColumn("l", F.lit(True))
    why = reasons.select("paper_id").distinct().withColumn("r", F.lit(True))
    p = papers.select("paper_id").join(has, "paper_id", "left").join(why, "paper_id", "left").agg(
        F.count(F.lit(1)).alias("papers"),
        F.count_if(F.col("l").isNotNull()).alias("papers_with_region"),
        F.count_if(F.col("l").isNull() & F.col("r").isNotNull()).alias("papers_empty_with_reason"),
    )
    return m.crossJoin(p)  # one row each


def check_index(mappings: DataFrame, papers: DataFrame, links: DataFrame, reasons: DataFrame, pairs: DataFrame, inverted: DataFrame, reps: DataFrame) -> DataFrame:
    """Invariants of links and both indexes, the four set differences included."""
    vanished = mappings.select("mapping_id").join(links, "mapping_id", "left_anti").join(reasons, "mapping_id", "left_anti")
    l = links.join(reps.select("representation", F.col("precision_mm").alias("floor_mm")), "representation", "left")
    coord = F.col("how") == "coordinate"
    bad = {
        "coordinate_below_registration": coord & (F.col("precision_mm") < F.col("floor_mm")),
        "coordinate_without_registration": coord & F.col("floor_mm").isNull(),
        "coordinate_without_precision": coord & F.col("precision_mm").isNull(),
        "exact_not_exact": (F.col("how") == "exact-term") & (F.col("precision") != "exact"),
        "crosswalk_not_approximate": (F.col("how") == "crosswalk") & ((F.col("precision") != "approximate") | (F.coalesce("why", F.lit("")) == "")),
        "scheme_is_crosswalk_only": F.col("scheme").isin(*CROSSWALK_ONLY_SCHEMES) & ~F.col("how").isin("crosswalk", "coordinate"),
    }
    tests = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in bad.items()]))
    rows = l.select("mapping_id", F.explode(tests).alias("rule")).select("rule", F.col("mapping_id").alias("row_id"), F.lit("").alias("message"))
    stated = reasons.select("paper_id").distinct()
    mute = papers.select("paper_id").join(pairs.select("paper_id").distinct(), "paper_id", "left_anti").join(stated, "paper_id", "left_anti")
    fwd = pairs.select("paper_id", "region_key", F.col("links").alias("n"))
    inv = inverted.select("paper_id", "region_key", F.col("links").alias("n"))
    via = links.groupBy("paper_id", F.concat_ws("/", "representation", "structure_id").alias("region_key")).agg(F.count(F.lit(1)).alias("n"))
    differ = [("forward_not_inverted", "fwd", "inv"), ("inverted_not_forward", "inv", "fwd"), ("link_not_forward", "via", "fwd"), ("forward_not_link", "fwd", "via")]
    diffs = _differences({"fwd": fwd, "inv": inv, "via": via}, differ, ["paper_id", "region_key", "n"])
    return all_of(
        [
            problem(vanished, "mapping_vanished", F.col("mapping_id"), F.lit("")),
            rows,
            problem(mute, "paper_without_region_or_reason", F.col("paper_id"), F.lit("")),
            diffs.select("rule", F.concat_ws(" ", "paper_id", "region_key").alias("row_id"), F.col("n").cast("string").alias("message")),
        ]
    )


def _differences(sides: dict[str, DataFrame], rules: list[tuple[str, str, str]], key: list[str]) -> DataFrame:
    """Rows of one side that another lacks, for each (rule, side, other): every side is shuffled once, whatever the number of rules.

    A row with a NULL equals no other, as in an anti join; repeated rows are kept as often as they occur.
    """
    rows = reduce(DataFrame.unionByName, [d.select(*key, F.lit(name).alias("_side")) for name, d in sides.items()])
    counts = rows.groupBy(*key).agg(*[F.count_if(F.col("_side") == name).cast("int").alias(f"_{name}") for name in sides])
    null = reduce(Column.__or__, [F.col(k).isNull() for k in key])
    of = lambda rule, a, b: F.array_repeat(F.lit(rule), F.when((F.col(f"_{b}") == 0) | null, F.col(f"_{a}")).otherwise(0))
    return counts.select(*key, F.explode(F.flatten(F.array(*[of(*r) for r in rules]))).alias("rule"))


def describe_links(links: DataFrame) -> DataFrame:
    """One sentence per link: how, precision and the paper's own term."""
    c = F.col
    precision = F.when(c("precision") == "exact", "exact").when(
        c("precision_mm").isNotNull(), F.concat(F.lit("approximate, ±"), c("precision_mm").cast("string"), F.lit(" mm"))
    ).otherwise(F.concat(F.lit("approximate: "), F.coalesce("why", F.lit(""))))
    source = F.concat(F.when(c("scheme") == "HCP-MMP1", F.lit("HCP-MMP1 area ")).otherwise(F.lit("")), "source_label", F.lit(" ("), "term", F.lit(")"))
    notes = F.concat_ws(
        "; ",
        F.when(c("completeness") == "parts", "the term names a whole; this structure is one of its parts"),
        F.when(c("completeness") == "overlaps", "the term and this structure only overlap"),
        F.when(F.coalesce("held_targets", F.lit("")) != "", F.concat(F.lit("also maps to held structures not drawn here: "), "held_targets")),
        F.when(c("side").isNotNull() & ~c("side_from_source"), F.concat(F.lit("the paper names no side; "), "side", F.lit(" is one of the structure's sides"))),
    )
    return links.select("mapping_id", "representation", "structure_id", precision.alias("precision_text"), source.alias("source_text"), notes.alias("notes"))


def region_pages(links: DataFrame, page_size: int = 1000) -> DataFrame:
    """Region documents as pages of papers: (region_key, page, pages, body JSON).

    A region may have any number of papers, so its document is split into pages by a
    hash of the paper; a page gathers about ``page_size`` papers and never a whole hot region.
    """
    key = F.concat_ws("/", "representation", "structure_id")
    pairs = links.withColumn("region_key", key).groupBy("region_key", "paper_id").agg(
        F.count(F.lit(1)).alias("links"), F.bool_or(F.col("precision") == "exact").alias("exact")
    )
    n = pairs.groupBy("region_key").agg(F.ceil(F.count(F.lit(1)) / page_size).cast("int").alias("pages"))
    paged = pairs.join(n, "region_key").withColumn("page", F.pmod(F.conv(F.substring(F.md5("paper_id"), 1, 8), 16, 10).cast("long"), F.col("pages")).cast("int"))
    papers = F.array_sort(F.collect_list(F.struct("paper_id", "links", "exact")))
    g = paged.groupBy("region_key", "pages", "page").agg(papers.alias("papers"))
    return g.select("region_key", "page", "pages", F.to_json(F.struct(F.lit("region").alias("kind"), "region_key", "papers")).alias("body"))


def document_problems(docs: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Unknown, missing and unknown-kind fields of JSON documents. docs: href, body."""
    d = docs.select("href", F.expr("json_object_keys(body)").alias("keys"), F.get_json_object("body", "$.kind").alias("kind"))
    want = F.lit(None).cast("array<string>")
    for kind, fields in allowed.items():
        want = F.when(F.col("kind") == kind, F.array(*[F.lit(f) for f in fields])).otherwise(want)
    d = d.withColumn("want", want)
    bad = lambda a, b, what: F.transform(F.array_except(a, b), lambda k: F.concat(F.lit(what), k))
    found = (
        F.when(F.col("keys").isNull(), F.array(F.lit("not_an_object")))
        .when(F.col("want").isNull(), F.array(F.lit("unknown_kind")))
        .otherwise(F.concat(bad(F.col("keys"), F.col("want"), "unknown_field:"), bad(F.col("want"), F.col("keys"), "missing_field:")))
    )
    return d.select("href", F.explode(found).alias("problem"))


def broken_links(hrefs: DataFrame, docs: DataFrame) -> DataFrame:
    """Links of documents that lead to no document. hrefs: from_href, href."""
    return hrefs.distinct().join(docs.select("href").distinct(), "href", "left_anti")


def floors(cov: DataFrame, min_linked: int, min_papers: int, held_out: int, min_held_out: int, claimed_mm: float, floor_mm: float) -> DataFrame:
    """Gate rows with verdicts; a criterion with nothing to check is vacuous, not passed."""
    row = lambda name, value, need, vac: F.struct(F.lit(name).alias("criterion"), value.cast("double").alias("value"), F.lit(float(need)).alias("floor"), vac.alias("vacuous"))
    no = F.lit(False)
    rows = F.array(
        row("mappings_linked", F.col("linked"), min_linked, no),
        row("papers_with_region", F.col("papers_with_region"), min_papers, no),
        row("held_out_landmarks", F.lit(held_out), min_held_out, no),
        row("claimed_precision_mm", F.lit(claimed_mm), floor_mm, F.col("by_coordinate") == 0),
    )
    d = cov.select(F.inline(rows))
    v = F.when(F.col("vacuous"), "vacuous").when(F.col("value") >= F.col("floor"), "pass").otherwise("fail")
    return d.select("criterion", "value", "floor", v.alias("verdict"))


def sided_target_problems(targets: DataFrame, structures: DataFrame, values: DataFrame) -> DataFrame:
    """Each target label must be exactly one structure per side with the expected id.

    ``values``: label, value; the expected id is hemisphere * 100 + value with left 1 and right 2.
    """
    want = targets.select("label").distinct().join(values, "label", "left").select(
        "label", F.explode(F.array(F.struct(F.lit("left").alias("side"), (100 + F.col("value")).alias("want")), F.struct(F.lit("right").alias("side"), (200 + F.col("value")).alias("want")))).alias("w")
    ).select("label", "w.*")
    got = structures.groupBy("label", "side").agg(F.count(F.lit(1)).alias("n"), F.min("structure_id").alias("got"))
    bad = want.join(got, ["label", "side"], "left").filter(~F.coalesce((F.col("n") == 1) & (F.col("got") == F.col("want").cast("string")), F.lit(False)))
    return problem(bad, "sided_target", F.concat_ws("/", "label", "side"), F.concat(F.coalesce("n", F.lit(0)), F.lit(" structures")))
