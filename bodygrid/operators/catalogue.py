"""Structure catalogue: provenance, grouping, sampling, attribution.

Rule lists (materials, sources, categories, decisions) are tables the caller passes,
joined by value; nothing about a particular asset is built in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bodygrid.operators.checks import all_of, problem

C = F.col


def classify_structures(structures: DataFrame, materials: DataFrame, atlases: DataFrame, own_source: str) -> DataFrame:
    """Group each structure by its materials and source; an unknown material is an error, never cleared.

    structures: id, name, materials ARRAY, bx_source, bx_parent. materials: material, class
    (own, undeclared, nerve, alone), where ``alone`` holds a structure only when it is
    the single material. atlases: bx_source, source_id.
    """
    m = structures.select("id", F.explode_outer(F.array_distinct("materials")).alias("material")).join(materials, "material", "left")
    g = m.groupBy("id").agg(
        F.count("material").alias("n"),
        F.count_if(C("class") == "nerve").alias("nerve"),
        F.count_if(C("class") == "undeclared").alias("undeclared"),
        F.count_if(C("class") == "alone").alias("alone"),
        F.count_if(C("material").isNotNull() & C("class").isNull()).alias("unknown"),
    )
    d = structures.join(g, "id").join(atlases, "bx_source", "left")
    held = (C("undeclared") > 0) | ((C("n") == 1) & (C("alone") == 1))
    error = (
        F.when(C("unknown") > 0, "unknown_material")
        .when((C("n") == 0) & C("source_id").isNull(), "no_recognised_atlas")
        .when((C("n") > 0) & ~C("bx_source").eqNullSafe(F.lit(own_source)), "unexpected_source")
    )
    group = F.when(error.isNotNull(), None).when(C("nerve") > 0, "nerves").when(held, "undeclared").otherwise("cleared")
    basis = (
        F.when(error.isNotNull(), None)
        .when(C("n") == 0, F.when(C("bx_parent").isNotNull(), "partition of a parent mesh by its atlas").otherwise("generated from its atlas"))
        .when((C("nerve") > 0) | held, "own system")
        .otherwise("own system, cleared by inference from its material names")
    )
    reasons = F.concat_ws("; ", F.when(C("nerve") > 0, "carries the nerve material"), F.when(C("undeclared") > 0, "carries undeclared materials"), F.when((C("n") == 1) & (C("alone") == 1), "carries only a material seen on undeclared structures"))
    return d.select("id", "name", group.alias("group"), basis.alias("basis"), F.when(reasons != "", reasons).alias("held_because"), error.alias("error"))


def apply_overrides(classified: DataFrame, measured: DataFrame, replacements: DataFrame, holds: DataFrame, control_share_limit: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Measurement, then decisions, over the material rules; and decisions that match nothing.

    measured: name, role, matched, control_passes (booleans). The measurement counts only
    if few controls pass. replacements: name, source. holds: name, reason.
    """
    share = measured.agg((F.avg(C("control_passes").cast("double")) <= control_share_limit)).scalar()
    m = measured.filter("role = 'held-out'").select("name", (C("matched") & F.coalesce(share, F.lit(False))).alias("_clears"))
    d = (
        classified.withColumn("name", F.trim("name")).join(m, "name", "left").join(replacements.select("name", C("source").alias("_repl")), "name", "left").join(holds.select("name", C("reason").alias("_hold")), "name", "left")
    )
    cleared = F.when(C("_clears"), "cleared").when(C("_clears").isNotNull() & C("_repl").isNotNull(), "cleared").otherwise(C("group"))
    ships = F.when(C("_clears").isNotNull() & ~C("_clears") & C("_repl").isNotNull(), C("_repl")).otherwise("own")
    hold = (cleared == "cleared") & C("_hold").isNotNull()
    out = d.select(
        "id", "name", F.when(hold, "held-by-decision").otherwise(cleared).alias("group"), ships.alias("ships_from"),
        F.when(hold, C("_hold")).when(cleared == "cleared", None).otherwise(C("held_because")).alias("held_because"),
    )
    stale = holds.join(classified.select(F.trim("name").alias("name")).distinct(), "name", "left_anti")
    return out, problem(stale, "hold_matches_nothing", C("name"), C("reason"))


def manifest_differences(manifest: DataFrame, derived: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Field-level differences between a stored manifest and the re-derived one."""
    a = manifest.select(key, *[C(f).cast("string").alias(f"a_{f}") for f in fields], F.lit(True).alias("_a"))
    b = derived.select(key, *[C(f).cast("string").alias(f"b_{f}") for f in fields], F.lit(True).alias("_b"))
    j = a.join(b, key, "full_outer")
    rows = F.array(*[F.struct(F.lit(f).alias("field"), C(f"a_{f}").alias("stored"), C(f"b_{f}").alias("derived")) for f in fields])
    d = j.select(key, "_a", "_b", F.inline(rows))
    d = d.withColumn("field", F.when(C("_a").isNull(), "missing_from_manifest").when(C("_b").isNull(), "not_derived").otherwise(C("field")))
    bad = d.filter(C("_a").isNull() | C("_b").isNull() | ~C("stored").eqNullSafe(C("derived")))
    return bad.select(key, "field", F.when(C("_a") & C("_b"), C("stored")).alias("stored"), F.when(C("_a") & C("_b"), C("derived")).alias("derived")).distinct()


def side_of(name):
    s = F.lower(F.regexp_extract(name, "(?i)\\b(right|left)\\b", 1))
    return F.when(s != "", s)


def group_files(files: DataFrame, elements: DataFrame, excluded: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to structures by concept, blanks resolved by the smallest consistent concept.

    files: file, concept (NULL when its header names none), name. elements: concept, file.
    excluded: file, reason. categories: category, precedence, file. Returns
    (structures: concept, name, category, side, n_files) and (excluded files: file, reason).
    """
    kept = files.join(excluded.select("file").distinct(), "file", "left_anti")
    blank = kept.filter("concept is null").select("file")
    size = elements.groupBy("concept").agg(F.count(F.lit(1)).alias("size"))
    cand = blank.join(elements.withColumnRenamed("concept", "cand"), "file").join(size.withColumnRenamed("concept", "cand"), "cand").filter("size >= 2")
    # A concept is consistent if its other files name it or nothing, and at least one names it.
    named = elements.withColumnRenamed("concept", "cand").join(files.select("file", C("concept").alias("header")), "file", "left").groupBy("cand").agg(
        F.count_if(C("header") == C("cand")).alias("yes"), F.count_if(C("header").isNotNull() & (C("header") != C("cand"))).alias("no")
    )
    ok = cand.join(named, "cand").filter("no = 0 and yes > 0").groupBy("file").agg(F.min(F.struct("size", "cand"))["cand"].alias("resolved"))
    d = kept.join(ok, "file", "left").withColumn("own", F.coalesce("concept", "resolved"))
    cat = d.filter("own is not null").select("own", "file").join(categories, "file").groupBy("own").agg(F.min_by("category", "precedence").alias("category"))
    g = d.filter("own is not null").groupBy("own").agg(F.count(F.lit(1)).alias("n_files"), F.min("name").alias("name"), F.count_distinct("name").alias("names"))
    s = g.join(cat, "own", "left").select(C("own").alias("concept"), "name", F.coalesce("category", F.lit("other")).alias("category"), side_of(C("name")).alias("side"), "n_files", "names")
    out = excluded.join(files.select("file"), "file", "left_semi").select("file", "reason").unionByName(
        d.filter("own is null").select("file", F.lit("names no concept and no consistent concept holds it").alias("reason"))
    )
    return s, out


def quotas(structures: DataFrame, size: int, at_least: int) -> DataFrame:
    """Largest-remainder quotas per category with a minimum, never above what exists.

    The table has one row per category, so its windows are small.
    """
    n = structures.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    allw = Window.partitionBy(F.lit(1))
    d = n.withColumn("spare", F.lit(size) - at_least * F.count(F.lit(1)).over(allw)).withColumn("share", C("spare") * C("n") / F.sum("n").over(allw))
    d = d.withColumn("base", at_least + F.floor("share")).withColumn("left", F.lit(size) - F.sum("base").over(allw))
    d = d.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy((F.floor("share") - C("share")), "category")))
    return d.select("category", "n", F.least(C("base") + F.when(C("r") <= C("left"), 1).otherwise(0), C("n")).cast("long").alias("quota"))


def draw_sample(structures: DataFrame, size: int, at_least: int, required: list[str], seed: int) -> DataFrame:
    """Reproducible stratified sample of whole units (all sides of a label together).

    structures: id, category, label. Units are ordered within a category by a hash of
    the seed and the unit; at most ``size`` units per category can matter, so the
    ranked window keeps only those before it shuffles. Required units come first.
    """
    u = structures.groupBy("category", "label").agg(F.count(F.lit(1)).alias("m"))
    first = C("label").isin(*required) if required else F.lit(False)
    u = u.withColumn("_o", F.struct(F.when(first, 0).otherwise(1).alias("q"), F.md5(F.concat_ws("|", F.lit(str(seed)), "category", "label")).alias("h")))
    w = Window.partitionBy("category").orderBy("_o")
    u = u.withColumn("_r", F.row_number().over(w)).filter(C("_r") <= size)
    u = u.join(quotas(structures, size, at_least), "category")
    cum = F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1))
    u = u.withColumn("_before", F.coalesce(cum, F.lit(0))).filter((C("_before") < C("quota")) | (C("_o.q") == 0))
    # A unit that overshoots its quota is dropped again where the whole would stay at or above the size.
    u = u.withColumn("_over", (C("_before") + C("m") > C("quota")) & (C("_o.q") == 1) & (C("_before") >= at_least))
    total = F.sum("m").over(Window.partitionBy(F.lit(1)))  # at most size + categories rows
    drop = F.sum(F.when(C("_over"), C("m")).otherwise(0)).over(Window.partitionBy(F.lit(1)).orderBy(F.desc("quota"), "category", "_r"))
    u = u.withColumn("_t", total).withColumn("_d", drop).filter(~(C("_over") & (C("_t") - C("_d") >= size)))
    return structures.join(u.select("category", "label"), ["category", "label"], "left_semi")


def check_sample(sample: DataFrame, structures: DataFrame, excluded: DataFrame, size: int, at_least: int, required: list[str]) -> DataFrame:
    """A stored sample against the population: size, membership, minimum per category, pairs, required, controls."""
    total = sample.agg(F.count(F.lit(1)).alias("n")).filter(C("n") != size)
    gone = sample.join(structures.select("id"), "id", "left_anti")
    changed = sample.alias("s").join(structures.alias("p"), "id").filter((C("s.label") != C("p.label")) | (C("s.category") != C("p.category")))
    have = sample.groupBy("category").agg(F.count(F.lit(1)).alias("k"))
    need = structures.groupBy("category").agg(F.count(F.lit(1)).alias("n")).join(have, "category", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    few = need.filter(C("k") < F.least(F.lit(at_least), C("n")))
    alone = structures.join(sample.select("category", "label").distinct(), ["category", "label"], "left_semi").join(sample.select("id"), "id", "left_anti")
    req = structures.filter(C("label").isin(*(required or [""]))).join(sample.select("id"), "id", "left_anti")
    held = sample.join(excluded.select("id"), "id", "left_semi")
    return all_of(
        [
            problem(total, "wrong_size", F.lit(""), C("n")),
            problem(gone, "does_not_ship", C("id"), F.lit("")),
            problem(changed, "changed", C("id"), F.lit("")),
            problem(few, "category_too_small", C("category"), C("k")),
            problem(alone, "sampled_without_sibling", C("id"), F.lit("")),
            problem(req, "required_missing", C("id"), F.lit("")),
            problem(held, "held_structure_sampled", C("id"), F.lit("")),
        ]
    )


def attribution_coverage(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Each payload file attributed exactly once, each listed file existing. files: path; entries: entry_id, path."""
    n = entries.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    j = files.select("path", F.lit(True).alias("_f")).join(n, "path", "full_outer")
    rule = F.when(C("_f").isNull(), "listed_but_missing").when(C("n").isNull(), "not_attributed").when(C("n") > 1, "attributed_twice")
    return j.select(rule.alias("rule"), C("path").alias("row_id"), F.coalesce(C("n"), F.lit(0)).cast("string").alias("message")).filter("rule is not null")


def inherited_terms(entries: DataFrame, upstream: DataFrame) -> DataFrame:
    """Entries whose sources are unknown, not cleared, or whose terms are not passed on.

    entries: entry_id, first_party, share_alike, non_commercial, sources ARRAY.
    upstream: source, cleared, share_alike, non_commercial.
    """
    e = entries.select("entry_id", "share_alike", "non_commercial", F.explode("sources").alias("source"))
    j = e.join(upstream.select("source", "cleared", C("share_alike").alias("u_sa"), C("non_commercial").alias("u_nc")), "source", "left")
    per = j.groupBy("entry_id", "share_alike", "non_commercial").agg(F.bool_or("u_sa").alias("sa"), F.bool_or("u_nc").alias("nc"))
    mute = entries.filter("not first_party and coalesce(size(sources), 0) <= 0")
    return all_of(
        [
            problem(j.filter("cleared is null"), "unknown_source", C("entry_id"), C("source")),
            problem(j.filter("not cleared"), "source_not_cleared", C("entry_id"), C("source")),
            problem(per.filter("sa and not share_alike"), "share_alike_not_passed_on", C("entry_id"), F.lit("")),
            problem(per.filter("nc and not non_commercial"), "non_commercial_not_passed_on", C("entry_id"), F.lit("")),
            problem(mute, "cites_nothing", C("entry_id"), F.lit("")),
        ]
    )


def contents_cited(contents: DataFrame, manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """Structures inside files: listed, cleared, and their sources cited by the file's entry.

    contents: path, structure_id. manifest: structure_id, group, sources ARRAY. entries: path, sources ARRAY.
    """
    at = F.concat_ws("#", "path", "structure_id")
    j = contents.join(manifest, "structure_id", "left").join(entries.select("path", C("sources").alias("cited")), "path", "left")
    missing = F.array_except("sources", F.coalesce("cited", F.array().cast("array<string>")))
    return all_of(
        [
            problem(j.filter("group is null"), "not_in_manifest", at, F.lit("")),
            problem(j.filter("group <> 'cleared'"), "not_cleared", at, C("group")),
            problem(j.filter(F.size(missing) > 0), "source_not_cited", at, F.array_join(F.array_sort(missing), ",")),
        ]
    )


def path_problems(paths: DataFrame, restricted: DataFrame) -> DataFrame:
    """Paths that are not normalised, and paths inside a restricted directory.

    Each path is compared with its own parent directories by an equi-join, never with every directory.
    """
    p = C("path")
    odd = p.rlike("(^/)|(^|/)\\.{1,2}(/|$)|//|\\\\") | (p == "")
    up = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("dir"))
    inside = up.join(restricted.select(F.regexp_replace("dir", "/+$", "").alias("dir")).distinct(), "dir")
    return problem(paths.filter(odd), "not_normalised", p, F.lit("")).unionByName(problem(inside, "inside_restricted", p, C("dir")))
