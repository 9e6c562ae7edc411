"""Mixing sources to target weights by thresholds on hashes.

Every document has a 60-bit hash. For each source the sizes are summed by the leading 12 bits; the bucket in which the running
sum crosses the budget is the boundary, and only its documents are summed again by the next 12 bits, five times at most. The
documents below the threshold are then taken by a filter: nothing is sorted, and smaller budgets take subsets of what larger
ones take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bodygrid.llm.common import n_words, stored

STEP_BITS = 12
STEPS = 5
#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (3, 1, 2)
#: The mix holds this share of all words, and no source more than so many times its own.
SHARE = 1.5
MOST = 2


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of a hash that SQL engines share; depends on the id and the text, so that rows without an id differ."""
    return F.conv(F.substring(F.md5(F.encode(F.concat_ws(":", doc_id.cast("string"), text), "UTF-8")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target). A table of one row per source.

    Weighted shares of ``share`` times all sizes; what exceeds ``most`` times a source's size goes to the others by weight
    until none is above. In the order of size by weight the full sources come first, so the last level is found at once.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # from the first source that the level does not fill, all others get the level too
    s = s.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    last = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level")))).over(every)
    s = s.withColumn("last", last)
    free = F.col("last").isNotNull() & (F.col("last.level") * F.col("weight") < F.col("cap"))
    return s.select("source", "source_size", F.when(free, F.col("last.level") * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def _thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): the hash up to which documents are taken so that their sizes come nearest to ``budget``.

    ``done``: sum of sizes below the boundary found so far; ``prefix``: the boundary's leading bits.
    """
    at = budgets.withColumns({"prefix": F.lit(0).cast("long"), "done": F.lit(0).cast("long")})
    for step in range(1, STEPS + 1):
        shift = 60 - STEP_BITS * step
        here = docs.select("source", "size", "h", F.shiftright("h", shift + STEP_BITS).alias("prefix")).join(at.select("source", "prefix"), ["source", "prefix"])
        sums = here.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        sums = at.select("source", "budget", "prefix", "done").join(sums, "source", "left")
        w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = sums.withColumn("upto", F.col("done") + F.coalesce(F.sum("size").over(w), F.lit(0)))
        crosses = F.coalesce(F.col("upto") > F.col("budget"), F.lit(False))
        crossing = F.min(F.when(crosses, F.struct("bucket", "upto", "size")))
        found = run.groupBy("source").agg(F.first("budget").alias("budget"), F.first("prefix").alias("was"), F.max("upto").alias("all"), crossing.alias("x"))
        at = stored(
            found.select(
                "source", "budget",
                # a source whose every document fits keeps a boundary beyond its last hash
                F.coalesce(F.col("x.bucket"), F.lit(1 << (60 - shift))).alias("prefix"),
                F.coalesce(F.col("x.upto") - F.col("x.size"), F.col("all")).cast("long").alias("done"),
                F.coalesce(F.col("x.size"), F.lit(0)).alias("size"),
            )
        )
    # one hash is left at the boundary: with it if that is nearer
    takes = (F.col("done") + F.col("size") - F.col("budget")) < (F.col("budget") - F.col("done"))
    return at.select("source", (F.col("prefix") - F.when(takes & (F.col("size") > 0), 0).otherwise(1)).alias("threshold"))


def _keyed(source: Column) -> Column:
    """Sources as names that join on equality: null and the empty name differ."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def mix_plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """From (source key, size, h): one row per source with source_size, target, k and threshold."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # the null source comes last, so its name is null again where the order counts
    named = sizes.select(F.when(F.col("source") != "-", F.col("source")).alias("source"), "source_size")
    targets = source_targets(named, weights, share, most)
    k = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = stored(targets.select(F.coalesce("source", F.lit("-")).alias("source"), "source_size", "target", k.alias("k")))
    budgets = plan.select("source", (F.col("target") - F.col("k") * F.col("source_size")).alias("budget"))
    return stored(plan.join(_thresholds(rows, budgets), "source"))


def _copies(most: int) -> Column:
    return F.least(F.col("k") + F.when(F.col("h") <= F.col("threshold"), 1).otherwise(0), F.lit(most)).cast("long")


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [_keyed(F.col(source_col)).alias("source"), n_words(F.col(text_col)).alias("size"), document_hash(F.col(id_col), F.col(text_col)).alias("h")]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per row: doc_id, size, source_size, target, copies, taken.

    A source whose target is k times its size and some rest is taken k times whole, and documents up to a hash threshold once
    more for the rest. Null text has size 0, null is a source of its own, repeated rows share their hash and are taken alike.
    An empty table gives no rows; other columns are not read.
    """
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), *_measured(docs, id_col, text_col, source_col)))
    out = rows.join(mix_plan(rows, weights, share, most), "source").withColumn("copies", _copies(most))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    measured = _measured(docs, id_col, text_col, source_col)
    plan = mix_plan(stored(docs.select(*measured)), weights, share, most)
    key, _, h = measured
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key, h)
    times = rows.join(plan.select("source", "k", "threshold"), "source").withColumn("copies", _copies(most))
    return times.select("row", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))).alias("copy"), "copies").filter("copies > 0").select("row.*")
