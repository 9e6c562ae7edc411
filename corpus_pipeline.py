"""Raw documents to packed training sequences: quality rules, exact duplicates, near duplicates, mixing, packing.

Each stage gets what the stage before has kept, as a table that was written and read again. ``doc_id`` names a document; rows
that are repeated whole are copies, of which one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bodygrid.llm import exact, minhash, mixing, packing, quality
from bodygrid.llm.common import stored, table
from bodygrid.llm.queries import PACKING_TOKENIZER


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go. Row-local once the ratios and the least score are known.

    Null and empty texts have no words and go. Repeated rows stay together; a very long text is scored whole; an empty table stays
    empty. All columns stay, one called ``quality`` too.
    """
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    ratios, least = quality.fitted(docs, trusted)
    if "quality" in docs.columns:
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        return quality.scored(docs.select(row, "doc_id", "text"), ratios, least=least).filter("quality.kept").select("row.*")
    return quality.scored(docs, ratios, least=least).filter("quality.kept").drop("quality")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays. Rows that share their id are told apart by their texts; of rows that share both, the least stays.

    Null counts as empty; an empty table stays empty; all columns stay.
    """
    kept = exact.exact_duplicates(docs).filter("kept").select("doc_id", "text_sha256")
    return _only(docs, kept, [("doc_id", F.col("doc_id")), ("text_sha256", F.sha2(F.encode(exact.normalised(F.col("text")), "UTF-8"), 256))])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near duplicates, over five words and a similarity of 0.8, the smallest id stays.

    Texts without words are linked with nothing and stay; rows with an id that stays all stay; an empty table stays empty.
    """
    kept = minhash.near_duplicates(docs).filter("kept").select("doc_id").distinct()
    return _only(docs, kept, [("doc_id", F.col("doc_id"))], one=False)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their targets: a document comes as often as the mix takes it.

    Null and empty texts have size 0; a null source is a source of its own; an empty table stays empty; all columns stay.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in the sequences.

    Null is an empty text, which is one piece of its end mark; long texts are cut into pieces; an empty table gives none.
    """
    return packing.pack(docs, PACKING_TOKENIZER)


def _only(docs: DataFrame, kept: DataFrame, keys: list, one: bool = True) -> DataFrame:
    """Rows of ``docs`` whose keys are in ``kept``; null is a value. ``one``: of rows with equal keys the least."""
    kept = stored(kept)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*cols).alias("row"), *[k.alias(n) for n, k in keys])
    cond = [rows[n].eqNullSafe(kept[n]) for n, _ in keys]
    if not one:
        return rows.join(kept, cond, "left_semi").select("row.*")
    again = stored(rows.groupBy(*[n for n, _ in keys]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    rows = rows.join(kept, cond, "left_semi")
    if not again.limit(1).count():
        return rows.select("row.*")
    twice = [rows[n].eqNullSafe(again[n]) for n, _ in keys]
    single = rows.join(again, twice, "left_anti").select("row")
    # a copy of a row is a row with the same keys; grouping keeps one without a window over the copies
    several = rows.join(again, twice, "left_semi").groupBy(*[n for n, _ in keys]).agg(F.min("row").alias("row")).select("row")
    return single.unionByName(several).select("row.*")


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("minhash near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Hashed n-grams, verified similarity and tokens have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
