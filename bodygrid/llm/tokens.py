"""Token counts from the exact histogram of encoded lengths.

Documents are grouped by encoded length; sums over the histogram from either end answer totals, quantiles and truncated totals
for every context limit, without another look at a text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bodygrid.llm.common import stored

#: Lengths are summed within ranges of so many, then over ranges, so that no task gets the whole histogram.
RANGE = 1024


def lengths(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, length: ids of each whole text; null has none."""

    def count(batches):
        from bodygrid.llm.encoders import counter

        n = counter(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n(t.as_py()) for t in b.column(1)], pa.int64())], ["doc_id", "length"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(count, f"doc_id {dict(src.dtypes)['doc_id']}, length bigint")


def length_histogram(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per encoded length, which is also a context limit: documents of it, up to it and over it, tokens up to it, all tokens,
    tokens that are left when every document is cut at it, tokens lost by that, the share of documents up to it, and the
    smallest doc_id of that length.

    Null and empty texts have length 0; repeated rows count each; an empty table gives no rows; other columns are not read.
    """
    h = stored(lengths(docs, tokenizer, id_col, text_col).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("example_doc_id")))
    h = h.withColumn("part", F.floor(F.col("length") / RANGE)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    parts = h.groupBy("part").agg(F.sum("n_docs").alias("pd"), F.sum("tokens").alias("pt"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range of lengths
    every = Window.partitionBy()
    parts = parts.select(
        "part", F.coalesce(F.sum("pd").over(before), F.lit(0)).alias("docs_before"), F.coalesce(F.sum("pt").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("pd").over(every).alias("all_docs"), F.sum("pt").over(every).alias("all_tokens"),
    )
    upto = Window.partitionBy("part").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = h.join(parts, "part").withColumn("docs_upto", F.col("docs_before") + F.sum("n_docs").over(upto)).withColumn("tokens_upto", F.col("tokens_before") + F.sum("tokens").over(upto))
    over = F.col("all_docs") - F.col("docs_upto")
    kept = F.col("tokens_upto") + over * F.col("length")
    return s.select(
        F.col("length").alias("context_limit"), "n_docs", "docs_upto", over.alias("docs_over"), "tokens_upto", F.col("all_tokens").alias("total_tokens"),
        kept.alias("truncated_tokens"), (F.col("all_tokens") - kept).alias("lost_tokens"), (F.col("docs_upto") / F.col("all_docs")).alias("share_upto"), "example_doc_id",
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for any context limits from the histogram: (context_limit, docs_over, total_tokens, truncated_tokens)."""
    sums = [F.sum(F.least(F.col("context_limit"), F.lit(n)) * F.col("n_docs")) for n in limits]
    rows = [F.struct(F.lit(n).cast("long").alias("context_limit"), F.coalesce(F.sum(F.when(F.col("context_limit") > n, F.col("n_docs"))), F.lit(0)).alias("docs_over"), F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total_tokens"), F.coalesce(s, F.lit(0)).alias("truncated_tokens")) for n, s in zip(limits, sums)]
    return histogram.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that at least this share of the documents does not exceed."""
    rows = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("share_upto") >= q, F.col("context_limit"))).alias("length")) for q in shares]
    return histogram.agg(F.array(*rows).alias("r")).select(F.inline("r"))
