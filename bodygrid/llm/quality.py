"""Quality rules: counts of signs and repeats, then a log-likelihood ratio of hashed n-grams.

Words and pairs of words are hashed into buckets. Their counts over trusted documents and over the whole corpus give two
smoothed multinomials; a document's score is the mean of the log ratio over its n-grams, so long and short documents compare.
Each distinct text counts once, however many copies it has, and is trusted if any of its rows is. The ratios are a table of fixed
size, kept as whole thousandths: scores are integer sums, equal in every run. The least score is read off
trusted texts that were held back. Scoring is row-local: no shuffle, and the same threshold for every document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bodygrid.functions.once import once
from bodygrid.llm.common import SPACE, WORD, words

BUCKETS = 10_000
#: Added to each bucket's count, as a share of one observation per bucket.
SMOOTHING = 1.0
#: One trusted text of so many is held back to set the least score: this quantile less its distance from the median.
HELD_BACK = 4
LOWEST = 0.001
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
# The signs that are counted.
SIGNS = r"[#*$%&|<>]"


def grams(w: Column, buckets: int) -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    two = F.transform(w, lambda x, i: F.when(i > 0, F.pmod(F.xxhash64(F.get(w, i - 1), x), F.lit(buckets)).cast("int")))
    return F.concat(one, F.array_compact(two))


def _trusted_ids(trusted: DataFrame) -> DataFrame:
    return trusted.select(F.col(trusted.columns[0]).alias("id")).distinct().hint("merge")  # the same plan at every size


def _held_back(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(HELD_BACK)) == 0


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key and text; the key is the text's identity. Null is the empty text."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.select("id", F.sha2(F.encode("text", "UTF-8"), 256).alias("key"), "text")


def _counts(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int) -> list[tuple[int, int, int]]:
    """(raw, target, learned) of each bucket: n-grams of all distinct texts, of the trusted ones, of those not held back."""
    src = _keyed(docs, id_col, text_col)
    keys = src.select("id", "key").join(_trusted_ids(trusted), "id").select("key").distinct().withColumn("trusted", F.lit(1)).hint("merge")
    # copies meet before the shuffle: a text travels about once per task
    src = src.groupBy("key").agg(F.first("text").alias("text")).join(keys, "key", "left")
    src = src.select("trusted", F.when(~_held_back(F.col("key")), F.col("trusted")).alias("learned"), "text")
    src = once(src, {"w": words(F.col("text"))}).select("trusted", "learned", "w")
    each = src.select("trusted", "learned", F.explode(grams(F.col("w"), buckets)).alias("bucket"))
    got = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target"), F.count("learned").alias("learned"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(got, "bucket", "left").fillna(0)
    return [(r[1], r[2], r[3]) for r in sorted(every.collect())]  # ``buckets`` rows


def _logs(counts: list[tuple[int, int]]) -> list[int]:
    raw, target = (sum(c) for c in zip(*counts))
    base = math.log((raw + SMOOTHING * len(counts)) / (target + SMOOTHING * len(counts)))
    return [round(1000 * (math.log((t + SMOOTHING) / (r + SMOOTHING)) + base)) for r, t in counts]


def ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> list[int]:
    """Log ratio of each bucket in thousandths; ``trusted`` has the ids of the target documents. A list of fixed length.

    Every distinct text counts once as raw, and once as target too if any of its rows is trusted. Ids join as values: a null id
    is trusted nowhere.
    """
    return _logs([(r, t) for r, t, _ in _counts(docs, trusted, id_col, text_col, buckets)])


def _ratio(grams: Column, table: list[int]) -> Column:
    """Mean log ratio over buckets of n-grams; null without any."""
    ratio = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")  # folded into a constant of fixed size
    total = F.aggregate(grams, F.lit(0).cast("long"), lambda a, x: a + F.get(ratio, x))
    return F.when(F.size(grams) > 0, total / F.size(grams))


def fitted(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> tuple[list[int], int | None]:
    """The ratios, and the least mean log ratio in thousandths.

    Trusted texts that are held back get ratios learned without them, as a good text without a label does. Of their scores the
    least score is the quantile ``LOWEST`` less its distance from the median. Only texts of ``MIN_WORDS`` words, as the base rules
    ask, have a say; without any the least score is None, and no text fails by its ratio.
    """
    counts = _counts(docs, trusted, id_col, text_col, buckets)
    learned = _logs([(r, n) for r, _, n in counts])
    src = once(_keyed(docs, id_col, text_col), {"w": words(F.col("text"))}).drop("text").filter(_held_back(F.col("key")) & (F.size("w") >= MIN_WORDS))
    src = once(src, {"grams": grams(F.col("w"), buckets)}).drop("w")
    src = once(src, {"score": F.floor(_ratio(F.col("grams"), learned)).cast("int")}).select("id", "key", "score")
    each = src.join(_trusted_ids(trusted), "id").select("key", "score").distinct()
    scores = sorted(each.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect())  # as many rows as the ratios have thousandths
    least = 2 * _quantile(scores, LOWEST) - _quantile(scores, 0.5) if scores else None
    return _logs([(r, t) for r, t, _ in counts]), least


def _quantile(counts: list[tuple[int, int]], share: float) -> int:
    left = share * sum(n for _, n in counts)
    for value, n in counts:
        left -= n
        if left < 0:
            return value
    return counts[-1][0]


def _repeats(df: DataFrame) -> DataFrame:
    """``n_repeat_words``: words in windows that the text has twice or more, from the array ``w``; drops nothing."""
    last = F.size("w") - WINDOW
    win = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(WINDOW)])))
    df = once(df, {"win": F.coalesce(win, F.array().cast("array<bigint>"))})
    ordered = F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("win")) < F.size("win")
    df = once(df, {"ordered": F.when(some, ordered).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))}).drop("win")
    s = F.col("ordered")
    twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    df = once(df, {"at": F.sort_array(F.transform(twice, lambda x: x["i"]))}).drop("ordered")
    at = F.col("at")
    covered = F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return once(df, {"n_repeat_words": covered}).drop("at")


def scored(docs: DataFrame, table: list[int], text_col: str = "text", least: int | None = None) -> DataFrame:
    """Adds to ``docs`` a struct ``quality``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    llr (mean log ratio in thousandths, null without words) and kept. Without ``least`` no text fails by its ratio.

    Null and empty texts have no words and fail. Repeated rows have equal values. A column called ``quality`` is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cols = [c for c in docs.columns if c != "quality"]
    df = once(docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), text.alias("text")), {"w": words(F.col("text"))})
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    df = once(
        df.withColumn("lines", lines),
        {
            "n_words": F.size("w").cast("long"),
            "word_chars": (F.char_length("text") - F.regexp_count("text", F.lit(SPACE))).cast("long"),
            "n_symbols": F.regexp_count("text", F.lit(SIGNS)).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "grams": grams(F.col("w"), len(table)),
        },
    ).drop("text", "lines")
    df = once(df, {"llr": _ratio(F.col("grams"), table)}).drop("grams")
    df = _repeats(df).drop("w")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept = ~failed if least is None else ~failed & F.coalesce(F.col("llr") >= least, F.lit(False))
    q = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "llr", kept.alias("kept"))
    return df.select("row.*", q.alias("quality"))


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, least: int | None = None) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept and llr. An empty table gives no rows; other columns are not read.

    ``least`` is that of ``fitted`` unless it is given.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table, found = fitted(src, trusted, buckets=buckets)
    return scored(src, table, least=found if least is None else least).select("doc_id", "quality.*")
