"""Personal data: base patterns, then bootstrapped contextual extraction.

Matches of the base patterns are the seeds. The words before a seed are a lexical pattern; the values that occur after it are its
instances. Patterns and instances form a graph whose edges Spark counts and scores in rounds: a pattern is as good as its trusted
instances of one kind against instances of other kinds and values that can't be of that kind; values that can be, but are not
found yet, say nothing. An instance is as good as the patterns that lead to it together. Values of the loosened shape of a kind
that match no base pattern are taken as that kind after a pattern of high confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bodygrid.functions.once import once
from bodygrid.llm import spans
from bodygrid.llm.common import stored

KINDS = ["email", "ip", "card", "phone"]
# The base patterns, in forms that do not go back over what they have read.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: What may be an identifier: name@host, groups of digits with at least four, or a run of these signs with at least four digits.
TOKEN = (
    r"(?<![A-Za-z0-9@._%+-])(?:[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
    r"|(?=(?:[\x20().-]{0,3}+[0-9]){4})(?:\([0-9]{1,6}+\)[\x20.-]{0,2}+(?=[0-9]))?+[0-9]++(?![A-Za-z@_+])(?:[\x20().-]{1,3}+[0-9]++(?![A-Za-z@_+]))*+"
    r"|(?=(?:[A-Za-z@._+-]*+[0-9]){4})[A-Za-z0-9@._+-]++)"
)
#: Rounds of scoring; least confidence; least number of different trusted instances of a pattern.
ROUNDS = 3
CONFIDENT = 0.9
SUPPORT = 5
OCCURRENCE = "array<struct<kind:string,start:int,end:int,value:string,before:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _ok(kind: str):
    if kind == "ip":
        return lambda v: v.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return lambda v: F.char_length(_digits(v)).between(16, 19) & F.call_function("luhn_check", _digits(v))
    if kind == "phone":
        return lambda v: F.char_length(_digits(v)).between(8, 15)
    return None


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value, before) by kind, then start."""
    def of(kind: str) -> Column:
        got = spans.matches(text, PATTERNS[kind], _ok(kind), context=True)
        return F.transform(got, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["before"].alias("before")))

    found = [of(k) for k in KINDS]
    return F.concat(*found)


def _may_be(value: Column) -> Column:
    """Kinds whose loosened shape a value has that no base pattern finds."""
    n, digits = F.char_length(_digits(value)), ~value.rlike("[A-Za-z@]")
    shape = {"email": value.rlike("[A-Za-z]"), "ip": value.rlike(r"^[0-9]+(?:[\x20.-][0-9]+){3}$"), "card": digits & n.between(12, 19), "phone": digits & n.between(7, 15)}
    return F.array_compact(F.array(*[F.when(shape[k], F.lit(k)) for k in KINDS]))


def _tokens(text: Column, base: Column) -> Column:
    """Possible identifiers that touch no base span, without signs at their ends; kind is null."""

    def trimmed(s):
        v = F.regexp_replace(s["value"], r"^[._-]++|[._+-]++$", "")
        lead = F.char_length(s["value"]) - F.char_length(F.regexp_replace(s["value"], r"^[._-]++", ""))
        start = s["start"] + lead
        return F.struct(F.lit(None).cast("string").alias("kind"), start.alias("start"), (start + F.char_length(v)).alias("end"), v.alias("value"), s["before"].alias("before"))

    got = F.transform(spans.matches(text, TOKEN, context=True), trimmed)
    return spans.bound(got, lambda g: spans.apart(g, base))


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, base, loose: spans of one scan of the texts, written down; texts go no further."""
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = once(src, {"base": base_spans(F.col("text")).cast(OCCURRENCE)})
    return stored(src.select("row", "doc_id", "base", _tokens(F.col("text"), F.col("base")).cast(OCCURRENCE).alias("loose")))


def _patterns(before: Column) -> Column:
    """The last word, and the last two, of what stands before; of letters and digits, lower case."""
    w = F.regexp_extract_all(F.lower(before), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    one = F.get(w, F.size(w) - 1)
    return F.array_compact(F.array(one, F.when(F.size(w) > 1, F.concat_ws(" ", F.get(w, F.size(w) - 2), one))))


def _edges(rows: DataFrame) -> DataFrame:
    """(pattern, value, kind, n): how often each value stands after each pattern; kind is null for what no base pattern finds."""
    o = rows.select("row", F.explode(F.concat("base", "loose")).alias("o")).select("o.kind", "o.value", F.explode(_patterns(F.col("o.before"))).alias("pattern"))
    return stored(o.groupBy("pattern", "value", "kind").agg(F.count(F.lit(1)).alias("n")))


def pattern_scores(edges: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, confidence, instances) of the patterns that are confident after the rounds."""
    total = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    may = F.when(F.col("kind").isNull(), _may_be(F.col("value"))).otherwise(F.array("kind"))
    fits = edges.select("pattern", "n", F.explode(may).alias("kind")).groupBy("pattern", "kind").agg(F.sum("n").alias("fits"))
    against = stored(fits.join(total, "pattern").select("pattern", "kind", (F.col("total") - F.col("fits")).alias("against")))
    known = edges.filter("kind is not null").select("value", "kind").distinct().withColumn("trust", F.lit(1.0))
    good = None
    for k in range(rounds):
        held = edges.select("pattern", "value", "n", may.alias("may")).join(known, "value").filter(F.array_contains("may", F.col("kind")))
        score = held.groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("trust")).alias("held"), F.count(F.lit(1)).alias("instances"))
        score = score.filter(F.col("instances") >= support).join(against, ["pattern", "kind"])
        good = stored(score.select("pattern", "kind", F.round(F.col("held") / (F.col("held") + F.col("against") + 1), 9).alias("confidence"), "instances").filter(F.col("confidence") >= confident))
        if k + 1 == rounds or not good.limit(1).count():
            break
        # an unseen value is trusted as much as its patterns are together
        fresh = edges.filter("kind is null").select("pattern", "value").join(good, "pattern").filter(F.array_contains(_may_be(F.col("value")), F.col("kind"))).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))).alias("trust"))
        seeds = edges.filter("kind is not null").select("value", "kind").distinct().withColumn("trust", F.lit(1.0))
        known = stored(seeds.unionByName(fresh.select("value", "kind", F.round("trust", 9).alias("trust"))))
    return good


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ``base`` and ``added``: arrays of (kind, start, end, value, before) by kind, then start.

    Null text is empty. Repeated rows each have their spans. An empty table gives no rows; other columns are not read. Of two
    confident kinds for one value the more confident is taken, then the first by name.
    """
    rows = occurrences(docs, id_col, text_col)
    good = pattern_scores(_edges(rows))
    loose = rows.select("row", F.posexplode("loose").alias("nth", "o")).select("row", "nth", "o.start", "o.end", "o.value", "o.before", F.explode(_patterns(F.col("o.before"))).alias("pattern"))
    told = loose.join(good.select("pattern", "kind", "confidence"), "pattern").filter(F.array_contains(_may_be(F.col("value")), F.col("kind")))
    best = told.groupBy("row", "nth", "start", "end", "value", "before").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "kind")).alias("best"))
    one = F.struct(F.col("best.kind").alias("kind"), "start", "end", "value", "before")
    added = best.groupBy("row").agg(F.collect_list(one).alias("added"))  # no more than the tokens of one document
    out = rows.join(added, "row", "left")
    return out.select("doc_id", "base", F.coalesce("added", F.array().cast(OCCURRENCE)).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: counts and digest of the base spans, all spans as text by kind, then start."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(rank(s).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(F.encode(spans.written(F.col("base")), "UTF-8"), 256).alias("base_sha256"), spans.written(every).alias("spans"))
