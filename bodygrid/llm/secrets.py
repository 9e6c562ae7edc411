"""Secret scans over a trigram inverted index.

From each rule's regex a Boolean query of trigrams is derived that every match must satisfy. Postings hold which documents have
which of these trigrams; intersecting them gives the candidates of each rule, and only these are searched with the regex. A rule
without mandatory trigrams has the query "true" and searches every document. The index is over lower-case texts, so that one
serves rules of either case.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bodygrid.functions.once import once
from bodygrid.llm import spans
from bodygrid.llm.common import stored

#: Strings and alternatives up to which a regex is followed; beyond, the query is weaker, never wrong.
MOST_STRINGS = 16
MOST_ALTERNATIVES = 64

TRUE = [frozenset()]


@dataclass
class Rule:
    """``regex``: what the query is derived from; ``java``: the same matches, without backtracking, if the regex itself has some;
    ``group``: the part whose length is tested."""

    kind: str
    regex: str
    java: str | None = None
    least: int = 0
    group: int = 0
    query: list[frozenset] = field(init=False)

    def __post_init__(self):
        self.query = trigram_query(self.regex)


def trigram_query(regex: str) -> list[frozenset]:
    """Alternatives, each a set of trigrams that must all be there. One empty alternative: nothing is mandatory."""
    exact, query = _follow(sre_parser.parse(regex))
    return _both(query, _of(exact)) if exact is not None else query


def _of(strings: set[str]) -> list[frozenset]:
    """Query of a text that holds one of the strings."""
    if not strings or any(len(s) < 3 for s in strings):
        return TRUE
    return _least([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


def _least(alternatives: list[frozenset]) -> list[frozenset]:
    """Without alternatives that another one implies."""
    own = set(alternatives)
    return sorted((a for a in own if not any(b < a for b in own)), key=sorted)


def _both(x: list[frozenset], y: list[frozenset]) -> list[frozenset]:
    if x == TRUE or y == TRUE:
        return y if x == TRUE else x
    return _least([a | b for a in x for b in y]) if len(x) * len(y) <= MOST_ALTERNATIVES else min(x, y, key=len)


def _follow(nodes) -> tuple[set[str] | None, list[frozenset]]:
    """(all strings the part can match, lower-cased, if few; else None, query of what precedes)."""
    run, query, all_exact = {""}, TRUE, True
    for op, arg in nodes:
        exact, inner = _one(op, arg)
        if exact is not None and len(run) * len(exact) <= MOST_STRINGS:
            run = {a + b for a in run for b in exact}
            query = _both(query, inner)
            continue
        query, all_exact = _both(_both(query, _of(run)), inner), False
        run = exact if exact is not None and len(exact) <= MOST_STRINGS else {""}
    if all_exact:
        return run, query
    return None, _both(query, _of(run))


def _one(op, arg) -> tuple[set[str] | None, list[frozenset]]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, TRUE
    if op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
        return {""}, TRUE
    if op is sre.IN:
        chars = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < MOST_STRINGS:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, TRUE
        return (chars if len(chars) <= MOST_STRINGS else None), TRUE
    if op is sre.SUBPATTERN:
        return _follow(arg[-1])
    if op is sre.BRANCH:
        got = [_follow(b) for b in arg[1]]
        if all(e is not None for e, _ in got) and sum(len(e) for e, _ in got) <= MOST_STRINGS and all(q == TRUE for _, q in got):
            return set().union(*(e for e, _ in got)), TRUE
        each = [_both(q, _of(e)) if e is not None else q for e, q in got]
        return None, TRUE if any(q == TRUE for q in each) or sum(map(len, each)) > MOST_ALTERNATIVES else _least([a for q in each for a in q])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, inner = arg
        exact, query = _follow(inner)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, TRUE
        if low == high and exact is not None and len(exact) == 1:
            return {next(iter(exact)) * low}, query
        if low == 0:
            return None, TRUE
        return None, _both(query, _of(exact)) if exact is not None else query
    return None, TRUE


# The base rules, then rules of published key formats. Kinds come in this order.
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = [
    Rule("assign", _ASSIGN, _ASSIGN.replace(r"\x20*", r"\x20*+").replace("=-]+", "=-]++"), 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}", r"AKIA[A-Z0-9]{16,}+"),
    Rule("hex", r"[0-9a-f]{24,}", r"(?<![0-9a-f])[0-9a-f]{24,}+"),
    Rule("private_key", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
]
BASE = 3


def postings(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(trigram, doc_id): which documents have which of the trigrams that the rules ask for. Their number is the rules', not the
    corpus'."""
    asked = sorted({t for r in rules for a in r.query for t in a})
    low = once(docs, {"low": F.lower("text")})
    have = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in asked])) if asked else F.array().cast("array<string>")
    return low.select("doc_id", F.explode(have).alias("trigram")).select("trigram", "doc_id")


def candidates(index: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, rules): for each document the rules with an alternative all of whose trigrams it has."""
    spark = index.sparkSession
    asked = [(r.kind, i, t, len(a)) for r in rules for i, a in enumerate(r.query) for t in sorted(a)]
    if not asked:
        return index.select("doc_id", F.array().cast("array<string>").alias("rules")).limit(0)
    q = F.broadcast(spark.createDataFrame(asked, "kind string, alternative int, trigram string, needs int"))  # a row per trigram of a rule
    # rows that repeat an id would count a trigram twice
    hits = index.distinct().join(q, "trigram").groupBy("doc_id", "kind", "alternative", "needs").agg(F.count(F.lit(1)).alias("n"))
    return hits.filter("n = needs").groupBy("doc_id").agg(F.collect_set("kind").alias("rules"))  # at most as many as there are rules


def _found(text: Column, rule: Rule, rank: int) -> Column:
    pattern = rule.java or rule.regex
    long_enough = lambda v: F.char_length(F.regexp_extract(v, pattern, rule.group)) >= rule.least
    got = spans.matches(text, pattern, long_enough if rule.least else None)
    return F.transform(got, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Per row: doc_id and ``found``, an array of (start, rank, kind, end, value) by start, then by the order of the rules.

    Null text is empty. Rows that repeat an id share their candidate rules, which are verified on each row's own text; null ids
    do so too. An empty table gives no rows; other columns are not read.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    some = stored(candidates(postings(src, rules), rules))
    rows = src.join(some.withColumnRenamed("doc_id", "id"), src["doc_id"].eqNullSafe(F.col("id")), "left").select("doc_id", "text", "rules")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string>>")
    parts = []
    for rank, r in enumerate(rules):
        got = _found(F.col("text"), r, rank)
        parts.append(got if r.query == TRUE else F.when(F.array_contains("rules", r.kind), got).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: counts and digest of the base kinds, all spans as text."""
    base = F.filter("found", lambda s: s["rank"] < BASE)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(r.kind) for r in RULES[:BASE]], F.sha2(F.encode(spans.written(base), "UTF-8"), 256).alias("base_sha256"), spans.written(F.col("found")).alias("spans"))
