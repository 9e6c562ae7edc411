"""Ranked search, byte-level BPE and phrase collocations against brute force, and spans of texts with very many matches."""

import collections
import hashlib
import math
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from bodygrid.llm import bpe, collocations, pii, search, secrets, spans

SCHEMA = "doc_id bigint, text string, lang string, score string, rank string, n string, phrase string"
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary, n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 5))) for _ in range(60)]
    texts = [None, "", " \n", "a", "A a,A", prose(rng, 9000, vocabulary), "x" * 20000, "aé\U0001f600 b\x00c", "the end. the end! The End; the"]
    texts += [prose(rng, int(rng.integers(1, 80)), vocabulary) + (". " if i % 3 else " \t") + prose(rng, 5, vocabulary) for i in range(150)]
    out = [(i if i != 12 else None, t, ("en", "fr", None)[i % 3], "s", "r", "n", "p") for i, t in enumerate(texts)]
    return out + [out[5], out[20], out[20], (None, texts[21], "en", "s", "r", "n", "p")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def ranked(rows, items, top=10):
    docs = [(r[0], TERM.findall(lower(r[1]))) for r in rows]
    n_docs, n_terms = sum(1 for _, w in docs if w), sum(len(w) for _, w in docs)
    df = collections.Counter(t for _, w in docs for t in set(w))
    out = []
    for item, text in items:
        got = []
        for i, w in docs:
            tf, m = collections.Counter(w), 10 + (90 * len(w) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in set(TERM.findall(lower(text))) if tf[t])
            if s > 0:
                got.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(got, key=lambda x: x[:2] if x[1] else x)[:top])]
    return out


def test_search(spark, rows, docs, none, monkeypatch):
    items = [(1, rows[30][1]), (2, rows[31][1] + " " + rows[40][1]), (3, None), (4, "?!"), (5, "nothinglikeit"), (5, "THE a é"), (None, rows[50][1]), (7, rows[5][1])]
    queries = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id int, text string, doc_id int, score int")
    want = collections.Counter(ranked(rows, items))
    assert collections.Counter(tuple(r) for r in search.search(docs, queries).collect()) == want
    # small batches, strides and blocks of queries: the same rows
    monkeypatch.setattr(search, "BLOCK_TERMS", 30)
    for short in (0, 0.3, 2):
        batch = {"STRIDE": 16, "SHORT": short}
        got = collections.Counter()
        for item, text in items:
            got += collections.Counter((item, *x) for x in _locally(rows, text, batch))
        assert got == want
    assert collections.Counter(tuple(r) for r in search.search(docs, queries).collect()) == want
    assert search.search(none, queries).count() == 0
    assert search.search(docs, queries.limit(0)).count() == 0


def _locally(rows, text, settings):
    """(rank, doc_id, score) by the batch algorithm itself with other sizes."""
    import pyarrow as pa

    docs = sorted(((r[0], TERM.findall(lower(r[1]))) for r in rows), key=lambda x: (x[0] is None, x[0] or 0))
    numbers = {t: i for i, t in enumerate(sorted(set(TERM.findall(lower(text)))))}
    n_docs, n_terms = sum(1 for _, w in docs if w), sum(len(w) for _, w in docs)
    found = [collections.Counter(numbers[t] for t in w if t in numbers) for _, w in docs]
    weights = np.array([search.weight(n_docs, sum(1 for f in found if i in f)) for i in range(len(numbers))], np.int64)
    b = pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in docs], pa.int64()), pa.array([len(w) for _, w in docs], pa.int64()), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))],
        ["doc_id", "n", "term", "tf"],
    )
    old = {k: getattr(search, k) for k in settings}
    try:
        for k, v in settings.items():
            setattr(search, k, v)
        batch = search.Batch(b, weights, n_docs, n_terms)
        got = sorted(search.best(batch, np.arange(len(numbers)), 10, 0), key=lambda x: (-x[1], x[0]))[:10]
    finally:
        for k, v in old.items():
            setattr(search, k, v)
    return [(k + 1, batch.ids[d].as_py(), s) for k, (d, s) in enumerate(got)]


def test_bpe(spark, rows, docs, none):
    rng = np.random.default_rng(4)
    hard = ["".join(rng.choice(list(a), n)) for a in ("ab", "abcdefgh", "theanding ") for n in (3, 40, 64, 65, 300)]
    hard += ["abab" * 99, "aaaa" * 40 + "bcbc" * 30, "the" * 200, "的一是不了人我在有他这" * 20, "a  　\xa0 \x85 b \n\n c", "'s'LL don't 12345 x1 \x01\x02", "<|endoftext|>", "ñ́ \U0001f469‍\U0001f469"]
    more = docs.unionByName(spark.createDataFrame([(1000 + i, t, "", "", "", "", "") for i, t in enumerate(hard)], SCHEMA))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(BYTES), special_tokens={})

    def want(i, t):
        ids = enc.encode_ordinary(t or "")
        return i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    got = bpe.digest(more, BYTES, public_tokenizers.PATTERN).collect()
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(want(r.doc_id, r.text) for r in more.collect())
    assert bpe.digest(none, BYTES, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_another_vocabulary(spark):
    """A rank map whose merges overlap: one at a time and all at once must agree with the plain algorithm."""
    rng = np.random.default_rng(8)
    letters = [b"a", b"b", b"c"]
    words = {b"".join(rng.choice(letters, rng.integers(2, 6))) for _ in range(120)}
    vocabulary = {w: i for i, w in enumerate(letters + [words_ for words_ in rng.permutation(sorted(words))])}
    vocabulary |= {bytes([b]): len(vocabulary) + b for b in range(256) if bytes([b]) not in vocabulary}
    enc = tiktoken.Encoding("small", pat_str=r"[abc]+", mergeable_ranks=vocabulary, special_tokens={})
    texts = ["".join(rng.choice(list("abc"), n)) for n in (5, 30, 60, 70, 120, 200) for _ in range(6)] + ["a" * 100, "ab" * 60, "abc" * 40, "c"]
    e = bpe.Encoder(vocabulary, "[abc]+")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name in ("folded", "swept"):
        tokens = bpe.bound(e.pairs, lambda t: getattr(bpe.Merges(t, e.singles), name)(F.col("t")))
        for r in df.select("t", tokens.alias("s")).collect():
            if len(r.t) == 1 or r.t.encode() not in vocabulary:
                assert r.s[1:-1] == "".join(map(bpe.sign, enc.encode_ordinary(r.t))), (name, r.t)


def test_bpe_texts_stay_in_their_rows(spark, docs):
    sc = spark.sparkContext
    sc.setJobGroup("bpe", "bpe")
    ids = bpe.encoded(docs, BYTES, public_tokenizers.PATTERN)
    assert ids.columns == ["doc_id", "ids_text", "ids"] and not sc.statusTracker().getJobIdsForGroup("bpe")  # no counts are gathered first
    vocabulary = bpe.ranks(BYTES)
    long = "".join(np.random.default_rng(2).choice(list("theandingos"), 30_000))
    assert bpe.merged(long.encode(), vocabulary) == tiktoken.Encoding("own", pat_str=r"\p{L}+", mergeable_ranks=vocabulary, special_tokens={}).encode_ordinary(long)


def phrases(rows, threshold, longest=5, top=2000):
    count, total = collections.Counter(), collections.Counter()
    for r in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(r[1])):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[r[2] or "und"] += len(w)
            for k in range(1, longest + 1):
                count.update((r[2] or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    frequent = {p: c for p, c in count.items() if c >= threshold}
    out = collections.defaultdict(list)
    for (lang, w), a in frequent.items():
        if len(w) < 2:
            continue
        inside = any(c >= a and g == lang and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1)) for (g, x), c in frequent.items() if len(x) > len(w))
        if not inside:
            cuts = [(1000 * a * total[lang] // (frequent[lang, w[:i]] * frequent[lang, w[i:]]), i, frequent[lang, w[:i]], frequent[lang, w[i:]]) for i in range(1, len(w))]
            score, _, left, right = min(cuts)
            out[lang].append((-score, -a, " ".join(w).encode(), left, right, total[lang]))
    return [(lang, k + 1, p.decode(), -a, left, right, n, -s) for lang, got in out.items() for k, (s, a, p, left, right, n) in enumerate(sorted(got)[:top])]


@pytest.mark.parametrize("shards", [1, 3])
def test_collocations(docs, none, rows, shards):
    want = phrases(rows, 6)
    assert max(len(w[2].split()) for w in want) >= 3
    assert sorted(map(tuple, collocations.collocations(docs, threshold=6, shards=shards).collect())) == sorted(want)
    assert collocations.collocations(none, threshold=6).count() == 0
    assert sorted(map(tuple, collocations.collocations(docs, threshold=6, shards=shards, top=4).collect())) == sorted(phrases(rows, 6, top=4))


def test_counts_do_not_depend_on_the_size_of_the_table(docs):
    got = [sorted(map(tuple, collocations.phrase_counts(docs, 6, shards=2, place_bits=bits, together=n)[0].collect())) for bits, n in ((22, 1 << 20), (4, 10))]
    assert got[0] == got[1] and got[0]


@pytest.mark.parametrize("seed", [19, 44, 47])
def test_shared_places_never_shorten_a_cycle(spark, seed):
    """Few words and a table of 32 places: a place may be taken before the words of a phrase have been reached."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)]
    texts = [" ".join(r.choices(vocabulary, weights=[r.random() ** 3 + 0.01 for _ in vocabulary], k=3000)) for _ in range(3)]
    docs = spark.createDataFrame([("x", t) for t in texts], "lang string, text string").coalesce(1)
    want = collections.Counter(" ".join(w[i : i + k]) for w in map(str.split, texts) for k in range(1, 6) for i in range(len(w) - k + 1))
    got = collocations.phrase_counts(docs, 20, place_bits=5)[0].collect()
    assert {x.phrase: x.n for x in got} == {p: n for p, n in want.items() if n >= 20} and len(got) > 200


def test_time_of_spans_grows_with_the_matches(spark):
    def seconds(n, f, unit):
        df = spark.createDataFrame([(1, unit * n)], "doc_id bigint, text string")
        t = time.time()
        assert f(df).collect()[0][0] == n
        return time.time() - t

    for f, unit in (
        (lambda d: d.select(F.size(spans.matches(F.col("text"), pii.PATTERNS["email"]))), "a@b.cde "),
        (lambda d: secrets.digest(secrets.find_secrets(d)).select("n_assign"), "token=abcdef12 "),
        (lambda d: pii.digest(pii.find_personal_data(d)).select("n_email"), "mail a@b.cde call 2020-1234567 "),
    ):
        seconds(8_000, f, unit)  # code is compiled
        assert seconds(128_000, f, unit) < 16 * seconds(8_000, f, unit) + 5


def test_spans_and_overlaps(spark):
    rng = np.random.default_rng(2)
    got = spark.createDataFrame([([int(x) for x in rng.integers(0, 9, n)],) for n in (0, 1, 63, 64, 65, 5000)], "v array<int>").select("v", spans.sums_before(F.col("v")).alias("s")).collect()
    for r in got:
        assert r.s == [sum(r.v[:i]) for i in range(len(r.v))]
    pairs = lambda n: [(int(s), int(s + e)) for s, e in zip(rng.integers(0, 200, n), rng.integers(1, 9, n))]
    rows = [(pairs(a), pairs(b)) for a, b in ((0, 0), (5, 0), (0, 5), (40, 1), (40, 15), (40, 33))]
    kind = "array<struct<start:int,end:int>>"
    for r in spark.createDataFrame(rows, f"a {kind}, b {kind}").select("a", "b", spans.apart(F.col("a"), F.col("b")).alias("c")).collect():
        assert r.c == [x for x in r.a if not any(y.start < x.end and x.start < y.end for y in r.b)]


def test_phrases_are_told_apart_by_their_words_where_hashes_meet():
    word = np.array([3, 1, 3, 1, 2, 3, 1])
    at = np.arange(6)
    for h in (np.array([5, 6, 5, 7, 8, 5], np.uint64), np.zeros(6, np.uint64)):
        first, number = collocations._phrases(h, at, word, 2)
        assert first.tolist() == [0, 1, 3, 4] and number.tolist() == [0, 1, 0, 2, 3, 0]


def test_phrases_are_numbered_only_while_their_cycle_is_open(monkeypatch):
    asked = []
    monkeypatch.setattr(collocations, "_phrases", lambda h, *a, f=collocations._phrases: asked.append(len(h)) or f(h, *a))
    reached = [np.full(1 << 10, collocations.NOT_REACHED, np.uint8) for _ in range(4)]
    reached[0][collocations.places("en", [[b"a"], [b"b"]], 10)] = 1
    text = b"a b a b\nb a c a b"
    got = [sorted((r["phrase"], r["n"], r["until"]) for b in collocations._counted("en", text, reached, step, 3) for r in b.to_pylist() if r["k"] == 2) for step in range(5)]
    pairs = [("a b", 3, 3), ("b a", 2, 3)]
    assert got == [[], pairs, pairs, pairs, []] and asked == [5, 5, 5]
