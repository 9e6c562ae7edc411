"""Protected windows in a corpus against brute force."""

import numpy as np

from bodygrid.operators import citations, winnow

PROTECTED = "item_id string, text string, doc_id int, hash int"
CORPUS = "doc_id bigint, text string, item_id int, window int"


def expected(items, docs, width, stride):
    out = {}
    for item, text in items:
        if text is None or len(text) < width:
            out[item, None] = 0
            continue
        windows = {text[i : i + width] for i in range(0, len(text) - width + 1, stride)}
        for doc, body in docs:
            if n := sum(w in (body or "") for w in windows):
                out[item, doc] = n
    return out


def test_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("ab \u00e9\U0001f600xyz"), n))
    passages = [text(int(n)) for n in rng.integers(64, 700, 30)]
    items = [(f"i{k}", p) for k, p in enumerate(passages)] + [("short", "x" * 63), ("none", None), ("empty", ""), ("flat", "a" * 200), ("edge", text(64))]
    docs = [(0, None), (1, ""), (2, "a" * 63), (3, "a" * 5000), (4, items[-1][1]), (5, passages[0][1:])]
    for k in range(6, 120):
        p = passages[int(rng.integers(30))]
        low = int(rng.integers(0, len(p) // 2))
        docs.append((k, text(int(rng.integers(0, 300))) + p[low : low + int(rng.integers(40, 500))] + text(int(rng.integers(0, 300)))))
    protected = spark.createDataFrame([(*i, 1, 2) for i in items], PROTECTED)
    corpus = spark.createDataFrame([(*d, 1, 2) for d in docs], CORPUS).repartition(3)
    want = expected(items, docs, 64, 32)
    assert sum(v > 0 for v in want.values()) > 60
    for block in (winnow.BLOCK, 50):  # blocks that cut windows lose none
        got = citations.leaked_windows(protected, corpus, block=block).collect()
        assert {(r["item_id"], r["doc_id"]): r["windows"] for r in got} == want and len(got) == len(want)
        assert {r["item_id"] for r in got if r["reason"]} == {"short", "none", "empty"}
    assert citations.leaked_windows(protected, corpus.limit(0)).filter("reason IS NULL").count() == 0
    assert citations.leaked_windows(protected.limit(0), corpus).count() == 0


def test_few_stretches_leave_the_scan(spark):
    rng = np.random.default_rng(6)
    plain = ["".join(rng.choice(list("abcdefgh"), 5000)) for _ in range(20)]
    leaked = plain[3][1000:1100]
    protected = spark.createDataFrame([("a", leaked)], "item_id string, text string")
    corpus = spark.createDataFrame(list(enumerate(plain)), "doc_id int, text string")
    bits = winnow.bitmap(winnow.probes(protected, 64, 32).select("hash"))
    rows = winnow.stretches(corpus, bits, 64).collect()
    assert 1 <= len(rows) <= 8  # of about 100,000 positions
    assert any(leaked[:64] in r["stretch"] for r in rows)


def test_equal_windows_have_equal_names():
    rng = np.random.default_rng(7)
    a, b = ("".join(rng.choice(list("abcd\u4e2d"), 500)) for _ in range(2))
    whole = winnow.least_hashes(a + b, 64)
    assert (winnow.least_hashes(b, 64) == whole[500:]).all() and len(set(whole.tolist())) < len(whole) / 8
