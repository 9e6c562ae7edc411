"""Language of a text by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its words' subwords (character n-grams with word ends, hashed into buckets), then a
linear layer and a softmax. Training is stochastic gradient descent in numpy over a sample of at most ``per_language`` distinct
labelled texts per language: that is the documented bound of what the driver holds. A part of the sample is held back to set the
temperature and the rejection threshold. Subwords are hashed and counted by numpy over the whole text, in blocks of words, so
predicting is linear in the text however many different words there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 15
WIDTH = 16
SHORTEST, LONGEST = 2, 4
#: Distinct texts per language in the sample, or all if it has fewer.
PER_LANGUAGE = 400
ROUNDS = 12
RATE = 0.5
#: Step of the embeddings by that of the linear layer: a bucket has a small share of a text.
EMBED_RATE = 50.0
#: Share of the sample that sets temperature and threshold; precision of what is not rejected there.
HELD_BACK = 0.25
PRECISION = 0.99
#: Words that are hashed together; bounds the memory of a long text.
TOGETHER = 50_000


def _buckets(words: list[str]) -> Iterator[np.ndarray]:
    """Buckets of the words' n-grams by length, word ends marked.

    One mark stands between two words, as end and as start: an n-gram may begin or end with it, but not run over it.
    """
    codes = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    mark = codes == 10
    h, whole = codes, np.ones(len(codes), bool)
    for n in range(2, LONGEST + 1):
        h = h[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        whole = whole[:-1] & ~mark[n - 2 : -1] if n > 2 else whole[:-1]
        if n >= SHORTEST:
            yield (((h ^ np.uint32(n)) * np.uint32(2654435769)) >> np.uint32(32 - BUCKETS.bit_length() + 1))[whole]


def _blocks(text: str) -> Iterator[np.ndarray]:
    words = text.lower().split()
    for k in range(0, len(words), TOGETHER):
        yield np.concatenate(list(_buckets(words[k : k + TOGETHER])))


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket x language: embedding times linear layer
    bias: np.ndarray
    temperature: float
    least: float  # probability under which a prediction is rejected


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    n = np.zeros(BUCKETS, np.int64)
    for b in _blocks(text):
        n += np.bincount(b, minlength=BUCKETS)
    keys = np.flatnonzero(n)
    return keys.astype(np.int32), n[keys].astype(np.float32)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, buckets, counts) of a bounded sample by hash of the text; needs the columns text and lang without nulls.

    Whole texts are read. A text counts once per language, however many copies it has. A language has ``per_language`` rows, or one
    for each of its texts if it has fewer.
    """
    pairs = docs.select("lang", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    sizes = {r["lang"]: r["n"] for r in pairs.select("lang", "h1", "h2").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not sizes:
        return []
    # twice as many as are taken are expected; a language of no more than that is here whole
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, 2 * max(per_language, 100) / n))])
    draw = F.pmod("h1", F.lit(1 << 30))
    some = pairs.filter(draw / F.lit(float(1 << 30)) < share[F.col("lang")])
    # copies meet before the shuffle
    some = some.groupBy("lang", "h1", "h2").agg(F.first("text").alias("text"))
    some = some.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(draw, "h1", "h2"))).filter(F.col("nth") <= per_language)

    def count(batches):
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                keys, n = _features(text.as_py())
                yield pa.RecordBatch.from_pydict({"lang": [lang], "h": pa.array([zlib.crc32(keys.tobytes())], pa.int64()), "keys": pa.array([keys.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary())})

    got = some.select("lang", "text").mapInArrow(count, "lang string, h bigint, keys binary, n binary").collect()  # no more than ``per_language`` a language
    return [(r["lang"], np.frombuffer(r["keys"], np.int32), np.frombuffer(r["n"], np.float32)) for r in sorted(got, key=lambda r: (r["lang"], r["h"], bytes(r["keys"]), bytes(r["n"])))]


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """A model of the sample's languages; of one language it always says that one. ValueError without any."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        raise ValueError("no labelled text to learn from")
    rng = np.random.default_rng(seed)
    at = {x: i for i, x in enumerate(languages)}
    order = rng.permutation(len(rows))
    back = set(order[: int(len(rows) * HELD_BACK)].tolist()) if len(rows) >= 8 * len(languages) else set()
    data = [(at[lang], keys, n / max(n.sum(), 1)) for lang, keys, n in rows]
    weight = np.bincount([d[0] for d in data], minlength=len(languages))
    weight = len(data) / np.maximum(weight, 1) / len(languages)  # rare languages count as much
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    lin, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    own = np.array([i for i in range(len(data)) if i not in back])
    for k in range(ROUNDS):
        rate = RATE * (1 - k / ROUNDS)
        for i in rng.permutation(own):
            y, keys, share = data[i]
            mean = share @ emb[keys] if len(keys) else np.zeros(WIDTH, np.float32)
            z = mean @ lin + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= rate * min(weight[y], 5.0)
            down = lin @ p
            lin -= np.outer(mean, p)
            bias -= 0.1 * p
            if len(keys):
                emb[keys] -= EMBED_RATE * share[:, None] * down
    scores = emb @ lin
    held = [data[i] for i in sorted(back)] or data
    logits = np.array([(share @ scores[keys] if len(keys) else 0) + bias for _, keys, share in held])
    truth = np.array([y for y, _, _ in held])
    loss = {t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in (0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0)}
    temperature = min(loss, key=lambda t: (round(loss[t], 6), t))
    p = _softmax(logits / temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == truth
    by = np.argsort(-top)
    precise = np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= PRECISION
    least = float(top[by][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    return Model(languages, scores.astype(np.float32), bias.astype(np.float32), float(temperature), min(least, 0.99))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def say(model: Model, text: str | None) -> tuple[str, float, bool]:
    """Language, its probability, and whether the prediction is rejected. Without a letter: und, 0, rejected."""
    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    total, n = np.zeros(len(model.languages)), 0
    for b in _blocks(text):
        total += np.ones(len(b), np.float32) @ model.scores.take(b, axis=0)
        n += len(b)
    p = _softmax((total / n + model.bias) / model.temperature)
    best = int(p.argmax())
    return model.languages[best], float(p[best]), bool(p[best] < model.least)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score, rejected. Only the text is read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by buckets and languages

    def run(batches):
        for b in batches:
            out = [say(sent.value, t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, rejected.

    Learns from rows with text and language whose crc32 of the id, as text, leaves no 1 by 3 (a null id is not held out). Null
    texts and texts without a letter are ``und`` with score 0. Repeated rows are predicted alike. An empty table gives no rows;
    where nothing can be learned, every text is ``und``. Other columns are not read.
    """
    held = F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
    known = docs.filter(~held & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = sample(known, per_language)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if not rows:
        return docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    got = predict(src, train(rows))
    out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
    return got.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")
