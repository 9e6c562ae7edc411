"""Phrase collocations by dynamic counting: longer phrases start as soon as both their subphrases have reached the threshold.

Documents are dealt over a few shards, which are scanned in a cycle. A step scans one shard and counts in it all phrases whose
cycle is open, of every length at once. Words are open from the first step. A phrase that reaches the threshold at the end of a
step opens, from the next step on, the longer phrases whose other subphrase has got there too. Each phrase is counted over one
full cycle from where it was opened, so each shard once, and is then complete.

When a phrase was reached is kept in a table of fixed size, by hash. Phrases that share a place open what contains them at the
earlier time of both, but not before their own parts are open, as no step sees them until then; a cycle is then only begun earlier
or in vain, so counts are exact whatever the table's size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bodygrid.llm.common import new_path, remove, stored

SHARDS = 3
#: Places of the table, for each length, are two to this power.
PLACE_BITS = 22
#: Bytes of text counted together; a piece is never cut.
TOGETHER = 8 << 20
NOT_REACHED = 255
#: Parts in which a language is first ranked.
PARTS = 64
#: Bytes as they are in words, A-Z lower-cased; what ends a piece becomes a line feed, what ends a word a space.
PIECE_BYTES = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c in b" \t" else c + 32 if 65 <= c <= 90 else c for c in range(256))
COUNTS = "lang string, phrase string, k int, n bigint, until int"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)


def _more(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of phrases, each with a word more at its end."""
    h = (h ^ (word + (h << np.uint64(6)) + (h >> np.uint64(2)))) * _ODD
    return h ^ (h >> np.uint64(31))


def places(lang: str, phrases: list[list[bytes]], bits: int) -> list[int]:
    """Places of phrases of one length and language in the table."""
    start = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
    h = np.full(len(phrases), start, np.uint64)
    for words in zip(*phrases):
        h = _more(h, _hashes(list(words)))
    return (h >> np.uint64(64 - bits)).tolist()


def _cut(text: bytes, together: int) -> Iterator[bytes]:
    """Parts of about ``together`` bytes, ending where a piece ends."""
    low = 0
    while low < len(text):
        high = text.find(b"\n", low + together)
        high = len(text) if high < 0 else high + 1
        yield text[low:high]
        low = high


def _words(text: bytes) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of a translated text, and the number of the piece that each is in."""
    b = np.frombuffer(text, np.uint8)
    inside = (b != 10) & (b != 32)
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    piece = np.cumsum(b == 10, dtype=np.int32)[start]
    at = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=at[1:])
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(text.translate(None, b"\n "))])
    return words.dictionary_encode(), piece


def _numbered(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct value is first, the number of its value for every row), by a hash table instead of a sort."""
    number = pa.array(number).dictionary_encode().indices.to_numpy(zero_copy_only=False)  # in the order of appearance
    return np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1)), number


def _phrases(h: np.ndarray, at: np.ndarray, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``_numbered`` for phrases of ``k`` words that begin at ``at``, by their hashes where these tell them apart, else by their words."""
    first, number = _numbered(h)
    model = at[first][number]
    if all(np.array_equal(word[at + i], word[model + i]) for i in range(k)):
        return first, number
    number = word[at]
    for i in range(1, k):
        first, number = _numbered(number.astype(np.int64) << 32 | word[at + i])
    return first, number


def _counted(lang: str, text: bytes, reached: list[np.ndarray], step: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of a text whose cycle is open at ``step``."""
    coded, piece = _words(text)
    if not len(coded):
        return
    names, word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    hashed = _hashes(names.to_pylist())[word]
    size = len(names)
    start = np.full(len(word), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    h, at = _more(start, hashed), np.arange(len(word))  # of the phrases of k words that begin at ``at``
    since = np.zeros(len(word), np.int64)  # the first step that sees them here
    if step < shards:
        yield _rows(lang, names, [np.arange(size)], np.bincount(word, minlength=size), 1, np.full(size, shards - 1))
    bits = len(reached[0]).bit_length() - 1
    for k in range(2, len(reached) + 2):
        seen = reached[k - 2][(h >> np.uint64(64 - bits)).astype(np.int64)]  # when each was reached
        ok = seen != NOT_REACHED
        at, h = at[ok], h[ok]
        seen = np.maximum(seen[ok].astype(np.int64), since[ok])  # a shared place may be older than the phrase's own parts
        # a longer phrase: two reached ones that begin one word apart, within a piece
        follows = np.flatnonzero(np.diff(at) == 1)
        last = at[follows] + k - 1
        fits = last < len(piece)
        follows, last = follows[fits], last[fits]
        fits = piece[at[follows]] == piece[last]
        follows, last = follows[fits], last[fits]
        if not len(follows):
            return
        opened = np.maximum(seen[follows], seen[follows + 1])
        at, h, since = at[follows], _more(h[follows], hashed[last]), opened
        now = np.flatnonzero((opened <= step) & (step < opened + shards))
        if len(now):  # only these are told apart; of the others the hash is enough to find what contains them
            first, number = _phrases(h[now], at[now], word, k)
            where = now[first]
            yield _rows(lang, names, [word[at[where] + i] for i in range(k)], np.bincount(number), k, opened[where] + shards - 1)


def _rows(lang: str, names: pa.Array, words: list[np.ndarray], n: np.ndarray, k: int, until: np.ndarray) -> pa.RecordBatch:
    parts = [names.take(pa.array(w)).cast(pa.string()) for w in words]
    phrase = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
    return pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(lang, pa.string()), len(n)), phrase, pa.array(np.full(len(n), k), pa.int32()), pa.array(n, pa.int64()), pa.array(until, pa.int32())], ["lang", "phrase", "k", "n", "until"]
    )


def _scan(shard: DataFrame, reached: list[np.ndarray], step: int, shards: int, together: int) -> DataFrame:
    packed = [zlib.compress(r, 1) for r in reached]  # of fixed size, and mostly empty

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.frombuffer(zlib.decompress(p), np.uint8) for p in packed]
        for b in batches:
            held: dict[str, list[bytes]] = {}
            size: dict[str, int] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                t = text.as_py().encode().translate(PIECE_BYTES)
                held.setdefault(lang, []).append(t)
                size[lang] = size.get(lang, 0) + len(t)
                if size[lang] >= together:
                    for part in _cut(b"\n".join(held.pop(lang)), together):
                        yield from _counted(lang, part, tables, step, shards)
                    size[lang] = 0
            for lang, texts in held.items():
                for part in _cut(b"\n".join(texts), together):
                    yield from _counted(lang, part, tables, step, shards)

    return shard.mapInArrow(count, COUNTS)


def _at(found: DataFrame, bits: int) -> DataFrame:
    """(k, place) of phrases that were reached."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[tuple[str, int], list[list[bytes]]] = {}
            for lang, phrase, k in zip(*(b.column(i).to_pylist() for i in range(3))):
                out.setdefault((lang, k), []).append(phrase.encode().split(b" "))
            for (lang, k), phrases in out.items():
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(phrases), pa.int32()), pa.array(places(lang, phrases, bits), pa.int32())], ["k", "place"])

    return found.select("lang", "phrase", "k").mapInArrow(locate, "k int, place int").distinct()


def phrase_counts(docs: DataFrame, threshold: int, longest: int = 5, shards: int = SHARDS, lang_col: str = "lang", text_col: str = "text", place_bits: int = PLACE_BITS, together: int = TOGETHER) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, n) of the phrases of at most ``longest`` words with n >= ``threshold``, (lang, n) of all words).

    Null texts are empty, null languages ``und``; a repeated row counts again; an empty table has no rows; other columns are not read.
    A piece, the text between two marks, is counted at once however long it is.
    """
    spark = docs.sparkSession
    src = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts, previous = new_path(spark), None
    dealt = stored(src.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")), by="shard", path=texts, codec="zstd")
    reached = [np.full(1 << place_bits, NOT_REACHED, np.uint8) for _ in range(longest - 1)]
    state = spark.createDataFrame([], COUNTS)
    complete, totals, last, step = [], [], shards - 1, 0
    while step <= last:
        here = dealt.filter(F.col("shard") == step % shards).select("lang", "text")
        added = state.filter(F.col("until") >= step).unionByName(_scan(here, reached, step, shards, together))
        current = new_path(spark)
        state = stored(added.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n"), F.max("until").alias("until")), path=current)
        if previous:  # all of it that lasts is in the new table, or was written when it ended
            remove(spark, previous)
        previous = current
        ended = state.filter(F.col("until") == step)
        complete.append(stored(ended.filter(F.col("n") >= threshold).select("lang", "phrase", "k", "n")))
        if step == shards - 1:
            totals = stored(ended.filter("k = 1").groupBy("lang").agg(F.sum("n").alias("n")))
        fresh = 0
        for r in _at(state.filter((F.col("n") >= threshold) & (F.col("k") < longest)), place_bits).toLocalIterator():  # at most a row for each place of the table
            if reached[r["k"] - 1][r["place"]] == NOT_REACHED:
                reached[r["k"] - 1][r["place"]] = step + 1
                fresh += 1
        last = step + shards if fresh else last
        step += 1
        if step >= NOT_REACHED:
            raise RuntimeError("more steps than the table can tell apart")
    for done in (texts, previous):
        remove(spark, done)
    found = complete[0]
    for c in complete[1:]:
        found = found.unionByName(c)
    return stored(found), totals


def collocations(docs: DataFrame, threshold: int = 100, longest: int = 5, top: int = 2000, shards: int = SHARDS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` phrases of 2 to ``longest`` words with a >= ``threshold``.

    A phrase cut after its first words gives l and r, the counts of both parts, and floor(1000 * a * n / (l * r)) with n the words of
    the language; the cut with the least score counts, of equal ones the first. Phrases within a longer one that is as frequent are
    left out. Nulls, empty and repeated rows and empty tables: as for ``phrase_counts``.
    """
    counts, totals = phrase_counts(docs, threshold, longest, shards, lang_col, text_col)
    phrases = counts.filter("k > 1").withColumnRenamed("n", "a").withColumn("w", F.split("phrase", " "))

    def words(first, n):
        return F.array_join(F.slice("w", first, n), " ")

    longer = phrases.filter("k > 2").select(
        "lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: words(i, m))))).alias("phrase")
    ).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < a").drop("longer")
    cuts = kept.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(i.alias("i"), words(F.lit(1), i).alias("left"), words(i + 1, F.col("k") - i).alias("right")))).alias("c"))
    cuts = cuts.select("lang", "phrase", "a", "c.*")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    cuts = cuts.join(totals, "lang")
    big = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r", "n")}
    scored = cuts.withColumn("num", (big["a"] * big["n"]).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("den", big["l"] * big["r"]).withColumn("score", F.expr("num div den"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "i", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    for keys in (["lang", "part"], ["lang"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
