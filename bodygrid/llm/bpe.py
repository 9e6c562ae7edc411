"""Byte-level BPE by ranked merges.

A task cuts each whole text by the vocabulary's pattern and remembers the ids of its pieces, a bounded number; a new piece
is merged over a heap of the ranks of its neighbours, in time that grows little faster than the piece. Texts don't leave their rows,
so nothing is shuffled and the driver gets nothing. Decoding looks up the bytes of each id and concatenates them.

``Merges`` says the same merges as column expressions, for sessions without Python tasks: the bytes of a piece are a string of one
character per token, in each round the neighbours of the least rank become one, and ranks are looked up in a literal map of pairs,
one short string for each of 2^16 hash places.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bodygrid.llm.spans import bound

#: Places of the literal maps.
PLACES = 1 << 16
#: Pieces that a task remembers before it starts afresh, and their longest length in characters; bounds memory, never changes a result.
REMEMBERED = 1 << 18
LONGEST_REMEMBERED = 32
#: Texts whose ids leave a task together.
TOGETHER = 256
#: Pieces of more bytes merge, as expressions, all equal neighbours in a round, so that rounds are few.
SHORT = 64
#: Characters for what is beside a piece, and for the rank of a pair that is no token; tokens are written as characters between.
EDGE, NONE = "\x01", "\U0010ffff"
#: Marks a key in the literal.
START = "\x02"
FIRST, SURROGATES, N_SURROGATES = 0x100, 0xD800, 0x800
#: White space of the vocabulary's pattern, which is that of Unicode.
BLANK = r"\t-\r\x20\x85\xA0  -     　"


def spelled(pattern: str) -> str:
    """The pattern with its white space spelled out: Python's own has four more characters."""
    return pattern.replace(r"[^\s", rf"[^{BLANK}").replace(r"\S", rf"[^{BLANK}]").replace(r"\s", rf"[{BLANK}]")


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:  # a vocabulary of the driver's machine: a parameter, not input
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def sign(token: int) -> str:
    """The character of a token; their order is that of the ids."""
    c = token + FIRST
    return chr(c if c < SURROGATES else c + N_SURROGATES)


def _pairs(vocabulary: dict[bytes, int]) -> dict[str, str]:
    """The merged token of each pair of tokens that has one."""
    return {sign(vocabulary[w[:i]]) + sign(vocabulary[w[i:]]): sign(t) for w, t in vocabulary.items() for i in range(1, len(w)) if w[:i] in vocabulary and w[i:] in vocabulary}


def _place(s: Column) -> Column:
    return F.pmod(F.crc32(F.encode(s, "UTF-8")), F.lit(PLACES)).cast("int")


def _literal(entries: dict[str, str]) -> Column:
    """``entries`` as a constant: at each place one string of the keys that are hashed to it, each with its value."""
    texts = [""] * PLACES
    for k, v in entries.items():
        texts[zlib.crc32(k.encode()) % PLACES] += START + k + v
    return F.from_json(F.lit(json.dumps(texts, ensure_ascii=False)), "array<string>")


class Merges:
    """Merges of one vocabulary, as expressions. ``pairs`` is a lambda variable, so that the constant stands in a plan only once."""

    def __init__(self, pairs: Column, singles: str):
        self.pairs, self.singles = pairs, singles

    def rank(self, two: Column) -> Column:
        found = F.substr(F.split_part(F.get(self.pairs, _place(two)), F.concat(F.lit(START), two), F.lit(2)), F.lit(1), F.lit(1))
        return F.when(found == "", NONE).otherwise(found)

    def ranks(self, s: Column) -> Column:
        """Characters of the ranks of each token with the one after it."""
        signs = F.split(s, "")
        return F.array_join(F.zip_with(signs, F.slice(signs, F.lit(2), F.size(signs)), lambda a, b: F.when(b.isNotNull(), self.rank(F.concat(a, b)))), "")

    def start(self, bytes_: Column) -> Column:
        """Single-byte tokens of bytes, which are written as Latin-1."""
        return F.concat(F.lit(EDGE), F.translate(bytes_, "".join(map(chr, range(256))), self.singles), F.lit(EDGE))

    def folded(self, bytes_: Column) -> Column:
        """Tokens of a short piece: the leftmost neighbours of least rank are merged until there are none."""

        def step(a, _):
            s, ranks = a["s"], a["ranks"]

            def merged(m, k):
                beside = F.concat(self.rank(F.concat(F.substr(s, k - 1, F.lit(1)), m)), self.rank(F.concat(m, F.substr(s, k + 2, F.lit(1)))))
                return F.struct(F.overlay(s, m, k, F.lit(2)).alias("s"), F.overlay(ranks, beside, k - 1, F.lit(3)).alias("ranks"))

            least = F.array_min(F.split(ranks, ""))
            return bound(least, lambda m: F.when(m == NONE, a).otherwise(bound(F.position(m, ranks), lambda k: merged(m, k))))

        start = lambda s: F.struct(s.alias("s"), self.ranks(s).alias("ranks"))
        rounds = F.sequence(F.lit(2), F.greatest(F.char_length(bytes_), F.lit(2)))
        return F.aggregate(rounds, bound(self.start(bytes_), start), step, lambda a: a["s"])

    def swept(self, bytes_: Column) -> Column:
        """Tokens of a long piece: a round merges all neighbours of the least rank at once where that is the same as one by one.

        It is the same unless neighbours of that rank differ, or a merged pair has a lower rank with what was next to it.
        """

        def look(s):
            state = lambda s, r: F.struct(s.alias("s"), r.alias("ranks"), F.array_min(F.split(r, "")).alias("least"))
            return bound(s, lambda x: bound(self.ranks(x), lambda r: state(x, r)))

        def step(a, _):
            s, ranks, m = a["s"], a["ranks"], a["least"]

            def at(k):
                left = F.substr(s, k, F.lit(1))
                others = F.exists(F.zip_with(F.split(s, ""), F.split(ranks, ""), lambda x, r: (r == m) & (x != left)), lambda x: x)
                swept, single = F.replace(s, F.substr(s, k, F.lit(2)), m), F.overlay(s, m, k, F.lit(2))
                one_by_one = F.coalesce(others, F.lit(False)) | (self.rank(F.concat(m, left)) < m)
                return F.when(one_by_one, look(single)).otherwise(bound(look(swept), lambda c: F.when(c["least"] >= m, c).otherwise(look(single))))

            return F.when(m == NONE, a).otherwise(bound(F.position(m, ranks), at))

        rounds = F.sequence(F.lit(2), F.greatest(F.char_length(bytes_), F.lit(2)))
        return F.aggregate(rounds, look(self.start(bytes_)), step, lambda a: a["s"])

    def ids(self, piece: Column) -> Column:
        """Ids of a piece, joined by blanks."""

        def number(x):
            c = F.ascii(x)
            return (F.when(c < SURROGATES, c).otherwise(c - N_SURROGATES) - FIRST).cast("string")

        def of_tokens(s):
            return F.array_join(F.transform(F.split(F.substr(s, F.lit(2), F.char_length(s) - 2), ""), number), " ")

        def of_bytes(b):
            return bound(F.when(F.char_length(b) <= SHORT, self.folded(b)).otherwise(self.swept(b)), of_tokens)

        return bound(F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1"), of_bytes)


def merged(piece: bytes, vocabulary: dict[bytes, int]) -> list[int]:
    """Ids of a piece: of neighbours whose union is a token those of least rank are merged, leftmost first, until there are none."""
    n = len(piece)
    ends = list(range(1, n + 1))  # of the token that starts here, 0 where none does
    before = list(range(-1, n - 1))
    get, heap = vocabulary.get, []

    def offer(i, k):
        r = get(piece[i:k])
        if r is not None:
            heapq.heappush(heap, (r, i, k))

    for i in range(n - 1):
        offer(i, i + 2)
    while heap:
        _, i, k = heapq.heappop(heap)
        j = ends[i]
        if not j or j >= n or ends[j] != k:
            continue  # one of the two was merged since
        ends[i], ends[j] = k, 0
        if k < n:
            before[k] = i
            offer(i, ends[k])
        if i:
            offer(before[i], k)
    ids, i = [], 0
    while i < n:
        ids.append(vocabulary[piece[i : ends[i]]])
        i = ends[i]
    return ids


class Pieces(dict):
    """Ids of pieces, joined by blanks."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> str:
        b = piece.encode()
        whole = self.vocabulary.get(b)
        v = " ".join(map(str, merged(b, self.vocabulary))) if whole is None else str(whole)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = v
        return v


class Encoder:
    """Column expressions of one vocabulary, which must have a token for each byte."""

    def __init__(self, vocabulary: dict[bytes, int], pattern: str):
        self.vocabulary, self.pattern = vocabulary, spelled(pattern)
        self.singles = "".join(sign(vocabulary[bytes([b])]) for b in range(256))

    @cached_property
    def pairs(self) -> Column:
        return _literal(_pairs(self.vocabulary))

    @cached_property
    def signs(self) -> Column:
        signs = [""] * (max(self.vocabulary.values()) + 1)
        for k, v in self.vocabulary.items():
            signs[v] = k.decode("latin-1")
        return F.from_json(F.lit(json.dumps(signs, ensure_ascii=False)), "array<string>")

    def text_ids(self, docs: DataFrame) -> DataFrame:
        """(doc_id, ids_text) of (doc_id, text)."""
        pattern, vocabulary = self.pattern, self.vocabulary

        def encode(batches):
            import regex

            cut, ids = regex.compile(pattern).findall, Pieces(vocabulary)
            for b in batches:
                for k in range(0, b.num_rows, TOGETHER):
                    part = b.slice(k, TOGETHER)
                    texts = [" ".join([ids[p] for p in cut(t.as_py() or "")]) for t in part.column(1)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "ids_text"])

        return docs.mapInArrow(encode, f"doc_id {dict(docs.dtypes)['doc_id']}, ids_text string")

    def bytes_of(self, ids: Column) -> Column:
        """The bytes of an array of ids, one after the other."""
        return bound(self.signs, lambda signs: F.encode(F.array_join(F.transform(ids, lambda i: F.get(signs, i)), ""), "ISO-8859-1"))


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids_text, ids): the ids of each whole text, joined by blanks and as an array.

    Null and empty texts have none; a repeated row has its own; an empty table gives none; other columns are not read.
    """
    out = Encoder(ranks(path), pattern).text_ids(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return out.withColumn("ids", F.when(F.col("ids_text") == "", F.array().cast("array<int>")).otherwise(F.split("ids_text", " ").cast("array<int>")))


def decoded(ids: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``ids`` with a column ``bytes``, its decoded ids. An id that the vocabulary lacks has no bytes; null stays null."""
    return ids.withColumn("bytes", Encoder(ranks(path), pattern).bytes_of(F.col(ids_col)))


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    both = decoded(encoded(docs, path, pattern), path, pattern)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
