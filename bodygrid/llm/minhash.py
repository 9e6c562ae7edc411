"""Near-duplicates by SuperMinHash signatures, banding, verification on whole sets and union-find.

Every shingle of a document draws, round by round, the place of a random permutation and a rank that grows with the round, so
the ranks of one shingle over all places are correlated; each place keeps its least rank. Once every place has a rank of an
earlier round than the next one, no later draw can win and the document is done: a few rounds instead of one per place.

Documents of equal sets are one class. Classes that share a band meet: first each with the smallest of its bucket, which
settles groups of copies with as many pairs as members; then, in buckets whose members are still apart, each with another
center; last, in buckets still apart, those outside the largest part with the members they are apart from. So a bucket's pairs
are made only where they could join two components, and only if sizes and sketches allow it. Every link is verified on the whole
sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bodygrid.llm.common import stored
from bodygrid.llm.graph import components

PLACES = 192
BANDS = 32
#: Bits of each place that are kept to compare signatures. Pairs whose places differ in more than they would at the asked
#: similarity, by this many standard deviations, aren't verified: 3 in a million pairs at the very threshold, far fewer than
#: no band finds.
SKETCH_BITS = 4
#: Places of the finer sketch of documents that are still apart from others of their buckets.
FINE_PLACES = 1024
DEVIATIONS = 4.5
#: Shingles that are signed together; bounds memory and spares calls for short documents.
TOGETHER = 16384
#: Words whose hashes a process remembers before it starts afresh.
MEMORY = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-known 64-bit finaliser (public domain), in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, width: int):
        import xxhash

        self.width = width

        class Hashes(dict):
            def __missing__(self, word):
                v = self[word] = xxhash.xxh3_64_intdigest(word)
                return v

        self.hashes = Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        """Lower-cases A-Z; fewer words than the width are one shingle, none are none."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only, both
        if not words:
            return np.empty(0, np.uint64)
        if len(self.hashes) > MEMORY:
            self.hashes.clear()
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(h))
        n = len(h) - width + 1
        out = np.full(n, width, np.uint64)
        for i in range(width):
            out += h[i : i + n]
            out *= _ODD
            _mixed(out)
        return np.unique(out)


def _draw(sets: list[np.ndarray], places: int) -> np.ndarray:
    sizes = np.array([len(s) for s in sets])
    x = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), sizes)
    best = np.full((len(sets), places), np.iinfo(np.uint64).max, np.uint64)
    order = np.tile(np.arange(places, dtype=np.uint16), (len(x), 1))
    row = np.arange(len(x))
    low = np.uint64(0xFFFFFFFF)
    for j in range(places):
        r = _mixed(x + np.uint64((j + 1) * int(_ODD) & 0xFFFFFFFFFFFFFFFF))
        k = j + ((r & low) * np.uint64(places - j) >> np.uint64(32)).astype(np.int64)
        place = order[row, k]
        order[row, k] = order[row, j]
        rank = (r >> np.uint64(32)) | np.uint64(j << 32)
        np.minimum.at(best.ravel(), doc * places + place, rank)
        open_docs = best.max(axis=1) >= np.uint64((j + 1) << 32)
        if not open_docs.any():
            break
        going = open_docs[doc]
        if not going.all():
            x, doc, order = x[going], doc[going], order[going]
            row = np.arange(len(x))
    return best


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """SuperMinHash of each non-empty set: a row of ``places`` values, the round above 32 bits of rank.

    Long sets are drawn part by part; the least of the parts' values is the value of the whole.
    """
    best = np.full((len(sets), places), np.iinfo(np.uint64).max, np.uint64)
    parts = [(i, s[k : k + TOGETHER]) for i, s in enumerate(sets) for k in range(0, len(s), TOGETHER)]
    at = 0
    while at < len(parts):
        first, size = at, 0
        while at < len(parts) and (at == first or size + len(parts[at][1]) <= 2 * TOGETHER):
            size += len(parts[at][1])
            at += 1
        owner = np.array([i for i, _ in parts[first:at]])
        np.minimum.at(best, owner, _draw([s for _, s in parts[first:at]], places))
    return best


def _band_keys(best: np.ndarray, bands: int) -> np.ndarray:
    rows = best.shape[1] // bands
    key = np.zeros((len(best), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _ODD
    for i in range(rows):
        key ^= best[:, i::rows][:, :bands]
        key = _mixed(key * _ODD)
    return key.view(np.int64)


def _planes(best: np.ndarray) -> np.ndarray:
    """The low bits of all places, bit by bit, as 64-bit words: SKETCH_BITS * places / 64 per document."""
    planes = [np.packbits((best >> np.uint64(k) & np.uint64(1)).astype(np.uint8), axis=1) for k in range(SKETCH_BITS)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)


def _may_link(n1: str, n2: str, planes1: str, planes2: str, places: int, percent: int) -> Column:
    """Whether sizes and sketches allow the similarity."""
    words = places // 64
    differ = []
    for w in range(words):
        bits = [F.col(planes1)[k * words + w].bitwiseXOR(F.col(planes2)[k * words + w]) for k in range(SKETCH_BITS)]
        one = bits[0]
        for x in bits[1:]:
            one = one.bitwiseOR(x)
        differ.append(F.bit_count(one))
    m = (1 - percent / 100) * (1 - 2.0**-SKETCH_BITS)
    most = int(places * m + DEVIATIONS * (places * m * (1 - m)) ** 0.5)
    return (F.lit(100) * F.least(n1, n2) >= F.lit(percent) * F.greatest(n1, n2)) & (sum(differ[1:], differ[0]) <= most)


def _signed(docs: DataFrame, width: int, places: int, bands: int) -> DataFrame:
    """doc_id, n (set size), f1 and f2 (128 bits of the set), bands, planes."""

    def sign(batches):
        import xxhash

        shingles = Shingler(width)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            at = 0
            while at < len(ids):
                sets, size, first = [], 0, at
                while at < len(ids) and (size < TOGETHER or not sets):
                    sets.append(shingles(texts[at].as_py()))
                    size += len(sets[-1])
                    at += 1
                full = [s for s in sets if len(s)]
                best = signatures(full, places) if full else np.empty((0, places), np.uint64)
                keys, planes = iter(_band_keys(best, bands)), iter(_planes(best))
                prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                two = np.frombuffer(b"".join(prints), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[first:at], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                        pa.array([next(planes) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "f1", "f2", "bands", "planes"],
                )

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(sign, "doc_id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>, planes array<bigint>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def hashed(batches):
        import xxhash

        shingles = Shingler(width)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                s = shingles(text.as_py()).tobytes()
                f = np.frombuffer(xxhash.xxh3_128_digest(s), "<i8")
                yield pa.RecordBatch.from_pydict({"c": pa.array([doc_id], pa.int64()), "f1": f[:1], "f2": f[1:], "items": pa.array([s], pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hashed, "c bigint, f1 bigint, f2 bigint, items binary")


def _fine(sets: DataFrame) -> DataFrame:
    """(c, planes) of FINE_PLACES places."""

    def sign(batches):
        for b in batches:
            for k in range(0, b.num_rows, 32):
                part = b.slice(k, 32)
                best = signatures([np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(1)], FINE_PLACES)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(_planes(best)), pa.list_(pa.int64()))], ["c", "planes"])

    return sets.select("c", "items").mapInArrow(sign, "c bigint, planes array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    mine = sets.select(F.col("c").alias("a"), F.col("items").alias("left"))
    other = sets.select(F.col("c").alias("b"), F.col("items").alias("right"))
    both = pairs.select("a", "b").join(mine, "a").join(other, "b").select("a", "b", "left", "right")

    def compare(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                place = np.searchsorted(y, x)
                place[place == len(y)] = 0
                same = int((y[place] == x).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(compare, "a bigint, b bigint")


def _apart(met: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of the links, and (h, c, part, main) of the buckets (h, c) with members of more than one; ``main`` is the part
    with most members in the bucket."""
    parts = components(links)
    labelled = stored(met.select("h", "c").join(parts.withColumnRenamed("v", "c"), "c", "left").select("h", "c", F.coalesce("root", "c").alias("part")))
    of = labelled.groupBy("h", "part").agg(F.count(F.lit(1)).alias("k")).groupBy("h").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("k", "part")).alias("most"))
    several = stored(of.filter("parts > 1").select("h", F.col("most.part").alias("main")))
    return parts, stored(labelled.join(several, "h"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, places: int = PLACES, bands: int = BANDS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept (doc_id = component_id).

    Ids should be unique: rows that share one are judged by their texts, but may come to share a component. Rows with null id
    are linked with nothing and kept, with null component_id. Texts without a word have an empty set and are linked with nothing. An empty table gives no rows; other
    columns are not read. Sets are of 64-bit hashes of shingles.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(_signed(src, width, places, bands))
    usable = signed.filter("doc_id is not null and n > 0")
    classes = stored(usable.groupBy("f1", "f2").agg(F.min("doc_id").alias("c"), F.max("n").alias("n")))
    first = stored(usable.select("doc_id", "f1", "f2", "bands", "planes").join(classes, ["f1", "f2"]).filter("doc_id = c").select("c", "n", "bands", "planes"))
    sketch = first.select("c", "n", "planes")
    banded = first.select("c", F.explode("bands").alias("h"))
    shared = banded.groupBy("h").agg(F.min("c").alias("first"), F.max("c").alias("last")).filter("first < last").select("h", "first")
    met = stored(banded.join(shared, "h"))
    wanted = met.select(F.col("c").alias("doc_id")).distinct()
    sets = _sets(src.join(wanted, "doc_id", "left_semi"), width).join(classes.select("c", "f1", "f2"), ["c", "f1", "f2"], "left_semi").dropDuplicates(["c", "f1", "f2"]).select("c", "items")
    sets = stored(sets)

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are links; pairs that sizes or sketches rule out are not compared."""
        one = sketch.select(F.col("c").alias("a"), F.col("n").alias("n1"), F.col("planes").alias("p1"))
        two = sketch.select(F.col("c").alias("b"), F.col("n").alias("n2"), F.col("planes").alias("p2"))
        likely = pairs.join(one, "a").join(two, "b").filter(_may_link("n1", "n2", "p1", "p2", places, percent)).select("a", "b").distinct()
        return stored(_verified(likely, sets, percent))

    pair = (F.least("c", "center").alias("a"), F.greatest("c", "center").alias("b"))
    links = verified(met.filter("c <> first").select("c", F.col("first").alias("center")).select(*pair).distinct())
    parts, mixed = _apart(met, links)
    # once more with another center for each bucket: large groups without one common center come together here
    draw = F.xxhash64("h", "c")
    centers = mixed.groupBy("h").agg(F.min(draw).alias("d"))
    centers = mixed.join(centers, "h").filter(draw == F.col("d")).select("h", F.col("c").alias("center"), F.col("part").alias("part2")).distinct()
    again = mixed.join(stored(centers), "h").filter("part <> part2").select(*pair).distinct()
    links = stored(links.unionByName(verified(again)))
    parts, mixed = _apart(mixed.select("h", "c"), links)
    # what is still apart: members outside the largest part of a bucket against all from which they are apart
    fine = stored(_fine(sets.join(mixed.select("c").distinct(), "c", "left_semi")).distinct())
    mixed = stored(mixed.join(first.select("c", "n", "planes", "bands"), "c").join(fine.withColumnRenamed("planes", "fine"), "c"))
    side = lambda df, k: df.select("h", *[F.col(x).alias(f"{x}{k}") for x in ("c", "part", "n", "planes", "bands", "fine")])
    cross = side(mixed.filter("part <> main"), 1).join(side(mixed, 2), "h")
    once = F.array_min(F.array_intersect("bands1", "bands2")) == F.col("h")  # of the buckets that two share, one makes the pair
    likely = _may_link("n1", "n2", "planes1", "planes2", places, percent) & _may_link("n1", "n2", "fine1", "fine2", FINE_PLACES, percent)
    cross = cross.filter((F.col("part1") != F.col("part2")) & likely & once)
    cross = stored(cross.select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")).distinct())
    more = stored(_verified(cross, sets, percent))
    if more.limit(1).count():
        parts = components(links.unionByName(more))
    # a document's class, and the class's component
    whole = classes.join(parts.select(F.col("v").alias("c"), "root"), "c", "left").select("f1", "f2", F.coalesce("root", "c").alias("component"))
    found = signed.select("doc_id", "n", "f1", "f2").join(whole, ["f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    out = found.select("doc_id", F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
