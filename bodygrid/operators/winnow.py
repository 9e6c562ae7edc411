"""Least hashes of windows of text, by rolling hashes of their k-grams.

A window of ``width`` characters is named by the least hash among its k-grams, k being a little over half of it. Neighbouring
windows mostly share that k-gram, so a text has far fewer names than positions, and equal windows have equal names wherever
they stand. Hashes only choose candidates: callers compare the characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Characters of a text hashed together; blocks overlap, so no window is lost.
BLOCK = 1 << 18
#: Bits of the bitmap are two to this power.
BITS = 24
#: Characters after which a batch of results leaves a task.
SEND = 1 << 22
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def least_hashes(text: str, width: int) -> np.ndarray:
    """For each window of ``width`` characters, the least hash of its k-grams."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(c) < width:
        return np.zeros(0, np.uint64)
    k = width // 2 + 1
    back = np.full(len(c), _BACK, np.uint64)
    forth = np.full(len(c), _BASE, np.uint64)
    back[0] = forth[0] = 1
    sums = np.zeros(len(c) + 1, np.uint64)
    np.cumsum((c + np.uint64(1)) * np.cumprod(back), out=sums[1:])
    h = (sums[k:] - sums[:-k]) * np.cumprod(forth)[: len(c) - k + 1]
    for shift in (32, 29):  # low bits of the sums are weak
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(_BASE)
    h ^= h >> np.uint64(32)
    grams, held = width - k + 1, 1
    while held < grams:
        step = min(held, grams - held)
        h = np.minimum(h[:-step], h[step:])
        held += step
    return h


def _rows(fields: StructType, ids: pa.Array, at: list[int], texts: list[str], hashes: list[int]) -> pa.RecordBatch:
    columns = [ids.take(pa.array(at, pa.int64())), pa.array(texts, pa.string()), pa.array(hashes, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, fields.names)


def probes(protected: DataFrame, width: int, stride: int) -> DataFrame:
    """(item_id, window, hash) of every ``stride``-aligned window. ``protected``: item_id, text."""
    out = StructType([protected.schema["item_id"], StructField("window", StringType()), StructField("hash", LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column(1).to_pylist()):
                h = least_hashes(text or "", width)[::stride]
                if len(h):
                    yield _rows(out, b.column(0), [i] * len(h), [text[n * stride : n * stride + width] for n in range(len(h))], h.copy().view(np.int64).tolist())

    return protected.mapInArrow(cut, out)


def bitmap(hashes: DataFrame) -> bytes:
    """A bit for each of 2^BITS places that a hash has; 2 MB whatever the number of hashes. ``hashes``: hash."""
    place = F.shiftrightunsigned("hash", 64 - BITS) + 1  # Spark's bitmaps count from 1
    parts = hashes.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = bytearray(1 << (BITS - 3))
    for r in parts.collect():  # 512 rows at most
        at = (r["part"] - 1) * len(r["bits"])
        bits[at : at + len(r["bits"])] = r["bits"]
    return bytes(bits)


def stretches(corpus: DataFrame, bits: bytes, width: int, block: int = BLOCK) -> DataFrame:
    """(doc_id, stretch, hash): runs of windows with one least hash, where that hash has its bit set. ``corpus``: doc_id, text."""
    out = StructType([corpus.schema["doc_id"], StructField("stretch", StringType()), StructField("hash", LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits, np.uint8)
        for b in batches:
            at, texts, hashes, size = [], [], [], 0
            for i, value in enumerate(b.column(1)):
                text = value.as_py() or ""
                for low in range(0, len(text) - width + 1, block):
                    part = text[low : low + block + width - 1]
                    h = least_hashes(part, width)
                    place = (h >> np.uint64(64 - BITS)).astype(np.int64)
                    passed = np.flatnonzero((held[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                    if not len(passed):
                        continue
                    ends = np.flatnonzero((np.diff(passed) != 1) | (np.diff(h[passed]) != 0))
                    first, last = passed[np.append(0, ends + 1)], passed[np.append(ends, len(passed) - 1)]
                    at += [i] * len(first)
                    texts += [part[x : y + width] for x, y in zip(first.tolist(), last.tolist())]
                    hashes += h[first].view(np.int64).tolist()
                    size += int((last - first).sum()) + width * len(first)
                    if size > SEND:
                        yield _rows(out, b.column(0), at, texts, hashes)
                        at, texts, hashes, size = [], [], [], 0
            if at:
                yield _rows(out, b.column(0), at, texts, hashes)

    return corpus.mapInArrow(scan, out)
