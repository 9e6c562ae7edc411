"""Best-fit packing of token pieces into sequences by exact complements.

Pieces of one length are alike, so a packing is a table of patterns: a list of lengths and how often it is used. It is found
from the histogram of lengths alone, which has at most ``capacity`` rows whatever the corpus, and then dealt back: the n-th
piece of a length takes the n-th place of that length in the table. Only small numbers move; a text is read and encoded once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from bodygrid.llm.common import stored

CAPACITY = 4096
END = 1

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("nth", T.LongType()),
    ]
)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document's ids and end mark; ``nth``: place among the pieces of this length that one task has made."""

    def cut(batches):
        from pyspark import TaskContext

        from bodygrid.llm.encoders import WordEncoder

        encode, task = WordEncoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end, step = np.array([END], "<u4").tobytes(), 4 * capacity
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(text.as_py()) + end
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    n = len(part) // 4
                    rows.append((doc_id, k // step, k // 4, n, zlib.crc32(part), task, int(seen[n])))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                PIECES.fieldNames(),
            )

    return stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES))


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how often) so that every piece is placed and no sum exceeds ``capacity``.

    Long lengths first: a gap is filled exactly by one length, by a pair, or by a triple, as often as the counts allow; what
    is left is packed best-fit, longest first. Each use of a pattern exhausts a length, so there are few patterns.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c
    out: list[tuple[tuple[int, ...], int]] = []

    def use(parts: tuple[int, ...]) -> bool:
        need: dict[int, int] = {}
        for p in parts:
            need[p] = need.get(p, 0) + 1
        times = int(min(left[p] // c for p, c in need.items()))
        if times:
            for p, c in need.items():
                left[p] -= times * c
            out.append((parts, times))
        return times > 0

    def pair_sums() -> np.ndarray:
        """Whether two lengths at hand (one length twice only if there are two) add up to each sum."""
        have = (left > 0).astype(np.float64)
        have[0] = 0
        size = 1 << (2 * capacity).bit_length()
        ways = np.rint(np.fft.irfft(np.fft.rfft(have, size) ** 2, size))[: 2 * capacity + 1]
        once = np.flatnonzero(left == 1)
        ways[2 * once[once > 0]] -= 1
        return ways[: capacity + 1] > 0

    def pair_for(gap: int) -> tuple[int, int] | None:
        a = np.arange((gap + 1) // 2, gap)
        ok = a[(left[a] > 0) & (left[gap - a] > 0)]
        ok = ok[(2 * ok != gap) | (left[ok] > 1)]
        return (int(ok[-1]), gap - int(ok[-1])) if len(ok) else None

    while left[capacity] and use((capacity,)):
        pass
    for parts in (2, 3, 4):
        sums = pair_sums() if parts > 2 else None
        for n in range(capacity - 1, 0, -1):
            gap = capacity - n
            while left[n]:
                if parts == 2:
                    if not (gap <= n and left[gap] and use((n, gap))):
                        break
                elif parts == 3:
                    if not sums[gap]:
                        break
                    left[n] -= 1  # set aside, so that it isn't its own complement
                    two = pair_for(gap)
                    left[n] += 1
                    if not two or not use((n, *two)):
                        break
                else:
                    left[n] -= 1
                    third = np.arange(gap - 2, 0, -1)
                    third = third[(left[third] > 0) & sums[gap - third]]
                    found = None
                    for t in third:
                        left[t] -= 1
                        two = pair_for(gap - int(t))
                        left[t] += 1
                        if two:
                            found = (int(t), *two)
                            break
                        sums[gap - int(t)] = False  # not asked again
                    left[n] += 1
                    if not found or not use((n, *found)):
                        break
    # best fit of the rest: open sequences by the room they have
    room: dict[int, list[list]] = {}
    rooms = np.zeros(capacity + 1, bool)

    def put(space: int, parts: tuple[int, ...], times: int) -> None:
        room.setdefault(space, []).append([parts, times])
        rooms[space] = True

    for n in range(capacity, 0, -1):
        count = int(left[n])
        while count:
            fits = np.flatnonzero(rooms[n:])
            if len(fits):
                space = n + int(fits[0])
                group = room[space][-1]
                times = min(count, group[1])
                group[1] -= times
                if not group[1]:
                    room[space].pop()
                    rooms[space] = bool(room[space])
                put(space - n, (*group[0], n), times)
                count -= times
            else:
                per = min(capacity // n, count)
                put(capacity - per * n, (n,) * per, count // per)
                count -= (count // per) * per
        left[n] = 0
    out += [(tuple(parts), times) for groups in room.values() for parts, times in groups]
    return out


def _places(table: list[tuple[tuple[int, ...], int]], capacity: int):
    """Per length, in one line of keys: first rank, first sequence and offset of each run of equal places."""
    rows, sequence = [], 0
    for parts, times in table:
        at = 0
        for p in parts:
            rows.append((p, sequence, at, times))
            at += p
        sequence += times
    if not rows:
        return np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(capacity + 2, np.int64)
    length, seq, offset, times = (np.array(c, np.int64) for c in zip(*rows))
    order = np.argsort(length, kind="stable")
    length, seq, offset, times = length[order], seq[order], offset[order], times[order]
    total = np.cumsum(times) - times
    bounds = np.searchsorted(length, np.arange(capacity + 2))
    base = np.append(total, times.sum())[bounds]  # places before each length
    return total, seq, offset, base


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty and gives its end mark alone. Repeated rows are packed each for itself; rows without an id stay without
    one. An empty table gives no rows. Only documents longer than ``capacity`` are cut.
    """
    got = pieces(docs, tokenizer, capacity, id_col, text_col)
    counts = stored(got.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    total, seq, offset, base = _places(patterns(histogram, capacity), capacity)
    sent = docs.sparkSession.sparkContext.broadcast((total, seq, offset, base))  # bounded by the lengths, not by the corpus
    w = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "task", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first"))
    ranked = got.join(first, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    schema = T.StructType([*PIECES.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def deal(batches):
        total, seq, offset, base = sent.value
        for b in batches:
            place = base[b.column(3).to_numpy(zero_copy_only=False)] + b.column(5).to_numpy(zero_copy_only=False)
            run = np.searchsorted(total, place, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq[run] + place - total[run]), pa.array(offset[run])], schema.fieldNames())

    return ranked.mapInArrow(deal, schema)
