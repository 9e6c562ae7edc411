"""Ranked lexical search: term-at-a-time sums over short lists inside a document-at-a-time pass over long ones.

Queries come in blocks of bounded size. For a block, one pass over the texts writes a small index of the block's terms, sums over
it give the statistics, and each task then answers all queries of the block on the documents it holds. In a batch of documents the
short lists of a query are summed once into accumulators; these are from then on one list with one bound. It and the long
lists are walked together by document: lists whose bounds add up to less than the score of rank ``top`` are not walked but only
probed, at documents that can still get there. Tasks keep ``top`` documents a query, and Spark merges them in two steps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bodygrid.llm.common import stored

#: Distinct terms, and queries, after which a block of queries is full. One query is never cut.
BLOCK_TERMS = 100_000
BLOCK_QUERIES = 1024
#: Lists with less than this share of a batch's documents are short.
SHORT = 1 / 32
#: Documents that are looked at between two updates of the threshold.
STRIDE = 1024
#: Rows of the index that are one batch.
BATCH = 8192
#: Parts a query's task results are first merged in.
PARTS = 64
#: Bytes of UTF-8 that are part of a term as they are; only A-Z are lower-cased, all else separates.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a whole text in order; null has none."""
    return text.encode().translate(TERM_BYTES).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def index(docs: DataFrame, numbers: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, term, tf) of each row of ``docs``: how many terms it has, and those of ``numbers`` with their counts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, at, term, tf = [], [0], [], []
            for text in b.column(1):
                words = terms(text.as_py())
                found = Counter(map(numbers.get, words))
                found.pop(None, None)
                n.append(len(words))
                term += found.keys()
                tf += found.values()
                at.append(len(term))
            at = pa.array(at, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, kind)) for x, kind in ((term, pa.int32()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "term", "tf"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n bigint, term array<int>, tf array<bigint>")


class Batch:
    """Posting lists of some documents, in order of doc_id, with what each posting adds to a score."""

    def __init__(self, b: pa.RecordBatch, weights: np.ndarray, n_docs: int, n_terms: int):
        order = pc.sort_indices(b.column(0))  # ascending, nulls last
        b = b.take(order)
        self.ids, self.size = b.column(0), b.num_rows
        lists, counts = b.column(2), b.column(3)
        n = b.column(1).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(self.size), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        term, tf = lists.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False)
        norm = 10 + (90 * n * n_docs) // max(n_terms, 1)
        gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[doc]))
        by_term = np.argsort(term, kind="stable")
        self.doc, self.gain, term = doc[by_term], gain[by_term], term[by_term]
        self.terms, self.starts = np.unique(term, return_index=True)
        self.ends = np.append(self.starts[1:], len(term))

    def lists(self, wanted: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        k = np.flatnonzero(np.isin(self.terms, wanted))
        return [(self.doc[i:j], self.gain[i:j]) for i, j in zip(self.starts[k], self.ends[k])]


def _summed(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One list: its documents ascending, gains added up."""
    docs, place = np.unique(np.concatenate([d for d, _ in lists]), return_inverse=True)
    total = np.zeros(len(docs), np.int64)
    np.add.at(total, place, np.concatenate([g for _, g in lists]))
    return docs, total


def best(batch: Batch, wanted: np.ndarray, top: int, least: int) -> list[tuple[int, int]]:
    """(document, score) of the batch among which are its ``top`` best for the terms; ``least``: scores under it don't matter."""
    lists = batch.lists(wanted)
    short = [x for x in lists if len(x[0]) < SHORT * batch.size]
    walked = [x for x in lists if len(x[0]) >= SHORT * batch.size] + ([_summed(short)] if short else [])
    walked.sort(key=lambda x: int(x[1].max()))
    bounds = np.cumsum([int(g.max()) for _, g in walked])  # of a list and all before it
    found: list[tuple[int, int]] = []
    for low in range(0, batch.size if walked else 0, STRIDE):
        probed = int(np.searchsorted(bounds, least))  # lists that together stay under the threshold
        if probed == len(walked):
            break
        part = [(d[i:j], g[i:j]) for d, g in walked for i, j in [np.searchsorted(d, (low, low + STRIDE))]]
        score = np.zeros(STRIDE, np.int64)
        for d, g in part[probed:]:
            score[d - low] += g
        live = np.flatnonzero(score)
        for k in range(probed - 1, -1, -1):
            live = live[score[live] + bounds[k] >= least]  # the others can't reach the threshold any more
            d, g = part[k]
            if not len(live) or not len(d):
                continue
            at = np.minimum(np.searchsorted(d, live + low), len(d) - 1)
            hit = d[at] == live + low
            score[live[hit]] += g[at[hit]]
        live = live[score[live] >= max(least, 1)]
        found += zip((live + low).tolist(), score[live].tolist())
        if len(found) > top:
            found = sorted(found, key=lambda x: (-x[1], x[0]))[:top]
            least = max(least, found[-1][1])
    return found


def search(docs: DataFrame, queries: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each query with a score above 0, equal scores by ascending doc_id.

    A row of ``queries`` is a query of its own, with repeated ids too; a query without terms, or null, has no rows. A row of ``docs``
    is a document of its own; null and empty texts have no terms; a null id comes after all others. Without documents there are no
    rows. Columns besides the named ones are not read. Whole texts are read once for each block of queries.
    """
    src = queries.select(F.col(query_id).alias("item_id"), F.col(query_text).alias("text"))
    kind = src.schema["item_id"].dataType.simpleString()
    doc_kind = docs.schema[id_col].dataType.simpleString()
    out = None
    for block in _blocks(src):
        one = _answered(docs, block, top, kind, doc_kind, id_col, text_col)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {doc_kind}, score bigint")
    return out


def _blocks(src: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    block, seen = [], 0
    for r in src.toLocalIterator():  # the driver holds one block and one partition of the query table
        words = sorted(set(terms(r["text"])))
        block.append((r["item_id"], words))
        seen += len(words)
        if seen >= BLOCK_TERMS or len(block) >= BLOCK_QUERIES:
            yield block
            block, seen = [], 0
    if block:
        yield block


def _answered(docs, block, top, kind, doc_kind, id_col, text_col) -> DataFrame:
    spark = docs.sparkSession
    numbers = {w: i for i, w in enumerate(sorted({w for _, words in block for w in words}))}
    wanted = [np.array(sorted(numbers[w] for w in words), np.int64) for _, words in block]
    postings = stored(index(docs, numbers, id_col, text_col))
    n_docs, n_terms = postings.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(numbers), np.int64)
    for r in postings.select(F.explode("term").alias("t")).groupBy("t").count().toLocalIterator():  # a row for each term of the block
        weights[r["t"]] = weight(n_docs, r["count"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list] = [[] for _ in wanted]  # of each query: (-score, no id, id)
        for whole in batches:
            for low in range(0, whole.num_rows, BATCH):
                batch = Batch(whole.slice(low, BATCH), weights, n_docs, n_terms)
                for q, want in enumerate(wanted):
                    full = len(kept[q]) == top
                    for d, s in best(batch, want, top, -kept[q][-1][0] if full else 0):
                        i = batch.ids[d].as_py()
                        kept[q].append((-s, i is None, i))
                    kept[q].sort(key=lambda x: x[:2] if x[1] else x)
                    del kept[q][top:]
        rows = [(q, i, -s) for q, k in enumerate(kept) for s, _, i in k]
        q, ids, score = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids, id_type), pa.array(score, pa.int64())], ["query", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    found = postings.mapInArrow(answer, f"query int, doc_id {doc_kind}, score bigint")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    for keys in (["query", "part"], ["query"]):
        part = part.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], f"query int, item_id {kind}")
    return part.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # names: BLOCK_QUERIES rows at most
