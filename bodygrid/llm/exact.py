"""Exact duplicates by deterministic naming of blocks.

A text is cut into fixed-size blocks. Distinct blocks are sorted and numbered: a block's number is its name. Then adjacent
names are named as pairs, and pairs of pairs, until one name is left per text. Two texts of as many blocks have the same last
name exactly when they are equal, so the name is an identity without collisions.

The text is shuffled once, as distinct blocks after a partial aggregation on the map side, so a text with a thousand copies
travels about once per task. What is joined and grouped afterwards are numbers. Blocks are sorted by 128 bits of hash; that no
two blocks share these is checked on the blocks themselves, and the hash is seeded anew if they do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bodygrid.functions.once import once
from bodygrid.llm.common import SPACE, stored

BLOCK_CHARS = 4096
#: Names are numbered within 2^20 ranges of the sort key; the name holds the range and the place in it.
RANGE_BITS = 20
PLACE_BITS = 40


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"{SPACE}{{2,}}|[\x09-\x0D]", " ")


def _blocks(text: Column, size: int) -> Column:
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(cut)


def _numbered(keys: DataFrame, first: Column, order: list[str]) -> DataFrame:
    """``name``: place of each row in the order, within the range that the high bits of ``first`` give."""
    part = F.shiftrightunsigned(first, 64 - RANGE_BITS)
    w = Window.partitionBy("part").orderBy(*order)
    return keys.withColumn("part", part).withColumn("name", F.shiftleft(F.col("part"), PLACE_BITS) + F.row_number().over(w))


def _block_names(texts: DataFrame, size: int, tries: int = 4) -> tuple[DataFrame, int]:
    """(h1, h2, name) of each distinct block, and the seed under which no two blocks share h1 and h2."""
    for seed in range(tries):
        blocks = texts.select(F.explode(_blocks(F.col("norm"), size)).alias("block"))
        h1, h2 = _hashes(F.col("block"), seed)
        distinct = blocks.select(h1.alias("h1"), h2.alias("h2"), "block").groupBy("h1", "h2", "block").agg(F.count(F.lit(1)).alias("uses")).select("h1", "h2")
        w = Window.partitionBy("part").orderBy("h1", "h2")
        named = _numbered(distinct, F.col("h1"), ["h1", "h2"])
        clash = (F.lag("h1").over(w) == F.col("h1")) & (F.lag("h2").over(w) == F.col("h2"))
        named = stored(named.select("h1", "h2", "name", F.coalesce(clash, F.lit(False)).alias("clash")))
        if not named.filter("clash").limit(1).count():
            return named.drop("clash"), seed
    raise RuntimeError("blocks share hashes under every seed")


def _hashes(block: Column, seed: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(2 * seed), block), F.xxhash64(F.lit(2 * seed + 1), block)


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row: doc_id, text_sha256, n_blocks, root. Rows are equal when n_blocks and root are.

    Null text is the empty text, which is one empty block. Repeated rows each have their row. Other columns are not read.
    """
    texts = once(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("raw")), {"norm": normalised(F.col("raw"))}).drop("raw")
    names, seed = _block_names(texts, block_chars)
    rows = stored(
        texts.withColumn("row", F.monotonically_increasing_id()).select(
            "row", "doc_id", F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"),
            F.transform(_blocks(F.col("norm"), block_chars), lambda b: F.struct(*[h.alias(f"h{i + 1}") for i, h in enumerate(_hashes(b, seed))])).alias("blocks"),
        )
    )
    parts = rows.select("row", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("pos", "b"))
    nodes = stored(
        parts.select("row", "n_blocks", F.col("n_blocks").alias("left_over"), "pos", "b.h1", "b.h2").join(names, ["h1", "h2"]).select("row", "n_blocks", "left_over", "pos", "name")
    )
    most = nodes.agg(F.max("n_blocks")).first()[0] or 1
    roots = nodes.filter("left_over = 1")
    while most > 1:
        pairs = stored(
            nodes.filter("left_over > 1").groupBy("row", "n_blocks", F.ceil(F.col("left_over") / 2).alias("left_over"), F.shiftright("pos", 1).alias("pos")).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"),
            )
        )
        pair_names = _numbered(pairs.select("l", "r").distinct(), F.xxhash64("l", "r"), ["l", "r"]).select("l", "r", "name")
        nodes = stored(pairs.join(pair_names, ["l", "r"]).select("row", "n_blocks", "left_over", "pos", "name"))
        roots = roots.unionByName(nodes.filter("left_over = 1"))
        most = -(-most // 2)
    return rows.select("row", "doc_id", "text_sha256").join(roots.select("row", "n_blocks", F.col("name").alias("root")), "row")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest doc_id stays; null ids come after all others, and of rows that share the smallest
    id exactly one stays. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    ids = stored(identities(docs, id_col, text_col, block_chars))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), F.col("row")))
    groups = ids.groupBy("n_blocks", "root").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
    return ids.join(groups, ["n_blocks", "root"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256",
    )
