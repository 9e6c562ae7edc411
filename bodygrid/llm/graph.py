"""Connected components of an edge table: union-find within tasks, then labels passed along what is left."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bodygrid.llm.common import stored


def _forests(edges: DataFrame) -> DataFrame:
    """Each task's edges by a union-find forest: (v, root) with root < v. As many rows as vertices at most, not edges."""

    def union(batches):
        parent: dict[int, int] = {}

        def find(x):
            top = x
            while parent.get(top, top) != top:
                top = parent[top]
            while parent.get(x, x) != top:
                parent[x], x = top, parent[x]
            return top

        for b in batches:
            for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a, c = find(a), find(c)
                if a != c:
                    parent[max(a, c)] = min(a, c)
        got = [(v, find(v)) for v in list(parent)]
        for i in range(0, len(got), 50_000):
            part = got[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], ["v", "root"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(union, "v bigint, root bigint")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) to (v, root): the smallest vertex that each vertex of an edge can reach. Repeated edges and loops do no harm."""
    tree = stored(_forests(edges))
    both = stored(tree.select(F.col("v").alias("u"), F.col("root").alias("w")).unionByName(tree.select(F.col("root").alias("u"), F.col("v").alias("w"))).distinct())
    labels = stored(both.groupBy("u").agg(F.min("w").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels, both["w"] == labels["v"]).groupBy("u").agg(F.min("label").alias("m"))
        step = labels.join(near.withColumnRenamed("u", "v"), "v", "left").select("v", F.col("label").alias("was"), F.least("label", F.coalesce("m", "label")).alias("label"))
        step = stored(step)
        up = step.select(F.col("v").alias("label"), F.col("label").alias("up"))
        step = stored(step.join(up, "label").select("v", F.least("label", "up").alias("label"), (F.least("label", "up") != F.col("was")).alias("moved")))
        labels = step.select("v", "label")
        if not step.filter("moved").limit(1).count():
            return labels.withColumnRenamed("label", "root")
    raise RuntimeError("components did not settle")
