"""Session settings used by tests, bench and scripts. A cluster supplies its own."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "bodygrid") -> SparkSession:
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.memory", "8g")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where a local session has none (tests, laptops)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(configured or os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp")))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder: readers of it scan the columns they need, and lineage ends here.

    Its order is not kept, nor how it was dealt out. It stays until the folder is cleared.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only for a table counted to have at most ``max_rows`` rows; any other joins by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: Estimated bytes below which a planned broadcast stays: what explodes from so little still fits a driver.
PLANNED_BROADCAST = 64 << 10


def broadcast_by_size(spark: SparkSession) -> None:
    """Let joins broadcast by measured sizes: the session's threshold goes to adaptive execution, plans keep a small one.

    A plan's estimate takes an exploded table to be as large as what it came from, and files to be as large as rows, so tables
    many times the threshold were sent through the driver. Sessions without adaptive execution, or a lower threshold, stay as they are.
    """
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    given = spark.conf.get(planned)
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgt]?)b?\s*", given.lower()).groups()
    if spark.conf.get("spark.sql.adaptive.enabled") == "true" and int(number) << (10 * " kmgt".index(unit or " ")) > PLANNED_BROADCAST:
        if spark.conf.get(measured, None) in (None, given):  # not set, so that of the plan
            spark.conf.set(measured, given)
        spark.conf.set(planned, str(PLANNED_BROADCAST))


def clean_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the action that wrote them ends, not when the driver collects its garbage.

    A query that stores tables on its way otherwise holds the shuffles of every step until its end. A result that is read twice
    runs its shuffles again. Versions of Spark without this setting ignore it.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
