"""Helpers the operators share: words, written tables, arrow batches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bodygrid.plans.tables import table  # noqa: F401

# The white space and the words of the contracts (Java and Python patterns alike).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only for a local master without the setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    import tempfile

    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame, by: str | None = None, path: str | None = None, codec: str | None = None) -> DataFrame:
    """``df`` written as a table into the shared folder and read again: lineage ends here, and lost executors lose nothing.

    Row numbers and other values that depend on the order of rows are fixed by it. The files stay until the folder is
    cleared, as lazy results may still read them. ``by``: a column whose values get folders of their own. A caller that
    knows when nothing reads the table any more names its ``path`` and removes it.
    """
    path = path or new_path(df.sparkSession)
    df.write.parquet(path, partitionBy=by, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``stored`` wrote, by the file system it is in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
