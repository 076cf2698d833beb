"""Intermediate tables in the shared folder, which cut a plan that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Rows from which a table isn't sent to the driver, however small its file is.
MANY = 100_000


def unsent(df: DataFrame, rows: int) -> DataFrame:
    """``df``, joined by merging if it has many rows. Spark's size check sees the bytes of a file, where values that repeat or follow from others
    take a fraction of what they take as rows; such a table would be built as a whole in the driver.
    """
    return df.hint("merge") if rows > MANY else df


def stored(df: DataFrame, what: str, by: str | None = None, parts: int = 0) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: later steps read it instead of working it out again.

    ``by``: ``df`` lies in so many ``parts`` by this column; it is kept so, and joins and windows by the column don't shuffle it again.
    """
    spark, name = df.sparkSession, f"table_{what.replace('-', '_')}_{uuid.uuid4().hex}"
    path, seen = f"{shared_folder(spark)}/{name}", Observation()
    told = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if by is None:
        told.write.parquet(path)
        back = spark.read.schema(df.schema).parquet(path)
    else:
        told.write.bucketBy(parts, by).option("path", path).saveAsTable(name)
        back = spark.table(name)
        # Only the name goes: the files stay, as those of the other tables do.
        spark.sql(f"DROP TABLE {name}")
    return unsent(back, seen.get["rows"])
