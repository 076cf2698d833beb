"""What several corpus operators share: table access, row keys, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words everywhere in this subpackage: space and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
#: Names of the row key's columns; chosen so that a table's own columns don't clash with them.
KEY = ["__row_key_1", "__row_key_2"]
#: Bytes of text that a Python worker takes at a time.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever signs their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    This cuts the lineage at a place that outlives any executor, and fixes values that a second evaluation could give
    otherwise (row numbers, seeds of a loop).
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/paperline-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for df in tables:
        for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, one row at least."""
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(batch[column]).to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def mapped(docs: DataFrame, schema: str, of: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``of`` over the rows of ``docs``, in batches whose ``text`` is of a bounded number of bytes (or one row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield of(part)

    return docs.mapInArrow(run, schema)


def fields(df: DataFrame, *names: str) -> str:
    """The DDL of some columns of ``df``."""
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two 64-bit hashes of (doc_id, text), never null: equal for rows alike in both, which count as one row."""
    kind = F.when(F.col(doc_id).isNull(), 1).otherwise(0) + F.when(F.col(text).isNull(), 2).otherwise(0)
    return [F.xxhash64(F.lit(s), kind, doc_id, text).alias(k) for s, k in enumerate(KEY)]


def one_of_each(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose row key is in ``keep``, with the columns of ``docs``.

    Of rows alike in doc_id and text one stays: the least by a hash of the whole row, so that any run keeps the same.
    """
    names = [f"__c{i}" for i in range(len(docs.columns))]
    at = docs.select(F.struct(*[c.alias(n) for c, n in zip(columns(docs), names, strict=True)]).alias("__row"), *row_key())
    order = F.struct(F.xxhash64("__row"), F.xxhash64(F.lit(1), "__row"))
    least = at.groupBy(*KEY).agg(F.min_by("__row", order).alias("__row")).join(keep, KEY, "left_semi")
    return least.select(*[F.col(f"__row.{n}").alias(c) for n, c in zip(names, docs.columns, strict=True)])


def utf8(text: str | Column = "text") -> Column:
    """The bytes of a text, none for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c, F.lit("")).cast("binary")


def offsets(totals: DataFrame, by: list[str], total: str, out: str) -> DataFrame:
    """Running sums before each row of a small table of totals (a bounded number of rows, fixed by a parameter)."""
    from pyspark.sql import Window

    w = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(total).over(w), F.lit(0)))


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, most: int = 1000) -> DataFrame:
    """``rows`` with the row of ``groups`` for their keys, if there is one; rows of large groups are not brought together.

    ``count`` tells how many of ``rows`` a group has. Fewer than ``most`` groups can hold more than one in ``most`` of all rows,
    which bounds the side that is broadcast. Rows met there go on under a key of their own, so ``rows`` are read once and no group
    fills a task. ``groups`` should be a written table; its keys are distinct and not null.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    values = [c for c in groups.columns if c not in keys]
    side = lambda df, mark: df.select(*[F.col(k).alias(f"{mark}{k}") for k in keys], F.struct(*values).alias(f"{mark}found"))
    hot = F.broadcast(side(groups.where(F.col(count) * most > total), "__hot_"))
    cold = side(groups.where(F.col(count) * most <= total), "__cold_").withColumn("__cold_spread", F.lit(0).cast("long"))
    at = rows.join(hot, [F.col(k) == F.col(f"__hot_{k}") for k in keys], "left")
    met = F.col("__hot_found").isNotNull()
    at = at.withColumn("__spread", F.when(met, F.xxhash64(*rows.columns)).otherwise(F.lit(0).cast("long")))
    same = [F.when(met, F.lit(None)).otherwise(F.col(k)) == F.col(f"__cold_{k}") for k in keys]
    at = at.join(cold, [*same, F.col("__spread") == F.col("__cold_spread")], "left")
    found = F.coalesce("__hot_found", "__cold_found")
    return at.where(found.isNotNull()).select(*[F.col(c) for c in rows.columns], *[found[v].alias(v) for v in values])
