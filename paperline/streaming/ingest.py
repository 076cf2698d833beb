"""Arriving documents against the table of those seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ITEM_SCHEMA = "doc_id long, arrived timestamp, supplier_key string, number_digits string, n long, barcode string, qty double, sum double"


def fingerprinted(items: DataFrame) -> DataFrame:
    """A row for each document: supplier, number, rows and a checksum of its rows that doesn't depend on their order."""
    row = F.xxhash64("barcode", F.floor(F.col("qty") * 1000 + 0.5), F.floor(F.col("sum") * 100 + 0.5))
    return items.groupBy("doc_id", "supplier_key", "number_digits").agg(F.count("*").alias("rows"), F.sum(row.cast("decimal(38,0)")).alias("checksum"), F.min("arrived").alias("arrived"))


def judge(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """STM-02: ``kind`` of each document of a batch: duplicate, page (of a document with its number) or new."""
    both = seen.select("doc_id", "supplier_key", "number_digits", "rows", "checksum", "arrived", F.lit(False).alias("fresh")).unionByName(batch.withColumn("fresh", F.lit(True)).select("doc_id", "supplier_key", "number_digits", "rows", "checksum", "arrived", "fresh"))
    order = ["fresh", "arrived", "doc_id"]
    same = F.row_number().over(Window.partitionBy("supplier_key", "number_digits", "rows", "checksum").orderBy(*order)) > 1
    number = (F.coalesce("number_digits", F.lit("")) != "") & (F.row_number().over(Window.partitionBy("supplier_key", "number_digits").orderBy(*order)) > 1)
    return both.withColumn("kind", F.when(same, "duplicate").when(number, "page").otherwise("new")).where("fresh").drop("fresh")


def ingest(spark: SparkSession, source: str, table: str, checkpoint: str, most_files: int = 100) -> StreamingQuery:
    """STM-01: files of items as they arrive; documents and their kind are appended to the Parquet table at ``table``.

    A batch is written under its number, so a repeated one replaces itself.
    """
    stream = spark.readStream.schema(ITEM_SCHEMA).option("maxFilesPerTrigger", most_files).parquet(source)

    def land(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        docs = fingerprinted(batch)
        schema = docs.withColumn("kind", F.lit("new")).schema
        seen = session.read.schema(schema).option("recursiveFileLookup", True).parquet(table).where(F.col("_metadata.file_path").contains(f"/batch={number}/") == F.lit(False)) if number else session.createDataFrame([], schema)
        judge(docs, seen).select([f.name for f in schema]).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
