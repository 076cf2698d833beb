"""Invoice lines, catalogue and dictionary made from the sales tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import ean_check_digit, round2
from ..operators.stage import unsent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ean13(number: Column, prefix: str = "460") -> Column:
    body = F.concat(F.lit(prefix), F.lpad(number.cast("string"), 12 - len(prefix), "0"))
    return F.concat(body, ean_check_digit(body).cast("string"))


def inv_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as invoice rows. Barcodes are made once for each part, then joined.

    Orders are named as documents before their lines are numbered, so that Spark knows the rows to lie together by document.
    """
    lines = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    parts = unsent(part, part.count()).select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), ean13(F.col("p_partkey")).alias("barcode"))
    at = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    at = at.withColumnRenamed("l_orderkey", "doc_id")
    order = Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    unit = F.when(F.col("l_returnflag") == "A", "block").when(F.col("l_returnflag") == "N", "pcs").otherwise("kg")
    return at.select(
        "doc_id", F.row_number().over(order).cast("long").alias("n"), F.col("l_suppkey").alias("supplier_key"), F.col("l_partkey").alias("partkey"),
        F.col("l_quantity").alias("qty"), round2(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_extendedprice").alias("sum"), "name", "brand", "barcode", unit.alias("unit"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return unsent(p, p.count()).select(
        F.col("p_partkey").alias("catalog_ord"), F.col("p_name").alias("name"), ean13(F.col("p_partkey")).alias("barcode"), F.array(ean13(F.col("p_partkey") + 1000000)).alias("extra"),
        F.lit("pcs").alias("unit"), F.col("p_brand").alias("supplier"), F.col("p_retailprice").alias("price"),
    )


R2 = "floor(({0}) * 100 + 2.220446049250313e-14 + 0.5) / 100"
CENTS = "CAST(floor(({0}) * 100 + 2.220446049250313e-14 + 0.5) AS BIGINT)"


def ean_sql(number: str, prefix: str = "460") -> str:
    body = f"('{prefix}' || lpad(CAST({number} AS VARCHAR), {12 - len(prefix)}, '0'))"
    total = " + ".join(f"CAST(substr({body}, {i}, 1) AS INTEGER) * {3 if i % 2 == 0 else 1}" for i in range(1, 13))
    return f"({body} || CAST((10 - ({total}) % 10) % 10 AS VARCHAR))"


PARTS = f"parts AS (SELECT p_partkey AS partkey, p_name AS name, p_brand AS brand, p_retailprice AS retail, {ean_sql('p_partkey')} AS barcode, {ean_sql('(p_partkey + 1000000)')} AS extra FROM part)"
INV = f"""{PARTS}, inv AS (SELECT l_orderkey AS doc_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n,
  l_suppkey AS supplier_key, l_partkey AS partkey, l_quantity AS qty, {R2.format('l_extendedprice / l_quantity')} AS price, l_extendedprice AS sum,
  name, brand, barcode, CASE l_returnflag WHEN 'A' THEN 'block' WHEN 'N' THEN 'pcs' ELSE 'kg' END AS unit
  FROM lineitem JOIN parts ON l_partkey = partkey)"""
