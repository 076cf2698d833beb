"""Duplicates, containment, continuation sheets and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import round2
from ..operators import documents
from .book import book
from .money import EXACT
from .views import INV, inv_items, table

QUERIES, ORACLES, query = book()


@query("""WITH f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) SELECT doc_id, first_id FROM f WHERE first_id < doc_id""")
def q29_text_duplicates(spark, sf_dir):
    return documents.text_duplicates(table(spark, sf_dir, "documents"))


def _copies(spark, sf_dir):
    """Every document once more under another number: whole if its number is even, without its first row if it is odd.

    Every third row has no barcode, and the copy's sum of every other row is a cent off.
    """
    lines = inv_items(spark, sf_dir).withColumns({"code": F.lit(None).cast("string"), "barcode": F.when(F.col("n") % 3 != 0, F.col("barcode"))})
    again = lines.where((F.col("doc_id") % 2 == 0) | (F.col("n") > 1)).withColumn("doc_id", F.col("doc_id") + 1000000000)
    again = again.withColumn("sum", round2(F.col("sum") + F.when(F.col("n") % 2 == 0, 0.01).otherwise(0.0)))
    return lines.unionByName(again)


@query(f"WITH {INV}, c AS (SELECT doc_id, count(*) AS n FROM inv GROUP BY doc_id) SELECT doc_id AS a, doc_id + 1000000000 AS b FROM c WHERE doc_id % 2 = 0 OR n > 1")
def q30_bag_containment(spark, sf_dir):
    """JOIN-16: each copy is held by its original; the question is asked both ways for odd ones, where only one holds."""
    items = _copies(spark, sf_dir)
    ids = items.where("doc_id < 1000000000").select("doc_id").distinct()
    asked = ids.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1000000000).alias("b"))
    back = asked.where("a % 2 = 1").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return documents.contained(asked.union(back), items)


@query(f"""WITH {INV}, c AS (SELECT doc_id, count(*) AS n FROM inv GROUP BY doc_id) SELECT doc_id + 1000000000 AS doc_id, doc_id AS target,
'duplicate' AS kind FROM c WHERE doc_id % 2 = 0 OR n > 1""")
def q31_related(spark, sf_dir):
    """JOIN-17: copies carry the number of their original."""
    items = _copies(spark, sf_dir)
    number = F.when(F.col("doc_id") >= 1000000000, F.col("doc_id") - 1000000000).otherwise(F.col("doc_id"))
    docs = items.groupBy("doc_id").agg(F.lit("s").alias("supplier_key")).select("doc_id", F.col("doc_id").alias("ord"), "supplier_key", F.concat(F.lit("9"), number).alias("number_digits"), F.lit(None).cast("string").alias("date"))
    return documents.related(docs, items)


@query(f"""WITH {INV}, s AS (SELECT *, n % 3 AS sheet FROM inv)
SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY sheet = 0, (sheet + doc_id) % 3, n) AS row FROM s""")
def q32_merge_sheets(spark, sf_dir):
    """SET-01: rows are spread over three sheets that arrive in turns; the one with the total comes last."""
    sheet = F.col("n") % 3
    at = inv_items(spark, sf_dir).select("doc_id", "n", ((sheet + F.col("doc_id")) % 3).alias("arrived"), (sheet == 0).alias("has_total"))
    return documents.merge_sheets(at).select("doc_id", "n", F.col("row").cast("long").alias("row"))


@query(f"WITH {EXACT} SELECT doc_id, doc_id % 4 = 1 OR doc_id % 4 = 2 AS continuation FROM ex GROUP BY doc_id")
def q33_continuation(spark, sf_dir):
    """FLT-02: some sheets have a head, some a total of their own, some a total that is of the whole document."""
    lines = inv_items(spark, sf_dir).withColumn("sum", round2(F.col("qty") * F.col("price")))
    k = F.col("doc_id") % 4
    none = F.lit(None).cast("string")
    docs = lines.groupBy("doc_id").agg(F.sum("sum").alias("s")).select(
        "doc_id", F.when(k == 0, "supplier").alias("supplier"), none.alias("number"), none.alias("date"), F.when(k == 2, F.col("s") + 100000).when(k == 3, F.col("s")).alias("total")
    )
    return documents.is_continuation(docs, lines)


@query(f"WITH {INV} SELECT doc_id, floor(count(*) FILTER (WHERE n % 2 = 0) * 10000.0 / count(*) + 0.5) / 10000 AS coded FROM inv GROUP BY doc_id")
def q34_coded_share(spark, sf_dir):
    items = inv_items(spark, sf_dir).select("doc_id", "n", F.when(F.col("n") % 4 == 0, "c").alias("code"), "barcode", F.when(F.col("n") % 2 == 0, "invoice").otherwise("catalog").alias("barcode_source"))
    return documents.coded_share(items).select("doc_id", (F.floor(F.col("coded") * 10000 + 0.5) / 10000).alias("coded"))


