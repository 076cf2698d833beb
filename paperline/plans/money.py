"""Solver and totals over invoice lines with known damage; SQL knows the truth or repeats the rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import cents, round2
from ..operators import reconcile, totals
from .book import book
from .views import CENTS, INV, inv_items

QUERIES, ORACLES, query = book()
#: Lines whose price times quantity is the sum to the cent, as a printed invoice has them.
EXACT = f"{INV}, ex AS (SELECT *, {CENTS.format('price')} AS pc, CAST(qty AS BIGINT) AS q FROM inv)"


def _exact(spark, sf_dir):
    """Lines with the sum made from quantity and price, all of them printed amounts."""
    return inv_items(spark, sf_dir).withColumn("sum", round2(F.col("qty") * F.col("price")))


@query(f"WITH {EXACT} SELECT doc_id, n, q AS qty, pc AS price_cents, q * pc AS sum_cents, true AS supported FROM ex")
def q13_solve_row(spark, sf_dir):
    """One reading of each line is damaged in turn: decimals of the price lost, a digit of the sum misread, the quantity missing."""
    lines = _exact(spark, sf_dir)
    kind = F.col("n") % 4
    none = F.array().cast("array<double>")
    wrong = F.col("sum") + F.when(F.floor(F.col("sum") / 1000) % 10 == 9, -1000).otherwise(1000)
    vat = round2(F.col("sum") * 0.16 / 1.16)
    rows = lines.select(
        "doc_id", "n", F.when(kind == 3, none).otherwise(F.array("qty")).alias("qtys"), none.alias("plans"),
        F.when(kind == 1, F.array(F.col("price") * 100, F.col("price"))).otherwise(F.array("price")).alias("prices"),
        F.when(kind == 2, F.array(wrong, F.col("sum"))).otherwise(F.array("sum")).alias("sums"), F.array(vat).alias("vats"), F.lit(False).alias("weight"),
    )
    s = reconcile.solve_rows(rows)
    return s.select("doc_id", "n", F.col("solution.qty").cast("long").alias("qty"), cents("solution.price").alias("price_cents"), cents("solution.sum").alias("sum_cents"), (F.col("solution.support") >= 3).alias("supported"))


@query(f"""WITH {EXACT} SELECT doc_id AS page, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS qty_col, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 3 END AS price_col,
CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 5 END AS sum_col FROM ex GROUP BY doc_id HAVING count(*) FILTER (WHERE q <> 1 AND pc <> 100) >= 2""")
def q14_detect_roles(spark, sf_dir):
    """Columns of each page are dealt in one of two orders, amid a row number and an empty column."""
    lines = _exact(spark, sf_dir).where((F.col("qty") != 1) & (cents("price") != 100))
    even = F.col("doc_id") % 2 == 0
    number = F.col("n").cast("double") + 0.37
    at = F.when(even, F.array(number, F.col("qty"), F.col("price"), F.lit(-1.0), F.col("sum"))).otherwise(F.array(F.col("qty"), number, F.lit(-1.0), F.col("price"), F.lit(-1.0), F.col("sum")))
    cells = lines.select(F.col("doc_id").alias("page"), F.col("n").alias("row"), F.posexplode(at).alias("col", "v")).select("page", "row", "col", F.array("v").alias("values"))
    found = reconcile.detect_roles(cells).where("votes >= 2")
    return found.select("page", *[F.col(c).cast("int").alias(c) for c in ("qty_col", "price_col", "sum_col")])


@query(f"""WITH {EXACT}, t AS (SELECT doc_id, count(*) AS rows, CAST(sum(q * pc) AS BIGINT) AS c FROM ex GROUP BY doc_id),
p AS (SELECT doc_id, rows, c, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN c + 50000 WHEN 2 THEN c + 1 ELSE c END AS p FROM t)
SELECT doc_id, rows, c AS rows_cents, p AS total_cents, p - c AS difference_cents,
CASE WHEN p IS NULL THEN 'warn' WHEN abs(p - c) <= 5 + rows THEN 'info' ELSE 'error' END AS status FROM p""")
def q15_totals_check(spark, sf_dir):
    lines = _exact(spark, sf_dir)
    printed = F.col("rows_sum") + F.when(F.col("doc_id") % 5 == 1, 500).when(F.col("doc_id") % 5 == 2, 0.01).otherwise(0)
    docs = totals.row_totals(lines).select("doc_id", F.when(F.col("doc_id") % 5 != 0, round2(printed)).alias("total"))
    c = totals.check_totals(docs, lines)
    return c.select("doc_id", "rows", cents("rows_sum").alias("rows_cents"), cents("total").alias("total_cents"), cents("difference").alias("difference_cents"), "status")


@query(f"""WITH {EXACT}, m AS (SELECT doc_id, max(n) AS last FROM ex GROUP BY doc_id)
SELECT ex.doc_id, n, q * pc AS sum_cents, CASE WHEN n = 1 OR (n = 2 AND ex.doc_id % 2 = 0) THEN true ELSE false END AS restored
FROM ex JOIN m ON ex.doc_id = m.doc_id""")
def q16_fix_rows_by_total(spark, sf_dir):
    """The first row of each document, and in every other one the second too, was read too large by odd amounts."""
    lines = _exact(spark, sf_dir)
    docs = totals.row_totals(lines).select("doc_id", F.col("rows_sum").alias("total"))
    hit = (F.col("n") == 1) | ((F.col("n") == 2) & (F.col("doc_id") % 2 == 0))
    alternative = F.array(F.struct("qty", "price", "sum"))
    none = F.array().cast("array<struct<qty: double, price: double, sum: double>>")
    added = F.when(F.col("n") == 1, 1000000.0).otherwise(333000.0)
    read = lines.withColumn("alternatives", F.when(hit, alternative).otherwise(none)).withColumn("sum", F.when(hit, F.col("sum") + added).otherwise(F.col("sum")))
    return totals.fix_rows(docs, read).select("doc_id", "n", cents("sum").alias("sum_cents"), "restored")


@query(f"""WITH {EXACT} SELECT doc_id, n, CASE WHEN n > 1 OR doc_id % 4 > 0 THEN q END AS qty, CASE WHEN n > 1 OR doc_id % 4 > 0 THEN q * pc END AS sum_cents, n = 1 AND doc_id % 4 > 0 AS filled FROM ex""")
def q17_fill_row(spark, sf_dir):
    """The first row of each document has lost quantity and sum; the total gives both back where the sum's digits were read."""
    lines = _exact(spark, sf_dir)
    docs = totals.row_totals(lines).select("doc_id", F.col("rows_sum").alias("total"))
    lost = F.col("n") == 1
    none = F.array().cast("array<double>")
    read = lines.select("doc_id", "n", F.when(~lost, F.col("qty")).alias("qty"), "price", F.when(~lost, F.col("sum")).alias("sum"), F.when(lost, 1).otherwise(3).alias("support"), F.when(lost, F.array("price")).otherwise(none).alias("prices"), F.when(lost & (F.col("doc_id") % 4 > 0), F.array("sum")).otherwise(none).alias("sums"))
    f = totals.fill_row(docs, read)
    return f.select("doc_id", "n", F.col("qty").cast("long").alias("qty"), cents("sum").alias("sum_cents"), "filled")


@query(f"""WITH {EXACT}, t AS (SELECT doc_id, n, 1000 * q AS m, unit, pc FROM ex), d AS (SELECT doc_id, sum(m) AS want FROM t GROUP BY doc_id),
r AS (SELECT t.*, want, CASE WHEN n = 1 THEN m * 10 ELSE m END AS read FROM t JOIN d USING (doc_id)), h AS (SELECT doc_id, sum(read) AS have FROM r GROUP BY doc_id),
k AS (SELECT r.*, want - have AS diff, have FROM r JOIN h USING (doc_id)),
f AS (SELECT *, abs(diff) * 2 <= have AND read / 10 - read = diff AND (read % 10000 = 0 OR unit = 'kg') AS hit FROM k),
c AS (SELECT *, count(*) FILTER (WHERE hit) OVER (PARTITION BY doc_id) AS hits FROM f)
SELECT doc_id, n, CAST(CASE WHEN hit AND hits = 1 THEN read / 10 ELSE read END AS BIGINT) AS thousandths, hit AND hits = 1 AS shifted FROM c""")
def q18_qty_by_total(spark, sf_dir):
    """The first quantity of each document has its decimal shifted; the printed quantity total shows it."""
    lines = _exact(spark, sf_dir)
    docs = lines.groupBy("doc_id").agg(F.sum("qty").alias("total_qty"))
    read = lines.withColumn("qty", F.when(F.col("n") == 1, F.col("qty") * 10).otherwise(F.col("qty")))
    q = totals.qty_by_total(docs, read)
    return q.select("doc_id", "n", F.floor(F.col("qty") * 1000 + 0.5).alias("thousandths"), "shifted")


@query(f"""WITH {EXACT}, t AS (SELECT doc_id, count(*) AS rows, CAST(sum(q * pc) AS BIGINT) AS c FROM ex GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN c + 7000000 ELSE c END AS total_cents, doc_id % 4 = 0 AS restored FROM t""")
def q19_total_by_vat(spark, sf_dir):
    """Every fourth total has lost its first digit while its VAT fits; of others, some are wrong with their VAT."""
    lines = _exact(spark, sf_dir)
    k = F.col("doc_id") % 4
    total = F.col("rows_sum") + F.when(k == 0, 50000).when(k == 1, 70000).otherwise(0)
    vat = round2(F.col("rows_sum") * F.when(k == 0, 0.16 / 1.16).otherwise(0.9))
    docs = totals.row_totals(lines).select("doc_id", total.alias("total"), vat.alias("vat"))
    return totals.total_by_vat(docs, lines).select("doc_id", cents("total").alias("total_cents"), "restored")
