"""Edits, quality, summaries, exports, listings and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import cents
from ..operators import edits, export, quality
from .book import book
from .views import CENTS, INV, R2, catalogue, inv_items, table

QUERIES, ORACLES, query = book()


def _rules(spark):
    return spark.createDataFrame([(1, "Block.", "pcs", 10.0), (2, "block", "kg", 7.0), (3, "kg", "kg", 3.0), (4, "KG", "g", 1000.0)], "rule_ord int, from string, to string, factor double")


@query(f"""WITH {INV} SELECT doc_id, n, CAST(CASE unit WHEN 'block' THEN qty * 10 WHEN 'kg' THEN qty * 1000 ELSE qty END AS BIGINT) AS qty,
{CENTS.format("CASE unit WHEN 'block' THEN price / 10 WHEN 'kg' THEN price / 1000 ELSE price END")} AS price_cents, {CENTS.format('sum')} AS sum_cents,
CASE unit WHEN 'block' THEN 'pcs' WHEN 'kg' THEN 'g' ELSE unit END AS unit, CASE WHEN unit <> 'pcs' THEN unit END AS was FROM inv""")
def q35_unit_rules(spark, sf_dir):
    """EDIT-01: applied twice, which must change nothing more."""
    rules = _rules(spark)
    at = edits.apply_unit_rules(edits.apply_unit_rules(inv_items(spark, sf_dir), rules), rules)
    return at.select("doc_id", "n", F.col("qty").cast("long").alias("qty"), cents("price").alias("price_cents"), cents("sum").alias("sum_cents"), "unit", F.col("orig.unit").alias("was"))


@query(f"""WITH {INV} SELECT doc_id, n, CAST(CASE n % 3 WHEN 0 THEN qty * 2 WHEN 1 THEN qty * 20 ELSE qty END AS BIGINT) AS qty,
{CENTS.format('CASE WHEN n % 3 = 1 THEN price / 20 ELSE price END')} AS price_cents, CASE n % 3 WHEN 1 THEN 'pack' WHEN 2 THEN 'box' ELSE unit END AS unit, {CENTS.format('sum')} AS sum_cents FROM inv""")
def q36_bulk_edit(spark, sf_dir):
    """EDIT-02, EDIT-03: a third of the rows scaled, a third converted, a third in another unit."""
    at = inv_items(spark, sf_dir)
    rows = at.select("doc_id", "n")
    at = edits.bulk(at, rows.where("n % 3 = 0"), lambda df, t: edits.scale(df, t, "qty", 2))
    at = edits.bulk(at, rows.where("n % 3 = 1"), lambda df, t: edits.convert(df, t, 20, F.lit("pack")))
    at = edits.bulk(at, rows.where("n % 3 = 2"), lambda df, t: edits.set_unit(df, t, "box"))
    return at.select("doc_id", "n", F.col("qty").cast("long").alias("qty"), cents("price").alias("price_cents"), "unit", cents("sum").alias("sum_cents"))


@query(f"WITH {INV} SELECT doc_id, n, CAST(qty AS BIGINT) AS qty, {CENTS.format('price')} AS price_cents, unit, true AS clean FROM inv")
def q37_restore(spark, sf_dir):
    """EDIT-02: everything converted and taken back."""
    at = edits.apply_unit_rules(inv_items(spark, sf_dir), _rules(spark))
    at = edits.restore(edits.scale(at, F.lit(True), "price", 3.0), F.lit(True))
    return at.select("doc_id", "n", F.col("qty").cast("long").alias("qty"), cents("price").alias("price_cents"), "unit", F.col("orig").isNull().alias("clean"))


@query(f"""WITH {INV} SELECT doc_id, n, CAST(CASE WHEN n = 1 THEN 7 ELSE qty END AS BIGINT) AS qty, {CENTS.format(f"CASE WHEN n = 1 THEN {R2.format('7 * price')} ELSE sum END")} AS sum_cents,
CASE WHEN n = 2 THEN 'typed' ELSE name END AS name, CASE WHEN n = 2 THEN name END AS invoice_name, n <= 2 AS edited FROM inv""")
def q38_patch(spark, sf_dir):
    """EDIT-05: a quantity typed into first rows, a name into second ones."""
    none = F.lit(None)
    items = inv_items(spark, sf_dir).withColumns({"edited": none.cast("boolean"), "invoice_name": none.cast("string"), "name_source": none.cast("string"), "barcode_source": none.cast("string"), "alt_barcode": none.cast("string"), "approved": none.cast("boolean")})
    typed = items.where("n <= 2").select("doc_id", "n", F.when(F.col("n") == 1, 7.0).alias("qty"), F.when(F.col("n") == 2, "typed").alias("name"))
    return edits.patch(items, typed).select("doc_id", "n", F.col("qty").cast("long").alias("qty"), cents("sum").alias("sum_cents"), "name", "invoice_name", "edited")


def _graded(spark, sf_dir):
    items = inv_items(spark, sf_dir).withColumns({
        "barcode": F.when(F.col("n") % 7 != 0, F.col("barcode")), "qty": F.when(F.col("n") % 5 == 0, 0.0).otherwise(F.col("qty")),
        "barcode_source": F.when(F.col("partkey") % 4 == 0, "catalog").otherwise("invoice"), "approved": F.col("n") % 2 == 0, "edited": F.lit(False),
        "issues": F.array().cast("array<struct<level: string, text: string, kind: string>>"),
    })
    at = quality.problems(items, catalogue(spark, sf_dir))
    return at.withColumn("all_issues", quality.effective_issues()).withColumn("level", quality.worst_level(F.col("all_issues")))


GRADED = f"""{INV}, g AS (SELECT *, CASE WHEN n % 5 = 0 THEN 'error' WHEN n % 7 <> 0 AND partkey % 4 = 0 AND n % 2 = 1 THEN 'warn' WHEN n % 7 = 0 THEN 'todo' ELSE 'ok' END AS level FROM inv)"""


@query(f"WITH {GRADED} SELECT doc_id, n, level FROM g")
def q39_issues_level(spark, sf_dir):
    return _graded(spark, sf_dir).select("doc_id", "n", "level")


@query(f"""WITH {INV}, m AS (SELECT doc_id, brand, count(*) AS k, min(n) AS n, arg_min(name, n) AS name, arg_min(barcode, n) AS first, min(barcode) AS lo, max(barcode) AS hi, sum(qty) AS q,
sum({CENTS.format('sum')}) AS c, arg_min(price, n) AS p1, sum(CAST(price * qty AS DECIMAL(28, 6))) AS pq FROM inv GROUP BY doc_id, brand)
SELECT doc_id, n, CASE WHEN lo <> hi THEN brand ELSE first END AS barcode, name, CAST(q AS BIGINT) AS qty, CAST(c AS BIGINT) AS sum_cents,
{CENTS.format('CASE WHEN k = 1 THEN p1 ELSE CAST(pq AS DOUBLE) / q END')} AS price_cents, k AS merged FROM m""")
def q40_export_merge(spark, sf_dir):
    """AGG-01, AGG-02: lines of one brand in a document count as one product."""
    items = inv_items(spark, sf_dir).withColumns({"catalog_barcode": F.col("brand"), "code": F.lit(None).cast("string")})
    at = export.export_lines(items)
    return at.select("doc_id", "n", "barcode", "name", F.col("qty").cast("long").alias("qty"), cents("sum").alias("sum_cents"), cents("price").alias("price_cents"), "merged")


@query(f"WITH {INV} SELECT doc_id, count(*) - count(DISTINCT brand) AS merged FROM inv GROUP BY doc_id")
def q41_merged_count(spark, sf_dir):
    return export.merged_count(inv_items(spark, sf_dir).withColumn("catalog_barcode", F.col("brand")))


@query(f"WITH {INV} SELECT supplier_key, doc_id, count(*) AS rows, CAST(sum({CENTS.format('sum')}) AS BIGINT) AS sum_cents, CAST(grouping(supplier_key) * 2 + grouping(doc_id) AS BIGINT) AS level FROM inv GROUP BY ROLLUP (supplier_key, doc_id)")
def q42_report_rollup(spark, sf_dir):
    """AGG-12."""
    return export.report(inv_items(spark, sf_dir))


@query(f"""WITH {INV}, d AS (SELECT doc_id, '{{"v":1,"items":[' || string_agg('{{"barcode":"' || barcode || '","name":"' || name || '","qty":' || CAST(CAST(qty AS BIGINT) AS VARCHAR) || ',"price":' || CAST({CENTS.format('price')} AS VARCHAR) || ',"sum":' || CAST({CENTS.format('sum')} AS VARCHAR) || '}}', ',' ORDER BY n) || ']}}' AS j FROM inv GROUP BY doc_id)
SELECT doc_id, 'https://shop.example#/invoice?d=' || rtrim(translate(base64(encode(j)), '+/', '-_'), '=') AS link FROM d""")
def q43_handoff(spark, sf_dir):
    """PRJ-03, STR-28, SNK-04: amounts in whole cents here, so both engines write them alike."""
    lines = inv_items(spark, sf_dir).withColumns({"qty": F.col("qty").cast("long"), "price": cents("price"), "sum": cents("sum")})
    return export.handoff(lines, "https://shop.example")


@query("""SELECT o_orderkey AS doc_id, o_orderpriority AS supplier FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders WHERE contains(lower(o_orderpriority), 'high')) WHERE k <= 300""")
def q44_top_k_listing(spark, sf_dir):
    """SRT-07: a listing of the newest 300 that contain a text, which is the feature."""
    found = table(spark, sf_dir, "orders").where(F.lower("o_orderpriority").contains("high"))
    return found.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(300).select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("supplier"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')
SELECT 'both' AS kind, count(*) AS customers FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'only open', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def q45_set_ops(spark, sf_dir):
    """SET-04..06 in one pass: a customer's flags say in which sets it is."""
    flags = table(spark, sf_dir, "orders").where("o_orderstatus in ('O', 'F')").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("a"), F.bool_or(F.col("o_orderstatus") == "F").alias("b"))
    counts = flags.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only open"), F.count("*").alias("either"))
    return counts.unpivot([], ["both", "only open", "either"], "kind", "customers")


@query(f"""WITH {GRADED} SELECT doc_id, count(*) AS rows, count(*) FILTER (WHERE n % 7 <> 0 AND n % 5 <> 0) AS exportable, count(*) FILTER (WHERE n % 7 = 0) AS missing_barcode,
count(*) FILTER (WHERE level = 'error') AS errors, count(*) FILTER (WHERE level = 'warn') AS warnings, CAST(sum({CENTS.format('sum')}) AS BIGINT) AS sum_cents,
CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 3 = 1 END AS totals_ok FROM g GROUP BY doc_id""")
def q48_summary(spark, sf_dir):
    """AGG-04."""
    rows = _graded(spark, sf_dir)
    k = F.col("doc_id") % 3
    docs = rows.groupBy("doc_id").agg(F.sum(cents("sum")).alias("c")).select("doc_id", F.when(k == 1, F.col("c") / 100).when(k == 2, F.col("c") / 100 + 5000).alias("total"))
    return quality.summarize(docs, rows)


@query(f"WITH {INV} SELECT doc_id, unit, CAST(sum(qty) AS BIGINT) AS qty FROM inv GROUP BY doc_id, unit")
def q49_qty_by_unit(spark, sf_dir):
    """AGG-05."""
    return quality.quantity_by_unit(inv_items(spark, sf_dir)).withColumn("qty", F.col("qty").cast("long"))


@query(f"""WITH {INV}, x AS (SELECT doc_id, n, unit, CASE WHEN n % 2 = 0 THEN unit END AS u FROM inv)
SELECT doc_id, n, coalesce(u, last_value(u IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS unit,
min(n) OVER (PARTITION BY doc_id, unit) AS first_row FROM x""")
def q50_neighbour_units(spark, sf_dir):
    """WIN-04, WIN-06: the last unit read above; the first row with the same unit."""
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    read = F.when(F.col("n") % 2 == 0, F.col("unit"))
    at = inv_items(spark, sf_dir).withColumn("u", read)
    first = F.min("n").over(Window.partitionBy("doc_id", "unit"))
    return at.select("doc_id", "n", F.coalesce("u", F.last("u", ignorenulls=True).over(w)).alias("unit"), first.alias("first_row"))


@query(f"WITH {INV}, p AS (SELECT doc_id, n, barcode || chr(9) || CAST(CAST(qty AS BIGINT) AS VARCHAR) || chr(9) || name AS line FROM inv) SELECT * FROM p")
def q51_tsv(spark, sf_dir):
    """PRJ-02, SNK-02."""
    lines = inv_items(spark, sf_dir).withColumn("qty", F.col("qty").cast("long"))
    return export.tsv(lines, ("barcode", "qty", "name"))


