"""Work on open documents: selections, edits, what is learnt from them, checks by unit, the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import cents, number_cell, sum_matches
from ..functions.strings import plural, strip_trailing_quantity, supplier_sort_key
from ..operators import documents, edits, export, quality, resolve
from .book import book
from .views import CENTS, INV, R2, catalogue, inv_items, table

QUERIES, ORACLES, query = book()


def _bare(spark, sf_dir):
    """Every third row has lost its barcode; sums of even rows are the catalogue's."""
    items = inv_items(spark, sf_dir)
    return items.withColumns({"barcode": F.when(F.col("n") % 3 != 0, F.col("barcode")), "barcode_source": F.when(F.col("n") % 2 == 0, "catalog").otherwise("invoice")})


@query(f"WITH {INV} SELECT a.doc_id, a.n, min(CASE WHEN b.n > a.n THEN b.n END) AS next_n FROM inv a LEFT JOIN (SELECT doc_id, n FROM inv WHERE n % 3 = 0) b USING (doc_id) GROUP BY a.doc_id, a.n")
def q52_next_bare_row(spark, sf_dir):
    """EDIT-15, for every row."""
    at = _bare(spark, sf_dir)
    return edits.next_without_barcode(at, at)


@query(f"WITH {INV} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS n, barcode FROM inv WHERE n <> 2")
def q53_remove_rows(spark, sf_dir):
    """EDIT-12: the second row of each document goes, those behind move up."""
    at = inv_items(spark, sf_dir)
    return edits.remove_rows(at, at.where("n = 2")).select("doc_id", "n", "barcode")


@query(f"""WITH {INV}, s AS (SELECT doc_id, n, unit, CASE WHEN n BETWEEN 2 AND 4 THEN true ELSE n = 1 AND doc_id % 2 = 0 END AS on_now FROM inv), a AS (SELECT doc_id, bool_or(on_now) AS any_on FROM s GROUP BY doc_id)
SELECT s.doc_id, n, on_now AS selected, CASE WHEN any_on THEN on_now ELSE unit = 'kg' END AS preset FROM s JOIN a USING (doc_id) WHERE on_now OR NOT any_on""")
def q54_targets(spark, sf_dir):
    """EDIT-08, EDIT-10: a range from row 4 to row 2 is switched on; documents without any selected row count whole."""
    at = inv_items(spark, sf_dir).withColumn("selected", (F.col("n") == 1) & (F.col("doc_id") % 2 == 0))
    clicks = at.select("doc_id").distinct().select("doc_id", F.lit(2).alias("n"), F.lit(4).alias("last"))
    on = edits.toggled(at, clicks)
    preset = edits.preset_targets(on, "kg").select("doc_id", "n", F.lit(True).alias("preset"))
    return edits.targets(on).select("doc_id", "n", "selected").join(preset, ["doc_id", "n"], "left").withColumn("preset", F.coalesce("preset", F.lit(False)))


@query(f"WITH {INV} SELECT doc_id, count(*) AS rows FROM inv WHERE unit = 'block' OR unit = 'kg' GROUP BY doc_id")
def q55_convertible(spark, sf_dir):
    """EDIT-11: rows of open documents that the rules would convert."""
    rules = spark.createDataFrame([("Block.", "pcs", 10.0), ("kg", "g", 1000.0), ("pcs", "PCS", 2.0)], "from string, to string, factor double")
    return edits.convertible(inv_items(spark, sf_dir), rules)


@query(f"""WITH {INV}, t AS (SELECT supplier_key, '7' || lpad(CAST(partkey AS VARCHAR), 6, '0') AS map_code, barcode, doc_id * 100 + n AS updated FROM inv WHERE n % 3 = 0)
SELECT supplier_key, map_code, arg_max(barcode, updated) AS barcode, max(updated) AS updated FROM t GROUP BY ALL
UNION ALL SELECT DISTINCT l_suppkey, 'old', 'x', -1 FROM lineitem""")
def q56_learned(spark, sf_dir):
    """EDIT-07, EDIT-14: barcodes typed into bare rows are learnt; of an old dictionary what is not replaced stays."""
    code = F.concat(F.lit("7"), F.lpad(F.col("partkey").cast("string"), 6, "0"))
    at = inv_items(spark, sf_dir).withColumns({"code": code, "invoice_name": F.lit(None).cast("string"), "barcode_source": F.lit(None).cast("string")})
    typed = at.where("n % 3 = 0").select("doc_id", "n", "barcode", (F.col("doc_id") * 100 + F.col("n")).alias("updated"))
    old = at.select("supplier_key", F.explode(F.array(F.lit("old"), "code")).alias("map_code"), F.lit("x").alias("barcode"), F.lit(-1).cast("long").alias("updated")).distinct()
    old = edits.forget(old, at.select("supplier_key", F.col("code").alias("map_code")).distinct())
    return edits.remembered_barcodes(old, at, typed).select("supplier_key", "map_code", "barcode", "updated")


@query(f"WITH {INV} SELECT doc_id, sum(qty) AS on_paper, doc_id % 2 = 0 AS agrees FROM inv GROUP BY doc_id")
def q57_paper_quantity(spark, sf_dir):
    """AGG-06: quantities before conversion against the printed total, which is off in every other document."""
    items = edits.convert(inv_items(spark, sf_dir), F.col("unit") == "block", 10.0, F.lit("pcs"))
    docs = inv_items(spark, sf_dir).groupBy("doc_id").agg((F.sum("qty") + F.col("doc_id") % 2).alias("total_qty"))
    return quality.paper_quantity(docs, items)


@query(f"WITH {INV} SELECT doc_id, unit, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS rows FROM inv GROUP BY doc_id, unit")
def q58_rows_by_unit(spark, sf_dir):
    """AGG-07."""
    return quality.rows_by_unit(inv_items(spark, sf_dir)).withColumn("rows", F.array_join(F.col("rows").cast("array<string>"), ","))


@query(f"WITH {INV} SELECT doc_id, count(*) FILTER (WHERE n % 2 = 0) AS filled, doc_id % 3 = 0 AS partial FROM inv GROUP BY doc_id")
def q59_filled_and_partial(spark, sf_dir):
    """AGG-08: every third document has a total of twice its rows."""
    items = _bare(spark, sf_dir)
    docs = items.groupBy("doc_id").agg((F.sum("sum") * F.when(F.col("doc_id") % 3 == 0, 2.0).otherwise(1.0)).alias("total"))
    return quality.filled_and_partial(docs, items)


@query(f"""WITH {INV}, d AS (SELECT doc_id, sum({CENTS.format('sum')}) AS c, count(*) AS k FROM inv GROUP BY doc_id),
s AS (SELECT doc_id, c, k, substr(substr('Supplier ' || CAST(doc_id % 50 AS VARCHAR), 1, 24) || ' ' || CAST(doc_id % 100 AS VARCHAR), 1, 31) AS name FROM d),
m AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS j FROM s),
x AS (SELECT *, CASE WHEN j = 1 THEN name ELSE substr(name, 1, 28) || ' ' || CAST(j AS VARCHAR) END AS sheet FROM m)
SELECT sheet, k AS items, 1 AS heads, c AS rows_cents, 2 * c AS total_cents FROM x""")
def q60_report(spark, sf_dir):
    """SNK-03, LIM-03: the report's rows, counted by sheet."""
    none = lambda t: F.lit(None).cast(t)
    items = inv_items(spark, sf_dir).withColumns({"code": none("string"), "invoice_name": none("string"), "barcode_source": none("string"), "orig": none(edits.ORIG), "issues": none("array<struct<level:string,kind:string,text:string>>")})
    docs = items.groupBy("doc_id").agg((F.sum(cents("sum")) / 50).alias("total")).withColumns({"ord": F.col("doc_id"), "supplier": F.concat(F.lit("Supplier "), (F.col("doc_id") % 50).cast("string")), "number": (F.col("doc_id") % 100).cast("string"), "date": none("string")})
    rows = export.report_rows(docs, items)
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, c))
    return rows.groupBy("sheet").agg(
        of("item", F.lit(1)).alias("items"), of("head", F.lit(1)).cast("int").alias("heads"), of("rows total", cents("sum")).alias("rows_cents"), of("document total", cents("sum")).alias("total_cents"),
    )


@query("SELECT * FROM (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'none' WHEN p_partkey % 2 = 0 THEN 'low' ELSE 'high' END AS confidence, count(*) FILTER (WHERE p_partkey % 4 <> 0 AND p_partkey % 3 <> 0) AS n_right, count(*) FILTER (WHERE p_partkey % 4 <> 0 AND p_partkey % 3 = 0) AS n_wrong, count(*) AS asked FROM part GROUP BY 1)")
def q61_match_report(spark, sf_dir):
    """AGG-14: matches of which a third is wrong and a quarter missing."""
    truth = catalogue(spark, sf_dir).select(F.col("catalog_ord").alias("q_id"), "barcode")
    key = F.col("q_id")
    found = truth.where(key % 4 != 0).select("q_id", F.when(key % 3 == 0, "x").otherwise(F.col("barcode")).alias("barcode"), F.when(key % 2 == 0, "low").otherwise("high").alias("confidence"))
    return resolve.match_report(found, truth)


@query("""WITH s AS (SELECT o_custkey AS doc_id, o_orderkey AS arrived, CASE WHEN o_orderkey % 3 = 0 THEN 'S' || CAST(o_orderkey AS VARCHAR) END AS supplier, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS number,
CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice END AS total FROM orders)
SELECT doc_id, arg_min(supplier, arrived) FILTER (WHERE supplier IS NOT NULL) AS supplier, arg_min(number, arrived + CASE WHEN total IS NULL THEN 0 ELSE 10000000 END) FILTER (WHERE number IS NOT NULL) AS number,
arg_max(total, arrived) FILTER (WHERE total IS NOT NULL) AS total, count(*) AS pages, string_agg(CAST(arrived % 7 AS VARCHAR), ',' ORDER BY total IS NOT NULL, arrived) AS sizes FROM s GROUP BY doc_id""")
def q62_merge_heads(spark, sf_dir):
    """SET-01: heads of documents whose sheets came one by one."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    sheets = o.select(
        F.col("o_custkey").alias("doc_id"), key.alias("arrived"), F.when(key % 3 == 0, F.concat(F.lit("S"), key.cast("string"))).alias("supplier"), F.when(key % 2 == 0, key.cast("string")).alias("number"),
        F.lit(None).cast("string").alias("date"), F.when(key % 5 == 0, F.col("o_totalprice")).alias("total"), (key % 7).alias("rows"),
    )
    return documents.merge_heads(sheets).drop("date").withColumn("sizes", F.array_join(F.col("sizes").cast("array<string>"), ","))


@query("""SELECT p_partkey, p_name AS name, CASE WHEN p_size % 10 = 1 AND p_size % 100 <> 11 THEN 'one' WHEN p_size % 10 BETWEEN 2 AND 4 AND p_size % 100 NOT BETWEEN 12 AND 14 THEN 'few' ELSE 'many' END AS form,
p_brand AS sort_key, CAST(p_size AS VARCHAR) AS num, CASE WHEN p_partkey % 2 = 0 THEN 'кг' END AS unit FROM part""")
def q63_cells_and_names(spark, sf_dir):
    """STR-18, STR-26, STR-27, NUM-23 on names and cells with what they should lose."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size").cast("string")
    cell = number_cell(F.concat(F.lit("| - "), size, F.when(F.col("p_partkey") % 2 == 0, " кг.").otherwise(" ")))
    worn = F.concat("p_name", F.lit(" "), size, F.lit(" блок |"))
    return p.select(
        "p_partkey", strip_trailing_quantity(worn, F.col("p_size").cast("double"), no_codes=True).alias("name"), plural("p_size", "one", "few", "many").alias("form"),
        supplier_sort_key(F.concat(F.lit("ТОО «"), "p_brand", F.lit("»"))).alias("sort_key"), cell["num"].alias("num"), cell["unit"].alias("unit"),
    )


_CASES = "SELECT l_orderkey, l_linenumber, l_quantity / (CASE WHEN l_linenumber % 2 = 0 THEN 2.0 ELSE 1.0 END) AS q, floor(l_extendedprice / l_quantity * 10) / 10 AS p, l_linenumber % 4 AS k FROM lineitem"


@query(f"""WITH c AS ({_CASES}), d AS (SELECT *, {R2.format('q * p')} AS c2 FROM c), e AS (SELECT *, CASE k WHEN 0 THEN floor(q * p + 0.5) WHEN 1 THEN floor(c2) + 0.2 WHEN 2 THEN c2 + 0.55 ELSE c2 END AS s FROM d)
SELECT l_orderkey, l_linenumber, abs(s - c2) <= greatest(0.02, q * 0.005 + 0.01) + 1e-9 OR (q <> floor(q) AND s = floor(s) AND s = floor(q * p + 0.5)) OR (q = floor(q) AND c2 = floor(c2) AND floor(s) = c2) AS fits FROM e""")
def q64_sum_cases(spark, sf_dir):
    """NUM-11: sums rounded, with spoilt cents, off by half, and exact, for whole and broken quantities."""
    at = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / F.when(F.col("l_linenumber") % 2 == 0, 2.0).otherwise(1.0)).alias("q"), (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 10) / 10).alias("p"), (F.col("l_linenumber") % 4).alias("k"))
    c2 = cents(F.col("q") * F.col("p")) / 100
    s = F.when(F.col("k") == 0, F.floor(F.col("q") * F.col("p") + 0.5).cast("double")).when(F.col("k") == 1, F.floor(c2) + 0.2).when(F.col("k") == 2, c2 + 0.55).otherwise(c2)
    return at.withColumn("s", s).select("l_orderkey", "l_linenumber", sum_matches(F.col("s"), F.col("q"), F.col("p")).alias("fits"))
