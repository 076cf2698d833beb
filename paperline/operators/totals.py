"""Document totals: check against the rows, and the repairs that a printed total allows.

``items`` has doc_id, n, qty, price, sum; ``docs`` has doc_id and the printed ``total`` (with ``vat`` and ``total_qty`` where a
repair needs them). Sums are of whole cents, so they don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import cents, near, round2, vat_of
from .reconcile import RATES


def row_totals(items: DataFrame) -> DataFrame:
    """TOT-01: doc_id, ``rows``, ``rows_sum``, ``rows_qty``."""
    return items.groupBy("doc_id").agg(
        F.count("*").alias("rows"), (F.sum(F.coalesce(cents("sum"), F.lit(0))) / 100).alias("rows_sum"), F.sum(F.coalesce("qty", F.lit(0.0)).cast("decimal(18,3)")).alias("rows_qty")
    )


def tolerance(rows: Column) -> Column:
    return 0.05 + 0.01 * rows


def check_totals(docs: DataFrame, items: DataFrame) -> DataFrame:
    """TOT-03: the total that counts, its difference from the rows and ``status``: info, error or warn; error too without rows.

    A whole total a hundred times too large has lost its decimals. ``other_totals`` (an array, if the column is there) may hold
    another reading that agrees.
    """
    at = docs.join(row_totals(items), "doc_id", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    t, s = F.col("total"), F.col("rows_sum")
    lost = (t % 100 == 0) & (t >= s * 50) & (t / 100).between(s * 0.5, s * 2)
    read = F.when(lost, t / 100).otherwise(t)
    tol = tolerance(F.col("rows"))
    others = F.col("other_totals") if "other_totals" in docs.columns else F.array().cast("array<double>")
    other = F.get(F.filter(others, lambda x: near(x, s, tol)), F.lit(0))
    used = F.when(read.isNotNull() & ~near(read, s, tol), F.coalesce(other, read)).otherwise(read)
    status = F.when(F.col("rows") == 0, "error").when(used.isNull(), "warn").when(near(used, s, tol), "info").otherwise("error")
    return at.select("doc_id", "rows", "rows_sum", used.alias("total"), round2(used - s).alias("difference"), status.alias("status"))


def fix_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """TOT-04: ``items`` with one row, or else two, changed to an alternative so that the total is met; a sole solution only.

    ``alternatives`` is an array of (qty, price, sum), a few at most for each row. Pairs are looked up by the cents that are
    missing, within tolerance, and only in documents that no single change settles.
    """
    sums = row_totals(items)
    need = docs.join(sums, "doc_id").where(F.col("total").isNotNull() & ~near(F.col("total"), F.col("rows_sum"), tolerance(F.col("rows"))))
    need = need.select("doc_id", (F.col("total") - F.col("rows_sum")).alias("need"), tolerance(F.col("rows")).alias("tol"))
    options = items.select("doc_id", "n", "sum", F.posexplode("alternatives").alias("k", "alt")).select("doc_id", "n", "k", "alt", (F.col("alt.sum") - F.coalesce("sum", F.lit(0.0))).alias("delta"))
    options = options.join(need, "doc_id")
    single = options.where(near(F.col("delta"), F.col("need"), F.col("tol")))
    hits = single.groupBy("doc_id").agg(F.count("*").alias("hits"), F.min(F.struct("n", "k")).alias("x"))
    one = hits.where("hits = 1").select("doc_id", F.array("x").alias("changes"))
    open_docs = options.join(hits.select("doc_id"), "doc_id", "left_anti").select("doc_id", "n", "k", "delta", "need", "tol")
    a, b = open_docs.alias("a"), open_docs.alias("b")
    pair = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.n") < F.col("b.n")) & near(F.col("a.delta") + F.col("b.delta"), F.col("a.need"), F.col("a.tol")))
    pairs = pair.groupBy(F.col("a.doc_id").alias("doc_id")).agg(F.count("*").alias("hits"), F.min(F.array(F.struct("a.n", "a.k"), F.struct("b.n", "b.k"))).alias("changes"))
    two = pairs.where("hits = 1").select("doc_id", "changes")
    change = one.union(two).select("doc_id", F.explode("changes").alias("x")).select("doc_id", "x.n", F.col("x.k").alias("_k"))
    at = items.join(change, ["doc_id", "n"], "left")
    alt = F.get("alternatives", F.col("_k"))
    new = {c: F.coalesce(alt[c], F.col(c)) for c in ("qty", "price", "sum")}
    return at.withColumns(new | {"restored": F.col("_k").isNotNull()}).drop("_k")


def fill_row(docs: DataFrame, items: DataFrame) -> DataFrame:
    """TOT-05: the one weak row of a document gets what the total leaves for it.

    Weak: no quantity or sum, or ``support`` of two or less. Its sum is the total less the other rows; its digits must be those of a
    read sum (``sums``), or part of them, or hold them, so that the total of other sheets is not forced into a row. The quantity is
    that sum over the first read price (``prices``) that gives a whole one, or one in thousandths where goods are weighed; a row
    without any price keeps its quantity. The sole whole solution counts, else the sole one.
    """
    doc = Window.partitionBy("doc_id")
    all_rows = F.sum(F.coalesce(cents("sum"), F.lit(0))).over(doc)
    broken = F.coalesce(F.col("qty") != F.floor("qty"), F.lit(False)).cast("int")
    weighed = (F.col("unit").eqNullSafe("кг") if "unit" in items.columns else F.lit(False)) | (F.sum(broken).over(doc) - broken > 0)
    at = items.withColumns({"_rest": all_rows - F.coalesce(cents("sum"), F.lit(0)), "_weighed": weighed}).join(docs.select("doc_id", F.col("total").alias("_total")), "doc_id", "left")
    weak = F.col("qty").isNull() | F.col("sum").isNull() | (F.coalesce("support", F.lit(3)) <= 2)
    at = at.withColumn("_left", F.when(weak, round2(F.col("_total") - F.col("_rest") / 100))).withColumn("_left", F.when(F.col("_left") > 0, F.col("_left")))
    read = F.transform(F.coalesce("sums", F.array().cast("array<double>")), _digits) if "sums" in items.columns else F.array().cast("array<string>")
    own = _digits(F.col("_left"))
    at = at.withColumn("_seen", F.exists(F.filter(read, lambda d: F.char_length(d) >= 2), lambda d: own.contains(d) | d.contains(own)))
    prices = F.array_distinct(F.concat(F.coalesce("prices", F.array().cast("array<double>")), F.when(F.col("price") > 0, F.array("price")).otherwise(F.array().cast("array<double>"))))
    left = F.col("_left")
    ratio = lambda p: F.floor(left / p * 1000 + 0.5) / 1000
    fits = F.filter(prices, lambda p: (p > 0) & (ratio(p) > 0) & (ratio(p) < 100000) & (F.abs(left / p - ratio(p)) < 1e-6))
    whole = F.get(F.filter(fits, lambda p: ratio(p) == F.floor(ratio(p))), F.lit(0))
    at = at.withColumn("_price", F.coalesce(whole, F.when(F.col("_weighed"), F.get(fits, F.lit(0)))))
    priceless = (F.size(prices) == 0) & (F.col("qty") > 0)
    solved = F.when(F.col("_seen") & F.col("_price").isNotNull(), F.struct(ratio(F.col("_price")).alias("q"), F.col("_price").alias("p")))
    solved = F.coalesce(solved, F.when(F.col("_seen") & priceless, F.struct(F.col("qty").alias("q"), round2(left / F.col("qty")).alias("p"))))
    at = at.withColumn("_x", solved)
    is_whole = F.coalesce(F.col("_x.q") == F.floor("_x.q"), F.lit(False))
    at = at.withColumns({"_whole": F.sum(is_whole.cast("int")).over(doc), "_hits": F.count("_x").over(doc)})
    fix = F.col("_x").isNotNull() & F.when(F.col("_whole") == 1, is_whole).otherwise(F.col("_hits") == 1)
    new = {"sum": F.when(fix, left).otherwise(F.col("sum")), "qty": F.when(fix, F.col("_x.q")).otherwise(F.col("qty")), "price": F.when(fix, F.col("_x.p")).otherwise(F.col("price"))}
    return at.withColumns(new | {"filled": fix}).drop("_rest", "_weighed", "_total", "_left", "_seen", "_price", "_x", "_whole", "_hits")


def _digits(amount: Column) -> Column:
    """The digits of an amount, cents only if there are some."""
    c = cents(amount)
    return F.when(c % 100 == 0, (c / 100).cast("long").cast("string")).otherwise(c.cast("string"))


def total_by_vat(docs: DataFrame, items: DataFrame) -> DataFrame:
    """TOT-06: ``docs`` whose total disagrees with the rows while its VAT agrees get the rows' sum as total."""
    at = docs.join(row_totals(items), "doc_id", "left")
    tol = tolerance(F.col("rows"))
    vat_fits = F.lit(False)
    for rate in RATES:
        vat_fits = vat_fits | near(F.col("vat"), vat_of(F.col("rows_sum"), rate), tol)
    fix = F.col("total").isNotNull() & F.col("vat").isNotNull() & ~near(F.col("total"), F.col("rows_sum"), tol) & vat_fits
    return at.withColumns({"restored": F.coalesce(fix, F.lit(False)), "total": F.when(fix, F.col("rows_sum")).otherwise(F.col("total"))}).drop("rows", "rows_sum", "rows_qty")


WEIGHED = "(?i)^(кг|л|м|г)(?![а-яё])|^kg$"


def qty_by_total(docs: DataFrame, items: DataFrame) -> DataFrame:
    """TOT-07: a quantity with a shifted decimal, if the quantity total points at one row alone; its sum stays."""
    at = items.join(docs.select("doc_id", F.col("total_qty").alias("_want")), "doc_id", "left")
    doc = Window.partitionBy("doc_id")
    have = F.sum(F.coalesce("qty", F.lit(0.0)).cast("decimal(18,3)")).over(doc).cast("double")
    at = at.withColumn("_diff", F.col("_want") - have).withColumn("_have", have)
    usable = (F.abs("_diff") >= 0.0005) & (F.abs("_diff") <= F.col("_have") * 0.5)
    at = at.withColumn("_k", F.when(usable, F.when(F.col("_diff") < 0, 0.1).otherwise(10.0)))
    new_qty = F.floor(F.col("qty") * F.col("_k") * 1000 + 0.5) / 1000
    fits = (F.col("qty") > 0) & F.col("price").isNotNull() & near(F.col("qty") * F.col("_k") - F.col("qty"), F.col("_diff"), 0.0005) & ((new_qty == F.floor(new_qty)) | F.coalesce(F.col("unit").rlike(WEIGHED), F.lit(False)))
    at = at.withColumn("_hit", F.coalesce(fits, F.lit(False))).withColumn("_hits", F.sum(F.col("_hit").cast("int")).over(doc))
    fix = F.col("_hit") & (F.col("_hits") == 1)
    new = {"qty": F.when(fix, new_qty).otherwise(F.col("qty")), "price": F.when(fix, round2(F.col("price") / F.col("_k"))).otherwise(F.col("price"))}
    return at.withColumns(new | {"shifted": fix}).drop("_want", "_diff", "_have", "_k", "_hit", "_hits")


def fix_by_totals(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """TOT-08: (docs, items): the total restored by its VAT, then a shifted quantity by the quantity total."""
    return total_by_vat(docs, items).drop("restored"), qty_by_total(docs, items)
