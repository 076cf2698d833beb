"""Problems of rows, their level, and document summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import cents, is_valid_ean, near
from .resolve import catalogue_codes
from .totals import tolerance


def issue(level: str, text: str, kind: str | None = None) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(text).alias("text"), F.lit(kind).cast("string").alias("kind"))


def problems(items: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """QA-01: ``problems`` of the row as it is now; unknown barcodes count only beside a catalogue that has any."""
    at = items
    unknown = F.lit(False)
    if catalogue is not None:
        known = catalogue_codes(catalogue).select(F.col("code").alias("barcode"), F.lit(True).alias("_known"))
        any_code = known.limit(1).select(F.lit(True).alias("_any"))
        at = at.join(known, "barcode", "left").join(F.broadcast(any_code), how="left")
        unknown = F.col("_any").isNotNull() & F.col("_known").isNull()
    code = F.col("barcode")
    some = F.coalesce(code != "", F.lit(False))
    n = F.char_length(code)
    found = F.array_compact(F.array(
        F.when(~some, issue("error", "no barcode", "barcode")),
        F.when(some & (F.col("barcode_source") == "catalog"), issue("warn", "barcode filled from the catalogue", "autofill")),
        F.when(some & ~code.rlike("^[0-9]+$"), issue("error", "barcode has other signs than digits")),
        F.when(some & code.rlike("^[0-9]+$") & n.isin(8, 13) & ~is_valid_ean(code) & ~code.startswith("2"), issue("warn", "check digit is wrong")),
        F.when(some & unknown, issue("warn", "barcode is not in the catalogue")),
        F.when(F.coalesce("qty", F.lit(0.0)) == 0, issue("error", "no quantity")),
        F.when(F.col("price").isNull(), issue("error", "no price")),
    ))
    return at.withColumn("problems", found).drop("_known", "_any")


def effective_issues() -> Column:
    """QA-02: problems and what the parse found, less what edits, other barcodes, a name or approval have settled."""
    parsed = F.filter("issues", lambda x: ~F.coalesce(F.col("edited"), F.lit(False)) & ((F.col("barcode_source") == "invoice") | ~x["kind"].eqNullSafe("ean")) & ~(x["kind"].eqNullSafe("noname") & (F.trim("name") != "")))
    every = F.concat("problems", parsed)
    return F.when(F.coalesce("approved", F.lit(False)), F.filter(every, lambda x: x["level"] != "warn")).otherwise(every)


def worst_level(issues: Column) -> Column:
    """QA-03: error, warn, todo (only the barcode is missing) or ok."""
    other = lambda level: F.exists(issues, lambda x: (x["level"] == level) & ~x["kind"].eqNullSafe("barcode"))
    return F.when(other("error"), "error").when(other("warn"), "warn").when(F.exists(issues, lambda x: x["kind"].eqNullSafe("barcode")), "todo").otherwise("ok")


def approve_all(items: DataFrame, issues: str = "all_issues") -> DataFrame:
    """QA-04."""
    warned = F.exists(issues, lambda x: x["level"] == "warn")
    return items.withColumn("approved", F.when(warned, True).otherwise(F.col("approved")))


def summarize(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """AGG-04: counts of a document by level; ``rows`` has ``level``; ``docs`` the printed ``total``."""
    each = rows.groupBy("doc_id").agg(
        F.count("*").alias("rows"), F.count_if((F.col("barcode") != "") & (F.col("qty") != 0)).alias("exportable"), F.count_if(F.coalesce("barcode", F.lit("")) == "").alias("missing_barcode"),
        F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warn").alias("warnings"), F.sum(F.coalesce(cents("sum"), F.lit(0))).alias("sum_cents"),
    )
    at = docs.join(each, "doc_id")
    return at.select("doc_id", "rows", "exportable", "missing_barcode", "errors", "warnings", "sum_cents", F.when(F.col("total").isNotNull(), near(F.col("total"), F.col("sum_cents") / 100, tolerance(F.col("rows")))).alias("totals_ok"))


def ready(summary: DataFrame) -> DataFrame:
    """AGG-15."""
    return summary.withColumn("ready", (F.col("errors") == 0) & F.coalesce("totals_ok", F.lit(True)) & (F.col("missing_barcode") == 0))


def quantity_by_unit(items: DataFrame) -> DataFrame:
    """AGG-05."""
    return items.groupBy("doc_id", F.coalesce("unit", F.lit("")).alias("unit")).agg(F.sum(F.coalesce("qty", F.lit(0.0)).cast("decimal(18,3)")).alias("qty"))


def paper_quantity(docs: DataFrame, items: DataFrame) -> DataFrame:
    """AGG-06: doc_id, ``on_paper`` (quantities before any conversion) and ``agrees`` with the printed quantity total."""
    qty = F.when(F.col("orig").isNotNull(), F.col("orig.qty")).otherwise(F.col("qty"))
    sums = items.groupBy("doc_id").agg(F.sum(F.coalesce(qty, F.lit(0.0)).cast("decimal(18,3)")).cast("double").alias("on_paper"))
    at = docs.select("doc_id", "total_qty").join(sums, "doc_id", "left")
    return at.select("doc_id", F.coalesce("on_paper", F.lit(0.0)).alias("on_paper"), F.coalesce(F.abs(F.col("total_qty") - F.coalesce("on_paper", F.lit(0.0))) < 0.0005, F.lit(False)).alias("agrees"))


def rows_by_unit(items: DataFrame) -> DataFrame:
    """AGG-07: doc_id, unit (empty: none) and its rows in order; a document's rows are few."""
    return items.groupBy("doc_id", F.coalesce("unit", F.lit("")).alias("unit")).agg(F.sort_array(F.collect_list("n")).alias("rows"))


def filled_and_partial(docs: DataFrame, items: DataFrame) -> DataFrame:
    """AGG-08: doc_id, ``filled`` (barcodes from the catalogue) and ``partial``: a printed total over 1.3 times the rows' sum."""
    each = items.groupBy("doc_id").agg(F.count_if(F.col("barcode_source") == "catalog").alias("filled"), F.sum(F.coalesce(cents("sum"), F.lit(0))).alias("c"))
    at = docs.select("doc_id", "total").join(each, "doc_id", "left")
    partial = (F.col("c") > 0) & (F.col("total") * 100 > F.col("c") * 1.3)
    return at.select("doc_id", F.coalesce("filled", F.lit(0)).alias("filled"), F.coalesce(partial, F.lit(False)).alias("partial"))


def barcode_origin(suppliers: DataFrame) -> DataFrame:
    """QA-05: where a supplier's barcodes come from, by the kind of its ``code`` column: ean, none, or own codes (null: own)."""
    kind = F.when(F.col("code") == "ean", "paper").when(F.col("code") == "none", "name").otherwise("once")
    return suppliers.withColumn("barcode_from", kind)
