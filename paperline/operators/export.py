"""Export lines, reports and the hand-off document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import cents, round2
from ..functions.strings import base64url_json, tsv_cell
from .stage import stored

COLUMNS = ("barcode", "qty", "price", "name", "sum", "code", "unit")


def merge_key() -> Column:
    """AGG-02: the catalogue product if there is one, else the barcode."""
    return F.coalesce(F.concat(F.lit("prod:"), F.nullif("catalog_barcode", F.lit(""))), F.concat(F.lit("bc:"), "barcode"))


def exportable(items: DataFrame) -> DataFrame:
    """FLT-01."""
    return items.where((F.col("barcode") != "") & (F.col("qty") != 0))


def by_packs(items: DataFrame) -> DataFrame:
    """PRJ-01: rows of whole packs counted in packs."""
    whole = F.col("pack").isNotNull() & F.col("qty").isNotNull() & F.col("sum").isNotNull()
    packs = F.col("qty") / F.col("pack.size")
    return items.withColumns({"qty": F.when(whole, packs).otherwise(F.col("qty")), "price": F.when(whole, round2(F.col("sum") / packs)).otherwise(F.col("price")), "unit": F.when(whole, "уп").otherwise(F.col("unit"))})


def export_lines(items: DataFrame) -> DataFrame:
    """AGG-01: one line for each product of a document, in the order of first rows (``n``).

    Quantity and sum add up; the price is the mean weighted by quantity; a line alone keeps its own. Name, unit and code are
    those of the first row. The barcode is the catalogue's if several were merged. Everything is an algebraic aggregate, so the
    map side combines; sums are of decimals and don't depend on order.
    """
    at = exportable(items).withColumns({"_key": merge_key(), "_sum": F.coalesce("sum", round2(F.col("qty") * F.col("price")))})
    product = F.coalesce("price", F.lit(0.0)) * F.coalesce("qty", F.lit(0.0))
    first = F.min(F.struct("n", "barcode", "name", "unit", "code", "price", "catalog_barcode")).alias("f")
    lines = at.groupBy("doc_id", "_key").agg(
        first, F.count("*").alias("merged"), F.min("barcode").alias("low"), F.max("barcode").alias("high"), F.sum(F.col("qty").cast("decimal(18,3)")).alias("qty"),
        F.sum(cents("_sum")).alias("c"), F.sum(product.cast("decimal(28,6)")).alias("pq"),
    )
    qty = F.col("qty").cast("double")
    price = F.when(F.col("merged") == 1, F.col("f.price")).otherwise(round2(F.col("pq").cast("double") / qty))
    code = F.when(F.col("low") != F.col("high"), F.coalesce("f.catalog_barcode", "f.barcode")).otherwise(F.col("f.barcode"))
    return lines.select("doc_id", F.col("f.n").alias("n"), code.alias("barcode"), qty.alias("qty"), price.alias("price"), "f.name", (F.col("c") / 100).alias("sum"), "f.code", "f.unit", "merged")


def merged_count(items: DataFrame) -> DataFrame:
    """AGG-03: rows that go into others."""
    keys = exportable(items).groupBy("doc_id", merge_key().alias("k")).agg(F.count("*").alias("n"))
    return keys.groupBy("doc_id").agg((F.sum("n") - F.count("*")).alias("merged"))


def tsv(lines: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """PRJ-02, SNK-02: a text line for each export line, with the columns asked for."""
    return lines.select("doc_id", "n", F.concat_ws("\t", *[tsv_cell(F.col(c)) for c in columns]).alias("line"))


def report(items: DataFrame) -> DataFrame:
    """AGG-12: rows summed by supplier and document, with subtotals and a grand total."""
    return items.rollup("supplier_key", "doc_id").agg(F.count("*").alias("rows"), F.sum(cents("sum")).alias("sum_cents"), F.grouping_id().alias("level"))


def handoff(lines: DataFrame, base: str = "") -> DataFrame:
    """PRJ-03, SNK-04: a link that carries the document's lines. A document has a bounded number of lines."""
    line = F.struct("n", "barcode", "name", "qty", "price", "sum")
    body = F.struct(F.lit(1).alias("v"), F.transform(F.array_sort(F.collect_list(line)), lambda x: x.dropFields("n")).alias("items"))
    docs = lines.groupBy("doc_id").agg(body.alias("body"))
    return docs.select("doc_id", F.concat(F.lit(f"{base}#/invoice?d="), base64url_json(F.col("body"))).alias("link"))


#: Labels of the export's columns.
LABELS = {"barcode": "Barcode", "qty": "Quantity", "price": "Price", "name": "Name", "sum": "Sum", "code": "Code", "unit": "Unit"}
#: Longest name of a sheet, and of the supplier in it.
SHEET_NAME, SUPPLIER_NAME = 31, 24


def labelled(lines: DataFrame, columns: list[str]) -> DataFrame:
    """PRJ-02: the chosen columns in their order, under their labels."""
    return lines.select(*[F.col(c).alias(LABELS[c]) for c in columns])


def sheet_names(docs: DataFrame) -> DataFrame:
    """LIM-03: doc_id and ``sheet``, unique without regard to case: supplier and number, cut to 31 characters, with a number behind later ones.

    A name that another document has by itself is its own; the others of a name take the numbers from 2 that no document's own name
    has with that ending. Numbers are dealt within a name, so no document waits for all others; names whose numbered forms meet (by a
    cut) are told apart by the documents' order in one more round, until all differ.
    """
    name = F.concat(F.substring(F.regexp_replace(F.coalesce("supplier", F.lit("Invoice")), r'[\\/?*\[\]:"]', ""), 1, SUPPLIER_NAME), F.coalesce(F.concat(F.lit(" "), "number"), F.lit("")))
    at = docs.select("doc_id", "ord", F.substring(name, 1, SHEET_NAME).alias("_name"))
    first = F.row_number().over(Window.partitionBy(F.lower("_name")).orderBy("ord", "doc_id"))
    at = at.withColumn("_k", first)
    done, rest = at.where("_k = 1").select("doc_id", F.col("_name").alias("sheet")), at.where("_k > 1").select("doc_id", "ord", F.substring("_name", 1, SHEET_NAME - 3).alias("_stem"))
    while True:
        done, rest = stored(done, "sheets"), stored(rest, "unnamed")
        if rest.isEmpty():
            return done
        stem = F.lower("_stem")
        number = F.regexp_extract(F.lower("sheet"), r"^(.*) ([0-9]{1,9})$", 2)
        taken = done.select(F.regexp_extract(F.lower("sheet"), r"^(.*) ([0-9]{1,9})$", 1).alias("_s"), number.cast("int").alias("_n")).where(number != "").groupBy("_s").agg(F.collect_set("_n").alias("_taken"))
        own = rest.withColumns({"_s": stem, "_k": F.row_number().over(Window.partitionBy(stem).orderBy("ord", "doc_id"))})
        # of the numbers from 2 that are free for a stem, the k-th goes to its k-th document
        most = own.groupBy("_s").agg(F.max("_k").alias("_most")).join(taken, "_s", "left")
        free = F.array_except(F.sequence(F.lit(2), F.lit(1) + F.col("_most") + F.size(F.coalesce("_taken", F.array().cast("array<int>")))), F.coalesce("_taken", F.array().cast("array<int>")))
        named = own.join(most.select("_s", free.alias("_free")), "_s").withColumn("_n", F.get("_free", F.col("_k") - 1))
        room = F.lit(SHEET_NAME) - F.char_length(F.col("_n").cast("string")) - 1
        named = named.withColumn("sheet", F.concat(F.substring("_stem", F.lit(1), room), F.lit(" "), F.col("_n").cast("string")))
        # a stem cut shorter for its number may meet another's; one of them waits for the next round
        met = F.row_number().over(Window.partitionBy(F.lower("sheet")).orderBy("ord", "doc_id"))
        clash = done.select(F.lower("sheet").alias("_low"), F.lit(True).alias("_held")).distinct()
        named = named.withColumns({"_low": F.lower("sheet"), "_met": met}).join(clash, "_low", "left")
        good = named["_held"].isNull() & (F.col("_met") == 1)
        rest = named.where(~good).select("doc_id", "ord", F.when(F.char_length("_stem") > room, F.substring("_stem", F.lit(1), room)).otherwise(F.col("_stem")).alias("_stem"))
        done = done.unionByName(named.where(good).select("doc_id", "sheet"))


def report_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """SNK-03: rows of the report: sheet, kind (head, item, rows total, document total), n and the columns of its table.

    ``remarks`` joins what the barcode was taken from, what stood on the paper, and the issues above information (those about check
    digits only for barcodes from the paper). ``docs``: doc_id, ord, supplier, number, date, total; ``items``: issues (array of
    level, kind, text), orig and more.
    """
    said = F.filter("issues", lambda x: (x["level"] != "info") & ~(x["kind"].eqNullSafe("ean") & ~F.coalesce(F.col("barcode_source") == "invoice", F.lit(False))))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    paper = F.when(F.col("orig").isNotNull(), F.concat_ws(" ", F.lit("On paper:"), text(F.col("orig.qty")), F.col("orig.unit"), F.lit("at"), text(F.col("orig.price"))))
    source = F.when(F.col("barcode_source") == "catalog", F.lit("Barcode filled from the catalogue, check it"))
    remarks = F.concat_ws("; ", source, paper, F.array_join(F.transform(F.coalesce(said, F.array().cast("array<struct<level:string,kind:string,text:string>>")), lambda x: x["text"]), "; "))
    other_name = F.when(F.col("invoice_name") != F.col("name"), F.col("invoice_name"))
    names = sheet_names(docs)
    rows = items.join(names, "doc_id").select("doc_id", "sheet", F.lit("item").alias("kind"), "n", "barcode", "code", "name", other_name.alias("invoice_name"), "unit", "qty", "price", "sum", F.regexp_replace(remarks, "; $", "").alias("remarks"))
    head = docs.join(names, "doc_id").select("doc_id", "sheet", F.lit("head").alias("kind"), F.concat_ws(" | ", F.coalesce("supplier", F.lit("")), F.coalesce("number", F.lit("")), F.coalesce(F.col("date").cast("string"), F.lit(""))).alias("name"))
    foot = items.groupBy("doc_id").agg((F.sum(F.coalesce(cents("sum"), F.lit(0))) / 100).alias("sum")).join(names, "doc_id").select("doc_id", "sheet", F.lit("rows total").alias("kind"), "sum")
    total = docs.where("total is not null").join(names, "doc_id").select("doc_id", "sheet", F.lit("document total").alias("kind"), F.col("total").alias("sum"))
    return rows.unionByName(head, True).unionByName(foot, True).unionByName(total, True)


def wrong_types(lines: DataFrame) -> list[str]:
    """QA-06: columns of the export that are not of their kind: quantities, prices and sums are numbers, all else is text."""
    numbers = {"qty", "price", "sum"}
    return [c for c, t in lines.dtypes if c in COLUMNS and (c in numbers) != (t in ("double", "float", "int", "bigint") or t.startswith("decimal"))]
