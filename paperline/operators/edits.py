"""Unit rules, bulk edits and patches. Sums never change with a unit; what was on the paper is kept in ``orig`` once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round2, round3
from ..functions.strings import unit_key
from .resolve import map_code

ORIG = "struct<qty: double, unit: string, price: double>"


def remembered() -> Column:
    """EDIT-04: the original values, those kept before if any."""
    return F.coalesce("orig", F.struct("qty", "unit", "price").cast(ORIG))


def pack_count(qty: Column) -> Column:
    """EDIT-04: how many packs the quantity makes."""
    return F.when(F.col("pack").isNotNull() & qty.isNotNull(), F.struct(round2(qty / F.col("pack.size")).alias("count"), F.col("pack.size").alias("size"))).otherwise(F.col("pack"))


def _changed(items: DataFrame, test: Column, **new: Column) -> DataFrame:
    test = F.coalesce(test, F.lit(False))
    if "qty" in new and "pack" in items.columns:
        new["pack"] = pack_count(new["qty"])
    return items.withColumns({c: F.when(test, v).otherwise(F.col(c)) for c, v in new.items()})


def with_orig(items: DataFrame) -> DataFrame:
    return items if "orig" in items.columns else items.withColumn("orig", F.lit(None).cast(ORIG))


def convert(items: DataFrame, test: Column, factor: Column | float, unit: Column) -> DataFrame:
    """EDIT-02: quantity times the factor, price divided by it, a new unit."""
    factor = F.lit(factor) if isinstance(factor, (int, float)) else factor
    test = test & (factor > 0) & (factor != 1)
    return _changed(with_orig(items), test, orig=remembered(), qty=round3(F.col("qty") * factor), price=round2(F.col("price") / factor), unit=unit)


def scale(items: DataFrame, test: Column, field: str, factor: float) -> DataFrame:
    """EDIT-02: one of quantity and price times a factor."""
    value = (round3 if field == "qty" else round2)(F.col(field) * factor)
    return _changed(with_orig(items), test & F.col(field).isNotNull() & F.lit(factor > 0 and factor != 1), orig=remembered(), **{field: value})


def set_unit(items: DataFrame, test: Column, unit: str) -> DataFrame:
    """EDIT-02: nothing happens if the units differ in case or a point only."""
    same = unit_key(F.coalesce("unit", F.lit(""))) == unit_key(F.lit(unit))
    return _changed(with_orig(items), test & ~same, orig=remembered(), unit=F.lit(unit or None).cast("string"))


def restore(items: DataFrame, test: Column) -> DataFrame:
    """EDIT-02: back to what was on the paper."""
    back = {c: F.col(f"orig.{c}") for c in ("qty", "unit", "price")}
    return _changed(items, test & F.col("orig").isNotNull(), **back, orig=F.lit(None).cast(ORIG))


def apply_unit_rules(items: DataFrame, rules: DataFrame) -> DataFrame:
    """EDIT-01, JOIN-21: the first rule for the unit, on rows not converted before; applying twice changes nothing more.

    ``rules``: rule_ord, from, to, factor; a setting of a few rows, reduced to one for each unit.
    """
    usable = rules.where((F.col("factor") > 0) & (unit_key("from") != unit_key("to"))).withColumn("_unit", unit_key("from"))
    first = usable.groupBy("_unit").agg(F.min_by(F.struct("to", "factor"), "rule_ord").alias("_rule"))
    at = with_orig(items).withColumn("_unit", unit_key("unit")).join(first, "_unit", "left")
    test = F.col("_rule").isNotNull() & F.col("orig").isNull() & F.col("qty").isNotNull()
    return convert(at, test, F.col("_rule.factor"), F.col("_rule.to")).drop("_unit", "_rule")


def bulk(items: DataFrame, rows: DataFrame, edit) -> DataFrame:
    """EDIT-03: ``edit(items, test)`` on the rows listed by (doc_id, n)."""
    at = items.join(rows.select("doc_id", "n").distinct().withColumn("_chosen", F.lit(True)), ["doc_id", "n"], "left")
    return edit(at, F.col("_chosen").isNotNull()).drop("_chosen")


def patch(items: DataFrame, edits: DataFrame) -> DataFrame:
    """EDIT-05: typed values (null: untouched) over rows: ``edits`` has doc_id, n and any of name, qty, price, barcode, approved.

    An approval alone does not make a row edited; packs follow a typed quantity.

    A typed quantity or price makes the sum anew; a typed name is the user's own and the paper's name is kept; a typed barcode is
    the user's own, drops the former main code and, if it differs, the approval and a name set by hand.
    """
    fields = [c for c in ("name", "qty", "price", "barcode") if c in edits.columns]
    at = items.join(edits.select("doc_id", "n", *[F.col(c).alias(f"_{c}") for c in [*fields, *(["approved"] if "approved" in edits.columns else [])]], F.lit(True).alias("_hit")), ["doc_id", "n"], "left")
    typed = lambda c: F.col(f"_{c}").isNotNull() if c in fields else F.lit(False)
    value = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)) if c in fields else F.col(c)
    qty, price = value("qty"), value("price")
    approval = F.coalesce("_approved", "approved") if "approved" in edits.columns else F.col("approved")
    touched = reduce(lambda a, b: a | b, [typed(c) for c in fields], F.lit(False))
    other_code = typed("barcode") & ~F.col("barcode").eqNullSafe(value("barcode"))
    new = {
        "name": value("name"), "qty": qty, "price": price, "barcode": value("barcode"),
        "sum": F.when((typed("qty") | typed("price")) & qty.isNotNull() & price.isNotNull(), round2(qty * price)).otherwise(F.col("sum")),
        "edited": touched | F.coalesce("edited", F.lit(False)),
        "invoice_name": F.when(typed("name"), F.coalesce("invoice_name", F.nullif("name", F.lit("")))).otherwise(F.col("invoice_name")),
        "name_source": F.when(typed("name"), F.lit("manual")).when(other_code & (F.col("name_source") == "manual"), F.lit(None)).otherwise(F.col("name_source")),
        "barcode_source": F.when(typed("barcode"), F.lit("manual")).otherwise(F.col("barcode_source")),
        "alt_barcode": F.when(typed("barcode"), F.lit(None)).otherwise(F.col("alt_barcode")),
        "approved": F.when(other_code, F.lit(None)).when(F.coalesce("_hit", F.lit(False)), approval).otherwise(F.col("approved")),
    }
    if "pack" in items.columns:
        new["pack"] = F.when(typed("qty"), pack_count(qty)).otherwise(F.col("pack"))
    return at.withColumns(new).drop("_hit", "_approved", *[f"_{c}" for c in fields])


def new_row(items: DataFrame, doc_id: object) -> DataFrame:
    """EDIT-06, EDIT-12: an empty row behind the last one of a document; its name is the empty text, all else is null."""
    last = items.where(F.col("doc_id") == F.lit(doc_id)).agg((F.coalesce(F.max("n"), F.lit(0)) + 1).cast(items.schema["n"].dataType).alias("n"))
    row = last.select(F.lit(doc_id).cast(items.schema["doc_id"].dataType).alias("doc_id"), "n", *([F.lit("").alias("name")] if "name" in items.columns else []))
    return items.unionByName(row, allowMissingColumns=True)


def remove_rows(items: DataFrame, rows: DataFrame) -> DataFrame:
    """EDIT-12: without the listed rows (doc_id, n); those behind are numbered anew."""
    left = items.join(rows.select("doc_id", "n"), ["doc_id", "n"], "left_anti")
    return left.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("n")).cast(items.schema["n"].dataType))


def edit_head(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """EDIT-12: typed head fields (null: untouched, empty: cleared) over ``docs``; ``edits`` has doc_id and some of their columns."""
    fields = [c for c in edits.columns if c != "doc_id"]
    at = docs.join(edits.select("doc_id", *[F.col(c).alias(f"_{c}") for c in fields]), "doc_id", "left")
    return at.withColumns({c: F.when(F.col(f"_{c}").isNotNull(), F.nullif(f"_{c}", F.lit(""))).otherwise(F.col(c)) for c in fields}).drop(*[f"_{c}" for c in fields])


def toggled(items: DataFrame, clicks: DataFrame) -> DataFrame:
    """EDIT-10: ``selected`` after a click in each document: all rows between the last click and this one take the state that this
    row did not have. ``items`` has ``selected``; ``clicks``: doc_id, n, last (null: no range)."""
    at = items.join(clicks.select("doc_id", F.col("n").alias("_n"), F.least("n", F.coalesce("last", "n")).alias("_low"), F.greatest("n", F.coalesce("last", "n")).alias("_high")), "doc_id", "left")
    was = F.bool_or((F.col("n") == F.col("_n")) & F.coalesce("selected", F.lit(False))).over(Window.partitionBy("doc_id"))
    hit = F.coalesce(F.col("n").between(F.col("_low"), F.col("_high")), F.lit(False))
    return at.withColumn("selected", F.when(hit, ~F.coalesce(was, F.lit(False))).otherwise(F.coalesce("selected", F.lit(False)))).drop("_n", "_low", "_high")


def targets(items: DataFrame) -> DataFrame:
    """EDIT-08: the selected rows of each document, or all of a document that has none."""
    some = F.bool_or(F.coalesce("selected", F.lit(False))).over(Window.partitionBy("doc_id"))
    return items.withColumn("_some", some).where(F.coalesce("selected", F.lit(False)) | ~F.col("_some")).drop("_some")


def preset_targets(items: DataFrame, unit: str) -> DataFrame:
    """EDIT-08: the rows that a rule for a unit is meant for: the selected ones, else those with the unit."""
    some = F.bool_or(F.coalesce("selected", F.lit(False))).over(Window.partitionBy("doc_id"))
    own = F.coalesce(unit_key(F.coalesce("unit", F.lit(""))) == unit_key(F.lit(unit)), F.lit(False))
    return items.withColumn("_some", some).where(F.when(F.col("_some"), F.coalesce("selected", F.lit(False))).otherwise(own)).drop("_some")


def convertible(items: DataFrame, rules: DataFrame) -> DataFrame:
    """EDIT-11: how many rows of each open document the unit rules would convert."""
    usable = rules.where((F.col("factor") > 0) & (unit_key("from") != unit_key("to"))).select(unit_key("from").alias("_unit")).distinct()
    hit = with_orig(items).where(F.col("orig").isNull() & F.col("qty").isNotNull()).withColumn("_unit", unit_key("unit"))
    return hit.join(usable, "_unit", "left_semi").groupBy("doc_id").agg(F.count("*").alias("rows"))


class Undo:
    """EDIT-09: the last state before a bulk edit. A state is a plan, so keeping one costs nothing."""

    def __init__(self, items: DataFrame) -> None:
        self.items, self.before = items, None

    def bulk(self, rows: DataFrame, edit) -> DataFrame:
        self.before, self.items = self.items, bulk(self.items, rows, edit)
        return self.items

    def undo(self) -> DataFrame:
        self.items, self.before = self.before if self.before is not None else self.items, None
        return self.items


def toggle_column(columns: list[str], column: str) -> list[str]:
    """EDIT-13: a column of the export put in at the end or taken out; the last one stays."""
    if column not in columns:
        return [*columns, column]
    return [c for c in columns if c != column] or columns


def move_column(columns: list[str], column: str, step: int) -> list[str]:
    """EDIT-13: a column swapped with the one ``step`` (1 or -1) beside it, if there is one."""
    to = columns.index(column) + step if column in columns else -1
    if not 0 <= to < len(columns):
        return columns
    other = columns[to]
    return [other if c == column else column if c == other else c for c in columns]


def forget(dictionary: DataFrame, entries: DataFrame) -> DataFrame:
    """EDIT-14: the dictionary without the listed entries (supplier_key, map_code)."""
    return dictionary.join(entries.select("supplier_key", "map_code"), ["supplier_key", "map_code"], "left_anti")


def next_without_barcode(items: DataFrame, positions: DataFrame) -> DataFrame:
    """EDIT-15: for each position (doc_id, n) the first later row of the document without a barcode (null: none)."""
    bare = items.where(F.coalesce("barcode", F.lit("")) == "").select("doc_id", F.col("n").alias("_n"))
    at = positions.select("doc_id", "n").join(bare, "doc_id", "left").groupBy("doc_id", "n")
    return at.agg(F.min(F.when(F.col("_n") > F.col("n"), F.col("_n"))).alias("next_n"))


def remembered_barcodes(dictionary: DataFrame, items: DataFrame, typed: DataFrame) -> DataFrame:
    """EDIT-07: the dictionary with barcodes typed into rows (``typed``: doc_id, n, barcode, updated), under code or name.

    A barcode that the paper gives is not learnt; of several for one key the last counts. ``dictionary_exact`` then brings them to the supplier's
    other documents.
    """
    key = map_code(F.col("code"), F.coalesce("invoice_name", "name"))
    at = items.where(~F.coalesce(F.col("barcode_source") == "invoice", F.lit(False))).drop("barcode").join(typed.where("barcode != ''"), ["doc_id", "n"])
    at = at.select("supplier_key", key.alias("map_code"), "barcode", F.coalesce("invoice_name", "name").alias("name"), "updated").where("map_code is not null")
    new = at.groupBy("supplier_key", "map_code").agg(F.max_by(F.struct("barcode", "name", "updated"), F.struct("updated", "barcode")).alias("x")).select("supplier_key", "map_code", "x.*")
    return forget(dictionary, new).unionByName(new, allowMissingColumns=True)
