"""Open documents: edits, what is learnt, the chain of resolution, heads and reports, on small tables."""

import pytest
from pyspark.sql import functions as F

from paperline.functions.numbers import format_quantity, number_cell, parse_amount, sum_matches
from paperline.operators import documents, edits, export, quality, resolve, totals


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"v{i} {'string' if isinstance(v, str) else 'double'}" for i, v in enumerate(values)))
    return df.select(column(*[F.col(f"v{i}") for i in range(len(values))]).alias("x")).first().x


def test_numbers(spark):
    assert one(spark, parse_amount, "11 136,00") == 11136.0 and one(spark, parse_amount, "1　200.5") == 1200.5
    assert one(spark, sum_matches, 781.55, 0.5, 1562.0) is False and one(spark, sum_matches, 2646.2, 6.0, 441.0) is True and one(spark, sum_matches, 781.0, 0.5, 1562.0) is True
    assert [one(spark, format_quantity, x) for x in (1234.5, 12.0, 0.125, -3.25)] == ["1 234,5", "12", "0,125", "-3,25"]
    cell = lambda t: one(spark, number_cell, t)
    assert tuple(cell("12 шт.")) == ("12", "шт") and tuple(cell("$ бут")) == ("5", "бут") and tuple(cell("| - 4,50")) == ("4,50", None)
    assert cell("4600000000017") is None and cell("слово") is None and tuple(cell("7кор")) == ("7", "кор")


def test_rows(spark):
    items = spark.createDataFrame([("a", 1, "x", 2.0, "u", 1.0), ("a", 2, "y", 3.0, "u", 1.0), ("b", 1, "z", 4.0, "u", 1.0)], "doc_id string, n int, name string, qty double, unit string, price double")
    assert [(r.n, r.name, r.qty) for r in edits.new_row(items, "a").where("doc_id = 'a'").orderBy("n").collect()] == [(1, "x", 2.0), (2, "y", 3.0), (3, "", None)]
    assert edits.new_row(items, "new").where("doc_id = 'new'").first().n == 1
    heads = spark.createDataFrame([("a", "S", "1"), ("b", "T", "2")], "doc_id string, supplier string, number string")
    typed = spark.createDataFrame([("a", "", None)], "doc_id string, supplier string, number string")
    assert [tuple(r) for r in edits.edit_head(heads, typed).orderBy("doc_id").collect()] == [("a", None, "1"), ("b", "T", "2")]
    state = edits.Undo(items)
    changed = state.bulk(items.where("n = 1"), lambda df, t: edits.scale(df, t, "qty", 10))
    assert [r.qty for r in changed.orderBy("doc_id", "n").collect()] == [20.0, 3.0, 40.0]
    assert [r.qty for r in state.undo().orderBy("doc_id", "n").collect()] == [2.0, 3.0, 4.0] == [r.qty for r in state.undo().orderBy("doc_id", "n").collect()]
    assert edits.toggle_column(["qty"], "qty") == ["qty"] and edits.toggle_column(["qty", "sum"], "qty") == ["sum"] and edits.toggle_column(["qty"], "sum") == ["qty", "sum"]
    assert edits.move_column(["a", "b", "c"], "b", -1) == ["b", "a", "c"] and edits.move_column(["a", "b"], "b", 1) == ["a", "b"] and edits.move_column(["a"], "z", 1) == ["a"]


def test_patch_of_approval_and_packs(spark):
    schema = "doc_id int, n int, name string, qty double, price double, sum double, barcode string, edited boolean, invoice_name string, name_source string, barcode_source string, alt_barcode string, approved boolean, pack struct<count: double, size: double>"
    items = spark.createDataFrame([(1, 1, "x", 72.0, 2.0, 144.0, "b", None, None, None, None, None, None, (3.0, 24.0)), (1, 2, "y", 48.0, 2.0, 96.0, "c", None, None, None, None, None, None, (2.0, 24.0))], schema)
    typed = spark.createDataFrame([(1, 1, None, True), (1, 2, 144.0, None)], "doc_id int, n int, qty double, approved boolean")
    a, b = edits.patch(items, typed).orderBy("n").collect()
    assert (a.approved, a.edited, a.qty, a.pack["count"]) == (True, False, 72.0, 3.0) and (b.approved, b.edited, b.sum, b.pack["count"]) == (None, True, 288.0, 6.0)


@pytest.fixture(scope="module")
def shelf(spark):
    return spark.createDataFrame(
        [(1, "Blue kettle 1,7 l", "4600000000017", ["4600000009997"], "шт", "Home", 900.0), (2, "Green kettle 2 l", "4600000000024", [], "шт", "Home", 950.0), (3, "Oat biscuits 400 g", "4600000000031", [], "шт", "Mill", 120.0)],
        "catalog_ord int, name string, barcode string, extra array<string>, unit string, supplier string, price double",
    )


def test_best_match_takes_codes_first(spark, shelf):
    asked = spark.createDataFrame([(1, "Oat biscuits 400 g", "шт", "Mill", 120.0, ["", "4600000009997"]), (2, "oat biscuits 400 g", "шт", "Mill", 120.0, []), (3, "nothing like it", "шт", "", 1.0, [])], "q_id int, name string, unit string, supplier string, price double, codes array<string>")
    got = {r.q_id: (r.catalog_ord, r.by, r.confidence) for r in resolve.best_match(asked, shelf).collect()}
    assert got == {1: (1, "code", "high"), 2: (3, "name", "high")}


def test_barcode_by_typed_name(spark, shelf):
    rows = [(1, "Oat biscuits 400 g", None, None), (2, "Oat biscuits 400 g", "own", "invoice"), (3, "nothing like it", "4600000000024", "catalog"), (4, " ", None, None)]
    items = spark.createDataFrame(rows, "q_id int, name string, barcode string, barcode_source string").withColumns({"unit": F.lit("шт"), "supplier": F.lit("Mill"), "price": F.lit(120.0), "codes": F.array().cast("array<string>")})
    got = {r.q_id: (r.barcode, r.barcode_source) for r in resolve.barcode_by_typed_name(items, shelf).collect()}
    assert got == {1: ("4600000000031", "catalog"), 2: ("own", "invoice"), 3: (None, None), 4: (None, None)}


def test_enrichment_chain(spark, shelf):
    none = lambda t: F.lit(None).cast(t)
    rows = [(1, 1, "77", "Kettle, blue", None), (1, 2, None, "Oat biscuits 400 g", None), (1, 3, None, "Own goods", "4600000000024"), (1, 4, None, "Oat biscuit 400 g", None)]
    items = spark.createDataFrame(rows, "doc_id int, n int, code string, name string, barcode string").withColumns({
        "supplier_key": F.lit("s"), "code_alt": none("string"), "unit": F.lit("шт"), "supplier": F.lit("Mill"), "price": F.lit(120.0), "qty": F.lit(1.0), "barcode_source": F.when(F.col("barcode").isNotNull(), "invoice"),
        "alt_barcode": none("string"), "invoice_name": none("string"), "name_source": none("string"),
    })
    dictionary = spark.createDataFrame([("s", "77", "4600000009997", "Kettle, blue")], "supplier_key string, map_code string, barcode string, name string")
    got = {r.n: (r.barcode, r.barcode_source, r.name) for r in resolve.enriched(items, dictionary, shelf).collect()}
    assert got[1] == ("4600000000017", "mapping", "Blue kettle 1,7 l") and got[2] == ("4600000000031", "catalog", "Oat biscuits 400 g")
    assert got[3] == ("4600000000024", "invoice", "Green kettle 2 l") and got[4][0] is None


def test_heads_and_sheets(spark):
    docs = spark.createDataFrame([(1, "S", "1", "d", 9.0, "f", 2.0), (2, None, None, None, None, "f", None), (3, "T", "2", "d", None, "g", None)], "doc_id int, supplier string, number string, date string, total double, format string, total_qty double")
    items = spark.createDataFrame([(1, 1, "c", 9.0, 2.0, None), (2, 1, None, 5.0, 1.0, None), (3, 1, "c", 5.0, 1.0, "b")], "doc_id int, n int, code string, sum double, qty double, barcode string").withColumn("barcode_source", F.lit("invoice"))
    assert {r.doc_id: r.awaits for r in documents.awaits_sheet(docs, items).collect()} == {1: False, 2: False, 3: True}
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 2)], "a int, b int")
    assert [tuple(r) for r in documents.same_table(pairs, docs, items).collect()] == [(2, 2)]
    notes = spark.createDataFrame([(1, 2, "totals", "info", "ok"), (1, 1, "x", "warn", "odd"), (1, 3, "y", "warn", "odd"), (2, 1, None, "error", "bad")], "doc_id int, ord int, kind string, level string, text string")
    assert {r.doc_id: r.matched for r in documents.totals_matched(notes).collect()} == {1: True, 2: False}
    assert sorted((r.doc_id, r.text, r.ord) for r in documents.distinct_issues(notes).collect()) == [(1, "odd", 1), (2, "bad", 1)]
    photos = spark.createDataFrame([(1, 1, True, "last"), (1, 3, False, "b"), (1, 2, False, "a")], "doc_id int, arrived int, has_total boolean, photo string")
    assert tuple(documents.attach_photos(photos).first()) == (1, "a", ["b", "last"])
    fixed, rows = totals.fix_by_totals(docs.withColumn("vat", F.lit(1.0)), items.withColumns({"price": F.lit(1.0), "unit": F.lit("шт")}))
    assert fixed.count() == 3 and rows.count() == 3


def test_fill_row_needs_its_digits(spark):
    docs = spark.createDataFrame([(1, 8472.0), (2, 8472.0), (3, 300.0), (4, 100.0)], "doc_id int, total double")
    rows = [(1, 1, 3.0, 1000.0, 3000.0, 3, [], []), (1, 2, None, None, None, 1, [456.0], [472.0]), (2, 1, 3.0, 1000.0, 3000.0, 3, [], []), (2, 2, None, None, None, 1, [456.0], [999.0]), (3, 1, 2.0, None, None, 1, [], [300.0]), (4, 1, 0.5, 100.0, 50.0, 3, [], []), (4, 2, None, None, None, 1, [40.0], [50.0])]
    items = spark.createDataFrame(rows, "doc_id int, n int, qty double, price double, sum double, support int, prices array<double>, sums array<double>")
    got = {(r.doc_id, r.n): (r.qty, r.price, r.sum) for r in totals.fill_row(docs, items).where("filled").collect()}
    assert got == {(1, 2): (12.0, 456.0, 5472.0), (3, 1): (2.0, 150.0, 300.0), (4, 2): (1.25, 40.0, 50.0)}


def test_export_checks(spark):
    lines = spark.createDataFrame([("46", 1.0, 2.0, "x", 2.0, "7", "шт")], "barcode string, qty double, price double, name string, sum double, code string, unit string")
    assert export.wrong_types(lines) == [] and export.wrong_types(lines.withColumn("barcode", F.lit(46)).withColumn("qty", F.lit("1"))) == ["barcode", "qty"]
    assert export.labelled(lines, ["qty", "barcode"]).columns == ["Quantity", "Barcode"]
    suppliers = spark.createDataFrame([("a", "ean"), ("b", "none"), ("c", None)], "name string, code string")
    assert [r.barcode_from for r in quality.barcode_origin(suppliers).orderBy("name").collect()] == ["paper", "name", "once"]
