"""Facts about the column functions and operators."""

import random

import pytest
from pyspark.sql import functions as F

from paperline.functions import numbers as N
from paperline.functions import strings as S
from paperline.operators import documents, edits, export, layout, quality, reconcile, resolve, totals
from paperline.sources import readers
from paperline.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,value", [("1 750,00", 1750.0), ("143260,00", 143260.0), ("12", 12.0), ("1,2345", None), ("a1", None), ("", None), ("1 234,5", 1234.5)])
def test_parse_amount(spark, text, value):
    assert one(spark, N.parse_amount(F.lit(text))) == value


def test_numbers(spark):
    found = lambda t: [(r.value, r.has_decimals) for r in one(spark, N.extract_numbers(F.lit(t)))]
    assert found("10 10") == [(10, False), (10, False)]
    assert found("1 750,00 и 143 260,00") == [(1750, True), (143260, True)]
    assert found("5 , 20 кг") == [(5.2, True)] and found("нет") == []
    assert one(spark, N.fix_digits(F.lit("4б0l2З"))) == "460123" and one(spark, N.fix_digits(F.lit("Оlо1"))) == "Оlо1"
    assert [one(spark, N.round2(F.lit(x))) for x in (1.005, 2.675, -2.675)] == [1.01, 2.68, -2.67]
    assert one(spark, N.near(F.lit(1.0), F.lit(1.011))) and not one(spark, N.near(F.lit(None).cast("double"), F.lit(1.0)))
    assert one(spark, N.parse_scale(F.lit("*10"))) == 10 and one(spark, N.parse_scale(F.lit("÷4"))) == 0.25 and one(spark, N.parse_scale(F.lit("10"))) is None
    assert one(spark, N.upper_median(F.array(*map(F.lit, [4.0, 1.0, 3.0, 2.0])))) == 3.0
    assert one(spark, N.money_text(F.lit(1234.5))) == "1\u00a0234,50"


def test_readings(spark):
    read = lambda t, role: one(spark, N.read_values(F.lit(t), role))
    assert read("5 472", "sum") == [5472] and read("4 936 00", "sum") == [4936.0] and read("11 618,001", "price") == [11618.0]
    assert read("175000", "price") == [175000, 1750] and read("5000", "qty") == [5000, 5] and read("4 1", "qty") == [4, 1]
    assert read("335,007", "sum") == [335.007, 335.0] and read("—", "qty") == [] and read(None, "sum") == []


def test_check_digits(spark):
    rng = random.Random(2)
    for _ in range(12):
        body = "".join(rng.choice("0123456789") for _ in range(12))
        digit = -sum(int(d) * (3 if i % 2 else 1) for i, d in enumerate(body)) % 10
        assert one(spark, N.is_valid_ean(F.lit(f"{body}{digit}"))) and not one(spark, N.is_valid_ean(F.lit(f"{body}{(digit + 1) % 10}")))
    assert one(spark, N.is_valid_ean(F.lit("96385074"))) and not one(spark, N.is_valid_ean(F.lit("12a")))
    tries = spark.range(1).select(F.explode(N.substitutions(F.lit("4600000000007"))).alias("c"))
    assert tries.count() == 117 and tries.where(N.is_valid_ean("c")).count() == 13


def test_strings(spark):
    assert one(spark, S.normalize_name(F.lit("Сигареты «SS» 0,5Л Жұлдыз"))) == "sigarety super slims 05l zhuldyz"
    assert one(spark, S.sizes_of(F.lit("Напиток 450мл"))) == [0.45] and one(spark, S.sizes_of(F.lit("Пиво 0,5 банка"))) == [0.5] and one(spark, S.sizes_of(F.lit("Сыр 038 кг"))) == [0.38]
    assert one(spark, S.find_date(F.lit("от 29.09.2026 г."))) == "29.09.2026" and one(spark, S.find_date(F.lit("3 мая 2026"))) == "03.05.2026" and one(spark, S.find_date(F.lit("01.01.2009"))) is None
    units = {"шт.": "шт", "Kr": "кг", "6yr": "бут", "wr": None, "уп(10 шт)": "блок", "пачка": "пачка", "wv": None, "": None}
    assert {u: one(spark, S.normalize_unit(F.lit(u))) for u in units} == units
    sim = lambda a, b: one(spark, S.name_similarity(F.lit(a), F.lit(b)))
    assert sim("молоко", "молоко") == 1 and sim("молоко", "хлеб") == sim("хлеб", "молоко") < 0.3 and sim("", "x") >= 0
    assert one(spark, S.word_similarity(F.lit("shokol"), F.lit("shokoladnoe"))) == 0.85
    assert one(spark, S.base64url_json(F.struct(F.lit("я?>").alias("a")))).isascii()
    assert one(spark, S.export_file_name(F.lit("ТОО «Ромашка»"), F.lit("№ 5"), extension="tsv")) == "ТОО_Ромашка_5.tsv"


def test_solver_recovers_damage(spark):
    rng, rows = random.Random(4), []
    for i in range(60):
        q, p = rng.randint(2, 40), rng.randint(300, 90000) / 100
        s = round(q * p, 2)
        damage = [([float(q)], [p * 100, p], [s]), ([], [p], [s]), ([float(q)], [], [s]), ([float(q)], [p], []), ([float(q) + 1], [p], [s])][i % 5]
        rows.append((i, *damage[:1], [], *damage[1:], [], False, q, p, s))
    df = spark.createDataFrame(rows, "id int, qtys array<double>, plans array<double>, prices array<double>, sums array<double>, vats array<double>, weight boolean, q int, p double, s double")
    for r in reconcile.solve_rows(df).collect():
        assert abs(r.solution.sum - r.s) < 0.02 and (r.solution.qty == r.q or r.id % 5 == 4), r
    nothing = spark.createDataFrame([(0, [], [], [], [], [], False)], "id int, qtys array<double>, plans array<double>, prices array<double>, sums array<double>, vats array<double>, weight boolean")
    assert reconcile.solve_rows(nothing).first().level == "error"


ITEM = "doc_id long, n long, barcode string, catalog_barcode string, code string, name string, qty double, unit string, price double, sum double"


def test_unit_rules_and_merge(spark):
    rules = spark.createDataFrame([(1, "block", "pcs", 10.0)], "rule_ord int, from string, to string, factor double")
    items = spark.createDataFrame([(1, 1, "b", None, None, "x", 1.0, "block", 11136.0, 11136.0), (1, 2, "b", None, None, "x", 1.0, "Block.", 1.0, 1.0), (1, 3, "c", None, None, "y", 5.0, "pcs", 150.0, 750.0), (1, 4, None, None, None, "z", 5.0, "pcs", 1.0, 5.0)], ITEM)
    once = edits.apply_unit_rules(items, rules)
    assert {(r.n, r.qty, r.unit, r.price) for r in once.collect()} == {(1, 10, "pcs", 1113.6), (2, 10, "pcs", 0.1), (3, 5, "pcs", 150), (4, 5, "pcs", 1)}
    again = edits.apply_unit_rules(once, rules)
    assert sorted(map(str, again.select(*once.columns).collect())) == sorted(map(str, once.collect()))
    lines = {r.barcode: (r.qty, r.price, r.sum) for r in export.export_lines(once).collect()}
    assert lines == {"b": (20, 556.85, 11137), "c": (5, 150, 750)}
    back = edits.restore(again, F.lit(True)).collect()
    assert {(r.n, r.qty, r.unit) for r in back} == {(1, 1, "block"), (2, 1, "Block."), (3, 5, "pcs"), (4, 5, "pcs")}
    flavours = spark.createDataFrame([(1, i, c, "main", None, "f", q, "pcs", 2.0, 2 * q) for i, (c, q) in enumerate([("a", 5.0), ("b", 5.0), ("main", 1.0)])], ITEM)
    assert [(r.barcode, r.qty) for r in export.export_lines(flavours).collect()] == [("main", 11)]


def test_scale_keeps_the_sum(spark):
    items = spark.createDataFrame([(1, 1, "b", None, None, "x", 5.0, "pcs", 150.0, 750.0)], ITEM)
    r = edits.scale(items, F.lit(True), "qty", 10).first()
    assert (r.qty, r.sum, r.orig.qty) == (50, 750, 5)
    r = edits.convert(items, F.lit(True), 20, F.lit("pack")).first()
    assert (r.qty, r.price, r.sum, r.unit) == (100, 7.5, 750, "pack")


def test_approval_and_levels(spark):
    schema = ITEM + ", barcode_source string, edited boolean, approved boolean, issues array<struct<level: string, text: string, kind: string>>"
    warn = [("warn", "odd", None)]
    rows = [(1, 1, "4600000000015", None, None, "x", 1.0, "", 1.0, 1.0, "invoice", False, None, warn), (1, 2, None, None, None, "x", 1.0, "", 1.0, 1.0, None, False, None, []), (1, 3, "12x", None, None, "x", 1.0, "", None, 1.0, "invoice", False, True, warn)]
    at = quality.problems(spark.createDataFrame(rows, schema)).withColumn("all_issues", quality.effective_issues())
    level = {r.n: r.l for r in at.select("n", quality.worst_level(F.col("all_issues")).alias("l")).collect()}
    assert level == {1: "warn", 2: "todo", 3: "error"}
    done = quality.approve_all(at).withColumn("l", quality.worst_level(quality.effective_issues()))
    assert {r.n: r.l for r in done.collect()} == {1: "ok", 2: "todo", 3: "error"}


def test_sheets_come_in_any_order(spark):
    sheets = [(1, 1, False, i) for i in range(1, 32)] + [(1, 2, True, i) for i in range(1, 9)] + [(1, 3, False, i) for i in range(1, 41)]
    got = documents.merge_sheets(spark.createDataFrame(sheets, "doc_id long, arrived int, has_total boolean, n long")).orderBy("row").collect()
    assert [r.arrived for r in got] == [1] * 31 + [3] * 40 + [2] * 8 and [r.row for r in got] == list(range(1, 80))


def test_quantity_total_finds_the_row(spark):
    items = spark.createDataFrame([(1, 1, "a", None, None, "x", 5.0, "кг", 156.2, 781.0), (1, 2, "b", None, None, "y", 20.0, "шт", 10.0, 200.0)], ITEM)
    docs = spark.createDataFrame([(1, 20.5)], "doc_id long, total_qty double")
    r = {x.n: x for x in totals.qty_by_total(docs, items).collect()}
    assert (r[1].qty, r[1].price, r[1].sum, r[1].shifted, r[2].shifted) == (0.5, 1562, 781, True, False)


def test_catalogue_ranking(spark):
    cat = spark.createDataFrame([
        (1, "Сок яблочный 1л", "4600000000015", None, "шт", "Фрукт", 500.0), (2, "Сок томатный 1л", "4600000000022", None, "шт", "Фрукт", 450.0),
        (3, "Шоколад молочный 90г", "4600000000039", ["4600000000046"], "шт", "Какао", 300.0), (4, "Новый продукт", "4600000000053", None, None, None, None),
    ], "catalog_ord long, name string, barcode string, extra array<string>, unit string, supplier string, price double")
    asked = spark.createDataFrame([(1, "Сок яблоч. 1 л", "шт", "ТОО Фрукт", 500.0), (2, "шокол молоч 90гр", None, None, None), (3, "Новый продукт", None, None, None)], "q_id long, name string, unit string, supplier string, price double")
    best = {r.q_id: (r.catalog_ord, r.confidence) for r in resolve.rank(asked, cat).where("rank = 1").collect()}
    assert best == {1: (1, "high"), 2: (3, best[2][1])} and best[2][1] in ("high", "medium")
    codes = spark.createDataFrame([("04600000000015",), ("4600000000046",), ("77",)], "code string")
    assert {r.code: r.catalog_ord for r in resolve.by_code(codes, cat).collect()} == {"04600000000015": 1, "4600000000046": 3, "77": None}


def test_assignment_gives_a_barcode_once(spark):
    options = spark.createDataFrame([(1, 1, "a", "A", 0.9, 1, False), (1, 1, "a", "B", 0.5, 2, False), (1, 2, "b", "A", 0.8, 1, False), (1, 2, "b", "C", 0.4, 2, False), (1, 3, "c", "T", 0.9, 1, False), (1, 9, "", "T", 1.0, 1, True), (1, 4, "a", "A", 0.7, 1, False)], "doc_id long, n long, owner string, barcode string, score double, rank int, taken boolean")
    assert {(r.n, r.barcode) for r in resolve.assign(options).collect()} == {(1, "A"), (2, "C"), (4, "A")}


def test_catalogue_names_revert(spark):
    schema = "doc_id long, n long, barcode string, alt_barcode string, unit string, name string, invoice_name string, name_source string"
    cat = spark.createDataFrame([(1, "Main name", "111111111", ["222222222"], "литр", None, None)], "catalog_ord long, name string, barcode string, extra array<string>, unit string, supplier string, price double")
    items = spark.createDataFrame([(1, 1, "222222222", None, None, "read", None, None), (1, 2, "999", None, "шт", "read", None, None), (1, 3, "111111111", None, None, "mine", "read", "manual")], schema)
    there = resolve.catalogue_names(items, cat)
    got = {r.n: (r.barcode, r.alt_barcode, r.name, r.unit) for r in there.collect()}
    assert got == {1: ("111111111", "222222222", "Main name", "л"), 2: ("999", None, "read", "шт"), 3: ("111111111", None, "mine", "л")}
    again = resolve.catalogue_names(there, cat)
    assert sorted(map(str, again.select(schema_names := there.columns).collect())) == sorted(map(str, there.select(schema_names).collect()))
    back = {r.n: (r.barcode, r.alt_barcode, r.name) for r in resolve.catalogue_names(there, cat.limit(0)).collect()}
    assert back == {1: ("222222222", None, "read"), 2: ("999", None, "read"), 3: ("111111111", None, "mine")}


def test_pages(spark, tmp_path):
    word = lambda t, x, y: {"text": t, "conf": 91.4, "x0": x, "y0": y, "x1": x + 8.0 * len(t), "y1": y + 10.0}
    line = lambda y, *ws: {"text": " ".join(w for w, _ in ws) + "\n", "conf": 90.6, "x0": 0.0, "y0": y, "x1": 400.0, "y1": y + 10, "words": [word(w, x, y) for w, x in ws]}
    import json

    (tmp_path / "a.json").write_text(json.dumps({"width": 500, "height": 500, "lines": [line(40.0, ("Сок", 0.0), ("яблочный", 28.0), ("12", 200.0)), line(10.0, ("Товар", 0.0), ("Кол", 200.0), (" ", 300.0))]}))
    pages = readers.ocr_pages(spark, str(tmp_path))
    assert [x.text for x in pages.first().lines] == ["Товар Кол  ", "Сок яблочный 12"]
    words = layout.flatten_words(pages)
    heights = layout.line_height(words, pages)
    assert words.count() == 5 and heights.first().line_h == 10
    assert {(r.line, r.text) for r in layout.cells(words, heights).collect()} == {(0, "Товар"), (0, "Кол"), (1, "Сок яблочный"), (1, "12")}
    assert layout.reading_order(words, heights).first().text == "Товар Кол Сок яблочный 12"
    anchors = spark.createDataFrame([("p", 0, 10.0, 5.0, 20.0), ("p", 1, 30.0, 5.0, 20.0)], "page string, row int, cy double, line_h double, pitch double")
    assert [(r.top, r.bottom) for r in layout.bands(anchors).orderBy("row").collect()] == [(5.0, 20.0), (20.0, 33.0)]
    assert layout.pitch(anchors).first().pitch == 20


def test_catalogue_file(spark, tmp_path):
    (tmp_path / "c.csv").write_text("прайс\n\nНаименование,Штрихкод,Доп. коды,Ед.,Закупочная цена\nСок,4600000000015; 4600000000022,77777,шт,\"1 200,5\"\nБез кода,,,шт,1\nМало,123,,шт,1\n", encoding="utf-8")
    got = readers.read_catalogue(spark, str(tmp_path / "c.csv")).collect()
    assert [(r.name, r.barcode, r.extra, r.unit, r.price) for r in got] == [("Сок", "4600000000015", ["4600000000022", "77777"], "шт", 1200.5)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_catalogue(spark, str(tmp_path / "bad.csv"))


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"mapping": {"s1::77": {"barcode": "111", "name": "x"}, "nokey": {"barcode": "2"}, "s1::name:a": {"name": "no code"}}}')
    d = readers.read_dictionary(spark, str(tmp_path / "d.json"))
    assert [(r.supplier_key, r.map_code, r.barcode) for r in d.collect()] == [("s1", "77", "111")]
    newer = spark.createDataFrame([("s1", "77", "222", "y", None, None), ("s2", "5", "3", None, None, None)], d.schema)
    assert {(r.supplier_key, r.barcode) for r in readers.merge_dictionaries(d, newer).collect()} == {("s1", "222"), ("s2", "3")}
    readers.write_dictionary(d, str(tmp_path / "out"))
    assert readers.read_dictionary(spark, str(tmp_path / "out")).count() == 1


def test_stream_flags_duplicates(spark, tmp_path):
    rows = lambda doc, no, codes: [(doc, None, "s", no, i, c, 1.0, 2.0) for i, c in enumerate(codes)]
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    for k, batch in enumerate([rows(1, "7", "ab") + rows(2, "8", "c"), rows(3, "7", "ba") + rows(4, "7", "zz") + rows(5, "", "q")]):
        spark.createDataFrame(batch, ingest.ITEM_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(spark, source, table, str(tmp_path / "checkpoint")).awaitTermination(120)
        assert k in (0, 1)
    got = {r.doc_id: r.kind for r in spark.read.option("recursiveFileLookup", True).parquet(table).collect()}
    assert got == {1: "new", 2: "new", 3: "duplicate", 4: "page", 5: "new"}
