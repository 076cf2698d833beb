"""Line-based forms and supplier detection on invented pages."""

from pyspark.sql import functions as F

from paperline.operators import forms


def lines(spark, texts, page="p"):
    return spark.createDataFrame([(page, i, t) for i, t in enumerate(texts)], "page string, line int, text string")


def test_pack_rows(spark):
    got = forms.pack_rows(lines(spark, [
        "СЧЕТ № 77 ОТ 03.02.2025", "204377 СИРОП ВИШНЯ 0,33Л 1X6 5 X 12 2 500,00 12 500,00 16% 2 000,00 14 500,00",
        "204379 МОРС 0,5Л 4х 6 750,00 3 000,00 16% 480,00 8 888,00", "ИТОГ ПО ЛИСТУ 15 500,00 2 480,00 17 980,00", "204380 ЧАЙ 3 x 5 90,00",
    ])).orderBy("n").collect()
    assert [(r.code, r.name, r.qty, r["sum"], r.pack.size) for r in got] == [("204377", "СИРОП ВИШНЯ 0,33Л 1X6", 60, 14500.0, 12), ("204379", "МОРС 0,5Л", 24, 3480.0, 6)]
    assert got[0].price == 241.67


def test_order_rows(spark):
    got = forms.order_rows(lines(spark, [
        "Заявка № __ от 05.03.2025", "№ Артикул Наименование Ед Кол-во Цена Стоимость", "480112345 Печенье овсяное", "1 6783 250гр Штук 4 350 1400", "Морс без кода", "2 330мл шт 3 1,150 3,000", "Итог 7 4,400 тенге", "98 прочее шт 1 1 1",
    ])).orderBy("n").collect()
    assert [(r.n, r.code, r.name, r.unit, r.qty, r.price, r["sum"], r.agrees) for r in got] == [(1, "4801123456783", "Печенье овсяное 250гр", "шт", 4, 350, 1400, True), (2, None, "Морс без кода 330мл", "шт", 3, 1150, 3000, False)]
    assert got[0].barcode in (None, "4801123456783")


def test_supplier(spark):
    registry = [forms.Supplier("first", ("111111111111",), ("(?iu)ромашк",)), forms.Supplier("second", ("222222222222",)), forms.Supplier("third", (), ("(?iu)склад",))]
    texts = ["БИН 2222 2222 2222 покупатель 111111111111", "ТОО Ромашка, склад", "общий склад", "никто"]
    at = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", forms.detect_supplier(F.col("t"), registry).alias("s"))
    assert [r.s for r in at.orderBy("i").collect()] == ["second", "first", "third", None]


def test_text_totals(spark):
    got = forms.text_totals(lines(spark, ["мыло 7,00", "Итого: 2 610,40", "из них налог 360,06", "подпись 8,88"])).first()
    assert got.totals == [360.06, 2610.4]
