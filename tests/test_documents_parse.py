"""Whole pages of several kinds, and the stores."""

import pytest
from pyspark.sql import functions as F

from paperline.operators import heads, parse
from paperline.sources import stores

from .test_tables import EANS, word

LINE = "array<struct<text:string,conf:double,x0:double,y0:double,x1:double,y1:double,words:array<struct<text:string,conf:double,x0:double,y0:double,x1:double,y1:double>>>>"


def money(x):
    return f"{x:,.2f}".replace(",", " ").replace(".", ",")


def page_rows(page, items, code="ean", align=0.0, head=(), total=True):
    """Words of one page: names at the left, codes, quantity, price and sum at the right; ``align`` moves numbers off the code's line."""
    out = [word(i, k, t, 50 + 140 * k, 60.0 + 30 * i, page) for i, text in enumerate(head) for k, t in enumerate(text.split(" "))]
    y = 400.0
    for i, (c, name, q, p) in enumerate(items):
        y = 400.0 + 60 * i
        line = 20 + 2 * i
        out += [word(line, k, t, 50 + 90 * k, y, page) for k, t in enumerate(name.split(" "))]
        out += [word(line, 8, c, 450, y, page)] if code else []
        for k, (v, edge) in enumerate(((str(q), 700), (money(p), 860), (money(q * p), 1020))):
            out.append(word(line + (1 if align else 0), 10 + k, v, edge - 10 * len(v), y + align, page))
    if total:
        v = money(sum(q * p for _, _, q, p in items))
        out += [word(300, 0, "Итого", 50, y + 60 + align, page), word(300, 1, v, 1020 - 10 * len(v), y + 60 + align, page)]
    return out


def pages_of(spark, rows):
    w = spark.createDataFrame(rows, "page int, line int, pos int, text string, conf double, x0 double, y0 double, x1 double, y1 double, cx double, cy double")
    one = F.struct("text", "conf", "x0", "y0", "x1", "y1")
    lines = w.groupBy("page", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("w")))), lambda x: x["w"]).alias("words"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    text = F.array_join(F.transform("words", lambda x: x["text"]), " ")
    line = F.struct(text.alias("text"), F.lit(90.0).alias("conf"), "x0", "y0", "x1", "y1", "words")
    found = lines.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("y0", "line", line.alias("l")))), lambda x: x["l"]).cast(LINE).alias("lines"))
    return found.withColumns({"width": F.lit(1200.0), "height": F.lit(2000.0), "charHeight": F.lit(14.0)})


GOODS = [(EANS[i], n, q, p) for i, (n, q, p) in enumerate([("Soft bread", 3, 120.5), ("Dark honey", 12, 1800.0), ("Green tea", 7, 455.25), ("Oat flakes", 2, 99.9)])]
NUMBERED = [(str(103112 + 7 * i), *g[1:]) for i, g in enumerate(GOODS)]
REGISTRY = """[{"id": "mill", "bins": ["123456789012"], "keywords": ["(?i)north mill"], "layout": {"code": "digits", "code_length": 6}}]"""


def test_documents_of_many_kinds(spark):
    rows = page_rows(1, GOODS, head=["Накладная ОТПУСК ЗАПАСОВ № 94688 от 29 сентября 2020 г."]) + page_rows(2, GOODS, align=24.0) + page_rows(3, NUMBERED, head=["North mill sends", "Дата отгрузки: 05.06.2021"])
    rows += page_rows(4, GOODS, code=None) + page_rows(5, GOODS[:1]) + [word(0, 0, "nothing", 50, 90.0, 6)] + page_rows(7, NUMBERED, total=False)
    docs, items = parse.parse_documents(pages_of(spark, rows), parse.read_registry(REGISTRY))
    docs = {r.page: r for r in docs.collect()}
    got = {}
    for r in items.orderBy("page", "row").collect():
        got.setdefault(r.page, []).append((r.code, r.name, r.qty, r.price, round(r.sum, 2)))
    want = lambda goods, code=True: [(c if code else None, n, q, p, round(q * p, 2)) for c, n, q, p in goods]
    assert got[1] == want(GOODS) and got[3] == want(NUMBERED) and got[7] == want(NUMBERED) and got[5] == want(GOODS[:1])
    assert [r[1:] for r in got[4]] == [r[1:] for r in want(GOODS)] and got[2] == want(GOODS)
    assert (docs[1].number, docs[1].date, docs[1].unknown_form, docs[1].total_met) == ("94688", "29.09.2020", False, True)
    assert (docs[3].supplier, docs[3].date, docs[3].code) == ("mill", "05.06.2021", "digits") and docs[2].row_align == "top" and docs[4].code == "none"
    assert 6 not in got and docs[6].total is None and docs[7].total_met is not True


def test_registry_is_checked():
    assert parse.read_registry(REGISTRY)[0].layout == {"code": "digits", "code_length": 6}
    with pytest.raises(ValueError, match="colour"):
        parse.read_registry('[{"id": "a", "layout": {"colour": 1}}]')


def test_form_dates_and_lonely_pages(spark):
    pages = spark.createDataFrame([(1, 1000.0, 20.0), (2, 1000.0, 20.0), (3, 1000.0, 20.0)], "page int, height double, line_h double")
    lines = spark.createDataFrame([(1, 0, "по приказу от 20.12.2012 года № 562", 30.0), (1, 1, "0500-31 от 14.10.2020", 60.0), (2, 0, "14.10.2020", 900.0)], "page int, line int, text string, y1 double")
    words = spark.createDataFrame([word(0, 0, "x", 1.0, page=3)], "page int, line int, pos int, text string, conf double, x0 double, y0 double, x1 double, y1 double, cx double, cy double")
    got = {r.page: (r.number, r.date) for r in heads.number_and_date(words, lines, pages).collect()}
    assert got == {1: ("0500-31", "14.10.2020"), 2: (None, None), 3: (None, None)}


def test_stores_keep_the_old_state(spark, tmp_path):
    path = str(tmp_path / "dictionary")
    assert stores.load_dictionary(spark, path).count() == 0
    row = lambda code: spark.createDataFrame([("s", code, "1", None, None, None)], stores.DICTIONARY)
    stores.save(row("a"), path)
    old = stores.load_dictionary(spark, path)
    stores.save(old.unionByName(row("b")), path)
    assert {r.map_code for r in stores.load_dictionary(spark, path).collect()} == {"a", "b"} and old.count() == 1
    broken = row("c").select("supplier_key", F.raise_error(F.lit("lost")).cast("string").alias("map_code"))
    with pytest.raises(Exception, match="lost"):
        stores.save(broken, path)
    assert {r.map_code for r in stores.load_dictionary(spark, path).collect()} == {"a", "b"}
    stores.save(row("d"), path)
    assert {r.map_code for r in stores.load_dictionary(spark, path).collect()} == {"d"} and len(stores.versions(spark, path)) == 2


def test_settings_of_every_age(spark, tmp_path):
    d = stores.Settings()
    assert [stores.settings_of(t) for t in (None, "", "no json", "[1]", '{"columns": ["barcode", "qty", "price"]}', '{"columns": ["nothing"]}')] == [d] * 6
    mine = stores.settings_of('{"columns": ["sum", "x", "name"], "header": true, "qty_mode": "packs", "unit_rules": [["a", "b", "5"], ["a", 1, 2], ["a", "b", 0], "ab"]}')
    assert mine == stores.Settings(("sum", "name"), True, "packs", (("a", "b", 5.0),))
    stores.save_settings(spark, mine, str(tmp_path / "settings"))
    assert stores.load_settings(spark, str(tmp_path / "settings")) == mine and stores.load_settings(spark, str(tmp_path / "none")) == d
