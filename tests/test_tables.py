"""Table recovery, stores and names against plain loops and planted cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperline.operators import align, anchors, cells, columns, export, reconcile, table
from paperline.sources import readers

WORDS = "page int, line int, pos int, text string, conf double, x0 double, y0 double, x1 double, y1 double, cx double, cy double"


def word(line, pos, text, x0, y=10.0, page=1, width=None, conf=90.0):
    x1 = x0 + (10 * len(text) if width is None else width)
    return (page, line, pos, text, conf, float(x0), y - 10, float(x1), y + 10, (x0 + x1) / 2, float(y))


def words_of(spark, rows):
    return spark.createDataFrame(rows, WORDS)


def best_alignment(a, b, tol):
    """The least cost over all order-preserving pairings, by trying every one."""
    steps = [min((x - y for x in b), key=abs) for y in a] if len(b) else []
    inside = sorted(s for s in steps if abs(s) < 2 * tol)
    off = inside[len(inside) // 2] if inside else 0
    best = np.inf
    for k in range(min(len(a), len(b)) + 1):
        for left in itertools.combinations(range(len(a)), k):
            for right in itertools.combinations(range(len(b)), k):
                costs = [abs(b[j] - a[i] - off) for i, j in zip(left, right)]
                if all(c <= tol for c in costs):
                    best = min(best, sum(costs) + tol * (len(a) - k) + 0.5 * tol * (len(b) - k))
    return best, off


def test_alignment_is_the_cheapest_of_all():
    rng = random.Random(1)
    for _ in range(150):
        a, b = (sorted(rng.sample(range(0, 120, 3), rng.randint(0, 5))) for _ in range(2))
        got = align.matching(np.array(a, float), np.array(b, float), 9.0)
        used = [j for j in got if j is not None]
        assert used == sorted(set(used))
        if a and b:
            best, off = best_alignment(a, b, 9.0)
            cost = sum(abs(b[j] - a[i] - off) for i, j in enumerate(got) if j is not None) + 9.0 * got.count(None) + 4.5 * (len(b) - len(used))
            assert cost == pytest.approx(best)


def test_aligned_frames(spark):
    left = spark.createDataFrame([(1, 0, 100.0, 10.0), (1, 1, 140.0, 10.0), (1, 2, 180.0, 10.0), (2, 0, 5.0, 10.0)], "page int, i int, y double, tol double")
    right = spark.createDataFrame([(1, 7, 103.0), (1, 8, 183.0), (3, 9, 5.0)], "page int, j int, y double")
    got = {(r.page, r.i): r.j for r in align.aligned(left, right, ["page"]).collect()}
    assert got == {(1, 0): 7, (1, 1): None, (1, 2): 8, (2, 0): None}


@pytest.mark.parametrize(
    "texts,want",
    [
        (["117", "/", "105,3"], ["105,3"]), (["117/105,3"], ["105,3"]), (["117", "/105,3"], ["105,3"]), (["117/", "105,3"], ["105,3"]), (["a", "/", "b"], ["a", "/", "b"]),
        (["1/", "2", "/3", "x"], ["3", "x"]), (["5", "6/", "7", "/", "8"], ["5", "8"]), (["/", "9"], ["/", "9"]), (["no", "stroke"], ["no", "stroke"]),
    ],
)
def test_slash_prices(spark, texts, want):
    rows = [word(0, i, t, 60 * i) for i, t in enumerate(texts)]
    got = cells.slash_prices(words_of(spark, rows)).orderBy("x0").collect()
    assert [r.text for r in got] == want
    assert got[-1].x1 == rows[-1][7]


def plain_cells(words, h=20.0, gap=0.7):
    """A loop over one line's words from left to right."""
    import re

    groups = []
    for w in sorted(words, key=lambda w: w[5]):
        last = groups[-1][-1] if groups else None
        if last and w[5] - last[7] <= gap * h and abs(w[10] - last[10]) < last[8] - last[6]:
            groups[-1].append(w)
        else:
            groups.append([w])
    split = []
    for g in groups:
        cut = next((i for i in range(1, len(g)) if re.match(r"\d{1,2}%", g[i][3]) and re.search(r"\d[.,]\d{2}$", g[i - 1][3])), None)
        split += [g] if cut is None else [g[:cut], g[cut:]]
    out = []
    for g in split:
        if out and not out[-1][1]:
            a = out[-1][0]
            if re.fullmatch(r"\d{1,3}", " ".join(w[3] for w in a)) and re.fullmatch(r"\d{3}(?:[.,]\d{1,3}| \d{2})?[.,-]?", " ".join(w[3] for w in g)) and g[0][5] - max(w[7] for w in a) <= 1.9 * gap * h:
                out[-1] = (a + g, True)
                continue
        out.append((g, False))
    return [" ".join(w[3] for w in g) for g, _ in out]


def test_cells_against_a_plain_loop(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for line in range(120):
        x, own = 0, []
        for pos in range(rng.randint(1, 7)):
            text = rng.choice(["1", "11", "136,00", "500", "1 298,00", "16%", "шт", "abc", "250", "12.5", "90,00-"])
            own.append(word(line, pos, text, x, 10.0 + rng.choice([0, 0, 0, 25])))
            x += 10 * len(text) + rng.choice([5, 14, 15, 20, 26, 27, 60])
        rows += own
        want[line] = plain_cells(own)
    found = cells.typed_cells(words_of(spark, rows).withColumn("line_h", F.lit(20.0))).orderBy("line", "cell").collect()
    got = {}
    for r in found:
        got.setdefault(r.line, []).append(r.text)
    assert got == want


def sheets(spark, page=1, **layout):
    from paperline.plans.sheets import sheets_of

    return sheets_of(spark.createDataFrame([(page,)], "page int"), **layout)


def code_rows(codes, x0=300, step=44, money=True):
    rows = []
    for i, c in enumerate(codes):
        y = 400.0 + step * i
        rows += [word(i + 5, 0, "Name", 50, y)] + ([word(i + 5, 1, c, x0, y)] if c else []) + ([word(i + 5, 2, "10,00", 600, y), word(i + 5, 3, "20,00", 700, y)] if money else [])
    return rows


EANS = [f"460000000{i:03}" for i in range(10, 60)]
EANS = [c + str(-sum(int(d) * (3 if k % 2 else 1) for k, d in enumerate(c)) % 10) for c in EANS]


def test_anchors_by_code_forms(spark):
    """The fullest column of right codes wins over digits elsewhere; internal codes join it; a missing row comes back, none twice."""
    codes = [*EANS[:3], "", *EANS[4:6], "УУ000000352", *EANS[7:9]]
    noise = [word(i + 5, 9, str(12345670 + i), 900, 400.0 + 44 * i) for i in range(4)]
    w = words_of(spark, code_rows(codes) + noise)
    got = [(r.cy, r.code) for r in anchors.anchors(w, sheets(spark, internal_codes=True)).orderBy("cy").collect()]
    assert got == [(400.0 + 44 * i, c) for i, c in enumerate(codes)]


def test_anchors_inside_names_and_wrapped_digits(spark):
    head = word(0, 0, "Количество", 500, 300.0)
    above = word(1, 0, EANS[0], 100, 250.0)
    inline = code_rows([EANS[1], ""], 120) + [word(6, 1, EANS[2][:7], 200, 444.0), word(6, 2, EANS[2][7:], 275, 444.0)]
    got = anchors.code_anchors(words_of(spark, [head, above, *inline]), sheets(spark, name_side="inline")).orderBy("cy").collect()
    assert [r.code for r in got] == [EANS[1], EANS[2]]
    cut = code_rows([EANS[3][:12], EANS[4]]) + [word(20, 0, EANS[3][12], 350, 422.0)]
    found = anchors.anchors(words_of(spark, cut), sheets(spark, code_wrap=True)).orderBy("cy").collect()
    assert [r.code for r in found] == [EANS[3], EANS[4]]


def test_totals_word_and_bands(spark):
    w = words_of(spark, code_rows(EANS[:4]) + [word(99, 0, "ИТОГО", 50, 600.0), word(99, 1, "80,00", 700, 600.0), word(2, 0, "Итого", 50, 410.0)])
    a = anchors.anchors(w, sheets(spark))
    t = anchors.totals_lines(w, a).collect()
    assert [r.total_y for r in t] == [600.0]
    b = anchors.row_bands(a, anchors.totals_lines(w, a), sheets(spark)).orderBy("row").collect()
    assert [(r.top, r.bottom) for r in b] == [(380.0, 422.0), (422.0, 466.0), (466.0, 510.0), (510.0, 544.0)]
    down = anchors.row_bands(a, anchors.totals_lines(w, a), sheets(spark, row_align="top", name_dir="down")).orderBy("row").collect()
    assert [(r.top, r.bottom) for r in down] == [(388.0, 432.0), (432.0, 476.0), (476.0, 520.0), (520.0, 591.0)]


def role_map(spark, rows):
    cols = max(len(r) for r in rows)
    values = spark.createDataFrame([(1, i, c, [float(x) for x in v]) for i, r in enumerate(rows) for c, v in enumerate(r) if v], "page int, row int, col int, values array<double>")
    found = columns.roles(values, spark.createDataFrame([(1, c) for c in range(cols)], "page int, col int")).collect()
    return [r.role for r in sorted(found, key=lambda r: r.col)]


def test_roles(spark):
    assert role_map(spark, [[[1], [3], [10], [30], [4.14]], [[2], [5], [7], [35], [4.83]]]) == ["skip", "qty", "price", "sum", "vat"]
    assert role_map(spark, [[[6], [6], [10], [60]], [[5], [5], [8], [40]]]) == ["qtyPlan", "qty", "price", "sum"]
    # a column of ones agrees everywhere, real products in half of the rows win
    assert role_map(spark, [[[1], [4], [5], [20]], [[1], [7], [9], [63]], [[1], [2], [2], [99]]]) == ["skip", "qty", "price", "sum"]
    # two prices, the sum is cut off: quantity one agrees, greater ones show two equal prices
    assert role_map(spark, [[[1], [9], [9]], [[1], [7], [7]], [[3], [8], [8]]]) == ["qty", "skip", "price"]
    assert role_map(spark, [[[3], [10], [31]], [[2], [5], [11]]]) == []


def test_roles_by_total_follows_every_reading(spark):
    rows = [([2], [22500, 225]), ([3], [100, 1]), ([5, 50], [7])]
    values = spark.createDataFrame([(1, i, c, [float(x) for x in v]) for i, r in enumerate(rows) for c, v in enumerate(r)], "page int, row int, col int, values array<double>")
    for total, hit in ((2 * 225 + 3 + 35, True), (2 * 22500 + 300 + 350, True), (999.0, False)):
        got = columns.roles_by_total(values, spark.createDataFrame([(1, float(total))], "page int, total double")).collect()
        assert [(r.qty_col, r.price_col) for r in got] == ([(0, 1)] if hit else [])


READ = "id int, qtys array<double>, plans array<double>, prices array<double>, sums array<double>, vats array<double>, totals array<double>, weight boolean, vat_rate double, vat_included boolean"


def test_solver_with_vat_on_top_and_spoilt_cents(spark):
    rows = [
        (0, [6.0], [], [441.0], [2646.2], [], [], False, 0.16, True), (1, [], [], [100.0], [], [], [], False, 0.16, True), (2, [4.0], [], [25.0], [], [], [112.0], False, 0.12, False),
        (3, [4.0], [], [], [], [16.0], [], False, 0.16, False), (4, [2.0, 2.0], [2.0], [10.0], [20.0], [], [], False, 0.16, True), (5, [2.0], [2.0], [10.0], [20.0], [], [], False, 0.16, True),
    ]
    got = {r.id: r for r in reconcile.solve_rows(spark.createDataFrame(rows, READ)).collect()}
    assert got[0].solution.sum == 2646.0 and got[1].solution.price == 100.0 and got[1].level == "error"
    assert (got[2].solution.sum, got[2].solution.support) == (100.0, 3) and got[3].solution.sum == 100.0 and got[3].solution.price == 25.0
    assert got[4].solution.score > got[5].solution.score


def test_codes_of_two_readings(spark):
    bad = EANS[0][:5] + str((int(EANS[0][5]) + 1) % 10) + EANS[0][6:]
    rows = [
        (0, bad, EANS[0], "ean", None), (1, "5" + EANS[1], None, "ean", None), (2, EANS[2] + "9", None, "ean", None), (3, bad, None, "ean", None),
        (4, "103112", "103172", "digits", 6), (5, "2103112", "103112", "digits", 6), (6, "УУ000000352", None, "ean", None), (7, "", None, "ean", None),
    ]
    df = spark.createDataFrame(rows, "id int, code string, strip_code string, kind string, code_length int")
    got = {r.id: (r.code, r.barcode, r.code_alt, r.code_level) for r in table.coded(df).collect()}
    assert got[0] == (EANS[0], EANS[0], None, "ok") and got[1][1] == EANS[1] and got[2][1] == EANS[2] and got[3][3] == "error"
    assert got[4] == ("103112", None, "103172", "warn") and got[5][0] == "103112" and got[6][:2] == ("УУ000000352", None) and got[7][1] is None


def test_clean_names(spark):
    of = lambda t: spark.range(1).select(table.clean_name(F.lit(t)).alias("x")).first().x
    assert of("12 «Сыр» 0.45'24_IM 70r 4600000000015") == "Сыр 0.45 24 IM 70г" and of("10Водка") == "Водка" and of("Наименование товара Хлеб") == "Хлеб"


def test_catalogue_without_bounds(spark, tmp_path):
    wide = ",".join(f"c{i}" for i in range(60)) + ",Наименование,Штрихкод"
    codes = [str(10000 + i) for i in range(150)]
    (tmp_path / "wide.csv").write_text("junk\n" + wide + "\n" + "," * 60 + '"Сок, яблоко",' + ";".join(codes) + "\n")
    (tmp_path / "other.csv").write_text("Barcode,Name\n7777,Tea\n,Empty\n")
    got = {r.name: (r.barcode, len(r.extra)) for r in readers.read_catalogue(spark, str(tmp_path)).collect()}
    assert got == {"Сок, яблоко": ("10000", 149), "Tea": ("7777", 0)}


def test_sheet_names_are_unique(spark):
    docs = [(i, i, s, n) for i, (s, n) in enumerate([("AB", "1 2"), ("AB", "1"), ("AB", "1"), ("ab", "1"), (None, None), (None, None), ("X" * 40, "1234567890"), ("X" * 40, "1234567891"), ("AB", "1 3")])]
    got = {r.doc_id: r.sheet for r in export.sheet_names(spark.createDataFrame(docs, "doc_id int, ord int, supplier string, number string")).collect()}
    assert len(got) == len(docs) == len({s.lower() for s in got.values()}) and all(len(s) <= 31 for s in got.values())
    assert got[0] == "AB 1 2" and got[1] == "AB 1" and got[8] == "AB 1 3" and got[2] == "AB 1 4" and got[5] == "Invoice 2"


def test_enrichment_in_its_order(spark):
    """Held extra codes, rows without quantity, stale and misread codes, names and codes alike."""
    from paperline.operators import resolve

    shelf = spark.createDataFrame([(1, "Sunny apple juice 1 l", EANS[0], [EANS[9]], "шт", "Mill", 100.0), (2, "Sunny orange juice 1 l", EANS[1], [], "шт", "Mill", 100.0)], "catalog_ord int, name string, barcode string, extra array<string>, unit string, supplier string, price double")
    bad = EANS[1][:4] + str((int(EANS[1][4]) + 2) % 10) + EANS[1][5:]
    rows = [
        (1, 1, None, "Apple drink", EANS[9], "invoice", 1.0, None), (1, 2, None, "Sunny apple juice 1 l", None, None, 2.0, None), (1, 3, None, "Sunny orange juice 1 l", None, None, None, None),
        (2, 1, None, "x", EANS[5], "catalog", 1.0, EANS[6]), (2, 2, None, "Sunny orange juice 1 l", bad, "invoice", 1.0, None), (3, 1, "73731", "Oat biscuits soft", None, None, 1.0, None), (3, 2, "", "Oat biscuits softly", None, None, 1.0, None),
    ]
    none = lambda *names: {c: F.lit(None).cast("string") for c in names}
    items = spark.createDataFrame(rows, "doc_id int, n int, code string, name string, barcode string, barcode_source string, qty double, ocr_barcode string").withColumns(
        {"supplier_key": F.lit("s"), "supplier": F.lit("Mill"), "unit": F.lit("шт"), "price": F.lit(100.0), **none("code_alt", "alt_barcode", "invoice_name", "name_source")}
    )
    learned = spark.createDataFrame([("s", "73730", "4600000077777", "Oat biscuits soft"), ("s", "name:oat biscuits soft", "4600000088888", "Oat biscuits soft")], "supplier_key string, map_code string, barcode string, name string")
    got = {(r.doc_id, r.n): (r.barcode, r.barcode_source) for r in resolve.enriched(items, learned, shelf).collect()}
    # the first product is held under its extra code, so the row named like it takes its next option
    assert got[1, 1] == (EANS[0], "invoice") and got[1, 2] == (EANS[1], "catalog") and got[1, 3][0] is None
    assert got[2, 1] == (EANS[6], "invoice") and got[2, 2] == (EANS[1], "catalog")
    assert got[3, 1] == ("4600000077777", "mapping") and got[3, 2] == ("4600000088888", "mapping")
