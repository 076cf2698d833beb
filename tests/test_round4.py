"""What round 3 found: repairs without broadcasts, steps of a cell bound once, words of rows, codes beyond a million."""

from pyspark.sql import functions as F

from paperline.functions import numbers as N
from paperline.operators import resolve


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_corrections_are_the_valid_substitutions(spark):
    codes = ["4600000000015", "4600000000016", "9600000000015", "46O0000000015", "4600000000x15", "4600OO0000015", "96385074", "96385075", "9638507x", "123", "", "46000000000151", None]
    at = spark.createDataFrame([(c,) for c in codes], "code string")
    got = at.select("code", F.array_sort(N.corrections(F.col("code"))).alias("a"), F.array_sort(F.filter(N.substitutions(F.col("code")), N.is_valid_ean)).alias("b")).collect()
    sized = [r for r in got if r.code and len(r.code) in (8, 13)]
    assert len(sized) == 9 and all(r.a == r.b for r in sized)
    assert all(not r.a for r in got if r not in sized)


def test_repair_sends_no_codes_to_the_driver(spark):
    known = spark.range(1000).select(F.format_string("46%011d", "id").alias("code"))
    bad = known.select(F.concat(F.lit("9"), F.substring("code", 2, 12)).alias("barcode"))
    assert "BroadcastHashJoin" not in plan_of(resolve.repair_ean(bad, known))


def test_number_cell_names_its_text_once(spark):
    # Written out, the patterns of the first step stood in the plan some hundred times.
    at = spark.createDataFrame([("12 345,50 шт",), ("З шт",), ("4600000000015",), ("abc",), (None,)], "t string").select(N.number_cell(F.col("t")).alias("x"))
    assert [(r.x.num, r.x.unit) if r.x else None for r in at.collect()] == [("12 345,50", "шт"), ("3", "шт"), None, None, None]
    assert at._jdf.queryExecution().optimizedPlan().toString().count("translate(t") <= 2


def test_row_cells_keep_the_words_of_their_rows(spark):
    from paperline.operators import columns

    rows = spark.createDataFrame([(1, i, 100.0 + 40 * i, 10.0, 50.0, "c", i, 0, 20.0, 80.0 + 40 * i, 120.0 + 40 * i) for i in range(3)], "page long, row int, cy double, x0 double, x1 double, code string, line int, pos int, line_h double, top double, bottom double")
    words = spark.createDataFrame([(1, i, k, t, 90.0, x, 90.0 + 40 * i, x + 30, 110.0 + 40 * i, x + 15, 100.0 + 40 * i) for i in range(3) for k, (t, x) in enumerate([("7", 100.0), ("8,50", 200.0)])],
                                  "page long, line int, pos int, text string, conf double, x0 double, y0 double, x1 double, y1 double, cx double, cy double")
    sheets = spark.createDataFrame([(1, 400.0, 20.0, "ean", "center")], "page long, width double, line_h double, code string, row_align string")
    got = columns.row_cells(words, rows, sheets).select("row", "text", "own").collect()
    assert sorted((r.row, r.text, r.own) for r in got) == sorted((i, t, True) for i in range(3) for t in ("7", "8,50"))


def test_dictionary_exact_beyond_a_million_parts(spark, tmp_path):
    """Codes of seven places hold six digits of a part's key, so parts beyond a million share them."""
    import duckdb

    from paperline.plans import registry

    from .conftest import SF
    from .test_oracles import same_rows

    c = duckdb.connect()
    for t, key in (("part", "p_partkey"), ("lineitem", "l_partkey")):
        c.execute(f"copy (select * replace ({key} + 1000000 as {key}) from '{SF}/{t}.parquet') to '{tmp_path}/{t}.parquet' (format parquet)")
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    same_rows(registry.QUERIES["q20_dict_exact"](spark, str(tmp_path)), c, registry.ORACLES["q20_dict_exact"])
