"""Tables kept by page, and joins of tables with many rows."""

from pyspark.sql import functions as F

from paperline.operators import stage
from paperline.plans import registry

from .conftest import SF


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_not_shuffled(spark):
    """rows are shuffled to their page, the words made from them aren't."""
    plan = plan_of(registry.QUERIES["q70_number_cells"](spark, SF))
    assert "Generate" in plan and "Exchange" not in plan[: plan.index("Generate")]


def test_kept_by_page_and_not_sent(spark, monkeypatch):
    """a table kept by a column isn't shuffled for a join by it; many rows aren't sent to the driver, few may be."""
    df = spark.range(300).select((F.col("id") % 30).alias("page"), F.lit("x").alias("text")).repartition(4, "page")
    other = spark.range(30).withColumnRenamed("id", "page")
    kept = stage.stored(df, "some-words", "page", 4)
    assert kept.count() == 300 and not spark.catalog.tableExists("table_some_words")
    assert "BroadcastHashJoin" in plan_of(stage.stored(df, "few").join(other, "page"))
    monkeypatch.setattr(stage, "MANY", 100)
    for table, shuffles in ((stage.stored(df, "many"), 2), (stage.stored(df, "many-by", "page", 4), 1)):
        joined = table.where("text = 'x'").join(other.hint("merge"), "page")
        assert "Broadcast" not in plan_of(joined) and plan_of(joined).count("Exchange hashpartitioning") == shuffles
        assert joined.count() == 300


def test_neighbours_without_joins(spark):
    """items are read once; the only way back must start like another code of the page."""
    from paperline.operators import table

    good, other, bad = "4600000123455", "4601111123457", "4600300123455"
    rows = [(1, 0, good, "ok"), (1, 1, bad, "error"), (1, 2, "4609999999999", "error"), (2, 0, other, "ok"), (2, 1, bad, "error")]
    items = spark.createDataFrame([(*r[:3], r[2], r[3]) for r in rows], "page long, row int, barcode string, code string, code_level string")
    found = table.repaired_by_neighbours(items)
    assert "Join" not in plan_of(found)
    assert {(r.page, r.row): r.code_level for r in found.collect()} == {(1, 0): "ok", (1, 1): "warn", (1, 2): "error", (2, 0): "ok", (2, 1): "error"}


def test_arrays_are_worked_out_once(spark):
    """F2 to F6, F11, F12: no filter asks for the size of an array that is made for its rows, and cells need no windows."""
    from paperline.operators import cells, resolve

    words = spark.createDataFrame([(1, 1, i, x, 90.0, 20.0 * i, 0.0, 20.0 * i + 15, 20.0, 10.0, 20.0) for i, x in enumerate(("11", "136,00", "12%", "шт"))], "page long, line int, pos int, text string, conf double, x0 double, y0 double, x1 double, y1 double, cy double, line_h double")
    found = cells.typed_cells(words)
    assert [(r.cell, r.text, r.places) for r in found.orderBy("cell").collect()] == [(0, "11 136,00", [0, 1]), (1, "12% шт", [2, 3])]
    holes = resolve.blanked(spark.createDataFrame([("12",), (None,)], "code string"), "code")
    assert sorted(r._hole for r in holes.collect()) == ["1?", "?2"]
    filters = [x for df in (found, holes) for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x]
    assert "Window" not in plan_of(found) and not any("(size(" in x for x in filters)


def test_heads_of_a_line_are_found_once(spark):
    """the date of a line is sought once for all columns that name it, so the number's pattern stands in the plan once."""
    from paperline.operators import heads

    lines = spark.createDataFrame([(1, 1, "Накладная № YT-1012 от 3 марта 2021", 100.0)], "page long, line int, text string, y1 double")
    found = heads.line_heads(lines, spark.createDataFrame([(1, 1600.0, 20.0)], "page long, height double, line_h double"))
    assert [(r.number, r.date) for r in found.collect()] == [("УТ-1012", "03.03.2021")]
    assert "own_date" in found._jdf.queryExecution().optimizedPlan().toString()
