"""Number and date of a document from the words and lines of its page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import fix_digits
from ..functions.strings import MONTHS, find_date, to_cyrillic

# How numbers and dates are labelled, with their misreadings; lines whose date is not the document's; the form's own date.
NUMBER_LABEL = r"[Нн]омер\S*(?:\s+[^\s0-9]+)?[\s:_.—-]+([A-ZА-Я]{2}[0-9OО]{8,10})(?![0-9A-Za-zА-Яа-я])"
DATE_LABEL = r"(?iu)^[^0-9A-Za-z_]*Дата\s+\S+\s*:?\s*(.*)$"
TITLE = r"(?iu)накладн|документ|реализаци"
NUMBER_SIGN = r"(?:№|\bN[eo°])\s*([A-ZА-Яa-z]{0,3}-?\s?[0-9][0-9-]{2,})"
NOT_ITS_DATE = r"(?iu)приказ|министр|года|приложение|время|оплатить"
FORM_DATE = "20.12.2012"
#: Heads stand in this share of the page's height.
TOP_SHARE = 0.45


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([0-9][0-9-]{2,})"), F.lit(1))


def _before_date(text: Column) -> Column:
    """What stands before a date in a text."""
    month = "|".join(MONTHS)
    return F.regexp_extract(text, rf"(?iu)^(.*?)(?:[0-9]{{2}}(?:[.,]|\s(?=[0-9]{{2}}\s))[0-9]{{2}}[.,\s]20[0-9]{{2}}(?![0-9])|[0-9]{{1,2}}\s+(?:{month})[а-я]*\s+20[0-9]{{2}})", 1)


def _last(values: Column) -> Column:
    return F.get(values, F.size(values) - 1)


def wrapped_heads(words: DataFrame, pages: DataFrame) -> DataFrame:
    """STR-20: page, number, date of narrow header cells: a year cut after ``20`` with two digits below it, and the number left of it.

    What continues a word stands below its beginning, within its width, half a line to 2.2 lines down. The first such date in the
    order of reading counts, with the nearest number on its left and the digits below that.
    """
    h = F.col("line_h")
    own = words.join(pages.select("page", "height", "line_h"), "page")
    cut = own.where(F.col("text").rlike("^[0-9]{2}[.,][0-9]{2}[.,]20$") & (F.col("cy") <= TOP_SHARE * F.col("height")))
    spot = lambda df, mark: df.select("page", *[F.col(c).alias(f"{mark}{c}") for c in ("line", "pos", "text", "x0", "x1", "cy", "cx")])

    def below(df: DataFrame, mark: str, pattern: str, keys: list[str]) -> DataFrame:
        inside = (F.col("b_cy") > F.col(f"{mark}cy") + 0.5 * h) & (F.col("b_cy") < F.col(f"{mark}cy") + 2.2 * h) & (F.col("b_cx") > F.col(f"{mark}x0")) & (F.col("b_cx") < F.col(f"{mark}x1"))
        met = df.join(spot(words.where(F.col("text").rlike(pattern)), "b_"), "page").join(pages.select("page", "line_h"), "page").where(inside)
        return met.groupBy(*keys).agg(F.min_by("b_text", F.struct("b_line", "b_pos")).alias("tail"))

    dates = spot(cut, "d_")
    keys = ["page", "d_line", "d_pos"]
    tails = below(dates, "d_", "^[0-9]{2}$", keys)
    first = dates.join(tails, keys).withColumn("k", F.row_number().over(Window.partitionBy("page").orderBy("d_line", "d_pos"))).where("k = 1")
    left = spot(words.where(F.col("text").rlike("^[A-Za-zА-Яа-яЁё]{1,4}[0-9]{3,}$")), "n_")
    beside = (F.abs(F.col("n_cy") - F.col("d_cy")) < 0.5 * h) & (F.col("n_x1") < F.col("d_x0"))
    number = first.select("page", "d_cy", "d_x0").join(left, "page").join(pages.select("page", "line_h"), "page").where(beside)
    number = number.withColumn("k", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("n_x1"), "n_line"))).where("k = 1").drop("line_h")
    ends = below(number, "n_", "^[0-9]{1,3}$", ["page"]).withColumnRenamed("tail", "number_tail")
    at = first.join(number.select("page", "n_text"), "page", "left").join(ends, "page", "left")
    date = F.concat(F.translate(F.substring("d_text", 1, 6), ",", "."), F.lit("20"), F.col("tail"))
    return at.select("page", F.concat("n_text", F.coalesce("number_tail", F.lit(""))).alias("number"), date.alias("date"))


def split_day_dates(words: DataFrame, pages: DataFrame) -> DataFrame:
    """STR-22: page, date where the day's digits are words of their own, left of a month's name and at its height."""
    own = words.join(pages.select("page", "height"), "page")
    month = reduce(lambda c, x: c.when(F.col("text").rlike(f"(?iu)^{x[1]}"), F.lit(f"{x[0]:02}")), enumerate(MONTHS, 1), F.when(F.lit(False), F.lit("")))
    months = own.where(F.col("cy") <= TOP_SHARE * F.col("height")).withColumn("month", month).where("month is not null")
    months = months.select("page", "line", "pos", "month", F.col("x0").alias("mx0"), F.col("x1").alias("mx1"), F.col("y0").alias("my0"), F.col("y1").alias("my1"))
    years = words.where(fix_digits("text").rlike("^20[0-9]{2}$")).select("page", "line", F.col("pos").alias("yp"), F.col("x0").alias("yx0"), fix_digits("text").alias("year"))
    at = months.join(years, ["page", "line"]).where("yx0 > mx1").groupBy("page", "line", "pos", "month", "mx0", "my0", "my1").agg(F.min_by("year", "yp").alias("year"))
    h = F.col("my1") - F.col("my0")
    digits = words.where(F.col("text").rlike("^[0-9]{1,2}$")).select("page", "x0", "x1", "y0", "y1", F.col("text").alias("d"))
    near = (F.col("x1") <= F.col("mx0") + 0.2 * h) & (F.col("x1") > F.col("mx0") - 3 * h) & (F.col("y1") > F.col("my0")) & (F.col("y0") < F.col("my1"))
    day = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "d"))), lambda x: x["d"]), "").try_cast("int")
    found = at.join(digits, "page").where(near).groupBy("page", "line", "pos", "month", "year").agg(day.alias("day")).where("day between 1 and 31")
    date = F.concat_ws(".", F.lpad(F.col("day").cast("string"), 2, "0"), "month", "year")
    return found.groupBy("page").agg(F.min_by(date, F.struct("line", "pos")).alias("date"))


def line_heads(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """STR-21 on lines (page, line, text, y1): page, number, date: labelled ones, else those of a title line, else those of the first dated line on top."""
    t, fixed = F.col("text"), fix_digits("text")
    at = lines.join(pages.select("page", "height"), "page")
    # Columns one on another: each is worked out once for a line, a number only where its date was found.
    top = (F.col("y1") < TOP_SHARE * F.col("height")) & ~t.rlike(NOT_ITS_DATE)
    at = at.withColumn("fixed", fixed).withColumns({
        "label": F.nullif(F.regexp_extract(t, NUMBER_LABEL, 1), F.lit("")), "dated": F.when(t.rlike(DATE_LABEL) & ~t.rlike("(?iu)составлен"), find_date(fix_digits(F.regexp_extract(t, DATE_LABEL, 1)))),
        "own_date": F.when(t.rlike(TITLE), F.coalesce(find_date("text"), find_date("fixed"))), "top_date": F.nullif(F.when(top, find_date("fixed")), F.lit(FORM_DATE)),
    })
    label, sign = F.col("label"), F.nullif(F.regexp_extract(t, NUMBER_SIGN, 1), F.lit(""))
    title_no = F.coalesce(to_cyrillic(F.regexp_replace(sign, r"\s", "")), _last(_runs(fix_digits(_before_date(t)))))
    top_no = _last(_runs(F.regexp_replace(_before_date(F.col("fixed")), r"[|\]\[]", " ")))
    at = at.withColumns({
        "labelled": F.concat(to_cyrillic(F.left(label, F.lit(2))), F.regexp_replace(F.substring(label, F.lit(3), F.char_length(label)), "[OО]", "0")),
        "title_no": F.when(F.col("own_date").isNotNull(), title_no), "top_no": F.when(F.col("top_date").isNotNull(), top_no),
    })
    first = lambda value, there: F.min(F.when(F.col(there).isNotNull(), F.struct("line", F.col(value).alias("v"))))["v"]
    found = at.groupBy("page").agg(
        first("labelled", "label").alias("n1"), first("dated", "dated").alias("d1"), first("title_no", "own_date").alias("n2"), first("own_date", "own_date").alias("d2"), first("top_no", "top_date").alias("n3"), first("top_date", "top_date").alias("d3")
    )
    one, two = F.col("n1").isNotNull() | F.col("d1").isNotNull(), F.col("d2").isNotNull()
    pick = lambda k: F.when(one, F.col(f"{k}1")).when(two, F.col(f"{k}2")).otherwise(F.col(f"{k}3"))
    return found.select("page", pick("n").alias("number"), pick("d").alias("date"))


def number_and_date(words: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """STR-21 whole: page, number, date of every page: wrapped cells, else lines, else a split day. ``pages``: page, height, line_h."""
    mark = lambda df, k: df.select("page", *[F.col(c).alias(f"{c}{k}") for c in ("number", "date") if c in df.columns])
    at = pages.select("page").join(mark(wrapped_heads(words, pages), 1), "page", "left").join(mark(line_heads(lines, pages), 2), "page", "left").join(mark(split_day_dates(words, pages), 3), "page", "left")
    wrapped, lined = F.col("date1").isNotNull(), F.col("number2").isNotNull() | F.col("date2").isNotNull()
    number = F.when(wrapped, F.col("number1")).when(lined, F.col("number2"))
    return at.select("page", number.alias("number"), F.when(wrapped, F.col("date1")).when(lined, F.col("date2")).otherwise(F.col("date3")).alias("date"))
