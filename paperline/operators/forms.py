"""Line-based forms: pack invoices and two-line orders; supplier detection.

``lines``: page, line, text. A page's lines are few; windows run inside a page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import extract_numbers, fix_digits, is_valid_ean, near, round2, whole_number

VAT_RATE = 0.16
# How a pack, an amount and the tail of an order's row are written.
AMOUNT = "[0-9]{1,3}(?:[  ]?[0-9]{3})*[.,][0-9]{2}(?![0-9])"
PACK_ROW = rf"(?<![0-9])([0-9]{{6}})\s+(?=[A-Za-zА-Яа-яЁё])(.*?)\s([0-9]{{1,3}})\s*[xXхХ×%*]\s*([0-9]{{1,3}})\s+({AMOUNT}(?:.*?{AMOUNT}){{2,}}.*)$"
ORDER_TAIL = r"(?iu)\s(штук[а-я]*|шт\.?|упак[а-я]*|кг|блок[а-я]*|бут[а-я]*)\s+([0-9]{1,5})\s+([0-9][0-9 ,]*?)\s+([0-9][0-9 ,]*?)\s*$"


@dataclass(frozen=True)
class Supplier:
    """A registry entry: its place is its priority."""

    id: str
    bins: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()


def detect_supplier(text: Column, registry: list[Supplier]) -> Column:
    """FMT-01: the entry whose number stands first among the page's digits, else the first entry with a keyword in the text."""
    digits = F.regexp_replace(F.regexp_replace(fix_digits(text), r"[^0-9\n ]", " "), " ", "")
    spots = [F.struct(F.instr(digits, F.lit(b)).alias("at"), F.lit(i).alias("ord"), F.lit(s.id).alias("id")) for i, s in enumerate(registry) for b in s.bins]
    found = [F.when(text.rlike(k), F.lit(s.id)) for s in registry for k in s.keywords]
    none = F.lit(None).cast("string")
    by_number = F.array_min(F.filter(F.array(*spots), lambda x: x["at"] > 0))["id"] if spots else none
    return F.coalesce(by_number, *found, none)


def tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def pack_rows(lines: DataFrame) -> DataFrame:
    """TAB-24: rows "code name N x M price net rate vat gross": quantity in pieces, price of a piece with VAT.

    The gross sum is the one read if it agrees with net and VAT to five cents, else their sum.
    """
    text = tidy(F.col("text"))
    part = lambda i: F.regexp_extract(text, PACK_ROW, i)
    at = lines.where(text.rlike(PACK_ROW)).select("page", "line", part(1).alias("code"), F.trim(F.regexp_replace(part(2), "[`\"'“”„«»°|_~^]", "")).alias("name"), part(3).cast("int").alias("packs"), part(4).cast("int").alias("size"), fix_digits(part(5)).alias("tail"))
    rate = F.coalesce(F.nullif(F.regexp_extract("tail", "([0-9]{1,2})\\s*%", 1), F.lit("")).cast("double") / 100, F.lit(VAT_RATE))
    money = F.transform(F.filter(extract_numbers(F.regexp_replace("tail", "[0-9]{1,2}\\s*%", " ")), lambda x: x["has_decimals"]), lambda x: x["value"])
    at = at.withColumn("rate", rate).withColumn("m", money).withColumn("k", F.size("m"))
    four = F.col("k") >= 4
    last = lambda i: F.get("m", F.col("k") - i)
    at = at.withColumns({"net": F.when(four, last(3)).otherwise(last(2)), "vat": F.when(four, last(2)), "read": last(1)})
    at = at.withColumn("vat", F.when(near(F.col("vat"), round2(F.col("net") * F.col("rate")), 0.03), F.col("vat")).otherwise(round2(F.col("net") * F.col("rate"))))
    computed = round2(F.col("net") + F.col("vat"))
    at = at.withColumn("sum", F.when(near(F.col("read"), computed, 0.05), F.col("read")).otherwise(computed)).withColumn("qty", (F.col("packs") * F.col("size")).cast("double"))
    n = F.row_number().over(Window.partitionBy("page").orderBy("line"))
    return at.select("page", n.alias("n"), "code", "name", F.lit("шт").alias("unit"), F.struct(F.col("packs").alias("count"), "size").alias("pack"), "qty", round2(F.col("sum") / F.col("qty")).alias("price"), "sum", "vat")


def order_rows(lines: DataFrame) -> DataFrame:
    """TAB-25: rows of two lines; one that ends in unit, quantity, price and sum closes a row, those before it belong to it.

    Rows stand between the column header and the totals line. A code is split: its head opens the first line, its rest follows
    the row number in the last.
    """
    page = Window.partitionBy("page").orderBy("line")
    text = tidy(F.regexp_replace("text", "[`‚'’|]", " "))
    at = lines.withColumn("t", text)
    head = F.min(F.when(F.col("t").rlike("(?iu)наименование") & F.col("t").rlike("(?iu)кол"), F.col("line"))).over(Window.partitionBy("page"))
    at = at.withColumn("head", head).where(F.col("line") > F.col("head"))
    end = F.min(F.when(F.col("t").rlike("(?iu)^итог"), F.col("line"))).over(Window.partitionBy("page"))
    at = at.withColumn("end", end).where(F.col("end").isNull() | (F.col("line") < F.col("end"))).withColumn("closes", F.col("t").rlike(ORDER_TAIL))
    before = F.coalesce(F.sum(F.col("closes").cast("int")).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = at.withColumn("row", before).groupBy("page", "row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("closes"), F.struct("line", "t")))), lambda x: x["t"]), " ").alias("top"), F.max(F.when(F.col("closes"), F.col("t"))).alias("last")
    ).where("last is not null")
    tail = lambda i: F.regexp_extract("last", ORDER_TAIL, i)
    lead = F.regexp_replace("last", ORDER_TAIL, "")
    numbered = r"^[0-9]{1,3}\s+(?:([0-9]{3,6})\s+)?(.*)$"
    opened = r"^([0-9]{6,12})\s+(.*)$"
    code = F.nullif(F.concat(F.regexp_extract("top", opened, 1), F.regexp_extract(lead, numbered, 1)), F.lit(""))
    rest = F.when(F.col("top").rlike(opened), F.regexp_extract("top", opened, 2)).otherwise(F.col("top"))
    own = F.when(lead.rlike(numbered), F.regexp_extract(lead, numbered, 2)).otherwise(lead)
    unit = F.when(tail(1).rlike("(?iu)^штук"), "шт").otherwise(F.lower(tail(1)))
    out = rows.select("page", (F.col("row") + 1).alias("n"), code.alias("code"), tidy(F.concat_ws(" ", rest, own)).alias("name"), unit.alias("unit"), tail(2).cast("double").alias("qty"), whole_number(tail(3)).alias("price"), whole_number(tail(4)).alias("sum"))
    return out.withColumns({"barcode": F.when(is_valid_ean("code"), F.col("code")), "agrees": near(F.col("qty") * F.col("price"), F.col("sum"), 0.5)})


def text_totals(lines: DataFrame) -> DataFrame:
    """TOT-02, in part: ``totals``: distinct amounts on lines that speak of a total and on the lines after them."""
    page = Window.partitionBy("page").orderBy("line")
    speaks = F.col("text").rlike("(?iu)итого|всего|к оплате|total")
    near_total = speaks | F.coalesce(F.lag(speaks).over(page), F.lit(False))
    money = F.transform(F.filter(extract_numbers(fix_digits("text")), lambda x: x["has_decimals"] & (x["value"] >= 1)), lambda x: x["value"])
    return lines.withColumn("_near", near_total).where("_near").select("page", F.explode(money).alias("amount")).groupBy("page").agg(F.array_sort(F.collect_set("amount")).alias("totals"))
