"""Readers of recognised pages, catalogue files and dictionaries, and their writers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = "struct<text: string, conf: double, x0: double, y0: double, x1: double, y1: double>"
LINE = f"struct<text: string, conf: double, x0: double, y0: double, x1: double, y1: double, words: array<{WORD}>>"
PAGE_SCHEMA = f"width double, height double, charHeight double, lines array<{LINE}>, strips array<struct<role: string, x0: double, y0: double, x1: double, y1: double, lines: array<{LINE}>>>, rules struct<h: array<double>, v: array<double>>"

# Words that mark the columns of a catalogue file.
HEADERS = {
    "name": "(?iu)^(наименование|название|товар|name)", "barcode": "(?iu)^(штрих-?код|barcode|ean)", "extra": "(?iu)^(доп|extra)", "ntin": "(?iu)ntin",
    "unit": "(?iu)^(ед|unit)", "supplier": "(?iu)^(поставщик|supplier)", "price": "(?iu)(закуп|purchase|price)",
}


def ocr_pages(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07, SRC-08: one page for each JSON file; ``page`` is its file's path; lines by their upper edge, confidences whole."""
    pages = spark.read.schema(PAGE_SCHEMA).option("multiLine", True).json(path).withColumn("page", F.col("_metadata.file_path"))
    tidy = F.transform("lines", lambda x: x.withField("conf", F.round(x["conf"])).withField("text", F.regexp_replace(x["text"], "\n+$", "")))
    by_edge = F.transform(F.array_sort(F.transform(tidy, lambda x, i: F.struct(x["y0"].alias("y0"), i.alias("i"), x.alias("x")))), lambda s: s["x"])
    return pages.withColumn("lines", by_edge)


def codes_of(cell: Column) -> Column:
    """SRC-10: digits of the codes in a cell, four at least."""
    return F.filter(F.transform(F.split(cell, r"[;,\s]+"), lambda c: F.regexp_replace(c, "[^0-9]", "")), lambda c: F.char_length(c) >= 4)


def read_catalogue(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """SRC-09: delimited files with up to 19 rows before a header that names a name and a barcode column, wherever in the row.

    All files are read in one scan; their layouts are found and joined by file, and no row comes to the driver. Codes of a row are
    kept whatever their number. Rows without a name or a code are dropped. A file without a header has no rows; raises if none has one.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    cells = lambda line: F.transform(F.split(line, re.escape(sep) + r"(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), lambda c: F.trim(F.regexp_replace(F.trim(c), "^\"|\"$", "")))
    first = raw.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("block", "at"))).where("k <= 20").withColumn("c", cells(F.col("value")))
    spot = lambda p: F.get(F.filter(F.transform("c", lambda x, i: F.when(x.rlike(p), i)), lambda i: i.isNotNull()), F.lit(0))
    spots = first.select("file", "k", "at", *[spot(p).alias(k) for k, p in HEADERS.items()]).where("name is not null and barcode is not null")
    layout = spots.groupBy("file").agg(F.min_by(F.struct(F.col("at").alias("head"), *HEADERS), "k").alias("l")).select("file", "l.*")
    if layout.isEmpty():
        raise ValueError("no header with a name and a barcode column in the first 20 rows")
    layout = layout.select("file", "head", *[F.col(k).alias(f"_{k}") for k in HEADERS])
    rows = raw.join(layout, "file").where(F.col("at") > F.col("head")).withColumn("c", cells(F.col("value")))
    cell = lambda k: F.get("c", F.col(f"_{k}"))
    codes = F.array_distinct(F.flatten(F.array_compact(F.array(*[F.coalesce(codes_of(cell(k)), F.array().cast("array<string>")) for k in ("barcode", "extra", "ntin")]))))
    price = F.regexp_replace(F.translate(cell("price"), ",", "."), r"\s", "").try_cast("double")
    found = rows.select("file", "at", cell("name").alias("name"), codes.alias("codes"), cell("unit").alias("unit"), cell("supplier").alias("supplier"), price.alias("price"))
    kept = found.where((F.col("name") != "") & (F.size("codes") > 0))
    return kept.select(F.col("at").alias("catalog_ord"), "name", F.get("codes", F.lit(0)).alias("barcode"), F.slice("codes", F.lit(2), F.size("codes")).alias("extra"), "unit", "supplier", "price")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: a JSON map keyed ``supplier::code``, bare or under ``mapping``; entries with a barcode count."""
    entry = "map<string, struct<barcode: string, name: string, supplier: string, updated: string>>"
    raw = spark.read.text(path, wholetext=True)
    inner = F.coalesce(F.get_json_object("value", "$.mapping"), F.col("value"))
    at = raw.select(F.explode(F.from_json(inner, entry)).alias("k", "v")).where(F.col("k").contains("::") & F.col("v.barcode").isNotNull())
    cut = F.instr("k", F.lit("::"))
    return at.select(F.substring("k", F.lit(1), cut - 1).alias("supplier_key"), F.substring("k", cut + 2, F.char_length("k")).alias("map_code"), "v.*")


def merge_dictionaries(old: DataFrame, new: DataFrame) -> DataFrame:
    """SRC-14: entries of both; the newer wins."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    best = both.groupBy("supplier_key", "map_code").agg(F.max_by(F.struct(*old.columns), "_side").alias("x"))
    return best.select("x.*")


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """SNK-05: a line of JSON for each entry."""
    value = F.struct(*[c for c in dictionary.columns if c not in ("supplier_key", "map_code")])
    dictionary.select(F.to_json(F.create_map(F.concat_ws("::", "supplier_key", "map_code"), value)).alias("value")).write.text(path)


def write_tsv(lines: DataFrame, path: str) -> None:
    """SNK-02: codes stay text, tabs and breaks inside cells become spaces."""
    lines.select("line").write.text(path)
