"""Whole documents from recognised pages: the supplier, the layouts worth a try side by side, the best one's items, the head."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import near
from ..functions.strings import page_text
from . import anchors, forms, heads, layout, table
from .stage import stored

# A page of a pack invoice, and of the form of the ministry.
PACK_PAGE = r"(?iu)ВСЕГО\s+ПО\s+СЧЕТУ|ЦЕНА\s+ЗА\s+УП"
FORM_PAGE = r"(?iu)ОТПУСК\s+ЗАПАСОВ|З-2|3-2"


@dataclass(frozen=True)
class Supplier(forms.Supplier):
    """A registry entry with its parser (table, pack or order) and the options of its layout."""

    name: str = ""
    parser: str = "table"
    layout: dict = field(default_factory=dict)


def read_registry(text: str) -> list[Supplier]:
    """Entries from JSON: a list of {id, name, bins, keywords, parser, layout}; the first has priority.

    Raises for an option that layouts don't have, so that a misspelt one isn't lost.
    """
    out = []
    for entry in json.loads(text):
        unknown = set(entry.get("layout", {})) - set(anchors.LAYOUT)
        if unknown:
            raise ValueError(f"{entry['id']}: unknown options {sorted(unknown)}")
        out.append(Supplier(entry["id"], tuple(entry.get("bins", ())), tuple(entry.get("keywords", ())), entry.get("name", entry["id"]), entry.get("parser", "table"), entry.get("layout", {})))
    return out


#: Layouts tried where the supplier is unknown: kind of code, place of the numbers. The first of equals wins inside a kind.
TRIED = [(kind, align, names) for kind in ("ean", "digits") for align, names in (("center", "nearest"), ("top", "down"), ("bottom", "up"))] + [("none", "center", "nearest")]


def layouts(pages: DataFrame, registry: list[Supplier]) -> DataFrame:
    """FMT-01, FMT-02: page, supplier, parser and a row for each layout to be tried (``try``, its order, and the layout's options)."""
    options = [c for c in anchors.LAYOUT]
    kinds = dict(x.split() for x in anchors.LAYOUT_DDL.replace("\n", " ").split(", "))
    text = page_text(F.col("lines"))
    at = pages.select("page", text.alias("text")).withColumn("supplier", forms.detect_supplier(F.col("text"), registry))
    one = lambda given: F.struct(*[F.lit((anchors.LAYOUT | given)[c]).cast(kinds[c]).alias(c) for c in options])
    tried = F.array(*[F.struct(F.lit(i).alias("try"), one({"code": k, "row_align": a, "name_dir": n}).alias("o")) for i, (k, a, n) in enumerate(TRIED)])
    known, parser = None, F.when(F.col("text").rlike(PACK_PAGE), "pack").otherwise("table")
    for s in registry:
        own = F.array(F.struct(F.lit(0).alias("try"), one(s.layout).alias("o")))
        this = F.col("supplier") == s.id
        known = F.when(this, own) if known is None else known.when(this, own)
        parser = F.when(this, F.lit(s.parser)).otherwise(parser)
    chosen = F.coalesce(known, tried) if known is not None else tried
    out = at.select("page", "supplier", parser.alias("parser"), F.col("text").rlike(FORM_PAGE).alias("known_form"), F.inline(chosen))
    return out.select("page", "supplier", "parser", "known_form", "try", "o.*")


def scores(items: DataFrame, totals: DataFrame) -> DataFrame:
    """FMT-03: page, rows, solved and ``score``: rows that three readings support, and one more than all rows if the total is met."""
    each = items.groupBy("page").agg(F.count("*").alias("rows"), F.sum((F.col("support") >= 3).cast("int")).alias("solved"))
    at = each.join(totals.select("page", "total", "rows_sum"), "page", "left")
    met = near(F.col("total"), F.col("rows_sum"), 0.05 + 0.01 * F.col("rows"))
    return at.select("page", "rows", "solved", (F.col("solved") + F.when(met, F.col("rows") + 1).otherwise(0)).alias("score"), met.alias("total_met"))


def plausibility(items: DataFrame, totals: DataFrame) -> DataFrame:
    """FMT-09: page, ``points``: a thousand for a total that is met (three hundred for one that isn't), less twenty for an error, five for a warning."""
    s = scores(items, totals).join(totals.select("page", "total"), "page", "left")
    bad = items.groupBy("page").agg(*[F.sum(((F.col("level") == k) | F.coalesce(F.col("code_level") == k, F.lit(False))).cast("int")).alias(k) for k in ("error", "warn")])
    points = F.when(F.col("total_met"), 1000).when(F.col("total").isNotNull(), 300).otherwise(0) - 20 * F.col("error") - 5 * F.col("warn")
    return s.join(bad, "page").select("page", points.alias("points"))


def text_quality(words: DataFrame) -> DataFrame:
    """FMT-08: page, ``quality``: words read with confidence 70 or more that hold four Cyrillic letters in a row."""
    good = (F.col("conf") >= 70) & F.col("text").rlike("[А-Яа-яЁё]{4}")
    return words.groupBy("page").agg(F.sum(good.cast("int")).alias("quality"))


def best_layouts(tried: DataFrame, rated: DataFrame) -> DataFrame:
    """FMT-02, FMT-03: page, ``key`` of the layout kept: of the first kind of code whose plain layout finds enough rows the one with the highest score.

    Enough are two rows, or one that three readings support; without any the layout without codes stays.
    """
    at = tried.join(rated.withColumnRenamed("page", "key"), "key", "left").fillna({"rows": 0, "solved": 0, "score": 0})
    alone = F.count("*").over(Window.partitionBy("page")) == 1
    enough = (F.col("rows") >= 2) | ((F.col("rows") == 1) & (F.col("solved") == 1))
    plain = (F.col("row_align") == "center") & enough
    has = lambda kind: F.max((plain & (F.col("code") == kind)).cast("int")).over(Window.partitionBy("page")) == 1
    kind = F.when(has("ean"), "ean").when(has("digits"), "digits").otherwise("none")
    at = at.withColumns({"alone": alone, "kind": kind}).where((F.col("alone")) | (F.col("code") == F.col("kind")))
    return at.groupBy("page").agg(F.max_by("key", F.struct("score", (-F.col("try")).alias("first"))).alias("key"))


def parse_documents(pages: DataFrame, registry: list[Supplier] | None = None, latest: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """FMT-06: documents and their items from pages (``readers.PAGE_SCHEMA`` with ``page``).

    Documents: page, supplier, number, date, layout (``code``, ``row_align``), total, rows_sum, total_met, unknown_form. A known supplier has
    its own layout; others are read in all of TRIED at once, as pages of their own in one plan, and the best is kept. Dates after
    ``latest`` (two days from now) are an expiry's and go with the number beside them. Pages of packs and orders have their rows from
    their own line parsers. A page without rows is a document without items.
    """
    registry = registry or []
    sizes = pages.select("page", "width", "height", "charHeight")
    words = stored(layout.flatten_words(pages), "flat-words")
    h = stored(layout.line_height(words, pages), "line-heights")
    tried = stored(layouts(pages, registry).withColumn("key", F.concat_ws("#", F.col("page").cast("string"), F.col("try").cast("string"))), "layouts")
    tables = tried.where("parser = 'table'")
    keyed = words.join(tables.select("page", "key"), "page").drop("page").withColumnRenamed("key", "page")
    sheets = stored(tables.join(sizes, "page").join(h, "page").select(F.col("key").alias("page"), "width", "height", "line_h", *anchors.LAYOUT), "sheets")
    items, totals = table.recognised(keyed.select("page", *[c for c in words.columns if c != "page"]), sheets)
    totals = stored(totals, "page-totals")
    rated = stored(scores(items, totals), "scores")
    best = stored(best_layouts(tables, rated), "best")
    back = best.withColumnsRenamed({"page": "document", "key": "page"})
    rows = items.join(back, "page").drop("page").withColumnRenamed("document", "page")
    lines = pages.select("page", F.posexplode("lines").alias("line", "l")).select("page", "line", "l.text", "l.y1")
    for name, parser in (("pack", forms.pack_rows), ("order", forms.order_rows)):
        if name == "pack" or any(s.parser == name for s in registry):
            own = parser(lines.join(tried.where(F.col("parser") == name).select("page"), "page", "left_semi"))
            own = own.select(*[c for c in own.columns if c in rows.columns], (F.col("n") - 1).cast("int").alias("row"))
            rows = rows.unionByName(own, allowMissingColumns=True)
    found = heads.number_and_date(words, lines, sizes.join(h, "page"))
    late = F.coalesce(F.try_to_timestamp("date", F.lit("dd.MM.yyyy")).cast("date") > (F.date_add(F.current_date(), 2) if latest is None else latest), F.lit(False))
    found = found.select("page", *[F.when(~late, F.col(c)).alias(c) for c in ("number", "date")])
    kept = tried.join(best, ["page", "key"], "left_semi").select("page", "supplier", "known_form", "code", "row_align", "key")
    others = tried.where("parser <> 'table'").select("page", "supplier", F.lit(True).alias("known_form"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("row_align"), F.lit(None).cast("string").alias("key")).distinct()
    docs = kept.unionByName(others).join(found, "page", "left").join(totals.withColumnRenamed("page", "key"), "key", "left").join(rated.select(F.col("page").alias("key"), "total_met"), "key", "left")
    return docs.select("page", "supplier", "number", "date", "code", "row_align", "total", "rows_sum", "total_met", (~F.col("known_form") & F.col("supplier").isNull()).alias("unknown_form")), rows


def registry_frame(spark: SparkSession, registry: list[Supplier]) -> DataFrame:
    """The registry as a table: ord, id, name, parser, bins, keywords, layout (JSON)."""
    rows = [(i, s.id, s.name, s.parser, list(s.bins), list(s.keywords), json.dumps(s.layout, ensure_ascii=False)) for i, s in enumerate(registry)]
    return spark.createDataFrame(rows, "ord int, id string, name string, parser string, bins array<string>, keywords array<string>, layout string")
