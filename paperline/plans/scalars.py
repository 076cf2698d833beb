"""Scalar functions over the sales tables: text is composed from known numbers, so SQL knows what must come out."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import strings as S
from ..operators.layout import cluster1d
from ..operators.resolve import repair_ean
from .book import book
from .views import CENTS, INV, PARTS, ean13, inv_items, table

QUERIES, ORACLES, query = book()
LINE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"


@query(f"""WITH {INV}, d AS (SELECT doc_id, n, lpad(CAST(partkey * 1000 + CAST(qty AS BIGINT) AS VARCHAR), 9, '7') AS t FROM inv),
x AS (SELECT *, translate(t, '15', 'lS') AS bad FROM d)
SELECT doc_id, n, CASE WHEN length(regexp_replace(bad, '[^0-9]', '', 'g')) * 2 >= 9 THEN t ELSE bad END AS fixed FROM x""")
def q01_fix_digits(spark, sf_dir):
    text = F.lpad((F.col("partkey") * 1000 + F.col("qty").cast("long")).cast("string"), 9, "7")
    return inv_items(spark, sf_dir).select("doc_id", "n", N.fix_digits(F.translate(text, "15", "lS")).alias("fixed"))


@query(f"WITH {INV} SELECT doc_id, n, {CENTS.format('sum')} AS cents FROM inv")
def q02_parse_amount(spark, sf_dir):
    return inv_items(spark, sf_dir).select("doc_id", "n", N.cents(N.parse_amount(N.money_text(F.col("sum")))).alias("cents"))


@query(f"WITH {INV} SELECT doc_id, n, 3 AS found, partkey AS first, CAST(qty AS BIGINT) AS second, {CENTS.format('price')} AS third, true AS decimals FROM inv")
def q03_extract_numbers(spark, sf_dir):
    text = F.concat(F.lit("арт "), F.col("partkey"), F.lit(" кол "), F.col("qty").cast("long"), F.lit(" по "), N.money_text(F.col("price")))
    at = inv_items(spark, sf_dir).select("doc_id", "n", N.extract_numbers(text).alias("x"))
    value = lambda i: F.get("x", F.lit(i))["value"]
    return at.select("doc_id", "n", F.size("x").alias("found"), value(0).cast("long").alias("first"), value(1).cast("long").alias("second"), N.cents(value(2)).alias("third"), F.get("x", F.lit(2))["has_decimals"].alias("decimals"))


@query(f"WITH {PARTS} SELECT partkey, partkey % 3 <> 0 AS valid, substr(barcode, 1, 2) <> '02' AND partkey % 3 <> 0 AS product FROM parts")
def q04_ean_valid(spark, sf_dir):
    code = ean13(F.col("p_partkey"))
    last = (F.right(code, F.lit(1)).cast("int") + 1) % 10
    spoilt = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.substring(code, 1, 12), last.cast("string"))).otherwise(code)
    at = table(spark, sf_dir, "part").select("p_partkey", spoilt.alias("c"))
    return at.select(F.col("p_partkey").alias("partkey"), N.is_valid_ean("c").alias("valid"), N.product_ean(F.col("c")).alias("product"))


@query(f"""WITH {PARTS}, d AS (SELECT partkey, barcode, partkey % 13 + 1 AS pos FROM parts),
s AS (SELECT partkey, barcode, substr(barcode, 1, pos - 1) || CAST((CAST(substr(barcode, pos, 1) AS INTEGER) + 1) % 10 AS VARCHAR) || substr(barcode, pos + 1) AS bad FROM d),
t AS (SELECT partkey, bad, substr(bad, 1, i - 1) || CAST(j AS VARCHAR) || substr(bad, i + 1) AS code FROM s, range(1, 14) a(i), range(0, 10) b(j)),
h AS (SELECT t.partkey, count(DISTINCT t.code) AS n, min(t.code) AS code FROM t JOIN parts p ON t.code = p.barcode WHERE t.code <> bad GROUP BY t.partkey)
SELECT s.partkey, bad, CASE WHEN n = 1 THEN code END AS repaired FROM s LEFT JOIN h ON s.partkey = h.partkey""")
def q05_ean_repair_known(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), ean13(F.col("p_partkey")).alias("code"))
    i = (F.col("partkey") % 13 + 1).cast("int")
    digit = ((F.substring("code", i, F.lit(1)).cast("int") + 1) % 10).cast("string")
    bad = F.concat(F.substring("code", F.lit(1), i - 1), digit, F.substring("code", i + 1, F.lit(13)))
    found = repair_ean(parts.select("partkey", bad.alias("barcode")), parts)
    return found.select("partkey", F.col("barcode").alias("bad"), "repaired")


@query(f"""WITH {INV}, d AS (SELECT *, CASE WHEN n % 4 = 0 THEN sum + 1 ELSE sum END AS s, abs(qty * price - round(qty * price)) < 0.005 AS w FROM inv)
SELECT unit, count(*) AS rows, count(*) FILTER (WHERE abs(s - qty * price) <= greatest(0.02, qty * 0.005 + 0.01) OR (w AND floor(s) = round(qty * price))) AS matching FROM d GROUP BY unit""")
def q06_sum_matches(spark, sf_dir):
    total = F.when(F.col("n") % 4 == 0, F.col("sum") + 1).otherwise(F.col("sum"))
    hit = N.sum_matches(total, F.col("qty"), F.col("price"))
    return inv_items(spark, sf_dir).groupBy("unit").agg(F.count("*").alias("rows"), F.count_if(hit).alias("matching"))


@query(f"WITH {INV} SELECT supplier_key, CAST(sum({CENTS.format('sum * 0.12 / 1.12')}) AS BIGINT) AS included_cents, CAST(sum({CENTS.format('sum * 0.16')}) AS BIGINT) AS on_top_cents FROM inv GROUP BY supplier_key")
def q07_vat(spark, sf_dir):
    at = inv_items(spark, sf_dir).select("supplier_key", N.cents(N.vat_of(F.col("sum"), 0.12)).alias("a"), N.cents(N.vat_of(F.col("sum"), 0.16, False)).alias("b"))
    return at.groupBy("supplier_key").agg(F.sum("a").alias("included_cents"), F.sum("b").alias("on_top_cents"))


@query(f"""WITH {INV}, d AS (SELECT n, CAST({CENTS.format('sum')} AS VARCHAR) AS a, CAST({CENTS.format('CASE n % 3 WHEN 0 THEN sum * 10 WHEN 1 THEN sum + 300 ELSE sum + 11.11 END')} AS VARCHAR) AS b FROM inv)
SELECT n % 3 AS kind, count(*) AS rows, count(*) FILTER (WHERE levenshtein(lpad(a, CAST(greatest(3, length(a)) AS INTEGER), '0'), lpad(b, CAST(greatest(3, length(b)) AS INTEGER), '0')) = 1) AS off FROM d GROUP BY n % 3""")
def q08_one_digit_off(spark, sf_dir):
    kind = F.col("n") % 3
    other = F.when(kind == 0, F.col("sum") * 10).when(kind == 1, F.col("sum") + 300).otherwise(F.col("sum") + 11.11)
    return inv_items(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("rows"), F.count_if(N.one_digit_off(F.col("sum"), other)).alias("off"))


@query("""WITH e AS (SELECT user_id, event_id, value AS v, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) > 5 THEN 1 ELSE 0 END AS s FROM events WHERE value IS NOT NULL),
c AS (SELECT user_id, v, sum(s) OVER (PARTITION BY user_id ORDER BY v, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, CAST(k AS BIGINT) AS cluster, count(*) AS members, min(v) AS low, max(v) AS high FROM c GROUP BY user_id, k""")
def q09_cluster1d(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("value is not null").select("user_id", "event_id", "value")
    at = cluster1d(events, ["user_id"], "value", 5, ["event_id"])
    return at.groupBy("user_id", F.col("cluster").cast("long").alias("cluster")).agg(F.count("*").alias("members"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("SELECT event_type, list_sort(list(value))[CAST(count(value) // 2 + 1 AS BIGINT)] AS upper_median FROM events WHERE value IS NOT NULL GROUP BY event_type")
def q10_upper_median(spark, sf_dir):
    # The upper of two middle values is the lower one in falling order; counts of values combine on the map side.
    events = table(spark, sf_dir, "events").where("value is not null")
    return events.groupBy("event_type").agg(F.expr("percentile_disc(0.5) within group (order by value desc)").alias("upper_median"))


@query("SELECT p_partkey AS partkey, 'sok zhuk ' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' 05l' AS plain FROM part")
def q11_normalize_name(spark, sf_dir):
    name = F.concat(F.lit("Сок «Жук» "), F.col("p_name"), F.lit(" 0,5Л"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), S.normalize_name(name).alias("plain"))


@query("""SELECT p_partkey AS partkey, (p_size * 10) / 1000.0::DOUBLE AS litres, 'шт' AS pieces, CASE WHEN p_size % 2 = 0 THEN 'кг' ELSE 'бут' END AS unit, CAST(NULL AS VARCHAR) AS unclear,
lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') || '.' || lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') || '.2026' AS day FROM part""")
def q12_sizes_units_dates(spark, sf_dir):
    months = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]
    p = table(spark, sf_dir, "part")
    day, month = F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"), F.col("p_size") % 12
    worded = F.concat(F.lit("от "), day, F.lit(" "), F.element_at(F.array(*map(F.lit, months)), month + 1), F.lit(" 2026 г."))
    written = F.concat(F.lit("№ 17 от "), day, F.lit("."), F.lpad((month + 1).cast("string"), 2, "0"), F.lit(".2026"))
    return p.select(
        F.col("p_partkey").alias("partkey"), F.get(S.sizes_of(F.concat(F.lit("Напиток "), (F.col("p_size") * 10).cast("string"), F.lit("мл"))), F.lit(0)).alias("litres"),
        S.normalize_unit(F.lit("Wryка.")).alias("pieces"), S.normalize_unit(F.when(F.col("p_size") % 2 == 0, "Kr.").otherwise("6yr")).alias("unit"), S.normalize_unit(F.lit("wr")).alias("unclear"),
        S.find_date(F.when(F.col("p_size") % 2 == 0, worded).otherwise(written)).alias("day"),
    )


@query("""WITH n AS (SELECT DISTINCT p_name AS name, regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g') AS p FROM part),
g AS (SELECT name, list_distinct([substr(' ' || p || ' ', i, 3) FOR i IN range(1, length(p) + 1)]) AS t FROM n)
SELECT a.name AS a, b.name AS b, floor(2.0 * len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t)) * 10000 + 0.5) / 10000 AS dice FROM g a JOIN g b ON a.name < b.name""")
def q13_name_similarity(spark, sf_dir):
    # Distinct product names are a small vocabulary; each pair of them is asked for here.
    grams = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("t", S.trigrams(S.normalize_name("name")))
    a, b = grams.alias("a"), grams.alias("b")
    score = F.floor(S.dice(F.col("a.t"), F.col("b.t")) * 10000 + 0.5) / 10000
    return a.join(b, F.col("a.name") < F.col("b.name")).select(F.col("a.name").alias("a"), F.col("b.name").alias("b"), score.alias("dice"))


@query(f"""WITH {INV} SELECT doc_id, n, CAST(qty * 10 AS BIGINT) AS scaled, CASE WHEN n % 2 = 0 THEN qty ELSE 1 / qty END AS factor, ltrim(CAST(doc_id AS VARCHAR), '0') AS digits,
partkey AS whole, CASE WHEN n = 1 THEN 1 ELSE 0 END AS differs FROM inv""")
def q14_user_input(spark, sf_dir):
    """Numbers and scale expressions as a user types them, document digits, thousands, code distance."""
    qty = F.col("qty").cast("long").cast("string")
    grouped = F.translate(F.format_number("partkey", 0), ",", " ")
    other = F.when(F.col("n") == 1, F.concat(F.lit("X"), F.substring("barcode", 2, 12))).otherwise(F.col("barcode"))
    return inv_items(spark, sf_dir).select(
        "doc_id", "n", N.parse_user_number(F.concat(F.lit(" "), qty, F.lit(" 0,0"))).cast("long").alias("scaled"),
        N.parse_scale(F.concat(F.when(F.col("n") % 2 == 0, "x").otherwise("/"), qty)).alias("factor"), S.number_digits(F.concat(F.lit("№ 00"), F.col("doc_id"))).alias("digits"),
        N.whole_number(grouped).cast("long").alias("whole"), N.digit_difference(F.col("barcode"), other).alias("differs"),
    )


@query("""WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations)
SELECT conv_id, string_agg(text, ' ' ORDER BY k) AS text, count(*) AS turns FROM t GROUP BY conv_id""")
def q46_ordered_text(spark, sf_dir):
    """GEO-06: parts joined in reading order; a conversation has a bounded number of turns."""
    c = table(spark, sf_dir, "conversations")
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"), F.count("*").alias("turns"))


@query("SELECT event_type, count(*) AS rows, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(DISTINCT json_extract_string(props, '$.k')) AS keys FROM events GROUP BY event_type")
def q47_json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("rows"), F.sum("p.k").alias("total"), F.countDistinct("p.k").alias("keys"))


