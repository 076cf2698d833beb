"""Amounts, roundings, tolerances and check digits as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that a reader takes for digits, and the digits meant.
LOOKALIKE_LETTERS = "OoОоQDЗзбБlI|i][!Ss$BВgЧч"
LOOKALIKE_DIGITS = "0000003366111111155588944"
EPSILON = 2.220446049250313e-16
NBSP = " "


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: what a lambda names by a column, the optimizer puts into each of its turns."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fix_digits(token: str | Column) -> Column:
    """NUM-01: look-alikes become digits in a token of which at least half is digits already."""
    t = col(token)
    digits, size = F.regexp_count(t, F.lit("[0-9]")), F.char_length(F.regexp_replace(t, rf"[\s{NBSP}.,]", ""))
    return F.when((digits > 0) & (digits * 2 >= size), F.translate(t, LOOKALIKE_LETTERS, LOOKALIKE_DIGITS)).otherwise(t)


def parse_amount(text: str | Column) -> Column:
    """NUM-02: spaces between thousands, comma or point before one to three decimals; else null."""
    t = F.regexp_replace(F.regexp_replace(col(text), "(?U)[\\s\ufeff]", ""), "[‚،]", ",")
    return F.when(t.rlike(r"^[0-9]+([.,][0-9]{1,3})?$"), F.translate(t, ",", ".").try_cast("double"))


NUMBER = rf"(?<![0-9,.])(?:[0-9]{{1,3}}(?:[ {NBSP}][0-9]{{3}})+[.,][0-9]{{2}}|[0-9]+[.,][0-9]{{1,3}}|[0-9]+)(?![0-9])"


def extract_numbers(line: str | Column) -> Column:
    """NUM-03: array of (value, text, has_decimals); spaces join thousands only if decimals follow."""
    healed = F.regexp_replace(F.translate(col(line), "‚", ","), rf"([0-9])[\s{NBSP}]*[,.][\s{NBSP}]+([0-9]{{2}})(?![0-9])", "$1,$2")
    found = F.regexp_extract_all(healed, F.lit(NUMBER), F.lit(0))
    # What is found is an amount in itself, so only its blanks and its comma are to be put right.
    value = lambda t: F.translate(t, f", {NBSP}", ".").try_cast("double")
    return F.transform(found, lambda t: F.struct(value(t).alias("value"), t.alias("text"), t.rlike("[.,][0-9]+$").alias("has_decimals")))


def round2(x: str | Column) -> Column:
    """NUM-04: halves up, after a hundred epsilons."""
    return F.floor(col(x) * 100 + 100 * EPSILON + 0.5) / 100


def round3(x: str | Column) -> Column:
    """NUM-05."""
    return F.floor(col(x) * 1000 + 0.5) / 1000


def cents(x: str | Column) -> Column:
    """An amount as a whole number of cents."""
    return F.floor(col(x) * 100 + 100 * EPSILON + 0.5).cast("long")


def near(a: str | Column, b: str | Column, tol: float | Column = 0.011) -> Column:
    """NUM-06: false if either is missing."""
    return F.coalesce(F.abs(col(a) - col(b)) <= tol + F.lit(1e-9), F.lit(False))


def amount_variants(value: Column, text: Column, has_decimals: Column) -> Column:
    """NUM-07: the value, and a hundredth of it if three digits or more carry no decimals."""
    lost = ~has_decimals & (F.char_length(F.regexp_replace(text, "[^0-9]", "")) >= 3)
    return F.array_compact(F.array(value, F.when(lost, value / 100)))


def vat_of(total: Column, rate: float | Column, included: bool = True) -> Column:
    """NUM-08."""
    rate = F.lit(rate) if isinstance(rate, float) else rate
    return round2(total * rate / (1 + rate) if included else total * rate)


def cent_digits(x: Column) -> Column:
    """Digits of an amount in cents, three at least."""
    c = cents(x).cast("string")
    return F.when(F.char_length(c) < 3, F.lpad(c, 3, "0")).otherwise(c)


def one_digit_off(a: Column, b: Column) -> Column:
    """NUM-09: one digit replaced, left out or put in."""
    return F.coalesce(F.levenshtein(cent_digits(a), cent_digits(b)) == 1, F.lit(False))


def sum_tolerance(qty: Column) -> Column:
    """NUM-10."""
    return F.greatest(F.lit(0.02), qty * 0.005 + 0.01)


def sum_matches(total: Column, qty: Column, price: Column, tol: Column | None = None) -> Column:
    """NUM-11: within tolerance; the whole sum of a broken quantity, rounded; or spoilt cents beside a whole product of a whole quantity."""
    product = qty * price
    cents_of, whole = round2(product), qty == F.floor(qty)
    tol = sum_tolerance(qty) if tol is None else tol
    return F.coalesce(
        (F.abs(total - cents_of) <= tol + 1e-9)
        | (~whole & (total == F.floor(total)) & (total == F.floor(product + 0.5)))
        | (whole & (cents_of == F.floor(cents_of)) & (F.floor(total) == cents_of)),
        F.lit(False),
    )


def distinct_amounts(values: Column) -> Column:
    """NUM-12: positive amounts, rounded, first occurrences in order."""
    return F.array_distinct(F.transform(F.filter(values, lambda x: x > 0), round2))


def ean_check_digit(body: Column) -> Column:
    """The digit after ``body``: weights 3 and 1 from the right."""
    reversed_digits = F.split(F.reverse(body), "")
    total = F.aggregate(F.transform(reversed_digits, lambda d, i: d.try_cast("int") * F.when(i % 2 == 0, 3).otherwise(1)), F.lit(0), lambda a, x: a + x)
    return F.pmod(-total, F.lit(10))


def is_valid_ean(code: str | Column) -> Column:
    """NUM-13: eight or thirteen digits with the right check digit."""
    c = col(code)
    body = F.substring(c, F.lit(1), F.char_length(c) - 1)
    return F.coalesce(c.rlike("^([0-9]{8}|[0-9]{13})$") & F.when(c.rlike("^[0-9]+$"), ean_check_digit(body) == F.right(c, F.lit(1)).try_cast("int")), F.lit(False))


def substitutions(code: Column) -> Column:
    """All codes with one digit replaced."""
    places = F.sequence(F.lit(1), F.char_length(code))
    other = lambda i: F.transform(F.array(*map(F.lit, "0123456789")), lambda d: F.concat(F.substring(code, F.lit(1), i - 1), d, F.substring(code, i + 1, F.char_length(code))))
    return F.array_remove(F.array_distinct(F.flatten(F.transform(places, other))), code)


def corrections(code: Column) -> Column:
    """Of ``substitutions`` those with the right check digit, for codes of eight or thirteen places: one digit in each place makes the sum right.

    A place that holds no digit is the only one that may be replaced; two of them leave no way.
    """
    size = F.char_length(code)
    digits = F.transform(F.split(code, ""), lambda c: c.try_cast("int"))
    strange = F.size(F.filter(digits, lambda d: d.isNull()))
    weight = lambda i: F.when((size - 1 - i) % 2 == 0, 1).otherwise(3)
    total = F.aggregate(F.transform(digits, lambda d, i: F.coalesce(d, F.lit(0)) * weight(i)), F.lit(0), lambda a, x: a + x)
    # 7 is the inverse of 3 in tenths.
    new = lambda d, i: F.pmod(F.coalesce(d, F.lit(0)) - total * F.when(weight(i) == 1, 1).otherwise(7), F.lit(10))
    places = F.transform(digits, lambda d, i: F.when((strange == 0) & (new(d, i) != d) | (strange == 1) & d.isNull(), F.concat(F.substring(code, F.lit(1), i), new(d, i).cast("string"), F.substring(code, i + 2, size))))
    return F.when(size.isin(8, 13), F.array_compact(places)).otherwise(F.array().cast("array<string>"))


def ean_like(code: Column) -> Column:
    """NUM-15: a valid code, or fourteen digits that start with one."""
    return is_valid_ean(code) | (code.rlike("^[0-9]{14}$") & is_valid_ean(F.substring(code, 1, 13)))


def product_ean(code: Column) -> Column:
    """NUM-15: not of the range for internal use."""
    return ean_like(code) & ~((F.char_length(code) >= 13) & code.startswith("02"))


def digit_difference(a: Column, b: Column) -> Column:
    """NUM-16: places where codes of one length differ; null for different lengths."""
    differs = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, 1).otherwise(0)), F.lit(0), lambda t, x: t + x)
    return F.when(F.char_length(a) == F.char_length(b), differs)


def parse_user_number(text: str | Column) -> Column:
    """NUM-17."""
    return F.translate(F.regexp_replace(col(text), rf"[\s{NBSP}]", ""), ",", ".").try_cast("double")


def parse_scale(text: str | Column) -> Column:
    """NUM-18: a factor from ``*10``, ``x10``, ``/10``, ``÷10`` or ``:10``."""
    t = F.trim(col(text))
    number = parse_user_number(F.regexp_extract(t, r"^[*xXхХ×/÷:]\s*([0-9\s.,]+)$", 1))
    return F.when(number > 0, F.when(t.rlike("^[*xXхХ×]"), number).otherwise(F.lit(1.0) / number))


def money_text(x: Column) -> Column:
    """NUM-19: ``1 234,50``."""
    return F.translate(F.format_number(round2(x), 2), ",.", f"{NBSP},")


def upper_median(values: Column) -> Column:
    """NUM-20: the upper of two middle values; zero for none."""
    kept = F.array_compact(values)
    return F.when(F.size(kept) > 0, F.element_at(F.array_sort(kept), (F.floor(F.size(kept) / 2) + 1).cast("int"))).otherwise(F.lit(0.0))


def whole_number(text: str | Column) -> Column:
    """NUM-21: thousands by space or comma, no cents."""
    t = F.trim(col(text))
    return F.when(t.rlike(rf"^[0-9]{{1,3}}([ ,{NBSP}][0-9]{{3}})*$|^[0-9]+$"), F.regexp_replace(t, rf"[ ,{NBSP}]", "").try_cast("double"))


def money_count(text: str | Column) -> Column:
    """NUM-22."""
    return F.regexp_count(col(text), F.lit(rf"(?<![0-9,.])[0-9]{{1,3}}(?:[ {NBSP}]?[0-9]{{3}})*[.,][0-9]{{2}}(?![0-9])"))


def read_values(text: str | Column, role: str) -> Column:
    """NUM-24: the readings of a cell in a column of this role (qtyPlan, qty, price, sum or vat)."""
    return _reading(text, _quantities if role in ("qty", "qtyPlan") else _amounts)


def read_any(text: str | Column) -> Column:
    """The different readings of a cell, whether it holds a quantity or money."""
    return _reading(text, lambda *x: F.array_distinct(F.concat(_quantities(*x), _amounts(*x))))


def _reading(text: str | Column, read: Callable[[Column, Column, Column], Column]) -> Column:
    """``read`` of the text, its numbers from the longest on, and the first of them, each bound once: written out, the patterns would run for each mention."""
    found = lambda t: F.filter(extract_numbers(t), lambda n: n["value"].isNotNull())
    longest = lambda found: F.array_sort(F.transform(found, lambda n, i: F.struct((-F.char_length(n["text"])).alias("k"), i.alias("i"), n.alias("n"))))
    return let(F.trim(col(text)), lambda t: let(longest(found(t)), lambda at: let(F.get(at, F.lit(0))["n"], lambda best: read(t, at, best))))


def _bare(text: Column) -> Column:
    return F.translate(text, " ", "").try_cast("double")


def _grouped(t: Column) -> Column:
    return F.when(t.rlike(r"^[0-9]{1,3}( [0-9]{3})+$"), F.array(_bare(t)))


def _quantities(t: Column, longest: Column, best: Column) -> Column:
    none = F.array().cast("array<double>")
    others = F.when(F.size(longest) <= 3, F.transform(F.array_sort(F.transform(F.slice(longest, 2, 9), lambda x: F.struct(x["i"].alias("i"), x["n"].alias("n")))), lambda x: x["n"]["value"])).otherwise(none)
    thousandth = F.when(~best["has_decimals"] & best["text"].rlike("000$") & (F.char_length(best["text"]) >= 4), F.array(best["value"] / 1000)).otherwise(none)
    read = F.concat(F.array(best["value"]), others, thousandth)
    return let(_grouped(t), lambda grouped: F.when(t.isNull() | (F.size(longest) == 0) & grouped.isNull(), none).otherwise(F.coalesce(grouped, read)))


def _amounts(t: Column, longest: Column, best: Column) -> Column:
    none = F.array().cast("array<double>")
    trimmed = F.regexp_replace(t, "[.,]+$", "")
    spaced = r"^([0-9]{1,3}(?: [0-9]{3})*|[0-9]{4,6}) ([0-9]{2})$"
    lost_comma = let(trimmed, lambda t: F.when(t.rlike(spaced), F.array(_bare(F.regexp_replace(t, spaced, "$1.$2")))))
    stuck = r"^([0-9]{1,3}(?: [0-9]{3})+)[.,]([0-9]{2})[0-9]$"
    third = F.when(t.rlike(stuck), F.array(_bare(F.regexp_replace(t, stuck, "$1.$2"))))
    cut = F.when(best["text"].rlike("[.,][0-9]{3}$"), F.array(F.floor(best["value"] * 100 + 1e-6) / 100)).otherwise(none)
    read = F.concat(amount_variants(best["value"], best["text"], best["has_decimals"]), cut)
    # A text without a blank has no thousands apart and no comma lost between words.
    known = F.when(F.contains(t, F.lit(" ")), F.coalesce(_grouped(t), lost_comma, third))
    return let(known, lambda known: F.when(t.isNull() | (F.size(longest) == 0) & known.isNull(), none).otherwise(F.coalesce(known, read)))


#: Signs of ruled lines and quotes around a number, and letters that stand for one digit before a unit.
CELL_JUNK = r"[|«»\"'`’“”_\[\]{}()*~=]"
UNIT_TAIL = r"(?i)^(.*[0-9].*?)[\s]*(бутылка|бут|блок|шт|кор|уп|кг|гр|л|м)\.?$"
LONE_LETTERS, LONE_DIGITS = "$SsЗзбOОlI|", "55533600111"


#: Figures in which nothing is to be put right, and ten of them without a blank.
PLAIN_FIGURES, LONG_FIGURES = r"^[0-9]+(?:[ .,][0-9]+)*\z", "(?:[0-9][.,]?){10}"


def number_cell(raw: str | Column) -> Column:
    """NUM-23: (num, unit) of a cell with a number and perhaps a unit behind it; null if it is none, or a code of ten digits."""

    def read(raw: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(F.translate(raw, NBSP, " "), CELL_JUNK, " "), r"(^|\s)-+|-+(?=\s|$)", " ")
        t = F.trim(F.regexp_replace(F.regexp_replace(t, r"^[‚\s]+|[‚\s]+$", ""), r"\s+", " "))
        # Each step is bound once: written out, the last would repeat the patterns of the first some hundred times.
        lone = lambda t: F.regexp_extract(t, r"(?i)^([$SsЗзбOОlI|])\s+(бутылка|бут|блок|шт|кор|уп|кг|гр|л|м)\.?$", 2)
        any_number = let(t, lambda t: let(lone(t), lambda lone: F.when(t.rlike("[0-9]") | (lone != ""), _number_and_unit(t, lone))))
        plain = F.when(~raw.rlike(LONG_FIGURES), F.struct(raw.alias("num"), F.lit(None).cast("string").alias("unit")))
        return F.when(raw.rlike(PLAIN_FIGURES), plain).otherwise(any_number)

    return let(col(raw), read)


def _number_and_unit(t: Column, lone: Column) -> Column:
    tail = t.rlike(UNIT_TAIL)
    code = lambda num: F.exists(F.split(num, r"\s+"), lambda x: F.char_length(F.regexp_replace(x, "[^0-9]", "")) >= 10)
    by_lone = F.when(lone != "", F.struct(F.translate(F.substring(t, 1, 1), LONE_LETTERS, LONE_DIGITS).alias("bare"), lone.alias("unit"))).otherwise(F.struct(t.alias("bare"), F.lit(None).cast("string").alias("unit")))
    parts = F.when(tail, F.struct(F.trim(F.regexp_extract(t, UNIT_TAIL, 1)).alias("bare"), F.regexp_extract(t, UNIT_TAIL, 2).alias("unit"))).otherwise(by_lone)
    good = lambda num: num.rlike(r"^[0-9\s.,]+$") & num.rlike("[0-9]") & ~code(num)
    return let(parts, lambda p: let(fix_digits(p["bare"]), lambda num: F.when(good(num), F.struct(num.alias("num"), p["unit"].alias("unit")))))


def format_quantity(qty: str | Column) -> Column:
    """NUM-19: a quantity with spaces between thousands, a comma and three decimals at most."""
    q = col(qty)
    whole = F.translate(F.format_number(F.floor(F.abs(round3(q))), 0), ",", NBSP)
    part = F.rtrim(F.lpad(F.round((F.abs(round3(q)) - F.floor(F.abs(round3(q)))) * 1000).cast("int").cast("string"), 3, "0"), F.lit("0"))
    return F.concat(F.when(round3(q) < 0, "-").otherwise(""), whole, F.when(part != "", F.concat(F.lit(","), part)).otherwise(""))
