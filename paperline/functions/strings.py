"""Names, sizes, units, dates and codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col, fix_digits, let

# Cyrillic and Kazakh letters in Latin, first those of one letter, then the rest.
SINGLE_FROM = "абвгдеёзийклмнопрстуфхцыэәғқңөұүһі"
SINGLE_TO = "abvgdeeziiklmnoprstufhcyeagknouuhi"
SEVERAL = {"ж": "zh", "ч": "ch", "ш": "sh", "щ": "sh", "ю": "yu", "я": "ya", "ъ": "", "ь": ""}
# Words that many products share; size and package words that tell nothing.
WEAK = "^(sigarety|kolbasa|napitok|voda|pivo|mayonez|ketchup|spred|margarin|konfety|shokolad|sok|chipsy|makarony)$"
SIZE_WORDS = "^[0-9]+(gr|g|ml|l|kg|kr|sht|sm|mm|rp|r|t|sht)$"
PACK_WORDS = "^(sht|kg|gr|ml|l|g|sm|im|kaz|tz|t|dp|vak|pet|ban|but|zhb|sb|up|pach|vr|dz)$"
SUPPLIER_WORDS = "^(too|ooo|ip|tk|filial|kompaniya|torgovaya|kazahstan|sigarety)$"
SIZED = r"([0-9]+(?:\.[0-9]+)?)[\s ]*(мл|ml|литр|л|l|гр|г|gr|rp|r|g|кг|kg|kr)(?![a-zа-я])"
BARE_SIZE = r"(?<![0-9.])([0-9]\.[0-9]{1,3})(?![0-9.%])"
MONTHS = ["январ", "феврал", "март", "апрел", "ма[яй]", "июн", "июл", "август", "сентябр", "октябр", "ноябр", "декабр"]
LATIN_ALIKE, CYRILLIC_ALIKE = "ABCEHKMOPTXY", "АВСЕНКМОРТХУ"
# Patterns of units as readers garble them, in the order in which they are tried.
UNITS = [
    ("^(wr|xr|w)$", None), ("^(к|кг|kr|kg|к[гr])$", "кг"), ("[тt]ук|^[wшч]r?[yу]к", "шт"), ("па[чy]|na[чy]|пэч|пач|nauk|пак|печк|точк", "пачка"),
    ("^(ш|шт|ил|цл|um|ur|un|шл|wt|шr|шm|ит)", "шт"), ("^бло?к", "блок"), ("^л$|^n$", "л"), ("бут|byt", "бут"), ("^(кор|kop)", "кор"), ("уп", "уп"),
]
OTHER_UNITS = "^(г|гр|мл|м|рул|пар|компл|ящ|бан|банка|флак|пак)$"


def normalize_name(name: str | Column) -> Column:
    """STR-01: Latin letters, digits and single spaces; a point or comma between digits goes."""
    c = F.translate(F.lower(col(name)), SINGLE_FROM, SINGLE_TO)
    for letter, latin in SEVERAL.items():
        c = F.replace(c, F.lit(letter), F.lit(latin))
    c = F.regexp_replace(F.regexp_replace(c, "([0-9])[.,]([0-9])", "$1$2"), "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(c, r"\bsuperslims\b|\bss\b", "super slims"))


def trigrams(name: Column) -> Column:
    """STR-02: distinct triples of the name between two spaces."""
    padded = F.concat(F.lit(" "), name, F.lit(" "))
    n = F.char_length(padded) - 2
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def dice(x: Column, y: Column) -> Column:
    """STR-03: zero if either set is empty."""
    return F.when((F.size(x) > 0) & (F.size(y) > 0), 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))).otherwise(F.lit(0.0))


def plain_similarity(a: Column, b: Column) -> Column:
    """STR-04 of normalised names; equal ones are as alike as can be, unless they are empty."""
    return F.when((a == b) & (a != ""), 1.0).otherwise(dice(trigrams(a), trigrams(b)))


def name_similarity(a: Column, b: Column) -> Column:
    """STR-04."""
    return dice(trigrams(normalize_name(a)), trigrams(normalize_name(b)))


def sizes_of(name: str | Column) -> Column:
    """STR-05: litres or kilograms, distinct, to three decimals."""
    s = F.translate(F.lower(col(name)), ",", ".")
    numbers, units = F.regexp_extract_all(s, F.lit(SIZED), F.lit(1)), F.regexp_extract_all(s, F.lit(SIZED), F.lit(2))

    def value(number: Column, unit: Column) -> Column:
        v = F.when(number.rlike("^0[0-9]+$"), F.concat(F.lit("0."), F.substring(number, F.lit(2), F.char_length(number)))).otherwise(number).try_cast("double")
        return F.when(unit.rlike("^(мл|ml|гр|г|gr|rp|r|g)$"), v / 1000).otherwise(v)

    bare = F.filter(F.transform(F.regexp_extract_all(s, F.lit(BARE_SIZE), F.lit(1)), lambda x: x.try_cast("double")), lambda v: (v >= 0.1) & (v <= 5))
    return F.array_distinct(F.transform(F.concat(F.zip_with(numbers, units, value), bare), lambda v: F.floor(v * 1000 + 0.5) / 1000))


def words_of(name: Column) -> Column:
    """STR-06: distinct telling words of a normalised name."""
    return F.array_distinct(F.filter(F.split(name, " "), lambda w: (F.char_length(w) >= 2) & w.rlike("[a-z]") & ~w.rlike(SIZE_WORDS) & ~w.rlike(PACK_WORDS)))


def supplier_words(name: Column) -> Column:
    return F.filter(F.split(normalize_name(name), " "), lambda w: (F.char_length(w) >= 4) & ~w.rlike(SUPPLIER_WORDS))


def same_supplier(a: Column, b: Column) -> Column:
    """STR-07."""
    return F.coalesce(F.arrays_overlap(supplier_words(a), supplier_words(b)), F.lit(False))


def word_similarity(a: Column, b: Column) -> Column:
    """STR-08."""
    short = F.least(F.char_length(a), F.char_length(b))
    close = dice(trigrams(a), trigrams(b))
    return F.when(a == b, 1.0).when((short >= 4) & (a.startswith(b) | b.startswith(a)), 0.85).when(short < 3, 0.0).when(close >= 0.4, close).otherwise(0.0)


def word_weight(word: Column) -> Column:
    return F.when(word.rlike(WEAK), 0.5).otherwise(1.0)


def matched_weight(of: Column, to: Column) -> Column:
    """STR-09: (total, strong): each word's best match times its weight; strong if a full word matches by 0.6."""
    best = F.transform(of, lambda a: F.struct(F.coalesce(F.array_max(F.transform(to, lambda b: word_similarity(a, b))), F.lit(0.0)).alias("best"), word_weight(a).alias("weight")))
    total = F.aggregate(best, F.lit(0.0), lambda t, x: t + x["best"] * x["weight"])
    return F.struct(total.alias("total"), F.exists(best, lambda x: (x["best"] >= 0.6) & (x["weight"] == 1.0)).alias("strong"))


def total_weight(words: Column) -> Column:
    return F.aggregate(words, F.lit(0.0), lambda t, w: t + word_weight(w))


def block_key(word: Column) -> Column:
    """STR-10."""
    return F.substring(word, 1, 4)


def clean_code(text: Column) -> Column:
    """STR-11: the digits of a code token, or null."""
    bare = F.regexp_replace(text, "^[^0-9A-Za-zА-Яа-я,.]+|[^0-9A-Za-zА-Яа-я,.]+$", "")
    return let(bare, lambda t: let(fix_digits(t), lambda t: F.when(t.rlike("^[0-9]+$"), t)))


def code_fits(code: Column, kind: Column, length: Column) -> Column:
    """STR-12: length of the code against the layout's kind and wanted length."""
    return let(F.char_length(code), lambda n: F.when(kind == "ean", (n == 8) | n.between(12, 14)).when(length.isNotNull(), F.abs(n - length) <= 1).otherwise(n.between(5, 14)))


def to_cyrillic(text: Column) -> Column:
    """STR-14."""
    return F.translate(text, LATIN_ALIKE, CYRILLIC_ALIKE)


def normalize_unit(text: str | Column) -> Column:
    """STR-15: the unit meant, or null."""
    t = F.lower(col(text))
    letters = F.regexp_replace(t, "[^a-zа-яё]", "")
    c = F.when(t.rlike(r"[уy][пn][^0-9]{0,3}10[^0-9]{0,3}(?:шт|wt|ur|um)"), F.lit("блок"))
    c = c.when(F.trim(t).rlike(r"^[^a-z0-9_]*[6б][yу][tтr][^a-z0-9_]*$"), "бут").when(letters == "", F.lit(None))
    for pattern, unit in UNITS:
        c = c.when(letters.rlike(pattern), F.lit(unit))
    return c.when(letters.rlike(OTHER_UNITS), letters)


def unit_key(unit: str | Column) -> Column:
    """STR-16."""
    return F.regexp_replace(F.lower(F.trim(col(unit))), r"\.$", "")


NUMERIC_DATE = r"([0-9]{2})(?:[.,]|\s(?=[0-9]{2}\s))([0-9]{2})[.,\s](20[0-9]{2})(?![0-9])"
WORD_DATE = rf"(?iu)([0-9]{{1,2}})\s+({'|'.join(MONTHS)})[а-я]*\s+(20[0-9]{{2}})"


def find_date(text: str | Column) -> Column:
    """STR-19: ``dd.MM.yyyy`` from digits (2015 or later) or from a month's name."""
    t = col(text)
    part = lambda pattern, i: F.regexp_extract(t, pattern, i)
    digits = F.when(part(NUMERIC_DATE, 3).try_cast("int") >= 2015, F.concat_ws(".", *[part(NUMERIC_DATE, i) for i in (1, 2, 3)]))
    month = F.lower(part(WORD_DATE, 2))
    number = F.coalesce(*[F.when(month.rlike(f"^{m}"), F.lit(f"{i:02}")) for i, m in enumerate(MONTHS, 1)])
    worded = F.when(month != "", F.concat_ws(".", F.lpad(part(WORD_DATE, 1), 2, "0"), number, part(WORD_DATE, 3)))
    return F.coalesce(digits, worded)


def number_digits(text: Column) -> Column:
    """STR-23."""
    return F.regexp_replace(F.regexp_replace(text, "[^0-9]", ""), "^0+", "")


def export_file_name(*parts: Column, extension: str) -> Column:
    """STR-24: letters, digits and underscores of the parts that are there."""
    joined = F.concat_ws("_", *parts)
    return F.concat(F.regexp_replace(F.regexp_replace(joined, r"[^\p{L}\p{N}]+", "_"), "^_|_$", ""), F.lit(f".{extension}"))


def tsv_cell(text: Column) -> Column:
    """STR-25."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\t\n]", " ")


def base64url_json(value: Column) -> Column:
    """STR-28."""
    return F.regexp_replace(F.translate(F.base64(F.to_json(value).cast("binary")), "+/\r\n", "-_"), "=+$", "")


def page_text(lines: Column) -> Column:
    """STR-29."""
    return F.array_join(F.transform(lines, lambda x: x["text"]), "\n")


#: Legal forms left out of a supplier's sort key.
LEGAL_FORMS = "Филиал|ТОО|АО|ИП|ТК|Компания|[\"«»]"


def supplier_sort_key(name: str | Column) -> Column:
    """STR-27."""
    return F.trim(F.regexp_replace(col(name), LEGAL_FORMS, ""))


def plural(n: str | Column, one: str, few: str, many: str) -> Column:
    """STR-26: the Russian form that goes with a number."""
    tens, last = F.pmod(col(n), F.lit(100)), F.pmod(col(n), F.lit(10))
    teen = tens.between(11, 14)
    return F.when((last == 1) & ~teen, one).when(last.between(2, 4) & ~teen, few).otherwise(many)


def strip_trailing_quantity(name: str | Column, qty: str | Column, no_codes: bool = False) -> Column:
    """STR-18: a name without the row's quantity (three decimals, or whole if there is no code column) or unit at its end."""
    n, q = col(name), col(qty)
    if no_codes:
        n = F.regexp_replace(n, r"(?iu)\s+(?:блок|бут|шт|уп|кор)(?![А-Яа-яA-Za-z])[^А-Яа-яA-Za-z]*$", "")
        n = F.trim(F.regexp_replace(n, r"\s+[ШЦЩ|!]$", ""))
        last = F.regexp_extract(n, r"\s([0-9]{1,3})$", 1)
        n = F.when(F.coalesce(last.try_cast("double") == q, F.lit(False)), F.regexp_replace(n, r"\s+[0-9]{1,3}$", "")).otherwise(n)
        n = F.when(q.isNotNull(), F.regexp_replace(n, r"^[A-Za-z]\s+(?=[А-ЯЁ])", "")).otherwise(n)
    tail = r"\s+([0-9]{1,4}[.,][0-9]{3})(?:\s+[^\s0-9]{1,4})?$"
    same = F.translate(F.regexp_extract(n, tail, 1), ",", ".").try_cast("double") == q
    return F.when(F.coalesce(same, F.lit(False)), F.trim(F.regexp_replace(n, tail, ""))).otherwise(n)
