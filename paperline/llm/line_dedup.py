"""Repeated passages by overlapping three-line windows.

A line ends at a newline or with its sentence (a stop, exclamation or question mark before a blank), so that a passage falls into
the same lines however it is laid out; blanks inside a line count as one space, those around it not at all. Every three
consecutive lines of a text are a window, known by two 64-bit hashes. The first occurrence of a window is the least by (doc_id,
row key, line). All later ones cover their lines; covered positions are merged into runs and cut out. Each removed line has an
equal one at an earlier place, so of every repeated line one stays. A passage is found if it holds three whole lines.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CLASS, BLANKS, KEY, row_key, spread_join, written

WINDOW = 3
#: Places where a line ends: behind the mark of a sentence, or before blanks with a newline; never before the blanks at a text's end.
#: The next sign being a blank is asked first, so most places are passed over at once.
BREAK = rf"(?={BLANK_CLASS})(?:(?<=[.!?])|(?<=[^\x20\x09-\x0D])(?={BLANK_CLASS}*\n))(?={BLANK_CLASS}*[^\x20\x09-\x0D])"
#: The blanks where a line ends: those behind the mark of a sentence or with a newline. The first sign of all is asked to be a blank.
GAP = rf"{BLANK_CLASS}(?:(?<=[.!?\n]{BLANK_CLASS})|(?<=\n)|(?<!{BLANK_CLASS}{BLANK_CLASS})(?={BLANK_CLASS}*\n)){BLANK_CLASS}*+"


def lines(text: str = "text") -> Column:
    """The lines of a text with the blanks before each; joined they are the text. All but those of a blank text have a word."""
    return F.split(F.coalesce(F.col(text), F.lit("")), BREAK, -1)


def hashes(docs: DataFrame) -> DataFrame:
    """doc_id, row key, ``n`` lines and ``h``, two 64-bit hashes of each line without blanks around it and with one space for those inside."""
    # Trimmed in a step of its own, as the text is used often below. Most texts hold single spaces and newlines only; plain
    # searches tell the others.
    at = docs.select("doc_id", *row_key(), F.btrim(F.coalesce("text", F.lit("")), F.lit(BLANKS)).alias("text"))
    t = F.col("text")
    odd = functools.reduce(operator.or_, [t.contains(x) for x in (*BLANKS.replace(" ", "").replace("\n", ""), "  ")])
    folded = F.when(odd, F.regexp_replace(t, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(t)
    hashed = F.transform(F.split(folded, GAP, -1), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    return at.select("doc_id", *KEY, hashed.alias("h")).withColumn("n", F.size("h"))


def windows(hashed: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, row key, ``line`` (from 0) and the hashes ``w1``, ``w2`` of each window of ``size`` lines."""
    at = hashed.where(F.col("n") >= size).select("doc_id", *KEY, "h", F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("line"))
    of = lambda side: [F.get("h", F.col("line") + i)[side] for i in range(size)]
    return at.select("doc_id", *KEY, "line", F.xxhash64(*of("a")).alias("w1"), F.xxhash64(*of("b")).alias("w2"))


def runs(hashed: DataFrame, size: int = WINDOW) -> DataFrame:
    """Row key, ``n`` lines and ``runs``: the spans (``a`` to ``b``, lines from 0) to cut out of each text, in order and apart."""
    found = windows(hashed, size)
    # One hash tells which windows may repeat; only those go on with both, so a window that stands once is shuffled narrow.
    often = written(found.groupBy("w1").agg(F.count("*").alias("often")).where("often > 1"), "often")
    found = written(spread_join(found, often, ["w1"], "often").drop("often"), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", *KEY, "line")
    repeated = written(found.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1"), "repeated")
    later = spread_join(found, repeated, ["w1", "w2"], "times").where(place != F.col("first"))
    # A text's own windows meet once, in order; a run ends where the next window begins beyond the lines covered so far.
    each = hashed.select(*KEY, "n", F.lit(None).cast("int").alias("line")).union(later.select(*KEY, F.lit(0), "line"))
    at = each.groupBy(*KEY).agg(F.max("n").alias("n"), F.array_sort(F.collect_set("line")).alias("at"))
    begins = F.filter("at", lambda x, i: (i == 0) | (x - F.get("at", i - 1) > size))
    ends = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) - x > size))
    return at.select(*KEY, "n", F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("a"), (b + size - 1).alias("b"))).alias("runs"))


def dedup(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, ``n_lines``, ``n_removed`` and the ``cleaned`` text, a row for each row of ``docs``.

    Texts of fewer than ``size`` lines have no window and stay as they are; null, empty and blank texts count as one line. A very
    long text is as many windows as it has lines, which are dealt out. Rows alike in doc_id and text count as one row, and each
    gets its result; a null doc_id comes last. Other columns are neither read nor returned. An empty table gives an empty result.
    """
    at = docs.select("doc_id", *row_key(), "text").join(runs(written(hashes(docs), "hashes"), size), KEY)
    # Ends of lines are sought where something is cut out.
    cut = F.size("runs") > 0
    at = at.withColumn("lines", F.when(cut, lines()))  # used twice below, so it is not put inside the lambda
    starts = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["b"] + 1))
    ends = F.concat(F.transform("runs", lambda r: r["a"]), F.array(F.size("lines")))
    spans = F.arrays_zip(starts.alias("s"), ends.alias("e"))
    kept = F.flatten(F.transform(spans, lambda x: F.slice("lines", x["s"] + 1, x["e"] - x["s"])))
    gone = F.aggregate("runs", F.lit(0), lambda t, r: t + r["b"] - r["a"] + 1)
    cleaned = F.when(cut, F.array_join(kept, "")).otherwise(F.coalesce("text", F.lit("")))
    return at.select("doc_id", F.col("n").cast("long").alias("n_lines"), gone.cast("long").alias("n_removed"), cleaned.alias("cleaned"))


# The mark of a cut is a private character, which the test tables don't hold; the engine itself uses none.
ORACLE = r"""
WITH m AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '([.!?])([\x20\x09-\x0D])', '\1' || chr(57344) || '\2', 'g') AS t FROM documents),
n AS (SELECT doc_id, regexp_replace(t, '([^\x20\x09-\x0D' || chr(57344) || '])([\x20\x09-\x0D]*\n)', '\1' || chr(57344) || '\2', 'g') AS t FROM m),
d AS (SELECT doc_id, string_split(regexp_replace(t, chr(57344) || '([\x20\x09-\x0D]*)$', '\1'), chr(57344)) AS ls FROM n),
p AS (SELECT doc_id, [trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') FOR x IN ls] AS fs FROM d),
w AS (SELECT doc_id, i, fs[i:i + 2] AS w FROM (SELECT doc_id, fs, unnest(range(1, len(fs) - 1)) AS i FROM p)),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM w),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS line FROM o WHERE k > 1),
g AS (SELECT doc_id, list(line) AS gone FROM c GROUP BY doc_id),
f AS (SELECT doc_id, len(ls) AS n_lines, coalesce(gone, []) AS gone, ls FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, n_lines, len(gone) AS n_removed, sha256(array_to_string([ls[j] FOR j IN range(1, n_lines + 1) IF NOT list_contains(gone, j)], '')) AS cleaned_sha256 FROM f
"""
