"""Line-first quality rules.

Each line is judged by itself: punctuation (symbols or exclamation marks stuck to most of its words), navigation (words between
bars or arrows) and boilerplate (a consent or copyright notice, or few words said again and again). Failing lines are removed;
a document that loses too large a share of its words that way is rejected. The base statistics of the whole text are beside
that verdict and can reject a document alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BLANKS, fields, mapped

SYMBOLS = "#*$%&|<>"
#: Punctuation that a mangled line sticks to its words.
STUCK = re.compile(r"[#*$%&<>]+$|!!+$")
BARS = {"|", ">", "<", "»", "«", "/", "·", "•", "→"}
NOTICE = re.compile(r"\b(cookie|cookies|all rights reserved|subscribe to our|sign up for our|terms of (use|service)|privacy policy|javascript (is )?(disabled|required))\b", re.I)


@dataclass(frozen=True)
class Rules:
    """Limits of the rules: shares of a line's words, and of a document's words."""

    stuck_share: float = 0.3
    bar_share: float = 0.15
    notice_words: int = 30
    repeat_from: int = 8
    repeat_share: float = 0.34
    lost_share: float = 0.3
    min_words: int = 10
    max_repeat_percent: int = 20


def line_fault(words: list[str], line: str, r: Rules) -> str | None:
    """The first rule that a line with words fails."""
    n = len(words)
    if sum(1 for w in words if STUCK.search(w)) > r.stuck_share * n:
        return "punctuation"
    if sum(1 for w in words if w in BARS) > r.bar_share * n:
        return "navigation"
    if n <= r.notice_words and NOTICE.search(line):
        return "boilerplate"
    if n >= r.repeat_from and len(set(words)) <= r.repeat_share * n and _adjacent(words) * 2 > n:
        return "boilerplate"
    return None


def _adjacent(words: list[str]) -> int:
    return sum(1 for a, b in zip(words, words[1:], strict=False) if a == b)


def split_words(text: str) -> list[str]:
    """Words between the six blanks; str.split() would also cut at other Unicode spaces."""
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def repeated_words(words: list[str]) -> int:
    """Words in five-word windows found twice or more, the first included."""
    seen, twice = set(), set()
    for window in zip(words, words[1:], words[2:], words[3:], words[4:], strict=False):
        (twice if window in seen else seen).add(window)
    if not twice:
        return 0
    count = end = 0
    for i, window in enumerate(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False)):
        if window in twice:
            count += i + 5 - max(i, end)
            end = i + 5
    return count


def measure(text: str | None, r: Rules = Rules()) -> tuple:
    """Base statistics, words and lines lost to each rule, verdicts, and the text without its failed lines."""
    text = text or ""
    words = split_words(text)
    n, seen, dup, lost = len(words), set(), 0, {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    left, gone = [], 0
    for line in text.split("\n"):
        own = split_words(line)
        if own:
            dup += line in seen
            seen.add(line)
        fault = line_fault(own, line, r) if own else None
        if fault:
            lost[fault] += len(own)
            gone += 1
        else:
            left.append(line)
    repeats = repeated_words(words)
    failed = n < r.min_words or 100 * repeats > r.max_repeat_percent * n
    kept = not failed and sum(lost.values()) <= r.lost_share * n
    chars, symbols = len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS))
    return n, chars, symbols, dup, repeats, failed, kept, gone, *lost.values(), "\n".join(left)


SCHEMA = """n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean,
n_lines_removed long, words_lost_punctuation long, words_lost_navigation long, words_lost_boilerplate long, cleaned string"""
NAMES = [x.split()[0] for x in SCHEMA.split(",")]


def quality(docs: DataFrame, rules: Rules = Rules(), with_text: bool = True) -> DataFrame:
    """doc_id, the base statistics, ``base_failed``, ``kept``, what the line rules removed, and the cleaned text.

    Null texts have no word and fail; so do empty ones and all with fewer than ``min_words`` words. Each row is judged by itself,
    in one pass whose memory is that of its longest text, so repeated rows, ties and null doc_ids come back as they are. Other
    columns are neither read nor returned. An empty table gives an empty result. Without ``with_text`` no text is returned.
    """
    names = NAMES if with_text else NAMES[:-1]
    schema = f"{fields(docs, 'doc_id')}, {SCHEMA if with_text else SCHEMA.rpartition(',')[0]}"

    def of(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [measure(t, rules) for t in part["text"].to_pylist()]
        kinds = [pa.bool_() if n in ("base_failed", "kept") else pa.string() if n == "cleaned" else pa.int64() for n in names]
        return pa.RecordBatch.from_arrays([part["doc_id"], *[pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]], ["doc_id", *names])

    return mapped(docs.select("doc_id", "text"), schema, of)


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``: failed lines are gone from ``text``, ``n_chars`` follows.

    Null, empty and short texts go (they fail the base rules), as do texts that lose too much; other columns, repeated rows and
    null doc_ids pass as they are. An empty table gives an empty result.
    """
    kept, cleaned = NAMES.index("kept"), NAMES.index("cleaned")
    at = docs.schema.names

    def of(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [(row, m[cleaned]) for row, t in enumerate(part["text"].to_pylist()) if (m := measure(t, rules))[kept]]
        new = part.take(pa.array([row for row, _ in found], pa.int64()))
        values = {"text": [t for _, t in found], "n_chars": [len(t) for _, t in found]}
        arrays = [pa.array(values[c], new.schema.field(k).type) if c in values else new.column(k) for k, c in enumerate(at)]
        return pa.RecordBatch.from_arrays(arrays, at)

    return mapped(docs, docs.schema, of)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT rid, string_split(t, chr(10)) AS ls FROM d),
l AS (SELECT rid, i, ls[i] AS line, list_filter(string_split_regex(ls[i], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS i FROM s)),
j AS (SELECT rid, i, line, w, len(w) AS n, len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&<>]+$|!!+$'))) AS stuck,
      len(list_filter(w, lambda x: x IN ('|', '>', '<', '»', '«', '/', '·', '•', '→'))) AS bars,
      regexp_matches(line, '(?i)\b(cookie|cookies|all rights reserved|subscribe to our|sign up for our|terms of (use|service)|privacy policy|javascript (is )?(disabled|required))\b') AS notice,
      len(list_distinct(w)) AS own, len([1 FOR k IN range(1, len(w)) IF w[k] = w[k + 1]]) AS adjacent FROM l WHERE len(w) > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY rid, line ORDER BY i) > 1 AS again, CASE WHEN stuck > CAST(0.3 AS DOUBLE) * n THEN 'p' WHEN bars > CAST(0.15 AS DOUBLE) * n THEN 'n'
      WHEN n <= 30 AND notice OR n >= 8 AND own <= CAST(0.34 AS DOUBLE) * n AND adjacent * 2 > n THEN 'b' END AS fault FROM j),
a AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n_words, count(*) FILTER (WHERE again) AS dups, count(fault) AS removed, CAST(coalesce(sum(n) FILTER (WHERE fault = 'p'), 0) AS BIGINT) AS p,
      CAST(coalesce(sum(n) FILTER (WHERE fault = 'n'), 0) AS BIGINT) AS v, CAST(coalesce(sum(n) FILTER (WHERE fault = 'b'), 0) AS BIGINT) AS b, flatten(list(w ORDER BY i)) AS ws FROM f GROUP BY rid),
g AS (SELECT rid, k, ws[k:k + 4] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS k FROM a)),
r AS (SELECT rid, k FROM (SELECT rid, k, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT x) AS repeats FROM (SELECT rid, unnest(range(k, k + 5)) AS x FROM r) GROUP BY rid),
x AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines,
      coalesce(repeats, 0) AS n_repeat_words, coalesce(removed, 0) AS n_lines_removed, coalesce(p, 0) AS words_lost_punctuation, coalesce(v, 0) AS words_lost_navigation, coalesce(b, 0) AS words_lost_boilerplate
      FROM d LEFT JOIN a USING (rid) LEFT JOIN c USING (rid)),
y AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x)
SELECT *, NOT base_failed AND words_lost_punctuation + words_lost_navigation + words_lost_boilerplate <= CAST(0.3 AS DOUBLE) * n_words AS kept FROM y
"""
