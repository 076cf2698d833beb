"""Benchmark decontamination by multi-pattern search over words (Wu and Manber's method).

Windows of ``size`` consecutive benchmark words are the test strings; an item with fewer words is one shorter window. The search
looks at the block of two words that ends at a position: the shift table tells how far the window's end may move on without passing a
match, so most positions are never looked at. Where the shift is zero, the bucket of that block (and in it the window's first
block) selects test strings, which are compared word by word. Windows of one length have tables of their own.

Documents are never shuffled: the windows go to them. The tables hold ``most`` windows at a time; a larger benchmark is searched
for in as many passes as that takes, and only documents with a match are brought together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, fields, mapped, removed, row_key, written

SIZE = 10
#: Windows of benchmark items that one pass searches for, which bounds what is broadcast; some 400 bytes each in a worker.
MOST = 500_000
#: Bytes of a text that are split into words at a time.
CHUNK = 4_000_000
#: Words are runs of ASCII digits and letters and of all characters beyond ASCII.
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def chunks(text: bytes) -> Iterator[list[bytes]]:
    """The lower-case words of a text, in lists of bounded size; a word is never cut."""
    at = 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        while end < len(text) and FOLD[text[end]] != 32:
            end += 1
        yield text[at:end].translate(FOLD).split()
        at = end


class Patterns:
    """Shift tables and buckets for windows of one length; a window's value is whatever is stored for it."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], list]):
        self.length, self.block = length, min(2, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], list]]]] = {}
        b, shift = self.block, self.shift
        for window, value in windows.items():
            for end in range(b, length + 1):
                block = window[end - b : end]
                shift[block] = min(shift.get(block, self.most), length - end)
            self.buckets.setdefault(window[-b:], {}).setdefault(window[:b], []).append((window, value))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """(end, value) of each occurrence, by end."""
        at, n, b, size, most = self.length, len(words), self.block, self.length, self.most
        shifts, buckets = self.shift.get, self.buckets
        while at <= n:
            block = tuple(words[at - b : at])
            step = shifts(block, most)
            if step:
                at += step
                continue
            for window, value in buckets[block].get(tuple(words[at - size : at - size + b]), ()):
                if window == tuple(words[at - size : at]):
                    yield at, value
            at += 1


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, in disjoint ones by their start."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


def search(text: bytes, tables: list[Patterns]) -> tuple[int, list[tuple[int, int]], set]:
    """The number of words, disjoint covered spans of words in their order, and the values found."""
    found: set = set()
    spans: list[list[tuple[int, int]]] = [[] for _ in tables]
    longest, before, start = max((t.length for t in tables), default=1), [], 0
    for words in chunks(text):
        words = before + words
        for table, own in zip(tables, spans, strict=True):
            # a window that ends in the words carried over has been seen
            for end, values in table.find(words):
                if end > len(before) or not start:
                    a, z = start + end - table.length, start + end
                    if own and a <= own[-1][1]:
                        own[-1] = own[-1][0], z
                    else:
                        own.append((a, z))
                    found.update(values)
        keep = min(longest - 1, len(words))
        start += len(words) - keep
        before = words[len(words) - keep :]
    return start + len(before), joined(x for own in spans for x in own), found


def windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """item_id as string (null: empty) and ``window``, the words of each window, once each."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(1))
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words.alias("words")).where(F.size("words") > 0)
    of = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1))), lambda i: F.slice("words", i, F.lit(size)))
    return rows.select("item_id", F.explode(of).alias("window")).distinct()


@lru_cache(maxsize=1)
def compiled(token: object) -> list[Patterns]:
    """The tables of a broadcast block, built once in each worker."""
    block: pa.Table = token.value
    by_length: dict[int, dict[tuple[bytes, ...], list]] = {}
    same: dict[bytes, bytes] = {}
    for item, window in zip(block["item_id"].to_pylist(), block["window"].to_pylist(), strict=True):
        w = tuple(same.setdefault(x, x) for x in (y.encode() for y in window))
        by_length.setdefault(len(w), {}).setdefault(w, []).append(item)
    return [Patterns(n, found) for n, found in sorted(by_length.items())]


def scanned(docs: DataFrame, block: pa.Table, only_hits: bool = False) -> DataFrame:
    """The columns of ``docs`` but its text, n_words, and the spans and items that the search for one block of windows finds."""
    token = docs.sparkSession.sparkContext.broadcast(block)
    names = [c for c in docs.columns if c != "text"]
    longs, strings = pa.list_(pa.int64()), pa.list_(pa.string())

    def of(part: pa.RecordBatch) -> pa.RecordBatch:
        tables = compiled(token)
        found = [search(t or b"", tables) for t in part["text"].cast(pa.binary()).to_pylist()]
        at = [i for i, (_, spans, _) in enumerate(found) if spans or not only_hits]
        rows, found = part.take(pa.array(at, pa.int64())), [found[i] for i in at]
        counts = pa.array([n for n, _, _ in found], pa.int64())
        starts, ends = (pa.array([[s[k] for s in spans] for _, spans, _ in found], longs) for k in (0, 1))
        items = pa.array([sorted(x) for _, _, x in found], strings)
        return pa.RecordBatch.from_arrays([*(rows[c] for c in names), counts, starts, ends, items], [*names, "n_words", "starts", "ends", "items"])

    return mapped(docs, f"{fields(docs, *names)}, n_words long, starts array<long>, ends array<long>, items array<string>", of)


def matches(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_hit, ``items`` (sorted as strings) and ``starts``, ``ends`` (covered spans of words), a row for each document.

    Null and empty texts have no word and no hit; null texts of items hold no window, and a null item_id is named by the empty
    string. Rows of the benchmark alike in item_id are one item; an empty benchmark hits nothing. Texts of any length are searched
    in pieces. Repeated rows and null doc_ids come back as they are. Other columns are neither read nor returned. An empty table
    gives an empty result.
    """
    wanted = written(windows(benchmark, size), "windows")
    passes = max(1, ceil(wanted.count() / most))
    # about ``most`` windows, by hash: this bounds what the driver and each worker hold
    block = lambda k: wanted.where(F.pmod(F.xxhash64("item_id", "window"), F.lit(passes)) == k).toArrow()
    rows = docs.select("doc_id", "text") if passes == 1 else docs.select("doc_id", "text", *row_key())
    found = scanned(rows, block(0))
    if passes > 1:
        found = written(found, "first-pass")
        hits = [found.where(F.size("starts") > 0).drop("doc_id", "n_words")]
        hits += [written(scanned(docs.select("text", *row_key()), block(k), True).drop("n_words"), "pass") for k in range(1, passes)]
        found = found.select("doc_id", "n_words", *KEY).join(gathered(hits), KEY, "left").select("doc_id", "n_words", "starts", "ends", "items")
        empty = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c)
        found = found.select("doc_id", "n_words", *map(empty, ("starts", "ends", "items")))
    covered = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda n, x: n + x)
    return found.select("doc_id", "n_words", covered.alias("n_hit"), "items", "starts", "ends")


def gathered(hits: list[DataFrame]) -> DataFrame:
    """The hits of several passes with one row for each document's key; a pass has at most one after the first grouping."""
    own = [h.groupBy(*KEY).agg(*[F.any_value(c).alias(c) for c in ("starts", "ends", "items")]) for h in hits]
    every = own[0]
    for h in own[1:]:
        every = every.unionByName(h)
    lists = every.groupBy(*KEY).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [joined(zip(a, b, strict=True)) for a, b in zip(batch["starts"].to_pylist(), batch["ends"].to_pylist(), strict=True)]
            sides = [pa.array([[s[k] for s in x] for x in spans], pa.list_(pa.int64())) for k in (0, 1)]
            items = pa.array([sorted(set(x)) for x in batch["items"].to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in KEY), *sides, items], [*KEY, "starts", "ends", "items"])

    return lists.mapInArrow(of, lists.schema)


def report(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``matches`` as counts, the SHA-256 of the items' ids joined by commas, and the verdict."""
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return matches(docs, benchmark, size).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


ORACLE = r"""
WITH b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS k, list_slice(w, i, i + least(len(w), 10) - 1) AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT rid, k, i, list_slice(w, i, i + k - 1) AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
h AS (SELECT rid, i, p.k AS k, item FROM p JOIN win ON p.k = win.k AND p.g = win.g),
c AS (SELECT rid, count(DISTINCT x) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS x FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
