"""Source divergence audit: how far the words of each source of a language are from those of its other sources.

Two passes over the texts. The first counts exactly in how many documents of a language each term occurs; the terms of three
documents or more are kept. The second finds every occurrence of the kept terms by an Aho-Corasick automaton for each language,
whose patterns are the terms between delimiters, and counts them by source. Texts are never shuffled, only counts.

The automata hold the ``most`` most frequent terms, which bounds the broadcast and the workers' memory; occurrences of rarer kept
terms, if there are more, are counted by words in the same pass. Pairs of sources come from postings: sources of a term that occurs
in neither, one or both of them contribute by three sums, so only terms of both are met by pair, in blocks of sources.
All arithmetic is in integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import removed, slices, written

#: Terms are runs of letters A-Z (lower-cased) and of characters beyond ASCII; all other bytes delimit.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Documents of a language that a kept term is in.
LEAST = 3
#: Terms in the automata of one worker: some 200 bytes each.
MOST = 1_000_000
#: Counts that a worker gathers before it hands them on.
HELD = 500_000
#: Bytes of a text that are searched at a time.
PIECE = 4_000_000
#: Sources of a language in a block of postings.
BLOCK = 256
#: Squares of pairs, BLOCK on a side, that a worker adds up at a time.
SQUARES = 64
TOP = 200
SCALE = 1_000_000_000


def pieces(text: bytes) -> Iterator[bytes]:
    """A text with blanks for delimiters, in parts cut at a delimiter."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and FOLD[text[end]] != 32:
            end += 1
        yield text[at:end].translate(FOLD)
        at = end


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, bytes]]:
    """(lang, source, text) of each document, with a bounded number of bytes in Python at a time."""
    for batch in batches:
        for part in slices(batch):
            yield from zip(part["lang"].to_pylist(), part["source"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), strict=True)


def frequencies(docs: DataFrame) -> DataFrame:
    """lang, term and ``df``, the number of documents of the language that hold the term."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[bytes]] = {}
        for lang, _, text in rows_of(batches):
            words: set[bytes] = set()
            for p in pieces(text):
                words.update(p.split())
            held.setdefault(lang, Counter()).update(words)
            if sum(map(len, held.values())) > HELD:
                yield from told(held)
                held = {}
        yield from told(held)

    def told(held: dict[str, Counter[bytes]]) -> Iterator[pa.RecordBatch]:
        for lang, own in held.items():
            if own:
                arrays = [pa.array([lang] * len(own)), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "term", "df"])

    return docs.mapInArrow(of, "lang string, term string, df long").groupBy("lang", "term").agg(F.sum("df").alias("df"))


def head(kept: DataFrame, most: int = MOST) -> tuple[DataFrame, bool]:
    """The kept terms for the automata, ``most`` at most, those of the highest frequencies; and whether any are left out."""
    # as many rows as there are different frequencies: their number grows with the root of the corpus
    by_df = kept.groupBy("df").agg(F.count("*").alias("n"))
    ahead = by_df.withColumn("to", F.sum("n").over(Window.orderBy(F.desc("df"))))
    edge, fits, terms = ahead.agg(F.min(F.when(F.col("to") <= most, F.col("df"))), F.coalesce(F.max(F.when(F.col("to") <= most, F.col("to"))), F.lit(0)), F.coalesce(F.max("to"), F.lit(0))).first()
    return kept.where(F.col("df") >= F.lit(edge)), fits < terms


@lru_cache(maxsize=1)
def automata(token: object, more: bool) -> tuple[dict[str, ahocorasick.Automaton], dict[str, set[bytes]]]:
    """For each language an automaton of its terms between delimiters, and, if there are more terms, these; built once in each worker."""
    terms: pa.Table = token.value
    found: dict[str, ahocorasick.Automaton] = {}
    known: dict[str, set[bytes]] = {}
    # frequent terms first: their nodes lie side by side in memory
    for lang, term, no in zip(*(terms[c].to_pylist() for c in ("lang", "term", "no")), strict=True):
        found.setdefault(lang, ahocorasick.Automaton()).add_word(f" {term} ", no)
        if more:
            known.setdefault(lang, set()).add(term.encode())
    for a in found.values():
        a.make_automaton()
    return found, known


def occurrences(docs: DataFrame, kept: DataFrame, most: int = MOST) -> DataFrame:
    """lang, source, term and ``n``, how often the kept term occurs in the source's documents; only terms that do."""
    terms, more = head(kept, most)
    token = docs.sparkSession.sparkContext.broadcast(terms.orderBy(F.desc("df"), "no").select("lang", "term", "no").toArrow())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, known = automata(token, more)
        held: dict[tuple[str, str], Counter] = {}
        size = seen = 0
        for lang, source, text in rows_of(batches):
            automaton, words, own = found.get(lang), known.get(lang, ()), held.setdefault((lang, source), Counter())
            before = len(own)
            for p in pieces(text):
                if automaton is not None:
                    own.update(map(itemgetter(1), automaton.iter(f" {p.decode('utf-8', 'replace')} ")))
                if more:
                    own.update(filterfalse(words.__contains__, p.split()))
            size, seen = size + len(own) - before, seen + 1
            if size > HELD:
                yield from told(held)
                held, size = {}, 0
        yield from told(held)

    def told(held: dict[tuple[str, str], Counter]) -> Iterator[pa.RecordBatch]:
        for (lang, source), own in held.items():
            keys = list(own)
            numbers = pa.array([k if isinstance(k, int) else None for k in keys] if more else keys, pa.int64())
            rest = pa.array([None if isinstance(k, int) else k for k in keys], pa.binary()).cast(pa.string()) if more else pa.nulls(len(keys), pa.string())
            names = [pa.array([x] * len(keys), pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*names, numbers, rest, pa.array(list(own.values()), pa.int64())], ["lang", "source", "no", "rest", "n"])

    counted = docs.mapInArrow(of, "lang string, source string, no long, rest string, n long").groupBy("lang", "source", "no", "rest").agg(F.sum("n").alias("n"))
    if more:
        counted = written(counted, "occurrences")
    numbered = counted.where("no is not null").join(kept.select("no", "term"), "no").select("lang", "source", "term", "n")
    if not more:
        return numbered
    return numbered.unionByName(counted.where("no is null").withColumnRenamed("rest", "term").join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), whatever the size of the counts."""
    whole = lambda c: c.cast("decimal(19,0)")
    large = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(count + 1), whole(total))
    return F.when(count < 2**63 // SCALE - 1, F.call_function("div", (count + 1) * SCALE, total)).otherwise(large) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def groups_of(docs: DataFrame, counts: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, its number ``at`` within the language, the count ``total`` its shares are of, and ``p0``, an absent term's share."""
    size = kept.groupBy("lang").agg(F.count("*").alias("v"))
    words = counts.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    rows = docs.select("lang", "source").distinct().join(words, ["lang", "source"], "left").join(size, "lang", "left")
    v = F.coalesce("v", F.lit(0).cast("long"))
    rows = rows.select("lang", "source", v.alias("v"), (F.coalesce("words", F.lit(0).cast("long")) + v).alias("total"))
    p0 = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"))).otherwise(F.lit(0).cast("long"))
    # a language's sources are numbered in one task: as many rows as the pairs' ranking has in one task too
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return rows.select("lang", "source", at.alias("at"), "v", "total", p0.alias("p0"))


def shared_sums(postings: DataFrame, blocks: int, block: int = BLOCK) -> DataFrame:
    """lang, g, h and ``both``: what terms of both sources add to what the terms of each one give by themselves.

    A term's postings are kept in blocks of ``block`` sources, so a row holds a bounded number of them whatever the term; terms are dealt to
    tasks, each of which adds up whole squares of pairs. Only where a language has several blocks do the blocks of a term meet.
    """
    entry = F.struct("at", "p", "p0")
    lists = postings.groupBy("lang", "term", F.floor(F.col("at") / block).alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("own"))
    within = lists.where(F.size("own") > 1).select("lang", F.col("block").alias("bg"), F.col("block").alias("bh"), F.col("own").alias("owng"), F.lit(None).cast(lists.schema["own"].dataType).alias("ownh"))
    if blocks > 1:
        lists = written(lists, "lists")
        side = lambda mark: lists.select("lang", "term", F.col("block").alias(f"b{mark}"), F.col("own").alias(f"own{mark}"))
        within = within.unionByName(side("g").join(side("h"), ["lang", "term"]).where("bg <> bh").drop("term"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in ("lang", "bg", "bh")), strict=True))
            one, two = Lists(batch["owng"]), Lists(batch["ownh"])
            for key in dict.fromkeys(keys):
                rows = np.array([i for i, k in enumerate(keys) if k == key])
                if key not in held and len(held) >= SQUARES:
                    yield from told(held)
                    held = {}
                sums, seen = held.setdefault(key, (np.zeros(block * block, np.int64), np.zeros(block * block, bool)))
                add_up(sums, seen, rows, one, one if key[1] == key[2] else two, key[1] * block, key[2] * block, block)
        yield from told(held)

    def told(held: dict[tuple[str, int, int], tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for (lang, bg, bh), (sums, seen) in held.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at // block + bg * block), pa.array(at % block + bh * block), pa.array(sums[at])], ["lang", "g", "h", "both"])

    summed = within.mapInArrow(of, "lang string, g long, h long, both long").where("g <> h")
    return summed.groupBy("lang", "g", "h").agg(F.sum("both").alias("both"))


class Lists:
    """Postings of many terms as flat columns: source, share, share of an absent term."""

    def __init__(self, lists: pa.ListArray):
        self.starts = lists.offsets.to_numpy()[:-1].astype(np.int64)
        self.sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        self.columns = [lists.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]

    def of(self, rows: np.ndarray, size: int) -> list[np.ndarray]:
        """The columns of rows whose lists have one size, a line for each row."""
        at = self.starts[rows][:, None] + np.arange(size)
        return [c[at] for c in self.columns]


def add_up(sums: np.ndarray, seen: np.ndarray, rows: np.ndarray, one: Lists, two: Lists, base_g: int, base_h: int, block: int) -> None:
    """Adds what the terms of ``rows`` give to each pair of their sources; terms with lists of the same sizes go together."""
    sizes = one.sizes[rows] * (block + 1) + two.sizes[rows]
    for size in np.unique(sizes):
        n, m = divmod(int(size), block + 1)
        alike, step = rows[sizes == size], max(1, 1_000_000 // (n * m))
        for k in range(0, len(alike), step):
            g, pg, zg = (c[:, :, None] for c in one.of(alike[k : k + step], n))
            h, ph, zh = (c[:, None, :] for c in two.of(alike[k : k + step], m))
            more = (pg - ph) ** 2 // ph - (pg - zh) ** 2 // zh - (zg - ph) ** 2 // ph + (zg - zh) ** 2 // zh
            at = (g - base_g) * block + (h - base_h)
            np.add.at(sums, at.ravel(), more.ravel())
            seen[at.ravel()] = True


def pairs(groups: DataFrame, postings: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, source, item and value for each source of a language and each other one.

    With the shares p, q of a term and those of an absent one, p0 and q0, the sum over all V kept terms is that of f(p0, q0), V times,
    of f(p, q0) - f(p0, q0) over the terms of the first, of f(p0, q) - f(p0, q0) over those of the second, and of what terms of both add.
    The sums over a source's own terms run over its different shares with their numbers, in bounded lists.
    """
    alike = postings.groupBy("lang", "at", "p").agg(F.count("*").alias("m"))
    part = F.pmod(F.col("p"), F.lit(64))
    lists = written(alike.groupBy("lang", "at", part.alias("part")).agg(F.collect_list(F.struct("p", "m")).alias("shares")), "shares")
    one = groups.select("lang", F.col("at").alias("g"), "source", "v", F.col("p0").alias("pg"))
    two = groups.select("lang", F.col("at").alias("h"), F.col("source").alias("item"), F.col("p0").alias("ph"))
    # the result itself has a row for each of these pairs
    both = written(one.join(two, "lang").where("g <> h"), "pairs")
    blocks = (groups.agg(F.coalesce(F.max("at"), F.lit(0))).first()[0]) // block + 1
    add = lambda shares, f: F.aggregate(shares, F.lit(0).cast("long"), lambda n, x: n + x.m * f(x.p))
    rest = distance(F.col("pg"), F.col("ph"))
    first = both.join(lists.withColumnRenamed("at", "g"), ["lang", "g"]).select("lang", "g", "h", add("shares", lambda p: distance(p, F.col("ph")) - rest).alias("more"))
    second = both.join(lists.withColumnRenamed("at", "h"), ["lang", "h"]).select("lang", "g", "h", add("shares", lambda q: distance(F.col("pg"), q) - rest).alias("more"))
    more = first.unionByName(second).unionByName(shared_sums(postings, blocks, block).withColumnRenamed("both", "more")).groupBy("lang", "g", "h").agg(F.sum("more").alias("more"))
    value = F.when(F.col("v") > 0, F.col("v") * rest + F.coalesce("more", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    return both.join(more, ["lang", "g", "h"], "left").select("lang", "source", "item", value.alias("value"))


def leading_terms(postings: DataFrame) -> DataFrame:
    """lang, source, item and value for the terms that a source has more often than its language."""
    return postings.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value and rank: for each source its distance to the others of its language, and its ``top`` leading terms.

    Null texts, langs and sources are empty ones. Sources without terms take part; a language without kept terms has zero distances
    and no terms. Equal values are ranked by item (UTF-8). Repeated rows count as documents of their own; doc_ids and other columns are
    neither read nor returned. Texts of any length are searched in pieces. An empty table gives an empty result.
    """
    rows = texts(docs)
    kept = written(frequencies(rows).where(F.col("df") >= least).withColumn("no", F.monotonically_increasing_id()), "kept")
    counts = written(occurrences(rows, kept, most), "counts")
    groups = written(groups_of(rows, counts, kept), "groups")
    whole = groups.groupBy("lang").agg((F.sum(F.col("total") - F.col("v")) + F.max("v")).alias("lang_total"))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")).join(whole, "lang").select("lang", "term", share(F.col("lang_n"), F.col("lang_total")).alias("q"))
    at = counts.join(groups.select("lang", "source", "at", "total", "p0"), ["lang", "source"]).join(terms, ["lang", "term"])
    postings = written(at.select("lang", "source", "at", "term", share(F.col("n"), F.col("total")).alias("p"), "p0", "q"), "postings")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs(groups, postings, block), "pair").unionByName(ranked(leading_terms(postings), "term").where(F.col("rank") <= top))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) + coalesce(v, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v USING (lang)),
s AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1) // total AS p FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (sum(n) + 1) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM c GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM s JOIN l USING (lang, term) WHERE n > 0 AND p > q),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM t WHERE part = 'pair' OR rank <= 200
"""
