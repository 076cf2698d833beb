"""Exact duplicates by deterministic block naming.

A text without its blanks is cut into blocks of a fixed number of bytes. The distinct blocks of the corpus are sorted and each
gets its rank as an integer name; then adjacent names are paired, the distinct pairs are sorted and named in turn, and so on
until each document has one name. Two documents have the same (level, name) exactly if their texts are equal.

Blocks are sorted by a key of 64-bit hashes in place of their bytes, which is right only while no two blocks share a key. That is not
assumed: the smallest and the largest block under each key are compared, over all blocks, and if some key has two blocks, the
naming starts again with one more hash in the key (two at first). Block bytes are shuffled once, after the map side has reduced copies to one
row; documents carry keys only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_CLASS, KEY, offsets, one_of_each, removed, row_key, spread_join, utf8, written

#: Names are ranks within a bucket of keys plus the number of names in the buckets before it.
BUCKETS = 4096


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANK_CLASS, "")


def blocks(plain: Column, size: int) -> Column:
    """The bytes of a text in pieces of ``size``; one empty piece for an empty text."""
    data = utf8(plain)
    last = F.floor((F.greatest(F.octet_length(data), F.lit(1)) - 1) / size)
    return F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def ranked(distinct: DataFrame, key: list[str]) -> DataFrame:
    """``distinct`` (``key`` and a count ``n``) with ``name``: ranks from 1 in the order of the key, without a global sort."""
    at = distinct.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(BUCKETS)))
    before = offsets(at.groupBy("bucket").agg(F.count("*").alias("n")), ["bucket"], "n", "before").drop("n")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*key))
    # before: a row for each of BUCKETS buckets at most, which bounds the broadcast
    return at.join(F.broadcast(before), "bucket").select(*key, "n", (F.col("before") + rank).alias("name"))


def block_names(cut: DataFrame, hashes: list[int]) -> DataFrame | None:
    """(key columns, n, name) of the distinct ``block``s of ``cut``, or None if two blocks share a key."""
    key = [f"h{i}" for i in range(len(hashes))]
    hashed = cut.select("block", *[_hash(F.col("block"), s).alias(k) for s, k in zip(hashes, key, strict=True)])
    spans = hashed.groupBy(*key).agg(F.min("block").alias("low"), F.max("block").alias("high"), F.count("*").alias("n"))
    checked = written(spans.select(*key, "n", (F.col("low") != F.col("high")).alias("clash")), "block-keys")
    if checked.where("clash").head(1):
        removed(checked)
        return None
    return written(ranked(checked.select(*key, "n"), key), "block-names")


def _hash(block: Column, seed: int) -> Column:
    """Seeds from 0: 64-bit hashes, each independent of the others. Below 0: so few values that tests meet clashes."""
    return F.pmod(F.xxhash64(block), F.lit(-seed)) if seed < 0 else F.xxhash64(F.lit(seed), block)


def identities(docs: DataFrame, size: int = 2048, seeds: tuple[int, ...] = (0, 1, 2, 3), first: int = 2) -> DataFrame:
    """A row for each row of ``docs``: ``rid``, doc_id, the row key, ``points``, ``sha``, and the identity (``level``, ``name``)."""
    plain = docs.select(normalised().alias("plain"))
    cut = plain.select(F.explode(blocks(F.col("plain"), size)).alias("block"))
    # Two hashes first: with one, a corpus of 10^10 blocks would be read twice for a few clashes.
    used = next((k for k in range(min(first, len(seeds)), len(seeds) + 1) if (names := block_names(cut, list(seeds[:k]))) is not None), None)
    if used is None:
        raise RuntimeError("blocks still share keys; give more seeds")
    keys = [f"h{i}" for i in range(used)]
    heads = docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", *row_key(), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("points"), normalised().alias("plain")
    )
    heads = heads.select(
        "rid", "doc_id", *KEY, "points", F.sha2(utf8("plain"), 256).alias("sha"),
        F.transform(blocks(F.col("plain"), size), lambda b: F.struct(*[_hash(b, s).alias(k) for s, k in zip(seeds, keys, strict=False)])).alias("cut"),
    )
    heads = written(heads, "heads")
    at = heads.select("rid", F.size("cut").alias("left"), F.posexplode("cut").alias("pos", "h")).select("rid", "left", "pos", "h.*")
    at = written(spread_join(at, names, keys, "n").select("rid", "left", "pos", "name"), "names")
    done, level = None, 0
    while True:
        whole = at.where("left = 1").select("rid", F.lit(level).alias("level"), "name")
        done = whole if done is None else done.union(whole)
        rest = at.where("left > 1")
        if not rest.head(1):
            break
        halves = F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("b")
        pairs = rest.groupBy("rid", F.floor((F.col("left") + 1) / 2).cast("int").alias("left"), F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(*halves)
        pairs = written(pairs.withColumn("b", F.coalesce("b", F.lit(0).cast("long"))), "pairs")
        named = written(ranked(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"]), "pair-names")
        at = written(spread_join(pairs, named, ["a", "b"], "n").select("rid", "left", "pos", "name"), "names")
        removed(pairs, named)
        level += 1
    return heads.drop("cut").join(done, "rid")


def exact_duplicates(docs: DataFrame, size: int = 2048, seeds: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the row keys, a row for each row of ``docs``.

    Null texts count as empty. Of equal texts the row with the most code points stays, then the smallest doc_id; a null doc_id
    comes last. Of rows alike in doc_id and text one is marked as kept. A very long text is many blocks, which are dealt out.
    Other columns are neither read nor returned. An empty table gives an empty result.
    """
    ids = written(identities(docs, size, seeds), "identities")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), "doc_id", "rid")).alias("best")
    groups = written(ids.groupBy("level", "name").agg(best, F.count("*").alias("group_size")), "groups")
    whole = spread_join(ids, groups, ["level", "name"], "group_size")
    return whole.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), F.col("sha").alias("text_sha256"), *KEY
    )


def dedup(docs: DataFrame, size: int = 2048) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``: one of each group of equal texts.

    Nulls, empty and very long texts, ties and an empty table are dealt with as by ``exact_duplicates``; of rows alike in doc_id
    and text the first by their other columns stays.
    """
    return one_of_each(docs, exact_duplicates(docs, size).where("kept").select(*KEY))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS p FROM documents),
r AS (SELECT doc_id, p, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY p) AS group_size
      FROM d WINDOW w AS (PARTITION BY p ORDER BY length(t) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(p) AS text_sha256 FROM r
"""
