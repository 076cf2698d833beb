"""Operator 1 at a stated similarity: SimHash near copies whose shingle sets are verified by their Jaccard similarity.

A text is the set of its five-word shingles. Candidates are the texts that operator 1 links: equal fingerprints of these shingles,
and those that its grid range join finds within three bits. At a similarity of 0.8 two fingerprints differ in some ten of 64 bits,
which no grid can reach, so most such pairs would be lost; therefore texts also meet by minima of their shingles' hashes:
``BANDS`` bands of ``ROWS`` minima each make a pair of similarity s meet with probability 1 - (1 - s^ROWS)^BANDS, which at 0.8 is
all but about three in a million (see below for the last round).

Every member of a bucket (equal fingerprints or a band) is tested against the bucket's head; verified links make classes. What is
left are buckets of several classes, whose texts get a bound: shingles that no other such text has can't be shared, so a text with
c shared ones of n is no more similar to another than c in n, and two of them no more than m / (n + n' - m) with m the lesser c.
Each member is then tested against ``HUBS`` members of other classes: the one with the largest share, the likeliest to be what the
others were copied from, and some by chance. Of the pairs that still lie in different classes those are formed whose bound allows
a link and whose sketches (a bit of each of 1024 minima) differ in no more bits than all but one in a million pairs of the least
similarity do. So a large group of copies costs a few tests for each member, and edited copies that are less alike than asked for
are told apart by their sketches.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import KEY, fields, mapped, one_of_each, row_key, spread_join, written
from .simhash import SEED, components

BANDS, ROWS = 24, 4
#: Members of a bucket that each other one is tested against in the second round; words of 64 bits in a sketch for the third.
HUBS, SKETCH = 3, 16
#: Shingles whose minima are taken at once; bounds memory for long texts.
SLICE = 1 << 13


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, in order; one for a text of fewer words, zero for one without a word."""
    hashes = simhash.shingle_hashes(text, words)
    return np.unique(hashes) if len(hashes) else np.zeros(1, np.uint64)


def bands(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band."""
    rng = np.random.default_rng(SEED)
    a, b = (rng.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), SLICE):
        least = np.minimum(least, ((hashes[k : k + SLICE] ^ b) * (a | np.uint64(1))).min(1))
    keys = [xxhash.xxh64_intdigest(m.tobytes(), i) for i, m in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketch(hashes: np.ndarray) -> list[int]:
    """One bit of each of 64 * SKETCH minima, in signed words; two texts of similarity s have a bit in common with (1 + s) / 2."""
    rng = np.random.default_rng(SEED + 1)
    a, b = (rng.integers(0, 2**64, (64 * SKETCH, 1), np.uint64) for _ in range(2))
    least = np.full(64 * SKETCH, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 1 << 10):
        least = np.minimum(least, ((hashes[k : k + (1 << 10)] ^ b) * (a | np.uint64(1))).min(1))
    return np.packbits((least >> np.uint64(31) & np.uint64(1)).astype(np.uint8)).view(np.int64).tolist()


def differing(least: float) -> int:
    """Bits in which the sketches of two texts of similarity ``least`` differ at most, but for one pair in a million."""
    p, n = (1 - least) / 2, 64 * SKETCH
    return int(n * p + 4.75 * (n * p * (1 - p)) ** 0.5) + 1


def sets_of(rids: DataFrame, ids: DataFrame, docs: DataFrame, words: int, sketched: bool = False) -> DataFrame:
    """``rid``, the array ``s`` of shingle hashes and, if ``sketched``, the array ``k`` for each of ``rids`` (distinct), written."""

    def of(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, words).view(np.int64) for t in part["text"].to_pylist()]
        ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
        sketches = pa.array([sketch(x.view(np.uint64)) if sketched else [] for x in sets], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([part["rid"], pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets))), sketches], ["rid", "s", "k"])

    keys = rids.join(ids.select("rid", *KEY), "rid")
    texts = docs.select(*row_key(), "text").join(keys, KEY).dropDuplicates(["rid"])
    return written(mapped(texts.select("rid", "text"), "rid long, s array<long>, k array<long>", of), "shingles")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) of row ids whose shingle sets have a Jaccard similarity of ``least`` or more, written."""
    at = pairs.join(sets.select(F.col("rid").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("rid").alias("v"), F.col("s").alias("b")), "v")
    both = at.select("u", "v", F.size(F.array_intersect("a", "b")).alias("both"), (F.size("a") + F.size("b")).alias("n"))
    return written(both.where(F.col("both") >= least * (F.col("n") - F.col("both")) - 1e-9).select("u", "v"), "links")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("rid")).distinct()


def links(ids: DataFrame, docs: DataFrame, words: int = 5, least: float = 0.8, radius: int = 3) -> DataFrame:
    """Verified pairs (u < v) of row ids whose classes are those of all candidate pairs; ``ids`` is written."""
    rows = ids.select("rid", "n", F.explode(F.concat(F.array(F.xxhash64(F.lit("fp"), "fp")), "bands")).alias("band"))
    groups = rows.groupBy("band").agg(F.min_by("n", "rid").alias("head_n"), F.min("rid").alias("head"), F.count("*").alias("size")).where("size > 1")
    whole = written(spread_join(rows, written(groups, "buckets"), ["band"], "size").select("band", "rid", "n", "head", "head_n"), "members")
    members = whole.select("band", "rid", "n")
    # Sets whose sizes differ by more than this can't be so similar.
    fits = lambda a, b: F.least(a, b) >= least * F.greatest(a, b) - 1e-9
    star = whole.where((F.col("rid") != F.col("head")) & fits(F.col("n"), F.col("head_n"))).select(F.col("head").alias("u"), F.col("rid").alias("v"))
    # One text stands for each fingerprint; the others of it are in its bucket.
    points = written(ids.groupBy("fp").agg(F.min("rid").alias("rid"), F.min_by("n", "rid").alias("n")), "points")
    of = lambda side: points.select(F.col("fp").alias(side), F.col("rid").alias(f"{side}_rid"), F.col("n").alias(f"{side}_n"))
    near = simhash.links(points.select("fp"), radius).join(of("u"), "u").join(of("v"), "v").where(fits(F.col("u_n"), F.col("v_n")))
    near = near.select(F.least("u_rid", "v_rid").alias("u"), F.greatest("u_rid", "v_rid").alias("v"))
    star = written(star.union(near).distinct(), "pairs")
    found = similar(star, sets_of(ends(star), ids, docs, words), least)
    at = mixed(members, found)
    # The sets of all texts that are left; what a text alone has can't be shared with another of them.
    sets = sets_of(at.select("rid").distinct(), ids, docs, words, sketched=True)
    alone = sets.select("rid", F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("k"), F.min("rid").alias("rid")).where("k = 1")
    at = written(at.join(alone.groupBy("rid").agg(F.count("*").alias("own")), "rid", "left").withColumn("c", F.col("n") - F.coalesce("own", F.lit(0))).drop("own"), "bounds")
    share = F.col("c") / F.col("n")
    hub = lambda by: F.max(F.struct(by.alias("by"), "rid", "n", "c", "root"))
    hubs = at.groupBy("band").agg(F.array(hub(share), *[hub(F.xxhash64("rid", F.lit(k)).cast("double")) for k in range(HUBS - 1)]).alias("hubs"))
    near = at.join(written(hubs, "hubs"), "band").select("rid", "n", "c", "root", F.explode("hubs").alias("hub"))
    near = near.where((F.col("root") != F.col("hub.root")) & may_link(F.col("n"), F.col("c"), F.col("hub.n"), F.col("hub.c"), least))
    near = near.select(F.least("rid", "hub.rid").alias("u"), F.greatest("rid", "hub.rid").alias("v")).distinct()
    found = written(found.union(similar(written(near, "pairs"), sets, least)), "links")
    # Members whose share is too small for any other of their bucket go, and buckets of one class.
    at = mixed(at.drop("root"), found)
    top = at.groupBy("band").agg(F.max(share).alias("top"))
    at = at.join(top, "band").where(F.col("c") >= least * (F.col("n") + F.col("c") * (1 / F.col("top") - 1)) - 1e-9).drop("top")
    bits = [F.get("k", F.lit(i)).alias(f"k{i}") for i in range(SKETCH)]
    at = several(at).join(ids.select("rid", "fp", "bands"), "rid").join(sets.select("rid", *bits), "rid")
    at = written(at, "mixed")
    a, b = at.alias("a"), at.alias("b")
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a.k{i}").bitwiseXOR(F.col(f"b.k{i}"))) for i in range(SKETCH)])
    # A pair is formed in one bucket only, the first that both are in.
    met = F.filter(F.zip_with("a.bands", "b.bands", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    once = F.col("a.band") == F.when(F.col("a.fp") == F.col("b.fp"), F.xxhash64(F.lit("fp"), "a.fp")).otherwise(F.get(met, F.lit(0)))
    across = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.root") < F.col("b.root")) & may_link(F.col("a.n"), F.col("a.c"), F.col("b.n"), F.col("b.c"), least) & (apart <= differing(least)) & once)
    across = across.select(F.least("a.rid", "b.rid").alias("u"), F.greatest("a.rid", "b.rid").alias("v"))
    return found.union(similar(written(across, "pairs"), sets, least))


def may_link(n: Column, c: Column, other_n: Column, other_c: Column, least: float) -> Column:
    """Whether two sets of n elements, c of them shared with any other, can have a similarity of ``least``."""
    m = F.least(c, other_c)
    return m >= least * (n + other_n - m) - 1e-9


def several(at: DataFrame) -> DataFrame:
    """The rows of ``at`` whose band has more than one root."""
    bands = at.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band")
    return at.join(bands, "band", "left_semi")


def mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members of buckets with more than one class, with their ``root``, written."""
    roots = components(found)
    at = members.join(roots, members.rid == roots.node, "left").withColumn("root", F.coalesce("root", "rid")).drop("node")
    return written(several(at), "mixed")


def dedup(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class of linked texts (smallest doc_id), with the columns of ``docs``.

    Texts are compared with ASCII letters in lower case. Texts without a word (null and empty ones too) are alike; a text of
    fewer than ``words`` words is one shingle. Minima of very long texts are taken some shingles at a time. Of rows alike in
    doc_id and text one stays at most, the first by their other columns; a null doc_id comes last. An empty table gives an
    empty result.
    """
    names = ["rid", "doc_id", *KEY]

    def of(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [simhash.shingle_hashes(t, words) for t in part["text"].to_pylist()]
        fps = np.array([simhash.majority(h) for h in hashes], np.uint64).view(np.int64)
        sets = [np.unique(h) if len(h) else np.zeros(1, np.uint64) for h in hashes]
        counts = pa.array(np.array([len(s) for s in sets], np.int32))
        return pa.RecordBatch.from_arrays([*[part[c] for c in names], pa.array(fps), counts, pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], [*names, "fp", "n", "bands"])

    at = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *row_key(), "text")
    ids = written(mapped(at, f"{fields(at, *names)}, fp long, n int, bands array<long>", of), "signatures")
    roots = components(links(ids, docs, words, least))
    at = ids.join(roots, ids.rid == roots.node, "left").withColumn("root", F.coalesce("root", "rid"))
    keep = at.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *KEY)).alias("first")).select("first.*").select(*KEY).distinct()
    return one_of_each(docs, keep)
