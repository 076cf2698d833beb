"""SimHash near-duplicate classes.

A fingerprint is mapped to the bit counts of its 2-bit segments, a point with 32 coordinates in {0, 1, 2}. Two fingerprints
at Hamming distance d lie at Manhattan distance d or less there, so the points within Manhattan distance r hold all links.
The range join runs on a grid of unit cells: a step of length r or less changes r coordinates at most. With the coordinates
dealt into ``axes`` groups, two points in range agree on some ``axes - r`` of these groups, so each choice of groups to ignore
is one projection of the grid, and a pair in range shares a cell in at least one. Cells are joined by equality; Manhattan
distance is tested first, the exact Hamming distance last. Only distinct fingerprints enter the join, so a group of copies is
one point, and links are turned into classes by star contraction, whose tables hold one row per link.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, fields, mapped, one_of_each, removed, row_key, spread_join, written

SEED = 42
#: Shingles whose bits are counted at once; bounds memory for long texts.
SLICE = 1 << 16


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """The unsigned 64-bit hashes of a text's shingles, repeats included; none if it has no word."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(found), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(found) - words + 1)
    starts, ends = (ends - sizes)[:n], ends[min(words, len(found)) - 1 :]
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, n)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text; zero if it has no word."""
    return majority(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), SLICE):
        counts += np.unpackbits(hashes[k : k + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, the row key and ``fp`` (long), a row for each row of ``docs``."""
    names = ["doc_id", *KEY]

    def of(part: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, words) for t in part["text"].to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*[part[c] for c in names], pa.array(fps)], [*names, "fp"])

    at = docs.select("doc_id", *row_key(), "text")
    return mapped(at, f"{fields(at, *names)}, fp long", of)


def segment_counts(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, each in two bits of a long."""
    odd = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def manhattan(a: Column, b: Column) -> Column:
    """The Manhattan distance of two segment-count points: a lower bound of the fingerprints' Hamming distance.

    Of two counts in two bits, the exclusive or is 1 (0-1), 2 (0-2) or 3 (1-2); the last differ by one.
    """
    odd = F.lit(0x5555555555555555)
    x = a.bitwiseXOR(b)
    low, high = x.bitwiseAND(odd), F.shiftrightunsigned(x, 1).bitwiseAND(odd)
    both = low.bitwiseAND(high)
    return F.bit_count(low) + 2 * F.bit_count(high) - 2 * F.bit_count(both)


def projections(radius: int, axes: int) -> list[int]:
    """Bit masks of the grid's projections: all segments but those of ``radius`` groups."""
    groups = [0] * axes
    for segment in range(32):
        groups[segment * axes // 32] |= 3 << (2 * segment)
    masks = [sum(g) for g in combinations(groups, axes - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def axes_for(points: int, radius: int) -> int:
    """Groups of segments so many that a cell of the grid holds a few points by chance, however many there are.

    Two fair bits have equal counts with probability 3/8, so a segment of a cell's key parts the points by 1.415 bits.
    """
    for axes in range(radius + 3, 17):
        if points <= 4 * 2 ** (1.415 * (32 * (axes - radius) // axes)):
            return axes
    return 16


def links(points: DataFrame, radius: int = 3, axes: int | None = None) -> DataFrame:
    """Pairs (u < v) of distinct fingerprints with ``radius`` differing bits or fewer; ``points`` has ``fp``, distinct.

    ``axes`` follows the number of points if it is not given.
    """
    masks = projections(radius, axes or axes_for(points.count(), radius))
    at = points.withColumn("c", segment_counts(F.col("fp")))
    cells = at.select("fp", "c", F.posexplode(F.array(*[F.col("c").bitwiseAND(F.lit(m)) for m in masks])).alias("p", "cell"))
    a, b = cells.alias("a"), cells.alias("b")
    near = (
        (F.col("a.p") == F.col("b.p")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp"))
        & (manhattan(F.col("a.c"), F.col("b.c")) <= radius)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius)
    )
    return a.join(b, near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for each node that has a link. ``edges``: (u, v) with u < v.

    Alternates large-star and small-star contraction (Kiveris et al., 2014) until a round changes nothing; each round is
    written to the shared folder and only its size and checksum come to the driver.
    """
    now, before = written(edges, "links"), None
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        least = large.groupBy(F.col("v").alias("w")).agg(F.min("u").alias("m"))
        tied = large.join(least, F.col("v") == F.col("w"))
        small = tied.select("m", F.explode(F.array("u", "v")).alias("v")).where("m < v").select(F.col("m").alias("u"), "v")
        last, now = now, written(small.distinct(), "links")
        removed(last)
        after = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, axes: int | None = None) -> DataFrame:
    """doc_id, ``fingerprint`` (hex), ``component_id`` and ``component_size``, a row for each row of ``docs``.

    Texts without a word (null and empty ones too) have fingerprint zero and link like any other; of very long texts some
    shingles are counted at a time. Rows alike in doc_id and text are in one class. component_id is the smallest doc_id of the
    class; null doc_ids are passed over, and a class with no other has a null one. Other columns are neither read nor returned.
    An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, words), "fingerprints")
    return classes(fps, radius, axes).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id"), F.col("component_size")
    )


def classes(fps: DataFrame, radius: int = 3, axes: int | None = None) -> DataFrame:
    """``fps`` (a written table) with ``component_id``, ``component_size`` and the row key of the member that stays."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *KEY))
    points = written(fps.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")), "points")
    roots = components(links(points.select("fp"), radius, axes))
    at = points.join(roots, points.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
    whole = at.groupBy("root").agg(F.min("first").alias("head"), F.sum("n").alias("component_size"))
    named = at.join(whole, "root").select("fp", "n", "component_size", F.col("head.doc_id").alias("component_id"), *[F.col(f"head.{k}").alias(f"{k}keep") for k in KEY])
    return spread_join(fps, written(named, "named"), ["fp"], "n").drop("n")


def dedup(docs: DataFrame, words: int = 3, radius: int = 3, axes: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class (smallest doc_id), with the columns of ``docs``.

    Nulls, empty texts and an empty table are dealt with as by ``near_duplicates``. Of rows alike in doc_id and text the first
    by their other columns stays.
    """
    fps = written(fingerprints(docs, words), "fingerprints")
    keep = classes(fps, radius, axes).where(" and ".join(f"{k} = {k}keep" for k in KEY)).select(*KEY).distinct()
    return one_of_each(docs, keep)
