"""Best-fit packing by hierarchical residual rounds.

Every document becomes pieces of ``size`` tokens at most. Each partition packs its pieces best-fit, largest first, a bounded
number at a time. Bins that are nearly full are done; underfull bins go on as items of the next round, dealt over fewer
partitions, and are merged best-fit again, until one partition holds them all or a round merges none. A bin holds ``size``
pieces at most (no piece is empty), so its members travel with it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec
from .common import removed, slices, written

#: Items that one task packs at a time, and the most that a partition of a later round is meant to hold.
AT_ONCE = 50_000
#: Free tokens up to which a bin counts as nearly full before the last round.
SLACK = 4


def pieces(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of each row's ids, ``end_id`` after the last; of a longer document the first piece is the short one."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, by_library=True)
        for batch in batches:
            for part in slices(batch):
                at, starts, lengths, crcs = [], [], [], []
                for row, text in enumerate(part["text"].to_pylist()):
                    ids = codec.encode(text) + end
                    n, start = len(ids) // 4, 0
                    stop = n % size or size
                    while start < n:
                        at.append(row)
                        starts.append(start)
                        lengths.append(stop - start)
                        crcs.append(zlib.crc32(memoryview(ids)[4 * start : 4 * stop]))
                        start, stop = stop, stop + size
                order = np.array(at, np.int64)
                first = np.searchsorted(order, order)
                piece = pa.array((np.arange(len(order)) - first).astype(np.int32))
                numbers = [pa.array(x, pa.int64()) for x in (starts, lengths, crcs)]
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(order)), piece, *numbers], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(cut, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of item numbers: largest item first, each into the fullest bin that still takes it.

    ``free[r]`` holds the bins with r tokens free; a bit for each r that has some finds the least r that suffices.
    """
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(size + 1)]
    some = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                some &= ~(1 << r)
            bins[b].append(item)
            left = r - n
        else:
            b, left = len(bins), size - n
            bins.append([item])
        free[left].append(b)
        some |= 1 << left
    return bins


def merged(items: DataFrame, size: int, at_once: int = AT_ONCE) -> DataFrame:
    """One best-fit round in each partition of ``items`` (``fill``, ``members``)."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= at_once:
                yield from _packed(pd.concat(held, ignore_index=True), size)
                held, n = [], 0
        if held:
            yield from _packed(pd.concat(held, ignore_index=True), size)

    return items.mapInPandas(pack, items.schema)


def _packed(frame: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    fills, members = frame["fill"].to_numpy(), frame["members"].tolist()
    bins = best_fit(fills, size)
    for k in range(0, len(bins), 5000):
        part = bins[k : k + 5000]
        yield pd.DataFrame({"fill": [int(fills[b].sum()) for b in part], "members": [[m for i in b for m in members[i]] for b in part]})


def packed(parts: DataFrame, size: int = 1024, slack: int = SLACK, at_once: int = AT_ONCE) -> DataFrame:
    """``parts`` (as of ``pieces``) with ``sequence_id`` and ``offset``.

    Pieces of the full size are sequences of their own. Equal pieces and repeated rows are packed one by one. An empty table
    gives an empty result. sequence_ids are distinct numbers, not dense.
    """
    # Written first, so that a task has one Python worker at a time: the tokenizer's or the packer's.
    parts = written(parts, "pieces")
    items = parts.select(F.col("length").alias("fill"), F.array(F.struct(*parts.columns)).alias("members"))
    now, done, before = written(merged(items, size, at_once), "bins"), [], None
    removed(parts)
    while True:
        open_bins = now.where(F.col("fill") < size - slack)
        n = open_bins.count()
        if not n or n == before:
            done.append(now)
            break
        tasks = -(-n // at_once)
        done.append(now.where(F.col("fill") >= size - slack))
        now = written(merged(open_bins.repartition(tasks), size, at_once), "bins")
        if tasks == 1:
            done.append(now)
            break
        before = n
    bins = done[0]
    for more in done[1:]:
        bins = bins.union(more)
    each = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    ends = F.expr("aggregate(members, array(0L), (a, m) -> array_append(a, element_at(a, -1) + m.length))")
    at = each.select("sequence_id", F.posexplode(F.arrays_zip("members", F.slice(ends, 1, F.size("members")).alias("offset"))).alias("i", "x"))
    return at.select("x.members.*", "sequence_id", "x.offset")


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset, a row for each piece of each row of ``docs``.

    Null and empty texts are one piece, the end id alone; very long ones are cut. Repeated rows are packed as often as they come,
    null doc_ids as they are. Other columns are neither read nor returned. An empty table gives an empty result.
    """
    return packed(pieces(docs, path, size, end_id), size)
