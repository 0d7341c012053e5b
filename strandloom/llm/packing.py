"""Problem 7: filling containers of a fixed capacity with items, by exact complements of length sums.

How many items there are of each length is all that the plan needs, and there are at most ``capacity`` lengths. The plan is
made from that histogram: patterns of lengths and how often each is used. Items are numbered within their length, and
an item's number says which container it goes to. So neither the items nor their assignment pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stage
from .tokens import VOCABULARY, token_counts

CAPACITY = 2048
#: Items that are numbered in one task, about.
NUMBERED = 200_000


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with sums up to ``capacity`` and their uses, which use up ``counts`` (by length, from 0) exactly.

    From the longest length down, the gap is filled exactly by a single, a pair or a triple of available lengths,
    as often as the counts allow. Where no combination is exact, the best-fitting length narrows the gap and the search goes on.
    """
    left, out = counts.astype(np.int64).copy(), []
    left[0] = 0
    for length in range(capacity, 0, -1):
        while left[length]:
            pattern, gap = [length], capacity - length
            while gap:
                spare = left - np.bincount(pattern, minlength=capacity + 1)
                more = _exact(spare, gap)
                if more:
                    pattern, gap = pattern + more, 0
                    break
                fits = np.flatnonzero(spare[1 : gap + 1] > 0)
                if not len(fits):
                    break
                pattern.append(int(fits[-1]) + 1)
                gap -= pattern[-1]
            kinds, each = np.unique(pattern, return_counts=True)
            times = int((left[kinds] // each).min())
            left[kinds] -= times * each
            out.append((tuple(pattern), times))
    return out


def _exact(spare: np.ndarray, gap: int) -> list[int]:
    """One, two or three available lengths with the sum ``gap``, long ones first; none if there are none."""
    if spare[gap] > 0:
        return [gap]
    here = spare[: gap + 1] > 0
    here[0] = False

    def pair(total: int) -> list[int]:
        a = np.arange((total + 1) // 2, total)
        good = np.flatnonzero(here[a] & here[total - a] & ((a * 2 != total) | (spare[a] > 1)))
        return [int(a[good[-1]]), total - int(a[good[-1]])] if len(good) else []

    if two := pair(gap):
        return two
    have = here.astype(np.float64)
    n = 1 << (2 * gap + 1).bit_length()
    sums = np.fft.irfft(np.fft.rfft(have, n) ** 2, n)[: gap + 1] > 0.5
    for a in np.flatnonzero(here & sums[::-1])[::-1]:
        spare[a] -= 1
        here[a] = spare[a] > 0
        rest = pair(gap - int(a))
        spare[a] += 1
        here[a] = True
        if rest:
            return [int(a), *rest]
    return []


def _pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """Items of (id, size): those over the capacity as full pieces and a rest; sizes of 0 and null ids or sizes are left out."""
    n = F.col("size")
    parts = sizes.where("id is not null and size > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), ((n - 1) / capacity).cast("bigint").cast("int"))))
    return parts.select("id", "piece", F.least(F.lit(capacity), n - F.col("piece") * capacity).cast("int").alias("length"))


def _numbered(items: DataFrame, rows: int) -> DataFrame:
    """``nth``: each item's number among those of its length, without sorting a frequent length in one task."""
    parts = max(1, -(-rows // NUMBERED))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.lit(parts)))
    counts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    here = F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "piece")) - 1
    return dealt.withColumn("here", here).join(before, ["length", "part"]).select("id", "piece", "length", (F.col("before") + F.col("here")).alias("nth"))


def fill(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers for the items of ``sizes`` (id, size): id, piece, length, container (from 0), place (where in it the piece begins).

    An item over the capacity, and only such a one, is split: pieces of the full capacity and a rest. Every other item
    is in one container, whole. Items of size 0, and null ids or sizes, go into none; repeated rows are items of their
    own; no rows give no containers; other columns are ignored.
    """
    items = stage(_pieces(sizes.select("id", "size"), capacity))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in items.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    patterns = plan(counts, capacity)
    uses: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for lengths, times in patterns:
        place = 0
        for x in lengths:
            uses.setdefault(x, []).append((times, base, place))
            place += x
        base += times
    lengths = np.array([x for x, u in uses.items() for _ in u], np.int64)
    times, bases, places = (np.array([e[i] for u in uses.values() for e in u], np.int64) for i in range(3))
    begin = np.cumsum(times) - times
    first = np.zeros(capacity + 1, np.int64)
    first[lengths[::-1]] = begin[::-1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = first[batch.column("length").to_numpy()] + batch.column("nth").to_numpy()
            use = np.searchsorted(begin, at, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "piece", "length")), pa.array(bases[use] + at - begin[use]), pa.array(places[use].astype(np.int32))], names=["id", "piece", "length", "container", "place"])

    return _numbered(items, int(counts.sum())).mapInArrow(assign, "id bigint, piece int, length int, container bigint, place int")


def packed_documents(documents: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """Containers of tokens for the texts of documents: doc_id, piece, first_token, tokens, container, place."""
    sizes = stage(token_counts(documents, path).toDF("id", "size"))
    return fill(sizes, capacity).select(F.col("id").alias("doc_id"), "piece", (F.col("piece") * capacity).cast("bigint").alias("first_token"), F.col("length").alias("tokens"), "container", "place")


def packing_summary(documents: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """One row: containers, tokens, the least possible number of containers, and the share of places used."""
    total = packed_documents(documents, capacity, path).agg(F.countDistinct("container").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return total.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("at_least"), (F.col("tokens") / (F.greatest("containers", F.lit(1)) * capacity)).alias("filled"))
