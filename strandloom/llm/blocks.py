"""Blocks of letters: many records' runs of A, C, G, T, two bits a letter, in one row.

A block is the unit that the anchor operators carry through a shuffle: a few rows of packed
arrays instead of a row for each window. Long runs are cut with an overlap, so a block has a
bounded size whatever the length of a record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.packed import NONE, joined_codes, pack, unpack
from ..runtime import spread

#: Letters in a block, about; a run longer than that is cut.
BLOCK_LETTERS = 1 << 21

SCHEMA = "block bigint, rid array<bigint>, at array<bigint>, len array<bigint>, data binary"
_ARROW = pa.schema([("block", pa.int64()), ("rid", pa.list_(pa.int64())), ("at", pa.list_(pa.int64())), ("len", pa.list_(pa.int64())), ("data", pa.binary())])


def runs_of(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of letters that are ``least`` long or longer."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], codes == NONE, [True])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    keep = end - start >= least
    return start[keep], end[keep]


def cut(start: np.ndarray, end: np.ndarray, longest: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut longer runs into pieces that overlap, so that every window of overlap + 1 is whole in one."""
    if not len(start) or (end - start).max() <= longest:
        return start, end
    step = longest - overlap
    pieces = np.maximum(1, -(-(end - start - overlap) // step))
    which = np.repeat(np.arange(len(start)), pieces)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    s = start[which] + nth * step
    return s, np.minimum(s + longest, end[which])


def letter_blocks(records: DataFrame, window: int) -> DataFrame:
    """Blocks of the runs of at least ``window`` letters in ``records`` (rid, seq).

    Null, empty and too short ``seq`` and null ``rid`` give nothing. A record that is
    delivered twice is in the blocks twice, under the same rid.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rids: list[np.ndarray] = []
        ats: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        letters: list[np.ndarray] = []
        held = made = 0
        task = TaskContext.get().partitionId()

        def flush():
            nonlocal held, made
            row = [[(task << 32) + made], [np.concatenate(rids)], [np.concatenate(ats)], [np.concatenate(lens)], [pack(np.concatenate(letters))]]
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _ARROW)], schema=_ARROW)
            for x in (rids, ats, lens, letters):
                x.clear()
            held, made = 0, made + 1
            return out

        for batch in batches:
            seqs, keys = batch.column("seq").to_pylist(), batch.column("rid").to_pylist()
            size = np.fromiter((len(s or "") + 1 for s in seqs), np.int64, len(seqs))
            part = np.cumsum(size) // BLOCK_LETTERS
            for lo, hi in _groups(part):
                codes, first = joined_codes(seqs[i] if keys[i] is not None else None for i in range(lo, hi))
                start, end = cut(*runs_of(codes, window), BLOCK_LETTERS, window - 1)
                if not len(start):
                    continue
                row = np.searchsorted(first, start, "right") - 1
                key = np.fromiter((-1 if k is None else k for k in keys[lo:hi]), np.int64, hi - lo)
                for b, e in _groups(np.cumsum(end - start) // BLOCK_LETTERS):
                    rids.append(key[row[b:e]])
                    ats.append(start[b:e] - first[row[b:e]])
                    lens.append(end[b:e] - start[b:e])
                    letters.extend(codes[s:t] for s, t in zip(start[b:e], end[b:e]))
                    held += int(lens[-1].sum())
                    if held >= BLOCK_LETTERS // 2:
                        yield flush()
        if held:
            yield flush()

    return spread(records.select("rid", "seq")).mapInArrow(make, SCHEMA)


def _groups(part: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal values in a sorted array."""
    if not len(part):
        return []
    at = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
    return list(zip(at[:-1].tolist(), at[1:].tolist()))


class Block:
    """A block's arrays in a task."""

    def __init__(self, rid, at, length, data: bytes):
        self.rid, self.at, self.len = (np.asarray(x, np.int64) for x in (rid, at, length))
        self.end = np.cumsum(self.len)
        self.start = self.end - self.len
        self.codes = unpack(data, int(self.end[-1]))

    @classmethod
    def each(cls, batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            yield cls(*(batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("rid", "at", "len")), batch.column("data")[i].as_py())

    def run(self, p: np.ndarray) -> np.ndarray:
        """The run that each position is in."""
        return np.searchsorted(self.end, p, "right")


def merged(rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching intervals of the same rid put together."""
    if not len(rid):
        return rid, start, end
    order = np.lexsort((start, rid))
    rid, start, end = rid[order], start[order], end[order]
    rank = np.cumsum(np.concatenate(([0], rid[1:] != rid[:-1])))
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + rank * far)
    new = np.concatenate(([True], (start + rank * far)[1:] > reach[:-1]))
    new[1:] |= rank[1:] != rank[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(rid)])) - 1
    return rid[first], start[first], reach[last] - rank[last] * far
