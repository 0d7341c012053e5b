"""Problem 1: long exact spans shared between records, by difference-cover anchors.

With a difference cover D modulo v, any two positions i and j have a shift s < v at which both
(i + s) mod v and (j + s) mod v are in D. So two equal windows of L letters hold, at the same
offset, an equal anchor of L - v + 1 letters that starts at a cover position in both records.

1. ``letter_blocks``: the records' runs of letters, packed, written to the shared folder.
2. Anchors at cover positions are hashed; each block sends each hash once to the bucket of its
   range, which answers which hashes two different records have.
3. Each shared anchor is sent with the letters that surround it to its bucket, where any two
   occurrences are extended left and right, exactly, by XOR of packed words.
4. Anchors with more occurrences than ``hot`` (copies, low complexity, planted repeats) would
   make too many pairs. There each window over the anchor is hashed, and the blocks' distinct
   window hashes go through step 2 again: a window that two records have is shared. No pairs.
5. The spans of all buckets are merged for each record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packed import mix64, windows
from ..runtime import buckets_for, by_bucket, scanned_bytes, stage
from .blocks import Block, _groups, letter_blocks, merged

#: Perfect difference sets, by their modulus.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52), 73: (0, 1, 3, 7, 15, 31, 36, 54, 63), 91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)}

#: Letters of an anchor in one 64-bit word.
WORD = 30


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """Modulus, cover and anchor length for a window: the largest modulus that leaves an anchor of 30 letters or fewer cover positions."""
    fits = [v for v in COVERS if window - v + 1 >= WORD]
    if not fits:
        raise ValueError(f"min_length {window}: at least {WORD + min(COVERS) - 1} is needed")
    v = max(fits)
    return v, COVERS[v], WORD


def shared_spans(records: DataFrame, min_length: int = 120, hot: int = 64) -> DataFrame:
    """Maximal runs of positions of a record that lie in windows found in other records too.

    ``records`` has rid and seq. Returns rid, start_pos, end_pos (from 0, end exclusive,
    positions of ``seq`` as stored), distinct. Letters are compared ignoring case and on the same strand;
    anything but A, C, G, T ends a window.

    Null or empty ``seq``, null ``rid`` and an empty table give no rows; repeated rows of one rid are one
    record and never match each other; columns besides rid and seq are ignored, whatever their names.
    ``hot`` is no cap: an anchor with more occurrences takes the window-hash way, which is
    exact up to collisions of 64-bit hashes.
    """
    return _merged_spans(_spans(records, min_length, hot))


def shared_parts(records: DataFrame, min_length: int = 120, hot: int = 64) -> DataFrame:
    """For each record with a shared span: rid, spans, shared_letters, longest_span."""
    return shared_spans(records, min_length, hot).groupBy("rid").agg(F.count("*").alias("spans"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_letters"), F.max(F.col("end_pos") - F.col("start_pos")).alias("longest_span"))


def _merged_spans(spans: DataFrame) -> DataFrame:
    by = Window.partitionBy("rid").orderBy("start_pos", "end_pos")
    return (
        spans.withColumn("reach", F.max("end_pos").over(by.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("span", F.sum(F.when(F.col("start_pos") <= F.col("reach"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("rid", "span")
        .agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
        .drop("span")
    )


def _spans(records: DataFrame, window: int, hot: int) -> DataFrame:
    v, cover, w = cover_for(window)
    buckets, width = buckets_for(records, 2 << 20), hash_bytes(scanned_bytes(records))
    blocks = stage(letter_blocks(records, window))

    def anchors(b: Block, _row) -> tuple[np.ndarray, np.ndarray]:
        at, words = _anchors(b, v, cover, w)
        return at, mix64(words[at])

    def over_hot(b: Block, row) -> tuple[np.ndarray, np.ndarray]:
        at, words = _anchors(b, v, cover, w)
        known = np.isin(_short(mix64(words[at]), width), _from_bytes(row("hot"), width))
        return _window_hashes(b, at[known], words, window)

    shared = stage(_shared(blocks, anchors, buckets, width, hot))
    dealt = blocks.repartition(buckets, "block")  # few blocks a task, however many there are
    spans = _extended(dealt.join(_by_block(shared, "normal", buckets), "block"), (v, cover, w), window, buckets, width)
    if not shared.where("hot is not null").isEmpty():
        over = dealt.join(_by_block(shared, "hot", buckets), "block")
        found = _by_block(_shared(over, over_hot, buckets, 8, None), "normal", buckets, "windows")
        spans = spans.unionByName(_window_spans(over.join(found, "block"), over_hot, window))
    return spans


def hash_bytes(size: int) -> int:
    """Bytes of a hash that keep chance hits rare (under one in 500 for random letters) at any size of input."""
    return int(np.clip(np.ceil((np.log2(max(size, 2)) + 9) / 8), 5, 8))


def _anchors(b: Block, v: int, cover, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Cover positions of a block at which a whole anchor starts, and all its windows as numbers."""
    return _cover_positions(b, v, cover, w), windows(b.codes, w)


def _cover_positions(b: Block, v: int, cover, w: int) -> np.ndarray:
    steps = (np.arange(-(-int(b.len.max()) // v))[:, None] * v + np.array(cover)).ravel()
    room = np.searchsorted(steps, b.len - w, "right")
    return np.concatenate([steps[:n] + s for n, s in zip(room.tolist(), b.start.tolist())])


def _window_hashes(b: Block, anchors: np.ndarray, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows of a block that lie over the anchors at given positions."""
    run = b.run(anchors)
    mark = np.zeros(len(b.codes) + 1, np.int32)
    first, last = np.maximum(b.start[run], anchors + WORD - window), np.minimum(b.end[run] - window, anchors)
    some = first <= last
    np.add.at(mark, first[some], 1)
    np.add.at(mark, last[some] + 1, -1)
    at = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for off in [*range(0, window - WORD, WORD), window - WORD]:
            h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + words[at + off])
    return at, h


def _short(h: np.ndarray, width: int) -> np.ndarray:
    """The top bytes of 64-bit hashes."""
    return h >> np.uint64(64 - 8 * width)


def _to_bytes(h: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _from_bytes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _binary(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _in_buckets(h: np.ndarray, width: int, buckets: int) -> list[tuple[int, int, int]]:
    """Bucket, begin and end of the hashes of each bucket that has some, in the sorted ``h``: buckets are ranges of hashes."""
    bucket = (h >> np.uint64(8 * width - 32)) * np.uint64(buckets) >> np.uint64(32)
    return [(int(bucket[lo]), lo, hi) for lo, hi in _groups(bucket)]


def _shared(blocks: DataFrame, hashed, buckets: int, width: int, hot: int | None) -> DataFrame:
    """Which hashes of each block another record has too: block, normal, hot (bytes of hashes).

    ``hashed`` gives a block's positions and hashes. A block sends each hash once, with one of its
    records, or with a count where it holds several. So a hash that a third of all rows have comes once from each block.
    """
    sent = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hash", pa.binary()), ("owner", pa.binary()), ("rid", pa.binary()), ("more", pa.binary())])
    back = pa.schema([("block", pa.int64()), ("normal", pa.binary()), ("hot", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, b in enumerate(Block.each(batch)):
                at, h = hashed(b, lambda c, i=i, batch=batch: batch.column(c)[i].as_py())
                if not len(at):
                    continue
                h = _short(h, width)
                order = np.argsort(h)
                h, rid = h[order], b.rid[b.run(at[order])]
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                times = np.diff(np.append(first, len(h)))
                several = np.minimum.reduceat(rid, first) != np.maximum.reduceat(rid, first)
                h, rid, rows = h[first], rid[first], []
                for k, lo, hi in _in_buckets(h, width, buckets):
                    keys, owner = np.unique(rid[lo:hi], return_inverse=True)
                    owner = owner.astype(np.uint16 if len(keys) < 1 << 16 else np.uint32)
                    more = np.flatnonzero(times[lo:hi] > 1)
                    noted = np.stack([more, times[lo:hi][more], several[lo:hi][more]]).astype(np.int32)
                    rows.append((k, batch.column("block")[i].as_py(), _to_bytes(h[lo:hi], width), owner.tobytes(), keys.tobytes(), noted.tobytes()))
                yield _binary(rows, sent)

    def answer(table: pa.Table) -> pa.Table:
        hs, rids, times, several, origin = [], [], [], [], []
        column = {c: table.column(c).to_pylist() for c in table.column_names}
        for i in range(table.num_rows):
            h = _from_bytes(column["hash"][i], width)
            raw = column["owner"][i]
            rids.append(np.frombuffer(column["rid"][i], np.int64)[np.frombuffer(raw, np.uint16 if len(raw) == 2 * len(h) else np.uint32)])
            more = np.frombuffer(column["more"][i], np.int32).reshape(3, -1)
            t, s = np.ones(len(h), np.int64), np.zeros(len(h), bool)
            t[more[0]], s[more[0]] = more[1], more[2] > 0
            hs.append(h), times.append(t), several.append(s), origin.append(np.full(len(h), i, np.int32))
        h, rid, t, s, o = (np.concatenate(x) for x in (hs, rids, times, several, origin))
        order = np.argsort(h)
        h, rid, t, s, o = h[order], rid[order], t[order], s[order], o[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        is_shared = (np.minimum.reduceat(rid, first) != np.maximum.reduceat(rid, first)) | np.logical_or.reduceat(s, first)
        is_hot = is_shared & (np.add.reduceat(t, first) > (hot or 1 << 62))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        keep = is_shared[group]
        h, o, heat = h[keep], o[keep], is_hot[group[keep]]
        order = np.argsort(o, kind="stable")
        h, o, heat = h[order], o[order], heat[order]
        rows, edge = [], np.searchsorted(o, np.arange(table.num_rows + 1))
        for i, block in enumerate(column["block"]):
            mine, warm = h[edge[i] : edge[i + 1]], heat[edge[i] : edge[i + 1]]
            if len(mine):
                rows.append((block, _to_bytes(mine[~warm], width), _to_bytes(mine[warm], width) if warm.any() else None))
        return pa.Table.from_batches([_binary(rows, back)])

    return by_bucket(blocks.mapInArrow(send, "bucket int, block bigint, hash binary, owner binary, rid binary, more binary"), buckets, "bucket").applyInArrow(answer, "block bigint, normal binary, hot binary")


def _by_block(shared: DataFrame, column: str, tasks: int, name: str | None = None) -> DataFrame:
    """The shared hashes of each block in one row; a block's size bounds them."""
    parts = shared.where(f"length({column}) > 0").repartition(tasks, "block").groupBy("block").agg(F.collect_list(column).alias("parts"))
    rows = parts.select("block", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x))").alias(name or column))
    return rows.hint("merge")  # it grows with the records, so it isn't broadcast


def _extended(blocks: DataFrame, cover, window: int, buckets: int, width: int) -> DataFrame:
    """Spans around the shared anchors of ``blocks`` (with their hashes in ``normal``), extended pair by pair."""
    sent = pa.schema([("bucket", pa.int32()), ("key", pa.binary()), ("words", pa.binary()), ("room", pa.binary()), ("rid", pa.binary()), ("pos", pa.binary())])
    around = -(-(window - WORD) // WORD)  # words of letters on either side

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, b in enumerate(Block.each(batch)):
                pad = around * WORD
                at, words = _cover_positions(b, *cover), windows(np.pad(b.codes, pad), WORD)
                h = mix64(words[at + pad])
                known = np.isin(_short(h, width), _from_bytes(batch.column("normal")[i].as_py(), width))
                order = np.argsort(h[known])
                at, h = at[known][order], h[known][order]
                run = b.run(at)
                left = np.minimum(at - b.start[run], window - WORD).astype(np.uint8 if window - WORD < 256 else np.uint16)
                right = np.minimum(b.end[run] - at - WORD, window - WORD).astype(left.dtype)
                beside = np.stack([words[at + pad + d * WORD] for n in range(1, around + 1) for d in (-n, n)], 1)
                room, rid, pos = np.stack([left, right], 1), b.rid[run], (b.at[run] + at - b.start[run]).astype(np.int32)
                rows = []
                for k, lo, hi in _in_buckets(_short(h, width), width, buckets):
                    rows.append((k, h[lo:hi].tobytes(), beside[lo:hi].tobytes(), room[lo:hi].tobytes(), rid[lo:hi].tobytes(), pos[lo:hi].tobytes()))
                yield _binary(rows, sent)

    def extend(table: pa.Table) -> pa.Table:
        read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()])
        key, rid, pos = read("key", np.uint64), read("rid", np.int64), read("pos", np.int32).astype(np.int64)
        words = read("words", np.uint64).reshape(len(key), 2 * around)
        room = read("room", np.uint8 if window - WORD < 256 else np.uint16).reshape(len(key), 2).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, rid, pos, words, room = key[order], rid[order], pos[order], words[order], room[order]
        spans, i, d = [], np.arange(len(key)), 0
        while True:
            d += 1
            i = i[i + d < len(key)]
            i = i[key[i] == key[i + d]]
            if not len(i):
                break
            a = i[rid[i] != rid[i + d]]
            b = a + d
            left, right = np.minimum(room[a], room[b]).T
            left = np.minimum(left, _alike(words[a, 0::2], words[b, 0::2], from_left=False))
            right = np.minimum(right, _alike(words[a, 1::2], words[b, 1::2], from_left=True))
            far = left + right + WORD >= window
            for x in (a[far], b[far]):
                spans.append((rid[x], pos[x] - left[far], pos[x] + WORD + right[far]))
        if spans:
            spans = merged(*(np.concatenate(x) for x in zip(*spans)))
        return pa.table(dict(zip(("rid", "start_pos", "end_pos"), (pa.array(x, pa.int64()) for x in (spans or ([], [], []))))))

    return by_bucket(blocks.mapInArrow(send, "bucket int, key binary, words binary, room binary, rid binary, pos binary"), buckets, "bucket").applyInArrow(extend, "rid bigint, start_pos bigint, end_pos bigint")


def _alike(a: np.ndarray, b: np.ndarray, from_left: bool) -> np.ndarray:
    """How many letters of two rows of words agree, from the anchor outwards."""
    total, going = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for n in range(a.shape[1]):
        x = a[:, n] ^ b[:, n]
        if from_left:
            for shift in (1, 2, 4, 8, 16, 32):
                x |= x >> np.uint64(shift)
            same = (2 * WORD - np.bitwise_count(x).astype(np.int64)) // 2
        else:
            same = np.minimum(np.bitwise_count(~x & (x - np.uint64(1))).astype(np.int64) // 2, WORD)
        total += np.where(going, same, 0)
        going &= same == WORD
    return total


def _window_spans(blocks: DataFrame, hashed, window: int) -> DataFrame:
    """Spans of the windows of ``blocks`` whose hashes are in ``windows``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, b in enumerate(Block.each(batch)):
                at, h = hashed(b, lambda c, i=i, batch=batch: batch.column(c)[i].as_py())
                at = at[np.isin(h, _from_bytes(batch.column("windows")[i].as_py(), 8))]
                run = b.run(at)
                start = b.at[run] + at - b.start[run]
                yield pa.RecordBatch.from_pydict(dict(zip(("rid", "start_pos", "end_pos"), merged(b.rid[run], start, start + window))))

    return blocks.mapInArrow(find, "rid bigint, start_pos bigint, end_pos bigint")
