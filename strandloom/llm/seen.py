"""Problem 3: has this key been seen before?

Keys are dealt to buckets by hash. What a bucket has seen is kept as sealed parts: a minimal perfect hash of the part's keys
and one fingerprint a key, 4.4 bytes a key in place of the keys. ``sealed`` makes the parts of the earlier keys, a table by bucket.

New rows come to their bucket in order of arrival, a batch at a time: each key of the batch is looked up in the sealed parts (slot
by the perfect hash, then the fingerprint), an exact set answers within the batch, and the batch's new keys are sealed as one more part.
So a task holds the sealed parts and one batch, never the earlier keys. ``seen_in_store`` keeps the parts in a folder between runs: later
batches are answered from the parts alone.

A key in a sealed part is always found. One that isn't is taken for seen with chance 2^-bits for each
part; ``seen_rate`` measures that against the exact answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.packed import CODE, NONE, mix64
from ..runtime import buckets_for, by_bucket, spread, stage

#: Rows of a bucket that are looked up and sealed together; keys of a part that is made of earlier keys.
BATCH, PART = 1 << 15, 1 << 20
_ROWS = "bucket int, kind tinyint, key bigint, arrival bigint"
_SEALED, _NEW, _SEEN = 0, 1, 2
_OUT = "bucket int, arrival bigint, sealed binary"
_OUT_ARROW = pa.schema([("bucket", pa.int32()), ("arrival", pa.int64()), ("sealed", pa.binary())])


class Sealed:
    """A set of keys as a minimal perfect hash and fingerprints.

    Level by level, the keys that are alone in their slot are placed; the others go to the next
    level. A key's number is the count of placed slots before its own.
    """

    def __init__(self, keys: np.ndarray, bits: int = 32):
        self.bits, self.levels, n = bits, [], 0
        self.prints = np.zeros(len(keys), _kind(bits))
        level = 0
        while len(keys):
            slots = -(-2 * len(keys) // 64) * 64
            at = self._slot(keys, level, slots)
            alone = np.bincount(at, minlength=slots) == 1
            self._add(np.packbits(alone, bitorder="little").view(np.uint64), n)
            placed = alone[at]
            self.prints[self._number(at[placed], level)] = self._print(keys[placed])
            n, keys, level = n + int(placed.sum()), keys[~placed], level + 1

    def _add(self, words: np.ndarray, n: int) -> int:
        """One more level, before which n keys are placed; how many are after it."""
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
        self.levels.append((64 * len(words), words, n + before[:-1]))
        return n + int(before[-1])

    @classmethod
    def load(cls, data: bytes) -> Sealed:
        """What ``dump`` wrote."""
        bits, levels = np.frombuffer(data, np.int64, 2)
        sizes = np.frombuffer(data, np.int64, levels, 16)
        out = cls(np.zeros(0, np.uint64), int(bits))
        at, n = 16 + 8 * int(levels), 0
        for size in sizes.tolist():
            n = out._add(np.frombuffer(data, np.uint64, size, at), n)
            at += 8 * size
        out.prints = np.frombuffer(data, _kind(int(bits)), n, at)
        return out

    def dump(self) -> bytes:
        """Bits, number of levels and their sizes, the levels' words, the fingerprints."""
        head = np.array([self.bits, len(self.levels), *(len(w) for _, w, _ in self.levels)], np.int64)
        return b"".join([head.tobytes(), *(w.tobytes() for _, w, _ in self.levels), self.prints.tobytes()])

    @staticmethod
    def _slot(keys, level, slots):
        return (mix64(keys + np.uint64(0x632BE59BD9B4E019 * (level + 1) & (1 << 64) - 1)) % np.uint64(slots)).astype(np.int64)

    def _print(self, keys):
        return (mix64(keys ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - self.bits)).astype(_kind(self.bits))

    def _number(self, at, level):
        _, words, before = self.levels[level]
        below = words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return before[at >> 6] + np.bitwise_count(below)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found, left = np.zeros(len(keys), bool), np.arange(len(keys))
        for level, (slots, words, _) in enumerate(self.levels):
            at = self._slot(keys[left], level, slots)
            here = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            mine = left[here]
            found[mine] = self.prints[self._number(at[here], level)] == self._print(keys[mine])
            left = left[~here]
            if not len(left):
                break
        return found


def _kind(bits: int):
    """The numbers that hold fingerprints of so many bits."""
    if not 0 < bits <= 32:
        raise ValueError("fingerprints of 1 to 32 bits")
    return np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32


def keys_of(values: pa.Array, k: int = 31) -> tuple[np.ndarray, np.ndarray]:
    """Canonical k-mers as numbers, and which rows have one.

    Outer white space and case don't matter; what isn't then k letters of ACGT has no key.
    """
    text = pc.utf8_upper(pc.utf8_trim_whitespace(values))
    fits = pc.fill_null(pc.equal(pc.binary_length(text), k), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    text = text.filter(fits)
    _, offsets, data = text.buffers()
    first = np.frombuffer(offsets, np.int32)[text.offset] if len(text) else 0
    codes = CODE[np.frombuffer(data or b"", np.uint8)[first : first + k * len(text)]].reshape(-1, k)
    good = (codes != NONE).all(1)
    columns = np.ascontiguousarray(codes[good].T).astype(np.uint64)
    forward, back = np.zeros(columns.shape[1], np.uint64), np.zeros(columns.shape[1], np.uint64)
    for i in range(k):
        forward = forward << np.uint64(2) | columns[i]
        back = back << np.uint64(2) | np.uint64(3) - columns[k - 1 - i]
    return np.minimum(forward, back), rows[good]


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix64(x) >> np.uint64(33)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int32)


def _rows(bucket, kind, key, arrival) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(np.broadcast_to(np.int8(kind), len(bucket)) if np.isscalar(kind) else kind, pa.int8()), pa.array(key.view(np.int64)), pa.array(arrival, pa.int64())], names=["bucket", "kind", "key", "arrival"])


def _dealt(stream: DataFrame, buckets: int) -> DataFrame:
    """Rows for the buckets. A row whose key came earlier in the same batch of input is settled here; so a frequent key comes once a batch."""

    def new(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("arrival").is_valid())
            key, rows = keys_of(batch.column("value"))
            arrival = batch.column("arrival").to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            order = np.lexsort((arrival, key))
            key, arrival = key[order], arrival[order]
            first = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
            begin = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0)) if len(key) else first
            seen = arrival > arrival[begin]
            keep = first | seen
            key, arrival, seen = key[keep], arrival[keep], seen[keep]
            yield _rows(_bucket(np.where(seen, arrival.view(np.uint64), key), buckets), np.where(seen, _SEEN, _NEW).astype(np.int8), key, arrival)

    return spread(stream.select("arrival", "value")).mapInArrow(new, _ROWS)


def sealed(known: DataFrame, buckets: int, bits: int = 32, part: int = PART) -> DataFrame:
    """Sealed parts of the keys in ``known`` (c): bucket, sealed. A part holds up to ``part`` keys, so a bucket of any size is sealed in bounded memory.

    Rows without a key (null, empty, not 31 letters of ACGT) are left out; repeated keys change nothing; no keys, no rows.
    """

    def old(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.unique(keys_of(batch.column("c"))[0])
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(key, buckets)), pa.array(key.view(np.int64))], names=["bucket", "key"])

    def seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, bucket = [], 0, None
        for batch in batches:
            for lo in range(0, batch.num_rows, part):
                held.append(batch.column("key").slice(lo, part).to_numpy().view(np.uint64))
                count, bucket = count + len(held[-1]), batch.column("bucket")[0].as_py()
                if count >= part:
                    yield one(bucket, held)
                    held, count = [], 0
        if count:
            yield one(bucket, held)

    def one(bucket, held):
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([Sealed(np.unique(np.concatenate(held)), bits).dump()], pa.binary())], names=["bucket", "sealed"])

    return by_bucket(known.select("c").mapInArrow(old, "bucket int, key bigint"), buckets, "bucket").applyInArrow(seal, "bucket int, sealed binary")


def _settled(stream: DataFrame, parts: DataFrame, buckets: int, bits: int, batch: int) -> DataFrame:
    """bucket, arrival, sealed: the arrivals that are seen (an arrival may come twice), and the parts of the new keys."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bucket = [], None
        key, arrival = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for rows in batches:
            if not rows.num_rows:
                continue
            bucket = rows.column("bucket")[0].as_py()
            kind = rows.column("kind").to_numpy()
            known += [Sealed.load(x.as_py()) for x in rows.column("sealed").filter(pa.array(kind == _SEALED))]
            came = rows.column("arrival").to_numpy(zero_copy_only=False)
            if (kind == _SEEN).any():
                yield answer(bucket, came[kind == _SEEN].astype(np.int64))
            fresh = rows.filter(pa.array(kind == _NEW))
            for lo in range(0, fresh.num_rows, batch):
                more = fresh.slice(lo, batch)
                key = np.concatenate((key, more.column("key").to_numpy().view(np.uint64)))
                arrival = np.concatenate((arrival, more.column("arrival").to_numpy()))
                done = int(np.searchsorted(arrival, arrival[-1], "left"))  # the last arrival may have more rows
                if len(key) >= batch and done:
                    yield from step(bucket, known, key[:done], arrival[:done])
                    key, arrival = key[done:], arrival[done:]
        if len(key):
            yield from step(bucket, known, key, arrival)

    def step(bucket, known, key, arrival):
        mine, first, back = np.unique(key, return_index=True, return_inverse=True)
        before = np.zeros(len(mine), bool)
        for part in known:
            before |= part.has(mine)
        yield answer(bucket, np.unique(arrival[before[back] | (arrival > arrival[first][back])]))
        if not before.all():
            known.append(Sealed(mine[~before], bits))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([None], pa.int64()), pa.array([known[-1].dump()], pa.binary())], schema=_OUT_ARROW)

    def answer(bucket, arrivals):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(arrivals), bucket, np.int32)), pa.array(arrivals), pa.nulls(len(arrivals), pa.binary())], schema=_OUT_ARROW)

    none = F.lit(None)
    rows = _dealt(stream, buckets).withColumn("sealed", none.cast("binary"))
    rows = rows.unionByName(parts.select("bucket", F.lit(_SEALED).cast("tinyint").alias("kind"), none.cast("bigint").alias("key"), none.cast("bigint").alias("arrival"), "sealed"))
    dealt = rows.repartition(max(buckets // 2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "bucket").sortWithinPartitions("bucket", "kind", "arrival")
    return dealt.groupBy("bucket").applyInArrow(settle, _OUT)


def _buckets(stream: DataFrame, known: DataFrame) -> int:
    """Buckets by the size of both tables: the sealed parts of one are a few MB."""
    return max(buckets_for(stream, 16 << 20), buckets_for(known, 64 << 20))


def seen_before(stream: DataFrame, known: DataFrame, bits: int = 32, batch: int = BATCH) -> DataFrame:
    """The rows of ``stream`` (arrival, value) whose key is in ``known`` (c) or came at a smaller arrival: arrival, distinct.

    Rows without a key (null, empty, not 31 letters of ACGT between outer white space) or without an arrival take no part;
    repeated rows (same arrival and key) are one row; either table may be empty; other columns are ignored.
    """
    buckets = _buckets(stream, known)
    parts = stage(sealed(known, buckets, bits))
    return _settled(stream, parts, buckets, bits, batch).where("arrival is not null").select("arrival").distinct()


def seen_in_store(stream: DataFrame, store: str, generation: int, buckets: int = 1024, bits: int = 32, batch: int = BATCH) -> DataFrame:
    """As ``seen_before``, against the sealed parts that earlier generations left in the folder ``store``; this one's new keys are added to it.

    Generations are numbered in order of arrival (a batch id of a stream, say); parts of this or a later number are replaced or not read, so a run that
    failed can be repeated. ``buckets`` and ``bits`` must stay the same. ``sealed`` keys may be written there beforehand as generation 0. The rows returned are read from a staged table.
    """
    spark = stream.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(store)
    there = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
    parts = spark.read.schema("bucket int, sealed binary, generation bigint").parquet(store).where(F.col("generation") < generation) if there else spark.createDataFrame([], "bucket int, sealed binary")
    done = stage(_settled(stream, parts, buckets, bits, batch))
    done.where("sealed is not null").select("bucket", "sealed").write.mode("overwrite").parquet(f"{store.rstrip('/')}/generation={generation}")
    return done.where("arrival is not null").select("arrival").distinct()


def seen_rate(stream: DataFrame, known: DataFrame, bits: int = 32, batch: int = BATCH) -> DataFrame:
    """One row: rows answered as seen, rows looked up, wrong answers among them, and their rate.

    The exact answer is made beside the sealed parts by grouping all keys; only this measurement needs them.
    """
    answered = seen_before(stream, known, bits, batch).select("arrival", F.lit(1).alias("answered"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column("arrival").is_valid())
            key, rows = keys_of(b.column("value"))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("arrival").take(pa.array(rows))], names=["key", "arrival"])

    columns = "key bigint, arrival bigint"
    rows = spread(stream.select("arrival", "value")).mapInArrow(keys, columns).distinct()
    old = known.select(F.lit(None).cast("bigint").alias("arrival"), F.col("c").alias("value"))

    def old_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = np.unique(keys_of(b.column("value"))[0])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.nulls(len(key), pa.int64())], names=["key", "arrival"])

    firsts = rows.unionByName(old.mapInArrow(old_keys, columns)).groupBy("key").agg(F.min("arrival").alias("first"), F.bool_or(F.col("arrival").isNull()).alias("old"))
    exact = rows.join(firsts, "key").groupBy("arrival").agg(F.bool_or(F.col("old") | (F.col("arrival") > F.col("first"))).alias("seen"))
    total = exact.join(answered, "arrival", "left").agg(F.count("answered").alias("seen"), F.count("*").alias("looked_up"), F.count_if(F.col("answered").isNotNull() != F.col("seen")).alias("wrong"))
    return total.withColumn("wrong_rate", F.when(F.col("looked_up") > 0, F.col("wrong") / F.col("looked_up")).otherwise(0.0))
