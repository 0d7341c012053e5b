"""k-mers of records: windows, canonical forms, sets, counts, membership."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import packed
from ..functions.letters import from_number, is_valid, reverse_complement, to_number
from ..runtime import spread, unsent

#: Letters of a text that are cut into windows at a time, and windows that leave a task together.
CHUNK, SENT = 1 << 20, 1 << 15
#: Positions in which runs are found at a time; runs that touch at the edges are put together afterwards.
BLOCK = 1 << 16
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[ord("a") : ord("z") + 1] -= 32
_OTHER = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"ACGTacgt", b"TGCATGCA"):
    _OTHER[_a] = _b


def _k(k: int | str) -> Column:
    return F.lit(k) if isinstance(k, int) else F.col(k)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as texts of one length."""
    n, k = rows.shape
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, (n + 1) * k, k, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows)))


def _pieces(seqs: list[str], k: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Bytes of joined texts in pieces that overlap by k - 1, the place of each piece, and where the texts start. A text is walked once, however long."""
    raw = np.frombuffer(("\n".join(seqs) + "\n").encode("ascii", "replace"), np.uint8)
    first = np.concatenate(([0], np.cumsum(np.fromiter((len(s) + 1 for s in seqs), np.int64, len(seqs)))))
    for at in range(0, len(raw) - k + 1, CHUNK):
        yield raw[at : at + CHUNK + k - 1], at, first


def _text_groups(seqs: list[str]) -> list[tuple[int, int]]:
    """Ranges of texts of about a chunk of letters together."""
    part = np.cumsum(np.fromiter(map(len, seqs), np.int64, len(seqs))) // CHUNK
    edge = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(seqs)])) if len(seqs) else [0]
    return list(zip(edge[:-1], edge[1:]))


def windows(records: DataFrame, k: int | str, *keys: str, both_strands: bool = True, texts: str = "uc") -> DataFrame:
    """Every window of k letters of ``seq``: keys, pos (from 0), u (upper case), c (canonical), up (first letter is upper case).

    k is a number or a column, without a limit. Anything but ACGT in either case breaks windows. Null, empty and short texts give none. Of u and c
    only those named in ``texts`` are made.
    """
    keys = keys or ("rid",)
    extra = [k] if isinstance(k, str) and k not in keys else []
    kinds = dict(records.dtypes)
    fields = [f"`{c}` {kinds[c]}" for c in (*keys, *extra)] + ["pos bigint", *(f"{x} string" for x in texts), "up boolean"]
    names = [*keys, *extra, "pos", *texts, "up"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.full(batch.num_rows, k) if isinstance(k, int) else batch.column(k).to_numpy()
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                seqs = batch.column("seq").take(pa.array(rows)).to_pylist()
                for lo, hi in _text_groups(seqs):
                    for raw, begin, first in _pieces(seqs[lo:hi], size):
                        yield from of_piece(batch, rows[lo:hi], raw, begin, first, size)

    def of_piece(batch, rows, raw, begin, first, size):
        every = np.flatnonzero(packed.whole(packed.CODE[raw], size))
        upper, other = _UPPER[raw], _OTHER[raw]
        ahead, back = (np.lib.stride_tricks.sliding_window_view(x, size) for x in (upper, other))
        for i in range(0, len(every), SENT):
            at = every[i : i + SENT]
            owner = np.searchsorted(first, at + begin, "right") - 1
            u = ahead[at]
            out = {"pos": pa.array(at + begin - first[owner]), "up": pa.array(raw[at] < ord("a")), "u": None, "c": None}
            if "u" in texts:
                out["u"] = _fixed(u)
            if "c" in texts:
                c = u
                if both_strands:
                    r = back[at][:, ::-1]
                    differ = (u != r).argmax(1)
                    row = np.arange(len(at))
                    c = np.where((r[row, differ] < u[row, differ])[:, None], r, u)
                out["c"] = _fixed(c)
            taken = pa.array(rows[owner])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in (*keys, *extra)), *(out[c] for c in names[len(keys) + len(extra) :])], names=names)

    return spread(records.select(*keys, *extra, "seq")).where((F.length("seq") >= _k(k)) & (_k(k) > 0)).mapInArrow(cut, ", ".join(fields))


def kmer_set(records: DataFrame, k: int, *keys: str, both_strands: bool = True, upper_only: bool = False) -> DataFrame:
    """The distinct canonical k-mers of records: keys (none: of all together), c. Up to 31 letters they are numbers until they are distinct."""
    if k <= 31 and len(keys) <= 1:
        rows = counted(records, k, *keys, both_strands=both_strands)
        return (rows.where("up") if upper_only else rows).select(*keys, from_number("number", k).alias("c"))
    w = windows(records, k, *(keys or ("rid",)), both_strands=both_strands, texts="c")
    return (w.where("up") if upper_only else w).select(*keys, "c").distinct()


def with_complements(kmers: DataFrame) -> DataFrame:
    """Every k-mer and its reverse complement, as a multiset: u."""
    return kmers.select(F.col("c").alias("u")).unionAll(kmers.select(reverse_complement("c").alias("u")))


def without_repeats(kmers: DataFrame, k: int) -> DataFrame:
    """A multiset u with each k-mer once, for even k a palindrome up to twice."""
    most = F.when((F.lit(k) % 2 == 0) & (F.col("u") == reverse_complement("u")), 2).otherwise(1)
    counted = kmers.groupBy("u").agg(F.count("*").alias("n"))
    return counted.select("u", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), most))).alias("i")).select("u")


def frequent(records: DataFrame, k: int, least: int, *keys: str) -> DataFrame:
    """Canonical k-mers that occur at least so often: keys, c, n."""
    if k <= 31 and len(keys) <= 1:
        return counted(records, k, *keys).where(F.col("n") >= least).select(*keys, from_number("number", k).alias("c"), "n")
    return windows(records, k, *(keys or ("rid",)), texts="c").groupBy(*keys, "c").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def contained(kmers: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``kmers`` (c) that ``known`` (c) has."""
    return kmers.join(known.select("c").distinct(), "c", "left_semi")


def erased(kmers: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``kmers`` (c) that ``known`` (c) doesn't have."""
    return kmers.join(known.select("c").distinct(), "c", "left_anti")


def marked(records: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """The distinct canonical k-mers of records, k <= 31, and whether ``known`` (c) has each: c, known. One join of numbers; known k-mers of other lengths and nulls match nothing."""
    old = known.where((F.length("c") == k) & is_valid("c")).select(to_number("c").alias("number")).distinct().withColumn("known", F.lit(True))
    found = counted(records, k).select("number").join(old, "number", "left")
    return found.select(from_number("number", k).alias("c"), F.coalesce("known", F.lit(False)).alias("known"))


def one_of_each_pair(kmers: DataFrame) -> DataFrame:
    """Of k-mers u, one of each complementary pair: the smaller."""
    return kmers.select(F.least("u", reverse_complement("u")).alias("u")).distinct()


def complement_pairs(kmers: DataFrame) -> DataFrame:
    """The k-mers u whose reverse complement is there too: u (the smaller), v (the reverse complement). A palindrome is its own."""
    sides = kmers.select("u", reverse_complement("u").alias("v")).distinct()
    both = sides.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count("*").alias("n"))
    return both.where((F.col("n") == 2) | (F.col("u") == F.col("v"))).select("u", "v")


def having_prefix(kmers: DataFrame, d: int) -> DataFrame:
    """k-mers u whose last d letters are the first d of another row or their own."""
    return kmers.withColumn("x", F.right("u", F.lit(d))).join(unsent(kmers.select(F.left("u", F.lit(d)).alias("x")).distinct()), "x", "left_semi").select("u")


def by_prefix(kmers: DataFrame, letters: int = 4, parts: int | None = None) -> DataFrame:
    """k-mers u dealt to partitions by ranges of their first letters, for locality only."""
    key = F.left("u", F.lit(letters))
    return kmers.repartitionByRange(parts, key) if parts else kmers.repartitionByRange(key)


def first_windows(records: DataFrame, k: int, both_strands: bool = True) -> DataFrame:
    """Where each canonical k-mer stands first, in the order of (rid, pos): rid, pos, c. A frequent k-mer is combined before the shuffle."""
    if k <= 31:
        return first_positions(records, k, both_strands).select("rid", "pos", from_number("number", k).alias("c"))
    w = windows(records, k, both_strands=both_strands, texts="c")
    return w.groupBy("c").agg(F.min(F.struct("rid", "pos")).alias("at")).select("at.rid", "at.pos", "c")


def first_positions(records: DataFrame, k: int, both_strands: bool = True) -> DataFrame:
    """``first_windows`` with k-mers as numbers, k <= 31: number, rid, pos. A k-mer leaves a batch once."""
    if not 0 < k <= 31:
        raise ValueError("k of 1 to 31; longer k-mers are strings, see first_windows")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, rids = batch.column("seq").to_pylist(), batch.column("rid").to_numpy()
            for lo, hi in _text_groups(seqs):
                for raw, begin, first in _pieces(seqs[lo:hi], k):
                    codes = packed.CODE[raw]
                    at = np.flatnonzero(packed.whole(codes, k))
                    number = (packed.canonical if both_strands else packed.windows)(codes, k)[at]
                    owner = np.searchsorted(first, at + begin, "right") - 1
                    rid, pos = rids[lo:hi][owner], at + begin - first[owner]
                    order = np.lexsort((pos, rid, number))
                    order = order[np.concatenate(([True], np.diff(number[order]) != 0))[: len(order)]]
                    yield pa.RecordBatch.from_arrays([pa.array(number[order].view(np.int64)), pa.array(rid[order]), pa.array(pos[order])], names=["number", "rid", "pos"])

    rows = spread(records.select(F.col("rid").cast("bigint").alias("rid"), "seq")).where((F.length("seq") >= k) & F.col("rid").isNotNull()).mapInArrow(find, "number bigint, rid bigint, pos bigint")
    return rows.groupBy("number").agg(F.min(F.struct("rid", "pos")).alias("at")).select("number", "at.rid", "at.pos")


def in_blocks(rows: DataFrame, keys: list[str], at: str = "pos") -> DataFrame:
    """``rows`` with the block of each position and a number that consecutive positions of a block share: _b, _g. Positions are distinct within keys."""
    rows = rows.withColumn("_b", F.floor(F.col(at) / BLOCK))
    return rows.withColumn("_g", F.col(at) - F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(at)))


def block_runs(rows: DataFrame, keys: list[str], at: str = "pos") -> DataFrame:
    """Of ``in_blocks``: keys, _b, _g, and the first and last position of the run that these are part of, over the edges of blocks.

    Only runs at the edges, two a block at most, are sorted by key.
    """
    parts = rows.groupBy(*keys, "_b", "_g").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    edge = (F.col("first") % BLOCK == 0) | ((F.col("last") + 1) % BLOCK == 0)
    by = Window.partitionBy(*keys).orderBy("first")
    some = parts.where(edge).withColumn("_n", F.when(F.lag("last").over(by) + 1 == F.col("first"), 0).otherwise(1)).withColumn("_n", F.sum("_n").over(by))
    run = Window.partitionBy(*keys, "_n")
    some = some.withColumn("_f", F.min("first").over(run)).withColumn("_l", F.max("last").over(run))
    return parts.where(~edge).unionByName(some.select(*keys, "_b", "_g", F.col("_f").alias("first"), F.col("_l").alias("last")))


def islands(rows: DataFrame, keys: list[str], at: str = "pos") -> DataFrame:
    """Runs of consecutive positions: keys, first, last. Found in blocks of positions, so one key may hold any number of them."""
    return block_runs(in_blocks(rows.select(*keys, at), keys, at), keys, at).select(*keys, "first", "last").distinct()


def counted(records: DataFrame, k: int, key: str | None = None, both_strands: bool = True) -> DataFrame:
    """k-mers as numbers, k <= 31, with their counts: key, number, n, up (a window with an upper-case start is among them).

    Windows are taken from whole batches at once and combined before the shuffle; a frequent k-mer leaves a batch once.
    """
    return counted_in_batches(records, k, key, both_strands).groupBy(*([key] if key else []), "number").agg(F.sum("n").alias("n"), F.max("up").alias("up"))


def counted_in_batches(records: DataFrame, k: int, key: str | None = None, both_strands: bool = True) -> DataFrame:
    """The rows of ``counted`` as they leave the tasks: a k-mer has one for each batch (and key) that holds it. No shuffle, so streams can take it too."""
    if not 0 < k <= 31:
        raise ValueError("k of 1 to 31; longer k-mers are strings, see windows")
    kind = dict(records.dtypes)[key] if key else None
    fields = ([f"{key} {kind}"] if key else []) + ["number bigint", "n bigint", "up boolean"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column("seq").to_pylist()
            groups = batch.column(key).dictionary_encode() if key else None
            group = np.nan_to_num(groups.indices.to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(np.int32) if key else None
            for raw, begin, first, lo in ((*x, lo) for lo, hi in _text_groups(seqs) for x in _pieces(seqs[lo:hi], k)):
                codes = packed.CODE[raw]
                at = np.flatnonzero(packed.whole(codes, k))
                number = (packed.canonical if both_strands else packed.windows)(codes, k)[at]
                where = group[lo + np.searchsorted(first, at + begin, "right") - 1] if key else None
                order = np.lexsort((number, where)) if key else np.argsort(number)
                number, up = number[order], raw[at[order]] < ord("a")
                new = np.concatenate(([True], number[1:] != number[:-1]))[: len(number)]
                if key:
                    where = where[order]
                    new[1:] |= where[1:] != where[:-1]
                begin = np.flatnonzero(new)
                if not len(begin):
                    continue
                out = [pa.array(number[begin].view(np.int64)), pa.array(np.diff(np.append(begin, len(number)))), pa.array(np.logical_or.reduceat(up, begin))]
                names = groups.dictionary.take(pa.array(where[begin], mask=where[begin] < 0)) if key else None
                yield pa.RecordBatch.from_arrays([names, *out] if key else out, names=[key, "number", "n", "up"] if key else ["number", "n", "up"])

    return spread(records.select(*([key] if key else []), "seq").where(F.length("seq") >= k)).mapInArrow(count, ", ".join(fields))
