"""Problem 2: groups of records that differ by small edits, by pigeonring filtering.

The likeness of two records is the Jaccard index of their sets of canonical 15-mers. The hash range is cut into 64 parts, and the
smallest hash of each part is one symbol of a record's signature; two records' symbols agree with a chance of their likeness.
So alike records are near in Hamming distance over 64 symbols.

The symbols are a ring of 32 boxes of two. If at most n symbols differ, a chain of boxes starts somewhere on the ring in which
the first l boxes differ in no more than l * n / 32 symbols, for every l. Each box of each record is a key; with it go the next boxes as
bytes, and two records with an equal box are a candidate only if their chain stays within its budgets. The first box must be equal (budget 0),
though it might differ in n // 32 symbols by the rule above: it is a filter by equal boxes, and pairs without one are lost, with a chance of
(1 - least^2)^32: 6e-7 at a likeness of 0.6, 1e-4 at 0.5. Then come the full
Hamming distance and the exact Jaccard index, both from the records' letters.

Records with equal sets are one class, of which one record stands for all. A key of very many records makes no
pairs of all of them: each is held against the key's first record, and only those that aren't linked to it against the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.packed import NONE, canonical, joined_codes, mix32, mix64, pack, unpack, whole
from ..operators.components import components
from ..runtime import buckets_for, by_bucket, spread, stage
from .blocks import _groups, runs_of
from .spans import _binary

K, SYMBOLS, BOXES, CHAIN = 15, 64, 32, 4
#: Records with fewer distinct k-mers take no part.
LEAST_KMERS = 50
_SIGNED = "rid bigint, set_a bigint, set_b bigint, n int, symbols binary, lens binary, letters binary"


def budget(least: float) -> int:
    """How many symbols may differ: the mean at that likeness and 4.5 standard deviations of the smallest records."""
    return min(SYMBOLS - 1, int(SYMBOLS * (1 - least + 4.5 * (least * (1 - least) / LEAST_KMERS) ** 0.5)))


def chain_budgets(n: int) -> list[int]:
    """Differences allowed in the 1, 2, ... boxes after an equal one."""
    return [(boxes + 1) * n // BOXES for boxes in range(1, CHAIN + 1)]


def _sets(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Distinct (owner, hash of canonical k-mer), sorted, as owner << 32 | hash."""
    at = np.flatnonzero(whole(codes, K))
    h = mix32(canonical(codes, K, np.uint32)[at])
    key = owner[at].astype(np.uint64) << np.uint64(32) | h
    key.sort()
    return key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key


def _symbols(sets: np.ndarray, owners: int) -> np.ndarray:
    """A row of symbols for each owner; an empty part takes the next full part's symbol, marked by the distance."""
    out = np.zeros((owners, SYMBOLS), np.uint32)
    full = np.zeros((owners, SYMBOLS), bool)
    part = (sets >> np.uint64(26)).astype(np.int64)  # owner and the top 6 bits
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else part
    out.reshape(-1)[part[first]] = sets[first].astype(np.uint32)
    full.reshape(-1)[part[first]] = True
    real, seen = out.copy(), full.copy()
    for step in range(1, SYMBOLS):
        if full.all():
            break
        take = ~full & np.roll(seen, -step, 1)
        out[take] = np.roll(real, -step, 1)[take] + np.uint32(step * 0x9E3779B1 & 0xFFFFFFFF)
        full |= take
    return out


def signed(records: DataFrame) -> DataFrame:
    """Each record's set fingerprint, symbols and packed letters; records with too few k-mers are left out."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, rids = batch.column("seq").to_pylist(), batch.column("rid").to_pylist()
            for lo, hi in _groups(np.cumsum(np.fromiter((len(s or "") + 1 for s in seqs), np.int64, len(seqs))) >> 20):
                codes, first = joined_codes(seqs[i] if rids[i] is not None else None for i in range(lo, hi))
                if len(codes) < K:
                    continue
                sets = _sets(codes, np.repeat(np.arange(hi - lo, dtype=np.uint32), np.diff(first)))
                edge = np.searchsorted(sets, np.arange(hi - lo + 1, dtype=np.uint64) << np.uint64(32))
                size = np.diff(edge)
                symbols, rows = _symbols(sets, hi - lo), []
                start, end = runs_of(codes, K)
                at = np.searchsorted(start, first)
                hashes = mix64(sets & np.uint64(0xFFFFFFFF)), mix64(sets & np.uint64(0xFFFFFFFF) | np.uint64(1 << 40))
                for i in np.flatnonzero(size >= LEAST_KMERS).tolist():
                    s, e = start[at[i] : at[i + 1]], end[at[i] : at[i + 1]]
                    letters = np.concatenate([codes[x:y] for x, y in zip(s, e)])
                    one, two = (int(h[edge[i] : edge[i + 1]].sum().view(np.int64)) for h in hashes)
                    rows.append((rids[lo + i], one, two, int(size[i]), symbols[i].tobytes(), (e - s).astype(np.int32).tobytes(), pack(letters)))
                yield _binary(rows, schema)

    schema = pa.schema([("rid", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("n", pa.int32()), ("symbols", pa.binary()), ("lens", pa.binary()), ("letters", pa.binary())])
    return spread(records.select("rid", "seq")).mapInArrow(sign, _SIGNED)


def _within(a: np.ndarray, b: np.ndarray, budgets: list[int]) -> np.ndarray:
    """Whether the chains behind two equal boxes stay within their budgets."""
    differ = (a ^ b).view(np.uint8).reshape(-1, CHAIN, 2) != 0
    return (np.cumsum(differ.sum(2), 1) <= np.array(budgets)).all(1)


def _within_sql(a, b, budgets: list[int]):
    """``_within`` of two columns."""
    x, total, ok = a.bitwiseXOR(b), F.lit(0), F.lit(True)
    for i, most in enumerate(budgets):
        for j in (2 * i, 2 * i + 1):
            total = total + (F.shiftrightunsigned(x, 8 * j).bitwiseAND(F.lit(255)) != 0).cast("int")
        ok = ok & (total <= most)
    return ok


def _candidates(signs: DataFrame, least: float, buckets: int, hot: int) -> DataFrame:
    """kind 0: pairs (a, b) whose chains fit. kind 1: rows of hot keys (key a, record b, chain)."""
    budgets = chain_budgets(budget(least))
    sent = pa.schema([("bucket", pa.int32()), ("hot", pa.bool_()), ("key", pa.binary()), ("rid", pa.binary()), ("chain", pa.binary())])
    local = max(2, hot // 4)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            symbols = np.frombuffer(b"".join(batch.column("symbols").to_pylist()), np.uint32).reshape(-1, BOXES, 2).astype(np.uint64)
            key = mix64(mix64(symbols[:, :, 0] << np.uint64(32) | symbols[:, :, 1]) + np.arange(BOXES, dtype=np.uint64))
            short = (mix64(symbols) & np.uint64(255)).astype(np.uint8)
            after = np.stack([np.roll(short, -i, 1) for i in range(1, CHAIN + 1)], 2)
            chain = np.ascontiguousarray(after).reshape(len(symbols), BOXES, 2 * CHAIN).view(np.uint64)[:, :, 0].ravel()
            rid = np.repeat(batch.column("rep").to_numpy(), BOXES)
            order = np.argsort(key.ravel())
            key, rid, chain = key.ravel()[order], rid[order], chain[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            count = np.diff(np.append(first, len(key)))
            many = np.repeat(count > local, count)
            rows = []
            # rows of a key that is frequent in this batch needn't meet here: they are dealt evenly, the first tells the key's bucket
            told = np.flatnonzero(many & np.concatenate(([True], key[1:] != key[:-1])))
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            spot = np.where(many, (mix64(rid.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), bucket)
            for warm, pick in ((False, np.flatnonzero(~many)), (True, np.flatnonzero(many))):
                pick = pick[np.argsort(spot[pick], kind="stable")]
                for lo, hi in _groups(spot[pick]):
                    x = pick[lo:hi]
                    rows.append((int(spot[x[0]]), warm, key[x].tobytes(), rid[x].tobytes(), chain[x].tobytes()))
            for x in told:
                rows.append((int(bucket[x]), True, key[x : x + 1].tobytes(), b"", b""))
            yield _binary(rows, sent)

    def meet(table: pa.Table) -> pa.Table:
        warm = table.column("hot").to_numpy(zero_copy_only=False)
        read = lambda c, kind, rows: np.concatenate([np.zeros(0, kind)] + [np.frombuffer(x, kind) for x, w in zip(table.column(c).to_pylist(), warm) if w == rows])
        key, rid, chain = (read(c, t, False) for c, t in (("key", np.uint64), ("rid", np.int64), ("chain", np.uint64)))
        told, full = [], []
        for k, r, w in zip(table.column("key").to_pylist(), table.column("rid").to_pylist(), warm):
            if w:
                (full if r else told).append(np.frombuffer(k, np.uint64))
        told = np.unique(np.concatenate([np.zeros(0, np.uint64), *told]))
        order = np.argsort(key, kind="stable")
        key, rid, chain = key[order], rid[order], chain[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(key)))
        many = np.repeat((count > hot) | np.isin(key[first], told), count)
        out = [(np.ones(int(many.sum()), np.int8), key[many].view(np.int64), rid[many], chain[many].view(np.int64))]
        out.append((np.ones(sum(map(len, full)), np.int8), np.concatenate([np.zeros(0, np.uint64), *full]).view(np.int64), read("rid", np.int64, True), read("chain", np.uint64, True).view(np.int64)))
        key, rid, chain = key[~many], rid[~many], chain[~many]
        pairs, i, d = [], np.arange(len(key)), 0
        while True:
            d += 1
            i = i[i + d < len(key)]
            i = i[key[i] == key[i + d]]
            if not len(i):
                break
            good = i[(rid[i] != rid[i + d]) & _within(chain[i], chain[i + d], budgets)]
            pairs.append(np.stack([np.minimum(rid[good], rid[good + d]), np.maximum(rid[good], rid[good + d])], 1))
        if pairs:
            p = np.unique(np.concatenate(pairs), axis=0)
            out.append((np.zeros(len(p), np.int8), p[:, 0], p[:, 1], np.zeros(len(p), np.int64)))
        return pa.table(dict(zip(("kind", "a", "b", "chain"), (np.concatenate(x) for x in zip(*out)))))

    return by_bucket(signs.select("rep", "symbols").mapInArrow(send, "bucket int, hot boolean, key binary, rid binary, chain binary"), buckets, "bucket").applyInArrow(meet, "kind tinyint, a bigint, b bigint, chain bigint")


def _linked(pairs: DataFrame, signs: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b): those within the Hamming budget and of at least that likeness."""
    n, text = budget(least), signs.select("rep", "lens", "letters")
    side = lambda x: text.toDF(x, f"lens_{x}", f"letters_{x}")

    def letters(lens, data):
        parts = [np.frombuffer(x, np.int32) for x in lens]
        size = np.fromiter((int(x.sum()) + len(x) for x in parts), np.int64, len(parts))
        codes, at = np.full(int(size.sum()), NONE, np.uint8), 0
        for x, raw in zip(parts, data):
            c, used = unpack(raw, int(x.sum())), 0
            for run in x.tolist():
                codes[at : at + run] = c[used : used + run]
                at, used = at + run + 1, used + run
        return _sets(codes, np.repeat(np.arange(len(parts), dtype=np.uint32), size))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.fromiter((len(x) + len(y) for x, y in zip(batch.column("letters_a").to_pylist(), batch.column("letters_b").to_pylist())), np.int64, batch.num_rows)
            for lo, hi in _groups(np.cumsum(size) >> 18):
                part = batch.slice(lo, hi - lo)
                a, b = (letters(part.column(f"lens_{x}").to_pylist(), part.column(f"letters_{x}").to_pylist()) for x in "ab")
                near = (_symbols(a, hi - lo) != _symbols(b, hi - lo)).sum(1) <= n
                common = np.concatenate((a, b))
                common.sort()
                common = common[:-1][common[1:] == common[:-1]]
                each = [np.bincount((x >> np.uint64(32)).astype(np.int64), minlength=hi - lo) for x in (a, b, common)]
                good = np.flatnonzero(near & (each[2] >= least * (each[0] + each[1] - each[2]) - 1e-9))
                yield pa.RecordBatch.from_arrays([part.column(x).take(pa.array(good)) for x in "ab"], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "lens_a", "letters_a", "lens_b", "letters_b").mapInArrow(test, "a bigint, b bigint")


def _links(signs: DataFrame, least: float, buckets: int, hot: int) -> DataFrame:
    """Links between classes: every pair of at least that likeness, but for those that a hot key's first record joins already."""
    found = stage(_candidates(signs, least, buckets, hot))
    links = _linked(found.where("kind = 0").select("a", "b").distinct(), signs, least)
    warm = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("rid"), "chain")
    if warm.isEmpty():
        return links
    budgets = chain_budgets(budget(least))
    centre = warm.groupBy("key").agg(F.min(F.struct("rid", "chain")).alias("c"))
    star = stage(warm.join(centre, "key").where(F.col("rid") != F.col("c.rid")).select("key", "rid", "chain", F.col("c.rid").alias("centre"), _within_sql(F.col("chain"), F.col("c.chain"), budgets).alias("near")))
    good = stage(_linked(star.where("near").select(F.col("centre").alias("a"), F.col("rid").alias("b")).distinct(), signs, least))
    apart = star.join(good.select(F.col("a").alias("centre"), F.col("b").alias("rid")), ["centre", "rid"], "left_anti").select("key", "rid", "chain")
    other = warm.toDF("key", "other", "other_chain")
    rest = apart.join(other, "key").where((F.col("rid") != F.col("other")) & _within_sql(F.col("chain"), F.col("other_chain"), budgets))
    rest = rest.select(F.least("rid", "other").alias("a"), F.greatest("rid", "other").alias("b")).distinct()
    return links.union(good).union(_linked(rest, signs, least))


def near_groups(records: DataFrame, least: float = 0.6, hot: int = 64) -> DataFrame:
    """The group of each record: rid, same (the class of records with an equal set, named by its smallest rid), near (the group, likewise).

    Records are linked where the Jaccard index of their canonical 15-mers is at least ``least`` (0.5 or more; the filter loses
    a link with a chance of about 1e-5 at a least likeness of 0.6, 1e-4 at 0.5, less above it). Null ``rid`` or ``seq``, empty texts and
    records with fewer than 50 distinct 15-mers take no part and give no row; rows of one rid are one record; an empty table
    gives no rows; columns besides rid and seq are ignored. ``hot`` is no cap, see above.
    """
    if least < 0.5:
        raise ValueError("least likeness 0.5")
    buckets = buckets_for(records)
    made = stage(signed(records))
    signs = stage(made.groupBy("set_a", "set_b").agg(F.min("rid").alias("rep"), *(F.min_by(c, "rid").alias(c) for c in ("symbols", "lens", "letters"))))
    found = components(_links(signs, least, buckets, hot))
    same = made.select("rid", "set_a", "set_b").distinct().join(signs.select("set_a", "set_b", F.col("rep").alias("same")), ["set_a", "set_b"]).select("rid", "same")
    out = same.join(found.withColumnRenamed("node", "same"), "same", "left").select("rid", "same", F.coalesce("component", "same").alias("near"))
    return out


def near_pairs(records: DataFrame, least: float = 0.6, hot: int = 64) -> DataFrame:
    """Every pair of records of one group: rid_a < rid_b, distinct."""
    rows = near_groups(records, least, hot).select("rid", "near").distinct()
    return rows.withColumnRenamed("rid", "rid_a").join(rows.withColumnRenamed("rid", "rid_b"), "near").where("rid_a < rid_b").select("rid_a", "rid_b")
