"""Whole results: what a cut of the search would lose."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import greedy, masks, measures

RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(RC)[::-1]


def cheapest(nodes, k, penalty, zeros, start):
    """Costs from one k-mer to all others over k-mers of the set, by Dijkstra."""
    cost, heap, limit = {}, [(0, start, 0)], (k - 1) * (penalty + 1) if zeros else k - 1 + penalty
    while heap:
        c, u, moved = heapq.heappop(heap)
        if moved and u in cost or c > limit:
            continue
        if moved:
            cost[u] = c
        for v in nodes:
            for d in range(1, k):
                if u[-d:] == v[:d]:
                    gap = k - 1 - d
                    heapq.heappush(heap, (c + 1 + gap + (penalty * gap if zeros else penalty * (gap > 0)), v, 1))
    return cost


def random_set(k, n, both, seed):
    x, found = seed, set()
    while len(found) < n:
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        w = "".join("ACGT"[x >> (20 + 2 * i) & 3] for i in range(k + 3))
        found |= {min(w[i : i + k], rc(w[i : i + k])) if both else w[i : i + k] for i in range(4)}
    return found


@pytest.mark.parametrize("zeros, penalty, both, k, n", [(False, 8, True, 5, 20), (True, 2, True, 5, 12), (True, 3, False, 4, 12)])
def test_pareto_joins_by_brute_force(spark, zeros, penalty, both, k, n):
    canon = random_set(k, n, both, 7)
    sets = spark.createDataFrame([("m", c) for c in canon], "ms_id string, c string")
    nodes = canon | {rc(c) for c in canon} if both else canon
    pieces = greedy._pieces(sets, "ms_id", both)
    nodes_ = greedy._nodes(pieces, "ms_id", both)
    text = {r.node: r.u for r in nodes_.collect()}
    found = greedy._walks_with_gaps(sets, nodes_, "ms_id", penalty, both) if zeros else greedy._walks(nodes_, greedy._ends(pieces, "ms_id", both), "ms_id", F.lit(k - 1 + penalty))
    got = {(text[r.u], text[r.v]): r.cost for r in found.collect()}
    if not zeros:  # direct joins are made by overlap, level by level
        for x in text.values():
            for y in text.values():
                direct = [k - d + (penalty if d < k - 1 else 0) for d in range(1, k) if x[-d:] == y[:d]]
                if direct:
                    got[x, y] = min(got.get((x, y), 10**6), *direct, 10**6)
    want = {}
    for x in text.values():
        cost = cheapest(nodes, k, penalty, zeros, x[-k:])
        want |= {(x, y): cost[y[:k]] for y in text.values() if y[:k] in cost}
    assert got == want
    parts = greedy.joined(sets, "ms_id", penalty=penalty, steps=None, both_strands=both, zeros=zeros)
    seq = greedy.superstring(parts, "ms_id").first().seq
    found = {seq[i : i + k].upper() for i in range(len(seq) - k + 1) if seq[i].isupper()}
    assert {min(u, rc(u)) if both else u for u in found} == canon
    size = greedy.sizes(parts, "ms_id").first()
    assert (size.length, size.runs) == (len(seq), len([x for x in "".join(c if c.isupper() else " " for c in seq).split()]))


def test_long_walk_saves_a_run(spark):
    """Two paths share twelve k-mers: the second can only go on by a walk of 13 letters over them, which is cheaper than a run."""
    k, common = 7, "ACGTTGCAATCGGACTGA"
    words = {w[i : i + k] for w in ("C" + common + "C", "T" + common + "G") for i in range(len(common) + 3 - k)}
    sets = spark.createDataFrame([("m", c) for c in words], "ms_id string, c string")
    size = lambda steps: greedy.sizes(greedy.joined(sets, "ms_id", penalty=20, steps=steps, both_strands=False), "ms_id").first()
    whole, cut = size(None), size(8)
    assert whole.length + 20 * whole.runs < cut.length + 20 * cut.runs and whole.runs < cut.runs


def test_fewest_runs_of_a_large_component(spark):
    """18 intervals that hang together: 8 are enough, as trying all choices tells; a greedy cover takes 10."""
    draw = random.Random(20)
    need = [draw.sample(range(18), 2 + n % 2) for n in range(32)]
    rows = [("m", 1000 * i + at, f"c{n}") for i in range(18) for at, n in enumerate(n for n, s in enumerate(need) if i in s)]
    found = masks.fewest_runs(spark.createDataFrame(rows, "ms_id string, pos bigint, c string")).collect()
    assert len(found) == 8 and all({r['first'] // 1000 for r in found} & set(s) for s in need)


def greedy_length(kmers, k, both):
    """Least and greatest length that a greedy superstring of few k-mers may have: every order of ties is tried."""
    start = tuple(sorted(kmers))
    done = {}

    def overlap(a, b):
        return max((d for d in range(1, k) if a[-d:] == b[:d]), default=0)

    def run(strings):
        if strings in done:
            return done[strings]
        best = {}
        for i, a in enumerate(strings):
            for j, b in enumerate(strings):
                if i != j:
                    for x in {a, rc(a)} if both else {a}:
                        for y in {b, rc(b)} if both else {b}:
                            best.setdefault(overlap(x, y), []).append((i, j, x, y))
        d = max(best, default=0)
        if not d:
            out = (sum(map(len, strings)),) * 2
        else:
            ways = [run(tuple(sorted([s for n, s in enumerate(strings) if n not in (i, j)] + [min(x + y[d:], rc(x + y[d:])) if both else x + y[d:]]))) for i, j, x, y in best[d]]
            out = min(w[0] for w in ways), max(w[1] for w in ways)
        done[strings] = out
        return out

    return run(start)


@pytest.mark.parametrize("both", [True, False])
def test_greedy_length_by_brute_force(spark, both):
    """Sets of up to six k-mers: the length is one that some order of the ties gives."""
    many = {f"m{i}": random_set(5, 3 + i % 4, both, 100 + i) for i in range(6)}
    many = {m: set(sorted(s)[:6]) for m, s in many.items()}
    sets = spark.createDataFrame([(m, c) for m, s in many.items() for c in s], "ms_id string, c string")
    got = {r.ms_id: r.length for r in greedy.sizes(greedy.joined(sets, "ms_id", both_strands=both), "ms_id").collect()}
    bound = {r.ms_id: r.bound for r in greedy.length_bound(sets, "ms_id", both).collect()}
    for m, s in many.items():
        least, most = greedy_length(s, 5, both)
        assert least <= got[m] <= most and bound[m] <= least, m


def test_levels_are_linear(spark):
    """Ends that all fit each other: as many rows as there are ends, not their square."""
    made = lambda w: spark.range(3000).selectExpr("'m' as ms_id", "5 as k", "id as end", "id as path", f"'{w}' as w")
    fitting = lambda w, missing, both: greedy._fitting(made(w), "ms_id", missing, missing, both, False)
    assert fitting("CCGC", 2, True).isEmpty()  # CGC fits GCG only
    for missing, both, w in ((1, True, "ACGT"), (3, True, "CCGC"), (1, False, "AAAA"), (4, False, "AAAA")):
        for salts in (1, 7):
            pairs = greedy._paired(fitting(w, missing, both), "ms_id", 0, salts).collect()
            assert 1500 - 150 * (salts > 1) <= len(pairs) <= 1500 and len({x for r in pairs for x in (r.a, r.b)}) == 2 * len(pairs)


def test_runs_fall_as_the_penalty_grows(spark):
    """The trade that the Pareto search makes: fewer runs for more letters."""
    canon = random_set(5, 24, True, 11)
    sets = spark.createDataFrame([("m", c) for c in canon], "ms_id string, c string")
    got = [greedy.sizes(greedy.joined(sets, "ms_id", penalty=p, steps=None if p else 0), "ms_id").first() for p in (0, 40)]
    assert got[0].runs >= got[1].runs and got[0].length <= got[1].length


def test_windows_and_runs_of_a_long_text(spark, monkeypatch):
    """A record longer than what is cut at a time, and runs over the edges of blocks: each window and run once."""
    import numpy as np

    from strandloom.functions import packed
    from strandloom.operators import convert, kmers

    codes = np.random.default_rng(5).integers(0, 4, 2_300_000)
    text = np.frombuffer(b"ACGT", np.uint8)[codes].tobytes().decode()
    text = text[:1_048_570] + "N" + text[1_048_571:2_100_000] + "acgtn" + text[2_100_005:]
    records = spark.createDataFrame([(1, text), (2, "ACGT" * 10), (3, None)], "rid bigint, seq string")
    got = kmers.windows(records, 31, texts="c").where("rid = 1").select("pos", "c").toPandas().sort_values("pos")
    whole = packed.whole(packed.joined_codes([text])[0], 31)
    assert got.pos.tolist() == np.flatnonzero(whole).tolist()
    for p in (0, 1_048_539, 1_048_571, 2_099_970, len(text) - 31):
        w = text[p : p + 31].upper()
        assert got.c[got.pos == p].tolist() == [min(w, rc(w))]
    assert kmers.counted(records, 31).agg({"n": "sum"}).first()[0] == whole.sum() + 10
    gaps = [0, 65_535, 65_536, 131_072, 400_000]
    rows = spark.range(500_000).where(~F.col("id").isin(gaps)).selectExpr("'m' as ms_id", "id as pos")
    runs = sorted((r["first"], r["last"]) for r in kmers.islands(rows, ["ms_id"]).collect())
    assert runs == [(a + 1, b - 1) for a, b in zip(gaps, [*gaps[1:], 500_000]) if b - a > 1]
    mask = "".join("0" if i in gaps else "1" for i in range(500_000))
    ms = spark.createDataFrame([("m", 31, text[:500_000], mask)], "ms_id string, k int, superstring string, mask string")
    assert sorted((r["first"], r["last"]) for r in convert.ones(ms).collect()) == runs
    assert masks.written(ms, convert.ones(ms)).first().mask == mask
    strings = sorted((r.sid, r.seq) for r in convert.to_strings(ms).collect())
    assert strings == [(i, text[a : b + 31][: 500_000 - a]) for i, (a, b) in enumerate(runs)]
    back = convert.split_case(convert.join_case(ms).select("ms_id", "seq")).first()
    assert back.mask == mask and back.superstring == text[:500_000]


def test_sets_are_compared_in_one_shuffle(spark):
    """A k-mer that stands in a side several times counts once, without a shuffle for that."""
    a = spark.createDataFrame([(1,), (1,), (2,), (3,)], "c bigint")
    b = spark.createDataFrame([(3,), (2,), (2,), (4,)], "c bigint")
    found = measures.set_equality(a, b)
    assert [tuple(r) for r in found.collect()] == [(3, 3, 4, False)]
    assert [tuple(r) for r in measures.set_equality(a, a).collect()] == [(3, 3, 3, True)]
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_streaming_superstring_is_made_once(spark, sf_dir):
    """The parts that are decoded again are read from a stage, so they don't come from a join that runs for each reader."""
    import __spark_entry__

    assert "Join" not in __spark_entry__.queries()["streaming_verified"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
