"""Whole results of the pipeline operators: what a cut would lose."""

import random

from strandloom.llm import overlaps, pieces


def test_balanced_takes_the_strongest_boundary(spark):
    """With the target at 2,570, a gap of 10 ends at 2,610 and one of 500 at 2,400."""
    text = "A" * 1900 + "N" * 500 + "C" * 200 + "N" * 10 + "G" * 2500
    got = sorted((r.start_pos, r.end_pos) for r in pieces.split_records(spark.createDataFrame([(1, text)], "rid bigint, seq string")).collect())
    assert got == [(0, 2400), (2370, 5110)]


def test_estimates_of_every_pair(spark):
    draw = random.Random(3)
    dna = lambda n: "".join(draw.choice("ACGT") for _ in range(n))
    core = dna(900)
    texts = [("a", core), ("b", core[:40] + dna(2000)), ("c", dna(700)), ("d", core[500:]), ("e", "")]
    windows = lambda s: {min(w, w.translate(str.maketrans("ACGT", "TGCA"))[::-1]) for w in (s[i : i + 31] for i in range(len(s) - 30))}
    sets = {d: windows(s) for d, s in texts}
    recs = spark.createDataFrame(texts, "dataset string, seq string")
    stream = spark.createDataFrame([], "arrival bigint, dataset string, value string")
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b}
    exact = {(r.dataset_a, r.dataset_b): (r.shared_estimate, r.shared_error) for r in overlaps.overlap_estimates(recs, stream).collect()}
    assert exact == {p: (n, 0) for p, n in want.items()}
    rough = {(r.dataset_a, r.dataset_b): r for r in overlaps.overlap_estimates(recs, stream, size=64).collect()}
    assert rough.keys() == want.keys() and all(abs(rough[p].shared_estimate - n) <= rough[p].shared_error for p, n in want.items())
