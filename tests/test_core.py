"""Known results on small inputs."""

import gzip

import pytest
from pyspark.sql import functions as F

from strandloom.functions import letters
from strandloom.operators import components, convert, graph, greedy, kmers, masks, measures, superstrings
from strandloom.sources import fasta

TEST = [(1, "ACCCGAAC"), (2, "CGTANATGC"), (3, "AcCCGTTTAACG"), (4, "A")]
SPSS = [(1, "ACCCGAAC"), (2, "CGTA"), (3, "ATGC"), (4, "AcCCGTTTAACG"), (5, "A")]
RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(RC)[::-1]


def rows(spark, data, extra=()):
    return spark.createDataFrame([(*r, *extra) for r in data], "rid bigint, seq string")


def sets(spark, *kmers_, key="m"):
    return spark.createDataFrame([(key, c) for c in kmers_], "ms_id string, c string")


def ms(spark, text, k, key="m"):
    return convert.split_case(spark.createDataFrame([(key, k, text)], "ms_id string, k int, seq string"))


def text_of(masked):
    return convert.join_case(masked).first().seq


@pytest.mark.parametrize("k, both, upper, n", [(10, True, False, 3), (10, True, True, 2), (5, True, False, 11), (5, False, False, 11), (2, True, False, 9), (2, False, False, 11)])
def test_distinct_kmers(spark, k, both, upper, n):
    assert kmers.kmer_set(rows(spark, TEST), k, both_strands=both, upper_only=upper).count() == n


@pytest.mark.parametrize("k, both, want", [(3, True, "ACCCGAacCGtaATgcTTta"), (2, True, "ACcCGAaTaATGc"), (1, True, "AC"), (1, False, "ACGT")])
def test_streaming(spark, k, both, want):
    parts = superstrings.streaming(rows(spark, TEST), k, both)
    assert convert.concatenated(parts.withColumn("x", F.lit(1)), "x", "rid").first().seq == want


def test_breaks(spark):
    got = lambda s, k: [r.u for r in kmers.windows(rows(spark, [(1, s)]), k, both_strands=False).orderBy("pos").collect()]
    assert got("acgTa", 3) == ["ACG", "CGT", "GTA"]
    assert got("ACGNTTA", 3) == got("ACGNMTTA", 3) == ["ACG", "TTA"]
    assert got("AAAA", 2) == ["AA"] * 3
    assert got("", 2) == got("A", 2) == got(None, 2) == []


def test_long_record_is_cut(spark):
    s = "".join("ACGT"[(i * i + i // 7) % 4] for i in range(3000))
    got = [(r.pos, r.u) for r in kmers.windows(rows(spark, [(1, s)]), 31, both_strands=False).orderBy("pos").collect()]
    assert got == [(i, s[i : i + 31]) for i in range(2970)]


def test_sets(spark):
    u = lambda *x: spark.createDataFrame([(v,) for v in x], "u string")
    assert kmers.one_of_each_pair(u("AA", "TT", "AC", "GT")).count() == 2
    assert kmers.one_of_each_pair(u("AT")).count() == 1
    assert kmers.one_of_each_pair(u("GT", "CG")).count() == 2
    assert sorted(r.u for r in kmers.without_repeats(u("AT", "AT", "AT", "AC", "AC"), 2).collect()) == ["AC", "AT", "AT"]
    assert sorted(r.u for r in kmers.without_repeats(u("ATA", "ATA"), 3).collect()) == ["ATA"]
    assert {r.u for r in kmers.having_prefix(u("ACG", "CGT", "TAA"), 2).collect()} == {"ACG"}
    assert kmers.by_prefix(u("ACG", "CGT"), parts=2).count() == 2


def test_letters(spark):
    df = spark.createDataFrame([("CG", "ATT"), ("CAC", "AGT")], "a string, b string")
    got = df.select(letters.reverse_complement("a"), letters.reverse_complement("b"), letters.to_number("b"), letters.from_number(letters.to_number("b"), 3), letters.overlap("a", "b", 3), letters.windows_in("b", 2), letters.nucleotide_code(F.lit("n"))).collect()
    assert [tuple(r) for r in got] == [("CG", "AAT", 15, "ATT", 0, 2, 4), ("GTG", "ACT", 11, "AGT", 0, 2, 4)]
    r = spark.range(1).select(letters.overlap(F.lit("ACGT"), F.lit("GTTT"), 4), letters.suffix(F.lit("ACG"), 0), letters.prefix(F.lit("ACG"), 2), letters.masked(F.lit("a"), F.lit(1)), letters.is_upper(F.lit("a")), letters.hashed(F.lit("a")).isNotNull()).first()
    assert tuple(r) == (2, "", "AC", "A", False, True)


def test_conversions(spark):
    one = ms(spark, "AcgCGTtacGtATt", 2)
    assert (one.first().mask, one.first().superstring) == ("10011100010110", "ACGCGTTACGTATT")
    strings = lambda k: [(r.sid, r.seq) for r in convert.to_strings(ms(spark, "AcgCGTtacGtATt", k)).orderBy("sid").collect()]
    assert strings(2) == list(enumerate(["AC", "CGTT", "GT", "ATT"]))
    assert strings(3) == list(enumerate(["ACG", "CGTTA", "GTA", "ATT"]))
    want = {1: "ACCCGAACCGTAATGCACCCGTTTAACGA", 2: "ACCCGAAcCGTaATGcACCCGTTTAACg", 3: "ACCCGAacCGtaATgcACCCGTTTAAcg", 4: "ACCCGaacCgtaAtgcACCCGTTTAacg", 5: "ACCCgaacACCCGTTTaacg"}
    for k, text in want.items():
        parts = convert.from_strings(rows(spark, SPSS), k).withColumn("x", F.lit(1))
        assert convert.concatenated(parts, "x", "rid").first().seq == text
    join = lambda m, s: text_of(spark.createDataFrame([("m", m, s)], "ms_id string, mask string, superstring string"))
    assert join("1001101", "ACGTTTA") == "AcgTTtA"
    assert join("0111110000", "CCCGGTATTA") == "cCCGGTatta"


@pytest.mark.parametrize("text, k, both, kind, want", [
    ("ACgTaacgt", 3, False, "minone", "ACgTaacgt"), ("ACgTaacgt", 3, False, "maxone", "ACgTaACgt"), ("AcgTaacgt", 3, True, "minone", "AcgTaacgt"), ("AcgTaacgt", 3, True, "maxone", "ACgTaACgt"),
    ("AcgCGTtacGtATt", 2, False, "approxminrun", "ACgCGTtACGtATt"), ("ACtaGta", 3, True, "minrun", "ACTAGta"),
])
def test_masks(spark, text, k, both, kind, want):
    one = ms(spark, text, k)
    w = masks.placed(one, both)
    found = {"minone": lambda: masks.runs(masks.fewest_ones(w)), "maxone": lambda: masks.runs(masks.most_ones(w)), "minrun": lambda: masks.fewest_runs(w), "approxminrun": lambda: masks.fewest_runs_approximately(w)}[kind]()
    assert text_of(masks.written(one, found)) == want


def test_fewest_runs(spark):
    one = ms(spark, "AcgCGTtacGtATt", 2)
    got = masks.written(one, masks.fewest_runs(masks.placed(one, False)))
    assert masks.represented(got, False).exceptAll(masks.represented(one, False)).isEmpty()
    assert masks.represented(one, False).exceptAll(masks.represented(got, False)).isEmpty()
    assert len(masks.runs(masks.placed(one, False).select("ms_id", "pos")).collect()) == 4 and len([x for x in got.first().mask.split("0") if x]) == 2
    assert masks.last_is_represented(ms(spark, "ACgTaacgt", 3)).first().last_represented


def test_dirty_superstrings(spark):
    bad = [("a", 2, None, "1"), ("b", 2, "ACG", None), ("c", 2, "ACN", "111"), ("d", 2, "ACG", "121"), ("e", 2, "ACG", "11"), ("f", 2, "acg", "110"), ("f", 2, "acg", "110"), ("g", None, "ACG", "110"), ("h", 2, "", "")]
    df = spark.createDataFrame(bad, "ms_id string, k int, superstring string, mask string")
    assert [r.ms_id for r in convert.usable(df).collect()] == ["f"]
    assert {r.ms_id: r.fault for r in convert.faults(df).collect()} == {"a": "no superstring", "b": "no mask", "c": "letters", "d": "digits", "e": "length", "f": None, "g": None, "h": None}


@pytest.mark.parametrize("kmers_, both, bound", [(("ACG", "CGT", "TAA"), False, 5), (("AC", "GG"), True, 3)])
def test_length_bound(spark, kmers_, both, bound):
    assert greedy.length_bound(sets(spark, *kmers_), "ms_id", both).first().bound == bound


GREEDY = [("CGT", "TAC", "ACG"), ("CGT", "TTT", "ACG"), ("ACAA", "ATTT", "AACA"), ("AAA", "TTA", "GCT", "TAA"), ("ACG", "CGA", "GAC"), ("AT", "TA", "CG"), ("ACGT", "CGTA", "GTAC", "TACG")]


HOW = [(GREEDY[2], True, {}), (GREEDY[4], False, {"deepest": 2}), (GREEDY[6], True, {"penalty": 3, "steps": 3})]


@pytest.mark.parametrize("kmers_, both, how", HOW)
def test_greedy_keeps_the_set(spark, kmers_, both, how):
    if both and len(kmers_[0]) % 2 == 0:
        kmers_ = tuple({min(c, rc(c)) for c in kmers_})
    canon = {min(c, rc(c)) if both else c for c in kmers_}
    k = len(kmers_[0])
    parts = greedy.joined(sets(spark, *canon), "ms_id", both_strands=both, **how)
    seq = greedy.superstring(parts, "ms_id").first().seq
    ones = [seq[i : i + k].upper() for i in range(len(seq) - k + 1) if seq[i].isupper()]
    found = [min(u, rc(u)) if both else u for u in ones]
    assert set(found) == canon and not any(c.isupper() for c in seq[len(seq) - k + 1 :])
    if not how.get("steps"):
        assert len(found) == len(canon)
        bound = greedy.length_bound(sets(spark, *canon), "ms_id", both).first().bound
        assert len(seq) >= bound


def test_global_length(spark):
    size = lambda both, *c: greedy.sizes(greedy.joined(sets(spark, *c), "ms_id", both_strands=both), "ms_id").first().length
    assert size(True, "ACAA", "ATTT", "AACA") == 7


def test_simplitigs_and_unitigs(spark):
    got = {r.seq for r in greedy.simplitigs(sets(spark, "GCT", "TAA", "AAA"), "ms_id", both_strands=False).collect()}
    assert got == {"GCT", "TAAA"}
    ring = {r.seq for r in graph.unitigs(sets(spark, "ACG", "CGA", "GAC"), "ms_id", both_strands=False).collect()}
    assert ring == {"ACGAC"}
    assert graph.isolated(spark.createDataFrame([("m", "AAC"), ("m", "GGT")], "ms_id string, u string"), "ms_id").count() == 2


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 1), (10, 9), (9, 8), (8, 11), (1, 2)], "a bigint, b bigint")
    assert {(r.node, r.component) for r in components.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 7), (8, 8), (9, 8), (10, 8), (11, 8)}
    path = spark.range(1, 200).selectExpr("id as a", "id + 1 as b")
    assert components.components(path).agg(F.max("component"), F.count("*")).first()[:] == (1, 200)
    assert components.components(e.limit(0)).count() == 0


def test_elias_fano(spark):
    r = spark.createDataFrame([("S", 15, "pareto-256", 9977622, 29), ("S", 15, "x", -1, 5), ("S", 15, "x", None, None)], "dataset string, k int, method string, superstring bigint, mask bigint")
    got = measures.report_sizes(r.union(r)).collect()
    assert [(x.method, x.elias_fano) for x in got] == [("pareto-256", 1088)]


def test_fasta(spark, tmp_path):
    text = ">1\nACCC\nGAAC\n>2\tx\nCGTANATGC\n>3 with > description\r\nAcCCGTTT\r\nAACG\r\n>4\nA\n"
    (tmp_path / "a.fa").write_text(text)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(text)
    want = [("1", None, "ACCCGAAC"), ("2", "x", "CGTANATGC"), ("3", "with > description", "AcCCGTTTAACG"), ("4", None, "A")]
    for name in ("a.fa", "b.fa.gz"):
        assert [tuple(r) for r in fasta.read_fasta(spark, str(tmp_path / name)).orderBy("rid").select("name", "comment", "seq").collect()] == want
    both = fasta.read_fasta(spark, str(tmp_path)).orderBy("rid").select("name").collect()
    assert [r.name for r in both] == ["1", "2", "3", "4"] * 2
    with pytest.raises(ValueError):
        fasta.read_masked_superstring(spark, str(tmp_path / "a.fa"))
    out = str(tmp_path / "out")
    fasta.write_fasta(fasta.read_fasta(spark, str(tmp_path / "a.fa")).coalesce(1), out)
    assert [tuple(r) for r in fasta.read_fasta(spark, out).orderBy("rid").select("name", "comment", "seq").collect()] == want
    (tmp_path / "r.fq").write_text("@r1 c\nACGT\n+\n@III\n@r2\nGG\n+\nII\n")
    assert [tuple(r) for r in fasta.read_fastq(spark, str(tmp_path / "r.fq")).select("name", "comment", "seq").collect()][-1] == ("r2", None, "GG")
    (tmp_path / "list.txt").write_text("# c\nS. pneumoniae @ http://x\n\n")
    assert [tuple(r) for r in fasta.read_catalog(spark, str(tmp_path / "list.txt")).collect()] == [("S._pneumoniae", "http://x")]
    head = spark.createDataFrame([("superstring", None, "ACgt")], "name string, comment string, seq string")
    fasta.write_fasta(head, str(tmp_path / "ms"), fasta.reoptimised_header("minone"))
    assert fasta.read_masked_superstring(spark, str(tmp_path / "ms")).first().comment == "reoptimized=minone"
    assert fasta.header("a.fa", 31, "global", "minone").startswith(">maskedsuperstring dataset='a.fa' k=31")
    report = spark.createDataFrame([("b", 1), ("a", 2)], "method string, n int")
    fasta.write_tsv(report, str(tmp_path / "tsv"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).collect()] == [("a", "2"), ("b", "1")]
    fasta.write_lines(head, "seq", str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).first().value == "ACgt"


def test_measures(spark):
    a, b = sets(spark, "AC", "AG"), sets(spark, "AC", "AG")
    assert measures.set_equality(a, b).first().equal and not measures.set_equality(a, sets(spark, "AC", "CC")).first().equal
    assert not measures.set_equality(a, b.limit(0)).first().equal
    got = measures.compressed_sizes(spark.createDataFrame([("x", "A" * 1000), ("y", None)], "id string, t string"), "id", "t").collect()
    assert len(got) == 1 and got[0].raw == 1000 and got[0].xz < 200 and got[0].bz2 < 200
    assert [tuple(r) for r in measures.flips(ms(spark, "AcgT", 2)).orderBy("pos").select("pos").collect()] == [(1,), (3,)]
