"""Streams: files that arrive one after another."""

from datetime import datetime

from strandloom.operators import kmers
from strandloom.sources import fasta
from strandloom.streaming import arriving


def _write(spark, rows, path):
    spark.createDataFrame(rows, "at timestamp, seq string, c string").coalesce(1).write.mode("append").parquet(path)


def test_new_kmers_of_arriving_files(spark, tmp_path):
    here, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    one, two = [(None, "ACCCGAAC", "x"), (None, None, None), (None, "", "")], [(None, "ttcgggt", None), (None, "CGTANATGC", "x"), (None, "ACCCGAAC", "x")]
    _write(spark, one, here)
    source = spark.readStream.schema("at timestamp, seq string, c string").parquet(here)
    first = arriving.taken(arriving.new_kmers(source, 3), out)
    want = lambda rows: {r.c for r in kmers.kmer_set(spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "rid long, seq string"), 3).collect()}
    got = [r.c for r in first.collect()]
    assert sorted(got) == sorted(want(one))
    _write(spark, two, here)
    got = [r.c for r in arriving.taken(arriving.new_kmers(source, 3), out).collect()]
    assert sorted(got) == sorted(want(one + two))


def test_counts_by_time(spark, tmp_path):
    here, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    day = lambda d: datetime(2024, 1, d, 12)
    run = lambda: sorted((r.start.day, r.c, r.n) for r in arriving.taken(arriving.counts_by_time(source, 3, "at", "1 day", "2 days"), out).collect())
    _write(spark, [(day(1), "AAAA", "x"), (None, "AAAA", "x"), (day(2), "ACG", None)], here)
    source = spark.readStream.schema("at timestamp, seq string, c string").parquet(here)
    assert run() == []
    _write(spark, [(day(1), "TTT", "late, but in time"), (day(4), "CCC", "x")], here)
    assert run() == [(1, "AAA", 3)]
    _write(spark, [(day(1), "AAA", "too late"), (day(9), "CCC", "x")], here)
    assert run() == [(1, "AAA", 3), (2, "ACG", 1), (4, "CCC", 1)]


def test_fasta_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">1 one\nACCC\nGAAC\n>2\nCGTANATGC\n")
    rows = arriving.taken(fasta.stream_fasta(spark, f"file://{tmp_path}/in").select("name", "comment", "seq"), f"file://{tmp_path}/out").collect()
    assert sorted(map(tuple, rows)) == [("1", "one", "ACCCGAAC"), ("2", None, "CGTANATGC")]
