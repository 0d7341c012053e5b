"""The queries of this package over the given tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import levels, near, overlaps, packing, pieces, seen, spans, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SPANS = """
with r as (select distinct rid, upper(seq) as s from fasta_record where rid is not null and length(seq) >= 120),
w as (select rid, p, s[p + 1:p + 120] as t from (select rid, s, unnest(range(length(s) - 119)) as p from r)),
ok as (select * from w where regexp_full_match(t, '[ACGT]+')),
found as (select distinct rid, p from ok semi join (select t from ok group by t having min(rid) <> max(rid)) using (t)),
marked as (select *, case when p <= lag(p) over (partition by rid order by p) + 120 then 0 else 1 end as fresh from found),
grouped as (select *, sum(fresh) over (partition by rid order by p) as g from marked),
spans as (select rid, min(p) as start_pos, max(p) + 120 as end_pos from grouped group by rid, g)
"""


@query(_SPANS + "select rid, start_pos, end_pos from spans")
def p1_found(spark, sf_dir):
    return spans.shared_spans(table(spark, sf_dir, "fasta_record")).select("rid", "start_pos", "end_pos")


@query(_SPANS + "select rid, count(*) as spans, cast(sum(end_pos - start_pos) as bigint) as shared_letters, max(end_pos - start_pos) as longest_span from spans group by rid")
def p1_parts(spark, sf_dir):
    return spans.shared_parts(table(spark, sf_dir, "fasta_record"))


_KEYS = """
with cleaned as (select arrival, upper(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) as v from kmer_stream where arrival is not null),
keys as (select arrival, least(v, reverse(translate(v, 'ACGT', 'TGCA'))) as c from cleaned where regexp_full_match(v, '[ACGT]{31}')),
firsts as (select c, min(arrival) as a from keys group by c),
answers as (select distinct k.arrival, k.arrival > f.a or exists (select 1 from kmer_known n where n.c = k.c) as seen from keys k join firsts f using (c))
"""


@query(_KEYS + "select arrival from answers where seen")
def p3_found(spark, sf_dir):
    return seen.seen_before(table(spark, sf_dir, "kmer_stream"), table(spark, sf_dir, "kmer_known"))


@query()
def p3_rate(spark, sf_dir):
    return seen.seen_rate(table(spark, sf_dir, "kmer_stream"), table(spark, sf_dir, "kmer_known"))


_FURTHEST = """
with recursive texts as (select distinct rid, seq from fasta_record where length(seq) > 4000),
parts as (select rid, seq, regexp_extract_all(seq, '[ACGTacgt]+|[^ACGTacgt]+') as runs from texts),
ends as (select rid, seq, unnest(runs) as run, unnest(range(1, len(runs) + 1)) as n, runs from parts),
bounds as (select distinct rid, seq, b from (select rid, seq, run, sum(length(run)) over (partition by rid, seq order by n) as b from ends) where length(run) >= 10 and not regexp_full_match(run, '[ACGTacgt]+')),
lists as (select t.rid, t.seq, length(t.seq) as size, list(b) filter (b is not null) as bs from texts t left join bounds b on t.rid is not distinct from b.rid and t.seq = b.seq group by all),
pieces as (
  select rid, seq, size, bs, cast(0 as bigint) as s, cast(coalesce(list_max(list_filter(bs, lambda x: x > 2000 and x <= 4000)), 4000) as bigint) as e from lists
  union all
  select rid, seq, size, bs, e - 30, case when size - (e - 30) <= 4000 then size else cast(coalesce(list_max(list_filter(bs, lambda x: x > e - 30 + 2000 and x <= e - 30 + 4000)), e - 30 + 4000) as bigint) end from pieces where e < size
)
select distinct rid, s as start_pos, e as end_pos from pieces
"""


@query(_FURTHEST)
def p4_found(spark, sf_dir):
    return pieces.split_records(table(spark, sf_dir, "fasta_record"), placement="furthest")


@query()
def p4_balanced(spark, sf_dir):
    return pieces.split_records(table(spark, sf_dir, "fasta_record"), placement="balanced")


_SETS = """
with texts as (select lower(regexp_replace(dataset, '^\\s+|\\s+$', '', 'g')) as d, upper(seq) as s from fasta_record where length(seq) >= 31),
cut as (select d, s[p + 1:p + 31] as v from (select d, s, unnest(range(length(s) - 30)) as p from texts)
  union all select lower(regexp_replace(dataset, '^\\s+|\\s+$', '', 'g')), upper(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) from kmer_stream),
sets as (select distinct d, least(v, reverse(translate(v, 'ACGT', 'TGCA'))) as c from cut where d is not null and regexp_full_match(v, '[ACGT]{31}')),
"""


@query(_SETS + "common as (select * from sets semi join (select c from sets group by c having count(*) > 1) using (c)) select a.d as dataset_a, b.d as dataset_b from common a join common b on a.c = b.c and a.d < b.d group by 1, 2 having count(*) >= 200")
def p5_found(spark, sf_dir):
    return overlaps.overlapping(table(spark, sf_dir, "fasta_record"), table(spark, sf_dir, "kmer_stream"))


@query()
def p5_estimates(spark, sf_dir):
    return overlaps.overlap_estimates(table(spark, sf_dir, "fasta_record"), table(spark, sf_dir, "kmer_stream"))


_NEAR = """
with recursive texts as (select distinct rid, upper(seq) as s from fasta_record where rid is not null and length(seq) >= 15),
cut as (select rid, s[p + 1:p + 15] as v from (select rid, s, unnest(range(length(s) - 14)) as p from texts)),
sets as (select distinct rid, least(v, reverse(translate(v, 'ACGT', 'TGCA'))) as c from cut where regexp_full_match(v, '[ACGT]{15}')),
sizes as (select rid, count(*) as n from sets group by rid having count(*) >= 50),
common as (select rid, c from sets semi join (select c from sets group by c having count(*) > 1) using (c) semi join sizes using (rid)),
pairs as (select a.rid as x, b.rid as y, count(*) as n from common a join common b on a.c = b.c and a.rid < b.rid group by all),
links as (select x, y from pairs join sizes s on s.rid = x join sizes t on t.rid = y where pairs.n >= 0.6 * (s.n + t.n - pairs.n)),
edges as (select x, y from links union select y, x from links),
reach as (select x, y from edges union select r.x, e.y from reach r join edges e on r.y = e.x)
"""


@query(_NEAR + "select x as rid_a, y as rid_b from reach where x < y")
def p2_found(spark, sf_dir):
    return near.near_pairs(table(spark, sf_dir, "fasta_record"))


@query(_NEAR + "select s.rid, coalesce(least(s.rid, min(r.y)), s.rid) as near from sizes s left join reach r on r.x = s.rid group by s.rid")
def p2_groups(spark, sf_dir):
    return near.near_groups(table(spark, sf_dir, "fasta_record")).select("rid", "near")


@query()
def p6_ids(spark, sf_dir):
    return tokens.encoded(table(spark, sf_dir, "documents"))


@query("select doc_id, coalesce(text, '') as text from documents")
def p6_decoded(spark, sf_dir):
    return tokens.decoded(tokens.encoded(table(spark, sf_dir, "documents")))


@query()
def p7_packed(spark, sf_dir):
    return packing.packed_documents(table(spark, sf_dir, "documents"))


@query()
def p7_summary(spark, sf_dir):
    return packing.packing_summary(table(spark, sf_dir, "documents"))


@query()
def p8_found(spark, sf_dir):
    return levels.demanding(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_label"))


@query()
def p8_levels(spark, sf_dir):
    return levels.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_label"))
