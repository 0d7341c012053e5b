"""Queries over the given tables and the SQL that checks them, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import letters
from ..operators import convert, graph, greedy, kmers, masks, measures, postings, superstrings
from ..runtime import stage, unsent
from ..streaming import arriving

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


K = 31

_CUT = f"""
with texts as (select distinct rid, seq from fasta_record where rid is not null and length(seq) >= {K}),
cut as (select rid, p as pos, seq[p + 1:p + {K}] as w from (select rid, seq, unnest(range(length(seq) - {K - 1})) as p from texts)),
w as (select rid, pos, upper(w) as u, least(upper(w), reverse(translate(upper(w), 'ACGT', 'TGCA'))) as c, w[1:1] <= 'Z' as up from cut where translate(w, 'ACGTacgt', '') = '')
"""


def records(spark, sf_dir):
    """The different records: a delivery that is repeated counts once."""
    return table(spark, sf_dir, "fasta_record").where("rid is not null").select("rid", "name", "comment", "seq", "dataset").dropDuplicates(["rid", "seq"])


def superstring_rows(spark, sf_dir):
    return convert.usable(table(spark, sf_dir, "masked_superstring"))


@query(_CUT + "select c, count(*) as n from w group by c")
def kmer_counts(spark, sf_dir):
    """Canonical 31-mers of all records and how often they occur."""
    return kmers.counted(records(spark, sf_dir), K).select(letters.from_number("number", K).alias("c"), "n")


@query(_CUT + "select count(*) as total, count(distinct c) as distinct_kmers, count(distinct c) filter (where up) as upper_only from w")
def kmer_totals(spark, sf_dir):
    """Windows, distinct k-mers, and those with an upper-case start."""
    return kmers.counted(records(spark, sf_dir), K).agg(F.sum("n").alias("total"), F.count("*").alias("distinct_kmers"), F.count_if("up").alias("upper_only"))


@query(_CUT + "select c, count(*) as n from w group by c having count(*) >= 3")
def kmer_abundant(spark, sf_dir):
    """K-mers that occur at least three times."""
    return kmers.frequent(records(spark, sf_dir), K, 3)


@query(_CUT + "select u, count(*) as n from w group by u")
def kmer_counts_one_strand(spark, sf_dir):
    """K1 on one strand."""
    return kmers.windows(records(spark, sf_dir), K, both_strands=False).groupBy("u").agg(F.count("*").alias("n"))


@query(_CUT + ", d as (select lower(trim(dataset)) as dataset, rid from fasta_record where dataset is not null group by all), s as (select distinct dataset, c from w join d using (rid)) select dataset, count(*) as n from s group by dataset")
def kmers_by_dataset(spark, sf_dir):
    """K2, K8: distinct canonical k-mers of each dataset, counted in two steps."""
    rows = records(spark, sf_dir).where("dataset is not null").withColumn("dataset", F.lower(F.trim("dataset")))
    return kmers.counted(rows, K, "dataset").groupBy("dataset").agg(F.count("*").alias("n"))


@query(_CUT + "select distinct c from w")
def streamed_kmers(spark, sf_dir):
    """K2 on a stream: the table's files as they come, each k-mer passed on once."""
    schema = table(spark, sf_dir, "fasta_record").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/fasta_record.parquet*")  # a pattern may stand for one file or for a folder
    return arriving.taken(arriving.new_kmers(rows.where("rid is not null"), K))


@query(_CUT + ", known as (select distinct c from kmer_known) select c, c in (select c from known) as known from (select distinct c from w)")
def kmer_membership(spark, sf_dir):
    """Which k-mers of the records are known ones."""
    return kmers.marked(records(spark, sf_dir), table(spark, sf_dir, "kmer_known"), K)


@query("select c, cast(list_sum(list_transform(range(31), lambda i: (instr('ACGT', c[i + 1:i + 1]) - 1) * power(4, 30 - i)::hugeint)) as bigint) as number, c as back from (select distinct c from kmer_known)")
def sorted_integers(spark, sf_dir):
    """Known k-mers as sorted numbers, and back."""
    known = table(spark, sf_dir, "kmer_known").distinct().withColumn("number", letters.to_number("c"))
    return known.withColumn("back", letters.from_number("number", K)).orderBy("number")


@query("select distinct c, c[1:10] as head, c[22:31] as tail, c[6:6] as sixth, instr('ACGT', c[6:6]) - 1 as code, reverse(translate(c, 'ACGT', 'TGCA')) as rc, c[1:1] || lower(c[2:12]) as shown, c[13:] as rest, least(c, reverse(translate(c, 'ACGT', 'TGCA'))) as canon from kmer_known")
def kmer_parts(spark, sf_dir):
    """Prefixes, suffixes, letters and strands of known k-mers."""
    c = table(spark, sf_dir, "kmer_known").distinct()
    return c.select("c", letters.prefix("c", 10).alias("head"), letters.suffix("c", 10).alias("tail"), letters.letter_at("c", 5).alias("sixth"), letters.nucleotide_code(letters.letter_at("c", 5)).cast("bigint").alias("code"), letters.reverse_complement("c").alias("rc"), letters.first_upper("c", 12).alias("shown"), letters.without_prefix("c", 12).alias("rest"), letters.canonical("c").alias("canon"))


@query(_CUT + ", both_strands as (select c as u from (select distinct c from w) union all select reverse(translate(c, 'ACGT', 'TGCA')) from (select distinct c from w)) select substr(u, 1, 4) as head, count(*) as n, count(distinct u) as different from both_strands group by head")
def complements_by_prefix(spark, sf_dir):
    """K-mers with their complements, by their first letters."""
    both = kmers.with_complements(kmers.kmer_set(records(spark, sf_dir), K))
    each = both.groupBy("u").agg(F.count("*").alias("n")).groupBy(F.left("u", F.lit(4)).alias("head"))
    return each.agg(F.sum("n").alias("n"), F.count("*").alias("different"))


@query(_CUT + ", uu as (select distinct u from w) select u from uu a where exists (select 1 from uu b where b.u[1:30] = a.u[2:31])")
def continued(spark, sf_dir):
    """K-mers that another one continues, one strand."""
    w = kmers.windows(records(spark, sf_dir), K, both_strands=False).select("u").distinct()
    return kmers.having_prefix(w, K - 1)


@query(_CUT + "select least(u, reverse(translate(u, 'ACGT', 'TGCA'))) as u from w group by 1")
def one_of_pair(spark, sf_dir):
    """One k-mer of each complementary pair."""
    return kmers.one_of_each_pair(kmers.windows(records(spark, sf_dir), K, both_strands=False).select("u"))


@query(_CUT + f""", firsts as (select c, min((rid, pos, u)) as f from w group by c),
ones as (select f[1] as rid, f[2] as pos, f[3] as u from firsts),
steps as (select *, least({K}, coalesce(lead(pos) over (partition by rid order by pos) - pos, {K})) as shown from ones)
select rid, string_agg(u[1:1] || lower(u[2:shown]), '' order by pos) as part from steps group by rid""")
def streaming_parts(spark, sf_dir):
    """The streaming superstring, record by record."""
    return superstrings.streaming(records(spark, sf_dir), K)


@query(_CUT + "select u, reverse(translate(u, 'ACGT', 'TGCA')) as v from (select distinct u from w) a where u <= reverse(translate(u, 'ACGT', 'TGCA')) and reverse(translate(u, 'ACGT', 'TGCA')) in (select u from w)")
def complement_pairs(spark, sf_dir):
    """31-mers that stand in records on both strands, with their complements."""
    return kmers.complement_pairs(kmers.windows(records(spark, sf_dir), K, both_strands=False, texts="u").select("u"))


_CUT12 = _CUT.replace(f"{K - 1}", "11").replace(f"{K}", "12")


@query(_CUT12 + ", n as (select u, least(count(*), case when u = reverse(translate(u, 'ACGT', 'TGCA')) then 2 else 1 end) as n from w group by u) select n, count(*) as kmers from n group by n")
def kmers_without_repeats(spark, sf_dir):
    """K6: 12-mers of one strand with a palindrome up to twice and any other once, by how often they are left."""
    left = kmers.without_repeats(kmers.windows(records(spark, sf_dir), 12, both_strands=False, texts="u").select("u"), 12)
    return left.groupBy("u").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("kmers"))


@query(_CUT + "select substr(c, 1, 4) as head, count(distinct c) as n, 1 as parts from w group by 1")
def kmers_by_prefix(spark, sf_dir):
    """K-mers dealt by their first letters; those with the same letters are in one partition."""
    dealt = kmers.by_prefix(kmers.kmer_set(records(spark, sf_dir), K).withColumnRenamed("c", "u")).select(F.left("u", F.lit(4)).alias("head"), F.spark_partition_id().alias("part"))
    return dealt.groupBy("head").agg(F.count("*").alias("n"), F.countDistinct("part").cast("int").alias("parts"))


@query(f"with r as (select distinct rid, upper(seq) as s from fasta_record where rid is not null and length(seq) >= {K}) select rid, length(s) - {K - 1} as windows, list_max(list_filter(range({K}), lambda d: right(s, d) = left(s, d))) as overlap from r")
def record_ends(spark, sf_dir):
    """windows of each record, and the letters that its end shares with its start, fewer than 31."""
    rows = records(spark, sf_dir).where(F.length("seq") >= K).select("rid", F.upper("seq").alias("s")).distinct()
    return rows.select("rid", letters.windows_in("s", K).cast("bigint").alias("windows"), letters.overlap(F.right("s", F.lit(K)), F.left("s", F.lit(K)), K).cast("bigint").alias("overlap"))


_MS = """
with ms as (select distinct ms_id, k, upper(superstring) as s, mask as m from masked_superstring where k > 0 and length(superstring) = length(mask) and length(mask) > 0 and translate(mask, '01', '') = '' and translate(superstring, 'ACGTacgt', '') = ''),
cut as (select ms_id, k, p as pos, s[p + 1:p + k] as u, m[p + 1:p + 1] = '1' as up from (select *, unnest(range(length(s) - k + 1)) as p from ms)),
w as (select *, least(u, reverse(translate(u, 'ACGT', 'TGCA'))) as c from cut),
rep as (select distinct ms_id, c from w where up),
placed as (select * from w semi join rep using (ms_id, c))
"""
_RUNS = "select ms_id, min(pos) as first, max(pos) as last from (select *, pos - row_number() over (partition by ms_id order by pos) as g from {0}) group by ms_id, g"


@query("select ms_id, case when superstring is null then 'no superstring' when mask is null then 'no mask' when translate(superstring, 'ACGTacgt', '') <> '' then 'letters' when translate(mask, '01', '') <> '' then 'digits' when length(mask) <> length(superstring) then 'length' end as fault from masked_superstring")
def superstring_faults(spark, sf_dir):
    """M8: what is wrong with each masked superstring."""
    return convert.faults(table(spark, sf_dir, "masked_superstring"))


@query(_MS + "select ms_id, c from rep")
def represented_kmers(spark, sf_dir):
    """M9, K9: the k-mers that each masked superstring stands for."""
    return masks.represented(superstring_rows(spark, sf_dir))


@query(_MS + ", ones as (select ms_id, min(pos) as pos from placed group by ms_id, c) " + _RUNS.format("ones"))
def mask_fewest_ones(spark, sf_dir):
    """M1: runs of the mask with the fewest ones."""
    return masks.runs(masks.fewest_ones(masks.placed(superstring_rows(spark, sf_dir))))


@query(_MS + _RUNS.format("placed"))
def mask_most_ones(spark, sf_dir):
    """Runs of the mask with the most ones, which are the intervals."""
    return masks.runs(masks.most_ones(masks.placed(superstring_rows(spark, sf_dir))))


_INSIDE = _MS + ", spans as (" + _RUNS.format("placed") + """), inside as (select distinct p.ms_id, s.first as i, c from placed p join spans s on s.ms_id = p.ms_id and p.pos between s.first and s.last),
forced as (select distinct ms_id, min(i) as i from inside group by ms_id, c having count(*) = 1),
covered as (select distinct ms_id, c from inside semi join forced using (ms_id, i)),
undecided as (select * from inside anti join forced using (ms_id, i) anti join covered using (ms_id, c))
"""


@query(_INSIDE + "select ms_id, i as interval, true as forced from forced union all select distinct ms_id, i, false from undecided")
def mask_presolve(spark, sf_dir):
    """Forced intervals, and those that are undecided."""
    forced, left = masks.presolved(masks.intervals(masks.placed(superstring_rows(spark, sf_dir))))
    return forced.withColumn("forced", F.lit(True)).union(left.select("ms_id", "interval").distinct().withColumn("forced", F.lit(False)))


@query(_INSIDE + "select ms_id, first, last from spans s where exists (select 1 from forced f where f.ms_id = s.ms_id and f.i = s.first) or exists (select 1 from undecided u where u.ms_id = s.ms_id)")
def mask_fewest_runs_approximately(spark, sf_dir):
    """M4: forced intervals, or all where those don't do."""
    return masks.fewest_runs_approximately(masks.placed(superstring_rows(spark, sf_dir)))


@query(_MS + "select ms_id, c from rep")
def mask_fewest_runs_decoded(spark, sf_dir):
    """M3: the k-mers under the mask with few runs; they must be the represented ones."""
    found = masks.placed(superstring_rows(spark, sf_dir))
    return masks.covered(found, masks.fewest_runs(found))


@query()
def mask_fewest_runs(spark, sf_dir):
    """M3: runs of the mask with few runs."""
    return masks.fewest_runs(masks.placed(superstring_rows(spark, sf_dir)))


@query(_MS + "select ms.ms_id, coalesce(max(pos) = any_value(length(s) - ms.k), false) as last_represented from ms left join placed p using (ms_id) group by ms.ms_id")
def mask_convention(spark, sf_dir):
    """M7: whether the last window is represented."""
    return masks.last_is_represented(superstring_rows(spark, sf_dir))


@query(_MS + ", letters as (select ms_id, unnest(string_split(s, '')) as a, unnest(string_split(m, '')) as b, unnest(range(length(s))) as p from ms) select ms_id, string_agg(case when b = '1' then a else lower(a) end, '' order by p) as seq from letters group by ms_id")
def joined_superstrings(spark, sf_dir):
    """Mask and superstring as one text."""
    return convert.join_case(superstring_rows(spark, sf_dir)).select("ms_id", "seq")


@query(_MS + "select ms_id, m as mask, s as superstring from ms")
def split_superstrings(spark, sf_dir):
    """Joined and split again."""
    return convert.split_case(convert.join_case(superstring_rows(spark, sf_dir)).select("ms_id", "seq")).select("ms_id", "mask", "superstring")


@query(_MS + ", bits as (select ms_id, k, s, p as pos from (select *, unnest(range(length(s))) as p from ms) where m[p + 1:p + 1] = '1'), runs as (" + _RUNS.format("bits") + ") select ms_id, row_number() over (partition by ms_id order by first) - 1 as sid, s[first + 1:last + k] as seq from runs join ms using (ms_id)")
def strings_of_superstrings(spark, sf_dir):
    """V3: the strings of each masked superstring."""
    return convert.to_strings(superstring_rows(spark, sf_dir)).withColumn("sid", F.col("sid").cast("bigint"))


@query("select distinct rid, upper(seq)[1:length(seq) - 30] || lower(seq[length(seq) - 29:]) as part from fasta_record where rid is not null and length(seq) >= 31")
def strings_to_superstring(spark, sf_dir):
    """V4, P5: records as parts of a masked superstring."""
    return convert.from_strings(records(spark, sf_dir), K).select("rid", "part")


@query(_MS + "select ms_id, translate(m, '01', 'AC') as swapped, m as mask from ms")
def swapped_masks(spark, sf_dir):
    """Masks in two letters and back."""
    rows = superstring_rows(spark, sf_dir).withColumn("swapped", F.col("mask"))
    return convert.swap_alphabet(convert.swap_alphabet(convert.swap_alphabet(rows, "swapped"), "mask"), "mask", back=True).select("ms_id", "swapped", "mask")


_EF_SQL = """
, a as (select *, len - n + 1 as u from b), l as (select *, case when u > n then length(bin(u // n)) - 1 else 0 end as low from a),
h as (select *, n + (u >> low) + 2 as high from l), p as (select *, length(bin(high - 1)) as ptr from h)
"""
_EF_BITS = "cast(64 * ceil((((high - n) // 512) * ptr + (n // 256) * ptr + high + n * low) / 64.0) as bigint)"


@query(_MS + ", bits as (select ms_id, unnest(range(length(m))) as p, unnest(string_split(m, '')) as x from ms), f as (select *, lag(x) over (partition by ms_id order by p) as y from bits), b as (select ms_id, count(*) as len, count(*) filter (where x = '1') as ones, count(*) filter (where x = '1' and y is distinct from '1') as runs, 1 + count(*) filter (where x <> y) as n from f group by ms_id)" + _EF_SQL + f"select ms_id, len as length, ones, runs, {_EF_BITS} as elias_fano from p")
def mask_sizes(spark, sf_dir):
    """E1, E2, E4, S13 and the Elias-Fano size: lengths, ones, runs and bits of masks."""
    return measures.mask_sizes(superstring_rows(spark, sf_dir))


@query(f"with r as (select distinct * from run_result where superstring > 1 and mask > 1), b as (select *, superstring - 1 as len, 2 * (mask - 1) as n from r)" + _EF_SQL + f"select dataset, k, method, superstring, mask, {_EF_BITS} as elias_fano from p")
def report_mask_bits(spark, sf_dir):
    """D17 and the Elias-Fano size of reported masks."""
    return measures.report_sizes(table(spark, sf_dir, "run_result"))


@query("select * from (pivot (select distinct dataset, k, method, case when superstring >= 0 then superstring end as superstring from run_result where dataset is not null and method is not null) on method using max(superstring) group by dataset, k)")
def report_grid(spark, sf_dir):
    """Reported lengths, a column a method."""
    return measures.report_grid(table(spark, sf_dir, "run_result"))


@query("with r as (select distinct dataset, k, method, superstring, mask from run_result where dataset is not null and k is not null) select r.dataset, r.k, r.method, r.superstring / b.superstring as over_bound from r join r b on r.dataset = b.dataset and r.k = b.k and b.method = 'lowerbound_length' where r.superstring > 0 and b.superstring > 0 and r.method <> 'lowerbound_length'")
def report_over_bound(spark, sf_dir):
    """Reported lengths over the lower bound of their dataset and k."""
    r = table(spark, sf_dir, "run_result").select("dataset", "k", "method", "superstring", "mask").distinct().where("superstring > 0")
    bound = r.where("method = 'lowerbound_length'").select("dataset", "k", F.col("superstring").alias("bound"))
    return r.where("method <> 'lowerbound_length'").join(bound, ["dataset", "k"]).select("dataset", "k", "method", (F.col("superstring") / F.col("bound")).alias("over_bound"))


@query(_MS + ", bits as (select ms_id, p as pos from (select *, unnest(range(length(m))) as p from ms) where m[p + 1:p + 1] = '1'), runs as (" + _RUNS.format("bits") + ") select ms_id, last - first + 1 as run_length, count(*) as n from runs group by all")
def mask_run_lengths(spark, sf_dir):
    """Lengths of runs of ones."""
    return measures.run_lengths(convert.ones(superstring_rows(spark, sf_dir))).withColumn("run_length", F.col("run_length").cast("bigint"))


@query(_MS + ", bits as (select ms_id, unnest(range(length(m))) as pos, unnest(string_split(m, '')) as x from ms), f as (select *, lag(x, 1, '1') over (partition by ms_id order by pos) as y from bits) select ms_id, pos from f where x <> y")
def mask_flips(spark, sf_dir):
    """Positions at which masks change."""
    return measures.flips(superstring_rows(spark, sf_dir)).withColumn("pos", F.col("pos").cast("bigint"))


@query(_MS + "select ms_id, count(*) as total, count(distinct c) as distinct_kmers from w group by ms_id")
def superstring_kmers(spark, sf_dir):
    """K-mers of whole superstrings, whatever the mask."""
    rows = superstring_rows(spark, sf_dir).withColumnRenamed("superstring", "seq")
    return measures.minimality(kmers.windows(rows, "k", "ms_id"), "ms_id")


@query(_CUT + ", a as (select distinct c from w), b as (select distinct c from kmer_known where c is not null), s as (select (select count(*) from a) as count_a, (select count(*) from b) as count_b, (select count(*) from (select c from a union select c from b)) as count_union) select *, count_a = count_union and count_b = count_union as equal from s")
def set_equality(spark, sf_dir):
    """E5: are the records' k-mers the known ones?"""
    return measures.set_equality(kmers.kmer_set(records(spark, sf_dir), K), table(spark, sf_dir, "kmer_known").where("c is not null"))


@query(_CUT + ", a as (select count(distinct c) as n from w) select n as count_a, n as count_b, n as count_union, true as equal from a")
def streaming_verified(spark, sf_dir):
    """The streaming superstring decoded again has the same k-mers. They are compared as numbers, as they leave the tasks, in one shuffle.

    The parts are written, as a task's number of partitions is asked for before they are cut, which would make them twice.
    """
    source = records(spark, sf_dir)
    parts = stage(superstrings.streaming(source, K).withColumnRenamed("part", "seq"))
    numbers = lambda rows: rows.select(F.col("number").alias("c"))
    return measures.set_equality(numbers(kmers.counted_in_batches(source, K)), numbers(kmers.counted_in_batches(parts, K).where("up")))


@query()
def superstring_bytes(spark, sf_dir):
    """Superstrings compressed by xz and bzip2."""
    return measures.compressed_sizes(superstring_rows(spark, sf_dir), "ms_id", "superstring")


_INDEX = """
with words as (select doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) as term from documents where doc_id is not null),
idx as (select term, doc_id, count(*) as freq from words group by all),
asked as (select doc_id as qid, unnest(regexp_extract_all(lower(court), '\\p{L}+')) as term from documents where doc_id % 50 = 0),
q as (select qid, term, count(*) as times from asked group by all),
need as (select qid, count(*) as need from q group by qid),
lens as (select doc_id, sum(freq) as len from idx group by doc_id),
norms as (select doc_id, len / (select avg(len) from lens) as norm from lens),
w as (select term, count(*) as df, greatest(1e-6, ln(((select count(*) from lens) - count(*) + 0.5) / (count(*) + 0.5))) as idf from idx group by term),
parts as (select qid, doc_id, times * idf * freq / (freq + 1.2 * (0.5 + 0.5 * norm)) as score from q join idx using (term) join w using (term) join norms using (doc_id)),
total as (select qid, doc_id, round(sum(score), 6) as score, count(*) as have from parts group by qid, doc_id)
"""
_RANKED = "select qid, rank, doc_id, score from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from total {0}) where rank <= 10"


def _index(spark, sf_dir):
    return postings.kept(table(spark, sf_dir, "documents"))


def _asked(spark, sf_dir):
    """Every 50th document asks for the words of its court."""
    return postings.query_terms(table(spark, sf_dir, "documents").where("doc_id % 50 = 0"), "doc_id", "court")


@query(_INDEX + "select term, doc_id, freq from idx")
def index_postings(spark, sf_dir):
    """The inverted lists of all documents."""
    return _index(spark, sf_dir)


@query(_INDEX + "select need.qid, count(have) filter (where have = need) as n from need left join total using (qid) group by need.qid")
def index_and(spark, sf_dir):
    """Documents with every term."""
    return postings.matching_all(_index(spark, sf_dir), _asked(spark, sf_dir))


@query(_INDEX + "select need.qid, count(doc_id) as n from need left join total using (qid) group by need.qid")
def index_or(spark, sf_dir):
    """Documents with any term."""
    return postings.matching_any(_index(spark, sf_dir), _asked(spark, sf_dir))


@query(_INDEX + _RANKED.format(""))
def index_ranked_or(spark, sf_dir):
    """The ten best documents by BM25."""
    return postings.ranked(_index(spark, sf_dir), _asked(spark, sf_dir)).withColumn("rank", F.col("rank").cast("bigint"))


@query(_INDEX + _RANKED.format("join need using (qid) where have = need"))
def index_ranked_and(spark, sf_dir):
    """The ten best documents of those with every term."""
    return postings.ranked(_index(spark, sf_dir), _asked(spark, sf_dir), every_term=True).withColumn("rank", F.col("rank").cast("bigint"))


@query(_INDEX + "select term, round(max(idf * freq / (freq + 1.2 * (0.5 + 0.5 * norm))), 6) as best from idx join w using (term) join norms using (doc_id) group by term")
def index_best_weights(spark, sf_dir):
    """Each term's largest score."""
    return postings.best_weights(_index(spark, sf_dir))


@query(_INDEX + "select term, count(*) as n from idx group by term having count(*) > 10")
def index_long_lists(spark, sf_dir):
    """Lists of more than ten documents."""
    return postings.long_lists(_index(spark, sf_dir), 10)


@query(_INDEX + "select qid, term, times from q where term in (select term from idx)")
def index_known_queries(spark, sf_dir):
    """The queries' terms that the index has."""
    return postings.known_queries(_asked(spark, sf_dir), _index(spark, sf_dir))


@query(_INDEX + "select least(need, 5) as terms, count(*) as queries from need group by 1")
def index_query_sizes(spark, sf_dir):
    """X11: queries by their number of terms."""
    return postings.by_size(_asked(spark, sf_dir))


def _sets(spark, sf_dir):
    return masks.represented(superstring_rows(spark, sf_dir))


_NODES = _MS + ", nodes as (select ms_id, c as u from rep union select ms_id, reverse(translate(c, 'ACGT', 'TGCA')) from rep), edges as (select a.ms_id, a.u, b.u as v from nodes a join nodes b on a.ms_id = b.ms_id and a.u[2:] = b.u[:-2])"


@query(_NODES + ", d as (select ms_id, u, (select count(*) from edges e where e.ms_id = n.ms_id and e.u = n.u) as outs, (select count(*) from edges e where e.ms_id = n.ms_id and e.v = n.u) as ins from nodes n) select ms_id, outs, ins, count(*) as n from d group by ms_id, outs, ins")
def graph_degrees(spark, sf_dir):
    """Edges of each set's graph, by degree."""
    return graph.degree_classes(graph.oriented(_sets(spark, sf_dir), "ms_id"), "ms_id")


@query(_NODES + """, outs as (select ms_id, u, min(v) as v from edges group by ms_id, u having count(*) = 1), ins as (select ms_id, v from edges group by ms_id, v having count(*) = 1)
select ms_id, u, v from outs semi join ins using (ms_id, v) where u <> v and v <> reverse(translate(u, 'ACGT', 'TGCA'))""")
def graph_unary_links(spark, sf_dir):
    """The edges inside unitigs."""
    return graph.unary_links(graph.oriented(_sets(spark, sf_dir), "ms_id"), "ms_id")


@query(_MS + "select ms_id, c from rep")
def graph_unitigs_decoded(spark, sf_dir):
    """The k-mers of all unitigs, which must be the sets again, each once."""
    sets = _sets(spark, sf_dir)
    k = superstring_rows(spark, sf_dir).select("ms_id", "k").distinct()
    return kmers.windows(graph.unitigs(sets, "ms_id").join(k, "ms_id"), "k", "ms_id").select("ms_id", "c")


@query()
def graph_unitigs(spark, sf_dir):
    """Unitigs of each set."""
    return graph.unitigs(_sets(spark, sf_dir), "ms_id")


_LINKS = """, outs as (select ms_id, u, min(v) as v from edges group by ms_id, u having count(*) = 1), ins as (select ms_id, v from edges group by ms_id, v having count(*) = 1),
links as (select ms_id, u, v from outs semi join ins using (ms_id, v) where u <> v and v <> reverse(translate(u, 'ACGT', 'TGCA')))"""


@query(_NODES.replace("\nwith ", "\nwith recursive ", 1) + _LINKS + """, starts as (select * from nodes anti join (select ms_id, v as u from edges) using (ms_id, u)),
walk as (select ms_id, u as head, u, 1 as n from starts union all select w.ms_id, w.head, l.v, n + 1 from walk w join links l on l.ms_id = w.ms_id and l.u = w.u),
ends as (select * from walk anti join (select ms_id, u from edges) using (ms_id, u))
select ms_id, n as kmers, count(*) // 2 as paths from ends group by ms_id, n""")
def graph_isolated_paths(spark, sf_dir):
    """Unitigs that hang together with no other, by their number of k-mers."""
    return graph.isolated_paths(_sets(spark, sf_dir), "ms_id").groupBy("ms_id", "kmers").agg(F.count("*").alias("paths"))


_OVERLAPS = _NODES + """, tails as (select ms_id, u, d, u[length(u) - d + 1:] as x from (select *, unnest(range(1, length(u))) as d from nodes)),
heads as (select distinct ms_id, d, u[:d] as x from (select *, unnest(range(1, length(u))) as d from nodes)),
best as (select ms_id, u, max(d) as d from tails semi join heads using (ms_id, d, x) group by ms_id, u),
costs as (select n.ms_id, length(n.u) - coalesce(d, 0) as j from nodes n left join best using (ms_id, u))
"""


@query(_OVERLAPS + "select ms_id, cast(floor(sum(case when j = 1 then 1 else j + 7 end) / 2) as bigint) as bound from costs group by ms_id")
def pareto_bound_runs(spark, sf_dir):
    """Lower bound of length and 7 for each run."""
    return graph.pareto_bound(graph.oriented(_sets(spark, sf_dir), "ms_id"), "ms_id", penalty=7)


@query(_OVERLAPS + "select ms_id, cast(floor(sum(case when j = 1 then 1 else j + 2 * (j - 1) end) / 2) as bigint) as bound from costs group by ms_id")
def pareto_bound_zeros(spark, sf_dir):
    """Lower bound of length and 2 for each zero."""
    return graph.pareto_bound(graph.oriented(_sets(spark, sf_dir), "ms_id"), "ms_id", penalty=2, runs=False)


@query(_OVERLAPS + "select ms_id, j as missing, count(*) as n from costs group by all")
def overlap_classes(spark, sf_dir):
    """How many letters each k-mer lacks at its longest overlap."""
    found = graph.longest_overlaps(graph.oriented(_sets(spark, sf_dir), "ms_id"), "ms_id")
    return found.groupBy("ms_id", (F.length("u") - F.col("overlap")).cast("bigint").alias("missing")).agg(F.count("*").alias("n"))


def _decoded(spark, sf_dir, parts):
    """The k-mers of superstrings in parts, as a set."""
    return greedy.decoded(parts, superstring_rows(spark, sf_dir).select("ms_id", "k").distinct(), "ms_id").select("ms_id", "c").distinct()


@query(_MS + "select ms_id, c from rep")
def simplitigs_decoded(spark, sf_dir):
    """All windows of the simplitigs, as a multiset: the sets again, each k-mer once."""
    k = superstring_rows(spark, sf_dir).select("ms_id", "k").distinct()
    return kmers.windows(greedy.simplitigs(_sets(spark, sf_dir), "ms_id").join(k, "ms_id"), "k", "ms_id").select("ms_id", "c")


@query(_MS + "select ms_id, c from rep")
def global_greedy_decoded(spark, sf_dir):
    """The k-mers of the global greedy superstring."""
    return _decoded(spark, sf_dir, greedy.joined(_sets(spark, sf_dir), "ms_id"))


@query(_MS + "select ms_id, c from rep")
def local_greedy_decoded(spark, sf_dir):
    """The k-mers of the local greedy superstring."""
    return _decoded(spark, sf_dir, greedy.joined(_sets(spark, sf_dir), "ms_id", deepest=5))


@query(_MS + "select ms_id, c from rep")
def pareto_decoded(spark, sf_dir):
    """The k-mers of a superstring with few runs, 8 letters for a run."""
    return _decoded(spark, sf_dir, greedy.joined(_sets(spark, sf_dir), "ms_id", penalty=8, steps=None))


@query()
def superstring_sizes(spark, sf_dir):
    """Length, ones and runs of the global greedy superstring."""
    return greedy.sizes(greedy.joined(_sets(spark, sf_dir), "ms_id"), "ms_id")


@query()
def length_bound(spark, sf_dir):
    """L1: lower bound of the length."""
    return greedy.length_bound(_sets(spark, sf_dir), "ms_id")


@query(_MS + "select ms_id, c from rep")
def strings_joined_decoded(spark, sf_dir):
    """The strings of each masked superstring joined greedily as they are; the k-mers of the result."""
    ms = superstring_rows(spark, sf_dir)
    strings = convert.to_strings(ms).join(unsent(ms.select("ms_id", "k").distinct()), "ms_id").select("ms_id", "k", "seq")
    return _decoded(spark, sf_dir, greedy.joined(None, "ms_id", strings=strings))


@query(_MS + "select ms_id, count(*) as fewest, true as most_are_not_fewer from rep group by ms_id")
def superstring_both_masks(spark, sf_dir):
    """Both masks of the global greedy superstring: the fewest ones are one for each k-mer, and the mask with the most holds them."""
    found = greedy.both_masks(greedy.joined(_sets(spark, sf_dir), "ms_id"), superstring_rows(spark, sf_dir).select("ms_id", "k").distinct(), "ms_id")
    each = found.groupBy("ms_id", "c").agg(F.count_if("one").alias("ones"), F.count("*").alias("n"))
    return each.groupBy("ms_id").agg(F.sum("ones").alias("fewest"), (F.sum("n") >= F.sum("ones")).alias("most_are_not_fewer"))


@query(_MS + "select ms_id, count(*) as ones, true as not_under_bound, true as not_over_simplitigs from rep group by ms_id")
def superstring_quality(spark, sf_dir):
    """Ones of the global greedy superstring (one for each k-mer), and whether its length lies between the lower bound and the simplitigs one after another."""
    sets = _sets(spark, sf_dir)
    size = greedy.sizes(greedy.joined(sets, "ms_id"), "ms_id")
    plain = greedy.sizes(greedy.joined(sets, "ms_id", 1), "ms_id").select("ms_id", F.col("length").alias("plain"))
    both = size.join(unsent(greedy.length_bound(sets, "ms_id")), "ms_id").join(unsent(plain), "ms_id")
    return both.select("ms_id", "ones", (F.col("length") >= F.col("bound")).alias("not_under_bound"), (F.col("length") <= F.col("plain")).alias("not_over_simplitigs"))


@query(_NODES + """, outs as (select ms_id, u, min(v) as v from edges group by ms_id, u having count(*) = 1), ins as (select ms_id, v from edges group by ms_id, v having count(*) = 1),
links as (select ms_id, u, v from outs semi join ins using (ms_id, v) where u <> v and v <> reverse(translate(u, 'ACGT', 'TGCA'))),
heads as (select * from nodes anti join (select ms_id, v as u from links) using (ms_id, u)), n as (select ms_id, count(*) // 2 as unitigs from heads group by ms_id)
select n.ms_id, unitigs, (select count(*) from rep where rep.ms_id = n.ms_id) as kmers from n""")
def graph_unitig_counts(spark, sf_dir):
    """Unitigs of each set and the k-mers in them; each begins where no unary link leads, once on either strand."""
    return graph.unitigs(_sets(spark, sf_dir), "ms_id").groupBy("ms_id").agg(F.count("*").alias("unitigs"), F.sum("kmers").alias("kmers"))


@query("with r as (select distinct dataset, k, method, superstring, mask from run_result), n as (select distinct dataset, k, mask as kmers from r where method = 'kmer_count' and mask > 0), b as (select r.*, kmers, superstring - 1 as len, 2 * (mask - 1) as n from r join n using (dataset, k) where superstring > 1 and mask > 1 and method <> 'kmer_count' and method not like 'lowerbound%')" + _EF_SQL + f"select distinct dataset, k, method, 2 * (superstring - 1) + {_EF_BITS} as bits, (2 * (superstring - 1) + {_EF_BITS}) / kmers as per_kmer from p")
def report_bits(spark, sf_dir):
    """Bits of letters and masks together, and for each k-mer."""
    return measures.bits_per_letter(table(spark, sf_dir, "run_result"))
