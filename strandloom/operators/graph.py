"""Overlap graphs of k-mers: edges, degrees, unitigs, and the bounds that need no search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.letters import reverse_complement
from ..runtime import stage, unsent


def oriented(sets: DataFrame, *keys: str) -> DataFrame:
    """Both strands of k-mer sets (keys, c): keys, u. A palindrome stands twice, as the multiset does."""
    return sets.select(*keys, F.col("c").alias("u")).unionAll(sets.select(*keys, reverse_complement("c").alias("u")))


def edges(nodes: DataFrame, *keys: str) -> DataFrame:
    """De Bruijn edges of k-mers u of one set: keys, u, v with the last k - 1 letters of u as the first of v. At most four for a u."""
    n = nodes.distinct()
    a = n.withColumn("x", F.expr("right(u, length(u) - 1)"))
    b = n.select(*keys, F.col("u").alias("v"), F.expr("left(u, length(u) - 1)").alias("x"))
    return a.join(unsent(b), [*keys, "x"]).select(*keys, "u", "v")


def degrees(nodes: DataFrame, *keys: str) -> DataFrame:
    """keys, u, outs, ins of every k-mer."""
    e = edges(nodes, *keys)
    ends = e.select(*keys, "u", F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(e.select(*keys, F.col("v").alias("u"), F.lit(0), F.lit(1)))
    ends = ends.unionAll(nodes.distinct().select(*keys, "u", F.lit(0), F.lit(0)))
    return ends.groupBy(*keys, "u").agg(F.sum("o").alias("outs"), F.sum("i").alias("ins"))


def degree_classes(nodes: DataFrame, *keys: str) -> DataFrame:
    """How many k-mers have so many edges: keys, outs, ins, n."""
    return degrees(nodes, *keys).groupBy(*keys, "outs", "ins").agg(F.count("*").alias("n"))


def isolated(nodes: DataFrame, *keys: str) -> DataFrame:
    """k-mers without edges: keys, u."""
    return degrees(nodes, *keys).where("outs = 0 and ins = 0").select(*keys, "u")


def unary_links(nodes: DataFrame, *keys: str) -> DataFrame:
    """Edges inside unitigs: the only one out of u and the only one into v, and not back into u's own strand. keys, u, v."""
    e = edges(nodes, *keys)
    out = e.groupBy(*keys, "u").agg(F.count("*").alias("n"), F.min("v").alias("v")).where("n = 1").drop("n")
    into = e.groupBy(*keys, "v").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    return out.join(unsent(into), [*keys, "v"], "left_semi").where((F.col("u") != F.col("v")) & (F.col("v") != reverse_complement("u")))


def chains(links: DataFrame, nodes: DataFrame, *keys: str) -> DataFrame:
    """Each node's chain and place along links of which none leaves or enters a node twice: keys, u, head, place (from 0).

    Pointers to predecessors are doubled by joins, so the rounds grow with the logarithm of the longest chain.
    A cycle has its smallest node as head, and is cut before it.
    """
    on = [*keys, "u"]
    start = nodes.distinct().join(unsent(links.select(*keys, F.col("u").alias("p"), F.col("v").alias("u"))), on, "left")
    now = stage(start.select(*on, "p", F.when(F.col("p").isNull(), 0).otherwise(1).cast("bigint").alias("place"), F.least("u", F.coalesce("p", "u")).alias("low"), F.lit(False).alias("done")))
    longest = None
    while True:
        jump = now.select(*keys, F.col("u").alias("p"), F.col("p").alias("p2"), F.col("place").alias("more"), F.col("low").alias("low2"))
        now = stage(now.join(unsent(jump), [*keys, "p"], "left").select(*on, F.coalesce("p2", "p").alias("p"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.least("low", F.coalesce("low2", "low")).alias("low"), F.col("p2").isNull().alias("done")))
        open_ = now.where("not done").count()
        if open_ == 0:
            break
        if longest == open_ and _only_cycles(now, keys):
            break
        longest = open_
    flat = now.where("done").select(*on, F.coalesce("p", "u").alias("head"), "place")
    rings = now.where("not done").select(*on, F.col("low").alias("head"))
    if rings.isEmpty():
        return flat
    cut = links.join(unsent(rings.select(*keys, F.col("head").alias("v")).distinct()), [*keys, "v"], "left_anti").join(unsent(rings.select(*on)), on, "left_semi")
    return flat.union(chains(cut, rings.select(*on), *keys))


def _only_cycles(now: DataFrame, keys) -> bool:
    """Whether every open pointer stays among open ones."""
    return now.where("not done").join(unsent(now.where("done").select(*keys, F.col("u").alias("p"))), [*keys, "p"], "left_semi").isEmpty()


def spelled(placed: DataFrame, *keys: str) -> DataFrame:
    """Strings of chains of k-mers that overlap by k - 1: keys, head, kmers, seq."""
    out = placed.groupBy(*keys, "head").agg(F.count("*").alias("kmers"), F.array_sort(F.collect_list(F.struct("place", F.right("u", F.lit(1)).alias("x")))).alias("xs"))
    return out.select(*keys, "head", "kmers", F.concat("head", F.expr("array_join(transform(slice(xs, 2, size(xs)), y -> y.x), '')")).alias("seq"))


def unitigs(sets: DataFrame, *keys: str, both_strands: bool = True) -> DataFrame:
    """Maximal unbranched paths of k-mer sets (keys, c): keys, kmers, seq, the smaller strand of each once.

    ``kmers`` counts the path's k-mers. A path that is its own reverse complement never arises from odd k.
    """
    nodes = oriented(sets, *keys).distinct() if both_strands else sets.select(*keys, F.col("c").alias("u"))
    nodes = stage(nodes)
    out = spelled(chains(stage(unary_links(nodes, *keys)), nodes, *keys), *keys)
    if both_strands:
        out = out.withColumn("seq", F.least("seq", reverse_complement("seq")))
    return out.select(*keys, "kmers", "seq").distinct()


def isolated_paths(sets: DataFrame, *keys: str, both_strands: bool = True) -> DataFrame:
    """Unitigs that no k-mer of the set leads into and none continues: keys, kmers, seq. They can be left out of any matching of paths."""
    nodes = oriented(sets, *keys) if both_strands else sets.select(*keys, F.col("c").alias("u"))
    into = nodes.select(*keys, F.expr("right(u, length(u) - 1)").alias("x")).distinct()
    out = nodes.select(*keys, F.expr("left(u, length(u) - 1)").alias("y")).distinct()
    k = F.length("seq") - F.col("kmers") + 1
    paths = unitigs(sets, *keys, both_strands=both_strands).withColumn("x", F.left("seq", k - 1)).withColumn("y", F.right("seq", k - 1))
    return paths.join(unsent(into), [*keys, "x"], "left_anti").join(unsent(out), [*keys, "y"], "left_anti").select(*keys, "kmers", "seq")


def longest_overlaps(nodes: DataFrame, *keys: str) -> DataFrame:
    """The longest overlap below k of each k-mer's end with any k-mer's start, its own included: keys, u, overlap.

    Most have one of k - 1, which one join tells; only the others are tried at every length.
    """
    n = nodes.distinct()
    full = n.withColumn("x", F.expr("right(u, length(u) - 1)")).join(unsent(n.select(*keys, F.expr("left(u, length(u) - 1)").alias("x")).distinct()), [*keys, "x"], "left_semi").select(*keys, "u")
    rest = n.join(unsent(full), [*keys, "u"], "left_anti")
    d = F.expr("sequence(1, length(u) - 2)")
    tails = rest.where("length(u) > 2").select(*keys, "u", F.explode(d).alias("d")).withColumn("x", F.expr("right(u, d)"))
    heads = n.where("length(u) > 2").select(*keys, "u", F.explode(d).alias("d")).select(*keys, "d", F.expr("left(u, d)").alias("x")).distinct()
    some = tails.join(unsent(heads), [*keys, "d", "x"], "left_semi").groupBy(*keys, "u").agg(F.max("d").alias("overlap"))
    found = full.withColumn("overlap", F.expr("length(u) - 1")).unionByName(rest.join(unsent(some), [*keys, "u"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0))))
    return found


def pareto_bound(nodes: DataFrame, *keys: str, penalty: int, runs: bool = True, both_strands: bool = True) -> DataFrame:
    """Lower bound of length and penalty together: keys, bound.

    A k-mer adds 1 if another continues it with k - 1 letters, else the j letters that are missing at its longest overlap
    and the penalty: once for runs, for each letter but one for zeros. Half of it for both strands.
    """
    j = F.length("u") - F.col("overlap")
    cost = F.when(j == 1, 1).otherwise(j + penalty * (F.lit(1) if runs else j - 1))
    total = F.sum(cost)
    return longest_overlaps(nodes, *keys).groupBy(*keys).agg((F.floor(total / 2) if both_strands else total).cast("bigint").alias("bound"))
