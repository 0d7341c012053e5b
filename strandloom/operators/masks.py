"""Masks of superstrings: fewest ones, most ones, fewest runs; intervals and what they force."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stage, unsent
from .components import components
from .convert import join_case
from .kmers import block_runs, in_blocks, islands, windows


def placed(ms: DataFrame, both_strands: bool = True) -> DataFrame:
    """All windows of superstrings whose k-mer is represented: ms_id, k, pos, c, up (it has a one)."""
    w = windows(join_case(ms), "k", "ms_id", both_strands=both_strands, texts="c")
    return w.join(unsent(w.where("up").select("ms_id", "c").distinct()), ["ms_id", "c"], "left_semi").select("ms_id", "k", "pos", "c", "up")


def represented(ms: DataFrame, both_strands: bool = True) -> DataFrame:
    """The k-mer set of each masked superstring: ms_id, c."""
    return windows(join_case(ms), "k", "ms_id", both_strands=both_strands, texts="c").where("up").select("ms_id", "c").distinct()


def fewest_ones(windows_: DataFrame) -> DataFrame:
    """One position for each k-mer, the first: ms_id, pos."""
    return windows_.groupBy("ms_id", "c").agg(F.min("pos").alias("pos")).select("ms_id", "pos")


def most_ones(windows_: DataFrame) -> DataFrame:
    """Every position of a represented k-mer: ms_id, pos."""
    return windows_.select("ms_id", "pos")


def runs(positions: DataFrame) -> DataFrame:
    """Runs of ones: ms_id, first, last."""
    return islands(positions, ["ms_id"])


def written(ms: DataFrame, ones: DataFrame) -> DataFrame:
    """``mask`` of superstrings from runs of ones (ms_id, first, last): ms_id, k, superstring, mask."""
    lists = ones.groupBy("ms_id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))
    text = F.expr("""rpad(array_join(transform(coalesce(runs, array()), (r, i) -> repeat('0', cast(r.first - if(i = 0, 0, runs[i - 1].last + 1) as int)) || repeat('1', cast(r.last - r.first + 1 as int))), ''), length(superstring), '0')""")
    return ms.join(lists, "ms_id", "left").select("ms_id", "k", "superstring", text.alias("mask"))


def last_is_represented(ms: DataFrame) -> DataFrame:
    """Whether each superstring's last window is represented, as the conventions of masks expect: ms_id, last_represented."""
    found = placed(ms).groupBy("ms_id").agg(F.max("pos").alias("last"))
    return ms.join(unsent(found), "ms_id", "left").select("ms_id", F.coalesce(F.col("last") == F.length("superstring") - F.col("k"), F.lit(False)).alias("last_represented"))


def _with_intervals(windows_: DataFrame) -> DataFrame:
    """``windows_`` with the first position of the interval that each is in."""
    rows = in_blocks(windows_, ["ms_id"])
    found = block_runs(rows, ["ms_id"]).select("ms_id", "_b", "_g", F.col("first").alias("interval"))
    return rows.join(unsent(found), ["ms_id", "_b", "_g"]).drop("_b", "_g")


def intervals(windows_: DataFrame) -> DataFrame:
    """Maximal runs of positions with represented k-mers, and the k-mers in them: ms_id, interval (its first position), c."""
    return _with_intervals(windows_).select("ms_id", "interval", "c").distinct()


def covered(windows_: DataFrame, chosen: DataFrame) -> DataFrame:
    """The k-mers in chosen intervals (ms_id, first): ms_id, c."""
    return intervals(windows_).join(unsent(chosen.select("ms_id", F.col("first").alias("interval"))), ["ms_id", "interval"], "left_semi").select("ms_id", "c").distinct()


def presolved(inside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Intervals that a k-mer forces (ms_id, interval), and the rows of ``intervals`` that are left: undecided intervals and k-mers not covered yet."""
    once = inside.groupBy("ms_id", "c").agg(F.count("*").alias("n"), F.min("interval").alias("interval")).where("n = 1")
    forced = once.select("ms_id", "interval").distinct()
    covered = inside.join(unsent(forced), ["ms_id", "interval"], "left_semi").select("ms_id", "c").distinct()
    return forced, inside.join(unsent(forced), ["ms_id", "interval"], "left_anti").join(unsent(covered), ["ms_id", "c"], "left_anti")


def fewest_runs_approximately(windows_: DataFrame) -> DataFrame:
    """The forced intervals where they cover all k-mers, else all intervals: ms_id, first, last."""
    spans, inside = runs(most_ones(windows_)), intervals(windows_)
    forced, left = presolved(inside)
    open_ = left.select("ms_id").distinct()
    chosen = forced.union(spans.join(unsent(open_), "ms_id", "left_semi").select("ms_id", F.col("first").alias("interval"))).distinct()
    return spans.join(unsent(chosen.withColumnRenamed("interval", "first")), ["ms_id", "first"], "left_semi").select("ms_id", "first", "last")


def shrunk(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists of intervals (ms_id, s, interval) of which each needs one chosen: the chosen ones (ms_id, interval), and the rows that are left.

    In rounds: a list that holds all of another is met with it; an interval that is in no list without a certain other one
    is not needed; the only interval of a list is chosen. None of these makes the smallest choice larger.
    """
    left, chosen = stage(lists), None
    rows = left.count()
    while rows:
        both = left.join(unsent(left.select("ms_id", "interval", F.col("s").alias("t"))), ["ms_id", "interval"]).groupBy("ms_id", "s", "t").agg(F.count("*").alias("n"))
        size = left.groupBy("ms_id", "s").agg(F.count("*").alias("of_s"))
        both = both.where("s <> t").join(unsent(size), ["ms_id", "s"]).join(unsent(size.toDF("ms_id", "t", "of_t")), ["ms_id", "t"])
        met = both.where("n = of_s and (of_s < of_t or s < t)").select("ms_id", F.col("t").alias("s")).distinct()
        left = stage(left.join(unsent(met), ["ms_id", "s"], "left_anti"))

        both = left.join(unsent(left.select("ms_id", "s", F.col("interval").alias("other"))), ["ms_id", "s"]).groupBy("ms_id", "interval", "other").agg(F.count("*").alias("n"))
        size = left.groupBy("ms_id", "interval").agg(F.count("*").alias("of_i"))
        both = both.where("interval <> other").join(unsent(size), ["ms_id", "interval"]).join(unsent(size.toDF("ms_id", "other", "of_o")), ["ms_id", "other"])
        idle = both.where("n = of_i and (of_i < of_o or other < interval)").select("ms_id", "interval").distinct()
        left = stage(left.join(unsent(idle), ["ms_id", "interval"], "left_anti"))

        only = stage(left.groupBy("ms_id", "s").agg(F.count("*").alias("n"), F.min("interval").alias("interval")).where("n = 1").select("ms_id", "interval").distinct())
        chosen = only if chosen is None else chosen.union(only)
        done = left.join(unsent(only), ["ms_id", "interval"], "left_semi").select("ms_id", "s").distinct()
        left = stage(left.join(unsent(done), ["ms_id", "s"], "left_anti"))
        before, rows = rows, left.count()
        if rows == before:
            break
    return (lists.select("ms_id", "interval").limit(0) if chosen is None else chosen), left


def smallest_cover(lists: list[frozenset[int]], most: int) -> set[int] | None:
    """A smallest choice of numbers with one of every list, None if it takes more than ``most``: branch and bound, to the end."""
    picked: set[int] = set()
    while True:
        kept: list[frozenset[int]] = []
        for s in sorted(set(lists), key=lambda s: (len(s), sorted(s))):
            if not any(t <= s for t in kept):
                kept.append(s)
        if kept and not kept[0]:
            return None
        where: dict[int, set[int]] = {}
        for n, s in enumerate(kept):
            for i in s:
                where.setdefault(i, set()).add(n)
        only = {i for s in kept if len(s) == 1 for i in s}
        idle = {i for i, at in where.items() if any(at <= where[j] and (len(at) < len(where[j]) or j < i) for j in kept[min(at)] if j != i)}
        if only:
            picked |= only
            lists = [s for s in kept if not s & only]
        elif idle:
            lists = [s - idle for s in kept]
        else:
            break
    if len(picked) > most or not kept:
        return picked if len(picked) <= most else None
    apart, taken = 0, set()
    for s in kept:
        if not s & taken:
            apart += 1
            taken |= s
    if len(picked) + max(apart, -(-len(kept) // max(map(len, where.values())))) > most:
        return None
    group, grow = {0}, [0]
    while grow:
        near = {m for i in kept[grow.pop()] for m in where[i]} - group
        group |= near
        grow += near
    if len(group) < len(kept):
        for part in ([kept[n] for n in sorted(group)], [s for n, s in enumerate(kept) if n not in group]):
            found = smallest_cover(part, most - len(picked))
            if found is None:
                return None
            picked |= found
        return picked
    best, tried = None, frozenset()
    for i in sorted(kept[0], key=lambda i: (-len(where[i]), i)):
        found = smallest_cover([s - tried for s in kept if i not in s], most - len(picked) - 1)
        if found is not None:
            best = picked | {i} | found
            most = len(best) - 1
        tried |= {i}
    return best


def fewest_runs(windows_: DataFrame) -> DataFrame:
    """The fewest intervals that cover every k-mer: ms_id, first, last.

    Forced intervals first. What is left is shrunk by joins, each k-mer's list of intervals being kept once, and falls into components of
    intervals with common k-mers, each of which is solved for itself by branch and bound. That always runs to the end, so the number is the
    least one at every size; the time for a large component that doesn't shrink can grow exponentially, as the problem is NP-hard.
    """
    spans = runs(most_ones(windows_))
    forced, left = presolved(intervals(windows_))
    sets = left.groupBy("ms_id", "c").agg(F.array_sort(F.collect_set("interval")).alias("choices")).groupBy("ms_id", "choices").agg(F.min("c").alias("s"))
    chosen, rest = shrunk(sets.select("ms_id", "s", F.explode("choices").alias("interval")))
    node = lambda i: F.xxhash64("ms_id", i)
    sets = stage(rest.groupBy("ms_id", "s").agg(F.array_sort(F.collect_list("interval")).alias("choices")).withColumn("a", node(F.col("choices")[0])))
    edges = sets.select("a", F.explode("choices").alias("i"), "ms_id").select("a", node(F.col("i")).alias("b"))
    found = components(edges).withColumnRenamed("node", "a")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        need = [frozenset(x) for x in pdf["choices"]]
        pick = smallest_cover(need, len(need))
        return pd.DataFrame({"ms_id": pdf["ms_id"].iloc[0], "interval": sorted(pick)})

    solved = sets.join(unsent(found), "a").select("component", "ms_id", "choices").groupBy("component", "ms_id").applyInPandas(solve, "ms_id string, interval bigint")
    chosen = forced.union(chosen).union(solved).withColumnRenamed("interval", "first").distinct()
    return spans.join(unsent(chosen), ["ms_id", "first"], "left_semi").select("ms_id", "first", "last")
