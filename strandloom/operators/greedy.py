"""Superstrings by greedy joining: simplitigs, local and global greedy, and paths over used k-mers (Pareto).

Unbranched paths are put together first. Each of these pieces has two ends, and an end is the k - 1 letters that lead out of it. Joins have a cost: the letters that
are missing from the overlap, and a penalty. In each round an end looks for partners at the least cost at which any end of another path fits, and only ends that are both at
their least cost are joined; so the joins are those that one greedy pass in the order of cost takes. Ends with the same letters are numbered and paired number by number: a
round has as many rows as there are free ends and lengths, however many ends fit each other. Of the pairs of a path the first is joined, so no ring closes; then both
paths are one, and the ends that are left look again.

On both strands an end fits another if its letters are the other's reverse complement, and a join is made once for both strands: classes of
a string and its reverse complement are joined to paths, so no k-mer is written on both strands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.letters import reverse_complement
from ..runtime import stage, unsent
from .graph import chains, oriented, unitigs
from .kmers import windows

#: Ends with the same letters that are numbered in one task, about.
NUMBERED = 200_000
#: Parts of a chain that are decoded in one task, about.
BLOCK = 1 << 14


def _pieces(sets: DataFrame, key: str, both_strands: bool) -> DataFrame:
    """Unitigs: key, k, id, seq. Ids are unique; the table is written, so they stay."""
    k = sets.groupBy(key).agg(F.max(F.length("c")).alias("k"))
    return stage(unitigs(sets, key, both_strands=both_strands).select(key, "seq").join(unsent(k), key).withColumn("id", F.monotonically_increasing_id()))


def _nodes(pieces: DataFrame, key: str, both_strands: bool) -> DataFrame:
    """Pieces in every orientation: key, k, node (2 * id, one more for the reverse complement), u."""
    one = pieces.select(key, "k", (F.col("id") * 2).alias("node"), F.col("seq").alias("u"))
    return one.union(pieces.select(key, "k", F.col("id") * 2 + 1, reverse_complement("seq"))) if both_strands else one


def _ends(pieces: DataFrame, key: str, both_strands: bool) -> DataFrame:
    """key, k, end (2 * id for where the piece ends, one more for where it starts), path (of the piece), w: the end's letters, on both strands as they lead out."""
    start = F.left("seq", F.col("k") - 1)
    one = pieces.select(key, "k", (F.col("id") * 2).alias("end"), F.col("id").alias("path"), F.right("seq", F.col("k") - 1).alias("w"))
    return one.union(pieces.select(key, "k", F.col("id") * 2 + 1, "id", reverse_complement(start) if both_strands else start))


def _fitting(ends: DataFrame, key: str, first: int, last: int, both_strands: bool, rings: bool) -> DataFrame:
    """Ends at every number of missing letters from ``first`` to ``last`` at which an end of another path fits: key, k, end, path, missing, x, role.

    x are the letters; ends of roles 0 and 1 fit each other, those of role 2 (their own reverse complement) fit among themselves.
    """
    rows = ends.select(key, "k", "end", "path", "w", F.explode(F.array(*map(F.lit, range(first, last + 1))).cast("array<int>")).alias("missing")).where("missing < k")
    d = F.col("k") - F.col("missing")
    rows = rows.withColumn("y", F.right("w", d))
    if both_strands:
        other = reverse_complement("y")
        role = F.when(F.col("y") < other, 0).when(F.col("y") > other, 1).otherwise(2)
        rows = rows.withColumn("role", role).withColumn("x", F.least("y", other))
    else:
        start = F.col("end") % 2 == 1
        rows = rows.withColumn("role", start.cast("int")).withColumn("x", F.when(start, F.left("w", d)).otherwise(F.col("y")))
    rows = rows.select(key, "k", "end", "path", "missing", "x", "role")
    group = [key, "missing", "x"]
    sizes_ = rows.groupBy(*group).agg(*(F.count_if(F.col("role") == i).alias(f"n{i}") for i in range(3))).where("n0 > 0 and n1 > 0 or n2 > 1")
    rows = rows.join(unsent(sizes_), group)
    if rings:
        return rows.drop("n0", "n1", "n2")
    mine = Window.partitionBy(*group, "path")
    own = F.when(F.col("role") == 2, F.count("*").over(mine)).when(F.col("role") == 0, F.count_if(F.col("role") == 1).over(mine)).otherwise(F.count_if(F.col("role") == 0).over(mine))
    fits = F.when(F.col("role") == 2, F.col("n2")).when(F.col("role") == 0, F.col("n1")).otherwise(F.col("n0"))
    return rows.withColumn("ok", fits > own).where("ok").drop("n0", "n1", "n2", "ok")


def _paired(rows: DataFrame, key: str, offset: int, salts: int) -> DataFrame:
    """Rows of ``_fitting`` paired by number within their letters: key, a, path_a, b, path_b, missing.

    Of the ends with the same letters the larger side is turned by ``offset``. A path has at most two ends on a side, so of three offsets one finds an end another path's.
    """
    group = [key, "missing", "x", "salt"]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("end", F.lit(offset)), F.lit(salts)))
    every, same = Window.partitionBy(*group), Window.partitionBy(*group, "role")
    rows = rows.withColumns({f"n{i}": F.count_if(F.col("role") == i).over(every) for i in range(3)})
    rows = rows.withColumn("i", F.row_number().over(same.orderBy(F.xxhash64("end"), "end")) - 1)
    small, large, alone = F.least("n0", "n1"), F.greatest("n0", "n1"), F.col("role") == 2
    few = F.when(F.col("n0") <= F.col("n1"), 0).otherwise(1) == F.col("role")
    slot = F.when(alone, F.floor(F.pmod(F.col("i") + offset, F.col("n2")) / 2)).when(few, F.col("i")).otherwise(F.pmod(F.col("i") - offset, large))
    kept = rows.withColumn("slot", slot.cast("bigint")).where(F.when(alone, F.col("slot") * 2 + 1 < F.col("n2")).otherwise(F.col("slot") < small))
    two = F.struct("role", "end", "path")
    pairs = kept.groupBy(*group, F.col("role") == 2, "slot").agg(F.min(two).alias("a"), F.max(two).alias("b"))
    return pairs.select(key, F.col("a.end").alias("a"), F.col("a.path").alias("path_a"), F.col("b.end").alias("b"), F.col("b.path").alias("path_b"), "missing")


def _first_of_paths(pairs: DataFrame, key: str) -> DataFrame:
    """The pairs (with cost) that are the first, in the order of cost and a hash, for both their paths."""
    columns = [key, "a", "path_a", "b", "path_b", "missing", "cost"]
    rank = F.struct("cost", F.xxhash64("a", "b"), "a", "b")
    sides = pairs.select(*columns, rank.alias("rank"), F.explode(F.array("path_a", "path_b")).alias("path"))
    first = sides.withColumn("first", F.col("rank") == F.min("rank").over(Window.partitionBy("path")))
    return first.groupBy(*columns).agg(F.bool_and("first").alias("sel")).where("sel").drop("sel")


class _Joining:
    """Free ends, and the joins so far. ``penalty`` for every join with more than one letter missing, or with ``zeros`` for each such letter but one."""

    def __init__(self, pieces: DataFrame, key: str, both_strands: bool, rings: bool, penalty: int = 0):
        self.key, self.both, self.rings, self.penalty = key, both_strands, rings, penalty
        self.ends = stage(_ends(pieces, key, both_strands))
        self.free, self.rounds = self.ends.count(), 0
        self.done: list[DataFrame] = []

    def run(self, first: int, last: int, walks: DataFrame | None = None) -> None:
        """All joins with ``first`` to ``last`` letters missing, or by ``walks`` (key, a, b, cost: ends), in the order of cost."""
        idle = 0
        while self.free > 1 and idle < 3:
            pairs = stage(self.step(first, last, walks))
            n = pairs.count()
            idle = 0 if n else idle + 1
            self.rounds += 1
            if n:
                self.take(pairs, n)
            elif idle == 1 and self.looking.isEmpty():  # else other numbers may bring ends of different paths together
                return

    def step(self, first: int, last: int, walks: DataFrame | None) -> DataFrame:
        key, missing = self.key, F.col("missing")
        salts = -(-self.free // NUMBERED)
        direct = _fitting(self.ends, key, first, last, self.both, self.rings).withColumn("cost", missing + F.when(missing > 1, self.penalty).otherwise(0))
        look = direct.select("end", "cost")
        if walks is not None:
            side = lambda x: self.ends.select(F.col("end").alias(x), F.col("path").alias(f"path_{x}"))
            walks = walks.join(unsent(side("a")), "a").join(unsent(side("b")), "b").where("path_a <> path_b").select(key, "a", "path_a", "b", "path_b", F.lit(0).alias("missing"), "cost")
            look = look.unionByName(walks.select(F.explode(F.array("a", "b")).alias("end"), "cost"))
        least = look.groupBy("end").agg(F.min("cost").alias("cost"))
        self.looking = least
        pairs = _paired(direct.join(unsent(least), ["end", "cost"], "left_semi"), key, self.rounds, salts).withColumn("cost", missing + F.when(missing > 1, self.penalty).otherwise(0))
        if walks is not None:
            at = lambda x: least.withColumnRenamed("end", x)
            pairs = pairs.unionByName(walks.join(unsent(at("a")), ["a", "cost"], "left_semi").join(unsent(at("b")), ["b", "cost"], "left_semi"))
        return pairs if self.rings else _first_of_paths(pairs.where("path_a <> path_b"), key)

    def take(self, pairs: DataFrame, n: int) -> None:
        self.done.append(pairs.select(self.key, "a", "b", "missing"))
        left = self.ends.join(unsent(pairs.select(F.explode(F.array("a", "b")).alias("end"))), "end", "left_anti")
        if not self.rings:
            now = pairs.select(F.explode(F.array("path_a", "path_b")).alias("path"), F.least("path_a", "path_b").alias("now"))
            left = left.join(unsent(now), "path", "left").withColumn("path", F.coalesce("now", "path")).drop("now")
        self.ends, self.free = stage(left.select(self.ends.columns)), self.free - 2 * n

    def joins(self) -> DataFrame | None:
        """key, a, b (ends), missing (0 for a walk)."""
        out = None
        for x in self.done:
            out = x if out is None else out.unionByName(x)
        return out


def _links(joins: DataFrame, key: str, both_strands: bool) -> DataFrame:
    """Joins of ends as steps from node to node, on both strands each with its mirror: key, u, v, missing."""
    flip = lambda x: F.col(x).bitwiseXOR(F.lit(1))
    if not both_strands:
        tail, head = F.when(F.col("a") % 2 == 0, F.col("a")).otherwise(F.col("b")), F.when(F.col("a") % 2 == 1, F.col("a")).otherwise(F.col("b"))
        return joins.select(key, tail.alias("u"), (head - 1).alias("v"), "missing")
    return joins.select(key, F.col("a").alias("u"), flip("b").alias("v"), "missing").union(joins.select(key, "b", flip("a"), "missing"))


def _better(front: DataFrame, best: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``front`` that are cheaper than the best ones so far for their ends."""
    return front.join(unsent(best.select(*on, F.col("cost").alias("had"))), on, "left").where("had is null or cost < had").drop("had")


def _cheapest(walks: DataFrame, on: list[str]) -> DataFrame:
    return walks.groupBy(*on).agg(F.min(F.struct("cost", "letters")).alias("w")).select(*on, "w.*")


def _walks(nodes: DataFrame, free: DataFrame, key: str, most: Column) -> DataFrame:
    """key, u, v, cost, letters: shortest walks over k-mers of the set from the end of node u to the start of v, of up to ``most`` letters, between free ends.

    What follows the end of an unbranched path is the start of one, so walks go over whole paths, from one to the next by k - 1 letters (at most four).
    A walk that skips letters costs no less than the direct join by what is left of its overlap, so none does.
    """
    on = [key, "k", "u", "at"]
    tails = nodes.select(key, F.col("node").alias("at"), F.expr("right(u, k - 1)").alias("x"))
    heads = nodes.select(key, F.col("node").alias("next"), F.expr("left(u, k - 1)").alias("x"), F.expr("if(length(u) - k + 1 < 2 * k, right(u, length(u) - k + 1), null)").alias("more"), F.expr("substr(u, k, 1)").alias("one"))
    follows = stage(tails.join(unsent(heads), [key, "x"]).drop("x"))
    starts = nodes.join(unsent(free.select(key, F.col("end").alias("node"))), [key, "node"], "left_semi")

    def onward(front: DataFrame) -> DataFrame:
        step = front.join(unsent(follows.where("more is not null")), [key, "at"]).withColumn("letters", F.concat("letters", "more")).withColumn("cost", F.length("letters"))
        return _cheapest(step.where(F.col("cost") < most).select(key, "k", "u", F.col("next").alias("at"), "cost", "letters"), on)

    begin = stage(starts.select(key, "k", F.col("node").alias("u"), F.col("node").alias("at"), F.lit(0).alias("cost"), F.lit("").alias("letters")))
    front = stage(onward(begin))
    best = front
    while not front.isEmpty():
        front = stage(_better(onward(front), best, on))
        best = stage(_cheapest(best.unionByName(front), on))
    hits = best.join(unsent(follows), [key, "at"]).select(key, "u", F.col("next").alias("v"), F.concat("letters", "one").alias("letters"))
    return _cheapest(hits.withColumn("cost", F.length("letters")), [key, "u", "v"])


def _walks_with_gaps(sets: DataFrame, nodes: DataFrame, key: str, penalty: int, both_strands: bool) -> DataFrame:
    """As ``_walks``, where a letter without a one (in lower case) costs ``penalty`` more: cheapest walks over k-mers of the set that may skip letters anywhere, direct joins too."""
    on = [key, "k", "n", "u"]
    kmers = stage((oriented(sets, key) if both_strands else sets.select(key, F.col("c").alias("u"))).distinct())
    d = F.explode(F.sequence(F.lit(1), F.length("u") - 1)).alias("d")
    entries = stage(kmers.where("length(u) > 1").select(key, F.col("u").alias("v"), d).withColumn("x", F.expr("left(v, d)")))
    heads = nodes.select(key, F.expr("left(u, k)").alias("u"), F.col("node").alias("v"))
    front = stage(nodes.select(key, "k", F.col("node").alias("n"), F.expr("right(u, k)").alias("u"), F.lit(0).alias("cost"), F.lit("").alias("letters")))
    best = front.limit(0)
    while not front.isEmpty():
        out = front.where("k > 1").select(*on, "cost", "letters", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("d"))
        out = out.withColumn("cost", F.col("cost") + F.col("k") - F.col("d") + penalty * (F.col("k") - 1 - F.col("d"))).where(F.col("cost") <= (F.col("k") - 1) * (penalty + 1))
        step = out.withColumn("x", F.expr("right(u, d)")).drop("u").join(unsent(entries), [key, "d", "x"])
        step = step.withColumn("letters", F.concat("letters", F.lower(F.expr("substr(v, d + 1, k - d - 1)")), F.expr("right(v, 1)")))
        front = stage(_better(_cheapest(step.withColumnRenamed("v", "u").select(*on, "cost", "letters"), on), best, on))
        best = stage(_cheapest(best.unionByName(front), on))
    return _cheapest(best.join(unsent(heads), [key, "u"]).select(key, F.col("n").alias("u"), "v", "cost", "letters"), [key, "u", "v"])


def _as_ends(walks: DataFrame, key: str, both_strands: bool) -> DataFrame:
    """Walks between nodes as unordered pairs of ends, each once with its least cost: key, a, b, cost."""
    a, b = F.col("u"), F.col("v").bitwiseXOR(F.lit(1))
    pairs = walks.select(key, (F.least(a, b) if both_strands else a).alias("a"), (F.greatest(a, b) if both_strands else b).alias("b"), "cost")
    return pairs.where("a <> b").groupBy(key, "a", "b").agg(F.min("cost").alias("cost"))


def _bands(longest: int) -> list[tuple[int, int]]:
    """Numbers of missing letters that are tried together; one letter joins most ends, so the others are tried for what it leaves."""
    return [(lo, hi) for lo, hi in ((1, 1), (2, longest)) if lo <= hi <= longest]


def joined(sets: DataFrame | None, key: str, deepest: int | None = None, penalty: int = 0, steps: int | None = 0, both_strands: bool = True, zeros: bool = False, strings: DataFrame | None = None) -> DataFrame:
    """Parts of a masked superstring of each k-mer set (key, c): key, chain, place, part.

    Overlaps are tried from k - 1 down to k - ``deepest``: 1 gives simplitigs, None every length (the global greedy).
    With ``steps`` a walk of up to so many letters (None: as many as are cheaper than a new run) over k-mers that are written elsewhere may join
    strings too, if it is cheaper than the letters and the ``penalty`` of a new run, or with ``zeros`` of each letter without a one; those k-mers
    have ones again. The parts of a chain in the order of place are its text with the mask as case; the chains in any order are the superstring.
    ``strings`` (key, k, seq) in place of ``sets`` are joined as they are: they are trusted to hold each k-mer of the set once.
    """
    if strings is not None:
        given = strings.where("length(seq) >= k").select(key, F.col("k").cast("int").alias("k"), F.upper("seq").alias("seq"))
        pieces = stage(given.withColumn("id", F.monotonically_increasing_id()))
        sets = windows(given, "k", key, both_strands=both_strands, texts="c").select(key, "c").distinct() if zeros else None
    else:
        sets = stage(sets.select(key, "c").distinct())
        pieces = _pieces(sets, key, both_strands)
    nodes = _nodes(pieces, key, both_strands)
    longest = (pieces.agg(F.max("k")).first()[0] or 1) - 1
    longest = longest if deepest is None else min(longest, deepest)
    joining, walked = _Joining(pieces, key, both_strands, False, penalty), None
    if steps == 0:
        for first, last in _bands(longest):
            joining.run(first, last)
    elif longest >= 1:
        most = F.col("k") - 1 + penalty
        if not zeros:
            joining.run(1, 1)
        walks = _walks_with_gaps(sets, nodes, key, penalty, both_strands) if zeros else _walks(nodes, joining.ends, key, most if steps is None else F.least(most, F.lit(steps)))
        walked = stage(walks if steps is None else walks.where(F.length("letters") <= steps))
        between = stage(_as_ends(walked, key, both_strands))
        joining.run(2, 1 if zeros else longest, between)
    joins = joining.joins()
    links = stage(_links(joins, key, both_strands)) if joins is not None else None
    return _parts(nodes, links, walked, key, both_strands)


def _parts(nodes: DataFrame, links: DataFrame | None, walked: DataFrame | None, key: str, both_strands: bool) -> DataFrame:
    on = nodes.select(key, F.col("node").alias("u"))
    if links is None:
        links = on.select(key, "u", F.lit(0).cast("bigint").alias("v"), F.lit(0).alias("missing")).limit(0)
    placed = chains(links.select(key, "u", "v"), on, key)
    if walked is not None:
        by = walked.select(key, "u", "v", "letters", F.lit(0).alias("missing"))
        links = links.join(unsent(by), [key, "u", "v", "missing"], "left")
    else:
        links = links.withColumn("letters", F.lit(None).cast("string"))
    rows = placed.join(unsent(links.select(key, "u", "missing", "letters")), [key, "u"], "left")
    if both_strands:  # of a chain and its mirror, the one whose first node is the smaller
        last = rows.groupBy(key, "head").agg(F.max_by("u", "place").alias("last"))
        rows = rows.join(unsent(last.where(F.col("head") <= F.col("last").bitwiseXOR(F.lit(1))).select(key, "head")), [key, "head"], "left_semi")
    rows = rows.withColumnRenamed("u", "node").join(unsent(nodes), [key, "node"])
    tail = F.expr("right(u, k - 1)")
    walk = F.expr("array_join(zip_with(split(left(upper(right(u, k - 1) || letters), length(letters) - 1), ''), split(left(letters, length(letters) - 1), ''), (x, m) -> if(m = upper(m), x, lower(x))), '')")
    rest = F.when(F.col("letters").isNotNull(), walk).otherwise(F.lower(F.left(tail, F.coalesce(F.col("missing") - 1, F.col("k") - 1))))
    part = F.concat(F.left("u", F.length("u") - F.col("k") + 1), rest)
    return rows.select(key, F.col("head").alias("chain"), "place", part.alias("part"))


def simplitigs(sets: DataFrame, key: str, both_strands: bool = True) -> DataFrame:
    """Disjoint paths that hold every k-mer once: key, chain, seq."""
    parts = joined(sets, key, 1, both_strands=both_strands)
    text = parts.groupBy(key, "chain").agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("x"))
    return text.select(key, "chain", F.upper(F.expr("array_join(transform(x, y -> y.part), '')")).alias("seq"))


def superstring(parts: DataFrame, key: str) -> DataFrame:
    """The whole text of each set, for a sink: key, seq."""
    return parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chain", "place", "part"))).alias("x")).select(key, F.expr("array_join(transform(x, y -> y.part), '')").alias("seq"))


def _with_next(parts: DataFrame, ks: DataFrame, key: str) -> DataFrame:
    """``parts`` with ``seq``: each part with the k - 1 letters that follow it in its chain, so no task holds a superstring; chains are read in blocks. ``ks``: key, k."""
    block, most = F.floor(F.col("place") / BLOCK), (ks.agg(F.max("k")).first()[0] or 1) - 1
    rows = parts.withColumn("block", block)
    before = rows.where((F.col("block") > 0) & (F.col("place") - F.col("block") * BLOCK < most)).withColumn("block", F.col("block") - 1)  # the next block's first parts, for their letters
    rows = rows.withColumn("own", F.lit(True)).unionByName(before.withColumn("own", F.lit(False))).join(unsent(ks), key)
    follow = Window.partitionBy(key, "chain", "block").orderBy("place").rowsBetween(1, max(1, most))
    rows = rows.withColumn("after", F.array_join(F.collect_list(F.left("part", F.col("k") - 1)).over(follow), "")).where("own")
    return rows.select(key, "k", "chain", "place", F.concat("part", F.left("after", F.col("k") - 1)).alias("seq"))


def decoded(parts: DataFrame, ks: DataFrame, key: str, both_strands: bool = True) -> DataFrame:
    """The k-mers with a one of superstrings in parts, as windows of the text: key, c. ``ks``: key, k."""
    return windows(_with_next(parts, ks, key), "k", key, both_strands=both_strands, texts="c").where("up").select(key, "c")


def both_masks(parts: DataFrame, ks: DataFrame, key: str, both_strands: bool = True) -> DataFrame:
    """Fewest and most ones of one superstring: key, chain, place, pos (in the part), one (it is among the fewest), c. Every position of a k-mer of the set has a row.

    The greedy superstring writes each k-mer with one one, so its own mask has the fewest; a window within a chain that is in the set has a one in the other mask.
    Windows over the seam of two chains aren't looked at.
    """
    w = windows(_with_next(parts, ks, key), "k", key, "chain", "place", both_strands=both_strands, texts="c")
    return w.join(unsent(w.where("up").select(key, "c").distinct()), [key, "c"], "left_semi").select(key, "chain", "place", "pos", F.col("up").alias("one"), "c")


def sizes(parts: DataFrame, key: str) -> DataFrame:
    """Letters, ones and runs of ones of superstrings in parts: key, length, ones, runs."""
    upper = F.regexp_replace("part", "[a-z]", "")
    return parts.groupBy(key).agg(F.sum(F.length("part")).alias("length"), F.sum(F.length(upper)).alias("ones"), F.sum(F.regexp_count("part", F.lit("[a-z]+"))).alias("runs"))


def length_bound(sets: DataFrame, key: str, both_strands: bool = True) -> DataFrame:
    """Lower bound of the length of a superstring, by greedy joining in which rings are allowed: key, bound."""
    sets = stage(sets.select(key, "c").distinct())
    pieces = _pieces(sets, key, both_strands)
    joining = _Joining(pieces, key, both_strands, rings=True)
    for first, last in _bands((pieces.agg(F.max("k")).first()[0] or 1) - 1):
        joining.run(first, last)
    total = pieces.groupBy(key, "k").agg(F.sum(F.length("seq")).alias("total"))
    joins = joining.joins()
    if joins is None:
        return total.select(key, F.col("total").alias("bound"))
    saved = joins.join(unsent(total), key).groupBy(key).agg(F.sum(F.col("k") - F.col("missing")).alias("saved"))
    return total.join(unsent(saved), key, "left").select(key, (F.col("total") - F.coalesce("saved", F.lit(0))).cast("bigint").alias("bound"))
