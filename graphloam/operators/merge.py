"""Operators on covers: overlaps, containment, epsilon merges, meta-graphs, ordered folds."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import overlap
from .components import components, cut

#: Two sets of which one holds the other: their ratio is over this.
CONTAINED = 1 - 1e-5


def sizes(cover: DataFrame) -> DataFrame:
    return cover.groupBy("comm_id").agg(F.count("*").alias("n"))


def wrap(members: DataFrame, comm_id: int = 0) -> DataFrame:
    """(comm_id, member): one set of members (member) as a cover."""
    return members.select(F.lit(comm_id).cast("long").alias("comm_id"), "member").distinct()


def union_of(cover: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, members): the sorted union of each pair (a, b) of communities."""
    both = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("comm_id")).join(cover, "comm_id")
    return both.groupBy("a", "b").agg(F.array_sort(F.collect_set("member")).alias("members"))


def exact_dedup(cover: DataFrame) -> DataFrame:
    """One community of each set of members: the smallest comm_id."""
    sets = cover.groupBy("comm_id").agg(F.array_sort(F.collect_set("member")).alias("m"))
    return sets.groupBy("m").agg(F.min("comm_id").alias("comm_id")).select("comm_id", F.explode("m").alias("member"))


def overlap_pairs(cover: DataFrame) -> DataFrame:
    """(a, b, shared, na, nb) for a < b of communities that share a member, by a join on members (an inverted index).

    The result has a row for each pair, so a member of k communities makes k² / 2 rows; where only containment or merging
    matters see ``contained_pairs`` and ``ordered_fold``, which don't list pairs."""
    x, y = cover.select("member", F.col("comm_id").alias("a")), cover.select("member", F.col("comm_id").alias("b"))
    both = x.join(y, "member").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    n = sizes(cover)
    return both.join(n.select(F.col("comm_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("comm_id").alias("b"), F.col("n").alias("nb")), "b")


def contained_pairs(cover: DataFrame) -> DataFrame:
    """(a, b): communities a whose members are all in b, a <> b.  Candidates share the member of a that fewest have."""
    c = cut(cover.select("comm_id", "member").distinct())
    often = c.groupBy("member").agg(F.count("*").alias("k"))
    counted = c.join(often, "member").groupBy("comm_id").agg(F.count("*").alias("n"), F.min_by("member", F.struct("k", "member")).alias("rare"))
    size = counted.select(F.col("comm_id").alias("b"), F.col("n").alias("nb"))
    near = counted.select(F.col("comm_id").alias("a"), F.col("n").alias("na"), F.col("rare").alias("member")).join(c.withColumnRenamed("comm_id", "b"), "member").where("a <> b")
    near = near.join(size, "b").where("na <= nb").select("a", "b", "na")
    shared = near.join(c.withColumnRenamed("comm_id", "a"), "a").join(c.withColumnRenamed("comm_id", "b"), ["b", "member"])
    return shared.groupBy("a", "b", "na").agg(F.count("*").alias("shared")).where("shared = na").select("a", "b")


def maximal(cover: DataFrame) -> DataFrame:
    """Communities that no other contains (of equal ones the smallest comm_id): the order-free containment merge."""
    one = cut(exact_dedup(cover))
    return one.join(contained_pairs(one).select(F.col("a").alias("comm_id")).distinct(), "comm_id", "left_anti")


def merge_overlapping(cover: DataFrame, eps: float, min_size: int = 1, inclusive: bool = False) -> DataFrame:
    """Union of all communities that are linked by overlap ratios over ``eps``; those of at most ``min_size`` are dropped.

    The order-free form of the epsilon fold: it follows chains of overlaps, so it can be coarser than a fold."""
    p = overlap_pairs(cover)
    ratio = overlap(F.col("shared"), F.col("na"), F.col("nb"))
    links = p.where(ratio >= eps if inclusive else ratio > eps).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    comp = components(links)
    out = cover.join(comp, cover.comm_id == comp.v, "left").select(F.coalesce("comp", "comm_id").alias("comm_id"), "member").distinct()
    return out.join(sizes(out).where(F.col("n") > min_size), "comm_id", "left_semi")


def meta_graph(cover: DataFrame, eps: float) -> DataFrame:
    """(a, b, jaccard): communities whose Jaccard similarity is over ``eps``."""
    jac = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return overlap_pairs(cover).withColumn("jaccard", jac).where(F.col("jaccard") > eps).select("a", "b", "jaccard")


def complete_meta_graph(cover: DataFrame, min_size: int = 1, most: int = 5000) -> DataFrame:
    """(a, b) for a < b of all communities of over ``min_size`` members.

    The result is every pair, whose number is the square of the communities'; over ``most`` of them are an error."""
    n = sizes(cover).where(F.col("n") > min_size).select("comm_id")
    if n.count() > most:
        raise ValueError(f"over {most} communities have too many pairs")
    listed = n.agg(F.array_sort(F.collect_list("comm_id")).alias("all"))  # ``most`` ids at most
    return n.select(F.col("comm_id").alias("a")).join(F.broadcast(listed)).select("a", F.explode(F.filter("all", lambda x: x > F.col("a"))).alias("b"))


class Fold:
    """An ordered list of sets into which new ones are merged: each into the first that it overlaps enough.

    mode ``containment``: ratio over 1 - 1e-5.  ``epsilon``: ratio over ``eps``; sets of at most ``min_size`` are not
    appended.  ``last``: at least ``eps``; smaller sets and exact copies are passed over and a merged set moves to the
    end.  ``compat`` (epsilon): a set that merges with another than the very first old one is appended as well.
    Members point to the sets that hold them, so only sets that share one are compared."""

    def __init__(self, mode: str = "containment", eps: float = 0.25, min_size: int = 1, compat: bool = False):
        self.mode, self.eps, self.min_size, self.compat = mode, CONTAINED if mode == "containment" else eps, min_size, compat and mode == "epsilon"
        self.sets: dict[int, set] = {}
        self.place: dict[int, int] = {}
        self.holds: dict[int, set] = defaultdict(set)
        self.name: dict[frozenset, int] = {}
        self.next = 0

    def append(self, new: set, key: int) -> None:
        self.sets[key], self.place[key] = set(new), self.next
        self.next += 1
        self.name[frozenset(new)] = key
        for v in new:
            self.holds[v].add(key)

    def match(self, new: set) -> int | None:
        for key in sorted({k for v in new for k in self.holds[v]}, key=self.place.__getitem__):
            old = self.sets[key]
            ratio = len(new & old) / min(len(new), len(old))
            if ratio > self.eps or (self.mode == "last" and ratio >= self.eps):
                return key
        return None

    def add(self, new: set, key: int, plain: bool = False, others: bool = False) -> None:
        """Merge or append; ``plain``: append without comparing; ``others``: other lists have older sets than these."""
        if not new or (self.mode != "containment" and len(new) <= self.min_size and (plain or self.mode == "last")):
            return
        if plain:
            return self.append(new, key)
        if self.mode == "last" and frozenset(new) in self.name:
            return
        old = self.match(new)
        if old is None:
            if self.mode == "containment" or len(new) > self.min_size:
                self.append(new, key)
            return
        first = not others and self.place[old] == 0
        self._merge(old, new)
        if self.compat and not first and len(new) > self.min_size:
            self.append(new, key)

    def _merge(self, old: int, new: set) -> None:
        if self.mode == "last":
            both = frozenset(self.sets[old] | new)
            del self.name[frozenset(self.sets[old])]
            for v in self.sets.pop(old):
                self.holds[v].discard(old)
            if both not in self.name:
                self.append(both, old)
            return
        for v in new - self.sets[old]:
            self.holds[v].add(old)
        self.sets[old] |= new

    def result(self) -> list[tuple[int, list[int]]]:
        return [(k, sorted(self.sets[k])) for k in sorted(self.sets, key=self.place.__getitem__)]


def fold(sets: Iterable[Iterable[int]], mode: str = "containment", eps: float = 0.25, min_size: int = 1, compat: bool = False, batches: Iterable[int] | None = None, start: Iterable[Iterable[int]] = ()) -> list[list[int]]:
    """The ordered folds of ``Fold`` over lists.  ``start``: sets that are there before (a left cover).

    batches: the batch of each set; with ``compat`` those of the first batch that has a set of over ``min_size`` members
    are appended unmerged."""
    out = Fold(mode, eps, min_size, compat)
    for k, s in enumerate(start):
        out.append(set(s), -1 - k)
    rows = [(set(s), b) for s, b in zip(sets, batches if batches is not None else iter(lambda: 0, 1), strict=False)]
    first = None if batches is None or not out.compat or out.sets else next((b for s, b in rows if len(s) > min_size), None)
    for k, (s, b) in enumerate(rows):
        out.add(s, k, plain=first is not None and b == first)
    return [s for _, s in out.result()]


def ordered_fold(sets: DataFrame, mode: str = "containment", eps: float = 0.25, min_size: int = 1, compat: bool = False) -> DataFrame:
    """(comm_id, member): the ordered fold of all sets (pos, m[, batch][, plain]) in the order of ``pos``, exactly.

    comm_id is the pos of the set that began a community.  Sets that share no member (mode ``containment``: of which none
    holds the other) never merge, so each connected component of sets is folded by itself, in one task, as the fold is in
    sequence; ``maximal`` and ``merge_overlapping`` are the forms that spread any component.  With ``compat`` and a column
    ``batch`` the first batch is appended unmerged; sets whose column ``plain`` is true (a left cover) are, too."""
    has = set(sets.columns)
    rows = sets.select("pos", "m", (F.col("batch") if "batch" in has else F.lit(None)).cast("long").alias("batch"), (F.col("plain") if "plain" in has else F.lit(False)).alias("plain"))
    rows = cut(rows.where(F.size("m") > 0))
    each = rows.select(F.col("pos").alias("comm_id"), F.explode("m").alias("member"))
    if mode == "containment":
        links = contained_pairs(each).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    else:
        low = each.groupBy("member").agg(F.min("comm_id").alias("src"))
        links = each.join(low, "member").select("src", F.col("comm_id").alias("dst")).where("src <> dst").distinct()
    comp = components(links)
    compat = compat and mode == "epsilon"
    first = rows.where(F.col("plain") | (F.size("m") > min_size)).agg(F.min(F.struct("batch", "pos")).alias("b"), F.min("pos").alias("pos")).first()
    batch, begin = (first.b.batch if first.b else None), first.pos
    kind = F.col("plain") | (F.lit(compat and batch is not None) & (F.col("batch") == F.lit(batch)))
    named = rows.join(comp, rows.pos == comp.v, "left").select(F.coalesce("comp", "pos").alias("grp"), "pos", "m", F.coalesce(kind, F.lit(False)).alias("plain"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = Fold(mode, eps, min_size, compat)
        pdf = pdf.sort_values("pos")
        others = begin not in set(pdf.pos)
        for pos, m, plain in zip(pdf.pos.tolist(), pdf.m, pdf.plain.tolist(), strict=True):
            out.add(set(m.tolist()), pos, plain, others)
        return pd.DataFrame([(k, v) for k, s in out.result() for v in s], columns=["comm_id", "member"], dtype="int64")

    return named.groupBy("grp").applyInPandas(run, "comm_id long, member long")


def reduce_covers(left: DataFrame, right: DataFrame, mode: str = "containment", eps: float = 0.25, min_size: int = 1, compat: bool = False) -> DataFrame:
    """(comm_id, member): every community of ``right`` folded, in the order of comm_id, into the cover ``left``.

    comm_id are 2 * that of a left community, 2 * that of a right one + 1.  Ids must not be negative."""
    gather = lambda c: c.groupBy("comm_id").agg(F.array_sort(F.collect_set("member")).alias("m"))
    top = left.agg(F.coalesce(F.max("comm_id"), F.lit(-1)).alias("t")).first().t + 1
    both = gather(left).select(F.col("comm_id").alias("pos"), "m", F.lit(True).alias("plain")).unionByName(gather(right).select((F.col("comm_id") + top).alias("pos"), "m", F.lit(False).alias("plain")))
    out = ordered_fold(both, mode, eps, min_size, compat)
    return out.select(F.when(F.col("comm_id") < top, 2 * F.col("comm_id")).otherwise(2 * (F.col("comm_id") - top) + 1).alias("comm_id"), "member")
