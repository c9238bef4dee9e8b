"""Versioned blocks: as-of reads, diffs between revisions, what watchers must pin, retention, and
parent-closed sets of tree nodes.

``changes``: (file_id, blk, rev[, value]); a block without a change is as it was at revision 0."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled

KEYS = ["file_id", "blk"]


def rev_at(changes: DataFrame, at: int) -> DataFrame:
    """(file_id, blk, rev): the last revision up to ``at`` that changed the block."""
    return changes.where(F.col("rev") <= at).groupBy(*KEYS).agg(F.max("rev").alias("rev"))


def snapshot(changes: DataFrame, at: int, keys: list[str], value: str = "value") -> DataFrame:
    """``keys`` and the last value up to ``at``; keys whose last value is null are gone. Of several
    values of one key and revision the greatest counts."""
    last = changes.where(F.col("rev") <= at).groupBy(*keys).agg(F.max(F.struct("rev", value)).alias("_last"))
    return last.select(*keys, F.col("_last")[value].alias(value)).where(F.col(value).isNotNull())


def get_or_none(snap: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """``asked`` with the value of each key; null where it is absent or deleted."""
    return asked.join(snap, keys, "left")


def diff(old: DataFrame, new: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``keys``, old, new where they differ; null stands for an absent key."""
    both = old.select(*keys, F.col(value).alias("old")).join(new.select(*keys, F.col(value).alias("new")), keys, "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def patch(old: DataFrame, delta: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``old`` after a diff (``keys``, old, new)."""
    kept = old.join(delta.select(*keys), keys, "left_anti").select(*keys, value)
    return kept.unionByName(delta.where(F.col("new").isNotNull()).select(*keys, F.col("new").alias(value)))


def compose(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """One diff of a run of them (``keys``, rev, old, new): the first old, the last new. A link of
    the run whose old isn't the new before it fails: the diffs are not of one history."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("rev")  # the diffs of one key
    broken = (F.row_number().over(w) > 1) & ~F.col("old").eqNullSafe(F.lag("new").over(w))
    checked = deltas.withColumn("_broken", broken)
    both = checked.groupBy(*keys).agg(F.min_by("old", "rev").alias("old"), F.max_by("new", "rev").alias("new"), F.max("_broken").alias("_broken"))
    whole = F.when(F.col("_broken"), F.raise_error(F.concat(F.lit("duplicate entries: "), F.to_json(F.struct(*keys)))).cast("boolean")).otherwise(F.lit(True))
    return both.where(whole & ~F.col("old").eqNullSafe(F.col("new"))).select(*keys, "old", "new")


def reverse(delta: DataFrame) -> DataFrame:
    """The diff that undoes a diff."""
    return delta.select(*(c for c in delta.columns if c not in ("old", "new")), F.col("new").alias("old"), F.col("old").alias("new"))


def between(changes: DataFrame, lo: int, hi: int, tracked: DataFrame | None = None) -> DataFrame:
    """Changes of revisions in (lo, hi], of ``tracked`` (file_id, blk) only if given."""
    out = changes.where((F.col("rev") > lo) & (F.col("rev") <= hi))
    return out if tracked is None else out.join(tracked.select(*KEYS).distinct(), KEYS, "left_semi")


def pins(changes: DataFrame, tracked: DataFrame, at: int, head: int) -> DataFrame:
    """(file_id, blk, rev): what a watcher of ``at`` must hold back while the head is at ``head``."""
    seen = changes.where(F.col("rev") <= head).groupBy(*KEYS).agg(F.max(F.when(F.col("rev") <= at, F.col("rev"))).alias("rev"), F.max("rev").alias("_last"))
    moved = seen.where(F.col("_last") > at).select(*KEYS, F.coalesce("rev", F.lit(0).cast("long")).alias("rev"))
    return moved.join(tracked.select(*KEYS).distinct(), KEYS, "left_semi")


def pins_in(pinned: DataFrame, file_id, lo: int, hi: int) -> DataFrame:
    """Those of ``pinned`` (file_id, blk, rev) that a mapping of blocks [lo, hi) shows."""
    return pinned.where((F.col("file_id") == file_id) & (F.col("blk") >= lo) & (F.col("blk") < hi))


def pin_update(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_id, blk, rev): pins to send when a watcher moves on; null revision: back to the head."""
    both = before.select(*KEYS, F.col("rev").alias("was")).join(after, KEYS, "full_outer")
    return both.where(~F.col("was").eqNullSafe(F.col("rev"))).select(*KEYS, "rev")


def conflicts(changes: DataFrame, written: DataFrame, base: int) -> DataFrame:
    """Blocks of ``written`` (file_id, blk) that were also committed after ``base``."""
    return written.join(changes.where(F.col("rev") > base).select(*KEYS).distinct(), KEYS, "left_semi")


def stats(changes: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """One row: files, blocks, changes, head, least and pinned blocks."""
    one = changes.agg(F.count_distinct("file_id").alias("files"), F.count_distinct(*KEYS).alias("blocks"), F.count(F.lit(1)).alias("changes"), F.max("rev").alias("head"), F.min("rev").alias("tail"))
    if pinned is None:
        return one.withColumn("pinned", F.lit(0).cast("long"))
    return one.crossJoin(pinned.agg(F.count(F.lit(1)).alias("pinned")))  # a row each


# ---- retention ----


@dataclass(frozen=True)
class Tail:
    """The part of a history that is kept: revisions in (tail, head] of the tracked blocks. What lies
    at or before ``tail`` can't be asked for."""

    changes: DataFrame
    tail: int
    head: int
    tracked: DataFrame | None = None

    def track(self, blocks: DataFrame) -> Tail:
        """Follows further blocks (file_id, blk)."""
        more = blocks.select(*KEYS)
        return Tail(self.changes, self.tail, self.head, more if self.tracked is None else self.tracked.unionByName(more).distinct())

    def update(self, changes: DataFrame, head: int) -> Tail:
        """A commit, or a run of them, up to the new ``head``."""
        if head < self.head:
            raise ValueError(f"the head can't go back from {self.head} to {head}")
        return Tail(self.changes.unionByName(changes.select(*self.changes.columns)), self.tail, head, self.tracked)

    def forget(self, rev: int) -> Tail:
        """Trims what is at ``rev`` or before; never beyond the head."""
        rev = max(self.tail, min(rev, self.head))
        return Tail(self.changes.where(F.col("rev") > rev), rev, self.head, self.tracked)

    def retained(self, watched: list[int], keep: int) -> Tail:
        """Forgets what neither the last ``keep`` revisions nor the oldest watcher needs."""
        return self.forget(min([self.head - keep, *watched]))

    def slice(self, lo: int, hi: int) -> DataFrame:
        if not self.tail <= lo <= hi <= self.head:
            raise ValueError(f"({lo}, {hi}] is not in ({self.tail}, {self.head}]")
        return between(self.changes, lo, hi, self.tracked)

    def rev_at(self, at: int) -> DataFrame:
        """(file_id, blk, rev, exact) of the tracked blocks: the last change up to ``at``; without one
        in what is kept, the tail bounds it from above."""
        if not self.tail <= at <= self.head:
            raise ValueError(f"{at} is not in [{self.tail}, {self.head}]")
        known = rev_at(self.changes, at)
        every = self.changes.select(*KEYS).distinct() if self.tracked is None else self.tracked.select(*KEYS).distinct()
        return every.join(known, KEYS, "left").select(*KEYS, F.coalesce("rev", F.lit(self.tail).cast("long")).alias("rev"), F.col("rev").isNotNull().alias("exact"))


# ---- parent-closed sets ----


def closure(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(oid): ``nodes`` (oid) and all their parents; ``parents``: (oid, parent), a null parent for a
    root. A node of two parents fails."""
    links = parents.where("parent is not null").distinct()
    torn = links.groupBy("oid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if torn:
        raise ValueError(f"node {torn['oid']} has {torn['n']} parents")
    links = settled(links)
    out = step = settled(nodes.select("oid").distinct())
    while True:
        step = settled(step.join(links, "oid").select(F.col("parent").alias("oid")).distinct().join(out, "oid", "left_anti"))
        if step.isEmpty():
            return out
        out = settled(out.unionByName(step))


def leaves(tree: DataFrame) -> DataFrame:
    """(oid) of the nodes of a parent-closed ``tree`` (oid, parent) that are no parent in it."""
    return tree.select("oid").join(tree.select(F.col("parent").alias("oid")).where("oid is not null").distinct(), "oid", "left_anti")


def tree_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes (oid, parent) of either parent-closed set; a node of different parents fails."""
    both = a.select("oid", "parent").unionByName(b.select("oid", "parent")).distinct()
    several = both.groupBy("oid").agg(F.count(F.lit(1)).alias("n"), F.first("parent").alias("parent"))
    return several.where(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("several parents of "), F.col("oid").cast("string"))).cast("boolean")).otherwise(F.lit(True))).select("oid", "parent")


def tree_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` without the leaves of ``b``, and without the parents that this leaves childless."""
    gone = leaves(b)
    kept = leaves(a).join(gone, "oid", "left_anti")
    return a.join(closure(kept, a), "oid", "left_semi").select("oid", "parent")


def tree_apply(a: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """(a without ``removed``) and ``added``."""
    return tree_union(tree_difference(a, removed), added)


def tree_delta_merge(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(removed, added) of two deltas in turn: what comes back is not removed, what goes again is not added."""
    (del1, add1), (del2, add2) = first, second
    minus = lambda x, y: x.join(y.select("oid"), "oid", "left_anti").select("oid", "parent")
    return tree_union(minus(del1, add2), del2), tree_union(minus(add1, del2), add2)


def tree_delta_reverse(delta: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    return delta[1], delta[0]


def connected(changed: DataFrame, tracked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``changed`` (oid) nodes those that are tracked, with all their tracked parents: (oid), and
    the top changed node of each, the changed nodes none of whose parents changed: (oid)."""
    own = changed.join(tracked.select("oid"), "oid", "left_semi").distinct()
    links = tracked.where("parent is not null").select("oid", "parent")
    above = closure(own.join(links, "oid").select(F.col("parent").alias("oid")), tracked)  # every strict ancestor of a changed node
    # a changed node is top if no changed node is among its strict ancestors
    reach = own.select(F.col("oid").alias("node"), "oid")
    under = None
    while True:
        reach = settled(reach.join(links, "oid").select("node", F.col("parent").alias("oid")))
        if reach.isEmpty():
            break
        hit = reach.join(own, "oid", "left_semi").select(F.col("node").alias("oid"))
        under = hit if under is None else under.unionByName(hit)
        reach = reach.join(own.select("oid"), "oid", "left_anti")
    top = own if under is None else own.join(under.distinct(), "oid", "left_anti")
    return own.unionByName(above).distinct(), top


def tree_diff(old: DataFrame, new: DataFrame, tracked: DataFrame, value: str = "value") -> DataFrame:
    """Keys (key, old, new) whose values differ between two trees' leaves (oid, key, value), as far as
    tracked nodes (oid) hold or held them. A node of an equal id and content is in both and falls out."""
    mine = lambda t: t.join(tracked.select("oid").distinct(), "oid", "left_semi").select("key", value)
    return diff(mine(old), mine(new), ["key"], value)


def block_changes(changed: DataFrame, holders: DataFrame, rev: int) -> DataFrame:
    """(file_id, blk, rev) of a commit's changed objects (oid); ``holders``: (oid, file_id, blk), the
    tracked blocks that an object is part of."""
    return holders.join(changed.select("oid").distinct(), "oid", "left_semi").select("file_id", "blk", F.lit(rev).cast("long").alias("rev")).distinct()
