"""A change feed and its watchers: commits and requests stream in, pins and answers go out.

A watcher of a file at a revision sees the file as of then: of every block that is changed later it
is told, once, which revision to keep (a pin). When it moves on it is told what changes for it, a
null revision meaning that the block is as at the head again. ``feed`` reads a folder of commits,
``fan_out`` gives each watcher the commits of its files, ``link`` answers. A watcher's state is one
group, or as many as ``link`` is told to cut it into, by block.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "file_id long, blk long, rev long"
#: Refusals.
TOO_OLD = "too far away back from head/at (@{head:016x})"
GOING_BACK = "going back in history is forbidden"
UNKNOWN = "file not yet known to wcfs or is not a ZBigFile"
EPOCH = "file epoch detected @{rev:016x} in between (at,head=@{head:016x}]"
#: Milliseconds that a watcher has to confirm its pins, if any are asked for.
PIN_TIMEOUT = 30_000
#: Events that a part of a watcher's state takes, roughly.
PER_PART = 50_000
KINDS = ("open", "commit", "watch", "unwatch", "confirm", "forget")
#: Events that go to a Python function, or messages that come from it, at once.
_CHUNK = 10_000


def feed(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def fan_out(commits: DataFrame, watchers: DataFrame) -> DataFrame:
    """Events for ``link``: each commit (file_id, blk, rev) for each of ``watchers`` (watcher,
    file_id); a join by file."""
    return commits.join(watchers.select("watcher", "file_id"), "file_id").select("watcher", "file_id", F.col("rev").alias("seq"), F.lit("commit").alias("kind"), F.lit(None).cast("long").alias("at"), "blk", "rev")


class Link:
    """What one watcher of one file has asked and been told. Of each block the state keeps the
    revisions that the watcher may still ask for: the last up to ``at`` and those after it. With
    ``part`` it has some of the blocks only, and the head is what commits without a block say."""

    def __init__(self, saved: str | None = None, tail: int = 0, part: bool = False):
        s = json.loads(saved) if saved else {}
        self.part = s.get("part", part)
        self.at, self.tail, self.head, self.opened = s.get("at"), s.get("tail", tail), s.get("head", 0), s.get("opened")
        self.revs: dict[int, array] = {int(k): array("q", v) for k, v in s.get("revs", {}).items()}
        self.pinned: dict[int, int] = {int(k): v for k, v in s.get("pinned", {}).items()}
        self.waiting: list[list[int]] = s.get("waiting", [])
        self.unconfirmed: dict[int, None] = dict.fromkeys(s.get("unconfirmed", []))

    def saved(self) -> str:
        return json.dumps(vars(self) | {"unconfirmed": list(self.unconfirmed)}, default=array.tolist, separators=(",", ":"))

    def rev_at(self, blk: int, at: int) -> int:
        revs = self.revs.get(blk, ())
        i = bisect_right(revs, at)
        return revs[i - 1] if i else 0

    def pins(self, at: int) -> dict[int, int]:
        return {blk: self.rev_at(blk, at) for blk, revs in self.revs.items() if revs[-1] > at}

    def event(self, seq: int, kind: str, at: int | None, blk: int | None, rev: int | None) -> Iterator[tuple]:
        """Messages (seq, say, blk, rev, error) in answer."""
        if kind == "open":
            self.opened = rev
        elif kind == "commit":
            yield from self._commit(seq, blk, rev)
        elif kind == "watch":
            if at > self.head:
                self.waiting.append([seq, at])  # answered when the head gets there
            else:
                yield from self._watch(seq, at)
        elif kind == "unwatch":
            self.at, self.pinned, self.unconfirmed = None, {}, {}
            yield seq, "ok", None, None, None
        elif kind == "confirm":
            self.unconfirmed.pop(blk, None)
        elif kind == "forget":
            self.tail = max(self.tail, min(rev, self.head))
            self._trim()

    def _commit(self, seq: int, blk: int | None, rev: int) -> Iterator[tuple]:
        if blk is None or not self.part:
            self.head = max(self.head, rev)
        if blk is not None:
            revs = self.revs.setdefault(blk, array("q"))
            i = bisect_left(revs, rev)
            if i == len(revs) or revs[i] != rev:
                revs.insert(i, rev)
                if self.at is not None and revs[-1] > self.at:
                    keep = self.rev_at(blk, self.at)  # a late commit may raise what was told before
                    if self.pinned.get(blk) != keep:
                        yield self._pin(seq, blk, keep)
        for asked in [w for w in self.waiting if w[1] <= self.head]:
            self.waiting.remove(asked)
            yield from self._watch(*asked)

    def _watch(self, seq: int, at: int) -> Iterator[tuple]:
        error = None
        if at < self.tail:
            error = TOO_OLD.format(head=self.head)
        elif self.at is None and self.opened is None:
            error = UNKNOWN
        elif self.at is not None and at < self.at:
            error = GOING_BACK
        elif self.opened > at:
            error = EPOCH.format(rev=self.opened, head=self.head)
        if error:
            yield seq, "error", None, None, error
            return
        self.at = at
        new = self.pins(at)
        for blk in sorted(self.pinned.keys() - new.keys()):
            del self.pinned[blk]
            yield seq, "pin", blk, None, None
        for blk in sorted(new):
            if self.pinned.get(blk) != new[blk]:
                yield self._pin(seq, blk, new[blk])
        self._trim()
        yield seq, "ok", None, None, None

    def _pin(self, seq: int, blk: int, rev: int) -> tuple:
        self.pinned[blk] = rev
        self.unconfirmed.setdefault(blk)
        return seq, "pin", blk, rev, None

    def _trim(self) -> None:
        floor = self.tail if self.at is None else self.at
        for revs in self.revs.values():
            del revs[: max(0, bisect_right(revs, floor) - 1)]


def link(events: DataFrame, tail: int = 0, pin_timeout: int | None = None, parts: int = 1) -> DataFrame:
    """``events``: streaming (watcher, file_id, seq, kind, at, blk, rev) with kinds open (rev: the
    file's first), commit (blk or, for the head alone, null; rev), watch (at), unwatch, confirm (blk)
    and forget (rev). Within a batch they count in order of seq. Emits (watcher, file_id, seq, say,
    blk, rev, error): pin, ok or error. With ``pin_timeout`` a watcher that leaves pins unconfirmed
    for so many milliseconds is dropped, with say = ``kill``.

    With ``parts`` > 1 a watcher's blocks are dealt into so many states, and no worker holds more
    than one at a time. Requests and commits without a block go to all of them; these commits alone
    move the head then, so a revision's must follow those of its blocks. ``parts`` is fixed for a
    checkpoint, and there is no ``pin_timeout``."""
    if parts > 1 and pin_timeout is not None:
        raise ValueError("pin_timeout drops a whole watcher: it needs parts = 1")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        who = key[:2]
        if state.hasTimedOut:
            state.remove()
            yield table([(*who, None, "kill", None, None, None)])
            return
        at = Link(state.get[0] if state.exists else None, tail, parts > 1)
        said = []
        for seq, kind, *more in _in_order(batches):
            for message in at.event(seq, kind, *more):
                if message[1] == "pin" or key[2:] in ((), (0,)):  # all parts come to the same answer
                    said.append((*who, *message))
            if len(said) >= _CHUNK:
                yield table(said)
                said = []
        state.update((at.saved(),))
        if pin_timeout is not None and at.unconfirmed:
            state.setTimeoutDuration(pin_timeout)
        if said:
            yield table(said)

    def table(said: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({name: pd.array(column, dtype=kind) for (name, kind), column in zip(kinds.items(), zip(*said))})

    kinds = {"watcher": "object", "file_id": "Int64", "seq": "Int64", "say": "object", "blk": "Int64", "rev": "Int64", "error": "object"}
    timeout = GroupStateTimeout.NoTimeout if pin_timeout is None else GroupStateTimeout.ProcessingTimeTimeout
    # numbers without nulls, which pandas would turn into floats
    given = sum((F.col(c).isNotNull().cast("long") * (1 << i) for i, c in enumerate(_OPTIONAL)), F.lit(0))
    known = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0))
    rows = events.select("watcher", "file_id", "seq", known.alias("kind"), given.alias("given"), *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in _OPTIONAL))
    keys = ["watcher", "file_id"]
    if parts > 1:
        own = F.col("kind").isin(KINDS.index("commit") + 1, KINDS.index("confirm") + 1) & (F.col("given").bitwiseAND(_BLK) != 0)
        part = F.when(own, F.array(F.pmod(F.xxhash64("blk"), F.lit(parts)).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(parts - 1)))
        rows = rows.withColumn("part", F.explode(part))
        keys.append("part")
    return rows.groupBy(*keys).applyInPandasWithState(step, "watcher string, file_id long, seq long, say string, blk long, rev long, error string", "link string", "append", timeout)


_OPTIONAL = ("at", "blk", "rev")
_BLK = 1 << _OPTIONAL.index("blk")


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(seq, kind, at, blk, rev) in order of seq; of an equal one openings come first, then commits,
    those of the head alone behind those of blocks. Kept in arrays: 48 bytes an event."""
    found = [batch[["seq", "kind", "given", *_OPTIONAL]].to_numpy("int64") for batch in batches]
    rows = np.concatenate(found)
    del found
    kind, blk = rows[:, 1], rows[:, 2] & _BLK
    commit = kind == KINDS.index("commit") + 1
    rank = np.where(kind == KINDS.index("open") + 1, 0, np.where(commit, np.where(blk != 0, 1, 2), 3)).astype("int8")
    order = np.lexsort((rank, rows[:, 0]))
    for start in range(0, len(order), _CHUNK):
        for seq, kind, given, *more in rows[order[start : start + _CHUNK]].tolist():
            if kind:
                yield seq, KINDS[kind - 1], *(x if given >> i & 1 else None for i, x in enumerate(more))
