"""A transactional store of arrays: Parquet parts by commit and a log of commits.

A folder holds ``data/<token>-<i>/`` (token, blk, pos, val), ``data/<token>-blks/`` (token, file_id,
blk: the write set) and ``log/<n>.json``. A log entry is written whole under another name and then
linked into place, which fails if the place is taken: whoever links the entry of a revision has
committed it. Others look at what came in between, and take the next revision or, if they wrote a
block that was committed since their base, fail. The file system must offer a link or a rename that
refuses an existing target (local and HDFS-like ones do).

What an append puts behind an array's end replaces what an earlier shrink has hidden there: the entry
names these places as cleared.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import prod
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.array import Array
from ..plans.index import shape_of, strides_of


class ConflictError(Exception):
    """Another transaction committed one of the written blocks or shapes first."""


class UnknownArray(KeyError):
    """No array of this name, as of the revision asked for."""


class Files:
    """Small files through Hadoop's file system, so that any store Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(self.conf)

    def create(self, path: str, text: str) -> bool:
        """The file appears whole, or not at all: False if it is there already."""
        written = f"{path}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self.path(written), False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            return self._publish(written, path)
        finally:
            self.fs.delete(self.path(written), False)

    def _publish(self, written: str, path: str) -> bool:
        if self.fs.getScheme() == "file":
            try:
                os.link(urlsplit(written).path, urlsplit(path).path)
            except FileExistsError:
                return False
            return True
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(path).toUri(), self.conf)
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.path(written), self.path(path), none)
        except Exception as e:  # py4j wraps FileAlreadyExistsException
            if "exist" in str(e).lower():
                return False
            raise
        return True

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        data = bytes(stream.readAllBytes())
        stream.close()
        return data.decode()

    def names(self, path: str) -> list[str]:
        p = self.path(path)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []


@dataclass
class Store:
    """``blk_items``: items of a block, unless an array has its own."""

    spark: SparkSession
    root: str
    blk_items: int = 1 << 18
    files: Files = field(init=False)
    _known: dict[int, dict] = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        self.files = Files(self.spark, self.root)

    # ---- the log ----

    def commits(self, at: int | None = None) -> list[dict]:
        """Entries up to ``at``. Each is read once: a checkpoint stands for those up to its revision."""
        names = self.files.names(f"{self.root}/log")
        revs = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())
        missing = [r for r in revs if r not in self._known]
        marks = sorted(int(n.removesuffix(".json").removeprefix("upto-")) for n in names if n.startswith("upto-") and n.endswith(".json"))
        if missing and marks and missing[0] <= marks[-1]:
            self._known |= {c["rev"]: c for c in json.loads(self.files.read(f"{self.root}/log/upto-{marks[-1]:020d}.json"))}
        for r in revs:
            if r not in self._known:
                self._known[r] = json.loads(self.files.read(f"{self.root}/log/{r:020d}.json"))
        return [self._known[r] for r in sorted(self._known) if at is None or r <= at]

    def checkpoint(self) -> None:
        """Puts the log so far into one file, for those who open the store later."""
        commits = self.commits()
        if commits:
            self.files.create(f"{self.root}/log/upto-{commits[-1]['rev']:020d}.json", json.dumps(commits))

    def head(self) -> int:
        return max((c["rev"] for c in self.commits()), default=0)

    def wait(self, at: int, timeout: float = 30.0, pause: float = 0.05) -> int:
        """The head, as soon as it is at ``at``."""
        until = time.monotonic() + timeout
        while (head := self.head()) < at:
            if time.monotonic() > until:
                raise TimeoutError(f"the head is at {head}, before {at}, after {timeout} s")
            time.sleep(pause)
        return head

    def changes(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """(file_id, blk, rev) of every block committed in (after, upto]."""
        commits = [c for c in self.commits(upto) if c["rev"] > after and c["data"]]
        if not commits:
            return self.spark.createDataFrame([], "file_id string, blk long, rev long")
        revs = self.spark.createDataFrame([(c["token"], c["rev"]) for c in commits], "token string, rev long")
        rows = self.spark.read.parquet(*(f"{self.root}/data/{c['token']}-blks" for c in commits))
        return rows.join(F.broadcast(revs), "token").select("file_id", "blk", "rev")

    # ---- arrays ----

    def meta(self, name: str, at: int | None = None) -> dict:
        for c in reversed(self.commits(at)):
            if name in c["arrays"]:
                return c["arrays"][name]
        raise UnknownArray(f"no array {name!r}" + (f" at {at}" if at is not None else ""))

    def open(self, name: str, at: int | None = None) -> Array:
        """The array as of revision ``at`` (now: None)."""
        commits = self.commits(at)
        meta = self.meta(name, at)
        parts = [c for c in commits if name in c["data"]]
        if not parts:
            elems = self.spark.createDataFrame([], f"pos long, val {meta['type']}")
        else:
            elems = self.spark.read.parquet(*(f"{self.root}/data/{c['data'][name]}" for c in parts))
            cleared = [(c["rev"], lo, hi) for c in commits for lo, hi in c["cleared"].get(name, [])]
            if len(parts) > 1 or cleared:
                revs = self.spark.createDataFrame([(c["token"], c["rev"]) for c in parts], "token string, rev long")
                elems = elems.join(F.broadcast(revs), "token")
                for rev, lo, hi in cleared:
                    elems = elems.where(~((F.col("rev") < rev) & F.col("pos").between(lo, hi - 1)))
            if len(parts) > 1:
                elems = elems.groupBy("pos").agg(F.max_by("val", "rev").alias("val"))
            elems = elems.select("pos", "val")
        return Array(elems.where(F.col("pos") < prod(meta["shape"])), tuple(meta["shape"]), meta["order"])

    def stat(self, name: str, at: int | None = None) -> dict:
        """size (items), blk_items, rev and mtime of the last change."""
        meta = self.meta(name, at)
        last = [c for c in self.commits(at) if name in c["data"] or name in c["arrays"]][-1]
        return {"size": prod(meta["shape"]), "blk_items": meta["blk_items"], "rev": last["rev"], "mtime": last["time"]}

    def stats(self) -> dict:
        commits = self.commits()
        return {"arrays": len({n for c in commits for n in c["arrays"]}), "commits": len(commits), "head": self.head(), "parts": sum(len(c["data"]) for c in commits)}

    def begin(self) -> Txn:
        return Txn(self, self.head())

    def view(self, at: int | None = None) -> View:
        return View(self, self.head() if at is None else at)


@dataclass
class View:
    """Arrays as of one revision, whatever is committed meanwhile, until it is moved on."""

    store: Store
    at: int

    def __post_init__(self) -> None:
        if self.at > self.store.head():
            raise ValueError(f"the head is before {self.at}")

    def open(self, name: str) -> Array:
        return self.store.open(name, self.at)

    def get(self, name: str) -> Array | None:
        """The array, or None if there is none at this revision."""
        try:
            return self.open(name)
        except UnknownArray:
            return None

    def resync(self, at: int | None = None) -> DataFrame:
        """Moves to a later revision; returns the blocks that changed on the way. Block sizes can't change."""
        at = self.store.head() if at is None else at
        if at < self.at:
            raise ValueError(f"can't go back from {self.at} to {at}")
        for c in self.store.commits(at):
            for name, meta in c["arrays"].items():
                if c["rev"] > self.at and (old := self._blk_items(name)) not in (None, meta["blk_items"]):
                    raise ValueError(f"{name!r} changed its blocks from {old} to {meta['blk_items']} items at {c['rev']}")
        moved = self.store.changes(self.at, at)
        self.at = at
        return moved

    def _blk_items(self, name: str) -> int | None:
        try:
            return self.store.meta(name, self.at)["blk_items"]
        except UnknownArray:
            return None


@dataclass
class Txn:
    """Reads at ``base``; what is staged here is seen here only, until commit."""

    store: Store
    base: int
    arrays: dict[str, dict] = field(default_factory=dict)
    overlay: dict[str, DataFrame] = field(default_factory=dict)
    cleared: dict[str, list[tuple[int, int]]] = field(default_factory=dict)
    stored: dict | None = None

    def isdirty(self) -> bool:
        return bool(self.arrays or self.overlay)

    def create(self, name: str, shape, kind: str, order: str = "C", blk_items: int | None = None) -> None:
        shape = shape_of(shape)
        strides_of(shape, order)
        self.arrays[name] = {"shape": list(shape), "order": order, "type": kind, "blk_items": blk_items or self.store.blk_items}
        self.stored = None

    def _meta(self, name: str) -> dict:
        return self.arrays[name] if name in self.arrays else self.store.meta(name, self.base)

    def open(self, name: str) -> Array:
        meta = self._meta(name)
        try:
            elems = self.store.open(name, self.base).elems
        except UnknownArray:
            elems = self.store.spark.createDataFrame([], f"pos long, val {meta['type']}")
        for lo, hi in self.cleared.get(name, []):
            elems = elems.where(~F.col("pos").between(lo, hi - 1))
        if name in self.overlay:
            elems = elems.join(self.overlay[name].select("pos"), "pos", "left_anti").unionByName(self.overlay[name])
        return Array(elems, tuple(meta["shape"]), meta["order"])

    def write(self, name: str, values: DataFrame) -> None:
        """Stages (pos, val)."""
        kind = self._meta(name)["type"]
        new = values.select(F.col("pos").cast("long").alias("pos"), F.col("val").cast(kind).alias("val"))
        old = self.overlay.get(name)
        self.overlay[name] = new if old is None else old.join(new.select("pos"), "pos", "left_anti").unionByName(new)
        self.stored = None

    def assign(self, name: str, idx, values, shape=None) -> None:
        """Stages an assignment to a slice; see ``Array.assigned``."""
        part = self.open(name)[idx]
        new = part.assigned(values, shape)
        if isinstance(values, DataFrame | Array):  # items that are left out become zeros
            every = part.assigned(0).withColumnRenamed("val", "_zero")
            new = every.join(new, "pos", "left").select("pos", F.coalesce("val", "_zero").alias("val"))
        self.write(name, new)

    def resize(self, name: str, shape) -> None:
        self.arrays[name] = self._meta(name) | {"shape": list(shape_of(shape))}
        self.stored = None

    def append(self, name: str, values: DataFrame, shape) -> None:
        """``values``: (pos, val) of an array of ``shape``; only these items are written. What an
        earlier shrink has hidden behind the end doesn't come back."""
        now = self.open(name)
        grown = Array(values.limit(0), now.shape_, now.order).append(values.limit(0), shape)
        lo, hi = prod(now.shape_), prod(grown.shape_)
        self.cleared.setdefault(name, []).append((lo, hi))
        if name in self.overlay:
            self.overlay[name] = self.overlay[name].where(~F.col("pos").between(lo, hi - 1))
        self.write(name, values.select((F.col("pos") + lo).alias("pos"), "val"))
        self.resize(name, grown.shape_)

    def abort(self) -> None:
        self.arrays.clear(), self.overlay.clear(), self.cleared.clear()
        self.stored = None

    # ---- writing out: parts first, in order of blocks; then the log entry publishes them ----

    def store_parts(self) -> dict:
        """Writes the staged items and the write set; may be repeated, the transaction stays dirty."""
        store, token, data = self.store, uuid.uuid4().hex, {}
        sets = None
        for i, (name, overlay) in enumerate(self.overlay.items()):
            data[name] = f"{token}-{i}"
            rows = overlay.select(F.lit(token).alias("token"), F.expr(f"pos div {self._meta(name)['blk_items']}").alias("blk"), "pos", "val")
            rows.repartitionByRange("blk").sortWithinPartitions("blk", "pos").write.parquet(f"{store.root}/data/{data[name]}")
            own = store.spark.read.parquet(f"{store.root}/data/{data[name]}").select("token", F.lit(name).alias("file_id"), "blk").distinct()
            sets = own if sets is None else sets.unionByName(own)
        if sets is not None:
            sets.write.parquet(f"{store.root}/data/{token}-blks")
        self.stored = {"token": token, "data": data}
        return self.stored

    def _refuse_conflicts(self, after: int, upto: int) -> None:
        """Fails if what this transaction wrote was committed in (after, upto]."""
        store = self.store
        since = [c for c in store.commits(upto) if c["rev"] > after]
        for c in since:
            hit = sorted(n for n in self.arrays if n in c["arrays"])
            if hit:
                raise ConflictError(f"{', '.join(hit)} changed at {c['rev']}, after {self.base}")
        if self.stored["data"] and any(set(c["data"]) & set(self.stored["data"]) for c in since):
            own = store.spark.read.parquet(f"{store.root}/data/{self.stored['token']}-blks").select("file_id", "blk")
            hit = store.changes(after, upto).join(own, ["file_id", "blk"], "left_semi").first()
            if hit:
                raise ConflictError(f"block {hit['blk']} of {hit['file_id']} changed at {hit['rev']}, after {self.base}")

    def attempts(self) -> Iterator[int | None]:
        """The steps of a commit: None after a check of what is committed so far, then the revision if
        the entry could be published right behind what was checked; else it goes on."""
        if self.stored is None:
            self.store_parts()
        checked = self.base
        while True:
            seen = max((c["rev"] for c in self.store.commits()), default=0)
            self._refuse_conflicts(checked, seen)
            checked = max(checked, seen)
            yield None
            rev = checked + 1
            entry = {"rev": rev, "time": time.time(), "arrays": self.arrays, "cleared": self.cleared, **self.stored}
            if self.store.files.create(f"{self.store.root}/log/{rev:020d}.json", json.dumps(entry)):
                self.base = rev
                self.abort()
                yield rev
                return

    def commit(self) -> int:
        """The new revision."""
        return next(rev for rev in self.attempts() if rev is not None)
