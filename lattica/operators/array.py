"""Lazy N-d arrays over element tables (pos BIGINT, val T): pos is the item's place in storage order.

A missing row is a zero. Slices become range predicates on pos, so they reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.blocks import ArrayRef
from ..functions.dtypes import numpy_type, spark_type
from ..plans.index import Axis, broadcast_axes, major_axis, normalised, permuted, refined, shape_after, shape_of, strides_of

#: Bytes that ``asarray`` brings to the driver at most, unless told otherwise.
MOST_BYTES = 1 << 30
#: Items read at a time by iteration.
STEP = 1 << 16


def _zero(kind: T.DataType) -> Column:
    """The value of a hole."""
    if isinstance(kind, T.StructType):
        return F.struct(*(_zero(f.dataType).alias(f.name) for f in kind.fields))
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    return F.lit("").cast(kind) if isinstance(kind, T.StringType | T.BinaryType) else F.lit(0).cast(kind)


@dataclass(frozen=True)
class Array:
    """An array or a basic slice of one. ``elems`` has pos, val and maybe more columns."""

    elems: DataFrame
    shape_: tuple[int, ...]
    order: str = "C"
    axes: tuple[Axis, ...] | None = None

    @classmethod
    def of(cls, elems: DataFrame, shape, order: str = "C") -> Array:
        shape = shape_of(shape)
        strides_of(shape, order)
        return cls(elems, shape, order)

    # ---- attributes: metadata only ----

    @property
    def shape(self) -> tuple[int, ...]:
        return self.shape_ if self.axes is None else shape_after(self.axes)

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return prod(self.shape)

    @property
    def kind(self) -> T.DataType:
        return self.elems.schema["val"].dataType

    @property
    def dtype(self) -> np.dtype:
        return numpy_type(self.kind)

    @property
    def itemsize(self) -> int:
        return self.dtype.itemsize

    @property
    def nbytes(self) -> int:
        return self.size * self.itemsize

    @property
    def steps(self) -> tuple[int, ...]:
        """Stored items from one item to the next along each axis."""
        s = strides_of(self.shape_, self.order)
        return tuple(0 if a.axis is None else s[a.axis] * a.step for a in self._axes() if a.kept)

    @property
    def strides(self) -> tuple[int, ...]:
        """The same in bytes."""
        return tuple(s * self.itemsize for s in self.steps)

    @property
    def data(self) -> None:
        raise TypeError("a lazy array has no buffer")

    def __len__(self) -> int:
        """Of the first axis; of the major one, as long as nothing was sliced."""
        if not self.shape:
            raise TypeError("len() of unsized object")
        return self.shape_[major_axis(self.shape_, self.order)] if self.axes is None else self.shape[0]

    # ---- views: metadata only ----

    def __getitem__(self, idx) -> Array:
        return replace(self, axes=normalised(idx, self.shape_) if self.axes is None else refined(self.axes, idx))

    def transpose(self, *order: int) -> Array:
        n = self.ndim
        return replace(self, axes=permuted(self._axes(), tuple(i % n for i in order) if order else tuple(reversed(range(n)))))

    def swapaxes(self, i: int, j: int) -> Array:
        order = list(range(self.ndim))
        order[i], order[j] = order[j], order[i]
        return self.transpose(*order)

    def field(self, name: str) -> Array:
        """One field of an array of records; only its column is read."""
        return replace(self, elems=self.elems.withColumn("val", F.col("val").getField(name)))

    def resize(self, shape) -> Array:
        """Metadata only: items behind the shape stay stored and come back when it grows."""
        return replace(self, shape_=shape_of(shape), axes=None)

    def _axes(self) -> tuple[Axis, ...]:
        return self.axes if self.axes is not None else normalised(Ellipsis, self.shape_)

    def _coordinate(self, a: Axis) -> Column:
        return F.expr(f"pos div {strides_of(self.shape_, self.order)[a.axis]} % {self.shape_[a.axis]}")

    def _along(self, a: Axis) -> Column:
        """The place along one axis of the slice."""
        c = self._coordinate(a)
        return F.expr(f"({'pos' if len(self.shape_) == 1 else f'pos div {strides_of(self.shape_, self.order)[a.axis]} % {self.shape_[a.axis]}'} - {a.start}) div {a.step}") if a.n > 1 else c * 0

    def _inside(self) -> Column:
        """Does a stored item lie in the slice?"""
        strides = strides_of(self.shape_, self.order)
        if not prod(a.n for a in self._axes()):
            return F.lit(False)
        real = [a for a in self._axes() if a.axis is not None]
        ends = {id(a): sorted((a.start, a.start + (a.n - 1) * a.step)) for a in real}
        # the ends of the slice on the flat line bound pos; both reach the scan
        where = F.col("pos").between(sum(ends[id(a)][0] * strides[a.axis] for a in real), sum(ends[id(a)][1] * strides[a.axis] for a in real))
        for a in real:
            first, last = ends[id(a)]
            if len(self.shape_) > 1 and (first, last) != (0, self.shape_[a.axis] - 1):
                where &= self._coordinate(a).between(first, last)
            if abs(a.step) > 1 and a.n > 1:
                where &= (self._coordinate(a) - first) % abs(a.step) == 0
        return where

    def rows(self) -> DataFrame:
        """Stored items of the slice: the table's columns, and out_pos, the item's C-order place in it."""
        out, weight = F.lit(0).cast("long"), 1
        if self.size:
            for a in reversed(self._axes()):
                if a.axis is not None:
                    out = out + self._along(a) * weight
                weight *= a.n
        return self.elems.where(self._inside()).withColumn("out_pos", out.cast("long"))

    def dense(self) -> DataFrame:
        """(out_pos, val) of every item, holes as zeros."""
        every = self.elems.sparkSession.range(self.size).withColumnRenamed("id", "out_pos")
        return every.join(self.rows().select("out_pos", "val"), "out_pos", "left").select("out_pos", F.coalesce("val", _zero(self.kind)).alias("val"))

    def flat(self) -> Array:
        """The slice as an array of its own, in C order."""
        return Array(self.rows().select(F.col("out_pos").alias("pos"), "val"), self.shape)

    # ---- to the driver ----

    def asarray(self, most_bytes: int = MOST_BYTES) -> np.ndarray:
        """The slice as a NumPy array; refused if it is larger than ``most_bytes``."""
        if self.nbytes > most_bytes:
            raise MemoryError(f"{self.nbytes} bytes are more than {most_bytes}: take a slice, or reduce the array where it is")
        got = self.rows().select("out_pos", "val").toArrow()
        out = np.zeros(self.size, self.dtype)
        at, val = got.column(0).to_numpy(), got.column(1)
        if isinstance(self.kind, T.StructType):
            for name in self.dtype.names or ():
                out[name][at] = pa.compute.struct_field(val, name).to_numpy()
        else:
            out[at] = val.to_numpy()
        return out.reshape(self.shape)

    def __iter__(self) -> Iterator:
        """Items of a 1-d slice, else its parts along the first axis. ``STEP`` items are on the driver at a time."""
        if not self.ndim:
            raise TypeError("iteration over a 0-d array")
        if self.ndim > 1:
            yield from (self[i] for i in range(self.shape[0]))
            return
        for lo in range(0, self.size, STEP):
            yield from self[lo : lo + STEP].asarray()

    # ---- other forms ----

    def structured(self, fields: Sequence[str]) -> Array:
        """The axis whose items lie next to each other becomes a record of ``fields``."""
        axes = self._axes()
        kept = [a for a in axes if a.kept]
        if not kept:
            raise ValueError("an array without axes can't become records")
        minor = min(range(len(kept)), key=lambda i: (abs(self.steps[i]), -i))
        if self.steps[minor] < 0:
            raise ValueError("the minor axis runs backwards")
        if self.steps[minor] != 1:
            raise ValueError("the minor axis has gaps between its items")
        if kept[minor].n != len(fields):
            raise ValueError(f"{len(fields)} fields don't fill a minor axis of {kept[minor].n}")
        rest = tuple(a for a in axes if a is not kept[minor])
        place, weight = F.lit(0).cast("long"), 1
        for a in reversed(rest):
            if a.axis is not None:
                place = place + self._along(a) * weight
            weight *= a.n
        own = self.elems.where(self._inside()).select(place.cast("long").alias("pos"), self._along(kept[minor]).alias("_field"), "val")
        record = F.struct(*(F.coalesce(F.max(F.when(F.col("_field") == i, F.col("val"))), _zero(self.kind)).alias(f) for i, f in enumerate(fields)))
        return Array(own.groupBy("pos").agg(record.alias("val")), shape_after(rest))

    def strided(self, shape, steps: Sequence[int], offset: int = 0) -> Array:
        """A view of any shape and steps over the slice's items in C order; items may repeat."""
        shape = shape_of(shape)
        if len(steps) != len(shape):
            raise ValueError("shape and steps differ in length")
        if prod(shape):
            low = offset + sum(min(0, (n - 1) * s) for n, s in zip(shape, steps, strict=True))
            high = offset + sum(max(0, (n - 1) * s) for n, s in zip(shape, steps, strict=True))
            if low < 0 or high >= self.size:
                raise ValueError(f"items {low} to {high} lie outside an array of {self.size}")
        at, weight = F.lit(offset).cast("long"), 1
        for n, s in zip(reversed(shape), reversed(steps), strict=True):
            at = at + F.expr(f"id div {weight} % {max(1, n)}") * s
            weight *= max(1, n)
        every = self.elems.sparkSession.range(prod(shape)).select(F.col("id").alias("_out"), at.alias("out_pos"))
        return Array(every.join(self.rows().select("out_pos", "val"), "out_pos").select(F.col("_out").alias("pos"), "val"), shape)

    def view(self, dtype, offset: int = 0) -> Array:
        """The slice's bytes, from ``offset`` on, as items of another type; 1-d."""
        new, old = np.dtype(dtype), self.dtype
        total = self.nbytes - offset
        if offset < 0 or total < 0 or total % new.itemsize:
            raise ValueError(f"{self.nbytes} bytes from {offset} on are no whole number of items of {new.itemsize}")
        group = int(np.lcm(old.itemsize, new.itemsize))  # bytes
        mine = self.rows().select((F.col("out_pos") * old.itemsize - offset).alias("at"), "val")
        # an item that lies across a border goes to both groups
        first, last = F.floor(F.col("at") / group), F.floor((F.col("at") + (old.itemsize - 1)) / group)
        mine = mine.where(F.col("at") + old.itemsize > 0).withColumn("g", F.explode(F.array_distinct(F.array(F.greatest(first, F.lit(0)), last))))
        parts = mine.groupBy("g").agg(F.collect_list(F.struct("at", "val")).alias("items"))  # at most a group's bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                raw = np.zeros((n, group + 2 * old.itemsize), np.uint8)
                items = batch.column(1)
                row = np.repeat(np.arange(n), items.value_lengths().to_numpy(zero_copy_only=False))
                flat = items.flatten()
                value = np.ascontiguousarray(flat.field(1).to_numpy(zero_copy_only=False).astype(old)).view(np.uint8).reshape(-1, old.itemsize)
                at = flat.field(0).to_numpy() - batch.column(0).to_numpy()[row] * group + old.itemsize
                raw[row[:, None], at[:, None] + np.arange(old.itemsize)] = value
                out = np.ascontiguousarray(raw[:, old.itemsize : old.itemsize + group]).view(new)
                pos = batch.column(0).to_numpy()[:, None] * (group // new.itemsize) + np.arange(group // new.itemsize)
                ok = (pos < total // new.itemsize).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(pos.ravel()[ok]), pa.array(out.ravel()[ok].astype(wide))], ["pos", "val"])

        kind = spark_type(new)
        wide = numpy_type(kind)
        return Array(parts.mapInArrow(run, f"pos long, val {kind.simpleString()}"), (total // new.itemsize,))

    def apply(self, f: Callable[[np.ndarray, np.ndarray], np.ndarray], dtype) -> Array:
        """``f(places, values)`` of the stored items of the slice, in batches, as a new 1-d array in C order.
        Holes stay holes, so ``f`` should keep zeros."""
        kind = spark_type(dtype)
        wide = numpy_type(kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = np.asarray(f(batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)), wide)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["pos", "val"])

        return Array(self.rows().select("out_pos", "val").mapInArrow(run, f"pos long, val {kind.simpleString()}"), (self.size,))

    def ref(self, root: str) -> ArrayRef:
        """This slice as data: bytes of the stored array, which goes by the name ``root``."""
        size, at = self.itemsize, sum(a.start * strides_of(self.shape_, self.order)[a.axis] for a in self._axes() if a.axis is not None)
        low = sum(min(0, (n - 1) * s) for n, s in zip(self.shape, self.strides, strict=True) if n)
        high = sum(max(0, (n - 1) * s) for n, s in zip(self.shape, self.strides, strict=True) if n) + size
        return ArrayRef(root, at * size + low, at * size + high, -low, self.shape, self.strides, self.dtype.str)

    def deref(self, ref: ArrayRef) -> Array:
        """What ``ref`` says of this array, its root; a plan, nothing is read."""
        ref.check(prod(self.shape_) * self.itemsize)
        flat = Array(self.elems, (prod(self.shape_),))
        if np.dtype(ref.dtype) != self.dtype:
            flat = flat.view(ref.dtype)
        size = np.dtype(ref.dtype).itemsize
        if any(s % size for s in ref.strides) or (ref.lo + ref.z0) % size:
            raise NotImplementedError("a reference whose items don't lie on whole items of the root")
        return flat.strided(ref.shape, [s // size for s in ref.strides], (ref.lo + ref.z0) // size)

    # ---- reductions ----

    def reduce(self) -> DataFrame:
        """One row: n, sum, mean, var, min, max of the slice, holes included."""
        n = float(self.size)
        v = F.col("val").cast("double")
        got = self.rows().agg(F.count("val").alias("stored"), F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"), F.coalesce(F.avg(v), F.lit(0.0)).alias("_mean"), F.coalesce(F.var_pop(v), F.lit(0.0)).alias("_var"), F.min(v).alias("_min"), F.max(v).alias("_max"))
        hole = F.col("stored") < n
        none = F.lit(None).cast("double")
        # the stored items' spread and that between them and the holes: no difference of large squares
        share = F.col("stored") / n if n else none
        var = share * F.col("_var") + share * (1 - share) * F.col("_mean") ** 2
        return got.select(
            F.lit(self.size).cast("long").alias("n"), "stored", "sum", (F.col("sum") / n if n else none).alias("mean"), (var if n else none).alias("var"),
            F.when(hole, F.least("_min", F.lit(0.0))).otherwise(F.col("_min")).alias("min"), F.when(hole, F.greatest("_max", F.lit(0.0))).otherwise(F.col("_max")).alias("max"),
        )

    def cumsum(self, block: int = 1 << 16) -> DataFrame:
        """(out_pos, val): sums of the stored items up to each, in C order. Blocks are summed apart;
        their sums are summed up in the same way, level by level."""
        rows = self.rows().select("out_pos", "val", F.expr(f"out_pos div {block}").alias("_blk"))
        own = F.sum("val").over(Window.partitionBy("_blk").orderBy("out_pos").rowsBetween(Window.unboundedPreceding, 0))
        if self.size <= block:
            return rows.select("out_pos", own.alias("val"))
        sums = rows.groupBy("_blk").agg(F.sum("val").alias("val"))
        upto = Array(sums.withColumnRenamed("_blk", "pos"), (-(-self.size // block),)).cumsum(block)
        before = upto.join(sums.withColumnRenamed("_blk", "out_pos").withColumnRenamed("val", "_own"), "out_pos").select(F.col("out_pos").alias("_blk"), (F.col("val") - F.col("_own")).alias("_before"))
        return rows.withColumn("val", own).join(before, "_blk").select("out_pos", (F.col("val") + F.col("_before")).alias("val"))

    def block_stats(self, items: int) -> DataFrame:
        """(blk, n, first, last): stored items of each block of ``items``."""
        return self.elems.groupBy(F.expr(f"pos div {items}").alias("blk")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))

    def differences(self, other: Array) -> DataFrame:
        """(out_pos, val, other) where two arrays of one shape differ; holes are zeros."""
        if self.shape != other.shape:
            raise ValueError(f"{self.shape} and {other.shape} can't be compared")
        zero = _zero(self.kind)
        both = self.rows().select("out_pos", "val").join(other.rows().select("out_pos", F.col("val").alias("other")), "out_pos", "full_outer")
        return both.select("out_pos", F.coalesce("val", zero).alias("val"), F.coalesce("other", zero).alias("other")).where(~F.col("val").eqNullSafe(F.col("other")))

    # ---- changes ----

    def append(self, values: DataFrame, shape) -> Array:
        """``values``: (pos, val) of an array of ``shape``, equal but for the major axis."""
        shape, m = shape_of(shape), major_axis(self.shape_, self.order)
        if len(shape) != len(self.shape_) or any(a != b for i, (a, b) in enumerate(zip(shape, self.shape_, strict=True)) if i != m):
            raise ValueError(f"can't append {shape} to {self.shape_}")
        grown = tuple(n + shape[m] if i == m else n for i, n in enumerate(self.shape_))
        moved = values.select((F.col("pos") + prod(self.shape_)).alias("pos"), F.col("val").cast(self.kind).alias("val"))
        base = self.elems.where(F.col("pos") < prod(self.shape_)).select("pos", "val")
        return Array(base.unionByName(moved), grown, self.order)

    def assigned(self, values: DataFrame | Array | bool | int | float | str, shape=None) -> DataFrame:
        """(pos, val): what an assignment to this slice stores. ``values``: a scalar, an array, or rows
        (out_pos, val) in C order of ``shape`` (the slice's own, if not given), which is stretched over
        the slice as NumPy does. Items that the values leave out become zeros."""
        spark = self.elems.sparkSession
        if isinstance(values, Array):
            values, shape = values.rows().select("out_pos", "val"), values.shape
        if not isinstance(values, DataFrame):
            values = spark.range(1).select(F.col("id").alias("out_pos"), F.lit(values).alias("val"))
            shape = ()
        shape = self.shape if shape is None else shape_of(shape)
        repeats = broadcast_axes(shape, self.shape)
        if prod(shape) != self.size:
            source, weight = F.lit(0).cast("long"), 1
            for n, s in zip(reversed(self.shape), reversed(repeats), strict=True):
                if s:
                    source = source + F.expr(f"id div {weight} % {max(1, n)}") * s
                weight *= max(1, n)
            every = spark.range(self.size).select(F.col("id").alias("_to"), source.alias("out_pos"))
            values = every.join(values.select("out_pos", "val"), "out_pos").select(F.col("_to").alias("out_pos"), "val")
        strides = strides_of(self.shape_, self.order)
        pos, w = F.lit(0).cast("long"), 1
        for a in reversed(self._axes()):
            if a.axis is not None:
                pos = pos + (F.expr(f"out_pos div {w} % {max(1, a.n)}") * a.step + a.start) * strides[a.axis]
            w *= max(1, a.n)
        return values.select(pos.alias("pos"), F.col("val").cast(self.kind).alias("val"))

    def assign(self, values, shape=None) -> Array:
        """The array with this slice assigned: what is stored in the slice goes, by a predicate on
        pos, and ``assigned`` comes in its place."""
        kept = self.elems.where(~self._inside()).select("pos", "val")
        return Array(kept.unionByName(self.assigned(values, shape)), self.shape_, self.order)


class Live:
    """An array under change: views of it see every later assignment, by whichever view it is made."""

    def __init__(self, array: Array):
        self.array = array

    def __getitem__(self, idx) -> LiveView:
        return LiveView(self, idx)

    def __setitem__(self, idx, values) -> None:
        self.array = self.array[idx].assign(values)


@dataclass(frozen=True)
class LiveView:
    live: Live
    idx: object

    def now(self) -> Array:
        return self.live.array[self.idx]

    def rows(self) -> DataFrame:
        return self.now().rows()

    def assign(self, values, shape=None) -> None:
        self.live.array = self.now().assign(values, shape)
