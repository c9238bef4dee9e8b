"""Algebra of closed integer ranges [lo, hi], as tables (lo, hi) or (lo, hi, value), over all longs.

Sets are swept: every range opens a place before ``lo`` and closes one behind ``hi``; at each place
the numbers of open ranges are running sums. The places are dealt into buckets at quantiles of the
data (found by bisection), summed inside a bucket, and shifted by what the buckets before it sum up
to (a row a bucket), so no window spans the line, ranges aren't cut, and their width doesn't matter.
Places move once. What is put out is where the state changes, so results are coalesced.

A set of integers is a table of words of 64 bits first: stretches inside a word are ranges already,
and only those that touch a word's edge are swept.

Pairs that overlap are joined by level: a range of at most 2**k keys touches two buckets of 2**k at
most. Levels are three bits apart, so short ranges of about a length are all at one.

Rows with lo > hi are empty ranges and add nothing. Values must not be null; ranges of a map must
not overlap (``violations`` tells). Keys may be any longs, both ends included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled

LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Places that a bucket of the sweep holds, roughly, and the most buckets.
PER_BUCKET = 50_000
MOST_BUCKETS = 10_000
#: Bits between the levels of the pair join.
LEVEL_BITS = 3


def of_keys(keys: DataFrame, key: str) -> DataFrame:
    """Coalesced ranges of a set of integers; it may come with repetitions."""
    k = F.col(key).cast("long")
    bit = F.expr(f"shiftleft(1L, cast(cast(`{key}` as long) & 63 as int))")
    words = keys.where(k.isNotNull()).groupBy(F.shiftright(k, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    words = settled(words)  # read twice
    ends = {"first": "bits & ~shiftleft(bits, 1)", "last": "bits & ~shiftrightunsigned(bits, 1)"}
    each = F.arrays_zip(*(_places_of(F.expr(e)).alias(name) for name, e in ends.items()))
    runs = words.select("word", F.explode(each).alias("x"))
    at = lambda name: F.shiftleft("word", 6) + F.col("x")[name]
    runs = runs.select(at("first").alias("lo"), at("last").alias("hi"), ((F.col("x")["first"] == 0) | (F.col("x")["last"] == 63)).alias("_edge"))
    return runs.where("not _edge").select("lo", "hi").unionByName(coalesced(runs.where("_edge").select("lo", "hi")))


def _places_of(bits: Column) -> Column:
    """Numbers of the bits that are set, in order."""
    one = F.length(F.bin(bits)) - 1
    every = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(bits, i) == 1)
    return F.when(F.bit_count(bits) == 1, F.array(one)).otherwise(every)


def _sided(ranges: DataFrame, side: int) -> DataFrame:
    return ranges.where("lo <= hi").select(F.lit(side).alias("side"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), *(["value"] if "value" in ranges.columns else []))


def _places(ranges: DataFrame, valued: bool) -> DataFrame:
    """Two rows a range: where it opens and where it closes. A place is (last, pos): before ``pos``;
    with ``last``, behind the greatest long. With the numbers of ranges that open less those that
    close there, of either side."""
    value = {"v": F.col("value")} if valued else {}
    behind = {"last": F.col("hi") == MOST, "pos": F.when(F.col("hi") < MOST, F.col("hi") + 1).otherwise(F.lit(MOST)), "d": F.lit(-1)} | {c: F.lit(None).cast(ranges.schema["value"].dataType) for c in value}
    before = {"last": F.lit(False), "pos": F.col("lo"), "d": F.lit(1)} | value
    ends = F.array(*(F.struct(*(x.alias(c) for c, x in end.items())) for end in (before, behind)))
    own = lambda side: F.when(F.col("side") == side, F.col("x.d")).otherwise(0)
    return ranges.select("side", F.explode(ends).alias("x")).select("x.last", "x.pos", own(0).alias("da"), own(1).alias("db"), *(f"x.{c}" for c in value))


def _bucket(pos: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are <= ``pos``, by bisection."""
    if not cuts:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    held = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")  # one literal
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda i, step: i + F.when(F.get(held, i + step - 1) <= pos, step).otherwise(0))


def _sweep(a: DataFrame, b: DataFrame | None, keep: Callable[[Column, Column], Column]) -> DataFrame:
    """Ranges on which ``keep(open ranges of a, open ranges of b)`` holds; with a's values if it has any."""
    valued = "value" in a.columns
    ranges = _sided(a, 0)
    if b is not None:
        ranges = ranges.unionByName(_sided(b.select("lo", "hi"), 1), allowMissingColumns=True)
    ranges = settled(ranges)  # read several times
    parts = min(MOST_BUCKETS, -(-2 * ranges.count() // PER_BUCKET))
    cuts: list[int] = []
    if parts > 1:
        ends = ranges.select(F.explode(F.array("lo", "hi")).alias("pos"))
        cuts = sorted(set(ends.agg(F.percentile_approx("pos", [i / parts for i in range(1, parts)], 10_000).alias("c")).first()["c"] or []))
    places = _places(ranges, valued).withColumn("bucket", _bucket(F.col("pos"), cuts))
    at = F.struct("last", "pos")

    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over a row a bucket
    sums = places.groupBy("bucket").agg(F.sum("da").alias("da"), F.sum("db").alias("db"), *([F.max(F.when(F.col("v").isNotNull(), F.struct(at.alias("at"), "v")))["v"].alias("v")] if valued else []))
    sums = sums.select("bucket", F.coalesce(F.sum("da").over(whole), F.lit(0)).alias("a0"), F.coalesce(F.sum("db").over(whole), F.lit(0)).alias("b0"), *([F.last("v", True).over(whole).alias("v0")] if valued else []))
    line = Window.partitionBy("bucket").orderBy("last", "pos")
    upto, before = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(Window.unboundedPreceding, -1)
    merged = places.repartition("bucket").groupBy("bucket", "last", "pos").agg(F.sum("da").alias("da"), F.sum("db").alias("db"), *([F.max("v").alias("v")] if valued else []))
    values = (F.last("v", True).over(upto).alias("va"), F.last("v", True).over(before).alias("vb")) if valued else ()
    swept = merged.select("*", F.sum("da").over(upto).alias("sa"), F.sum("db").over(upto).alias("sb"), *values).join(F.broadcast(sums), "bucket")
    open_a, open_b = F.col("a0") + F.col("sa"), F.col("b0") + F.col("sb")
    state = lambda x, y, v: F.when(keep(x, y), F.struct(F.coalesce(v, "v0").alias("v")) if valued else F.lit(True))
    turns = swept.select("bucket", "last", "pos", state(open_a, open_b, "va").alias("now"), state(open_a - F.col("da"), open_b - F.col("db"), "vb").alias("was"))
    turns = turns.where(~F.col("now").eqNullSafe(F.col("was"))).select("bucket", at.alias("at"), "now", F.lead(at).over(line).alias("_next"))
    turns = settled(turns)  # read twice

    # a kept stretch ends where the state turns next; for a bucket's last one that is in a later bucket
    firsts = turns.groupBy("bucket").agg(F.min("at").alias("first"))
    following = Window.orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.select("bucket", F.min("first").over(following).alias("_later"))
    turns = turns.where("now is not null").join(F.broadcast(firsts), "bucket")
    end = F.coalesce("_next", "_later")
    hi = F.when(end["last"], F.lit(MOST)).otherwise(end["pos"] - F.when(end["last"], 0).otherwise(1))
    return turns.select(F.col("at.pos").alias("lo"), hi.alias("hi"), *([F.col("now.v").alias("value")] if valued else []))


def coalesced(ranges: DataFrame) -> DataFrame:
    """Disjoint, no two adjacent ones (of an equal value)."""
    return _sweep(ranges, None, lambda a, b: a > 0)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sweep(a.select("lo", "hi"), b, lambda x, y: (x > 0) | (y > 0))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of both; keeps a's value."""
    return _sweep(a, b, lambda x, y: (x > 0) & (y > 0))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Parts of ``a`` outside ``b``; keeps a's value."""
    return _sweep(a, b, lambda x, y: (x > 0) & (y <= 0))


def symmetric(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of one of them only."""
    return _sweep(a.select("lo", "hi"), b, lambda x, y: (x > 0) != (y > 0))


def set_ranges(ranges: DataFrame, new: DataFrame) -> DataFrame:
    """The map with the ranges of ``new`` (lo, hi, value) overwriting it."""
    return coalesced(difference(ranges, new).unionByName(new.select("lo", "hi", "value")))


def set_range(ranges: DataFrame, lo: int, hi: int, value) -> DataFrame:
    kind = ranges.schema["value"].dataType.simpleString()
    return set_ranges(ranges, ranges.sparkSession.createDataFrame([(lo, hi, value)], f"lo long, hi long, value {kind}"))


def del_range(ranges: DataFrame, lo: int, hi: int) -> DataFrame:
    return difference(ranges, ranges.sparkSession.createDataFrame([(lo, hi)], "lo long, hi long"))


# ---- pairs that meet ----


def _level(lo: str, hi: str) -> Column:
    """Bits of hi - lo, up to the next level, 63 at most."""
    bits = F.coalesce(F.length(F.bin(F.expr(f"try_subtract({hi}, {lo})"))), F.lit(63))
    return F.least(F.lit(63), (F.ceil(bits / LEVEL_BITS) * LEVEL_BITS).cast("int"))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """The columns of ``a``, and those of ``b`` (lo2, hi2, value2), of each pair of ranges that meet."""
    a = settled(a.where("lo <= hi").withColumn("_la", _level("lo", "hi")))  # both are read several times
    b = settled(b.where("lo <= hi").select(*(F.col(c).alias(c + "2") for c in b.columns)).withColumn("_lb", _level("lo2", "hi2")))
    levels_a, levels_b = ([r[0] for r in side.select(own).distinct().collect()] for side, own in ((a, "_la"), (b, "_lb")))  # 22 at most

    def keyed(side: DataFrame, lo: str, hi: str, level: Column) -> DataFrame:
        """Once for each bucket that a range touches."""
        at = side.withColumn("_level", level)
        touched = F.array_distinct(F.array(F.expr(f"shiftright({lo}, _level)"), F.expr(f"shiftright({hi}, _level)")))
        return at.withColumn("_bucket", F.explode(touched))

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        both = x.join(y, ["_level", "_bucket"]).where("lo <= hi2 and lo2 <= hi and _bucket = shiftright(greatest(lo, lo2), _level)")
        return both.drop("_level", "_bucket", "_la", "_lb")

    # the longer one is at its own level, the other at all that longer ones have
    at_all = lambda levels, keep: F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), keep))
    longer_b = met(keyed(a, "lo", "hi", at_all(levels_b, lambda k: k >= F.col("_la"))), keyed(b, "lo2", "hi2", F.col("_lb")))
    longer_a = met(keyed(a, "lo", "hi", F.col("_la")), keyed(b, "lo2", "hi2", at_all(levels_a, lambda k: k > F.col("_lb"))))
    return longer_b.unionByName(longer_a)


def get(ranges: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, value, lo, hi) for each of ``keys`` (k): its value and its range; nulls where there is none."""
    held = overlaps(keys.select(F.col("k").alias("lo"), F.col("k").alias("hi")).distinct(), ranges)
    held = held.select(F.col("lo").alias("k"), F.col("value2").alias("value"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"))
    return keys.join(held, "k", "left")


def tested(ranges: DataFrame, asked: DataFrame) -> DataFrame:
    """(lo, hi, has, intersects) for each distinct range of ``asked``: are all its keys in the
    ranges, is any? An empty range has all and meets none."""
    asked = asked.select("lo", "hi").distinct()
    met = overlaps(asked, coalesced(ranges.select("lo", "hi"))).groupBy("lo", "hi").agg(F.max((F.col("lo2") <= F.col("lo")) & (F.col("hi") <= F.col("hi2"))).alias("_all"))
    return asked.join(met, ["lo", "hi"], "left").select("lo", "hi", F.coalesce("_all", F.col("lo") > F.col("hi")).alias("has"), F.col("_all").isNotNull().alias("intersects"))


def covers(ranges: DataFrame, lo: int, hi: int) -> bool:
    """Are all keys of [lo, hi] in the ranges? True of an empty range."""
    return lo > hi or tested(ranges, ranges.sparkSession.createDataFrame([(lo, hi)], "lo long, hi long")).first()["has"]


def intersects(ranges: DataFrame, lo: int, hi: int) -> bool:
    """Is any key of [lo, hi] in the ranges? False of an empty range."""
    return lo <= hi and not ranges.where((F.col("lo") <= F.col("hi")) & (F.col("lo") <= hi) & (F.col("hi") >= lo)).isEmpty()


def violations(ranges: DataFrame) -> DataFrame:
    """Rows that break the invariant: empty, overlapping, or adjacent to one of an equal value."""
    return ranges.exceptAll(coalesced(ranges).select(*ranges.columns))


def contains(ranges: DataFrame, key: int) -> bool:
    return intersects(ranges, key, key)


def equal(a: DataFrame, b: DataFrame) -> bool:
    """The same keys (and values), however cut."""
    x, y = coalesced(a), coalesced(b)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
