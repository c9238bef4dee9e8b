"""Queries over the driver's tables and their SQL.

``events`` by event_id is a 1-d array (dense 0..N-1); with user_id as block and event_id as revision
it is a change log. Order keys of ``lineitem`` are sparse integer sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import generate, history, intervals, sets
from .operators.array import Array

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def size(spark: SparkSession, d: str, name: str = "events") -> int:
    return table(spark, d, name).count()  # from the files' footers


#: The same in SQL.
_N = "(SELECT count(*) FROM events)"


def signal(spark: SparkSession, d: str, shape) -> Array:
    return Array.of(table(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("value").alias("val")), shape)


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.lit(1).cast("long").alias("file_id"), F.col("user_id").alias("blk"), F.col("event_id").alias("rev"), F.col("event_type").alias("value"))


def item(rows: DataFrame) -> DataFrame:
    return rows.select("out_pos", F.round("val", 6).alias("val"))


_SLICE = "SELECT {out} AS out_pos, round(value, 6) AS val FROM events WHERE {where}"


@query("slice_range", _SLICE.format(out="event_id - 103", where="event_id >= 103 AND event_id < " + _N + " - 97"))
def _(s, d):
    return item(signal(s, d, size(s, d))[103:-97].rows())


@query("slice_scalar", _SLICE.format(out="0", where="event_id = " + _N + " - 10"))
def _(s, d):
    return item(signal(s, d, size(s, d))[-10].rows())


@query("slice_strided", _SLICE.format(out="(event_id - 103) // 7", where="event_id >= 103 AND event_id < " + _N + " - 97 AND (event_id - 103) % 7 = 0"))
def _(s, d):
    return item(signal(s, d, size(s, d))[103:-97:7].rows())


@query("slice_reverse", _SLICE.format(out=f"({_N} - 100 - event_id) // 3", where=f"event_id <= {_N} - 100 AND event_id > 100 AND ({_N} - 100 - event_id) % 3 = 0"))
def _(s, d):
    return item(signal(s, d, size(s, d))[-100:100:-3].rows())


@query("slice_nd", "SELECT (event_id // 40 - 3) * 5 + (event_id % 40 - 2) // 8 AS out_pos, round(value, 6) AS val FROM events WHERE event_id < " + _N + " // 40 * 40 AND event_id // 40 >= 3 AND event_id % 40 >= 2 AND (event_id % 40 - 2) % 8 = 0")
def _(s, d):
    return item(signal(s, d, (size(s, d) // 40, 40))[3:, 2::8].rows())


@query("slice_forder", "WITH x AS (SELECT event_id % 10 AS i, event_id // 10 % 20 AS j, event_id // 200 AS k, " + _N + " // 200 AS m, value FROM events WHERE event_id < " + _N + " // 200 * 200) SELECT ((i - 1) // 3) * m + (m - 1 - k) AS out_pos, round(value, 6) AS val FROM x WHERE i >= 1 AND i < 9 AND (i - 1) % 3 = 0 AND j = 19")
def _(s, d):
    shape = (10, 20, size(s, d) // 200)
    a = signal(s, d, shape)
    return item(Array.of(a.elems, shape, "F")[1:9:3, -1, ::-1].rows())


@query("slice_empty", "SELECT CAST(0 AS BIGINT) AS out_pos, round(value, 6) AS val FROM events WHERE false")
def _(s, d):
    return item(signal(s, d, 1000)[5:5].rows())


@query("slice_embedding", "SELECT vec_id * 8 + (k - 1) // 8 AS out_pos, round(CAST(embedding[k] AS DOUBLE), 5) AS val FROM embeddings, (SELECT unnest(range(1, 65, 8)) AS k)")
def _(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v")).select((F.col("vec_id") * 64 + F.col("k")).alias("pos"), F.col("v").cast("double").alias("val"))
    return Array.of(e, (size(s, d, "embeddings"), 64))[:, ::8].rows().select("out_pos", F.round("val", 5).alias("val"))


@query("newaxis_ellipsis", "SELECT event_id % 10 AS out_pos, round(value, 6) AS val FROM events WHERE event_id >= " + _N + " // 100 * 100 - 10 AND event_id < " + _N + " // 100 * 100")
def _(s, d):
    return item(signal(s, d, (size(s, d) // 100, 10, 10))[-1, None, ..., -1, :].rows())


_RED = "round(sum(value), 4) AS sum, round(sum(value) / {n}, 6) AS mean"


@query("reduce_slice", f"SELECT count(*) AS n, count(*) AS stored, {_RED.format(n='count(*)')} FROM events WHERE event_id >= 103 AND event_id < {_N} - 97 AND (event_id - 103) % 7 = 0")
def _(s, d):
    return signal(s, d, size(s, d))[103:-97:7].reduce().select("n", "stored", F.round("sum", 4).alias("sum"), F.round("mean", 6).alias("mean"))


@query("reduce_holes", f"SELECT 2 * {_N} AS n, count(*) AS stored, {_RED.format(n=f'(2.0 * {_N})')}, round(var_pop(value) / 2 + avg(value) ** 2 / 4, 4) AS var, round(least(min(value), 0), 6) AS min, round(greatest(max(value), 0), 6) AS max FROM events")
def _(s, d):
    r = signal(s, d, 2 * size(s, d)).reduce()  # as many holes as items
    return r.select("n", "stored", *(F.round(c, k).alias(c) for c, k in (("sum", 4), ("mean", 6), ("var", 4), ("min", 6), ("max", 6))))


@query("resize_shrink_grow", "SELECT event_id AS out_pos, round(value, 6) AS val FROM events WHERE event_id < " + _N + " - 300")
def _(s, d):
    n = size(s, d)
    return item(signal(s, d, n).resize(n // 3).resize(n - 300).rows())


@query("append_tail", "SELECT event_id AS out_pos, round(value, 6) AS val FROM events UNION ALL SELECT " + _N + " + o_orderkey, round(o_totalprice, 6) FROM orders")
def _(s, d):
    new = table(s, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("val"))
    longest = table(s, d, "orders").agg(F.max("o_orderkey")).first()[0] + 1
    return item(signal(s, d, size(s, d)).append(new, longest).rows())


@query("assign_slice", "SELECT event_id AS out_pos, CASE WHEN event_id >= 10 AND event_id < " + _N + " - 10 AND event_id % 4 = 2 THEN 0.5 ELSE round(value, 6) END AS val FROM events")
def _(s, d):
    return item(signal(s, d, size(s, d))[10:-10:4].assign(0.5)[:].rows())


@query("hole_fill", "SELECT r AS out_pos, coalesce(round(value, 6), 0) AS val FROM (SELECT unnest(range(0, (" + _N + " + 1) // 2)) AS r) LEFT JOIN (SELECT event_id, value FROM events WHERE event_id % 3 = 0) ON r * 2 = event_id")
def _(s, d):
    n = size(s, d)
    a = signal(s, d, n)
    return item(Array.of(a.elems.where("pos % 3 = 0"), n)[::2].dense())


@query("struct_view", "SELECT a.event_id // 2 AS out_pos, round(a.value, 6) AS x, round(b.value, 6) AS y FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0")
def _(s, d):
    return signal(s, d, (size(s, d) // 2, 2)).structured(["x", "y"]).rows().select("out_pos", F.round("val.x", 6).alias("x"), F.round("val.y", 6).alias("y"))


@query("gen_signal", "SELECT event_id AS pos, round(15 * sin(0.2 * event_id), 6) AS val FROM events")
def _(s, d):
    return generate.signal(s, size(s, d)).select("pos", F.round("val", 6).alias("val"))


@query("cumsum_blocks", "SELECT event_id AS out_pos, round(sum(value) OVER (ORDER BY event_id), 3) AS val FROM events")
def _(s, d):
    return signal(s, d, size(s, d)).cumsum(64).select("out_pos", F.round("val", 3).alias("val"))


@query("block_stats", "SELECT event_id // 512 AS blk, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def _(s, d):
    return signal(s, d, size(s, d)).block_stats(512)


#: Revisions that split a log into three: of each commit one third, and the head.
_LO, _HI, _HEAD = f"({_N} // 3)", f"({_N} // 3 * 2)", f"({_N} - 1)"


def thirds(s, d) -> tuple[int, int, int]:
    n = size(s, d)
    return n // 3, n // 3 * 2, n - 1


@query("asof_block_rev", f"SELECT user_id AS blk, max(event_id) AS rev FROM events WHERE event_id <= {_HI} GROUP BY user_id")
def _(s, d):
    return history.rev_at(log(s, d), thirds(s, d)[1]).select("blk", "rev")


@query("slice_by_rev", f"SELECT user_id AS blk, event_id AS rev FROM events WHERE event_id > {_LO} AND event_id <= {_HI} AND user_id IN (SELECT user_id FROM events WHERE event_id <= {_LO} AND event_type = 'click')")
def _(s, d):
    lo, hi, _head = thirds(s, d)
    return history.between(log(s, d), lo, hi, log(s, d).where((F.col("rev") <= lo) & (F.col("value") == "click"))).select("blk", "rev")


_SNAP = "(SELECT user_id AS blk, arg_max(event_type, event_id) AS v FROM events WHERE event_id <= {at} GROUP BY user_id)"


@query("snapshot_at", f"SELECT blk, v AS value FROM {_SNAP.format(at=_HI)}")
def _(s, d):
    return history.snapshot(log(s, d), thirds(s, d)[1], ["blk"])


_DIFF = f"SELECT coalesce(a.blk, b.blk) AS blk, a.v AS old, b.v AS new FROM {_SNAP.format(at=_LO)} a FULL JOIN {_SNAP.format(at=_HI)} b ON a.blk = b.blk WHERE a.v IS DISTINCT FROM b.v"


def third_diff(s, d) -> DataFrame:
    lo, hi, _head = thirds(s, d)
    return history.diff(history.snapshot(log(s, d), lo, ["blk"]), history.snapshot(log(s, d), hi, ["blk"]), ["blk"])


@query("snapshot_diff", _DIFF)
def _(s, d):
    return third_diff(s, d)


@query("diff_patch", f"SELECT blk, v AS value FROM {_SNAP.format(at=_HI)}")
def _(s, d):
    return history.patch(history.snapshot(log(s, d), thirds(s, d)[0], ["blk"]), third_diff(s, d), ["blk"])


@query("diff_reverse", f"SELECT blk, new AS old, old AS new FROM ({_DIFF})")
def _(s, d):
    return history.reverse(third_diff(s, d))


@query("diff_merge", f"SELECT user_id AS blk, arg_min(o, event_id) AS old, arg_max(event_type, event_id) AS new FROM (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), '') AS o FROM events) WHERE event_id > {_LO} AND event_id <= {_HI} GROUP BY user_id HAVING arg_min(o, event_id) IS DISTINCT FROM arg_max(event_type, event_id)")
def _(s, d):
    from pyspark.sql import Window

    lo, hi, _head = thirds(s, d)
    was = F.coalesce(F.lag("value").over(Window.partitionBy("blk").orderBy("rev")), F.lit(""))
    deltas = log(s, d).withColumn("old", was).withColumnRenamed("value", "new").where((F.col("rev") > lo) & (F.col("rev") <= hi))
    return history.compose(deltas, ["blk"])


@query("get_or_none", f"SELECT c.c_custkey AS blk, s.v AS value FROM customer c LEFT JOIN {_SNAP.format(at=_HI)} s ON s.blk = c.c_custkey")
def _(s, d):
    return history.get_or_none(history.snapshot(log(s, d), thirds(s, d)[1], ["blk"]), table(s, d, "customer").select(F.col("c_custkey").alias("blk")), ["blk"])


@query("conflict_check", f"SELECT DISTINCT user_id AS blk FROM events WHERE event_id > {_HI} AND user_id IN (SELECT user_id FROM events WHERE event_id <= {_LO} AND event_type = 'click')")
def _(s, d):
    lo, hi, _head = thirds(s, d)
    return history.conflicts(log(s, d), log(s, d).where((F.col("rev") <= lo) & (F.col("value") == "click")).select("file_id", "blk").distinct(), hi).select("blk")


_PINS = "SELECT c.blk, coalesce(max(CASE WHEN r.rev <= {at} THEN r.rev END), 0) AS rev FROM (SELECT DISTINCT user_id AS blk FROM events WHERE event_id > {at} AND event_id <= " + _HEAD + ") c JOIN (SELECT user_id AS blk, event_id AS rev FROM events) r USING (blk) GROUP BY c.blk"


@query("watch_pins", _PINS.format(at=_HI))
def _(s, d):
    _lo, hi, head = thirds(s, d)
    return history.pins(log(s, d), log(s, d), hi, head).select("blk", "rev")


@query("watch_pin_update", f"SELECT coalesce(a.blk, b.blk) AS blk, b.rev AS rev FROM ({_PINS.format(at=_LO)}) a FULL JOIN ({_PINS.format(at=_HI)}) b ON a.blk = b.blk WHERE a.rev IS DISTINCT FROM b.rev")
def _(s, d):
    lo, hi, head = thirds(s, d)
    at = lambda x: history.pins(log(s, d), log(s, d), x, head)
    return history.pin_update(at(lo), at(hi)).select("blk", "rev")


@query("pins_in_mapping", f"SELECT * FROM ({_PINS.format(at=_HI)}) WHERE blk >= 20 AND blk < 90")
def _(s, d):
    _lo, hi, head = thirds(s, d)
    return history.pins_in(history.pins(log(s, d), log(s, d), hi, head), 1, 20, 90).select("blk", "rev")


@query("history_stats", f"SELECT CAST(1 AS BIGINT) AS files, count(DISTINCT user_id) AS blocks, count(*) AS changes, max(event_id) AS head, min(event_id) AS tail, (SELECT count(*) FROM ({_PINS.format(at=_HI)})) AS pinned FROM events")
def _(s, d):
    _lo, hi, head = thirds(s, d)
    return history.stats(log(s, d), history.pins(log(s, d), log(s, d), hi, head))


@query("tail_slice", f"SELECT user_id AS blk, event_id AS rev FROM events WHERE event_id > {_HI} AND event_id <= {_HEAD}")
def _(s, d):
    lo, hi, head = thirds(s, d)
    return history.Tail(log(s, d), -1, head).forget(lo).slice(hi, head).select("blk", "rev")


@query("tail_rev_at", f"SELECT blk, coalesce(max(CASE WHEN event_id > {_LO} AND event_id <= {_HI} THEN event_id END), {_LO}) AS rev, max(CASE WHEN event_id > {_LO} AND event_id <= {_HI} THEN 1 ELSE 0 END) = 1 AS exact FROM (SELECT user_id AS blk, event_id FROM events) GROUP BY blk")
def _(s, d):
    lo, hi, head = thirds(s, d)
    return history.Tail(log(s, d), -1, head).track(log(s, d)).retained([lo], head).forget(lo).rev_at(hi).select("blk", "rev", "exact")


def order_keys(s, d, flag):
    return table(s, d, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("k"))


def keys(s, d, flag):
    return order_keys(s, d, flag).distinct()


for _name, _op, _f in (("union", "UNION", sets.union), ("intersection", "INTERSECT", sets.intersection), ("difference", "EXCEPT", sets.difference)):
    query(f"set_{_name}", f"SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A' {_op} SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")(lambda s, d, f=_f: f(keys(s, d, "A"), keys(s, d, "R")))


@query("set_symmetric_difference", "(SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def _(s, d):
    return sets.symmetric_difference(keys(s, d, "A"), keys(s, d, "R"))


def _islands(keys_sql: str) -> str:
    return f"SELECT min(k) AS lo, max(k) AS hi FROM (SELECT k, k - row_number() OVER (ORDER BY k) AS g FROM ({keys_sql})) GROUP BY g"


_A, _R = ("SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = '" + x + "'" for x in "AR")


@query("ranges_coalesce", _islands(_A))
def _(s, d):
    return intervals.of_keys(order_keys(s, d, "A"), "k")


for _name, _op, _f in (("union", "UNION", intervals.union), ("intersection", "INTERSECT", intervals.intersection), ("difference", "EXCEPT", intervals.difference)):
    query(f"ranges_{_name}", _islands(f"{_A} {_op} {_R}"))(lambda s, d, f=_f: f(intervals.of_keys(order_keys(s, d, "A"), "k"), intervals.of_keys(order_keys(s, d, "R"), "k")))


@query("ranges_overlap_join", f"SELECT a.lo, a.hi, b.lo AS lo2, b.hi AS hi2 FROM ({_islands(_A)}) a JOIN ({_islands(_R)}) b ON a.lo <= b.hi AND b.lo <= a.hi")
def _(s, d):
    return intervals.overlaps(intervals.of_keys(order_keys(s, d, "A"), "k"), intervals.of_keys(order_keys(s, d, "R"), "k"))


from . import registry_more  # noqa: E402, F401  the rest of the queries
