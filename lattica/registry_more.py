"""Further queries: views, storage, ranges, trees and functions."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import blocks as byte_blocks
from .functions import scalar, text
from .operators import generate, history, intervals, sets
from .operators.array import Array, Live
from .registry import _A, _HI, _LO, _N, _PINS, _R, _islands, item, keys, log, order_keys, query, signal, size, table, thirds
from .session import scratch
from .sources import blockstore, custom
from .sources.store import ConflictError, Store
from .streaming import watch

# ---- views ----


@query("array_attributes", f"SELECT {_N} // 40 AS n0, CAST(40 AS BIGINT) AS n1, {_N} // 40 * 40 AS size, CAST(8 AS BIGINT) AS itemsize, {_N} // 40 * 320 AS nbytes, CAST(320 AS BIGINT) AS stride0, CAST(8 AS BIGINT) AS stride1, CAST(2 AS BIGINT) AS ndim, '<f8' AS dtype")
def _(s, d):
    a = signal(s, d, (size(s, d) // 40, 40))
    row = (*a.shape, a.size, a.itemsize, a.nbytes, *a.strides, a.ndim, a.dtype.str)
    return s.createDataFrame([row], "n0 long, n1 long, size long, itemsize long, nbytes long, stride0 long, stride1 long, ndim long, dtype string")


@query("slice_of_slice", f"WITH x AS (SELECT event_id // 40 AS i, event_id % 40 AS j, {_N} // 40 AS n, value FROM events WHERE event_id < {_N} // 40 * 40) SELECT (i - 3) // 2 * 10 + (35 - j) // 3 AS out_pos, round(value, 6) AS val FROM x WHERE i >= 3 AND (i - 3) % 2 = 0 AND j <= 35 AND j >= 8 AND (35 - j) % 3 = 0")
def _(s, d):
    return item(signal(s, d, (size(s, d) // 40, 40))[3:, 5:36][::2, ::-3][:, :10].rows())


@query("axis_swap", f"SELECT event_id % 40 * ({_N} // 40) + event_id // 40 AS out_pos, round(value, 6) AS val FROM events WHERE event_id < {_N} // 40 * 40")
def _(s, d):
    return item(signal(s, d, (size(s, d) // 40, 40)).swapaxes(0, 1).rows())


@query("strided_view", f"SELECT i * 3 + j AS out_pos, round(value, 6) AS val FROM (SELECT unnest(range(0, ({_N} - 3) // 4)) AS i), (SELECT unnest(range(0, 3)) AS j), events WHERE event_id = 2 + 4 * i - j")
def _(s, d):
    n = size(s, d)
    return item(signal(s, d, n).strided(((n - 3) // 4, 3), (4, -1), 2).rows())


@query("bytes_view", "SELECT 2 * event_id AS out_pos, CAST(event_id % 4294967296 AS BIGINT) AS val FROM events UNION ALL SELECT 2 * event_id + 1, event_id // 4294967296 FROM events")
def _(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("pos"), F.col("event_id").alias("val"))
    return Array.of(e, size(s, d)).view("<u4").rows().select("out_pos", "val")


@query("field_select", "SELECT event_id AS out_pos, user_id AS val FROM events")
def _(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("pos"), F.struct("user_id", "value", "event_type").alias("val"))
    return Array.of(e, size(s, d)).field("user_id").rows().select("out_pos", "val")


@query("whole_array", "SELECT vec_id * 64 + k - 1 AS pos, round(CAST(embedding[k] AS DOUBLE), 5) AS val FROM embeddings, (SELECT unnest(range(1, 65)) AS k)")
def _(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v")).select((F.col("vec_id") * 64 + F.col("k")).alias("pos"), F.col("v").cast("double").alias("val"))
    got = Array.of(e, (size(s, d, "embeddings"), 64)).asarray().ravel()  # guarded: within the bound the whole array fits the driver
    import pandas as pd

    return s.createDataFrame(pd.DataFrame({"pos": np.arange(got.size), "val": got.round(5)}))


@query("assign_broadcast", f"SELECT event_id AS out_pos, CASE WHEN event_id // 40 >= 2 AND event_id % 40 % 2 = 1 THEN CAST(event_id % 40 // 2 AS DOUBLE) ELSE round(value, 6) END AS val FROM events WHERE event_id < {_N} // 40 * 40")
def _(s, d):
    row = Array.of(s.range(20).select(F.col("id").alias("pos"), F.col("id").cast("double").alias("val")), 20)
    return item(signal(s, d, (size(s, d) // 40, 40))[2:, 1::2].assign(row)[:].rows())


@query("append_forder", f"WITH m AS (SELECT {_N} // 40 AS m) SELECT event_id % 40 * (m + 3) + event_id // 40 AS out_pos, round(value, 6) AS val FROM events, m WHERE event_id < m * 40 UNION ALL SELECT k % 40 * (m + 3) + m + k // 40, CAST(k AS DOUBLE) FROM (SELECT unnest(range(0, 120)) AS k), m")
def _(s, d):
    m = size(s, d) // 40
    new = s.range(120).select(F.col("id").alias("pos"), F.col("id").cast("double").alias("val"))
    a = signal(s, d, (40, m))
    return item(Array.of(a.elems.where(F.col("pos") < 40 * m), (40, m), "F").append(new, (40, 3)).rows())


@query("views_alias", f"SELECT event_id - 5 AS out_pos, CASE WHEN event_id % 2 = 0 AND event_id < {_N} - 5 THEN 7.0 WHEN event_id >= 100 AND event_id < 110 THEN 8.0 ELSE round(value, 6) END AS val FROM events WHERE event_id >= 5")
def _(s, d):
    live = Live(signal(s, d, size(s, d)))
    a, b = live[5:], live[:-5]
    live[100:110] = 8.0
    live[:-5:2].assign(7.0)
    assert b.now().shape == a.now().shape
    return item(a.rows())


@query("array_differences", f"SELECT event_id AS out_pos, round(value, 6) AS val, 0.0 AS other FROM events WHERE event_id % 10 = 3 AND value <> 0")
def _(s, d):
    a = signal(s, d, size(s, d))
    return a[:].differences(a[3::10].assign(0.0)[:]).select("out_pos", F.round("val", 6).alias("val"), "other")


@query("random_writes", "SELECT txn, count(*) AS n, max(pos) - min(pos) AS spread FROM (SELECT i // 25 AS txn, i % 25 AS pos FROM (SELECT unnest(range(0, 5000)) AS i)) GROUP BY txn")
def _(s, d):
    w = generate.random_writes(s, 200, size(s, d), 25)
    return w.groupBy("txn").agg(F.count("*").alias("n"), (F.max("pos") - F.min("pos")).alias("spread"))


# ---- the store ----


def store(s: SparkSession, **more) -> Store:
    return Store(s, f"{scratch(s)}/lattica-store-{uuid.uuid4().hex}", **more)


def begun(s: SparkSession, d: str) -> Store:
    """A store of ``a``: the first half of events, then the rest appended, then every third zeroed."""
    out, n = store(s, blk_items=512), size(s, d)
    values = signal(s, d, n).elems
    t = out.begin()
    t.create("a", n // 2, "double")
    t.write("a", values.where(F.col("pos") < n // 2))
    t.commit()
    t = out.begin()
    t.append("a", values.where(F.col("pos") >= n // 2).select((F.col("pos") - n // 2).alias("pos"), "val"), n - n // 2)
    t.commit()
    t = out.begin()
    t.write("a", values.where("pos % 3 = 0").select("pos", F.lit(0.0).alias("val")))
    t.commit()
    return out


@query("store_asof", f"SELECT CAST(1 AS BIGINT) AS at, event_id AS pos, round(value, 6) AS val FROM events WHERE event_id < {_N} // 2 UNION ALL SELECT 2, event_id, round(value, 6) FROM events UNION ALL SELECT 3, event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE round(value, 6) END FROM events")
def _(s, d):
    kept, out = begun(s, d), None
    for at in (1, 2, 3):
        one = kept.view(at).open("a").rows().select(F.lit(at).cast("long").alias("at"), F.col("out_pos").alias("pos"), F.round("val", 6).alias("val"))
        out = one if out is None else out.unionByName(one)
    return out


@query("store_changes", f"SELECT DISTINCT event_id // 512 AS blk, CASE WHEN event_id < {_N} // 2 THEN CAST(1 AS BIGINT) ELSE 2 END AS rev FROM events UNION ALL SELECT DISTINCT event_id // 512, 3 FROM events WHERE event_id % 3 = 0")
def _(s, d):
    return begun(s, d).changes().select("blk", "rev")


@query("store_resync", "SELECT DISTINCT event_id // 512 AS blk FROM events")
def _(s, d):
    view = begun(s, d).view(1)
    return view.resync().select("blk").distinct()


@query("store_append_after_shrink", f"SELECT event_id AS pos, round(value, 6) AS val FROM events WHERE event_id < {_N} // 2 UNION ALL SELECT {_N} // 2 + event_id, 1.5 FROM events WHERE event_id < {_N} // 4 AND event_id % 2 = 1 UNION ALL SELECT event_id, round(value, 6) FROM events WHERE event_id >= {_N} // 2 + {_N} // 4")
def _(s, d):
    kept, n = store(s, blk_items=512), size(s, d)
    t = kept.begin()
    t.create("a", n, "double")
    t.write("a", signal(s, d, n).elems)
    t.commit()
    t = kept.begin()
    t.resize("a", n // 2)
    t.commit()
    t = kept.begin()
    t.append("a", s.range(n // 4).where("id % 2 = 1").select(F.col("id").alias("pos"), F.lit(1.5).alias("val")), n // 4)
    t.commit()
    t = kept.begin()
    t.resize("a", n)  # what lies behind the appended part comes back
    t.commit()
    return kept.open("a").rows().select(F.col("out_pos").alias("pos"), F.round("val", 6).alias("val"))


@query("store_conflict", "SELECT * FROM (VALUES ('first', CAST(2 AS BIGINT), false), ('same block', NULL, true), ('other block', 3, false), ('shape', 4, false), ('shape again', NULL, true), ('after abort', 5, false)) t(who, rev, refused)")
def _(s, d):
    kept, n = store(s, blk_items=512), size(s, d)
    t = kept.begin()
    t.create("a", n, "double")
    t.write("a", signal(s, d, n).elems)
    t.commit()
    put = lambda t, at: t.write("a", s.range(1).select(F.lit(at).alias("pos"), F.lit(1.0).alias("val")))
    out = []

    def tried(who, t) -> None:
        try:
            out.append((who, t.commit(), False))
        except ConflictError:
            out.append((who, None, True))

    x, y, z = kept.begin(), kept.begin(), kept.begin()
    put(x, 3), put(y, 4), put(z, 700)
    tried("first", x), tried("same block", y), tried("other block", z)
    y.abort()
    x, z = kept.begin(), kept.begin()
    x.resize("a", n + 1), z.resize("a", n + 2)
    tried("shape", x), tried("shape again", z)
    y = kept.begin()
    put(y, 4)
    tried("after abort", y)
    return s.createDataFrame(out, "who string, rev long, refused boolean")


# ---- byte blocks ----

#: A user's event types as the bytes of a block; ``cond`` picks events.
_TEXTS = "(SELECT user_id AS blk, string_agg(event_type, '' ORDER BY event_id) AS t FROM events WHERE {cond} GROUP BY user_id)"
_BLKSIZE = 1 << 16


def texts(s: SparkSession, d: str, cond=None) -> DataFrame:
    e = table(s, d, "events") if cond is None else table(s, d, "events").where(cond)
    parts = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), "").alias("t"))
    return parts.select(F.lit(1).cast("long").alias("file_id"), F.col("user_id").alias("blk"), F.col("t").cast("binary").alias("data"))


def saved(df: DataFrame, name: str) -> DataFrame:
    path = f"{scratch(df.sparkSession)}/lattica-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def twice_stored(s: SparkSession, d: str, fmt: str) -> blockstore.BlockFiles:
    """The first third of the log at revision 1, all of it at 2."""
    empty = s.createDataFrame([], blockstore.ROWS)
    first = saved(blockstore.store(empty, saved(texts(s, d, F.col("event_id") <= thirds(s, d)[0]), "texts"), 1, _BLKSIZE, fmt), "rows")
    second = saved(blockstore.store(first, saved(texts(s, d), "texts"), 2, _BLKSIZE, fmt), "rows")
    return blockstore.BlockFiles(first.unionByName(second), _BLKSIZE, fmt)


_BLOCKS = f"SELECT CAST(1 AS BIGINT) AS at, blk, length(t) AS n, md5(t) AS md5 FROM {_TEXTS.format(cond=f'event_id <= {_LO}')} UNION ALL SELECT 2, blk, length(t), md5(t) FROM {_TEXTS.format(cond='true')}"


def roundtrip(fmt: str):
    def run(s, d):
        files, out = twice_stored(s, d, fmt), None
        for at in (1, 2):
            one = files.blocks(at).select(F.lit(at).cast("long").alias("at"), "blk", F.octet_length("data").cast("long").alias("n"), F.md5("data").alias("md5"))
            out = one if out is None else out.unionByName(one)
        return out

    return run


for _fmt in ("ZBlk0", "ZBlk1", "auto"):
    query(f"blocks_roundtrip_{_fmt.lower()}", _BLOCKS)(roundtrip(_fmt))


@query("fmt_auto", f"SELECT blk, CASE WHEN lead(blk) OVER (ORDER BY blk) = blk + 1 THEN 'ZBlk0' WHEN length(t) < {_BLKSIZE // 2} THEN 'ZBlk1' ELSE 'ZBlk0' END AS fmt FROM {_TEXTS.format(cond='true')}")
def _(s, d):
    return blockstore.formats(s.createDataFrame([], blockstore.ROWS), texts(s, d), _BLKSIZE).select("blk", "fmt")


@query("chunk_reuse", f"SELECT n.blk, CAST(g AS INTEGER) * 4096 AS off, least(4096, length(n.t) - g * 4096) AS n FROM {_TEXTS.format(cond='true')} n LEFT JOIN {_TEXTS.format(cond=f'event_id <= {_LO}')} o USING (blk), LATERAL (SELECT unnest(range(0, (length(n.t) + 4095) // 4096)) AS g) WHERE substr(n.t, g * 4096 + 1, 4096) IS DISTINCT FROM substr(o.t, g * 4096 + 1, 4096)")
def _(s, d):
    rows = twice_stored(s, d, "ZBlk1").rows.where("rev = 2")
    return rows.select("blk", "off", F.octet_length("data").cast("long").alias("n"))


@query("fmt_change", f"SELECT blk, 'ZBlk1' AS before, 'ZBlk0' AS after, CAST(2 AS BIGINT) AS rev FROM {_TEXTS.format(cond=f'event_id <= {_LO}')}")
def _(s, d):
    first = saved(blockstore.store(s.createDataFrame([], blockstore.ROWS), saved(texts(s, d, F.col("event_id") <= thirds(s, d)[0]), "texts"), 1, _BLKSIZE, "ZBlk1"), "rows")
    second = saved(blockstore.store(first, texts(s, d, F.col("event_id") <= thirds(s, d)[0]), 2, _BLKSIZE, "ZBlk0"), "rows")
    files = blockstore.BlockFiles(first.unionByName(second), _BLKSIZE)
    return files.blocks(1).select("blk", F.col("fmt").alias("before")).join(files.blocks(2).select("blk", F.col("fmt").alias("after"), "rev"), "blk")


@query("file_size", f"SELECT (max(user_id) + 1) * {_BLKSIZE} AS size FROM events")
def _(s, d):
    return blockstore.file_size(log(s, d), _BLKSIZE).select("size")


@query("block_load", f"SELECT c_custkey AS blk, md5(coalesce(t, '') || repeat(chr(0), CAST(2048 * 64 - length(coalesce(t, '')) AS INTEGER))) AS md5 FROM customer LEFT JOIN {_TEXTS.format(cond='true')} ON blk = c_custkey")
def _(s, d):
    rows = texts(s, d).select("file_id", "blk", F.lit(1).cast("long").alias("rev"), F.lit("ZBlk0").alias("fmt"), F.lit(0).alias("off"), "data")
    asked = table(s, d, "customer").select(F.lit(1).cast("long").alias("file_id"), F.col("c_custkey").alias("blk"))
    return blockstore.load(rows, 2048 * 64, asked).select("blk", F.md5("data").alias("md5"))


@query("memdelta", f"SELECT n.blk, CAST(length(n.t) - length(o.t) AS BIGINT) AS delta FROM {_TEXTS.format(cond='true')} n JOIN {_TEXTS.format(cond=f'event_id <= {_LO}')} o USING (blk)")
def _(s, d):
    old = texts(s, d, F.col("event_id") <= thirds(s, d)[0]).select("blk", F.col("data").alias("old"))
    return texts(s, d).join(old, "blk").select("blk", byte_blocks.memdelta_of("old", "data").alias("delta"))


# ---- ranges ----

_ENDS = f"SELECT CAST({intervals.LEAST} AS BIGINT) AS lo, CAST(0 AS BIGINT) AS hi, 'below' AS value UNION ALL SELECT (SELECT max(l_orderkey) + 10 FROM lineitem), {intervals.MOST}, 'above'"
_MAP = f"(SELECT lo, hi, CASE WHEN lo % 2 = 0 THEN 'even' ELSE 'odd' END AS value FROM ({_islands(_A)}) WHERE lo > 0 UNION ALL {_ENDS})"


def range_map(s, d) -> DataFrame:
    """Ranges of keys with values, and one to either end of the longs."""
    top = table(s, d, "lineitem").agg(F.max("l_orderkey")).first()[0]
    ends = s.createDataFrame([(intervals.LEAST, 0, "below"), (top + 10, intervals.MOST, "above")], "lo long, hi long, value string")
    own = intervals.of_keys(order_keys(s, d, "A"), "k").where("lo > 0")
    return own.select("lo", "hi", F.when(F.col("lo") % 2 == 0, "even").otherwise("odd").alias("value")).unionByName(ends)


@query("range_get", f"SELECT o_orderkey AS k, m.value, m.lo, m.hi FROM (SELECT o_orderkey FROM orders UNION ALL SELECT {intervals.LEAST} UNION ALL SELECT {intervals.MOST}) LEFT JOIN {_MAP} m ON o_orderkey BETWEEN m.lo AND m.hi")
def _(s, d):
    asked = table(s, d, "orders").select(F.col("o_orderkey").alias("k")).unionByName(s.createDataFrame([(intervals.LEAST,), (intervals.MOST,)], "k long"))
    return intervals.get(range_map(s, d), asked)


_ASKED = f"(SELECT DISTINCT lo - 1 AS lo, hi + 2 AS hi FROM ({_islands(_R)}))"


def asked_ranges(s, d) -> DataFrame:
    return intervals.of_keys(order_keys(s, d, "R"), "k").select((F.col("lo") - 1).alias("lo"), (F.col("hi") + 2).alias("hi"))


_COVER = f"(SELECT lo, hi FROM ({_islands(_A)}))"


@query("range_has", f"SELECT q.lo, q.hi, coalesce(bool_or(m.lo <= q.lo AND q.hi <= m.hi), false) AS has FROM {_ASKED} q LEFT JOIN {_COVER} m ON m.lo <= q.hi AND q.lo <= m.hi GROUP BY q.lo, q.hi")
def _(s, d):
    return intervals.tested(intervals.of_keys(order_keys(s, d, "A"), "k"), asked_ranges(s, d)).select("lo", "hi", "has")


@query("range_intersects", f"SELECT q.lo, q.hi, count(m.lo) > 0 AS intersects FROM {_ASKED} q LEFT JOIN {_COVER} m ON m.lo <= q.hi AND q.lo <= m.hi GROUP BY q.lo, q.hi")
def _(s, d):
    return intervals.tested(intervals.of_keys(order_keys(s, d, "A"), "k"), asked_ranges(s, d)).select("lo", "hi", "intersects")


#: The part [x, y] cut out of the map.
_CUT = "(SELECT CAST(-100 AS BIGINT) AS x, max(l_orderkey) // 2 AS y FROM lineitem)"
_LEFT = f"SELECT lo, least(hi, x - 1) AS hi, value FROM {_MAP}, {_CUT} WHERE lo < x UNION ALL SELECT greatest(lo, y + 1), hi, value FROM {_MAP}, {_CUT} WHERE hi > y"
#: Adjacent ranges of one value become one.
_MERGED = "SELECT min(lo) AS lo, max(hi) AS hi, value FROM (SELECT *, sum(b) OVER (ORDER BY lo) AS g FROM (SELECT *, CASE WHEN lag(value) OVER (ORDER BY lo) = value AND CAST(lag(hi) OVER (ORDER BY lo) AS HUGEINT) + 1 = lo THEN 0 ELSE 1 END AS b FROM ({rows}))) GROUP BY g, value"


def cut(s, d) -> tuple[int, int]:
    return -100, table(s, d, "lineitem").agg(F.max("l_orderkey")).first()[0] // 2


@query("range_del", _MERGED.format(rows=_LEFT))
def _(s, d):
    return intervals.del_range(range_map(s, d), *cut(s, d))


@query("range_set", _MERGED.format(rows=f"{_LEFT} UNION ALL SELECT x, y, 'even' FROM {_CUT}"))
def _(s, d):
    return intervals.set_range(range_map(s, d), *cut(s, d), "even")


@query("range_set_limits", _MERGED.format(rows=f"SELECT lo, hi, value FROM {_MAP} WHERE lo <> {intervals.LEAST} AND hi <> {intervals.MOST} UNION ALL SELECT {intervals.LEAST}, -5, 'first' UNION ALL SELECT -4, 0, 'below' UNION ALL SELECT lo, {intervals.MOST - 1}, value FROM {_MAP} WHERE hi = {intervals.MOST} UNION ALL SELECT {intervals.MOST}, {intervals.MOST}, 'last'"))
def _(s, d):
    new = s.createDataFrame([(intervals.LEAST, -5, "first"), (intervals.MOST, intervals.MOST, "last")], "lo long, hi long, value string")
    return intervals.set_ranges(range_map(s, d), new)


@query("range_verify", f"SELECT a.k AS lo, a.k AS hi FROM ({_A}) a JOIN ({_A}) b ON b.k = a.k + 1 UNION SELECT a.k, a.k FROM ({_A}) a JOIN ({_A}) b ON b.k = a.k - 1")
def _(s, d):
    return intervals.violations(keys(s, d, "A").select(F.col("k").alias("lo"), F.col("k").alias("hi")))


@query("ranges_symmetric", _islands(f"({_A} EXCEPT {_R}) UNION ALL ({_R} EXCEPT {_A})"))
def _(s, d):
    a, r = (intervals.of_keys(order_keys(s, d, x), "k") for x in "AR")
    return intervals.symmetric(a, r)


# ---- sets ----


@query("set_update", f"SELECT k FROM ({_A} UNION SELECT -1 UNION SELECT -2) WHERE k NOT IN (1, 2, 3)")
def _(s, d):
    return sets.remove(sets.add(keys(s, d, "A"), -1, -2), 1, 2, 3)


@query("set_has", f"SELECT o_orderkey AS k, o_orderkey IN ({_A}) AS has FROM orders")
def _(s, d):
    return sets.has(keys(s, d, "A"), table(s, d, "orders").select(F.col("o_orderkey").alias("k")))


@query("set_elements", "SELECT k, row_number() OVER (ORDER BY k) AS place FROM (SELECT DISTINCT user_id AS k FROM events)")
def _(s, d):
    ordered = sets.elements(table(s, d, "events").select(F.col("user_id").alias("k")).distinct())
    return Array.of(ordered.select("k"), 1).elems.withColumn("place", F.row_number().over(Window.orderBy("k")).cast("long"))  # as many rows as users


@query("set_text", "SELECT event_type, '{' || string_agg(CAST(u AS VARCHAR), ', ' ORDER BY u) || '}' AS text FROM (SELECT DISTINCT event_type, user_id % 20 AS u FROM events) GROUP BY event_type")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(sets.text(F.collect_set(F.col("user_id") % 20)).alias("text"))


# ---- trees: regions, nations, customers ----

_TREE = "(SELECT CAST(r_regionkey AS BIGINT) AS oid, NULL AS parent FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey FROM nation UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey FROM customer)"


def tree(s, d) -> DataFrame:
    region = table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("oid"), F.lit(None).cast("long").alias("parent"))
    nation = table(s, d, "nation").select((100 + F.col("n_nationkey")).cast("long").alias("oid"), F.col("n_regionkey").cast("long").alias("parent"))
    customer = table(s, d, "customer").select((1000 + F.col("c_custkey")).alias("oid"), (100 + F.col("c_nationkey")).cast("long").alias("parent"))
    return region.unionByName(nation).unionByName(customer)


#: Parent-closed sets: customers that a condition picks, and all above them.
_CLOSED = f"(WITH RECURSIVE up(oid) AS (SELECT 1000 + c_custkey FROM customer WHERE {{cond}} UNION SELECT t.parent FROM up JOIN {_TREE} t USING (oid) WHERE t.parent IS NOT NULL) SELECT oid, parent FROM {_TREE} WHERE oid IN (SELECT oid FROM up))"
_POOR, _NATIONS = "c_acctbal < 0", "c_nationkey IN (1, 5, 9)"


def closed(s, d, cond: str) -> DataFrame:
    whole = tree(s, d)
    nodes = table(s, d, "customer").where(cond).select((1000 + F.col("c_custkey")).alias("oid"))
    return whole.join(history.closure(nodes, whole), "oid", "left_semi").select("oid", "parent")


@query("tree_closure", f"SELECT oid, parent FROM {_CLOSED.format(cond=_NATIONS)}")
def _(s, d):
    return closed(s, d, _NATIONS)


@query("tree_union", f"SELECT * FROM {_CLOSED.format(cond=f'{_NATIONS} OR {_POOR}')}")
def _(s, d):
    return history.tree_union(closed(s, d, _NATIONS), closed(s, d, _POOR))


@query("tree_difference", f"SELECT * FROM {_CLOSED.format(cond=f'{_NATIONS} AND NOT ({_POOR})')}")
def _(s, d):
    return history.tree_difference(closed(s, d, _NATIONS), closed(s, d, _POOR))


@query("tree_apply", f"SELECT * FROM {_CLOSED.format(cond=f'{_NATIONS} AND NOT ({_POOR}) OR c_nationkey = 3')}")
def _(s, d):
    return history.tree_apply(closed(s, d, _NATIONS), closed(s, d, _POOR), closed(s, d, "c_nationkey = 3"))


_CHANGED = f"(SELECT 1000 + c_custkey AS oid FROM customer WHERE {_POOR} UNION SELECT 105)"


def changed_nodes(s, d) -> DataFrame:
    return table(s, d, "customer").where(_POOR).select((1000 + F.col("c_custkey")).alias("oid")).unionByName(s.createDataFrame([(105,)], "oid long"))


_TRACKED = _CLOSED.format(cond=_NATIONS)


@query("tree_connected", f"WITH RECURSIVE t AS (SELECT * FROM {_TRACKED}), up(oid) AS (SELECT oid FROM t WHERE oid IN (SELECT oid FROM {_CHANGED}) UNION SELECT t.parent FROM up JOIN t USING (oid) WHERE t.parent IS NOT NULL) SELECT oid FROM up")
def _(s, d):
    return history.connected(changed_nodes(s, d), closed(s, d, _NATIONS))[0]


@query("tree_top_changed", f"WITH t AS (SELECT * FROM {_TRACKED}), own AS (SELECT t.oid, t.parent, p.parent AS above FROM t LEFT JOIN t p ON p.oid = t.parent WHERE t.oid IN (SELECT oid FROM {_CHANGED})) SELECT oid FROM own WHERE coalesce(parent, -1) NOT IN (SELECT oid FROM {_CHANGED}) AND coalesce(above, -1) NOT IN (SELECT oid FROM {_CHANGED})")
def _(s, d):
    return history.connected(changed_nodes(s, d), closed(s, d, _NATIONS))[1]


_LEAF = f"(SELECT 100 + user_id % 10 AS oid, user_id AS key, arg_max(event_type, event_id) AS value FROM events WHERE event_id <= {{at}} GROUP BY user_id)"


def leaf_values(s, d, at: int) -> DataFrame:
    return history.snapshot(log(s, d), at, ["blk"]).select((100 + F.col("blk") % 10).alias("oid"), F.col("blk").alias("key"), "value")


@query("tree_diff", f"SELECT coalesce(a.key, b.key) AS key, a.value AS old, b.value AS new FROM (SELECT * FROM {_LEAF.format(at=_LO)} WHERE oid IN (101, 105, 109)) a FULL JOIN (SELECT * FROM {_LEAF.format(at=_HI)} WHERE oid IN (101, 105, 109)) b USING (key) WHERE a.value IS DISTINCT FROM b.value")
def _(s, d):
    lo, hi, _head = thirds(s, d)
    return history.tree_diff(leaf_values(s, d, lo), leaf_values(s, d, hi), closed(s, d, _NATIONS))


@query("block_changes", f"SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS file_id, c_custkey // 16 AS blk, CAST(9 AS BIGINT) AS rev FROM customer WHERE {_POOR}")
def _(s, d):
    holders = table(s, d, "customer").select((1000 + F.col("c_custkey")).alias("oid"), F.col("c_nationkey").cast("long").alias("file_id"), F.expr("c_custkey div 16").alias("blk"))
    return history.block_changes(changed_nodes(s, d), holders, 9)


# ---- functions ----


@query("fn_mul", "SELECT o_orderkey, CAST(o_orderkey AS DECIMAL(38, 0)) * o_custkey * 7 AS product FROM orders")
def _(s, d):
    xs = F.array("o_orderkey", "o_custkey", F.lit(7).cast("long"))
    return table(s, d, "orders").select("o_orderkey", scalar.mul_of(xs).alias("product"))


@query("fn_ilog2", "SELECT event_id, CAST(event_id % 40 AS INTEGER) AS exponent FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", scalar.ilog2_exact_of(F.expr("shiftleft(1L, cast(event_id % 40 as int))")).alias("exponent"))


@query("fn_memory", "SELECT event_id, repeat('78', length(event_type)) AS filled, repeat('00', length(event_type)) AS zeroed, lower(hex('ab' || substr(event_type, 3))) AS copied FROM events WHERE length(event_type) >= 2")
def _(s, d):
    b = F.col("event_type").cast("binary")
    hexed = lambda c: F.lower(F.hex(c))
    return table(s, d, "events").where("length(event_type) >= 2").select("event_id", hexed(scalar.memset(b, F.lit(0x78))).alias("filled"), hexed(scalar.bzero(b)).alias("zeroed"), hexed(scalar.memcpy(b, F.lit(b"ab"))).alias("copied"))


@query("fn_stripped", "SELECT event_id, rtrim(event_type || 'x' || repeat('0', CAST(event_id % 5 AS INTEGER)), '0') AS stripped FROM events")
def _(s, d):
    data = F.concat(F.col("event_type").cast("binary"), F.lit(b"x"), F.unhex(F.repeat(F.lit("00"), (F.col("event_id") % 5).cast("int"))))
    return table(s, d, "events").select("event_id", byte_blocks.stripped(data).cast("string").alias("stripped"))


@query("fn_revisions", "SELECT event_id, lower(lpad(to_hex(event_id), 16, '0')) AS name, event_id AS parsed, event_id - 1 AS before FROM events")
def _(s, d):
    name = F.lpad(F.lower(F.hex("event_id")), 16, "0")
    return table(s, d, "events").select("event_id", text.revision_name(F.col("event_id")).alias("name"), scalar.parse_hex64(name).alias("parsed"), scalar.before(F.col("event_id")).alias("before"))


@query("fn_revision_time", "SELECT event_id, TIMESTAMP '1900-01-01' + INTERVAL 1 MINUTE * (event_id % 44640) + INTERVAL 30 SECOND AS t FROM events")
def _(s, d):
    rev = F.expr("(event_id % 44640) * 4294967296L + 2147483648L")
    return table(s, d, "events").select("event_id", scalar.time_of(rev).alias("t"))


_KV = "(SELECT user_id, string_agg(CAST(event_id AS VARCHAR) || ':' || event_type, ',' ORDER BY event_id{order}) AS kv FROM events GROUP BY user_id)"


@query("kv_text", f"SELECT user_id, kv FROM {_KV.format(order='')}")
def _(s, d):
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("event_id")).alias("k"), F.concat(F.col("event_id").cast("string"), F.lit(":"), "event_type").alias("t"))))
    backwards = table(s, d, "events").groupBy("user_id").agg(F.array_join(F.transform(pairs, lambda p: p["t"]), ",").alias("kv"))
    return backwards.select("user_id", text.kv_encode(text.kv_decode(F.col("kv"))).alias("kv"))


@query("watch_requests", "SELECT event_id, CAST(event_id AS BIGINT) AS stream, lower(lpad(to_hex(user_id), 16, '0')) AS oid, CASE WHEN event_id % 3 = 0 THEN NULL ELSE lower(lpad(to_hex(event_id), 16, '0')) END AS at, CASE WHEN event_id % 7 = 0 THEN 'bad watch: expected 2 arguments, got 1' END AS error FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT event_id, event_id, NULL, NULL, 'bad watch: expected 2 arguments, got 1' FROM events WHERE event_id % 7 = 0")
def _(s, d):
    oid, at = (F.lpad(F.lower(F.hex(c)), 16, "0") for c in ("user_id", "event_id"))
    tail = F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.when(F.col("event_id") % 3 == 0, F.lit("-")).otherwise(F.concat(F.lit("@"), at))))
    line = F.concat(F.col("event_id").cast("string"), F.lit(" watch "), oid, tail)
    r = table(s, d, "events").select("event_id", text.watch_request(line).alias("r"))
    return r.select("event_id", F.col("r.stream").cast("long").alias("stream"), "r.oid", "r.at", "r.error")


# ---- extension points and streams ----


@query("apply_function", "SELECT event_id AS pos, round(value * 2 + event_id, 6) AS val FROM events WHERE event_id % 2 = 0")
def _(s, d):
    rows = signal(s, d, size(s, d))[::2].apply(lambda pos, val: val * 2 + 2 * pos, "f8").elems
    return rows.select((F.col("pos") * 2).alias("pos"), F.round("val", 6).alias("val"))


@query("array_ref", f"WITH x AS (SELECT event_id // 40 AS i, event_id % 40 AS j, {_N} // 40 AS n, value FROM events WHERE event_id < {_N} // 40 * 40) SELECT (n - 1 - i) // 2 * 3 + (j - 4) // 9 AS out_pos, round(value, 6) AS val FROM x WHERE (n - 1 - i) % 2 = 0 AND j >= 4 AND j < 30 AND (j - 4) % 9 = 0")
def _(s, d):
    root = signal(s, d, (size(s, d) // 40, 40))
    return item(root.deref(root[::-2, 4:30:9].ref("events")).rows())


class Repeated(custom.BlockSource):
    """Blocks that repeat their own number."""

    blksize = 64

    def load(self, blk: int) -> bytes:
        return str(blk).encode() * 3


@query("custom_source", "SELECT event_id AS blk, repeat(CAST(event_id AS VARCHAR), 3) AS data FROM events")
def _(s, d):
    return custom.scan(s, Repeated(), size(s, d)).select("blk", F.col("data").cast("string").alias("data"))


@query("watch_stream", _PINS.format(at=_LO))
def _(s, d):
    lo, _hi, head = thirds(s, d)
    schema = table(s, d, "events").schema
    log_ = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    none = F.lit(None).cast("long")
    event = lambda seq, kind, at, blk, rev: F.struct(seq.alias("seq"), F.lit(kind).alias("kind"), at.alias("at"), blk.alias("blk"), rev.alias("rev"))
    commit = event(F.col("event_id"), "commit", none, F.col("user_id"), F.col("event_id"))
    opened = F.when(F.col("event_id") == 0, event(F.lit(-1).cast("long"), "open", none, none, F.lit(0).cast("long")))
    moved = F.when(F.col("event_id") == head, event(F.col("event_id"), "commit", none, none, F.col("event_id")))
    asked = F.when(F.col("event_id") == head, event(F.lit(head + 1).cast("long"), "watch", F.lit(lo).cast("long"), none, none))
    events = log_.select(F.lit("w").alias("watcher"), F.lit(1).cast("long").alias("file_id"), F.explode(F.filter(F.array(commit, opened, moved, asked), lambda x: x.isNotNull())).alias("e")).select("watcher", "file_id", "e.*")
    out = f"{scratch(s)}/lattica-watch-{uuid.uuid4().hex}"
    watch.link(events, parts=head // watch.PER_PART + 1).writeStream.format("parquet").option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start(out).awaitTermination()
    return s.read.parquet(out).where("say = 'pin'").select("blk", "rev")
