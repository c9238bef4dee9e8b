"""Arrays against NumPy, the store's transactions, block codecs and the golden change log."""

import numpy as np
import pytest

from lattica import registry
from lattica.functions.blocks import ArrayRef, InvalidArrayRef, adler32, adler32_combine, changed_chunks, from_chunks, memdelta, stitch, to_chunks
from lattica.functions.dtypes import spark_type
from lattica.operators import history, intervals
from lattica.operators.array import Array, Live
from lattica.plans.index import major_axis, normalised, shape_after, shape_of, strides_of
from lattica.sources import blockstore
from lattica.sources.store import ConflictError, Store, UnknownArray

SHAPE = (7, 6, 5)
INDEXES = [np.s_[:], np.s_[2], np.s_[-1], np.s_[1:5], np.s_[5:1:-2], np.s_[:, 1:4, ::2], np.s_[..., -1], np.s_[2:2, 0:2], np.s_[None, -1, ...], np.s_[1:6:2, ::-1, 3], np.s_[3, 4, 0]]


def test_index_algebra_follows_numpy():
    a = np.zeros(SHAPE)
    for i in INDEXES:
        assert shape_after(normalised(i, SHAPE)) == a[i].shape
    for bad, error in (((7,), IndexError), ((-8,), IndexError), ((0, 0, 0, 0), IndexError), ([1, 2], TypeError)):
        with pytest.raises(error):
            normalised(bad, SHAPE)
    assert strides_of((10, 3)) == (3, 1) and strides_of((10, 3), "F") == (1, 10)
    assert major_axis((10, 3)) == 0 and major_axis((10, 3), "F") == 1
    assert shape_of(5) == (5,) and shape_of([1, 4]) == (1, 4)


@pytest.mark.parametrize("order", ["C", "F"])
def test_slices_follow_numpy(spark, order):
    n = int(np.prod(SHAPE))
    a = np.arange(n).reshape(SHAPE, order=order)
    lazy = Array.of(spark.range(n).selectExpr("id as pos", "id as val"), SHAPE, order)
    assert len(lazy) == SHAPE[0 if order == "C" else 2]
    for i in INDEXES:
        got = sorted((r.out_pos, r.val) for r in lazy[i].rows().collect())
        assert got == list(enumerate(np.asarray(a[i]).ravel().tolist()))


def test_reductions_count_holes(spark):
    stored = spark.createDataFrame([(1, 3.0), (4, 5.0)], "pos long, val double")
    r = Array.of(stored, 8).reduce().first()
    x = np.array([0, 3, 0, 0, 5, 0, 0, 0.0])
    assert (r.n, r.stored, r["sum"], r["mean"], r["min"], r["max"]) == (8, 2, x.sum(), x.mean(), 0, 5)
    assert abs(r["var"] - x.var()) < 1e-12


def test_variance_of_large_means(spark):
    x = np.array([1e9 + 1, 1e9 + 3, 0])
    got = Array.of(spark.createDataFrame([(0, 1e9 + 1), (1, 1e9 + 3)], "pos long, val double"), 2).reduce().first()
    assert got["var"] == 1.0
    holes = Array.of(spark.createDataFrame([(0, 1e9 + 1), (1, 1e9 + 3)], "pos long, val double"), 3).reduce().first()
    assert holes["var"] == pytest.approx(x.var(), rel=1e-12)


@pytest.mark.parametrize("n", [7, 500])
def test_reduce_holes_covers_the_table(spark, tmp_path, n):
    spark.range(n).selectExpr("id as event_id", "cast(id + 1 as double) as value").write.parquet(f"{tmp_path}/events.parquet")
    (got,) = registry.QUERIES["reduce_holes"](spark, str(tmp_path)).collect()
    assert (got.n, got.stored, got.sum, got.max, got.min) == (2 * n, n, n * (n + 1) / 2, n, 0)
    assert got["var"] == pytest.approx(np.array([*range(1, n + 1), *[0] * n]).var(), abs=1e-3)


@pytest.mark.parametrize("order", ["C", "F"])
def test_views_follow_numpy(spark, order):
    shape = (4, 3, 5)
    a = np.arange(60).reshape(shape, order=order)
    lazy = Array.of(spark.range(60).selectExpr("id as pos", "id as val"), shape, order)
    pairs = [(lazy[1:, ::-1][:, 1:, ::2], a[1:, ::-1][:, 1:, ::2]), (lazy[2][..., -1], a[2][..., -1]), (lazy.transpose(), a.T), (lazy[:, 1].swapaxes(0, 1)[::-2], a[:, 1].swapaxes(0, 1)[::-2]), (lazy[None, 1][0], a[None, 1][0])]
    for mine, theirs in pairs:
        assert mine.shape == theirs.shape and (mine.asarray() == theirs).all()
    assert lazy.strides == a.strides and lazy.nbytes == a.nbytes and lazy[::2, ::-1].strides == a[::2, ::-1].strides
    want = a.copy()
    want[1:3, ::-1, ::2] = np.arange(3)[:, None]
    column = Array.of(spark.range(3).selectExpr("id as pos", "id as val"), (3, 1))
    assert (lazy[1:3, ::-1, ::2].assign(column)[:].asarray() == want).all()
    with pytest.raises(ValueError, match="broadcast"):
        lazy.assign(column.flat().resize(7))
    ref = lazy[1:, ::-2].ref("r")
    assert (lazy.deref(ref).asarray() == a[1:, ::-2]).all()


def test_records_steps_and_bytes(spark):
    a = np.arange(12, dtype="<i4").reshape(4, 3)
    lazy = Array.of(spark.range(12).selectExpr("id as pos", "cast(id as int) as val"), (4, 3))
    records = lazy[:3, :2].structured(["x", "y"])
    assert records.asarray().tolist() == [(0, 1), (3, 4), (6, 7)] and records.field("y").asarray().tolist() == [1, 4, 7]
    columns = Array.of(lazy.elems, (4, 3), "F").structured(list("abcd"))
    assert columns.asarray().tolist() == [(0, 1, 2, 3), (4, 5, 6, 7), (8, 9, 10, 11)]
    for bad in (lambda: lazy[:, ::-1].structured("abc"), lambda: lazy[:, ::2].structured("ab"), lambda: lazy.structured("a")):
        with pytest.raises(ValueError):
            bad()
    assert (lazy.strided((3, 2, 2), (3, 1, -1), 2).asarray() == np.lib.stride_tricks.as_strided(a.ravel()[2:], (3, 2, 2), (12, 4, -4))).all()
    with pytest.raises(ValueError):
        lazy.strided((5, 2), (3, 1))
    for dtype, offset in (("<i2", 0), ("<i8", 0), ("u1", 0), ("<f8", 8), ("<i2", 3 + 1), ("<u4", 0)):
        assert (lazy.view(dtype, offset).asarray() == a.ravel().view("u1")[offset:].view(dtype)).all()
    with pytest.raises(ValueError):
        lazy.view("<i8", 3)
    assert list(lazy[1]) == [3, 4, 5] and [part.shape for part in lazy] == [(3,)] * 4 and len(lazy) == 4
    with pytest.raises(MemoryError):
        lazy.asarray(most_bytes=10)
    live = Live(lazy)
    row, column = live[0], live[:, 0]
    column.assign(9)
    assert row.now().asarray().tolist() == [9, 1, 2]
    assert [r.val for r in Array.of(lazy.elems, 12).cumsum(2).orderBy("out_pos").collect()] == a.ravel().cumsum().tolist()
    assert sorted(map(tuple, lazy.differences(lazy[1].assign(7)).collect())) == [(3, 3, 7), (4, 4, 7), (5, 5, 7)]
    grown = Array.of(spark.range(5).selectExpr("id as pos", "id as val"), (1, 5), "F").append(spark.range(2).selectExpr("id as pos", "id + 5 as val"), (1, 2))
    assert grown[:].asarray().tolist() == [list(range(7))]


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", blk_items=4)
    t = store.begin()
    t.create("a", 10, "int")
    t.write("a", spark.range(10).selectExpr("id as pos", "cast(id as int) as val"))
    assert t.isdirty() and t.commit() == 1 and not t.isdirty()
    one, two, other = store.begin(), store.begin(), store.begin()
    one.write("a", spark.createDataFrame([(0, 11)], "pos long, val int"))
    two.write("a", spark.createDataFrame([(1, 12)], "pos long, val int"))
    other.write("a", spark.createDataFrame([(9, 13)], "pos long, val int"))
    assert one.commit() == 2
    with pytest.raises(ConflictError):
        two.commit()
    assert two.open("a")[0:1].rows().first().val == 0
    assert other.commit() == 3
    assert [store.open("a", at)[:1].rows().first().val for at in (1, 2, 3)] == [0, 11, 11]
    t = store.begin()
    t.append("a", spark.createDataFrame([(0, 7), (1, 8)], "pos long, val int"), 2)
    t.commit()
    assert store.open("a").shape == (12,) and store.open("a")[-1].rows().first().val == 8
    t = store.begin()
    t.resize("a", 3)
    t.commit()
    t = store.begin()
    t.resize("a", 12)
    t.commit()
    assert store.open("a", 5).shape == (3,) and store.open("a")[-1].rows().first().val == 8
    x, y = store.begin(), store.begin()
    x.resize("a", 13), y.resize("a", 14)
    x.commit()
    with pytest.raises(ConflictError):
        y.commit()


def test_interleaved_commits(spark, tmp_path):
    """Of two transactions over one block one is refused, at whichever step the other comes in."""
    for steps in range(2):
        store = Store(spark, f"file://{tmp_path}/i{steps}", blk_items=4)
        t = store.begin()
        t.create("a", 10, "int")
        t.commit()
        one, two = store.begin(), store.begin()
        for txn, val in ((one, 1), (two, 2)):
            txn.write("a", spark.createDataFrame([(val, val)], "pos long, val int"))
        mine = one.attempts()
        for _ in range(steps):
            assert next(mine) is None
        assert two.commit() == 2
        with pytest.raises(ConflictError):
            list(mine)
        assert store.open("a")[:3].asarray().tolist() == [0, 0, 2]
        other = store.begin()
        other.write("a", spark.createDataFrame([(8, 8)], "pos long, val int"))
        late = other.attempts()
        assert next(late) is None
        t = store.begin()
        t.write("a", spark.createDataFrame([(0, 5)], "pos long, val int"))
        assert t.commit() == 3
        assert [rev for rev in late if rev] == [4]  # another block: it takes the next revision


def test_store_log_views_and_shrinks(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", blk_items=4)
    t = store.begin()
    t.create("a", 10, "int")
    t.write("a", spark.range(10).selectExpr("id as pos", "cast(id as int) as val"))
    t.store_parts()
    assert t.isdirty()
    t.commit()
    view = store.view()
    t = store.begin()
    t.resize("a", 3)
    t.commit()
    t = store.begin()
    t.append("a", spark.createDataFrame([(1, 7)], "pos long, val int"), 2)
    assert t.open("a").asarray().tolist() == [0, 1, 2, 0, 7]
    t.commit()
    assert store.open("a").asarray().tolist() == [0, 1, 2, 0, 7] and store.open("a", 1).asarray().tolist() == list(range(10))
    t = store.begin()
    t.assign("a", np.s_[::2], Array.of(spark.createDataFrame([(0, 9)], "pos long, val int"), 3))
    t.commit()
    assert store.open("a").asarray().tolist() == [9, 1, 0, 0, 0]
    store.checkpoint()
    again = Store(spark, f"file://{tmp_path}/s", blk_items=4)
    assert again.commits() == store.commits() and again.wait(4, 1) == 4 and again.stat("a")["rev"] == 4
    assert not [n for n in again.files.names(f"{again.root}/log") if n.endswith(".tmp")]
    with pytest.raises(TimeoutError):
        again.wait(5, 0.1)
    with pytest.raises(UnknownArray):
        again.open("b")
    assert view.get("b") is None and view.open("a").shape == (10,)
    assert {(r.blk, r.rev) for r in view.resync().collect()} == {(1, 3), (0, 4), (1, 4)} and view.open("a").shape == (5,)
    with pytest.raises(ValueError):
        view.resync(1)


def test_watch_pins_of_the_golden_log(spark):
    log = {1: [2], 2: [2, 3, 4, 5], 3: [0, 2, 5], 4: [2, 4, 5], 5: [3, 5]}
    changes = spark.createDataFrame([(7, b, r) for r, bs in log.items() for b in bs], "file_id long, blk long, rev long")
    tracked = spark.createDataFrame([(7, b) for b in (0, 1, 2, 3, 5)], "file_id long, blk long")
    want = {1: {0: 0, 2: 1, 3: 0, 5: 0}, 2: {0: 0, 2: 2, 3: 2, 5: 2}, 3: {2: 3, 3: 2, 5: 3}, 4: {3: 2, 5: 4}, 5: {}}
    pins = {at: history.pins(changes, tracked, at, 5) for at in want}
    assert {at: {r.blk: r.rev for r in p.collect()} for at, p in pins.items()} == want
    moved = {r.blk: r.rev for r in history.pin_update(pins[3], pins[4]).collect()}
    assert moved == {2: None, 5: 4}


def test_intervals(spark, monkeypatch):
    """Against sets of keys, with many buckets, and at both ends of the longs."""
    monkeypatch.setattr(intervals, "PER_BUCKET", 4)
    rng = np.random.default_rng(1)
    least, most = intervals.LEAST, intervals.MOST
    table = lambda rows, valued=False: spark.createDataFrame(rows, "lo long, hi long" + ", value string" * valued)
    got = lambda df: sorted(tuple(r) for r in df.collect())
    a, b = ([(int(x), int(x) + int(n)) for x, n in zip(rng.integers(-50, 50, 14), rng.integers(-1, 7, 14), strict=True)] for _ in range(2))
    keys = lambda rows: {k for lo, hi in rows for k in range(lo, hi + 1)}

    def islands(found):
        out = []
        for k in sorted(found):
            if out and out[-1][1] == k - 1:
                out[-1] = (out[-1][0], k)
            else:
                out.append((k, k))
        return out

    assert got(intervals.union(table(a), table(b))) == islands(keys(a) | keys(b))
    assert got(intervals.intersection(table(a), table(b))) == islands(keys(a) & keys(b))
    assert got(intervals.difference(table(a), table(b))) == islands(keys(a) - keys(b))
    assert got(intervals.overlaps(table(a), table(b))) == sorted((*x, *y) for x in a for y in b if x[0] <= x[1] and y[0] <= y[1] and x[0] <= y[1] and y[0] <= x[1])
    whole = table([(least, most, "a")], True)
    assert got(intervals.set_range(whole, 3, 4, "x")) == [(least, 2, "a"), (3, 4, "x"), (5, most, "a")]
    assert got(intervals.set_range(whole, most, most, "x")) == [(least, most - 1, "a"), (most, most, "x")]
    assert got(intervals.set_range(whole, least, 4, "a")) == [(least, most, "a")]
    assert got(intervals.del_range(whole, least, most)) == [] and got(intervals.del_range(whole, most, most)) == [(least, most - 1, "a")]
    assert intervals.covers(whole, least, most) and intervals.contains(whole, most) and not intervals.covers(table([(1, 6)]), 5, 7) and intervals.covers(table([]), 3, 2)
    assert got(intervals.violations(table([(1, 2, "a"), (3, 4, "a"), (6, 7, "a"), (8, 9, "b"), (9, 9, "c")], True))) == [(1, 2, "a"), (3, 4, "a"), (8, 9, "b")]
    assert intervals.equal(table([(1, 2), (3, 4)]), table([(1, 4)]))


def test_history_refuses(spark):
    deltas = spark.createDataFrame([(1, 1, "a", "b"), (1, 2, "c", "d")], "k long, rev long, old string, new string")
    with pytest.raises(Exception, match="duplicate entries"):
        history.compose(deltas, ["k"]).collect()
    chain = spark.createDataFrame([(i, i + 1 if i < 70 else None) for i in range(71)], "oid long, parent long")
    assert history.closure(spark.createDataFrame([(0,)], "oid long"), chain).count() == 71
    with pytest.raises(ValueError, match="2 parents"):
        history.closure(spark.createDataFrame([(1,)], "oid long"), spark.createDataFrame([(1, 2), (1, 3)], "oid long, parent long"))
    tail = history.Tail(spark.createDataFrame([(1, 5, r) for r in range(1, 9)], "file_id long, blk long, rev long"), 0, 8).forget(3)
    assert sorted(r.rev for r in tail.slice(4, 6).collect()) == [5, 6]
    assert tail.retained([5], 1).tail == 5 and tail.retained([2], 1).tail == 3
    for bad in (lambda: tail.slice(2, 6), lambda: tail.slice(6, 5), lambda: tail.slice(6, 9), lambda: tail.update(tail.changes, 7)):
        with pytest.raises(ValueError):
            bad()


def test_block_files_in_both_formats(spark, tmp_path):
    size = 4 * 4096
    table = lambda blocks: spark.createDataFrame([(1, b, bytearray(x)) for b, x in blocks.items()], "file_id long, blk long, data binary")

    def stored(files, blocks, rev):
        new = blockstore.store(files.rows, table(blocks), rev, size, files.fmt)
        new.write.parquet(f"{tmp_path}/{files.fmt}-{rev}")
        rows = spark.read.parquet(f"{tmp_path}/{files.fmt}-{rev}")
        return blockstore.BlockFiles(rows if rev == 1 else files.rows.unionByName(rows), size, files.fmt)

    first = {0: b"\1" * 100, 1: b"\2" * size, 3: bytes(5000) + b"\3" * 10}
    second = {0: b"\1" * 100 + bytes(4096) + b"\4", 3: b"", 4: b"\5" * 9000}
    for fmt in ("ZBlk0", "ZBlk1", "auto"):
        files = blockstore.BlockFiles(spark.createDataFrame([], blockstore.ROWS), size, fmt)
        files = stored(stored(files, first, 1), second, 2)
        for at, want in ((1, first), (2, {**first, **second})):
            got = {r.blk: r for r in files.blocks(at).collect()}
            assert {k: bytes(r.data) for k, r in got.items()} == {k: x.rstrip(b"\0") for k, x in want.items()}
    assert {(r.blk, r.fmt) for r in got.values()} == {(0, "ZBlk1"), (1, "ZBlk0"), (3, "ZBlk0"), (4, "ZBlk0")}
    whole = b"".join({**first, **second}.get(k, b"").ljust(size, b"\0") for k in range(5))
    import zlib

    assert adler32(files.blocks().select("blk", "data"), size, 2) == zlib.adler32(whole)
    assert blockstore.read_bytes(files.rows, size, 1, size - 5, 20) == whole[size - 5 : size + 15] and len(blockstore.read_bytes(files.rows, size, 1, 5 * size - 3, 10)) == 3
    with pytest.raises(ValueError, match="unknown block format"):
        blockstore.BlockFiles(files.rows, size, "ZBlk2")


def test_blocks(spark):
    assert memdelta(b"aXcZEF", b"aYcQRS") == 4 and memdelta(b"", b"ab") == 2
    size = 3 * 4096
    data = b"\0" * 4096 + b"x" * 10 + b"\0" * 5000
    blocks = spark.createDataFrame([(1, 0, 1, bytearray(data.ljust(size, b"\0")))], "file_id long, blk long, rev long, data binary")
    chunks = to_chunks(blocks)
    assert [(r.off, bytes(r.data)) for r in chunks.collect()] == [(4096, b"x" * 10)]
    assert bytes(from_chunks(chunks, size).first().data) == data.rstrip(b"\0")
    assert changed_chunks(chunks, chunks).isEmpty()
    for bad in ([(-1, b"x")], [(0, b"xx"), (1, b"y")], [(9, b"xx")], [(3, b""), (3, b"")]):
        with pytest.raises(ValueError):
            stitch(bad, 10)
    assert adler32(spark.createDataFrame([(0, bytearray(b""))], "blk long, data binary"), 2 << 20) == 0x01E00001
    import zlib

    assert adler32_combine(zlib.adler32(b"abc"), zlib.adler32(b"defg"), 4) == zlib.adler32(b"abcdefg")


def test_references():
    root = np.arange(256, dtype=np.uint8)
    for view in (root[10:20], root[20:10:-2], root.view("<u4")[3:9:2], root[5:205].reshape(20, 10)[::-1, 2::3]):
        ref = ArrayRef.of("r", root, view)
        assert (ref.deref(root.tobytes()) == view).all()
    with pytest.raises(InvalidArrayRef):
        ArrayRef("r", 0, 300, 0, (1,), (1,), "|u1").deref(root.tobytes())
    for bad in (ArrayRef("r", 0, 10, 0, (11,), (1,), "|u1"), ArrayRef("r", 0, 10, 10, (0,), (1,), "|u1")):
        with pytest.raises(InvalidArrayRef):
            bad.deref(root.tobytes())


def test_dtypes():
    for bad in (object, "i4, O"):
        with pytest.raises(TypeError):
            spark_type(bad)
    assert spark_type("u8").simpleString() == "decimal(20,0)" and spark_type("c16").simpleString() == "struct<re:double,im:double>"
    assert spark_type([("x", "<i2"), ("y", "f8", (2,))]).simpleString() == "struct<x:smallint,y:array<double>>"


def test_ranges_of_keys_and_symmetric_difference(spark, monkeypatch):
    """Repeated keys, words' edges, both ends of the longs; only stretches at words' edges are swept."""
    rng = np.random.default_rng(2)
    least, most = intervals.LEAST, intervals.MOST
    got = lambda df: sorted(tuple(r) for r in df.collect())

    def islands(found):
        out = []
        for k in sorted(found):
            if out and out[-1][1] == k - 1:
                out[-1] = (out[-1][0], k)
            else:
                out.append((k, k))
        return out

    pick = lambda: {int(k) for k in rng.integers(-400, 400, 500)} | {least, least + 1, most - 64, most - 63, most, *range(1000, 1200)}
    a, b = pick(), pick() - {least, 1100}
    table = lambda keys: spark.createDataFrame([(k,) for k in [*keys, *keys, None]], "k long")
    swept, sweep = [], intervals._sweep
    monkeypatch.setattr(intervals, "_sweep", lambda x, y, keep: swept.append(x.count()) or sweep(x, y, keep))
    of_a, of_b = intervals.of_keys(table(a), "k"), intervals.of_keys(table(b), "k")
    assert got(of_a) == islands(a) and sum(swept) < len(islands(a))
    swept.clear()
    monkeypatch.setattr(intervals, "PER_BUCKET", 16)
    assert got(intervals.symmetric(of_a, of_b)) == islands(a ^ b) and len(swept) == 1
    assert got(intervals.of_keys(table([]), "k")) == []


def test_buckets_are_found_by_bisection(spark):
    from bisect import bisect_right

    from pyspark.sql import functions as F

    for n in (0, 1, 3, 4, 100, 1000):
        cuts = sorted({intervals.LEAST, intervals.MOST, *(int(k) for k in np.random.default_rng(n).integers(-5000, 5000, n))})[: n or None] if n else []
        keys = [intervals.LEAST, -5001, -1, 0, 1, 7, 5001, intervals.MOST - 1, intervals.MOST, *cuts[:50]]
        got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", intervals._bucket(F.col("k"), cuts).alias("b")).collect()
        assert all(r.b == bisect_right(cuts, r.k) for r in got)


def test_overlaps_of_short_and_wide_ranges(spark):
    """Short ranges share a level, so that none is repeated at several; wide ones meet them all."""
    rng = np.random.default_rng(3)
    least, most = intervals.LEAST, intervals.MOST
    wide = [(least, most), (least, -5), (0, most), (7, 6), (-3, 1 << 40), (most, most), (least, least)]
    a, b = ([*((int(x), int(x) + int(n)) for x, n in zip(rng.integers(-60, 60, 30), 2 ** rng.integers(0, 7, 30) - 1, strict=True)), *wide] for _ in range(2))
    table = lambda rows: spark.createDataFrame(rows, "lo long, hi long")
    got = sorted(tuple(r) for r in intervals.overlaps(table(a), table(b)).collect())
    assert got == sorted((*x, *y) for x in a for y in b if x[0] <= x[1] and y[0] <= y[1] and x[0] <= y[1] and y[0] <= x[1])
    levels = table([(0, n) for n in range(8)]).select(intervals._level("lo", "hi").alias("k")).distinct().collect()
    assert len(levels) == 1
