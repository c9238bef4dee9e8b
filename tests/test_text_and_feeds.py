"""Text forms, block files both ways, the change feed and its pins."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lattica.functions.text import HEAD, kv_decode, kv_encode, revision_name, store_location, watch_request
from lattica.sources.blockfile import BlockFile
from lattica.streaming.watch import Link, fan_out, feed, link


def test_watch_requests(spark):
    oid, at = "00000000000000ab", "0285CBAC258BF266"
    lines = {
        f"2 watch {oid} @{at}\n": (2, oid, at.lower(), None),
        f"4 watch {oid} -": (4, oid, None, None),
        "6": (None, None, None, 'invalid frame: "6"'),
        'x "bye"': (None, None, None, r'invalid frame: "x \"bye\"" (invalid stream)'),
        "18446744073709551616 bye": (None, None, None, 'invalid frame: "18446744073709551616 bye" (invalid stream)'),
        "8 bye": (8, None, None, 'bad watch: not a watch request: "bye"'),
        f"8 watch {oid}": (8, None, None, "bad watch: expected 2 arguments, got 1"),
        f"8 watch {oid} -  ": (8, None, None, "bad watch: expected 2 arguments, got 4"),
        "8 watch 12 -": (8, None, None, "bad watch: invalid oid"),
        f"8 watch {oid} {at}": (8, None, None, "bad watch: invalid at"),
    }
    rows = spark.createDataFrame([(x,) for x in [*lines, None]], "line string").select("line", watch_request(F.col("line")).alias("r")).collect()
    got = {r.line: r.r and (None if r.r.stream is None else int(r.r.stream), r.r.oid, r.r.at, r.r.error) for r in rows}
    assert got == lines | {None: None}


def test_revision_names_and_key_value_text(spark):
    r = spark.createDataFrame([(255, "3:hello,1:zzz,4:a:b"), (HEAD, "")], "rev long, kv string")
    got = r.select(revision_name(F.col("rev")).alias("rev"), kv_encode(kv_decode(F.col("kv"))).alias("kv")).collect()
    assert [tuple(x) for x in got] == [("00000000000000ff", "1:zzz,3:hello,4:a:b"), ("head", "")]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("1:a,1:b",)], "kv string").select(kv_decode(F.col("kv"))).collect()


def test_store_locations():
    assert store_location("neo://c@b:2,a:1?ca=x&z=1&compress=1&b=2") == "neos://c@a:1,b:2?b=2&z=1"
    assert store_location("neo://a,b@m?ca=&key=") == "neo://a,b@m"
    assert store_location("neo://b,a") == "neo://a,b"
    assert store_location("file:///x/y.fs") == "file:///x/y.fs"
    with pytest.raises(NotImplementedError):
        store_location("http://x")


def test_block_files(spark, tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"aaaabbbbcccc")
    spark.dataSource.register(BlockFile)
    opened = lambda: {r.blk: bytes(r.data) for r in spark.read.format("blockfile").option("path", str(path)).option("blksize", 4).load().collect()}
    assert opened() == {0: b"aaaa", 1: b"bbbb", 2: b"cccc"}
    new = spark.createDataFrame([(1, b"xy"), (4, b"zzzz")], "blk long, data binary")
    save = lambda df, mode="append": df.write.format("blockfile").option("path", str(path)).option("blksize", 4).mode(mode).save()
    save(new)
    assert opened() == {0: b"aaaa", 1: b"xy\0\0", 2: b"cccc", 3: bytes(4), 4: b"zzzz"}
    with pytest.raises(PySparkException):
        save(spark.createDataFrame([(0, b"12345")], "blk long, data binary"))
    path.write_bytes(b"12345")
    with pytest.raises(PySparkException):
        opened()


LOG = {1: [2], 2: [2, 3, 5], 3: [0, 2, 5], 4: [2, 5], 5: [3, 5]}
STEPS = {0: {0: 0, 2: 0, 3: 0, 5: 0}, 1: {2: 1}, 2: {2: 2, 3: 2, 5: 2}, 3: {0: None, 2: 3, 5: 3}, 4: {2: None, 5: 4}, 5: {3: None, 5: None}}


def test_a_watch_moves_along_the_golden_log():
    at = Link()
    seq = iter(range(1000))
    say = lambda *event: list(at.event(next(seq), *event))
    assert say("watch", 0, None, None)[0][4].startswith("file not yet known")
    say("open", None, None, 0)
    for rev, blks in LOG.items():
        for blk in blks:
            assert say("commit", None, blk, rev) == []
    for step, want in STEPS.items():
        said = say("watch", step, None, None)
        assert {m[2]: m[3] for m in said if m[1] == "pin"} == want and said[-1][1] == "ok"
    assert say("watch", 4, None, None)[0][4] == "going back in history is forbidden"
    assert say("watch", 6, None, None) == []  # it waits for the head
    assert [m[1] for m in say("commit", None, None, 6)] == ["ok"]
    assert [(m[2], m[3]) for m in say("commit", None, 2, 7)] == [(2, 4)] and say("commit", None, 2, 8) == []
    assert say("unwatch", None, None, None)[0][1] == "ok" and say("commit", None, 2, 9) == []
    say("forget", None, None, 8)
    assert "too far away back" in say("watch", 7, None, None)[0][4]
    assert Link(at.saved()).saved() == at.saved()
    late = Link()
    for event in (("open", None, None, 3), ("commit", None, 1, 9), ("watch", 2, None, None), ("watch", 5, None, None)):
        last = list(late.event(0, *event))
        assert event[0] != "watch" or event[1] != 2 or "epoch" in last[0][4]
    assert [(m[2], m[3]) for m in late.event(0, "commit", None, 1, 4)] == [(1, 4)]  # a late commit corrects a pin


def test_pins_of_a_feed(spark, tmp_path):
    """The golden log, one commit a file, for two watchers."""
    (tmp_path / "feed").mkdir()
    for rev, blks in LOG.items():
        spark.createDataFrame([(1, b, rev) for b in blks], "file_id long, blk long, rev long").coalesce(1).write.parquet(str(tmp_path / f"in{rev}"))
        for p in (tmp_path / f"in{rev}").glob("part-*"):
            p.rename(tmp_path / "feed" / f"{rev}.parquet")
    watchers = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "watcher string, file_id long")
    commits = fan_out(feed(spark, str(tmp_path / "feed"), 2), watchers)
    asked = F.when((F.col("rev") == 1) & (F.col("blk") == 2), F.array(F.struct(F.lit("open").alias("kind"), F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("rev")), F.struct(F.lit("watch").alias("kind"), F.when(F.col("watcher") == "a", 1).otherwise(3).cast("long").alias("at"), F.lit(None).cast("long").alias("rev"))))
    each = F.explode(F.concat(F.array(F.struct("kind", "at", "rev")), F.coalesce(asked, F.array())))
    events = commits.select("watcher", "file_id", "seq", "blk", each.alias("e")).select("watcher", "file_id", "seq", "e.kind", "e.at", "blk", "e.rev")
    query = link(events).writeStream.format("memory").queryName("pins").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(200)
    got = {}
    for r in spark.table("pins").where("say = 'pin'").collect():
        got.setdefault(r.watcher, {})[r.blk] = r.rev
    assert got == {"a": {0: 0, 2: 1, 3: 0, 5: 0}, "b": {2: 3, 3: 2, 5: 3}}


def test_a_watcher_in_parts_says_the_same(spark, tmp_path):
    """Waiting, refused and moved watches; revisions that a float doesn't hold."""
    base = 1 << 60
    events = [(-1, "open", None, None, base)]
    for i in range(60):
        events += [(i, "commit", None, i * 7 % 11, base + i), (i, "commit", None, None, base + i)]
    events += [(5, "watch", base + 20, None, None), (30, "watch", base + 25, None, None), (31, "watch", base + 1, None, None), (33, "confirm", None, 3, None)]
    events += [(40, "unwatch", None, None, None), (45, "forget", None, None, base + 30), (46, "watch", base + 29, None, None), (60, "watch", base + 41, None, None)]
    schema = "seq long, kind string, at long, blk long, rev long"
    rows = spark.createDataFrame(events, schema).selectExpr("'w' AS watcher", "1L AS file_id", "*")
    rows.write.parquet(str(tmp_path / "in"))

    def said(parts: int) -> list:
        name = f"said{parts}"
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        query = link(source, parts=parts).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(200)
        return sorted(map(str, spark.table(name).collect()))

    at = Link()
    order = sorted(events, key=lambda e: (e[0], e[1] != "open", e[1] != "commit"))
    want = sorted(f"Row(watcher='w', file_id=1, seq={seq}, say={say!r}, blk={blk}, rev={rev}, error={error!r})" for e in order for seq, say, blk, rev, error in at.event(*e))
    assert said(1) == want and said(5) == want
    assert sum("'ok'" in x for x in want) == 4 and sum("'error'" in x for x in want) == 2
    with pytest.raises(ValueError):
        link(rows, pin_timeout=1, parts=2)


def test_the_watch_query_bounds_a_part(spark, monkeypatch):
    """No state of the query takes many more events than its bound, however long the log."""
    from lattica import registry
    from lattica.streaming import watch

    asked, made = [], watch.link
    monkeypatch.setattr(watch, "PER_PART", 50)
    monkeypatch.setattr(watch, "link", lambda events, **how: asked.append(how) or made(events, **how))
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/events.parquet").count()
    got = registry.QUERIES["watch_stream"](spark, d).collect()
    log = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id").collect()
    changed = {r.user_id for r in log if r.event_id > n // 3}
    want = {b: max((r.event_id for r in log if r.user_id == b and r.event_id <= n // 3), default=0) for b in changed}
    assert sorted(map(tuple, got)) == sorted(want.items()) and asked[0]["parts"] * 50 >= n
