"""Benchmark decontamination by a prefix-filtered set join.

Both sides are sets of five-word shingles. Every window of an item (eight consecutive words; all of
a shorter item) must be contained whole, so its necessary prefix is a single shingle: the rarest by
its count over all documents. Documents are probed with these alone; a probe gives the window's
place, which must lie inside the document (length and position), and the window's words are then
compared exactly there.

The benchmark side is an index of at most ``SLICE`` windows at a time (a proven bound for the
broadcast); a larger benchmark takes one pass over the same rows for each slice, and the rows carry
what earlier passes found. Documents are never shuffled.

Defined cases: null text has no words and no hits; an item without words is ignored; a null item_id
is ignored too. Repeated documents keep one row each; repeated items count by distinct item_id. An
empty table of documents gives an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table

SHINGLE = 5
WINDOW = 8
#: Windows of the index that one pass broadcasts: some 100 bytes each.
SLICE = 500_000
#: Items from which a document counts as contaminated.
ITEMS = 2

_WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: A-Z lower-cased; all other ASCII but digits and letters to a blank; other bytes stay.
_FOLD = bytes(b if b >= 128 or b in _WORD_BYTES else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
CACHE = 400_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Hashes(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; of all of them if there are fewer."""
    k = min(k, len(h))
    if not k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ (out >> np.uint64(29))) * _MIX + h[j : j + n]
        return out ^ (out >> np.uint64(32))


class Filter:
    """Membership in a sorted array behind a bitmap of hash ends."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = np.uint64((1 << max(16, int(len(keys)).bit_length() + 6)) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[(keys & self.mask).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, places in keys) of the members."""
        at = np.flatnonzero(self.bits[(h & self.mask).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[k] == h[at]
        return at[ok], k[ok]


def item_windows(items: list[tuple[object, str]]) -> dict[tuple[bytes, ...], set[str]]:
    out: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
            out.setdefault(tuple(w[i : i + WINDOW]), set()).add(str(item))
    return out


def count_shingles(docs: DataFrame, keys: np.ndarray) -> np.ndarray:
    """How often each shingle of the index occurs, over all documents: at most a row a task and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, members = Hashes(), Filter(keys)
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            met = [members.find(runs(hashes.of(words_of(text.as_py())), SHINGLE))[1] for text in batch.column(0) if text.is_valid]
            at, n = np.unique(np.concatenate([np.zeros(0, np.int64), *met]), return_counts=True)  # once a batch, however many keys
            total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["k", "n"])

    out = np.zeros(len(keys), np.int64)
    got = docs.select("text").transform(lean, run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # at most a row a key
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


class Index:
    """Windows by their rarest shingle. Windows shorter than a shingle are their own prefix."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]], counts: dict[int, int]):
        hashes = Hashes()
        self.by_length: dict[int, tuple[Filter, list[list[tuple[int, tuple[bytes, ...], tuple[str, ...]]]]]] = {}
        rows: dict[int, dict[int, list]] = {}
        for window, items in sorted(windows.items()):
            h = runs(hashes.of(list(window)), SHINGLE)
            rarest = min(range(len(h)), key=lambda j: (counts.get(int(h[j]), 0), int(h[j]))) if len(h) > 1 else 0
            k = min(SHINGLE, len(window))
            rows.setdefault(k, {}).setdefault(int(h[rarest]), []).append((rarest, window, tuple(sorted(items))))
        for k, by in rows.items():
            keys = np.array(sorted(by), np.uint64)
            self.by_length[k] = (Filter(keys), [by[int(x)] for x in keys])

    def search(self, words: list[bytes], hashes: Hashes, hit: np.ndarray, items: set[str]) -> None:
        h = hashes.of(words)
        for k, (members, rows) in self.by_length.items():
            if len(words) < k:
                continue
            for at, row in zip(*members.find(runs(h, k)), strict=True):
                for offset, window, ids in rows[row]:
                    lo = int(at) - offset
                    hi = lo + len(window)
                    if lo >= 0 and hi <= len(words) and tuple(words[lo:hi]) == window:
                        hit[lo:hi] = True
                        items.update(ids)


def slices(benchmark: DataFrame, limit: int) -> Iterator[dict[tuple[bytes, ...], set[str]]]:
    """The windows of the benchmark in parts of about ``limit``; the driver holds one part at a time."""
    rows, size = [], 0
    for r in benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        size += max(1, len(words_of(r["text"])) - WINDOW + 1)
        if size >= limit:
            yield item_windows(rows)
            rows, size = [], 0
    if rows:
        yield item_windows(rows)


def build(docs: DataFrame, windows: dict[tuple[bytes, ...], set[str]]) -> Index:
    hashes = Hashes()
    keys = {int(x) for w in windows if len(w) >= SHINGLE for x in runs(hashes.of(list(w)), SHINGLE)}
    keys = np.array(sorted(keys), np.uint64)
    counts = count_shingles(docs, keys) if len(keys) else np.zeros(0, np.int64)
    return Index(windows, dict(zip(keys.tolist(), counts.tolist(), strict=True)))


def indexes(docs: DataFrame, benchmark: DataFrame, limit: int = SLICE) -> Iterator[Index]:
    return (build(docs, windows) for windows in slices(benchmark, limit))


def found(docs: DataFrame, benchmark: DataFrame, limit: int = SLICE) -> DataFrame:
    """(doc_id, text, _bits, _items) after a pass for each slice: a bitmap of hit words, item ids."""
    sc = docs.sparkSession.sparkContext
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text", F.lit(None).cast("binary").alias("_bits"), F.array().cast("array<string>").alias("_items"))
    for index in indexes(docs, benchmark, limit):
        shared = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hashes = Hashes()
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    bits, items = [], []
                    for text, old, own in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                        words = words_of(text)
                        hit = np.unpackbits(np.frombuffer(old, np.uint8))[: len(words)].astype(bool) if old else np.zeros(len(words), bool)
                        ids = set(own)
                        shared.value.search(words, hashes, hit, ids)
                        bits.append(np.packbits(hit).tobytes() if hit.any() else None), items.append(sorted(ids))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "_bits", "_items"])

        out = out.transform(lean, run, f"doc_id {id_type}, text string, _bits binary, _items array<string>")
    return out


def report(docs: DataFrame, benchmark: DataFrame, limit: int = SLICE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, bits, items = (batch.column(i).to_pylist() for i in (1, 2, 3))
            n = [len(words_of(t)) for t in texts]
            hit = [int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) if b else 0 for b in bits]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([len(x) >= ITEMS for x in items], pa.bool_())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return found(docs, benchmark, limit).transform(lean, run, f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def keep_clean(docs: DataFrame, benchmark: DataFrame, limit: int = SLICE) -> DataFrame:
    """The rows of ``docs``, all their columns, that no benchmark item leaks into: fewer than
    ``ITEMS`` items of which a window occurs. One slice a pass; a row is judged by the item ids of
    all passes, carried beside it."""
    sc = docs.sparkSession.sparkContext
    carried = "_leaks_found"
    while carried in docs.columns:
        carried += "_"
    out = docs.withColumn(carried, F.array().cast("array<string>"))
    schema = out.schema
    for index in indexes(docs, benchmark, limit):
        shared = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hashes = Hashes()
            for batch in batches:
                at, last = batch.schema.get_field_index("text"), batch.num_columns - 1
                items = []
                for text, own in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True):
                    words, ids = words_of(text), set(own)
                    shared.value.search(words, hashes, np.zeros(len(words), bool), ids)
                    items.append(sorted(ids))
                yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(items, pa.list_(pa.string()))], names=batch.schema.names)

        out = out.transform(lean, run, schema)
    return out.where(F.size(carried) < ITEMS).drop(carried)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH folded AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM folded),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 7), ' ') AS s, least(8, len(w)) AS k
        FROM iw, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 6))) AS i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
        FROM dw, ks, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) WHERE len(w) >= k),
m AS (SELECT doc_id, item_id, pos.k, i FROM pos JOIN win ON pos.s = win.s AND pos.k = win.k),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, k, i FROM m), LATERAL (SELECT unnest(range(i, i + k)) AS p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
