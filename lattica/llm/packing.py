"""Best-fit packing of tokenised documents by patterns.

1. Every text is tokenised once, in Arrow batches; documents longer than a sequence are cut into
   full pieces and a rest. Only (doc_id, piece, start, length, crc32) go on.
2. The histogram of piece lengths has at most ``size`` rows and goes to the driver.
3. There, patterns of one to three lengths are fitted to the histogram by non-negative least squares
   (coordinate descent: price all patterns, take the steepest ones, then sweep over those taken) and
   rounded, and what is left is packed best-fit decreasing into what the patterns leave free and into
   new sequences, in runs of equal lengths, so its cost does not depend on the number of documents.
   Three documents don't fill a sequence where lengths are short, so a pattern leaves ``GAP`` ids free
   at most, and best-fit decreasing alone is the plan where it needs no more sequences.
4. The plan is a table of slot runs (length, first rank, count, sequence, offset). Pieces are ranked
   within their length in salted groups and joined to the runs by (length, block of ranks).

Defined cases: null text is empty and holds the one closing id. Repeated rows are packed as rows of
their own. An empty table gives an empty result. Very long texts give many pieces.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, staged, table

SIZE = 2048
END_ID = 0
#: Ids that a pattern may leave free.
GAP = 16
#: Words whose ids a worker keeps.
CACHE = 1_000_000
#: Words that are looked up together.
SLICE = 16_384
_END = np.array([END_ID], "<u4").tobytes()


#: Letters (the same after NFC, and of one lower case everywhere) and ASCII marks behind them, but no
#: apostrophe, after which letters may belong to the mark. Other words are encoded one by one.
_MARKS = "".join(map(chr, [*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
_SIMPLE = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[" + re.escape(_MARKS) + "]*").fullmatch


def words_of(text: str | None) -> list[str]:
    """Split where every tokenizer sees white space; other white space stays inside words."""
    return (text or "").replace("\n", " ").split(" ")


class WordTokens(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes. The tokenizer drops white space and
    never joins across it, so a text's ids are those of its blank-separated words in order. Words
    that are new are encoded together: a run of letters ends with a word-end id, which shows where
    the joined ids are to be cut.

    Words, the runs of letters in them and the marks behind these number at most ``most`` (three for
    each word of a slice at least): a slice of words that might not fit empties the table first."""

    def __init__(self, path: str, most: int = CACHE):
        from tokenizers import Tokenizer

        super().__init__()
        self.most = max(most, 3 * SLICE + 1)
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks: dict[str, bytes] = {"": b""}

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.encoded(word)
        return ids

    def learn(self, words: Iterable[str]) -> None:
        """Makes room for a slice of words, and encodes those that need no look of their own."""
        words = set(words)
        new = {w for w in words if w not in self}
        if len(self) + len(self.marks) + 3 * len(new) > self.most:
            self.clear()
            self.marks = {"": b""}
            new = words
        parts = [(w, w.rstrip(_MARKS)) for w in new if _SIMPLE(w)]
        cores = [core for core in {core.lower() for _, core in parts} if core not in self]
        if cores:
            ids = np.array(self.tokenizer.encode(" ".join(cores), add_special_tokens=False).ids, "<u4")
            cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(cuts) == len(cores):  # a vocabulary without word ends: encoded one by one when asked for
                raw, ends = ids.tobytes(), cuts.tolist()
                self.update(zip(cores, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        for w, core in parts:
            mark = w[len(core) :]
            if mark not in self.marks:
                self.marks[mark] = self.encoded(mark)
            self[w] = self[core.lower()] + self.marks[mark]

    def ids(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text and ``END_ID``. Whole texts are looked up together while their words
        make no more than a slice; longer texts are taken slice by slice."""
        waiting: list[list[str]] = []
        size = 0
        for text in texts:
            words = words_of(text)
            if waiting and size + len(words) > SLICE:
                yield from self._looked_up(waiting)
                waiting, size = [], 0
            waiting.append(words)
            size += len(words)
        yield from self._looked_up(waiting)

    def _looked_up(self, texts: list[list[str]]) -> Iterator[bytes]:
        if len(texts) > 1 or not texts:
            self.learn(chain.from_iterable(texts))
            for words in texts:
                yield b"".join(map(self.__getitem__, words)) + _END
            return
        parts = []
        for lo in range(0, len(texts[0]), SLICE):
            part = texts[0][lo : lo + SLICE]
            self.learn(part)
            parts.append(b"".join(map(self.__getitem__, part)))
        yield b"".join(parts) + _END


def tokens_of(path: str, most: int = CACHE) -> WordTokens:
    return kept(("words", path, most), lambda: WordTokens(path, most))


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, words: int = CACHE) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of each text's pieces. A worker keeps the ids of
    ``words`` words: fewer take less memory and more time."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(vocabulary, words)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                row, piece, start, length, crc, raw = [], [], [], [], [], []
                for i, ids in enumerate(tokens.ids(text.as_py() for text in part.column(1))):
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[at : at + 4 * size]
                        row.append(i), piece.append(k), start.append(at // 4), length.append(len(own) // 4), crc.append(zlib.crc32(own))
                        if with_ids:
                            raw.append(own)
                cols = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


# ---- the plan, from the histogram alone ----


def patterns_of(present: np.ndarray, size: int, gap: int = GAP) -> np.ndarray:
    """All a <= b <= c over lengths that occur, c the longest that still fits beside a and b, which
    leave ``gap`` ids free at most; 0 stands for no document."""
    have = np.zeros(size + 1, bool)
    have[present] = True
    have[0] = True
    longest = np.maximum.accumulate(np.where(have, np.arange(size + 1), 0))
    a, b = np.meshgrid(np.flatnonzero(have[: size // 3 + 1]), np.flatnonzero(have), indexing="ij")
    room = size - a - b
    c = longest[np.maximum(room, 0)]
    ok = (b >= a) & (room >= 0) & (c >= b) & (c > 0) & (room - c <= gap)
    return np.stack([a[ok], b[ok], c[ok]], 1)


def fit(hist: np.ndarray, size: int, rounds: int = 60, sweeps: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares of the histogram by pattern columns: (patterns, counts).
    Misses weigh as the square of the length: what is left over should be short and fill gaps."""
    pats = patterns_of(np.flatnonzero(hist), size)
    if not len(pats):
        return pats, np.zeros(0)
    weight = np.maximum(0.05, (np.arange(size + 1) / size) ** 2)
    weight[0] = 0
    r = hist.astype(float) * weight
    # a column has weight * multiplicity at each of its lengths
    w2 = weight[pats]
    dup01, dup12 = (pats[:, 0] == pats[:, 1]) & (pats[:, 0] > 0), (pats[:, 1] == pats[:, 2])
    norm = (w2**2).sum(1) + 2 * dup01 * w2[:, 0] * w2[:, 1] + 2 * dup12 * w2[:, 1] * w2[:, 2] + 2 * (dup01 & dup12) * w2[:, 0] * w2[:, 2]
    norm = np.maximum(norm, 1e-9)
    x = np.zeros(len(pats))
    target = hist.astype(float) * weight

    def residual() -> np.ndarray:
        got = np.bincount(pats.ravel(), weights=np.repeat(x, 3), minlength=size + 1)
        return target - got * weight

    for _ in range(rounds):
        gain = (r[pats] * w2).sum(1)
        score = gain / np.sqrt(norm)
        order = np.argsort(-score)[: 4 * size]
        used = np.zeros(size + 1, bool)
        took = False
        for j in order:
            if gain[j] <= 0.5 * norm[j]:
                break
            p = pats[j]
            if used[p[p > 0]].any():
                continue
            used[p[p > 0]] = True
            x[j] += gain[j] / norm[j]
            took = True
        r = residual()
        if not took:
            break
    support = np.flatnonzero(x)
    for _ in range(sweeps):
        moved = 0.0
        for j in support:
            p = pats[j]
            g = float((r[p] * weight[p]).sum())
            step = max(-x[j], g / norm[j])
            if step:
                x[j] += step
                np.subtract.at(r, p, step * weight[p])
                moved = max(moved, abs(step))
        if moved < 0.05:
            break
    keep = x > 0
    return pats[keep], x[keep]


def plan(hist: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence in order, how many such sequences)]: covers the histogram exactly."""
    h = np.zeros(size + 1, np.int64)
    for n, count in hist.items():
        h[n] += count
    plans = best_fit({n: int(h[n]) for n in range(1, size + 1) if h[n]}, size), by_patterns(h, size)
    return min(plans, key=lambda p: sum(times for _, times in p))


def by_patterns(h: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """A plan by patterns, topped up with what they left over."""
    out: list[tuple[tuple[int, ...], int]] = []
    pats, counts = fit(h, size)
    left = h.copy()
    for p, c in sorted(zip(map(tuple, pats.tolist()), counts.tolist(), strict=True), key=lambda t: -t[1]):
        lengths = tuple(sorted((n for n in p if n), reverse=True))
        times = min([round(c), *(int(left[n]) // k for n, k in Counter(lengths).items())])
        if times > 0:
            out.append((lengths, times))
            for n in lengths:
                left[n] -= times
    return best_fit({n: int(left[n]) for n in range(1, size + 1) if left[n]}, size, out)


def best_fit(hist: dict[int, int], size: int, begun: Iterable[tuple[tuple[int, ...], int]] = ()) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing, a run of equal lengths at a time into groups of equal sequences; those
    ``begun`` take part with their free space."""
    groups: dict[int, Counter] = {}  # free -> {lengths: count}
    free: list[int] = []  # the keys of groups, ascending
    import bisect

    def put(lengths: tuple[int, ...], count: int) -> None:
        f = size - sum(lengths)
        if f not in groups:
            groups[f] = Counter()
            bisect.insort(free, f)
        groups[f][lengths] += count

    for lengths, count in begun:
        put(lengths, count)
    for n in sorted(hist, reverse=True):
        todo = hist[n]
        while todo:
            i = bisect.bisect_left(free, n)
            if i == len(free):
                k = min(size // n, todo)
                times = todo // k
                put((n,) * k, times)
                todo -= k * times
                continue
            f = free[i]
            lengths, count = next(iter(groups[f].items()))
            k = min(f // n, todo)
            times = min(count, todo // k)
            groups[f][lengths] -= times
            if not groups[f][lengths]:
                del groups[f][lengths]
            if not groups[f]:
                del groups[f]
                free.pop(i)
            put(lengths + (n,) * k, times)
            todo -= k * times
    return [(lengths, count) for f in free for lengths, count in groups[f].items()]


def slots(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): documents of a length with these ranks
    take this place in these sequences."""
    rank: Counter = Counter()
    out, sequence = [], 0
    for lengths, times in planned:
        at = 0
        for n in lengths:
            out.append((n, rank[n], times, sequence, at))
            rank[n] += times
            at += n
        sequence += times
    return out


# ---- from the plan to places ----


def ranked(rows: DataFrame, salts: int) -> DataFrame:
    """``rank`` from 0 within each length. A length is dealt over ``salts`` groups by a hash, ranked
    there, and shifted by the sizes of the groups before; no length meets in one task."""
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")
    rows = rows.withColumn("_salt", key)
    sizes = rows.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))  # at most lengths x salts
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32"))
    return rows.withColumn("_own", own - 1).join(sizes, ["length", "_salt"]).withColumn("rank", F.col("_before") + F.col("_own")).drop("_salt", "_own", "_before")


def place(rows: DataFrame, size: int = SIZE, per_group: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32). ``rows`` is
    read twice, so it should be staged."""
    spark = rows.sparkSession
    hist = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    runs = slots(plan(hist, size))
    salts = max(32, math.ceil(max(hist.values(), default=0) / per_group))
    numbered = ranked(rows, salts)
    # runs of a length as one sorted array each: a binary-search-free range lookup by the last start not above the rank
    schema = "length long, runs array<struct<first:long,sequence:long,offset:long>>"
    by: dict[int, list] = {}
    for n, first, _, sequence, at in runs:
        by.setdefault(n, []).append((first, sequence, at))
    lookup = spark.createDataFrame(sorted(by.items()), schema)
    # at most ``size`` arrays whose entries are bounded by the plan: support of the fit and groups of the rest
    joined = numbered.join(F.broadcast(lookup), "length")
    run = F.expr("element_at(filter(runs, r -> r.first <= rank), -1)")
    return joined.withColumn("_run", run).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_run.sequence") + F.col("rank") - F.col("_run.first")).alias("sequence_id"), F.col("_run.offset").alias("offset"))


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, words: int = CACHE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece."""
    return place(staged(pieces(docs, vocabulary, size, words=words), "pieces"), size)


def sequences(docs: DataFrame, placed: DataFrame, vocabulary: str, size: int = SIZE) -> DataFrame:
    """(sequence_id, tokens array<int>): the packed sequences themselves, for documents with unique
    ids. A sequence holds at most ``size`` ids, so its group is bounded."""
    ids = pieces(docs, vocabulary, size, with_ids=True).select("doc_id", "piece", "ids")
    whole = ids.join(placed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.int32()))], ["sequence_id", "tokens"])

    return whole.mapInArrow(run, "sequence_id long, tokens array<int>")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())
