"""N-gram Jaccard self-join by filters under several global token orders, and the groups it makes.

Sets of five-word shingles (64-bit hashes); two link when 100 * |x & y| >= 80 * |x | y|.

1. One pass over the texts gives for each row the set's size and digest, its first token under
   ``len(ORDERS)`` random orders, and counts of hash cells (a sketch of fixed size) that make the
   rarity of a token. Equal sets form one class (least doc_id).
2. Under each random order, classes of an equal first token are compared with one of them, that
   whose tokens are the commonest: near copies share the tokens of what they were copied from.
   What links is merged: a group of near copies, however large, collapses in work linear in it.
3. Partners must share a token in their prefixes (|x| - ceil(0.8 |x|) + 1 tokens) under every order
   of all tokens. Every class sends its prefix under the first rarity order. Tokens whose classes
   all lie in one component already need no more work; of tokens that the very same classes hold one
   stands for all, so a pair is made once and not once a shared token. Pairs across components
   are formed with length and positional bounds, never two of a token's largest component.
   The join itself drops pairs by parities (a bit for each hash end: is the number of its tokens
   odd?): every bit in which two differ is a token that only one side has. A bitmap fills up as sets
   grow, parities only as sets differ, so families of near misses don't leave the join as pairs.
4. A pair's bitmaps (a bit for each hash end, four or more bits a token) bound its overlap from above:
   every bit that one side lacks is a token that it lacks. Pairs that are left are held against the
   prefixes under further orders (rarest first too, but with ties in another sequence): only those
   that share a prefix token under each go on. Only then sets move and are intersected.
5. Components of all links. Every link between different components is found, so none is lost.

Rows that share a doc_id are one node of the graph. Texts move only to be compared.

Defined cases: null text and text without words have an empty set, link with nothing and are their
own component. A null doc_id links with nothing and has a null component. An empty table gives an
empty result. doc_id is of an integer type; any other is refused.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import fresh, lean, small, staged, sweep, table, unstage
from .components import components

SHINGLE = 5
PERCENT = 80
#: Odd multipliers: h * m modulo 2**64 orders the tokens anew.
#: The first make stars; the others also break ties of rarity.
ORDERS = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
#: The rarity sketch has 2**CELL_BITS cells in chunks of 2**CHUNK_BITS.
CELL_BITS, CHUNK_BITS = 24, 16
#: Words of the parities that the pair join itself tests.
WORDS = 16
#: Orders, after the first, under which candidates must meet.
FURTHER = (1, 2)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of each k consecutive words (of all words, if fewer). ``lower`` and
    ``split`` of bytes touch A-Z and the six ASCII blanks only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[j : j + n]
    return np.unique(out ^ (out >> np.uint64(32)))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def bitmap(s: np.ndarray) -> bytes:
    """Bits of the hashes' low ends: a power of two of them, four a token at least."""
    n = 1 << max(9, int(4 * len(s) - 1).bit_length())
    bits = np.zeros(n, bool)
    bits[(s & np.uint64(n - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def signature(s: np.ndarray) -> list[int]:
    """``WORDS`` words of parities: whether an odd number of tokens has each low end. Bits in which
    two sets differ are at most the tokens that only one of them has."""
    odd = np.bincount((s & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).tolist()


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def may_link(nx: int, bx: bytes, ny: int, by: bytes, percent: int = PERCENT) -> bool:
    """False only if the sets can't link: the overlap is at most |x| less the bits that y lacks."""
    x, y = np.frombuffer(bx, np.uint8), np.frombuffer(by, np.uint8)
    while len(x) > len(y):  # the longer one folded: its upper half has the same low ends
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    most = min(nx - int(_ONES[x & ~y].sum()), ny - int(_ONES[y & ~x].sum()))
    return (100 + percent) * most >= percent * (nx + ny)


def signed(x: np.ndarray | int) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


class Cells:
    """Counts of 2**CELL_BITS cells: a byte each, and beside them what was more than a byte holds."""

    def __init__(self) -> None:
        self.low = np.zeros(1 << CELL_BITS, np.uint8)
        self.over: dict[int, int] = {}

    def add(self, tokens: np.ndarray) -> None:
        at, n = np.unique((tokens >> np.uint64(64 - CELL_BITS)).astype(np.int32), return_counts=True)
        n += self.low[at]
        high = n > 255
        self.low[at] = np.where(high, 0, n)
        for c, k in zip(at[high].tolist(), n[high].tolist(), strict=True):
            self.over[c] = self.over.get(c, 0) + k

    def chunks(self) -> Iterator[tuple[int, np.ndarray]]:
        """(number, counts) of each chunk that isn't empty."""
        at = np.array(sorted(self.over), np.int64)
        n = np.array([self.over[c] for c in at.tolist()], np.uint32)
        for c in range(1 << (CELL_BITS - CHUNK_BITS)):
            own = self.low[c << CHUNK_BITS : (c + 1) << CHUNK_BITS].astype(np.uint32)
            lo, hi = np.searchsorted(at, [c << CHUNK_BITS, (c + 1) << CHUNK_BITS])
            own[at[lo:hi] - (c << CHUNK_BITS)] += n[lo:hi]
            if own.any():
                yield c, own


def survey(docs: DataFrame) -> DataFrame:
    """Rows of two kinds. kind 0: a document's id, set size, digest, first tokens. kind 1: a task's
    counts of one chunk of cells (n: the chunk; cells: the counts, compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells()
        waiting, size = [], 0

        def count() -> None:
            nonlocal waiting, size
            if waiting:
                cells.add(np.concatenate(waiting))
            waiting, size = [], 0

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                n, d1, d2, firsts = [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingles(text)
                    d = xxhash.xxh3_128_digest(s.tobytes())
                    n.append(len(s)), d1.append(int.from_bytes(d[:8], "little", signed=True)), d2.append(int.from_bytes(d[8:], "little", signed=True))
                    firsts.append(signed([(s * m).min() for m in ORDERS]).tolist() if len(s) else [])
                    waiting.append(s)
                    size += len(s)
                    if size > 500_000:
                        count()
                k = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), part.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.nulls(k, pa.binary())], names)
        count()
        for c, own in cells.chunks():
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.nulls(1, pa.int64()), pa.array([c], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names)

    names = ["kind", "doc_id", "n", "d1", "d2", "firsts", "cells"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(lean, run, "kind int, doc_id long, n long, d1 long, d2 long, firsts array<long>, cells binary")


def rarity(counts: DataFrame) -> np.ndarray:
    """Level of each cell (2**CELL_BITS bytes, whatever the corpus): 0 up to some times the mean,
    then one for each doubling. ``counts``: (n: chunk, cells), summed in two rounds of tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(raw), np.uint32)
                total[c] = total[c] + own if c in total else own.copy()
        for c, own in sorted(total.items()):
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["n", "cells"])

    parts = 1 << (CELL_BITS - CHUNK_BITS)
    summed = counts.select("n", "cells").repartition(min(parts, 64), "n").transform(lean, add, "n long, cells binary")
    out = np.zeros(1 << CELL_BITS, np.uint32)
    for r in summed.toLocalIterator():  # one row a chunk
        out[r["n"] << CHUNK_BITS : (r["n"] + 1) << CHUNK_BITS] = np.frombuffer(zlib.decompress(r["cells"]), np.uint32)
    common = 3 * out.mean() + 8
    return np.where(out <= common, 0, 1 + np.log2(np.maximum(out, 1) / common)).astype(np.uint8)


def ranks(s: np.ndarray, levels: np.ndarray, order: int = 0) -> np.ndarray:
    """The tokens of a set in a rarity order, each as level and hash in one number. Orders differ in
    how they break ties, but for the first by an odd multiplier of ``ORDERS``."""
    level = levels[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64)
    tie = s * ORDERS[order] if order else s
    return np.sort((level << np.uint64(58)) | (tie >> np.uint64(6)))


def commonness(docs: DataFrame, levels_shared) -> DataFrame:
    """(cid, common): the mean level of a document's tokens, in thousandths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(levels_shared.value, np.uint8)
        for batch in batches:
            mean = []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                mean.append(int(1000 * levels[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)].mean()) if len(s) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mean, pa.int64())], ["cid", "common"])

    return docs.select("doc_id", "text").transform(lean, run, "cid long, common long")


def postings(docs: DataFrame, levels_shared) -> DataFrame:
    """(token, doc_id, comp, n, pos, sig) of each prefix token, and a row a document that has, in
    place of a token, its parities. ``docs``: (doc_id, comp, text)."""
    names = ["token", "doc_id", "comp", "n", "pos", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(levels_shared.value, np.uint8)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                tokens, sizes, sigs = [], [], []
                for text in part.column(2).to_pylist():
                    s = shingles(text)
                    sigs.append(signature(s))
                    tokens.append(ranks(s, levels)[: prefix_size(len(s))] if len(s) else s)
                    sizes.append(len(s))
                lens = np.array([len(t) for t in tokens])
                row = np.repeat(np.arange(len(tokens)), lens)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tokens))), part.column(0).take(at), part.column(1).take(at), pa.array(np.array(sizes, np.int32)[row]), pa.array(pos.astype(np.int32)), pa.nulls(len(row), pa.list_(pa.int64()))], names)
                k = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), part.column(0), part.column(1), pa.array(sizes, pa.int32()), pa.nulls(k, pa.int32()), pa.array(sigs, pa.list_(pa.int64()))], names)

    return docs.select("doc_id", "comp", "text").transform(lean, run, "token long, doc_id long, comp long, n int, pos int, sig array<long>")


def links(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """The exact intersection, after the length bound."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def sets_of(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """``keys`` and the sorted set as bytes, for rows of ``keys`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([shingles(t).tobytes() for t in part.column(len(keys)).to_pylist()], pa.binary())], [*keys, out])

    return rows.select(*keys, "text").transform(lean, run, ", ".join(f"{k} long" for k in keys) + f", {out} binary")


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b; staged) that link. ``docs``: (doc_id, text). The sets of b go to
    those of a; a node with very many pairs is split by the skew join."""
    left = sets_of(docs.join(small(pairs), docs["doc_id"] == pairs["b"]), ["a", "b"], "set_b")
    heads = pairs.select(F.col("a").alias("_a")).distinct()
    right = sets_of(docs.join(small(staged(heads, "heads")), F.col("doc_id") == F.col("_a")).select(F.col("_a"), "text"), ["_a"], "set_a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True) for x, y in [(x.as_py(), y.as_py())]]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return left.join(right, F.col("a") == F.col("_a")).select("a", "b", "set_a", "set_b").transform(lean, run, "a long, b long")


def sides(docs: DataFrame, levels_shared) -> DataFrame:
    """(node, n, bits, prefixes): what pairs are held against before sets move; a prefix for each
    further order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(levels_shared.value, np.uint8)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                prefixes = [[signed(ranks(s, levels, o)[: prefix_size(len(s))]) if len(s) else [] for o in FURTHER] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([bitmap(s) if len(s) else b"" for s in sets], pa.binary()), *(pa.array([p[i] for p in prefixes], pa.list_(pa.int64())) for i in range(len(FURTHER)))],
                    ["node", "n", "bits", *(f"p{o}" for o in FURTHER)],
                )

    return docs.select("doc_id", "text").transform(lean, run, "node long, n int, bits binary" + "".join(f", p{o} array<long>" for o in FURTHER))


def screened(docs: DataFrame, pairs: DataFrame, levels_shared) -> DataFrame:
    """Those of ``pairs`` (a, b; staged) that their bitmaps don't rule out and whose prefixes meet
    under each further order, staged. Only the sides of pairs are read for this."""
    ends = lambda p: staged(p.select(F.explode(F.array("a", "b")).alias("_node")).distinct(), "nodes")
    nodes = ends(pairs)
    seen = staged(sides(docs.join(small(nodes), F.col("doc_id") == F.col("_node")), levels_shared), "sides")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                ok = [may_link(*row) for row in zip(*(part.column(i).to_pylist() for i in range(2, 6)), strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def both(p: DataFrame, side: DataFrame) -> DataFrame:
        for x in ("a", "b"):
            p = p.join(side.select(F.col("node").alias(x), *(F.col(c).alias(c + x) for c in side.columns if c != "node")), x)
        return p

    held = both(pairs, seen.select("node", "n", "bits"))
    held = staged(held.select("a", "b", "na", "bitsa", "nb", "bitsb").transform(lean, run, "a long, b long").distinct(), "held")
    left = ends(held)
    met = both(held, seen.join(small(left), F.col("node") == F.col("_node")).select("node", *(f"p{o}" for o in FURTHER)))
    for o in FURTHER:
        met = met.where(F.arrays_overlap(f"p{o}a", f"p{o}b"))
    out = staged(met.select("a", "b").distinct(), "screened")
    unstage(nodes, seen, held, left)
    sweep(docs.sparkSession)
    return out


def shared_postings(posted: DataFrame) -> DataFrame:
    """The postings of tokens that several components hold, staged; of tokens that the very same
    classes hold, of the least only. Holders are told apart by count, xor and two sums of hashes."""
    mixed = staged(posted.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token"), "mixed")
    met = staged(posted.join(small(mixed), "token"), "met")
    h = F.xxhash64("doc_id")
    held = met.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("x"), F.sum(F.shiftrightunsigned(h, 32)).alias("s1"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s2"))
    alone = staged(held.groupBy("c", "x", "s1", "s2").agg(F.min("token").alias("token")).select("token"), "alone")
    out = staged(met.join(small(alone), "token"), "marked")
    unstage(mixed, met, alone)
    sweep(posted.sparkSession)
    return out


def candidates(marked: DataFrame, sigs: DataFrame) -> DataFrame:
    """(a, b) pairs of different components that share a prefix token and pass the length,
    positional and parity bounds, staged. ``marked``: as of ``shared_postings``; ``sigs``:
    (doc_id, sig)."""
    size = marked.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    largest = staged(size.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("big")), "largest")
    members = staged(marked.select(F.col("doc_id").alias("_member")).distinct(), "members")
    words = staged(sigs.join(small(members), F.col("doc_id") == F.col("_member")).select(F.col("doc_id").alias("_member"), "sig"), "words")
    # staged, so that the skew join can split the postings of a hot token
    own = staged(marked.join(small(largest), "token").join(small(words, 50_000), F.col("doc_id") == F.col("_member")).drop("_member"), "own")
    side = lambda x: [F.col("doc_id").alias(x), F.col("comp").alias("c" + x), F.col("n").alias("n" + x), F.col("pos").alias("p" + x), F.col("sig").alias("s" + x)]
    a = own.where("comp <> big").select("token", *side("a"))
    b = own.select("token", *side("b"), (F.col("comp") == F.col("big")).alias("inbig"))
    need = f"ceil({PERCENT} * (na + nb) / {100 + PERCENT}D)"
    differ = "aggregate(zip_with(sa, sb, (x, y) -> bit_count(x ^ y)), 0, (sum, x) -> sum + x)"
    bound = (
        f"ca <> cb and (inbig or a < b) and 100 * least(na, nb) >= {PERCENT} * greatest(na, nb)"
        f" and 1 + least(na - pa - 1, nb - pb - 1) >= {need} - least(pa, pb)"
        f" and na + nb - {differ} >= 2 * {need}"
    )
    pairs = staged(a.join(b, "token").where(bound).select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).distinct(), "pairs")
    unstage(largest, members, words, own)
    sweep(marked.sparkSession)
    return pairs


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType
    if not isinstance(id_type, IntegralType):
        raise TypeError(f"doc_id must be of an integer type, not {id_type.simpleString()}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = staged(survey(docs), "survey")
    slim = both.where("kind = 0").select("doc_id", "n", "d1", "d2", "firsts")
    known = slim.where("doc_id is not null and n > 0")
    classes = staged(known.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("cid"), F.first("firsts").alias("firsts")), "classes")

    # 2: stars around the commonest class of an equal first token
    levels = spark.sparkContext.broadcast(rarity(both.where("kind = 1")).tobytes())
    keys = classes.select("cid", "n", F.posexplode("firsts").alias("o", "key"))
    shared = keys.groupBy("o", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    shared_keys = staged(keys.join(small(staged(shared, "shared")), ["o", "key"]), "keys")
    members = staged(shared_keys.select(F.col("cid").alias("_cid")).distinct(), "members")
    common = staged(commonness(docs.join(small(members), F.col("doc_id") == F.col("_cid")), levels), "common")
    common = common.groupBy("cid").agg(F.max("common").alias("common"))  # rows that share an id
    # staged with its hubs, so that neither the aggregate nor the join gathers a hot key in one task
    keys = staged(shared_keys.join(small(common), "cid"), "ranked")
    hubs = staged(keys.groupBy("o", "key").agg(F.min(F.struct((-F.col("common")).alias("rare"), "cid", "n")).alias("hub")), "hubs")
    star = keys.join(small(hubs), ["o", "key"]).where(f"cid <> hub.cid and 100 * least(n, hub.n) >= {PERCENT} * greatest(n, hub.n)")
    star = staged(star.select(F.col("hub.cid").alias("a"), F.col("cid").alias("b")).distinct(), "stars")
    near = staged(components(verified(docs, screened(docs, star, levels))), "near")
    unstage(shared_keys, members, keys, hubs, star)

    # 3, 4: pairs across those components
    labelled = classes.select(F.col("cid").alias("doc_id")).distinct().join(small(near), F.col("doc_id") == F.col("id"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("comp"))
    labelled = staged(labelled, "labelled")
    posted = staged(postings(docs.join(small(labelled), "doc_id"), levels), "postings")
    marked = shared_postings(posted.where("token is not null").drop("sig"))
    pairs = candidates(marked, posted.where("token is null").select("doc_id", "sig"))
    unstage(posted, marked)
    found = verified(docs, screened(docs, pairs, levels))

    # 5: links between components
    comp = lambda side: labelled.select(F.col("doc_id").alias(side), F.col("comp").alias(f"c{side}"))
    across = found.join(small(comp("a")), "a").join(small(comp("b")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    merged = components(across)
    final = labelled.join(merged, F.col("comp") == F.col("id"), "left").select(F.col("doc_id").alias("cid"), F.coalesce("component", "comp").alias("component_id"))

    # a class's documents, and all rows of one id, are in one component
    member = slim.where("doc_id is not null").join(classes.select("d1", "d2", "n", "cid"), ["d1", "d2", "n"], "left").join(final, "cid", "left")
    member = member.select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("n").alias("n_shingles"))
    rest = slim.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("component_id"), F.col("n").alias("n_shingles"))
    out = one_node_an_id(staged(member, "member")).unionByName(rest)
    return out.select(F.col("doc_id").cast(id_type), "n_shingles", F.col("component_id").cast(id_type))


def one_node_an_id(member: DataFrame) -> DataFrame:
    """Joins the components that rows of one repeated id are in."""
    several = member.groupBy("doc_id").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo <> hi").select(F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("doc_id").alias("c"))
    if several.isEmpty():
        return member
    # every row's component is tied to its id, so also those between the least and the greatest
    ties = member.join(several.select(F.col("c").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    merged = components(ties)
    return member.join(merged, F.col("component_id") == F.col("id"), "left").select("doc_id", F.coalesce("component", "component_id").alias("component_id"), "n_shingles")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, with one document of each group: that of the least
    id. Rows without words or id stay; of rows that repeat an id one stays."""
    found = staged(groups(docs), "groups")
    gone, twice = fresh(docs, "_gone"), fresh(docs, "_twice")
    out = staged(found.where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct(), "gone")
    kept = docs.join(small(out), docs["doc_id"] == out[gone], "left_anti")
    several = staged(found.where("n_shingles > 0 and doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(twice)), "twice")
    if several.isEmpty():
        return kept
    repeated = kept.join(several, kept["doc_id"] == several[twice], "left_semi").dropDuplicates(["doc_id"])
    return kept.join(several, kept["doc_id"] == several[twice], "left_anti").unionByName(repeated)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + 4), ' ')) AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 3))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
bi AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(x, y) AS (SELECT x, y FROM bi UNION SELECT r.x, b.y FROM reach r JOIN bi b ON r.y = b.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low.y, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.x = w.doc_id
"""
