"""Sharding by extendible hashing. DataFrame functions only.

The directory is indexed by leading bits of a 64-bit hash of the id. A bucket of depth d holds the
rows that agree in d bits; one that is over the byte limit, and no other, splits on its next bit,
until all fit. Instead of one pass a split, a pass sums bytes by ``STEP`` further bits at once and
rolls the sums up: a leaf is the shallowest prefix that fits, below ancestors that do not. Only rows
of prefixes that are still too large go into the next pass. Rows whose hashes agree in all 64 bits
(repeated ids) get ``STEP`` bits of a second hash at a time, over the row's content and its place in
the staged table, so a bucket of repeated rows splits too.

A row larger than the limit makes a shard of its own, marked ``oversized``.

Defined cases: null text has 0 bytes; null ids share one hash and split by the second. An empty
table gives an empty result. Repeated rows keep one row each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, staged, table

#: Bytes of text a shard may hold.
LIMIT = 8 << 20
STEP = 12
#: Bits of the directory's index: the id's hash, then the second hash.
BITS = 128


def prefix(depth: int) -> Column:
    """The first ``depth`` bits of the address as text; addresses are strings of 0 and 1."""
    return F.substring("address", 1, depth)


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(address prefix, depth, shard_bytes) of the leaves. ``rows``: (address, n_bytes), staged."""
    leaves = None
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    known, depth = rows, 0
    step = min(24, max(STEP, math.ceil(math.log2(max(1, total / limit))) + 4))
    while depth < BITS:
        deep = min(depth + step, BITS)
        fine = staged(known.groupBy(prefix(deep).alias("p")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")), "directory")
        # sums of every prefix between the two depths, from the fine ones
        sums = fine.select(F.explode(F.transform(F.sequence(F.lit(depth), F.lit(deep)), lambda d: F.struct(d.alias("d"), F.substring(F.col("p"), F.lit(1), d).alias("q")))).alias("x"), "b", "n")
        sums = sums.groupBy("x.d", "x.q").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        fits = (F.col("b") <= limit) | (F.col("n") == 1)
        # a prefix is a leaf if it fits and its parent does not
        parents = sums.where(~fits).select((F.col("d") + 1).alias("d"), F.col("q").alias("parent"))
        level = sums.where(fits)
        up = level.withColumn("parent", F.expr("substring(q, 1, d - 1)"))
        found = up.where(F.col("d") > depth).join(parents, ["d", "parent"]).select("q", F.col("d").alias("depth"), F.col("b").alias("shard_bytes"))
        if depth == 0:
            found = found.unionByName(level.where("d = 0").select("q", F.col("d").alias("depth"), F.col("b").alias("shard_bytes")))
        leaves = found if leaves is None else leaves.unionByName(found)
        over = staged(sums.where(~fits & (F.col("d") == deep)).select(F.col("q").alias("_over")), "over")
        if over.isEmpty():
            break
        known = rows.join(small(over), prefix(deep) == F.col("_over"), "left_semi")
        depth, step = deep, STEP
    else:  # addresses agree in all bits: 2 ** -128 a pair
        leaves = leaves.unionByName(over.select(F.col("_over").alias("q"), F.lit(BITS).alias("depth"), F.lit(None).cast("long").alias("shard_bytes")))
    return staged(leaves, "leaves")


def shard(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, shard, depth, shard_bytes, oversized) for each row: ``shard`` is the bucket's
    address prefix."""
    bits = lambda c: F.lpad(F.conv(F.hex(c), 16, 2), 64, "0")
    rows = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.xxhash64(id_col).alias("_h"), F.xxhash64(F.lit(1), F.col(text_col)).alias("_c"), F.monotonically_increasing_id().alias("_place"))
    rows = staged(rows, "addresses")  # from here on a row's place is a stored value
    rows = rows.withColumn("address", F.concat(bits(F.col("_h")), bits(F.xxhash64("_c", "_place")))).drop("_h", "_c", "_place")
    leaves = directory(rows, limit)
    # the depths that occur number at most BITS; each row has its leaf at just one of them
    depths = sorted(r["depth"] for r in leaves.select("depth").distinct().collect())
    if not depths:
        return rows.select(id_col, "n_bytes", F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(False).alias("oversized"))
    least, most = depths[0], depths[-1]
    # leaves deeper than the least are found by a key of fixed length with the depths below it
    table_ = leaves.select(F.substring("q", 1, least).alias("_head"), F.struct("depth", F.col("q"), "shard_bytes").alias("leaf"))
    grouped = table_.groupBy("_head").agg(F.collect_list("leaf").alias("leaves")) if most - least <= STEP else None
    if grouped is not None:  # a head has at most 2 ** STEP leaves
        joined = rows.withColumn("_head", prefix(least)).join(small(grouped, 20_000), "_head")
        joined = joined.withColumn("leaf", F.expr("filter(leaves, l -> startswith(address, l.q))[0]"))
    else:
        keys = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), prefix(d).alias("q")) for d in depths]))
        joined = rows.withColumn("_k", keys).select("*", "_k.*").join(small(leaves.withColumnRenamed("shard_bytes", "_b"), 200_000), ["depth", "q"])
        joined = joined.withColumn("leaf", F.struct("depth", "q", F.col("_b").alias("shard_bytes")))
    return joined.select(id_col, "n_bytes", F.col("leaf.q").alias("shard"), F.col("leaf.depth").alias("depth"), F.col("leaf.shard_bytes").alias("shard_bytes"), (F.col("leaf.shard_bytes") > limit).alias("oversized"))


def write(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """The shards as files: one folder a shard, for documents with unique ids."""
    docs.join(placed.select("doc_id", "shard"), "doc_id").repartition("shard").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
