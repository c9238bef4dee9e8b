"""Document fingerprints: a canonical exact digest. DataFrame functions only.

Canonical form: Unicode NFKC, full case folding (lower of upper), NFKC again, every run of white
space one blank, none at the ends. The digest is four xxhash64 lanes with different salts. Rows of
an equal digest form a bucket; inside each bucket the canonical bytes are compared (least against
greatest, pre-aggregated in every task, so a hot bucket sends one row a task). Should a bucket hold
different texts, the digest of its rows is widened by SHA-256 of the canonical text.

Defined cases: null text counts as empty. Repeated rows keep one row each. In the order of
documents null ids come last, and rows of an equal id are ordered by a hash of the text. An empty
table gives an empty result. Rows that share one id stay in one window bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

LANES = 4


def canonical(text: Column) -> Column:
    """ICU's ``Normalizer.compose`` with compatibility mapping is NFKC."""
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = nfkc(F.lower(F.upper(nfkc(text))))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def lanes(canon: Column) -> Column:
    """The wide digest: 64 hex digits."""
    return F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(i), canon)), 16, "0") for i in range(LANES))))


def colliding(canon: DataFrame, digest: str, text: str) -> DataFrame:
    """Digests whose bucket holds different texts, by comparison of bytes."""
    return canon.groupBy(digest).agg(F.min(text).alias("_lo"), F.max(text).alias("_hi")).where(F.col("_lo") != F.col("_hi")).select(F.col(digest).alias("_collides"))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for each row; equal canonical texts have equal fingerprints, others not."""
    rows = docs.select(F.col(id_col).alias(id_col), canonical(F.coalesce(F.col(text_col), F.lit(""))).alias("_canon")).withColumn("_digest", lanes(F.col("_canon")))
    bad = colliding(rows, "_digest", "_canon")
    slim = rows.select(id_col, "_digest", F.sha2("_canon", 256).alias("_wider"))
    return slim.join(bad, F.col("_digest") == F.col("_collides"), "left").select(id_col, F.when(F.col("_collides").isNull(), F.col("_digest")).otherwise(F.concat("_digest", "_wider")).alias("fingerprint"))


def with_next(docs: DataFrame, order_col: str, carried: list[str]) -> DataFrame:
    """Adds ``next_<c>`` for each carried column: that of the next row by descending ``order_col``,
    after the last that of the first.

    Ids are cut into ranges at quantiles, which are ids of the data; each range is a window of its
    own, and the row that begins a range is also sent to the range before it. So no task sees more
    than its range, and the text is shuffled once.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    head = docs.agg(F.percentile_approx(order_col, [i / parts for i in range(1, parts)], 20_000).alias("cuts"), F.max(order_col).alias("top")).first()
    cuts, top = sorted(set(head["cuts"] or [])), head["top"]
    id_type = docs.schema[order_col].dataType
    cut = F.array(*[F.lit(c) for c in cuts]).cast(f"array<{id_type.simpleString()}>") if cuts else None
    below = F.size(F.filter(cut, lambda c: c < F.col(order_col))) if cuts else F.lit(0)  # a null id: none
    own = F.when(F.col(order_col).isNull(), F.lit(0)).otherwise(below).cast("int")
    place = lambda b, extra: F.struct(b.cast("int").alias("bucket"), F.lit(extra).alias("guest"))
    guests = [F.when(F.col(order_col).eqNullSafe(F.lit(top).cast(id_type)), place(F.lit(0), 2))]  # follows the last row of all
    if cuts:
        guests.append(F.when(F.array_contains(cut, F.col(order_col)), place(own + 1, 1)))
    rows = docs.withColumn("_at", F.explode(F.filter(F.array(place(own, 0), *guests), lambda x: x.isNotNull())))
    w = Window.partitionBy("_at.bucket").orderBy(F.col("_at.guest"), F.col(order_col).desc_nulls_last(), F.col("_tie"))
    nexts = [F.lead(c).over(w).alias(f"next_{c}") for c in carried]
    return rows.select("*", *nexts).where("_at.guest = 0").drop("_at")


def compare(docs: DataFrame) -> DataFrame:
    """The fingerprint of each text and of its edited form (the last half of its code points
    replaced by the first as many of the next document), with their likeness: of exact digests 1.0
    or 0.0, and 1.0 only after the canonical bytes were compared too."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    canon = docs.select(canonical(F.col("text")).alias("_canon")).withColumn("_digest", lanes(F.col("_canon")))
    bad = colliding(canon, "_digest", "_canon")
    collisions = not bad.isEmpty()

    rows = docs.withColumn("digest", lanes(canonical(F.col("text")))).withColumn("_tie", F.xxhash64("text"))
    rows = with_next(rows, "doc_id", ["text", "digest"])
    edited = F.expr("concat(substring(text, 1, length(text) - length(text) div 2), substring(next_text, 1, cast(length(text) div 2 as int)))")
    rows = rows.withColumn("edited", F.when(F.length("text") > 1, edited).otherwise(F.col("text")))
    rows = rows.withColumn("edited_canon", canonical(F.col("edited"))).withColumn("edited_digest", lanes(F.col("edited_canon")))

    def same(digest: str, other: Column) -> Column:
        return F.when(F.col("digest") != F.col(digest), F.lit(0.0)).when(canonical(F.col("text")) == other, F.lit(1.0)).otherwise(F.lit(0.0))

    out = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.col("digest").alias("fingerprint"), F.col("edited_digest").alias("edited_fingerprint"),
        same("edited_digest", F.col("edited_canon")).alias("near_edited"), same("next_digest", canonical(F.col("next_text"))).alias("near_next"),
        *([F.sha2(canonical(F.col("text")), 256).alias("_wider"), F.sha2("edited_canon", 256).alias("_edited_wider")] if collisions else []),
    )
    if collisions:
        for c, wider in (("fingerprint", "_wider"), ("edited_fingerprint", "_edited_wider")):
            out = out.join(bad, F.col(c) == F.col("_collides"), "left").withColumn(c, F.when(F.col("_collides").isNull(), F.col(c)).otherwise(F.concat(c, wider))).drop("_collides")
        out = out.drop("_wider", "_edited_wider")
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))
