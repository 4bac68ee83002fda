"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 60-bit hash of its id and text. Tokens are summed by source and hash bucket; the running sum finds the
bucket in which a source's budget ends, only that boundary bucket is cut into finer buckets, and at last the few
documents of the innermost bucket settle the threshold. A document is then kept by comparing its hash with its
source's threshold: nothing is sorted, and a larger budget keeps a superset (the thresholds are nested).

A source whose target is above its size takes every document once (or twice at the most) and the rest by threshold.
Targets: weights over all sources, filled up to a cap of ``max_repeats`` times the source's size; what is above the
cap is shared by weight among the others.

Defined results: a null or empty text has size 0; a null source is a source of its own, last in order; rows of one id and
text share one hash and are taken or left together, other rows of one id part; a null id hashes as the word null. Very long
texts count whole. An empty table gives an empty result; other columns, of whatever name, are ignored (``mix_sources``) or
returned (``take_mix``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SQL, cut_lineage, read_table, shielded

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
SPACE_SQL = r"[\x20\x09-\x0D]+"
#: 12 bits a level: 4096 buckets a source.
LEVELS = (48, 36)
#: The table of sources is broadcast up to this many rows; beyond it the joins shuffle and adaptive execution splits
#: a source that holds most rows.
MAX_BROADCAST_SOURCES = 100_000


def row_hash(id_col: str, text_col: str) -> Column:
    """60 bits of the md5 of the id and the text, so that different texts of one id part."""
    written = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # Never null; said so that no plan hashes once more to see whether it is.
    return F.coalesce(F.conv(F.substring(F.md5(written), 1, 15), 16, 10).cast("long"), F.lit(0).cast("long"))


def word_count(text_col: str) -> Column:
    """Words of a text, 0 if it is null. Each becomes one letter, and these are counted: ``regexp_count`` would hold all
    words at once, each as a string of its own, which takes many times the memory of the text."""
    marks = F.regexp_replace(text_col, WORD_SQL, "x")
    return F.coalesce(F.length(F.regexp_replace(marks, SPACE_SQL, "")), F.lit(0)).cast("long")


def by_source(sources: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(sources) if few else sources


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sizes: one row a source (source, source_size). Adds target. The windows run over sources, not documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.col("rk") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rk", F.row_number().over(order) - 1).withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(max_repeats))
    everything = Window.orderBy(F.col("cap") / F.col("w"), "rk")
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    filled = (
        ranked.withColumn("total", F.lit(share) * F.sum("source_size").over(whole))
        .withColumn("all_w", F.sum("w").over(whole))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("capped", F.col("cap") * (F.col("all_w") - F.col("w_before")) <= F.col("w") * (F.col("total") - F.col("cap_before")))
        .withColumn("cap_sum", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(whole))
        .withColumn("w_sum", F.sum(F.when(F.col("capped"), F.col("w")).otherwise(0)).over(whole))
    )
    rate = F.try_divide(F.col("total") - F.col("cap_sum"), (F.col("all_w") - F.col("w_sum")).cast("double"))
    return filled.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(rate * F.col("w")).alias("target"))


def thresholds(base: DataFrame, targets: DataFrame, few: bool) -> DataFrame:
    """For each source: times (whole passes), and last_hash: documents with a hash up to it are taken once more."""
    budget = targets.select(
        F.col("source").alias("s"), "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("times"), "source_size",
    ).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")).withColumn("lo", F.lit(0).cast("long")).withColumn("used", F.lit(0).cast("long"))
    inside, width = base, 60
    for shift in LEVELS:
        size = 1 << width
        sums = (
            inside.join(by_source(budget.select("s", "lo"), few), F.col("source").eqNullSafe(F.col("s")))
            .where((F.col("h") >= F.col("lo")) & (F.col("h") - F.col("lo") < size))
            .groupBy("s", F.shiftright(F.col("h") - F.col("lo"), shift).alias("b")).agg(F.sum("size").alias("n"))
        )
        before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        found = (
            sums.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .join(budget.select(F.col("s").alias("s2"), "rest", "used"), F.col("s").eqNullSafe(F.col("s2")))
            .where(F.col("used") + F.col("below") <= F.col("rest"))
            .groupBy("s").agg(F.max(F.struct("b", "below")).alias("last"))
            .select(F.col("s").alias("s3"), "last")
        )
        budget = (
            budget.join(found, F.col("s").eqNullSafe(F.col("s3")), "left")
            .withColumn("lo", F.col("lo") + F.coalesce(F.shiftleft(F.col("last.b"), shift), F.lit(0)))
            .withColumn("used", F.col("used") + F.coalesce(F.col("last.below"), F.lit(0)))
            .drop("s3", "last")
        )
        budget, width = cut_lineage(budget), shift
    each = (
        base.join(by_source(budget.select("s", "lo", "used", "rest"), few), F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("h") >= F.col("lo")) & (F.col("h") - F.col("lo") < (1 << width)))
        .groupBy("s", "h", "used", "rest").agg(F.sum("size").alias("n"))
    )
    before = Window.partitionBy("s").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    taken = (
        each.withColumn("below", F.col("used") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        .where(F.col("below") + F.col("n") / 2 <= F.col("rest")).groupBy("s").agg(F.max("h").alias("top")).select(F.col("s").alias("s3"), "top")
    )
    return budget.join(taken, F.col("s").eqNullSafe(F.col("s3")), "left").select("s", "target", "source_size", "times", F.coalesce("top", F.col("lo") - 1).alias("last_hash"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), row_hash(id_col, text_col).alias("h"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target of its source, taken words (repeats counted)."""
    base = cut_lineage(measured(docs, id_col, text_col, source_col))
    targets = cut_lineage(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeats))
    few = targets.count() <= MAX_BROADCAST_SOURCES
    limits = thresholds(base, targets, few)
    joined = base.join(by_source(limits, few), F.col("source").eqNullSafe(F.col("s")))
    taken = F.col("size") * (F.col("times") + (F.col("h") <= F.col("last_hash")).cast("long"))
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))


@shielded("id_col", "text_col", "source_col")
def take_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: documents with all their columns, and times, how often the mix takes each; others are left out."""
    base = cut_lineage(measured(docs, id_col, text_col, source_col))
    targets = cut_lineage(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeats))
    few = targets.count() <= MAX_BROADCAST_SOURCES
    limits = thresholds(base, targets, few).select(F.col("s").alias("_s"), F.col("times").alias("_times"), "last_hash")
    # Hashed below the join: above it, the filter on times would hash every text a second time.
    joined = docs.withColumn("_h", row_hash(id_col, text_col)).join(by_source(limits, few), F.col(source_col).eqNullSafe(F.col("_s")))
    taken = joined.withColumn("times", F.col("_times") + (F.col("_h") <= F.col("last_hash")).cast("long"))
    return taken.where(F.col("times") > 0).select(*docs.columns, "times")


def query(spark, sf_dir):
    return mix_sources(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap FROM k),
f AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
             coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, cap * (all_w - w_before) <= w * (total - cap_before) AS capped FROM f),
t AS (SELECT source, source_size,
             CASE WHEN capped THEN cap::DOUBLE ELSE
               (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / nullif(all_w - sum(CASE WHEN capped THEN w ELSE 0 END) OVER (), 0)::DOUBLE * w END AS target
      FROM g),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS times FROM t),
j AS (SELECT b.*, r.source_size, r.target, r.times, r.target - r.times * r.source_size AS rest
      FROM base b JOIN r ON b.source IS NOT DISTINCT FROM r.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
             sum(size) OVER (PARTITION BY source, h) AS n FROM j)
SELECT doc_id, size, source_size, target,
       (size * (times + CASE WHEN upto - n + n / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
