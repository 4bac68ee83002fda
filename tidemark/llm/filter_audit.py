"""Audit of how document filters interact: what each filter removes in every order of application, and what it costs.

Four filters look at a text alone (A few words, B few different words, C capitals, D symbols), the fifth (E) at the table:
a text that a smaller id holds already. Each document's failures are found once, as a combination of bits:

1. A to D are column functions of the text.
2. E is an existential self-join: a left-semi join on the hash, the exact text and a smaller id. Only texts whose hash
   occurs under several ids are met; the right side is one row of each hash, that of the least id, as any smaller id
   proves the same. A hash that many rows share is dealt into as many salts as it has pieces of ``PIECE`` rows.
3. The ids marked by E are united with those of the other failures, and each document's bits are put together.

All that the orders need is how many documents of a part have which combination of bits (32 at most): every step of all
120 orders is a sum over these, and the texts are never looked at again.

Defined results: a null text is an empty one; a null source makes the part '', as an empty source does; a null id is
smaller than none and has none smaller, so E never removes it, and it has no label. Rows of one id and text are counted
each and judged alike; equal texts of the least id stay. Labels of one id are put together: one of quality 1 is enough,
one of toxic 1 too; null labels count as 0. Very long texts are judged whole. No documents give no rows; other columns
are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SQL, cut_lineage, read_table

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SYMBOLS = "[#$%&*|]"
#: Rows of one text that a task of the self-join takes.
PIECE = 4096
#: Repeated hashes (16 bytes and two numbers each) up to which they are broadcast; more are joined by a shuffle.
MAX_BROADCAST_HASHES = 500_000


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_failures(text: Column, words: Column) -> Column:
    """Bits of the filters A to D for a text and the list of its words."""
    n = F.size(words)
    failed = {
        "A": n < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < n * LEAST_DISTINCT,
        "C": F.length(F.regexp_replace(text, "[^A-Z]", "")) * 100 > F.length(text) * MOST_CAPITALS,
        "D": text.rlike(SYMBOLS),
    }
    return sum((F.when(is_failed, _bit(letter)).otherwise(0) for letter, is_failed in failed.items()), F.lit(0))


def earlier_copies(texts: DataFrame) -> DataFrame:
    """texts: (part, id, hash, text). (part, id, hash) of those whose text a smaller id holds, by a left-semi join."""
    groups = texts.groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where(F.col("low") < F.col("high"))
    groups = cut_lineage(groups.select(F.col("hash").alias("g"), "low", F.ceil(F.col("n") / PIECE).alias("salts")))
    known = F.broadcast(groups) if groups.count() <= MAX_BROADCAST_HASHES else groups
    repeated = texts.join(known, F.col("hash") == F.col("g")).drop("g")
    rows = repeated.where(F.col("id") > F.col("low")).select("part", "id", "hash", "text", F.pmod(F.xxhash64("id"), "salts").alias("salt"))
    first = repeated.where(F.col("id") == F.col("low")).dropDuplicates(["hash"])
    first = first.select(F.col("hash").alias("h"), F.col("text").alias("t"), F.col("id").alias("smaller"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("s"))
    found = rows.join(first, (F.col("hash") == F.col("h")) & (F.col("salt") == F.col("s")) & (F.col("text") == F.col("t")) & (F.col("smaller") < F.col("id")), "left_semi")
    return found.select("part", "id", "hash")


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(part, id, hash, bits, n): the failed filters of the n rows of one source, id and text."""
    texts = docs.select(
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("hash", F.unhex(F.md5("text")))
    worded = texts.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    own = worded.select("part", "id", "hash", text_failures(F.col("text"), F.col("words")).alias("bits"), F.lit(1).alias("n"))
    copies = earlier_copies(texts).select("part", "id", "hash", F.lit(_bit("E")).alias("bits"), F.lit(0).alias("n"))
    return own.union(copies).groupBy("part", "id", "hash").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))


def combinations(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, bits, n, good, toxic): documents of each combination of failures, and those of them with either label."""
    is_one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("labelled")).agg(is_one("quality"), is_one("toxic"))
    count = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    joined = failed.join(marks, F.col("id") == F.col("labelled"), "left")
    return joined.groupBy("part", "bits").agg(F.sum("n").alias("n"), count("quality").alias("good"), count("toxic").alias("toxic"))


def orders(combos: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from the counts of its combinations."""
    every = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = combos.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = {letter: F.instr("filter_order", letter) for letter in FILTERS}
    mask = lambda chosen: sum((F.when(chosen(place[x]), _bit(x)).otherwise(0) for x in FILTERS), F.lit(0))
    steps = steps.withColumns({"own": mask(lambda at: at == F.col("step")), "before": mask(lambda at: at < F.col("step"))})
    fails, gone = F.col("bits").bitwiseAND(F.col("own")) != 0, F.col("bits").bitwiseAND(F.col("before")) != 0
    total = lambda chosen, value="n": F.sum(F.when(chosen, F.col(value)).otherwise(0))
    counted = steps.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("bits") == F.col("own")).alias("unique_fails"), total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    same_filter = Window.partitionBy("part", F.expr("substring(filter_order, step, 1)"))
    return counted.withColumn("shapley", F.sum("removed").over(same_filter))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return orders(cut_lineage(combinations(failures(docs, id_col, text_col, source_col), labels, id_col)))


def query(spark, sf_dir):
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


ORACLE = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
 w AS MATERIALIZED (SELECT t.*, regexp_extract_all(text, '{WORD_SQL}') AS ws, min(doc_id) OVER (PARTITION BY text) AS low FROM t),
 f AS MATERIALIZED (SELECT doc_id, part, (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
     + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
     + CASE WHEN coalesce(doc_id > low, false) THEN 16 ELSE 0 END) AS bits FROM w),
 l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
 c AS MATERIALIZED (SELECT part, bits, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, bits),
 a AS (SELECT chr(65 + i::INT) AS letter, (1 << i)::INT AS bit FROM range(5) r(i)),
 o AS (SELECT '' AS filter_order, 0 AS step, 0 AS before, 0 AS own UNION ALL
       SELECT filter_order || letter, step + 1, before | own, bit FROM o JOIN a ON ((before | own) & bit) = 0),
 s AS MATERIALIZED (SELECT full_order.filter_order, p.step, p.before, p.own FROM o full_order JOIN o p ON full_order.step = 5 AND p.step > 0 AND starts_with(full_order.filter_order, p.filter_order)),
 r AS (SELECT part, filter_order, step, any_value(own) AS own, sum(CASE WHEN bits & (own | before) = 0 THEN n ELSE 0 END) AS kept,
     sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN bits & own <> 0 AND bits & before <> 0 THEN n ELSE 0 END) AS redundant,
     sum(CASE WHEN bits = own THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN good ELSE 0 END) AS good_lost,
     sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY part, filter_order, step)
 SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
   good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""
