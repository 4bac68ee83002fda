"""Near-duplicate lines by a deletion-neighbourhood join, native.

A line is removed if an earlier line (by document id, then line number) is the same or one edit away: one word
inserted, deleted or replaced. Lines are compared as words in lower case. Lines of fewer than ``MIN_WORDS`` words are
only compared for equality, as one edit is too much of them; lines without a word stay.

1. Equal lines: lines are hashed, and the first place of each hash is found by an aggregation.
2. Of the distinct lines, only those can have a neighbour that share an end with another one: a single edit leaves the
   first or the last ``e`` words alone, where e is a power of two, at most half the line. This loses nothing and spares
   the variants of all other lines.
3. Deletion neighbourhood: each such line emits a hashed key for every variant with one word deleted outside the end
   it shares, the exclusive-or of its other words' hashes. Equal keys at the same place mean a replaced word; a key equal to that of a whole line
   means an inserted or deleted one. Variants that share a key get a hash of the remaining sequence, each group links
   its lines to its earliest one, and the edit is verified on the words themselves.

A group of variants is linked to its earliest line, never all with all; as all of its lines are one edit apart from
each other, that decides every one of them. Hot lines are counted with map-side combining, and joins on them are
left to adaptive skew handling.

Defined results: a null text has no lines; an empty one has one empty line. Rows that share an id are told apart by
their text; equal rows are one document and never remove each other's lines. A null id comes first in order. Very long
texts are taken whole. No rows give no rows; other columns, of whatever name, are ignored (``report``) or returned
(``dedup_lines``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SQL, cut_lineage, read_table, shielded

MIN_WORDS = 8
#: Candidate lines, of about 50 bytes each, up to which their places are broadcast to the scan that fetches their words.
MAX_BROADCAST_LINES = 1_000_000


def _normal(text: Column) -> Column:
    """Lower case, runs of white space but line ends as one space; most texts need no replacing."""
    odd = text.contains("  ") | text.contains("\t") | text.contains("\x0b") | text.contains("\x0c") | text.contains("\r")
    return F.lower(F.when(odd, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text))


def _count(text: Column, symbol: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(symbol), F.lit("")))


def _judged(docs: DataFrame) -> DataFrame:
    """(id, tkey, line_no, words, n) of the lines with a word; words is a string with single spaces. docs has id and text."""
    split = docs.select("id", F.xxhash64("text").alias("tkey"), F.posexplode(F.split(_normal(F.col("text")), "\n", -1)).alias("line_no", "line"))
    trimmed = split.select("id", "tkey", "line_no", F.trim("line").alias("words"))
    return trimmed.withColumn("n", _count(F.col("words"), " ") + 1).where(F.col("words") != "")


def _ends(words: Column, n: Column) -> list[Column]:
    """Hashes of the ends a single edit may leave alone; lengths that differ by one have one length of end in common.

    Lines of 2^c to 2^(c+1) - 1 words have ends of 2^(c-1) words; those of 2^c words also the shorter ends of the
    lines one word below. Lines under MIN_WORDS have none.
    """
    e = F.pow(F.lit(2), F.floor(F.log2(n)) - 1).cast("int")
    shorter = F.when((n == 2 * e) & (e >= MIN_WORDS), (e / 2).cast("int"))

    def end(side: int, length: Column) -> Column:
        # substring_index with a count that differs from row to row
        part = F.call_function("substring_index", words, F.lit(" "), length if side == 0 else -length)
        return F.when((n >= MIN_WORDS) & length.isNotNull(), F.xxhash64(F.lit(side), length, part))

    return [end(0, e), end(1, e), end(0, shorter), end(1, shorter)]


def _open(shared: Column, n: Column, at: Column) -> Column:
    """Whether an edit may lie at the place: not within an end that the line has in common with another one.

    Bit k of shared stands for the k-th of _ends; a line with common first and common last words may have either.
    """
    e = F.pow(F.lit(2), F.floor(F.log2(n)) - 1).cast("int")

    def common(side: int) -> Column:
        long_end, short_end = shared.bitwiseAND(1 << side) != 0, shared.bitwiseAND(4 << side) != 0
        return F.when(short_end, (e / 2).cast("int")).when(long_end, e)

    return F.coalesce(at >= common(0), F.lit(False)) | F.coalesce(at < n - common(1), F.lit(False))


def _hashed(unique: DataFrame) -> DataFrame:
    """For joins on a key that is unique here: partitions are looked up by hash, the many rows needn't be sorted."""
    return unique.hint("shuffle_hash")


def _without(words: Column, at: Column) -> Column:
    """The words but the one at the (0-based) place."""
    return F.concat(F.slice(words, F.lit(1), at), F.slice(words, at + 2, F.greatest(F.size(words) - at - 1, F.lit(0))))


def _xor(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h))


def _neighbours(lines: DataFrame) -> DataFrame:
    """lines has line, first, shared and words. Returns (line): those with an earlier line one edit away.

    Lines are distinct but for rows with one id and one text, which bring equal rows; these don't change the result.
    """
    hashed = lines.select("line", "first", "shared", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("h")).withColumn("all", _xor(F.col("h")))
    variants = hashed.select("line", "n", "all", "shared", F.posexplode("h").alias("at", "word")).where(_open(F.col("shared"), F.col("n"), F.col("at"))).select("line", "n", "at", F.col("all").bitwiseXOR(F.col("word")).alias("key"))
    shared = variants.groupBy("key", "n", "at").agg(F.min("line").alias("low"), F.max("line").alias("high")).where(F.col("low") != F.col("high")).select("key", "n", "at")
    replaced = cut_lineage(variants.join(_hashed(shared), ["key", "n", "at"], "left_semi").select("line", "at"))
    sequences = replaced.join(lines, "line").select("line", "at", "first", F.xxhash64(_without(F.col("words"), F.col("at")), F.size("words")).alias("rest"))
    leaders = sequences.groupBy("rest", "at").agg(F.min(F.struct("first", "line")).alias("lead"))
    swaps = (
        sequences.join(leaders.select("rest", "at", F.col("lead.line").alias("other")), ["rest", "at"])
        .where(F.col("line") != F.col("other")).select("line", "other", "at", F.lit(True).alias("swap"))
    )
    whole = hashed.select(F.col("line").alias("other"), F.col("all").alias("key"), (F.col("n") + 1).alias("n"))
    inserts = variants.join(whole, ["key", "n"]).select("line", "other", "at", F.lit(False).alias("swap"))
    pairs = cut_lineage(swaps.union(inserts))
    left = lines.select("line", F.col("first").alias("first_a"), F.col("words").alias("words_a"))
    right = lines.select(F.col("line").alias("other"), F.col("first").alias("first_b"), F.col("words").alias("words_b"))
    rest = _without(F.col("words_a"), F.col("at"))
    one_edit = F.when(F.col("swap"), rest == _without(F.col("words_b"), F.col("at"))).otherwise(rest == F.col("words_b"))
    return (
        pairs.join(left, "line").join(right, "other").where(one_edit)
        .select(F.when(F.col("first_a") > F.col("first_b"), F.col("line")).otherwise(F.col("other")).alias("line")).distinct()
    )


def removed_lines(docs: DataFrame) -> DataFrame:
    """docs has id and text. Returns (id, tkey, line_nos): sorted numbers of the lines to remove from each document."""
    place = F.struct("id", "tkey", "line_no")
    names = ["e0", "e1", "e2", "e3"]
    found = _judged(docs)
    lines = cut_lineage(found.select("id", "tkey", "line_no", F.xxhash64("words").alias("line"), *[x.alias(c) for x, c in zip(_ends(F.col("words"), F.col("n")), names)]))
    ends = lines.select("line", F.posexplode(F.array(*names)).alias("which", "end")).where(F.col("end").isNotNull())
    # An end of two different lines at least; equal lines needn't be told apart beforehand.
    shared = ends.groupBy("end").agg(F.min("line").alias("low"), F.max("line").alias("high")).where(F.col("low") != F.col("high")).select("end")
    shared = cut_lineage(shared)  # so that the join reads two plain shuffles and can split an end that most lines have
    survivors = ends.join(_hashed(shared), "end", "left_semi").groupBy("line").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("which"))).alias("shared"))
    first = lines.groupBy("line").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    first = cut_lineage(first.join(_hashed(survivors), "line", "left").where((F.col("n") > 1) | F.col("shared").isNotNull()))
    wanted = first.where(F.col("shared").isNotNull()).select("line", "first", "shared")
    # The words of the survivors are read again, only from the documents in which they come first.
    per_doc = cut_lineage(wanted.groupBy(F.col("first.id").alias("d"), F.col("first.tkey").alias("k")).agg(F.collect_list(F.struct(F.col("first.line_no").alias("no"), "line", "first", "shared")).alias("picked")))
    if per_doc.agg(F.coalesce(F.sum(F.size("picked") + 2), F.lit(0))).first()[0] <= MAX_BROADCAST_LINES:
        per_doc = F.broadcast(per_doc)
    texts = docs.withColumn("tkey", F.xxhash64("text")).join(per_doc, F.col("id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("k")))
    again = texts.select(F.split(_normal(F.col("text")), "\n", -1).alias("all"), F.explode("picked").alias("p")).select("p.line", "p.first", "p.shared", F.split(F.trim(F.get(F.col("all"), F.col("p.no"))), " ").alias("words"))
    near = _neighbours(cut_lineage(again))
    fate = cut_lineage(first.select("line", "first", "n").join(near.withColumn("near", F.lit(True)), "line", "left").where((F.col("n") > 1) | F.col("near")))
    return (
        lines.select("id", "tkey", "line_no", "line").join(_hashed(fate), "line")
        .where(F.coalesce("near", F.lit(False)) | (F.struct("id", "tkey", "line_no") != F.col("first")))
        .groupBy("id", "tkey").agg(F.array_sort(F.collect_set("line_no")).alias("line_nos"))
    )


def _joined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    gone = removed_lines(picked).select(F.col("id").alias("_d"), F.col("tkey").alias("_k"), F.coalesce("line_nos", F.expr("cast(array() as array<int>)")).alias("_gone"))
    return gone


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_lines, n_removed, removed_lines (numbers from 0, comma-joined)."""
    gone = _joined(docs, id_col, text_col)
    lines = F.coalesce(_count(F.col(text_col).cast("string"), "\n") + 1, F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col), F.xxhash64(F.col(text_col).cast("string")).alias("_t"), lines.alias("n_lines"))
    return rows.join(gone, F.col(id_col).eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_k")), "left").select(
        id_col, "n_lines", F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("_gone", ","), F.lit("")).alias("removed_lines")
    )


@shielded("id_col", "text_col")
def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with all their columns, duplicate lines taken out of the text; documents that lose all words go."""
    gone = _joined(docs, id_col, text_col)
    joined = docs.withColumn("_t", F.xxhash64(F.col(text_col).cast("string"))).join(gone, F.col(id_col).eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_k")), "left")
    kept = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda line, no: ~F.array_contains("_gone", no)), "\n")
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept)
    return joined.withColumn("_text", text).where(F.col("_gone").isNull() | F.col("_text").rlike(WORD_SQL)).select(*[F.col("_text").alias(c) if c == text_col else F.col(c) for c in docs.columns])


def query(spark, sf_dir):
    return report(read_table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH l AS MATERIALIZED (
  SELECT doc_id, i - 1 AS no, regexp_extract_all(lower(p[i]), '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))),
j AS MATERIALIZED (SELECT doc_id, no, w, array_to_string(w, ' ') AS s FROM l WHERE len(w) >= 1),
f AS MATERIALIZED (SELECT s, any_value(w) AS w, min((doc_id, no)) AS o FROM j GROUP BY s),
e AS MATERIALIZED (SELECT * FROM f WHERE len(w) >= {MIN_WORDS}),
v AS MATERIALIZED (SELECT s, o, i, array_to_string(w[1:i-1] || w[i+1:], ' ') AS r FROM (SELECT s, o, w, unnest(range(1, len(w) + 1)) AS i FROM e)),
swapped AS (SELECT s FROM (SELECT s, o, min(o) OVER (PARTITION BY r, i) AS lead FROM v) WHERE o > lead),
longer AS (SELECT v.s FROM v JOIN e ON v.r = e.s WHERE v.o > e.o),
shorter AS (SELECT e.s FROM v JOIN e ON v.r = e.s WHERE v.o < e.o),
near AS (SELECT s FROM swapped UNION SELECT s FROM longer UNION SELECT s FROM shorter),
gone AS (SELECT DISTINCT j.doc_id, j.no FROM j JOIN f USING (s) WHERE (j.doc_id, j.no) <> f.o OR j.s IN (SELECT s FROM near)),
g AS (SELECT doc_id, count(*) AS n, string_agg(no::VARCHAR, ',' ORDER BY no) AS nos FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
       coalesce(n, 0)::BIGINT AS n_removed, coalesce(nos, '') AS removed_lines
FROM documents d LEFT JOIN g USING (doc_id)
"""
