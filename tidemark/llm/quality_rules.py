"""Quality rules: text statistics of each document, and cross-document line frequency per host.

Lines are normalised (words joined by one space, A-Z lower-cased, digits as 0) and hashed; a line counts once for each
document of a host (the ``source`` column). Lines that more than ``MAX_DOCUMENTS`` documents of one host carry are
removed. A document is depleted, and rejected, if fewer than half of its words, or fewer than ``MIN_WORDS``, are left.

The first pass, vectorised over Arrow batches, reads each text once and returns its statistics with one hash and word
count per distinct line. Counting is an aggregation with map-side combining, so a line that a third of all documents
carry costs one row per task. The counts meet the documents again by an ordinary join on (host, line hash).

Defined results: a null text has no words and fails the base rules; a null source is a host of its own. Rows that
repeat, or share an id, are documents of their own in every count. Very long texts are taken whole. No rows give no
rows; other columns, of whatever name, are ignored. Lines are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import read_table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_DOCUMENTS = 20
CHUNK = 4 << 20
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[ord("0") : ord("9") + 1] = ord("0")
_U64 = np.uint64

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _counted(owner: np.ndarray, n: int, member: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner if member is None else owner[member], minlength=n).astype(np.int64)


def _per_value(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Statistics per text, and its distinct lines with a word: (owner, hash, words), ordered by owner."""
    n = len(offsets) - 1
    space = common.is_space(data)
    words, starts, ends, firsts = common.words_of(data, offsets)
    owner = np.repeat(np.arange(n), np.diff(firsts))
    stats = {
        "n_words": np.diff(firsts).astype(np.int64),
        "word_chars": _per_value(~space & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_value(_SYMBOL[data], offsets),
    }
    stats["n_repeat_words"] = _repeat_words(words, owner, firsts, n)

    # Lines: runs of other bytes than \n, within one text; those without a word are left out.
    l_starts, l_ends = common.segments(data != 10, offsets)
    l_first, l_last = np.searchsorted(starts, l_starts), np.searchsorted(starts, l_ends)
    full = l_last > l_first
    l_starts, l_ends, l_first, l_last = l_starts[full], l_ends[full], l_first[full], l_last[full]
    l_owner = np.searchsorted(offsets, l_starts, side="right") - 1
    exact = common.hash_segments(data, l_starts, l_ends)
    stats["n_dup_lines"] = _counted(l_owner, n) - _counted(_distinct(l_owner, exact)[0], n)

    folded = common.hash_segments(data, starts, ends, _FOLD)
    place = np.arange(len(words)) - np.repeat(l_first, l_last - l_first) if len(words) else np.zeros(0, np.int64)
    weighted = folded * common.powers(int(place.max()) + 1 if len(place) else 1)[place]
    lines = common.mix(np.add.reduceat(weighted, l_first) + (l_last - l_first).astype(np.uint64)) if len(l_first) else np.zeros(0, np.uint64)
    who, what, at = _distinct(l_owner, lines)
    return stats, (who, what, (l_last - l_first)[at])


def _distinct(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs in order, and where each first occurs."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return o[new], v[new], order[new]


def _repeat_words(words: np.ndarray, owner: np.ndarray, firsts: np.ndarray, n: int) -> np.ndarray:
    """Words that lie in a 3-word window found twice or more in their text."""
    if len(words) < 3:
        return np.zeros(n, np.int64)
    inside = owner[2:] == owner[:-2]
    at = np.flatnonzero(inside)
    window = common.mix(words[at] * _U64(3) + common.mix(words[at + 1] * _U64(5) + common.mix(words[at + 2])))
    # A text's number goes into the key, so that one sort serves all texts of the chunk.
    key = common.mix(window + owner[at].astype(np.uint64) * _U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    return _counted(owner, n, covered)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, 1, CHUNK):
        data, offsets = common.utf8(batch.column(1))
        stats, (who, what, words) = measure(data, offsets)
        bounds = np.searchsorted(who, np.arange(len(offsets))).astype(np.int32)
        lines = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(what.view(np.int64)), pa.array(words.astype(np.int64))], ["line", "words"]))
        # Ids repeat, so rows get a key of their content; equal rows are counted with it.
        whole = common.hash_segments(data, offsets[:-1], offsets[1:])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(whole.view(np.int64)), *[pa.array(stats[k]) for k in STATS], lines], ["id", "source", "whole", *STATS, "lines"])


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """One row per document: id, statistics, base_failed, n_removed_words (in lines above the limit), kept."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).alias("source"))
    kinds = {f.name: f.dataType.simpleString() for f in picked.schema}
    scanned = picked.mapInArrow(_scan, f"id {kinds['id']}, source {kinds['source']}, whole bigint, {', '.join(f'{k} bigint' for k in STATS)}, lines array<struct<line:bigint,words:bigint>>")
    # Equal rows become one with a count; afterwards (id, source, whole) is a key. Salted by content, so no id is hot.
    rows = common.cut_lineage(scanned.groupBy("id", "source", "whole", *STATS).agg(F.count("*").alias("copies"), F.first("lines").alias("lines")))
    seen = rows.select("id", "source", "whole", "copies", F.inline("lines"))
    common_lines = seen.groupBy("source", "line").agg(F.sum("copies").alias("n")).where(F.col("n") > max_documents).select(F.col("source").alias("s"), F.col("line").alias("l"))
    # Written first: a join that reads two plain shuffles can split a line that most documents of a host carry.
    common_lines = common.cut_lineage(common_lines)
    removed = (
        seen.join(common_lines, F.col("source").eqNullSafe(F.col("s")) & (F.col("line") == F.col("l")))
        .groupBy(F.col("id").alias("i"), F.col("source").alias("s"), F.col("whole").alias("w")).agg(F.sum("words").alias("removed"))
    )
    left = F.col("n_words") - F.col("n_removed_words")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        rows.drop("lines")
        .join(removed, F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("whole") == F.col("w")), "left")
        .withColumn("n_removed_words", F.coalesce("removed", F.lit(0)).cast("long"))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (left >= MIN_WORDS) & (2 * left >= F.col("n_words")))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(F.col("id").alias(id_col), *STATS, "base_failed", "kept", "n_removed_words")
    )


def query(spark, sf_dir):
    return judge_documents(read_table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, source, text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
lines AS MATERIALIZED (SELECT n, source, i, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w
          FROM (SELECT n, source, generate_subscripts(p, 1) AS i, unnest(p) AS x FROM (SELECT n, source, string_split(text, chr(10)) AS p FROM d))),
worded AS MATERIALIZED (SELECT n, source, i, x, len(w) AS words, regexp_replace(translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS l
           FROM lines WHERE len(w) > 0),
dup AS (SELECT n, count(*) - count(DISTINCT x) AS n_dup_lines FROM worded GROUP BY n),
tri AS (SELECT n, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT n, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT n, count(DISTINCT k) AS n_repeat_words FROM (
          SELECT n, unnest([i, i + 1, i + 2]) AS k FROM (SELECT n, i, count(*) OVER (PARTITION BY n, t) AS c FROM tri) WHERE c > 1) GROUP BY n),
once AS (SELECT n, source, l, first(words) AS words FROM worded GROUP BY n, source, l),
freq AS (SELECT source, l FROM once GROUP BY source, l HAVING count(*) > {MAX_DOCUMENTS}),
gone AS (SELECT n, sum(words) AS removed FROM once JOIN freq ON once.source IS NOT DISTINCT FROM freq.source AND once.l = freq.l GROUP BY n),
s AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0)::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS n_removed_words
      FROM d LEFT JOIN dup USING (n) LEFT JOIN rep USING (n) LEFT JOIN gone USING (n)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND n_words - n_removed_words >= {MIN_WORDS} AND 2 * (n_words - n_removed_words) >= n_words AS kept FROM b
"""
