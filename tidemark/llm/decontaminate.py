"""Benchmark decontamination by pigeonhole edit matching.

A test item within ``budget`` edits of a passage must leave at least one of budget + 1 disjoint pieces unchanged.
All pieces of all items go into one Aho-Corasick automaton; each exact piece hit in a document fixes where the item
would lie, and Myers' bit-parallel distance verifies the item against that window.

Items may share pieces, as those with one opening do. Before the distance, an item's halves of pieces are looked up
around their places: an edit spoils one half at most, so of 2 * (budget + 1) halves no more than budget may be missing.
An item that shares only some pieces with a text fails by a few short searches; none within its budget is lost.

Texts and items are compared in lower case with runs of white space as one space. The budget is ``ERROR_RATE`` of the
item's normalised length; an item too short for pieces of ``MIN_PIECE`` characters gets the largest budget that still
has such pieces, down to 0 (then the whole item must occur).

The items are the stated query set: they are read in blocks of at most ``BLOCK_CHARS`` characters, and each block's
items are broadcast and met by all documents; a worker builds a block's automaton once. A benchmark of more than one
block takes a pass for each, which leaves only the hits, so that one block is held at a time whatever their number.

Defined results: null, empty or blank items never match; a null document has no items. Equal items each report their
own id, of any type; an id that several items share is reported once, a null id not at all. Rows with a repeated id are
judged each for itself. No items give no hits, no documents no rows. Very long texts are taken whole; other columns, of
whatever name, are ignored (``find_items``) or returned (``decontaminate``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut_lineage, read_table, shielded

ERROR_RATE = 0.05
MIN_PIECE = 10
BLOCK_CHARS = 8_000_000


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def error_budget(length: int) -> int:
    return max(0, min(int(length * ERROR_RATE), length // MIN_PIECE - 1))


def pieces(item: str) -> list[tuple[str, int]]:
    """budget + 1 pieces of nearly equal length, with their offsets."""
    n = error_budget(len(item)) + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(item[a:b], a) for a, b in zip(cuts, cuts[1:])]


def halves(item: str) -> list[tuple[str, int]]:
    """Each piece as two, with their offsets, from both ends of the item inwards: shared openings or ends leave the other."""
    parts = []
    for piece, at in pieces(item):
        half = len(piece) // 2
        parts += [(piece[:half], at), (piece[half:], at + half)]
    inwards = [x for pair in zip(parts, reversed(parts)) for x in pair]
    return inwards[: len(parts)]


def may_lie(parts: list[tuple[str, int]], text: str, start: int, budget: int) -> bool:
    """Whether no more than ``budget`` halves are missing around their places in an item that starts about ``start``."""
    missing = 0
    for part, at in parts:
        low = start + at - budget
        if text.find(part, max(low, 0), max(low + 2 * budget + len(part), 0)) < 0:
            missing += 1
            if missing > budget:
                return False
    return True


def best_distance(pattern: str, text: str, masks: dict[str, int] | None = None) -> int:
    """Least edit distance between the pattern and any substring of the text (Myers; one machine word per text symbol)."""
    m = len(pattern)
    masks = symbol_masks(pattern) if masks is None else masks
    everything, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = everything, 0, m, m
    for symbol in text:
        match = masks.get(symbol, 0)
        diagonal = (((match & plus) + plus) ^ plus) | match | minus
        up = (minus | ~(diagonal | plus)) & everything
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            best = min(best, score)
        up, down = up << 1, down << 1  # row 0 stays 0: a match may start anywhere
        plus = (down | ~(diagonal | up)) & everything
        minus = up & diagonal & everything
    return best


def symbol_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, symbol in enumerate(pattern):
        masks[symbol] = masks.get(symbol, 0) | 1 << i
    return masks


class Matcher:
    """Automaton over the pieces of one block of items."""

    def __init__(self, items: list[tuple[object, str]]):
        self.items: dict[str, list] = {}
        for item_id, text in items:
            if item_id is not None and (plain := normalise(text)):
                self.items.setdefault(plain, []).append(item_id)
        self.texts = list(self.items)
        self.masks: dict[int, dict[str, int]] = {}
        self.halves: dict[int, list[tuple[str, int]]] = {}
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, text in enumerate(self.texts):
            for piece, offset in pieces(text):
                owners.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in owners.items():
            self.automaton.add_word(piece, (len(piece), places))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def find(self, text: str | None) -> list:
        """Ids of the items found in the text, in order."""
        if self.empty or not (plain := normalise(text)):
            return []
        found: set[int] = set()
        tried: set[tuple[int, int]] = set()
        for end, (length, places) in self.automaton.iter(plain):
            for k, offset in places:
                start = end - length + 1 - offset
                if k in found or (k, start) in tried:
                    continue
                tried.add((k, start))
                item = self.texts[k]
                if plain.startswith(item, max(start, 0)) and start >= 0:
                    found.add(k)
                elif budget := error_budget(len(item)):
                    if k not in self.halves:
                        self.halves[k] = halves(item)
                    if not may_lie(self.halves[k], plain, start, budget):
                        continue
                    window = plain[max(0, start - budget) : start + len(item) + budget]
                    if k not in self.masks:
                        self.masks[k] = symbol_masks(item)
                    if best_distance(item, window, self.masks[k]) <= budget:
                        found.add(k)
        return sorted({i for k in found for i in self.items[self.texts[k]]})


_built: dict[str, Matcher] = {}


def matcher_of(name: str, block) -> Matcher:
    """The matcher of a broadcast block of items, by the block's name; a Python worker keeps that of its last block."""
    if name not in _built:
        _built.clear()
        _built[name] = Matcher(block.value)
    return _built[name]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of bounded size, one partition after another on the driver."""
    block, held = [], 0
    for row in benchmark.select(item_col, text_col).toLocalIterator():
        size = len(row[1] or "") + 100
        if block and held + size > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += size
    if block:
        yield block


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """All rows of docs: id, the columns in ``keep``, and item_ids: sorted ids of the benchmark items found."""
    context = docs.sparkSession.sparkContext
    kind = benchmark.schema[item_col].dataType
    ids = T.ArrayType(kind)
    columns = [F.col(id_col), *[F.col(c) for c in keep if c != id_col]]
    scanned = docs.select(*columns, F.col(text_col).cast("string").alias("_scanned"))
    blocks = _blocks(benchmark, item_col, item_text_col)
    first, second = next(blocks, []), next(blocks, None)

    def scan(block, hits_only: bool):
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(name, block)
            for batch in batches:
                found = [matcher.find(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                if hits_only:
                    batch, found = batch.filter(pa.array([bool(x) for x in found], pa.bool_())), [x for x in found if x]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, to_arrow_type(ids))], [*batch.schema.names[:-1], "item_ids"])

        return run

    if second is None:
        return scanned.mapInArrow(scan(context.broadcast(first), False), T.StructType([*scanned.schema.fields[:-1], T.StructField("item_ids", ids)]))
    texts = docs.select(F.xxhash64(F.col(text_col).cast("string")).alias("_text_key"), F.col(text_col).cast("string").alias("_scanned"))
    schema = T.StructType([texts.schema.fields[0], T.StructField("item_ids", ids)])
    hits = None
    for block in (first, second, *blocks):
        shared = context.broadcast(block)
        some = cut_lineage(texts.mapInArrow(scan(shared, True), schema).distinct())
        shared.destroy()
        hits = some if hits is None else hits.union(some)
    found = hits.groupBy(F.col("_text_key").alias("_hit")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
    keyed = scanned.withColumn("_text_key", F.xxhash64("_scanned")).drop("_scanned").join(found, F.col("_text_key") == F.col("_hit"), "left").drop("_text_key", "_hit")
    return keyed.withColumn("item_ids", F.coalesce("item_ids", F.array().cast(ids)))


@shielded("id_col", "text_col")
def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents (all their columns) in which no benchmark item was found."""
    kept = find_items(docs, benchmark, id_col, text_col, keep=tuple(docs.columns)).where(F.size("item_ids") == 0)
    return kept.select(*docs.columns)


def query(spark, sf_dir):
    found = find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.size("item_ids") > 0).alias("contaminated"))
