"""Repeated passages by column-wise construction of a collection's Burrows-Wheeler order and common prefixes.

Removed is every byte covered by a string of ``SPAN`` bytes that also starts anywhere else in the collection.

Sequential column-wise construction over whole documents needs as many rounds as the longest document has bytes, each
over all documents. Here the collection is first cut so that each piece can be built by itself, without losing a match:

1. Segments. Each window of SPAN bytes picks its least-hashed k-gram (its anchor), so equal windows pick the same
   anchor at the same place. Consecutive windows with one anchor form a segment; each window lies in exactly one.
2. Equal segments are counted by (anchor, hash); what occurs twice is repeated as a whole. Only different segments
   that share an anchor need their text, one copy of each.
3. Columns. The segments of one anchor are aligned at it, and one symbol of each is put before its suffix per round,
   from the last column to the first: the new suffix order is the stable order by (symbol, old rank), and the common
   prefix of two neighbours is one more than the least one between their old ranks, or 0 for different symbols. A
   window is repeated where a neighbour's common prefix reaches SPAN. Many anchors are built at once, as blocks of one
   order. At most ``2 * SPAN`` rounds are needed whatever the length of the documents.

The segments reach a task in anchor order from the external sort of the shuffle, so it reads its collection from
sequential files and holds one block of ``BLOCK_BYTES`` at a time. Anchors with more than ``MAX_SEGMENTS`` different
segments (a passage pasted into millions of documents) would put one long block into one task; for them, the windows
of each segment are hashed and counted with map-side combining, which is exact as well and spreads over all tasks.

``n_passage_words`` is a mark beside the removal: how many words of the document lie in passages of ``PASSAGE`` words or
more that another document holds too. Such a passage can have fewer than SPAN bytes, so that nothing of it is removed.
It is found by the same anchors over words; the windows of what shares an anchor are counted by their hashes.

Defined results: a null text is empty; texts under SPAN bytes keep everything; equal rows are copies of each other, so
a text of SPAN bytes or more that occurs twice is removed whole. Ids may repeat or be null. Very long texts are taken
whole. An empty table gives no rows; other columns, of whatever name, are ignored. Strings are told apart by 64-bit
hashes of segments, windows (hot anchors, passages) and texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import cut_lineage, read_table

SPAN = 400
GRAM = 32
#: Words of a passage that marks the documents that share it, and of its anchors.
PASSAGE = 51
PASSAGE_GRAM = 8
MAX_SEGMENTS = 50_000
BLOCK_BYTES = 6 << 20
CHUNK = 1 << 20

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15)
_INVERSE = _U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = common.mix(np.arange(1, 257, dtype=np.uint64))


def gram_hashes(values: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` values (a power of two) from each position on, by doubling."""
    out, size = values, 1
    while size < gram:
        out = out[: len(out) - size] * common.mix(np.array([size], np.uint64))[0] + out[size:]
        size *= 2
    return common.mix(out)


class Hasher:
    """Polynomial hashes of any substrings of some values, from prefix sums."""

    def __init__(self, values: np.ndarray):
        self.back = common.powers(len(values) + 1, _INVERSE)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * common.powers(len(values), _BASE)[: len(values)], dtype=np.uint64)))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return common.mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64) * _BASE)


def segments(values: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Segments of all texts: owner, start and length in the text, place of the anchor in the segment, anchor, hash.

    values has a 64-bit hash of each symbol (byte or word).
    """
    window = span - gram + 1
    lengths = np.diff(offsets)
    counts = np.maximum(lengths - span + 1, 0)
    total = int(counts.sum())
    if not total:
        empty = np.zeros(0, np.int64)
        return {k: empty for k in ("owner", "start", "length", "place", "anchor", "hash")}
    grams = gram_hashes(values, gram)
    # Hash above, position below: the least value is the leftmost of the least hashes.
    value = (grams >> _U64(32) << _U64(32)) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(value) // window) * window, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(value)] = value
    blocks = padded.reshape(-1, window)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    owner = np.repeat(np.arange(len(lengths)), counts)
    starts = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    least = np.minimum(suffix[starts], prefix[starts + window - 1])
    place = (least & _U64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [total])) - 1
    begin, end = starts[first], starts[last] + span
    return {
        "owner": owner[first], "start": begin - offsets[owner[first]], "length": end - begin, "place": place[first] - begin,
        "anchor": grams[place[first]].view(np.int64), "hash": Hasher(values).of(begin, end).view(np.int64),
    }


def _segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text with a segment; of each segment: start, length and place packed, anchor, hash."""
    for batch in common.slices(batches, 2, CHUNK):
        data, offsets = common.utf8(batch.column(2))
        found = segments(_BYTE[data], offsets)
        rows, firsts = np.unique(found["owner"], return_index=True)
        bounds = pa.array(np.concatenate((firsts, [len(found["owner"])])).astype(np.int32))
        packed = (found["start"] << 20) | ((found["length"] - SPAN) << 10) | found["place"]
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (packed, found["anchor"], found["hash"])]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), *lists], ["id", "tkey", "at", "anchor", "hash"])


def column_wise(data: np.ndarray, offsets: np.ndarray, place: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Repeated windows of the segments of several anchors.

    data and offsets hold the segments, place is the anchor's place in each, group ascends and numbers their anchors.
    Returns a row for each segment: at column w, whether the window that starts w bytes into the segment starts, at
    the same distance from the anchor, in another segment of the group too.
    """
    lengths = np.diff(offsets)
    n = len(lengths)
    left, right = int(place.max()), int((lengths - place).max())
    found = np.zeros((n, int((lengths - SPAN).max()) + 1), bool)
    order = np.arange(n)
    prefix = np.zeros(n + 1, np.int64)  # between the suffixes at rank r - 1 and r; 0 at both ends
    block = group.astype(np.int64) * 257
    for column in range(right - 1, -left - 1, -1):
        at = place + column
        symbol = np.zeros(n, np.int64)  # 0: the segment hasn't begun, its suffix is empty
        inside = (at >= 0) & (at < lengths)
        symbol[inside] = data[offsets[:-1][inside] + at[inside]].astype(np.int64) + 1
        key = (block + symbol)[order]
        moved = np.argsort(key, kind="stable")
        key = key[moved]
        low, high = moved[:-1], moved[1:]
        same = (key[1:] == key[:-1]) & (key[1:] % 257 != 0)
        grown = np.zeros(n - 1, np.int64)
        near = same & (high == low + 1)
        grown[near] = prefix[high[near]] + 1
        far = np.flatnonzero(same & (high != low + 1))
        if len(far):
            grown[far] = np.minimum.reduceat(prefix, np.stack((low[far] + 1, high[far] + 1), axis=1).ravel())[::2] + 1
        order = order[moved]
        prefix = np.concatenate(([0], grown, [0]))
        if column <= 0:
            twice = np.maximum(prefix[:-1], prefix[1:]) >= SPAN
            if twice.any():
                who = order[twice]
                found[who, place[who] + column] = True
    return found


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and last columns of the maximal runs of True in each row."""
    padded = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    padded[:, 1:-1] = flags
    step = np.diff(padded, axis=1)
    rows, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    return rows, first, last - 1


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in anchor order; blocks of whole anchors are built at once."""

    def build(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        anchor, digest = table["anchor"].to_numpy(), table["hash"].to_numpy()
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])))
        if not new.all():  # rows with one id and one text bring a segment twice
            table = table.filter(pa.array(new)).combine_chunks()
            anchor = table["anchor"].to_numpy()
        group = np.concatenate(([0], np.cumsum(anchor[1:] != anchor[:-1])))
        data, offsets = common.utf8(table["text"].chunk(0))
        rows, first, last = runs(column_wise(data, offsets, table["place"].to_numpy(), group))
        bounds = np.searchsorted(rows, np.arange(len(anchor) + 1)).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(first), pa.array(last)], ["first", "last"]))
        out = pa.RecordBatch.from_arrays([table["anchor"].chunk(0), table["hash"].chunk(0), spans], ["anchor", "hash", "runs"])
        return out.filter(pa.array(np.diff(bounds) > 0))

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        anchor = batch.column(0).to_numpy()
        ends = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        _, offsets = common.utf8(batch.column(3))
        # A block is closed where an anchor ends, once it is large enough.
        for end in [0, *ends.tolist()]:
            joins = end == 0 and held and held[-1].column(0)[-1].as_py() == int(anchor[0])
            if not joins and (held or end > start) and size + int(offsets[end] - offsets[start]) >= BLOCK_BYTES:
                if end > start:
                    held.append(batch.slice(start, end - start))
                yield build(held)
                held, size, start = [], 0, end
        if start < batch.num_rows:
            held.append(batch.slice(start))
            size += int(offsets[-1] - offsets[start])
    if held:
        yield build(held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, 3, CHUNK):
        data, offsets = common.utf8(batch.column(3))
        counts = np.diff(offsets) - SPAN + 1
        owner = np.repeat(np.arange(len(counts)), counts)
        first = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        at = first + offsets[:-1][owner]
        rows = pa.array(owner)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first), pa.array(Hasher(_BYTE[data]).of(at, at + SPAN).view(np.int64))], ["anchor", "hash", "at", "window"])


def _looked_up(texts: DataFrame, keyed: DataFrame, how: str = "inner") -> DataFrame:
    """Joins texts with a table by text key t (and id i, where copies of a text must not all answer).

    Both joins of the plan deal the texts out by the same key and read one shuffle of them. The ids are compared in a
    form that doesn't become a second key of the join.
    """
    on = F.col("tkey") == F.col("t")
    if "i" in keyed.columns:
        on = on & (F.xxhash64("id").bitwiseXOR(F.xxhash64("i")) == 0)
    return texts.join(keyed.hint("shuffle_hash"), on, how)


def repeated_runs(texts: DataFrame) -> DataFrame:
    """texts has id, tkey and text. Returns (t, spans): for each text key, (first, last) starts of repeated windows."""
    kind = texts.schema["id"].dataType.simpleString()
    cut = cut_lineage(texts.select("id", "tkey", "text").mapInArrow(_segmented, f"id {kind}, tkey bigint, at array<bigint>, anchor array<bigint>, hash array<bigint>"))
    each = cut.select("id", "tkey", F.inline(F.arrays_zip("at", "anchor", "hash")))
    # Only segments whose anchor occurs twice go on; most don't.
    twice = each.groupBy("anchor").agg(F.count("*").alias("c"), F.min("hash").alias("low"), F.max("hash").alias("high")).where(F.col("c") > 1)
    # Written first: a join that reads two plain shuffles can split an anchor that holds most rows.
    twice = cut_lineage(twice.select("anchor", (F.col("low") != F.col("high")).alias("mixed")))
    again = cut_lineage(each.join(twice, "anchor"))
    kinds = cut_lineage(again.groupBy("anchor", "hash").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("id", "tkey", "at", "mixed")]))
    whole = kinds.where(F.col("n") > 1).select("anchor", "hash", F.array(F.struct(F.lit(0).cast("long").alias("first"), F.shiftright("at", 10).bitwiseAND(1023).alias("last"))).alias("runs"))
    compared = kinds.where("mixed")
    hot_anchors = cut_lineage(compared.groupBy("anchor").agg(F.count("*").alias("different")).where(F.col("different") > MAX_SEGMENTS).select("anchor", F.lit(True).alias("hot")))
    marked = compared.join(hot_anchors, "anchor", "left")
    per_text = cut_lineage(marked.groupBy(F.col("id").alias("i"), F.col("tkey").alias("t")).agg(F.collect_list(F.struct("anchor", "hash", "at", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("picked")))
    pieces = (
        _looked_up(texts, per_text)
        .select(F.col("text").cast("binary").alias("bytes"), F.explode("picked").alias("p"))
        .select(
            "p.anchor", "p.hash", "p.hot", F.col("p.at").bitwiseAND(1023).alias("place"),
            F.substring("bytes", (F.shiftright("p.at", 20) + 1).cast("int"), (F.shiftright("p.at", 10).bitwiseAND(1023) + SPAN).cast("int")).alias("text"),
        )
    )
    found = whole
    columns = ["anchor", "hash", "place", "text"]
    if not hot_anchors.isEmpty():
        windows = pieces.where("hot").select(columns).mapInArrow(_windows, "anchor bigint, hash bigint, at bigint, window bigint")
        # A window of two different segments; equal rows of the input bring a segment twice.
        shared = windows.groupBy("window").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).where(F.col("low") != F.col("high")).select("window")
        hot = windows.join(shared, "window", "left_semi").groupBy("anchor", "hash").agg(F.collect_set(F.struct(F.col("at").alias("first"), F.col("at").alias("last"))).alias("runs"))
        found = found.union(hot)
    usual = pieces.where(~F.col("hot")).select(columns).repartition("anchor").sortWithinPartitions("anchor", "hash")
    built = usual.mapInArrow(_built, "anchor bigint, hash bigint, runs array<struct<first:bigint,last:bigint>>")
    found = found.union(built)
    placed = again.select("tkey", F.shiftright("at", 20).alias("start"), "anchor", "hash").join(found, ["anchor", "hash"]).select(
        "tkey", F.explode(F.transform("runs", lambda r: F.struct((F.col("start") + r["first"]).alias("first"), (F.col("start") + r["last"]).alias("last")))).alias("s")
    )
    # Copies of a text bring equal spans; sets are merged before the shuffle.
    return placed.groupBy(F.col("tkey").alias("t")).agg(F.collect_set("s").alias("spans"))


def _passage_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text of PASSAGE words or more: of each of its segments of words, start and length packed, anchor,
    hash."""
    for batch in common.slices(batches, 2, CHUNK):
        words, _, _, firsts = common.words_of(*common.utf8(batch.column(2)))
        found = segments(words, firsts, PASSAGE, PASSAGE_GRAM)
        rows, cuts = np.unique(found["owner"], return_index=True)
        bounds = pa.array(np.concatenate((cuts, [len(found["owner"])])).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in ((found["start"] << 10) | (found["length"] - PASSAGE), found["anchor"], found["hash"])]
        n_words = pa.array(np.diff(firsts)[rows].astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), n_words, *lists], ["id", "tkey", "n_words", "at", "anchor", "hash"])


def _passage_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows of PASSAGE words of the picked segments."""
    for batch in common.slices(batches, 0, CHUNK):
        words, _, _, firsts = common.words_of(*common.utf8(batch.column(0)))
        picked = batch.column(1)
        inside = picked.flatten()
        at = inside.field("at").to_numpy()
        owner = np.repeat(np.arange(batch.num_rows), picked.value_lengths().to_numpy())
        counts = (at & 1023) + 1
        segment = np.repeat(np.arange(len(at)), counts)
        first = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        start = first + (at >> 10)[segment] + firsts[:-1][owner[segment]]
        own = [inside.field(c).take(pa.array(segment)) for c in ("anchor", "hash", "low", "high")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(first), pa.array(Hasher(words).of(start, start + PASSAGE).view(np.int64))], ["anchor", "hash", "low", "high", "first", "window"])


def passages(texts: DataFrame) -> DataFrame:
    """texts has id, tkey and text. Returns (p, n_passage_words): words of each text key in passages that others hold."""
    kind = texts.schema["id"].dataType.simpleString()
    lists = ", ".join(f"{c} array<bigint>" for c in ("at", "anchor", "hash"))
    found = texts.select("id", "tkey", "text").mapInArrow(_passage_anchors, f"id {kind}, tkey bigint, n_words bigint, {lists}")
    found = cut_lineage(found.groupBy("tkey").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("id", "n_words", "at", "anchor", "hash")]))
    each = found.select("id", "tkey", F.inline(F.arrays_zip("at", "anchor", "hash")))
    others = F.min("tkey") != F.max("tkey")
    twice = each.groupBy("anchor").agg(others.alias("several"), (F.min("hash") != F.max("hash")).alias("mixed")).where("several")
    # Written first, so that the join can split an anchor that most texts have.
    again = cut_lineage(each.join(cut_lineage(twice.select("anchor", "mixed")), "anchor"))
    kinds = cut_lineage(again.groupBy("anchor", "hash", "mixed").agg(F.min("tkey").alias("low"), F.max("tkey").alias("high"), F.min(F.struct("tkey", "id", "at")).alias("one")))
    # Segments that two texts share are shared whole; those that differ but have one anchor are compared by windows.
    whole = kinds.where(F.col("low") != F.col("high")).select("anchor", "hash", F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("one.at").bitwiseAND(1023).alias("last"))).alias("runs"))
    per_text = kinds.where("mixed").groupBy(F.col("one.id").alias("i"), F.col("one.tkey").alias("t")).agg(F.collect_list(F.struct(F.col("one.at").alias("at"), "anchor", "hash", "low", "high")).alias("picked"))
    windows = cut_lineage(_looked_up(texts, cut_lineage(per_text)).select("text", "picked").mapInArrow(_passage_windows, "anchor bigint, hash bigint, low bigint, high bigint, first bigint, window bigint"))
    shared = cut_lineage(windows.groupBy("window").agg((F.min("low") != F.max("high")).alias("several")).where("several").select("window"))
    some = windows.join(shared, "window", "left_semi").groupBy("anchor", "hash").agg(F.collect_set(F.struct("first", F.col("first").alias("last"))).alias("runs"))
    start = F.shiftright("at", 10)
    placed = again.select("tkey", start.alias("start"), "anchor", "hash").join(whole.union(some), ["anchor", "hash"]).select(
        "tkey", F.explode(F.transform("runs", lambda r: F.struct((F.col("start") + r["first"]).alias("first"), (F.col("start") + r["last"]).alias("last")))).alias("run")
    )
    runs_of = placed.groupBy("tkey").agg(F.array_sort(F.collect_set("run")).alias("runs"))
    none = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(state, run):
        end = run["last"] + PASSAGE
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["n"] + F.greatest(end - F.greatest(state["end"], run["first"]), F.lit(0).cast("long"))).alias("n"))

    shared_words = runs_of.select(F.col("tkey").alias("s"), F.aggregate("runs", none, add, lambda state: state["n"]).alias("covered"))
    copies = found.select("tkey", "copies", "n_words").join(shared_words, F.col("tkey") == F.col("s"), "left")
    return copies.select(F.col("tkey").alias("p"), F.when(F.col("copies") > 1, F.col("n_words")).otherwise(F.coalesce("covered", F.lit(0))).alias("n_passage_words")).where(F.col("n_passage_words") > 0)


def covered(spans: list, size: int) -> list[tuple[int, int]]:
    """Maximal removed runs as (start, end)."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        end = min(last + SPAN, size)
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words; with texts also kept (bytes)
    and spans."""
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    picked = picked.select("id", F.xxhash64("text").alias("tkey"), "text")
    runs_of = repeated_runs(picked)
    marked = runs_of.join(passages(picked), F.col("t") == F.col("p"), "full").select(F.coalesce("t", "p").alias("t"), "spans", "n_passage_words")
    joined = _looked_up(picked, marked, "left").select("id", "text", "spans", F.coalesce("n_passage_words", F.lit(0).cast("long")).alias("n_passage_words"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1, CHUNK):
            rows = []
            for value, spans in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist()):
                gone = covered([(s["first"], s["last"]) for s in spans or ()], len(value))
                kept, at = [], 0
                for first, end in gone:
                    kept.append(value[at:first])
                    at = end
                kept.append(value[at:])
                rest = b"".join(kept)
                rows.append((len(value), len(value) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest, [{"start": a, "end": b} for a, b in gone]))
            columns = [batch.column(0), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], batch.column(3)]
            if texts:
                columns += [pa.array([r[4] for r in rows], pa.binary()), pa.array([r[5] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "kept", "spans"][: len(columns)])

    kind = picked.schema["id"].dataType.simpleString()
    more = ", kept binary, spans array<struct<start:bigint,end:bigint>>" if texts else ""
    return joined.mapInArrow(finish, f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage_words bigint{more}")


def query(spark, sf_dir):
    return remove_repeats(read_table(spark, sf_dir, "documents"))
