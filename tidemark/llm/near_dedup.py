"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is a sequence of words; its k-mers are its windows of ``WINDOW`` words, each labelled with how many equal ones
came before it. Each of ``SKETCHES`` hash functions samples the ``SAMPLED`` least labelled k-mers and keeps them in
text order, so a sketch agrees only where both texts hold the same windows in the same order (edit similarity, where
plain MinHash only sees the set). Texts of up to ``SHORT`` words have as many sketches again of windows of
``SHORT_WINDOW`` words. Texts that agree in one sketch share a bucket. Those under 10 words, which may differ by one
edit, are found without chance: by the place and the rest of a replaced word, and by equality with a variant that lacks
one word. Copies are taken out beforehand: equal word sequences share one node.

1. All members of a bucket are compared with its leader, the one of the least key, and linked if similar.
2. A bucket of up to ``CROWD`` members that then still holds more than one component compares all pairs of different
   components; bounds from words and pairs (matrix products of clipped counts) spare most alignments.
3. A larger one is crowded by a passage that unrelated texts have in common. The members of all crowded buckets make one
   crowd. If it has no more than ``LEFT`` pairs of different components, each pair is compared once, however many buckets
   it shares: the crowd is dealt into tiles of about ``TILE`` texts of like length, and only tiles of lengths that similarity
   allows meet. A larger crowd is parted by its rarest pairs of words, each counted as often as it occurs: texts so similar
   share one at least among the first n - needed + 1 of either (`rarest`), and what only one component holds parts nothing.
   Members of parts that are still crowded make the next crowd, which is parted by the rarest words; parts that are crowded
   even then are compared one by one, dealt into blocks of ``BLOCK`` members. Only members that share a bucket are linked.

So nothing but the sketches decides by chance which pairs are met: every similar pair of different components that shares a
bucket is compared, however large the bucket, and sizes only decide how it is found. Unrelated texts with a common passage
cost about their number, as long as their rarest words differ. Candidates are verified by the edit distance of the word
sequences, from a banded bit-parallel alignment whose band is the number of edits allowed. Two texts are near-duplicates at
a similarity 1 - distance / length of the longer of ``SIMILARITY`` or more. Classes are the connected components of
verified links; they are found on the cluster.

Defined results: texts without a word (null, empty, white space) are each a class of their own. Texts of fewer than
``SHINGLE`` words only join equal ones. Very long texts are taken whole. Rows may repeat and ids be shared or null: rows
of equal words are one class, whose class_id is its least non-null id. An empty table gives no rows; other columns, of
whatever name, are ignored (``classify``) or returned (``keep_one``). Words and texts are compared by hashes of 64 bits
(words in the alignment by 32).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import read_table
from .components import components, hinted, merge_classes

SHINGLE = 5
WINDOW = 3
SKETCHES = 40
SHORT, SHORT_WINDOW = 50, 2
#: Longest texts of which similarity allows a single edit.
ONE_EDIT = 9
SAMPLED = 2
SIMILARITY = 0.8
CHUNK = 2 << 20
#: Members up to which a bucket compares all its pairs; pairs up to which a crowd compares all (some 0.1 microseconds each,
#: and what their bounds leave); members of a tile of these; members of a block of a crowded part; members of a bucket up to
#: which many are put in one task's table.
CROWD = 256
LEFT = 1 << 26
TILE = 256
BLOCK, PACKED = 128, 16
#: Two similar texts are at most two bands of length apart: a length is 1.25 times the other at most.
BANDS = 2 / np.log(1.2501)
#: Slots of the counts (4 bytes each) of windows by which crowded buckets are parted; they are broadcast.
MAX_BROADCAST_WINDOWS = 1_000_000
#: Nodes (8 bytes each) up to which they are broadcast to pick their texts; more of them are joined by a shuffle.
MAX_BROADCAST_NODES = 1_000_000
#: Buckets (24 bytes each) up to which they are broadcast to pick their entries, as most entries have a bucket of their own.
MAX_BROADCAST_BUCKETS = 1_000_000
#: Edits allowed from which a text's alignment is first tried greedily.
WIDE = 64
#: Bins and levels of the clipped counts of words and pairs.
BINS, LEVELS = 1024, 2

_U64 = np.uint64
_SEEDS = common.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64))
_SHORT_SEEDS = common.mix(np.arange(SKETCHES + 1, 2 * SKETCHES + 1, dtype=np.uint64))


def shingles(words: np.ndarray, firsts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``size`` words within one text, and the offset of each text's first window."""
    counts = np.maximum(np.diff(firsts) - size + 1, 0)
    starts = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(starts[-1]) - np.repeat(starts[:-1], counts) + np.repeat(firsts[:-1], counts)
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = out * _U64(0x100000001B3) + words[at + k]
    return common.mix(out), starts


def labelled(windows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Windows with their occurrence number within the text mixed in."""
    owner = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts))
    key = common.mix(windows + owner * _U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(key) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
    number = np.empty(len(key), np.uint64)
    number[order] = (np.arange(len(key)) - first).astype(np.uint64)
    return common.mix(windows ^ (number * _U64(0xC2B2AE3D27D4EB4F)))


def sketch(windows: np.ndarray, starts: np.ndarray, seeds: np.ndarray = _SEEDS, sampled: int = SAMPLED) -> np.ndarray:
    """Order MinHash keys: a row for each text with a window, a column for each sketch."""
    full = np.flatnonzero(np.diff(starts))
    heads, counts = starts[full], np.diff(starts)[full]
    out = np.zeros((len(full), len(seeds)), np.uint64)
    if not len(full):
        return out
    marked = labelled(windows, starts)
    rows = np.arange(len(full))
    for t, seed in enumerate(seeds):
        value = (marked ^ seed) * _U64(0xFF51AFD7ED558CCD)
        value ^= value >> _U64(33)
        places = np.full((len(full), sampled), np.iinfo(np.int64).max)
        for k in range(sampled):
            least = np.minimum.reduceat(value, heads)
            hit = np.flatnonzero(value == np.repeat(least, counts))
            row = np.searchsorted(heads, hit, side="right") - 1
            places[row[::-1], k] = hit[::-1]
            gone = counts <= k
            places[gone, k] = np.iinfo(np.int64).max
            value[hit] = np.iinfo(np.uint64).max
        places.sort(axis=1)
        key = np.full(len(full), seed)
        for k in range(sampled):
            there = places[:, k] < np.iinfo(np.int64).max
            key[there] = common.mix(key[there] * _U64(0x100000001B3) + marked[places[there, k]])
        out[rows, t] = key
    return out


def text_keys(words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """64-bit hash of each text's word sequence."""
    counts = np.diff(firsts)
    place = np.arange(len(words)) - np.repeat(firsts[:-1], counts)
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if full.any():
        weighted = words * common.powers(int(counts.max()), _U64(0xA0761D6478BD642F))[place]
        out[full] = np.add.reduceat(weighted, firsts[:-1][full])
    return common.mix(out + counts.astype(np.uint64))


def one_edit_keys(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of SHINGLE to ONE_EDIT words, for each word: the text, a key of the rest with the word's place (equal
    where two texts differ in that word), and the key of the text without the word (equal to that of a shorter text)."""
    counts = np.diff(firsts)
    owners, places, rests = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for n in range(SHINGLE, ONE_EDIT + 1):
        texts = np.flatnonzero(counts == n)
        table = words[firsts[:-1][texts][:, None] + np.arange(n)]
        for k in range(n) if len(texts) else ():
            variant = np.delete(table, k, axis=1)
            owners.append(texts)
            rests.append(text_keys(variant.ravel(), np.arange(len(texts) + 1) * (n - 1)))
            places.append(common.mix(rests[-1] ^ _U64(0xD1B54A32D192ED03 + k)))
    return np.concatenate(owners), np.concatenate(places), np.concatenate(rests)


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """Values as one list for each of n texts."""
    order = np.argsort(owner, kind="stable")
    bounds = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values[order].view(np.int64)))


def sketch_keys(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and keys of all sketches of the texts of SHINGLE words or more."""
    counts = np.diff(firsts)
    owners, keys = [], []
    for longest, size, seeds in ((len(words), WINDOW, _SEEDS), (SHORT, SHORT_WINDOW, _SHORT_SEEDS)):
        texts = (counts >= SHINGLE) & (counts <= longest)
        windows, starts = shingles(words[np.repeat(texts, counts)], np.concatenate(([0], np.cumsum(counts[texts]))), size)
        owners.append(np.repeat(np.flatnonzero(texts), len(seeds)))
        keys.append(sketch(windows, starts, seeds).ravel())
    return np.concatenate(owners), np.concatenate(keys)


def rarest(words: np.ndarray, firsts: np.ndarray, size: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and the first of their labelled windows of ``size`` words (1 or 2) in the order that all share: rare ones first.

    A longer text of n words shares n - size + 1 - size * limit windows at least with a similar one (an edit touches ``size``
    of them), and that bound only grows with n; so two similar texts share one of those returned.
    """
    windows, starts = shingles(words, firsts, size)
    marked = labelled(windows, starts)
    have = np.diff(starts)
    owner = np.repeat(np.arange(len(have)), have)
    order = np.lexsort((marked, counts[(marked % _U64(len(counts))).astype(np.int64)], owner))
    needed = np.maximum(1, np.ceil(np.diff(firsts) * (1 - size * (1 - SIMILARITY)) - (size - 1) - 1e-6)).astype(np.int64)
    wanted = np.maximum(0, have - needed + 1)
    place = np.arange(len(marked)) - np.repeat(starts[:-1], have)
    first = place < wanted[owner]
    return owner[first], marked[order[first]]


def candidate_keys(words: np.ndarray, firsts: np.ndarray) -> list[set[int]]:
    """For each text, the keys of which two near-duplicates are hoped to share one."""
    found: list[set[int]] = [{int(k)} for k in text_keys(words, firsts)]
    owner, places, rests = one_edit_keys(words, firsts)
    for who, keys in ((owner, places), (owner, rests), sketch_keys(words, firsts)):
        for k, key in zip(who.tolist(), keys.tolist()):
            found[k].add(key)
    return found


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, 0, CHUNK):
        words, _, _, firsts = common.words_of(*common.utf8(batch.column(0)))
        counts = np.diff(firsts)
        n = len(counts)
        owner, places, rests = one_edit_keys(words, firsts)
        lists = [_lists(*sketch_keys(words, firsts), n), _lists(owner, places, n), _lists(owner, rests, n)]
        node = pa.array(text_keys(words, firsts).view(np.int64))
        yield pa.RecordBatch.from_arrays([node, pa.array(counts.astype(np.int64)), *lists], ["node", "n_words", "keys", "places", "rests"]).filter(pa.array(counts >= SHINGLE))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, 1, CHUNK):
        words, _, _, firsts = common.words_of(*common.utf8(batch.column(1)))
        counts = np.diff(firsts)
        node = pa.array(text_keys(words, firsts).view(np.int64), mask=counts == 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), node, pa.array(counts.astype(np.int64))], ["id", "node", "n_words"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, 0, CHUNK):
        words, _, _, firsts = common.words_of(*common.utf8(batch.column(0)))
        small = (words >> _U64(32)).astype(np.uint32)
        node = text_keys(words, firsts).view(np.int64)
        rows = [small[a:b].tobytes() for a, b in zip(firsts, firsts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(rows, pa.binary())], ["node", "tokens"])


def banded_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edit distance of two sequences if at most limit, else limit + 1. Bit-parallel over a band of 2 limit + 1 rows."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return limit + 1
    n = len(b)
    same = a[:n] == b
    head = n if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    if len(b):
        same = a[len(a) - len(b) :][::-1] == b[::-1]
        tail = len(b) if same.all() else int(same.argmin())
        if tail:
            a, b = a[: len(a) - tail], b[: len(b) - tail]
    m, n = len(a), len(b)
    if not n or not limit:
        return m if m <= limit else limit + 1
    k = min(limit, m)
    masks: dict[int, int] = {}
    rows = a.tolist()
    values, at = np.unique(a, return_inverse=True)
    order = np.argsort(at, kind="stable")
    cuts = np.concatenate(([0], np.cumsum(np.bincount(at))))
    bits = np.zeros(m + 7, np.uint8)
    wanted = set(b.tolist())
    for j, value in enumerate(values.tolist()):
        if value in wanted:
            where = order[cuts[j] : cuts[j + 1]]
            if len(where) < 8:
                masks[value] = sum(1 << int(i) for i in where)
            else:
                bits[:] = 0
                bits[where] = 1
                masks[value] = int.from_bytes(np.packbits(bits[: m + (-m % 8)], bitorder="little").tobytes(), "little")
    del rows
    width = 2 * k + 1
    everything, bottom = (1 << width) - 1, 1 << (width - 1)
    plus, minus, score = ((1 << (k + 1)) - 1) << k, 0, k
    # Row m is met on the horizontal after the band's last row has passed it; only there can the score fall.
    worst = k + n - (m - k)
    for j, value in enumerate(b.tolist(), 1):
        mask = masks.get(value, 0)
        shift = j - k - 1
        match = (mask >> shift if shift >= 0 else mask << -shift) & everything
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & everything
        up = (minus | ~(diagonal | plus)) & everything
        down = diagonal & plus
        if j <= m - k:
            score += not diagonal & bottom
        else:
            row = 1 << (m - j + k)
            score += bool(up & row) - bool(down & row)
        if score > worst:
            return limit + 1
        plus = (down | ~((diagonal >> 1) | up)) & everything
        minus = (diagonal >> 1) & up
    return score if score <= limit else limit + 1


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the multiset intersection."""
    x, y = np.sort(a), np.sort(b)
    # The k-th copy of a value in one meets the k-th in the other: counts of equal values, the lesser of both.
    low, high = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
    first = np.searchsorted(x, x, "left")
    return int((np.arange(len(x)) - first < high - low).sum())


def pairs_of(a: np.ndarray) -> np.ndarray:
    return (a[:-1].astype(np.uint64) << _U64(32)) | a[1:]


def greedy_distance(a: np.ndarray, b: np.ndarray, limit: int, look: int = 8) -> int:
    """Cost of one way to turn a into b, stepping over differences by what lets the next words agree; no less than the
    edit distance, and given up above limit."""
    i = j = cost = 0
    while i < len(a) and j < len(b) and cost <= limit:
        n = min(len(a) - i, len(b) - j, 256)
        differs = a[i : i + n] != b[j : j + n]
        k = int(differs.argmax()) if differs.any() else n
        i, j = i + k, j + k
        if k < n:
            best = None
            for x, y in ((1, 1), (1, 0), (0, 1)):
                m = min(len(a) - i - x, len(b) - j - y, look)
                agree = int((a[i + x : i + x + m] == b[j + y : j + y + m]).sum()) if m > 0 else 0
                if best is None or agree > best[0]:
                    best = (agree, x, y)
            i, j, cost = i + best[1], j + best[2], cost + 1
    return cost + max(len(a) - i, len(b) - j)


def similar(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> bool:
    """Whether the edit distance allows the similarity; bounds from either side spare most alignments."""
    longer = max(len(a), len(b))
    limit = int((1 - threshold) * longer + 1e-9)
    # An edit touches one word, and two adjacent pairs at most.
    if abs(len(a) - len(b)) > limit or longer - limit > shared(a, b):
        return False
    if longer - 1 - 2 * limit > shared(pairs_of(a), pairs_of(b)):
        return False
    # A wide band costs more than to step from difference to difference.
    return (limit > WIDE and greedy_distance(a, b, limit) <= limit) or banded_distance(a, b, limit) <= limit


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(common.slices(batches, 2, CHUNK), 3, CHUNK):
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        kept = pa.array([similar(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(left, right)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(kept)


def _profiles(values: list[np.ndarray]) -> np.ndarray:
    """A row for each text: its words or pairs counted by hash, each count as LEVELS ones and zeros."""
    owner = np.repeat(np.arange(len(values)), [len(v) for v in values])
    bins = (common.mix(np.concatenate(values).astype(np.uint64)) % _U64(BINS)).astype(np.int64)
    counts = np.bincount(owner * BINS + bins, minlength=len(values) * BINS).reshape(-1, BINS)
    return np.concatenate([counts > k for k in range(LEVELS)], axis=1).astype(np.float32)


def possible(a: list[np.ndarray], b: list[np.ndarray], threshold: float = SIMILARITY) -> np.ndarray:
    """Which texts of a may be similar to which of b. Sums and clips only bring profiles closer, so none is lost."""
    la, lb = (np.array([len(t) for t in x])[:, None] for x in (a, b))
    lb = lb.T
    longer = np.maximum(la, lb)
    limit = np.floor((1 - threshold) * longer + 1e-9)
    may = np.abs(la - lb) <= limit
    for values, touched in ((lambda t: t, 1), (pairs_of, 2)):
        left, right = (_profiles([values(t) for t in x]) for x in (a, b))
        apart = left.sum(axis=1)[:, None] + right.sum(axis=1)[None, :] - 2 * (left @ right.T)
        least = longer - (touched - 1) - touched * limit
        may &= apart <= la + lb - 2 * (touched - 1) - 2 * least
    return may


def _crossed(table: pa.Table) -> pa.Table:
    """Links of different components between two blocks of a bucket (or within one, or within each of several small
    buckets). One link joins two components. Members with marks are only linked if they share one."""
    keys, nodes, labels, block = (table.column(c).to_numpy() for c in ("key", "node", "label", "block"))
    marks = [set(m) for m in table.column("marks").to_pylist()] if "marks" in table.column_names else None
    x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
    tokens = [np.frombuffer(t, np.uint32) for t in table.column("tokens").to_pylist()]
    first, second = np.flatnonzero(block == x), np.flatnonzero(block == y)
    found: tuple[list[int], list[int]] = [], []
    if len(first) and len(second):
        open_pairs = possible([tokens[i] for i in first], [tokens[j] for j in second]) & (labels[first][:, None] != labels[second][None, :])
        open_pairs &= keys[first][:, None] == keys[second][None, :]
        if x == y:
            open_pairs = np.triu(open_pairs, 1)
        above: dict[int, int] = {}

        def root(label: int) -> int:
            while label in above:
                label = above[label]
            return label

        for i, j in zip(*(at.tolist() for at in np.nonzero(open_pairs))):
            i, j = first[i], second[j]
            a, b = root(int(labels[i])), root(int(labels[j]))
            if a != b and (marks is None or not marks[i].isdisjoint(marks[j])) and similar(tokens[i], tokens[j]):
                above[a] = b
                found[0].append(int(nodes[i]))
                found[1].append(int(nodes[j]))
    return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})


def _words(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = [np.frombuffer(t, np.uint32).astype(np.uint64) for t in tokens.to_pylist()]
    return np.concatenate([*texts, np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def _counted(size: int, slots: int):
    """How many labelled windows of tokens (column 1) each slot holds, and the least and greatest component (column 2) of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1, CHUNK):
            windows, starts = shingles(*_words(batch.column(1)), size)
            if not len(windows):
                continue
            slot = (labelled(windows, starts) % _U64(slots)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            held, first, n = np.unique(slot[order], return_index=True, return_counts=True)
            label = np.repeat(batch.column(2).to_numpy(), np.diff(starts))[order]
            ends = [np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (held, n, *ends)], ["slot", "n", "low", "high"])

    return count


def _rarest(size: int, counts):
    """Rarest windows of tokens (column 1) but for those of slots with count 0, which only one component holds."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1, CHUNK):
            owner, windows = rarest(*_words(batch.column(1)), size, counts.value)
            met = counts.value[(windows % _U64(len(counts.value))).astype(np.int64)] > 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _lists(owner[met], windows[met], batch.num_rows)], ["node", "label", "windows"])

    return scan


def _met(entries: DataFrame) -> DataFrame:
    """entries: (key, node). (key, node, n, low) of the buckets with two members at least; low is the least node.

    The buckets are written first: a join that reads two plain shuffles can split a bucket that holds most texts.
    """
    buckets = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low")).where(F.col("n") > 1)
    buckets = common.cut_lineage(buckets.withColumnRenamed("key", "k"))
    return common.cut_lineage(entries.join(hinted(buckets, MAX_BROADCAST_BUCKETS), F.col("key") == F.col("k")).select("key", "node", "n", "low"))


def _paired(one: str, other: str) -> list:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _leaders(met: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket with the bucket's leader."""
    return met.where(F.col("node") != F.col("low")).select(*_paired("node", "low"))


def _one_edit(nodes: DataFrame) -> DataFrame:
    """(a, b) of short texts: one word replaced (all that share its place and the rest are similar, so the least leads),
    or one word more."""
    replaced = nodes.select("node", F.explode("places").alias("key"))
    first = common.cut_lineage(replaced.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where(F.col("n") > 1).select(F.col("key").alias("k"), "leader"))
    swaps = replaced.join(hinted(first), F.col("key") == F.col("k")).where(F.col("node") != F.col("leader")).select(*_paired("node", "leader"))
    longer = nodes.select(F.col("node").alias("long"), F.explode("rests").alias("rest"))
    return swaps.union(longer.join(nodes.where(F.col("n_words") < ONE_EDIT).select("node"), F.col("rest") == F.col("node")).select(*_paired("node", "long")))


def _only(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Texts (with node) of the distinct nodes in the only column of ``nodes``."""
    need = common.cut_lineage(nodes.toDF("need").distinct())
    return texts.join(F.broadcast(need) if need.count() <= MAX_BROADCAST_NODES else need, F.col("node") == F.col("need"), "left_semi")


def _links(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    sides = [tokens.select(F.col("node").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}")) for x in "ab"]
    checked = pairs.join(sides[0], F.col("a") == F.col("n_a")).join(sides[1], F.col("b") == F.col("n_b")).select("a", "b", "t_a", "t_b")
    return checked.mapInArrow(_verified, "a bigint, b bigint")


def _with_labels(table: DataFrame, classes: DataFrame) -> DataFrame:
    known = hinted(classes).select(F.col("node").alias("c"), F.col("label").alias("l"))
    return table.join(known, F.col("node") == F.col("c"), "left").withColumn("label", F.coalesce("l", "node")).drop("c", "l")


def _open_buckets(members: DataFrame) -> DataFrame:
    """members: (key, node, label). (k, main, n_rest, n_main) of buckets with several components, each set once."""
    parts = members.groupBy("key", "label").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("mark"), F.min("node").alias("low"), F.max("node").alias("high"))
    whole = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("main"), F.bit_xor("mark").alias("mark"), F.min("low").alias("low"), F.max("high").alias("high"))
    once = whole.where(F.col("parts") > 1).groupBy("n", "mark", "low", "high").agg(F.min(F.struct("key", "main")).alias("one"))
    return once.select(F.col("one.key").alias("k"), F.col("one.main.label").alias("main"), (F.col("n") - F.col("one.main.n")).alias("n_rest"), F.col("one.main.n").alias("n_main"))


def _within_buckets(members: DataFrame, buckets: DataFrame, tokens: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Links between components that share a bucket: the largest component's members only meet the others. marks: (node,
    marks); members are only linked if they share one."""
    packed = F.col("n_rest") + F.col("n_main") <= PACKED
    packs = 1 + (buckets.agg(F.sum(F.when(packed, F.col("n_rest") + F.col("n_main")))).first()[0] or 0) // (2 * BLOCK)
    small = F.col("n_rest") + F.col("n_main") <= CROWD
    n_rest = F.when(small, 1).otherwise(F.ceil(F.col("n_rest") / BLOCK))
    n_main = F.when(small, 0).otherwise(F.ceil(F.col("n_main") / BLOCK))
    apart = ~small & (F.col("label") == F.col("main"))
    dealt = members.join(hinted(buckets), F.col("key") == F.col("k")).withColumns({"rest_blocks": n_rest, "main_blocks": n_main, "apart": apart, "table": F.when(packed, F.pmod(F.xxhash64("key"), F.lit(packs))).otherwise(F.col("key"))})
    spot = F.xxhash64("node", "key")
    dealt = dealt.withColumn("block", F.when(F.col("apart"), F.col("rest_blocks") + F.pmod(spot, F.col("main_blocks"))).otherwise(F.pmod(spot, F.col("rest_blocks"))))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("apart"), F.col("rest_blocks")).otherwise(F.col("rest_blocks") + F.col("main_blocks")) - 1)
    dealt = common.cut_lineage(dealt)
    sides = _only(tokens, dealt.select("node")).select(F.col("node").alias("t"), "tokens")
    if marks is not None:
        sides = sides.join(marks.select(F.col("node").alias("m"), "marks"), F.col("t") == F.col("m")).drop("m")
    rows = dealt.select("table", "key", "node", "label", "block", F.explode(others).alias("other")).select("table", "key", "node", "label", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    return rows.join(sides, F.col("node") == F.col("t")).drop("t").groupBy("table", "x", "y").applyInArrow(_crossed, "a bigint, b bigint")


def _crowd(members: DataFrame, crowded: DataFrame, marks: DataFrame | None) -> DataFrame:
    """(node, label, marks): members of crowded buckets, each once. Without marks given, these are the crowded buckets' keys."""
    crowd = members.join(hinted(crowded.select("k")), F.col("key") == F.col("k"), "left_semi").groupBy("node", "label").agg(F.collect_set("key").alias("marks"))
    return common.cut_lineage(crowd if marks is None else crowd.drop("marks").join(marks, "node"))


def _whole(crowd: DataFrame, main: int, tokens: DataFrame) -> DataFrame:
    """Links between components of a crowd, each pair met once. Tiles hold texts of one band of length, and either members of
    the largest component (main) or others; the former only meet the others. Numbers of texts by band reach the driver."""
    names = [F.col(c).alias(f"c_{c}") for c in ("node", "label", "marks")]
    texts = tokens.join(hinted(crowd).select(*names), F.col("node") == F.col("c_node")).select("node", F.col("c_label").alias("label"), F.col("c_marks").alias("marks"), "tokens")
    band = F.floor(F.log(F.octet_length("tokens") / 4) * F.lit(float(BANDS)))
    texts = common.cut_lineage(texts.withColumns({"band": band, "apart": F.col("label") == main}))
    sizes = sorted((r["band"], r["apart"], -(-r["n"] // TILE)) for r in texts.groupBy("band", "apart").agg(F.count("*").alias("n")).collect())
    tiles = [(band, apart) for band, apart, n in sizes for _ in range(n)]
    firsts = {(band, apart): tiles.index((band, apart)) for band, apart, _ in sizes}
    met = [(x, y) for x, (low, main_x) in enumerate(tiles) for y, (high, main_y) in enumerate(tiles[x:], x) if high - low <= 2 and not (main_x and main_y)]
    spark = crowd.sparkSession
    dealt = spark.createDataFrame([(band, apart, firsts[band, apart], n) for band, apart, n in sizes], "t_band long, t_apart boolean, first long, n long")
    meets = spark.createDataFrame([(t, x, y) for x, y in met for t in {x, y}], "tile long, x long, y long")
    rows = texts.join(F.broadcast(dealt), (F.col("band") == F.col("t_band")) & (F.col("apart") == F.col("t_apart")))
    rows = rows.select(F.lit(0).alias("key"), "node", "label", "marks", "tokens", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("n"))).alias("block"))
    return rows.join(F.broadcast(meets), F.col("block") == F.col("tile")).drop("tile").groupBy("x", "y").applyInArrow(_crossed, "a bigint, b bigint")


def _parted(crowd: DataFrame, tokens: DataFrame, size: int) -> DataFrame:
    """(key, node, label): members of a crowd by each of their rarest windows of ``size`` words that another component may hold.

    Counts of windows by slot, at most MAX_BROADCAST_WINDOWS of them, reach the driver.
    """
    labels = hinted(crowd).select(F.col("node").alias("c"), "label")
    texts = common.cut_lineage(tokens.join(labels, F.col("node") == F.col("c")).select("node", "tokens", "label"))
    counts = np.zeros(max(1, MAX_BROADCAST_WINDOWS), np.int32)
    slots = texts.mapInArrow(_counted(size, len(counts)), "slot bigint, n bigint, low bigint, high bigint").groupBy("slot").agg(F.least(F.sum("n"), F.lit(1 << 30)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    held = slots.where(F.col("low") != F.col("high")).select("slot", "n").toArrow()
    counts[held.column("slot").to_numpy()] = held.column("n").to_numpy()
    windows = texts.mapInArrow(_rarest(size, crowd.sparkSession.sparkContext.broadcast(counts)), "node bigint, label bigint, windows array<bigint>")
    return windows.select(F.explode("windows").alias("key"), "node", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows has id, node, n_words of each document; classes has node, label of every linked node."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    lists = ", ".join(f"{c} array<bigint>" for c in ("keys", "places", "rests"))
    nodes = common.cut_lineage(texts.select("text").mapInArrow(_sketched, f"node bigint, n_words bigint, {lists}").dropDuplicates(["node"]))
    met = _met(nodes.select(F.explode(F.array_distinct("keys")).alias("key"), "node"))
    pairs = common.cut_lineage(_leaders(met).union(_one_edit(nodes)).distinct())
    tokens = _only(texts.select("text").mapInArrow(_tokens, "node bigint, tokens binary"), pairs.select(F.explode(F.array("a", "b"))))
    tokens = common.cut_lineage(tokens.dropDuplicates(["node"]))
    classes = common.cut_lineage(components(common.cut_lineage(_links(pairs, tokens))))
    # Two members are compared as leader and member already.
    members, marks = common.cut_lineage(_with_labels(met.where(F.col("n") > 2).select("key", "node"), classes)), None
    in_crowd = F.col("n_rest") + F.col("n_main") > CROWD
    for size in (2, 1, 0):  # of the windows that part a crowd; sizes decide which way its pairs are found, not which
        buckets = common.cut_lineage(_open_buckets(members))
        crowd = _crowd(members, buckets.where(in_crowd), marks)
        sizes = crowd.groupBy("label").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("main")).first()
        n, n_main, main = (sizes["n"], sizes["main"]["n"], sizes["main"]["label"]) if sizes["n"] else (0, 0, 0)
        few = (n - n_main) * (n + n_main) // 2 <= LEFT
        last = few or not size
        links = _within_buckets(members, buckets.where(~in_crowd), tokens, marks)
        if n and last:
            links = links.union(_whole(crowd, main, tokens) if few else _within_buckets(members, buckets.where(in_crowd), tokens, marks))
        links = common.cut_lineage(links)
        if not links.isEmpty():
            classes = merge_classes(classes, links)
        if last:
            break
        marks = crowd.select("node", "marks") if marks is None else marks
        members = common.cut_lineage(_parted(common.cut_lineage(_with_labels(crowd, classes)), tokens, size))
    return texts.mapInArrow(_named, f"id {texts.schema['id'].dataType.simpleString()}, node bigint, n_words bigint"), classes


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id (least id of its class), class_size, is_first."""
    rows, classes = near_duplicates(docs, id_col, text_col)
    labelled_nodes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("n")).join(classes.withColumnRenamed("node", "c"), F.col("node") == F.col("c"), "left").withColumn("label", F.coalesce("label", "node"))
    totals = labelled_nodes.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    named = labelled_nodes.select("node", "label").join(totals.withColumnRenamed("label", "l"), F.col("label") == F.col("l")).select(F.col("node").alias("n"), "class_id", "class_size")
    return rows.join(named, F.col("node") == F.col("n"), "left").select(
        F.col("id").alias(id_col), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), "n_words"
    )


@common.shielded("id_col", "text_col")
def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with all their columns, one of each class: that of the least id (one row of it, should rows repeat)."""
    rows, classes = near_duplicates(docs, id_col, text_col)
    best = (
        rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"))
        .join(classes.withColumnRenamed("node", "c"), F.col("node") == F.col("c"), "left")
        .groupBy(F.coalesce("label", "node").alias("label")).agg(F.min(F.struct("first", "node")).alias("best"))
        .select(F.col("best.node").alias("_keep_node"), F.col("best.first.id").alias("_keep_id"))
    )

    column = docs.columns.index(text_col)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, column, CHUNK):
            words, _, _, firsts = common.words_of(*common.utf8(batch.column(column)))
            node = pa.array(text_keys(words, firsts).view(np.int64), mask=np.diff(firsts) == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, node], [*batch.schema.names, "_node"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    with_node = docs.mapInArrow(named, f"{columns}, _node bigint")
    chosen = with_node.join(best, (F.col("_node") == F.col("_keep_node")) & F.col(id_col).eqNullSafe(F.col("_keep_id"))).dropDuplicates(["_node"])
    return chosen.select(*docs.columns).union(with_node.where(F.col("_node").isNull()).select(*docs.columns))


def query(spark, sf_dir):
    return classify(read_table(spark, sf_dir, "documents"))
