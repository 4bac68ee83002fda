"""Jaccard self-join of word n-grams: size-banded tiles, hashed bitmaps, exact intersections.

A text's set holds its distinct windows of ``WORDS`` words. Two sets are linked if the intersection is ``MATCH`` hundredths
of the union at least; equal sets are one node from the start.

1. Tiles. All sets order their windows alike, common ones last: by how many texts hold the window's bucket (one of
   ``BUCKETS``, counted over all texts), then by hash. Linked sets share a window among the first few of either, so each
   set enters the tiles of these windows only. A window's sets come in order of size, and each meets those of its size
   band: no larger ones can be linked. The places of the window in either order bound what both can have in common.
2. Bitmaps. Each window of a set flips one bit of its bitmap; the bits in which two bitmaps differ bound the intersection
   of their sets from above. Pairs that pass are verified by an exact intersection of their sorted windows: first each set
   with the partner that it meets most often, then what is left between different components.
3. Crowds. A tile where more than ``FEW`` pairs a row pass, or of more than ``CROWD`` rows, only compares its sets with
   their band's first one at once. Then it is cut into size bands; those of one component are done, and those with one
   largest component are put together. They are cut into blocks of ``BLOCK_WINDOWS`` windows, which take the sets along;
   members of the largest component only meet the others, and a link joins two components for good.

Nothing is left to chance: the result equals that of comparing all pairs. Windows and sets are compared by hashes of 64
bits.

Defined results: words are compared with A to Z lower-cased. A text of fewer than ``WORDS`` words has its whole sequence as
its only window. A text without a word (null, empty, white space) has an empty set, is linked with nothing and is its own
component. Very long texts are taken whole. Rows of one id are judged each; a component's id is its least non-null id; a
row without an id or a partner has none. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import read_table
from .components import between_labels, components, merge_classes
from .near_dedup import shingles, text_keys

WORDS = 4
#: Hundredths of the union that the intersection of linked sets has.
MATCH = 85
BUCKETS = 1 << 18
CHUNK = 2 << 20
#: Bits of a bitmap: a power of two above its band's sizes, within these bounds.
LEAST_BITS, MOST_BITS = 64, 4096
#: Windows (8 bytes each) of the members of a block; pairs looked at together.
BLOCK_WINDOWS, PAIRS = 1 << 20, 1 << 20
#: Pairs a row above which a tile is a crowd, and rows.
FEW, CROWD = 4, 4096
#: Partners that a copy of a set is compared with in one task.
PIECE = 4096
#: Rows of a key and up to four numbers up to which they are broadcast; more of them are joined by a shuffle.
MAX_BROADCAST_KEYS = 1_000_000

_U64 = np.uint64
_FOLD = np.arange(256)
_FOLD[ord("A") : ord("Z") + 1] += 32


def window_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of all texts, ascending within each, and where each text's begin."""
    words, _, _, firsts = common.words_of(data, offsets, _FOLD)
    counts = np.diff(firsts)
    windows, starts = shingles(words, firsts, WORDS)
    owner = np.repeat(np.arange(len(counts)), np.diff(starts))
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        windows = np.concatenate([windows, common.mix(text_keys(words, firsts)[short] + _U64(1))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((windows, owner))
    windows, owner = windows[order], owner[order]
    new = np.ones(len(windows), bool)
    new[1:] = (windows[1:] != windows[:-1]) | (owner[1:] != owner[:-1])
    return windows[new], np.searchsorted(owner[new], np.arange(len(counts) + 1))


def set_keys(windows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of each set."""
    out, full = np.zeros(len(starts) - 1, np.uint64), np.diff(starts) > 0
    if full.any():
        out[full] = np.add.reduceat(common.mix(windows), starts[:-1][full])
    return common.mix(out + np.diff(starts).astype(np.uint64))


def band_of(size: np.ndarray) -> np.ndarray:
    """Bands as wide as linked sets may differ in size."""
    return np.floor(np.log(np.maximum(size, 1)) / math.log(100 / MATCH) + 1e-9).astype(np.int64)


def bits_of(band: np.ndarray) -> np.ndarray:
    top = np.power(100 / MATCH, np.maximum(band, 0) + 1.0)
    return np.clip(2 ** np.ceil(np.log2(top)).astype(np.int64), LEAST_BITS, MOST_BITS)


def bitmaps(windows: np.ndarray, starts: np.ndarray, bits: np.ndarray) -> list[bytes]:
    """For each set, as many bits as told; every window flips one."""
    at = np.concatenate(([0], np.cumsum(bits)))
    place = np.repeat(at[:-1], np.diff(starts)) + (common.mix(windows ^ _U64(0x5851F42D4C957F2D)) & np.repeat(bits - 1, np.diff(starts)).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=at[-1]) & 1).astype(np.uint8))
    return [packed[a // 8 : b // 8].tobytes() for a, b in zip(at, at[1:])]


def prefixes(windows: np.ndarray, starts: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first windows of each set in the order that all sets share, and where each set's begin."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((windows, level[(windows & _U64(BUCKETS - 1)).astype(np.int64)], owner))
    sizes = np.diff(starts)
    # A set of n shares MATCH hundredths of its windows at least, so one of the first n minus that many plus one.
    wanted = np.where(sizes > 0, sizes - -(-MATCH * sizes // 100) + 1, 0)
    ends = np.concatenate(([0], np.cumsum(wanted)))
    at = np.arange(ends[-1]) - np.repeat(ends[:-1], wanted) + np.repeat(starts[:-1], wanted)
    return windows[order[at]], ends


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(BUCKETS, np.int64)
    for batch in common.slices(batches, 0, CHUNK):
        windows, _ = window_sets(*common.utf8(batch.column(0)))
        found += np.bincount((windows & _U64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    held = np.flatnonzero(found)
    for part in np.array_split(held, max(1, len(held) // 65536)):
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(found[part])], ["bucket", "n"])


def window_levels(texts: DataFrame) -> np.ndarray:
    """A level for each bucket of windows: quarters of the doublings of what it holds above the mean and its deviation.

    BUCKETS numbers reach the driver, whatever the size of the table.
    """
    counts = np.zeros(BUCKETS)
    for row in texts.select("text").mapInArrow(_counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["bucket"]] = row["n"]
    usual = counts.mean() + 4 * math.sqrt(counts.mean() + 1)
    return np.minimum(255, np.ceil(4 * np.log2(np.maximum(counts / usual, 1)))).astype(np.uint8)


def _described(levels):
    """(id, node, n, band, prefix, bitmap) of each text; node is null if it has no word."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1, CHUNK):
            windows, starts = window_sets(*common.utf8(batch.column(1)))
            sizes = np.diff(starts)
            first, ends = prefixes(windows, starts, levels.value)
            band = band_of(sizes)
            bitmap = pa.array(bitmaps(windows, starts, bits_of(band)), pa.binary())
            prefix = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(first.view(np.int64)))
            node = pa.array(set_keys(windows, starts).view(np.int64), mask=sizes == 0)
            columns = [batch.column(0), node, pa.array(sizes.astype(np.int32)), pa.array(band.astype(np.int32)), prefix, bitmap]
            yield pa.RecordBatch.from_arrays(columns, ["id", "node", "n", "band", "prefix", "bitmap"])

    return describe


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, 0, CHUNK):
        windows, starts = window_sets(*common.utf8(batch.column(0)))
        rows = [windows[a:b].tobytes() for a, b in zip(starts, starts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(set_keys(windows, starts).view(np.int64)), pa.array(rows, pa.binary())], ["node", "windows"])


def folded(bitmap: bytes, size: int) -> bytes:
    """A bitmap of as many bytes, from one of a multiple: windows of either half flip the bits of both."""
    bits = np.frombuffer(bitmap, np.uint8)
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0).tobytes() if len(bits) > size else bitmap


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(common_windows, n_a, n_b):
    return 100 * common_windows >= MATCH * (n_a + n_b - common_windows)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted stars: (a, piece, b, windows), the star's own set (b is null) before its partners."""
    star, own, before = None, None, None
    for batch in batches:
        a, piece, b, windows = (batch.column(c).to_pylist() for c in range(4))
        found: tuple[list[int], list[int]] = [], []
        for k in range(batch.num_rows):
            here = np.frombuffer(windows[k], np.uint64)
            if b[k] is None:
                star, own, before = (a[k], piece[k]), here, None
            elif b[k] != before and star == (a[k], piece[k]):
                before = b[k]
                if linked(intersection(own, here), len(own), len(here)):
                    found[0].append(a[k])
                    found[1].append(b[k])
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["a", "b"])


def joined_pairs(group: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i, j of one window that sizes and places allow to be linked, and the groups where too many of them are.

    Rows are sorted by group, size and node; groups are numbered from 0.
    """
    sizes = np.bincount(group)
    line = group * (int(n.max()) * 2 + 2)
    ends = np.searchsorted(line + n, line + 100 * n // MATCH, "right")
    count = ends - np.arange(len(n)) - 1
    total = np.cumsum(count)
    few, dense = np.zeros(len(sizes), np.int64), sizes > CROWD
    found: list[np.ndarray] = []
    at = 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        rows = np.arange(at, stop)
        rows = rows[~dense[group[rows]]]
        at = stop
        i = np.repeat(rows, count[rows])
        shift = np.cumsum(count[rows]) - count[rows]
        j = np.arange(len(i)) - np.repeat(shift, count[rows]) + i + 1
        keep = (100 + MATCH) * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= MATCH * (n[i] + n[j])
        found.append(np.stack([i[keep], j[keep]]))
        few += np.bincount(group[i[keep]], minlength=len(sizes))
        dense |= few > FEW * sizes
    pairs = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
    pairs = pairs[:, ~dense[group[pairs[0]]]]
    return pairs[0], pairs[1], np.flatnonzero(dense)


_FOUND = "a bigint, b bigint, times bigint, crowd bigint"


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries (window, n, node, pos), so sorted: pairs and how many windows they share here, or a crowd's window."""
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
    hot: tuple | None = None  # window, band and first node of the last row of a crowd
    hot_open = False  # whether the last batch ended in it

    def told(a: np.ndarray, b: np.ndarray, crowds: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            pairs, times = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(times), pa.nulls(len(times), pa.int64())], ["a", "b", "times", "crowd"])
        if len(crowds):
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(crowds), pa.int64())] * 3, pa.array(crowds)], ["a", "b", "times", "crowd"])

    def with_first(window: np.ndarray, n: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row of crowds with the first one of its band."""
        nonlocal hot
        band = band_of(n)
        new = np.ones(len(n), bool)
        new[1:] = (window[1:] != window[:-1]) | (band[1:] != band[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(n)), 0))
        leader = node[first]
        if hot and hot[:2] == (int(window[0]), int(band[0])):
            leader = np.where(first == 0, hot[2], leader)
        hot = int(window[-1]), int(band[-1]), int(leader[-1])
        return node[node != leader], leader[node != leader]

    def judge(window: np.ndarray, n: np.ndarray, node: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(n), bool)
        new[1:] = window[1:] != window[:-1]
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        if several.any():
            window, n, node, pos = window[several], n[several], node[several], pos[several]
            _, group = np.unique(group[several], return_inverse=True)
            i, j, dense = joined_pairs(group, node, n, pos)
            crowded = np.isin(group, dense)
            a, b = with_first(window[crowded], n[crowded], node[crowded]) if len(dense) else (node[:0], node[:0])
            yield from told(np.concatenate([node[i], a]), np.concatenate([node[j], b]), np.unique(window[crowded]))

    for batch in batches:
        rows = [np.concatenate([h, batch.column(c).to_numpy().astype(np.int64)]) for c, h in enumerate(held)]
        if not len(rows[0]):
            continue
        fresh = np.ones(len(rows[0]), bool)  # copies of a text enter a window once
        fresh[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[2][1:] != rows[2][:-1])
        rows = [r[fresh] for r in rows]
        if hot and int(rows[0][0]) == hot[0] and hot_open:
            more = rows[0] == rows[0][0]
            yield from told(*with_first(rows[0][more], rows[1][more], rows[2][more]), rows[0][:0])
            rows = [r[~more] for r in rows]
            if not len(rows[0]):
                held = [np.zeros(0, np.int64)] * 4
                continue
        hot_open = False
        same = rows[0] == rows[0][-1]
        last = 0 if same.all() else len(same) - int(same[::-1].argmin())
        if last:
            yield from judge(*[r[:last] for r in rows])
        held = [r[last:] for r in rows]
        if len(held[0]) > CROWD:
            hot, hot_open = None, True
            yield from told(*with_first(held[0], held[1], held[2]), held[0][:1])
            held = [np.zeros(0, np.int64)] * 4
    if len(held[0]):
        yield from judge(*held)


_MEMBER = ["key", "x", "y", "block", "node", "label", "n", "upper", "bitmap"]


def _crossed(table: pa.Table) -> pa.Table:
    """Links between components of two blocks of a tile (or within one). One link joins two components."""
    node, label, block, n = (table.column(c).to_numpy().astype(np.int64) for c in ("node", "label", "block", "n"))
    x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
    sets = [np.frombuffer(w, np.uint64) for w in table.column("windows").to_pylist()]
    raw = table.column("bitmap").to_pylist()
    bitmap = np.frombuffer(b"".join(folded(m, min(map(len, raw))) for m in raw), np.uint64).reshape(len(node), -1)
    upper = table.column("upper").to_numpy(zero_copy_only=False)
    first, second = np.flatnonzero(block == x), np.flatnonzero(block == y)
    _, root = np.unique(label, return_inverse=True)  # a joined component takes its partner's number, everywhere at once
    found: tuple[list[int], list[int]] = [], []
    for k, i in enumerate(first.tolist()):
        others = second[k + 1 :] if x == y else second
        both = n[i] + n[others]
        least = -(-MATCH * both // (100 + MATCH))
        may = (root[others] != root[i]) & ~(upper[i] & upper[others]) & (100 * np.minimum(n[i], n[others]) >= MATCH * np.maximum(n[i], n[others]))
        others, both, least = others[may], both[may], least[may]
        others = others[(both - np.bitwise_count(bitmap[i] ^ bitmap[others]).sum(axis=1).astype(np.int64)) // 2 >= least]
        for j in others.tolist():
            if root[j] != root[i] and linked(intersection(sets[i], sets[j]), len(sets[i]), len(sets[j])):
                root[root == root[j]] = root[i]
                found[0].append(int(node[i]))
                found[1].append(int(node[j]))
    return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})


def _hinted(table: DataFrame) -> DataFrame:
    """A written table of a key and few numbers, broadcast if it is small."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_KEYS else table


def _sets_of(need: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, windows) of the distinct nodes in the only column of ``need``; only texts of their least ids are read."""
    need = common.cut_lineage(nodes.select("node", "rep").join(need.toDF("m").distinct(), F.col("node") == F.col("m"), "left_semi"))
    need = _hinted(need)
    asked = texts.join(need.select("rep").distinct(), F.col("id").eqNullSafe(F.col("rep")), "left_semi")
    return asked.select("text").mapInArrow(_sets, "node bigint, windows binary").join(need.select(F.col("node").alias("m")), F.col("node") == F.col("m"), "left_semi")


def _links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs: (a, b), written. Those whose sets are linked: b's set is sent to a's, which has a copy for each piece."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b"))), nodes, texts)
    pieces = pairs.groupBy("a").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
    dealt = pairs.join(pieces.withColumnRenamed("a", "s"), F.col("a") == F.col("s")).select("a", F.pmod(F.xxhash64("b"), "pieces").alias("piece"), "b", F.col("b").alias("m"))
    stars = pieces.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.lit(None).cast("long").alias("b"), F.col("a").alias("m"))
    rows = sets.join(_hinted(common.cut_lineage(dealt.union(stars))), F.col("node") == F.col("m")).select("a", "piece", "b", "windows")
    return rows.repartition("a", "piece").sortWithinPartitions("a", "piece", F.col("b").asc_nulls_first()).mapInArrow(_verified, "a bigint, b bigint")


def _entries(described: DataFrame) -> DataFrame:
    return described.where(F.col("node").isNotNull()).select("node", "n", F.posexplode("prefix").alias("pos", "window")).select("window", "n", "node", "pos")


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose sizes and bitmaps allow a link."""
    for batch in batches:
        n_a, n_b = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3))
        least = -(-MATCH * (n_a + n_b) // (100 + MATCH))
        kept = []
        for x, y, total, needed in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), (n_a + n_b).tolist(), least.tolist()):
            size = min(len(x), len(y))
            differ = (int.from_bytes(folded(x, size), "little") ^ int.from_bytes(folded(y, size), "little")).bit_count()
            kept.append((total - differ) // 2 >= needed)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that bitmaps allow to be linked, written."""
    for s in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(f"m_{s}"), F.col("n").alias(f"n_{s}"), F.col("bitmap").alias(f"bits_{s}")), F.col(s) == F.col(f"m_{s}"))
    return common.cut_lineage(pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_bounded, "a bigint, b bigint"))


def _open_blocks(members: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """members: (window, n, node) of crowds. Sets of their size bands with several components, with the blocks x and y in which
    they meet others."""
    sides = F.explode(F.array(F.struct("band", F.lit(False).alias("upper")), F.struct((F.col("band") - 1).alias("band"), F.lit(True).alias("upper"))))
    known = nodes.select(F.col("node").alias("m"), "band").join(classes.select(F.col("node").alias("c"), "label"), F.col("m") == F.col("c"), "left").select("m", "band", F.coalesce("label", "m").alias("label"))
    tiles = members.join(known, F.col("node") == F.col("m")).select("window", "node", "label", "n", sides.alias("side"))
    tiles = common.cut_lineage(tiles.select(F.xxhash64("window", "side.band").alias("tile"), "side.band", "side.upper", "node", "label", "n"))
    parts = tiles.groupBy("tile", "label").agg(F.count("*").alias("k"), F.min("upper").alias("upper"))
    whole = parts.groupBy("tile").agg(F.count("*").alias("parts"), F.max_by("label", F.struct("k", "label")).alias("main"), F.min("upper").alias("upper"))
    whole = common.cut_lineage(whole.where((F.col("parts") > 1) & ~F.col("upper")).select(F.col("tile").alias("t"), "main"))
    # Tiles of one band and main component hold much the same sets, so they are judged as one, each set once.
    merged = tiles.join(_hinted(whole), F.col("tile") == F.col("t")).select(F.xxhash64("main", "band").alias("key"), "main", "upper", "node", "label", "n")
    merged = common.cut_lineage(merged.distinct())
    of_main = F.col("label") == F.col("main")
    sizes = merged.groupBy("key").agg(F.sum(F.when(~of_main, F.col("n")).otherwise(0)).alias("rest"), F.sum(F.when(of_main, F.col("n")).otherwise(0)).alias("others"))
    small = F.col("rest") + F.col("others") <= BLOCK_WINDOWS
    sizes = common.cut_lineage(sizes.select(
        F.col("key").alias("k"), (~small).alias("large"), F.when(small, 1).otherwise(F.ceil((F.col("rest") + 1) / BLOCK_WINDOWS)).alias("rest_blocks"), F.when(small, 0).otherwise(F.ceil(F.col("others") / BLOCK_WINDOWS)).alias("main_blocks"),
    ))
    dealt = merged.join(_hinted(sizes), F.col("key") == F.col("k")).withColumn("apart", F.col("large") & of_main)
    spot = F.xxhash64("node", "key")
    dealt = dealt.withColumn("block", F.when(F.col("apart"), F.col("rest_blocks") + F.pmod(spot, F.col("main_blocks"))).otherwise(F.pmod(spot, F.col("rest_blocks"))))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("apart"), F.col("rest_blocks")).otherwise(F.col("rest_blocks") + F.col("main_blocks")) - 1)
    dealt = dealt.join(nodes.select(F.col("node").alias("m"), "bitmap"), F.col("node") == F.col("m"))
    return dealt.withColumn("other", F.explode(others)).withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).select(*_MEMBER)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows has id, node, n of each document; classes has node, label of every linked node."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    levels = docs.sparkSession.sparkContext.broadcast(window_levels(texts))
    schema = f"id {texts.schema['id'].dataType.simpleString()}, node bigint, n int, band int, prefix array<bigint>, bitmap binary"
    described = common.cut_lineage(texts.mapInArrow(_described(levels), schema))
    nodes = common.cut_lineage(described.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "band", "bitmap")]))
    met = _entries(described).repartition("window").sortWithinPartitions("window", "n", "node").mapInArrow(_paired, _FOUND)
    met = common.cut_lineage(met.groupBy("a", "b", "crowd").agg(F.sum("times").alias("times")))
    pairs = met.where(F.col("crowd").isNull()).select("a", "b", "times")
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("one"), F.col("b").alias("other")), F.struct(F.col("b").alias("one"), F.col("a").alias("other")))).alias("p"), "times")
    best = both.groupBy("p.one").agg(F.max_by("p.other", F.struct("times", "p.other")).alias("other"))
    first = _possible(best.select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")).distinct(), nodes)
    classes = common.cut_lineage(components(common.cut_lineage(_links(first, nodes, texts))))
    rest = between_labels(pairs.select("a", "b").join(first.select(F.col("a").alias("fa"), F.col("b").alias("fb")), (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb")), "left_anti"), classes)
    links = common.cut_lineage(_links(_possible(rest.select("a", "b"), nodes), nodes, texts))
    if not links.isEmpty():
        classes = merge_classes(classes, links)
    crowds = common.cut_lineage(met.where(F.col("crowd").isNotNull()).select(F.col("crowd").alias("w")).distinct())
    if not crowds.isEmpty():
        members = _entries(described).join(_hinted(crowds), F.col("window") == F.col("w")).drop("w").dropDuplicates(["window", "node"])
        rows = common.cut_lineage(_open_blocks(members, classes, nodes))
        sets = common.cut_lineage(_sets_of(rows.select("node"), nodes, texts).dropDuplicates(["node"]).withColumnRenamed("node", "s"))
        links = rows.join(sets, F.col("node") == F.col("s")).drop("s").groupBy("key", "x", "y").applyInArrow(_crossed, "a bigint, b bigint")
        links = common.cut_lineage(links)
        if not links.isEmpty():
            classes = merge_classes(classes, links)
    return described.select("id", "node", F.col("n").cast("long").alias("n")), classes


def join_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, and the component's number of documents."""
    rows, classes = jaccard_classes(docs, id_col, text_col)
    label = lambda: F.coalesce("label", "node").alias("label")
    held = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("k")).join(classes.withColumnRenamed("node", "c"), F.col("node") == F.col("c"), "left")
    held = held.select("node", label(), "least", "k")
    totals = held.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("k").alias("component_size")).withColumnRenamed("label", "l")
    named = held.select("node", "label").join(totals, F.col("label") == F.col("l")).select(F.col("node").alias("m"), "component_id", "component_size")
    return rows.join(named, F.col("node") == F.col("m"), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("component_size", F.lit(1)).alias("component_size")
    )


def query(spark, sf_dir):
    return join_documents(read_table(spark, sf_dir, "documents"))


#: All pairs that share a window are counted, so this only suits small tables.
ORACLE = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{common.WORD_SQL}') AS ws FROM documents),
 s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {WORDS} THEN [array_to_string(ws, ' ')]
   ELSE list_distinct(list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' '))) END AS s FROM w),
 n AS MATERIALIZED (SELECT min(r) AS v, list_sort(s) AS key, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY key, n),
 t AS MATERIALIZED (SELECT v, n, unnest(key) AS g FROM n),
 e AS MATERIALIZED (SELECT a, b FROM (SELECT x.v AS a, y.v AS b, any_value(x.n) + any_value(y.n) AS total, count(*) AS m FROM t x JOIN t y ON x.g = y.g AND x.v < y.v GROUP BY x.v, y.v) WHERE 100 * m >= {MATCH} * (total - m)),
 e2 AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
 c AS (SELECT v, v AS reached FROM n UNION SELECT c.v, e2.b FROM c JOIN e2 ON c.reached = e2.a),
 l AS MATERIALIZED (SELECT v, min(reached) AS label FROM c GROUP BY v),
 m AS MATERIALIZED (SELECT s.r, s.doc_id, len(s.s) AS n, l.label FROM s LEFT JOIN n ON n.key = list_sort(s.s) AND len(s.s) > 0 LEFT JOIN l ON l.v = n.v)
 SELECT doc_id, n::BIGINT AS n_shingles, CASE WHEN label IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY label) END AS component_id,
   (CASE WHEN label IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY label) END)::BIGINT AS component_size FROM m"""
