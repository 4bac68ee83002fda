"""Merkle manifest of a dataset: one hash tree for each source, one over the sources, and a proof for each row.

A leaf is the SHA-256 of a row's fields. While a tree has more than one node, every ``ARITY`` consecutive ones become the
hash of their concatenated hex digests. The roots of the sources, in order, are the leaves of the crown, whose root
stands for the dataset.

1. Rows are numbered within their source without sorting a source in one task: they are dealt by ranges of (source, id,
   leaf), and a row's number is what the earlier ranges hold plus its place in its own range.
2. A block is ``WIDTH`` consecutive nodes, aligned to a power of the arity, so a run never crosses its edge. It keeps each
   level as one string of hex digests; fixed-width substrings of a level are hashed into the next one.
3. Roots of blocks are the nodes of the next round: a tree of n rows takes log(n) / log(WIDTH) rounds, each of n / WIDTH
   as many rows as the one before. Only the size of the largest tree reaches the driver.
4. Downwards, the substrings that flank a node on its level are the siblings of its run. A node's path is the siblings
   inside its block and then the path of its block, so a row's proof leads through its source's root to the crown.

Defined results: a null field hashes as ``-``, every other as its length in UTF-8 bytes, a colon and its text; so null and
empty differ. A null source comes first, an empty one next. Null ids come first in their source; rows of one id are
ordered by their leaves, and rows that repeat take adjoining places. Very long texts are hashed whole. An empty table has
no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read_table

ARITY, LEVELS = 3, 5
#: Nodes of a block.
WIDTH = ARITY**LEVELS
#: Hex characters of a digest.
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEPS = "array<struct<left:string,right:string>>"


def leaf_hash(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields, each with its length in bytes."""
    written = []
    for field in fields:
        text = field.cast("string")
        written.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*written), 256)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds n (the size of the row's tree) and at (its place there, from 0): nodes has tree and the columns of the order."""
    ranged = nodes.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "_row")
    ranged = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))
    by_tree = Window.partitionBy("t")
    sizes = ranged.groupBy(F.col("tree").alias("t"), F.col("_part").alias("p")).agg(F.count("*").alias("own"))
    sizes = sizes.withColumns({"n": F.sum("own").over(by_tree), "before": F.sum("own").over(by_tree.orderBy("p")) - F.col("own")})
    inside = F.row_number().over(Window.partitionBy("tree", "_part").orderBy(*order, "_row"))
    joined = ranged.join(sizes, (F.col("tree") == F.col("t")) & (F.col("_part") == F.col("p")))
    return joined.withColumn("at", F.col("before") + inside - 1).select(*nodes.columns, "n", "at")


def _above(level: Column) -> Column:
    """The next level's string of digests."""
    run = ARITY * DIGEST
    starts = F.sequence(F.lit(1), F.length(level), F.lit(run))
    return F.array_join(F.transform(starts, lambda start: F.sha2(F.substring(level, start, F.lit(run)), 256)), "")


def _blocks(nodes: DataFrame) -> DataFrame:
    """nodes: (tree, n, at, node, others). (tree, block, n, members, levels, root) of each block of neighbours."""
    payload = [c for c in nodes.columns if c not in ("tree", "n", "at")]
    block = F.floor(F.col("at") / WIDTH).alias("block")
    grouped = nodes.groupBy("tree", block).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", *payload))).alias("members"))
    # As many levels as its tree is still high, up to a block's own height.
    height = sum((F.when(F.col("n") > ARITY**k, 1).otherwise(0) for k in range(LEVELS)), F.lit(0))
    lowest = F.array(F.array_join(F.col("members.node"), ""))
    steps = F.slice(F.array(*[F.lit(k) for k in range(LEVELS)]), F.lit(1), height)
    levels = F.aggregate(steps, lowest, lambda found, _: F.concat(found, F.array(_above(F.element_at(found, -1)))))
    return grouped.withColumn("levels", levels).withColumn("root", F.element_at("levels", -1))


def _climb(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """The blocks of each round, up to that in which every tree is one block."""
    rounds = []
    while True:
        rounds.append(cut_lineage(_blocks(nodes)))
        if largest <= WIDTH:
            return rounds
        nodes = rounds[-1].select("tree", F.ceil(F.col("n") / WIDTH).alias("n"), F.col("block").alias("at"), F.col("root").alias("node"))
        largest = -(-largest // WIDTH)


def _siblings(levels: Column, place: Column) -> Column:
    """The siblings of a block's node on each level, left and right of the node's ancestor: flanks of its run."""
    widths = F.slice(F.array(*[F.lit(ARITY**k) for k in range(LEVELS)]), F.lit(1), F.size(levels) - 1)

    def flanks(width: Column, k: Column) -> Column:
        at = F.floor(place / width).cast("int")
        inside, level = at % ARITY, F.get(levels, k)
        left = F.substring(level, (at - inside) * DIGEST + 1, inside * DIGEST)
        right = F.substring(level, (at + 1) * DIGEST + 1, (ARITY - 1 - inside) * DIGEST)
        return F.struct(left.alias("left"), right.alias("right"))

    return F.transform(widths, flanks)


def _descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Members of the lowest blocks, each with its whole path. tops: (tree, path, carried) of each tree's root."""
    upper = tops.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        above = upper.select(F.col("tree").alias("t"), F.col("block").alias("b"), "path", "carried")
        known = blocks.join(above, (F.col("tree") == F.col("t")) & (F.col("block") == F.col("b")))
        rows = F.transform("members", lambda m, i: F.struct(m.alias("member"), F.concat(_siblings(F.col("levels"), i), F.col("path")).alias("path")))
        spread = known.select("tree", "carried", F.inline(rows))
        upper = spread.withColumn("block", F.col("member.at"))
    return upper.select("tree", "carried", "member", "path")


def fold(leaf: Column | str, path: Column | str) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, F.col(leaf) if isinstance(leaf, str) else leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def path_text(path: Column | str) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


@dataclass
class Manifest:
    """Hash trees of the sources and of the whole: blocks of every round, and (tree, source, subroot, root)."""

    rounds: list[DataFrame]
    crown: list[DataFrame]

    def proofs(self) -> DataFrame:
        """(source, id, leaf, kept, subroot, root, path): a row for each leaf; kept is what build was told to keep."""
        whole = self.crown[-1].select("tree", F.array().cast(_STEPS).alias("path"), F.col("root").alias("carried"))
        sources = _descend(self.crown, whole).select(
            F.col("member.name").alias("tree"), "path", F.struct(F.col("member.source").alias("source"), F.col("member.node").alias("subroot"), F.col("carried").alias("root")).alias("carried")
        )
        rows = _descend(self.rounds, sources)
        return rows.select("carried.source", "member.id", F.col("member.node").alias("leaf"), "member.kept", "carried.subroot", "carried.root", "path")

    def roots(self) -> DataFrame:
        """(source, subroot, root) of each source."""
        whole = self.crown[-1].select("tree", F.array().cast(_STEPS).alias("path"), F.col("root").alias("carried"))
        return _descend(self.crown, whole).select("member.source", F.col("member.node").alias("subroot"), F.col("carried").alias("root"))


def _largest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("n")).first()[0] or 0


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", keep: Column | None = None) -> Manifest:
    """Trees over the rows of docs; ``keep`` is an expression over docs that the proofs carry along."""
    source = F.col(source_col).cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("."), source), F.lit("")).alias("tree"), F.col(id_col).alias("id"), leaf_hash(*[F.col(f) for f in fields]).alias("node"),
        (F.lit(None).cast("string") if keep is None else keep).alias("kept"),
    )
    nodes = cut_lineage(numbered(leaves, ["id", "node"]))
    rounds = _climb(nodes, _largest(nodes))
    named = F.when(F.col("tree") == "", F.lit(None)).otherwise(F.expr("substring(tree, 2)"))
    tops = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), named.alias("source"), F.col("root").alias("node"))
    tops = cut_lineage(numbered(tops, ["name"]))
    return Manifest(rounds, _climb(tops, _largest(tops)))


def report(docs: DataFrame) -> DataFrame:
    """Proof digests of all rows, and whether each still leads to the root after the line breaks of half of them are lost."""
    fields = [F.col(f) for f in FIELDS]
    broken = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(broken, leaf_hash(*fields[:-1], F.translate("text", "\n", "")))
    proofs = build(docs, keep=tampered).proofs()
    checked = proofs.withColumn("folded_root", fold(F.coalesce("kept", "leaf"), "path"))
    return checked.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(path_text("path"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def query(spark, sf_dir):
    return report(read_table(spark, sf_dir, "documents"))


def _field_sql(expression: str) -> str:
    return f"CASE WHEN ({expression}) IS NULL THEN '-' ELSE strlen(({expression})::VARCHAR) || ':' || ({expression})::VARCHAR END"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_field_sql(f) for f in (*FIELDS[:-1], text))})"


#: CRC-32 goes bit by bit over the decimal id; the polynomial and its start are fixed by the standard.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 8 * strlen(doc_id::VARCHAR)), lambda i: ((ascii(substr(doc_id::VARCHAR, i // 8 + 1, 1)) >> (i % 8)::INT) & 1)::BIGINT)),
    lambda c, m: xor(c >> 1, (xor(c, m) & 1) * 3988292384::BIGINT)), 4294967295)"""


def _tree_sql(name: str, leaves: str) -> str:
    """Levels of all trees, runs of each level, from leaves (tree, pos, node, n)."""
    return f"""{name} AS (SELECT tree, 0 AS lv, pos, node, n FROM {leaves}
   UNION ALL SELECT tree, lv + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, lv, pos // 3),
 {name}_runs AS MATERIALIZED (SELECT tree, lv, pos // 3 AS run, string_agg(node, '' ORDER BY pos) AS s FROM {name} WHERE n > 1 GROUP BY tree, lv, pos // 3)"""


def _fold_sql(name: str, start: str, runs: str) -> str:
    left, right = "substr(s, 1, (pos % 3) * 64)", "substr(s, (pos % 3) * 64 + 65)"
    return f"""{name} AS (SELECT * FROM ({start})
   UNION ALL SELECT {name}.* REPLACE ({name}.lv + 1 AS lv, pos // 3 AS pos, sha256({left} || cur || {right}) AS cur, proof || {left} || {right} AS proof)
   FROM {name} JOIN {runs} r ON r.tree = {name}.tree AND r.lv = {name}.lv AND r.run = {name}.pos // 3)"""


ORACLE = f"""WITH RECURSIVE h AS MATERIALIZED (SELECT doc_id, coalesce('.' || source, '') AS tree, {_leaf_sql("text")} AS node,
   CASE WHEN {_CRC_SQL} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS tampered FROM documents),
 l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM h),
 {_tree_sql("up", "l")},
 c AS MATERIALIZED (SELECT '' AS tree, tree AS name, node, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
 {_tree_sql("cu", "c")},
 {_fold_sql("f", "SELECT doc_id, node AS leaf, tree, 0 AS lv, pos, coalesce(tampered, node) AS cur, '' AS proof FROM l", "up_runs")},
 e AS MATERIALIZED (SELECT doc_id, leaf, c.node AS subroot, '' AS tree, 0 AS lv, c.pos, cur, proof FROM f JOIN (SELECT tree, max(lv) AS lv FROM up GROUP BY tree) t ON t.tree = f.tree AND t.lv = f.lv
   JOIN c ON c.name = f.tree),
 {_fold_sql("g", "SELECT * FROM e", "cu_runs")}
 SELECT doc_id, leaf, subroot, w.node AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = w.node AS verified FROM g JOIN (SELECT lv, node FROM cu WHERE n = 1) w ON w.lv = g.lv"""
