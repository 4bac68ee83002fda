"""URL filter: a trie over reversed host labels and path segments, broadcast to the executors.

The longest matching rule (characters of host and path together) decides between allow and block entries; of two
rules of one length, block wins, then the one later in code-point order. A rule (host, path) fits its host and all subdomains if the url's path starts with
the rule's path. A url that no rule fits gets the default verdict.

Defined results: a null url, or one without ``://``, has empty host and path and can only meet a rule with empty host
and path. Repeated rows are judged alike. Extra columns are ignored. An empty table gives an empty result.

The trie is broadcast only while the rules stay under ``max_rule_bytes`` (their text and ``NODE_BYTES`` a rule for the
nodes of the trie); larger rule sets are matched by equi-joins on those suffixes of the url's host that have as many
labels as a rule's host, and on those prefixes of its path whose length occurs in a rule of that host. Very long hosts
and paths cost no more than the rules' own numbers of labels and lengths. Both ways give the same result. Rules are a
list on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table

#: (host, path, verdict) of the contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
MAX_RULE_BYTES = 64 << 20
NODE_BYTES = 600
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = str.maketrans(_UPPER, _UPPER.lower())

_PATHS, _RULES, _SIZES = "paths", "rules", "sizes"


def split_url(url: str | None) -> tuple[str, str]:
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    host = rest if slash < 0 else rest[:slash]
    return host.translate(_LOWER), "" if slash < 0 else rest[slash:]


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Nested dictionaries: host labels from the right; at a host node, a second trie over whole path segments.

    At a path node, ``rules`` maps the rest of the rule's path, a prefix of the url's next segment, to the decision, and
    ``sizes`` has the lengths of these. None stands for a rule with an empty path, which needs no segment at all.
    """
    root: dict = {"labels": {}, _PATHS: None}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node["labels"].setdefault(label, {"labels": {}, _PATHS: None})
        if node[_PATHS] is None:
            node[_PATHS] = {"segments": {}, _RULES: {}, _SIZES: set()}
        spot, rest = node[_PATHS], None
        if path:
            *whole, rest = path.split("/")
            for segment in whole:
                spot = spot["segments"].setdefault(segment, {"segments": {}, _RULES: {}, _SIZES: set()})
        weight = (len(host) + len(path), verdict == "block", host + path)
        if rest is not None:
            spot[_SIZES].add(len(rest))
        if rest not in spot[_RULES] or spot[_RULES][rest][0] < weight:
            spot[_RULES][rest] = (weight, host + path, verdict)
    return root


def match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits, or None."""
    best = None
    parts = path.split("/") if path else []
    node, labels = trie, list(reversed(host.split("."))) if host else []
    for depth in range(len(labels) + 1):
        spot = node[_PATHS]
        for at in range(len(parts) + 1):
            if spot is None:
                break
            segment = parts[at] if at < len(parts) else None
            for rest in (None, *(segment[:n] for n in spot[_SIZES] if n <= len(segment))) if segment is not None else (None,):
                found = spot[_RULES].get(rest)
                if found and (best is None or best[0] < found[0]):
                    best = found
            if at == len(parts) - 1:  # the last segment isn't followed by a slash
                break
            spot = spot["segments"].get(parts[at]) if at < len(parts) else None
        if depth == len(labels):
            break
        node = node["labels"].get(labels[depth])
        if node is None:
            break
    return None if best is None else best[1:]


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_rule_bytes: int = MAX_RULE_BYTES) -> DataFrame:
    """One row per page: id, host, path, rule (null where none fits) and verdict."""
    rules = RULES if rules is None else rules
    urls = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    if sum(len(h) + len(p) + NODE_BYTES for h, p, _ in rules) > max_rule_bytes:
        return _by_join(urls, rules, default, id_col)
    # The rules are sent flat; a worker builds their trie.
    shared = pages.sparkSession.sparkContext.broadcast(rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = build_trie(shared.value)
        for batch in batches:
            rows = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [match(trie, h, p) for h, p in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in rows], pa.string()),
                    pa.array([p for _, p in rows], pa.string()),
                    pa.array([x and x[0] for x in found], pa.string()),
                    pa.array([x[1] if x else default for x in found], pa.string()),
                ],
                [id_col, "host", "path", "rule", "verdict"],
            )

    kind = urls.schema[id_col].dataType.simpleString()
    return urls.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def _by_join(urls: DataFrame, rules: list[tuple[str, str, str]], default: str, id_col: str) -> DataFrame:
    """The same decision for rule sets too large to broadcast: distinct (host, path) pairs meet the rules by equality."""
    spark = urls.sparkSession
    table = spark.createDataFrame(rules, "r_host string, r_path string, r_verdict string")
    parsed = urls.select(
        id_col,
        F.coalesce(F.translate(F.regexp_extract("url", "(?s)://([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract("url", "(?s)://[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
    )
    counts = F.array(*[F.lit(n) for n in sorted({h.count(".") + 1 if h else 0 for h, _, _ in rules})])
    n_labels = F.octet_length("host") - F.octet_length(F.translate("host", ".", "")) + 1
    suffix = lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n)
    lengths = table.select(F.col("r_host").alias("l_host"), F.length("r_path").alias("n")).distinct()
    keys = (
        parsed.select("host", "path").distinct()
        .withColumn("r_host", F.explode(F.transform(F.filter(counts, lambda n: n <= n_labels), suffix)))
        .dropDuplicates(["host", "path", "r_host"])
        .join(lengths, (F.col("r_host") == F.col("l_host")) & (F.col("n") <= F.length("path")))
        .withColumn("r_path", F.substring(F.col("path"), F.lit(1), F.col("n")))
    )
    best = (
        keys.join(table, ["r_host", "r_path"])
        .groupBy("host", "path")
        .agg(F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), (F.col("r_verdict") == "block").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict"))).alias("best"))
    )
    return parsed.join(best, ["host", "path"], "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))


def query(spark, sf_dir):
    return filter_urls(read_table(spark, sf_dir, "pages"))


ORACLE = """
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
d AS (SELECT DISTINCT host, path FROM u),
m AS (
  SELECT d.host, d.path, h || p AS rule, v,
         row_number() OVER (PARTITION BY d.host, d.path ORDER BY length(h) + length(p) DESC, v DESC) AS k
  FROM d JOIN r ON (d.host = h OR ends_with(d.host, '.' || h)) AND starts_with(d.path, p))
SELECT page_id, u.host, u.path, rule, coalesce(v, 'allow') AS verdict
FROM u LEFT JOIN m ON m.host = u.host AND m.path = u.path AND m.k = 1
"""
