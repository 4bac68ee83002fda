"""The manifest, the n-gram join and the filter audit against plain readings, and their edges."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, filter_audit, merkle_manifest, ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ["node", "tree", "at", "part", "bits", "hash", "label", "n", "id", "path", "leaf", "key", "window"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text). (doc_id, leaf, subroot, root, proof, folded, verified), sorted."""

    def leaf(row, text):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def flanks(found, at):
        for level in found[:-1]:
            first = at - at % 3
            yield "".join(level[first:at]), "".join(level[at + 1 : first + 3])
            at //= 3

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for s in sources}
    built = {s: levels([leaf(r, r[4]) for r in trees[s]]) for s in sources}
    crown = levels([built[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, r in enumerate(trees[s]):
            broken = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            path = [*flanks(built[s], at), *flanks(crown, k)]
            node = leaf(r, r[4].replace("\n", "") if broken else r[4])
            for left, right in path:
                node = sha(left, node, right)
            out.append((r[0], leaf(r, r[4]), built[s][-1][0], crown[-1][0], sha(*[x for p in path for x in p]), node, node == crown[-1][0]))
    return sorted(out, key=repr)


def random_rows(n, seed=1):
    rng = random.Random(seed)
    texts = ["", "one\ntwo", "three", None, "é\U0001f600\nline", "x" * 5000]
    return [(rng.choice([None, *range(n)]) if rng.random() < 0.1 else i, rng.choice(["hot", "hot", "hot", "b", "", None, "é"]), rng.choice(["en", None]), rng.choice([None, 3]), rng.choice(texts) if rng.random() < 0.5 else f"text {i}\n") for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit("x") for c in CLASHES})


@pytest.mark.parametrize("n", [0, 1, 2, 7, 600])
def test_manifest_equals_the_plain_one(spark, n):
    """600 rows, most of one source: blocks of 243 leaves, so two rounds."""
    rows = random_rows(n)
    rows += rows[:3]
    got = merkle_manifest.report(table(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_manifest(rows)


def test_manifest_of_many_sources(spark):
    rows = [(i, f"s{i:04}", "en", 1, "a\nb") for i in range(300)]
    assert sorted((tuple(r) for r in merkle_manifest.report(table(spark, rows)).collect()), key=repr) == plain_manifest(rows)
    roots = merkle_manifest.build(table(spark, rows)).roots().collect()
    assert len(roots) == 300 and len({r["root"] for r in roots}) == 1


def plain_sets(rows):
    out = []
    for _, text in rows:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out.append(frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3)) if len(words) >= 4 else frozenset([tuple(words)] if words else []))
    return out


def plain_join(rows):
    sets = plain_sets(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if sets[i] and doc_id is not None:
            ids[find(i)] = min(ids.get(find(i), doc_id), doc_id)
    return sorted(((r[0], len(sets[i]), ids.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=repr)


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return words


def near_texts(seed):
    """Chains of edits, a crowd of copies of one text, a passage that many share, very long and very short texts."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for n in (5, 20, 60, 150, 400):
        for _ in range(4):
            words = fresh(n)
            for step in range(4):
                texts.append(" ".join(words))
                words = edited(rng, words, rng.choice([0, 1, 1, 2]) if n > 20 else step % 2)
                if rng.random() < 0.3:
                    words = words[: len(words) - rng.randrange(max(1, n // 8))]
    base, passage = fresh(100), fresh(50)
    texts += [" ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 4]))) for _ in range(90)]
    texts += [" ".join([*fresh(rng.randrange(3, 12)), *passage, *fresh(rng.randrange(3))]) for _ in range(60)]
    long = fresh(30_000)
    texts += [" ".join(long), " ".join(edited(rng, long, 500)), " ".join(edited(rng, long, 4000)), "", None, " \n\t", "one", "ONE", "one two three", "one two three", "a b c d", "A B c d"]
    rows = [(None if rng.random() < 0.03 else i, t) for i, t in enumerate(texts)]
    rows += rows[:10]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_all_pairs(spark, seed):
    rows = near_texts(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHES}).repartition(3)
    got = ngram_join.join_documents(docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == plain_join(rows)
    assert ngram_join.join_documents(docs.limit(0)).count() == 0


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 900))
        one = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        other = np.unique(np.concatenate([one[rng.random(len(one)) < rng.random()], rng.integers(0, 2**63, int(rng.integers(1, 300))).astype(np.uint64)]))
        maps = [ngram_join.bitmaps(s, np.array([0, len(s)]), ngram_join.bits_of(ngram_join.band_of(np.array([len(s)]))))[0] for s in (one, other)]
        size = min(map(len, maps))
        differ = sum((x ^ y).bit_count() for x, y in zip(*[ngram_join.folded(m, size) for m in maps]))
        same = ngram_join.intersection(one, other)
        assert same == len(np.intersect1d(one, other)) <= (len(one) + len(other) - differ) // 2


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed = []
    for doc_id, source, text in rows:
        words, text = WORD.findall(text or ""), text or ""
        bits = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text)}
        bits["E"] = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, _, t in rows)
        failed.append((source or "", doc_id, {k for k, v in bits.items() if v}))
    out = []
    for part in {f[0] for f in failed}:
        own = [f for f in failed if f[0] == part]
        shapley = {x: sum(x in f and not f & set(order[: order.index(x)]) for order in permutations("ABCDE") for _, _, f in own) for x in "ABCDE"}
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [(i, f) for _, i, f in own if x in f and not f & before]
                out.append((part, "".join(order), step, sum(not f & (before | {x}) for _, _, f in own), len(removed), sum(x in f and bool(f & before) for _, _, f in own), sum(f == {x} for _, _, f in own), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed), shapley[x]))
    return sorted(out)


def test_audit_equals_the_plain_one(spark):
    rng = random.Random(4)
    texts = ["", None, "short", " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i}" for i in range(250)), "again " * 300, "LOUD " * 250, " ".join(f"w{i}" for i in range(230)) + " #", " ".join(f"u{i}" for i in range(200)), "$ " * 20_000]
    rows = [(None if rng.random() < 0.05 else rng.randrange(60), rng.choice(["a", "a", "a", "b", None, ""]), rng.choice(texts)) for _ in range(90)]
    rows += rows[:4]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit("x") for c in (*CLASHES, "words", "quality", "toxic", "step")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    got = filter_audit.audit(docs, marks).collect()
    assert sorted(tuple(r) for r in got) == plain_audit(rows, labels) and len(got) == 3 * 600
    assert filter_audit.audit(docs.limit(0), marks).count() == 0


def test_one_text_of_many_rows_is_dealt_into_pieces(spark):
    docs = spark.range(3 * filter_audit.PIECE).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("same text").alias("text"))
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(docs, marks).collect()}
    assert rows["EABCD", 1]["kept"] == 1 and rows["EABCD", 1]["removed"] == 3 * filter_audit.PIECE - 1
