"""Operators that SQL can't express, against plain readings of what they promise."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.llm import common, decontaminate, html_extract, language_id, line_dedup, mixing, near_dedup, pii, quality_rules, suffix_dedup, url_filter
from tidemark.llm.components import components
from tidemark.llm.queries import ORACLE_SQL, QUERIES

from compare import same, sql_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir).toPandas(), sql_rows(ORACLE_SQL[name], sf_dir))


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j - 1] + (x != y), before[j] + 1, now[-1] + 1))
        before = now
    return before[-1]


def test_banded_alignment_equals_the_table():
    rng = random.Random(2)
    for _ in range(1500):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 16))]
        b = [x for x in a if rng.random() < 0.8] + [1] if rng.random() < 0.5 else [rng.randint(0, 3) for _ in range(rng.randint(0, 16))]
        limit = rng.randint(0, 18)
        assert near_dedup.banded_distance(np.array(a, np.uint32), np.array(b, np.uint32), limit) == min(distance(a, b), limit + 1)


def test_bit_parallel_search_equals_the_table():
    rng = random.Random(3)
    for _ in range(800):
        p, t = ("".join(rng.choice("abc") for _ in range(n)) for n in (rng.randint(1, 10), rng.randint(0, 14)))
        want = min(distance(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        assert decontaminate.best_distance(p, t) == want


def test_order_sketch_tells_the_order():
    one, two = "a b c d e f g h i j k l m n o p".split(), "i j k l m n o p a b c d e f g h".split()
    def keys(*texts):
        words, _, _, firsts = common.words_of(*common.utf8(pa.array([" ".join(t) for t in texts])))
        return near_dedup.sketch(*near_dedup.shingles(words, firsts))
    same_text, swapped = keys(one, one), keys(one, two)
    assert (same_text[0] == same_text[1]).all() and (swapped[0] == swapped[1]).mean() < 0.5
    assert len(keys("a b c d".split())) == 0


def test_near_duplicate_classes_equal_all_pairs(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    words, _, _, firsts = common.words_of(*common.utf8(pa.array(table["text"])))
    tokens = [(words[a:b] >> np.uint64(32)).astype(np.uint32) for a, b in zip(firsts, firsts[1:])]
    label = list(range(len(tokens)))
    for i in range(len(tokens)):
        for j in range(i):
            if np.array_equal(tokens[i], tokens[j]) or (min(len(tokens[i]), len(tokens[j])) >= 5 and near_dedup.similar(tokens[i], tokens[j])):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    want = {d: table["doc_id"][label[k]] for k, d in enumerate(table["doc_id"])}
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.query(spark, sf_dir).collect()}
    first = {}
    for d in sorted(want):
        first.setdefault(want[d], d)
    assert got == {d: first[c] for d, c in want.items()}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: x for n, x in label.items() if any(n in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("most", [1, 50_000])
def test_spans_equal_counting_all_windows(spark, sf_dir, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MAX_SEGMENTS", most)
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    extra = {90_001: b"ab" * 700, 90_002: b"x" + b"ab" * 450, 90_003: b"q" * 399, 90_004: b"q" * 400}
    docs |= extra
    seen = Counter(b[i : i + 400] for b in docs.values() for i in range(len(b) - 399))
    frame = spark.createDataFrame([(d, b.decode()) for d, b in docs.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame, texts=True).collect()}
    for d, b in docs.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        rest = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) == (len(b), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest(), rest)


def test_passages_equal_counting_all_windows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    words = [re.findall(rb"[^ \t-\r]+", (r["text"] or "").encode()) for r in rows]
    holders = defaultdict(set)
    for k, w in enumerate(words):
        for i in range(len(w) - 50):
            holders[tuple(w[i : i + 51])].add(k)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_passage_words"] for r in suffix_dedup.remove_repeats(frame).collect()}
    for k, (r, w) in enumerate(zip(rows, words)):
        inside = np.zeros(len(w), bool)
        for i in range(len(w) - 50):
            if holders[tuple(w[i : i + 51])] - {k}:
                inside[i : i + 51] = True
        assert got[r["doc_id"]] == inside.sum()
    assert sum(map(bool, got.values())) > 10


def test_columns_give_common_prefixes():
    texts = [b"x" * 10 + b"k" * 32 + b"y" * 368, b"x" * 10 + b"k" * 32 + b"y" * 368, b"z" * 10 + b"k" * 32 + b"y" * 367 + b"n"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    found = suffix_dedup.column_wise(data, offsets, np.array([10, 10, 10]), np.zeros(3, np.int64))
    windows = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    for t, row in zip(texts, found):
        assert [bool(x) for x in row[: len(t) - 399]] == [windows[t[i : i + 400]] > 1 for i in range(len(t) - 399)]


@pytest.mark.parametrize("block", [8_000_000, 2_000])
def test_found_items_equal_search(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    items = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pydict()
    plain = [(i, decontaminate.normalise(t)) for i, t in zip(items["item_id"], items["text"])]
    masks = {p: decontaminate.symbol_masks(p) for _, p in plain}
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.query(spark, sf_dir).collect()}
    texts = [(d, decontaminate.normalise(t)) for d, t in zip(docs["doc_id"], docs["text"])]
    short = [(d, t) for d, t in texts if len(t) < 6_000]
    assert len(short) > 0.8 * len(texts)
    for d, t in short:
        assert got[d] == [i for i, p in plain if p and decontaminate.best_distance(p, t, masks[p]) <= decontaminate.error_budget(len(p))]
    for d, t in texts:
        assert {i for i, p in plain if p and p in t} <= set(got[d])


@pytest.mark.parametrize("block", [8_000_000, 100])
def test_items_of_other_ids(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    items = [("b", "one two three four five six seven"), ("a", "one two three four five six seven"), ("a", "eight nine ten eleven twelve thirteen"), (None, "one two three four five six seven"), ("c", None)]
    docs = spark.createDataFrame([("x", "zero one two three four five six  seven eight nine ten eleven twelve thirteen", "k"), ("x", None, "l"), (None, "ONE two three four five six seven", "m")], "doc_id string, text string, item_ids string")
    found = decontaminate.find_items(docs, spark.createDataFrame(items, "item_id string, text string")).collect()
    assert sorted((r["doc_id"] or "", r["item_ids"]) for r in found) == [("", ["a", "b"]), ("x", []), ("x", ["a", "b"])]


def test_edited_items_are_found_and_others_not():
    rng = random.Random(7)
    items = [(k, "".join(rng.choice("abcdefgh") for _ in range(200))) for k in range(20)]
    matcher = decontaminate.Matcher(items)
    for k, item in items:
        edited = list(decontaminate.normalise(item))
        budget = decontaminate.error_budget(len(edited))
        for spot in rng.sample(range(len(edited)), budget):
            edited[spot] = rng.choice(["", "z", edited[spot] + "q"])
        assert matcher.find("before " + "".join(edited) + " after") == [k]
    assert matcher.find("".join(rng.choice("abcdefgh") for _ in range(5000))) == []


def test_edited_items_with_shared_openings_equal_search():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    opening = "which of the following statements about the old harbour town is correct? "
    items = [(k, opening + " ".join(rng.choice(words) for _ in range(20)) + (" none of the above" if k % 3 == 0 else "")) for k in range(60)]
    matcher = decontaminate.Matcher(items)
    plain = [(k, decontaminate.normalise(t)) for k, t in items]
    hits = 0
    for _ in range(60):
        edited = list(rng.choice(plain)[1])
        spots = rng.sample(range(len(edited)), round(decontaminate.error_budget(len(edited)) * rng.choice([0.5, 0.8, 1, 1.3])))
        for spot in spots:
            edited[spot] = rng.choice(["", "z", edited[spot] + "q"])
        text = decontaminate.normalise(opening * rng.randint(0, 2) + "".join(edited) + " end " + opening)
        want = [k for k, p in plain if decontaminate.best_distance(p, text) <= decontaminate.error_budget(len(p))]
        assert matcher.find(text) == want
        hits += len(want)
    assert 20 < hits


def test_shared_openings_need_few_distances(monkeypatch):
    rng = random.Random(9)
    opening = "which of the following statements about the old harbour town is correct? "
    items = [(k, opening + "".join(rng.choice("abcdefgh ") for _ in range(130))) for k in range(1000)]
    done = []
    measure = decontaminate.best_distance
    monkeypatch.setattr(decontaminate, "best_distance", lambda *a: done.append(1) or measure(*a))
    text = " ".join(opening + "".join(rng.choice("abcdefgh ") for _ in range(30)) for _ in range(20))
    assert decontaminate.Matcher(items).find(text + " " + items[7][1][:-3]) == [7] and len(done) < 10


def test_held_out_languages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.identify(rows, language_id.fit(rows), keep=("lang",)).toPandas()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.95 and got["score"].between(0, 1).all() and got["rejected"].mean() < 0.02


def test_models_are_distributions_and_reject_noise():
    text = "the cat sat on the mat and the dog sat on the log " * 30
    models = language_id.Models({"en": [text], "xx": ["zyx wvu tsr zyx " * 80]})
    models.calibrate({"en": [text], "xx": ["zyx wvu tsr zyx " * 20]})
    every = np.concatenate([models.points, [0x3B1]]).astype(np.uint32)
    context = models.encode(np.array([ord("t"), ord("h"), ord("e")], np.uint32))
    codes = np.array([np.concatenate([context, models.encode(np.array([p], np.uint32))]) for p in every])
    total = np.exp(models._log_p(4, np.concatenate([language_id.grams(c, 4) for c in codes]))).sum(axis=0)
    assert total == pytest.approx([1, 1], abs=1e-5)
    names, scores, _, rejected = models.predict(["the dog", "zyx wvu", None, "12 34", "qjq kqv jjx qkq vvq jqk " * 20])
    assert names[:4] == ["en", "xx", "und", "und"] and list(rejected) == [False, False, True, True, True]


def test_article_texts(sf_dir):
    pages = pq.read_table(f"{sf_dir}/pages.parquet").to_pydict()
    for source in pages["html"]:
        inside = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        lines = re.sub(r"</?b>", "", re.sub(r"<(?:/?p|/?h1|br)>", "\n", inside)).split("\n")
        assert html_extract.extract(source, set()) == "\n".join(" ".join(html.unescape(x).split()) for x in lines if x.strip())


def test_site_templates_go(spark):
    page = "<body><div><div class=x><p>Same words on all pages</p><b>Site</b></div><div><p>Own story {0} &lt;tag&gt;<p>and  more {0}</div><div class='comment-list'>no</div><nav>menu</nav></div></body>"
    rows = [(i, f"http://site/{i}", page.format(i)) for i in range(8)] + [(99, "http://other/1", page.format(99))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own story 3 <tag>\nand more 3" and got[99].startswith("Same words on all pages\nSite\n")


def test_rules_by_trie_and_by_join(spark):
    rng = random.Random(9)
    hosts = ["net", "example.net", "a.example.net", "example.com", "org", "xnet", "net:80", ""]
    urls = [(i, f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en', '/de/x', '/fr/y/', '?q', '#f', '/en/x?y/z'])}") for i in range(200)] + [(900, None), (901, "nothing"), (902, "HTTPS://EXAMPLE.Net/en/1")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    rules = [*url_filter.RULES, ("net", "", "allow"), ("example.net", "/e", "block"), ("", "/fr/", "block")]
    want = {}
    for i, u in urls:
        host, path = url_filter.split_url(u)
        fits = [(len(h) + len(p), v == "block", h + p, v) for h, p, v in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
        want[i] = (host, path, *(max(fits)[2:] if fits else (None, "allow")))
    for bound in (1 << 20, 0):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules, max_rule_bytes=bound).collect()}
        assert got == want


def test_checksums_and_context(spark):
    texts = [(1, "card 4111 1111 1111 1111 and 4111 1111 1111 1112"), (2, "iban GB82 WEST 1234 5698 7654 32, not GB83 WEST 1234 5698 7654 32"), (3, "my ssn is 123-45-6789"), (4, "part 123-45-6789"), (5, "a@b.cd@e.fg x@y"), (6, "1.2.3.4.5.6.7.8 999.1.1.1"), (7, "9" * 100_000)]
    got = {r["doc_id"]: r for r in pii.summarise(pii.find_pii(spark.createDataFrame(texts, "doc_id long, text string"))).collect()}
    assert got[1]["spans"] == "card:5:24" and got[2]["spans"] == "iban:5:32" and got[3]["spans"] == "ssn:10:21" and got[4]["spans"] == ""
    assert got[5]["spans"] == "email:0:6" and got[6]["spans"] == "ip:0:7,ip:8:15" and got[7]["spans"] == ""


def test_mix_meets_targets_and_nests(spark, sf_dir):
    rows = mixing.query(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").toPandas()
    merged = rows.merge(docs, on="doc_id")
    for _, group in merged.groupby("source"):
        assert abs(group["taken"].sum() - group["target"].iloc[0]) <= group["size"].max() and (group["taken"] <= 2 * group["size"]).all()
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    small, large = ({r["doc_id"] for r in mixing.mix_sources(frame, share=s).where("taken > 0").collect()} for s in (0.2, 0.4))
    assert small < large


def test_common_lines_deplete(spark):
    shared = "this very line stands in every document of the host and says nothing at all of any interest"
    rows = [(i, "h", f"{shared}\n{shared} 1\n{shared} 22\n" + (" ".join(f"own{i}w{k}" for k in range(60)) if i < 3 else "")) for i in range(30)]
    got = {r["doc_id"]: r for r in quality_rules.judge_documents(spark.createDataFrame(rows, "doc_id long, source string, text string"), max_documents=20).collect()}
    assert [got[i]["kept"] for i in (0, 1, 2, 3, 29)] == [True, True, True, False, False]
    assert got[0]["n_removed_words"] == 3 * len(shared.split()) + 2


def test_lines_one_edit_apart(spark):
    line = "one two three four five six seven eight nine ten"
    rows = [(1, line), (2, line.replace("five", "FIVE")), (3, line.replace("five", "5")), (4, line + " more"), (5, line.replace("one ", "")), (6, line.replace("two", "2").replace("nine", "9")), (7, "short line"), (8, "short line")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in line_dedup.report(frame).collect() if r["n_removed"]} == {2, 3, 4, 5, 8}
    assert {r["doc_id"] for r in line_dedup.dedup_lines(frame).collect()} == {1, 6, 7}


def test_bounds_enclose_the_distance():
    rng = np.random.default_rng(8)
    for _ in range(600):
        a = rng.integers(0, 12, rng.integers(5, 60)).astype(np.uint32)
        b = a[rng.random(len(a)) < 0.9]
        b = np.where(rng.random(len(b)) < 0.1, rng.integers(0, 12, len(b)), b).astype(np.uint32)
        true = distance(a.tolist(), b.tolist())
        longer = max(len(a), len(b))
        assert near_dedup.greedy_distance(a, b, longer) >= true
        assert near_dedup.shared(a, b) == sum((Counter(a.tolist()) & Counter(b.tolist())).values()) >= longer - true
        assert near_dedup.similar(a, b) == (true <= int(0.2 * longer + 1e-9))


@pytest.mark.parametrize("most, left", [(1_000_000, 0), (0, 0), (1_000_000, 1 << 20)])
def test_large_bucket_hides_no_pair(spark, monkeypatch, most, left):
    monkeypatch.setattr(near_dedup, "MAX_BROADCAST_WINDOWS", most)
    monkeypatch.setattr(near_dedup, "MAX_BROADCAST_NODES", most)
    monkeypatch.setattr(near_dedup, "LEFT", left)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    shared = rng.sample(vocabulary, 140)
    texts = [shared + rng.sample(vocabulary, 60) for _ in range(700)]
    pairs = [(700 + k, rng.randrange(700)) for k in range(20)]
    for _, source in pairs:
        near = texts[source][:]
        for spot in rng.sample(range(140, 200), 30):
            near[spot] = rng.choice(vocabulary)
        texts.append(near)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classify(docs).collect()}
    assert all(got[a] == got[b] for a, b in pairs) and len(set(got.values())) >= 700 - 20


def test_crowded_bucket_is_exact_whatever_its_size(spark, monkeypatch):
    """Near copies that keep no pair of words but those of a passage that all texts share: no switch of sizes loses them."""
    rng = random.Random(12)
    shared = [f"p{i}" for i in range(140)]
    texts = [shared + [f"w{k}_{i}" for i in range(60)] for k in range(60)]
    texts += [shared + [w if i % 3 == 0 else f"n{k}_{i}" for i, w in enumerate(texts[k][140:])] for k in range(20)]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").cache()
    found = []
    for crowd, left in ((256, 1 << 23), (8, 0)):
        monkeypatch.setattr(near_dedup, "CROWD", crowd)
        monkeypatch.setattr(near_dedup, "LEFT", left)
        found.append({r["doc_id"]: r["class_id"] for r in near_dedup.classify(docs).collect()})
    assert found[0] == found[1] and len(set(found[0].values())) == 60


def _crowd_of_lengths():
    """Texts of one passage and of all lengths; of some, copies that lose or gain as many words as similarity allows."""
    rng = random.Random(31)
    texts = []
    for k in range(90):
        texts.append("p q r s t u v x".split() + [f"w{k}_{i % 7 if k % 5 == 0 else i}" for i in range(rng.randrange(4, 190))])
        n = len(texts[-1])
        if k % 3 == 0:
            texts.append(texts[-1][: n - n // 5] if k % 2 else texts[-1] + [f"e{k}_{i}" for i in range(n // 4)])
    rng.shuffle(texts)
    return texts


def test_classes_do_not_depend_on_how_a_crowd_is_compared(spark, monkeypatch):
    texts = _crowd_of_lengths()
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").cache()
    found = []
    for crowd, left, tile, slots in ((1 << 20, 0, 256, 1000), (8, 1 << 26, 8, 1000), (8, 0, 8, 1000), (8, 0, 8, 1)):
        for name, value in (("CROWD", crowd), ("LEFT", left), ("TILE", tile), ("MAX_BROADCAST_WINDOWS", slots)):
            monkeypatch.setattr(near_dedup, name, value)
        found.append({r["doc_id"]: r["class_id"] for r in near_dedup.classify(docs).collect()})
    assert found[0] == found[1] == found[2] == found[3] and len(set(found[0].values())) <= len(texts) - 25


@pytest.mark.parametrize("main", [0, 1])
def test_a_crowd_compared_whole_loses_no_pair_of_any_length(spark, monkeypatch, main):
    monkeypatch.setattr(near_dedup, "TILE", 8)
    tokens = [np.array([zlib.crc32(t.encode()) for t in text], np.uint32) for text in _crowd_of_lengths()]
    label = [main if i % 4 == 0 else 1000 + i for i in range(len(tokens))]
    crowd = spark.createDataFrame([(i, label[i], [0] if i % 2 else [0, 1]) for i in range(len(tokens))], "node long, label long, marks array<long>")
    table = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in enumerate(tokens)], "node long, tokens binary")
    got = {(r["a"], r["b"]) for r in near_dedup._whole(crowd, main, table).collect()}
    true = {(i, j) for i in range(len(tokens)) for j in range(i) if label[i] != label[j] and near_dedup.similar(tokens[i], tokens[j])}
    assert {frozenset(p) for p in got} <= {frozenset(p) for p in true}

    def parts(pairs):
        above = {x: x for x in [*range(len(tokens)), *label]}

        def root(x):
            while above[x] != x:
                x = above[x]
            return x

        for a, b in [*pairs, *((i, x) for i, x in enumerate(label))]:
            above[max(root(a), root(b))] = min(root(a), root(b))
        return [root(i) for i in range(len(tokens))]

    assert parts(got) == parts(true) and len(true) >= 15


def test_windows_of_one_component_part_no_crowd(spark):
    """300 unrelated texts of a common passage, 100 of which are near copies of one another: rows for what they share only."""
    passage = [f"p{i}" for i in range(10)]
    copies = [[f"c{i}" if i != k % 50 else f"d{k}" for i in range(50)] for k in range(100)]
    texts = [*copies, *([f"w{k}_{i}" for i in range(50)] for k in range(200))]
    tokens = [np.array([zlib.crc32(w.encode()) for w in passage + t], np.uint32) for t in texts]
    crowd = spark.createDataFrame([(i, 0 if i < 100 else i, [7]) for i in range(300)], "node long, label long, marks array<long>")
    table = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in enumerate(tokens)], "node long, tokens binary")
    rows = near_dedup._parted(crowd, table, 2).collect()
    assert len(rows) < 300  # 24 windows of each text are its rarest


@pytest.mark.parametrize("size", [1, 2])
@pytest.mark.parametrize("n", [5, 6, 9, 10, 11, 20, 45, 200])
def test_similar_texts_share_a_rarest_window(n, size):
    rng = np.random.default_rng(n)
    for _ in range(60):
        a = rng.integers(0, n, n).astype(np.uint64)
        b = a.tolist()
        for _ in range(int(0.2 * n + 1e-9)):
            at = rng.integers(0, len(b))
            b[at : at + 1] = [[], [int(rng.integers(n, 2 * n))], [b[at], int(rng.integers(0, n))]][rng.integers(0, 3)]
        if near_dedup.similar(a.astype(np.uint32), np.array(b, np.uint32)):
            owner, keys = near_dedup.rarest(np.concatenate([a, np.array(b, np.uint64)]), np.array([0, n, n + len(b)]), size, rng.integers(0, 5, 64))
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_possible_loses_no_similar_text():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 60, rng.integers(5, 80)).astype(np.uint32) for _ in range(40)]
    texts += [np.where(rng.random(len(t)) < 0.15, rng.integers(0, 60, len(t)), t).astype(np.uint32) for t in texts]
    may = near_dedup.possible(texts, texts)
    assert all(may[i, j] for i in range(len(texts)) for j in range(len(texts)) if near_dedup.similar(texts[i], texts[j]))


@pytest.mark.parametrize("n", [5, 6, 9, 10, 20, 45, 60, 200])
def test_lone_pairs_at_the_threshold_meet(n):
    rng = np.random.default_rng(n)
    texts = []
    for _ in range(100):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = a.copy()
        at = rng.choice(n, int(0.2 * n + 1e-9), replace=False)
        b[at] = rng.integers(0, 1 << 63, len(at)).astype(np.uint64)
        texts += [a, b]
    found = near_dedup.candidate_keys(np.concatenate(texts), np.arange(len(texts) + 1) * n)
    assert np.mean([bool(x & y) for x, y in zip(found[::2], found[1::2])]) >= (1 if n < 10 else 0.95)


def test_copies_do_not_starve_a_language(spark):
    rng = random.Random(6)
    def text(letters):
        return " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    rows = [("xx", t) for t in [text("abcdefg")] * 4000 + [text("abcdefg") for _ in range(60)]] + [("yy", text("mnopqrs")) for _ in range(60)] + [("zz", text("tuvwxyz"))]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    kept = docs.where(~language_id.held_out("doc_id"))
    models = language_id.fit(kept, sample_texts=40)
    assert set(models.languages) == {r["lang"] for r in kept.select("lang").distinct().collect()}
    assert models.limits[models.languages.index("xx"), 0] < np.inf
    names = models.predict([text("abcdefg") for _ in range(20)])[0]
    assert names == ["xx"] * 20
    # However small the sample, a text of each language is learned from.
    assert set(language_id.fit(kept, sample_texts=0).languages) == set(models.languages)


def test_recurring_blocks_in_articles_go_and_copies_stay(spark):
    page = "<body><div>Top {0}</div><article><h1>Story {0}</h1><div class=x><p>Write to the editor</p></div><p>Own words {0}</p></article></body>"
    rows = [(i, f"http://site/{i}", page.format(i)) for i in range(8)]
    rows += [(100 + i, f"http://copies/{i}", page.format("one")) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i}\nOwn words {i}" for i in range(8))
    assert all(got[100 + i] == "Story one\nWrite to the editor\nOwn words one" for i in range(8))


def test_short_lines_repeat_once(spark):
    rows = [(1, "Subscribe now\nown words here\n\n-"), (2, "subscribe  NOW\nown words there\n\n"), (3, "own\nown")]
    got = {r["doc_id"]: r["removed_lines"] for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "0", 3: "1"}


def test_context_reaches_beyond_the_last_match(spark):
    far = "x" * 41
    texts = [(1, "ssn 123-45-6789, 987-65-4321"), (2, f"ssn 123-45-6789 {far} 987-65-4321")]
    got = {r["doc_id"]: r["spans"] for r in pii.summarise(pii.find_pii(spark.createDataFrame(texts, "doc_id long, text string"))).collect()}
    assert got == {1: "ssn:4:15,ssn:17:28", 2: "ssn:4:15"}


def test_context_words_after_a_span_count(spark):
    texts = [(1, "123-45-6789 is my ssn"), (2, f"123-45-6789 {'x' * 36} ssn"), (3, f"123-45-6789 {'x' * 35} ssn"), (4, "a@b.co " * 200 + "is my mail"), (5, "123-45-6789, 987-65-4321 (ssn)"), (6, "4111 1111 1111 1111 visa")]
    got = {r["doc_id"]: r for r in pii.summarise(pii.find_pii(spark.createDataFrame(texts, "doc_id long, text string"))).collect()}
    assert got[1]["spans"] == "ssn:0:11" and got[3]["spans"] == "ssn:0:11" and got[2]["spans"] == ""
    assert got[4]["n_email"] == 200 and got[4]["top_score"] == 0.9 and got[5]["spans"] == "ssn:0:11,ssn:13:24" and got[6]["top_score"] == 1.0


def test_words_after_a_span_equal_reading_the_text(spark):
    rng = random.Random(4)
    texts = []
    for i in range(40):
        parts = [rng.choice(["ssn", "filler", "a, b", "", "words between", "security", "x" * rng.randint(1, 50), f"{rng.randint(100, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"]) for _ in range(rng.choice([5, 40, 900]))]
        texts.append((i, " ".join(parts)))
    got = {r["doc_id"]: r["spans"] for r in pii.summarise(pii.find_pii(spark.createDataFrame(texts, "doc_id long, text string"))).collect()}
    for i, t in texts:
        near = [m for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", t) if re.search("ssn|security", t[max(0, m.start() - 40) : m.start()]) or re.search("ssn|security", t[m.end() : m.end() + 40])]
        assert [x for x in got[i].split(",") if x[:4] == "ssn:"] == [f"ssn:{m.start()}:{m.end()}" for m in near]


def test_long_lists_are_found_whole(spark):
    mail = "".join(f"m{i}@site.org, " for i in range(5000))
    numbers = "ssn " + "".join(f"{100 + i % 900}-45-6789, " for i in range(300))
    texts = [(1, mail), (2, numbers), (3, "x " + numbers[4:])]
    got = {r["doc_id"]: r for r in pii.summarise(pii.find_pii(spark.createDataFrame(texts, "doc_id long, text string"))).collect()}
    assert got[1]["spans"] == ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[a-z0-9]+@site\.org", mail))
    # The word lies within 40 characters before the first three numbers only.
    assert got[2]["spans"] == "ssn:4:15,ssn:17:28,ssn:30:41" and got[3]["spans"] == ""


ARTICLES = {
    '<div class="layout has-sidebar"><article><p>Main</article></div>': "Main",
    '<div id="social-page"><main><p>Main</main></div>': "Main",
    '<article><p>Main</article><article class="comment"><p>reader says</article>': "Main",
    '<article><p>Main<article><p>reader says</article></article>': "Main",
    '<article><div class="post-header"><h1>Title</h1></div><p>Main</article>': "Title\nMain",
    '<article id="related-work"><p>Main</article>': "Main",
    '<article><section id="related-work"><p>Work</section><p class="search">Paragraph</article>': "Work\nParagraph",
    '<article><header><h1>Title</h1></header><p>Main<footer>by</footer></article>': "Title\nMain",
    '<div class="cookie-banner">Accept</div><div class="main-menu">Home</div><p>Main text of some length<p class="advert">Buy': "Main text of some length",
    '<div class="widget"><p>All there is of the text</div><div class="share">Share</div>': "All there is of the text",
    '<p>Main<div id="comments"><p>Far longer than the text itself is, as readers write a lot</div>': "Main",
    '<div class="related"><article class="card">Teaser</article></div>': "Teaser",
    '<aside><article>Other</article></aside><p>Main': "Main",
    '<article><p class="ad-hoc">Ad hoc</p><div class="menu-of-the-day">Soup</div><div class="end-of-page-ad">Buy</div></article>': "Ad hoc\nSoup",
    '<p>Main<div class="consent">We and our many partners store and read data on your device</div>': "Main",
    '<p>Main<div class="cookie-bar">We and our many partners store and read data on your device</div>': "Main",
    '<div class="cookie">Cookies are baked for ten minutes</div><p>Eat': "Cookies are baked for ten minutes\nEat",
    '<div class="informed-consent">A patient agrees to a treatment once its risks are known</div><p>End': "A patient agrees to a treatment once its risks are known\nEnd",
}


@pytest.mark.parametrize("source", ARTICLES)
def test_names_do_not_hide_the_article(source):
    assert html_extract.extract(f"<html><body>{source}</body></html>", set()) == ARTICLES[source]


def test_furniture_that_recurs_is_a_template(spark):
    menu = "<nav><ul><li>Home<li>News</ul></nav><div class=\"sidebar\"><p>Most read</p></div>"
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<body>{menu}<div><p>Home<p>Story {i}</div></body>") for i in range(8)], "page_id long, url string, html string")
    keys = {r["key"] for r in html_extract.site_templates(pages).collect()}
    tree = html_extract.parse(f"<body>{menu}</body>")
    wanted = {n.key for n in html_extract.hash_tree(tree) if n.tag in ("nav", "div")}
    assert len(wanted) == 2 and wanted <= keys
    # A short paragraph that all pages of the host hold goes, wherever it is.
    assert {r["text"] for r in html_extract.extract_pages(pages).collect()} == {f"Story {i}" for i in range(8)}


@pytest.mark.parametrize("frame", ["{}", "<article>{}</article>", "<main><div>{}</div></main>", "<div class=page><section>{}</section></div>"])
def test_templates_equal_counting_blocks(spark, frame):
    rng = random.Random(len(frame))
    blocks = [f"<div><p>Shared words {k} of a block</p><b>more {k}</b></div>" for k in range(12)]
    pages, chosen = [], {}
    for host, n in (("a", 4), ("b", 9), ("c", 40)):
        for i in range(n):
            picked = [k for k in range(12) if rng.random() < (k + 1) / 13]
            chosen[host, i] = picked
            inside = "".join([*(blocks[k] for k in picked), f"<p>Own story {i} of {host}</p>"])
            pages.append((len(pages), f"http://{host}/{i}", f"<body>{frame.format(inside)}</body>"))
    counts = Counter((h, k) for (h, _), picked in chosen.items() for k in picked)
    sizes = Counter(h for h, _ in chosen)
    got = {r["url"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for (h, i), picked in chosen.items():
        kept = [f"Shared words {k} of a block\nmore {k}" for k in picked if counts[h, k] < max(5, 0.3 * sizes[h])]
        assert got[f"http://{h}/{i}"] == "\n".join([*kept, f"Own story {i} of {h}"])


def test_probabilities_equal_the_formula():
    texts = {"en": ["the cat sat on the mat", "a dog and the log", "that hat"], "xx": ["zig zag zog", "tic tac toe zig"]}
    models = language_id.Models(texts)
    for j, lang in enumerate(models.languages):
        line = " " + " ".join(texts[lang]) + " "
        full = Counter(line[i : i + 4] for i in range(len(line) - 3))

        def counts(n):
            return full if n == 4 else Counter(g[1:] for g in {line[i : i + n + 1] for i in range(len(line) - n)})

        def chance(context, symbol):
            if len(context) == 0:
                own, below = counts(1), 1 / (len(models.points) + 1)
            else:
                own, below = counts(len(context) + 1), chance(context[1:], symbol)
            after = {g: c for g, c in own.items() if g[:-1] == context}
            total = sum(after.values())
            if not total:
                return below
            return max(after.get(context + symbol, 0) - 0.75, 0) / total + 0.75 * len(after) / total * below

        tried = [line[i : i + 4] for i in range(0, len(line) - 3, 2)] + ["qzzq", "the ", "thz ", " zxa", "abcd"]
        for gram in tried:
            codes = models.encode(np.array([ord(c) for c in gram], np.uint32))
            assert np.exp(models._log_p(4, language_id.grams(codes, 4))[0, j]) == pytest.approx(chance(gram[:3], gram[3]), rel=1e-4)


def test_rejected_texts_score_nothing():
    models = language_id.Models({"en": ["the cat sat on the mat and the dog sat on the log " * 30], "rare": ["one two three four five"]})
    models.calibrate({"en": ["the cat sat on the mat and the dog sat on the log " * 5], "rare": []})
    assert np.isfinite(models.limits).all()
    _, scores, _, rejected = models.predict(["the dog sat on the mat", "\u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440 " * 40])
    assert list(rejected) == [False, True] and scores[0] > 0.5 and scores[1] == 0
