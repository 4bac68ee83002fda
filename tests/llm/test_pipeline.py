"""The whole pipeline over documents of which it is known what should happen to them."""

import random
from collections import Counter

import corpus_pipeline
from tidemark.llm import decontaminate, language_id, mixing, near_dedup

LETTERS = {"aa": "abcdefghijk", "bb": "lmnopqrstuv"}


def word(rng, lang):
    return "".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(3, 8)))


def corpus():
    rng = random.Random(4)
    lexicon = {lang: [word(rng, lang) for _ in range(400)] for lang in LETTERS}
    prose = lambda lang, n: [rng.choice(lexicon[lang]) for _ in range(n)]
    rows, fate = [], {}

    def add(kind, text, lang, source):
        fate[len(rows)] = kind
        rows.append((len(rows), text, lang, source, len(text or "")))

    item = " ".join(prose("aa", 40))
    for k in range(240):
        lang = "aa" if k % 2 else "bb"
        add("clean", " ".join(prose(lang, 120)), lang, f"s{k % 3}")
    for k in range(12):
        base = prose("aa", 150)
        add("first", " ".join(base), "aa", "s0")
        for _ in range(3):
            near = base[:]
            for spot in rng.sample(range(150), 10):
                near[spot] = rng.choice(lexicon["aa"])
            add("copy", " ".join(near), "aa", "s1")
        add("copy", " ".join(base), "aa", "s2")
    for k in range(10):
        text = item[:50] + "#" + item[51:]
        add("leak", " ".join(prose("aa", 50)) + " " + text + " " + " ".join(prose("aa", 50)), "aa", "s1")
    for _ in range(10):
        add("noise", "".join(rng.choice("\u0430\u0431\u0432\u0433\u0434\u0435 ") for _ in range(600)), None, "s0")
    add("noise", None, None, None)
    add("noise", "12 34", None, "s0")
    shared = " ".join(prose("bb", 12))
    for k in range(15):
        add("lines", f"{' '.join(prose('bb', 60))}\n{shared}", "bb", "s2")
    return rows, fate, item, shared


def test_each_stage_does_its_work(spark, tmp_path, monkeypatch):
    rows, fate, item, shared = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage-{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage-{k}"))
        left[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    count = lambda name: Counter(fate[i] for i in left[name])
    sizes = Counter(fate.values())
    assert count("language") == {k: n for k, n in sizes.items() if k != "noise"}
    # One of the copies of a text loses its only line to the first; the line that many share stays once.
    assert sum(shared in t for t in left["lines"].values()) == 1 and count("lines")["copy"] == 3 * 12 and count("lines")["clean"] == 240
    assert count("near_duplicates") == {"clean": 240, "first": 12, "leak": 10, "lines": 15}
    assert count("benchmark") == {"clean": 240, "first": 12, "lines": 15}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["times"]) for r in whole} == {(r["doc_id"], r["times"]) for r in docs.collect()}
    words = lambda t: len(t.split())
    mix = {r["doc_id"]: r["times"] for r in whole}
    for source in ("s0", "s1", "s2"):
        own = [i for i in left["benchmark"] if rows[i][3] == source]
        wanted = mixing.mix_sources(spark.read.parquet(str(tmp_path / "stage-3"))).where(f"doc_id = {own[0]}").first()["target"]
        taken = sum(mix.get(i, 0) * words(left["benchmark"][i]) for i in own)
        assert abs(taken - wanted) <= max(words(left["benchmark"][i]) for i in own)
