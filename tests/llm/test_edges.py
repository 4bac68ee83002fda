"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, decontaminate, html_extract, language_id, line_dedup, mixing, near_dedup, pii, quality_rules, suffix_dedup, url_filter

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
PROSE = " ".join(WORDS[i * 7 % 12] + str(i % 5) for i in range(120))
LONG = " ".join(f"w{i * 37 % 1009}" for i in range(60_000))
ROWS = [
    (1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, PROSE, "en", None), (3, None, None, None), (None, "some words without an id here", "de", "a"), (4, "", "en", "b"), (5, " \n\t ", "fr", "b"),
    (6, LONG, "en", "a"), (7, "one", "en", "a"), (8, "\ue000 odd \ue001 é\U0001f600 a@b.co", None, "c"), (1, "another text of the same id, as can be", "de", "c"), (None, None, None, None),
]
#: Names that the operators use inside.
CLASHES = ["tkey", "node", "line", "words", "h", "s", "t", "k", "size", "rest", "start", "hash", "keys", "found", "copies", "_text", "held_out", "host", "path", "times", "id"]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PROSE[100:260]), (2, None), (3, ""), (4, PROSE[100:260]), (5, "never in any of the texts, at all, whatever they are")], "item_id long, text string")


def languages(docs):
    return language_id.identify(docs, language_id.fit(docs))


OPERATORS = {
    "near": near_dedup.classify, "lines": line_dedup.report, "spans": suffix_dedup.remove_repeats, "rules": quality_rules.judge_documents, "mix": mixing.mix_sources,
    "language": languages, "pii": lambda d: pii.summarise(pii.find_pii(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_document(docs, name):
    got = OPERATORS[name](docs).select("doc_id").toPandas()["doc_id"]
    assert sorted(got.fillna(-1).astype(int)) == sorted(-1 if r[0] is None else r[0] for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, name):
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_benchmark_edges(docs, benchmark):
    rows = decontaminate.find_items(docs, benchmark).collect()
    assert len(rows) == len(ROWS) and sorted(tuple(r["item_ids"]) for r in rows if r["item_ids"]) == [(1, 4)] * 3
    assert decontaminate.decontaminate(docs, benchmark).columns == docs.columns
    assert decontaminate.find_items(docs, benchmark.limit(0)).where(F.size("item_ids") > 0).count() == 0
    assert decontaminate.find_items(docs.limit(0), benchmark).count() == 0


def test_pages_edges(spark):
    rows = [(1, None, None), (1, "http://h/x", "<p>a"), (None, "nonsense", ""), (2, "http://h/x", "<p>a"), (3, "://", "<div>" * 3000 + "deep"), (4, "http://h", "x" * 300_000), (5, "http://h", "<<>&&amp;<a href='"), (6, "HTTP://Ab.C/d?e://f", "<b>z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "key", "h", "templates", "text", "rule", "path")})
    got = html_extract.extract_pages(pages).collect()
    assert len(got) == len(rows) and {r["text"] for r in got if r["page_id"] in (1, 2)} == {"", "a"}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    urls = url_filter.filter_urls(pages).collect()
    assert len(urls) == len(rows) and {(r["host"], r["path"]) for r in urls if r["page_id"] == 6} == {("ab.c", "/d")}
    assert html_extract.extract_pages(pages.limit(0)).count() == url_filter.filter_urls(pages.limit(0)).count() == 0


def test_defined_results(docs):
    near = {(r["doc_id"], r["n_words"]): r for r in near_dedup.classify(docs).collect()}
    assert near[2, 120]["class_id"] == 1 and near[2, 120]["class_size"] == 3
    spans = [r for r in suffix_dedup.remove_repeats(docs).collect() if r["n_bytes"] == len(PROSE)]
    assert {(r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in spans} == {(len(PROSE), 1, hashlib.sha256(b"").hexdigest())}
    assert {r["lang_pred"] for r in languages(docs).collect() if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert {r["n_removed"] for r in line_dedup.report(docs).collect() if r["doc_id"] == 1} == {0}
    emails = {r["doc_id"]: r["n_email"] for r in pii.summarise(pii.find_pii(docs)).collect()}
    assert emails[8] == 1


def test_pipeline_stages_take_the_same_rows(spark, docs, benchmark, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    benchmark.write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    plain = docs.drop("id", "times")
    for rows in (plain, plain.limit(0)):
        current = rows
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            current = stage(spark, current, str(tmp_path / "none"))
            assert set(rows.columns) <= set(current.columns)
            path = str(tmp_path / f"{rows.count()}-{k}")
            current.write.parquet(path)
            current = spark.read.parquet(path)
            if name != "mixing":
                assert current.columns == rows.columns


def test_other_column_names(docs, benchmark):
    other = docs.withColumnRenamed("id", "x1").withColumnRenamed("text", "body").withColumnRenamed("doc_id", "key").withColumnRenamed("source", "origin").withColumnRenamed("lang", "tongue").withColumn("doc_id", F.lit("y")).withColumn("text", F.lit("z"))
    for kept in (
        near_dedup.keep_one(other, id_col="key", text_col="body"), line_dedup.dedup_lines(other, "key", "body"), language_id.keep_recognised(other, "key", "body", "tongue"),
        decontaminate.decontaminate(other, benchmark, id_col="key", text_col="body"), mixing.take_mix(other.drop("times"), id_col="key", text_col="body", source_col="origin"),
    ):
        assert set(other.columns) - {"times"} <= set(kept.columns) and 0 < kept.count() <= len(ROWS)


def test_very_long_urls(spark):
    long = "http://a.example.com/de/" + "x/" * 20_000
    pages = spark.createDataFrame([(1, long), (2, "http://" + "a." * 5_000 + "net/y")], "page_id long, url string")
    rules = [*url_filter.RULES, ("a.example.com", "/de/" + "x/" * 10_000, "allow")]
    for bound in (1 << 30, 0):
        got = {r["page_id"]: (r["rule"] and len(r["rule"]), r["verdict"]) for r in url_filter.filter_urls(pages, rules, max_rule_bytes=bound).collect()}
        assert got == {1: (len("a.example.com/de/") + 20_000, "allow"), 2: (4, "block")}


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    from tidemark.llm import common

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError):
        common.ensure_checkpoint_dir(Session())


def test_rows_of_one_id_are_parted_by_the_mix(spark):
    """A hundred rows of one id in a source whose target is a share of it: the words taken come near the target."""
    rows = [(7, f"w{i} " * 10, "a") for i in range(100)] + [(k, f"b{k} " * 10, "b") for k in range(40)] + [(k, f"c{k} " * 10, "c") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_sources(docs).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(mixed) == 3 and all(abs(r["taken"] - r["target"]) <= 10 for r in mixed)


def test_the_shortest_texts_are_scored_or_rejected():
    """One letter is told by shorter windows; letters that no language has are rejected, whatever their number."""
    texts = {"en": ["a plan in the autumn and a storm over the town"] * 8, "es": ["el niño o la niña y la montaña o el otoño"] * 8}
    models = language_id.Models(texts)
    models.calibrate(texts)
    languages, scores, losses, rejected = models.predict(["a", "o", "ñ", "я", "中文", "中文中文中", "", None, "7 !"])
    assert languages[:3] == ["en", "es", "es"] and not rejected[:2].any() and (losses[:3] > 0).all()
    assert rejected[3:].all() and (scores[3:] == 0).all() and languages[6:] == ["und"] * 3 and "und" not in languages[:6]


def peak(run) -> int:
    """Bytes that a call holds at most."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_hashing_holds_little_memory(monkeypatch):
    """Words are hashed in blocks, which change no hash: empty words, words longer than a block, overlapping ones."""
    data = np.random.default_rng(3).integers(0, 256, 4 << 20).astype(np.uint8)
    starts = np.arange(0, len(data), 64)
    assert peak(lambda: common.hash_segments(data, starts, starts + 60)) < 4 * len(data)
    starts, ends = np.array([0, 5, 5, 7, 400, 650, 650]), np.array([5, 5, 300, 400, 402, 650, 700])
    found = []
    for block in (1, 90, 1 << 17):
        monkeypatch.setattr(common, "HASHED", block)
        found.append(common.hash_segments(data[:700], starts, ends).tolist())
    base, plain = int(common.powers(2)[1]), []
    for a, b in zip(starts.tolist(), ends.tolist()):
        plain.append((sum(int(common._BYTE[x]) * base**k for k, x in enumerate(data[a:b].tolist())) + b - a) % (1 << 64))
    assert found[0] == found[1] == found[2] == common.mix(np.array(plain, np.uint64)).tolist()


def test_pairs_are_verified_a_few_at_a_time():
    """A batch of 40 pairs of long texts: no copy of them all is held, and every pair is judged."""
    text = np.arange(50_000, dtype=np.uint32)
    left, right = [text.tobytes()] * 40, [text.tobytes() if k % 2 else (text[::-1]).tobytes() for k in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(range(100, 140)), pa.array(left), pa.array(right)], ["a", "b", "t_a", "t_b"])
    rows: list[dict] = []
    assert peak(lambda: rows.extend(r for out in near_dedup._verified(iter([batch])) for r in out.to_pylist())) < 12_000_000
    assert rows == [{"a": k, "b": k + 100} for k in range(1, 40, 2)]
