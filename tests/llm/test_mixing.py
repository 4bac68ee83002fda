"""What the mix counts, and in how much memory."""

import os
import subprocess
import sys

from tidemark.llm import mixing

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
LONG = """
from pyspark.sql import SparkSession, functions as F
from tidemark.llm import mixing

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.range(1).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.expr("repeat(concat(id, ' '), 15000000)").alias("text"))
print("words", mixing.measured(docs).first()["size"])
spark.stop()
"""


def test_a_text_of_many_words_fits_a_small_heap():
    """15 million words of 30 MB: as strings of their own they don't fit."""
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": "--driver-memory 512m pyspark-shell"}
    done = subprocess.run([sys.executable, "-c", LONG], env=env, capture_output=True, text=True, timeout=300)
    assert "words 15000000" in done.stdout, done.stderr[-2000:]


def test_words_end_at_the_white_space_of_the_contract_only(spark):
    texts = [None, "", " ", "\n\t\x0b\x0c\r ", "x", " x", "x ", "x  x", "\x0bx\x0cx\rx\n", "a\u00a0b c\u2003d", "\x1c \x85 \x00", "\U0001f600\U0001f600 \u00e9 $1 \\\\ x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n"] for r in rows.select("doc_id", mixing.word_count("text").alias("n")).collect()}
    for i, text in enumerate(texts):
        spaced = (text or "").translate({c: " " for c in (9, 10, 11, 12, 13)})
        assert got[i] == sum(w != "" for w in spaced.split(" ")), (text, got[i])


def test_texts_are_hashed_once_for_the_mix(spark):
    docs = spark.createDataFrame([(i, f"word {i}", "a") for i in range(20)], "doc_id long, text string, source string")
    plan = mixing.take_mix(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1, plan
