"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

One model per language over letters (lower case, runs of anything else as one space), of order ``ORDER``. For each
order the n-grams of all languages share one sorted array of 64-bit keys (symbols packed, so without collisions) with
a row of log-probabilities, one for each language, interpolation already carried out; a second sorted array holds the
log-weight with which a context passes to the next lower order. A position of the text costs one binary search in most
cases, and all languages are scored at once. The language of the lowest cross-entropy per symbol wins.

Learning: rows with a non-null lang whose crc32(id) mod 4 is not 2. The models are fitted on a bounded sample of them,
about ``SAMPLE_TEXTS`` distinct texts a language, up to ``SAMPLE_CHARS`` characters, chosen by a hash of the text (copies
count once), and one at least; whole texts are used. A quarter of each language's sample calibrates the rejection: the
mean and the spread of the cross-entropy between texts, and between symbols within a text. A language with fewer than
four distinct texts is calibrated like the mean of the others. A text is rejected if its cross-entropy lies more than
``REJECT_Z`` deviations above the mean of its language, where short texts have wider deviations, and more than half the
way from that mean to the entropy of evenly drawn symbols; so are texts without a letter, and those whose letters no
language has. Texts too short for a window of the full order are scored from their first symbol on, by lower orders.

Defined results: null text, or no letter: lang_pred ``und``, score 0, rejected. Without any labelled row every text is
``und``. Ties go to the language first in code-point order. Rows repeat as they come; ids may repeat or be null (a null
id is not learned from and not held out). The score is the posterior of the winner under equal priors, tempered, and 0
for rejected texts, which keep the best language as lang_pred. Very long texts are taken whole. No rows give no rows;
other columns, of whatever name, are ignored (``identify``) or returned (``keep_recognised``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import read_table

ORDER = 4
BITS = 12
DISCOUNT = 0.75
SAMPLE_TEXTS, SAMPLE_CHARS = 400, 8_000_000
REJECT_Z = 8.0
TEMPER, TEMPER_LENGTH = 0.25, 200
CHUNK = 1 << 20
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, folded, each text between single spaces; and the text each belongs to."""
    folded = [(t or "").lower() for t in texts]
    joined = " " + "".join(t + " " for t in folded)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(folded)), [len(t) + 1 for t in folded])
    owner = np.concatenate(([0], owner)) if len(owner) else np.zeros(1, np.int64)
    points = np.where(letter_table()[points], points, np.uint32(32))
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    return points[keep], owner[keep]


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Packed n-grams ending at each position from n - 1 on."""
    out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n):
        out = (out << np.uint64(BITS)) | codes[k : k + len(out)]
    return out


class Models:
    """All languages' models; see the module."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        parts = {lang: symbols(texts[lang])[0] for lang in self.languages}
        points, counts = np.unique(np.concatenate([*parts.values(), np.zeros(0, np.uint32)]), return_counts=True)
        order = np.argsort(-counts, kind="stable")[: (1 << BITS) - 2]
        self.points = np.sort(points[order])  # symbol 0 stands for all other letters
        coded = {lang: self.encode(p) for lang, p in parts.items()}
        self.keys: list[np.ndarray] = []
        self.log_p: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.log_back: list[np.ndarray] = []
        lower = None
        for n in range(1, ORDER + 1):
            lower = self._fit_order(n, coded, lower)
        self.limits = np.zeros((len(self.languages), 3))

    def encode(self, points: np.ndarray) -> np.ndarray:
        if not len(self.points):
            return np.zeros(len(points), np.uint64)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, at + 1, 0).astype(np.uint64)

    def _fit_order(self, n: int, coded: dict[str, np.ndarray], lower):
        """Adds the arrays of order n, whose probabilities rest on those of order n - 1."""
        tables = []
        for lang in self.languages:
            if n == ORDER:
                keys, counts = np.unique(grams(coded[lang], n), return_counts=True)
            else:  # continuation counts: distinct symbols before the n-gram
                wider = np.unique(grams(coded[lang], n + 1))
                keys, counts = np.unique(wider & np.uint64((1 << (BITS * n)) - 1), return_counts=True)
            tables.append((keys, counts.astype(float)))
        keys = np.unique(np.concatenate([k for k, _ in tables] + [np.zeros(0, np.uint64)]))
        contexts = np.unique(keys >> np.uint64(BITS))
        p = np.zeros((len(keys), len(self.languages)))
        back = np.ones((len(contexts), len(self.languages)))
        for j, (own, counts) in enumerate(tables):
            at = np.searchsorted(contexts, own >> np.uint64(BITS))
            total = np.bincount(at, counts, minlength=len(contexts))
            kinds = np.bincount(at, minlength=len(contexts))
            seen = total > 0
            back[seen, j] = DISCOUNT * kinds[seen] / total[seen]
            p[np.searchsorted(keys, own), j] = np.maximum(counts - DISCOUNT, 0) / total[at]
        below = np.full(p.shape, 1.0 / (len(self.points) + 1)) if n == 1 else np.exp(self._log_p(n - 1, keys & np.uint64((1 << (BITS * (n - 1))) - 1)))
        p += back[np.searchsorted(contexts, keys >> np.uint64(BITS))] * below
        self.keys.append(keys)
        self.log_p.append(np.log(p).astype(np.float32))
        self.contexts.append(contexts)
        self.log_back.append(np.log(back).astype(np.float32))

    def _log_p(self, n: int, codes: np.ndarray) -> np.ndarray:
        """Log-probability of each n-gram's last symbol after the others, a column for each language."""
        if n == 0 or not len(self.keys[n - 1]):
            return np.full((len(codes), len(self.languages)), -np.log(len(self.points) + 1), np.float32)
        keys = self.keys[n - 1]
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        out = self.log_p[n - 1][at]
        miss = np.flatnonzero(keys[at] != codes)
        if len(miss):
            lost, known = codes[miss], self.contexts[n - 1]
            ctx = lost >> np.uint64(BITS)
            where = np.minimum(np.searchsorted(known, ctx), len(known) - 1)
            back = np.where((known[where] == ctx)[:, None], self.log_back[n - 1][where], np.float32(0))
            out[miss] = back + self._log_p(n - 1, lost & np.uint64((1 << (BITS * (n - 1))) - 1))
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Letters and spaces scored in each text, sums of -log p and of its square, and how many letters are known ones.

        Of a text too short for a window of the full order, each symbol is scored after all that come before it.
        """
        points, owner = symbols(texts)
        n_texts, n_langs = len(texts), len(self.languages)
        letters = np.bincount(owner, points != 32, minlength=n_texts)[:n_texts]
        codes = self.encode(points)
        sums, squares, counts = np.zeros((n_texts, n_langs)), np.zeros((n_texts, n_langs)), np.zeros(n_texts, np.int64)
        if len(codes) >= ORDER and n_langs:
            loss = -self._log_p(ORDER, grams(codes, ORDER))
            # A window belongs to the text of its last symbol, if it starts within it (or at the space before it).
            last = owner[ORDER - 1 :]
            own = owner[1 : len(owner) - ORDER + 2] == last
            loss, last = loss[own], last[own]
            counts = np.bincount(last, minlength=n_texts)
            for j in range(n_langs):
                sums[:, j] = np.bincount(last, loss[:, j], minlength=n_texts)
                squares[:, j] = np.bincount(last, loss[:, j] ** 2, minlength=n_texts)
        short = np.concatenate(((counts == 0) & (letters > 0), [False]))
        begins = np.concatenate(([True], owner[1:-1] != owner[2:], [False]))[: len(owner)]  # the spaces before texts
        for n in range(2, ORDER) if short.any() and n_langs else ():
            last = owner[n - 1 :]
            own = begins[: len(last)] & (owner[1 : len(owner) - n + 2] == last) & short[last]
            loss, last = -self._log_p(n, grams(codes, n)[own]), last[own]
            counts = counts + np.bincount(last, minlength=n_texts)
            for j in range(n_langs):
                sums[:, j] += np.bincount(last, loss[:, j], minlength=n_texts)
                squares[:, j] += np.bincount(last, loss[:, j] ** 2, minlength=n_texts)
        known = np.bincount(owner, (points != 32) & (codes > 0), minlength=n_texts)[:n_texts]
        return np.where(letters > 0, counts, -1), sums, squares, known

    def calibrate(self, texts: dict[str, list[str]]) -> None:
        for j, lang in enumerate(self.languages):
            counts, sums, squares, _ = self.score(texts.get(lang, []))
            full = counts > 0
            if full.any():
                n, ce = counts[full], sums[full, j] / counts[full]
                mean = np.average(ce, weights=n)
                within = max(0.0, squares[full, j].sum() / n.sum() - mean**2)
                between = max(0.0, np.average((ce - mean) ** 2, weights=n))
                self.limits[j] = mean, between, within
            else:
                self.limits[j] = np.nan
        unknown = np.isnan(self.limits[:, 0])
        if unknown.any():
            usual = math.log(len(self.points) + 1) / 2, 0.0, 1.0
            self.limits[unknown] = self.limits[~unknown].mean(axis=0) if not unknown.all() else usual

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of each text."""
        counts, sums, _, known = self.score(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        n = np.maximum(counts, 1)
        ce = sums / n[:, None]
        best = ce.argmin(axis=1)
        lowest = ce[np.arange(len(texts)), best]
        weight = TEMPER * np.minimum(n, TEMPER_LENGTH)
        posterior = 1 / np.exp(-(ce - lowest[:, None]) * weight[:, None]).sum(axis=1)
        mean, between, within = self.limits[best].T
        with np.errstate(invalid="ignore"):
            halfway = (np.log(len(self.points) + 1) - mean) / 2
            rejected = lowest - mean > np.maximum(REJECT_Z * np.sqrt(between + within / n), halfway)
            rejected |= known == 0  # letters that no language has tell nothing
        none = counts < 0
        languages = [UNKNOWN if e else self.languages[b] for b, e in zip(best, none)]
        return languages, np.where(none | rejected, 0.0, posterior), np.where(none, 0.0, lowest), rejected | none


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> Models:
    """Fits the models on a bounded sample of the labelled rows that aren't held out."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    distinct = labelled.select("lang", F.xxhash64("text").alias("hash"), place.alias("place")).distinct()
    sizes = {r["lang"]: (r["n"], r["low"]) for r in distinct.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("low")).collect()}  # a row for each language
    if not sizes:
        return Models({})
    bound = F.coalesce(*[F.when(F.col("lang") == k, F.lit(max(math.ceil(min(1.0, sample_texts / n) * (1 << 40)), low + 1))) for k, (n, low) in sorted(sizes.items())])
    drawn = labelled.where(place < bound).distinct().withColumns({"place": place, "size": F.length("text").cast("long")})
    # About SAMPLE_TEXTS rows a language; those within the bound on characters, and the first.
    upto = F.sum("size").over(Window.partitionBy("lang").orderBy("place", "text"))
    rows = drawn.withColumn("upto", upto).where((F.col("upto") <= sample_chars) | (F.col("upto") == F.col("size"))).orderBy("lang", "place", "text").select("lang", "text").collect()
    learn: dict[str, list[str]] = {k: [] for k in sizes}
    check: dict[str, list[str]] = {k: [] for k in sizes}
    for lang, text in rows:
        (check if (len(learn[lang]) + len(check[lang])) % 4 == 3 else learn)[lang].append(text)
    models = Models(learn)
    models.calibrate(check)
    return models


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """All rows of docs: id, columns in ``keep``, held_out, lang_pred, score, cross_entropy, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    picked = docs.select(F.col(text_col).alias("_scanned"), F.col(id_col), *[F.col(c) for c in keep if c != id_col], held_out(id_col).alias("held_out"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 0, CHUNK):
            languages, scores, losses, rejected = shared.value.predict(batch.column(0).to_pylist())
            added = [pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(losses, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *added], [*batch.schema.names[1:], "lang_pred", "score", "cross_entropy", "rejected"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[1:])
    return picked.mapInArrow(scan, f"{columns}, lang_pred string, score double, cross_entropy double, rejected boolean")


@common.shielded("id_col", "text_col", "lang_col")
def keep_recognised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Documents with all their columns whose language models fitted on them don't reject."""
    judged = identify(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col, keep=tuple(docs.columns))
    return judged.where(~F.col("rejected")).select(*docs.columns)


def query(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
