"""Personal data, native: regular expressions propose spans, checksums confirm them, context words adjust the score.

Per kind, matches are leftmost and don't overlap; a match that its validator refuses is dropped and not retried.
Positions come from marking each match with a private-use character and summing the lengths of the pieces between
marks; that character is first replaced in the text by another of the same length, so no position moves.

The patterns are the contract's with the same matches, written so that no run of characters is scanned twice:
possessive repeats, and look-behinds that start a match only where a run starts (or the last match ended).

Kinds: email, ip (parts up to 255), card (14 to 19 digits, Luhn), phone (10 to 15 digits), and beyond the base iban
(mod-97) and ssn (three groups of digits; nothing to check, so only with a context word close to it).
Score: 0.9 where a checksum confirmed the span, 0.6 otherwise, 0.3 for ssn; a context word of the kind in the 40
characters before the span or the 40 after it (other matches included) adds 0.3, up to 1. Spans under ``MIN_SCORE`` aren't reported.

Defined results: a null text counts as empty; no spans give an empty string and the SHA-256 of it. Very long texts are
taken whole. Rows repeat as they come; extra columns are ignored; ids may repeat or be null. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table

MARK, STAND_IN = "\ue000", "\ue001"
MIN_SCORE = 0.5
CONTEXT = 40
#: Pieces behind a match that hold CONTEXT characters at least, if there are any: each second one is a match, of five or more.
REACH = 2 * -(-CONTEXT // 5) + 1
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Pieces of a text (even) that are walked at once; each walk's list of spans grows by copying.
CHUNK = 128
#: A text without a match of this has none of the kind; cheap to test.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-"}
CONTEXT_WORDS = {
    "email": "mail|contact|write",
    "ip": r"\bip\b|address|host|server",
    "card": "card|visa|master|credit|carte|karte|tarjeta",
    "phone": r"phone|\btel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|insurance",
}
START_SCORE = {"email": 0.6, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
IP_PARTS = r"^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"
SPAN = "array<struct<start:int,rank:int,stop:int,score:double>>"


def _luhn(match: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(match, "[^0-9]", "")), "")
    doubled = F.transform(digits, lambda c, i: F.when(i % 2 == 0, F.ascii(c) - 48).otherwise((F.ascii(c) - 48) * 2 - F.when(c > "4", 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(match: Column) -> Column:
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), "")

    def step(rest: Column, c: Column) -> Column:
        return F.when(c < "A", rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(turned, F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    return {
        "ip": lambda: match.rlike(IP_PARTS),
        "card": lambda: _luhn(match),
        "phone": lambda: digits.between(10, 15),
        "iban": lambda: _mod97(match),
    }.get(kind, lambda: F.lit(True))()


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _spans(kind: str, text: Column) -> Column:
    """Array of confirmed spans of one kind, in order.

    The pieces between marks are walked in chunks, each from the sum of the lengths before it and the end of the chunk
    before it, so the work follows the number of matches.
    """
    pieces = F.split(F.regexp_replace(text, PATTERNS[kind], f"{MARK}$0{MARK}"), MARK, -1)
    rank = KINDS.index(kind)
    empty = F.expr(f"cast(array() as {SPAN})")

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def named(around: Column) -> Column:
        return F.lower(around).rlike(CONTEXT_WORDS[kind])

    def with_after(x: Column) -> Column:
        """Pieces, and for each match whether a context word follows it; the heads of the next pieces hold all it takes."""
        following = lambda i: F.left(F.array_join(F.slice(x["heads"], i + 2, F.lit(REACH)), ""), F.lit(CONTEXT))
        return F.transform(x["pieces"], lambda p, i: F.struct(p.alias("text"), ((i % 2 == 1) & named(following(i))).alias("after")))

    def step(state: Column, piece: Column) -> Column:
        stop = state["at"] + F.length(piece["text"])
        near = piece["after"] | named(state["before"])
        score = F.least(F.lit(1.0), F.lit(START_SCORE[kind]) + F.when(near, 0.3).otherwise(0.0))
        span = F.array(F.struct(state["at"].alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), score.alias("score"))).cast(SPAN)
        keep = state["inside"] & _valid(kind, piece["text"]) & (score >= MIN_SCORE)
        before = F.right(F.concat(state["before"], piece["text"]), F.lit(CONTEXT))
        return F.struct(stop.alias("at"), before.alias("before"), (~state["inside"]).alias("inside"), F.when(keep, F.concat(state["found"], span)).otherwise(state["found"]).alias("found"))

    def walk(chunk: Column, at: Column, before: Column) -> Column:
        first = F.struct(at.alias("at"), before.alias("before"), F.lit(False).alias("inside"), empty.alias("found"))
        return F.aggregate(chunk, first, step, lambda s: s["found"])

    def in_chunks(parts: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int")), lambda c: F.slice(parts, c * CHUNK + 1, F.lit(CHUNK)))
        sized = F.struct(chunks.alias("chunks"), F.transform(chunks, lambda c: _sum(F.transform(c, lambda p: F.length(p["text"])))).alias("sizes"))

        def of(x: Column) -> Column:
            ahead = lambda i: F.coalesce(F.right(F.array_join(F.get(x["chunks"], i - 1)["text"], ""), F.lit(CONTEXT)), F.lit(""))
            return F.flatten(F.transform(x["chunks"], lambda c, i: walk(c, _sum(F.slice(x["sizes"], F.lit(1), i)), ahead(i))))

        return let(sized, of)

    def whole(parts: Column) -> Column:
        return F.when(F.size(parts) <= CHUNK, walk(parts, F.lit(0), F.lit(""))).otherwise(in_chunks(parts))

    hint = text.contains(HINTS[kind]) if HINTS[kind] else text.rlike("[0-9]")
    headed = let(pieces, lambda p: F.struct(p.alias("pieces"), F.transform(p, lambda x: F.left(x, F.lit(CONTEXT))).alias("heads")))
    found = let(let(headed, with_after), whole)
    return F.when(hint & text.rlike(PATTERNS[kind]), found).otherwise(empty)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``found``, an array of (start, rank in KINDS, stop, score), in order of start."""
    clean = F.translate(F.coalesce(F.col(text_col), F.lit("")), MARK, STAND_IN)
    parts = docs.select(F.col(id_col), clean.alias("_text")).select(F.col(id_col), *[_spans(k, F.col("_text")).alias(f"_{k}") for k in KINDS])
    return parts.select(id_col, F.array_sort(F.concat(*[f"_{k}" for k in KINDS])).alias("found"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def summarise(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    spans = F.col("found")
    base = F.filter(spans, lambda s: s["rank"] < len(BASE))

    def count(rank: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    counts = [count(r) for r in range(len(KINDS))]
    top = F.coalesce(F.round(F.array_max(F.transform(spans, lambda s: s["score"])), 6), F.lit(0.0))
    return found.select(id_col, *counts[: len(BASE)], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"), *counts[len(BASE) :], top.alias("top_score"))


def query(spark, sf_dir):
    return summarise(find_pii(read_table(spark, sf_dir, "documents")))


def _sql_kind(kind: str, pattern: str, valid: str, marked: str = f"{MARK}\\0{MARK}") -> str:
    rank, score, words = KINDS.index(kind), START_SCORE[kind], CONTEXT_WORDS[kind]
    return f"""
  SELECT n, {rank} AS rank, '{kind}' AS kind, start, start + length(m) AS stop, least(1.0, {score} + CASE WHEN near THEN 0.3 ELSE 0 END)::DOUBLE AS score
  FROM (SELECT n, m, start, regexp_matches(lower(substr(t, greatest(start - {CONTEXT}, 0) + 1, least(start, {CONTEXT}))), '{words}')
                            OR regexp_matches(lower(substr(t, start + length(m) + 1, {CONTEXT})), '{words}') AS near
        FROM (SELECT n, t, p[i] AS m, coalesce(list_sum(list_transform(p[1:i-1], lambda x: length(x))), 0)::BIGINT AS start
              FROM (SELECT n, t, p, unnest(range(2, len(p) + 1, 2)) AS i
                    FROM (SELECT n, t, string_split(regexp_replace(t, '{pattern}', '{marked}', 'g'), '{MARK}') AS p FROM d))))
  WHERE {valid} AND {score} + CASE WHEN near THEN 0.3 ELSE 0 END >= {MIN_SCORE}"""


def oracle() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = (
        f"len({digits}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, len({digits}) + 1), lambda i: CASE WHEN (len({digits}) - i) % 2 = 0 THEN {digits}[i]::INT "
        f"ELSE 2 * {digits}[i]::INT - CASE WHEN {digits}[i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    )
    plain = "replace(m, ' ', '')"
    turned = f"({plain}[5:] || {plain}[1:4])"
    mod97 = f"list_aggregate(list_transform(string_split({turned}, ''), lambda c: CASE WHEN c < 'A' THEN c ELSE (ascii(c) - 55)::VARCHAR END), 'string_agg', '')::HUGEINT % 97 = 1"
    kinds = [
        _sql_kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        _sql_kind("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", f"regexp_matches(m, '{IP_PARTS}')"),
        _sql_kind("card", r"[0-9]([\x20-]?[0-9])+", luhn),
        _sql_kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({digits}) BETWEEN 10 AND 15"),
        # Without look-around here, the neighbours are matched too and put back outside the marks.
        _sql_kind("iban", r"(^|[^A-Za-z0-9])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)($|[^A-Za-z0-9])", mod97, f"\\1{MARK}\\2{MARK}\\3"),
        _sql_kind("ssn", r"(^|[^0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})($|[^0-9-])", "true", f"\\1{MARK}\\2{MARK}\\3"),
    ]
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, translate(coalesce(text, ''), '{MARK}', '{STAND_IN}') AS t FROM documents),
s AS ({" UNION ALL ".join(kinds)}),
g AS (SELECT n, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
             count(*) FILTER (kind = 'phone') AS n_phone, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 4) AS base,
             count(*) FILTER (kind = 'iban') AS n_iban, count(*) FILTER (kind = 'ssn') AS n_ssn, round(max(score), 6) AS top_score
      FROM s GROUP BY n)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_iban, 0)::BIGINT AS n_iban, coalesce(n_ssn, 0)::BIGINT AS n_ssn, coalesce(top_score, 0)::DOUBLE AS top_score
FROM d LEFT JOIN g USING (n)
"""

