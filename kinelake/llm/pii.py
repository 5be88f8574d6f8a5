"""Personal data in texts, with DataFrame functions alone: patterns propose spans, checks confirm them, context adjusts the score.

Kinds email, ip, card and phone are the base: a proposal that fails its check is dropped and not tried again, and what
passes stays whatever its score, so context decides on the added kinds only. Kinds iban (mod-97) and ssn (no checksum: it needs a context word) are added where
their score, in percent, reaches THRESHOLD. Positions are code points, the end exclusive.

The patterns are written so that Java's matcher is linear and does not recurse: runs are possessive, and a match can begin
inside a run of its first characters only where the last match ended, since from within a run it would fail just the same.

Defined results: a null text is empty and has no spans; overlapping spans of different kinds all stay; rows keep their
multiplicity; only the text column is read, the others pass through, and one named like the result's is replaced by it; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = r"[A-Za-z0-9._%+-]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = 4
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Score in percent before and after a confirming context word within CONTEXT code points before the span.
SCORES = {"email": (80, 95), "ip": (55, 80), "card": (75, 95), "phone": (50, 80), "iban": (75, 95), "ssn": (35, 70)}
CONTEXT, THRESHOLD = 48, 50
#: Matches are placed in blocks of this size: one growing array would be copied for each of a text's matches.
BLOCK = 256
WORDS = {
    "email": r"mail|contact|correo|courriel|kontakt",
    "ip": r"\bip\b|address|server|host|login",
    "card": r"card|visa|credit|pay|tarjeta|carte|karte",
    "phone": r"phone|tel|call|mobile|fax|llam|appel|anruf",
    "iban": r"iban|bank|account|konto|cuenta|compte",
    "ssn": r"ssn|social|security",
}
SPAN = "struct<start: int, kind_no: int, end: int, kind: string, score: int>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits, short enough to fold over, passes Luhn's checksum."""

    def weighed(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (F.lit(1) + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    at = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(at, F.lit(0), lambda s, i: s + weighed(i)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether letters and digits, the first four moved to the end, leave 1 modulo 97."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": lambda m: F.length(_only_digits(m)).between(14, 19) & luhn(_only_digits(m)),
    "phone": lambda m: F.length(_only_digits(m)).between(10, 15),
    "iban": lambda m: F.length(F.replace(m, F.lit(" "))).between(15, 34) & mod97(F.replace(m, F.lit(" "))),
    "ssn": lambda m: ~m.rlike(r"^(?:000|666|9)|-00-|-0000$"),
}
#: A text without a match of this can't hold the kind; far cheaper than its pattern.
HINTS: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "ssn": lambda t: t.rlike(r"[0-9]-[0-9]"),
}


def spans_of(text: Column, kind: str) -> Column:
    """array<SPAN> of one kind in a non-null text: lengths of what lies between the matches give their places, its end their context."""
    pattern, no = PATTERNS[kind], KINDS.index(kind)
    none = F.lit(None).cast(f"array<{SPAN}>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    low, high = SCORES[kind]
    hits = "array<struct<start: int, end: int, score: int>>"
    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["between"])
        end = start + F.length(x["hit"])
        near = F.right(F.concat(acc["near"], x["between"]), F.lit(CONTEXT))
        score = F.when(F.lower(near).rlike(WORDS[kind]), F.lit(high)).otherwise(F.lit(low))
        kept = F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), score.alias("score"))))
        out = F.when(CHECKS[kind](x["hit"]), kept).otherwise(acc["out"])
        return F.struct(end.alias("at"), F.right(F.concat(near, x["hit"]), F.lit(CONTEXT)).alias("near"), out.alias("out"))

    def place_block(pairs: Column) -> Callable[[Column, Column], Column]:
        def step(acc: Column, i: Column) -> Column:
            inner = F.struct(acc["at"].alias("at"), acc["near"].alias("near"), F.array().cast(hits).alias("out"))
            # bound once as the one element of an array, so the block is not placed again for each field
            done = F.transform(F.array(F.aggregate(F.slice(pairs, i * BLOCK + 1, F.lit(BLOCK)), inner, place)), lambda d: F.struct(d["at"].alias("at"), d["near"].alias("near"), F.concat(acc["out"], F.array(d["out"])).alias("out")))
            return done[0]

        return step

    pairs = F.filter(F.zip_with(between, found, lambda b, m: F.struct(b.alias("between"), m.alias("hit"))), lambda x: x["hit"].isNotNull())
    outer = F.struct(F.lit(0).alias("at"), F.lit("").alias("near"), F.array().cast(f"array<{hits}>").alias("out"))
    blocks = lambda p: F.sequence(F.lit(0), F.floor(F.size(p) / BLOCK).cast("int"))
    placed = F.transform(F.array(pairs), lambda p: F.flatten(F.aggregate(blocks(p), outer, place_block(p))["out"]))[0]
    spans = F.transform(placed, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["score"].alias("score")))
    if no >= BASE:
        spans = F.filter(spans, lambda s: s["score"] >= THRESHOLD)
    hint = HINTS.get(kind, lambda t: t.rlike("[0-9]"))(text)
    return F.when(hint, F.coalesce(spans, none)).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_pii(docs: DataFrame, text_col: str = "text", into: str = "pii_spans") -> DataFrame:
    """docs with column ``into``: all spans, by start, then kind as in KINDS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(into, F.array_sort(F.concat(*[spans_of(text, k) for k in KINDS])))


def redacted(text: Column, spans: Column, block: int = 64) -> Column:
    """The text with every span (in order) replaced by its kind in brackets; of overlapping spans the first stands, and the rest of a longer one goes too.

    Finding a position in a text takes time by its distance from the start, so the text is cut once per `block` spans and the pieces are cut from
    that stretch; pieces are joined at the end.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / block).cast("int")), lambda b: F.slice(spans, b * block + 1, block))
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))

    def piece(z: Column, held: Column, s: Column, i: Column) -> Column:
        before = F.greatest(z["at"], F.array_max(F.transform(F.slice(held, F.lit(1), i), lambda y: y["end"])))  # greatest passes over null: nothing came before
        return F.when(s["start"] >= before, F.concat(F.substring(z["text"], before - z["at"] + 1, s["start"] - before), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")

    def step(acc: Column, held: Column) -> Column:
        stretch = F.substring(text, acc["at"] + 1, F.greatest(F.element_at(held, -1)["start"] - acc["at"], F.lit(0)))
        once = F.array(F.struct(stretch.alias("text"), acc["at"].alias("at")))  # a lambda's argument is evaluated once
        joined = F.transform(once, lambda z: F.array_join(F.transform(held, lambda s, i: piece(z, held, s, i)), ""))
        return F.struct(F.concat(acc["out"], joined).alias("out"), F.greatest(acc["at"], F.array_max(F.transform(held, lambda s: s["end"]))).alias("at"))

    done = F.aggregate(blocks, state, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = F.col("pii_spans")
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter(spans, lambda x: x["kind_no"] < BASE)
    count = lambda no: F.size(F.filter(spans, lambda x: x["kind_no"] == no)).cast("long")
    return find_pii(docs).select(
        "doc_id",
        *[count(no).alias(f"n_{k}") for no, k in enumerate(KINDS[:BASE])],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda x: x["score"].cast("string")), ",").alias("scores"),
    )


def _oracle() -> str:
    """DuckDB's patterns know no lookaround: an ssn fills a run of digits and dashes, an iban stands between word bounds once an underscore is none."""
    plain = {
        "email": ("text", rf"{LOCAL}+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        "ip": ("text", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        "card": ("text", r"[0-9]([ -]?[0-9])+"),
        "phone": ("text", PATTERNS["phone"]),
        "iban": ("replace(text, '_', '.')", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b"),
        "ssn": ("text", r"[0-9-]+"),
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    turned = "substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4)"
    values = f"list_transform(string_split({turned}, ''), lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)"
    weighed = f"list_transform(range(0, length({digits})), lambda i: CAST({digits}[length({digits}) - i] AS INT) * (1 + i % 2))"
    passes = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(m, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE CAST('0' || ltrim(x, '0') AS INT) END)) <= 255",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND list_sum(list_transform({weighed}, lambda v: CASE WHEN v > 9 THEN v - 9 ELSE v END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
        "iban": f"length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, {values}), lambda r, v: (CASE WHEN v > 9 THEN r * 100 ELSE r * 10 END + v) % 97) = 1",
        "ssn": "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')",
    }
    parts = []
    for no, kind in enumerate(KINDS):
        source, pattern = plain[kind]
        low, high = SCORES[kind]
        parts.append(f"""
            SELECT row, text, {no} AS no, '{kind}' AS kind, start, start + length(m) AS stop, m,
                   CASE WHEN regexp_matches(lower(substr(text, greatest(1, start - {CONTEXT - 1}), least(start, {CONTEXT}))), '{WORDS[kind]}') THEN {high} ELSE {low} END AS score
            FROM (SELECT row, text, m, CAST(sum(length(b)) OVER o + coalesce(sum(length(m)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
                  FROM (SELECT row, text, unnest(ms) AS m, unnest(regexp_split_to_array({source}, '{pattern}')[:len(ms)]) AS b, generate_subscripts(ms, 1) AS n
                        FROM (SELECT row, text, regexp_extract_all({source}, '{pattern}') AS ms FROM d))
                  WINDOW o AS (PARTITION BY row ORDER BY n))
            WHERE {passes[kind]}""")
    listed = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no){}, '')"
    base = f" FILTER (WHERE no < {BASE})"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
        s AS ({" UNION ALL ".join(parts)}),
        f AS (SELECT * FROM s WHERE no < {BASE} OR score >= {THRESHOLD})
        SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE no = {no}) AS n_{k}" for no, k in enumerate(KINDS[:BASE]))},
               sha256({listed.format(base)}) AS base_sha256, {listed.format("")} AS spans, coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY start, no), '') AS scores
        FROM d LEFT JOIN f USING (row) GROUP BY row, doc_id"""


ORACLE = _oracle()
