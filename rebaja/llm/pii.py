"""Personal data in texts: patterns propose, checksums confirm, context words adjust the score. DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rebaja.llm.common import free_name, prefix_sums, texts

# The kinds in their order, and the patterns of the first four.
# Possessive forms and look-behinds give the same matches as the plain patterns
# (leftmost, longest run, non-overlapping) in one pass and without recursion.
KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
BASE = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
# What a text must hold for a pattern to be tried at all.
HINTS = {"email": "@", "phone": "+"}
# Score of a confirmed proposal, and the words before it that raise or lower the score.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.4}
RAISES = {
    "email": r"\b(?:e-?mail|mail|contact|correo|courriel)\b",
    "ip": r"\b(?:ip|host|server|address|adresse|dirección)\b",
    "card": r"\b(?:card|visa|credit|debit|karte|tarjeta|carte)\b",
    "phone": r"\b(?:phone|call|tel|mobile|fax|telefon|teléfono|téléphone)\b",
    "iban": r"\b(?:iban|account|bank|konto|cuenta|compte)\b",
    "national_id": r"\b(?:ssn|social\s+security|tax\s+id|national\s+id|id\s+number)\b",
}
LOWERS = r"\b(?:example|sample|version|order|invoice|ticket|part|serial|ref)\b"
CONTEXT, STEP, THRESHOLD = 40, 0.3, 0.5


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where the digits pass the Luhn check."""
    at = F.sequence(F.lit(1), F.length(digits))
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((F.length(digits) - i) % 2 == 1, doubled(d)).otherwise(d)
    return F.aggregate(at, F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """True where the account number, its first four signs put last and letters as 10 to 35, leaves 1 by 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    """Validator of each kind."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(match)).between(12, 19), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return F.when(F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34), mod97(match)).otherwise(False)
    if kind == "national_id":
        return ~match.rlike("^(?:000|666|9)") & ~match.rlike("-00-") & ~match.rlike("0000$")
    return F.lit(True)


def _matches(kind: str, text: Column) -> tuple[Column, Column]:
    """What lies between the matches, and the matches: one more gap than matches."""
    may = text.contains(HINTS[kind]) if kind in HINTS else text.rlike("[0-9]")
    pattern = F.lit(PATTERNS[kind])
    return (F.when(may, F.split(text, PATTERNS[kind], -1)).otherwise(F.array(text)),
            F.when(may, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.array().cast("array<string>")))


def _score(kind: str, before: Column) -> Column:
    near = F.lower(F.right(before, F.lit(CONTEXT)))
    return (F.lit(SCORES[kind]) + F.when(near.rlike(RAISES[kind]), STEP).otherwise(0.0) - F.when(near.rlike(LOWERS), STEP).otherwise(0.0))


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: array of (start, rank, end, kind, score), by start and then by the order of ``KINDS``.

    Positions count code points, ``end`` is exclusive. A proposal of the first
    four kinds stays when its validator confirms it, whatever its score; one of
    the added kinds also needs ``THRESHOLD``, so that a national id counts only
    with context words before it. Context is the text between the previous
    match of the kind and this one, at most ``CONTEXT`` signs. A null or empty
    text gives an empty array. A column of ``docs`` called ``out`` gives way to
    the result, all others stay, whatever their names. Cost is linear in the text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    df, own = docs, {f"{k}{s}": free_name(docs, f"__{k}{s}") for k in KINDS for s in ("", "_gaps", "_found")}
    for kind in KINDS:
        gaps, found = _matches(kind, whole)
        df = df.withColumn(own[f"{kind}_gaps"], gaps).withColumn(own[f"{kind}_found"], found)
    spans = []
    for rank, kind in enumerate(KINDS):
        gaps, found = F.col(own[f"{kind}_gaps"]), F.col(own[f"{kind}_found"])
        n = F.size(found)
        widths = F.zip_with(F.transform(F.slice(gaps, 1, n), F.length), F.transform(found, F.length), lambda g, m: g + m)
        starts = F.zip_with(prefix_sums(widths), F.transform(F.slice(gaps, 1, n), F.length), lambda s, g: s + g)
        rows = F.arrays_zip(starts.alias("start"), found.alias("found"), F.slice(gaps, 1, n).alias("before"))
        kept = F.filter(rows, lambda x: confirmed(kind, x["found"]))
        spans.append(F.when(n > 0, F.transform(kept, lambda x: F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + F.length(x["found"])).alias("end"),
            F.lit(kind).alias("kind"), _score(kind, x["before"]).alias("score")))))
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>")
    for kind, column in zip(KINDS, spans):
        df = df.withColumn(own[kind], F.coalesce(column.cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>"), empty))
    every = F.concat(*[F.col(own[k]) for k in KINDS])
    sure = F.filter(every, lambda x: (x["rank"] < len(BASE)) | (x["score"] >= THRESHOLD))
    return df.withColumn(out, F.array_sort(sure)).drop(*own.values())


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every confirmed match in ``text`` replaced by the name of its kind in brackets; other columns stay.

    Kinds are taken one after the other, each on what the earlier ones left, so
    overlapping matches are covered by the first kind. A null text stays null.
    """
    df, between, matched = docs, free_name(docs, "__gaps"), free_name(docs, "__found")
    for kind in KINDS:
        gaps, found = _matches(kind, F.col(text))
        df = df.withColumn(between, gaps).withColumn(matched, found)
        n = F.size(matched)

        def tail(gap: Column, match: Column) -> Column:
            ok = confirmed(kind, match) if kind in BASE else confirmed(kind, match) & (_score(kind, gap) >= THRESHOLD)
            return F.concat(gap, F.when(ok, F.lit(f"[{kind.upper()}]")).otherwise(match))
        joined = F.concat(F.array_join(F.zip_with(F.slice(between, 1, n), F.col(matched), tail), ""), F.element_at(between, -1))
        df = df.withColumn(text, F.when(n > 0, joined).otherwise(F.col(text))).drop(between, matched)
    return df


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, hash of the base spans, all spans as text."""
    found = find_pii(texts(docs))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("pii", lambda x: x["rank"] < len(BASE))
    count = lambda r: F.size(F.filter("pii", lambda x: x["rank"] == r)).cast("long")
    return found.select("doc_id", *[count(r).alias(f"n_{k}") for r, k in enumerate(BASE)],
                        F.sha2(said(base), 256).alias("base_sha256"), said(F.col("pii")).alias("spans"))


def _sql() -> str:
    """The same digest for DuckDB, from the plain patterns."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    keep = {
        "email": "true",
        "ip": "list_max([try_cast(x AS DOUBLE) FOR x IN string_split(m, '.')]) <= 255",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND list_sum([CASE WHEN (length({digits}) - i) % 2 = 1 THEN (CASE WHEN CAST(substr({digits}, i, 1) AS INT) > 4 THEN CAST(substr({digits}, i, 1) AS INT) * 2 - 9 ELSE CAST(substr({digits}, i, 1) AS INT) * 2 END) ELSE CAST(substr({digits}, i, 1) AS INT) END FOR i IN range(1, length({digits}) + 1)]) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
    }
    parts = []
    for rank, (kind, pattern) in enumerate(plain.items()):
        parts.append(f"""SELECT r, {rank} AS k, '{kind}' AS kind, start, start + length(m) AS stop FROM (
            SELECT r, m, sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM (SELECT r, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g, unnest(range(len(ms))) AS i
                  FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d) WHERE len(ms) > 0)
            WINDOW w AS (PARTITION BY r ORDER BY i)) WHERE {keep[kind]}""")
    union = "\nUNION ALL\n".join(parts)
    counts = ", ".join(f"CAST(count(*) FILTER (k = {rank}) AS BIGINT) AS n_{kind}" for rank, kind in enumerate(plain))
    said = "coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, k), '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    s AS ({union})
    SELECT any_value(doc_id) AS doc_id, {counts}, sha256({said}) AS base_sha256, {said} AS spans
    FROM d LEFT JOIN s USING (r) GROUP BY r"""


#: The tables hold no account numbers and no national ids with context words, so here the added kinds find nothing and all spans are base spans.
SQL = _sql()
