"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Each kind has a pattern, a check of the matched text, a starting score, and words that raise the score when they
stand within NEAR characters of the span. Matches are leftmost and do not overlap within a kind; a match that
fails its check is dropped and not tried again shorter. The four base kinds stay whatever their score. The
further kinds are kept from SCORE_KEPT on: iban (mod-97; its country says how long it is, so words that follow it are
no part of it) needs no word, secret (32 or more hexadecimal digits) does.

The patterns are written so that a start inside a run of the same characters is never tried, and so that repeated
groups do not nest calls: time is linear in the text, whatever its length. Spans are code points, end exclusive.
Null texts count as empty; texts without spans give empty strings and zeros. Repeated rows are searched alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters on each side of a span in which words count.
NEAR = 40
#: Score that a span of a further kind needs.
SCORE_KEPT = 0.5
#: What a word nearby adds.
WORD_ADDS = 0.4
_CHUNK = 256
#: Characters of an account number of the international format (ISO 13616), by country code.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban_pattern() -> str:
    """Country codes by length, then groups of four as long as the country has them: words that follow are left out."""
    by: dict[int, list[str]] = {}
    for code, n in IBAN_LENGTHS.items():
        by.setdefault(n, []).append(code)
    body = lambda n: rf"(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    return r"\b(?:" + "|".join(f"(?:{'|'.join(codes)})[0-9]{{2}}{body(n)}" for n, codes in by.items()) + r")\b"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    words: str
    base: bool
    needs: str = ""  # a character without which the text has no match


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write", True, "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.5, "ip|address|server|host", True, "."),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+", 0.7, "card|visa|credit|payment", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|tel|call|fax", True, "+"),
    Kind("iban", _iban_pattern(), 0.8, "iban|bank|account", False),
    Kind("secret", r"\b[0-9a-fA-F]{32,}+\b", 0.2, "token|secret|key|password", False),
)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    both = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)),
    )
    return F.aggregate(both, F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether letters and digits, the first four moved to the end, leave 1 when divided by 97 (A is 10, Z is 35)."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    return F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    ) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        code = F.replace(m, F.lit(" "), F.lit(""))
        return mod97(code)
    return F.lit(True)


def _ends(lengths: Column) -> Column:
    """Running sums of an array of integers, in two levels so that long arrays stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    n = F.size(lengths)
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(n / _CHUNK).cast("int") - 1), lambda c: total(F.slice(lengths, c * _CHUNK + 1, F.lit(_CHUNK))))
    return F.element_at(
        F.transform(
            F.array(chunks),
            lambda sums: F.transform(
                F.sequence(F.lit(0), n - 1),
                lambda i: total(F.slice(sums, F.lit(1), F.floor(i / _CHUNK).cast("int"))) + total(F.slice(lengths, F.floor(i / _CHUNK).cast("int") * _CHUNK + 1, i % _CHUNK + 1)),
            ),
        ),
        1,
    )


_NONE = "array<struct<start:int,end:int,score:double>>"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and, for each kind, an array of (start, end, score) in order of start."""
    names = [k.name for k in KINDS]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    none = F.array().cast("array<string>")
    rows = rows.select(
        "doc_id", "text", *[(F.when(F.instr("text", k.needs) > 0, F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).otherwise(none) if k.needs else F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).alias(f"m_{k.name}") for k in KINDS]
    )
    # What lies between the matches: the same pattern splits the text, so piece i stands before match i.
    rows = rows.select("doc_id", *[f"m_{n}" for n in names], *[F.when(F.size(f"m_{k.name}") > 0, F.split("text", k.pattern, -1)).otherwise(none).alias(f"p_{k.name}") for k in KINDS])
    # A piece of length 0 at the start is kept by split, as no match is empty.
    rows = rows.select(
        "doc_id",
        *[f"m_{n}" for n in names],
        *[f"p_{n}" for n in names],
        *[F.when(F.size(f"m_{n}") > 0, F.zip_with(F.slice(f"p_{n}", 1, F.size(f"m_{n}")), f"m_{n}", lambda p, m: F.length(p) + F.length(m))).otherwise(F.array().cast("array<int>")).alias(f"l_{n}") for n in names],
    )
    rows = rows.select(
        "doc_id", *[f"m_{n}" for n in names], *[f"p_{n}" for n in names], *[F.when(F.size(f"l_{n}") > 0, _ends(F.col(f"l_{n}"))).otherwise(F.array().cast("array<int>")).alias(f"e_{n}") for n in names]
    )

    def spans(k: Kind) -> Column:
        m, p, e = F.col(f"m_{k.name}"), F.col(f"p_{k.name}"), F.col(f"e_{k.name}")

        def one(end: Column, i: Column) -> Column:
            near = F.lower(F.concat(F.right(F.get(p, i), F.lit(NEAR)), F.lit(" "), F.left(F.get(p, i + 1), F.lit(NEAR))))
            score = F.least(F.lit(k.score) + F.when(near.rlike(rf"\b(?:{k.words})"), F.lit(WORD_ADDS)).otherwise(F.lit(0.0)), F.lit(1.0))
            return F.when(_valid(k.name, F.get(m, i)), F.struct((end - F.length(F.get(m, i))).alias("start"), end.alias("end"), score.alias("score")))

        kept = F.filter(F.transform(e, one), lambda s: s.isNotNull() if k.base else s.isNotNull() & (s["score"] >= SCORE_KEPT))
        return F.when(F.size(m) > 0, kept).otherwise(F.array().cast(_NONE)).alias(k.name)

    return rows.select("doc_id", *[spans(k) for k in KINDS])


def _joined(kinds: list[str]) -> Column:
    def texts(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat(F.lit(kind + ":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(texts, kinds)), ",")


def op5(spark, sf_dir: str) -> DataFrame:
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = [k.name for k in KINDS if k.base]
    every = [k.name for k in KINDS]
    top = F.coalesce(F.array_max(F.transform(F.concat(*every), lambda s: s["score"])), F.lit(0.0))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in every], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(every).alias("spans"), F.round(top, 3).alias("top_score")
    )


def _kind_sql(k: Kind) -> str:
    base = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "iban": r"\b(?:" + "|".join(rf"{code}\d\d(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}(?: ?[A-Z0-9]{{{n % 4}}}){{{int(n % 4 > 0)}}}" for code, n in sorted(IBAN_LENGTHS.items())) + r")\b",
        "secret": k.pattern.replace("}+", "}"),
    }.get(k.name, k.pattern)
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    valid = {
        "ip": "len(list_filter(string_split(m, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 999) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse({digits}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) WHEN CAST(c AS INT) > 4 THEN CAST(c AS INT) * 2 - 9 ELSE CAST(c AS INT) * 2 END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, b: (a * (CASE WHEN b > 9 THEN 100 ELSE 10 END) + b) % 97) = 1",
    }.get(k.name, "true")
    score = f"least({k.score} + CASE WHEN regexp_matches(lower(right(p, {NEAR}) || ' ' || left(q, {NEAR})), '\\b(?:{k.words})') THEN {WORD_ADDS} ELSE 0.0 END, 1.0)"
    return f"""
x_{k.name} AS (SELECT doc_id, regexp_extract_all(t, '{base}') AS ms, string_split_regex(t, '{base}') AS ps FROM t),
y_{k.name} AS (SELECT doc_id, unnest(list_transform(ms, lambda m, i: {{'m': m, 'p': ps[i], 'q': ps[i + 1], 'e': list_sum(list_transform(ps[:i], lambda z: length(z))) + list_sum(list_transform(ms[:i], lambda z: length(z)))}})) AS s FROM x_{k.name}),
z_{k.name} AS (SELECT doc_id, s.e AS e, s.m AS m, s.p AS p, s.q AS q FROM y_{k.name}),
k_{k.name} AS (SELECT doc_id, count(*) AS n, max(score) AS score, string_agg('{k.name}:' || CAST(CAST(e - length(m) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR), ',' ORDER BY e) AS spans
  FROM (SELECT *, {score} AS score FROM z_{k.name} WHERE {valid}){'' if k.base else f' WHERE score >= {SCORE_KEPT}'} GROUP BY doc_id)"""


def _op5_sql() -> str:
    joined = lambda some: f"coalesce(concat_ws(',', {', '.join(f'k_{k.name}.spans' for k in some)}), '')"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),{",".join(_kind_sql(k) for k in KINDS)}
SELECT t.doc_id, {", ".join(f"CAST(coalesce(k_{k.name}.n, 0) AS BIGINT) AS n_{k.name}" for k in KINDS)}, sha256({joined([k for k in KINDS if k.base])}) AS base_sha256, {joined(KINDS)} AS spans,
round(CAST(greatest({", ".join(f"coalesce(k_{k.name}.score, 0)" for k in KINDS)}) AS DOUBLE), 3) AS top_score
FROM t {" ".join(f"LEFT JOIN k_{k.name} ON t.doc_id = k_{k.name}.doc_id" for k in KINDS)}
"""


OP5_SQL = _op5_sql()
