"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

In DataFrame functions only. Cards are confirmed by Luhn, IBANs by mod 97, addresses by their parts.
The score starts at the kind's prior and rises if one of the kind's words stands in the ``CONTEXT``
code points before the span or after it, whatever else matches there. Social security numbers have
no checksum and are only kept if such a word stands there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .spans import Kind, all_spans, base_digest, count_of, rebuilt, span_sql, told

CONTEXT, RISE, LIKELY = 40, 25, 75
#: Prior and context words by kind.
SCORES = {
    "email": (70, "mail|contact|write|reach"),
    "ip": (50, "ip|address|server|host|login"),
    "card": (80, "card|visa|credit|pay"),
    "phone": (50, "phone|tel|call|mobile|fax"),
    "iban": (80, "iban|account|bank|konto"),
    "ssn": (50, "ssn|social|security"),
}


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def worth(x: Column, i: Column) -> Column:
        d = x.cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    values = F.transform(F.split(F.reverse(c), ""), worth)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(c: Column) -> Column:
    """Whether an IBAN (spaces allowed) leaves 1 when divided by 97."""
    plain = F.replace(c, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    values = F.transform(F.split(turned, ""), lambda x: F.position(x, F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")) - 1)
    return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _between(n: Column, least: int, most: int) -> Column:
    return (n >= least) & (n <= most)


def _ip(hit: Column, _: Column) -> Column:
    # a part of over 9 digits, leading zeros aside, is above 255
    return F.forall(F.split(hit, "\\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.try_to_number(F.right(p, F.lit(3)), F.lit("999")) <= 255))


def _scored(name: str):
    prior, words = SCORES[name]
    return lambda around: F.lit(prior) + F.when(around.rlike(words), RISE).otherwise(0)


#: Characters of an IBAN by country.
IBAN_CHARS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _spaced(n: int, countries: str) -> str:
    groups, rest = divmod(n - 4, 4)
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\\x20[A-Z0-9]{{4}}){{{groups}}}" + (f"\\x20[A-Z0-9]{{{rest}}}" if rest else "")


#: In groups, with as many characters as the country's have, so that no word after it is taken in; else any run.
IBAN = (
    r"(?=[A-Z]{2}[0-9]{2}\x20)(?:" + "|".join(_spaced(n, c) for n, c in IBAN_CHARS.items()) + ")(?![A-Z0-9])"
    r"|[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]++)"
)
KINDS = tuple(
    Kind(name, pattern, hint, keep, None, _scored(name), CONTEXT)
    for name, pattern, hint, keep in (
        ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", None),
        ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", _ip),
        ("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", "", lambda h, _: _between(F.length(digits_of(h)), 14, 19) & luhn(digits_of(h))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda h, _: _between(F.length(digits_of(h)), 10, 15)),
        ("iban", IBAN, "", lambda h, _: _between(F.length(F.replace(h, F.lit(" "), F.lit(""))), 15, 34) & mod97(h)),
        ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", lambda h, around: around.rlike(SCORES["ssn"][1])),
    )
)
BASE = 4


def find_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with pii: array<struct(start, place, end, value, score)>, by start, then kind; a column of that name is replaced.

    place is the kind's index in KINDS. Null and empty texts have no spans. Rows are judged one by
    one: rows that repeat get equal results, an empty table gives an empty one, other columns pass.
    """
    return df.withColumn("pii", all_spans(F.col(text_col), KINDS))


def redact(df: DataFrame, text_col: str = "text", least: int = LIKELY) -> DataFrame:
    """df with the likely spans of its text replaced by their kind in brackets; pii goes.

    The text is rebuilt from the spans' offsets, so nothing else changes; of spans that overlap all
    are replaced, by the kind of the first. A null text stays null.
    """
    names = F.array(*[F.lit(f"[{k.name.upper()}]") for k in KINDS])
    likely = F.transform(F.filter("pii", lambda s: s["score"] >= least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["place"]).alias("mark")))
    return find_pii(df, text_col).withColumn(text_col, F.when(F.size(likely) > 0, rebuilt(F.col(text_col), likely)).otherwise(F.col(text_col))).drop("pii")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    p = F.col("pii")
    return found.select(
        "doc_id",
        *[count_of(p, i).alias(f"n_{k.name}") for i, k in enumerate(KINDS)],
        base_digest(p, KINDS, BASE).alias("base_sha256"),
        told(p, KINDS).alias("spans"),
        F.size(F.filter(p, lambda s: s["score"] >= LIKELY)).cast("long").alias("n_likely"),
    )


_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) WHEN CAST(c AS INT) > 4 THEN CAST(c AS INT) * 2 - 9 ELSE CAST(c AS INT) * 2 END)) % 10 = 0"
_PLAIN = "replace(hit, ' ', '')"
_MOD97 = f"list_reduce(list_transform(string_split(substr({_PLAIN}, 5) || substr({_PLAIN}, 1, 4), ''), lambda c: CAST(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1 AS BIGINT)), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97, 0::BIGINT) = 1"
_SCORE = " ".join(f"WHEN {i} THEN {SCORES[k.name][0]} + CASE WHEN regexp_matches(ctx, '{SCORES[k.name][1]}') THEN {RISE} ELSE 0 END" for i, k in enumerate(KINDS))
OP9_SQL = (
    "WITH"
    + span_sql(
        [
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and(list_transform(string_split(hit, '.'), lambda p: CAST(p AS HUGEINT) <= 255))"),
            ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
            ("iban", r"[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]+)", f"length({_PLAIN}) BETWEEN 15 AND 34 AND {_MOD97}"),
            ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "regexp_matches(ctx, 'ssn|social|security')"),
        ],
        CONTEXT,
    )
    + f""",
g AS (SELECT rid, {', '.join(f"count(*) FILTER (place = {i}) AS n_{k.name}" for i, k in enumerate(KINDS))},
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place < {BASE}) AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans,
             count(*) FILTER ((CASE place {_SCORE} END) >= {LIKELY}) AS n_likely FROM y GROUP BY rid)
SELECT d.doc_id, {', '.join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in KINDS)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_likely, 0) AS n_likely
FROM d LEFT JOIN g USING (rid)
"""
)
