"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Everything is a column expression. Spark's pattern functions give the matches and the pieces between them; the lengths of
both, summed in order, are the positions. Sums run in two levels so that a text with very many matches stays linear.
Patterns never look at the same run of characters twice: a start inside a run is ruled out by a look-behind, and
repetitions are possessive, so a long text without spaces costs no more than any other.

The four base kinds keep every span that passes its own check, whatever stands nearby. The further kinds (iban, ssn,
secret) need a score of at least one half.

Defined cases: a null or empty text has no spans (base_sha256 is that of the empty string); repeated rows are reported one
by one; other columns are ignored by `personal_data` and kept by `masked`; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEARBY = 40
ACCEPT = 0.5
CONTEXT = 0.3
STEP = 128


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # cheap test that a text can hold a match
    check: str  # SQL on x: the match m, its digits d, and a, the match without spaces
    score: float
    near: str  # nearby words that raise the score
    base: bool = True


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_LUHN = (
    "aggregate(transform(sequence(1, length(x.d)), i -> (CAST(substr(x.d, -i, 1) AS INT) * (2 - i % 2))),"
    " 0, (s, v) -> s + IF(v > 9, v - 9, v)) % 10 = 0"
)
_MOD97 = (
    "aggregate(split(concat(substr(x.a, 5), substr(x.a, 1, 4)), ''), 0, (r, c) ->"
    " IF(c BETWEEN '0' AND '9', (r * 10 + ascii(c) - 48) % 97, (r * 100 + ascii(c) - 55) % 97)) = 1"
)

KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "t LIKE '%@%'",
        "true",
        0.9,
        "(?i)mail|contact|write|kontakt|correo|courriel",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        "true",
        rf"x.m RLIKE '^{_OCTET}([.]{_OCTET}){{3}}$'",
        0.6,
        "(?i)\\bip\\b|addr|host|server|login",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        "true",
        f"IF(length(x.d) BETWEEN 14 AND 19, {_LUHN}, false)",
        0.8,
        "(?i)card|visa|credit|karte|carte|tarjeta|pay",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "t LIKE '%+%'",
        "length(x.d) BETWEEN 10 AND 15",
        0.7,
        "(?i)phone|call|tel|fax|mobil",
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
        "true",
        f"IF(length(x.a) BETWEEN 15 AND 34, {_MOD97}, false)",
        0.7,
        "(?i)iban|bank|konto|account|compte|cuenta",
        base=False,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        "t LIKE '%-%'",
        "true",
        0.3,
        "(?i)ssn|social|security",
        base=False,
    ),
    Kind(
        "secret",
        r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
        r"|(?<=(?:password|passwd|secret|token|api_key)\x20?[=:]\x20?[\x22\x27]?)[A-Za-z0-9_/+-]{12,}",
        "true",
        "true",
        0.4,
        "(?i)password|passwd|secret|token|api_key|akia",
        base=False,
    ),
)
BASE_KINDS = tuple(k.name for k in KINDS if k.base)
AGAINST = "(?i)isbn|version|invoice no|order no"


def _starts(pieces: str) -> str:
    """SQL array of start positions from an array of (gap, size): a running sum in blocks of STEP."""
    blocks = f"transform(sequence(0, CAST(floor((size({pieces}) - 1) / {STEP}) AS INT)), b -> slice({pieces}, b * {STEP} + 1, {STEP}))"
    return f"""
        aggregate({blocks}, named_struct('at', 0, 'out', CAST(array() AS array<array<int>>)),
            (whole, block) -> named_struct(
                'at', whole.at + aggregate(block, 0, (s, p) -> s + p.gap + p.size),
                'out', array_append(whole.out, aggregate(block,
                    named_struct('at', whole.at, 'out', CAST(array() AS array<int>)),
                    (part, p) -> named_struct('at', part.at + p.gap + p.size, 'out', array_append(part.out, part.at + p.gap)),
                    part -> part.out))),
            whole -> flatten(whole.out))"""


def with_spans(df: DataFrame) -> DataFrame:
    """Adds `spans` to a table with the text in column `t` (not null): start, kind rank, end, kind, base, score."""
    columns = df.columns
    for k in KINDS:
        df = df.withColumn(
            f"m_{k.name}",
            F.when(F.expr(k.hint), F.regexp_extract_all("t", F.lit(k.pattern), F.lit(0))).otherwise(
                F.array().cast("array<string>")
            ),
        )
    for k in KINDS:
        found = F.col(f"m_{k.name}")
        df = df.withColumn(
            f"p_{k.name}",
            F.when(
                F.size(found) > 0,
                F.zip_with(
                    found,
                    F.slice(F.split("t", k.pattern, -1), F.lit(1), F.size(found)),
                    lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size")),
                ),
            ),
        )
    for k in KINDS:
        df = df.withColumn(f"s_{k.name}", F.expr(f"CASE WHEN p_{k.name} IS NOT NULL THEN {_starts(f'p_{k.name}')} END"))
    parts = []
    for rank, k in enumerate(KINDS):
        named = f"""transform(filter(transform(m_{k.name}, (m, i) -> named_struct(
                'm', m, 'at', s_{k.name}[i],
                'd', regexp_replace(m, '[^0-9]', ''), 'a', replace(m, ' ', ''))),
            x -> {k.check}), x -> named_struct(
                'start', x.at, 'rank', {rank}, 'end', x.at + length(x.m), 'kind', '{k.name}', 'base', {str(k.base).lower()},
                'score', least(1.0D, {k.score}D
                    + IF(concat(substr(t, greatest(x.at - {NEARBY}, 0) + 1, x.at - greatest(x.at - {NEARBY}, 0)), ' ',
                        {"x.m, ' ', " if k.name == "secret" else ""}substr(t, x.at + length(x.m) + 1, {NEARBY}))
                        RLIKE '{_quoted(k.near)}', {CONTEXT}D, 0D)
                    - IF(substr(t, greatest(x.at - {NEARBY}, 0) + 1, x.at - greatest(x.at - {NEARBY}, 0))
                        RLIKE '{_quoted(AGAINST)}', {CONTEXT}D, 0D))))"""
        parts.append(f"CASE WHEN p_{k.name} IS NOT NULL THEN {named} ELSE array() END")
    df = df.withColumn("found", F.expr(f"concat({', '.join(parts)})"))
    return df.select(
        *columns,
        F.expr(f"array_sort(filter(found, x -> x.base OR x.score >= {ACCEPT}D))").alias("spans"),
    )


def _quoted(pattern: str) -> str:
    """A pattern inside a SQL string, whose backslashes are escapes."""
    return pattern.replace("\\", "\\\\")


def _joined(spans: str) -> Column:
    return F.expr(f"concat_ws(',', transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)))")


def personal_data(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, a count per base kind, base_sha256, spans, n_other, top_score."""
    found = with_spans(df.select(df[key].alias("own_key"), F.coalesce(df[text].cast("string"), F.lit("")).alias("t")))
    counts = [F.expr(f"CAST(size(filter(spans, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(
        F.col("own_key").alias(key),
        *counts,
        F.sha2(_joined("filter(spans, x -> x.base)"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
        F.expr("CAST(size(filter(spans, x -> NOT x.base)) AS BIGINT)").alias("n_other"),
        F.expr("array_max(transform(spans, x -> x.score))").alias("top_score"),
    )


def masked(df: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with every span replaced by its kind in brackets, and the length column brought up to date."""
    columns = df.columns
    found = with_spans(
        df.select(F.struct(*[df[c] for c in columns]).alias("own_row"), F.coalesce(df[text].cast("string"), F.lit("")).alias("t"))
    )
    clean = found.select(
        "own_row",
        F.expr(
            """CASE WHEN size(spans) = 0 THEN t ELSE
            aggregate(spans, named_struct('at', 0, 'out', CAST(array() AS array<string>)),
                (a, x) -> IF(x.start < a.at,
                    named_struct('at', greatest(a.at, x.end), 'out', a.out),
                    named_struct('at', x.end, 'out', concat(a.out,
                        array(substr(t, a.at + 1, x.start - a.at), concat('[', upper(x.kind), ']'))))),
                a -> concat(array_join(a.out, ''), substr(t, a.at + 1))) END"""
        ).alias("clean"),
    )
    out = []
    for c in columns:
        value = F.col("own_row").getField(c)
        if c == text:
            value = F.when(value.isNotNull(), F.col("clean"))
        elif c == length:
            value = F.when(F.col("own_row").getField(text).isNotNull(), F.length("clean")).otherwise(value)
            value = value.cast(df.schema[c].dataType)
        out.append(value.alias(c))
    return clean.select(*out)
