"""Secret scans, by DataFrame functions alone.

Three rules find secrets by their form (assign, access, hex). The method adds strings that look random: candidates are
runs of WINDOW or more characters of one alphabet; a window slides along each, and the counts of its characters, and with
them the sum of count * log2(count), change by the character that enters and the one that leaves. A candidate is a secret
when the lowest sum of its windows, and so the highest Shannon entropy, passes its class's threshold. Sums are integers,
so that results are the same everywhere. The allow-list suppresses words, numbers, dotted or dashed names, dates, UUIDs and
placeholders. Candidates inside a span of the rules are left out.

Cases: a null text is empty; a document without secrets has the hash of the empty string and empty spans; repeated rows
give repeated rows; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The forms of secrets.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

WINDOW = 20
#: Bits of entropy that a window needs, by class of characters.
HEX_BITS, MIXED_BITS = 3.0, 3.75
SCALE = 1 << 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A candidate needs a part of so many letters and digits, with both of them in it; names, dates and UUIDs have none.
PART = r"[A-Za-z0-9]{16,}"
MIX = r"[A-Za-z][0-9]|[0-9][A-Za-z]"
PLACEHOLDER = r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Xx]{8}|0{8}|123456789|abcdefgh|ABCDEFGH"
HEX_ONLY = r"^[0-9A-Fa-f]+$"
KINDS = ("assign", "access", "hex", "entropy")

_LOGS = [0 if c < 2 else round(c * math.log2(c) * SCALE) for c in range(WINDOW + 1)]


def _most(bits: float) -> int:
    """The largest sum of count * log2(count) that a window of this entropy has."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * SCALE)


_SPAN = "struct<start: bigint, stop: bigint, s: string>"


def _located(pieces: str, matches: str) -> Column:
    """Where matches stand: between pieces, whose lengths and theirs add up."""
    return F.expr(f"""
        CASE WHEN size({matches}) = 0 THEN cast(array() AS array<{_SPAN}>) ELSE
        aggregate(sequence(0, size({matches}) - 1), named_struct('at', 0L, 'out', cast(array() AS array<{_SPAN}>)),
          (a, i) -> named_struct(
            'at', a.at + length({pieces}[i]) + length({matches}[i]),
            'out', array_append(a.out, named_struct('start', a.at + length({pieces}[i]), 'stop', a.at + length({pieces}[i]) + length({matches}[i]), 's', {matches}[i]))),
          a -> a.out) END""")


def _find(df: DataFrame, text: str, kind: str, pattern: str) -> DataFrame:
    """Adds a column of that kind's name with the spans of all matches."""
    quoted = F.lit(pattern)
    df = df.withColumn("_m", F.regexp_extract_all(text, quoted, F.lit(0)))
    empty = F.expr("cast(array() AS array<string>)")
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split(F.col(text), pattern, -1)).otherwise(empty))
    return df.withColumn(kind, _located("_p", "_m")).drop("_m", "_p")


def _lowest_sums() -> Column:
    """For each array of characters in _chars, the lowest sum over its windows, by incremental counts.

    The accumulator holds the counts of the window's characters, their sum, and the lowest sum of a whole window. The
    leaving character lowers its count, and then the entering one raises its own."""
    logs = "array(" + ", ".join(f"{x}L" for x in _LOGS) + ")"
    code = lambda i: f"(locate(c[{i}], '{ALPHABET}') - 1)"
    step = lambda b, j, by: f"named_struct('n', transform({b}.n, (v, k) -> CASE WHEN k = {j} THEN v + ({by}) ELSE v END), 'sum', {b}.sum + logs[{b}.n[{j}] + ({by})] - logs[{b}.n[{j}]], 'low', {b}.low)"
    out = f"aggregate(CASE WHEN i < {WINDOW} THEN cast(array() AS array<int>) ELSE array({code(f'i - {WINDOW}')}) END, a, (b, j) -> {step('b', 'j', -1)})"
    into = f"aggregate(array({code('i')}), {out}, (b, j) -> {step('b', 'j', 1)}, b -> named_struct('n', b.n, 'sum', b.sum, 'low', CASE WHEN i >= {WINDOW - 1} THEN least(b.low, b.sum) ELSE b.low END))"
    start = f"named_struct('n', array_repeat(0, {len(ALPHABET)}), 'sum', 0L, 'low', {1 << 60}L)"
    whole = f"transform(_chars, c -> aggregate(sequence(0, size(c) - 1), {start}, (a, i) -> {into}, a -> a.low))"
    return F.expr(whole.replace("logs[", f"{logs}["))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds to docs a column _spans: array of (start, kind's rank, stop) in order; positions count code points."""
    df = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    for kind, pattern in zip(("_assign", "_access", "_hex", "_entropy"), (ASSIGN, ACCESS, HEX, CANDIDATE), strict=True):
        df = _find(df, "_text", kind, pattern)
    df = df.withColumn("_assign", F.filter("_assign", lambda m: F.length(F.regexp_extract(m.s, ASSIGN, 2)) >= ASSIGN_LEAST))
    # The allow-list comes first, as it is cheap; then what lies inside a rule's span, and then the windows.
    part = lambda m: F.exists(F.regexp_extract_all(m.s, F.lit(PART), F.lit(0)), lambda p: p.rlike(MIX))
    df = df.withColumn("_entropy", F.filter("_entropy", lambda m: ~m.s.rlike(PLACEHOLDER) & part(m)))
    df = df.withColumn("_rules", F.concat("_assign", "_access", "_hex"))
    df = df.withColumn("_entropy", F.filter("_entropy", lambda m: ~F.exists("_rules", lambda r: (r.start <= m.start) & (m.stop <= r.stop))))
    df = df.withColumn("_chars", F.transform("_entropy", lambda m: F.split(m.s, "")))
    df = df.withColumn("_low", _lowest_sums())
    df = df.withColumn(
        "_entropy",
        F.expr(f"filter(_entropy, (m, i) -> _low[i] <= CASE WHEN m.s RLIKE '{HEX_ONLY}' THEN {_most(HEX_BITS)}L ELSE {_most(MIXED_BITS)}L END)"),
    )
    ranked = [F.expr(f"transform(_{k}, m -> named_struct('start', m.start, 'kind', {r}, 'stop', m.stop))") for r, k in enumerate(KINDS)]
    df = df.withColumn("_spans", F.array_sort(F.concat(*ranked)))
    return df.drop("_text", "_assign", "_access", "_hex", "_entropy", "_rules", "_chars", "_low")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", names[m.kind], m.start, m.stop)), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    df = scan(common.documents_of(docs, id_col, text_col))
    count = lambda r: F.size(F.filter("_spans", lambda m: m.kind == r)).cast("long")
    base = F.filter("_spans", lambda m: m.kind < 3)
    return df.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("_spans")).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text replaced by the mark; overlapping spans become one."""
    # The input's row stays apart in a struct, so its columns may have any names.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    df = scan(docs.select(row, F.col(f"`{text_col}`").alias("text")), "text")
    out = F.expr(f"""
        aggregate(_spans, named_struct('at', 0L, 'out', ''),
          (a, m) -> named_struct(
            'at', greatest(a.at, m.stop),
            'out', CASE WHEN m.start >= a.at THEN concat(a.out, substring(text, cast(a.at + 1 AS int), cast(m.start - a.at AS int)), '{mark}') ELSE a.out END),
          a -> concat(a.out, substring(text, cast(a.at + 1 AS int))))""")
    out = F.when(F.size("_spans") > 0, out).otherwise(F.col("text"))
    return df.select(*[(out if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(common.table(spark, sf_dir, "documents"))


def _sql_spans(kind: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
m_{kind} AS (SELECT row, regexp_extract_all(t, '{quoted}') AS m, string_split_regex(t, '{quoted}') AS p FROM d),
s_{kind} AS (
  SELECT row, m[i] AS s,
    CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT row, m, p, unnest(range(1, len(m) + 1)) AS i FROM m_{kind})),"""


SECRETS_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
{_sql_spans("assign", ASSIGN)}{_sql_spans("access", ACCESS)}{_sql_spans("hex", HEX)}{_sql_spans("entropy", CANDIDATE)}
rules AS (
  SELECT row, 0 AS kind, start, start + length(s) AS stop FROM s_assign WHERE length(regexp_extract(s, '{ASSIGN.replace("'", "''")}', 2)) >= {ASSIGN_LEAST}
  UNION ALL SELECT row, 1, start, start + length(s) FROM s_access
  UNION ALL SELECT row, 2, start, start + length(s) FROM s_hex),
candidates AS (
  SELECT row, s, start, start + length(s) AS stop FROM s_entropy
  WHERE NOT regexp_matches(s, '{PLACEHOLDER}')
    AND len(list_filter(regexp_extract_all(s, '{PART}'), lambda x: regexp_matches(x, '{MIX}'))) > 0),
free AS (SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.row = c.row AND r.start <= c.start AND c.stop <= r.stop)),
windows AS (SELECT row, s, start, stop, substr(s, CAST(i AS INT), {WINDOW}) AS w FROM (SELECT *, unnest(range(1, length(s) - {WINDOW} + 2)) AS i FROM free)),
sums AS (
  SELECT row, s, start, stop, list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: ([{", ".join(map(str, _LOGS))}])[len(w) - len(replace(w, c, '')) + 1])) AS total
  FROM windows),
found AS (
  SELECT row, 3 AS kind, start, stop FROM sums GROUP BY row, s, start, stop
  HAVING min(total) <= CASE WHEN regexp_matches(s, '{HEX_ONLY}') THEN {_most(HEX_BITS)} ELSE {_most(MIXED_BITS)} END),
spans AS (SELECT row, kind, start, stop, (['assign', 'access', 'hex', 'entropy'])[kind + 1] || ':' || start || ':' || stop AS said FROM (FROM rules UNION ALL FROM found)),
grouped AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(said, ',' ORDER BY start, kind) AS spans
  FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN grouped USING (row)
"""
