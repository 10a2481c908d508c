r"""Secret scans (DataFrame functions only): fixed patterns plus sliding-window entropy.

Base kinds are patterns matched leftmost and non-overlapping, each on its own. Positions come from the
pieces between matches: the start of a match is the length of all that stands before it.

The entropy kind looks at runs of hex digits of one case that no letter or digit touches, and at runs of base64
characters. A run is split at its allow-listed parts (UUIDs, digests after their name, placeholder words, six or more equal
characters; runs of digits and hex runs of 20 or more, which are judged on their own) and each part that is left is a
candidate of `window` characters or more. A window of fixed length slides over a candidate; the counts of its
characters and the sum of count * log2(count) are updated by the one character that enters and the one that
leaves, so that each step's Shannon entropy is log2(window) - sum / window. A span reaches from the first to
the last window at or above the class's threshold. The class of a candidate of base64 characters is by its mixture: lower
case, upper case and digits; digits and one case; or anything else, with the highest threshold.
Lower-case hex runs of 32 or more are a base kind already and are not reported twice. An entropy span may lie inside
an assign span.

Defined results: a null text counts as empty and has no spans; rows that repeat a doc_id are scanned one by
one; an empty table gives an empty result; other columns are ignored; long texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table

#: Name, pattern, and whether group 2 must have 8 characters. `x+` of n or more characters is x{n,} where a longer run can't be cut short.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True),
    ("access", r"AKIA[A-Z0-9]{12,}", False),
    ("hex", r"[0-9a-f]{32,}", False),
)
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Class name, alphabet, window, threshold in bits.
CLASSES = (
    ("hex", "0123456789abcdef", 20, 3.0),
    ("base64", BASE64, 24, 3.9),
    ("upper hex", "0123456789ABCDEF", 20, 3.0),
    ("one case", BASE64, 24, 3.6),
    ("other", BASE64, 24, 4.1),
)
LOW, UP, DIGIT = ("m rlike '[a-z]'", "m rlike '[A-Z]'", "m rlike '[0-9]'")
#: Class name: SQL for which candidates m are of it. The last three exclude each other.
MEMBERS = {
    "hex": f"{DIGIT} and m rlike '[a-f]' and not m rlike '^[0-9a-f]{{32,}}$'",
    "upper hex": f"{DIGIT} and m rlike '[A-F]'",
    "base64": f"{LOW} and {UP} and {DIGIT}",
    "one case": f"{DIGIT} and ({LOW}) <> ({UP})",
    "other": f"not ({DIGIT} and ({LOW} or {UP}))",
}
#: Parts of a run that are not secrets.
EQUAL = r"(.)\1{5,}"
ALLOWED = (
    EQUAL,
    r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])(?i:md5[-_/](?:[0-9a-f]{32}|[a-z0-9+/_-]{22})|sha1[-_/](?:[0-9a-f]{40}|[a-z0-9+/_-]{27})|sha256[-_/](?:[0-9a-f]{64}|[a-z0-9+/_-]{43})|sha384[-_/](?:[0-9a-f]{96}|[a-z0-9+/_-]{64})|sha512[-_/](?:[0-9a-f]{128}|[a-z0-9+/_-]{86}))(?![A-Za-z0-9+/_-])",
    r"(?i:example|placeholder|changeme|your[-_])",
    r"(?<![A-Za-z0-9])(?:[0-9a-f]{20,}|[0-9A-F]{20,})(?![A-Za-z0-9])",
    r"[0-9a-f]{32,}",
)
KINDS = (*(name for name, _, _ in BASE), "entropy")
BLOCK = 512


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str, keep: str = "true") -> str:
    """SQL for array<struct<s,e,m>>: start, end and string of every match of a pattern in a column for which `keep`, which may use m, holds.

    Results are gathered in blocks, since appending to one long array would copy it for every match.
    """
    p = sql_text(pattern)
    row = "struct<s:int,e:int,m:string>"
    new = "named_struct('s', acc.at + z.gap, 'e', acc.at + z.gap + char_length(z.m), 'm', z.m)"
    return f"""
    if({text} rlike {p}, aggregate(
      zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (x, y) -> named_struct('gap', char_length(x), 'm', y)),
      named_struct('at', 0, 'now', cast(array() as array<{row}>), 'done', cast(array() as array<array<{row}>>)),
      (acc, z) -> named_struct(
        'at', acc.at + z.gap + coalesce(char_length(z.m), 0),
        'now', if(z.m is null or not ({keep}), acc.now, if(size(acc.now) < {BLOCK}, concat(acc.now, array({new})), array({new}))),
        'done', if(z.m is null or not ({keep}) or size(acc.now) < {BLOCK}, acc.done, concat(acc.done, array(acc.now)))),
      acc -> flatten(concat(acc.done, array(acc.now)))), cast(array() as array<{row}>))"""


def entropy_reach(value: str, alphabet: str, window: int, threshold: float) -> str:
    """SQL for struct<first,last>: first and last window end (1-based) with enough entropy in a string; first is 0 if there is none.

    The string is split into an array once, so that a step costs the alphabet's size however long the string is.
    """
    code = f"instr({sql_text(alphabet)}, element_at(cs, {{at}}))"
    weigh = lambda x: f"if({x} <= 1, 0D, {x} * log2(cast({x} as double)))"
    enters, leaves = "z.enters", "z.leaves"
    out = f"if({leaves} = 0, 0, element_at(acc.counts, greatest({leaves}, 1)))"
    into = f"(element_at(acc.counts, {enters}) - if({leaves} = {enters}, 1, 0))"
    total = f"acc.total - {weigh(out)} + {weigh(f'({out} - 1)')} - {weigh(into)} + {weigh(f'({into} + 1)')}"
    return f"""
    element_at(transform(array(split({value}, '')), cs -> aggregate(
      transform(sequence(1, size(cs)), i -> named_struct('i', i, 'enters', {code.format(at="i")}, 'leaves', if(i > {window}, {code.format(at=f"i - {window}")}, 0))),
      named_struct('counts', array_repeat(0, {len(alphabet)}), 'total', 0D, 'first', 0, 'last', 0),
      (acc, z) -> named_struct(
        'counts', transform(acc.counts, (c, j) -> c + if(j + 1 = {enters}, 1, 0) - if(j + 1 = {leaves}, 1, 0)),
        'total', {total},
        'first', if(acc.first = 0 and z.i >= {window} and log2({window}D) - ({total}) / {window} >= {threshold}D, z.i, acc.first),
        'last', if(z.i >= {window} and log2({window}D) - ({total}) / {window} >= {threshold}D, z.i, acc.last)),
      acc -> named_struct('first', acc.first, 'last', acc.last))), 1)"""


def remains(value: str, pattern: str) -> str:
    """SQL for array<struct<s,m>>: start and string of what is left of a string between the matches of a pattern."""
    p = sql_text(pattern)
    row = "struct<s:int,m:string>"
    return f"""
    aggregate(
      zip_with(split({value}, {p}, -1), regexp_extract_all({value}, {p}, 0), (x, y) -> named_struct('m', x, 'gap', y)),
      named_struct('at', 0, 'now', cast(array() as array<{row}>), 'done', cast(array() as array<array<{row}>>)),
      (acc, z) -> named_struct(
        'at', acc.at + char_length(z.m) + coalesce(char_length(z.gap), 0),
        'now', if(size(acc.now) < {BLOCK}, concat(acc.now, array(named_struct('s', acc.at, 'm', z.m))), array(named_struct('s', acc.at, 'm', z.m))),
        'done', if(size(acc.now) < {BLOCK}, acc.done, concat(acc.done, array(acc.now)))),
      acc -> flatten(concat(acc.done, array(acc.now))))"""


def candidates(text: str, name: str, window: int) -> str:
    """SQL for array<struct<s,m>>: start and string of a class's candidates in a column."""
    if name in ("hex", "upper hex"):
        runs, cut_at = matches(text, f"(?<![A-Za-z0-9])[{'0-9a-f' if name == 'hex' else '0-9A-F'}]{{{window},}}(?![A-Za-z0-9])"), EQUAL
    else:
        runs, cut_at = matches(text, f"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{window},}}"), "|".join(ALLOWED)
    parts = f"flatten(transform({runs}, h -> transform({remains('h.m', cut_at)}, x -> named_struct('s', h.s + x.s, 'm', x.m))))"
    return f"filter({parts}, c -> char_length(c.m) >= {window} and exists(array(c.m), m -> {MEMBERS[name]}))"


def entropy_spans(text: str) -> str:
    """SQL for array<struct<s,e>> of a column's high-entropy spans of all classes."""
    parts = []
    for name, alphabet, window, threshold in CLASSES:
        reach = f"transform({candidates(text, name, window)}, h -> named_struct('s', h.s, 'r', {entropy_reach('h.m', alphabet, window, threshold)}))"
        parts.append(f"transform(filter({reach}, h -> h.r.first > 0), h -> named_struct('s', h.s + h.r.first - {window}, 'e', h.s + h.r.last))")
    return f"concat({', '.join(parts)})"


def joined(spans: Column) -> Column:
    """kind:start:end of spans, by start, then kind as listed, comma-joined."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: array<struct<s,k,e>> with start, index of the kind in KINDS, and end, in code points, end exclusive."""
    row = "array<struct<s:int,k:int,e:int>>"
    found = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kinds = []
    for k, (name, pattern, valued) in enumerate(BASE):
        keep = f"char_length(regexp_extract(z.m, {sql_text('^' + pattern)}, 2)) >= 8" if valued else "true"
        kinds.append(f"transform({matches('text', pattern, keep)}, x -> named_struct('s', x.s, 'k', {k}, 'e', x.e))")
    found = found.select("doc_id", F.expr(f"cast(concat({', '.join(kinds)}) as {row})").alias("base"), F.expr(f"transform({entropy_spans('text')}, x -> named_struct('s', x.s, 'k', {len(BASE)}, 'e', x.e))").alias("more"))
    return found.select("doc_id", "base", F.concat("base", F.col("more").cast(row)).alias("spans"))


def op1_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, (name, _, _) in enumerate(BASE)],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["k"] == len(BASE))).cast("long").alias("n_entropy"),
    )
