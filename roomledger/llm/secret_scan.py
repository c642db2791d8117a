"""Secret scans: fixed patterns plus sliding-window entropy, in SQL functions.

Positions come from the text's parts: ``split`` gives what lies between the
matches that ``regexp_extract_all`` gives, so a match starts after the lengths
of all parts and matches before it.  Positions count code points.

The entropy of each window of ``WINDOW`` characters of a candidate follows from
the one before: the counts of the character that enters and of the one that
leaves change, and with them the sum of ``c * log2(c)``, held as an integer.
Only the window's own characters are counted.  Windows with enough entropy that
overlap or touch are one span; a candidate can hold several.

Lengths are summed, and candidates looked at, in blocks, so a text takes time in
proportion to its length, whatever it holds; no pattern repeats a group without
a bound, as Java would go down a stack frame for each repeat.

Defined results: a null text counts as empty; text without a match has no
spans; repeated rows give repeated results; other columns stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomledger.llm.common import unused

# Fixed values of the contract: kinds in their order, patterns, shortest match.
ASSIGN = (r"(?i)(password|passwd|secret|token|api_?key)" r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}+"  # a match of AKIA[A-Z0-9]+ has 20 characters or more only so
HEX = r"[0-9a-f]{24,}+"  # likewise, [0-9a-f]+ of 24 or more
KINDS = ("assign", "access", "hex")

WINDOW = 20
BLOCK = 512  # characters, or matches, that are handled from one state
RUN = r"[A-Za-z0-9+/_=-]{20,}+"
# Classes of runs, the first that fits holds: kind, pattern of the whole run, least bits in a window.
CLASSES = (
    ("entropy_hex", r"^(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]++$", 3.0),
    ("entropy_alnum", r"^(?=[A-Za-z]*[0-9])[0-9A-Za-z]++$", 3.7),
    ("entropy_base64", r"[0-9]", 3.7),
    ("entropy_letters", r"", 3.7),
)
# A run without a digit counts if upper and lower case are mixed as in no words, joined words or names: in the span,
# capitals are 3 to 7 tenths of the letters, and 3 in 20 characters or more are a capital before a small letter.
MIXED = (3, 7, 3)
# Runs that are no secrets: placeholders, counted-up digits and letters, one repeated part, UUIDs, paths
# (small letters, "_", "-" and single "/", then a number).
# A run that one matches as a whole is left out; otherwise what it matches is cut out and the rest is looked at.
ALLOW = (r"(?i)example|placeholder|changeme|xxxx", r"(?i)0123456789|123456789a|abcdefghij",
         r"^(.{1,8})\1+$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
         r"^(?!.*//)/?[a-z_-][a-z_/-]*[a-z_-]/[0-9]++$")
SCALE = 1 << 32

MATCH = "array<struct<start:bigint,stop:bigint,m:string,g:string>>"


def _quoted(s: str) -> str:
    return "r'" + s + "'" if "'" not in s else "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(lengths: str) -> str:
    """SQL: the sums of all entries before each entry of an array of bigint."""
    none = "named_struct('s', 0L, 'out', cast(array() AS array<bigint>))"
    blocks = (f"transform(sequence(0, greatest(size(l) - 1, 0) div {BLOCK}), b -> aggregate(slice(l, b * {BLOCK} + 1, {BLOCK}), {none}, "
              "(a, v) -> named_struct('s', a.s + v, 'out', concat(a.out, array(a.s)))))")
    before = f"aggregate(q, {none}, (a, v) -> named_struct('s', a.s + v.s, 'out', concat(a.out, array(a.s)))).out"
    return _let(lengths, "l", _let(blocks, "q", _let(before, "o", "flatten(transform(q, (v, j) -> transform(v.out, w -> w + o[j])))")))


def matches(text: str, pattern: str, keep: str = "true", group: int = 0) -> str:
    """SQL: array of (start, stop, text) of all matches for which ``keep`` holds;
    in ``keep``, ``g`` is the match's ``group``."""
    p = _quoted(pattern)
    at = running("transform(hit, (m, i) -> cast(length(gap[i]) + length(m) AS bigint))")
    spans = """transform(hit, (m, i) -> named_struct('start', at[i] + length(gap[i]),
        'stop', at[i] + length(gap[i]) + length(m), 'm', m, 'g', part[i]))"""
    found = _let(f"split({text}, {p}, -1)", "gap", _let(f"regexp_extract_all({text}, {p}, 0)", "hit", _let(
        f"regexp_extract_all({text}, {p}, {group})", "part", _let(at, "at", f"filter({spans}, x -> {keep})"))))
    return f"CASE WHEN {text} RLIKE {p} THEN {found} ELSE cast(array() AS {MATCH}) END"


def _spans(found: str, rank: int, kind: str) -> str:
    return (f"transform({found}, x -> named_struct('start', x.start, 'rank', {rank}, 'stop', x.stop, "
            f"'kind', '{kind}'))")


def most_repeats(bits: float, window: int = WINDOW) -> int:
    """The largest sum of ``c * log2(c)``, scaled, in a window that has ``bits`` or more."""
    return math.floor((math.log2(window) - bits) * window * SCALE)


def stretches(word: str, most: str, window: int = WINDOW) -> str:
    """SQL: array of (lo, hi), the first and last character (from 1) of each stretch of windows of ``word``
    whose sum of ``c * log2(c)`` is ``most`` or less; windows that overlap or touch are one stretch."""
    f = [0] + [round(c * math.log2(c) * SCALE) for c in range(1, window + 1)]
    step = "array(" + ", ".join(f"{b - a}L" for a, b in zip(f, f[1:])) + ")"  # one more of a character there are c of
    inner = f"substr(y, greatest(1, i - {window - 1}), least(i - 1, {window - 1}))"  # of the window, without the new character

    def more(char: str) -> str:
        return f"d[length(t.mid) - length(replace(t.mid, {char}, ''))]"

    s = f"a.s + {more('t.new')} - IF(i > {window}, {more('t.old')}, 0L)"
    joined = f"size(a.out) > 0 AND element_at(a.out, -1).hi >= off + i - {window}"
    out = f"""IF(i >= {window} AND s <= {most}, IF({joined},
        concat(slice(a.out, 1, size(a.out) - 1), array(named_struct('lo', element_at(a.out, -1).lo, 'hi', off + i))),
        concat(a.out, array(named_struct('lo', off + i - {window - 1}, 'hi', off + i)))), a.out)"""
    chars = f"named_struct('mid', {inner}, 'new', substr(y, i, 1), 'old', substr(y, greatest(1, i - {window}), 1))"
    turn = _let(chars, "t", _let(s, "s", f"named_struct('s', s, 'out', {out})"))
    # a block, with the window before it, from its first character on
    block = _let(f"IF(j = 0, b, concat(right(bs[greatest(j - 1, 0)], {window}), b))", "y", _let(
        f"cast(IF(j = 0, 0, j * {BLOCK} - {window}) AS bigint)", "off",
        f"""aggregate(sequence(1, length(y)), named_struct('s', 0L, 'out', cast(array() AS array<struct<lo:bigint,hi:bigint>>)),
            (a, i) -> {turn}).out"""))
    parts = f"flatten(transform(bs, (b, j) -> {block}))"
    whole = _let("filter(u, (x, i) -> i = 0 OR get(u, i - 1).hi < x.lo - 1)", "open", _let(
        "filter(u, (x, i) -> i = size(u) - 1 OR get(u, i + 1).lo > x.hi + 1)", "shut",
        "transform(open, (x, i) -> named_struct('lo', x.lo, 'hi', shut[i].hi))"))
    return _let(step, "d", _let(f"regexp_extract_all({word}, '.{{1,{BLOCK}}}', 0)", "bs", _let(parts, "u", whole)))


def _masked(text: str, pattern: str) -> str:
    """SQL: ``text`` with blanks for the matches of ``pattern``, as long as before."""
    p = _quoted(pattern)
    return f"""CASE WHEN {text} RLIKE {p} THEN array_join(transform(
        arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0)),
        x -> concat(x.`0`, repeat(' ', coalesce(length(x.`1`), 0)))), '') ELSE {text} END"""


def _mixed(hot: str) -> str:
    """SQL: whether ``hot`` mixes upper and lower case as MIXED says."""
    low, high, turns = MIXED
    upper, both = f"regexp_count({hot}, r'[A-Z]')", f"regexp_count({hot}, r'[A-Za-z]')"
    return (f"(10 * {upper} BETWEEN {low} * {both} AND {high} * {both} "
            f"AND 20 * regexp_count({hot}, r'[A-Z][a-z]') >= {turns} * length({hot}))")


def scan(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``docs`` with ``base_spans`` and ``method_spans``: arrays of (start, rank,
    stop, kind) by start, then kind."""
    text, found, base, method = unused(docs, "whole_text", "runs", "base_spans", "method_spans")
    df = docs.withColumn(text, F.coalesce(F.col("text"), F.lit("")))
    df = df.withColumn(base, F.expr("array_sort(concat(" + ", ".join([
        _spans(matches(text, ASSIGN, f"length(x.g) >= {ASSIGN_LEAST}", 2), 0, "assign"),
        _spans(matches(text, ACCESS), 1, "access"),
        _spans(matches(text, HEX), 2, "hex")]) + "))"))
    known = " OR ".join([f"x.m RLIKE {_quoted(f'^(?:{a})$')}" for a in allow] or ["false"])
    df = df.withColumn(found, F.expr(matches(text, RUN, f"NOT ({known})")))
    for a in allow:
        df = df.withColumn(found, F.expr(f"transform({found}, x -> named_struct('start', x.start, 'm', {_masked('x.m', a)}))"))
    df = df.withColumn(found, F.expr(f"flatten(transform({found}, r -> transform({matches('r.m', RUN)}, "
                                     "z -> named_struct('start', r.start + z.start, 'm', z.m))))"))
    kinds = " ".join(f"WHEN r.m RLIKE {_quoted(p)} THEN named_struct('rank', {3 + k}, 'kind', '{kind}', 'most', {most_repeats(bits)}L)"
                     for k, (kind, p, bits) in enumerate(CLASSES))
    hot = _let(f"CASE {kinds} END", "c", f"""transform(filter({stretches('r.m', 'c.most')},
        z -> c.kind != 'entropy_letters' OR {_let('substr(r.m, cast(z.lo AS int), cast(z.hi - z.lo + 1 AS int))', 'h', _mixed('h'))}),
        z -> named_struct('start', r.start + z.lo - 1, 'rank', c.rank, 'stop', r.start + z.hi, 'kind', c.kind))""")
    return df.withColumn(method, F.expr(f"array_sort(flatten(transform({found}, r -> {hot})))")).drop(text, found)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
