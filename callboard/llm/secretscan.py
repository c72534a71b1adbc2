"""Secret scan: known formats, and sliding windows of high Shannon entropy, all in SQL functions.

Formats: assignments to password-like names, access keys, long hex strings. Each is cut out
of the text by its pattern; a span's place follows from the lengths of what lies before it,
summed by doubling: in step k every entry adds the one 2**k before it, so log(n) steps over
whole arrays replace n steps that each copy one.

Entropy: a candidate is a maximal run of the characters of one class, at least ``WINDOW``
long. A window slides over it; of its characters only two counts change per step, that of
the one that enters and that of the one that leaves, and the sum of n log2 n over all counts
changes by those two terms alone. The entropy log2 W - sum / W reaches the class's threshold
where the sum is at most W (log2 W - threshold). Terms are whole numbers (units of 2**-40),
so sums are exact and don't depend on the way there. Windows that reach it and touch or
overlap become one span. Candidates that match an allow-list entry are suppressed: words, slugs, numbers,
UUIDs, counting sequences, placeholders, integrity digests. Spans of known formats are never
suppressed, and an entropy span inside one isn't told again.

Every step works on one row: nothing is shuffled, and a hot source costs nothing extra.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callboard.llm.blocks import free_names

# The known formats, in the order in which spans of one start are told: pattern, test of a match ``m``.
_ASSIGN = r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))"
FORMATS = {
    "assign": (_ASSIGN, "length(regexp_extract(m, {pattern}, 2)) >= 8"),
    "access": ("AKIA[A-Z0-9]{12,}", None),
    "hex": ("[0-9a-f]{32,}", None),
}
#: Characters in a window.
WINDOW = 20
#: Character classes of candidates, with the bits a character from which on a window counts.
CLASSES = {
    "entropy_hex": ("0-9A-Fa-f", 3.0),
    "entropy_text": ("0-9A-Za-z+/_=-", 3.75),
}
#: A candidate that one of these matches isn't a secret.
ALLOWED = (
    r"^[A-Za-z]+([-_/=+][A-Za-z]+)*[-_/=+]*$",  # words, paths and slugs
    r"^[-_/=+]*[0-9]+([-_/=+][0-9]+)*[-_/=+]*$",  # numbers, days
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",  # UUIDs
    r"^(sha1|sha256|sha384|sha512|md5)[-_=]",  # integrity digests
    r"(?i)example|placeholder|0123456789|abcdefghijkl|xxxxxxxx",  # documentation, counting sequences
)
_SCALE = 1 << 40
#: Code points of class characters lie from 43 (plus) to 122 (z).
_LOW, _CODES = 43, 80


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(numbers: str, both: str = "x + y", none: int = 0) -> str:
    """SQL: what ``both`` makes of all entries of an int array up to each entry, by doubling."""
    steps = "transform(sequence(0, CAST(ceil(log2(greatest(size(s), 1))) AS INT)), k -> shiftleft(1, k))"
    step = both.replace("y", f"coalesce(get(a, i - d), {none})")
    return _let(numbers, "s", f"aggregate({steps}, s, (a, d) -> transform(a, (x, i) -> {step}))")


def _placed(text: str, pattern: str, test: str | None) -> str:
    """SQL: array of (start, m) of all matches, or of those that pass the test; starts count code points from 0."""
    shift = "transform(p, (x, i) -> length(x) + coalesce(length(get(ms, i - 1)), 0))"
    zipped = f"zip_with(slice({_running(shift)}, 1, size(ms)), ms, (b, m) -> named_struct('start', b, 'm', m))"
    kept = f"filter({zipped}, z -> {test.format(pattern=_sql(pattern)).replace('(m,', '(z.m,')})" if test else zipped
    found = _let(f"regexp_extract_all({text}, {_sql(pattern)}, 0)", "ms", kept)
    none = "CAST(array() AS array<struct<start: int, m: string>>)"
    return f"coalesce({_let(f'split({text}, {_sql(pattern)}, -1)', 'p', f'if(size(p) < 2, {none}, {found})')}, {none})"


def terms(window: int) -> list[int]:
    """n log2 n in units of 2**-40 for counts up to the window's length."""
    return [0] + [round(n * math.log2(n) * _SCALE) for n in range(1, window + 1)]


def largest_sum(window: int, bits: float) -> int:
    """The largest sum of terms at which a window's entropy still reaches ``bits``."""
    return math.floor(window * (math.log2(window) - bits) * _SCALE)


def _windows(run: str, window: int, bits: float) -> str:
    """SQL: array of (s, e) of the windows of a run that reach the entropy, joined where they touch."""
    table = f"array({', '.join(f'{t}L' for t in terms(window))})"
    codes = f"transform(split({run}, ''), c -> ascii(c) - {_LOW})"
    spans = "CAST(array() AS array<struct<s: int, e: int>>)"
    start = f"named_struct('n', array_repeat(0, {_CODES}), 'sum', 0L, 'i', 0, 's', -1, 'e', -1, 'done', {spans})"
    counts = "transform(a.n, (x, k) -> x + if(k = c, 1, 0) - if(k = gone, 1, 0))"
    entered = "t[a.n[c] + 1] - t[a.n[c]]"
    left = "if(gone IS NULL, 0L, t[a.n[gone] - 1] - t[a.n[gone]])"
    total = f"a.sum + if(gone <=> c, 0L, {entered} + {left})"
    hit = f"a.i >= {window - 1} AND total <= {largest_sum(window, bits)}L"
    apart = f"a.e < a.i - {window - 1}"
    step = (
        f"named_struct('n', if(gone <=> c, a.n, {counts}), 'sum', total, 'i', a.i + 1, "
        f"'s', if({hit} AND {apart}, a.i - {window - 1}, a.s), 'e', if({hit}, a.i + 1, a.e), "
        f"'done', if({hit} AND {apart} AND a.s >= 0, array_append(a.done, named_struct('s', a.s, 'e', a.e)), a.done))"
    )
    step = _let(f"get(codes, a.i - {window})", "gone", _let(total, "total", step))
    last = "if(a.s < 0, a.done, array_append(a.done, named_struct('s', a.s, 'e', a.e)))"
    return _let(table, "t", _let(codes, "codes", f"aggregate(codes, {start}, (a, c) -> {step}, a -> {last})"))


def find(
    docs: DataFrame,
    text: str = "text",
    found: str = "found",
    window: int = WINDOW,
    classes: Mapping[str, tuple[str, float]] = CLASSES,
    allowed: Sequence[str] = ALLOWED,
) -> DataFrame:
    """All rows and columns, and ``found``: the array of (start, end, kind) by start, then kind, then end.

    Places count code points from 0, ends are exclusive. Kinds are those of ``FORMATS`` and of
    ``classes``, in this order. Null and empty texts hold none; equal rows get equal spans; an
    empty table stays empty; a column called like ``found`` is replaced, others may bear any name.
    """
    source, *parts = free_names([*docs.columns, found], "text_", *FORMATS, *classes)
    placed = docs.withColumn(source, F.col(text).cast("string"))
    spans, rank = [], -1
    for part, (kind, (pattern, test)) in zip(parts, FORMATS.items()):
        rank += 1
        placed = placed.withColumn(part, F.expr(_placed(f"`{source}`", pattern, test)))
        spans.append(f"transform(`{part}`, z -> named_struct('start', z.start, 'rank', {rank}, 'end', z.start + length(z.m), 'kind', '{kind}'))")
    more = []
    for part, (kind, (characters, bits)) in zip(parts[len(FORMATS) :], classes.items()):
        rank += 1
        placed = placed.withColumn(part, F.expr(_placed(f"`{source}`", f"[{characters}]{{{window},}}", None)))
        fine = " AND ".join(f"NOT z.m RLIKE {_sql(a)}" for a in allowed) or "true"
        shifted = f"transform({_windows('z.m', window, bits)}, w -> named_struct('start', z.start + w.s, 'rank', {rank}, 'end', z.start + w.e, 'kind', '{kind}'))"
        more.append(f"flatten(transform(filter(`{part}`, z -> {fine}), z -> {shifted}))")
    # How far spans of known formats that start no later reach; an entropy span within them is dropped.
    known = f"x.rank < {len(FORMATS)}"
    reach = _running(f"transform(spans, x -> if({known}, x.end, -1))", "greatest(x, y)", -1)
    told = f"filter(zip_with(spans, {reach}, (x, r) -> named_struct('x', x, 'r', r)), z -> {known.replace('x.', 'z.x.')} OR z.r < z.x.end)"
    whole = _let(f"array_sort(concat({', '.join(spans + more)}))", "spans", told)
    shown = F.expr(f"transform({whole}, z -> named_struct('start', z.x.start, 'end', z.x.end, 'kind', z.x.kind))")
    return placed.select(*[c for c in docs.columns if c != found], shown.alias(found))


def listed(found: str, base_only: bool = False) -> str:
    """SQL: ``kind:start:end`` of all spans, or those of known formats, comma-joined."""
    kinds = ", ".join(f"'{k}'" for k in FORMATS)
    spans = f"filter({found}, x -> x.kind IN ({kinds}))" if base_only else found
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
