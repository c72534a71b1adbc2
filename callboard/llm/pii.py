"""Format-preserving pseudonyms for personal data: keyed Feistel permutations, all in SQL functions.

Found and validated, and what is permuted:

* email: a local part, an at sign, a domain that ends in letters; the characters of the local part;
* ipv4: four numbers up to 255; the 32-bit address;
* iban: remainder 1 of 97; the account, after which the check digits are renewed;
* date: a day of the years 1800 to 2199 in ISO, d/m/y or d.m.y form; the day among 146,097;
* ssn: no area 000, 666 or 9xx, no group or serial of zeros; the number among all valid ones;
* card: an issuer's first digits and length, a right Luhn digit; the digits from the fifth to the one before the last;
* phone: area, exchange and line; the digits after the country code;
* secret: 16 or more hex digits after token, key, secret and the like; the hex digits.

Each format is a finite set and each map a permutation of it: a Feistel network over two
halves, either numbers of sizes a and b (each round adds a keyed hash of one half to the
other, modulo its size) or halves of a string (each round shifts every character within its
class). Classes are digits, capitals, small letters, and in addresses the ``SCRIPTS``: runs of
letters without gaps; other characters stay. A value therefore always gets the same pseudonym,
wherever it stands, two values never share one, and the result is valid again. 400 Gregorian
years have 146,097 = 189 x 773 days, so dates need no walking back into range.

Cards and IBANs (compact or in groups of four) are validated before the text is cut: all
candidates of every length at every place, however they overlap, and only the valid ones then
stand in the pattern that cuts. So a number that fails its check digits never hides a neighbour.
A card doesn't reach over a whole phone number, day, address or ssn after a space; digits in
one run go before groups, longer values before shorter ones.

Every step works on one row: nothing is shuffled, and a hot source costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callboard.llm.blocks import free_names

ROUNDS = 8

# The formats, in the order in which they are tried.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_CENTURY, _LEAP = "(?:1[89]|2[01])", "(?:(?:1[89]|2[01])(?:0[48]|[2468][048]|[13579][26])|2000)"
_MONTHS = (
    ("(?:0[13578]|1[02])", "(?:0[1-9]|[12][0-9]|3[01])", _CENTURY + "[0-9]{2}"),
    ("(?:0[469]|11)", "(?:0[1-9]|[12][0-9]|30)", _CENTURY + "[0-9]{2}"),
    ("02", "(?:0[1-9]|1[0-9]|2[0-8])", _CENTURY + "[0-9]{2}"),
    ("02", "29", _LEAP),
)
_DATE = "(?:" + "|".join(f"{y}-{m}-{d}|{d}/{m}/{y}|{d}[.]{m}[.]{y}" for m, d, y in _MONTHS) + ")"
_SSN = "(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"
FORMATS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\p{L}\p{N}])",
    "ipv4": rf"(?<![0-9.]){_IPV4}(?![0-9]|\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "date": rf"(?<![0-9]){_DATE}(?![0-9])",
    "ssn": rf"(?<![0-9-]){_SSN}(?![0-9-])",
    "card": r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}])",
    "secret": r"(?i:token|key|secret|password|passwd)[ \t]{0,3}[=:][ \t]{0,3}[\"']?[0-9a-fA-F]{16,256}(?![0-9A-Za-z])",
}
# Runs of letters of one script (and one case, where the script lists cases apart), without gaps.
SCRIPTS = (
    (0xC0, 0xD6), (0xD8, 0xDE), (0xE0, 0xF6), (0xF8, 0xFE),  # Latin-1 but for its two signs
    (0x100, 0x17F), (0x180, 0x1BF), (0x1C4, 0x24F),  # Latin Extended
    (0x391, 0x3A1), (0x3A3, 0x3AB), (0x3B1, 0x3CE), (0x400, 0x40F), (0x410, 0x42F), (0x430, 0x44F), (0x450, 0x45F), (0x460, 0x481),
    (0x531, 0x556), (0x561, 0x586), (0x5D0, 0x5EA), (0x620, 0x64A), (0x671, 0x6D3), (0x904, 0x939), (0x985, 0x98C), (0x995, 0x9A8),
    (0xE01, 0xE30), (0x10D0, 0x10FA), (0x1E00, 0x1EFF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x3105, 0x312F), (0x3400, 0x4DBF),
    (0x4E00, 0x9FEF), (0xAC00, 0xD7A3),
)
# First digits and lengths of card issuers. Four digits at most decide, and they stay.
_ISSUED = (
    "^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}"
    "|3[47][0-9]{13}|(?:6011|64[4-9][0-9]|65[0-9]{2})[0-9]{12,15}|(?:30[0-5]|3[689][0-9])[0-9]{11}"
    "|35(?:2[89]|[3-8][0-9])[0-9]{12,15}|62[0-9]{14,17}|(?:5018|5020|5038|5893|6304|6759|676[1-3])[0-9]{9,15})$"
)
# What a card doesn't swallow at its start or after a space, unless a hyphen ties it to more digits.
_OTHER = rf"(?!(?:[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}}|{_SSN}|{_DATE}|{_IPV4})(?![A-Za-z0-9]|[.-][0-9]))"
_CARDS = [rf"(?<![A-Za-z0-9]){_OTHER}(?=([0-9](?:(?:-| {_OTHER})?[0-9]){{{n - 1}}})(?![A-Za-z0-9]))" for n in range(13, 20)]
_IBANS = [r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![A-Za-z0-9]))"] + [
    rf"(?<![A-Za-z0-9])(?=([A-Z]{{2}}[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}{f' [A-Z0-9]{{{n % 4}}}' if n % 4 else ''})(?![A-Za-z0-9]))"
    for n in range(15, 35)
]
_BEFORE = "|".join(FORMATS[k] for k in ("email", "ipv4", "date", "ssn"))
_AFTER = "|".join(FORMATS[k] for k in ("phone", "secret"))
_CHECKED = rf"{FORMATS['card']}|[A-Z]{{2}}[0-9]{{2}}[ A-Z0-9]{{11}}"
#: Characters that neither stand in a format nor decide about one beside them.
_BREAK = r"(?<=[\n\r,;!?<>{}|])"
_DAYS_A, _DAYS_B = 189, 773
_FIRST_DAY = "DATE'1800-01-01'"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class _Keyed:
    """SQL text of the permutations under one key. Arguments are SQL text too."""

    def __init__(self, key: str):
        self.key = key

    def _hash(self, kind: str, turn: str, value: str) -> str:
        return f"sha2(concat({_sql(self.key + '|' + kind + '|')}, {turn}, '|', {value}), 256)"

    def numbers(self, kind: str, x: str, a: int, y: str, b: int, then: str) -> str:
        """A Feistel network on pairs below a and b; ``then`` is SQL on s.x and s.y."""
        drawn = lambda v: f"CAST(conv(substr({self._hash(kind, 'r', v)}, 1, 15), 16, 10) AS BIGINT)"
        return (
            f"aggregate(sequence(1, {ROUNDS}), named_struct('x', CAST({x} AS BIGINT), 'y', CAST({y} AS BIGINT)), (s, r) -> "
            f"if(r % 2 = 1, named_struct('x', (s.x + {drawn('s.y')}) % {a}L, 'y', s.y), "
            f"named_struct('x', s.x, 'y', (s.y + {drawn('s.x')}) % {b}L)), s -> {then})"
        )

    def string(self, kind: str, value: str, letters: int = 26, scripts: bool = False) -> str:
        """A Feistel network on the halves of a string; characters stay in their class, ones without a class as they are.

        ``scripts`` adds the classes of ``SCRIPTS``.
        """

        def mixed(half: str, other: str) -> str:
            def draw(digits: int) -> str:
                return f"CAST(conv(substr({self._hash(kind, 'r', other)}, 1 + (2 * i) % {65 - digits}, {digits}), 16, 10) AS INT)"

            kept = lambda low, size: f"chr({low} + (ascii(c) - {low} + {draw(3)}) % {size})"
            wide, characters = "", f"split({half}, '')"
            if scripts:
                # By code points: splitting would cut those beyond 16 bits in two.
                characters = f"if(length({half}) = 0, array(), transform(sequence(1, length({half})), j -> substr({half}, j, 1)))"
                moved = lambda low, high: f"{low} + (ascii(c) - {low} + {draw(7)}) % {high - low + 1}"
                cases = " ".join(f"WHEN ascii(c) BETWEEN {low} AND {high} THEN decode(unhex(lpad(hex({moved(low, high)}), 4, '0')), 'UTF-16BE')" for low, high in SCRIPTS)
                wide = f"WHEN ascii(c) < 192 THEN c {cases} "
            return (
                f"array_join(transform({characters}, (c, i) -> CASE "
                f"WHEN c BETWEEN '0' AND '9' THEN {kept(48, 10)} WHEN c BETWEEN 'A' AND 'Z' AND ascii(c) < {65 + letters} THEN {kept(65, letters)} "
                f"WHEN c BETWEEN 'a' AND 'z' AND ascii(c) < {97 + letters} THEN {kept(97, letters)} {wide}ELSE c END), '')"
            )

        return (
            f"aggregate(sequence(1, {ROUNDS}), named_struct('a', substr({value}, 1, length({value}) div 2), 'b', substr({value}, length({value}) div 2 + 1)), "
            f"(s, r) -> if(r % 2 = 1, named_struct('a', {mixed('s.a', 's.b')}, 'b', s.b), named_struct('a', s.a, 'b', {mixed('s.b', 's.a')})), "
            f"s -> concat(s.a, s.b))"
        )


def _luhn(digits: str) -> str:
    """The Luhn sum of a digit string in which the last digit counts once."""
    return (
        f"aggregate(transform(split(reverse({digits}), ''), (d, i) -> CAST(d AS INT) * (1 + i % 2) - "
        f"if(i % 2 = 1 AND CAST(d AS INT) > 4, 9, 0)), 0, (t, d) -> t + d)"
    )


def _mod97(text: str) -> str:
    """Remainder of 97 of a text whose capitals count 10 to 35."""
    return (
        f"aggregate(split({text}, ''), 0, (t, c) -> if(c BETWEEN 'A' AND 'Z', "
        f"(t * 100 + ascii(c) - 55) % 97, (t * 10 + CAST(c AS INT)) % 97))"
    )


def _same_shape(pattern: str, digits: str, which: str = "c BETWEEN '0' AND '9'") -> str:
    """``pattern`` with its digits (or what ``which`` says of c) replaced, in turn, by those of ``digits``."""
    return (
        f"aggregate(split({pattern}, ''), named_struct('t', '', 'n', 1), (s, c) -> if({which}, "
        f"named_struct('t', concat(s.t, substr({digits}, s.n, 1)), 'n', s.n + 1), named_struct('t', concat(s.t, c), 'n', s.n)), s -> s.t)"
    )


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _card_ok(m: str) -> str:
    return f"({_digits(m)} RLIKE {_sql(_ISSUED)} AND {_luhn(_digits(m))} % 10 = 0)"


def _iban_ok(m: str) -> str:
    return _let(f"replace({m}, ' ', '')", "w", f"{_mod97('concat(substr(w, 5), substr(w, 1, 4))')} = 1")


def _parts(k: _Keyed, m: str) -> dict[str, tuple[str, str]]:
    """Per kind: SQL that says whether match ``m`` is valid, and its pseudonym."""
    let, digits, compact = _let, _digits(m), f"replace({m}, ' ', '')"
    octet = lambda i: f"CAST(split({m}, '[.]')[{i}] AS BIGINT)"
    address = "concat_ws('.', s.x div 256, s.x % 256, s.y div 256, s.y % 256)"
    day = f"coalesce(try_to_date({m}, 'yyyy-MM-dd'), try_to_date({m}, 'dd/MM/yyyy'), try_to_date({m}, 'dd.MM.yyyy'))"
    form = f"if({m} LIKE '____-%', 'yyyy-MM-dd', if({m} LIKE '__/%', 'dd/MM/yyyy', 'dd.MM.yyyy'))"
    new_day = lambda d: k.numbers("date", f"datediff({d}, {_FIRST_DAY}) % {_DAYS_A}", _DAYS_A, f"datediff({d}, {_FIRST_DAY}) div {_DAYS_A}", _DAYS_B, f"date_format(date_add({_FIRST_DAY}, CAST(s.y * {_DAYS_A} + s.x AS INT)), {form})")
    area = f"CAST(substr({m}, 1, 3) AS INT)"
    ssn = k.numbers(
        "ssn", f"{area} - if({area} > 666, 2, 1)", 898,
        f"(CAST(substr({m}, 5, 2) AS INT) - 1) * 9999 + CAST(substr({m}, 8, 4) AS INT) - 1", 99 * 9999,
        "concat(lpad(CAST(s.x + if(s.x >= 665, 2, 1) AS STRING), 3, '0'), '-', lpad(CAST(s.y div 9999 + 1 AS STRING), 2, '0'), '-', lpad(CAST(s.y % 9999 + 1 AS STRING), 4, '0'))",
    )
    body = f"concat(substr({digits}, 1, 4), {k.string('card', f'substr({digits}, 5, length({digits}) - 5)')})"
    card = let(body, "p", let(f"concat(p, CAST((10 - {_luhn("concat(p, '0')")} % 10) % 10 AS STRING))", "q", _same_shape(m, "q")))
    account = k.string("iban", f"substr({compact}, 5)")
    iban = let(account, "p", f"concat(substr({m}, 1, 2), lpad(CAST(98 - {_mod97(f"concat(p, substr({m}, 1, 2), '00')")} AS STRING), 2, '0'), p)")
    iban = let(iban, "q", _same_shape(m, "q", "c <> ' '"))
    country = f"regexp_extract({m}, '^([+][0-9]{{1,3}}[ .-]?)?', 0)"
    phone = f"concat({country}, {let(k.string('phone', f"regexp_replace(substr({m}, length({country}) + 1), '[^0-9]', '')"), 'p', _same_shape(f'substr({m}, length({country}) + 1)', 'p'))})"
    hexes = f"regexp_extract({m}, '[0-9a-fA-F]{{16,}}$', 0)"
    secret = f"concat(substr({m}, 1, length({m}) - length({hexes})), {k.string('secret', hexes, 6)})"
    local = f"substring_index({m}, '@', 1)"
    return {
        "email": ("true", f"concat({k.string('email', local, scripts=True)}, substr({m}, length({local}) + 1))"),
        "ipv4": ("true", k.numbers("ipv4", f"{octet(0)} * 256 + {octet(1)}", 65536, f"{octet(2)} * 256 + {octet(3)}", 65536, address)),
        "iban": (_iban_ok(m), iban),
        "date": (f"{day} IS NOT NULL", let(day, "d", new_day("d"))),
        "ssn": ("true", ssn),
        "card": (_card_ok(m), card),
        "phone": ("true", phone),
        "secret": ("true", secret),
    }


def _of_kind(m: str, kind: str) -> str:
    """Whether a match, seen alone, has the format of a kind."""
    return f"{m} RLIKE {_sql('^(?:' + FORMATS[kind] + ')$')}"


def pseudonym(match: str, key: str) -> str:
    """SQL: a struct of kind and pseudonym of one match; kind null and the match itself if not valid."""
    parts = _parts(_Keyed(key), match)
    cases = " ".join(f"WHEN {_of_kind(match, kind)} AND {valid} THEN named_struct('kind', {_sql(kind)}, 'text', {new})" for kind, (valid, new) in parts.items())
    return f"CASE {cases} ELSE named_struct('kind', CAST(NULL AS STRING), 'text', {match}) END"


def _pattern(text: str) -> str:
    """SQL: the pattern that cuts a text, with its valid cards and IBANs spelt out."""
    every = lambda patterns: f"concat({', '.join(f'regexp_extract_all({text}, {_sql(p)}, 1)' for p in patterns)})"
    valid = f"array_distinct(concat(filter({every(_CARDS)}, m -> {_card_ok('m')}), filter({every(_IBANS)}, m -> {_iban_ok('m')})))"
    ranked = f"transform(sort_array(transform({valid}, m -> named_struct('gaps', m RLIKE '[ -]', 'size', -length(m), 'm', m))), o -> o.m)"
    spelt = f"concat({_sql(_BEFORE + '|(?<![A-Za-z0-9])(?:')}, array_join(v, '|'), {_sql(')(?![A-Za-z0-9])|' + _AFTER)})"
    none = _sql(f"{_BEFORE}|{_AFTER}")
    return f"if({text} RLIKE {_sql(_CHECKED)}, {_let(ranked, 'v', f'if(size(v) = 0, {none}, {spelt})')}, {none})"


def replace(docs: DataFrame, key: str, text: str = "text", kinds: str | None = None, found: str | None = None) -> DataFrame:
    """All rows and columns, with every valid value in ``text`` replaced by its pseudonym.

    ``kinds`` names an array column for the kinds replaced, ``found`` a column for their
    number. Null text stays null and has none; text without personal data is unchanged;
    equal rows stay equal; an empty table stays empty. The key is part of the plan: take it
    from a secret store and don't publish query plans.
    """
    source, result = free_names([*docs.columns, *filter(None, (kinds, found))], "text_", "new_")
    some = F.col(source).rlike("[0-9@]")
    picked = docs.withColumn(source, F.col(text).cast("string"))
    pieces = f"if({source} RLIKE {_sql(_CHECKED)}, split({source}, {_sql(_BREAK)}, -1), array({source}))"
    new = f"transform(regexp_extract_all(piece, cut, 0), m -> {pseudonym('m', key)})"
    merged = "array_join(zip_with(split(piece, cut, -1), new, (g, n) -> concat(g, coalesce(n.text, ''))), '')"
    done = _let(new, "new", f"named_struct('text', if(size(new) > 0, {merged}, piece), 'kinds', transform(new, n -> n.kind))")
    picked = picked.withColumn(result, F.when(some, F.expr(f"transform({pieces}, piece -> {_let(_pattern('piece'), 'cut', done)})")))
    put = F.when(F.expr(f"exists({result}, n -> size(n.kinds) > 0)"), F.expr(f"array_join(transform({result}, n -> n.text), '')")).otherwise(F.col(source))
    listed = F.expr(f"coalesce(filter(flatten(transform({result}, n -> n.kinds)), x -> x IS NOT NULL), array())").cast("array<string>")
    extra = ([listed.alias(kinds)] if kinds else []) + ([F.size(listed).cast("bigint").alias(found)] if found else [])
    kept = [put.alias(c) if c == text else F.col(c) for c in docs.columns if c not in (kinds, found)]
    return picked.select(*kept, *extra)
