"""Format-preserving Feistel pseudonyms for personal data, in SQL functions only.

Candidates are found by one pattern and validated (Luhn's check, octets, social
security areas, calendar dates). A validated value is read as an array of digits,
each with a radix of its own, and goes through a keyed alternating Feistel
network: in each round one half of the digits is shifted by an HMAC of the other
half, digit by digit modulo its radix, with 32 bits of the HMAC for each digit and
another HMAC for every eight of them. That is a permutation of the values
of a format, so equal values get equal pseudonyms in all documents and different
ones of a format stay different. Letters stay letters of their case, digits stay
digits, a card number keeps a right check digit, a date stays a date.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.llm.common import fresh

ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31: the domain of dates.
DAYS = 73_049

#: A run of digit groups in which cards of 4-4-4-4 and 4-6-5 may stand, overlapping
#: ones too. A group after the fourth that begins a mail address is not of the run;
#: a date whose year may be the last group is.
_RUN = (
    r"(?:\d{4}(?:[ -]\d{4}){3}(?!\w)(?:(?: (?![A-Za-z0-9._%+-]++@)|-)\d{4}(?!\w))*+(?:[ -]\d{6}[ -]\d{5}(?!\w)|(?<= \d{4})-\d{2}-\d{2}(?![\d-]))?"
    r"|\d{4}[ -]\d{6}[ -]\d{5}(?!\w))"
)
#: What may be personal, each beginning and ending outside a longer run. A phone or
#: social security number that may share a group with a card is one candidate with it.
PATTERN = "|".join(
    (
        r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}+(?![\w-])",
        r"(?<![\w])AKIA[A-Z0-9]{16}(?![\w])",
        r"(?<![\w])(?i:password|passwd|secret|token|api_key|apikey)(?-i)[ \t]{0,4}[=:][ \t]{0,4}[\"']?(?![A-Za-z][a-z]++(?![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{8,}+",
        r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
        r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]" + _RUN,
        r"(?<![\w+.-])(?:\+\d{1,3}[ .-])?\d{3}[ .-]\d{3}[ .-]" + _RUN,
        r"(?<![\w.-])\d{3}-\d{2}-" + _RUN,
        r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)",
        r"(?<![\w+.-])(?:\+\d{1,3}[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])",
        r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])",
        r"(?<![\w.-])\d{4}-\d{2}-\d{2}(?![\d-])",
        r"(?<!\w)(?<!\d[.-])\d{13,19}(?!\w)",
        r"(?<!\w)" + _RUN,
    )
)

_LUHN = (
    "pmod(aggregate(transform(split(reverse({0}), ''), (c, i) -> cast(c as bigint) * (1 + i % 2)), 0L, (a, x) -> a + x div 10 + x % 10), 10)"
)

_DAY = "try_to_date({0}, 'yyyy-MM-dd') between date'1900-01-01' and date'2099-12-31'"


def _quoted(text: str) -> str:
    return "r'" + text.replace("'", "\\x27") + "'"


def _feistel(digits: str, radices: str, tweak: str) -> str:
    """SQL for the permuted digits (array of bigint), given SQL for the digits,
    their radices (arrays of bigint) and a string that tells formats apart."""
    half = "(size(z.r) + 1) div 2"
    # even rounds shift the first half by the second, odd ones the second by the first
    own = f"if(q % 2 = 0, {half}, size(s) - {half})"
    other = f"if(q % 2 = 0, slice(s, {half} + 1, greatest(size(s) - {half}, 0)), slice(s, 1, {half}))"
    message = f"concat_ws('|', z.t, cast(q as string), array_join(transform({other}, x -> cast(x as string)), ','))"
    blocks = f"transform(sequence(0, greatest({own} - 1, 0) div 8), b -> {_hmac("concat(m, '|', cast(b as string))")})"
    hashes = f"element_at(transform(array({message}), m -> {blocks}), 1)"
    place = f"(j - if(q % 2 = 0, 0, {half}))"
    shift = f"cast(conv(substr(h[{place} div 8], 1 + ({place} % 8) * 8, 8), 16, 10) as bigint)"
    one = f"transform(s, (d, j) -> if((j < {half}) = (q % 2 = 0), pmod(d + {shift}, z.r[j]), d))"
    rounds = f"aggregate(sequence(0, {ROUNDS - 1}), z.d, (s, q) -> element_at(transform(array({hashes}), h -> {one}), 1))"
    return f"element_at(transform(array(named_struct('d', {digits}, 'r', {radices}, 't', {tweak})), z -> {rounds}), 1)"


def _hmac(message: str) -> str:
    """SQL for the HMAC-SHA256 of a string in hex; the key's two pads take the place of the marks."""
    return f"sha2(concat(hmac_outer(), unhex(sha2(concat(hmac_inner(), cast({message} as binary)), 256))), 256)"


def _pads(key: str | bytes) -> tuple[str, str]:
    """SQL literals of a key's inner and outer pad."""
    raw = key.encode() if isinstance(key, str) else key
    padded = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return tuple("X'" + bytes(b ^ pad for b in padded).hex() + "'" for pad in (0x36, 0x5C))


#: What a key's pads look like in a plan.
_SECRET = "[0-9a-fA-F]{128}"


def hide_keys(spark: SparkSession) -> None:
    """Have Spark cross out pads of keys wherever it prints a plan."""
    name = "spark.sql.redaction.string.regex"
    now = spark.conf.get(name, None) or ""
    if _SECRET not in now:
        spark.conf.set(name, f"{now}|{_SECRET}" if now else _SECRET)


def _by_class(value: str, start: str, stop: str, tweak: str) -> str:
    """SQL for `value` with the characters from start to before stop (from 0)
    permuted within their class: digits, lower case, upper case; others stay."""
    codes = f"transform(split(substr({value}, {start} + 1, {stop} - {start}), ''), c -> cast(ascii(c) as bigint))"
    base = "case when a between 48 and 57 then 48L when a between 97 and 122 then 97L when a between 65 and 90 then 65L else a end"
    radix = "case when a between 48 and 57 then 10L when a between 97 and 122 then 26L when a between 65 and 90 then 26L else 1L end"
    moved = _feistel(f"transform(k.c, a -> a - {base})", f"transform(k.c, a -> {radix})", f"concat({tweak}, array_join(transform(k.c, a -> {base}), ','))")
    text = f"array_join(zip_with({moved}, transform(k.c, a -> {base}), (x, b) -> chr(x + b)), '')"
    inner = f"element_at(transform(array(named_struct('c', {codes})), k -> {text}), 1)"
    return f"concat(substr({value}, 1, {start}), {inner}, substr({value}, {stop} + 1))"


def _octets(value: str) -> str:
    moved = _feistel(f"transform(split({value}, '[.]'), x -> cast(x as bigint))", "array(256L, 256L, 256L, 256L)", "'ip'")
    return f"array_join(transform({moved}, x -> cast(x as string)), '.')"


def _ssn(value: str) -> str:
    """Areas 001 to 665 and 667 to 899, groups 01 to 99, serials 0001 to 9999."""
    area = f"cast(substr({value}, 1, 3) as bigint)"
    digits = f"array({area} - if({area} > 666, 2L, 1L), cast(substr({value}, 5, 2) as bigint) - 1, cast(substr({value}, 8, 4) as bigint) - 1)"
    moved = _feistel(digits, "array(898L, 99L, 9999L)", "'ssn'")
    return f"element_at(transform(array({moved}), y -> concat_ws('-', lpad(cast(y[0] + if(y[0] >= 665, 2, 1) as string), 3, '0'), lpad(cast(y[1] + 1 as string), 2, '0'), lpad(cast(y[2] + 1 as string), 4, '0'))), 1)"


def _date(value: str) -> str:
    """The day's number, permuted among 271 * 270 and again until it is a day of the domain."""
    again = _feistel("array(n div 270, n % 270)", "array(271L, 270L)", "'date'")
    step = f"element_at(transform(array({again}), y -> y[0] * 270 + y[1]), 1)"
    walked = f"aggregate(sequence(1, 12), -1L, (w, i) -> if(w between 0 and {DAYS - 1}, w, element_at(transform(array(if(w < 0, cast(datediff(try_to_date({value}, 'yyyy-MM-dd'), date'1900-01-01') as bigint), w)), n -> {step}), 1)))"
    return f"date_format(date_add(date'1900-01-01', cast({walked} as int)), 'yyyy-MM-dd')"


def _card(value: str) -> str:
    """All digits but the last permuted, then the check digit that Luhn's rule asks for; separators stay."""
    body = f"element_at(transform(array({_by_class(value, '0', f'(length({value}) - 1)', chr(39) + 'card' + chr(39))}), b -> substr(b, 1, length(b) - 1)), 1)"
    check = _LUHN.format("concat(regexp_replace(b, '[ -]', ''), '0')")
    return f"element_at(transform(array({body}), b -> concat(b, cast(pmod(10 - {check}, 10) as string))), 1)"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _pieces() -> str:
    """SQL for the pieces of a candidate m: structs of a text v and whether it stays.

    All but runs of groups are one piece. In a run every window of Luhn's rule goes:
    from the left, one that overlaps none before it is a card; groups that only a
    window overlapping a card has are pieces of their own. Of the number before a
    run and the date after it, what shares no group with a card is a piece too.
    """
    head, tail = r"regexp_extract(m, r'^(?:[+(]?\d{1,3}[() .-]+)*', 0)", r"regexp_extract(m, r'-\d{2}-\d{2}$', 0)"
    split = _let("o", f"named_struct('h', {head}, 'e', {tail})", "named_struct('h', o.h, 'e', o.e, 'c', substr(m, length(o.h) + 1, length(m) - length(o.h) - length(o.e)))")
    groups = _let("o", split, "named_struct('h', o.h, 'e', o.e, 'g', split(o.c, '[ -]'), 's', regexp_extract_all(o.c, '[ -]', 0))")
    fours = "(size(o.g) - if(length(element_at(o.g, -1)) = 5, 2, 0))"
    width = f"if(u + 4 <= {fours}, 4, if(u + 1 = {fours} and size(o.g) > {fours}, 3, 0))"
    wide = _let("o", groups, f"named_struct('h', o.h, 'e', o.e, 'g', o.g, 's', o.s, 'w', transform(sequence(0, size(o.g) - 1), u -> {width}))")
    right = f"o.w[u] > 0 and {_LUHN.format("array_join(slice(o.g, u + 1, o.w[u]), '')")} = 0"
    valid = _let("o", wide, f"named_struct('h', o.h, 'e', o.e, 'g', o.g, 's', o.s, 'w', o.w, 'r', transform(sequence(0, size(o.g) - 1), u -> {right}))")
    # a string with a mark at each card's first group; it ends with the last card's
    marks = "aggregate(filter(sequence(0, size(o.g) - 1), u -> o.r[u]), '', (f, u) -> if(f = '' or u >= length(f) + 3, concat(rpad(f, u, '-'), 'c'), f))"
    marked = _let("o", valid, f"named_struct('h', o.h, 'e', o.e, 'g', o.g, 's', o.s, 'w', o.w, 'r', o.r, 'f', split(rpad({marks}, size(o.g), '-'), ''))")
    piece = lambda v, stays: f"named_struct('v', {v}, 'stays', {stays})"
    after = lambda u: f"coalesce(get(o.s, {u}), '')"
    near = lambda array, test: "(" + " or ".join(f"coalesce(get({array}, u - {i}){test}, false)" for i in (1, 2, 3)) + ")"
    window = "array_join(zip_with(slice(o.g, u + 1, o.w[u]), concat(slice(o.s, u + 1, o.w[u] - 1), array('')), (x, y) -> concat(x, y)), '')"
    last = "u + 1 = size(o.g)"
    day = f"o.e <> '' and coalesce({_DAY.format('concat(t, o.e)')}, false)"
    ended = f"if({last}, o.e, {after('u')})"
    other = f"get(o.s, 0) <> ' ' and not (o.h like '%)%')"
    run = f"""flatten(transform(o.g, (t, u) -> case
        when o.f[u] = 'c' then array({piece("if(u = 0, o.h, '')", 'true')}, {piece(window, 'false')}, {piece(f"if(u + o.w[u] = size(o.g), o.e, {after('u + o.w[u] - 1')})", 'true')})
        when {near('o.f', " = 'c'")} then array({piece("''", 'true')})
        when {last} and {day} then array({piece('concat(t, o.e)', 'false')})
        when o.r[u] or {near('o.r', '')} then array({piece('t', 'false')}, {piece(ended, 'true')})
        when u = 0 and o.h <> '' then array({piece('concat(o.h, t)', other)}, {piece(after('u'), 'true')})
        else array({piece(f'concat(t, {ended})', 'true')}) end))"""
    is_run = r"m rlike r'^[+(0-9]' and not contains(m, '@') and m rlike r'\d{4}[ -](?:\d{4}[ -]\d{4}[ -]\d{4}|\d{6}[ -]\d{5})'"
    return f"if({is_run}, {_let('o', marked, run)}, array({piece('m', 'false')}))"


def _pseudonym() -> str:
    """SQL for the pseudonym of a candidate m; m itself where it isn't valid."""
    octets = "forall(split(m, '[.]'), x -> cast(x as int) <= 255)"
    area = "cast(substr(m, 1, 3) as int)"
    return f"""case
        when m rlike '@' then {_by_class('m', '0', "(instr(m, '@') - 1)", "'email'")}
        when m rlike r'^AKIA' then {_by_class('m', '4', 'length(m)', "'key'")}
        when m rlike r'^[A-Za-z]' then {_by_class('m', "length(regexp_extract(m, r'^[A-Za-z_]+[ \\t]*[=:][ \\t]*[^A-Za-z0-9+/_-]?', 0))", 'length(m)', "'secret'")}
        when m rlike r'^[0-9]+([.][0-9]+){{3}}$' and length(m) <= 15 then if({octets}, {_octets('m')}, m)
        when m rlike r'^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then if({area} between 1 and 899 and {area} <> 666 and substr(m, 5, 2) <> '00' and substr(m, 8, 4) <> '0000', {_ssn('m')}, m)
        when m rlike r'^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' then if({_DAY.format('m')}, {_date('m')}, m)
        when length(regexp_replace(m, '[^0-9]', '')) >= 13 and not m rlike r'[(+.]' then if({_LUHN.format("regexp_replace(m, '[ -]', '')")} = 0, {_card('m')}, m)
        else {_by_class('m', "length(regexp_extract(m, r'^[+][0-9]+[ .-]?', 0))", 'length(m)', "'phone'")} end"""


def pseudonymise(docs: DataFrame, key: str | bytes, column: str = "text") -> DataFrame:
    """docs with `column`'s personal data replaced by pseudonyms under `key`, and
    the columns pii_found (candidates) and pii_changed (replaced), both long. A run of
    digit groups counts as often as there are cards in it, once at least.

    A null text stays null and counts zero; an empty one stays empty. Texts may be of
    any length. Rows don't depend on each other, so repeated rows stay equal, and an
    empty table gives none. Existing columns named pii_found or pii_changed are
    replaced; all others stay as they are, whatever their names. One scan, no
    shuffle, no Python. The key is in the plan as its two HMAC pads, which
    `hide_keys` has Spark cross out where it prints plans.
    """
    hide_keys(docs.sparkSession)
    inner, outer = _pads(key)
    rest = [c for c in docs.columns if c.lower() not in ("pii_found", "pii_changed")]
    held, new = fresh(docs.columns, "_found", "_new")
    every = f"transform(regexp_extract_all(`{column}`, {_quoted(PATTERN)}, 0), m -> {_pieces()})"
    columns = [F.col(f"`{c}`") for c in rest]
    found = docs.select(*columns, F.expr(every).alias(held))
    each = f"if(p.stays, p.v, {_let('m', 'p.v', _pseudonym())})".replace("hmac_inner()", inner).replace("hmac_outer()", outer)
    made = found.select(*columns, held, F.expr(f"transform(`{held}`, ps -> transform(ps, p -> {each}))").alias(new))
    parts = f"split(`{column}`, {_quoted(PATTERN)}, -1)"
    joined = f"element_at(transform(array({parts}), p -> concat(p[0], array_join(zip_with(`{new}`, slice(p, 2, size(`{new}`)), (m, s) -> concat(array_join(m, ''), s)), ''))), 1)"
    text = F.expr(f"if(size(`{held}`) > 0, {joined}, `{column}`)").alias(column)
    count = lambda each: F.coalesce(F.expr(f"aggregate({each}, 0L, (x, y) -> x + y)"), F.lit(0)).cast("long")
    candidates = count(f"transform(`{held}`, ps -> greatest(1, size(filter(ps, p -> not p.stays))))")
    changed = count(f"transform(flatten(zip_with(`{held}`, `{new}`, (ps, ns) -> zip_with(ps, ns, (p, n) -> p.v <=> n))), same -> if(same, 0, 1))")
    return made.select(*(text if c == column else F.col(f"`{c}`") for c in rest), candidates.alias("pii_found"), changed.alias("pii_changed"))
