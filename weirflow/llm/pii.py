"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation in SQL expressions.

Values are found by pattern and then validated: card numbers by their check digit, IBANs by their remainder, addresses and
national numbers by their parts, dates by the calendar. A valid value goes through a Feistel network over its own
format: its characters are cut in halves, and each round adds a keyed hash of one half to the other, character by
character, within the class of the character (digit, capital, small letter, hexadecimal digit). That permutes the values of
one format, so equal values get equal pseudonyms in all documents, different ones different pseudonyms, and no table
of values is kept. Separators stay; check digits are made to fit; a date moves within its 400-year cycle of the calendar.

A card or account number that fails validation as far as its pattern goes is tried up to each of its separators, so that
what follows it (an expiry date, a currency) doesn't hide it.

Patterns and rounds are evaluated in the row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require

ROUNDS = 10
#: The session setting that names the key, and the key if none is set or given: for demonstrations only.
KEY_SETTING, DEMONSTRATION_KEY = "spark.weirflow.pseudonym.key", "weirflow demonstration key"

_B, _E = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Candidates by kind, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![0-9A-Za-z._%+-])[0-9A-Za-z._%+-]{1,64}+@(?:[0-9A-Za-z](?:[0-9A-Za-z-]{0,62})\.){1,8}[A-Za-z]{2,24}" + _E,
    "iban": _B + r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?" + _E,
    "ip6": r"(?<![0-9A-Za-z:])(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9A-F]{1,4}:){7}[0-9A-F]{1,4})(?![0-9A-Za-z:])",
    "ip": r"(?<![0-9A-Za-z.])(?<![Vv]ersion )(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?![0-9A-Za-z]|\.[0-9])",
    "iso_date": _B + r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9]{2}:|(?![0-9A-Za-z]))",
    "dot_date": _B + r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}" + _E,
    "slash_date": _B + r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}" + _E,
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + _E,
    "long_phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-][0-9]{2,5}){2,5}" + _E,
    "ssn": _B + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _E,
    "card": _B + r"[0-9](?:[ -]?[0-9]){12,18}" + _E,
    # Prefixes of access keys that are public knowledge (fixed values).
    "token": _B + r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36})" + _E,
    "secret": _B + r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})" + _E,
}
#: What a number cut before a separator has to look like: common groupings of card numbers, and accounts in fours.
CARD_SHAPE = "^(?:[0-9]{4}[ -]){3}[0-9]{4}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}$|^[0-9]{13,19}$"
IBAN_SHAPE = "^[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?$"
CANDIDATE = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Days of the Gregorian cycle of 400 years, and two factors of it, the radices of a date's halves.
CYCLE, RADICES, EPOCH = 146097, (189, 773), "1800-01-01"


def _text(s: str) -> str:
    """A SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """body, in which name stands for the value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _hash(key: str, kind: str, turn: str, half: str) -> str:
    return f"sha2(concat_ws('|', {_text(key)}, '{kind}', cast({turn} as string), cast({half} as string)), 512)"


def _shift(half: str, digest: str, hexadecimal: str | None = None) -> str:
    """half with each character moved on within its class by three hex digits of the digest."""
    classes = f"case when x between '0' and '9' then '0123456789' when x between 'a' and 'z' then '{_LOWER}' when x between 'A' and 'Z' then '{_UPPER}' end"
    by = "cast(conv(substring(d, 1 + 3 * (j % 42), 3), 16, 10) as int)"
    moved = _let("q", hexadecimal or classes, f"coalesce(substring(q, 1 + (instr(q, x) - 1 + {by}) % length(q), 1), x)")
    return _let("d", digest, f"array_join(transform(split({half}, ''), (x, j) -> {moved}), '')")


_LOWER, _UPPER = "".join(map(chr, range(97, 123))), "".join(map(chr, range(65, 91)))


def _feistel(core: str, key: str, kind: str, hexadecimal: str | None = None) -> str:
    """The permuted core, a string of ASCII letters and digits, class by class."""
    left = f"named_struct('l', {_shift('s.l', _hash(key, kind, 'i', 's.r'), hexadecimal)}, 'r', s.r)"
    right = f"named_struct('l', s.l, 'r', {_shift('s.r', _hash(key, kind, 'i', 's.l'), hexadecimal)})"
    start = "named_struct('l', substring(c, 1, length(c) div 2), 'r', substring(c, 1 + length(c) div 2))"
    return _let("c", core, f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, i) -> if(i % 2 = 0, {left}, {right}), s -> concat(s.l, s.r))")


def _feistel_numbers(number: str, radices: tuple[int, int], key: str, kind: str) -> str:
    """The permuted number in [0, product of the radices)."""
    a, b = radices

    def round_(half: str, other: str, radix: int) -> str:
        return f"cast((s.{half} + cast(conv(substring({_hash(key, kind, 'i', 's.' + other)}, 1, 12), 16, 10) as bigint)) % {radix} as bigint)"

    left = f"named_struct('l', {round_('l', 'r', a)}, 'r', s.r)"
    right = f"named_struct('l', s.l, 'r', {round_('r', 'l', b)})"
    start = f"named_struct('l', cast(c div {b} as bigint), 'r', cast(c % {b} as bigint))"
    return _let("c", number, f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, i) -> if(i % 2 = 0, {left}, {right}), s -> s.l * {b} + s.r)")


def _core(value: str, drop: str = "[^0-9A-Za-z]") -> str:
    return f"regexp_replace({value}, '{drop}', '')"


def _refill(value: str, core: str, kept: str = "[0-9A-Za-z]") -> str:
    """value with its characters of a class taken from core, one after the other."""
    at = f"length(regexp_replace(substring({value}, 1, k + 1), '[^{kept[1:]}', ''))"
    return _let("w", core, f"array_join(transform(split({value}, ''), (y, k) -> if(y rlike '^{kept}$', substring(w, {at}, 1), y)), '')")


def _luhn(payload: str) -> str:
    """The check digit, as text."""
    doubled = "transform(split(reverse(p), ''), (x, j) -> if(j % 2 = 0, cast(x as int) * 2 - if(cast(x as int) > 4, 9, 0), cast(x as int)))"
    return _let("p", payload, f"cast((10 - aggregate({doubled}, 0, (t, x) -> t + x) % 10) % 10 as string)")


def _mod97(letters: str) -> str:
    step = "if(x between '0' and '9', (t * 10 + cast(x as int)) % 97, (t * 100 + ascii(x) - 55) % 97)"
    return f"aggregate(split({letters}, ''), 0, (t, x) -> {step})"


def _longest(value: str, valid: str, moved: str, shape: str) -> str:
    """The moved longest beginning of value that is valid and ends where it does or, if it has a shape, before a separator.

    valid and moved: SQL about the variable pre. NULL if there's none.
    """
    ends = f"filter(sequence(length({value}), 1, -1), e -> e = length({value}) or substring({value}, e + 1, 1) in (' ', '-') and left({value}, e) rlike {_text(shape)})"
    found = f"filter(transform({ends}, e -> left({value}, e)), pre -> {valid})"
    put = _let("pre", "found[0]", f"concat({moved}, substring({value}, length(pre) + 1))")
    return _let("found", found, f"if(size(found) = 0, null, {put})")


def _date(value: str, formats: list[str], key: str) -> str:
    """The date permuted in its cycle and written as it was read, by the first format that fits; NULL if none does."""
    out = "null"
    for f in reversed(formats):
        day = f"cast(try_to_timestamp({value}, '{f}') as date)"
        since = f"datediff(t, date'{EPOCH}')"
        moved = f"cast({_feistel_numbers(f'cast(pmod({since}, {CYCLE}) as bigint)', RADICES, key, 'date')} as int)"
        out = _let("t", day, f"if(t is null, {out}, date_format(date_add(date'{EPOCH}', {moved} + cast(floor({since} / {CYCLE}) as int) * {CYCLE}), '{f}'))")
    return out


def pseudonym(value: str, key: str) -> str:
    """SQL for the pseudonym of a candidate; NULL if it isn't valid. value: the name of a column or variable."""

    def plain(kind: str) -> str:
        return _refill(value, _feistel(_core(value), key, kind))

    digits, own = _core(value, "[^0-9]"), _core("pre", "[^0-9]")
    card_core = _let("v", own, _let("g", _feistel("substring(v, 1, length(v) - 1)", key, "card"), f"concat(g, {_luhn('g')})"))
    card = _longest(value, _let("v", own, _luhn("substring(v, 1, length(v) - 1)") + " = right(v, 1)"), _refill("pre", card_core), CARD_SHAPE)
    bban = _feistel("substring(v, 5)", key, "iban")
    iban_core = _let("v", _core("pre"), _let("g", bban, f"concat(left(v, 2), lpad(cast(98 - {_mod97('concat(g, left(v, 2), ' + _text('00') + ')')} as string), 2, '0'), g)"))
    iban = _longest(value, _let("v", _core("pre"), _mod97("concat(substring(v, 5), left(v, 4))") + " = 1"), _refill("pre", iban_core), IBAN_SHAPE)
    octets = f"transform(split({value}, '[.]'), o -> cast(o as bigint))"
    number = _let("v", octets, "((v[0] * 256 + v[1]) * 256 + v[2]) * 256 + v[3]")
    moved = _feistel_numbers(number, (65536, 65536), key, "ip")
    ip = _let("n", moved, "concat_ws('.', cast(n div 16777216 as string), cast(n div 65536 % 256 as string), cast(n div 256 % 256 as string), cast(n % 256 as string))")
    local = _let("e", f"substring_index({value}, '@', 1)", _refill("e", _feistel(_core("e"), key, "email")))
    email = f"concat({local}, '@', substring_index({value}, '@', -1))"
    code = _let("f", f"regexp_extract({value}, '^[+][0-9]{{1,3}}(?![0-9])', 0)", _let("e", f"substring({value}, length(f) + 1)", "concat(f, " + _refill("e", _feistel(_core("e"), key, "phone")) + ")"))
    count = f"length({digits})"
    ssn = f"if({value} rlike '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}$', {plain('ssn')}, null)"
    upper = f"if({value} rlike '[A-F]', '0123456789ABCDEF', '0123456789abcdef')"
    ip6 = _refill(value, _feistel(_core(value), key, "ip6", upper))
    token = f"concat(left({value}, 4), {_feistel(f'substring({value}, 5)', key, 'token')})"
    whole = {k: _text(f"^(?:{p})$") for k, p in PATTERNS.items()}
    return (
        f"case when {value} rlike {whole['email']} then {email}"
        f" when {value} rlike {whole['ip6']} then {ip6}"
        f" when {value} rlike {whole['ip']} then {ip}"
        f" when {value} rlike {whole['iso_date']} then {_date(value, ['yyyy-MM-dd'], key)}"
        f" when {value} rlike {whole['dot_date']} then {_date(value, ['dd.MM.yyyy', 'd.M.yyyy'], key)}"
        f" when {value} rlike {whole['slash_date']} then {_date(value, ['dd/MM/yyyy', 'MM/dd/yyyy', 'd/M/yyyy', 'M/d/yyyy'], key)}"
        f" when {value} rlike {whole['ssn']} then {ssn}"
        f" when {value} rlike {whole['iban']} then {iban}"
        f" when {value} rlike {whole['phone']} or {value} rlike {whole['long_phone']} and {count} between 10 and 15 then {code}"
        f" when {value} rlike {whole['card']} then {card}"
        f" when {value} rlike {whole['token']} then {token}"
        f" when {value} rlike {whole['secret']} then {_feistel(value, key, 'secret', upper)} end"
    )


def pseudonymize(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with pseudonyms in text, and values, the number of values that got one. key: if None, the session's KEY_SETTING.

    Candidates that don't validate stay as they are, and so does everything around them. NULL and empty texts stay, with 0
    values. All rows and other columns stay; an existing column named values is replaced. n_chars isn't touched: only an
    IP address or a date of one-digit parts can change a text's length. An empty table gives an empty one.
    """
    require(docs, "text")
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None) or DEMONSTRATION_KEY
    pattern = _text(CANDIDATE)
    found = _let("m", f"regexp_extract_all(text, {pattern}, 0)", f"named_struct('m', m, 'p', transform(m, value -> {pseudonym('value', key)}))")
    pieces = f"split(text, {pattern}, -1)"
    joined = f"array_join(flatten(zip_with({pieces}, zip_with(h.m, h.p, (x, y) -> coalesce(y, x)), (x, y) -> array(x, coalesce(y, '')))), '')"
    changed = _let("h", found, f"named_struct('text', if(size(h.m) = 0, text, {joined}), 'n', size(filter(h.p, x -> x is not null)))")
    out = f"case when text rlike '[0-9@]' then {changed} else named_struct('text', text, 'n', 0) end"
    kept = [c for c in docs.columns if c not in ("text", "values")]
    both = docs.withColumn("__weir_pii", F.expr(out))
    return both.select(*kept, F.col("__weir_pii.text").alias("text"), F.col("__weir_pii.n").alias("values")).select(*[c for c in docs.columns if c != "values"], "values")
