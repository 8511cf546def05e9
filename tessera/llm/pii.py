r"""Format-preserving pseudonyms, in DataFrame and SQL functions only.

Validated numbers and dates are permuted by a keyed Feistel network within
their own format: equal values get equal pseudonyms in every document, other
values never do, and separators, length and check digits stay valid.

Kinds, in order of precedence:

* e-mail addresses, passwords and tokens have no format worth keeping: 128
  bits of a keyed digest replace the address or the secret;
* access keys: prefix kept, the 16 places permuted among those of A-Z and 0-9;
* IBANs, mod-97 valid, letters and digits of the account each permuted in
  their own alphabet; check digits anew;
* phone numbers in the North American form: all ten digits, country code kept;
* payment cards: 13 to 19 digits, single spaces or hyphens between, Luhn
  valid; first digit kept, check digit computed anew;
* US social security numbers ``ddd-dd-dddd`` of an assignable range;
* IPv4 addresses;
* dates of 1900-2099: ``yyyy-mm-dd``, ``dd.mm.yyyy`` and ``mm/dd/yyyy``.

The network alternates between Z_a and Z_b: x <- x + F(key, kind, round, y)
mod a, then the halves change roles.  Each step is invertible, so the whole is
a permutation of the a * b values of the kind, without cycle walking.  The key
reaches the expressions as a column of a one-row table, so that executed plans
do not show it.

Defined cases: a null text stays null with no findings; an empty table gives
none; texts of any length are read whole; numbers that fail their check stay
as they are; every other column passes through whatever its name, but for one
named as ``count_col``, which is replaced; ties and repeated rows are treated
alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Length of the IBANs of countries whose accounts may have letters.
_LETTERED = {18: "NL", 20: "KZ|LU", 21: "CH|LI|LV", 22: "BG|BH|GB|GE|IE", 23: "GI|IQ", 24: "AD|MD|PK|RO|SA|VG", 26: "TR", 27: "FR|GR|IT|MC|SM", 28: "AL|AZ|BY|CY|DO|GT|LB|NI|SV", 29: "BR|PS|QA|UA", 30: "JO|KW|MU", 31: "MT|SC", 32: "LC"}
_FOURS = "|".join(f"(?:{c})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in _LETTERED.items())
#: Patterns of each kind: fixed formats.  Groups are non-capturing.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_])(?i:password|passwd|pwd|secret|token|api_key|apikey|access_key)(?: ?[=:] ?\"?)[^\s\"']{6,}+",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": rf"(?<![A-Za-z0-9])(?:{_FOURS}|[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9]{{4}}){{2,7}}(?: ?[0-9]{{1,3}})?)(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9.])(?:[0-9]{13,19}|(?:[0-9]{4} ){3}[0-9]{1,7}|(?:[0-9]{4}-){3}[0-9]{1,7}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9])(?:\+?1[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "ipv4": r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9])",
    "date": r"(?<![A-Za-z0-9])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![A-Za-z0-9])",
}
_ANY = "|".join(PATTERNS.values())
#: A text without any of these has nothing to find.
_HINT = r"[0-9@]|(?i:password|passwd|pwd|secret|token|key)"
#: Days from 1900-01-01 to 2099-12-31: 73,049 = 17 * 4,297.
_DAYS = (17, 4297)


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _mix(key: str, kind: str, x: str, y: str, a: str, b: str) -> str:
    """struct(x, y) after the network; x in Z_a, y in Z_b.  ``key`` is SQL."""
    f = f"CAST(conv(substring(sha2(concat_ws(':', {key}, {_lit(kind)}, CAST(r AS string), CAST(acc.y AS string)), 256), 1, 15), 16, 10) AS bigint)"
    swap = f"named_struct('x', acc.y, 'y', (acc.x + {f}) % if(r % 2 = 1, {a}, {b}))"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('x', CAST({x} AS bigint), 'y', CAST({y} AS bigint)), (acc, r) -> {swap})"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _permuted_digits(key: str, kind: str, d: str) -> str:
    """The digit string ``d`` (2 to 36 digits) permuted among those as long."""
    half = f"(length({d}) div 2)"
    size = lambda n: f"CAST(concat('1', repeat('0', {n})) AS bigint)"
    mixed = _mix(f"{key}", kind, f"substring({d}, 1, {half})", f"substring({d}, {half} + 1)", size(half), size(f"(length({d}) - {half})"))
    return _let(mixed, "mix", f"concat(lpad(CAST(mix.x AS string), {half}, '0'), lpad(CAST(mix.y AS string), length({d}) - {half}, '0'))")


def _permuted_letters(key: str, kind: str, s: str) -> str:
    """The capital letters ``s`` permuted among strings as long; those after
    the first 26, which only an account without digits has, stay."""
    n = f"least(length({s}), 26)"
    half = f"({n} div 2)"
    size = lambda k: f"element_at(array({', '.join(f'{26**i}L' for i in range(14))}), CAST({k} AS int) + 1)"
    number = lambda part: f"aggregate(filter(split({part}, ''), ch -> ch <> ''), 0L, (acc, ch) -> acc * 26 + ascii(ch) - 65)"
    letters = lambda v, k: f"if({k} = 0, '', array_join(transform(sequence(CAST({k} AS int) - 1, 0), i -> chr(65 + ({v} div {size('i')}) % 26)), ''))"
    mixed = _mix(key, kind, number(f"substring({s}, 1, CAST({half} AS int))"), number(f"substring({s}, CAST({half} AS int) + 1, CAST({n} - {half} AS int))"), size(half), size(f"({n} - {half})"))
    return _let(mixed, "mix", f"concat({letters('mix.x', half)}, {letters('mix.y', f'({n} - {half})')}, substring({s}, 27))")


def _luhn(d: str) -> str:
    """Luhn sum of a digit string whose last digit is the check digit."""
    step = f"(acc + if((length({d}) - i) % 2 = 0, q, if(q > 4, 2 * q - 9, 2 * q)))".replace("q", f"CAST(substring({d}, i, 1) AS int)")
    return f"aggregate(sequence(1, length({d})), 0, (acc, i) -> {step})"


def _refill(m: str, d: str, kind: str = "[0-9]") -> str:
    """``m`` with its digits replaced in order by those of ``d``."""
    body = f"if(ch RLIKE '{kind}', struct(concat(acc.s, substring({d}, acc.k, 1)) AS s, acc.k + 1 AS k), struct(concat(acc.s, ch) AS s, acc.k AS k))"
    return f"aggregate(split({m}, ''), struct('' AS s, 1 AS k), (acc, ch) -> {body}, acc -> acc.s)"


def _mod97(s: str) -> str:
    """Remainder of a string of digits and capital letters (A = 10)."""
    number = f"regexp_replace({s}, ' ', '')"
    value = "if(ch RLIKE '[0-9]', (acc * 10 + CAST(ch AS int)) % 97, (acc * 100 + ascii(ch) - 55) % 97)"
    return f"aggregate(filter(split({number}, ''), ch -> ch <> ''), 0, (acc, ch) -> {value.replace('CAST(ch AS int)', 'try_cast(ch AS int)')})"


def _replacement(key: str, m: str = "m") -> str:
    """SQL of the pseudonym of one match."""
    digest = lambda x: f"left(sha2(concat({key}, ':', {x}), 256), 32)"
    is_kind = lambda k: f"{m} RLIKE {_lit('^(?:' + PATTERNS[k] + ')$')}"
    luhn_tail = lambda body: f"concat({body}, CAST((10 - {_luhn(f'''concat({body}, '0')''')} % 10) % 10 AS string))"
    card = _let(_digits(m), "d", f"if({_luhn('d')} % 10 = 0, " + _let(_let("substring(d, 2, length(d) - 2)", "inner", f"concat(substring(d, 1, 1), {_permuted_digits(key, 'card', 'inner')})"), "body", _let(luhn_tail("body"), "full", _refill(m, "full"))) + f", {m})")
    account = f"substring({m}, 5)"
    check = f"lpad(CAST(98 - {_mod97('''concat(acct, substring(''' + m + ''', 1, 2), '00')''')} AS string), 2, '0')"
    given_digits = _let(_digits(account), "d", f"if(length(d) < 2, d, {_permuted_digits(key, 'iban', 'd')})")
    given_letters = _let(f"regexp_replace({account}, '[^A-Z]', '')", "s", f"if(length(s) = 0, s, {_permuted_letters(key, 'iban', 's')})")
    filled = _let(given_digits, "ds", _let(given_letters, "ls", _refill(_refill(account, "ds"), "ls", "[A-Z]")))
    iban = f"if({_mod97(f'concat(substring({m}, 5), substring({m}, 1, 4))')} = 1, " + _let(filled, "acct", f"concat(substring({m}, 1, 2), {check}, acct)") + f", {m})"
    area, group, serial = (f"CAST(substring({m}, {a}, {n}) AS bigint)" for a, n in ((1, 3), (5, 2), (8, 4)))
    # Areas 001-665 and 667-899, groups 01-99, serials 0001-9999.
    ssn = f"if({area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0, " + _let(_mix(key, "ssn", f"({area} - if({area} > 666, 2, 1))", f"(({group} - 1) * 9999 + {serial} - 1)", "898", "989901"), "mix", "format_string('%03d-%02d-%04d', mix.x + if(mix.x >= 665, 2, 1), (mix.y div 9999) + 1, mix.y % 9999 + 1)") + f", {m})"
    ten = f"right({_digits(m)}, 10)"
    phone = _let(ten, "d", _let(_mix(key, "phone", "substring(d, 1, 3)", "substring(d, 4)", "1000", "10000000"), "mix", _let(f"concat(left({_digits(m)}, length({_digits(m)}) - 10), format_string('%03d%07d', mix.x, mix.y))", "full", _refill(m, "full"))))
    octet = lambda k: f"CAST(element_at(o, {k}) AS bigint)"
    ipv4 = _let(f"split({m}, '[.]')", "o", f"if(forall(o, q -> CAST(q AS int) <= 255), {_let(_mix(key, 'ipv4', f'({octet(1)} * 256 + {octet(2)})', f'({octet(3)} * 256 + {octet(4)})', '65536', '65536'), 'mix', 'concat_ws(chr(46), CAST(mix.x div 256 AS string), CAST(mix.x % 256 AS string), CAST(mix.y div 256 AS string), CAST(mix.y % 256 AS string))')}, {m})")
    form = f"CASE WHEN {m} RLIKE '^[0-9]{{4}}-' THEN 'yyyy-MM-dd' WHEN {m} RLIKE '/' THEN 'MM/dd/yyyy' ELSE 'dd.MM.yyyy' END"
    # Every form is first put as yyyy-mm-dd; try_cast rejects days that do not exist.
    iso = f"CASE WHEN {m} RLIKE '^[0-9]{{4}}-' THEN {m} WHEN {m} RLIKE '/' THEN concat_ws('-', substring({m}, 7, 4), substring({m}, 1, 2), substring({m}, 4, 2)) ELSE concat_ws('-', substring({m}, 7, 4), substring({m}, 4, 2), substring({m}, 1, 2)) END"
    number = "CAST(datediff(day, DATE'1900-01-01') AS bigint)"
    date = _let(f"try_cast({iso} AS date)", "day", f"if(day IS NULL, {m}, " + _let(_mix(key, "date", f"{number} div {_DAYS[1]}", f"{number} % {_DAYS[1]}", str(_DAYS[0]), str(_DAYS[1])), "mix", f"date_format(date_add(DATE'1900-01-01', CAST(mix.x * {_DAYS[1]} + mix.y AS int)), {form})") + ")")
    email = f"concat('user-', {digest(f'lower({m})')}, '@example.invalid')"
    head = f"regexp_extract({m}, {_lit(r'^[A-Za-z_]+ ?[=:] ?' + chr(34) + '?')}, 0)"
    secret = f"concat({head}, 'redacted-', {digest(f'substring({m}, length({head}) + 1)')})"
    half = lambda at: f"CAST(conv(substring({m}, {at}, 8), 36, 10) AS bigint)"
    access = _let(_mix(key, "access_key", half(5), half(13), str(36**8), str(36**8)), "mix", f"concat(left({m}, 4), lpad(conv(mix.x, 10, 36), 8, '0'), lpad(conv(mix.y, 10, 36), 8, '0'))")
    cases = [("email", email), ("secret", secret), ("access_key", access), ("iban", iban), ("phone", phone), ("card", card), ("ssn", ssn), ("ipv4", ipv4), ("date", date)]
    return "CASE " + " ".join(f"WHEN {is_kind(k)} THEN {sql}" for k, sql in cases) + f" ELSE {m} END"


def _unused(docs: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def pseudonymise(docs: DataFrame, key: str | Column, *, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the pseudonymised text in place; with ``count_col`` also
    the number of values that changed.  ``key`` may be a column, such as a
    scalar query of a table of secrets."""
    if isinstance(key, str):
        key = docs.sparkSession.sql("SELECT k FROM VALUES (:k) AS t(k)", {"k": key}).scalar()
    text, secret, found, given = F.col(text_col), *(_unused(docs, n) for n in ("_key", "_found", "_given"))
    none = F.array().cast("array<string>")
    matches = F.coalesce(F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))), none)
    staged = docs.withColumns({found: matches, secret: key})
    staged = staged.withColumn(given, F.expr(f"transform({found}, m -> {_replacement(secret)})"))
    joined = F.expr(f"array_join(zip_with(split({text_col}, {_lit(_ANY)}, -1), {given}, (s, g) -> concat(s, coalesce(g, ''))), '')")
    changed = F.expr(f"size(filter(zip_with({found}, {given}, (m, g) -> m <> g), x -> x))")
    whole = F.when(F.size(found) == 0, text).otherwise(joined).alias(text_col)
    out = [whole if c == text_col else F.col(c) for c in docs.columns if c != count_col]
    return staged.select(*out, *([changed.alias(count_col)] if count_col else []))
