"""Format-preserving Feistel pseudonyms for personal data, with SQL functions only.

Candidates are found by one pattern, validated by kind, and permuted within their format by a keyed Feistel network of
eight rounds (SHA-256 as round function, addition modulo the half's size): card numbers keep a right Luhn digit, IBANs
right check digits, dates stay dates of the years 1600 to 2399, addresses stay addresses. Equal values get equal
pseudonyms in every document, however they are punctuated. What isn't valid (a long number without the Luhn digit, a
31st of June, a phone of one repeated digit) stays as it is. Each row is worked on alone, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8
KINDS = ("email", "ip", "iban", "ssn", "date", "phone", "card")
#: Phones in groups of 3, 3 and 4 digits, with or without a country code.
AMERICAN = "(?:[+][0-9]{1,3}[ .-]?)?(?:[(]?[0-9]{3}[)]?[ .-]{1,2}|[(][0-9]{3}[)])[0-9]{3}[ .-][0-9]{4}"
#: Country codes of one and two digits; all others have three.
COUNTRY = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Alternatives are tried in this order at each place; quantifiers are bounded or possessive, so scanning is linear.
PATTERN = "|".join((
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}",
    r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<![0-9])[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}(?![0-9])",
    r"(?<![0-9])[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4}(?![0-9])",
    rf"(?<![0-9+]){AMERICAN}(?![0-9])",
    r"(?<![0-9+])\+[0-9]{8,15}(?![0-9])",
    r"(?<![0-9+])\+[0-9](?:[ .-]?[0-9]){7,14}(?![0-9])",
    r"(?<![0-9+])\+[0-9]{1,3}[ .-]?[(][0-9]{1,4}[)][ .-]?[0-9](?:[ .-]?[0-9]){5,9}(?![0-9])",
    r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
))
#: 800 years of days, 1600-01-01 to 2399-12-31: 378 * 773.
DAY_HALVES = (378, 773)


def sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """Bind a value to a name, so that it is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def feistel(a: str, b: str, size_a: str, size_b: str, key: str, tweak: str) -> str:
    """A keyed permutation of the pairs 0 <= a < size_a, 0 <= b < size_b, as a struct (a, b)."""
    f = lambda x: f"cast(conv(substr(sha2(concat({sql_text(key)}, {sql_text(f'|{tweak}|')}, i, '|', {x}), 256), 1, 15), 16, 10) as bigint)"
    left = f"named_struct('a', pmod(s.a + pmod({f('s.b')}, {size_a}), {size_a}), 'b', s.b)"
    right = f"named_struct('a', s.a, 'b', pmod(s.b + pmod({f('s.a')}, {size_b}), {size_b}))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, i) -> if(i % 2 = 0, {left}, {right}))"


def permuted_digits(d: str, key: str, tweak: str) -> str:
    """Permutes the strings of as many digits (2 to 34) as the value of d has."""
    half, rest = "(length(d) div 2)", "(length(d) - length(d) div 2)"
    power = lambda n: f"cast(rpad('1', {n} + 1, '0') as bigint)"
    pair = feistel(f"substr(d, 1, {half})", f"substr(d, {half} + 1)", power(half), power(rest), key, tweak)
    return let(d, "d", let(pair, "p", f"concat(lpad(p.a, {half}, '0'), lpad(p.b, {rest}, '0'))"))


def laid_out(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order by ``digits``."""
    step = "if(c rlike '^[0-9]$', named_struct('o', concat(r.o, substr(g, r.k, 1)), 'k', r.k + 1), named_struct('o', concat(r.o, c), 'k', r.k))"
    return let(digits, "g", f"aggregate(split({form}, ''), named_struct('o', '', 'k', 1), (r, c) -> {step}).o")


def only_digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def permuted_name(address: str, key: str) -> str:
    """The name before the sign of an address, permuted among the names of its shape and mail domain (128 characters at most).

    Letters move within their case, digits among digits. A name of one character has no two halves: it takes the place
    of its character in a keyed order of all characters of its kind.
    """
    shift = "cast(conv(substr(h, 2 * (j % 32) + 1, 2), 16, 10) as int)"
    turn = lambda first, last, size: f"chr(ascii('{first}') + pmod(ascii(c) - ascii('{first}') + {shift}, {size}))"
    moved = f"case when c rlike '^[a-z]$' then {turn('a', 'z', 26)} when c rlike '^[A-Z]$' then {turn('A', 'Z', 26)} when c rlike '^[0-9]$' then {turn('0', '9', 10)} else c end"
    tweak = f"concat({sql_text(key)}, '|email|', lower(w), '|'"
    added = lambda x, y: let(f"sha2({tweak}, i, '|', {y}), 256)", "h", f"array_join(transform(split({x}, ''), (c, j) -> {moved}), '')")
    start = "named_struct('a', substr(n, 1, length(n) div 2), 'b', substr(n, length(n) div 2 + 1))"
    rounds = f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, i) -> if(i % 2 = 0, named_struct('a', {added('s.a', 's.b')}, 'b', s.b), named_struct('a', s.a, 'b', {added('s.b', 's.a')})))"
    kinds = {"a-z": "abcdefghijklmnopqrstuvwxyz", "A-Z": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0-9": "0123456789"}
    order = f"array_sort(transform(split(k, ''), c -> named_struct('h', sha2({tweak}, 'one|', c), 256), 'c', c)))"
    placed = let(f"case {' '.join(f"when n rlike '^[{r}]$' then '{k}'" for r, k in kinds.items())} end", "k",
        f"if(k is null, n, element_at({order}, locate(n, k)).c)")
    name = f"if(length(n) = 1, {placed}, {let(rounds, 'p', 'concat(p.a, p.b)')})"
    return let(f"substring_index({address}, '@', -1)", "w", let(f"substring_index({address}, '@', 1)", "n", name))


def _date(key: str) -> str:
    """Year first, or year last: then month, day if that is a date and the sign isn't a dot, else day, month."""
    p = "split(m, '[-/.]')"
    day = lambda y, mo, d: f"try_cast(concat({p}[{y}], '-', lpad({p}[{mo}], 2, '0'), '-', lpad({p}[{d}], 2, '0')) as date)"
    first, us, eu = day(0, 1, 2), day(2, 0, 1), day(2, 1, 0)
    order = f"case when m rlike '^[0-9]{{4}}' then 'ymd' when m not like '%.%' and {us} is not null then 'mdy' else 'dmy' end"
    value = f"case o when 'ymd' then {first} when 'mdy' then {us} else {eu} end"
    number = "datediff(v, date'1600-01-01')"
    new = f"date_add(date'1600-01-01', cast(q.a * {DAY_HALVES[1]} + q.b as int))"
    pair = feistel(f"{number} div {DAY_HALVES[1]}", f"{number} % {DAY_HALVES[1]}", str(DAY_HALVES[0]), str(DAY_HALVES[1]), key, "date")
    sign = "regexp_extract(m, '[-/.]', 0)"
    part = lambda f: f"if(m rlike '(^|[-/.])[0-9]([-/.]|$)', cast({f}(w) as string), lpad({f}(w), 2, '0'))"
    written = f"case o when 'ymd' then concat_ws({sign}, lpad(year(w), 4, '0'), {part('month')}, {part('day')}) when 'mdy' then concat_ws({sign}, {part('month')}, {part('day')}, lpad(year(w), 4, '0')) else concat_ws({sign}, {part('day')}, {part('month')}, lpad(year(w), 4, '0')) end"
    inside = f"v >= date'1600-01-01' and v <= date'2399-12-31'"
    return let(order, "o", let(value, "v", f"case when {inside} then {let(pair, 'q', let(new, 'w', written))} end"))


def pseudonym(key: str) -> str:
    """For a match m: a struct (kind, value) with the pseudonym, or nulls where the match isn't valid."""
    octets = "transform(split(m, '[.]'), z -> cast(z as int))"
    ip_pair = feistel("x[0] * 256 + x[1]", "x[2] * 256 + x[3]", "65536", "65536", key, "ip")
    ip = let(octets, "x", f"case when array_max(x) <= 255 then {let(ip_pair, 'q', "concat_ws('.', q.a div 256, q.a % 256, q.b div 256, q.b % 256)")} end")
    remainder = lambda s: f"aggregate(split({s}, ''), 0, (r, c) -> if(c rlike '^[0-9]$', (r * 10 + cast(ascii(c) - 48 as int)) % 97, (r * 100 + ascii(c) - 55) % 97))"
    body = laid_out("substr(x, 5)", permuted_digits(only_digits("substr(x, 5)"), key, "iban"))
    iban_new = let(body, "y", f"concat(substr(x, 1, 2), lpad(98 - {remainder("concat(y, substr(x, 1, 2), '00')")}, 2, '0'), y)")
    spaced = f"aggregate(split(m, ''), named_struct('o', '', 'k', 1), (r, c) -> if(c = ' ', named_struct('o', concat(r.o, c), 'k', r.k), named_struct('o', concat(r.o, substr(t, r.k, 1)), 'k', r.k + 1))).o"
    iban = let("replace(m, ' ', '')", "x", f"case when length(x) between 15 and 34 and length({only_digits('substr(x, 5)')}) >= 2 and {remainder('concat(substr(x, 5), substr(x, 1, 4))')} = 1 then {let(iban_new, 't', spaced)} end")
    ssn_pair = feistel("(x[0] - 1 - if(x[0] > 666, 1, 0)) * 99 + x[1] - 1", "x[2] - 1", str(898 * 99), "9999", key, "ssn")
    area = "q.a div 99 + 1 + if(q.a div 99 + 1 >= 666, 1, 0)"
    ssn = let("transform(split(m, '-'), z -> cast(z as int))", "x",
        f"case when x[0] between 1 and 899 and x[0] <> 666 and x[1] > 0 and x[2] > 0 then {let(ssn_pair, 'q', f"concat(lpad({area}, 3, '0'), '-', lpad(q.a % 99 + 1, 2, '0'), '-', lpad(q.b + 1, 4, '0'))")} end")
    digits = only_digits("m")
    country = f"if(m rlike '^{AMERICAN}$', length(x) - 10, length(regexp_extract(x, '{COUNTRY}', 0)))"
    phone_new = f"concat(substr(x, 1, z), {permuted_digits('substr(x, z + 1)', key, 'phone')})"
    dialled = f"length(x) between 7 and 15 and replace(substr(x, z + 1), substr(x, -1), '') <> ''"
    phone = let(digits, "x", let(country, "z", f"case when {dialled} then {laid_out('m', phone_new)} end"))
    payload = permuted_digits("substr(x, 1, length(x) - 1)", key, "card")
    card_new = let(payload, "y", "concat(y, cast(filter(sequence(0, 9), z -> luhn_check(concat(y, z)))[0] as string))")
    card = let(digits, "x", f"case when luhn_check(x) then {laid_out('m', card_new)} end")
    email = f"concat({permuted_name('m', key)}, '@', substring_index(m, '@', -1))"
    kind = "case when m like '%@%' then 'email' when m rlike '^[0-9]{1,3}([.][0-9]{1,3}){3}$' then 'ip' when m rlike '^[A-Z]' then 'iban' when m rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$' then 'ssn' when m rlike '^([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})$' then 'date' when m like '+%' or m rlike '^AMERICAN$' then 'phone' else 'card' end".replace("AMERICAN", AMERICAN)
    value = f"case kind when 'email' then {email} when 'ip' then {ip} when 'iban' then {iban} when 'ssn' then {ssn} when 'date' then {_date(key)} when 'phone' then {phone} else {card} end"
    return let(kind, "kind", let(value, "value", "named_struct('kind', if(value is null, null, kind), 'value', coalesce(value, m))"))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with its ``text`` column rewritten and a column ``n_<kind>`` for each of KINDS.

    ``key`` is the secret: who has it can undo the pseudonyms. It stands in the SQL plan, and so in what shows plans (the
    UI, event logs), which must be kept as safe as the key. A null text stays null and counts nothing; so do texts
    without candidates. Repeated rows give repeated results; a column n_<kind> that is already there is replaced; other
    columns are kept, whatever they are called.
    """
    if not key:
        raise ValueError("a key is asked for")
    found, new = fresh(docs, "found", "new")
    candidates = F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    named = docs.withColumn(found, candidates).withColumn(new, F.expr(f"transform(`{found}`, m -> {pseudonym(key)})"))
    between = F.split(F.col(text), PATTERN, -1)
    joined = F.array_join(F.zip_with(between, F.col(new), lambda p, n: F.concat(p, F.coalesce(n["value"], F.lit("")))), "")
    counts = {f"n_{k}": F.expr(f"size(filter(`{new}`, n -> n.kind = '{k}'))") for k in KINDS}
    return named.withColumns(counts | {text: F.when(F.size(found) > 0, joined).otherwise(F.col(text))}).drop(found, new)
