"""PII: format-preserving Feistel pseudonyms, with DataFrame functions only.

Validated numbers and dates are permuted by a keyed Feistel network within
their format, so a value always gets the same pseudonym and values stay linked
across documents. A value is a pair (A, B) of Z_a x Z_b; rounds add a keyed hash
of one half to the other, modulo its size, which is a permutation for any a, b.

- card: 13 to 19 digits with a valid Luhn digit; the first digit stays, the
  others are permuted, the check digit is worked out anew
- phone: North American numbers with separators; area and exchange keep a first
  digit of 2 to 9, so 555-123-4567, whose exchange begins with 1, is none
- ip: IPv4 with octets up to 255
- ssn: area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999
- date: year-month-day, day/month/year and, where that is no date, month/day/year
  of 1900 to 2099 that exist; one day has one pseudonym in all three layouts
- iban: valid by mod 97; the digits of the account are permuted, the check
  digits are worked out anew
- email: the local part, character by character within letters and digits
- secret: access keys, and values of password=, token= and the like, likewise

What does not validate is left as it is and hides nothing: all kinds but the
card and the IBAN validate in their pattern, so what fails is not matched, and
no other kind fits inside an IBAN's run of letters and digits. Cards are looked
for in what the other kinds leave. There every span of whole groups of digits is
tried: first the usual layouts (one group, 4-4-4-4, 4-4-4-4-3, 4-6-5, 4-6-4),
then, clear of those, the longest valid span from the left. Where a card in an
unusual layout overlaps a value of another kind, the other kind goes first.
Separators and layout stay.

Nulls: a null text stays null with counts of 0. Empty tables give no rows;
repeated rows are treated alike; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import docs_only, table

#: A key for tests and the registered query; production passes its own.
KEY = "not-a-secret"
ROUNDS = 8
KINDS = ("email", "phone", "card", "ip", "ssn", "date", "iban", "secret")
_PHONE = r"(?:\+?1[ .\-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.\-])[2-9][0-9]{2}[ .\-][0-9]{4}"
_DAY = "(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))"
_DAY_FIRST = "(?:(?:0[1-9]|[12][0-9]|3[01])/(?:0[13578]|1[02])|(?:0[1-9]|[12][0-9]|30)/(?:0[469]|11)|(?:0[1-9]|1[0-9]|2[0-8])/02)"
_MONTH_FIRST = "(?:(?:0[13578]|1[02])/(?:1[3-9]|2[0-9]|3[01])|(?:0[469]|11)/(?:1[3-9]|2[0-9]|30)|02/(?:1[3-9]|2[0-8]))"
_LEAP = "(?:19(?:0[48]|[2468][048]|[13579][26])|20(?:[02468][048]|[13579][26]))"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
_NAMES = ("password", "passwd", "secret", "token", "api_key")
_AFTER = "|".join([*[f"{x}=" for x in _NAMES], "password: ", 'token = "', 'token: "', 'secret = "', 'api_key = "'])
_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-]*+\.)+[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?i:(?<=" + _AFTER + r"))(?![0-9]++(?![A-Za-z]))[A-Za-z0-9]{8,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z]{0,4}[0-9]{10,26}(?![A-Za-z0-9])",
    "phone": rf"(?<![0-9A-Za-z]){_PHONE}(?![0-9A-Za-z])",
    "date": rf"(?<![0-9A-Za-z/\-])(?:(?:19|20)[0-9]{{2}}-{_DAY}|{_LEAP}-02-29|(?:{_DAY_FIRST}|{_MONTH_FIRST})/(?:19|20)[0-9]{{2}}|(?:29/02|02/29)/{_LEAP})(?![0-9A-Za-z/\-])",
    "ssn": r"(?<![0-9A-Za-z\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z\-])",
    "ip": rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])",
}
_ANY = "|".join(_PATTERNS.values())
#: Groups of digits in which cards are looked for, and one card in them.
_RUN = r"(?<![0-9A-Za-z])[0-9][0-9 \-]{11,}[0-9](?![0-9A-Za-z])"
_CARD = r"^[0-9](?:[ \-]?[0-9]){12,18}$"
_USUAL = r"^(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{4}([ \-])[0-9]{6}\2[0-9]{4,5})$"
#: No kind is without one of these.
_GATE = f"[0-9@]|AKIA|(?i:{'|'.join(_NAMES)})"


def _text(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(**names: str):
    """SQL of an expression in which names stand for values worked out once."""

    def over(body: str) -> str:
        for k, v in reversed(names.items()):
            body = f"transform(array({v}), {k} -> {body})[0]"
        return body

    return over


def _feistel(kind: str, a: str, b: str, size_a: str, size_b: str, key: str) -> str:
    """SQL of a struct (a, b): the permuted pair."""
    f = lambda half, size: f"cast(conv(substr(sha2(concat_ws('|', {_text(key)}, '{kind}', r, {half}), 256), 1, 15), 16, 10) as bigint) % ({size})"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, r) -> if(r % 2 = 1, "
        f"named_struct('a', (s.a + {f('s.b', size_a)}) % ({size_a}), 'b', s.b), named_struct('a', s.a, 'b', (s.b + {f('s.a', size_b)}) % ({size_b}))))"
    )


def _refill(x: str, digits: str) -> str:
    """SQL of x with its digits replaced in order."""
    return f"aggregate(split({x}, ''), named_struct('o', '', 'k', 1), (s, c) -> if(c between '0' and '9', named_struct('o', concat(s.o, substr({digits}, s.k, 1)), 'k', s.k + 1), named_struct('o', concat(s.o, c), 'k', s.k)), s -> s.o)"


def _luhn(digits: str) -> str:
    """SQL of the Luhn sum of digits before the check digit; the digit next to it counts double."""
    return (
        f"aggregate(sequence(1, length({digits})), cast(0 as bigint), (t, i) -> t + if((length({digits}) - i) % 2 = 0, "
        f"(2 * cast(substr({digits}, i, 1) as int)) div 10 + (2 * cast(substr({digits}, i, 1) as int)) % 10, cast(substr({digits}, i, 1) as int)))"
    )


def _check(digits: str) -> str:
    return f"cast((10 - {_luhn(digits)} % 10) % 10 as string)"


def _shifted(part: str, seed: str) -> str:
    """SQL of a string whose letters and digits are shifted, each within its class, by a hash of seed."""
    k = "cast(conv(substr(h, (i % 31) * 2 + 1, 2), 16, 10) as int)"
    turn = lambda low, n: f"chr({low} + (ascii(c) - {low} + {k} + i) % {n})"
    body = f"array_join(transform(split({part}, ''), (c, i) -> case when c between '0' and '9' then {turn(48, 10)} when c between 'a' and 'z' then {turn(97, 26)} when c between 'A' and 'Z' then {turn(65, 26)} else c end), '')"
    return _let(h=f"sha2({seed}, 256)")(body)


def _string_feistel(kind: str, x: str, key: str) -> str:
    """SQL of a keyed permutation of strings of one layout."""
    step = lambda to, by: f"if(length({to}) = 0, {to}, {_shifted(to, f'''concat_ws('|', {_text(key)}, '{kind}', r, {by})''')})"
    half = f"length({x}) div 2"
    return (
        f"aggregate(sequence(1, 4), named_struct('a', substr({x}, 1, {half}), 'b', substr({x}, {half} + 1)), (s, r) -> "
        f"if(r % 2 = 1, named_struct('a', s.a, 'b', {step('s.b', 's.a')}), named_struct('a', {step('s.a', 's.b')}, 'b', s.b)), s -> concat(s.a, s.b))"
    )


def _mod97(s: str) -> str:
    """SQL of the IBAN remainder of a string of digits and capitals."""
    return f"aggregate(split({s}, ''), cast(0 as bigint), (t, c) -> if(c between '0' and '9', (t * 10 + cast(c as int)) % 97, (t * 100 + ascii(c) - 55) % 97))"


def _branches(x: str, key: str) -> list[tuple[str, str, str]]:
    """(kind, SQL of the condition, SQL of the pseudonym) for a match x."""
    d = f"regexp_replace({x}, '[^0-9]', '')"
    out = []
    out.append(("email", f"contains({x}, '@')", _let(at=f"locate('@', {x})")(f"concat({_string_feistel('email', f'substr({x}, 1, at - 1)', key)}, substr({x}, at))")))
    body, rest = f"substr({x}, 5)", f"substr({x}, 1, 2)"
    digits = f"regexp_replace({body}, '[^0-9]', '')"
    new = _let(q=digits, u="length(q) div 2", p=_feistel("iban", "substr(q, 1, u)", "substr(q, u + 1)", "cast(pow(10, u) as bigint)", "cast(pow(10, length(q) - u) as bigint)", key))(
        _let(z=_refill(body, "concat(lpad(cast(p.a as string), u, '0'), lpad(cast(p.b as string), length(q) - u, '0'))"))(
            f"concat({rest}, lpad(cast(98 - {_mod97(f'''concat(z, {rest}, '00')''')} as string), 2, '0'), z)"
        )
    )
    out.append(("iban", f"{x} rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z]{{0,4}}[0-9]{{10,26}}$' and {_mod97(f'concat(substr({x}, 5), substr({x}, 1, 4))')} = 1", new))
    out.append(("secret", f"{x} rlike '^[A-Za-z0-9]+$' and {x} rlike '[A-Za-z]' and not {x} rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z]{{0,4}}[0-9]{{10,26}}$'", f"if({x} like 'AKIA%', concat('AKIA', {_string_feistel('secret', f'substr({x}, 5)', key)}), {_string_feistel('secret', x, key)})"))
    phone = _let(q=f"right({d}, 10)", k=f"length({d}) - 10")(
        _let(
            p=_feistel(
                "phone", "(cast(substr(q, 1, 3) as int) - 200) * 800 + cast(substr(q, 4, 3) as int) - 200", "substr(q, 7, 4)", "640000", "10000", key
            )
        )(_refill(x, f"concat(substr({d}, 1, k), cast(p.a div 800 + 200 as string), cast(p.a % 800 + 200 as string), lpad(cast(p.b as string), 4, '0'))"))
    )
    out.append(("phone", f"{x} rlike {_text(f'^{_PHONE}$')}", phone))
    iso = f"{x} like '____-__-__'"
    day = f"if({iso}, try_to_date({x}, 'yyyy-MM-dd'), coalesce(try_to_date({x}, 'dd/MM/yyyy'), try_to_date({x}, 'MM/dd/yyyy')))"
    date = _let(q=f"datediff({day}, date'1900-01-01')", p=_feistel("date", "q div 4297", "q % 4297", "17", "4297", key))(
        f"date_format(date_add(date'1900-01-01', cast(p.a * 4297 + p.b as int)), case when {iso} then 'yyyy-MM-dd' when try_to_date({x}, 'dd/MM/yyyy') is not null then 'dd/MM/yyyy' else 'MM/dd/yyyy' end)"
    )
    out.append(("date", f"({iso} or {x} like '__/__/____') and {day} is not null", date))
    ssn = _let(q=f"cast(substr({x}, 1, 3) as int)", p=_feistel("ssn", "if(q > 666, q - 2, q - 1)", f"(cast(substr({x}, 5, 2) as int) - 1) * 9999 + cast(substr({x}, 8, 4) as int) - 1", "898", "989901", key))(
        "concat(lpad(cast(if(p.a >= 665, p.a + 2, p.a + 1) as string), 3, '0'), '-', lpad(cast(p.b div 9999 + 1 as string), 2, '0'), '-', lpad(cast(p.b % 9999 + 1 as string), 4, '0'))"
    )
    out.append(("ssn", f"{x} rlike '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}$'", ssn))
    ip = _let(q=f"transform(split({x}, '[.]'), o -> cast(o as int))", p=_feistel("ip", "q[0] * 256 + q[1]", "q[2] * 256 + q[3]", "65536", "65536", key))(
        "concat_ws('.', cast(p.a div 256 as string), cast(p.a % 256 as string), cast(p.b div 256 as string), cast(p.b % 256 as string))"
    )
    out.append(("ip", f"{x} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' and forall(split({x}, '[.]'), o -> cast(o as int) <= 255)", ip))
    return out


def _card(x: str, key: str) -> str:
    """SQL of the pseudonym of a valid card."""
    d = f"regexp_replace({x}, '[^0-9]', '')"
    return _let(q=d, u="(length(q) - 2) div 2", p=_feistel("card", "substr(q, 2, u)", "substr(q, u + 2, length(q) - 2 - u)", "cast(pow(10, u) as bigint)", "cast(pow(10, length(q) - 2 - u) as bigint)", key))(
        _let(z="concat(substr(q, 1, 1), lpad(cast(p.a as string), u, '0'), lpad(cast(p.b as string), length(q) - 2 - u, '0'))")(_refill(x, f"concat(z, {_check('z')})"))
    )


def _cards_of_run(run: str, key: str) -> str:
    """SQL of a struct (o, n): a run of groups of digits with pseudonyms for its cards, and their number."""
    each, d = "sequence(1, size(gg))", "regexp_replace(sp, '[^0-9]', '')"
    span = lambda k: f"regexp_replace(array_join(slice(gg, ii, {k}), ''), '[ -]+$', '')"
    valid = _let(sp=span("kk"))(f"sp rlike {_text(_CARD)} and {_check(f'substr({d}, 1, length({d}) - 1)')} = right(sp, 1)")
    return _let(
        gg=f"regexp_extract_all({run}, '[0-9]+[ -]*', 0)",
        vv=f"transform({each}, ii -> filter(sequence(1, least(19, size(gg) - ii + 1)), kk -> {valid}))",
        uu=f"transform({each}, ii -> coalesce(array_max(filter(vv[ii - 1], kk -> {span('kk')} rlike {_text(_USUAL)})), 0))",
        ww=f"transform({each}, ii -> if(uu[ii - 1] > 0, uu[ii - 1], coalesce(array_max(filter(vv[ii - 1], kk -> not exists(slice(uu, ii, kk), y -> y > 0))), 0)))",
    )(
        f"aggregate({each}, named_struct('o', '', 'n', 0, 'to', 1), (ss, ii) -> case when ii < ss.to then ss "
        f"when ww[ii - 1] = 0 then named_struct('o', concat(ss.o, gg[ii - 1]), 'n', ss.n, 'to', ii + 1) else "
        + _let(sp=span("ww[ii - 1]"), tail="regexp_extract(gg[ii + ww[ii - 1] - 2], '[ -]*$', 0)")(f"named_struct('o', concat(ss.o, {_card('sp', key)}, tail), 'n', ss.n + 1, 'to', ii + ww[ii - 1])")
        + " end, ss -> named_struct('o', ss.o, 'n', ss.n))"
    )


def _cards(x: str, key: str) -> str:
    """SQL of a struct (o, n): a piece of text with pseudonyms for its cards, and their number."""
    runs = f"regexp_extract_all({x}, {_text(_RUN)}, 0)"
    filled = _let(cc=f"transform({runs}, rr -> {_cards_of_run('rr', key)})")(
        f"named_struct('o', array_join(zip_with(split({x}, {_text(_RUN)}, -1), concat(cc.o, array('')), (a, b) -> concat(a, b)), ''), 'n', aggregate(cc.n, 0, (t, y) -> t + y))"
    )
    return f"if({x} rlike {_text(_RUN)}, {filled}, named_struct('o', {x}, 'n', 0))"


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with pseudonyms, and the count of each kind (n_email and so on)."""
    cases = " ".join(f"when {cond} then named_struct('kind', '{kind}', 'new', {new})" for kind, cond, new in _branches("m", key))
    found = docs_only(docs).withColumn("_m", F.when(F.col("text").rlike(_GATE), F.regexp_extract_all("text", F.lit(_ANY), F.lit(0))))
    found = found.withColumn("_p", F.expr(f"transform(_m, m -> case {cases} else named_struct('kind', '', 'new', m) end)"))
    # what follows a value gets a letter in front, as no card begins there
    rest = f"transform(split(text, {_text(_ANY)}, -1), (v, j) -> if(j = 0, v, concat('x', v)))"
    found = found.withColumn("_c", F.expr(f"if(_m is null, null, transform({rest}, v -> {_cards('v', key)}))"))
    whole = F.expr("array_join(zip_with(transform(_c.o, (v, j) -> if(j = 0, v, substr(v, 2))), concat(_p.new, array('')), (a, b) -> concat(a, b)), '')")
    counts = {k: f"greatest(coalesce(size(filter(_p, p -> p.kind = '{k}')), 0), 0)" for k in KINDS} | {"card": "coalesce(aggregate(_c.n, 0, (t, y) -> t + y), 0)"}
    counts = [F.expr(f"cast({v} as bigint)").alias(f"n_{k}") for k, v in counts.items()]
    changed = F.expr("size(_m) > 0 or exists(_c, c -> c.n > 0)")
    return found.select("doc_id", F.when(changed, whole).otherwise(F.col("text")).alias("text"), *counts)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"))
