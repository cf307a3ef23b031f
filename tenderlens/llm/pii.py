r"""Format-preserving pseudonyms for personal data, as SQL expressions alone.

One pattern finds candidates; each is validated (Luhn for cards, mod 97 for IBANs, check letters for DNI and NIE, calendar for
dates, octets for IP addresses, issued ranges for social security numbers) and then permuted under a key within its own format, by a Feistel
network: the value is cut in two halves, and in each round one half is shifted by a keyed hash of the other. That is a
bijection, so equal values get equal pseudonyms in all documents and different values different ones, and a digit
stays a digit, a letter a letter of its case; separators stay where they are.

| kind | permuted | kept |
|---|---|---|
| email | letters and digits up to the last label, whatever their case | last label, punctuation, case |
| card | all digits but first and last | first digit; the last is the new check digit |
| iban | the account part | country; the check digits are new |
| phone | digits after the country code | country code, punctuation |
| dni, nie | digits | first letter; the last is the new check letter |
| ssn, secret (32 to 64 hex digits) | all | punctuation |
| token (access keys with a known prefix), JWT, PEM private key | letters and digits | prefix or frame, punctuation |
| ip | the address as a 32-bit number | dots |
| ip6 | hex digits | colons; notations of one address are not linked |
| date | the day within its century | century, order, separators, whether parts are padded |

A slash date is read day first if that is a date, else month first; only there can two notations meet in one pseudonym.
Numbers that fail validation are left as they are, and so are four numbers after a word such as "version". Dates with the
month in words are not looked for. The key reaches the rows as a one-row subquery, so no plan and no event log holds it. Work is narrow: a row's text and its own matches, nothing else.

Defined cases: null texts stay null with n_private 0; texts of any length are read whole; repeated rows and extra columns
stay; empty tables stay empty.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenderlens.llm.common import free_name

ROUNDS = 8

# Notations of personal data.
_NOT_BEFORE, _NOT_AFTER = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
_EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
#: Countries by the length of their IBANs.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban() -> str:
    """An IBAN of its country's own length, else a candidate of any length that ends before a listed country's next one."""
    own = "|".join(f"(?:{'|'.join(names.split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
                   for n, names in sorted(_IBAN_LENGTHS.items(), reverse=True))
    listed = "|".join(sorted(set(" ".join(_IBAN_LENGTHS.values()).split())))
    group = f"(?! (?:{listed})[0-9]{{2}} ?[A-Z0-9]{{4}}) ?[A-Z0-9]"
    other = f"[A-Z]{{2}}[0-9]{{2}}(?:{group}{{4}}){{2,7}}(?:{group}{{1,3}})?"
    return f"{_NOT_BEFORE}(?=[A-Z]{{2}}[0-9]{{2}})(?:(?:{own}){_NOT_AFTER}|{other}{_NOT_AFTER})"


_IBAN = _iban()
_SSN = _NOT_BEFORE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _NOT_AFTER
_IP = r"(?<![A-Za-z0-9.])(?<![Vv]ersion )(?<![Rr]elease )(?<![Bb]uild )(?<![Vv]er )(?<![Vv]er\. )(?<![Ff]irmware )[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])"
_ISO = _NOT_BEFORE + r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}" + _NOT_AFTER
_DMY = _NOT_BEFORE + r"[0-9]{1,2}([./])[0-9]{1,2}\1(?:19|20)[0-9]{2}" + _NOT_AFTER
_SECRET = _NOT_BEFORE + r"(?:[a-f0-9]{32,64}|[A-F0-9]{32,64})" + _NOT_AFTER
_CARD = (_NOT_BEFORE + r"(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})" + _NOT_AFTER)
_PHONE = (r"(?<![A-Za-z0-9+])(?:(?:\+?1[ .\-]?)?\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|(?:\+?1[ .\-])?[0-9]{3}([.\-])[0-9]{3}\3[0-9]{4}"
          r"|\+[0-9]{1,3}[ .\-]?\(?[0-9]{1,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4})" + _NOT_AFTER)
_NATIONAL = (r"(?<![A-Za-z0-9+])(?<![0-9][ .,\-])(?:[67][0-9]{2} [0-9]{3} [0-9]{3}|[67][0-9]{2}-[0-9]{3}-[0-9]{3}|[67][0-9]{2} [0-9]{2} [0-9]{2} [0-9]{2}"
             r"|[89][0-9]{2} [0-9]{3} [0-9]{3}|[89][0-9]{2} [0-9]{2} [0-9]{2} [0-9]{2}|9[0-9] [0-9]{3} [0-9]{2} [0-9]{2}|0[1-9](?: [0-9]{2}){4})"
             r"(?![A-Za-z0-9]|[ .,\-][0-9])")
_DNI = _NOT_BEFORE + r"(?:[XYZ]-?[0-9]{7}|[0-9]{8})-?[A-Z]" + _NOT_AFTER
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_TOKEN_HEAD = r"(?:AKIA|ASIA|AIza|gh[pousr]_|glpat-|xox[abposr]-|[spr]k_(?:live|test)_)"
_TOKEN = (_NOT_BEFORE + r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|AIza[0-9A-Za-z_\-]{35}|gh[pousr]_[A-Za-z0-9]{36,255}|glpat-[A-Za-z0-9_\-]{20,64}"
          r"|xox[abposr]-[A-Za-z0-9\-]{10,250}|[spr]k_(?:live|test)_[A-Za-z0-9]{16,250})" + _NOT_AFTER)
_JWT = _NOT_BEFORE + r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"
_PEM_BEGIN, _PEM_END = "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", "-----END [A-Z ]{0,20}PRIVATE KEY-----"
_PEM = _PEM_BEGIN + r"[A-Za-z0-9+/=\s:,.\-]{32,}?" + _PEM_END
#: All eight groups, or a double colon after a first group that looks like a network's.
_IP6 = (r"(?<![A-Za-z0-9:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
        r"|(?=[A-Fa-f]{0,3}[0-9])[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{1,4}){0,5}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})(?![A-Za-z0-9]|:[0-9A-Fa-f:])")
PATTERN = "|".join((_EMAIL, _PEM, _JWT, _TOKEN, _IBAN, _SSN, _ISO, _DMY, _SECRET, _CARD, _PHONE, _NATIONAL, _DNI, _IP6, _IP))

#: First and last day of each century, and two factors of its number of days.
_CENTURIES = (("19", "1900-01-01", 92, 397), ("20", "2000-01-01", 75, 487))


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """body with name bound to value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def _luhn(digits: str, with_check: bool) -> str:
    """Luhn sum of digits with or without their check digit."""
    weight = "2 - li % 2" if with_check else "1 + li % 2"
    return (f"aggregate(sequence(1, length({digits})), 0L, (lsum, li) -> lsum + "
            + _let("ld", f"cast(substr({digits}, -li, 1) as int) * ({weight})", "ld div 10 + ld % 10") + ")")


def _mod97(text: str) -> str:
    return (f"aggregate(split({text}, ''), 0L, (msum, mc) -> case when mc = '' then msum when mc between '0' and '9' "
            "then (msum * 10 + cast(mc as int)) % 97 else (msum * 100 + ascii(mc) - 55) % 97 end)")


def _date(m: str) -> str:
    """The day that a notation means, or null."""
    parts = f"split({m}, '[-./]')"
    ymd = lambda y, mo, d: f"try_to_date(concat_ws('-', {y}, lpad({mo}, 2, '0'), lpad({d}, 2, '0')), 'yyyy-MM-dd')"
    return _let("dp", parts, f"case when length(dp[0]) = 4 then {ymd('dp[0]', 'dp[1]', 'dp[2]')} else "
                f"coalesce({ymd('dp[2]', 'dp[1]', 'dp[0]')}, {ymd('dp[2]', 'dp[0]', 'dp[1]')}) end")


def _dni_letter(number: str) -> str:
    """The check letter of a DNI's or NIE's other characters."""
    return f"substr('{_DNI_LETTERS}', cast(1 + cast(translate({number}, 'XYZ-', '012') as bigint) % 23 as int), 1)"


def kind_of(m: str) -> str:
    """The kind of a candidate that passes its validation, else ''."""
    d = _digits(m)
    compact = f"replace({m}, ' ', '')"
    iban = _mod97(f"concat(substr({compact}, 5), substr({compact}, 1, 4))")
    return f"""case
        when contains({m}, '@') then 'email'
        when {m} like '-----BEGIN%' then if({m} rlike '[0-9]', 'pem', '')
        when {m} like 'eyJ%.%.%' then if({m} rlike '[0-9]', 'jwt', '')
        when {m} rlike '^{_TOKEN_HEAD}' then if({m} rlike '[0-9]', 'token', '')
        when {m} rlike '^([XYZ]-?[0-9]{{7}}|[0-9]{{8}})-?[A-Z]$' then
             if({_dni_letter(f'left({m}, length({m}) - 1)')} = right({m}, 1), 'dni', '')
        when contains({m}, ':') then if(size(split({m}, ':')) <= 8, 'ip6', '')
        when {m} rlike '^[A-Z]{{2}}[0-9]{{2}}' and {m} rlike '^[A-Z0-9 ]+$' and length({compact}) between 15 and 34
             and {iban} = 1 then 'iban'
        when {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then
             case when {m} rlike '^(000|666|9)' or substr({m}, 5, 2) = '00' or substr({m}, 8) = '0000' then '' else 'ssn' end
        when {m} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then
             if(forall(split({m}, '[.]'), o -> cast(o as int) <= 255), 'ip', '')
        when {m} rlike '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}[./][0-9]{{1,2}}[./][0-9]{{4}})$' then
             if({_date(m)} is null, '', 'date')
        when {m} rlike '^([a-f0-9]+|[A-F0-9]+)$' and length({m}) >= 32 then if({m} rlike '[A-Fa-f]', 'secret', '')
        when {m} rlike '^[0-9][0-9 -]+$' and length({d}) >= 13 then
             if({_luhn(d, True)} % 10 = 0, 'card', '')
        when {m} rlike '[A-Z]' then ''
        when length({d}) between 7 and 15 then 'phone'
        else '' end"""


def _stream(key: str, kind: str, round_: str, other: str) -> str:
    return f"sha2(concat_ws('|', {key}, {kind}, cast({round_} as string), {other}), 512)"


def _number(stream: str) -> str:
    return f"cast(conv(substr({stream}, 1, 12), 16, 10) as bigint)"


def _shift(half: str, stream: str, kind: str) -> str:
    """Each character moved on within its class by four hex digits of the stream."""
    by = f"cast(conv(substr({stream}, 1 + 4 * ((ci - 1) % 32), 4), 16, 10) as int)"
    move = lambda low, size: f"char({low} + (ascii(cc) - {low} + {by}) % {size})"
    char = _let("cc", f"substr({half}, ci, 1)", f"case when cc between '0' and '9' then {move(48, 10)} when {kind} in ('secret', 'ip6') and cc >= 'a' "
                f"then {move(97, 6)} when {kind} = 'secret' then {move(65, 6)} when cc >= 'a' then {move(97, 26)} else {move(65, 26)} end")
    return f"if({half} = '', '', array_join(transform(sequence(1, greatest(1, length({half}))), ci -> {char}), ''))"


def _permuted(symbols: str, key: str, kind: str) -> str:
    """Letters and digits under the Feistel network."""
    step = _let("fk", f"struct(fs.a as a, fs.b as b, {_stream(key, kind, 'fr', 'if(fr % 2 = 0, fs.a, fs.b)')} as k)",
                f"if(fr % 2 = 0, struct(fk.a as a, {_shift('fk.b', 'fk.k', kind)} as b), struct({_shift('fk.a', 'fk.k', kind)} as a, fk.b as b))")
    start = f"struct(left({symbols}, length({symbols}) div 2) as a, substr({symbols}, 1 + length({symbols}) div 2) as b)"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (fs, fr) -> {step}, fs -> concat(fs.a, fs.b))"


def _refill(form: str, symbols: str) -> str:
    """form with its letters and digits replaced, in order; a capital stays one."""
    return (f"aggregate(split({form}, ''), struct('' as o, 0 as i), (rs, rc) -> if(rc rlike '^[A-Za-z0-9]$', "
            f"struct(concat(rs.o, if(rc between 'A' and 'Z', upper(substr({symbols}, rs.i + 1, 1)), substr({symbols}, rs.i + 1, 1))) as o, rs.i + 1 as i), struct(concat(rs.o, rc) as o, rs.i as i)), rs -> rs.o)")


def _ip(m: str, key: str) -> str:
    halves = f"struct(cast(split({m}, '[.]')[0] as bigint) * 256 + cast(split({m}, '[.]')[1] as bigint) as a, " \
             f"cast(split({m}, '[.]')[2] as bigint) * 256 + cast(split({m}, '[.]')[3] as bigint) as b)"
    f = _number(_stream(key, "'ip'", "ir", "cast(s.b as string)"))
    return (f"aggregate(sequence(0, {ROUNDS - 1}), {halves}, (s, ir) -> struct(s.b as a, s.a ^ ({f} & 65535L) as b), "
            "s -> concat_ws('.', cast(s.a div 256 as string), cast(s.a % 256 as string), cast(s.b div 256 as string), cast(s.b % 256 as string)))")


def _new_date(m: str, key: str) -> str:
    """The permuted day of the same century, written as before: padded to two digits unless a part was not."""
    branches = ""
    for century, first, p, q in _CENTURIES:
        day = f"datediff(dd, date'{first}')"
        f = lambda other: _number(_stream(key, f"'date{century}'", "dr", other))
        step = (f"if(dr % 2 = 0, struct(s.a as a, (s.b + {f('cast(s.a as string)')} % {q}) % {q} as b), "
                f"struct((s.a + {f('cast(s.b as string)')} % {p}) % {p} as a, s.b as b))")
        branches += (f" when year(dd) div 100 = {century} then aggregate(sequence(0, {ROUNDS - 1}), struct(cast({day} div {q} as bigint) as a, "
                     f"cast({day} % {q} as bigint) as b), (s, dr) -> {step}, s -> date_add(date'{first}', cast(s.a * {q} + s.b as int)))")
    sep = f"if(contains({m}, '/'), '/', '.')"
    first_is_month = f"cast(substring_index({m}, {sep}, 1) as int) = month(dd) and cast(split({m}, '[./]')[1] as int) > 12"
    short = f"{m} rlike '(^|[./])[0-9][./]'"
    day, month = (f"if({short}, date_format(dn, '{c}'), date_format(dn, '{c}{c}'))" for c in "dM")
    written = _let("dn", f"case{branches} end", f"case when {m} like '____-%' then date_format(dn, 'yyyy-MM-dd') when {first_is_month} "
                   f"then concat_ws({sep}, {month}, {day}, date_format(dn, 'yyyy')) "
                   f"else concat_ws({sep}, {day}, {month}, date_format(dn, 'yyyy')) end")
    return _let("dd", _date(m), written)


def pseudonym(m: str, kind: str, key: str) -> str:
    """SQL for the pseudonym of a validated value; m, kind and key are names or literals."""
    country = f"regexp_extract({m}, '^[+]?(1(?=[ .(-])|(?<=[+])(1|7|[0-9]{{2}}))[ .-]?', 0)"
    parts = f"""case {kind}
        when 'email' then struct('' as head, substring_index({m}, '.', size(split({m}, '[.]')) - 1) as body, concat('.', substring_index({m}, '.', -1)) as tail)
        when 'card' then struct(left({m}, 1) as head, substr({m}, 2, length({m}) - 2) as body, '' as tail)
        when 'iban' then struct(left({m}, 2) as head, substr({m}, 5) as body, '' as tail)
        when 'phone' then struct({country} as head, substr({m}, 1 + length({country})) as body, '' as tail)
        when 'dni' then struct(regexp_extract({m}, '^[XYZ]-?', 0) as head, regexp_extract({m}, '[0-9]+', 0) as body,
             if(substr({m}, -2, 1) = '-', '-', '') as tail)
        when 'token' then struct(regexp_extract({m}, '^{_TOKEN_HEAD}', 0) as head, regexp_replace({m}, '^{_TOKEN_HEAD}', '') as body, '' as tail)
        when 'jwt' then struct('eyJ' as head, substr({m}, 4) as body, '' as tail)
        when 'pem' then struct(regexp_extract({m}, '^{_PEM_BEGIN}', 0) as head,
             regexp_replace({m}, '^{_PEM_BEGIN}|{_PEM_END}$', '') as body, regexp_extract({m}, '{_PEM_END}$', 0) as tail)
        else struct('' as head, {m} as body, '' as tail) end"""
    fresh = _let("pb", _refill("pp.body", "ps"), f"""case {kind}
        when 'card' then concat(pp.head, pb, cast((10 - {_luhn(_digits("concat(pp.head, pb)"), False)} % 10) % 10 as string))
        when 'iban' then concat(pp.head, lpad(cast(98 - {_mod97("concat(replace(pb, ' ', ''), pp.head, '00')")} as string), 2, '0'), pb)
        when 'dni' then concat(pp.head, pb, pp.tail, {_dni_letter("concat(pp.head, pb)")})
        else concat(pp.head, pb, pp.tail) end""")
    symbols = "regexp_replace(pp.body, '[^A-Za-z0-9]', '')"
    symbols = f"if({kind} in ('email', 'ip6'), lower({symbols}), {symbols})"
    by_symbols = _let("pp", parts, _let("pq", symbols, _let("ps", _permuted("pq", key, kind), fresh)))
    return f"case {kind} when '' then {m} when 'ip' then {_ip(m, key)} when 'date' then {_new_date(m, key)} else {by_symbols} end"


def pseudonymize(docs: DataFrame, key: str | DataFrame, text_col: str = "text", count_col: str = "n_private") -> DataFrame:
    """docs with pseudonyms in its texts and the number of values replaced, in count_col (which it replaces if present).

    The key is a text, or a table of one row and column that is read when the job runs.
    """
    if isinstance(key, str):
        key = docs.sparkSession.createDataFrame(pa.table({"key": [key]}))
    secret, hits = (free_name(docs, name) for name in ("_secret", "_found"))
    text, pattern = f"cast(`{text_col}` as string)", _lit(PATTERN)
    each = _let("k", kind_of("m"), f"struct(k as kind, {pseudonym('m', 'k', f'`{secret}`')} as new)")
    found = f"transform(regexp_extract_all({text}, {pattern}, 0), m -> {each})"
    # Most texts hold neither a digit nor an @ and are passed on as they are.
    plain = f"{text} is null or not {text} rlike '[0-9@]'"
    marked = docs.withColumn(secret, key.scalar()).withColumn(hits, F.expr(f"if({plain}, array(), {found})"))
    joined = (f"if(size({hits}) = 0, {text}, array_join(zip_with(split({text}, {pattern}, -1), {hits}, "
              "(piece, f) -> concat(piece, coalesce(f.new, ''))), ''))")
    n = f"cast(size(filter({hits}, f -> f.kind <> '')) as bigint)"
    return marked.withColumns({text_col: F.expr(joined), count_col: F.expr(n)}).drop(hits, secret)
