"""Format-preserving pseudonyms for personal data, in native expressions.

One regular expression finds candidates, each is validated by its kind, and the valid ones are
replaced by keyed permutations inside their own format: a balanced or mixed-radix Feistel network
whose round function is a keyed SHA-256. Equal values get equal pseudonyms in every document and
different values different ones, so documents stay linked without the values themselves.

Kinds: payment cards (13 to 19 digits with a right check digit, which is computed anew), telephone
numbers (a plus sign and 8 to 15 digits, ten digits in groups of 3, 3 and 4, or ten digits after a word for a telephone), social
security numbers, IPv4 addresses, dates from 0001-01-01 to 9999-12-31, secrets assigned to a name, of any length and case, and e-mail
addresses. Dates of 1900 to 2099 are permuted among themselves, all others among the others. A secret of 16 or more hexadecimal digits
stays hexadecimal; any other one that holds a digit keeps its shape: digits, small and capital letters each stay such, other characters
stay as they are. An e-mail's local part has no fixed format to permute in: it becomes a keyed digest under a reserved domain.

Left alone by rule: numbers that fail their check (a wrong check digit, an octet over 255, 31 February), social security numbers with
area 000 or 666, group 00 or serial 0000, which are never given out, and words after a name of a secret that hold no digit ("token: yes").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Setting of a session that holds the key of the queries, and the key of a session without it.
KEY_SETTING, DEMO_KEY = "spark.brindle.pii.key", "brindle-demo-key"

# The format of each kind. Every pattern starts at a border, so a search is linear in the text.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
IPV4 = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
PHONE = (
    r"(?<![0-9+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|(?<![0-9+])\+[0-9]{8,15}(?![0-9])"
    r"|(?<![0-9+])\+[2-9][0-9]{0,2}(?:[ -][0-9]{2,8}){1,4}(?![0-9]|[ .-][0-9])"
    r"|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
    r"|(?<![0-9A-Za-z+]|[0-9][ .-])[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.| [0-9]{3} )[0-9]{4}(?![0-9A-Za-z]|[ .-][0-9])"
    r"|(?<=(?i:tel|phone|call|cell|mobile|fax)[.:]{0,1} {0,2})[0-9]{10}(?![0-9A-Za-z])"
)
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])"
ISO_DATE = r"(?<![0-9/-])[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}(?![0-9/-])"
DAY_DATE = r"(?<![0-9./])[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?![0-9./]*[0-9])"
CARD = (
    r"(?<![0-9A-Za-z]|[0-9][.,])[0-9]{13,19}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z]|[0-9][.,])[0-9]{4}(?: [0-9]{4} [0-9]{4} |-[0-9]{4}-[0-9]{4}-)[0-9]{4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z]|[0-9][.,])[0-9]{4}(?: [0-9]{6} |-[0-9]{6}-)[0-9]{5}(?![0-9A-Za-z])"
)
#: Names of secrets, with the characters that an assigned value which isn't hexadecimal has at least, one of them a digit.
SECRET_NAMES = ((r"password|passwd|passphrase|pwd", 6), (r"secret|token|credentials?|(?:api|access|private|secret)[_-]?key", 8), (r"key", 16))
_ASSIGNED = r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
_VALUE = r"[A-Za-z0-9_+/.~!@#$%^&*-]"
_NO_DIGIT = r"[A-Za-z_+/.~!@#$%^&*-]"
SECRET = r"(?<![A-Za-z])(?:" + "|".join(
    f"(?i:{names}){_ASSIGNED}(?:[0-9A-Fa-f]{{16,}}+(?![0-9A-Za-z])|(?={_NO_DIGIT}*+[0-9]){_VALUE}{{{least},}}+)" for names, least in SECRET_NAMES
) + ")"
ANY = "|".join((EMAIL, SECRET, IPV4, PHONE, SSN, ISO_DATE, DAY_DATE, CARD))

KINDS = ("email", "secret", "ip", "phone", "ssn", "date", "card")

#: Days before 1900-01-01 and from then to 2099-12-31, and factors of those days and of all others up to 9999-12-31.
DAYS_BEFORE, DAYS_NEAR = 693_595, 73_049
NEAR, FAR = (17, 4_297), (1_258, 2_845)


def _round(kind: str, key: str, other: str) -> str:
    """60 bits of a keyed hash of the round and the other half."""
    return f"CAST(conv(substring(sha2(concat('{key}|{kind}|', tag, '|', r, '|', {other}), 256), 1, 15), 16, 10) AS BIGINT)"


def _feistel(kind: str, key: str, a: str, b: str, size_a: str, size_b: str, tag: str = "''") -> str:
    """SQL of a permutation of pairs (a, b), 0 <= a < size_a, 0 <= b < size_b: a struct (a, b)."""
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', CAST({a} AS BIGINT), 'b', CAST({b} AS BIGINT)), (s, r) -> IF(r % 2 = 1,"
        f" named_struct('a', pmod(s.a + {_round(kind, key, 's.b')} % {size_a}, {size_a}), 'b', s.b),"
        f" named_struct('a', s.a, 'b', pmod(s.b + {_round(kind, key, 's.a')} % {size_b}, {size_b}))))"
    ).replace("tag", tag)


def _digits(kind: str, key: str, digits: str) -> str:
    """SQL that permutes a string of up to 36 decimal digits among those of its length."""
    n, h = f"length({digits})", f"(length({digits}) div 2)"
    # Blocks of up to 18 digits are two halves of up to nine: products stay inside 64 bits.
    walk = _feistel(kind, key, f"CAST(substring({digits}, 1, {h}) AS BIGINT)", f"CAST(substring({digits}, {h} + 1) AS BIGINT)", f"CAST(rpad('1', {h} + 1, '0') AS BIGINT)", f"CAST(rpad('1', {n} - {h} + 1, '0') AS BIGINT)", f"CAST({n} AS STRING)")
    return f"transform(array({walk}), p -> concat(lpad(CAST(p.a AS STRING), {h}, '0'), lpad(CAST(p.b AS STRING), {n} - {h}, '0')))[0]"


def _luhn_sum(digits: str) -> str:
    """SQL of the check sum of digits: every second from the right doubled, its digits added."""
    return (
        f"aggregate(sequence(1, length({digits})), 0, (acc, i) -> acc + CASE WHEN (length({digits}) - i) % 2 = 0 THEN CAST(substring({digits}, i, 1) AS INT)"
        f" WHEN CAST(substring({digits}, i, 1) AS INT) > 4 THEN 2 * CAST(substring({digits}, i, 1) AS INT) - 9 ELSE 2 * CAST(substring({digits}, i, 1) AS INT) END)"
    )


def _refill(shape: str, digits: str) -> str:
    """SQL that puts digits, in order, in the place of the digits of a shape."""
    return (
        f"aggregate(split({shape}, ''), named_struct('t', '', 'k', 1), (o, c) -> IF(c RLIKE '^[0-9]$',"
        f" named_struct('t', concat(o.t, substring({digits}, o.k, 1)), 'k', o.k + 1), named_struct('t', concat(o.t, c), 'k', o.k)), o -> o.t)"
    )


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _plain(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def _card(key: str) -> str:
    """Permutes all digits but the last, which becomes the right check digit."""
    body = _digits("card", key, "substring(d, 1, length(d) - 1)")
    check = "concat(q, CAST(pmod(10 - " + _luhn_sum("concat(q, '0')") + ", 10) AS STRING))"
    return _let(_plain("m"), "d", f"IF({_luhn_sum('d')} % 10 = 0 AND d RLIKE '[1-9]', {_let(body, 'q', _let(check, 'e', _refill('m', 'e')))}, NULL)")


def _phone(key: str) -> str:
    """Keeps the country code with its plus sign where a separator ends it, else the first digit."""
    head = r"regexp_extract(m, r'^\+[0-9]{1,3}(?=[ .(-])|^\+[0-9]', 0)"  # empty without a plus sign
    body = _let("substring(m, length(h) + 1)", "x", _let(_digits("phone", key, _plain("x")), "q", f"concat(h, {_refill('x', 'q')})"))
    return f"IF(length({_plain('m')}) BETWEEN 8 AND 15, {_let(head, 'h', body)}, NULL)"


def _ip(key: str) -> str:
    part = "split(m, '[.]')"
    walk = _feistel("ip", key, "CAST(o[0] AS BIGINT) * 256 + CAST(o[1] AS BIGINT)", "CAST(o[2] AS BIGINT) * 256 + CAST(o[3] AS BIGINT)", "65536", "65536")
    text = "concat_ws('.', p.a div 256, p.a % 256, p.b div 256, p.b % 256)"
    return _let(part, "o", f"IF(forall(o, x -> CAST(x AS INT) < 256 AND NOT x RLIKE '^0[0-9]'), {_let(walk, 'p', text)}, NULL)")


def _ssn(key: str) -> str:
    """Areas 001 to 999 but 666, groups from 01, serials from 0001: 998 * 99 * 9999 numbers."""
    area, group, serial = "CAST(o[0] AS BIGINT)", "CAST(o[1] AS BIGINT)", "CAST(o[2] AS BIGINT)"
    walk = _feistel("ssn", key, f"({area} - IF({area} > 666, 2, 1)) * 99 + {group} - 1", f"{serial} - 1", "98802", "9999")
    back = "concat(lpad(CAST(p.a div 99 + IF(p.a div 99 + 1 >= 666, 2, 1) AS STRING), 3, '0'), '-', lpad(CAST(p.a % 99 + 1 AS STRING), 2, '0'), '-', lpad(CAST(p.b + 1 AS STRING), 4, '0'))"
    return _let("split(m, '-')", "o", f"IF({area} > 0 AND {area} <> 666 AND {group} > 0 AND {serial} > 0, {_let(walk, 'p', back)}, NULL)")


def _date(key: str) -> str:
    """Year first, or day first unless only month first is a date; written back in the order it was read."""
    d = _plain("m")
    tries = (
        f"coalesce(IF(m RLIKE '^[0-9]{{4}}', named_struct('d', try_to_date({d}, 'yyyyMMdd'), 'f', concat('yyyy', substring(m, 5, 1), 'MM', substring(m, 8, 1), 'dd')), NULL),"
        f" IF(m RLIKE '^[0-9]{{4}}' OR try_to_date({d}, 'ddMMyyyy') IS NULL, NULL, named_struct('d', try_to_date({d}, 'ddMMyyyy'), 'f', concat('dd', substring(m, 3, 1), 'MM', substring(m, 6, 1), 'yyyy'))),"
        f" IF(m RLIKE '^[0-9]{{4}}', NULL, named_struct('d', try_to_date({d}, 'MMddyyyy'), 'f', concat('MM', substring(m, 3, 1), 'dd', substring(m, 6, 1), 'yyyy'))))"
    )
    near = f"(n BETWEEN {DAYS_BEFORE} AND {DAYS_BEFORE + DAYS_NEAR - 1})"
    place = f"(n - IF({near}, {DAYS_BEFORE}, IF(n < {DAYS_BEFORE}, 0, {DAYS_NEAR})))"
    size_a, size_b = (f"IF({near}, {x}, {y})" for x, y in zip(NEAR, FAR, strict=True))
    walk = _feistel("date", key, f"{place} div {size_b}", f"{place} % {size_b}", size_a, size_b, tag=f"IF({near}, 'near', 'far')")
    back = f"IF({near}, k + {DAYS_BEFORE}, IF(k < {DAYS_BEFORE}, k, k + {DAYS_NEAR}))"
    text = f"date_format(date_add(DATE'0001-01-01', CAST({back} AS INT)), t.f)"
    new = _let(walk, "p", _let(f"p.a * {size_b} + p.b", "k", text))
    return _let(tries, "t", _let("datediff(t.d, DATE'0001-01-01')", "n", f"IF(n BETWEEN 0 AND {FAR[0] * FAR[1] + DAYS_NEAR - 1}, {new}, NULL)"))


def _secret(key: str) -> str:
    """Permutes the characters of a value in two halves; each round adds a keyed stream to one, character by character.

    Hexadecimal digits (h) are permuted as lower-case ones and written in the case read: upper-case where all letters are, else each
    place in its own case, which in a mixed value also enters the hash so that values differing in case only stay different. In any
    other value each character is moved within its own class, and the classes of all places enter the hash. Punctuation at the end is
    no part of a value. Work is in proportion to the length.
    """
    moved = lambda alphabet: f"substring('{alphabet}', 1 + (instr('{alphabet}', x) - 1 + CAST(conv(y, 16, 10) AS INT)) % {len(alphabet)}, 1)"
    digits, small = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    added = (
        f"CASE WHEN h THEN {moved('0123456789abcdef')} WHEN x BETWEEN '0' AND '9' THEN {moved(digits)} WHEN x BETWEEN 'a' AND 'z' THEN {moved(small)}"
        f" WHEN x BETWEEN 'A' AND 'Z' THEN {moved(small.upper())} ELSE x END"
    )
    seed = f"sha2(concat('{key}|secret|', length(v), c, '|', r, '|', GIVES), 512)"
    stream = f"regexp_extract_all(array_join(transform(sequence(0, length(GETS) div 64), b -> sha2(concat(e, '|', b), 512)), ''), '..', 0)"
    add = f"array_join(zip_with(split(GETS, ''), slice(f, 1, length(GETS)), (x, y) -> {added}), '')"
    step = lambda gets, gives: _let(seed.replace("GIVES", gives), "e", _let(stream.replace("GETS", gets), "f", add.replace("GETS", gets)))
    walk = (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', substring(v, 1, length(v) div 2), 'b', substring(v, length(v) div 2 + 1)), (s, r) -> IF(r % 2 = 1,"
        f" named_struct('a', {step('s.a', 's.b')}, 'b', s.b), named_struct('a', s.a, 'b', {step('s.b', 's.a')})), s -> concat(s.a, s.b))"
    )
    value = r"regexp_replace(regexp_extract(m, '^[^=:]*[=:]\\s*[\'\"]?(.*)$', 1), '[^0-9A-Za-z]+$', '')"
    classes = "concat('|', regexp_replace(regexp_replace(regexp_replace(w, '[a-z]', 'a'), '[A-Z]', 'A'), '[0-9]', '9'))"
    places = f"CASE WHEN NOT h THEN {classes} WHEN w IN (lower(w), upper(w)) THEN '' ELSE concat('|', regexp_replace(regexp_replace(w, '[A-F]', '^'), '[^^]', '.')) END"
    cased = "array_join(zip_with(split(x, ''), split(substring(c, 2), ''), (a, b) -> IF(b = '^', upper(a), a)), '')"
    written = f"CASE WHEN NOT h OR w = lower(w) THEN x WHEN w = upper(w) THEN upper(x) ELSE {cased} END"
    new = _let("w RLIKE '^[0-9A-Fa-f]{16,}$'", "h", _let("IF(h, lower(w), w)", "v", _let(places, "c", _let(walk, "x", written))))
    at = "locate(w, m, instr(translate(m, ':', '='), '='))"
    return _let(value, "w", _let(at, "i", f"concat(substring(m, 1, i - 1), {new}, substring(m, i + length(w)))"))


def _email(key: str) -> str:
    return f"concat('u', substring(sha2(concat('{key}|email|', lower(m)), 256), 1, 20), '@example.invalid')"


def _pseudonym(key: str) -> str:
    """SQL: a match m to a struct (kind, text), text null if m fails its check."""
    kinds = (
        ("secret", "m RLIKE '[=:]'", _secret(key)),
        ("email", "m LIKE '%@%'", _email(key)),
        ("phone", r"m LIKE '+%' OR m LIKE '(%' OR m RLIKE r'^(?:[0-9]{10}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})$'", _phone(key)),
        ("ip", r"m RLIKE r'^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$'", _ip(key)),
        ("ssn", "m RLIKE '^[0-9]{3}-[0-9]{2}-[0-9]{4}$'", _ssn(key)),
        ("date", "m RLIKE '[./]' OR m RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'", _date(key)),
    )
    cases = " ".join(f"WHEN {test} THEN named_struct('kind', '{kind}', 'text', {sql})" for kind, test, sql in kinds)
    return f"CASE {cases} ELSE named_struct('kind', 'card', 'text', {_card(key)}) END"


_P = "__p_"


def _replaced(docs: DataFrame, key: str) -> DataFrame:
    if not key or "'" in key or "\\" in key:
        raise ValueError("a key is a non-empty string without quotes and backslashes")
    # Most texts hold no digit and no at sign; they skip the long pattern.
    some = F.col("text").rlike("[0-9@]|(?i:key|token|secret|credential|pass|pwd)")
    df = docs.withColumn(f"{_P}found", F.when(some, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    df = df.withColumn(f"{_P}found", F.when(F.size(f"{_P}found") > 0, F.col(f"{_P}found")))
    df = df.withColumn(f"{_P}new", F.expr(f"transform({_P}found, m -> {_pseudonym(key)})"))
    rebuilt = F.expr(
        f"array_join(zip_with(zip_with({_P}found, {_P}new, (m, p) -> coalesce(p.text, m)), split(text, {_sql_string(ANY)}), (m, gap) -> concat(gap, coalesce(m, ''))), '')"
    )
    return df.withColumn(f"{_P}text", F.when(F.col(f"{_P}found").isNull(), F.col("text")).otherwise(rebuilt))


def _sql_string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def session_key(spark: SparkSession) -> str:
    """The key that the session names; the demonstration's key where it names none."""
    return spark.conf.get(KEY_SETTING, DEMO_KEY)


def pseudonymize(docs: DataFrame, *, key: str) -> DataFrame:
    """Out: doc_id, text with pseudonyms, n_found (replaced values), and n_<kind> for each kind.

    A null text stays null, an empty one empty; texts without a valid value come back byte for byte.
    Rows are independent, so repeated rows get equal results. Other columns are not looked at.
    """
    df = _replaced(docs.select("doc_id", "text"), key)
    count = lambda kind: F.expr(f"coalesce(size(filter({_P}new, p -> p.text IS NOT NULL AND ({kind}))), 0)").cast("long")
    df = df.withColumn("n_found", count("true"))
    for kind in KINDS:
        df = df.withColumn(f"n_{kind}", count(f"p.kind = '{kind}'"))
    return df.select("doc_id", F.col(f"{_P}text").alias("text"), "n_found", *(f"n_{k}" for k in KINDS))


def replace_texts(docs: DataFrame, *, key: str) -> DataFrame:
    """`docs` with pseudonyms in `text` and, where a text changed and the column is there, its new `n_chars`."""
    df = _replaced(docs, key)
    new: dict[str, Column] = {"text": F.col(f"{_P}text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(f"{_P}text") == F.col("text"), F.col("n_chars")).otherwise(F.length(f"{_P}text").cast(docs.schema["n_chars"].dataType))
        new["n_chars"] = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(new["n_chars"])
    return df.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
