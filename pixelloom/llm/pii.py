"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

A value that passes its format's check (a card's or account's check digits, a calendar date in numbers or with its
month's name, address ranges) is numbered within its format, the number permuted by a Feistel network under the key, and
written back in the same format. Equal values get equal pseudonyms in all documents,
different values of a format different ones.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import ipaddress
import math
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pixelloom.llm.common import map_columns

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LATIN_LOWER = "".join(c for c in map(chr, range(0xDF, 0x100)) if c.islower())
LATIN_UPPER = "".join(c for c in map(chr, range(0xC0, 0xDF)) if c.isupper())
ALPHABETS = {c: a for a in (DIGITS, LOWER, UPPER, LATIN_LOWER, LATIN_UPPER) for c in a}
SMALL = 1 << 40  # permutations of fewer values are made free of fixed points


@lru_cache(maxsize=20_000)
def alphabet(c: str) -> str:
    """What a character may turn into: the ten digits of its script, or the letters of its kind among the 256 code points around it.

    Empty for other characters and for letters that are the only ones of their kind there.
    """
    if c in ALPHABETS:
        return ALPHABETS[c]
    kind, first = unicodedata.category(c), ord(c) & ~0xFF
    if kind == "Nd":
        zero = ord(c) - unicodedata.digit(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if kind not in ("Ll", "Lu", "Lo", "Lt", "Lm"):
        return ""
    own = "".join(x for x in map(chr, range(first, first + 256)) if unicodedata.category(x) == kind and x not in ALPHABETS)
    return own if len(own) > 1 else ""


# The months' names in the corpus's four languages, and English abbreviations.
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "short": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
MONTH = "(?:" + "|".join(sorted({m for names in MONTHS.values() for m in names} | {m.capitalize() for x in ("fr", "es") for m in MONTHS[x]}, key=lambda m: (-len(m), m))) + ")"
WITH_NAME = re.compile(rf"(\d{{1,2}})(st|nd|rd|th|er|\.)?( (?:of |de )?)({MONTH})((?: de|,|\.)? )(\d{{4}})|({MONTH})(\.? )(\d{{1,2}})(st|nd|rd|th)?(,? )(\d{{4}})")
LONGEST = 1024  # characters that are permuted at once

PATTERN = re.compile(
    r"(?P<block>-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:(?!-----)[\s\S])+-----END (?:[A-Z]+ )*PRIVATE KEY-----)"
    r"|(?P<jwt>(?<![^\W_])eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})"
    r"|(?P<email>[^\W_](?:[\w.+%-]|'(?=\w)){0,63}@[^\W_][\w-]*(?:\.[\w-]+)*\.[^\W\d_]{2,})"
    r"|(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{6,39}(?![\w:]))"
    + rf"|(?P<named>(?<![\w./-])(?:{WITH_NAME.pattern.replace("(?:", "(").replace("(", "(?:")})(?!\w))"
    + r"|(?P<iban>\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)\b)"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"
    r"|(?<![\w+])(?:\+|00(?=[1-9]))\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,8}){1,6}(?!\w)"
    r"|(?<![\w+.,-])0\d(?:[ .-]\d\d){4}(?![\w.-])"
    r"|(?<![\w+.,-])\(?0\d{2,4}\)?[ /-]\d{3,4}[ -]?\d{3,5}(?![\w.-]))"
    r"|(?P<card>(?<![\w.-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}(?P<space>[ -])\d{6}(?P=space)\d{5})(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}(?=T\d{2}:\d{2})|(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{1,2}/\d{1,2}|\d{4}\.\d{1,2}\.\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\w|[./-]\d)))"
    r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d))"
    r"|(?P<token>(?<![^\W_])(?:A[KS]IA[A-Z2-7]{16}|gh[pousr]_[A-Za-z0-9]{36}|AIza[\w-]{35}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,64}|xox[abprs](?:-[A-Za-z0-9]{8,64}){1,4}|sk-[A-Za-z0-9-]{20,64})(?![\w-]))"
    r"|(?P<assigned>(?<![^\W_])(?i:password|passwd|pwd|passwort|kennwort|contraseña|mot de passe|secret|api[_-]?key|(?:access|auth)[_-]?token)[\"']?[ \t]*[=:][ \t]*[\"']?(?=[^\s\"',;]*\d)[^\s\"',;]{6,128})"
    r"|(?P<secret>(?<![^\W_])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![^\W_]))"
)


def permuted(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..size-1: alternating Feistel rounds on a near-square grid, walking on while outside.

    Below ``SMALL`` values it has no fixed point (where there are two values at least); above, one is out of the question.
    """
    if size < 2:
        return x
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    width = (max(a, b).bit_length() + 71) // 8

    def mixed(value: int, k: int, modulus: int) -> int:
        data = f"{tweak}|{size}|{k}|{value}".encode()
        return int.from_bytes(hashlib.shake_256(key + data).digest(width), "big") % modulus

    def through(x: int) -> int:
        while True:
            left, right = divmod(x, b)
            for k in range(0, ROUNDS, 2):
                left = (left + mixed(right, k, a)) % a
                right = (right + mixed(left, k + 1, b)) % b
            x = left * b + right
            if x < size:
                return x

    def back(x: int) -> int:
        while True:
            left, right = divmod(x, b)
            for k in range(ROUNDS - 2, -1, -2):
                right = (right - mixed(left, k + 1, b)) % b
                left = (left - mixed(right, k, a)) % a
            x = left * b + right
            if x < size:
                return x

    if size > SMALL:
        return through(x)
    # A cyclic shift, seen through the permutation, leaves no value where it is.
    return back((through(x) + 1 + mixed(0, ROUNDS, size - 1)) % size)


def characters(value: str, key: bytes, tweak: str) -> str | None:
    """Permute all letters and digits of ``value`` within their alphabets at once; the rest stay.

    None when there is nothing to permute.
    """
    where = [(i, a) for i, c in enumerate(value) if (a := alphabet(c))]
    if not where:
        return None
    known = (DIGITS, LOWER, UPPER, LATIN_LOWER, LATIN_UPPER)
    shape = "".join("0aA1B"[known.index(a)] if a in known else f"<{ord(a[0]):x}>" for _, a in where)
    x, size = 0, 1
    for i, a in where:
        x, size = x * len(a) + a.index(value[i]), size * len(a)
    x = permuted(x, size, key, f"{tweak}|{shape}")
    out = list(value)
    for i, a in reversed(where):
        x, d = divmod(x, len(a))
        out[i] = a[d]
    made = "".join(out)
    return made if made != value else None


def luhn_digit(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return -total % 10


def into(shape: str, symbols: str) -> str:
    """``symbols`` in the places of the letters and digits of ``shape``."""
    it = iter(symbols)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def card(value: str, key: bytes) -> str | None:
    digits = "".join(str(int(c)) for c in value if c.isdecimal())
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != int(digits[-1]) or set(digits) == {"0"}:
        return None
    made = characters(digits[1:-1], key, "card")
    if made is None:
        return None
    return into(value, in_script(value, digits[0] + made + str(luhn_digit(digits[0] + made))))


def in_script(like: str, digits: str) -> str:
    """ASCII digits written with the digits that ``like`` begins with."""
    first = next((c for c in like if c.isdecimal()), "0")
    zero = ord(first) - int(first)
    return "".join(chr(zero + int(c)) for c in digits)


def iban_number(symbols: str) -> int:
    return int("".join(str(int(c, 36)) for c in symbols))


def iban(value: str, key: bytes) -> str | None:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    account = characters(plain[4:], key, "iban")
    if account is None:
        return None
    check = 98 - iban_number(account + plain[:2] + "00") % 97
    return into(value, f"{plain[:2]}{check:02d}{account}")


def phone(value: str, key: bytes) -> str | None:
    """Numbers of 8 to 15 digits (E.164) or national ones of 9 to 13; a country code and a national zero stay."""
    lead = re.match(r"(?:\+|00)\d{1,3}", value)
    # Country codes have one digit in zones 1 and 7, else two or three; what lies behind the first mark isn't one.
    digits = sum(c.isdecimal() for c in value) - (2 if value[:2] == "00" and lead else 0)
    if not (8 <= digits <= 15 if lead else 9 <= digits <= 13):
        return None
    at = 0
    if lead:
        code = lead[0].lstrip("+")[2 if value[:2] == "00" else 0 :]
        at = lead.end() - (len(code) - 1 if code[0] in "17" else max(0, len(code) - 2) if value[lead.end() : lead.end() + 1].isdecimal() else 0)
    elif re.match(r"\(?0", value):
        at = value.index("0") + 1
    made = characters(value[at:], key, "phone")
    return None if made is None else value[:at] + made


def ssn(value: str, key: bytes) -> str | None:
    def number(s: str) -> int:
        area, group, serial = map(int, s.split("-"))
        return -1 if area in (0, 666) or area > 899 or not group or not serial else (area * 99 + group - 1) * 9999 + serial - 1

    x = number(value)
    if x < 0:
        return None
    while True:  # walk on over the areas that aren't given out
        x = permuted(x, 900 * 99 * 9999, key, "ssn")
        rest, serial = divmod(x, 9999)
        area, group = divmod(rest, 99)
        made = f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"
        if number(made) >= 0:
            return in_place(value, made)


def in_place(value: str, made: str) -> str | None:
    """``made`` with the digits of the value's script; None when nothing changed."""
    first = next(c for c in value if c.isdecimal())
    zero = ord(first) - int(first)
    out = "".join(chr(zero + int(c)) if c.isdecimal() else c for c in made)
    return out if out != value else None


@lru_cache(maxsize=1)
def late_days() -> list[int]:
    """The days whose number in the month is above 12, so that a date with slashes can be read in one order only."""
    return [n for n in range(FIRST_DAY, LAST_DAY + 1) if datetime.date.fromordinal(n).day > 12]


def date(value: str, key: bytes) -> str | None:
    """The date of a permuted day, written alike.

    With slashes month and day may stand in either order. Dates that could be read both ways are permuted among
    themselves, as pairs of numbers, and those with a number above 12 among themselves, in their order: so different dates never print alike.
    """
    mark = re.search(r"\D", value)[0]
    parts = value.split(mark)
    if mark == "/" and len(parts[0]) < 4:
        a, b, year = map(int, parts)
        padded = any(len(p) == 2 and int(p[0]) == 0 for p in parts) or all(len(p) >= 2 for p in parts)
        if not (1 <= a <= 31 and 1 <= b <= 31 and 1900 <= year <= 2099):
            return None
        if max(a, b) <= 12:
            rest, b = divmod(permuted(((year - 1900) * 12 + a - 1) * 12 + b - 1, 200 * 144, key, "date|either"), 12)
            year, a = divmod(rest, 12)
            year, a, b = year + 1900, a + 1, b + 1
        else:
            try:
                n = datetime.date(year, *((b, a) if a > 12 else (a, b))).toordinal()
            except ValueError:
                return None
            days = late_days()
            made = datetime.date.fromordinal(days[permuted(bisect.bisect_left(days, n), len(days), key, "date|late")])
            year, (a, b) = made.year, ((made.day, made.month) if a > 12 else (made.month, made.day))
        return in_place(value, "/".join(f"{v:02d}" if padded else str(v) for v in (a, b, year)))
    for year, month, day in [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0)]:
        try:
            n = datetime.date(int(parts[year]), int(parts[month]), int(parts[day])).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= n <= LAST_DAY:
            return None
        made = datetime.date.fromordinal(FIRST_DAY + permuted(n - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))
        out = ["", "", ""]
        padded = any(len(p) == 2 and p[0] == "0" for p in parts) or all(len(p) >= 2 for p in parts)
        for i, v in ((year, made.year), (month, made.month), (day, made.day)):
            out[i] = f"{v:02d}" if padded else str(v)
        return in_place(value, mark.join(out))
    return None


def named_date(value: str, key: bytes) -> str | None:
    """A date with its month's name: the permuted day of ``date``, in the same language and order."""
    first = WITH_NAME.fullmatch(value)
    day, mark, gap, name, comma, year = first.group(1, 2, 3, 4, 5, 6) if first[1] else first.group(9, 10, 8, 7, 11, 12)
    order = ("de", "en", "short", "fr", "es") if mark == "." else ("en", "short", "de", "fr", "es")
    names = next(MONTHS[x] for x in order if name in MONTHS[x] or name[0].isupper() and name.lower() in MONTHS[x])
    try:
        n = datetime.date(int(year), 1 + [m.lower() for m in names].index(name.lower()), int(day)).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= n <= LAST_DAY:
        return None
    made = datetime.date.fromordinal(FIRST_DAY + permuted(n - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))
    month = names[made.month - 1]
    month = month.capitalize() if name[0].isupper() else month
    digits = f"{made.day:02d}" if day[0] == "0" else str(made.day)
    if mark in ("st", "nd", "rd", "th"):
        mark = "th" if made.day in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(made.day % 10, "th")
    if mark == "er" and made.day != 1:
        mark = ""
    return f"{digits}{mark or ''}{gap}{month}{comma}{made.year}" if first[1] else f"{month}{gap}{digits}{mark or ''}{comma}{made.year}"


def ip6(value: str, key: bytes) -> str | None:
    """An address of version 6 with at least three groups and a digit, in its shortest form; loopback and the like stay."""
    try:
        address = ipaddress.IPv6Address(value)
    except ValueError:
        return None
    if len([g for g in value.split(":") if g]) < 3 or not re.search(r"\d", value):
        return None
    made = str(ipaddress.IPv6Address(permuted(int(address), 1 << 128, key, "ip6")))
    return made.upper() if value.upper() == value else made


def ip(value: str, key: bytes) -> str | None:
    octets = [int(p) for p in value.split(".")]
    if any(o > 255 for o in octets) or any(len(p) > 1 and int(p[0]) == 0 for p in value.split(".")):
        return None
    x = permuted(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ip")
    return in_place(value, ".".join(map(str, x.to_bytes(4, "big"))))


def email(value: str, key: bytes) -> str | None:
    local, _, domain = value.rpartition("@")
    host, _, top = domain.rpartition(".")
    made = characters(local, key, "email"), characters(host, key, "host")
    return None if made == (None, None) else f"{made[0] or local}@{made[1] or host}.{top}"


def token(value: str, key: bytes) -> str | None:
    """A service's key: its kind's prefix stays."""
    lead = re.match(r"A[KS]IA|AIza|gh[pousr]_|[sr]k_(?:live|test)_|xox[abprs]-|sk-", value).end()
    made = characters(value[lead:], key, f"token|{value[:lead]}")
    return None if made is None else value[:lead] + made


def in_pieces(value: str, key: bytes, tweak: str) -> str:
    """``characters`` of each piece of a long value under a tweak of its own, so that work grows with the length only."""
    pieces = [value[i : i + LONGEST] for i in range(0, len(value), LONGEST)]
    return "".join(characters(p, key, f"{tweak}|{i}") or p for i, p in enumerate(pieces))


def jwt(value: str, key: bytes) -> str | None:
    """A signed token of three parts: the openings of the first two stay."""
    head, body, signature = value.split(".")
    return ".".join([head[:3] + in_pieces(head[3:], key, "jwt"), body[:3] + in_pieces(body[3:], key, "jwt|body"), in_pieces(signature, key, "jwt|signature")])


def block(value: str, key: bytes) -> str | None:
    """A private key between its two lines."""
    begin, end = value.index("-----", 5) + 5, value.rindex("-----END")
    made = value[:begin] + in_pieces(value[begin:end], key, "block") + value[end:]
    return made if made != value else None


def secret(value: str, key: bytes) -> str | None:
    if value.isdigit() or value.isalpha():
        return None
    x = permuted(int(value, 16), 16 ** len(value), key, f"secret|{len(value)}")
    made = f"{x:0{len(value)}x}"
    return made.upper() if value.upper() == value else made


def assigned(value: str, key: bytes) -> str | None:
    """What is assigned to a name such as ``password``, but for the marks at its end; the name stays."""
    at = re.match(r"[^=:]+[=:][ \t]*[\"']?", value).end()
    made = characters(value[at:], key, "assigned")
    return None if made is None else value[:at] + made


KINDS = {"block": block, "jwt": jwt, "email": email, "ip6": ip6, "named": named_date, "iban": iban, "phone": phone, "card": card, "ssn": ssn, "date": date, "ip": ip, "token": token, "assigned": assigned, "secret": secret}


@lru_cache(maxsize=50_000)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The pseudonym of a value, never the value itself; None when it isn't a valid one of its kind or can't be permuted."""
    return KINDS[kind](value, key)


def pseudonymised(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with pseudonyms, and (kind, start, length, pseudonym) of each in the given text's characters."""
    found, parts, at, search = [], [], 0, 0
    while match := PATTERN.search(text, search):
        kind = match.lastgroup
        made = pseudonym(kind, match[0], key)
        if made is None:  # not valid: look again behind its first run of digits or letters
            search = match.start() + max(1, len(re.match(r"[^\W_]*", match[0])[0]))
            continue
        found.append((kind, match.start(), len(match[0]), made))
        parts += [text[at : match.start()], made]
        at = search = match.end()
    return ("".join([*parts, text[at:]]), found) if found else (text, found)


HINT = re.compile(r"[\d@]|gh[pousr]_|xox[abprs]-|AIza|A[KS]IA|[sr]k_|sk-|eyJ|-----BEGIN")


def pseudonymise(df: DataFrame, key: bytes, text: str = "text", spans: str = "pii") -> DataFrame:
    """Replace personal data in ``text`` and add ``pii``: array of (kind, start, length, pseudonym).

    Starts and lengths are characters of the text before. A null text stays null with an
    empty array; empty texts stay empty; texts are read whole; repeated rows
    get the same result; an empty table stays empty; a column called like ``spans`` is replaced.
    The key stays on the executors' side of the closure; without it pseudonyms can't be undone.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("pseudonym", pa.string())]))
    entry = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("pseudonym", T.StringType())])

    def kernel(column: pa.Array) -> list[pa.Array]:
        made = [(None, []) if t is None else pseudonymised(t, key) if HINT.search(t) else (t, []) for t in column.to_pylist()]
        return [pa.array([t for t, _ in made], pa.string()), pa.array([[dict(zip(("kind", "start", "length", "pseudonym"), f, strict=True)) for f in found] for _, found in made], kind)]

    made_text, taken = "pseudonymised_text", {c.lower() for c in df.columns}
    while made_text in taken:
        made_text += "_"
    out = map_columns(df, text, [(made_text, T.StringType()), (spans, T.ArrayType(entry))], kernel)
    names = [c for c in out.columns if c != made_text]
    return out.select(*[out[made_text].alias(c) if c == text else f"`{c}`" for c in names])
