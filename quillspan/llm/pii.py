"""Format-preserving pseudonyms: validated numbers and dates are permuted by a keyed Feistel network within their format.

A value is found by its pattern, validated (Luhn digit, calendar, octets, address groups, number plan, IBAN remainder), reduced to a
canonical integer of its format's domain and sent through a Feistel network with a keyed hash as round function; walking
the cycle until the result is of the format again makes that a permutation of the format's values. Equal values become
equal pseudonyms in every document, however they are written; different ones stay different; and a text keeps its length.
The letters and digits of mail names and of labelled secrets are permuted in the same way, in any script: a letter becomes one of its
kind among the 128 code points around it. Digits that fail validation are
left alone, and so are digits of other scripts than ASCII; the search goes on inside them. An IBAN ends by its country's length, whatever words follow. Dates may be
written with one-digit days or months, phone numbers of other countries than the US in international form (+44 ...).

Defined cases: a null text stays null; empty texts and texts without findings come back unchanged; equal rows are treated alike;
columns named like the results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable
from functools import cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import with_columns

ROUNDS = 8
#: Characters of a value that are permuted as one number; and of values whose pseudonyms a worker remembers.
PIECE = 256
#: Domains smaller than this are shifted by a keyed amount that isn't 0, so that no value stays itself.
SMALL = 1000
#: A stand-in; a user passes a key of their own.
KEY = b"change this key"
#: Digits of other scripts are no digits here: numbers written in them are left alone.
DIGITS = "0123456789"
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()

PATTERN = re.compile(
    r"(?P<email>(?<![\w+%-])(?=[\w.+%-]{1,256}@)[\w+%-]+(?:\.[\w+%-]+)*@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}(?![\w-]))"
    r"|(?P<secret>\b(?:api[_ -]?key|secret|token|passw(?:or)?d|access[_ -]?key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?a:[A-Za-z0-9+/_-]{16,}))"
    r"|(?P<key>(?-i:\b(?:AKIA|ASIA)[A-Z2-7]{16}\b))"
    r"|(?P<iban>\b(?a:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}))"
    r"|(?P<ip6>(?<![\w:.])(?=[0-9a-f:]{2,39}(?![\w:]))(?=[0-9a-f:]*[0-9])(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}(?![\w:]))"
    r"|(?P<ip>(?<![0-9])(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<ymd>(?<![0-9])(?<![0-9][/.-])[0-9]{4}(?P<s1>[-/.])[0-9]{1,2}(?P=s1)[0-9]{1,2}(?![0-9/-]|\.[0-9]))"
    r"|(?P<dmy>(?<![0-9])(?<![0-9][/.-])[0-9]{1,2}(?P<s2>[-/.])[0-9]{1,2}(?P=s2)[0-9]{4}(?![0-9/-]|\.[0-9]))"
    r"|(?P<ssn>(?<![0-9])(?<![0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<phone>(?<![0-9])(?<![0-9][.-])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}(?P<s3>[ .-])[0-9]{3}(?P=s3)[0-9]{4})(?![0-9]|-[0-9]))"
    r"|(?P<e164>(?<![\w+])\+[2-9](?:[ ./()-]{0,2}[0-9]){7,14}(?![0-9]|-[0-9]))"
    r"|(?P<card>(?<![0-9])(?<![0-9][.-])(?:[0-9]{4}(?P<s4>[ -])[0-9]{4}(?P=s4)[0-9]{4}(?P=s4)[0-9]{4}|[0-9]{4}(?P<s5>[ -])[0-9]{6}(?P=s5)[0-9]{5}|[0-9]{13,19})(?![0-9-]))",
    re.IGNORECASE,
)
#: Characters of an IBAN by country.
IBAN_SIZE = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM TL SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG DZ", 25: "AO CV LY MZ PT ST", 26: "IR IS TR", 27: "BF BI CF CG CM EG FR GA GQ GR IT KM MC MG MR SM TD DJ",
        28: "AL AZ BJ BY CI CY DO GT GW HN HU LB MA ML NE NI PL SN SV TG YE", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
#: Country calling codes other than 1: two digits, or three.
CALLING = re.compile(r"7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|3[578]|42|5[09]|6[7-9]|8[0578]|9[67])[0-9]|99[2-68]")
MAYBE = re.compile(rb"[0-9@:]|AKIA|ASIA|(?i:key|secret|token|passw)")


class Permuter:
    """Keyed permutations of integer domains; one for each worker and key."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.memo: dict[tuple[str, str], str] = {}

    def _round(self, kind: str, n: int, r: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{kind}|{n}|{r}|{x}".encode(), key=self.key, digest_size=32).digest(), "big")

    def integer(self, kind: str, n: int, x: int, same: Callable[[int], bool] | None = None) -> int:
        """A permutation of 0 to n - 1; with ``same``, of those values for which it holds (as it does for ``x``)."""
        if n < 2:
            return x
        if n < SMALL and same is None:
            return (x + 1 + self._round(kind, n, 0, 0) % (n - 1)) % n
        a = isqrt(n - 1) + 1  # the network permutes a * a values, at least n
        while True:
            left, right = divmod(x, a)
            for r in range(ROUNDS):
                left, right = right, (left + self._round(kind, n, r, right)) % a
            x = left * a + right
            if x < n and (same is None or same(x)):
                return x

    def characters(self, kind: str, text: str) -> str:
        """Letters and digits permuted together, each within its own alphabet; other characters stay.

        Long texts go by pieces, each under a key that takes in what the pieces before it became.
        """
        if len(text) > PIECE:
            out: list[str] = []
            seen = hashlib.blake2b(key=self.key, digest_size=16)
            for at in range(0, len(text), PIECE):
                out.append(self.characters(f"{kind}:{len(text)}:{seen.hexdigest()}", text[at : at + PIECE]))
                seen.update(out[-1].encode())
            return "".join(out)
        sets = [alphabet(c) for c in text]
        n, x = 1, 0
        for c, s in zip(text, sets):
            n, x = n * len(s), x * len(s) + s.index(c)
        x, out = self.integer(f"{kind}:{'.'.join(str(len(s)) for s in sets)}", n, x), []
        for s in reversed(sets):
            x, k = divmod(x, len(s))
            out.append(s[k])
        return "".join(reversed(out))


#: Letters a to z, A to Z, digits, and the Latin-1 letters of either case.
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7), "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7))


@cache
def alphabet(c: str) -> str:
    """The characters that ``c`` may become: of its own alphabet, or else the letters or digits of its kind among the 128 code points around it."""
    known = next((s for s in ALPHABETS if c in s), None)
    kind = unicodedata.category(c)
    if known or kind[0] != "L" and kind != "Nd":
        return known or c
    low = ord(c) & ~127
    # those in a listed alphabet belong to that one
    return "".join(x for x in map(chr, range(low, low + 128)) if unicodedata.category(x) == kind and not any(x in s for s in ALPHABETS))


def luhn_digit(digits: str) -> int:
    """The digit that makes ``digits`` and itself pass the Luhn test."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return -total % 10


def iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{account}{country}00")) % 97


def phone_class(digits: int) -> tuple[bool, bool]:
    area, rest = divmod(digits, 10_000_000)
    return area >= 200, rest >= 2_000_000


def ip_class(octets: list[int]) -> int:
    """Public addresses, private ones and the rest keep to themselves."""
    a, b = octets[:2]
    return 1 if a == 10 or (a, b) == (192, 168) or (a == 172 and 16 <= b < 32) else 2 if a in (0, 127) or a >= 224 or (a, b) == (169, 254) else 0


def ssn_ok(x: int) -> bool:
    area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _day(y: int, m: int, d: int) -> int | None:
    try:
        n = dt.date(y, m, d).toordinal()
    except ValueError:
        return None
    return n - FIRST_DAY if FIRST_DAY <= n <= LAST_DAY else None


def _same_date(day: int) -> Callable[[int], bool]:
    """Whether a date has as many digits as ``day`` without leading zeros, and a day above 12 or not as it has.

    All ways to write a date keep to that, so the day's pseudonym is one date whether its zeros are written or left out,
    and whether the day or the month comes first, which only a day above 12 tells.
    """

    def kind(v: int) -> tuple[bool, bool, bool]:
        d = dt.date.fromordinal(FIRST_DAY + v)
        return d.day > 9, d.day > 12, d.month > 9

    here = kind(day)
    return lambda v: kind(v) == here


def _ip6_groups(value: str) -> list[int]:
    """Places in ``value`` of the groups that its pseudonym replaces: those with a number, from the second on; none if it isn't valid.

    The first group tells the kind of network and stays. Loopback, multicast and local addresses say nothing of anybody.
    """
    try:
        at = ipaddress.IPv6Address(value)
    except ValueError:
        return []
    groups = value.split(":")
    if at.is_loopback or at.is_unspecified or at.is_multicast or at.is_link_local:
        return []
    first = next(i for i, g in enumerate(groups) if g)
    return [i for i, g in enumerate(groups) if i > first and g and int(g, 16)]


def iban_end(value: str) -> int:
    """Where the IBAN at the start of ``value`` ends, by its country's length; 0 if there is none. Groups after it don't belong to it."""
    left = IBAN_SIZE.get(value[:2].upper(), 0)
    for at, c in enumerate(value):
        left -= c != " "
        if not left:
            return 0 if value[at + 1 : at + 2].isalnum() else at + 1
    return 0


def digits_like(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced, from the right, by ``digits``."""
    out, left = list(shape), list(digits)
    for i in range(len(out) - 1, -1, -1):
        if out[i] in DIGITS and left:
            out[i] = left.pop()
    return "".join(out)


def pseudonym(p: Permuter, kind: str, value: str) -> str | None:
    """The pseudonym of a value as it is written, or None if it isn't valid."""
    digits = "".join(c for c in value if c in "0123456789")
    if kind == "email":
        name, _, host = value.rpartition("@")
        return f"{p.characters('email', name)}@{host}"
    if kind == "secret":
        label, body = re.match(r"(.*[:=]\s*[\"']?)(.*)", value, re.S).groups()
        if len(body) <= PIECE and re.fullmatch(r"[0-9a-f]+", body):
            return label + f"{p.integer(f'hex{len(body)}', 16 ** len(body), int(body, 16)):0{len(body)}x}"
        # letters of one case alone, or capitalised, are a word
        mixed = re.search(r"[0-9]", body) or body[1:] != body[1:].lower() != body[1:].upper()
        return label + p.characters("secret", body) if mixed else None
    if kind == "key":
        return value[:4] + p.characters("key", value[4:])
    if kind == "iban":
        flat = value.replace(" ", "").upper()
        country, check, account = flat[:2], flat[2:4], flat[4:]
        if sum(c.isdigit() for c in account) < 8 or int(check) != iban_check(country, account):
            return None
        account = p.characters(f"iban{country}", account)
        new = iter(f"{country}{iban_check(country, account):02d}{account}")
        return "".join(c if c == " " else next(new) for c in value)
    if kind == "ip6":
        parts = value.split(":")
        places = _ip6_groups(value)
        if not places:
            return None
        # a group keeps its number of digits, so that zeros may be left out or written as before
        ranges = [(16 ** (n - 1) if n > 1 else 1, 16**n - (16 ** (n - 1) if n > 1 else 1)) for n in (len(parts[i].lstrip("0")) for i in places)]
        n, x = 1, 0
        for i, (low, size) in zip(places, ranges):
            n, x = n * size, x * size + int(parts[i], 16) - low
        x = p.integer(f"ip6{ranges}", n, x)
        for i, (low, size) in zip(reversed(places), reversed(ranges)):
            x, r = divmod(x, size)
            new = f"{low + r:0{len(parts[i])}x}"
            parts[i] = new.upper() if value != value.lower() else new
        return ":".join(parts)
    if kind == "ip":
        octets = [int(c) for c in value.split(".")]
        if max(octets) > 255 or any(len(c) > 1 and c[0] == "0" for c in value.split(".")):
            return None
        here = ip_class(octets)
        # an octet keeps its number of digits; outside the public ranges the first two octets stay
        ranges = [(o, 1) if here and i < 2 else ((0, 10), (10, 90), (100, 156))[len(str(o)) - 1] for i, o in enumerate(octets)]
        n, x = 1, 0
        for o, (low, size) in zip(octets, ranges):
            n, x = n * size, x * size + o - low

        def spelled(v: int) -> list[int]:
            out = []
            for low, size in reversed(ranges):
                v, r = divmod(v, size)
                out.append(low + r)
            return out[::-1]

        y = p.integer(f"ip{ranges}", n, x, lambda v: ip_class(spelled(v)) == here)
        return ".".join(map(str, spelled(y)))
    if kind in ("ymd", "dmy"):
        sep = next(c for c in value if c not in DIGITS)
        a, b, c = map(int, value.split(sep))
        if kind == "ymd":
            day = _day(a, b, c)
            if day is None:
                return None
            new = dt.date.fromordinal(FIRST_DAY + p.integer("date", LAST_DAY - FIRST_DAY + 1, day, _same_date(day)))
            _, wb, wc = map(len, value.split(sep))
            return f"{new.year:04d}{sep}{new.month:0{wb}d}{sep}{new.day:0{wc}d}"
        day, first = _day(c, b, a), True
        if day is None:  # month first, which only a day above 12 tells
            day, first = _day(c, a, b), False
        if day is None:
            return None
        new = dt.date.fromordinal(FIRST_DAY + p.integer("date", LAST_DAY - FIRST_DAY + 1, day, _same_date(day)))
        one, two = (new.day, new.month) if first else (new.month, new.day)
        wa, wb, _ = map(len, value.split(sep))
        return f"{one:0{wa}d}{sep}{two:0{wb}d}{sep}{new.year:04d}"
    if kind == "ssn":
        x = int(digits)
        return digits_like(value, f"{p.integer('ssn', 10**9, x, ssn_ok):09d}") if ssn_ok(x) else None
    if kind == "phone":
        x = int(digits[-10:])
        here = phone_class(x)
        if not all(here) and value[0] not in "+(":
            return None
        return digits_like(value, f"{p.integer('phone', 10**10, x, lambda v: phone_class(v) == here):010d}")
    if kind == "e164":
        head, trunk, tail = value.partition("(0)")  # a trunk zero isn't part of the number
        digits = "".join(c for c in head + tail if c in DIGITS)
        code = CALLING.match(digits)
        if not code or not 8 <= len(digits) <= 15 or len(digits) - code.end() < 5:
            return None
        n = len(digits) - code.end()
        low = 10 ** (n - 1)
        here = int(digits[code.end() :]) >= low  # a leading zero stays one, and no other appears
        new = digits_like(head + tail, f"{p.integer(f'e164{code[0]}:{n}', 10**n, int(digits[code.end() :]), lambda v: (v >= low) == here):0{n}d}")
        return new[: len(head)] + trunk + new[len(head) :]
    if len(set(digits)) == 1 or luhn_digit(digits[:-1]) != int(digits[-1]):
        return None
    n = len(digits) - 2  # the first digit tells the network and stays
    body = f"{digits[0]}{p.integer(f'card{digits[0]}:{n}', 10**n, int(digits[1:-1])):0{n}d}"
    return digits_like(value, f"{body}{luhn_digit(body)}")


_PERMUTERS: dict[bytes, Permuter] = {}


def pseudonymise_text(text: str, key: bytes = KEY) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and what was replaced: kind, start and length in the text given."""
    p = _PERMUTERS.setdefault(key, Permuter(key))
    found: list[dict] = []

    def swap(kind: str, value: str, start: int) -> str | None:
        if (new := p.memo.get((kind, value))) is None:
            if len(p.memo) > 200_000:
                p.memo.clear()
            new = pseudonym(p, kind, value) or ""
            if len(value) <= PIECE:
                p.memo[kind, value] = new
        if new:
            found.append({"kind": {"e164": "phone", "ip6": "ip", "key": "secret"}.get(kind, kind), "start": start, "length": len(value)})
        return new or None

    out, done, at = [], 0, 0
    while m := PATTERN.search(text, at):
        value = m[0]
        if m.lastgroup == "iban":
            value = value[: iban_end(text[m.start() : m.end() + 1])]
        new = swap(m.lastgroup, value, m.start()) if value else None
        if new is None:
            at = m.start() + 1  # what isn't valid doesn't hide what stands inside or after it
        else:
            out += [text[done : m.start()], new]
            done = at = m.start() + len(value)
    return "".join([*out, text[done:]]), found


def pseudonymise(docs: DataFrame, *, key: bytes = KEY, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all, if None) with the text rewritten, and ``findings`` (kind, start, length)."""

    def work(columns, texts):
        new, found = [], []
        nulls = columns[text_col].is_null().to_pylist()
        for raw, null in zip(texts, nulls):
            text, what = (None if null else raw.decode("utf-8")), []
            if MAYBE.search(raw):
                text, what = pseudonymise_text(text, key)
            new.append(text)
            found.append(what)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
        return {text_col: pa.array(new, pa.string()), "findings": pa.array(found, kind)}

    made = with_columns(docs, work, f"{text_col} string, findings array<struct<kind:string,start:int,length:int>>", text_col=text_col, uses=(text_col,), keep=keep)
    return made.select(*[c for c in (docs.columns if keep is None else keep) if c not in ("findings", text_col)], text_col, "findings")
