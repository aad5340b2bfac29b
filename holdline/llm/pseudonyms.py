"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass the checks of their kind are replaced by others of the same
kind and format, by a Feistel permutation with a secret key. The permutation works on
the value, not on how it is written: the same card number, with spaces or without, gets
the same digits in every document, so records stay linked, and the key turns them back.
Kinds whose valid values are not a plain range (telephone numbers, dates, addresses) are
permuted again until the result is valid, which is still a permutation of the valid ones.

Values of unlimited length (passwords, addresses) are permuted as one number up to
``LONG`` letters and digits. Longer ones are cut in pieces, each permuted under a tweak
that holds all that is left of it, and then once more under one that holds all that is
right of it: a permutation too, in which every place depends on all others, at a cost that
grows with the length.

Words that are as often something else need their context: hexadecimal digits are a secret
after the name of one and a sign (``token = "…"``), not as the digest of a commit or file;
four numbers with dots are no address after the word version, and a year first with dots
is a date after the word date or born only.
"""

from __future__ import annotations

import re
from calendar import month_name
from collections.abc import Callable
from datetime import date
from functools import lru_cache
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdline.llm import common

ROUNDS = 10
# Letters and digits that are permuted as one number, and those of a piece beyond it.
LONG, PIECE = 64, 32
# Dates that are recognised and given out: 1900 to 2099.
_FIRST, _LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
_MONTHS = {name.lower(): i for i, name in enumerate(month_name) if name}
_MONTH = "|".join(list(month_name)[1:])

# What may be personal, by kind, the more specific first; each is checked further.
_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)",
    "iso_date": r"(?<![\w-])\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}(?![\d-]|\.\d)",
    "day_first": r"(?<![\w.-])\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4}(?![\d-]|\.\d)",
    "day_month": rf"(?<!\w)\d{{1,2}}\ (?:{_MONTH})\ \d{{4}}(?!\w)",
    "month_day": rf"(?<!\w)(?:{_MONTH})\ \d{{1,2}},\ \d{{4}}(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w+.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])",
    "social": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w.])(?:\+?1[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])",
    "abroad": r"(?<!\w)\+\d{1,3}(?:[ .()/-]{0,2}\d){6,13}(?!\w|\.\d)",
    "access_key": r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)",
    "password": r"(?<=password=)[^\s\"']+",
    "secret": r"(?<!\w)[0-9a-f]{32,64}(?!\w)",
}
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS.items()))
# Kinds with spaces inside and no fixed length; a match may hold words that follow.
_OPEN = ("iban", "abroad")
# Characters of an IBAN by country, as registered.
_IBAN_SIZES = {
    c: int(n)
    for c, n in re.findall(
        r"([A-Z]{2})(\d\d)",
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 "
        "FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 "
        "LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 "
        "ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20",
    )
}
_POSSIBLE = re.compile(r"[0-9@]|AKIA|password=")


def feistel(x: int, size: int, key: bytes, kind: str, back: bool = False, tweak: bytes = b"") -> int:
    """The place of ``x`` in a permutation of ``range(size)`` that key, kind and tweak
    choose."""
    left = max(1, isqrt(size - 1) + 1)
    right = -(-size // left)
    width = (left.bit_length() + 7) // 8 + 8

    def f(r: int, half: int, mod: int) -> int:
        data = tweak + r.to_bytes(1, "big") + half.to_bytes((half.bit_length() + 7) // 8, "big")
        out = b"".join(
            blake2b(data + i.to_bytes(4, "big"), key=key, person=kind.encode()[:16]).digest() for i in range(-(-width // 64))
        )
        return int.from_bytes(out[:width], "big") % mod

    while True:  # until the result is in range
        a, b = divmod(x, right)
        for r in range(ROUNDS)[:: -1 if back else 1]:
            sign = -1 if back else 1
            if r % 2:
                b = (b + sign * f(r, a, right)) % right
            else:
                a = (a + sign * f(r, b, left)) % left
        x = a * right + b
        if x < size:
            return x


def _until(x: int, size: int, valid: Callable[[int], bool], *how) -> int:
    x = feistel(x, size, *how)
    while not valid(x):
        x = feistel(x, size, *how)
    return x


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[::-2])
    return str(-(doubled + sum(int(d) for d in digits[-2::-2])) % 10)


def _filled(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in form)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _card(text: str, *how) -> str | None:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    # The first digit, which names the kind of card, stays; zero is none.
    body = f"{feistel(int(digits[1:-1]), 10 ** (n - 1), *how):0{n - 1}d}"
    body = digits[0] + body
    return _filled(text, body + luhn_digit(body))


def _social(text: str, *how) -> str | None:
    def valid(x: int) -> bool:
        s = f"{x:09d}"
        return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

    x = int(_digits(text))
    return _filled(text, f"{_until(x, 10**9, valid, *how):09d}") if valid(x) else None


def _phone(text: str, *how) -> str | None:
    digits = _digits(text)
    before, own = digits[:-10], digits[-10:]

    def valid(x: int) -> bool:
        s = f"{x:010d}"
        return s[0] in "23456789" and s[3] in "23456789"

    strict = valid(int(own))
    if not strict and not text.startswith("+"):
        return None
    new = _until(int(own), 10**10, lambda x: valid(x) == strict, *how)
    return _filled(text, f"{before}{new:010d}")


def _abroad(text: str, *how) -> str | None:
    digits = _digits(text)
    if not 8 <= len(digits) <= 15 or digits[0] == "0":
        return None
    n = len(digits) - 2  # the first two may be the country
    return _filled(text, digits[:2] + f"{feistel(int(digits[2:]), 10**n, *how):0{n}d}")


def _ip(text: str, *how) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    x = feistel(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, *how)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _iban(text: str, *how) -> str | None:
    plain = text.replace(" ", "")

    def rest(s: str) -> int:
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97

    if not 15 <= len(plain) <= 34 or rest(plain) != 1:
        return None
    body = _letters(plain[4:], *how)
    country = plain[:2]
    new = f"{country}{98 - rest(f'{country}00{body}'):02d}{body}"
    places = iter(new)
    return "".join(c if c == " " else next(places) for c in text)


def _pieces(values: list[tuple[int, int]], key: bytes, kind: str, back: bool = False) -> list[int]:
    """``values``, pairs of a number and the size of its range, permuted together."""
    x = [v for v, _ in values]
    forth = range(len(x))

    def chain(places, offset: bytes, undo: bool) -> None:
        # What a piece's tweak holds is the result of all pieces before it in the chain.
        seen = blake2b(offset + len(x).to_bytes(8, "big"), key=key, person=kind.encode()[:16]).digest()
        for i in places:
            given = x[i]
            x[i] = feistel(given, values[i][1], key, kind, undo, seen)
            told = (given if undo else x[i]).to_bytes((values[i][1].bit_length() + 7) // 8, "big")
            seen = blake2b(seen + told, key=key, person=kind.encode()[:16]).digest()

    steps = [(forth, b"left"), (forth[::-1], b"right")]
    for places, offset in steps[:: -1 if back else 1]:
        chain(places, offset, back)
    return x


def _letters(text: str, key: bytes, kind: str, back: bool = False) -> str:
    """Letters and digits permuted, each place within its own kind; others stay."""
    places = [i for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    bases = [(10, "0") if text[i].isdigit() else (26, "a" if text[i].islower() else "A") for i in places]
    step = PIECE if len(places) > LONG else max(1, len(places))
    values = []
    for at in range(0, len(places), step):
        size, x = 1, 0
        for i, (base, first) in zip(places[at : at + step], bases[at : at + step]):
            size, x = size * base, x * base + ord(text[i]) - ord(first)
        values.append((x, size))
    new = _pieces(values, key, kind, back) if len(values) > 1 else [feistel(x, n, key, kind, back) for x, n in values]
    out = list(text)
    for at, x in zip(range(0, len(places), step), new):
        for i, (base, first) in reversed(list(zip(places[at : at + step], bases[at : at + step]))):
            x, d = divmod(x, base)
            out[i] = chr(ord(first) + d)
    return "".join(out)


def _email(text: str, *how) -> str:
    # One address in any case; the last label of the domain stays.
    body, dot, top = text.rpartition(".")
    new = _letters(body.lower(), *how)
    return "".join(n.upper() if c.isupper() else n for c, n in zip(body, new)) + dot + top


def _hex(text: str, *how) -> str | None:
    if text.isdigit() or text.isalpha():
        return None
    return f"{feistel(int(text, 16), 16 ** len(text), *how):0{len(text)}x}"


def _key(text: str, *how) -> str:
    return text[:4] + _letters(text[4:], *how)


def _date(text: str, key: bytes, kind: str, order: str) -> str | None:
    parts = re.findall(r"\d+|[A-Za-z]+", text)
    named = [p for p in parts if p.isalpha()]
    values = [_MONTHS[p.lower()] if p.isalpha() else int(p) for p in parts]
    found = dict(zip(order, values))
    if not named and order == "dmy" and found["m"] > 12:  # written month first
        order = "mdy"
        found = dict(zip(order, values))
    try:
        day = date(found["y"], found["m"], found["d"]).toordinal()
    except ValueError:
        return None
    if not _FIRST <= day <= _LAST:
        return None

    def fits(x: int) -> bool:
        # A date that can be read both ways must still be read as it was written.
        new = date.fromordinal(_FIRST + x)
        return order != "mdy" or bool(named) or new.day > 12

    if not fits(day - _FIRST):
        return None
    new = date.fromordinal(_FIRST + _until(day - _FIRST, _LAST - _FIRST + 1, fits, key, kind))
    rest = iter(order)

    def put(m: re.Match) -> str:
        part = next(rest)
        if m[0].isalpha():
            return month_name[new.month]
        value = {"y": new.year, "m": new.month, "d": new.day}[part]
        padded = any(p.startswith("0") for p in parts) or all(len(p) > 1 for p in parts if p.isdigit())
        return f"{value:02d}" if padded and part != "y" else str(value)

    return re.sub(r"\d+|[A-Za-z]+", put, text)


# The check and the permutation of each kind; kinds that share values share a name.
_KINDS: dict[str, tuple[str, Callable[..., str | None]]] = {
    "email": ("email", _email),
    "ip": ("ip", _ip),
    "iso_date": ("date", lambda t, *how: _date(t, *how, "ymd")),
    "day_first": ("date", lambda t, *how: _date(t, *how, "dmy")),
    "day_month": ("date", lambda t, *how: _date(t, *how, "dmy")),
    "month_day": ("date", lambda t, *how: _date(t, *how, "mdy")),
    "iban": ("iban", _iban),
    "card": ("card", _card),
    "social": ("social", _social),
    "phone": ("phone", _phone),
    "abroad": ("abroad", _abroad),
    "access_key": ("key", _key),
    "password": ("password", _letters),
    "secret": ("secret", _hex),
}


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, text: str, key: bytes) -> str | None:
    """What replaces ``text``; nothing if it fails the checks of its kind."""
    name, change = _KINDS[kind]
    return change(text, key, name)


def replaced(text: str, key: bytes) -> tuple[str, int]:
    """``text`` with pseudonyms, and how many."""
    if not _POSSIBLE.search(text):
        return text, 0
    out, n, at, look = [], 0, 0, 0
    while m := _ANY.search(text, look):
        new, m = _checked(m.lastgroup if m.lastgroup in _KINDS else _kind(m), text, m, key)
        if new is None:  # it may still begin, or hold, something of another kind
            new, m = _other(text, m, key)
        if new is None:
            look = m.start() + 1
            continue
        out += [text[at : m.start()], new]
        at = look = m.end()
        n += 1
    return ("".join(out) + text[at:], n) if n else (text, 0)


def _kind(m: re.Match) -> str:
    return next(k for k in _KINDS if m[k] is not None)


_EACH = {k: re.compile(p) for k, p in _PATTERNS.items()}
# What has to stand before a match of a kind, or must not, in so many characters.
_BEFORE = 48
_NAMED = re.compile(r"""(?:token|secret|key|pass(?:word|wd|phrase)|pwd|auth|credential)[\w.-]{0,20}["']?\s{0,3}(?:=>|[:=])\s{0,3}["']?$""", re.I)
_DATED = re.compile(r"(?:date|dated|born|birth|birthday|dob|on)[\s:=]{1,3}$", re.I)
_VERSION = re.compile(r"(?:\bv|version|release|build)[\s.:=]{0,3}$", re.I)


def _in_context(kind: str, text: str, m: re.Match) -> bool:
    before = text[max(0, m.start() - _BEFORE) : m.start()]
    if kind == "secret":
        return bool(_NAMED.search(before))
    if kind == "ip":
        return not _VERSION.search(before)
    return kind != "iso_date" or "." not in m[0] or bool(_DATED.search(before))


def _checked(kind: str, text: str, m: re.Match, key: bytes) -> tuple[str | None, re.Match]:
    """What replaces the match, or the longest part of it up to a space that passes the
    checks; of an IBAN first the part that is as long as its country's."""
    parts = [m] if _in_context(kind, text, m) else []
    if kind in _OPEN:
        ends = [i for i in range(m.end() - 1, m.start(), -1) if text[i] == " "]
        parts += [p for end in ends if (p := _EACH[kind].fullmatch(text, m.start(), end))]
        if kind == "iban":
            size = _IBAN_SIZES.get(m[0][:2])
            parts.sort(key=lambda p: len(p[0].replace(" ", "")) != size)
    for part in parts:
        if (new := pseudonym(kind, part[0], key)) is not None:
            return new, part
    return None, m


def _other(text: str, m: re.Match, key: bytes) -> tuple[str | None, re.Match]:
    for kind, pattern in _EACH.items():
        if other := pattern.match(text, m.start()):
            new, other = _checked(kind, text, other, key)
            if new is not None:
                return new, other
    return None, m


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_replaced", pa.int64())])


def pseudonymized(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, n_replaced) for each row, from its whole text.

    A null text stays null, an empty one empty; null or repeated ids keep their rows;
    other columns are ignored and an empty table gives no rows. What fails the checks of
    its kind (a number with a wrong check digit, a 31st of February) stays as it is.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        for ids, texts in common.columns_of(batches, "doc_id", "text"):
            found = [(None, 0) if t is None else replaced(t, key) for t in texts]
            cols = {"doc_id": ids, "text": [f[0] for f in found], "n_replaced": [f[1] for f in found]}
            yield common.batch(cols, _SCHEMA)

    return common.bounded_batches(rows).mapInArrow(run, "doc_id long, text string, n_replaced long")
