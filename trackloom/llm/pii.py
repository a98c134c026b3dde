"""Personal data: format-preserving pseudonyms by a keyed Feistel permutation.

Card numbers (Luhn), bank accounts (check digits), social security numbers, phone numbers, IPv4
addresses and dates are recognised, validated, and permuted within their format under a key; e-mail
addresses keep their shape under a keyed permutation of letters and digits. Equal values map to
equal pseudonyms in all documents, different values of a format to different ones. What is part of
the format stays: an account's country and the letters of its bank's code, the country code of a phone
number that begins with +, an e-mail address's last label, all blanks and punctuation. A phone number
ends where a valid card number begins.

Not recognised: dates written month first, accounts in lower case, social security numbers without
hyphens, phone numbers of fewer than ten digits.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import hmac
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import map_batches, text_of

ROUNDS = 8
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)


def _stream(key: bytes, message: bytes, size: int) -> bytes:
    """``size`` pseudo-random bytes of a message: its digest under the key, expanded by a counter."""
    seed, out = hmac.digest(key, message, "sha256"), []
    for i in range(-(-size // 32)):
        out.append(hmac.digest(seed, i.to_bytes(8, "big"), "sha256"))
    return b"".join(out)[:size]


def feistel(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of 0 .. size - 1: a balanced network over the next square, walked until
    it falls into the range. Round values have 16 bytes more than a side, so all of it is mixed."""
    if size < 2:
        return value
    side = math.isqrt(size - 1) + 1
    width = (side.bit_length() + 7) // 8
    while True:
        a, b = divmod(value, side)
        for i in range(ROUNDS):
            d = _stream(key, b"%d|%d|" % (i, len(tweak)) + tweak + size.to_bytes(2 * width + 1, "big") + b.to_bytes(width, "big"), width + 16)
            a, b = b, (a + int.from_bytes(d, "big")) % side
        value = a * side + b
        if value < size:
            return value


def permuted_symbols(symbols: list[int], radices: list[int], key: bytes, tweak: bytes) -> list[int]:
    """A keyed permutation of symbol sequences, each symbol below its own radix and the radices
    fixed: the two halves are shifted in turn, symbol by symbol, by values drawn from the other.
    Its cost grows with the length alone."""
    half = len(symbols) // 2
    parts = [symbols[:half], symbols[half:]]
    of = [radices[:half], radices[half:]]
    for i in range(ROUNDS):
        own, other = i % 2, 1 - i % 2
        d = _stream(key, b"%d|%d|" % (i, len(tweak)) + tweak + bytes(parts[other]), 8 * len(parts[own]))
        parts[own] = [(x + int.from_bytes(d[8 * j : 8 * j + 8], "big")) % r for j, (x, r) in enumerate(zip(parts[own], of[own]))]
    return parts[0] + parts[1]


def permuted_digits(digits: str, key: bytes, tweak: bytes) -> str:
    return str(feistel(int(digits), 10 ** len(digits), key, tweak)).zfill(len(digits)) if digits else ""


def luhn_digit(body: str) -> str:
    total = sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 == 0 else d for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def iban_check(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return str(98 - int(number) % 97).zfill(2)


def _into(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _only(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _card(value: str, key: bytes) -> str | None:
    d = _only(value)
    if luhn_digit(d[:-1]) != d[-1]:
        return None
    body = permuted_digits(d[:-1], key, b"card")
    return _into(value, body + luhn_digit(body))


def account_end(value: str) -> int:
    """Where the longest account ends that ``value`` (as the pattern finds it) begins with: at its end
    or at a blank, with right check digits; 0 if none does. The remainder is carried from token to token."""
    head = int("".join(str(int(c, 36)) for c in value[:4]))
    rest, size, best = 0, 0, 0
    for i, c in enumerate(value[4:], 4):
        if c == " ":
            if size >= 8 and (rest * 1_000_000 + head) % 97 == 1:
                best = i
        else:
            x = int(c, 36)
            rest = (rest * (10 if x < 10 else 100) + x) % 97
            size += 1
    return len(value) if size >= 8 and (rest * 1_000_000 + head) % 97 == 1 else best


def _iban(value: str, key: bytes) -> str | None:
    s = value.replace(" ", "")
    country, body = s[:2], s[4:]
    if account_end(value) != len(value):
        return None
    new = permuted_digits(_only(body), key, b"iban" + re.sub(r"\d", "0", s).encode())
    body = _into(body, new)
    it = iter(country + iban_check(country, body) + body)
    return "".join(c if c == " " else next(it) for c in value)


def _ssn(value: str, key: bytes) -> str | None:
    area, group, serial = (int(x) for x in value.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    n = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
    n = feistel(n, len(areas) * 99 * 9999, key, b"ssn")
    return f"{areas[n // 9999 // 99]:03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"


#: Country codes of one and two digits; all others have three.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def country_code(digits: str) -> str:
    return next((digits[:n] for n in (1, 2) if digits[:n] in _CODES), digits[:3])


def _phone(value: str, key: bytes) -> str | None:
    d = _only(value)
    if not 10 <= len(d) <= 15:
        return None
    code = country_code(d) if value[0] == "+" else ""
    return _into(value, code + permuted_digits(d[len(code) :], key, b"phone" + code.encode()))


def _address(value: str, key: bytes) -> str | None:
    parts = [int(x) for x in value.split(".")]
    if max(parts) > 255:
        return None
    n = feistel(int.from_bytes(bytes(parts), "big"), 1 << 32, key, b"ipv4")
    return ".".join(str(x) for x in n.to_bytes(4, "big"))


def _date(value: str, key: bytes) -> str | None:
    """Dates as year-month-day, or with points or slashes as day.month.year."""
    sep = "-" if "-" in value else "." if "." in value else "/"
    a, b, c = (int(x) for x in value.split(sep))
    y, mo, d = (a, b, c) if value[4] == sep else (c, b, a)
    try:
        day = datetime.date(y, mo, d)
    except ValueError:
        return None
    if not _FIRST_DAY <= day <= _LAST_DAY:
        return None
    days = (_LAST_DAY - _FIRST_DAY).days + 1
    new = _FIRST_DAY + datetime.timedelta(feistel((day - _FIRST_DAY).days, days, key, b"date"))
    return f"{new.year:04d}{sep}{new.month:02d}{sep}{new.day:02d}" if value[4] == sep else f"{new.day:02d}{sep}{new.month:02d}{sep}{new.year:04d}"


_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _mail(value: str, key: bytes) -> str | None:
    """The local part and the domain but its last label, character kind by character kind; an
    address is told apart from others of its shape by the whole of it, in lower case."""
    body, dot, top = value.rpartition(".")
    low = body.lower()
    kinds = [_LETTERS if c in _LETTERS else _DIGITS if c in _DIGITS else "" for c in low]
    new = iter(permuted_symbols([k.index(c) for c, k in zip(low, kinds) if k], [len(k) for k in kinds if k], key, b"mail" + re.sub(r"[0-9]", "0", re.sub(r"[a-z]", "a", low)).encode()))
    out = [k[next(new)] if k else c for c, k in zip(low, kinds)]
    return "".join(x.upper() if c.isupper() else x for c, x in zip(body, out)) + dot + top


#: Kinds, in order of precedence at one place.
KINDS = ("mail", "iban", "ssn", "address", "date", "phone", "card")
_WORK = {"mail": _mail, "iban": _iban, "ssn": _ssn, "address": _address, "date": _date, "phone": _phone, "card": _card}
_PATTERN = re.compile(
    r"(?P<mail>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<address>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<date>(?<![0-9.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]))"
    r"|(?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])|(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]))"
    r"|(?P<card>(?<![A-Za-z0-9])[0-9]{4}(?:([ -]?)[0-9]{4}){2}\8[0-9]{1,7}(?![A-Za-z0-9]))",
    re.A,
)


_CARD = re.compile(r"(?<![A-Za-z0-9])[0-9]{4}(?:([ -]?)[0-9]{4}){2}\1[0-9]{1,7}(?![A-Za-z0-9])", re.A)


def _card_inside(text: str, start: int, end: int) -> int | None:
    """Where a valid card number begins between ``start`` and ``end``; of several the first that begins
    as issuers' do (3 to 6), else the first."""
    found, m = [], _CARD.search(text, start)
    while m and m.start() < end:
        d = _only(m[0])
        if luhn_digit(d[:-1]) == d[-1]:
            found.append(m.start())
        m = _CARD.search(text, m.start() + 1)
    return next((i for i in found if text[i] in "3456"), found[0] if found else None)


def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The pseudonym of a value that has the form of its kind; None if it is not valid."""
    return _WORK[kind](value, key)


def replace(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with pseudonyms, and (kind, start, end, pseudonym) of each, in code points of the
    original."""
    out, found, at = [], [], 0
    m = _PATTERN.search(text)
    while m:
        kind, end = next(k for k in KINDS if m[k] is not None), m.end()
        if kind == "iban":  # it may end before the match's last tokens
            end = m.start() + account_end(m[0])
        elif kind == "phone":  # it leaves a card number that begins in it whole
            card = _card_inside(text, m.start() + 1, end)
            if card is not None:
                m = _PATTERN.match(text, m.start(), card) or m
                end = m.end() if m.end() <= card else m.start()
                kind = next(k for k in KINDS if m[k] is not None)
        new = pseudonym(kind, text[m.start() : end], key) if end > m.start() else None
        if new is None:  # others may begin within the match
            m = _PATTERN.search(text, m.start() + 1)
            continue
        out += text[at : m.start()], new
        found.append((kind, m.start(), end, new))
        at = end
        m = _PATTERN.search(text, at)
    return "".join([*out, text[at:]]), found


def derived_key(secret: str) -> bytes:
    return hashlib.sha256(b"pseudonyms|" + secret.encode()).digest()


def pseudonymise(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """``docs`` with the text's personal data replaced, and pii: array of (kind, start, end,
    pseudonym), start and end in code points of the original text.

    Null texts stay null and empty ones empty, both with an empty pii. Every other column stays; a
    column named pii is replaced. Values that fail validation (dates that do not exist, addresses
    over 255, wrong check digits of accounts and cards) stay, and the search goes on inside them, so
    a valid value there is found. Texts without a digit or @ skip the search. No shuffle; each row
    by itself, so copies, ties and hot sources cost no more than their rows.
    """
    rows = docs.drop("pii") if "pii" in docs.columns else docs
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    key = derived_key(secret)
    maybe = re.compile(r"[0-9@]")

    def make():
        @functools.lru_cache(1)
        def nothing():
            return []

        def work(b):
            texts, found = [], []
            for t in b[text]:
                new, spans = replace(t, key) if t and maybe.search(t) else (t, nothing())
                texts.append(new)
                found.append([dict(zip(("kind", "start", "end", "pseudonym"), s)) for s in spans])
            return b | {text: texts, "pii": found}

        return work

    return map_batches(rows, make, f"{schema}, pii array<struct<kind:string,start:int,end:int,pseudonym:string>>")


def digests(replaced: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts by kind, the spans as text and the new text's digest."""
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    spans = F.array_join(F.transform("pii", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return replaced.select(key, *map(count, KINDS), spans.alias("spans"), F.sha2(text_of(text), 256).alias("text_sha256"), F.col(text))
