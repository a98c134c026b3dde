"""Personal data found place by place, from the rules in words; no code of the operator but the
permutation of a single value."""

from __future__ import annotations

import datetime
import re
import string

from trackloom.llm import pii

ALNUM = set(string.ascii_letters + string.digits)
DIGITS = set(string.digits)
MAIL = ALNUM | set("._%+-")
_PHONE = [
    re.compile(r"\+\d{1,3}[ .-]?(\(\d{1,4}\)[ .-]?)?\d{2,4}([ .-]?\d{2,4}){1,3}", re.A),
    re.compile(r"(\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}", re.A),
]


def at(t, i):
    return t[i] if 0 <= i < len(t) else ""


def luhn(digits):
    return sum(sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def mail(t, i):
    j = i
    while at(t, j) in MAIL and j < len(t):
        j += 1
    if at(t, i - 1) in MAIL and i or j == i or at(t, j) != "@":
        return None
    k = j + 1
    while k < len(t) and (t[k] in ALNUM or t[k] in "-."):
        k += 1
    for end in range(k, j + 1, -1):
        parts = t[j + 1 : end].split(".")
        if len(parts) > 1 and all(parts) and len(parts[-1]) > 1 and set(parts[-1]) <= set(string.ascii_letters):
            return end
    return None


def iban(t, i):
    if (i and t[i - 1] in ALNUM) or not (re.fullmatch("[A-Z]{2}[0-9]{2}", t[i : i + 4])):
        return None
    for end in range(min(len(t), i + 44), i + 11, -1):
        if at(t, end) in ALNUM and end < len(t):
            continue
        tokens = t[i:end]
        if re.fullmatch(r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?", tokens):
            s = tokens.replace(" ", "")
            if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
                return end
    return None


def ssn(t, i):
    m = re.match(r"(\d{3})-(\d\d)-(\d{4})", t[i : i + 11], re.A)
    if not m or at(t, i - 1) in (DIGITS | {"-"}) and i or (at(t, i + 11) in (DIGITS | {"-"}) and i + 11 < len(t)):
        return None
    a, g, s = map(int, m.groups())
    return i + 11 if a not in (0, 666) and a < 900 and g and s else None


def address(t, i):
    if i and t[i - 1] in DIGITS | {"."}:
        return None
    k, parts = i, []
    for n in range(4):
        j = k
        while j < len(t) and t[j] in DIGITS:
            j += 1
        if not 1 <= j - k <= 3:
            return None
        parts.append(int(t[k:j]))
        if n < 3 and at(t, j) != ".":
            return None
        k = j + 1
    if at(t, j) == "." and j + 1 < len(t) and t[j + 1] in DIGITS:
        return None
    return j if max(parts) < 256 else None


def date(t, i):
    if (i and t[i - 1] in DIGITS | {"."}) or (i + 10 < len(t) and t[i + 10] in DIGITS):
        return None
    for shape in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y"):
        v = t[i : i + 10]
        if len(v) == 10 and re.fullmatch(shape.replace(".", r"\.").replace("%Y", r"\d{4}").replace("%m", r"\d\d").replace("%d", r"\d\d"), v, re.A):
            try:
                return i + 10 if 1900 <= datetime.datetime.strptime(v, shape).year <= 2099 else None
            except ValueError:
                return None
    return None


def card(t, i):
    if i and t[i - 1] in ALNUM:
        return None
    # the first gap may differ from the others, which are alike
    for first in ("", " ", "-"):
        for sep in ("", " ", "-"):
            m = re.match(rf"\d{{4}}{first}\d{{4}}{sep}\d{{4}}{sep}\d+", t[i : i + 40], re.A)
            digits = re.sub(r"\D", "", m[0]) if m else ""
            if m and len(digits) <= 19 and not (i + len(m[0]) < len(t) and t[i + len(m[0])] in ALNUM):
                return i + len(m[0]) if luhn(digits) else None
    return None


def longest_phone(t, i, most):
    for k, shape in enumerate(_PHONE):
        if k and i and t[i - 1] in DIGITS:
            continue
        for end in range(min(most, i + 36), i, -1):
            if not (end < most and t[end] in DIGITS) and shape.fullmatch(t, i, end):
                return end
    return None


def phone(t, i):
    end = longest_phone(t, i, len(t))
    if end is None:
        return None
    inside = [j for j in range(i + 1, end) if card(t, j)]
    first = next((j for j in inside if t[j] in "3456"), inside[0] if inside else None)
    if first is not None:
        end = longest_phone(t, i, first)
    return end if end is not None and 10 <= sum(c in DIGITS for c in t[i:end]) <= 15 else None


FIND = {"mail": mail, "iban": iban, "ssn": ssn, "address": address, "date": date, "phone": phone, "card": card}


def spans(text):
    out, i = [], 0
    while i < len(text):
        if text[i] in MAIL or text[i] == "(":
            kind, end = next(((k, e) for k, f in FIND.items() if (e := f(text, i)) is not None), (None, None))
            if kind:
                out.append((kind, i, end))
                i = end
                continue
        i += 1
    return out


def replaced(text, key):
    out, last = [], 0
    for kind, a, b in spans(text):
        out += text[last:a], pii.pseudonym(kind, text[a:b], key)
        last = b
    return "".join([*out, text[last:]])
