"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Values are found by pattern and kept only if they are valid (check digits, ranges, calendar).
Each valid value is a number in the finite set of its format, and a Feistel network with a keyed
round function permutes that set; numbers that leave the set are permuted again until they are
back inside. So a pseudonym has the same separators, letter case and check digits, and the same
length but for the numbers of IPv4 addresses and the names of months, and equal values get equal pseudonyms in all documents: they stay linked, with no table of values.

Kinds: payment cards (Luhn), IBANs (mod 97), social security numbers, telephone numbers, IPv4 and
IPv6 addresses, calendar dates (1900 to 2099, in digits or with an English month name), e-mail addresses,
access keys and secret strings.

Cards and IBANs may stand next to other digits or capitals: every admissible stretch between group
boundaries is validated and the longest valid one holds (an IBAN of its country's length before
others), then the rest is searched. Part of a longer row of digit groups is a card only if its groups,
the last aside, have four digits or more; other rows of small numbers would pass by chance.

Defined results: a null text stays null, with no spans; an empty one stays empty; invalid numbers
stay as they are; of overlapping finds the one that starts first, then the longer one, holds;
repeated rows get the same result; other columns pass through, and a column with the name of the
spans column is replaced. Whole texts of any length are read. An empty table stays empty.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import uuid
from bisect import bisect
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, functions as F

SPAN = "array<struct<kind:string,start:int,end:int,new_end:int>>"
ROUNDS = 10
STRETCH = 256
DIGITS, LOWER, UPPER, HEX, HEX_UPPER = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef", "0123456789ABCDEF",
)
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), 73049  # to 2099-12-31

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH = "|".join([*MONTHS, *(m[:3] for m in MONTHS), "sept"])
# Lengths by country; other countries' IBANs may have any length.
IBAN_LENGTHS = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS",
    23: "AE GI IL TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL",
    29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC",
}.items() for country in countries.split()}

PATTERNS = {
    "email": r"(?<![\w.+%'-])[\w.+%'-]*+(?<=[\w+%-])@[\w-]+(?:\.[\w-]+)+",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?=((?: ?[A-Z0-9]){11,30}))",
    "phone": r"(?<![\d.+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d])|(?<![\d+])\+\d(?:[ .()-]{0,2}\d){7,14}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d])(?!\.\d)",
    "ip6": r"(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{6,39}(?![\w:.])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\d/-])",
    "written": rf"(?i)(?<![\d./-])(?P<d>\d{{1,2}})(?:st|nd|rd|th)?\.?(?: of)?[ -](?P<m>{MONTH})\b\.?,?[ -](?P<y>\d{{4}})(?!\d)"
               rf"|\b(?P<m2>{MONTH})\b\.? (?P<d2>\d{{1,2}})(?:st|nd|rd|th)?,? (?P<y2>\d{{4}})(?!\d)",
    "key": r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9_])(?:gh[pousr]_|sk-|xox[abp]-)[A-Za-z0-9-]{16,}",
    "secret": r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,}(?![A-Za-z0-9])",
    "named": r"(?i)\b(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key)\b[^\w\n]{1,8}([A-Za-z0-9+/_-]{16,})",
}
FOUND = {kind: re.compile(p) for kind, p in PATTERNS.items()}
NUMERIC = ("card", "iban", "phone", "ssn", "ip", "ip6", "date", "written")
DIGIT = re.compile(r"\d")


def permuted(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a balanced Feistel network with cycle walking."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            mix = hashlib.shake_256(b"|".join((key, tweak.encode(), bytes([i]), str(half).encode(), right.to_bytes(width, "big"))))
            left, right = right, left ^ (int.from_bytes(mix.digest(width + 4), "big") & mask)
        value = left << half | right
        if value < size:
            return value


def swapped(text: str, key: bytes, tweak: str, hexadecimal: bool = False) -> str:
    """Digits, small and capital letters permuted inside their classes, other characters kept.

    Very long values are permuted in stretches, as the work grows with the square of a number's length.
    """
    if len(text) > STRETCH:
        return "".join(swapped(text[i:i + STRETCH], key, f"{tweak}@{i}", hexadecimal) for i in range(0, len(text), STRETCH))
    if hexadecimal:
        classes = [HEX_UPPER if any(c in "ABCDEF" for c in text) else HEX]
    else:
        classes = [DIGITS, LOWER, UPPER]
    sets = [next((s for s in classes if c in s), "") for c in text]
    size = value = 0
    size = 1
    for c, s in zip(text, sets):
        if s:
            value, size = value * len(s) + s.index(c), size * len(s)
    value = permuted(value, size, key, tweak + ":" + "".join(str(len(s)) + "," for s in sets))
    out = []
    for c, s in zip(reversed(text), reversed(sets)):
        if s:
            value, place = divmod(value, len(s))
            c = s[place]
        out.append(c)
    return "".join(reversed(out))


def luhn_digit(payload: str) -> str:
    """The check digit that makes payload + digit valid."""
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(payload)))
    return str(-total % 10)


def _refilled(text: str, new: str) -> str:
    """The letters and digits of `text` replaced by those of `new`, separators kept."""
    source = iter(new)
    return "".join(next(source) if c.isalnum() else c for c in text)


def _card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    payload = swapped(digits[:-1], key, "card")
    return _refilled(text, payload + luhn_digit(payload))


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    account = swapped(plain[4:], key, "iban" + plain[:2])
    return _refilled(text, plain[:2] + f"{98 - _iban_number(account + plain[:2] + '00') % 97:02d}" + account)


def _phone(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 8 <= len(digits) <= 15:
        return None
    # With and without a country prefix, the same ten digits get the same pseudonym.
    kept = len(digits) - 10 if len(digits) > 10 else 0
    return _refilled(text, digits[:kept] + swapped(digits[kept:], key, "phone"))


def _ssn_valid(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _ssn(text: str, key: bytes) -> str | None:
    digits = text.replace("-", "")
    if not _ssn_valid(digits):
        return None
    while True:
        digits = swapped(digits, key, "ssn")
        if _ssn_valid(digits):
            return _refilled(text, digits)


def _ip(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    number = permuted(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, number.to_bytes(4, "big")))


def _ip6(text: str, key: bytes) -> str | None:
    """Hexadecimal digits permuted; short forms keep their form."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return None
    return swapped(text, key, "ip6", hexadecimal=True) if sum(c != ":" for c in text) >= 4 and text in (text.lower(), text.upper()) else None


def _date(text: str, key: bytes) -> str | None:
    parts = re.split(r"\D", text)
    mark = re.sub(r"\d", "", text)[0]
    year_first = len(parts[0]) == 4
    # Day first unless only month first is a calendar date.
    for order in ([(0, 1, 2)] if year_first else [(2, 1, 0), (2, 0, 1)]):
        try:
            day = datetime.date(*(int(parts[i]) for i in order)).toordinal() - FIRST_DAY
        except ValueError:
            continue
        if not 0 <= day < DAYS:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + permuted(day, DAYS, key, "date"))
        out = [""] * 3
        for i, value in zip(order, (new.year, new.month, new.day)):
            out[i] = str(value).zfill(len(parts[i]))
        return mark.join(out)
    return None


def _written(text: str, key: bytes) -> str | None:
    m = FOUND["written"].fullmatch(text)
    names = ("d", "m", "y") if m["d"] else ("d2", "m2", "y2")
    day, name, year = (m[n] for n in names)
    month = next(i for i, full in enumerate(MONTHS, 1) if full.startswith(name.lower()[:3]))
    try:
        number = datetime.date(int(year), month, int(day)).toordinal() - FIRST_DAY
    except ValueError:
        return None
    if not 0 <= number < DAYS:
        return None
    new = datetime.date.fromordinal(FIRST_DAY + permuted(number, DAYS, key, "date"))
    word = MONTHS[new.month - 1] if name.lower() in MONTHS and name.lower() != "may" else MONTHS[new.month - 1][:3]
    word = word.upper() if name.isupper() else word if name.islower() else word.capitalize()
    put = dict(zip(names, (str(new.day).zfill(len(day)), word, str(new.year))))
    out, at = [], 0
    for n in sorted(names, key=m.start):
        out += [text[at:m.start(n)], put[n]]
        at = m.end(n)
    done = "".join([*out, text[at:]])
    suffix = "th" if 11 <= new.day <= 13 else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")
    return re.sub(r"(?i)(?<=\d)(?:st|nd|rd|th)\b", lambda o: suffix.upper() if o[0].isupper() else suffix, done)


def _email(text: str, key: bytes) -> str | None:
    local, host = text.split("@", 1)
    new = swapped(local, key, "email")
    if new == local:  # very short names; their host's labels take part as well
        name, _, top = host.rpartition(".")
        host = swapped(name, key, "host") + "." + top
    return f"{new}@{host}"


def _key(text: str, key: bytes) -> str | None:
    head = 4 if text[:4] in ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_") else text.index("-") + 1
    return text[:head] + swapped(text[head:], key, "key")


def _secret(text: str, key: bytes) -> str | None:
    mixed_kinds = any(c.isdigit() for c in text) and any(c.isalpha() for c in text)
    one_case = text in (text.lower(), text.upper())
    return swapped(text, key, "secret", hexadecimal=one_case and bool(re.fullmatch("[0-9a-fA-F]+", text))) if mixed_kinds else None


MAKE = {
    "email": _email, "card": _card, "iban": _iban, "phone": _phone, "ssn": _ssn, "ip": _ip, "ip6": _ip6, "date": _date, "written": _written,
    "key": _key, "secret": _secret, "named": _secret,
}


def _cards(text: str):
    """(start, end) of the valid cards in each row of digit groups: the longest first, then the first."""
    for m in FOUND["card"].finditer(text):
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in re.finditer(r"\d+", m[0])]
        before = [0, *accumulate(b - a for a, b in groups)]
        whole, valid = before[-1], []
        # The digits of an IBAN's form are no card, valid or not.
        head = text[max(0, m.start() - 2):m.start()] if groups[0][1] - groups[0][0] == 2 else ""
        inside = IBAN_LENGTHS.get(head, 0) - 2
        for i, (start, _) in enumerate(groups):
            n = 0
            if before[i] < inside:
                continue
            for j in range(i, len(groups)):
                a, end = groups[j]
                n += end - a
                if n > 19 or (j > i and whole > n and groups[j - 1][1] - groups[j - 1][0] < 4):
                    break
                if n < 13 or re.match(r"\.\d", text[end:end + 2]):
                    continue
                digits = re.sub(r"\D", "", text[start:end])
                if luhn_digit(digits[:-1]) == digits[-1]:
                    marks = {text[b] for _, b in groups[i:j]}
                    # A dash or slash around a number with other separators belongs to its neighbour, as in a date.
                    torn = (i > 0 and text[start - 1] == "-" and "-" not in marks) or (text[end:end + 1] in ("-", "/") and text[end] not in marks and text[end + 1:end + 2].isdigit())
                    valid.append((torn or len(marks) > 1, -n, start, end))
        taken: list[tuple[int, int]] = []  # apart from each other and in order
        for *_, start, end in sorted(valid):
            at = bisect(taken, (start, end))
            if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
                taken.insert(at, (start, end))
        yield from taken


def _ibans(text: str):
    """(start, end) of the IBAN at each place where one may begin."""
    for m in FOUND["iban"].finditer(text):
        tail, n, ends = m[1], 4, []
        for i, c in enumerate(tail):
            n += c != " "
            end = m.end() + i + 1
            if c != " " and n >= 15 and not re.match("[A-Za-z0-9]", text[end:end + 1]):
                ends.append((n != IBAN_LENGTHS.get(m[0][:2]), -n, end))
        for *_, end in sorted(ends):
            plain = text[m.start():end].replace(" ", "")
            if _iban_number(plain[4:] + plain[:4]) % 97 == 1:
                yield m.start(), end
                break


def finds(text: str):
    """(start, end, kind) of everything that has the form of a value."""
    kinds = ["email"] * ("@" in text)
    if DIGIT.search(text):
        kinds += [*NUMERIC, "secret", "named"]
    if "IA" in text or "_" in text or "-" in text:
        kinds.append("key")
    for kind in kinds:
        if kind in ("card", "iban"):
            yield from ((start, end, kind) for start, end in (_cards if kind == "card" else _ibans)(text))
            continue
        for m in FOUND[kind].finditer(text):
            start, end = m.span(1 if kind == "named" else 0)
            yield start, end, kind


def replaced(text: str | None, key: bytes, kinds=tuple(MAKE)) -> tuple[str | None, list[dict]]:
    """The text with pseudonyms and the spans of the values in the old text."""
    if not text:
        return text, []
    out, spans, at, length = [], [], 0, 0
    for start, end, kind in sorted(finds(text), key=lambda f: (f[0], -f[1], f[2])):
        if start < at or {"written": "date", "ip6": "ip"}.get(kind, kind) not in kinds:
            continue
        new = MAKE[kind](text[start:end], key)
        if new is None:
            continue
        out += [text[at:start], new]
        length += start - at + len(new)
        spans.append({"kind": {"named": "secret", "written": "date", "ip6": "ip"}.get(kind, kind), "start": start, "end": end, "new_end": length})
        at = end
    return ("".join([*out, text[at:]]) if spans else text), spans


def pseudonymised(
    docs: DataFrame, key: bytes, *, text_column: str = "text", spans_column: str = "pii_spans", kinds=tuple(MAKE)
) -> DataFrame:
    """`docs` with the values in the text column replaced, and where they stood."""

    @F.pandas_udf(f"text string, spans {SPAN}")
    def mask(texts: pd.Series) -> pd.DataFrame:
        done = [replaced(t, key, kinds) for t in texts]
        return pd.DataFrame({"text": [d[0] for d in done], "spans": [d[1] for d in done]}, dtype=object)

    held = f"_pii_{uuid.uuid4().hex}"
    masked = docs.withColumn(held, mask(F.col(text_column)))
    kept = [
        (F.col(f"{held}.text") if c == text_column else F.col(c)).alias(c) for c in docs.columns if c != spans_column
    ]
    return masked.select(*kept, F.col(f"{held}.spans").alias(spans_column))
