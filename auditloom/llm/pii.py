"""Format-preserving pseudonyms for personal data: keyed Feistel permutations within each format."""

import hashlib
import hmac
import re
from collections.abc import Callable
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

ROUNDS = 8
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
LOWER36 = "0123456789abcdefghijklmnopqrstuvwxyz"
CACHED_VALUES = 100_000


class Feistel:
    """A keyed permutation of the numbers below any size: a balanced Feistel network over an even number of bits,
    walked along its cycle until it comes back below size and, if asked for, to a valid number. That is a
    permutation of the valid numbers, so different values stay different and equal ones equal."""

    def __init__(self, key: bytes):
        self.key = key

    def permute(self, x: int, size: int, tweak: str, valid: Callable[[int], bool] | None = None) -> int:
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = x >> half, x & mask
            for k in range(ROUNDS):
                left, right = right, left ^ (self._round(tweak, size, k, right, half) & mask)
            x = left << half | right
            if x < size and (valid is None or valid(x)):
                return x

    def _round(self, tweak: str, size: int, k: int, value: int, half: int) -> int:
        said = f"{tweak}|{size}|{k}|{value}".encode()
        out = hmac.digest(self.key, said, "sha256")
        while 8 * len(out) < half:
            out += hmac.digest(self.key, said + out[-32:], "sha256")
        return int.from_bytes(out, "big")


def luhn_digit(body: str) -> str:
    """The check digit that makes body + digit pass the Luhn test."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_digits(country: str, bban: str) -> str:
    """The two check digits of an IBAN (mod 97)."""
    number = "".join(str(int(c, 36)) for c in (bban + country + "00").upper())
    return f"{98 - int(number) % 97:02d}"


def _fill(pattern: str, chars: str) -> str:
    """pattern with its letters and digits replaced by chars, in order; other characters stay."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in pattern)


def _radix(feistel: Feistel, text: str, alphabet: str, tweak: str) -> str:
    """A string over alphabet, permuted among those of its length."""
    n = len(alphabet)
    value = 0
    for c in text:
        value = value * n + alphabet.index(c)
    value = feistel.permute(value, n ** len(text), f"{tweak}{len(text)}")
    out = []
    for _ in text:
        value, r = divmod(value, n)
        out.append(alphabet[r])
    return "".join(reversed(out))


def _mixed(feistel: Feistel, text: str, tweak: str) -> str:
    """Digits among digits, small among small and capital among capital letters: the classes stay in place."""
    sizes = [10 if c.isdigit() else 26 for c in text]
    value = 0
    size = 1
    for c, n in zip(text, sizes, strict=True):
        value = value * n + (int(c) if n == 10 else ord(c.lower()) - 97)
        size *= n
    shape = "".join("9" if c.isdigit() else "a" if c.islower() else "A" for c in text)
    value = feistel.permute(value, size, f"{tweak}{shape}")
    out = []
    for c, n in zip(reversed(text), reversed(sizes), strict=True):
        value, r = divmod(value, n)
        out.append(str(r) if n == 10 else chr(r + (97 if c.islower() else 65)))
    return "".join(reversed(out))


def _card(f: Feistel, m: str) -> str | None:
    digits = re.sub(r"\D", "", m)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = digits[0] + _radix(f, digits[1:-1], "0123456789", "card")
    return _fill(m, body + luhn_digit(body))


def _iban(f: Feistel, m: str) -> str | None:
    plain = m.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_digits(plain[:2], plain[4:]) != plain[2:4]:
        return None
    bban = _mixed(f, plain[4:], "iban")
    return _fill(m, plain[:2] + iban_digits(plain[:2], bban) + bban)


def _phone(f: Feistel, m: str) -> str | None:
    head = re.match(r"\+\d{1,3}(?=\D)|", m).group()
    digits = re.sub(r"\D", "", m[len(head) :])
    if not 7 <= len(digits) <= 12 or (not head and len(digits) != 10):
        return None
    lead = digits[0] if digits[0] in "01" else ""
    rest = digits[len(lead) :]
    first = "" if lead else "23456789"
    if first:  # a subscriber or area code doesn't begin with 0 or 1
        value = f.permute((int(rest[0]) - 2) * 10 ** (len(rest) - 1) + int(rest[1:]), 8 * 10 ** (len(rest) - 1), f"phone{len(rest)}")
        rest = str(value + 2 * 10 ** (len(rest) - 1))
    else:
        rest = _radix(f, rest, "0123456789", "phone")
    return head + _fill(m[len(head) :], lead + rest)


def _ssn(f: Feistel, m: str) -> str | None:
    def valid(x: int) -> bool:
        area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    x = int(m.replace("-", ""))
    return _fill(m, f"{f.permute(x, 10**9, 'ssn', valid):09d}") if valid(x) else None


def _ip(f: Feistel, m: str) -> str | None:
    parts = m.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(f: Feistel, m: str) -> str | None:
    """Day-first dates, and those with the year first, are permuted among all dates; month-first ones that can't be
    read day-first among the dates whose day is over 12, which can't either. So no two strings of a format meet."""
    a, mark, b, _, c = re.match(r"(\d+)(\D)(\d+)(\D)(\d+)", m).groups()
    orders = [("y", "m", "d")] if len(a) == 4 else [("d", "m", "y"), ("m", "d", "y")]
    for order in orders:
        part = dict(zip(order, map(int, (a, b, c)), strict=True))
        try:
            day = date(part["y"], part["m"], part["d"]).toordinal()
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            days = LAST_DAY - FIRST_DAY + 1
            if order[0] == "m":
                moved = f.permute(day - FIRST_DAY, days, "month-first", lambda x: date.fromordinal(FIRST_DAY + x).day > 12)
            else:
                moved = f.permute(day - FIRST_DAY, days, "date")
            new = date.fromordinal(FIRST_DAY + moved)
            value = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
            return mark.join(value[k] for k in order)
    return None


def _recased(text: str, like: str) -> str:
    return "".join(c.upper() if o.isupper() else c for c, o in zip(text, like, strict=True))


def _email(f: Feistel, m: str) -> str | None:
    """The permutation doesn't see capitals, so an address keeps its pseudonym however it is written; they are put back."""
    local, _, domain = m.rpartition("@")
    host, dot, end = domain.rpartition(".")
    plain = "".join(c for c in local if c.isalnum())
    hidden = "".join(c for c in host if c.isalnum())
    moved, other = _recased(_mixed(f, plain.lower(), "email"), plain), _recased(_mixed(f, hidden.lower(), "host"), hidden)
    return _fill(local, moved) + "@" + _fill(host, other) + dot + end


def _key(f: Feistel, m: str) -> str | None:
    return m[:4] + _radix(f, m[4:].lower(), LOWER36, "key").upper()


def _secret(f: Feistel, m: str) -> str | None:
    head = re.match(r"[^=:]*[=:]\s*[\"']?", m).group()
    return head + _fill(m[len(head) :], _mixed(f, "".join(c for c in m[len(head) :] if c.isalnum()), "secret"))


# The registered lengths of IBANs
IBAN_LENGTHS = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in cs.split()}
BREAK = re.compile(r"(?<=\w)(?=[ .-])")


def _shorter(kind: str, match: str) -> list[str]:
    """What to try of a match: all of it, then what ends at each break before, longest first, as words behind a value can
    look like a part of it. Of an IBAN, the one that has its country's length comes first."""
    if kind not in ("iban", "phone"):
        return [match]
    ends = [match] + [match[: m.start()] for m in reversed(list(BREAK.finditer(match)))]
    return sorted(ends, key=lambda v: len(v.replace(" ", "")) != IBAN_LENGTHS.get(v[:2])) if kind == "iban" else ends


#: Kind, pattern, and what validates a match and gives its pseudonym; tried in this order at each place.
KINDS: tuple[tuple[str, str, Callable], ...] = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])", _email),
    ("key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", _key),
    ("secret", r"(?<![A-Za-z])(?:password|passwd|token|secret|api_?key)\s?[=:]\s?[\"']?[A-Za-z0-9]{8,128}(?![A-Za-z0-9])", _secret),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("date", r"(?<![\w.\-/])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})(?![\w\-/]|\.\d)", _date),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", _ip),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _ssn),
    ("card", r"(?<![\w-])(?:\d{13,19}|\d{4}(?P<mark>[ -])\d{4}(?P=mark)\d{4}(?P=mark)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])", _card),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])|(?<![\w+])\+\d{1,3} ?\d{7,12}(?!\w)|(?<![\w+])\+\d{1,3}[ .-]\d{1,4}(?:[ .-]\d{2,4}){2,5}(?![\w-])|(?<![\w+.\-/])0\d(?:[ .-]\d{2}){4}(?![\w-])", _phone),
)
NUMBERS = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern, _ in KINDS if kind not in ("email", "key", "secret")), re.ASCII)
WORDS = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern, _ in KINDS if kind in ("email", "key", "secret")), re.ASCII)
HINT = re.compile(r"@|AKIA|ASIA|[=:]")
DIGIT_RUN = re.compile(r"\d[\d().\-/ +]*\d", re.ASCII)
MAKERS = {kind: maker for kind, _, maker in KINDS}


class Pseudonymiser:
    def __init__(self, key: bytes):
        self.feistel, self.known = Feistel(key), {}

    def _value(self, kind: str, value: str) -> str | None:
        if (kind, value) not in self.known:
            if len(self.known) >= CACHED_VALUES:
                self.known.clear()
            self.known[kind, value] = MAKERS[kind](self.feistel, value)
        return self.known[kind, value]

    def _found(self, pattern: re.Pattern, text: str) -> list[tuple[int, int, str, str]]:
        """Validated matches with their pseudonyms; after one that fails at every end, the search goes on right behind its start."""
        found, at = [], 0
        while m := pattern.search(text, at):
            kind = next(k for k in MAKERS if k in m.re.groupindex and m.group(k) is not None)
            at = m.start() + 1
            for value in _shorter(kind, m.group()):
                if (new := self._value(kind, value)) is not None:
                    at = m.start() + len(value)
                    found.append((m.start(), at, kind, new))
                    break
        return found

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each in the new text, in characters."""
        matches = []
        if HINT.search(text):
            matches += self._found(WORDS, text)
        if DIGIT_RUN.search(text):
            matches += self._found(NUMBERS, text)
        out, spans, at, length = [], [], 0, 0
        for start, end, kind, new in sorted(matches, key=lambda m: (m[0], -m[1])):
            if start < at:
                continue
            out += [text[at:start], new]
            length += start - at
            spans.append((kind, length, length + len(new)))
            length += len(new)
            at = end
        return "".join([*out, text[at:]]), spans


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """docs with pseudonyms in text_col and their places in the new text in spans_col.

    Replaced are: payment card numbers (13 to 19 digits that pass the Luhn test; the first digit stays, the new number
    passes it too), IBANs (mod 97, before and after), phone numbers, social security numbers and IPv4 addresses in
    their valid ranges, calendar dates from 1900 to 2099, mail addresses, access keys, and values assigned to a password
    or token. Separators, lengths and character classes stay. Each kind has one keyed permutation, so a value has the
    same pseudonym in every document, and two values of one format have two; mail addresses are equal whatever the size of
    their letters. What fails validation stays as it is. A null text stays
    null, with null spans; empty texts have none; repeated rows change alike; an empty table stays empty. A column
    of docs named spans_col is replaced.
    """

    @pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", SPAN)]))
    def change(texts: pd.Series) -> pd.DataFrame:
        worker = Pseudonymiser(key)
        done = [(None, None) if t is None else worker.replace(t) for t in texts]
        return pd.DataFrame({"text": [d[0] for d in done], "spans": [None if d[1] is None else [{"kind": k, "start": a, "end": b} for k, a, b in d[1]] for d in done]})

    def at(name: str) -> Column:
        return F.col(f"`{name}`")

    rest = [c for c in docs.columns if c != spans_col]
    changed = docs.select(F.struct(*(at(c) for c in rest)).alias("_doc"), change(at(text_col)).alias("_new"))
    return changed.select(*(F.col("_new.text").alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c) for c in rest), F.col("_new.spans").alias(spans_col))


def key_from(secret: str) -> bytes:
    return hashlib.sha256(secret.encode()).digest()
