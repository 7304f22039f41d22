"""Format-preserving pseudonyms for personal data.

Numbers, dates, addresses and secrets are found by pattern, validated (check
digits, calendar, number plans) and replaced by a keyed permutation within
their format: digits stay digits, letters letters, separators stay where they
are, check digits are right again and dates are dates. The permutation depends
on the value alone, so equal values stay equal across documents and runs.

What fits a pattern but isn't valid is tried again with fewer of its groups,
then as the other kinds, then from its next group on; so a valid number is
found beside digits or capitals that aren't part of it.

The permutation: a value is a number in a mixed-radix domain; a keyed Feistel
network with cycle walking permutes the domain (E), and E, one step on, and E
undone is a permutation without a fixed point. So no value stays as it was.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
import string
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import small

HALF_ROUNDS = 8
#: Characters that are permuted together; longer values take several blocks.
BLOCK = 128
KINDS = ("email", "iban", "secret", "ip", "date", "ssn", "card", "phone")


def feistel(x: int, size: int, key: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size)."""
    bits = max(1, -(-(size - 1).bit_length() // 2))
    mask, width = (1 << bits) - 1, -(-bits // 8)
    while True:
        left, right = x >> bits, x & mask
        for r in reversed(range(HALF_ROUNDS)) if back else range(HALF_ROUNDS):
            if back:
                left, right = right, left
            digest = hashlib.blake2b(bytes([r]) + right.to_bytes(width, "big"), key=key, digest_size=min(64, width + 8)).digest()
            left ^= int.from_bytes(digest, "big") & mask
            if not back:
                left, right = right, left
        x = left << bits | right
        if x < size:
            return x


def derange(x: int, size: int, key: bytes) -> int:
    """Like feistel, but no x maps to itself (if there are two values at least)."""
    return x if size < 2 else feistel((feistel(x, size, key) + 1) % size, size, key, back=True)


def permute(digits: list[int], radices: list[int], key: bytes) -> list[int]:
    x = 0
    for d, r in zip(digits, radices):
        x = x * r + d
    x = derange(x, math.prod(radices), key)
    out = []
    for r in reversed(radices):
        x, d = divmod(x, r)
        out.append(d)
    return out[::-1]


def characters(text: str, key: bytes) -> str:
    """Permute digits, small and capital letters within their own kinds, ``BLOCK`` of them at a time."""
    classes = [c for c in (string.digits, string.ascii_lowercase, string.ascii_uppercase)]
    at = [(k, next(c for c in classes if ch in c)) for k, ch in enumerate(text) if ch.isascii() and ch.isalnum()]
    new = list(text)
    for n in range(0, len(at), BLOCK):
        part = at[n : n + BLOCK]
        # The first block has the key itself, each further one a key of its own.
        own = hashlib.blake2b(n.to_bytes(8, "big"), key=key, digest_size=32).digest() if n else key
        for (k, c), d in zip(part, permute([c.index(text[k]) for k, c in part], [len(c) for _, c in part], own)):
            new[k] = c[d]
    return "".join(new)


def spread(text: str, digits: list[int]) -> str:
    """``text`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(str(next(it)) if c.isdigit() else c for c in text)


def digits_of(text: str) -> list[int]:
    return [int(c) for c in text if c.isdigit()]


def luhn(digits: list[int]) -> int:
    """The sum that must be a multiple of ten."""
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))


def email(text: str, key: bytes) -> str | None:
    local, _, domain = text.rpartition("@")
    name, _, top = domain.rpartition(".")
    return f"{characters(local, key)}@{characters(name, key)}.{top}"


def iban(text: str, key: bytes) -> str | None:
    bare = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(bare) <= 34 or number(bare[4:] + bare[:4]) % 97 != 1:
        return None
    body = characters(bare[4:], key)
    it = iter(f"{bare[:2]}{98 - number(body + bare[:2] + '00') % 97:02d}{body}")
    return "".join(c if c == " " else next(it) for c in text)


def secret(text: str, key: bytes) -> str | None:
    if re.fullmatch("[0-9a-fA-F]+", text):
        if not (re.search("[0-9]", text) and re.search("[a-fA-F]", text)):
            return None
        kinds = ["0123456789abcdef" if text == text.lower() else "0123456789ABCDEF"] * len(text)
        chars = text if text in (text.lower(), text.upper()) else text.upper()
        return "".join(kinds[0][d] for d in permute([kinds[0].index(c) for c in chars], [16] * len(text), key))
    head = re.match("AKIA|gh[pousr]_|github_pat_|sk-|xox[a-z]-|AIza", text).group()
    return head + characters(text[len(head) :], key)


def ip(text: str, key: bytes) -> str | None:
    parts = [int(p) for p in text.split(".")]
    return ".".join(map(str, permute(parts, [256] * 4, key))) if max(parts) < 256 else None


FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def date(text: str, key: bytes) -> str | None:
    """Year first, or day (else month) first; the order and the separators stay."""
    a, s, b, _, c = re.split(r"([-/.])", text)
    orders = ["ymd"] if len(a) == 4 else ["dmy", "mdy"]
    for order in orders:
        part = dict(zip(order, (a, b, c)))
        try:
            day = dt.date(int(part["y"]), int(part["m"]), int(part["d"])).toordinal()
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            new = dt.date.fromordinal(FIRST_DAY + derange(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key))
            shown = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
            return s.join(shown[k] for k in order)
    return None


AREAS = [a for a in range(1, 900) if a != 666]


def ssn(text: str, key: bytes) -> str | None:
    area, group, serial = (int(text[:3]), int(text[4:6]), int(text[7:]))
    if area not in AREAS or not group or not serial:
        return None
    a, g, n = permute([AREAS.index(area), group - 1, serial - 1], [len(AREAS), 99, 9999], key)
    return f"{AREAS[a]:03d}{text[3]}{g + 1:02d}{text[6]}{n + 1:04d}"


def card(text: str, key: bytes) -> str | None:
    d = digits_of(text)
    if not 13 <= len(d) <= 19 or d[0] == 0 or luhn(d) % 10:
        return None
    new = permute([d[0] - 1, *d[1:-1]], [9] + [10] * (len(d) - 2), key)
    new[0] += 1
    return spread(text, [*new, -luhn([*new, 0]) % 10])


def phone(text: str, key: bytes) -> str | None:
    d = digits_of(text)
    if not 10 <= len(d) <= 15:
        return None
    head = len(d) - 10 if text.startswith("+") or len(d) == 11 else 0
    own = d[head:]
    # North American area and exchange codes don't begin with 0 or 1.
    codes = (0, 3) if head < 2 and len(own) == 10 and own[0] > 1 and own[3] > 1 else ()
    low = [2 if k in codes else 0 for k in range(len(own))]
    new = permute([x - b for x, b in zip(own, low)], [10 - b for b in low], key)
    return spread(text, [*d[:head], *(x + b for x, b in zip(new, low))])


#: An address is tried once for each run of the characters that it may begin
#: with, and all else has a bounded length or begins at a border, so long unbroken
#: texts take time in proportion to their length. Digits are ASCII digits.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[._%+\-]*[A-Za-z0-9][A-Za-z0-9._%+\-]*@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|(?:gh[pousr]_|github_pat_|sk-|xox[a-z]-|AIza)[A-Za-z0-9_\-]{16,})(?![A-Za-z0-9])",
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}(?![A-Za-z0-9]|\.\d)",
    "date": r"(?:\d{4}(?:-\d{2}-|/\d{2}/|\.\d{2}\.)\d{2}|\d{1,2}(?:-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)\d{4})(?![A-Za-z0-9]|[-/.]\d)",
    "ssn": r"\d{3}[- ]\d{2}[- ]\d{4}(?![A-Za-z0-9]|-\d)",
    "card": r"\d(?:[ -]?\d){12,18}(?![A-Za-z0-9])",
    "phone": r"(?:\+\d(?:[ .()-]{0,2}\d){9,14}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![A-Za-z0-9]|-\d)",
}
#: Where something may begin, and the kind and end to be tried first.
FIND = re.compile(f"(?P<email>{PATTERNS['email']})|(?<![A-Za-z0-9])(?:" + "|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items() if k != "email") + ")", re.ASCII)
ONE = {k: re.compile(v if k == "email" else f"(?<![A-Za-z0-9]){v}", re.ASCII) for k, v in PATTERNS.items()}
#: Kinds that may have taken in groups of what follows them.
GROUPED = ("iban", "card", "phone")
#: Characters of an IBAN by country.
IBAN_SIZES = {
    c: n
    for n, names in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
    for c in names.split()
}
#: Texts without these hold nothing to find.
MAYBE = re.compile(r"[0-9@]|AKIA|AIza|gh[pousr]_|github_pat_|sk-|xox[a-z]-")


def ends(kind: str, text: str, start: int, end: int) -> list[int]:
    """Where a match may end: as found, then at the borders of its groups from the last back; an IBAN of its country's size first."""
    if kind not in GROUPED:
        return [end]
    out = [end, *(k for k in range(end - 1, start, -1) if text[k] in " .-" and text[k - 1] not in " .-")]
    if kind == "card":
        out = [k for k in out if k - start >= 13]  # it has 13 digits at least
    if kind == "iban":
        own = IBAN_SIZES.get(text[start : start + 2])
        out.sort(key=lambda k: k - start - text.count(" ", start, k) != own)
    return out


MAKERS: dict[str, Callable[[str, bytes], str | None]] = {"email": email, "iban": iban, "secret": secret, "ip": ip, "date": date, "ssn": ssn, "card": card, "phone": phone}


class Pseudonyms:
    def __init__(self, key: bytes):
        self.keys = {k: hashlib.blake2b(k.encode(), key=key, digest_size=32).digest() for k in KINDS}
        self.of = lru_cache(maxsize=50_000)(lambda kind, value: MAKERS[kind](value, self.keys[kind]))

    def replace(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        """The text with pseudonyms, and how many of each kind."""
        counts = dict.fromkeys(KINDS, 0)
        if not text or not MAYBE.search(text):
            return text, counts

        out, done, m = [], 0, FIND.search(text)
        while m:
            start = m.start()
            kind, end, new = self.at(text, m)
            if new is not None:
                counts[kind] += 1
                out += [text[done:start], new]
                done = end
            # Behind what isn't valid another value may begin at the next group.
            m = FIND.search(text, start + 1 if new is None else end)
        return "".join([*out, text[done:]]) if out else text, counts

    def at(self, text: str, m: re.Match) -> tuple[str, int, str | None]:
        """Kind, end and pseudonym of the first valid value where ``m`` begins."""
        start = m.start()
        for kind in KINDS[KINDS.index(m.lastgroup) :]:
            tried = m if kind == m.lastgroup else ONE[kind].match(text, start)
            for end in ends(kind, text, start, tried.end()) if tried else ():
                new = self.of(kind, text[start:end])
                if new is not None:
                    return kind, end, new
        return m.lastgroup, m.end(), None


def pseudonymise(docs: DataFrame, key: bytes, with_counts: bool = True) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; ``with_counts`` adds ``n_email`` and so on.

    Null texts stay null. Rows without personal data come out as they were.
    All other columns stay; ones named like the added counts are replaced. The
    work is one Arrow pass without a shuffle.
    """
    added = [f"n_{k}" for k in KINDS] if with_counts else []
    docs = docs.drop(*added)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key)
        for b in small(batches):
            got = [own.replace(t) for t in b["text"].to_pylist()]
            columns = [pa.array([t for t, _ in got], pa.string()) if n == "text" else b[n] for n in names]
            columns += [pa.array([c[k[2:]] for _, c in got], pa.int32()) for k in added]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    schema = StructType(list(docs.schema.fields))
    for name in added:
        schema = schema.add(name, "integer")
    return docs.mapInArrow(run, schema)
