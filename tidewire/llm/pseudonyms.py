"""Personal data as format-preserving pseudonyms of a keyed Feistel permutation.

A value is found by its format, validated (check digits, ranges, calendar), numbered
within the set of valid values of that format and moved by a permutation of that set.
So a card stays a valid card and a date a date, equal values stay equal in every
document, and who has the key can restore the text. Nothing is looked up or joined:
one narrow pass, the same on any executor.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.words import without

ROUNDS = 8
#: Letters and digits of a value that are moved as one number: half of it, at six bits
#: each, is well below the 64 bytes that are added to it.
BLOCK = 128
KINDS = ["email", "secret", "iban", "ip", "card", "ssn", "phone", "date"]
RESULT = ["n_found", "kinds"]
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE32 = UPPER + "234567"


class Permutation:
    """A keyed permutation of the numbers below any bound, and its inverse."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = hashlib.blake2b(key, digest_size=32).digest(), back

    def _noise(self, tweak: str, turn: int, half: int) -> int:
        said = f"{tweak}|{turn}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(said, key=self.key).digest(), "big")

    def _once(self, x: int, a: int, b: int, tweak: str) -> int:
        left, right = divmod(x, b)
        sign = -1 if self.back else 1
        for turn in reversed(range(ROUNDS)) if self.back else range(ROUNDS):
            if turn % 2:
                right = (right + sign * self._noise(tweak, turn, left)) % b
            else:
                left = (left + sign * self._noise(tweak, turn, right)) % a
        return left * b + right

    def move(self, x: int, bound: int, tweak: str, valid: Callable[[int], bool] = lambda _: True) -> int:
        """The image of x below ``bound``, walked on until it is a valid value again."""
        if bound < 2:
            return x
        a = math.isqrt(bound - 1) + 1
        b = -(-bound // a)
        while True:
            x = self._once(x, a, b, tweak)
            if x < bound and valid(x):
                return x

    def chars(
        self, text: str, alphabets: list[str], tweak: str, valid: Callable[[str], bool] = lambda _: True
    ) -> str:
        """``text`` moved within the valid strings of these alphabets, place by place."""
        x, bound = 0, 1
        for c, letters in zip(text, alphabets, strict=True):
            x, bound = x * len(letters) + letters.index(c), bound * len(letters)
        while True:
            x = rest = self.move(x, bound, f"{tweak}{bound}")
            out = []
            for letters in reversed(alphabets):
                rest, at = divmod(rest, len(letters))
                out.append(letters[at])
            moved = "".join(reversed(out))
            if valid(moved):
                return moved

    def alike(self, text: str, tweak: str) -> str:
        """Letters and digits moved within their class; all other characters stay.

        Long values go in blocks, forth and back: a block is moved under the digest of
        those before it, then of those behind it, so each depends on all.
        """
        at = [i for i, c in enumerate(text) if c in DIGITS or c in LOWER or c in UPPER]
        kinds = [next(s for s in (DIGITS, LOWER, UPPER) if text[i] in s) for i in at]
        chars = "".join(text[i] for i in at)
        if len(chars) <= BLOCK:
            return put(text, at, self.chars(chars, kinds, tweak))
        blocks = [chars[i : i + BLOCK] for i in range(0, len(chars), BLOCK)]
        classes = [kinds[i : i + BLOCK] for i in range(0, len(chars), BLOCK)]
        ways = [("forth", range(len(blocks))), ("back", range(len(blocks) - 1, -1, -1))]
        for name, way in reversed(ways) if self.back else ways:
            blocks = self._chained(blocks, classes, f"{tweak}|{name}|{len(chars)}", way)
        return put(text, at, "".join(blocks))

    def _chained(self, blocks: list[str], classes: list[list[str]], tweak: str, way: range) -> list[str]:
        chain, out = hashlib.blake2b(tweak.encode(), key=self.key), list(blocks)
        for i in way:
            out[i] = self.chars(blocks[i], classes[i], f"{tweak}|{i}|{chain.hexdigest()}")
            chain.update((blocks[i] if self.back else out[i]).encode())  # what stands in the moved text
        return out


def put(text: str, at: list[int], chars: str) -> str:
    out = list(text)
    for i, c in zip(at, chars, strict=True):
        out[i] = c
    return "".join(out)


def digit_places(text: str) -> list[int]:
    return [i for i, c in enumerate(text) if c in DIGITS]


def luhn_digit(payload: str) -> str:
    """The check digit that makes these digits and it valid."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def card(text: str, p: Permutation) -> str | None:
    at = digit_places(text)
    digits = "".join(text[i] for i in at)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or digits[0] == "0":
        return None
    inner = digits[0] + p.chars(digits[1:-1], [DIGITS] * (len(digits) - 2), "card" + digits[0])
    return put(text, at, inner + luhn_digit(inner))


def _iban_check(country: str, rest: str) -> str:
    number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - number % 97:02d}"


def iban(text: str, p: Permutation) -> str | None:
    at = [i for i, c in enumerate(text) if c != " "]
    whole = "".join(text[i] for i in at)
    country, check, rest = whole[:2], whole[2:4], whole[4:]
    if not 11 <= len(rest) <= 30 or _iban_check(country, rest) != check:
        return None
    rest = p.chars(rest, [DIGITS if c in DIGITS else UPPER for c in rest], "iban" + country)
    return put(text, at, country + _iban_check(country, rest) + rest)


def _public(x: int) -> bool:
    first, second = x >> 24, x >> 16 & 255
    reserved = first in (0, 10, 127) or first >= 224 or (first, second) in ((192, 168), (169, 254))
    return not reserved and not (first == 172 and 16 <= second < 32)


def ip(text: str, p: Permutation) -> str | None:
    parts = text.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    x = sum(int(v) << 8 * (3 - i) for i, v in enumerate(parts))
    if not _public(x):
        return None  # names no one outside its own network
    x = p.move(x, 1 << 32, "ip", _public)
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _ssn_valid(x: int) -> bool:
    area, rest = divmod(x, 1_000_000)
    group, serial = divmod(rest, 10_000)
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def ssn(text: str, p: Permutation) -> str | None:
    x = int(text.replace("-", ""))
    if not _ssn_valid(x):
        return None
    moved = f"{p.move(x, 10**9, 'ssn', _ssn_valid):09d}"
    return put(text, digit_places(text), moved)


def _national(x: int) -> bool:
    return x // 10**9 >= 2 and x // 10**6 % 10 >= 2


def phone(text: str, p: Permutation) -> str | None:
    """North American numbers within their valid ones, others digit by digit."""
    at = digit_places(text)
    digits = "".join(text[i] for i in at)
    lead = 0
    if text[0] == "+":
        lead = len(re.match(r"\+([0-9]{1,3})", text)[1]) if digits[0] != "1" else 1
    rest = digits[lead:]
    if not 7 <= len(rest) <= 14:
        return None
    if len(rest) == 10 and digits[:lead] in ("", "1"):
        if not _national(int(rest)):
            return None
        return put(text, at[lead:], f"{p.move(int(rest), 10**10, 'phone1', _national):010d}")
    if not lead:
        return None
    return put(text, at[lead:], p.chars(rest, [DIGITS] * len(rest), "phone" + digits[:lead]))


def day(text: str, p: Permutation) -> str | None:
    """A day of the calendar moved within its century, in its own way of writing."""
    parts = re.split(r"[-/.]", text)
    try:
        if len(parts[0]) == 4:
            order = (0, 1, 2)
            was = date(*[int(x) for x in parts])
        else:
            day_first = int(parts[1]) <= 12
            order = (2, 1, 0) if day_first else (2, 0, 1)
            was = date(*[int(parts[i]) for i in order])
    except ValueError:
        return None
    if was.year < 1000:
        return None
    century = was.year // 100 * 100
    low = date(century, 1, 1).toordinal()
    bound = date(century + 99, 12, 31).toordinal() - low + 1

    widths = [len(x) for x in parts]

    def written_alike(x: int) -> bool:
        """The same parts come first, and single digits stand where they stood."""
        found = date.fromordinal(low + x)
        values = dict(zip(order, (found.year, found.month, found.day), strict=True))
        single = 1 in widths
        return (order != (2, 0, 1) or found.day > 12) and not (
            single and any((widths[i] == 1) != (values[i] < 10) for i in range(3))
        )

    if not written_alike(was.toordinal() - low):
        return None
    new = date.fromordinal(low + p.move(was.toordinal() - low, bound, f"day{century}{order}{widths}", written_alike))
    values = dict(zip(order, (new.year, new.month, new.day), strict=True))
    sign = text[widths[0]]
    return sign.join(f"{values[i]:0{width}d}" for i, width in enumerate(widths))


def email(text: str, p: Permutation) -> str | None:
    local, _, host = text.rpartition("@")
    return p.alike(local, "email" + host.lower()) + "@" + host


def _numbered(value: str) -> bool:
    return any(c in DIGITS for c in value)


def secret(text: str, p: Permutation) -> str | None:
    """Access keys and the values of passwords and tokens, within their alphabet."""
    head = re.match(r"(AKIA|ASIA)|(?:.*?[=:]\s*[\"']?)", text, re.S)[0]
    value = text[len(head) :]
    if head in ("AKIA", "ASIA"):
        letters = BASE32 if all(c in BASE32 for c in value) else UPPER + DIGITS
        alike = lambda v: letters == BASE32 or not all(c in BASE32 for c in v)
        return head + p.chars(value, [letters] * len(value), "key", alike)
    if not _numbered(value):
        return None
    hexed = DIGITS + "abcdef"
    if all(c in hexed for c in value) and len(value) >= 8:
        return head + p.chars(value, [hexed] * len(value), "hex", _numbered)
    return head + p.alike(value, "word")


# Formats, in the order in which they are tried at a place of the text.
FORMATS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?[A-Za-z0-9_+/.~-]{6,}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])",
    "date": r"[0-9]{4}(?P<s1>[-/.])[0-9]{1,2}(?P=s1)[0-9]{1,2}(?![0-9])|[0-9]{1,2}(?P<s2>[-/.])[0-9]{1,2}(?P=s2)[0-9]{4}(?![0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"[0-9]{13,19}(?![0-9])|[0-9]{4}(?P<s5>[ -])[0-9]{4}(?P=s5)[0-9]{4}(?P=s5)[0-9]{4}(?![0-9])"
    r"|[0-9]{4}(?P<s6>[ -])[0-9]{6}(?P=s6)[0-9]{5}(?![0-9])",
    "phone": r"\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}(?![0-9])|\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])",
}
MOVES = {
    "email": email, "secret": secret, "iban": iban, "ip": ip, "date": day, "ssn": ssn, "card": card,
    "phone": phone,
}
NUMBERS = ("ip", "date", "ssn", "card", "phone")


def _any_format() -> re.Pattern:
    """Every format at the start of a word; numbers also right behind a letter or a sign."""
    words = "|".join(f"(?P<{k}>{v})" for k, v in FORMATS.items())
    numbers = "|".join(f"(?P<{k}_>{re.sub(r'\bs(?=[0-9]\b)', 't', FORMATS[k])})" for k in NUMBERS)
    return re.compile(f"(?<![A-Za-z0-9._%+-])(?:{words})|(?<![0-9])(?<![0-9][.])(?:{numbers})")


_MARKED = re.compile("[0-9@]|AKIA|ASIA")
_ANY = _any_format()


class Pseudonyms:
    """Finds and replaces; with ``back`` it restores what the same key replaced."""

    def __init__(self, key: bytes, back: bool = False):
        self.permutation = Permutation(key, back)
        self.moved = lru_cache(maxsize=1 << 16)(self._moved)

    def _moved(self, kind: str, value: str) -> str | None:
        return MOVES[kind](value, self.permutation)

    def replace(self, text: str) -> tuple[str, Counter]:
        found: Counter = Counter()
        if not _MARKED.search(text):
            return text, found
        out, done, at = [], 0, 0
        while m := _ANY.search(text, at):
            kind = next(k for k, v in m.groupdict().items() if v is not None and k.rstrip("_") in MOVES).rstrip("_")
            moved = self.moved(kind, m[0])
            if moved is None:  # not valid: another format may start inside
                at = m.start() + 1
                continue
            out += [text[done : m.start()], moved]
            found[kind] += 1
            done = at = m.end()
        return "".join(out) + text[done:], found


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", back: bool = False) -> DataFrame:
    """Every row with its text pseudonymised, ``n_found`` and ``kinds`` (kind to count).

    A null text stays null with nothing found. Copies of a row get equal results. Values
    that fail their validation stay as they are, as do addresses of private networks.
    Input columns named as a result give way to it; all others pass unchanged.
    """
    kept = without(docs, RESULT)
    names = kept.columns
    result = T.StructType([*kept.schema.fields]).add("n_found", "long").add("kinds", T.MapType(T.StringType(), T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = Pseudonyms(key, back)
        for batch in batches:
            texts, counts = [], []
            for value in batch.column(text).to_pylist():
                new, found = (None, Counter()) if value is None else moved.replace(value)
                texts.append(new)
                counts.append(found)
            columns = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names]
            columns += [
                pa.array([c.total() for c in counts], pa.int64()),
                pa.array([sorted(c.items()) for c in counts], pa.map_(pa.string(), pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in result.fields])

    return kept.mapInArrow(run, result)
