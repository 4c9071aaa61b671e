"""Format-preserving pseudonyms for personal data.

A value that passes its validation (check digits, calendar, ranges) is read as
a number below the count of all values of its format, that number goes through
a keyed Feistel permutation of exactly this range, and the result is written
in the same format.  So a card number stays a card number with a right check
digit, a date a date, and equal values become equal pseudonyms in every
document.  With the key the permutation can be undone.

Kinds: card numbers (13 to 19 digits, Luhn), IBANs (mod 97), social security
numbers, IPv4 addresses, international phone numbers, dates from 1900 to 2099
in ISO or point, slash and dash forms, the local part of e-mail addresses, and
hexadecimal keys.  Numbers that fail validation stay as they are.

Cards, IBANs and phones may run on into what stands behind them: where the
whole run fails its check, its groups are tried as the value's end and then as
its start; a card is then one group, groups of four or more digits but for the
last, or 16 single digits, so that tables of small numbers stay.  If a pseudonym would be read with other bounds than its value, the
permutation is applied again, so that undoing finds the same places.

A null text stays null and an empty one empty, with no replacements.  Repeated
rows get equal results.  Extra columns pass only if named in ``carry``.
"""

from __future__ import annotations

import datetime
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.store import small_batches

#: Only for trials; a real run passes a secret of its own.
TRIAL_KEY = b"not a secret: for trials only"
ROUNDS = 8
KINDS = ("email", "ip", "phone", "ssn", "card", "iban", "date", "key")

# Each pattern starts at the edge of a run of its characters, so scanning stays linear in the text.
_PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z0-9-]*[A-Za-z0-9])"
    r"|(?P<key>(?<![A-Za-z0-9])(?:[0-9a-f]{64}|[0-9A-F]{64}|[0-9a-f]{40}|[0-9A-F]{40}|[0-9a-f]{32}|[0-9A-F]{32})(?![A-Za-z0-9]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))"
    r"|(?P<date>(?<![\d./-])(?:\d{4}(?P<s>[./-])\d{2}(?P=s)\d{2}|\d{2}(?P<t>[./-])\d{2}(?P=t)\d{4})(?!\d|[./-]\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?!\d|-\d))"
    r"|(?P<card>(?<![\d-])\d(?:[ -]?\d){12,18}(?!\d|-\d))")
_MAYBE = re.compile(r"[0-9@]")
_GROUP = re.compile(r"[A-Za-z0-9]+")
#: Kinds whose pattern may take in more than the value.
_LOOSE = ("card", "iban", "phone")
#: Digits of a card in the order in which a run is read: the usual lengths first, so that what follows does not matter.
_CARD_SIZES = (16, 15, 14, 19, 18, 17, 13)
#: Signs of a country's IBAN, by the registry.
_IBAN_SIZES = {c: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in countries.split()}
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_AREAS = [a for a in range(1, 900) if a != 666]


class Permutation:
    """Keyed permutations of the numbers below any bound."""

    def __init__(self, key: bytes, undo: bool = False):
        self._key, self._undo = hashlib.blake2b(key, digest_size=32).digest(), undo

    def _round(self, tweak: bytes, number: int, value: int, bits: int) -> int:
        size = (bits + 7) // 8
        text = number.to_bytes(1, "big") + value.to_bytes(size, "big") + tweak
        out = b""
        while len(out) < size:
            out += hashlib.blake2b(text, digest_size=64, key=self._key, salt=len(out).to_bytes(4, "big")).digest()
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def __call__(self, value: int, bound: int, tweak: str) -> int:
        """The partner of ``value`` below ``bound``; walks on while the network's result is outside."""
        if bound < 2:
            return value
        half = max(1, ((bound - 1).bit_length() + 1) // 2)
        mask, label = (1 << half) - 1, f"{tweak}:{bound}".encode()
        while True:
            left, right = value >> half, value & mask
            if self._undo:
                for r in reversed(range(ROUNDS)):
                    left, right = right ^ self._round(label, r, left, half), left
            else:
                for r in range(ROUNDS):
                    left, right = right, left ^ self._round(label, r, right, half)
            value = left << half | right
            if value < bound:
                return value


def luhn(digits: str) -> int:
    """The check digit that belongs behind ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _mixed(text: str, permute: Permutation, tweak: str) -> str:
    """Digits to digits and letters to letters; equal up to case gives equal up to case."""
    sizes = [10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 0 for c in text]
    value, bound = 0, 1
    for c, n in zip(text, sizes, strict=True):
        if n:
            value, bound = value * n + (ord(c.lower()) - (97 if n == 26 else 48)), bound * n
    shape = "".join({0: c, 10: "9", 26: "a"}[n] for c, n in zip(text, sizes, strict=True))
    value, out = permute(value, bound, f"{tweak}:{shape}"), []
    for c, n in zip(reversed(text), reversed(sizes), strict=True):
        if not n:
            out.append(c)
            continue
        value, d = divmod(value, n)
        new = chr(d + (97 if n == 26 else 48))
        out.append(new.upper() if c.isupper() else new)
    return "".join(reversed(out))


def _into(shape: str, signs: str) -> str:
    """``signs`` put at the places of ``shape`` that hold letters or digits."""
    left = iter(signs)
    return "".join(next(left) if c.isalnum() else c for c in shape)


def _card(text: str, permute: Permutation) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = _mixed(digits[:-1], permute, "card")
    return _into(text, body + str(luhn(body)))


def _iban(text: str, permute: Permutation) -> str | None:
    signs = text.replace(" ", "")
    if _iban_check(signs[:2], signs[4:]) != int(signs[2:4]):
        return None
    body = _mixed(signs[4:], permute, "iban")
    return _into(text, f"{signs[:2]}{_iban_check(signs[:2], body):02d}{body}")


def _ip(text: str, permute: Permutation) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _phone(text: str, permute: Permutation) -> str | None:
    country = re.match(r"\+\d+", text)[0]
    if not 7 <= len(re.sub(r"\D", "", text[len(country):])) or len(re.sub(r"\D", "", text)) > 15:
        return None
    rest = text[len(country):]
    return country + _into(rest, _mixed(re.sub(r"\D", "", rest), permute, f"phone:{country}"))


def _ssn(text: str, permute: Permutation) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area not in _AREAS or not group or not serial:
        return None
    value = permute((_AREAS.index(area) * 99 + group - 1) * 9999 + serial - 1, len(_AREAS) * 99 * 9999, "ssn")
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    return f"{_AREAS[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _date(text: str, permute: Permutation) -> str | None:
    """Day before month where both readings are dates; the pseudonym is read the same way again."""
    sign = re.search(r"\D", text)[0]
    a, b, c = map(int, text.split(sign))
    first = text.index(sign) == 4
    order = "ymd" if first else "dmy" if b <= 12 else "mdy"
    year, month, day = (a, b, c) if order == "ymd" else (c, b, a) if order == "dmy" else (c, a, b)
    try:
        value = datetime.date(year, month, day).toordinal()
    except ValueError:
        return None
    if not _FIRST <= value <= _LAST:
        return None
    while True:
        value = _FIRST + permute(value - _FIRST, _LAST - _FIRST + 1, "date")
        new = datetime.date.fromordinal(value)
        # A month-first date stays one only while its day is above 12.
        if order != "mdy" or new.day > 12:
            break
    y, m, d = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
    return sign.join({"ymd": (y, m, d), "dmy": (d, m, y), "mdy": (m, d, y)}[order])


def _key(text: str, permute: Permutation) -> str | None:
    low = text.lower()
    if low.isdigit() or low.isalpha():
        return None
    value = permute(int(low, 16), 16 ** len(low), "key")
    new = f"{value:0{len(low)}x}"
    return new.upper() if text.isupper() else new


def _email(text: str, permute: Permutation) -> str | None:
    local, _, domain = text.rpartition("@")
    return f"{_mixed(local, permute, 'email:' + domain.lower())}@{domain}"


_MAKE = {"email": _email, "ip": _ip, "phone": _phone, "ssn": _ssn, "card": _card, "iban": _iban, "date": _date, "key": _key}


_TWICE = {str(d): 2 * d - 9 * (d > 4) for d in range(10)}


def _valid(kind: str, text: str) -> bool:
    if kind == "card":  # many are tried
        digits = text.replace(" ", "").replace("-", "")
        return (sum(map(int, digits[::-2])) + sum(map(_TWICE.__getitem__, digits[-2::-2]))) % 10 == 0 and len(set(digits)) > 1
    return _MAKE[kind](text, lambda value, bound, tweak: value) is not None


def _ends(kind: str, text: str, inner: bool) -> list[int]:
    """Where the value at the start of a match may end, by its groups, in the order of trial; ``inner`` ones begin in a failed run."""
    if kind not in _LOOSE:
        return [len(text)]
    at, size, least, most = {}, 0, 99, 0
    for group in _GROUP.finditer(text):
        n = len(group[0])
        size, most = size + n, max(most, n)
        if kind != "card" or least >= 4 or not inner and (group.end() == len(text) or size == 16 and most == 1):
            at[size] = group.end()
        least = min(least, n)
    if kind == "card":
        return [at[n] for n in _CARD_SIZES if n in at]
    if kind == "phone":
        return [at[n] for n in reversed(at)]
    n = _IBAN_SIZES.get(text[:2])
    return ([at[n]] if n in at else []) + [at[k] for k in reversed(at) if k == size or (n is None and k >= 15)]


def _find(text: str, at: int) -> tuple[int, int, str, int] | None:
    """Bounds and kind of the first value from ``at`` on, and the start of the failed runs that reach into it."""
    first = reach = at
    while match := _PATTERN.search(text, at):
        kind = match.lastgroup if match.lastgroup in _MAKE else "date"
        start = match.start()
        if start >= reach:
            first = start
        for end in _ends(kind, match[0], start < reach):
            if _valid(kind, match[0][:end]):
                return start, start + end, kind, first
        at = match.end()
        if kind in _LOOSE:
            reach, at = max(reach, at), _GROUP.search(text, start).end()
    return None


def replace(text: str, permute: Permutation) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind were put in."""
    found: dict[str, int] = {}
    if not _MAYBE.search(text):
        return text, found
    out, at = [], 0
    while place := _find(text, at):
        start, end, kind, first = place
        made = _MAKE[kind](text[start:end], permute)
        if kind in _LOOSE or first < start:
            # Read with what stands around it, the pseudonym must have the bounds of the value.
            low = max(first - 1, 0)
            before, after = text[low:start], text[end:end + 80]
            while (again := _find(before + made + after, max(first, at) - low)) is None or again[:3] != (
                    start - low, start - low + len(made), kind):
                made = _MAKE[kind](made, permute)
        out += [text[at:start], made]
        found[kind] = found.get(kind, 0) + 1
        at = end
    return "".join(out) + text[at:], found


def pseudonymise(docs: DataFrame, key: bytes, carry: tuple[str, ...] = (), undo: bool = False) -> DataFrame:
    """doc_id, the ``carry`` columns, text, n_replaced and one count per kind (n_email, ...) of every row."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"),
                       *[docs[c].alias(f"_c{k}") for k, c in enumerate(carry)])

    def run(batches):
        permute = Permutation(key, undo)
        for batch in batches:
            texts, counts = [], []
            for text in batch.column("_text").to_pylist():
                text, found = replace(text, permute) if text else (text, {})
                texts.append(text)
                counts.append(found)
            kept = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(texts, pa.string()),
                 *(pa.array([c.get(k, 0) for c in counts], pa.int64()) for k in KINDS)],
                names=[*kept, "_new", *(f"_n_{k}" for k in KINDS)])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema if f.name != "_text")
    made = base.mapInArrow(run, f"{fields}, _new string, " + ", ".join(f"_n_{k} long" for k in KINDS))
    return made.select("doc_id", *[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)], F.col("_new").alias("text"),
                       sum((F.col(f"_n_{k}") for k in KINDS[1:]), F.col(f"_n_{KINDS[0]}")).alias("n_replaced"),
                       *[F.col(f"_n_{k}").alias(f"n_{k}") for k in KINDS])
