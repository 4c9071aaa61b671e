"""Unicode folding and IRI key text as Spark column expressions.

Spark has no compatibility decomposition (NFKD), so the tables below are
derived once per driver process from ``unicodedata`` and become literals of
``translate`` and of a small map.  Nothing here runs Python per row.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleloom.functions.lexical import double_text, timestamp_text

UNICODE_VERSION = unicodedata.unidata_version

_HANGUL_FIRST, _HANGUL_LAST = 0xAC00, 0xD7A3
_SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
_KEY_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_OTHER_ASCII = "".join(c for c in map(chr, range(128)) if c not in _KEY_CHARS + _SPACES)
_RANGE_GAP = 64
_ENTRY_END, _IMAGE_START = "\x02", "\x01"


def _decompose(char: str) -> str:
    """Compatibility decomposition of one character, combining marks removed."""
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))


def _key_image(char: str) -> str:
    """What one character contributes to an IRI key, before the final clean-up.

    Blank stands for whitespace and ``-`` for a character the clean-up removes;
    ``-`` only matters where it keeps two blanks apart.
    """
    image = "".join(
        " " if c.isspace() else c if re.fullmatch("[A-Z0-9_]", c) else "-"
        for c in _decompose(char).upper()
    )
    return image if " " in image else image.replace("-", "") or image


class _FoldTable:
    """Character images, split by how Spark can apply them."""

    def __init__(self, images: dict[str, str]):
        single = {c: i for c, i in images.items() if len(i) == 1}
        removed = [c for c, i in images.items() if i == ""]
        self.match = "".join(single) + "".join(removed)
        self.replace = "".join(single.values())
        self.expansions = {c: i for c, i in images.items() if len(i) > 1}

    def apply(self, text: Column, hangul: bool = False) -> Column:
        # One text constant the optimizer folds to a map, not an expression per entry.
        entries = _ENTRY_END.join(c + _IMAGE_START + i for c, i in self.expansions.items())
        table = F.str_to_map(F.lit(entries), F.lit(_ENTRY_END), F.lit(_IMAGE_START))

        def expand(piece: Column) -> Column:
            image = F.coalesce(F.try_element_at(table, piece), piece)
            if hangul:
                image = F.when(piece.rlike("^[가-힣]$"), _jamo(piece)).otherwise(image)
            return F.when(F.octet_length(piece) == F.char_length(piece), piece).otherwise(image)

        # Cut around the characters that expand, so plain runs stay whole.
        wide = _ranges(self.expansions, "가-힣" if hangul else "")
        expanded = F.array_join(F.transform(F.split(text, f"(?<={wide})|(?={wide})"), expand), "")
        has_wide = F.char_length(F.translate(text, "".join(self.expansions), "")) < F.char_length(text)
        if hangul:
            has_wide = has_wide | text.rlike("[가-힣]")
        narrow = F.when(has_wide, expanded).otherwise(text)
        return F.when(_is_ascii(text), text).otherwise(F.translate(narrow, self.match, self.replace))


def _is_ascii(text: Column) -> Column:
    """As many bytes as characters."""
    return F.octet_length(text) == F.char_length(text)


def _ranges(chars: Iterable[str], extra: str) -> str:
    """A regex class of few ranges that covers the characters; it may cover others too."""
    spans: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if spans and code - spans[-1][1] <= _RANGE_GAP:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in spans) + extra + "]"


def _jamo(char: Column) -> Column:
    """Hangul syllables decompose by arithmetic (Unicode standard, section 3.12)."""
    index = F.ascii(char) - _HANGUL_FIRST

    def pick(first: int, count: int, offset: Column) -> Column:
        letters = F.lit("".join(chr(first + i) for i in range(count)))
        return F.substring(letters, offset.cast("int") + 1, F.lit(1))

    trailing = index % 28
    return F.concat(
        pick(0x1100, 19, F.floor(index / 588)),
        pick(0x1161, 21, F.floor((index % 588) / 28)),
        F.when(trailing == 0, F.lit("")).otherwise(pick(0x11A7, 28, trailing)),
    )


def _non_ascii() -> range:
    return range(0x80, sys.maxunicode + 1)


@lru_cache(maxsize=1)
def _accent_table() -> _FoldTable:
    images = {}
    for code in _non_ascii():
        if 0xD800 <= code <= 0xDFFF or _HANGUL_FIRST <= code <= _HANGUL_LAST:
            continue
        char = chr(code)
        image = _decompose(char)
        if image != char:
            images[char] = image
    return _FoldTable(images)


@lru_cache(maxsize=1)
def _key_table() -> _FoldTable:
    images = {}
    for code in _non_ascii():
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        image = _key_image(char)
        if image.strip("-") or image == "":
            images[char] = image
    return _FoldTable(images)


@lru_cache(maxsize=1)
def _key_map() -> tuple[str, str]:
    """Every character that gives at most one of a key, in one map: blanks to a blank, the clean-up's to nothing."""
    table = _key_table()
    images = dict(zip(table.match, table.replace)) | {c: " " for c in _SPACES} | {c: c.upper() for c in _LOWER}
    kept = {c: i for c, i in images.items() if i != "-"}
    removed = [c for c in images if c not in kept] + [*table.match[len(table.replace):], *_OTHER_ASCII]
    return "".join(kept) + "".join(c for c in removed if c not in kept), "".join(kept.values())


def strip_accents(text: Column) -> Column:
    """NFKD text without combining marks; base letters of any script stay."""
    return _accent_table().apply(text, hangul=True)


def key_text(text: Column) -> Column:
    """IRI key of a string: folded, upper-cased, blanks to ``_``, rest removed.

    Text of characters that give at most one of the key each, and without
    neighbouring blanks in it, the usual key, takes one character map instead of
    three and two regular expressions.
    """
    mapped = F.translate(text, *_key_map())
    plain = F.replace(mapped, F.lit(" "), F.lit("_"))
    folded = F.regexp_replace(F.upper(_key_table().apply(text)), f"[{_SPACES}]+", "_")
    cleaned = F.regexp_replace(F.translate(folded, _OTHER_ASCII, ""), "[^A-Z0-9_]", "")
    simple = _is_ascii(mapped) & ~F.contains(mapped, F.lit("  "))
    return F.when(simple, plain).otherwise(cleaned)


def iri_key(value: Column, dtype: T.DataType, null_text: str | None = "NONE") -> Column:
    """IRI key of a column of any scalar type.

    Non-string values only hold ASCII text of a known shape, so each type takes
    the shortest expression.  A null gives ``null_text``, or stays null when
    that is ``None``.
    """
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        key = key_text(value)
    elif isinstance(dtype, T.NullType):
        key = F.lit(None).cast("string")
    elif isinstance(dtype, T.BooleanType):
        key = F.upper(value.cast("string"))
    elif isinstance(dtype, T.IntegralType):
        key = F.translate(value.cast("string"), "-", "")
    elif isinstance(dtype, T.DecimalType):
        key = F.translate(value.cast("string"), "-.", "")
    elif isinstance(dtype, T.FractionalType):
        key = F.upper(F.translate(double_text(value), "-+.", ""))
    elif isinstance(dtype, T.DateType):
        key = F.date_format(value, "yyyyMMdd")
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        key = F.translate(timestamp_text(value), " -:.", "_")
    else:
        raise TypeError(f"no IRI key for a column of type {dtype.simpleString()}")
    return key if null_text is None else F.coalesce(key, F.lit(null_text))
