"""N-Triples text and prefixed display of IRIs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# N-Triples ECHAR escapes (W3C Recommendation, production [153s]); the backslash comes first.
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))
_NEEDS_ESCAPE = r'[\\"\n\r\t]'


def escape_literal(text: Column) -> Column:
    """Literal text with the characters escaped that may not stand in a quoted string."""
    escaped = text
    for raw, shown in _ESCAPES:
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    return F.when(text.rlike(_NEEDS_ESCAPE), escaped).otherwise(text)


def compact_iri(iri: Column, prefixes: Mapping[str, str]) -> Column:
    """``prefix:local`` for display; the longest namespace wins, unknown IRIs stay whole."""
    ordered = sorted(prefixes.items(), key=lambda item: (-len(item[1]), item[0]))
    shown = None
    for prefix, namespace in ordered:
        hit = iri.startswith(namespace)
        text = F.concat(F.lit(prefix + ":"), F.substring(iri, F.lit(len(namespace) + 1), F.length(iri)))
        shown = F.when(hit, text) if shown is None else shown.when(hit, text)
    return iri if shown is None else shown.otherwise(iri)


def prefix_lines(prefixes: Mapping[str, str]) -> list[str]:
    """Turtle ``@prefix`` block; valid in front of N-Triples lines when read as Turtle."""
    return [f"@prefix {prefix}: <{namespace}> ." for prefix, namespace in prefixes.items()]
