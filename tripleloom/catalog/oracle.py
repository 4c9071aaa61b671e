"""DuckDB statements of what triple rules mean, for checking only."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from tripleloom.functions.lexical import XSD_DATE
from tripleloom.operators.rules import Template, TriplesMap
from tripleloom.operators.triples import RDF_TYPE


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def key(x: str) -> str:
    """IRI key of text; DuckDB's strip_accents leaves ß alone."""
    folded = f"upper(strip_accents(replace({x}, 'ß', 'SS')))"
    return f"regexp_replace(regexp_replace({folded}, '\\s+', '_', 'g'), '[^A-Z0-9_]', '', 'g')"


def typed_key(x: str, kind: str) -> str:
    text = {
        "text": key(x),
        "int": f"replace(CAST({x} AS VARCHAR), '-', '')",
        "double": f"upper(replace(replace(replace(CAST({x} AS VARCHAR), '-', ''), '+', ''), '.', ''))",
        "date": f"strftime({x}, '%Y%m%d')",
        "timestamp": f"strftime({x}, '%Y%m%d_%H%M%S')",
    }[kind]
    return f"coalesce({text}, 'NONE')"


def lexical(x: str, kind: str, datatype: str) -> str:
    if datatype == XSD_DATE:
        return f"strftime({x}, '%Y-%m-%d')" if kind != "text" else x
    if kind == "timestamp":
        return f"strftime({x}, '%Y-%m-%dT%H:%M:%S')"
    return f"CAST({x} AS VARCHAR)"


def kept(x: str, kind: str) -> str:
    test = {"text": f"{x} <> ''", "int": f"{x} <> 0", "double": f"{x} <> 0"}.get(kind)
    return f"{x} IS NOT NULL" + (f" AND {test}" if test else "")


def iri(template: str, kinds: Mapping[str, str]) -> str:
    parsed = Template(template)
    parts = [quoted(parsed.pieces[0])]
    for variable, piece in zip(parsed.variables, parsed.pieces[1:]):
        parts.append(typed_key(variable, kinds.get(variable.lower(), "text")))
        if piece:
            parts.append(quoted(piece))
    return " || ".join(parts)


def rows(s: str, p: str, o: str, kind: str, datatype: str, source: str, where: str = "") -> str:
    return (
        f"SELECT {s} AS s, {quoted(p)} AS p, {o} AS o, {quoted(kind)} AS o_kind, "
        f"{quoted(datatype)} AS o_datatype FROM {source}" + (f" WHERE {where}" if where else "")
    )


def map_sql(
    tm: TriplesMap, source: str, kinds: Mapping[str, str] | None = None,
    absent: Iterable[str] = (), constants: bool = False,
) -> str:
    """Bag of triples of one map over a relation; ``absent`` columns are not in it."""
    kinds, absent = kinds or {}, {a.lower() for a in absent}
    s = iri(tm.subject, kinds)
    parts = [rows(s, RDF_TYPE, quoted(c), "iri", "", source) for c in tm.classes]
    for obj in tm.objects:
        for p in obj.predicates:
            if obj.kind == "column" and obj.column.lower() not in absent:
                kind = kinds.get(obj.column.lower(), "text")
                o = lexical(obj.column, kind, obj.literal_type)
                parts.append(rows(s, p, o, "literal", obj.literal_type, source, kept(obj.column, kind)))
            elif obj.kind == "template":
                if not {v.lower() for v in Template(obj.template).variables} & absent:
                    parts.append(rows(s, p, iri(obj.template, kinds), "iri", "", source))
            elif obj.kind == "constant" and constants:
                parts.append(rows(s, p, quoted(obj.constant), "literal", obj.literal_type, source))
    return " UNION ALL ".join(parts)


def with_relations(relations: Mapping[str, str], body: str) -> str:
    ctes = ", ".join(f"{name} AS ({sql})" for name, sql in relations.items())
    return f"WITH {ctes} {body}" if ctes else body


def distinct(sql: str) -> str:
    return f"SELECT DISTINCT * FROM ({sql})"
