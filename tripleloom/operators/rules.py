"""Mapping rules: what a table row says in triples."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tripleloom.functions.lexical import XSD_STRING

_VARIABLE = re.compile(r"\{(\w+)\}")


@dataclass(frozen=True)
class Template:
    """An IRI template, cut into text pieces and the columns between them."""

    text: str

    @property
    def variables(self) -> list[str]:
        return _VARIABLE.findall(self.text)

    @property
    def pieces(self) -> list[str]:
        return _VARIABLE.split(self.text)[0::2]

    @property
    def prefix(self) -> str:
        return self.pieces[0]


@dataclass(frozen=True)
class ObjectMap:
    """Predicates and the one object they share.

    Exactly one source is used: a column before a template before a constant.
    A predicate text may list several IRIs separated by commas; repeated
    predicates count once.
    """

    predicates: tuple[str, ...]
    column: str | None = None
    template: str | None = None
    constant: str | None = None
    datatype: str | None = None

    def __post_init__(self):
        named = [p.strip() for text in self.predicates for p in text.split(",")]
        object.__setattr__(self, "predicates", tuple(dict.fromkeys(named)))
        if self.column is None and self.template is None and self.constant is None:
            raise ValueError(f"no object for predicates {self.predicates}")

    @property
    def kind(self) -> str:
        if self.column is not None:
            return "column"
        return "template" if self.template is not None else "constant"

    @property
    def value(self) -> str:
        return {"column": self.column, "template": self.template, "constant": self.constant}[self.kind]

    @property
    def literal_type(self) -> str:
        return self.datatype or XSD_STRING


@dataclass(frozen=True)
class TriplesMap:
    """One logical table, its subject, the classes and the object maps."""

    name: str
    sql: str | None
    subject: str
    classes: tuple[str, ...] = ()
    objects: tuple[ObjectMap, ...] = field(default=())
    source: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "classes", tuple(dict.fromkeys(self.classes)))
        templates: dict[str, str] = {}
        for obj in self.objects:
            for predicate in obj.predicates if obj.kind == "template" else ():
                if templates.setdefault(predicate, obj.template) != obj.template:
                    raise ValueError(f"{self.name}: two templates for predicate {predicate}")

    @property
    def table(self) -> str | None:
        """``source`` if given, else the first table the logical query reads, or None when it reads none."""
        return self.source or (first_table(self.sql) if self.sql else None)


def first_table(sql: str) -> str | None:
    """The first table of a query, as Spark's own parser finds it; names of a WITH clause are looked through."""
    words = sql.split()
    if len(words) == 4 and " ".join(words[:3]).upper() == "SELECT * FROM" and words[3].isidentifier():
        return words[3]  # known without a session
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise ValueError("a session is needed to find the table of a query; or give the map its source")
    return _first_relation(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), {})


def _first_relation(plan, named: dict) -> str | None:
    if plan.getClass().getSimpleName() == "UnresolvedWith":
        relations = plan.cteRelations()
        for i in range(relations.size()):
            named = {**named, relations.apply(i)._1().lower(): relations.apply(i)._2()}
        return _first_relation(plan.child(), named)
    if plan.getClass().getSimpleName() == "UnresolvedRelation":
        name = ".".join(plan.multipartIdentifier().apply(i) for i in range(plan.multipartIdentifier().size()))
        inner = named.get(name.lower())
        return _first_relation(inner, {k: v for k, v in named.items() if k != name.lower()}) if inner else name
    children = plan.children()
    for i in range(children.size()):
        found = _first_relation(children.apply(i), named)
        if found:
            return found
    return None


def rule_rows(maps: Iterable[TriplesMap]) -> list[tuple]:
    """One row per (map, predicate, object) rule and per class assertion."""
    rows = []
    for tm in maps:
        for cls in tm.classes:
            rows.append((tm.name, tm.table, tm.subject, "class", None, cls, None))
        for obj in tm.objects:
            datatype = None if obj.kind == "template" else obj.literal_type
            for predicate in obj.predicates:
                rows.append((tm.name, tm.table, tm.subject, obj.kind, predicate, obj.value, datatype))
    return rows


def maps_to_json(maps: Iterable[TriplesMap]) -> str:
    """A mapping as JSON text, to be kept and edited as a file."""
    return json.dumps([asdict(tm) for tm in maps], indent=2, ensure_ascii=False)


def maps_from_json(text: str) -> tuple[TriplesMap, ...]:
    """The mapping written by ``maps_to_json``; fields with a default may be left out."""
    return tuple(
        TriplesMap(
            tm["name"], tm.get("sql"), tm["subject"], tuple(tm.get("classes", ())),
            tuple(ObjectMap(tuple(o["predicates"]), **{k: v for k, v in o.items() if k != "predicates"})
                  for o in tm.get("objects", ())),
            tm.get("source"),
        )
        for tm in json.loads(text)
    )


RULE_SCHEMA = (
    "map string, source_table string, subject string, kind string, "
    "predicate string, value string, datatype string"
)


def rules_frame(spark: SparkSession, maps: Sequence[TriplesMap]) -> DataFrame:
    """The mapping as a table; its size is that of the mapping, not of the data."""
    return spark.createDataFrame(rule_rows(maps), RULE_SCHEMA)
