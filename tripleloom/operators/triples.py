"""Rows to triples by mapping rules, as one projection and one Expand per table.

A graph is held *encoded*: every triple is ``(shape, s, o)`` where ``shape``
numbers the constant parts (subject prefix, predicate, object prefix, kind,
datatype) and ``s``/``o`` are only the parts that vary by row.  The constant
parts come back by array look-up afterwards.

De-duplication, the one shuffle of triple generation, moves *packed* rows: per
source row and subject one ``(s, o)`` with all objects of that subject in the
text ``o``.  Equal triples have equal subjects, so packed rows are dealt by
``s`` and become triples only behind the shuffle, in tasks of bounded input.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tripleloom.functions.fold import iri_key
from tripleloom.functions.lexical import XSD_STRING, literal_or_null
from tripleloom.functions.ntriples import escape_literal
from tripleloom.operators.joins import stored_bytes
from tripleloom.operators.rules import Template, TriplesMap

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
TRIPLE_COLUMNS = ["s", "p", "o", "o_kind", "o_datatype"]
ENCODED_SCHEMA = "shape int, s string, o string"
PACKED_SCHEMA = "s string, o string"
NOTE_SCHEMA = "map string, rule string, reason string"
# Stored bytes of the tables whose triples one task should put together, and the most such tasks.
SPREAD_BYTES = 2 * 1024 * 1024
MOST_SPREAD = 20_000
# The projected column of objects that are a constant part and nothing else.
_NOTHING = "empty"
# Between the fields of a packed row, before what stands for one of these two inside a field, and a field that is null.
_CUT, _MARK = "\x01", "\x02"
_ESCAPES = ((_MARK, _MARK + "m"), (_CUT, _MARK + "c"))
# Flagged views of one subject that share a packed row; each set of them that holds at once is a recipe.
_MOST_FLAGS = 4
# Bytes of bytecode of a method that the JVM still compiles; what whole-stage code has over that stays interpreted.
LARGEST_METHOD = 8000


class Shape(NamedTuple):
    """The parts of a triple that are the same for every row."""

    subject: str
    predicate: str
    object: str
    kind: str
    datatype: str


class Prefixes(NamedTuple):
    """Which prefixes are followed by one key, and which by other text as well."""

    keyed: frozenset[str] = frozenset()
    open: frozenset[str] = frozenset()

    def __or__(self, other: Prefixes) -> Prefixes:
        return Prefixes(self.keyed | other.keyed, self.open | other.open)


@dataclass(frozen=True)
class View:
    """A table as named columns of a wider frame, on the rows where its flag column is true.

    Tables that are views of one frame are read in one pass over it.
    """

    base: DataFrame
    columns: Mapping[str, str]
    where: str | None = None

    def frame(self) -> DataFrame:
        rows = self.base if self.where is None else self.base.filter(F.col(self.where))
        return rows.select(*[F.col(own).alias(name) for name, own in self.columns.items()])


def as_frame(table: DataFrame | Sequence[View]) -> DataFrame:
    """A table that may be given as views, whose rows are then put together."""
    return table if isinstance(table, DataFrame) else _union(view.frame() for view in table)


class Watch:
    """Counts that the run which writes a graph makes on its way, to be held against counts of the input.

    The scan counts the rows that it reads and those that get a subject, per
    map; behind set semantics the triples are counted, and at the sink the
    lines with the sum of their hashes, which does not depend on their order.
    Nothing is read again for it.  A map task that runs anew after a lost
    executor counts its rows again, so a scan's count can be too high, never too
    low; the counts of triples and lines are taken once per written part.
    """

    def __init__(self):
        self.scans: list[tuple[_Seen, list[str]]] = []
        self.kept: _Seen | None = None
        self.sink: _Seen | None = None

    def scan(self, source: DataFrame, subjects: Sequence[tuple[str, str]]) -> DataFrame:
        """``source`` with its rows, and the subjects of each named map, counted."""
        seen = _Seen(source, [F.count(F.lit(1)).alias("rows_read"), *[
            F.count(F.col(column)).alias(f"m{i}") for i, (_, column) in enumerate(subjects)]])
        self.scans.append((seen, [name for name, _ in subjects]))
        return seen.frame

    def triples(self, encoded: DataFrame) -> DataFrame:
        self.kept = _Seen(encoded, [F.count(F.lit(1)).alias("triples")])
        return self.kept.frame

    def lines(self, lines: DataFrame) -> DataFrame:
        self.sink = _Seen(lines, line_sums())
        return self.sink.frame

    def subjects(self) -> dict[str, tuple[int, int]]:
        """Rows read and rows with a subject, per map; of several views of a table the latter are added."""
        found: dict[str, tuple[int, int]] = {}
        for seen, names in self.scans:
            values = seen.values()
            for i, name in enumerate(names):
                read, made = found.get(name, (0, 0))
                found[name] = max(read, values["rows_read"]), made + values[f"m{i}"]
        return found

    def written(self) -> dict[str, int]:
        return {**self.kept.values(), **self.sink.values()}


class _Seen:
    """A frame whose rows are counted as they pass."""

    def __init__(self, source: DataFrame, counts: list[Column]):
        self.source, self.counts, self.observation = source, counts, Observation()
        self.frame = source.observe(self.observation, *counts)

    def values(self) -> dict[str, int]:
        """The counts; taken anew where the run left this part of the plan out, as no row came through it."""
        try:
            return self.observation.get
        except Py4JJavaError:
            return self.source.agg(*self.counts).first().asDict()


def line_sums() -> list[Column]:
    """Number of lines and the sum of their hashes, exact whatever the number."""
    hashes = F.sum(F.xxhash64("value").cast("decimal(38,0)"))
    return [F.count(F.lit(1)).alias("lines"), F.coalesce(hashes, F.lit(0)).cast("string").alias("checksum")]


class Note(NamedTuple):
    """A rule or map that yields nothing, and why."""

    map: str
    rule: str
    reason: str


@dataclass(frozen=True)
class Options:
    """Choices where mapping standards and practice differ.

    ``null_iri``: text a null gives inside an IRI, or None to drop the triple.
    ``constants``: whether constant objects are emitted.
    ``source``: ``table`` reads the stored table a map names; ``query`` runs
    the map's SQL over the registered views, or over the views given as its
    table where it takes each row by itself.
    """

    null_iri: str | None = "NONE"
    constants: bool = False
    source: str = "table"

    def __post_init__(self):
        if self.source not in ("table", "query"):
            raise ValueError(f"source must be 'table' or 'query', not {self.source!r}")


class _Emission(NamedTuple):
    """One triple per row: its map and shape, and the projected columns of its parts."""

    map: str
    shape: Shape
    subject: str
    object: str


def _pick(values: Sequence[str], shape: Column) -> Column:
    """The value of a shape; the list is one text constant the optimizer folds to an array."""
    if len(set(values)) == 1:
        return F.lit(values[0])
    return F.element_at(F.split(F.lit("\n".join(values)), "\n"), shape)


def _escaped(text: Column) -> Column:
    for plain, sign in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(sign))
    return text


def _unescaped(text: Column) -> Column:
    for plain, sign in reversed(_ESCAPES):
        text = F.replace(text, F.lit(sign), F.lit(plain))
    return text


class Packed(NamedTuple):
    """Rows ``(s, o)`` with the objects of one subject, and per recipe from 1 the shapes with their places in ``o``.

    ``o`` is the number of the row's recipe and then the objects, as one text:
    it takes two thirds of the shuffled bytes that an array of them took.
    Place 0 stands for an object without a varying part.
    """

    rows: DataFrame
    recipes: tuple[tuple[tuple[int, int], ...], ...]

    def dealt(self) -> Packed:
        """The rows with all of one subject in one task, over tasks as many as the stored tables need."""
        spark = self.rows.sparkSession
        needed = min(stored_bytes(self.rows) // SPREAD_BYTES + 1, MOST_SPREAD)
        return self._replace(rows=self.rows.repartition(max(needed, spark.sparkContext.defaultParallelism), "s"))

    def encoded(self) -> DataFrame:
        """The triples ``(shape, s, o)`` of the rows."""
        recipes = F.array(*[F.array(*[
            F.struct(F.lit(number).alias("shape"), F.lit(place).alias("place")) for number, place in recipe])
            for recipe in self.recipes])
        cut = self.rows.select("s", F.split("o", _CUT).alias("o"))
        made = cut.select("s", "o", F.explode(F.get(recipes, F.get("o", F.lit(0)).cast("int") - 1)).alias("made"))
        o = F.when(F.col("made.place") == 0, F.lit("")).otherwise(F.get("o", F.col("made.place")))
        rows = made.select(F.col("made.shape").alias("shape"), "s", o.alias("o")).filter(F.col("o") != _MARK)
        return rows.select("shape", "s", _unescaped(F.col("o")).alias("o"))

    def units(self) -> list[list[int]]:
        """The shapes, those together that every row gives from the same places and so with the same objects."""
        places: dict[int, dict[tuple[int, int], None]] = {}
        for i, recipe in enumerate(self.recipes):
            for number, place in recipe:
                places.setdefault(number, {})[i, place] = None
        units: dict[frozenset[tuple[int, int]], list[int]] = {}
        for number, found in places.items():
            units.setdefault(frozenset(found), []).append(number)
        return list(units.values())

    def distinct(self) -> DataFrame:
        """The triples ``(shape, s, o)`` as a set: one row per unit of shapes is put together, and then spread."""
        units = self.units()
        unit = {number: u for u, numbers in enumerate(units, 1) for number in numbers}
        recipes = tuple(tuple(dict.fromkeys((unit[number], place) for number, place in recipe)) for recipe in self.recipes)
        kept = self._replace(recipes=recipes).dealt().encoded().dropDuplicates(["shape", "s", "o"])
        most = max(map(len, units))
        numbers = [F.element_at(F.array(*[F.lit(u[i] if i < len(u) else None).cast("int") for u in units]), F.col("shape"))
                   for i in range(most)]
        if most == 1:
            return kept.select(numbers[0].alias("shape"), "s", "o")
        wide = kept.select("s", "o", *[number.alias(f"n{i}") for i, number in enumerate(numbers)])
        return wide.sparkSession.sql(
            f"SELECT shape, s, o FROM {{wide}} UNPIVOT (shape FOR place IN ({', '.join(f'n{i}' for i in range(most))}))", wide=wide)


@dataclass(frozen=True)
class Graph:
    """Encoded triples with their shapes and the notes of compilation.

    ``single`` holds triples known to occur once; only ``repeated`` needs
    de-duplication.  ``packed``, where there is one, holds the triples of
    ``repeated`` as rows per subject; a graph that gets other triples in
    ``repeated`` must leave it out.
    """

    repeated: DataFrame
    shapes: tuple[Shape, ...]
    notes: tuple[Note, ...] = ()
    prefixes: Prefixes = Prefixes()
    single: DataFrame | None = None
    watch: Watch | None = None
    packed: Packed | None = None

    @property
    def encoded(self) -> DataFrame:
        """All triples as ``(shape, s, o)``."""
        return self.repeated if self.single is None else self.repeated.unionByName(self.single)

    def watched(self) -> Graph:
        """The graph with its triples counted where a watch is kept."""
        return self if self.watch is None else replace(self, repeated=self.watch.triples(self.encoded), single=None, packed=None)

    def distinct(self) -> Graph:
        """Set semantics.  Packed rows are dealt by subject, triples without them by all their parts."""
        rows = self.repeated.dropDuplicates(["shape", "s", "o"]) if self.packed is None else self.packed.distinct()
        return replace(self, repeated=rows, packed=None)

    def triples(self) -> DataFrame:
        """Whole triples ``s, p, o, o_kind, o_datatype`` (datatype '' for IRIs)."""
        if not self.shapes:
            return self.encoded.selectExpr("s", "'' AS p", "o", "'' AS o_kind", "'' AS o_datatype")
        shape = F.col("shape")
        return self.encoded.select(
            F.concat(_pick([x.subject for x in self.shapes], shape), F.col("s")).alias("s"),
            _pick([x.predicate for x in self.shapes], shape).alias("p"),
            F.concat(_pick([x.object for x in self.shapes], shape), F.col("o")).alias("o"),
            _pick([x.kind for x in self.shapes], shape).alias("o_kind"),
            _pick([x.datatype for x in self.shapes], shape).alias("o_datatype"),
        )

    def lines(self) -> DataFrame:
        """N-Triples statements, one column ``value``; constant parts are joined per shape."""
        if not self.shapes:
            return self.encoded.selectExpr("s AS value")
        head, middle, tail = [], [], []
        for x in self.shapes:
            iri = x.kind == "iri"
            plain = iri or x.datatype == XSD_STRING
            head.append("<" + x.subject)
            middle.append(f"> <{x.predicate}> " + ("<" + x.object if iri else '"'))
            tail.append("> ." if iri else '" .' if plain else f'"^^<{x.datatype}> .')
        literals = [i for i, x in enumerate(self.shapes, 1) if x.kind == "literal"]
        shape, o = F.col("shape"), F.col("o")
        shown = F.when(shape.isin(literals), escape_literal(o)).otherwise(o)
        line = F.concat(_pick(head, shape), F.col("s"), _pick(middle, shape), shown, _pick(tail, shape))
        return self.encoded.select(line.alias("value"))

    def predicate_counts(self) -> DataFrame:
        """Triples per predicate and kind, counted on the encoded form."""
        shape = F.col("shape")
        return (
            self.encoded.groupBy("shape").count()
            .select(
                _pick([x.predicate for x in self.shapes], shape).alias("p"),
                _pick([x.kind for x in self.shapes], shape).alias("o_kind"),
                "count",
            )
            .groupBy("p", "o_kind").agg(F.sum("count").alias("triples"))
        )

    def union(self, other: Graph) -> Graph:
        """Bag union; apply ``distinct`` for the set union."""
        shapes = tuple(dict.fromkeys(self.shapes + other.shapes))
        prefixes = self.prefixes | other.prefixes
        if _prefixes_overlap(shapes, prefixes):
            return self.whole().union(other.whole())
        notes = tuple(dict.fromkeys(self.notes + other.notes))
        merged = self._renumbered(shapes).unionByName(other._renumbered(shapes))
        return Graph(merged, shapes, notes, prefixes)

    def _renumbered(self, shapes: tuple[Shape, ...]) -> DataFrame:
        if shapes[: len(self.shapes)] == self.shapes:
            return self.encoded
        number = {x: i for i, x in enumerate(shapes, 1)}
        moved = _pick([str(number[x]) for x in self.shapes], F.col("shape")).cast("int")
        return self.encoded.select(moved.alias("shape"), "s", "o", *self.encoded.columns[3:])

    def whole(self) -> Graph:
        """The same graph with whole IRIs in ``s`` and ``o``, none of them known to be single."""
        bare = [x._replace(subject="", object="") for x in self.shapes]
        shapes = tuple(dict.fromkeys(bare))
        shape = F.col("shape")
        number = {x: i for i, x in enumerate(shapes, 1)}
        encoded = self.encoded.select(
            _pick([str(number[x]) for x in bare], shape).cast("int").alias("shape"),
            F.concat(_pick([x.subject for x in self.shapes], shape), F.col("s")).alias("s"),
            F.concat(_pick([x.object for x in self.shapes], shape), F.col("o")).alias("o"),
            *self.encoded.columns[3:],
        )
        return replace(self, repeated=encoded, shapes=shapes, prefixes=Prefixes(open=frozenset([""])), single=None,
                       packed=None)

    def notes_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.notes), NOTE_SCHEMA)


def _prefixes_overlap(shapes: Iterable[Shape], prefixes: Prefixes) -> bool:
    """Whether two different prefixes could complete to one and the same IRI.

    That takes a prefix that starts another one and is followed by something.
    If that is one key, the longer prefix must add nothing but key characters.
    """
    shapes = list(shapes)
    for texts in ({x.subject for x in shapes}, {x.object for x in shapes if x.kind == "iri"}):
        for short in texts:
            for long in texts:
                rest = long[len(short):]
                if rest and long.startswith(short):
                    if short in prefixes.open or (short in prefixes.keyed and re.fullmatch("[A-Z0-9_]+", rest)):
                        return True
    return False


class _Compiler:
    """Compiles the maps over one frame to projected columns and emissions."""

    def __init__(self, frame: DataFrame, options: Options):
        self.frame = frame
        self.options = options
        self.own = {f.name.lower(): f for f in frame.schema.fields}
        self.fields = self.own
        self.columns: dict[str, Column] = {}
        self.emissions: dict[_Emission, None] = {}
        self.subjects: list[tuple[str, str]] = []
        self.flagged: dict[str, tuple[str, str]] = {}
        self.watched = False
        self.notes: list[Note] = []
        self.prefixes = Prefixes()

    def _project(self, name: str, build: Callable[[], Column]) -> str:
        """Adds a projected column once; equal keys and literals are shared by all rules."""
        if name not in self.columns:
            self.columns[name] = build()
        return name

    def _key_column(self, variable: str) -> Column:
        fld = self.fields[variable.lower()]
        return iri_key(F.col(f"`{fld.name}`"), fld.dataType, self.options.null_iri)

    def _nothing(self) -> str:
        return self._project(_NOTHING, lambda: F.lit(""))

    def _rendered(self, template: Template) -> str:
        """Name of the projected column with everything after the template's prefix."""
        pieces, variables = template.pieces, template.variables
        if not variables:
            return self._nothing()
        owns = [self.fields[v.lower()].name for v in variables]
        if len(variables) == 1 and pieces[1] == "":
            self.prefixes |= Prefixes(keyed=frozenset([template.prefix]))
            return self._project(f"key {owns[0]}", lambda: self._key_column(variables[0]))
        self.prefixes |= Prefixes(open=frozenset([template.prefix]))

        def parts() -> Column:
            columns: list[Column] = []
            for variable, text in zip(variables, pieces[1:]):
                columns.append(self._key_column(variable))
                if text:
                    columns.append(F.lit(text))
            return F.concat(*columns)

        return self._project(f"template {template.text} {owns}", parts)

    def _known(self, template: Template) -> list[str]:
        return [v for v in template.variables if v.lower() in self.fields]

    def add(self, tm: TriplesMap, view: View | None = None) -> None:
        """Compiles a map over the frame itself, or over a view of it."""
        self.fields = self.own if view is None else {
            name.lower(): self.own[own.lower()] for name, own in view.columns.items()}
        subject = Template(tm.subject)
        known = self._known(subject)
        if not known:
            self.notes.append(Note(tm.name, tm.subject, "no subject column in the table"))
            return
        if len(known) < len(subject.variables):
            missing = sorted(set(subject.variables) - set(known))
            raise ValueError(f"{tm.name}: subject columns {missing} are not in the table")
        s = self._rendered(subject)
        if view is not None and view.where is not None:
            name, whole = s, self.columns[s]
            s = self._project(f"{name} where {view.where}", lambda: F.when(F.col(f"`{view.where}`"), whole))
            self.flagged[s] = name, view.where
        self.subjects.append((tm.name, s))
        for cls in tm.classes:
            self._emit(tm, Shape(subject.prefix, RDF_TYPE, cls, "iri", ""), s, self._nothing())
        for obj in tm.objects:
            if obj.kind == "constant" and not self.options.constants:
                self.notes.append(Note(tm.name, obj.value, "constant objects are off"))
                continue
            if obj.kind == "template":
                template = Template(obj.template)
                if len(self._known(template)) < len(template.variables):
                    self.notes.append(Note(tm.name, obj.template, "object column not in the table"))
                    continue
                value, prefix, kind, datatype = self._rendered(template), template.prefix, "iri", ""
            else:
                kind, prefix, datatype = "literal", "", obj.literal_type
                if obj.kind == "constant":
                    value = self._project(f"constant {obj.constant}", lambda: F.lit(obj.constant))
                elif obj.column.lower() in self.fields:
                    fld = self.fields[obj.column.lower()]
                    value = self._project(
                        f"literal {fld.name} {datatype}",
                        lambda: literal_or_null(F.col(f"`{fld.name}`"), fld.dataType, datatype))
                else:
                    self.notes.append(Note(tm.name, obj.column, "literal column not in the table"))
                    continue
            for predicate in obj.predicates:
                self._emit(tm, Shape(subject.prefix, predicate, prefix, kind, datatype), s, value)

    def _emit(self, tm: TriplesMap, shape: Shape, s: str, o: str) -> None:
        self.emissions[_Emission(tm.name, shape, s, o)] = None

    def encoded(
        self, spark: SparkSession, numbers: Mapping[Shape, int], wanted: Callable[[_Emission], bool],
        watch: Watch | None = None, carry: Sequence[str] = (), first: int = 1,
    ) -> tuple[DataFrame, Packed] | None:
        """Triples of the wanted emissions by one scan of the columns they need; the first such scan is watched.

        The same triples come as packed rows too, numbered from ``first``.
        """
        triples = list(dict.fromkeys((numbers[e.shape], e.subject, e.object) for e in self.emissions if wanted(e)))
        if not triples:
            return None
        watch = None if self.watched else watch
        used = dict.fromkeys(name for _, s, o in triples for name in (s, o))
        if watch is not None:
            used |= dict.fromkeys(s for _, s in self.subjects)
        used |= dict.fromkeys(name for name, _ in self.flagged.values())
        names = {name: f"c{i}" for i, name in enumerate(used)}
        flags = {flag: f"f{i}" for i, flag in enumerate(dict.fromkeys(flag for _, flag in self.flagged.values()))}
        source = self.frame.select(
            *[self.columns[n].alias(alias) for n, alias in names.items()],
            *[F.col(f"`{flag}`").alias(alias) for flag, alias in flags.items()], *carry)
        if watch is not None:
            source, self.watched = watch.scan(source, [(name, names[s]) for name, s in self.subjects]), True
        rows = ", ".join(f"(`{names[s]}`, `{names[o]}`) AS `{number}`" for number, s, o in triples)
        # UNPIVOT plans as Expand, which stays in whole-stage codegen and builds no array per row.
        spread = spark.sql(
            f"SELECT {', '.join(['CAST(shape AS INT) AS shape', 's', 'o', *carry])} "
            f"FROM {{source}} UNPIVOT ((s, o) FOR shape IN ({rows}))",
            source=source,
        )
        encoded = spread.filter(F.col("s").isNotNull() & F.col("o").isNotNull())
        return encoded, self._packed(spark, source, triples, names, flags, first)

    def _field(self, name: str, column: str) -> Column:
        """An object as a field of a packed row; keys have none of the two signs."""
        keyed = name.startswith("key ") and not set(_CUT + _MARK) & set(self.options.null_iri or "")
        return F.coalesce(F.col(column) if keyed else _escaped(F.col(column)), F.lit(_MARK))

    def _packed(
        self, spark: SparkSession, source: DataFrame, triples: Sequence[tuple[int, str, str]], names: Mapping[str, str],
        flags: Mapping[str, str], first: int
    ) -> Packed:
        """One row per source row and subject, also where several flagged views of the row have that subject."""
        subjects: dict[str, dict[str | None, list[tuple[int, str]]]] = {}
        for number, s, o in triples:
            whole, flag = self.flagged.get(s, (s, None))
            subjects.setdefault(whole, {}).setdefault(flag, []).append((number, o))
        groups = []
        for whole, views in subjects.items():
            conditions = sorted(views, key=lambda flag: flag is not None)  # first what every row has
            groups += [(whole, {flag: views[flag] for flag in conditions[i:i + _MOST_FLAGS]})
                       for i in range(0, len(conditions), _MOST_FLAGS)]
        recipes, columns = [], []
        for i, (whole, views) in enumerate(groups):
            objects = {flag: list(dict.fromkeys(o for _, o in made if o != _NOTHING)) for flag, made in views.items()}
            held = [flag for flag in views if flag is not None]
            number, parts = F.lit(first + len(recipes)), []
            for bit, flag in enumerate(held):
                number = number + F.when(F.col(flags[flag]), F.lit(1 << bit)).otherwise(F.lit(0))
            for flag, fields in objects.items():
                if fields:
                    part = F.concat_ws(_CUT, *[self._field(o, names[o]) for o in fields])
                    parts.append(part if flag is None else F.when(F.col(flags[flag]), part))
            for held_at_once in range(1 << len(held)):
                recipe, place = [], 0
                for flag, made in views.items():
                    if flag is None or held_at_once >> held.index(flag) & 1:
                        places = {o: place + k for k, o in enumerate(objects[flag], 1)}
                        recipe += [(shape, places.get(o, 0)) for shape, o in made]
                        place += len(places)
                recipes.append(tuple(dict.fromkeys(recipe)))
            s = F.col(names[whole])
            if None not in views:
                # Named twice, so that the optimizer keeps the key where it is made once for all that take it.
                s = F.when(reduce(or_, [F.col(flags[flag]) for flag in held]) & s.isNotNull(), s)
            columns += [s.alias(f"s{i}"), F.concat_ws(_CUT, number.cast("string"), *parts).alias(f"o{i}")]
        wide = source.select(*columns)
        rows = ", ".join(f"(s{i}, o{i})" for i in range(len(groups)))
        packed = spark.sql(f"SELECT s, o FROM {{wide}} UNPIVOT INCLUDE NULLS ((s, o) FOR g IN ({rows}))", wide=wide)
        return Packed(packed.filter(F.col("s").isNotNull()), tuple(recipes))


Table = DataFrame | Sequence[View]
Tables = Mapping[str, Table] | Callable[[str], Table]


def _select_list(spark: SparkSession, sql: str, table: str) -> list[str] | None:
    """The items of a query that only selects from the table, as they are written; None for any other query."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    if plan.getClass().getSimpleName() != "Project" or plan.child().getClass().getSimpleName() != "UnresolvedRelation":
        return None
    if plan.child().tableName().lower() != table.lower():
        return None
    items = [plan.projectList().apply(i).origin() for i in range(plan.projectList().size())]
    if any(item.startIndex().isEmpty() or item.stopIndex().isEmpty() for item in items):
        return None
    return [sql[item.startIndex().get():item.stopIndex().get() + 1] for item in items]


def _each_row(frame: DataFrame, items: Sequence[str]) -> list[str] | None:
    """The columns that the items make, if they make one row of each row and of that row alone."""
    made = frame.selectExpr(*items)
    plan, rows = made._jdf.queryExecution().analyzed(), frame._jdf.queryExecution().analyzed()
    alone = (plan.getClass().getSimpleName() == "Project" and plan.child().sameResult(rows)
             and plan.deterministic() and plan.subqueriesAll().isEmpty())
    return made.columns if alone else None


def _queried(
    spark: SparkSession, maps: Sequence[TriplesMap], tables: Mapping[str, Table]
) -> dict[tuple[str, str], list[View]]:
    """Queries that take each row of a table by itself, as views where their table is given as views.

    What such a query derives becomes columns of the views' frame, so that all
    queries over one frame share its scan.  Other queries are left to Spark.
    """
    made: dict[tuple[str, str], list[tuple[int, dict[str, str], str | None]]] = {}
    bases: dict[int, DataFrame] = {}
    for tm in maps:
        table = tables.get(tm.table) if tm.sql and tm.table else None
        if table is None or isinstance(table, DataFrame) or (tm.table, tm.sql) in made:
            continue
        items = _select_list(spark, tm.sql, tm.table)
        made_by = items and [_each_row(view.frame().alias(tm.table), items) for view in table]
        # Two columns of one name are Spark's to reject or to tell apart.
        if not made_by or any(names is None or len({n.lower() for n in names}) < len(names) for names in made_by):
            continue
        views = made.setdefault((tm.table, tm.sql), [])
        for view in table:
            base, own = bases.setdefault(id(view.base), view.base), {name.lower(): c for name, c in view.columns.items()}
            # A star stands for all columns, any other item for one.
            pieces = [piece for item in items for piece in (view.columns if item == "*" else [item])]
            names = _each_row(view.frame().alias(tm.table), pieces)
            derived = {name: f"query {len(made)} {len(views)} {k}" for k, (piece, name) in enumerate(zip(pieces, names))
                       if piece.lower() != name.lower()}
            if derived:
                kept = {f"_base {i}": column for i, column in enumerate(base.columns)}
                both = base.select(*[F.col(f"`{column}`").alias(alias) for alias, column in kept.items()],
                                   *[F.col(f"`{column}`").alias(name) for name, column in view.columns.items()])
                bases[id(view.base)] = both.alias(tm.table).selectExpr(
                    *[f"`{alias}`" for alias in kept],
                    *[piece for piece, name in zip(pieces, names) if name in derived]).toDF(*kept.values(), *derived.values())
            views.append((id(view.base), {name: derived.get(name) or own[name.lower()] for name in names}, view.where))
    return {key: [View(bases[base], columns, where) for base, columns, where in views] for key, views in made.items()}


def _compile(
    spark: SparkSession, maps: Sequence[TriplesMap], tables: Tables, options: Options
) -> tuple[list[_Compiler], list[Note]]:
    """One compiler per logical source, so that maps over one table, or over views of one frame, share its scan."""
    load = tables if callable(tables) else tables.__getitem__
    queried = {} if options.source == "table" or callable(tables) else _queried(spark, maps, tables)
    compilers: dict[str | int, _Compiler] = {}
    notes: list[Note] = []
    for tm in maps:
        if not tm.sql:
            notes.append(Note(tm.name, "", "no logical query"))
            continue
        if not tm.table:
            notes.append(Note(tm.name, tm.sql, "no table in the logical query"))
            continue
        source = tm.table if options.source == "table" else tm.sql
        found = compilers[source].frame if source in compilers else (
            load(tm.table) if options.source == "table" else queried.get((tm.table, tm.sql)) or spark.sql(tm.sql))
        if isinstance(found, DataFrame):
            compilers.setdefault(source, _Compiler(found, options)).add(tm)
            continue
        for view in found:
            compilers.setdefault(id(view.base), _Compiler(view.base, options)).add(tm, view)
    for compiler in compilers.values():
        notes.extend(compiler.notes)
    return list(compilers.values()), notes


def _union(frames: Iterable[DataFrame | None]) -> DataFrame | None:
    result = None
    for frame in frames:
        if frame is not None:
            result = frame if result is None else result.unionByName(frame)
    return result


def build_graph(
    spark: SparkSession,
    maps: Sequence[TriplesMap],
    tables: Tables,
    options: Options = Options(),
    unique: frozenset[str] = frozenset(),
    watch: Watch | None = None,
    carry: Sequence[str] = (),
) -> Graph:
    """The bag of all triples of all maps; maps over one table share its scan.

    ``tables`` gives the stored table of a name, or the views that make it up.
    Maps whose query names no table are skipped with a note.

    ``unique`` names maps whose rows all have different subjects, as found by
    ``unique_subjects``.  Their triples cannot repeat, unless the same shape is
    made twice, and then stay out of the shuffle of ``distinct``.

    With a ``watch`` the action that writes the graph counts on its way.
    Columns named in ``carry`` go from each row to all its triples, as further
    columns of ``encoded``.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", LARGEST_METHOD)
    compilers, notes = _compile(spark, maps, tables, options)
    emissions = [e for compiler in compilers for e in compiler.emissions]
    numbers = {shape: i for i, shape in enumerate(dict.fromkeys(e.shape for e in emissions), 1)}
    prefixes = Prefixes()
    for compiler in compilers:
        prefixes |= compiler.prefixes
    overlap = _prefixes_overlap(numbers, prefixes)
    made = Counter(e.shape for e in emissions)

    def is_single(e: _Emission) -> bool:
        return not overlap and e.map in unique and made[e.shape] == 1

    bags, recipes = [], ()
    for compiler in compilers:
        made_by = compiler.encoded(spark, numbers, lambda e: not is_single(e), watch, carry, len(recipes) + 1)
        if made_by is not None:
            bags.append(made_by)
            recipes += made_by[1].recipes
    alone = [c.encoded(spark, numbers, is_single, watch, carry) for c in compilers]
    repeated, single = _union(bag for bag, _ in bags), _union(found[0] for found in alone if found is not None)
    # Carried columns stay with each triple.
    packed = Packed(_union(p.rows for _, p in bags), recipes) if bags and not carry else None
    if repeated is None:
        repeated = spark.createDataFrame([], ", ".join([ENCODED_SCHEMA, *[f"`{c}` long" for c in carry]]))
    graph = Graph(repeated, tuple(numbers), tuple(notes), prefixes, single, watch, packed)
    return graph.whole() if overlap else graph


def unique_subjects(
    spark: SparkSession, maps: Sequence[TriplesMap], tables: Tables, options: Options = Options()
) -> frozenset[str]:
    """Names of the maps whose rows all have different subjects.

    One aggregate over the subject keys alone; its result is a row per map.
    At scale this shuffles one key per row to save shuffling every triple.
    """
    compilers, _ = _compile(spark, maps, tables, options)
    parts = []
    times = Counter(name for compiler in compilers for name, _ in compiler.subjects)
    for compiler in compilers:
        for name, s in compiler.subjects:
            if times[name] > 1:  # several views, whose subjects may meet
                continue
            sizes = compiler.frame.select(compiler.columns[s].alias("s")).filter("s IS NOT NULL").groupBy("s").count()
            parts.append(sizes.agg(F.lit(name).alias("map"), F.max("count").alias("most")))
    checked = _union(parts)
    if checked is None:
        return frozenset()
    return frozenset(r.map for r in checked.filter("coalesce(most, 1) = 1").collect())


def reconcile(
    spark: SparkSession,
    maps: Sequence[TriplesMap],
    tables: Tables,
    options: Options = Options(),
) -> DataFrame:
    """Rows of each map's table, rows of its source that got a subject, and the difference.

    The source is what the graph reads: the stored table, or with
    ``source="query"`` the map's query, whose condition may drop rows.  All maps
    over one stored table are counted in one aggregate of one scan, all its
    column statistics from the same pass.  A subject of which the source has
    only some columns raises, as it does when the graph is built.
    """
    load = tables if callable(tables) else tables.__getitem__
    by_source: dict[tuple[str, str | None], list[TriplesMap]] = {}
    for tm in maps:
        if tm.table:
            by_source.setdefault((tm.table, tm.sql if options.source == "query" else None), []).append(tm)
    result = None
    for (table, sql), group in by_source.items():
        frame = as_frame(load(table)) if sql is None else as_frame(load(table)).sparkSession.sql(sql)
        fields = {f.name.lower(): f for f in frame.schema.fields}
        counts = [F.count(F.lit(1)).alias("rows_in")]
        for i, tm in enumerate(group):
            variables = Template(tm.subject).variables
            known = [fields[v.lower()] for v in variables if v.lower() in fields]
            if known and len(known) < len(variables):
                raise ValueError(f"{tm.name}: {table} has only some columns of the subject {tm.subject}")
            if not known:
                made = F.lit(0).cast("long")
            elif options.null_iri is None:
                complete = F.lit(True)
                for fld in known:
                    complete = complete & F.col(f"`{fld.name}`").isNotNull()
                made = F.count_if(complete)
            else:
                made = F.count(F.lit(1))
            counts.append(made.alias(f"m{i}"))
        totals = frame.agg(*counts)
        if sql is not None:
            whole = as_frame(load(table)).agg(F.count(F.lit(1)).alias("rows_in"))
            totals = whole.crossJoin(totals.drop("rows_in"))  # one row each
        per_map = totals.select(
            F.lit(table).alias("source_table"), "rows_in",
            F.inline(F.array(*[
                F.struct(F.lit(tm.name).alias("map"), F.col(f"m{i}").alias("rows_with_subject"))
                for i, tm in enumerate(group)
            ])),
        )
        part = per_map.select(
            "source_table", "map", "rows_in", "rows_with_subject",
            (F.col("rows_in") - F.col("rows_with_subject")).alias("difference"),
        )
        result = part if result is None else result.unionByName(part)
    return result


def reconcile_watched(spark: SparkSession, maps: Sequence[TriplesMap], tables: Tables, watch: Watch) -> DataFrame:
    """Rows of each map's table, rows that got a subject in the run that wrote the graph, and the difference.

    The first are counted from the tables, the second were counted on the way
    by ``watch``, so rows that a run loses between the two show as a difference.
    Maps that the graph left out have no rows with a subject.
    """
    load = tables if callable(tables) else tables.__getitem__
    made = watch.subjects()
    by_table: dict[str, list[TriplesMap]] = {}
    for tm in maps:
        if tm.table:
            by_table.setdefault(tm.table, []).append(tm)
    parts = []
    for table, group in by_table.items():
        per_map = spark.createDataFrame([(tm.name, made.get(tm.name, (0, 0))[1]) for tm in group], "map string, rows_with_subject long")
        rows = as_frame(load(table)).agg(F.count(F.lit(1)).alias("rows_in"))
        parts.append(rows.crossJoin(per_map).select(  # one row, and one per map
            F.lit(table).alias("source_table"), "map", "rows_in", "rows_with_subject",
            (F.col("rows_in") - F.col("rows_with_subject")).alias("difference")))
    return _union(parts)
