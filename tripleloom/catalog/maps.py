"""The company register's mapping over the refined stand-in tables."""

from __future__ import annotations

from tripleloom.catalog.oracle import distinct, map_sql, with_relations
from tripleloom.catalog.registry import query
from tripleloom.catalog.silver import BRONZE, SILVER_SQL
from tripleloom.catalog.standin import CODES, bronze_frames
from tripleloom.operators.triples import Graph, Options, as_frame, build_graph, reconcile
from tripleloom.plans.register_mapping import REGISTER_MAPS
from tripleloom.plans.silver import SILVER, fan_out
from tripleloom.sources.tables import register_views

_DATES = ("DATA_INICIO_ATIV", "DATA_INICIO_SOCIEDADE", "DATA_OPCAO_SIMPLES", "DATA_EXCLUSAO_SIMPLES",
          "DATA_INICIO_SIT_ESPECIAL", "VAL_DATA_SITUACAO")
_KINDS = {**{name.lower(): "date" for name in _DATES}, "capital_social": "double"}
_RELATIONS = {**BRONZE, **SILVER_SQL}


def register_graph(spark, sf_dir, maps=REGISTER_MAPS, options=Options()) -> Graph:
    """Graph of the register from the driver tables, through bronze and silver."""
    names = dict.fromkeys(tm.table for tm in maps)
    return build_graph(spark, maps, fan_out(bronze_frames(spark, sf_dir), CODES, names), options)


def _single(tm):
    def run(spark, sf_dir):
        return register_graph(spark, sf_dir, [tm]).distinct().triples()

    relations = {**BRONZE, tm.table: SILVER_SQL[tm.table]}
    query(f"map_{tm.name.lower()}", with_relations(relations, distinct(map_sql(tm, tm.table, _KINDS))))(run)


for _tm in REGISTER_MAPS:
    _single(_tm)

_BAG = " UNION ALL ".join(map_sql(tm, tm.table, _KINDS) for tm in REGISTER_MAPS)


@query("register_graph", with_relations(
    _RELATIONS, f"SELECT p, o_kind, count(*) AS triples FROM ({distinct(_BAG)}) GROUP BY ALL"))
def whole_register(spark, sf_dir):
    """Triples per predicate of the whole register's graph as one set."""
    return register_graph(spark, sf_dir).distinct().predicate_counts()


# Columns that a map reads but its own query does not give.
_ABSENT = {"Address": ("NOME_PAIS", "ID_CIDADE"), "AddressExt": ("NOME_PAIS", "CITY_EXT"),
           "Socio_RFB_PF": ("ID_URI",)}
_DECLARED = " UNION ALL ".join(
    map_sql(tm, tm.table, _KINDS, _ABSENT.get(tm.name, ()), constants=True) for tm in REGISTER_MAPS)


def _declared_graph(spark, sf_dir, maps):
    tables = fan_out(bronze_frames(spark, sf_dir), CODES, dict.fromkeys(tm.table for tm in maps))
    register_views({name: as_frame(table) for name, table in tables.items()})
    return build_graph(spark, maps, tables, Options(source="query", constants=True))


@query("register_declared", with_relations(
    _RELATIONS, f"SELECT p, o_kind, count(*) AS triples FROM ({distinct(_DECLARED)}) GROUP BY ALL"))
def declared_register(spark, sf_dir):
    """The same with each map's own SQL run, and constant objects emitted."""
    return _declared_graph(spark, sf_dir, REGISTER_MAPS).distinct().predicate_counts()


def _declared_single(name):
    tm = next(m for m in REGISTER_MAPS if m.name == name)

    def run(spark, sf_dir):
        return _declared_graph(spark, sf_dir, [tm]).distinct().triples()

    sql = map_sql(tm, tm.table, _KINDS, _ABSENT.get(name, ()), constants=True)
    relations = {**BRONZE, tm.table: SILVER_SQL[tm.table]}
    query(f"declared_{name.lower()}", with_relations(relations, distinct(sql)))(run)


for _name in ("Address", "AddressExt", "Estrangeiro"):
    _declared_single(_name)


@query("register_reconcile", with_relations(_RELATIONS, " UNION ALL ".join(
    f"SELECT '{tm.table}' AS source_table, '{tm.name}' AS map, count(*) AS rows_in, "
    f"count(*) AS rows_with_subject, CAST(0 AS BIGINT) AS difference FROM {tm.table}" for tm in REGISTER_MAPS)))
def register_reconcile(spark, sf_dir):
    bronze = bronze_frames(spark, sf_dir)
    return reconcile(spark, REGISTER_MAPS, lambda name: SILVER[name](bronze, CODES))
