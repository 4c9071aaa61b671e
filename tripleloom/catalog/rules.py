"""Mapping rules over the driver tables, rule by rule and as whole maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleloom.catalog.oracle import distinct, key, map_sql, quoted, rows, with_relations
from tripleloom.catalog.registry import query, table
from tripleloom.catalog.standin import BRONZE_SQL, bronze_frames
from tripleloom.functions.lexical import XSD_ANY_URI, XSD_BOOLEAN, XSD_DATE, XSD_DOUBLE, XSD_STRING
from tripleloom.operators.rules import ObjectMap, TriplesMap, rules_frame
from tripleloom.operators.triples import (
    RDF_TYPE,
    Options,
    Watch,
    build_graph,
    reconcile,
    reconcile_watched,
    unique_subjects,
)
from tripleloom.session import scratch_dir
from tripleloom.sources.passes import write_in_passes
from tripleloom.sources.sinks import stored_lines, write_ntriples

ONT = "http://example.org/ontology/"
RES = "http://example.org/resource/"
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"

_KINDS = {
    "c_custkey": "int", "c_nationkey": "int", "c_acctbal": "double",
    "o_orderkey": "int", "o_custkey": "int", "o_totalprice": "double", "o_orderdate": "timestamp",
    "l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_shipdate": "timestamp",
    "s_suppkey": "int", "s_nationkey": "int", "s_acctbal": "double",
    "p_partkey": "int", "p_size": "int", "p_retailprice": "double",
    "n_nationkey": "int", "n_regionkey": "int", "r_regionkey": "int", "page_id": "int",
}


def _col(column, *predicates, datatype=None):
    return ObjectMap(tuple(ONT + p for p in predicates), column=column, datatype=datatype)


def _iri(template, *predicates):
    return ObjectMap(tuple(ONT + p for p in predicates), template=RES + template)


def _map(name, source, subject, classes=(), *objects):
    return TriplesMap(name, f"SELECT * FROM {source}", RES + subject, tuple(ONT + c for c in classes), objects)


SALES_MAPS = (
    _map("customer", "customer", "Customer/{c_custkey}", ("Customer", "Agent"),
         _col("c_name", "name", "legal_name"), _col("c_acctbal", "balance", datatype=XSD_DOUBLE),
         _iri("Nation/{c_nationkey}", "nation"), _iri("Segment/{c_mktsegment}", "segment")),
    _map("order", "orders", "Order/{o_orderkey}", ("Order",),
         _col("o_totalprice", "total", datatype=XSD_DOUBLE), _col("o_orderdate", "date", datatype=XSD_DATE),
         _iri("Customer/{o_custkey}", "ordered_by"), _iri("Status/{o_orderstatus}", "status"),
         _iri("Priority/{o_orderpriority}", "priority")),
    _map("customer_order", "orders", "Customer/{o_custkey}", ("Customer",), _iri("Order/{o_orderkey}", "has_order")),
    _map("line", "lineitem", "Line/{l_orderkey}/{l_linenumber}", ("Line",),
         _col("l_quantity", "quantity", datatype=XSD_DOUBLE), _col("l_discount", "discount", datatype=XSD_DOUBLE),
         _col("l_tax", "tax", datatype=XSD_DOUBLE), _col("l_shipdate", "shipped", datatype=XSD_DATE),
         _iri("Part/{l_partkey}", "part"), _iri("Supplier/{l_suppkey}", "supplier"),
         _iri("Flag/{l_returnflag}-{l_linestatus}", "flags")),
    _map("order_line", "lineitem", "Order/{l_orderkey}", (), _iri("Part/{l_partkey}", "contains", "mentions")),
    _map("supplier", "supplier", "Supplier/{s_suppkey}", ("Supplier", "Agent"),
         _col("s_name", "name"), _col("s_acctbal", "balance", datatype=XSD_DOUBLE),
         _iri("Nation/{s_nationkey}", "nation")),
    _map("part", "part", "Part/{p_partkey}", ("Part",),
         _col("p_name", "name"), _col("p_size", "size"), _col("p_retailprice", "price", datatype=XSD_DOUBLE),
         _iri("Brand/{p_brand}", "brand"), _iri("Type/{p_type}", "type")),
    _map("nation", "nation", "Nation/{n_nationkey}", ("Nation",),
         _col("n_name", "name"), _iri("Region/{n_regionkey}", "region")),
    _map("region", "region", "Region/{r_regionkey}", ("Region",), _col("r_name", "name")),
)


def graph_of(spark, sf_dir, maps, options=Options(), tables=None):
    def load(name):
        return tables[name] if tables else table(spark, sf_dir, name)

    return build_graph(spark, maps, load, options)


def _whole(source, maps):
    def run(spark, sf_dir):
        return graph_of(spark, sf_dir, maps).distinct().triples()

    query(f"triples_{source}", distinct(" UNION ALL ".join(map_sql(m, source, _KINDS) for m in maps)))(run)


for _source in ("customer", "orders", "lineitem", "supplier", "part", "nation"):
    _whole(_source, [m for m in SALES_MAPS if m.table == _source])


def _one(name, source, sql, *objects, subject=None, classes=(), options=Options(), view=None):
    """One small map; ``view`` shapes the table, ``sql`` says what comes out."""
    tm = TriplesMap(name, f"SELECT * FROM {source}", subject or RES + "Customer/{c_custkey}", tuple(classes), objects)

    def run(spark, sf_dir):
        frame = table(spark, sf_dir, source)
        frame = frame if view is None else frame.selectExpr(*view)
        return graph_of(spark, sf_dir, [tm], options, {source: frame}).distinct().triples()

    query(name, distinct(sql))(run)


_CUSTOMER = quoted(RES + "Customer/") + " || CAST(c_custkey AS VARCHAR)"
_ORDER = quoted(RES + "Order/") + " || CAST(o_orderkey AS VARCHAR)"
_LINE = quoted(RES + "Line/") + " || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)"
_LINE_IRI = RES + "Line/{l_orderkey}-{l_linenumber}"
_NATION = quoted(RES + "Nation/")

_one("subject_iri", "customer",
     rows(f"{quoted(RES + 'Customer/')} || {key('c_name')}", RDF_TYPE, quoted(ONT + "Customer"), "iri", "", "customer"),
     subject=RES + "Customer/{C_NAME}", classes=[ONT + "Customer"])
_one("object_iri", "customer",
     rows(_CUSTOMER, ONT + "nation", f"{_NATION} || CAST(c_nationkey AS VARCHAR)", "iri", "", "customer"),
     _iri("Nation/{C_NationKey}", "nation"))
_one("object_iri_null", "customer",
     rows(_CUSTOMER, ONT + "nation", f"{_NATION} || coalesce(CAST(nullif(c_nationkey, 7) AS VARCHAR), 'NONE')",
          "iri", "", "customer"),
     _iri("Nation/{n}", "nation"), view=["c_custkey", "nullif(c_nationkey, 7) AS n"])
_one("object_iri_null_dropped", "customer",
     rows(_CUSTOMER, ONT + "nation", f"{_NATION} || CAST(c_nationkey AS VARCHAR)", "iri", "", "customer",
          "c_nationkey <> 7"),
     _iri("Nation/{n}", "nation"), view=["c_custkey", "nullif(c_nationkey, 7) AS n"], options=Options(null_iri=None))
_one("object_iri_missing_col", "customer",
     rows(_CUSTOMER, ONT + "nation", f"{_NATION} || CAST(c_nationkey AS VARCHAR)", "iri", "", "customer"),
     _iri("Nation/{c_nationkey}", "nation"), _iri("Nation/{c_nationkey}/{absent}", "elsewhere"))
_one("literal_string", "customer", rows(_CUSTOMER, ONT + "name", "c_name", "literal", XSD_STRING, "customer"),
     _col("c_name", "name", datatype=XSD_STRING))
_one("literal_double", "orders",
     rows(_ORDER, ONT + "total", "CAST(o_totalprice AS VARCHAR)", "literal", XSD_DOUBLE, "orders", "o_totalprice <> 0")
     + " UNION ALL " + rows(_ORDER, ONT + "scaled", "CAST(o_totalprice * 1000 AS VARCHAR)", "literal", XSD_DOUBLE,
                            "orders", "o_totalprice <> 0"),
     _col("o_totalprice", "total", datatype=XSD_DOUBLE), _col("scaled", "scaled", datatype=XSD_DOUBLE),
     subject=RES + "Order/{o_orderkey}", view=["o_orderkey", "o_totalprice", "o_totalprice * 1000 AS scaled"])
_one("literal_date", "orders",
     rows(_ORDER, ONT + "date", "strftime(o_orderdate, '%Y-%m-%d')", "literal", XSD_DATE, "orders")
     + " UNION ALL " + rows(_ORDER, ONT + "compact", "CASE WHEN o_orderstatus = 'P' THEN 'unknown' "
                            "ELSE strftime(o_orderdate, '%Y-%m-%d') END", "literal", XSD_DATE, "orders"),
     _col("o_orderdate", "date", datatype=XSD_DATE), _col("compact", "compact", datatype=XSD_DATE),
     subject=RES + "Order/{o_orderkey}",
     view=["o_orderkey", "o_orderdate", "CASE WHEN o_orderstatus = 'P' THEN 'unknown' "
           "ELSE date_format(o_orderdate, 'yyyyMMdd') END AS compact"])
_one("literal_uri", "pages",
     rows(f"{quoted(RES + 'Page/')} || CAST(page_id AS VARCHAR)", ONT + "url", "url", "literal", XSD_ANY_URI, "pages"),
     _col("url", "url", datatype=XSD_ANY_URI), subject=RES + "Page/{page_id}")
_one("literal_default_type", "customer",
     rows(_CUSTOMER, ONT + "segment", "c_mktsegment", "literal", XSD_STRING, "customer"), _col("c_mktsegment", "segment"))
_one("literal_truthy", "lineitem",
     " UNION ALL ".join([
         rows(_LINE, ONT + "discount", "CAST(l_discount AS VARCHAR)", "literal", XSD_DOUBLE, "lineitem", "l_discount <> 0"),
         rows(_LINE, ONT + "tax", "CAST(l_tax AS VARCHAR)", "literal", XSD_DOUBLE, "lineitem", "l_tax <> 0"),
         rows(_LINE, ONT + "flag", "l_returnflag", "literal", XSD_STRING, "lineitem", "l_returnflag <> 'N'"),
         rows(_LINE, ONT + "digit", "CAST(l_linenumber - 1 AS VARCHAR)", "literal", XSD_STRING, "lineitem"),
         rows(_LINE, ONT + "taxed", "'true'", "literal", XSD_BOOLEAN, "lineitem", "l_tax > 0"),
     ]),
     _col("l_discount", "discount", datatype=XSD_DOUBLE), _col("l_tax", "tax", datatype=XSD_DOUBLE),
     _col("flag", "flag"), _col("digit", "digit"), _col("taxed", "taxed", datatype=XSD_BOOLEAN), subject=_LINE_IRI,
     view=["l_orderkey", "l_linenumber", "l_discount", "l_tax", "replace(l_returnflag, 'N', '') AS flag",
           "CAST(l_linenumber - 1 AS STRING) AS digit", "l_tax > 0 AS taxed"])
_one("literal_missing_col", "customer", rows(_CUSTOMER, ONT + "name", "c_name", "literal", XSD_STRING, "customer"),
     _col("C_NAME", "name"), _col("absent", "nothing"))
_one("class_triples", "customer",
     rows(_CUSTOMER, RDF_TYPE, quoted(ONT + "Customer"), "iri", "", "customer")
     + " UNION ALL " + rows(_CUSTOMER, RDF_TYPE, quoted(ONT + "Agent"), "iri", "", "customer"),
     classes=[ONT + "Customer", ONT + "Agent", ONT + "Customer"])
_one("predicate_fanout", "customer",
     " UNION ALL ".join(rows(_CUSTOMER, p, "c_name", "literal", XSD_STRING, "customer")
                        for p in (ONT + "name", LABEL, ONT + "alias")),
     ObjectMap((ONT + "name", LABEL, f"{ONT}name, {ONT}alias"), column="c_name"))
_one("predicate_multi_column", "lineitem",
     rows(_LINE, ONT + "code", "l_returnflag", "literal", XSD_STRING, "lineitem")
     + " UNION ALL " + rows(_LINE, ONT + "code", "l_linestatus", "literal", XSD_STRING, "lineitem"),
     _col("l_returnflag", "code"), _col("l_linestatus", "code"), subject=_LINE_IRI)
_one("constant_object", "customer", rows(_CUSTOMER, ONT + "active", "'true'", "literal", XSD_BOOLEAN, "customer"),
     ObjectMap((ONT + "active",), constant="true", datatype=XSD_BOOLEAN), options=Options(constants=True))


@query("subject_missing_col", """
    SELECT 'found' AS map, count(*) AS triples, CAST(NULL AS VARCHAR) AS reason FROM customer
    UNION ALL SELECT 'unknown', 0, 'no subject column in the table'""")
def subject_missing(spark, sf_dir):
    """A map whose subject columns are all absent gives no triples, only a note."""
    maps = [_map("found", "customer", "Customer/{c_custkey}", ("C",)), _map("unknown", "customer", "X/{absent}", ("C",))]
    frame = None
    for tm in maps:
        graph = graph_of(spark, sf_dir, [tm])
        reason = F.lit(graph.notes[0].reason if graph.notes else None).cast("string")
        part = graph.encoded.agg(F.lit(tm.name).alias("map"), F.count(F.lit(1)).alias("triples")).select(
            "map", "triples", reason.alias("reason"))
        frame = part if frame is None else frame.unionByName(part)
    return frame


_SALES_BAG = " UNION ALL ".join(map_sql(m, m.table, _KINDS) for m in SALES_MAPS)


def _sales_counts(spark, sf_dir, is_set):
    graph = graph_of(spark, sf_dir, SALES_MAPS)
    return (graph.distinct() if is_set else graph).predicate_counts()


@query("graph_union", f"SELECT p, o_kind, count(*) AS triples FROM ({_SALES_BAG}) GROUP BY ALL")
def graph_union(spark, sf_dir):
    return _sales_counts(spark, sf_dir, False)


@query("graph_distinct", f"SELECT p, o_kind, count(*) AS triples FROM ({distinct(_SALES_BAG)}) GROUP BY ALL")
def graph_distinct(spark, sf_dir):
    return _sales_counts(spark, sf_dir, True)


@query("graph_in_passes", f"SELECT p, count(*) AS triples FROM ({distinct(_SALES_BAG)}) GROUP BY ALL")
def graph_in_passes(spark, sf_dir):
    """The same set, written in three committed passes and counted from the lines in the files."""
    tables = {tm.table: table(spark, sf_dir, tm.table) for tm in SALES_MAPS}
    path = scratch_dir(spark, "passes")
    write_in_passes(spark, SALES_MAPS, tables, path, passes=3, compression="gzip")
    predicate = F.substring_index(F.substring_index("value", "> ", 2), "<", -1)
    return spark.read.text(path).groupBy(predicate.alias("p")).agg(F.count(F.lit(1)).alias("triples"))


@query("graph_unique_subjects", f"SELECT p, o_kind, count(*) AS triples FROM ({distinct(_SALES_BAG)}) GROUP BY ALL")
def graph_unique_subjects(spark, sf_dir):
    """The same set, with triples of maps that have a subject per row kept out of the shuffle."""
    def load(name):
        return table(spark, sf_dir, name)

    unique = unique_subjects(spark, SALES_MAPS, load)
    return build_graph(spark, SALES_MAPS, load, unique=unique).distinct().predicate_counts()


def _rule_sql():
    parts = []
    for m in SALES_MAPS:
        bag = map_sql(m, m.table, _KINDS)
        parts.append(f"""SELECT '{m.name}' AS map, p AS predicate, count(*) AS triples
                         FROM ({bag}) WHERE p <> '{RDF_TYPE}' GROUP BY ALL""")
    kinds = ", ".join(
        f"('{m.name}', {quoted(p)}, '{o.kind}', {quoted(o.value)}, "
        + ("NULL" if o.kind == "template" else quoted(o.literal_type)) + ")"
        for m in SALES_MAPS for o in m.objects for p in o.predicates)
    return with_relations(
        {"counted": " UNION ALL ".join(parts),
         "rule": f"SELECT * FROM (VALUES {kinds}) t(map, predicate, kind, value, datatype)"},
        "SELECT map, kind, predicate, value, datatype, coalesce(triples, 0) AS triples "
        "FROM rule LEFT JOIN counted USING (map, predicate)")


@query("mapping_rules", _rule_sql())
def mapping_rules(spark, sf_dir):
    """Every rule of the mapping with the number of triples it makes."""
    counted = None
    for tm in SALES_MAPS:
        counts = graph_of(spark, sf_dir, [tm]).predicate_counts()
        part = counts.filter(F.col("p") != RDF_TYPE).select(
            F.lit(tm.name).alias("map"), F.col("p").alias("predicate"), "triples")
        counted = part if counted is None else counted.unionByName(part)
    rule = rules_frame(spark, SALES_MAPS).filter(F.col("kind") != "class")
    return rule.join(counted, ["map", "predicate"], "left").select(
        "map", "kind", "predicate", "value", "datatype", F.coalesce("triples", F.lit(0).cast("long")).alias("triples"))


@query("reconcile", " UNION ALL ".join(
    f"SELECT '{m.table}' AS source_table, '{m.name}' AS map, count(*) AS rows_in, count(*) AS rows_with_subject, "
    f"CAST(0 AS BIGINT) AS difference FROM {m.table}" for m in SALES_MAPS)
    + " UNION ALL SELECT 'customer', 'lost', count(*), 0, count(*) FROM customer")
def reconcile_counts(spark, sf_dir):
    lost = _map("lost", "customer", "X/{absent}", ("C",))
    return reconcile(spark, [*SALES_MAPS, lost], lambda name: table(spark, sf_dir, name))


_CITIES = TriplesMap(
    "cities", "SELECT * FROM estabelecimento", "http://example.org/city/{NM_CIDADE_EXTERIOR}",
    classes=("http://example.org/City",), objects=(ObjectMap(("http://example.org/state",), column="UF"),))
_STATES = TriplesMap(
    "states", "SELECT * FROM estabelecimento", "http://example.org/state/{UF}", classes=("http://example.org/State",))


@query("reconcile_watched", f"""
    WITH b AS ({BRONZE_SQL['estabelecimento']})
    SELECT 'estabelecimento' AS source_table, 'cities' AS map, count(*) AS rows_in,
        count("NM_CIDADE_EXTERIOR") AS rows_with_subject, count(*) - count("NM_CIDADE_EXTERIOR") AS difference FROM b
    UNION ALL SELECT 'estabelecimento', 'states', count(*), count("UF"), count(*) - count("UF") FROM b""")
def watched_reconciliation(spark, sf_dir):
    """Branches without a foreign city, or without a state, give no subject; counted by the run that writes the lines."""
    tables, watch = {"estabelecimento": bronze_frames(spark, sf_dir)["estabelecimento"]}, Watch()
    graph = build_graph(spark, [_CITIES, _STATES], tables, Options(null_iri=None), watch=watch).distinct()
    write_ntriples(graph, scratch_dir(spark, "watched"))
    return reconcile_watched(spark, [_CITIES, _STATES], tables, watch)


@query("written_lines", """
    SELECT count(*) * 2 AS triples, count(*) * 2 AS lines, count(*) * 2 AS stored_lines, true AS same_lines FROM nation""")
def lines_written(spark, sf_dir):
    """Triples made, lines written and lines found in the files of a graph over ``nation``."""
    tm = TriplesMap("nations", "SELECT * FROM nation", "http://example.org/nation/{n_nationkey}",
                    classes=("http://example.org/Nation",), objects=(ObjectMap(("http://example.org/name",), column="n_name"),))
    watch, path = Watch(), scratch_dir(spark, "lines")
    write_ntriples(build_graph(spark, [tm], {"nation": table(spark, sf_dir, "nation")}, watch=watch).distinct(), path)
    made, stored = watch.written(), stored_lines(spark, path)
    same = (made["lines"], made["checksum"]) == (stored["lines"], stored["checksum"])
    return spark.createDataFrame([(made["triples"], made["lines"], stored["lines"], same)],
                                 "triples long, lines long, stored_lines long, same_lines boolean")
