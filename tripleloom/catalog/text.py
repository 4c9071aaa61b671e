"""Scalar expressions over whole text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleloom.catalog.oracle import key, quoted, typed_key
from tripleloom.catalog.registry import query, table
from tripleloom.functions import compact_iri, iri_key, strip_accents
from tripleloom.functions.lexical import XSD_ANY_URI, XSD_STRING
from tripleloom.operators.rules import ObjectMap, TriplesMap
from tripleloom.operators.triples import build_graph
from tripleloom.plans.register_mapping import MAPPING_PREFIXES


@query("strip_accents", "SELECT doc_id, strip_accents(text) AS plain FROM documents")
def accents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", strip_accents(F.col("text")).alias("plain"))


@query("normalize_uri_text", f"""
    SELECT 'documents' AS source, doc_id AS id, 0 AS turn, {key('text')} AS key FROM documents
    UNION ALL SELECT 'conversations', conv_id, turn, {key('text')} FROM conversations
    UNION ALL SELECT 'benchmark', item_id, 0, {key('text')} FROM benchmark
    UNION ALL SELECT 'pages', page_id, 0, {key('html')} FROM pages""")
def normalize_text(spark, sf_dir):
    def keys(name, number, column, turn=F.lit(0).cast("long")):
        frame = table(spark, sf_dir, name)
        text = iri_key(F.col(column), frame.schema[column].dataType)
        return frame.select(F.lit(name).alias("source"), F.col(number).alias("id"), turn.alias("turn"), text.alias("key"))

    return (
        keys("documents", "doc_id", "text")
        .unionByName(keys("conversations", "conv_id", "text", F.col("turn")))
        .unionByName(keys("benchmark", "item_id", "text"))
        .unionByName(keys("pages", "page_id", "html"))
    )


_TYPED = {
    "k_long": ("l_orderkey", "int"), "k_null": ("nullif(l_linenumber, 1)", "int"),
    "k_minus": ("0 - l_linenumber", "int"),
    "k_date": ("CAST(l_shipdate AS DATE)", "date"), "k_time": ("l_shipdate", "timestamp"),
    "k_double": ("l_extendedprice", "double"), "k_scaled": ("l_extendedprice * 1000", "double"),
}


@query("normalize_uri_types", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"{typed_key(x, kind)} AS {name}" for name, (x, kind) in _TYPED.items()
) + """, CASE WHEN l_tax > 0 THEN 'TRUE' ELSE 'FALSE' END AS k_bool,
    replace(CAST(CAST(l_discount AS DECIMAL(12, 2)) AS VARCHAR), '.', '') AS k_decimal FROM lineitem""")
def normalize_types(spark, sf_dir):
    typed = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", *[f"{x} AS {name}" for name, (x, _) in _TYPED.items()],
        "l_tax > 0 AS k_bool", "CAST(l_discount AS DECIMAL(12, 2)) AS k_decimal",
    )
    return typed.select(
        "l_orderkey", "l_linenumber",
        *[iri_key(F.col(f.name), f.dataType).alias(f.name) for f in typed.schema.fields[2:]],
    )


_DOC = "http://example.org/doc/"
_ESCAPED = r"""replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'),
    chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"""


@query("ntriples_lines", f"""
    SELECT '<{_DOC}' || CAST(doc_id AS VARCHAR) || '> <{_DOC}text> "' || {_ESCAPED} || '" .' AS value FROM documents
    UNION ALL
    SELECT '<{_DOC}' || CAST(page_id AS VARCHAR) || '> <{_DOC}url> "' || url || '"^^<{XSD_ANY_URI}> .' FROM pages
    UNION ALL
    SELECT '<{_DOC}' || CAST(page_id AS VARCHAR) || '> <{_DOC}next> <{_DOC}' || CAST(page_id AS VARCHAR) || '/next> .'
    FROM pages""")
def lines(spark, sf_dir):
    """Plain and typed literals and IRIs, through the renderer of the triple sink."""
    maps = (
        TriplesMap("documents", "SELECT * FROM documents", _DOC + "{doc_id}", (),
                   (ObjectMap((_DOC + "text",), column="text", datatype=XSD_STRING),)),
        TriplesMap("pages", "SELECT * FROM pages", _DOC + "{page_id}", (),
                   (ObjectMap((_DOC + "url",), column="url", datatype=XSD_ANY_URI),
                    ObjectMap((_DOC + "next",), template=_DOC + "{page_id}/next"))),
    )
    return build_graph(spark, maps, {m.table: table(spark, sf_dir, m.table) for m in maps}).lines()


_PREFIXES = {**MAPPING_PREFIXES, "page": "http://", "word": "http://th"}


def _compact_sql(x: str) -> str:
    ordered = sorted(_PREFIXES.items(), key=lambda item: -len(item[1]))
    cases = " ".join(
        f"WHEN starts_with({x}, {quoted(ns)}) THEN '{name}:' || substr({x}, {len(ns) + 1})" for name, ns in ordered)
    return f"CASE {cases} ELSE {x} END"


_TERM = f"{quoted(MAPPING_PREFIXES['cnpj'])} || o_orderstatus"


@query("compact_iri", f"""
    SELECT url AS iri, {_compact_sql('url')} AS shown FROM pages
    UNION ALL SELECT {_TERM}, {_compact_sql(_TERM)} FROM orders""")
def compact(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("iri"))
    terms = table(spark, sf_dir, "orders").select(
        F.concat(F.lit(MAPPING_PREFIXES["cnpj"]), "o_orderstatus").alias("iri"))
    return urls.unionByName(terms).select("iri", compact_iri(F.col("iri"), _PREFIXES).alias("shown"))
