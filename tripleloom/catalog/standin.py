"""Driver tables in the shape of the ten bronze register tables.

customer stands for companies, orders for branches, lineitem for partnerships,
part for activities and nation for the code lookups.  Every row of the source
tables is used.  ``BRONZE_SQL`` says the same in DuckDB's dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripleloom.catalog.registry import table
from tripleloom.plans.silver import Codes
from tripleloom.sources.bronze import SCHEMAS

CODES = Codes(head_office="1", company="1", person="2", foreigner="3", opted="S", home_country="BRASIL")

# Per bronze table: source, and per column an expression valid in both dialects.
# {ymd:x} is the yyyyMMdd text of a timestamp, {day:n} the same of a day offset.
_SHAPES: dict[str, tuple[str, list[str]]] = {
    "razao_situacao": (
        "(SELECT DISTINCT o_orderpriority FROM orders)",
        ["substr(o_orderpriority, 1, 1)", "nullif(substr(o_orderpriority, 3), 'NOT SPECIFIED')"]),
    "cnae": ("part", ["CAST(p_partkey AS {text})", "p_name"]),
    "municipio": ("nation", ["CAST(n_nationkey AS {text})", "n_name"]),
    "nat_ju": ("nation", ["CAST(n_nationkey AS {text})", "n_name"]),
    "pais": ("nation", ["CAST(n_nationkey AS {text})", "n_name"]),
    "qualif_socio": ("nation", ["CAST(n_nationkey AS {text})", "n_name"]),
    "empresa": ("customer", [
        "CAST(c_custkey AS {text})", "c_name", "CAST(c_nationkey AS {text})", "CAST(c_nationkey AS {text})",
        "replace(CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS {text}), '.', ',')", "c_mktsegment",
        "CAST(NULL AS {text})"]),
    "estabelecimento": ("orders", [
        "CAST(o_custkey AS {text})",
        "lpad(CAST(o_orderkey AS {text}), 12, '0')",
        "'00'",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN '1' ELSE '2' END",
        "nullif(substr(o_orderpriority, 3), 'NOT SPECIFIED')",
        "o_orderstatus",
        "{ymd:o_orderdate}",
        "substr(o_orderpriority, 1, 1)",
        "CASE WHEN o_orderstatus = 'P' THEN 'City ' || CAST(month(o_orderdate) AS {text}) END",
        "CASE WHEN o_orderstatus = 'P' THEN CAST(month(o_orderdate) AS {text}) END",
        "{ymd:o_orderdate}",
        "CAST(CAST(floor(o_totalprice) AS BIGINT) AS {text})",
        "CAST(year(o_orderdate) AS {text}) || ', ' || CAST(month(o_orderdate) AS {text}) || ',, ' || "
        "CAST(day(o_orderdate) AS {text}) || ' '",
        "'RUA'",
        "'Praça ' || CAST(day(o_orderdate) AS {text})",
        "CAST(day(o_orderdate) AS {text})",
        "nullif(o_orderpriority, '5-LOW')",
        "substr(o_orderpriority, 3)",
        "CAST(o_custkey AS {text})",
        "CASE o_orderstatus WHEN 'F' THEN 'SP' WHEN 'O' THEN 'MS' END",
        "CAST(month(o_orderdate) AS {text})",
        "'85'",
        "CAST(o_orderkey AS {text})",
        "CASE WHEN o_orderstatus = 'F' THEN '86' END",
        "CAST(o_custkey AS {text})",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN '87' END",
        "CAST(o_orderkey AS {text})",
        "'order' || CAST(o_orderkey AS {text}) || '@example.com'",
        "CASE WHEN o_orderpriority = '2-HIGH' THEN 'EM LIQUIDAÇÃO' END",
        "CASE WHEN o_orderpriority = '2-HIGH' THEN {ymd:o_orderdate} END"]),
    "socio": ("lineitem", [
        "CAST(l_suppkey AS {text})",
        "CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '2' ELSE '3' END",
        "'Sócio ' || CAST(l_partkey AS {text})",
        "CASE WHEN l_linenumber <> 4 THEN CAST(l_partkey AS {text}) END",
        "CAST(l_linenumber AS {text})",
        "{ymd:l_shipdate}",
        "CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber AS {text}) END",
        "CASE WHEN l_tax > 0 THEN CAST(l_suppkey AS {text}) END",
        "CASE WHEN l_tax > 0 THEN 'Rep ' || CAST(l_suppkey AS {text}) END",
        "CASE WHEN l_tax > 0 THEN CAST(l_linenumber + 10 AS {text}) END",
        "CAST(CAST(floor(l_quantity / 10) AS BIGINT) AS {text})"]),
    "simei": ("customer", [
        "CAST(c_custkey AS {text})",
        "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'S' ELSE 'N' END",
        "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN {day:CAST(floor(c_acctbal / 10) AS INT)} END",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN {day:CAST(floor(c_acctbal / 5) AS INT)} ELSE '00000000' END",
        "CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'S' ELSE 'N' END",
        "CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN {day:CAST(floor(c_acctbal / 10) AS INT)} END",
        "CAST(NULL AS {text})"]),
}

_SPARK = {
    "text": "STRING",
    "ymd": lambda x: f"date_format({x}, 'yyyyMMdd')",
    "day": lambda n: f"date_format(date_add(DATE '2007-07-01', {n}), 'yyyyMMdd')",
}
_DUCK = {
    "text": "VARCHAR",
    "ymd": lambda x: f"strftime({x}, '%Y%m%d')",
    "day": lambda n: f"strftime(DATE '2007-07-01' + {n}, '%Y%m%d')",
}


def _fill(expression: str, dialect: dict) -> str:
    text = expression.replace("{text}", dialect["text"])
    for name in ("ymd", "day"):
        while f"{{{name}:" in text:
            start = text.index(f"{{{name}:")
            end = text.index("}", start)
            text = text[:start] + dialect[name](text[start + len(name) + 2:end]) + text[end + 1:]
    return text


def _columns(name: str, dialect: dict) -> list[str]:
    _, expressions = _SHAPES[name]
    return [f"{_fill(e, dialect)} AS {c}" for e, c in zip(expressions, SCHEMAS[name].names, strict=True)]


BRONZE_SQL = {
    name: f"SELECT {', '.join(_columns(name, _DUCK))} FROM {source}" for name, (source, _) in _SHAPES.items()
}


def bronze_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The ten bronze tables as lazy frames over the driver tables."""
    frames = {}
    for name, (source, _) in _SHAPES.items():
        if source.startswith("("):
            rows = table(spark, sf_dir, "orders").select("o_orderpriority").distinct()
        else:
            rows = table(spark, sf_dir, source)
        frames[name] = rows.selectExpr(*_columns(name, _SPARK))
    return frames
