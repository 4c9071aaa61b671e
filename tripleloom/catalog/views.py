"""Logical views: projection, constant column, code lookup, composed label."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleloom.catalog.registry import query, table
from tripleloom.catalog.standin import BRONZE_SQL, bronze_frames
from tripleloom.plans.register_mapping import ADDRESS_LABEL, STATE_CODES, label_sql, state_code_sql
from tripleloom.plans.silver import dashed, state_code
from tripleloom.sources.tables import register_views


def _orders_view(spark, sf_dir):
    register_views({"orders_view": table(spark, sf_dir, "orders")})


@query("view_projection", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def projection(spark, sf_dir):
    _orders_view(spark, sf_dir)
    return spark.sql("SELECT o_orderkey, o_custkey, o_orderdate FROM orders_view")


@query("view_constant", "SELECT o_orderkey, 'SOCIO_PESSOA_FISICA' AS tipo FROM orders")
def constant(spark, sf_dir):
    _orders_view(spark, sf_dir)
    return spark.sql("SELECT o_orderkey, 'SOCIO_PESSOA_FISICA' AS tipo FROM orders_view")


# Nation numbers pick one of the listed state names; numbers past the list give none.
_NAMES = "[" + ", ".join(f"'{name}'" for name in STATE_CODES) + "]"
_CASES = " ".join(f"WHEN '{name}' THEN '{code}'" for name, code in STATE_CODES.items())


@query("view_case_lookup", f"""
    WITH named AS (SELECT c_custkey, coalesce({_NAMES}[c_nationkey + 2], 'ELSEWHERE') AS estado FROM customer),
    more AS (SELECT * FROM named UNION ALL SELECT o_orderkey, o_orderstatus FROM orders)
    SELECT *, CASE estado {_CASES} END AS uf, CASE estado {_CASES} END AS uf_sql FROM more""")
def case_lookup(spark, sf_dir):
    names = F.array(*[F.lit(name) for name in STATE_CODES])
    named = table(spark, sf_dir, "customer").select(
        "c_custkey", F.coalesce(F.get(names, F.col("c_nationkey") + 1), F.lit("ELSEWHERE")).alias("estado"))
    more = named.unionByName(table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("c_custkey"), F.col("o_orderstatus").alias("estado")))
    return more.select("*", state_code(F.col("estado")).alias("uf"), F.expr(state_code_sql("estado")).alias("uf_sql"))


_ADDRESS = {
    "PAIS": "COD_PAIS", "LOGRADOURO": "LOGRADOURO", "NUMERO": "NUMERO", "COMPLEMENTO": "COMPLEMENTO",
    "BAIRRO": "BAIRRO", "CIDADE": "COD_MUNICIPIO", "ESTADO": "SITUACAO", "CEP": "CEP",
}


@query("view_concat", "SELECT id, label, label AS label_sql FROM (SELECT \"CNPJ_ORDEM\" AS id, "
       + " || '-' || ".join(f'"{_ADDRESS[c]}"' for c in ADDRESS_LABEL)
       + f" AS label FROM ({BRONZE_SQL['estabelecimento']}))")
def concat(spark, sf_dir):
    branches = bronze_frames(spark, sf_dir)["estabelecimento"]
    parts = branches.select(F.col("CNPJ_ORDEM").alias("id"), *[F.col(c).alias(n) for n, c in _ADDRESS.items()])
    return parts.select("id", dashed(*ADDRESS_LABEL).alias("label"), F.expr(label_sql(ADDRESS_LABEL)).alias("label_sql"))
