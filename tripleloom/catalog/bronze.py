"""Bronze loading of stand-in register files, manifests and plain SQL access."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleloom.catalog.registry import query, table
from tripleloom.catalog.standin import BRONZE_SQL, bronze_frames
from tripleloom.operators.batches import with_batch
from tripleloom.operators.changes import snapshot_changes
from tripleloom.session import scratch_dir
from tripleloom.sources import bronze as B
from tripleloom.sources.loads import load_whole, read_changes
from tripleloom.sources.tables import _path, preview, previous_path, register_views

# Files written by Spark are named part-…; the register's own fragments are the default.
_PART = ("PART",)


def _write_files(frame, folder, mode="overwrite"):
    # The writer trims fields unless told not to.
    frame.write.mode(mode).options(sep=";", header=False, ignoreLeadingWhiteSpace=False,
                                   ignoreTrailingWhiteSpace=False).csv(folder)


def _written(spark, sf_dir, *names):
    base = scratch_dir(spark, "register")
    frames = bronze_frames(spark, sf_dir)
    for name in names:
        _write_files(frames[name], f"{base}/data/{name}")
    return base


@query("bronze_scan", BRONZE_SQL["estabelecimento"])
def scan(spark, sf_dir):
    base = _written(spark, sf_dir, "estabelecimento")
    rows = B.scan_files(spark, f"{base}/data/estabelecimento", B.SCHEMAS["estabelecimento"], _PART)
    return rows.drop(B.SOURCE_FILE)


_LOOKUPS = ("cnae", "municipio", "nat_ju", "pais", "qualif_socio", "razao_situacao")


@query("bronze_lookup_scan", " UNION ALL ".join(
    f"SELECT '{name}' AS lookup, t.* FROM ({BRONZE_SQL[name]}) t(code, description)" for name in _LOOKUPS))
def lookup_scan(spark, sf_dir):
    base = _written(spark, sf_dir, *_LOOKUPS)
    result = None
    for name in _LOOKUPS:
        rows = B.scan_files(spark, f"{base}/data/{name}", B.SCHEMAS[name], _PART).drop(B.SOURCE_FILE)
        part = rows.toDF("code", "description").select(F.lit(name).alias("lookup"), "*")
        result = part if result is None else result.unionByName(part)
    return result


# Lines with one field, two and three, of which a table of two columns has to report the first and the last.
_LINES = """CASE c_mktsegment WHEN 'BUILDING' THEN CAST(c_custkey AS {text})
    WHEN 'MACHINERY' THEN concat(CAST(c_custkey AS {text}), ';', c_name, ';', c_mktsegment)
    ELSE concat(CAST(c_custkey AS {text}), ';', c_name) END"""


@query("rejected_records", f"""
    WITH l AS (SELECT c_custkey, c_name, c_mktsegment, {_LINES.format(text="VARCHAR")} AS line FROM customer)
    SELECT 'rejected' AS part, line AS code, NULL AS name FROM l WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
    UNION ALL SELECT 'table', CAST(c_custkey AS VARCHAR), CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END FROM l""")
def rejected(spark, sf_dir):
    """Lines with too few or too many fields, and the table with all rows, from one load."""
    base, schema = scratch_dir(spark, "rejects"), {"municipio": B.SCHEMAS["municipio"]}
    lines = table(spark, sf_dir, "customer").selectExpr(f"{_LINES.format(text='STRING')} AS value")
    lines.write.text(f"{base}/data/municipio")
    B.load_tables(spark, f"{base}/data", f"{base}/bronze", schema, _PART, rejects=True)
    bad = B.rejected_records(spark, f"{base}/bronze", schema)
    rows = B.read_table(spark, f"{base}/bronze", "municipio").toDF("code", "name")
    return bad.select(F.lit("rejected").alias("part"), F.col("record").alias("code"), F.lit(None).cast("string").alias("name")).unionByName(
        rows.select(F.lit("table").alias("part"), "code", "name"))


_SELECTED = ("customer", "documents", "lineitem", "part", "supplier")


@query("file_selection", " UNION ALL ".join(
    f"SELECT '{name}.parquet' AS file, count(*) AS row_count FROM {name}" for name in _SELECTED))
def selection(spark, sf_dir):
    """Rows per driver file whose name holds a fragment; files that do not match are not opened."""
    every = spark.read.schema("_none int").option("recursiveFileLookup", True).parquet(sf_dir)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+\.parquet)", 1)
    wanted = every.filter(B.name_matches(name, ("CUST", "docu", "line", "part.", "supp")))
    return wanted.groupBy(name.alias("file")).agg(F.count(F.lit(1)).alias("row_count"))


_PARTIES = (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"),
            ("part", "p_partkey", "p_name"), ("customer", "c_custkey", "c_name"))


@query("bronze_union", " UNION ALL ".join(
    f"SELECT CAST({k} AS VARCHAR) AS COD_MUNICIPIO, {n} AS MUNICIPIO FROM {t}" for t, k, n in _PARTIES))
def union(spark, sf_dir):
    """Several source files in one table folder; equal rows stay."""
    base = scratch_dir(spark, "union")
    for name, number, text in _PARTIES:
        rows = table(spark, sf_dir, name).select(F.col(number).cast("string"), text)
        _write_files(rows, f"{base}/data/municipio", "append")
    schema = {"municipio": B.SCHEMAS["municipio"]}
    B.load_tables(spark, f"{base}/data", f"{base}/bronze", schema, _PART)
    return B.read_table(spark, f"{base}/bronze", "municipio")


@query("full_refresh", """
    SELECT 'empresa' AS delta_table, count(*) AS row_count, CAST(sum(c_custkey) AS BIGINT) AS key_sum FROM customer
    UNION ALL SELECT 'estabelecimento', count(*), CAST(sum(o_custkey) AS BIGINT) FROM orders""")
def refresh(spark, sf_dir):
    """Loading twice leaves the rows of one load; a cleared table is refilled."""
    names = ("empresa", "estabelecimento")
    base = _written(spark, sf_dir, *names)
    schemas = {name: B.SCHEMAS[name] for name in names}
    B.load_tables(spark, f"{base}/data", f"{base}/bronze", schemas, _PART)
    B.clear_tables(spark, f"{base}/bronze")
    B.load_tables(spark, f"{base}/data", f"{base}/bronze", schemas, _PART)
    B.load_tables(spark, f"{base}/data", f"{base}/bronze", schemas, _PART)
    parts = [
        B.read_table(spark, f"{base}/bronze", name).agg(
            F.lit(name).alias("delta_table"), F.count(F.lit(1)).alias("row_count"),
            F.sum(F.col("CNPJ_BASICO").cast("long")).alias("key_sum"))
        for name in names
    ]
    return parts[0].unionByName(parts[1])


_LOADED = ("empresa", "simei", "socio", "municipio")
_COUNTS = {"empresa": "customer", "simei": "customer", "socio": "lineitem", "municipio": "nation"}


# Register-like file names, chosen by the default fragments; a blank and a percent sign are part of them.
_FILES = {"empresa": "K 100%.EMPRECSV", "simei": "F.K03200$W.SIMPLES.CSV", "socio": "k+1.Sociocsv",
          "municipio": "muni cipios.csv"}


def _manifest(spark, sf_dir):
    base = _written(spark, sf_dir, *_LOADED)
    for name in _LOADED:  # one file per table under the register's kind of name
        folder, files = _path(spark, f"{base}/data/{name}")
        parts = [x.getPath() for x in files.listStatus(folder) if x.getPath().getName().startswith("part-")]
        for k, part in enumerate(parts):
            prefix = "" if k == 0 else f"{k}."
            files.rename(part, spark._jvm.org.apache.hadoop.fs.Path(folder, prefix + _FILES[name]))
    # A second load is appended; the manifest is that of the first alone.
    schemas = {n: B.SCHEMAS[n] for n in _LOADED}
    load_id = B.load_tables(spark, f"{base}/data", f"{base}/bronze", schemas)
    B.load_tables(spark, f"{base}/data", f"{base}/bronze", {"municipio": schemas["municipio"]}, mode="append")
    return B.load_manifest(spark, f"{base}/data", f"{base}/bronze", _LOADED, load_id=load_id)


@query("load_manifest", " UNION ALL ".join(
    f"SELECT '{n}' AS delta_table, '{_FILES[n]}' AS file, count(*) AS record_count FROM {t}" for n, t in _COUNTS.items()))
def manifest(spark, sf_dir):
    """Records per file, the parts of one table's file taken together."""
    name = F.regexp_replace("file", r"^\d+\.", "")
    return _manifest(spark, sf_dir).groupBy("delta_table", name.alias("file")).agg(
        F.sum("record_count").alias("record_count"))


_CHANGED = """SELECT "CNPJ_BASICO", "RAZAO_SOCIAL", "COD_NAT_JURIDICA", "QUALIF_RESP", "CAPITAL_SOCIAL",
    CASE WHEN CAST("CNPJ_BASICO" AS INT) % 5 = 0 THEN 'GRANDE' ELSE "PORTE" END AS "PORTE", "ENTE_FEDERATIVO"
    FROM e WHERE CAST("CNPJ_BASICO" AS INT) % 7 <> 0"""


@query("load_changes", f"""
    WITH e AS ({BRONZE_SQL['empresa']}), a AS (SELECT * FROM e WHERE CAST("CNPJ_BASICO" AS INT) % 3 <> 0),
    b AS ({_CHANGED})
    SELECT 'delete' AS _change_type, * FROM a WHERE "CNPJ_BASICO" NOT IN (SELECT "CNPJ_BASICO" FROM b)
    UNION ALL SELECT 'insert', * FROM b WHERE "CNPJ_BASICO" NOT IN (SELECT "CNPJ_BASICO" FROM a)
    UNION ALL SELECT 'update_preimage', a.* FROM a JOIN b USING ("CNPJ_BASICO") WHERE a."PORTE" <> b."PORTE"
    UNION ALL SELECT 'update_postimage', b.* FROM a JOIN b USING ("CNPJ_BASICO") WHERE a."PORTE" <> b."PORTE" """)
def load_changes(spark, sf_dir):
    """The change set between two loads of one table, before the first one's rows are dropped."""
    base, rows = scratch_dir(spark, "changes"), bronze_frames(spark, sf_dir)["empresa"]
    number, schema = F.col("CNPJ_BASICO").cast("int"), {"empresa": B.SCHEMAS["empresa"]}
    big = F.when(number % 5 == 0, "GRANDE").otherwise(F.col("PORTE"))
    for snapshot in (rows.filter(number % 3 != 0), rows.filter(number % 7 != 0).withColumn("PORTE", big)):
        _write_files(snapshot, f"{base}/data/empresa")
        B.load_tables(spark, f"{base}/data", f"{base}/bronze", schema, _PART, keep_previous=True)
    table_path = f"{base}/bronze/empresa"
    old = spark.read.parquet(previous_path(table_path)).drop(B.SOURCE_FILE, B.LOAD_ID)
    return snapshot_changes(old, B.read_table(spark, f"{base}/bronze", "empresa"), ["CNPJ_BASICO"])


@query("load_append_changes", f"""
    SELECT 'insert' AS _change_type, *, count(*) AS copies FROM ({BRONZE_SQL['municipio']}) GROUP BY ALL""")
def append_changes(spark, sf_dir):
    """Change set of a load that adds to a table: all its rows are inserts, whatever the table held."""
    base, schema = scratch_dir(spark, "append"), {"municipio": B.SCHEMAS["municipio"]}
    _write_files(bronze_frames(spark, sf_dir)["municipio"], f"{base}/data/municipio")
    for append in (False, True):
        load_whole(spark, f"{base}/data", f"{base}/bronze", f"{base}/status", schema, _PART, append=append,
                   changes_dir=f"{base}/changes" if append else None)
    return read_changes(spark, f"{base}/changes", "municipio")


@query("load_after_failure", f"""
    WITH e AS ({BRONZE_SQL['empresa']})
    SELECT CASE WHEN CAST("CNPJ_BASICO" AS INT) % 2 = 0 THEN 'delete' ELSE 'insert' END AS _change_type, *
    FROM e WHERE CAST("CNPJ_BASICO" AS INT) % 4 <> 2""")
def changes_after_failure(spark, sf_dir):
    """A load that fails, as its key is not unique, changes nothing: the next one's change set starts from the rows before it."""
    base, rows = scratch_dir(spark, "failure"), bronze_frames(spark, sf_dir)["empresa"]
    number, schema = F.col("CNPJ_BASICO").cast("int"), {"empresa": B.SCHEMAS["empresa"]}
    first, last = rows.filter(number % 2 == 0), rows.filter((number % 2 == 1) | (number % 4 == 2))
    for snapshot in (first, last.union(last), last):
        _write_files(snapshot, f"{base}/data/empresa")
        try:
            load_whole(spark, f"{base}/data", f"{base}/bronze", f"{base}/status", schema, _PART,
                       changes_dir=f"{base}/changes", keys={"empresa": ["CNPJ_BASICO"]})
        except Exception as error:
            if "is not unique" not in str(error):
                raise
    return read_changes(spark, f"{base}/changes", "empresa")


@query("load_totals", " UNION ALL ".join(
    f"SELECT '{n}' AS delta_table, count(*) AS record_count FROM {t}" for n, t in _COUNTS.items()))
def totals(spark, sf_dir):
    return B.load_totals(_manifest(spark, sf_dir))


@query("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
def first_rows(spark, sf_dir):
    return preview(table(spark, sf_dir, "orders"), "o_orderkey")


@query("batch_split", """
    SELECT 'orders' AS source, count(*) AS row_count, count(*) // 200000 + 1 AS batches FROM orders
    UNION ALL SELECT 'lineitem', count(*), count(*) // 200000 + 1 FROM lineitem
    UNION ALL SELECT 'lineitem_small', count(*), count(*) // 5000 + 1 FROM lineitem""")
def batches(spark, sf_dir):
    def split(label, name, **size):
        rows = with_batch(table(spark, sf_dir, name), **size)
        sizes = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
        return sizes.agg(F.lit(label).alias("source"), F.sum("n").alias("row_count"),
                         F.count(F.lit(1)).alias("batches"))

    return (split("orders", "orders").unionByName(split("lineitem", "lineitem"))
            .unionByName(split("lineitem_small", "lineitem", batch_rows=5000)))


@query("sql_access", f"""
    SELECT e."PORTE" AS porte, count(*) AS branches, count(DISTINCT e."CNPJ_BASICO") AS companies
    FROM ({BRONZE_SQL['empresa']}) e JOIN ({BRONZE_SQL['estabelecimento']}) b
    ON e."CNPJ_BASICO" = b."CNPJ_BASICO" GROUP BY 1""")
def sql_access(spark, sf_dir):
    frames = bronze_frames(spark, sf_dir)
    register_views({name: frames[name] for name in ("empresa", "estabelecimento")})
    return spark.sql("""
        SELECT e.PORTE AS porte, count(*) AS branches, count(DISTINCT e.CNPJ_BASICO) AS companies
        FROM empresa e JOIN estabelecimento b ON e.CNPJ_BASICO = b.CNPJ_BASICO GROUP BY e.PORTE""")
