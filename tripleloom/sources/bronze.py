"""Bronze layer: headerless delimited register files into all-string tables.

A stored table keeps the file of every row in ``_source_file`` (dictionary
encoded, next to free), so the load manifest reads one small column of the
table instead of the delimited text a second time; ``_load_id`` tells loads apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Iterable, Mapping, Sequence
from functools import partial

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleloom.session import run_together
from tripleloom.sources.layout import Layout
from tripleloom.sources.tables import _path, replace_table

SOURCE_FILE, LOAD_ID, REJECTED = "_source_file", "_load_id", "_rejected"


# Rows of a task are ordered by this column when stored, without a shuffle, so
# that reading one of its few values skips the pages that hold only others.
STORED_ORDER = {"socio": "TIPO_SOCIO"}


def _strings(*names: str) -> T.StructType:
    """All-string schema; a trailing ``!`` documents a value that is always given.

    File sources do not enforce this, and neither does the loader.
    """
    return T.StructType([T.StructField(n.rstrip("!"), T.StringType(), not n.endswith("!")) for n in names])


# Register tables and their columns, by position in the files.
SCHEMAS: dict[str, T.StructType] = {
    "razao_situacao": _strings("CODIGO", "DESCRICAO"),
    "cnae": _strings("CNAE", "DESCRICAO!"),
    "municipio": _strings("COD_MUNICIPIO", "MUNICIPIO!"),
    "nat_ju": _strings("CODIGO", "NATUREZA_JURIDICA!"),
    "pais": _strings("COD_PAIS", "NOME_PAIS!"),
    "qualif_socio": _strings("COD", "DESCRICAO!"),
    "empresa": _strings(
        "CNPJ_BASICO", "RAZAO_SOCIAL", "COD_NAT_JURIDICA", "QUALIF_RESP", "CAPITAL_SOCIAL!",
        "PORTE!", "ENTE_FEDERATIVO!"),
    "estabelecimento": _strings(
        "CNPJ_BASICO", "CNPJ_ORDEM", "CNPJ_DV", "MATRIZ_FILIAL", "NOME_FANTASIA", "SITUACAO",
        "DATA_SITUACAO", "MOTIVO_SITUACAO", "NM_CIDADE_EXTERIOR", "COD_PAIS", "DATA_INICIO_ATIV",
        "CNAE_FISCAL", "CNAE_FISCAL_SEC", "TIPO_LOGRADOURO", "LOGRADOURO", "NUMERO!",
        "COMPLEMENTO!", "BAIRRO", "CEP", "UF!", "COD_MUNICIPIO", "DDD_1!", "TELEFONE_1!", "DDD_2!",
        "TELEFONE_2!", "DDD_FAX!", "NUM_FAX!", "EMAIL", "SIT_ESPECIAL!", "DATA_SIT_ESPECIAL!"),
    "socio": _strings(
        "CNPJ_BASICO", "TIPO_SOCIO", "NOME_SOCIO", "CNPJ_CPF_SOCIO", "COD_QUALIFICACAO",
        "DATA_ENTRADA", "COD_PAIS_EXT!", "CPF_REPRES!", "NOME_REPRES!", "COD_QUALIF_REPRES!",
        "FAIXA_ETARIA!"),
    "simei": _strings(
        "CNPJ_BASICO", "OPC_SIMPLES!", "DATA_OPC_SIMPLES!", "DATA_EXC_SIMPLES!", "OPC_MEI!",
        "DATA_OPC_MEI!", "DATA_EXC_MEI!"),
}

# A file is loaded when its name holds any of these, in any folder.
FILE_FRAGMENTS = ("moti", "simp", "soci", "esta", "empr", "qual", "pais", "natj", "muni", "cnae")


def name_matches(file_name: Column, fragments: Sequence[str] = FILE_FRAGMENTS) -> Column:
    """Whether a file name contains any fragment, whatever its case."""
    hit = F.lit(False)
    for fragment in fragments:
        hit = hit | F.lower(file_name).contains(fragment.lower())
    return hit


def scan_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    fragments: Sequence[str] = FILE_FRAGMENTS,
    rejects: bool = False,
    **options: str | bool,
) -> DataFrame:
    """Rows of the matching files directly inside ``folder``, plus ``_source_file``.

    With ``rejects`` a further column ``_rejected`` holds the whole text of
    records with too few or too many fields, else null.

    Short rows are filled with nulls and extra fields dropped; empty fields are
    null.  ``encoding``, ``escape``, ``multiLine`` and other reader options can
    be given; one record per line keeps large files splittable.  The condition
    is on file metadata, so files that do not match are never opened.
    """
    extra = [T.StructField(REJECTED, T.StringType())] if rejects else []
    reader = spark.read.schema(T.StructType(schema.fields + extra)).options(
        header=False, sep=";", inferSchema=False, columnNameOfCorruptRecord=REJECTED)
    rows = reader.options(**options).csv(folder)
    matching = rows.filter(name_matches(F.col("_metadata.file_name"), fragments))
    return matching.select(*schema.names, *[f.name for f in extra], _plain_name(F.col("_metadata.file_name")).alias(SOURCE_FILE))


def _plain_name(encoded: Column) -> Column:
    """A file name as it is stored; a scan's own are percent-encoded, with plus signs as they are."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def list_files(
    spark: SparkSession, data_dir: str, tables: Iterable[str], fragments: Sequence[str] = FILE_FRAGMENTS
) -> DataFrame:
    """Selected files per table (``delta_table, file``), empty ones included.

    Names come from the scan's file index, one call per table; no file is opened.
    """
    paths = []
    for table in tables:
        found = spark.read.format("binaryFile").load(f"{data_dir.rstrip('/')}/{table}").inputFiles()
        paths += [(table, path) for path in found]
    name = F.element_at(F.split("path", "/"), -1)
    named = spark.createDataFrame(paths, "delta_table string, path string").filter(name_matches(name, fragments))
    return named.select("delta_table", _plain_name(name).alias("file"))


def load_tables(
    spark: SparkSession,
    data_dir: str,
    bronze_dir: str,
    schemas: Mapping[str, T.StructType] = SCHEMAS,
    fragments: Sequence[str] = FILE_FRAGMENTS,
    mode: str = "overwrite",
    fmt: str = "parquet",
    keep_previous: bool = False,
    load_id: str | None = None,
    rejects: bool = False,
    layouts: Mapping[str, Layout] | None = None,
    **options: str | bool,
) -> str:
    """Loads every table from ``data_dir/<table>`` with one read and one write; returns the load's id.

    ``overwrite`` is the full refresh: a table is replaced as a whole when its
    rows are written, so a repeated load leaves the same rows and a failed one
    the old.  ``append`` adds to what is there.  ``keep_previous`` leaves the
    replaced rows in ``previous_path``.  ``rejects`` also stores the text of
    records with a wrong number of fields, for ``rejected_records``; the rows
    themselves stay as they are.  ``layouts`` of some tables take the place of
    their stored order.
    """
    load_id = load_id or uuid.uuid4().hex

    def load(table: str) -> None:
        rows = scan_files(spark, f"{data_dir.rstrip('/')}/{table}", schemas[table], fragments, rejects, **options)
        layout = (layouts or {}).get(table, Layout())
        if STORED_ORDER.get(table) in schemas[table].names and not layout.order:
            rows = rows.sortWithinPartitions(STORED_ORDER[table])
        rows, path = rows.withColumn(LOAD_ID, F.lit(load_id)), f"{bronze_dir.rstrip('/')}/{table}"
        if mode == "overwrite":
            replace_table(rows, path, fmt, keep_previous, layout)
        else:
            layout.rows(rows).write.mode(mode).format(fmt).options(**layout.options()).save(path)

    run_together([partial(load, table) for table in schemas])
    return load_id


def clear_tables(
    spark: SparkSession, bronze_dir: str, fmt: str = "parquet", keep: Collection[str] = ()
) -> list[str]:
    """Empties every table folder under ``bronze_dir``, listed or not, keeping schemas.

    Tables named in ``keep`` are left, for a load that replaces them anyway, and
    folders that hold no table of the format are not touched.
    """
    root, files = _path(spark, bronze_dir)
    cleared = []
    for status in files.listStatus(root) if files.exists(root) else []:
        name = status.getPath().getName()
        if status.isDirectory() and name not in keep and not name.startswith((".", "_")):
            path = status.getPath().toString()
            try:
                schema = spark.read.format(fmt).load(path).schema
            except (AnalysisException, Py4JJavaError):
                continue
            replace_table(spark.createDataFrame([], schema), path, fmt)
            cleared.append(name)
    return sorted(cleared)


def read_table(spark: SparkSession, bronze_dir: str, table: str, fmt: str = "parquet") -> DataFrame:
    """A stored bronze table with its declared columns only."""
    return spark.read.format(fmt).load(f"{bronze_dir.rstrip('/')}/{table}").drop(SOURCE_FILE, LOAD_ID, REJECTED)


def rejected_records(
    spark: SparkSession, bronze_dir: str, tables: Iterable[str] = tuple(SCHEMAS), fmt: str = "parquet", load_id: str | None = None
) -> DataFrame:
    """Records with a wrong number of fields (``delta_table, file, record``), each as often as it was loaded.

    They come from a column that the load stored in its one pass: almost all
    null, so a reader skips most of it by its statistics.  A table loaded
    without ``rejects`` has none.
    """
    found = spark.createDataFrame([], "delta_table string, file string, record string")
    for table in tables:
        stored = spark.read.format(fmt).load(f"{bronze_dir.rstrip('/')}/{table}")
        if REJECTED in stored.columns:
            stored = stored if load_id is None else stored.filter(F.col(LOAD_ID) == load_id)
            found = found.unionByName(stored.filter(F.col(REJECTED).isNotNull()).select(
                F.lit(table).alias("delta_table"), F.col(SOURCE_FILE).alias("file"), F.col(REJECTED).alias("record")))
    return found


def rejected_per_file(manifest: DataFrame, rejected: DataFrame) -> DataFrame:
    """The manifest with the number of rejected records of each file."""
    counts = rejected.groupBy("delta_table", "file").agg(F.count(F.lit(1)).alias("_count"))
    return manifest.join(counts, ["delta_table", "file"], "left").select(
        *manifest.columns, F.coalesce("_count", F.lit(0)).cast("long").alias("rejected_count"))


def load_manifest(
    spark: SparkSession,
    data_dir: str,
    bronze_dir: str,
    tables: Iterable[str] = tuple(SCHEMAS),
    fragments: Sequence[str] = FILE_FRAGMENTS,
    fmt: str = "parquet",
    load_id: str | None = None,
) -> DataFrame:
    """Records per loaded file (``delta_table, file, record_count``), empty files included.

    With ``load_id`` only that load counts.  Rows of a file that the folder no
    longer names fail the manifest rather than vanish from it.
    """
    tables = list(tables)
    counts = None
    for table in tables:
        stored = spark.read.format(fmt).load(f"{bronze_dir.rstrip('/')}/{table}")
        stored = stored if load_id is None else stored.filter(F.col(LOAD_ID) == load_id)
        part = stored.groupBy(F.col(SOURCE_FILE).alias("file")).agg(F.count(F.lit(1)).alias("record_count"))
        part = part.select(F.lit(table).alias("delta_table"), "file", "record_count")
        counts = part if counts is None else counts.unionByName(part)
    files = list_files(spark, data_dir, tables, fragments)
    named = files.withColumn("_named", F.lit(True)).join(counts, ["delta_table", "file"], "full_outer")
    missing = F.raise_error(F.concat(F.lit("loaded file is not in the folder: "), "delta_table", F.lit("/"), "file"))
    count = F.when(F.col("_named").isNull(), missing.cast("long")).otherwise(F.coalesce("record_count", F.lit(0)))
    return named.select("delta_table", "file", count.cast("long").alias("record_count"))


def load_totals(manifest: DataFrame) -> DataFrame:
    """Records per table, from the manifest."""
    return manifest.groupBy("delta_table").agg(F.sum("record_count").alias("record_count"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Writes the load status as JSON lines: ``status`` per file, ``totals`` per table.

    Every line carries the time of the load.
    """
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("date")
    base = path.rstrip("/")
    manifest.select(stamp, "*").write.mode("overwrite").json(f"{base}/status")
    load_totals(manifest).select(stamp, "*").write.mode("overwrite").json(f"{base}/total_records_per_table")
