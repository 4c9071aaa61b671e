"""Refined tables from the bronze register, in the shape the mapping reads.

Only names and columns of these tables are given by the mapping; the
derivations are this project's own, and the register's codes are parameters.

A refined table is a ``Facet``: columns derived from one bronze table's rows, on
the rows of a flag.  ``SILVER`` builds one table alone, with the look-ups it
needs; ``fan_out`` derives all facets of a bronze table in one pass, as views of
one wide frame, and ``spread_tables`` writes them from one scan.

All joins are left joins to a table with one row per key.  Company and lookup
codes may be hot on the left; ``left_lookup`` broadcasts the right side when its
size allows and splits hot keys when it does not.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.operators.joins import left_lookup, planned_bytes
from tripleloom.operators.triples import Table, View
from tripleloom.plans.register_mapping import ADDRESS_LABEL, STATE_CODES

Tables = Mapping[str, DataFrame]

# The least of a file that a scan gives to a task while cores are idle (spark.sql.files.openCostInBytes).
SPLIT_BYTES = 4 * 1024 * 1024


@dataclass(frozen=True)
class Codes:
    """Code values of the register's bronze columns."""

    head_office: str
    person: str
    company: str
    foreigner: str
    opted: str
    home_country: str


def state_code(name: Column) -> Column:
    """Two-letter code of a state name; null for a name that is not listed."""
    code = F.when(F.lit(False), F.lit(None).cast("string"))
    for known, short in STATE_CODES.items():
        code = code.when(name == known, short)
    return code


def state_name(code: Column) -> Column:
    """State name of a two-letter code; null for a code that is not listed."""
    name = F.when(F.lit(False), F.lit(None).cast("string"))
    for known, short in STATE_CODES.items():
        name = name.when(code == short, known)
    return name


def dashed(*parts: str | Column) -> Column:
    """Parts joined by ``-``; null as soon as one part is null."""
    pieces: list[Column] = []
    for part in parts:
        pieces += [F.lit("-"), F.col(part) if isinstance(part, str) else part]
    return F.concat(*pieces[1:])


def register_date(text: str) -> Column:
    """``yyyyMMdd`` text as a date; anything else, also ``00000000``, is null."""
    return F.try_to_date(F.col(text), "yyyyMMdd")


def decimal_comma(text: str) -> Column:
    return F.replace(F.col(text), F.lit(","), F.lit(".")).try_cast("double")


def joined(*columns: str) -> Column:
    """Parts joined by ``_``, each in its place even where one is missing; null when there is none."""
    parts = F.concat_ws("_", *[F.coalesce(c, F.lit("")) for c in columns])
    return F.when(F.coalesce(*columns).isNotNull(), parts)


def telephone(area: str, number: str) -> Column:
    """Area code and number; the number alone without a code."""
    return F.concat(F.coalesce(area, F.lit("")), number)


def branch_id() -> Column:
    return F.concat("CNPJ_BASICO", "CNPJ_ORDEM", "CNPJ_DV")


def status_id() -> Column:
    return joined("SITUACAO", "DATA_SITUACAO", "MOTIVO_SITUACAO")


def special_id() -> Column:
    return joined("SIT_ESPECIAL", "DATA_SIT_ESPECIAL")


def representative_id() -> Column:
    return joined("CPF_REPRES", "NOME_REPRES")


def partner_id(kind: str) -> Column:
    """Companies by the root of their number, or their name without one; persons and foreigners with their name."""
    if kind == "company":
        return F.coalesce(F.substring("CNPJ_CPF_SOCIO", 1, 8), "NOME_SOCIO")
    return joined("CNPJ_CPF_SOCIO", "NOME_SOCIO")


def partnership_id(kind: str) -> Column:
    empty = F.lit("")
    return F.concat(F.coalesce("CNPJ_BASICO", empty), F.lit("_"), F.coalesce(partner_id(kind), empty))


def lookup(frame: DataFrame, code: str, text: str, code_as: str, text_as: str) -> DataFrame:
    """A code table with one text per code, so that joining it never adds rows."""
    return frame.filter(F.col(code).isNotNull()).groupBy(F.col(code).alias(code_as)).agg(F.min(text).alias(text_as))


def company(bronze: Tables, codes: Codes) -> DataFrame:
    """``RFB_EMPRESA``: companies with their head office and tax options.

    One row per company and option that it has taken, one without an option for
    the others; the graph, a set, gets the rest of a company once.
    """
    none, unknown = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    heads = bronze["estabelecimento"].filter(F.col("MATRIZ_FILIAL") == codes.head_office).select(
        "CNPJ_BASICO", branch_id().alias("head"), unknown.alias("mei"), unknown.alias("simples"))
    options = bronze["simei"].select(
        "CNPJ_BASICO", none.alias("head"),
        (F.col("OPC_MEI") == codes.opted).alias("mei"), (F.col("OPC_SIMPLES") == codes.opted).alias("simples"))
    # Both sides of the company in one aggregate: one shuffle, and one row per company.
    known = heads.unionByName(options).groupBy("CNPJ_BASICO").agg(
        F.min("head").alias("ID_ESTABELECIMENTO_MATRIZ"),
        F.bool_or("mei").alias("mei"), F.bool_or("simples").alias("simples"))
    legal = lookup(bronze["nat_ju"], "CODIGO", "NATUREZA_JURIDICA", "COD_NAT_JURIDICA", "NATUREZA_JURIDICA")
    # The register has one row per company.
    rows = left_lookup(bronze["empresa"], {"CNPJ_BASICO": known, "COD_NAT_JURIDICA": legal}, unique={"CNPJ_BASICO"})
    chosen = F.array_compact(F.array(F.when(F.col("mei"), "MEI"), F.when(F.col("simples"), "SIMPLES")))
    rows = rows.withColumn("option", F.explode_outer(chosen))
    return rows.select(
        F.col("CNPJ_BASICO").alias("CNPJ_RAIZ"),
        "RAZAO_SOCIAL",
        F.col("COD_NAT_JURIDICA").alias("ID_NATUREZA_LEGAL"),
        "NATUREZA_JURIDICA",
        "ID_ESTABELECIMENTO_MATRIZ",
        F.concat("CNPJ_BASICO", F.lit("_"), "option").alias("ID_OPCAO_SIMPLES"),
        decimal_comma("CAPITAL_SOCIAL").alias("CAPITAL_SOCIAL"),
        F.col("PORTE").alias("TEM_PORTE"),
    )


@dataclass(frozen=True)
class Source:
    """A bronze table's derived columns, and the look-ups that some of them need."""

    table: str
    columns: Callable[[Codes], dict[str, Column]]
    lookups: Mapping[str, Callable[[Tables], DataFrame]] = field(default_factory=dict)
    needs: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    def derive(self, bronze: Tables, codes: Codes, wanted: Collection[str], where: str | None = None) -> DataFrame:
        """The wanted columns of the rows where the flag is true."""
        columns = self.columns(codes)
        frame = bronze[self.table] if where is None else bronze[self.table].filter(columns[where])
        keys = [key for key in self.lookups if any(key in self.needs.get(name, ()) for name in wanted)]
        if keys:
            frame = left_lookup(frame, {key: self.lookups[key](bronze) for key in keys})
        return frame.select(*[columns[name].alias(name) for name in wanted])


@dataclass(frozen=True)
class Facet:
    """A refined table's columns by the derived ones of a source, on the rows of a flag."""

    source: Source
    columns: Mapping[str, str]
    where: str | None = None


def _branch_columns(codes: Codes) -> dict[str, Column]:
    is_head = F.col("MATRIZ_FILIAL") == codes.head_office
    country = F.coalesce("NOME_PAIS", F.when(F.col("COD_PAIS").isNull(), codes.home_country))
    state = state_name(F.col("UF"))
    parts = {"PAIS": country, "LOGRADOURO": joined_street(), "ESTADO": state} | {
        name: F.col(name) for name in ("NUMERO", "COMPLEMENTO", "BAIRRO", "CIDADE", "CEP")}
    plain = ("CNPJ_BASICO", "RAZAO_SOCIAL", "NOME_FANTASIA", "CNAE_FISCAL", "EMAIL", "SIT_ESPECIAL", "SITUACAO",
             "NM_CIDADE_EXTERIOR", "COD_MUNICIPIO", "NUMERO", "COMPLEMENTO", "BAIRRO", "CIDADE", "CEP")
    return {name: F.col(name) for name in plain} | {
        "branch": branch_id(),
        "status": status_id(),
        "status_date": register_date("DATA_SITUACAO"),
        "known_reason": F.when(F.col("RAZAO").isNotNull(), F.col("MOTIVO_SITUACAO")),
        "started": register_date("DATA_INICIO_ATIV"),
        "kind": F.when(is_head, "MATRIZ").otherwise("FILIAL"),
        "phone_1": telephone("DDD_1", "TELEFONE_1"),
        "phone_2": telephone("DDD_2", "TELEFONE_2"),
        "fax": telephone("DDD_FAX", "NUM_FAX"),
        "special": special_id(),
        "special_date": register_date("DATA_SIT_ESPECIAL"),
        "country": country,
        "street": parts["LOGRADOURO"],
        "state": state,
        "state_code": state_code(state),
        "label": dashed(*[parts[name] for name in ADDRESS_LABEL]),
        "label_abroad": dashed(country, "NM_CIDADE_EXTERIOR"),
        "is_special": F.col("SIT_ESPECIAL").isNotNull(),
        "has_status": status_id().isNotNull(),
        "at_home": F.col("NM_CIDADE_EXTERIOR").isNull(),
        "abroad": F.col("NM_CIDADE_EXTERIOR").isNotNull(),
    }


def _partner_columns(codes: Codes) -> dict[str, Column]:
    plain = ("CNPJ_BASICO", "NOME_SOCIO", "CNPJ_CPF_SOCIO", "COD_QUALIFICACAO", "QUALIFICACAO_SOCIO", "FAIXA_ETARIA",
             "COD_QUALIF_REPRES", "QUALIFICACAO_REPRESENTANTE", "CPF_REPRES", "NOME_REPRES", "NOME_PAIS")
    flags = {kind: F.col("TIPO_SOCIO") == getattr(codes, kind) for kind in ("person", "company", "foreigner")}
    return {name: F.col(name) for name in plain} | flags | {
        # Persons and foreigners have their ids by the same rule.
        "partner": partner_id("person"),
        "partnership": partnership_id("person"),
        "partner_company": partner_id("company"),
        "company_partnership": partnership_id("company"),
        "since": register_date("DATA_ENTRADA"),
        "representative": representative_id(),
        "none": F.lit(None).cast("string"),
        "named_person": flags["person"] & partner_id("person").isNotNull(),
        "represented": representative_id().isNotNull(),
    }


def _option_columns(codes: Codes) -> dict[str, Column]:
    columns = {}
    for kind in ("SIMPLES", "MEI"):
        since = f"DATA_OPC_{kind}"
        columns |= {
            f"{kind}_id": F.concat("CNPJ_BASICO", F.lit(f"_{kind}")), f"{kind}_kind": F.lit(kind),
            f"{kind}_since": register_date(since), f"{kind}_until": register_date(f"DATA_EXC_{kind}"),
            f"{kind}_taken": (F.col(f"OPC_{kind}") == codes.opted) | F.col(since).isNotNull()}
    return columns


def joined_street() -> Column:
    return F.nullif(F.concat_ws(" ", "TIPO_LOGRADOURO", "LOGRADOURO"), F.lit(""))


def _code_list(table: str, code: str, text: str, code_as: str, text_as: str) -> Callable[[Tables], DataFrame]:
    return lambda bronze: lookup(bronze[table], code, text, code_as, text_as)


BRANCHES = Source(
    "estabelecimento", _branch_columns,
    lookups={
        "CNPJ_BASICO": _code_list("empresa", "CNPJ_BASICO", "RAZAO_SOCIAL", "CNPJ_BASICO", "RAZAO_SOCIAL"),
        "COD_PAIS": _code_list("pais", "COD_PAIS", "NOME_PAIS", "COD_PAIS", "NOME_PAIS"),
        "COD_MUNICIPIO": _code_list("municipio", "COD_MUNICIPIO", "MUNICIPIO", "COD_MUNICIPIO", "CIDADE"),
        "MOTIVO_SITUACAO": _code_list("razao_situacao", "CODIGO", "DESCRICAO", "MOTIVO_SITUACAO", "RAZAO"),
    },
    needs={
        "RAZAO_SOCIAL": ("CNPJ_BASICO",), "country": ("COD_PAIS",), "label": ("COD_PAIS", "COD_MUNICIPIO"),
        "label_abroad": ("COD_PAIS",), "CIDADE": ("COD_MUNICIPIO",), "known_reason": ("MOTIVO_SITUACAO",),
    })
PARTNERS = Source(
    "socio", _partner_columns,
    lookups={
        "COD_QUALIFICACAO": _code_list("qualif_socio", "COD", "DESCRICAO", "COD_QUALIFICACAO", "QUALIFICACAO_SOCIO"),
        "COD_QUALIF_REPRES": _code_list(
            "qualif_socio", "COD", "DESCRICAO", "COD_QUALIF_REPRES", "QUALIFICACAO_REPRESENTANTE"),
        "COD_PAIS_EXT": _code_list("pais", "COD_PAIS", "NOME_PAIS", "COD_PAIS_EXT", "NOME_PAIS"),
    },
    needs={
        "QUALIFICACAO_SOCIO": ("COD_QUALIFICACAO",), "QUALIFICACAO_REPRESENTANTE": ("COD_QUALIF_REPRES",),
        "NOME_PAIS": ("COD_PAIS_EXT",),
    })
OPTIONS = Source("simei", _option_columns)


def _partnership(kind: str) -> tuple[Facet, ...]:
    """Partnerships of one kind with both qualifications."""
    own, partner = ("company_partnership", "partner_company") if kind == "company" else ("partnership", "partner")
    return (Facet(PARTNERS, {
        "ID_SOCIEDADE": own, "ID_EMPRESA": "CNPJ_BASICO", "ID_SOCIO": partner, "DATA_INICIO_SOCIEDADE": "since",
        "ROTULO": "NOME_SOCIO", "ID_QUALIFICACAO_SOCIO": "COD_QUALIFICACAO", "QUALIFICACAO_SOCIO": "QUALIFICACAO_SOCIO",
        "ID_REPRESENTANTE": "representative", "ID_QUALIFICACAO_REPRESENTANTE": "COD_QUALIF_REPRES",
        "QUALIFICACAO_REPRESENTANTE": "QUALIFICACAO_REPRESENTANTE", "ID_URI": "COD_QUALIFICACAO"}, kind),)


def _partnership_link(kind: str) -> tuple[Facet, ...]:
    """Company and partnership; the latter is named ``ID_SOCIO`` by the mapping."""
    own = "company_partnership" if kind == "company" else "partnership"
    return (Facet(PARTNERS, {"ID_EMPRESA": "CNPJ_BASICO", "ID_SOCIO": own}, kind),)


def _option(kind: str) -> Facet:
    return Facet(OPTIONS, {
        "ID_OPCAO_SIMPLES": f"{kind}_id", "TIPO_SIMPLES": f"{kind}_kind", "DATA_OPCAO_SIMPLES": f"{kind}_since",
        "DATA_EXCLUSAO_SIMPLES": f"{kind}_until"}, f"{kind}_taken")


# Tables that rows of one bronze table give, some by several facets of a row.
FACETS: dict[str, tuple[Facet, ...]] = {
    "RFB_ESTABELECIMENTO": (Facet(BRANCHES, {
        "CNPJ": "branch", "RAZAO_SOCIAL": "RAZAO_SOCIAL", "NOME_FANTASIA": "NOME_FANTASIA", "ID_SITUACAO": "status",
        "DATA_INICIO_ATIV": "started", "ID_ATIVIDADE_ECONOMICA": "CNAE_FISCAL", "ID_ENDERECO": "branch",
        "TIPO_ESTABELECIMENTO": "kind", "EMAIL": "EMAIL", "TELEFONE_1": "phone_1", "TELEFONE_2": "phone_2", "FAX": "fax"}),),
    "RFB_SOCIEDADE_COM_PESSOA_FISICA": _partnership("person"),
    "RFB_SOCIEDADE_COM_HOLDING": _partnership("company"),
    "RFB_SOCIEDADE_COM_ESTRANGEIRO": _partnership("foreigner"),
    "RFB_PESSOA": (  # partners and representatives
        Facet(PARTNERS, {"ID_PESSOA": "partner", "CPF": "CNPJ_CPF_SOCIO", "NOME": "NOME_SOCIO",
                         "FAIXA_ETARIA": "FAIXA_ETARIA"}, "named_person"),
        Facet(PARTNERS, {"ID_PESSOA": "representative", "CPF": "CPF_REPRES", "NOME": "NOME_REPRES",
                         "FAIXA_ETARIA": "none"}, "represented")),
    "RFB_ESTRANGEIRO": (Facet(PARTNERS, {"ID_SOCIO": "partner", "NOME": "NOME_SOCIO", "NOME_PAIS": "NOME_PAIS"}, "foreigner"),),
    "RFB_TEM_SITUACAO_ESPECIAL": (Facet(
        BRANCHES, {"ID_EMPRESA": "CNPJ_BASICO", "ID_SITUACAO_ESPECIAL": "special"}, "is_special"),),
    "RFB_TEM_ESTABELECIMENTO": (Facet(BRANCHES, {"ID_EMPRESA": "CNPJ_BASICO", "ID_ESTABELECIMENTO": "branch"}),),
    "RFB_TEM_SOCIEDADE_FISICA": _partnership_link("person"),
    "RFB_TEM_SOCIEDADE_JURIDICA": _partnership_link("company"),
    "RFB_TEM_SOCIEDADE_ESTRANGEIRA": _partnership_link("foreigner"),
    "RFB_OPCAO_SIMPLES": (_option("SIMPLES"), _option("MEI")),  # a row per company and kind of option
    "RFB_SITUACAO_ESPECIAL": (Facet(BRANCHES, {
        "ID_SITUACAO_ESPECIAL": "special", "DATA_INICIO_SIT_ESPECIAL": "special_date", "DESCRICAO": "SIT_ESPECIAL"},
        "is_special"),),
    "RFB_SITUACAO_CADASTRAL": (Facet(BRANCHES, {
        "ID_SITUACAO_CADASTRAL": "status", "VAL_DATA_SITUACAO": "status_date", "SITUACAO": "SITUACAO",
        "ID_URI": "known_reason"}, "has_status"),),
    "RFB_ENDERECO": (Facet(BRANCHES, {
        "ID_ENDERECO": "branch", "PAIS": "country", "LOGRADOURO": "street", "NUMERO": "NUMERO",
        "COMPLEMENTO": "COMPLEMENTO", "BAIRRO": "BAIRRO", "CIDADE": "CIDADE", "ESTADO": "state", "CEP": "CEP",
        "NOME_PAIS": "country", "ID_CIDADE": "COD_MUNICIPIO", "UF": "state_code", "ENDERECO": "label"}, "at_home"),),
    "RFB_ENDERECO_EXTERIOR": (Facet(BRANCHES, {
        "ID_ENDERECO": "branch", "PAIS": "country", "CIDADE_EXTERIOR": "NM_CIDADE_EXTERIOR", "CEP": "CEP",
        "NOME_PAIS": "country", "CITY_EXT": "NM_CIDADE_EXTERIOR", "ENDERECO": "label_abroad"}, "abroad"),),
}
# Tables of which a row of the source gives no row of its own.
DISTINCT = frozenset({
    "RFB_PESSOA", "RFB_ESTRANGEIRO", "RFB_TEM_SITUACAO_ESPECIAL", "RFB_TEM_ESTABELECIMENTO", "RFB_TEM_SOCIEDADE_FISICA",
    "RFB_TEM_SOCIEDADE_JURIDICA", "RFB_TEM_SOCIEDADE_ESTRANGEIRA", "RFB_SITUACAO_ESPECIAL", "RFB_SITUACAO_CADASTRAL"})


def _alone(name: str) -> Callable[[Tables, Codes], DataFrame]:
    """One refined table from one scan, with the look-ups it needs."""
    facets = FACETS[name]

    def build(bronze: Tables, codes: Codes) -> DataFrame:
        wanted = dict.fromkeys(own for facet in facets for own in facet.columns.values())
        if len(facets) == 1:
            facet = facets[0]
            base = facet.source.derive(bronze, codes, list(wanted), facet.where)
            rows = base.select(*[F.col(own).alias(column) for column, own in facet.columns.items()])
        else:
            flags = dict.fromkeys(facet.where for facet in facets)
            base = facets[0].source.derive(bronze, codes, list(wanted | flags))
            rows = base.select(F.inline(F.array_compact(F.array(*[
                F.when(F.col(facet.where), F.struct(*[F.col(own).alias(column) for column, own in facet.columns.items()]))
                for facet in facets]))))
        return rows.distinct() if name in DISTINCT else rows

    return build


def secondary_activity(bronze: Tables, codes: Codes) -> DataFrame:
    """``RFB_TEM_ATIV_ECONOMICA_SECUNDARIA``: one row per branch and listed activity; blank pieces are none."""
    codes_ = F.filter(F.transform(F.split("CNAE_FISCAL_SEC", ","), lambda x: F.trim(x)), lambda x: x != "")
    return bronze["estabelecimento"].filter(F.col("CNAE_FISCAL_SEC").isNotNull()).select(
        branch_id().alias("CNPJ_COMPLETO"), F.explode(codes_).alias("CNAE")
    )


def status_reason(bronze: Tables, codes: Codes) -> DataFrame:
    """``RFB_RAZAO_SITUACAO_CADASTRAL``: the reason lookup under the mapping's names."""
    return bronze["razao_situacao"].select(
        F.col("CODIGO").alias("ID_RAZAO_SITUACAO_CADASTRAL"),
        F.col("DESCRICAO").alias("ROTULO"),
        F.col("CODIGO").alias("CODIGO_RAZAO_SITUACAO"),
    )


SILVER: dict[str, Callable[[Tables, Codes], DataFrame]] = {
    "RFB_EMPRESA": company,
    "RFB_TEM_ATIV_ECONOMICA_SECUNDARIA": secondary_activity,
    "RFB_RAZAO_SITUACAO_CADASTRAL": status_reason,
    **{name: _alone(name) for name in FACETS},
}


def silver_tables(bronze: Tables, codes: Codes) -> dict[str, DataFrame]:
    """All 19 refined tables as lazy frames over the ten bronze tables."""
    return {name: build(bronze, codes) for name, build in SILVER.items()}


def dealt(frame: DataFrame) -> DataFrame:
    """A table of fewer files than cores, and too small for the scan to split it over them, dealt over the cores.

    One pass does the work of many, so it must not be left to the few tasks of
    such a scan.  Larger tables have splits enough and are never shuffled here.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    few = 0 < len(frame.inputFiles()) < cores and planned_bytes(frame) < cores * SPLIT_BYTES
    return frame.repartition(cores) if few else frame


def wide_frames(bronze: Tables, codes: Codes, names: Collection[str] = tuple(FACETS)) -> dict[str, DataFrame]:
    """Per bronze table one frame with every derived column that the named tables take, each made once."""
    wanted: dict[str, dict[str, None]] = {}
    sources: dict[str, Source] = {}
    for facet in (f for name in names for f in FACETS[name]):
        sources[facet.source.table] = facet.source
        wanted.setdefault(facet.source.table, {}).update(dict.fromkeys([*facet.columns.values(), facet.where]))
    return {table: source.derive({**bronze, table: dealt(bronze[table])}, codes, [c for c in wanted[table] if c is not None])
            for table, source in sources.items()}


def fan_out(bronze: Tables, codes: Codes, names: Collection[str] = tuple(SILVER)) -> dict[str, Table]:
    """The named tables for a graph: all that come from one bronze table are views of one frame, so of one scan.

    Views are bags; a graph is a set, so it needs no tables without repeated rows.
    """
    wide = wide_frames(bronze, codes, [name for name in names if name in FACETS])
    return {name: [View(wide[f.source.table], f.columns, f.where) for f in FACETS[name]] if name in FACETS
            else SILVER[name](bronze, codes) for name in names}


def tagged_rows(wide: DataFrame, table: str) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """The rows of all tables that one bronze table gives, told apart by ``_table``, and where each one's columns are.

    Every row of ``wide`` becomes an array of structs, one per table that it
    belongs to, and one Expand spreads it.  Columns of equal type share a place.
    """
    kinds = {f.name: f.dataType.simpleString() for f in wide.schema.fields}
    places: dict[str, dict[str, str]] = {}
    most: dict[str, int] = {}
    for name, facets in FACETS.items():
        if facets[0].source.table == table:
            used: dict[str, int] = {}
            places[name] = {}
            for column, own in facets[0].columns.items():
                kind = kinds[own]
                places[name][column] = f"{kind}_{used.get(kind, 0)}"
                used[kind] = used.get(kind, 0) + 1
                most[kind] = max(most.get(kind, 0), used[kind])
    structs = []
    for name, place in places.items():
        for facet in FACETS[name]:
            own = {place[column]: F.col(source) for column, source in facet.columns.items()}
            struct = F.struct(F.lit(name).alias("_table"), *[
                own.get(f"{kind}_{k}", F.lit(None).cast(kind)).alias(f"{kind}_{k}") for kind, n in most.items() for k in range(n)])
            structs.append(struct if facet.where is None else F.when(F.col(facet.where), struct))
    return wide.select(F.inline(F.filter(F.array(*structs), lambda x: x.isNotNull()))), places


def spread_tables(bronze: Tables, codes: Codes, scratch: str) -> dict[str, DataFrame]:
    """All refined tables, those with facets from one scan of each bronze table, spread into folders under ``scratch``.

    The folders are read with the columns of their table only; repeated rows
    are put together there, where a table's rows are already apart.
    """
    tables = {name: SILVER[name](bronze, codes) for name in SILVER if name not in FACETS}
    for table, wide in wide_frames(bronze, codes).items():
        rows, places = tagged_rows(wide, table)
        path = f"{scratch.rstrip('/')}/{table}"
        rows.write.partitionBy("_table").parquet(path)
        stored = wide.sparkSession.read.schema(rows.schema).parquet(path)
        for name, place in places.items():
            own = stored.filter(F.col("_table") == name).select(*[F.col(p).alias(column) for column, p in place.items()])
            tables[name] = own.distinct() if name in DISTINCT else own
    return {name: tables[name] for name in SILVER}
