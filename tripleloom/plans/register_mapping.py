"""The company register's mapping: 22 maps over 19 refined tables."""

from __future__ import annotations

from tripleloom.functions.lexical import XSD_ANY_URI, XSD_BOOLEAN, XSD_DATE, XSD_DOUBLE, XSD_STRING
from tripleloom.operators.rules import ObjectMap, TriplesMap

# Namespaces of the mapping's terms and resources.
CNPJ = "http://www.cnpj.data.br/ontology/"
FOAF = "http://xmlns.com/foaf/0.1/"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
VCARD = "http://www.w3.org/2006/vcard/ns#"
RFB = "http://www.cnpj.data.br/resource/RFB/"
DOMAIN = "http://www.cnpj.data.br/resource/DOMINIO/"

# Prefixes bound in the output of triple generation.
OUTPUT_PREFIXES = {
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "rr": "http://www.w3.org/ns/r2rml#",
    "ex": "http://example.com/ns#",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "dc": "http://purl.org/dc/elements/1.1/",
    "vcard": "http://www.w3.org/2006/vcard/ns#",
    "dcterms": "http://purl.org/dc/terms/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "rfb": "http://www.sefaz.ma.gov.br/ontology/",
    "cnae": "http://www.sefaz.ma.gov.br/ontology/",
    "map": "http://sistemas.sefaz.ma.gov.br/maps/RFB/2020-04-01",
    "rfb_resource": "http://www.sefaz.ma.gov.br/RFB/resource/",
    "sefazma": "http://www.sefaz.ma.gov.br/ontology/",
}

# Prefixes the mapping itself declares; three differ from the output's.
MAPPING_PREFIXES = {
    **{k: OUTPUT_PREFIXES[k] for k in (
        "rdfs", "rr", "ex", "foaf", "dc", "vcard", "dcterms", "skos", "owl", "rdf", "xsd")},
    "map": "http://sistemas.sefaz.ma.gov.br/maps/RFB/2024-07-22",
    "rfb_resource": "http://www.cnpj.data.br/RFB/resource/",
    "cnpj": CNPJ,
}

# State names as the address table spells them, and their codes.
STATE_CODES = {
    "ACRE": "AC", "ALAGOAS": "AL", "AMAPA": "AP", "AMAZONAS": "AM", "BAHIA": "BA", "CEARA": "CE",
    "ESPIRITO_SANTO": "ES", "GOIAS": "GO", "MARANHAO": "MA", "MATO_GROSSO": "MT",
    "MATO_GROSSO DO SUL": "MS", "MINAS_GERAIS": "MG", "PARA": "PA", "PARAIBA": "PB",
    "PARANA": "PR", "PERNAMBUCO": "PE", "PIAUI": "PI", "RIO_DE_JANEIRO": "RJ",
    "RIO_GRANDE_DO_NORTE": "RN", "RIO_GRANDE_DO_SUL": "RS", "RONDONIA": "RO", "RORAIMA": "RR",
    "SANTA_CATARINA": "SC", "SAO_PAULO": "SP", "SERGIPE": "SE", "TOCANTINS": "TO",
    "DISTRITO_FEDERAL": "DF",
}

# The fields joined by '-' in an address label, in order.
ADDRESS_LABEL = ("PAIS", "LOGRADOURO", "NUMERO", "COMPLEMENTO", "BAIRRO", "CIDADE", "ESTADO", "CEP")


def state_code_sql(column: str) -> str:
    """Two-letter code of a state name, null for a name that is not listed."""
    cases = " ".join(f"WHEN '{name}' THEN '{code}'" for name, code in STATE_CODES.items())
    return f"CASE {column} {cases} END"


def label_sql(columns: tuple[str, ...]) -> str:
    """Fields joined by '-'; null as soon as one of them is null."""
    return "CONCAT(" + ", '-', ".join(columns) + ")"


def _all(table: str) -> str:
    return f"SELECT * FROM {table}"


def _text(column: str, *predicates: str) -> ObjectMap:
    return ObjectMap(predicates, column=column, datatype=XSD_STRING)


def _date(column: str, predicate: str) -> ObjectMap:
    return ObjectMap((predicate,), column=column, datatype=XSD_DATE)


def _link(template: str, *predicates: str) -> ObjectMap:
    return ObjectMap(predicates, template=template)


_ADDRESS_SQL = (
    "SELECT ID_ENDERECO, PAIS, LOGRADOURO, NUMERO, COMPLEMENTO, BAIRRO, CIDADE, ESTADO, CEP, "
    f"{state_code_sql('ESTADO')} AS UF, {label_sql(ADDRESS_LABEL)} AS ENDERECO FROM RFB_ENDERECO"
)
_FOREIGN_ADDRESS_SQL = (
    "SELECT CEP, PAIS, CIDADE_EXTERIOR, ID_ENDERECO, "
    f"{label_sql(('PAIS', 'CIDADE_EXTERIOR'))} AS ENDERECO FROM RFB_ENDERECO_EXTERIOR"
)


def _partner_sql(kind: str, table: str) -> str:
    return f"SELECT ID_SOCIO, DATA_INICIO_SOCIEDADE, ID_QUALIFICACAO_SOCIO, '{kind}' AS TIPO FROM {table}"


# The maps, in their own order.  Some links are spelt unlike the
# subjects they seem to mean (Agent/Agente, Sociedade_* by ID_SOCIO, two maps
# with PF in their names over companies' and foreigners' tables); they are kept
# because the graph must be the same.
REGISTER_MAPS: tuple[TriplesMap, ...] = (
    TriplesMap(
        "Organization", _all("RFB_EMPRESA"), RFB + "Empresa/{CNPJ_RAIZ}",
        (FOAF + "Organization", CNPJ + "Empresa"),
        (
            _text("CNPJ_RAIZ", CNPJ + "cnpj", CNPJ + "cnpj_raiz"),
            _text("RAZAO_SOCIAL", CNPJ + "razao_social", RDFS + "label"),
            _link(DOMAIN + "Natureza_Legal/{ID_NATUREZA_LEGAL}", CNPJ + "tem_natureza_legal"),
            _link(RFB + "Estabelecimento/{ID_ESTABELECIMENTO_MATRIZ}", CNPJ + "tem_matriz", CNPJ + "tem_matriz"),
            _link(RFB + "Opcao_Simples/{ID_OPCAO_SIMPLES}", CNPJ + "opcao_simples"),
            ObjectMap((CNPJ + "valor_capital_social",), column="CAPITAL_SOCIAL", datatype=XSD_DOUBLE),
            _link(RFB + "Porte/{TEM_PORTE}", CNPJ + "tem_porte"),
        ),
    ),
    TriplesMap(
        "Establishment", _all("RFB_ESTABELECIMENTO"), RFB + "Estabelecimento/{CNPJ}",
        (CNPJ + "Estabelecimento", CNPJ + "Estabelecimento"),
        (
            _text("CNPJ", CNPJ + "cnpj_completo", CNPJ + "cnpj"),
            _text("razao_social", CNPJ + "razao_social", RDFS + "label"),
            _text("NOME_FANTASIA", CNPJ + "nome_fantasia"),
            _link(RFB + "Situacao_Cadastral/{ID_SITUACAO}", CNPJ + "tem_situacao_cadastral"),
            _date("DATA_INICIO_ATIV", CNPJ + "data_inicio_atividade"),
            _link(DOMAIN + "Atividade_Economica/{ID_ATIVIDADE_ECONOMICA}",
                  CNPJ + "tem_atividade_economica_principal", CNPJ + "tem_atividade_economica"),
            _link(RFB + "Endereco/{ID_ENDERECO}", CNPJ + "tem_endereco"),
            _link(RFB + "Tipo_Estabelecimento/{TIPO_ESTABELECIMENTO}", CNPJ + "tem_tipo_estabelecimento"),
            ObjectMap((VCARD + "email",), column="EMAIL", datatype=XSD_ANY_URI),
            _text("TELEFONE_1", CNPJ + "telefone", CNPJ + "numero_contato"),
            _text("TELEFONE_2", CNPJ + "telefone", CNPJ + "numero_contato"),
            _text("FAX", CNPJ + "fax", CNPJ + "numero_contato"),
        ),
    ),
    TriplesMap(
        "Sociedade_Fisica", _all("RFB_SOCIEDADE_COM_PESSOA_FISICA"), RFB + "Sociedade_PF/{ID_SOCIEDADE}",
        (CNPJ + "Sociedade", CNPJ + "Sociedade_PF", CNPJ + "Sociedade_RFB", CNPJ + "Sociedade_PF"),
        (
            _date("DATA_INICIO_SOCIEDADE", CNPJ + "inicio_participacao"),
            _text("ROTULO", RDFS + "label"),
            _link(DOMAIN + "Qualificacao/{ID_QUALIFICACAO_SOCIO}", CNPJ + "tem_qualificacao_socio"),
            _link(RFB + "Pessoa/{ID_SOCIO}", CNPJ + "tem_socio"),
        ),
    ),
    TriplesMap(
        "Partnership_jID", _all("RFB_SOCIEDADE_COM_HOLDING"), RFB + "Sociedade_PJ/{ID_SOCIEDADE}",
        (CNPJ + "Sociedade", CNPJ + "Sociedade_PJ", CNPJ + "Sociedade_RFB", CNPJ + "Sociedade_PJ"),
        (
            _link(RFB + "Empresa/{ID_SOCIO}", CNPJ + "tem_socio"),
            _text("ID_SOCIEDADE", RDFS + "label"),
            _date("DATA_INICIO_SOCIEDADE", CNPJ + "data_entrada_participacao"),
            _link(RFB + "Pessoa/{ID_REPRESENTANTE}", CNPJ + "tem_representante"),
            _link(DOMAIN + "Qualificacao/{ID_QUALIFICACAO_SOCIO}", CNPJ + "qualificacao_socio"),
            _link(DOMAIN + "Qualificacao/{ID_QUALIFICACAO_REPRESENTANTE}", CNPJ + "qualificacao_do_responsavel"),
        ),
    ),
    TriplesMap(
        "Partnership_estrang", _all("RFB_SOCIEDADE_COM_ESTRANGEIRO"), RFB + "Sociedade_Estrangeiro/{ID_SOCIEDADE}",
        (CNPJ + "Sociedade", CNPJ + "Sociedade_Estrangeiro", CNPJ + "Sociedade"),
        (
            _link(RFB + "Agent/{ID_SOCIO}", CNPJ + "tem_socio"),
            _text("ID_SOCIEDADE", RDFS + "label"),
            _date("DATA_INICIO_SOCIEDADE", CNPJ + "data_entrada_participacao"),
            _link(RFB + "Pessoa/{ID_REPRESENTANTE}", CNPJ + "tem_representante"),
            _link(DOMAIN + "Qualificacao/{ID_QUALIFICACAO_REPRESENTANTE}", CNPJ + "qualificacao_do_responsavel"),
            _link(DOMAIN + "Qualificacao/{ID_URI}", CNPJ + "qualificacao_socio"),
        ),
    ),
    TriplesMap(
        "Socio_RFB", _partner_sql("SOCIO_PESSOA_FISICA", "RFB_SOCIEDADE_COM_PESSOA_FISICA"),
        RFB + "Pessoa/{ID_SOCIO}", (CNPJ + "Socio", CNPJ + "Socio_RFB", FOAF + "Person"),
        (
            _date("DATA_INICIO_SOCIEDADE", CNPJ + "inicio_participacao"),
            _text("ID_SOCIO", RDFS + "label"),
            _link(DOMAIN + "Qualificacao/{ID_QUALIFICACAO_SOCIO}", CNPJ + "tem_qualificacao_socio"),
        ),
        source="RFB_SOCIEDADE_COM_PESSOA_FISICA",
    ),
    TriplesMap(
        "Socio_RFB_PJ", _partner_sql("SOCIO_PESSOA_JURIDICA", "RFB_SOCIEDADE_COM_HOLDING"),
        RFB + "Socio/{ID_SOCIO}", (CNPJ + "Socio", CNPJ + "Socio_RFB", FOAF + "Organization"),
        (
            _date("DATA_INICIO_SOCIEDADE", CNPJ + "inicio_participacao"),
            _text("ID_SOCIO", RDFS + "label"),
            _link(DOMAIN + "Qualificacao/{ID_QUALIFICACAO_SOCIO}", CNPJ + "tem_qualificacao_socio"),
        ),
        source="RFB_SOCIEDADE_COM_HOLDING",
    ),
    TriplesMap(
        "Socio_RFB_PF", _partner_sql("SOCIO_ESTRANGEIRO", "RFB_SOCIEDADE_COM_ESTRANGEIRO"),
        RFB + "Agente/{ID_SOCIO}",
        (CNPJ + "Socio", CNPJ + "Socio_RFB", FOAF + "Person", CNPJ + "Estrangeiro"),
        (
            _date("DATA_INICIO_SOCIEDADE", CNPJ + "inicio_participacao"),
            _text("ID_SOCIO", RDFS + "label"),
            _link(DOMAIN + "Qualificacao/{ID_URI}", CNPJ + "tem_qualificacao_socio"),
        ),
        source="RFB_SOCIEDADE_COM_ESTRANGEIRO",
    ),
    TriplesMap(
        "Person", _all("RFB_PESSOA"), RFB + "Pessoa/{ID_PESSOA}",
        (FOAF + "Person", FOAF + "Agent", CNPJ + "Pessoa_RFB", CNPJ + "Pessoa", CNPJ + "Socio"),
        (
            _text("CPF", CNPJ + "cpf"),
            _text("NOME", FOAF + "name", RDFS + "label"),
            ObjectMap((CNPJ + "faixa_etaria",), column="FAIXA_ETARIA"),
        ),
    ),
    TriplesMap(
        "Estrangeiro", _all("RFB_ESTRANGEIRO"), RFB + "Agente/{ID_SOCIO}",
        (FOAF + "Agent", CNPJ + "Estrangeiro"),
        (
            _text("NOME", RDFS + "label"),
            ObjectMap((CNPJ + "e_estrangeiro",), constant="true", datatype=XSD_BOOLEAN),
            _link(DOMAIN + "Pais/{NOME_PAIS}", CNPJ + "tem_pais"),
        ),
    ),
    TriplesMap(
        "Organization_has_special_situation", _all("RFB_TEM_SITUACAO_ESPECIAL"), RFB + "Empresa/{ID_EMPRESA}",
        objects=(_link(RFB + "Situacao_Especial/{ID_SITUACAO_ESPECIAL}", CNPJ + "tem_situacao_especial"),),
    ),
    TriplesMap(
        "has_subsidiary", _all("RFB_TEM_ESTABELECIMENTO"), RFB + "Empresa/{ID_EMPRESA}",
        objects=(_link(RFB + "Estabelecimento/{ID_ESTABELECIMENTO}",
                       CNPJ + "tem_estabelecimento", CNPJ + "tem_filial", CNPJ + "tem_filial"),),
    ),
    TriplesMap(
        "has_partnership_fisic", _all("RFB_TEM_SOCIEDADE_FISICA"), RFB + "Empresa/{ID_EMPRESA}",
        objects=(_link(RFB + "Sociedade_PF/{ID_SOCIO}", CNPJ + "tem_sociedade", CNPJ + "tem_sociedade_fisica"),),
    ),
    TriplesMap(
        "has_partnership_jID", _all("RFB_TEM_SOCIEDADE_JURIDICA"), RFB + "Empresa/{ID_EMPRESA}",
        objects=(_link(RFB + "Sociedade_PJ/{ID_SOCIO}", CNPJ + "tem_sociedade", CNPJ + "tem_sociedade_juridica"),),
    ),
    TriplesMap(
        "has_partnership_extrang", _all("RFB_TEM_SOCIEDADE_ESTRANGEIRA"), RFB + "Empresa/{ID_EMPRESA}",
        objects=(_link(RFB + "Sociedade_Estrangeiro/{ID_SOCIO}",
                       CNPJ + "tem_sociedade", CNPJ + "tem_sociedade_estrangeiro"),),
    ),
    TriplesMap(
        "Option_SIMPLES",
        "SELECT ID_OPCAO_SIMPLES, TIPO_SIMPLES, DATA_OPCAO_SIMPLES, DATA_EXCLUSAO_SIMPLES FROM RFB_OPCAO_SIMPLES",
        RFB + "Opcao_Simples/{ID_OPCAO_SIMPLES}", (CNPJ + "Opcao_SIMPLES",),
        (
            _text("ID_OPCAO_SIMPLES", RDFS + "label"),
            _text("TIPO_SIMPLES", CNPJ + "tipo_opcao_SIMPLES"),
            _date("DATA_OPCAO_SIMPLES", CNPJ + "data_opcao_SIMPLES"),
            _date("DATA_EXCLUSAO_SIMPLES", CNPJ + "data_exclusao_SIMPLES"),
        ),
        source="RFB_OPCAO_SIMPLES",
    ),
    TriplesMap(
        "Special_Situation",
        "SELECT ID_SITUACAO_ESPECIAL, DATA_INICIO_SIT_ESPECIAL, DESCRICAO FROM RFB_SITUACAO_ESPECIAL",
        RFB + "Situacao_Especial/{ID_SITUACAO_ESPECIAL}", (CNPJ + "Situacao_Especial",),
        (
            _text("ID_SITUACAO_ESPECIAL", RDFS + "label"),
            _date("DATA_INICIO_SIT_ESPECIAL", CNPJ + "data_inicio_situacao_especial"),
            _text("DESCRICAO", CNPJ + "descricao_situacao_especial", RDFS + "label"),
        ),
        source="RFB_SITUACAO_ESPECIAL",
    ),
    TriplesMap(
        "has_secondary_activity", _all("RFB_TEM_ATIV_ECONOMICA_SECUNDARIA"),
        RFB + "Estabelecimento/{CNPJ_COMPLETO}",
        objects=(_link(DOMAIN + "Atividade_Economica/{CNAE}", CNPJ + "tem_atividade_economica"),),
    ),
    TriplesMap(
        "Cadastral_Situation", _all("RFB_SITUACAO_CADASTRAL"), RFB + "Situacao_Cadastral/{ID_SITUACAO_CADASTRAL}",
        (CNPJ + "Situacao_Cadastral", CNPJ + "Situacao_Cadastral"),
        (
            _text("ID_SITUACAO_CADASTRAL", RDFS + "label"),
            _date("VAL_DATA_SITUACAO", CNPJ + "data_da_situacao_cadastral"),
            _text("SITUACAO", CNPJ + "tipo_situacao"),
            _link(RFB + "Razao_Situacao_Cadastral/{ID_URI}", CNPJ + "tem_razao_situacao"),
        ),
    ),
    TriplesMap(
        "Reason_Cadastral_Situation", _all("RFB_RAZAO_SITUACAO_CADASTRAL"),
        RFB + "Razao_Situacao_Cadastral/{ID_RAZAO_SITUACAO_CADASTRAL}", (CNPJ + "Razao_Situacao_Cadastral",),
        (
            _text("ROTULO", RDFS + "label"),
            _text("CODIGO_RAZAO_SITUACAO", CNPJ + "codigo_razao_situacao"),
        ),
    ),
    TriplesMap(
        "Address", _ADDRESS_SQL, RFB + "Endereco/{ID_ENDERECO}", (CNPJ + "Endereco", CNPJ + "Endereco"),
        (
            _text("NUMERO", CNPJ + "numero"),
            _text("COMPLEMENTO", CNPJ + "complemento"),
            _text("ENDERECO", RDFS + "label"),
            _link(DOMAIN + "Unidade_Federativa/{UF}", CNPJ + "tem_estado", CNPJ + "tem_unidade_federativa"),
            _link(DOMAIN + "Pais/{NOME_PAIS}", CNPJ + "tem_pais"),
            _link(DOMAIN + "Cidade/{ID_CIDADE}", CNPJ + "tem_cidade"),
            _link(DOMAIN + "Bairro/{BAIRRO}", CNPJ + "tem_bairro"),
            _link(DOMAIN + "Logradouro/{LOGRADOURO}", CNPJ + "tem_logradouro"),
            _text("CEP", VCARD + "postal-code", CNPJ + "cep"),
        ),
        source="RFB_ENDERECO",
    ),
    TriplesMap(
        "AddressExt", _FOREIGN_ADDRESS_SQL, RFB + "Endereco_Exterior/{ID_ENDERECO}",
        (CNPJ + "Endereco", CNPJ + "Endereco_Exterior"),
        (
            _text("ENDERECO", RDFS + "label"),
            _link(DOMAIN + "Pais/{NOME_PAIS}", CNPJ + "tem_pais"),
            _link(DOMAIN + "Cidade/{CITY_EXT}", CNPJ + "tem_cidade"),
        ),
        source="RFB_ENDERECO_EXTERIOR",
    ),
)
