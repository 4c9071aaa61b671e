from tripleloom.functions.fold import iri_key, key_text, strip_accents
from tripleloom.functions.lexical import double_text, is_truthy, literal_or_null, literal_text
from tripleloom.functions.ntriples import compact_iri, escape_literal

__all__ = [
    "compact_iri", "double_text", "escape_literal", "iri_key", "is_truthy", "key_text",
    "literal_or_null", "literal_text", "strip_accents",
]
