"""Scalar expressions against plain-Python statements of their rules."""

import datetime as dt
import re
import sys
import unicodedata
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleloom.functions import double_text, iri_key, is_truthy, key_text, literal_text, strip_accents
from tripleloom.functions.lexical import XSD_DATE, XSD_DOUBLE, XSD_STRING


def plain_accents(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def plain_key(value):
    upper = plain_accents(str(value)).upper()
    return re.sub("[^A-Z0-9_]", "", re.sub(r"\s+", "_", upper))


def compare(spark, texts, column, expected):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.v for r in frame.select("i", column(F.col("t")).alias("v")).collect()}
    wrong = [(texts[i], got[i], expected(texts[i])) for i in got if got[i] != expected(texts[i])]
    assert not wrong, wrong[:5]


def every_character():
    return [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]


def test_key_of_every_character_between_blanks(spark):
    """Each code point in a context where vanishing, blank and removed differ."""
    chars = [c for c in every_character() if ord(c) < 0x3000 or plain_key(c) or plain_accents(c) != c]
    compare(spark, [f"a {c} b{c}c" for c in chars], key_text, plain_key)


def test_accents_of_every_character(spark):
    chars = every_character()
    step = 40
    texts = ["x".join(chars[i:i + step]) for i in range(0, len(chars), step)]
    compare(spark, texts, strip_accents, plain_accents)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=200, max_size=400))
def test_random_text(spark, texts):
    texts = [t.replace("\x00", "") for t in texts]
    compare(spark, texts, key_text, plain_key)
    compare(spark, texts, strip_accents, plain_accents)


@pytest.mark.parametrize("text,key", [
    ("São  Paulo", "SAO_PAULO"), ("a - b", "A__B"), (" x ", "_X_"), ("º½ß", "O12SS"),
    ("´x", "_X"), ("", ""), ("ﷺ", "___"), ("a\u001cb\u0085c", "A_B_C"),
])
def test_key_cases(spark, text, key):
    assert plain_key(text) == key
    compare(spark, [text], key_text, plain_key)


def test_key_is_idempotent(spark):
    compare(spark, ["São  Paulo", "a - b", " x ", "½ ½"], lambda c: key_text(key_text(c)), plain_key)


def test_key_of_types(spark):
    schema = T.StructType([
        T.StructField("i", T.LongType()), T.StructField("b", T.BooleanType()),
        T.StructField("d", T.DateType()), T.StructField("n", T.DecimalType(12, 2)),
        T.StructField("f", T.DoubleType()), T.StructField("t", T.TimestampNTZType()),
        T.StructField("s", T.StringType()),
    ])
    rows = [
        (-7, True, dt.date(2020, 1, 1), Decimal("-1.10"), 1.0, dt.datetime(2020, 1, 2, 3, 4, 5), "é"),
        (12, False, dt.date(1999, 12, 31), Decimal("0.00"), -0.5, dt.datetime(2020, 1, 2, 3, 4, 5, 60), ""),
        (None,) * 7,
    ]
    frame = spark.createDataFrame(rows, schema)
    keyed = frame.select(*[iri_key(F.col(f.name), f.dataType).alias(f.name) for f in schema])
    expected = [tuple(plain_key(v) for v in row) for row in rows]
    assert [tuple(r) for r in keyed.collect()] == expected
    dropped = frame.select(iri_key(F.col("s"), T.StringType(), None).alias("k")).collect()
    assert [r.k for r in dropped] == ["E", "", None]


def test_key_rejects_nested_types():
    with pytest.raises(TypeError):
        iri_key(None, T.ArrayType(T.StringType()))


DOUBLES = [0.0, -0.0, 1.0, -1.5, 12345678.9, 1e7, 1.5e7, 123456789012345.0, 1e15, 1e16, 1.25e16,
           1e-4, 1.5e-4, -2.5e-5, 1e-5, 1e-10, 1e100, 1.7e308, 5e-100, 0.001, 9999999.99, 2.5e21]


def test_double_text(spark):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(DOUBLES)], "i int, v double")
    got = {r.i: r.t for r in frame.select("i", double_text(F.col("v")).alias("t")).collect()}
    assert [got[i] for i in range(len(DOUBLES))] == [repr(v) for v in DOUBLES]
    special = spark.sql("SELECT double('NaN') a, double('Infinity') b, double('-Infinity') c")
    row = special.select(*[double_text(F.col(c)).alias(c) for c in "abc"]).first()
    assert tuple(row) == ("NaN", "INF", "-INF")


@settings(max_examples=3, deadline=None)
@given(st.lists(st.integers(-10**13, 10**13), min_size=200, max_size=300))
def test_money_text(spark, cents):
    values = [c / 100 for c in cents]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    rows = frame.select("v", double_text(F.col("v")).alias("t")).collect()
    assert all(r.t == repr(r.v) for r in rows), [(r.v, r.t) for r in rows if r.t != repr(r.v)][:3]


def test_literal_text(spark):
    row = spark.sql("""
        SELECT '20200131' a, '2020-01-31' b, '20201331' c, 'x' d, '1.50' e, '1,50' f, '1.5d' g,
               timestamp_ntz'2020-01-31 10:00:00' h, date'2020-01-31' i""")
    text, stamp = T.StringType(), T.TimestampNTZType()
    got = row.select(
        *[literal_text(F.col(c), text, XSD_DATE).alias(c) for c in "abcd"],
        *[literal_text(F.col(c), text, XSD_DOUBLE).alias(c) for c in "efg"],
        literal_text(F.col("h"), stamp, XSD_DATE).alias("h"),
        literal_text(F.col("h"), stamp, XSD_STRING).alias("h2"),
        literal_text(F.col("i"), T.DateType(), XSD_STRING).alias("i"),
    ).first()
    assert tuple(got) == ("2020-01-31", "2020-01-31", "20201331", "x", "1.5", "1,50", "1.5d",
                          "2020-01-31", "2020-01-31T10:00:00", "2020-01-31")


@pytest.mark.parametrize("kind,values", [
    ("string", [None, "", "0", " ", "x"]), ("long", [None, 0, 1, -1]), ("boolean", [None, True, False]),
    ("double", [None, 0.0, -0.0, float("nan"), 0.1]), ("date", [None, dt.date(1970, 1, 1)]),
    ("decimal(5,2)", [None, Decimal("0.00"), Decimal("0.01")]), ("binary", [None, b"", b"0"]),
])
def test_truthiness(spark, kind, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    kept = frame.filter(is_truthy(F.col("v"), frame.schema["v"].dataType)).select("i").collect()
    assert {r.i for r in kept} == {i for i, v in enumerate(values) if v}
