"""Triple generation on small fixtures, against the stated rules."""

import pytest

from tripleloom.functions.lexical import XSD_DOUBLE, XSD_STRING
from tripleloom.operators.rules import ObjectMap, TriplesMap, rules_frame
from tripleloom.operators.triples import RDF_TYPE, Options, View, build_graph, reconcile, unique_subjects

N = "http://n/"


def tm(name="m", sql="SELECT * FROM T", subject=N + "x/{ID}", classes=(), objects=()):
    return TriplesMap(name, sql, subject, tuple(classes), tuple(objects))


def triples(spark, maps, tables, **options):
    graph = build_graph(spark, maps, tables, Options(**options)).distinct()
    return {tuple(r) for r in graph.triples().collect()}, graph


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame(
        [("a 1", "São Paulo", None, 0.0, 5), ("a 1", "", "0", 1.5, None), (None, " ", "x", None, 0)],
        "ID string, nome string, Code string, amount double, n int",
    )


def test_literals_and_classes(spark, t):
    m = tm(classes=[N + "C", N + "C", N + "D"], objects=[
        ObjectMap((N + "p", N + "q", N + "p"), column="NOME"),
        ObjectMap((N + "p",), column="code"),
        ObjectMap((N + "amount",), column="AMOUNT", datatype=XSD_DOUBLE),
        ObjectMap((N + "r, " + N + "r2",), column="n"),
        ObjectMap((N + "z",), column="absent"),
    ])
    got, graph = triples(spark, [m], {"T": t})
    one, none = N + "x/A_1", N + "x/NONE"
    lit = "literal", XSD_STRING
    assert got == {
        *((s, RDF_TYPE, N + c, "iri", "") for s in (one, none) for c in "CD"),
        (one, N + "p", "São Paulo", *lit), (one, N + "q", "São Paulo", *lit),
        (none, N + "p", " ", *lit), (none, N + "q", " ", *lit),
        (one, N + "p", "0", *lit), (none, N + "p", "x", *lit),
        (one, N + "amount", "1.5", "literal", XSD_DOUBLE),
        (one, N + "r", "5", *lit), (one, N + "r2", "5", *lit),
    }
    assert [(x.rule, x.reason) for x in graph.notes] == [("absent", "literal column not in the table")]


def test_object_templates(spark, t):
    m = tm(objects=[
        ObjectMap((N + "city",), template=N + "city/{Nome}"),
        ObjectMap((N + "pair",), template=N + "pair/{id}-{code}/end"),
        ObjectMap((N + "gone",), template=N + "gone/{nope}"),
        ObjectMap((N + "fixed",), template=N + "fixed"),
    ])
    got, graph = triples(spark, [m], {"T": t})
    assert {(p[len(N):], o[len(N):]) for _, p, o, _, _ in got} == {
        ("city", "city/SAO_PAULO"), ("city", "city/"), ("city", "city/_"),
        ("pair", "pair/A_1-NONE/end"), ("pair", "pair/A_1-0/end"), ("pair", "pair/NONE-X/end"),
        ("fixed", "fixed"),
    }
    assert {x.rule for x in graph.notes} == {N + "gone/{nope}"}
    dropped, _ = triples(spark, [m], {"T": t}, null_iri=None)
    assert {o[len(N):] for _, p, o, _, _ in dropped} == {"city/SAO_PAULO", "city/", "pair/A_1-0/end", "fixed"}


def test_subject_columns(spark, t):
    nothing = tm("none", subject=N + "{A}{B}", classes=[N + "C"])
    constant = tm("constant", subject=N + "s", classes=[N + "C"])
    got, graph = triples(spark, [nothing, constant], {"T": t})
    assert got == set() and len(graph.notes) == 2
    with pytest.raises(ValueError, match="subject columns"):
        build_graph(spark, [tm(subject=N + "{ID}{B}")], {"T": t})
    rows = reconcile(spark, [nothing, tm(classes=[N + "C"])], {"T": t}).collect()
    assert {(r.map, r.rows_in, r.rows_with_subject, r.difference) for r in rows} == {("none", 3, 0, 3), ("m", 3, 3, 0)}
    rows = reconcile(spark, [tm()], {"T": t}, Options(null_iri=None)).collect()
    assert (rows[0].rows_with_subject, rows[0].difference) == (2, 1)


def test_maps_without_a_table_are_noted(spark, t):
    got, graph = triples(spark, [tm("a", sql=None), tm("b", sql="SELECT 1")], {"T": t})
    assert got == set() and [x.map for x in graph.notes] == ["a", "b"]


def test_constants_only_when_asked(spark, t):
    m = tm(objects=[ObjectMap((N + "flag",), constant="true", datatype=N + "bool")])
    assert triples(spark, [m], {"T": t})[0] == set()
    got, _ = triples(spark, [m], {"T": t}, constants=True)
    assert {(p, o, d) for _, p, o, _, d in got} == {(N + "flag", "true", N + "bool")}


def test_ambiguous_templates_are_rejected():
    with pytest.raises(ValueError, match="two templates"):
        tm(objects=[ObjectMap((N + "p",), template="a{x}"), ObjectMap((N + "p",), template="b{x}")])
    kept = ObjectMap((N + "p",), column="c", template="a{x}")
    assert (kept.kind, kept.value) == ("column", "c")
    with pytest.raises(ValueError, match="no object"):
        ObjectMap((N + "p",))


def test_query_source_runs_the_sql(spark, t):
    t.createOrReplaceTempView("T")
    m = tm(sql="SELECT ID, CONCAT(ID, '-', Code) AS label FROM T", objects=[
        ObjectMap((N + "label",), column="label"), ObjectMap((N + "n",), column="n")])
    stored, _ = triples(spark, [m], {"T": t})
    assert {p for _, p, _, _, _ in stored} == {N + "n"}
    declared, graph = triples(spark, [m], {"T": t}, source="query")
    assert {(p, o) for _, p, o, _, _ in declared} == {(N + "label", "a 1-0")}
    assert [x.rule for x in graph.notes] == ["n"]


def test_overlapping_prefixes_stay_exact(spark):
    """Different prefixes that complete to the same IRI are still one triple."""
    rows = spark.createDataFrame([("AB", "B"), ("CB", "B")], "a string, b string")
    maps = [
        tm("one", subject=N + "{a}", objects=[ObjectMap((N + "p",), template=N + "x/{a}")]),
        tm("two", subject=N + "A{b}", objects=[ObjectMap((N + "p",), template=N + "x/A{b}")]),
        tm("three", subject=N + "{a}", objects=[ObjectMap((N + "p",), template=N + "x/{a}foo{b}")]),
        tm("four", subject=N + "{a}", objects=[ObjectMap((N + "p2",), template=N + "x/foo{b}")]),
    ]
    graph = build_graph(spark, maps, {"T": rows}).distinct()
    out = [tuple(r)[:3] for r in graph.triples().collect()]
    assert len(out) == len(set(out)) == 6
    parts = [build_graph(spark, [m], {"T": rows}) for m in maps]
    merged = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).distinct()
    assert sorted(tuple(r)[:3] for r in merged.triples().collect()) == sorted(out)


def test_union_of_graphs_is_graph_of_union(spark, t):
    m = tm(classes=[N + "C"], objects=[ObjectMap((N + "p",), column="nome")])
    m2 = tm("m2", objects=[ObjectMap((N + "q",), column="nome"), ObjectMap((N + "p",), column="nome")])
    together = build_graph(spark, [m, m2], {"T": t}).distinct()
    apart = build_graph(spark, [m], {"T": t}).union(build_graph(spark, [m2], {"T": t})).distinct()
    again = apart.union(together).distinct()
    expected = {tuple(r) for r in together.triples().collect()}
    assert {tuple(r) for r in apart.triples().collect()} == expected
    assert again.encoded.count() == len(expected)
    spread, _ = triples(spark, [m, m2], {"T": t.repartition(5)})
    assert spread == expected


def test_lines_escape_literals(spark):
    text = 'a "b" \\ c\nd\te\r'
    rows = spark.createDataFrame([("k", text)], "ID string, v string")
    m = tm(classes=[N + "C"], objects=[
        ObjectMap((N + "p",), column="v"), ObjectMap((N + "q",), column="v", datatype=N + "t"),
        ObjectMap((N + "r",), template=N + "o/{v}")])
    lines = {r.value for r in build_graph(spark, [m], {"T": rows}).lines().collect()}
    shown = '"a \\"b\\" \\\\ c\\nd\\te\\r"'
    assert lines == {
        f"<{N}x/K> <{RDF_TYPE}> <{N}C> .", f"<{N}x/K> <{N}p> {shown} .",
        f"<{N}x/K> <{N}q> {shown}^^<{N}t> .", f"<{N}x/K> <{N}r> <{N}o/A_B__C_D_E_> .",
    }


def test_rules_frame(spark):
    m = tm(classes=[N + "C"], objects=[
        ObjectMap((N + "p", N + "q"), column="v"), ObjectMap((N + "r",), template=N + "{v}")])
    rows = rules_frame(spark, [m]).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in rows} == {"class": 1, "column": 2, "template": 1}


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_plan_has_one_scan_one_shuffle_and_no_python(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    maps = [
        tm("a", subject=N + "o/{o_orderkey}", classes=[N + "C"], objects=[ObjectMap((N + "p",), column="o_orderdate")]),
        tm("b", subject=N + "c/{o_custkey}", objects=[ObjectMap((N + "q",), template=N + "o/{o_orderkey}")]),
    ]
    plan = plan_of(build_graph(spark, maps, {"T": orders}).distinct().triples())
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert "Python" not in plan and "Expand" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate" in plan
    assert "o_totalprice" not in plan


def test_unique_subjects_leave_the_shuffle_and_keep_the_graph(spark):
    rows = spark.createDataFrame(
        [("a", "1", "1", "x"), ("b", "1", None, "x"), ("c", "2", "3", "y")], "id string, t1 string, t2 string, grp string")
    doubled = spark.createDataFrame([("é", "1"), ("e", "1"), (None, "2")], "id string, t1 string")
    maps = [
        tm("keyed", subject=N + "x/{id}", classes=[N + "C"], objects=[
            ObjectMap((N + "phone",), column="t1"), ObjectMap((N + "phone",), column="t2"),
            ObjectMap((N + "grp",), template=N + "g/{grp}")]),
        tm("grouped", subject=N + "g/{grp}", classes=[N + "G"], objects=[ObjectMap((N + "has",), template=N + "x/{id}")]),
        tm("doubled", sql="SELECT * FROM D", subject=N + "x/{id}", classes=[N + "C"],
           objects=[ObjectMap((N + "t",), column="t1")]),
    ]
    tables = {"T": rows, "D": doubled}
    unique = unique_subjects(spark, maps, tables)
    assert unique == {"keyed"}
    plain = build_graph(spark, maps, tables).distinct()
    saving = build_graph(spark, maps, tables, unique=unique)
    assert sorted(saving.distinct().triples().collect()) == sorted(plain.triples().collect())
    # Only the group link: classes are shared with another map, phones come from two columns.
    assert {saving.shapes[r.shape - 1].predicate for r in saving.single.collect()} == {N + "grp"}


def test_a_set_shuffles_a_row_per_subject_into_tasks_by_stored_size(spark, tmp_path, monkeypatch):
    """Ten triples of a row used to be ten shuffled rows, put together in as many tasks whatever the table's size."""
    rows = [(f"k{i % 40}", f"v{i % 7}" if i % 5 else None, None if i % 3 else "é") for i in range(4000)]
    spark.createDataFrame(rows, "ID string, a string, b string").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    maps = [tm("one", classes=[N + "C", N + "D"], objects=[
                ObjectMap((N + "p", N + "q"), column="a"), ObjectMap((N + "r",), template=N + "o/{b}")]),
            tm("two", subject=N + "o/{b}", classes=[N + "O"]),
            tm("three", subject=N + "x/{ID}", objects=[ObjectMap((N + "p",), column="b"), ObjectMap((N + "r",), template=N + "o/{b}")])]
    graph = build_graph(spark, maps, {"T": table}, Options(null_iri=None))
    want = {tuple(r) for r in graph.triples().collect()}
    plan = plan_of(graph.distinct().triples())
    assert plan.index("HashAggregate") < plan.index("Generate") < plan.index("Exchange") and plan.count("Exchange") == 1
    got = [tuple(r) for r in graph.distinct().triples().collect()]
    assert len(got) == len(want) and set(got) == want
    assert graph.packed.rows.count() == 2 * 4000 - sum(r[2] is None for r in rows)  # two subjects a row
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    monkeypatch.setattr("tripleloom.operators.triples.SPREAD_BYTES", size // 50)
    assert graph.distinct().repeated.rdd.getNumPartitions() >= 50
    assert {tuple(r) for r in graph.distinct().distinct().triples().collect()} == want


def test_a_packed_row_is_one_text_and_keeps_every_sign(spark):
    """Objects as an array took half as many shuffled bytes again; signs of the packing inside a text stay what they are."""
    texts = ["", "\x01", "\x02", "\x02c", "\x02m\x01", "a\x01\x02b", "\x01\x01", "x", None]
    rows = spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)], "ID string, a string, b string")
    m = tm(classes=[N + "C", N + "D"], objects=[
        ObjectMap((N + "p", N + "q"), column="a"), ObjectMap((N + "r",), column="b"), ObjectMap((N + "q",), column="b"),
        ObjectMap((N + "t",), template=N + "\x01{a}\x02{ID}")])
    graph = build_graph(spark, [m], {"T": rows})
    assert graph.packed.rows.dtypes == [("s", "string"), ("o", "string")]
    want = {tuple(r) for r in graph.triples().collect()}
    got = [tuple(r) for r in graph.distinct().triples().collect()]
    assert len(got) == len(want) and set(got) == want
    # Both classes come from the same places, and so do p and r with none.
    assert sorted(map(len, graph.packed.units())) == [1, 1, 1, 1, 2]


def test_views_with_one_subject_share_a_packed_row(spark):
    """Each view of a row used to send the subject by itself."""
    rows = [(f"k{i % 7}", f"v{i % 3}", None if i % 4 else "w", [True, False, None][i % 3], i % 2 == 0, True) for i in range(60)]
    base = spark.createDataFrame(rows, "k string, v string, w string, f boolean, g boolean, h boolean")
    maps = [tm(f"m{i}", f"SELECT * FROM T{i}", N + ("y/{ID}" if i == 2 else "x/{ID}"), [N + "C", N + f"C{i}"],
               [ObjectMap((N + "p", N + f"p{i}"), column="V"), ObjectMap((N + "q",), column="W")]) for i in range(7)]
    flags = [None, "f", "g", "h", "f", "g", None]
    tables = {f"T{i}": [View(base, {"ID": "k", "V": "vw"[i % 2], "W": "w"}, flag)] for i, flag in enumerate(flags)}
    graph = build_graph(spark, maps, tables)
    assert graph.packed.rows.count() == 60
    want = {tuple(r) for r in graph.triples().collect()}
    got = [tuple(r) for r in graph.distinct().triples().collect()]
    assert len(got) == len(want) and set(got) == want


def test_packed_rows_are_left_behind_by_graphs_of_other_triples(spark, t):
    m = tm(classes=[N + "C"], objects=[ObjectMap((N + "p",), column="nome")])
    graph = build_graph(spark, [m], {"T": t})
    assert graph.packed is not None
    for other in (graph.distinct(), graph.whole(), graph.union(graph), build_graph(
            spark, [m], {"T": t.selectExpr("*", "1L AS weight")}, carry=("weight",))):
        assert other.packed is None
    assert graph.whole().distinct().encoded.count() == graph.distinct().encoded.count()
