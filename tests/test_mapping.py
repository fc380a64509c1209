"""Term maps, fan-out, sources and mapping documents on small fixtures."""

import pytest
from pyspark.sql import functions as F

from quadweave import (
    Mapping,
    call,
    const,
    csv_source,
    json_source,
    literal,
    parent,
    ref,
    table,
    template,
    triples_map,
    xml_source,
)
from quadweave.errors import IriError, MappingError, SourceError
from quadweave.functions import FunctionRegistry
from quadweave.operators import terms
from quadweave.sources.rdf import read_rdf

V = "http://example.org/"
BASE = "http://example.com/base/"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
PREFIXES = """@prefix rr: <http://www.w3.org/ns/r2rml#> .
@prefix rml: <http://semweb.mmlab.be/ns/rml#> .
@prefix ql: <http://semweb.mmlab.be/ns/ql#> .
@prefix fnml: <http://semweb.mmlab.be/ns/fnml#> .
@prefix fno: <https://w3id.org/function/ontology#> .
@prefix ex: <http://example.org/> .
@prefix in: <http://example.org/stream#> .
"""
ORCHARD = """<orchard>
  <plot name="slope">
    <tree tag="q7"><graft><scion year="1998">Boskoop</scion></graft></tree>
    <tree tag="041"><graft><scion year="2004">Ribston &lt;red&gt;</scion><scion year="2011">Gräfin</scion></graft></tree>
  </plot>
  <nursery><bed><tree tag="z0"/></bed></nursery>
</orchard>"""


def objects(frame, predicate=None):
    rows = frame.where(F.col("p") == V + predicate) if predicate else frame
    return sorted(row.o for row in rows.collect())


@pytest.fixture
def orchard(tmp_path):
    (tmp_path / "trees.xml").write_text(ORCHARD, encoding="utf-8")
    return str(tmp_path)


def tree_map(iterator="/orchard/plot/tree", **options):
    return triples_map("tree", xml_source("trees.xml", iterator, **options), template("{@tag}"), classes=V + "Tree")


# --- sources, base and limit --------------------------------------------------------------------


def test_xml_source_gives_one_statement_per_element(spark, orchard):
    rows = Mapping.of(tree_map()).run(spark, root=orchard).collect()
    assert sorted(row.s for row in rows) == [BASE + "041", BASE + "q7"]
    assert {row.o for row in rows} == {V + "Tree"}


def test_limit(spark, orchard):
    assert Mapping.of(tree_map()).run(spark, root=orchard, limit=1).count() == 1


def test_base_iri(spark, orchard):
    rows = Mapping.of(tree_map()).run(spark, root=orchard, base_iri="https://archive.test/").collect()
    assert all(row.s.startswith("https://archive.test/") for row in rows)


def test_unnamed_input(spark):
    lamps = spark.createDataFrame([(9, "Kullen"), (4, "Utsira"), (4, "Oland")], "range int, name string")
    mapping = Mapping.of(triples_map("light", csv_source(None), template(V + "light/{name}"), classes=V + "Light"))
    rows = mapping.run(spark, {None: lamps}).collect()
    assert sorted(row.s for row in rows) == [V + "light/" + name for name in ("Kullen", "Oland", "Utsira")]


def test_unbound_input_is_an_error(spark):
    mapping = Mapping.of(triples_map("m", csv_source(None), template("x/{name}"), classes=V + "Light"))
    with pytest.raises(SourceError, match="unnamed input"):
        mapping.run(spark)


@pytest.mark.parametrize("text, valid", [("archive.test/", False), ("https://archive.test/", True), ("http://a b/", False)])
def test_base_iri_check(text, valid):
    if valid:
        assert terms.check_iri(text) == text
    else:
        with pytest.raises(IriError, match="is not a valid IRI"):
            terms.check_iri(text)


# --- sources -----------------------------------------------------------------------------------


def test_xml_iterators(spark, orchard):
    everywhere = Mapping.of(tree_map("//tree")).run(spark, root=orchard)
    assert sorted(row.s for row in everywhere.collect()) == [BASE + "041", BASE + "q7", BASE + "z0"]
    item = tree_map().add(V + "sort", ref("graft/scion")).add(V + "year", ref("graft/scion/@year"))
    frame = Mapping.of(item).run(spark, root=orchard)
    assert objects(frame, "sort") == ["Boskoop", "Gräfin", "Ribston <red>"]
    assert objects(frame, "year") == ["1998", "2004", "2011"]


def test_xml_text_column(spark):
    frame = spark.createDataFrame([("<a><b id='1'><c>x</c><c>y</c></b></a>",)], "value string")
    item = triples_map("b", xml_source(None, "/a/b"), template("{@id}")).add(V + "c", ref("c"))
    assert objects(Mapping.of(item).run(spark, {None: frame})) == ["x", "y"]


@pytest.mark.parametrize("path", ["a[1]", "a//b", "count(a)", "/a"])
def test_unsupported_xpath_is_rejected(spark, orchard, path):
    with pytest.raises(SourceError, match="unsupported XPath"):
        Mapping.of(tree_map().add(V + "x", ref(path))).run(spark, root=orchard)


def test_csv_keeps_text_quotes_and_empty_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n007,"say ""hi""\nthere"\n2,\n3,""\n')
    item = triples_map("a", csv_source("a.csv"), template("{id}")).add(V + "name", ref("name"))
    frame = Mapping.of(item).run(spark, root=str(tmp_path))
    assert {(r.s, r.o) for r in frame.collect()} == {
        (BASE + "007", 'say "hi"\nthere'),
        (BASE + "2", ""),
        (BASE + "3", ""),
    }
    item = triples_map("a", csv_source("a.csv", null_value=""), template("{id}")).add(V + "name", ref("name"))
    assert Mapping.of(item).run(spark, root=str(tmp_path)).count() == 1  # quoted or not, the text is empty


def test_json_iterator_and_number_text(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"cars": [\n {"id": "1", "price": 1.50, "tags": ["x", 2.00], "owner": {"name": "A"}},\n {"id": "2"}]}'
    )
    item = (
        triples_map("car", json_source("a.json", "$.cars[*]"), template("car/{id}"), classes=V + "Car")
        .add(V + "price", ref("price"))
        .add(V + "tag", ref("$.tags[*]"))
        .add(V + "owner", ref("owner.name"))
        .add(V + "first", ref("tags[0]")) 
    )
    frame = Mapping.of(item).run(spark, root=str(tmp_path))
    assert objects(frame, "price") == ["1.50"]
    assert objects(frame, "tag") == ["2.00", "x"]
    assert objects(frame, "owner") == ["A"]
    assert objects(frame, "first") == ["x"]
    assert frame.where(F.col("p") == TYPE).count() == 2


def test_json_text_column_keeps_number_text(spark):
    text = r'{"k": 1.50, "s": "a \" 2.50 \\", "big": 12345678901234567890.10, "n": {"b": [{"c": 1}, {"c": 2}]}}'
    frame = spark.createDataFrame([(7, text)], "id int, props string")
    item = (
        triples_map("e", json_source("e", column="props"), template("e/{id}"))
        .add(V + "k", ref("$.k"))
        .add(V + "s", ref("s"))
        .add(V + "big", ref("$['big']"))
        .add(V + "c", ref("n.b[*].c"))
    )
    result = Mapping.of(item).run(spark, {"e": frame})
    assert objects(result, "k") == ["1.50"]
    assert objects(result, "s") == ['a " 2.50 \\']
    assert objects(result, "big") == ["12345678901234567890.10"]
    assert objects(result, "c") == ["1", "2"]


@pytest.mark.parametrize("path", ["$..a", "$.a[?(@.b)]", "$.a[1:2]"])
def test_unsupported_json_path_is_rejected(spark, path):
    frame = spark.createDataFrame([("{}",)], "value string")
    item = triples_map("e", json_source("e"), template("e/{id}")).add(V + "x", ref(path))
    with pytest.raises(SourceError, match="unsupported JSONPath"):
        Mapping.of(item).run(spark, {"e": frame})


# --- terms -------------------------------------------------------------------------------------


def test_template_escapes_and_null(spark):
    frame = spark.createDataFrame([("a", None), ("b", "x")], "k string, v string")
    item = triples_map("t", table("t"), template(r"http://x/\{{k}\}")).add(V + "v", template("{k}-{v}", term_type="literal"))
    rows = Mapping.of(item).run(spark, {"t": frame}).collect()
    assert [(r.s, r.o) for r in rows] == [("http://x/{b}", "b-x")]


@pytest.mark.parametrize("bad", ["http://x/{a", "http://x/a}", "http://x/{}"])
def test_bad_templates(bad):
    with pytest.raises(MappingError):
        template(bad)


def test_iri_encodings(spark):
    frame = spark.createDataFrame([("a b/c*~é_-.+%&'()!@中\n",)], "x string")
    row = frame.select(
        terms.encode_iri_part(F.col("x"), "ascii").alias("a"), terms.encode_iri_part(F.col("x"), "rfc3987").alias("i")
    ).first()
    assert row.a == "a%20b%2Fc%2A~%C3%A9_-.%2B%25%26%27%28%29%21%40%E4%B8%AD%0A"
    assert row.i == "a%20b%2Fc%2A~é_-.%2B%25%26%27%28%29%21%40中%0A"


def test_canonical_doubles(spark):
    cases = {
        12345.67: "1.234567E4",
        0.001: "1.0E-3",
        1e10: "1.0E10",
        1e-5: "1.0E-5",
        -0.25: "-2.5E-1",
        100.0: "1.0E2",
        0.0: "0.0E0",
        float("inf"): "INF",
        float("-inf"): "-INF",
    }
    frame = spark.createDataFrame([(v, t) for v, t in cases.items()], "v double, t string")
    assert frame.where(~(terms.canonical_double(F.col("v")) == F.col("t"))).count() == 0


def test_natural_types(spark):
    frame = spark.sql(
        "SELECT 1 AS i, true AS b, 1.50BD AS d, DATE'2024-01-02' AS t, X'0AFF' AS x, "
        "TIMESTAMP_NTZ'2024-01-02 03:04:05.6' AS ts, 'q' AS s"
    )
    item = triples_map("t", table("t"), template("r/{i}"))
    for name in frame.columns:
        item = item.add(V + name, ref(name))
    rows = {r.p[len(V) :]: (r.o, r.o_dt and r.o_dt.rpartition("#")[2]) for r in Mapping.of(item).run(spark, {"t": frame}).collect()}
    assert rows == {
        "i": ("1", "integer"),
        "b": ("true", "boolean"),
        "d": ("1.50", "decimal"),
        "t": ("2024-01-02", "date"),
        "x": ("0AFF", "hexBinary"),
        "ts": ("2024-01-02T03:04:05.600000", "dateTime"),
        "s": ("q", None),
    }


def test_string_datatype_is_the_plain_literal(spark):
    frame = spark.createDataFrame([("a",)], "k string")
    item = triples_map("t", table("t"), template("{k}"))
    item = item.add(V + "v", ref("k", datatype="http://www.w3.org/2001/XMLSchema#string"))
    assert Mapping.of(item).run(spark, {"t": frame}).first().o_dt is None


def test_repeated_multi_valued_reference_is_not_squared(spark):
    frame = spark.createDataFrame([(1, ["a", "b"], ["x", "y"]), (2, [], ["z"]), (3, None, None)], "id int, v array<string>, w array<string>")
    item = triples_map("t", table("t"), template("r/{id}"), classes=V + "T")
    item = item.add(V + "two", template("{v}-{w}-{v}", term_type="literal")).add(V + "v", ref("v"))
    result = Mapping.of(item).run(spark, {"t": frame})
    assert objects(result, "two") == ["a-x-a", "a-y-a", "b-x-b", "b-y-b"]
    assert objects(result, "v") == ["a", "b"]
    assert result.where(F.col("p") == TYPE).count() == 3


def test_multi_valued_subject_and_object(spark):
    frame = spark.createDataFrame([(["a", "b"],)], "v array<string>")
    item = triples_map("t", table("t"), template("r/{v}")).add(V + "v", ref("v"))
    rows = Mapping.of(item).run(spark, {"t": frame}).collect()
    assert sorted((r.s, r.o) for r in rows) == [(BASE + f"r/{s}", o) for s in "ab" for o in "ab"]


def test_blank_nodes_are_stable(spark):
    frame = spark.range(100).select(F.col("id").cast("string").alias("k"))
    item = triples_map("t", table("t"), template("n-{k}", term_type="bnode")).add(V + "k", ref("k"))
    mapping = Mapping.of(item)
    one = mapping.run(spark, {"t": frame.repartition(7)})
    two = mapping.run(spark, {"t": frame.repartition(3)})
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
    assert one.select("s").distinct().count() == 100


def test_on_invalid(spark):
    frame = spark.createDataFrame([("http://ok/x",), ("not ok",)], "u string")
    mapping = Mapping.of(triples_map("t", table("t"), ref("u", term_type="iri"), classes=V + "T"))
    assert mapping.run(spark, {"t": frame}).count() == 2
    assert [r.s for r in mapping.run(spark, {"t": frame}, on_invalid="drop").collect()] == ["http://ok/x"]
    with pytest.raises(Exception, match="invalid IRI"):
        mapping.run(spark, {"t": frame}, on_invalid="fail").collect()


def test_positions_are_checked(spark):
    frame = spark.createDataFrame([("a",)], "k string")
    item = triples_map("t", table("t"), literal("no subject")).add(V + "k", ref("k"))
    with pytest.raises(MappingError, match="a subject cannot be a literal"):
        Mapping.of(item).run(spark, {"t": frame})


# --- graphs, functions, hooks ------------------------------------------------------------------


def test_graph_sets(spark):
    frame = spark.createDataFrame([("a",)], "k string")
    item = triples_map("t", table("t"), template("{k}"), classes=V + "T", graphs=V + "g1")
    item = item.add(V + "p", ref("k"), [V + "g2", "http://www.w3.org/ns/r2rml#defaultGraph"])
    rows = Mapping.of(item).run(spark, {"t": frame}).collect()
    assert {(r.p, r.g) for r in rows} == {(TYPE, V + "g1"), (V + "p", V + "g1"), (V + "p", V + "g2"), (V + "p", None)}


def test_functions_and_configurers_run_in_order(spark):
    import pandas as pd

    @F.pandas_udf("string")
    def swap(text: pd.Series) -> pd.Series:
        return text.str.swapcase()

    frame = spark.createDataFrame([("aB",)], "k string")
    item = triples_map("t", table("t"), template("{k}")).add(V + "p", call(V + "swap", text="k"))
    seen = []

    def add_source(setup):
        seen.append(sorted(setup.sources))
        setup.sources["t"] = frame

    def add_function(setup):
        seen.append(sorted(setup.sources))
        setup.functions.register(V + "swap", lambda text: swap(text))
        setup.transforms.append(lambda df: df.withColumn("g", F.lit(V + "g")))

    row = Mapping.of(item).run(spark, configure=[add_source, add_function]).first()
    assert (row.o, row.g, seen) == ("Ab", V + "g", [[], ["t"]])


def test_unknown_function(spark):
    frame = spark.createDataFrame([("a",)], "k string")
    item = triples_map("t", table("t"), template("{k}")).add(V + "p", call(V + "nope", x="k"))
    with pytest.raises(MappingError, match="not registered"):
        Mapping.of(item).run(spark, {"t": frame}, functions=FunctionRegistry())


# --- mapping documents -------------------------------------------------------------------------


def document(tmp_path, body):
    path = tmp_path / "mapping.ttl"
    path.write_text(PREFIXES + body)
    return str(path)


def test_mapping_document_with_xml_source(spark, orchard, tmp_path):
    path = document(
        tmp_path,
        """ex:trees rr:subjectMap [ rr:class ex:Tree ; rr:template "{@tag}" ] ; rml:logicalSource ex:file .
           ex:file rml:iterator "/orchard/plot/tree" ; rml:source "trees.xml" ; rml:referenceFormulation ql:XPath .""",
    )
    mapping = Mapping.from_statements(read_rdf(spark, path))
    assert mapping.run(spark, root=orchard).exceptAll(Mapping.of(tree_map()).run(spark, root=orchard)).count() == 0
    assert mapping.run(spark, root=orchard).count() == 2


def test_mapping_document_equals_the_builder(spark, tmp_path):
    path = document(
        tmp_path,
        """ex:Light rml:logicalSource [ rml:source [ a in:Stream ] ; rml:referenceFormulation ql:CSV ] ;
          rr:subjectMap [ rr:template "http://example.org/light/{name}" ; rr:class ex:Light ; rr:graph ex:g ] ;
          rr:predicateObjectMap [ rr:predicate ex:kind ; rr:object ex:Car ],
            [ rr:predicate ex:label ; rr:objectMap [ rml:reference "name" ; rr:language "en" ] ],
            [ rr:predicate ex:shout ; rr:objectMap [ fnml:functionValue [
                rr:predicateObjectMap [ rr:predicate fno:executes ; rr:object ex:upper ],
                  [ rr:predicate ex:value ; rr:objectMap [ rml:reference "name" ] ] ] ] ],
            [ rr:predicate ex:keeper ; rr:objectMap [ rr:parentTriplesMap ex:Owner ;
                rr:joinCondition [ rr:child "id" ; rr:parent "light_id" ] ] ] .
          ex:Owner rml:logicalSource [ rml:source "keepers" ] ;
          rr:subjectMap [ rr:template "o/{light_id}/{name}" ; rr:termType rr:BlankNode ] .""",
    )
    read = Mapping.from_statements(read_rdf(spark, path))
    built = Mapping.of(
        triples_map(
            "m", csv_source(None), template("http://example.org/light/{name}"), classes=V + "Light", graphs=V + "g"
        )
        .add(V + "kind", const(V + "Car"))
        .add(V + "label", ref("name", language="en"))
        .add(V + "shout", call(V + "upper", value="name"))
        .add(V + "keeper", parent("o", ("id", "light_id"))),
        triples_map("o", table("keepers"), template("o/{light_id}/{name}", term_type="bnode")),
    )
    sources = {
        None: spark.createDataFrame([("1", "Kullen"), ("2", "Utsira")], "id string, name string"),
        "keepers": spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (3, "C")], "light_id int, name string"),
    }
    functions = FunctionRegistry().register(V + "upper", lambda value: F.upper(value))
    one, two = (m.run(spark, sources, functions=functions) for m in (read, built))
    assert one.count() == 2 * 4 + 3
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_no_triples_map_is_an_error(spark, tmp_path):
    with pytest.raises(MappingError, match="no triples map"):
        Mapping.from_statements(read_rdf(spark, document(tmp_path, "ex:a ex:b ex:c .")))


def test_graph_maps_without_a_value(spark):
    frame = spark.createDataFrame(
        [("1", "a", "b", ["x"]), ("2", None, "b", []), ("3", None, None, None)], "id string, g string, h string, gs array<string>"
    )
    item = triples_map("t", table("t"), template("{id}"))
    one = item.add(V + "p", ref("id"), template(V + "{g}"))
    two = item.add(V + "p", ref("id"), [template(V + "{g}"), template(V + "{h}")])
    fixed = item.add(V + "p", ref("id"), [template(V + "{g}"), V + "k"])
    many = item.add(V + "p", ref("id"), template(V + "{gs}"))

    def graphs(mapped):
        return sorted((r.o, (r.g or "")[len(V) :]) for r in Mapping.of(mapped).run(spark, {"t": frame}).collect())

    assert graphs(one) == [("1", "a"), ("2", ""), ("3", "")]
    assert graphs(two) == [("1", "a"), ("1", "b"), ("2", "b"), ("3", "")]
    assert graphs(fixed) == [("1", "a"), ("1", "k"), ("2", "k"), ("3", "k")]
    assert graphs(many) == [("1", "x"), ("2", ""), ("3", "")]


def test_self_join_on_a_key_needs_the_key(spark):
    frame = spark.createDataFrame([(1, "a"), (None, "b")], "id int, name string")
    source = table("t", unique=["id"])
    mapping = Mapping.of(
        triples_map("c", source, template("c/{name}")).add(V + "p", parent("p", ("id", "id"))),
        triples_map("p", source, template("p/{name}")),
    )
    assert objects(mapping.run(spark, {"t": frame})) == [BASE + "p/a"]


@pytest.mark.parametrize("name, text", [("x.csv", "a,b\n1,2\n3\n"), ("x.json", '{"a": 1}\n{"a": \n{"a": 3}\n')])
def test_broken_files_are_errors(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    source = csv_source(name) if name.endswith("csv") else json_source(name, "$", lines=True)
    mapping = Mapping.of(triples_map("m", source, template("x/{a}"), classes=V + "C"))
    with pytest.raises(Exception, match="(?i)malformed"):
        mapping.run(spark, root=str(tmp_path)).collect()


# --- documents that cannot be parsed -----------------------------------------------------------


@pytest.mark.parametrize("text", ['{"a": ', "nonsense {", '[{"a": 1}'])
def test_malformed_json_in_a_column_is_an_error(spark, text):
    frame = spark.createDataFrame([('{"a": "x"}',), (text,), (None,)], "value string")
    item = triples_map("m", json_source("docs", "$"), template("m/{a}"), classes=V + "Thing")
    with pytest.raises(Exception, match="malformed JSON document"):
        Mapping.of(item).run(spark, {"docs": frame}).collect()


def test_json_of_another_shape_has_no_match(spark):
    frame = spark.createDataFrame([('{"a": "x"}',), ("null",), (None,), ('"text"',), ("[1, 2]",), ("{}",)], "value string")
    item = triples_map("m", json_source("docs", "$"), template("m/{a}"), classes=V + "Thing")
    assert [r.s for r in Mapping.of(item).run(spark, {"docs": frame}).collect()] == [BASE + "m/x"]


@pytest.mark.parametrize("iterator", ["/orchard/plot/tree", "//tree"])
@pytest.mark.parametrize("text", ["<orchard><plot><tree tag='a'></plot></orchard>", "<orchard><plot><tree tag='a'><x></tree>"])
def test_malformed_xml_is_an_error(spark, tmp_path, iterator, text):
    (tmp_path / "trees.xml").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        Mapping.of(tree_map(iterator)).run(spark, root=str(tmp_path)).collect()


def test_malformed_xml_in_a_column_is_an_error(spark):
    good = "<orchard><plot><tree tag='a'/></plot></orchard>"
    frame = spark.createDataFrame([(good,), ("<orchard><plot>",)], "value string")
    assert len(Mapping.of(tree_map()).run(spark, {"trees.xml": frame.limit(1)}).collect()) == 1
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        Mapping.of(tree_map()).run(spark, {"trees.xml": frame}).collect()
