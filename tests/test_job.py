"""From mapping documents to a written dataset, as a user runs it."""

import os

import pytest

from quadweave import Mapping, json_source, map_to_rdf, ref, template, triples_map
from quadweave.errors import FormatError, IriError, MappingError, PrefixError, SourceError

V = "http://example.org/"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
HEAD = """PREFIX map: <http://www.w3.org/ns/r2rml#>
PREFIX rml: <http://semweb.mmlab.be/ns/rml#>
PREFIX form: <http://semweb.mmlab.be/ns/ql#>
BASE <http://garden.test/mapping/>
"""
SEEDS = """<accession> map:subjectMap <accession-subject> ; rml:logicalSource <vault> .
<accession-subject> map:class <http://example.org/Accession> ; map:template "{number}" .
<vault> rml:referenceFormulation form:XPath ; rml:iterator "/vault/shelf/packet" ; rml:source "seeds.xml" .
"""
FERRIES = """<ferry> a map:TriplesMap ;
  map:subjectMap [ map:class <http://example.org/Ferry> ; map:template "http://example.org/vessel/{callsign}" ] ;
  rml:logicalSource [ rml:referenceFormulation form:CSV ; rml:source [ a <http://garden.test/input#Stream> ] ] .
"""


@pytest.fixture
def place(tmp_path):
    for name, text in {
        "maps/seeds.ttl": HEAD + SEEDS,
        "ferries.ttl": HEAD + FERRIES,
        "data/seeds.xml": "<vault><shelf><packet><number>A-17</number><taxon>Vicia faba</taxon></packet></shelf>"
        "<shelf><packet><number>B-4</number></packet></shelf><lost><packet><number>C-9</number></packet></lost></vault>",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def lines(frame):
    return sorted(row.value for row in frame.collect())


def test_lines_come_back_without_an_output(spark, place):
    for fmt in (None, "ttl"):
        frame = map_to_rdf(spark, str(place / "maps"), mapping_format=fmt, root=str(place / "data"))
        assert lines(frame) == [f"<http://example.com/base/{n}> <{TYPE}> <{V}Accession> ." for n in ("A-17", "B-4")]


def test_unnamed_input_from_a_document(spark, place):
    ferries = spark.createDataFrame([("OJQX", 1200), ("LAZK", 90)], "callsign string, berths int")
    frame = map_to_rdf(spark, str(place / "ferries.ttl"), sources={None: ferries})
    assert lines(frame) == [f"<{V}vessel/{n}> <{TYPE}> <{V}Ferry> ." for n in ("LAZK", "OJQX")]


def test_pretty_turtle_with_prefixes_to_a_file(spark, place):
    report = map_to_rdf(
        spark,
        [str(place / "maps")],
        root=str(place / "data"),
        output=str(place / "out" / "seeds.ttl"),
        fmt="ttl",
        pretty=True,
        prefixes=f"ex={V},rdf",
    )
    assert report.written_raw == 2 and report.path.endswith("/out/seeds.ttl")
    text = "".join(open(os.path.join(report.path, f)).read() for f in os.listdir(report.path) if f.startswith("part-"))
    assert "<http://example.com/base/B-4>\n    a ex:Accession ." in text and f"@prefix ex: <{V}> ." in text


def test_limit_and_base(spark, place):
    frame = map_to_rdf(spark, str(place / "maps"), root=str(place / "data"), limit=1, base_iri="https://archive.test/")
    (line,) = lines(frame)
    assert line.startswith("<https://archive.test/")


def test_wrong_parameters(spark, place):
    run = lambda **options: map_to_rdf(spark, str(place / "maps"), root=str(place / "data"), **options)
    with pytest.raises(FormatError, match="Unsupported RDF Format"):
        run(fmt="sheet")
    with pytest.raises(IriError):
        run(base_iri="archive.test/")
    with pytest.raises(PrefixError):
        run(prefixes="ex=http://a/,ex=http://b/")
    with pytest.raises(SourceError):
        map_to_rdf(spark, str(place / "missing"))


def test_typed_json(spark):
    frame = spark.createDataFrame([('{"id": 7, "price": 2.5, "ok": true}',)], "value string")
    source = json_source(None, "$", types={"price": "double", "ok": "boolean"})
    item = triples_map("t", source, template("t/{id}"))
    rows = Mapping.of(item.add(V + "p", ref("price")).add(V + "ok", ref("ok")).add(V + "id", ref("id"))).run(
        spark, {None: frame}
    )
    assert {(r.o, r.o_dt and r.o_dt.rpartition("#")[2]) for r in rows.collect()} == {
        ("2.5E0", "double"),
        ("true", "boolean"),
        ("7", None),
    }


# --- what mapping documents have no words for --------------------------------------------------

CREW = """<sailor> map:subjectMap [ map:template "sailor/{id}" ] ; rml:logicalSource <crew> ;
  map:predicateObjectMap [ map:predicate <http://example.org/name> ; map:objectMap [ rml:reference "name" ] ] ;
  map:predicateObjectMap [ map:predicate <http://example.org/ship> ; map:objectMap [ map:parentTriplesMap <ship> ;
    map:joinCondition [ map:child "ship" ; map:parent "number" ] ] ] .
<ship> map:subjectMap [ map:template "ship/{title}" ] ; rml:logicalSource <fleet> .
<crew> rml:referenceFormulation form:CSV ; rml:source "crew.csv" .
<fleet> rml:referenceFormulation form:CSV ; rml:source "fleet.csv" .
"""


def test_keys_and_reader_options_for_mapping_documents(spark, tmp_path):
    (tmp_path / "crew.ttl").write_text(HEAD + CREW)
    (tmp_path / "crew.csv").write_text("id;name;ship\n1;Ann;7\n2;Bo;8\n3;Cy;9\n")
    (tmp_path / "fleet.csv").write_text("number,title\n7,Adder\n8,Beagle\n")
    options = {"fleet.csv": {"unique": ["number"]}, "crew.csv": {"sep": ";", "multi_line": False}}
    frame = map_to_rdf(spark, str(tmp_path / "crew.ttl"), root=str(tmp_path), source_options=options)
    base = "http://example.com/base/"
    expected = [f'<{base}sailor/{i}> <{V}name> "{n}" .' for i, n in ((1, "Ann"), (2, "Bo"), (3, "Cy"))]
    expected += [f"<{base}sailor/{i}> <{V}ship> <{base}ship/{n}> ." for i, n in ((1, "Adder"), (2, "Beagle"))]
    assert lines(frame) == sorted(expected)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ship#") and plan.count("LeftOuter") == 1 and "Union" not in plan


def test_options_of_an_xml_source_and_of_an_unknown_one(spark, place):
    seeds = str(place / "maps")
    frame = map_to_rdf(spark, seeds, root=str(place / "data"), source_options={"seeds.xml": {"unique_tag": True}})
    assert len(lines(frame)) == 3  # the promise is trusted: the tag is taken wherever it stands
    with pytest.raises(MappingError, match="no source named"):
        map_to_rdf(spark, seeds, root=str(place / "data"), source_options={"other.csv": {"sep": ";"}})
