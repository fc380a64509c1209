"""RDF scans and sinks, formats, blank nodes."""

import json
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from quadweave.errors import FormatError, SourceError
from quadweave.operators import bnodes, grouping
from quadweave.operators.schema import STATEMENT_SCHEMA
from quadweave.plans.output import is_streamable, output_format, supports_graphs
from quadweave.sinks.text import render_rdf, write_per_graph, write_rdf
from quadweave.sources import rdf_documents
from quadweave.sources.files import list_files, output_location
from quadweave.sources.rdf import format_by_extension, read_rdf

TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"
V = "http://example.org/"
#: Eight statements, two of whose nodes have no name: an instrument with a sensor and a place.
DOCUMENT = """PREFIX s: <http://stations.test/terms#>
<http://stations.test/{n}> a s:Station ; s:code "st-{n}" ;
  s:sensor [ a s:Thermometer ; s:unit "K" ] ; s:place [ s:height 4.5 ; s:name "dune"@en ] .
"""


@pytest.fixture
def tree(tmp_path):
    """Two Turtle documents and one N3 document, and beside them a file of an unknown format."""
    places = ["coast/north/a.ttl", "coast/north/b.ttl", "coast/south/c.n3", "mixed/old/a.ttl", "mixed/new/a.sheet"]
    for n, path in enumerate(places):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(DOCUMENT.replace("{n}", str(n)))
    return tmp_path


@pytest.mark.parametrize(
    "path, fmt, size",
    [
        ("coast/north/a.ttl", "ttl", 8),
        ("coast/north/a.ttl", None, 8),
        ("coast/north", "ttl", 16),
        ("coast", None, 24),
    ],
)
def test_load_sizes(spark, tree, path, fmt, size):
    assert read_rdf(spark, str(tree / path), fmt).count() == size


def test_unknown_extension(spark, tree):
    path = str(tree / "mixed/new/a.sheet")
    with pytest.raises(FormatError, match="Could not determine mapping format by file extension for path '.*sheet'"):
        read_rdf(spark, path)


@pytest.mark.parametrize("path", ["coast/north", "mixed"])
@pytest.mark.parametrize("fmt", ["nq", "nt", "trix", "rj", "rdf", "jsonld"])
def test_wrong_format(spark, tree, path, fmt):
    with pytest.raises(Exception, match="Exception occurred while parsing"):
        read_rdf(spark, str(tree / path), fmt).collect()


def test_unknown_format_name(spark, tree):
    with pytest.raises(FormatError, match="Could not determine RDFFormat for `sheet`"):
        read_rdf(spark, str(tree / "coast"), "sheet")


def test_path_resolution(spark, tree):
    assert [p.rsplit("/", 1)[1] for p in list_files(spark, str(tree / "coast"))] == [
        "a.ttl",
        "b.ttl",
        "c.n3",
    ]
    assert len(list_files(spark, str(tree / "coast/south/c.n3"))) == 1
    with pytest.raises(SourceError, match="Exception occurred while reading path"):
        list_files(spark, str(tree / "missing"))
    with pytest.raises(SourceError, match="Exception occurred while reading path"):
        read_rdf(spark, str(tree / "missing"), "nq")


def test_format_by_extension():
    assert [format_by_extension(f"/a.b/x.{e}") for e in ("ttl", "owl", "xml", "jsonl")] == ["ttl", "rdf", "trix", "ndjsonld"]
    with pytest.raises(FormatError):
        format_by_extension("/a.ttl/x")


# --- sinks -------------------------------------------------------------------------------------


def generated(spark, name, n):
    return spark.createDataFrame(
        [("bnode", f"{name}{i}", TYPE, "bnode", f"kind{i}{name}", None, None, None) for i in range(n)],
        STATEMENT_SCHEMA,
    ).coalesce(1)


def written(path):
    parts = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    return [open(os.path.join(path, part), encoding="utf-8").read() for part in parts]


@pytest.mark.parametrize("pretty", [True, False])
def test_nquads(spark, tmp_path, pretty):
    report = write_rdf(generated(spark, "tide", 5), str(tmp_path / "x.nq"), "nq", pretty=pretty)
    assert report.written_raw == 5
    assert "".join(written(report.path)).count(TYPE) == 5


def test_pretty_turtle_inlines_blank_nodes(spark, tmp_path):
    report = write_rdf(
        generated(spark, "reef", 4), str(tmp_path / "x"), "ttl", prefixes={"ex": V}, pretty=True, inline_bnodes=True
    )
    text = "".join(written(report.path))
    assert report.written_raw == 4
    assert text.count("[]\n    a [] .") == 4
    assert all(part.startswith(f"@prefix ex: <{V}> .\n") for part in written(report.path) if part)


@pytest.mark.parametrize("fmt", ["nq", "ttl", "trig", "trix", "rdf", "jsonld", "ndjsonld", "rj"])
def test_nothing_to_write(spark, tmp_path, fmt):
    static = spark.createDataFrame([], STATEMENT_SCHEMA)
    for name, frame in (("static", static), ("late", generated(spark, "tide", 3).where(F.rand(1) < -1))):
        report = write_rdf(frame, str(tmp_path / name), fmt, pretty=True)
        assert report.written_raw == 0 and not report.written_distinct


def test_hub_over_inlined_nodes_is_cut(spark, monkeypatch):
    monkeypatch.setattr(grouping, "MAX_GROUP_BYTES", 2000)
    rows = [("iri", V + "hub", V + "has", "bnode", f"n{i}", None, None, None) for i in range(20)]
    rows += [("bnode", f"n{i}", V + "note", "literal", f"{i} " + "w" * 400, None, None, None) for i in range(20)]
    blocks = [r.block for r in bnodes.inlined_blocks(spark.createDataFrame(rows, STATEMENT_SCHEMA)).collect()]
    assert len(blocks) > 2 and "".join(blocks).count("[ <") == 20


def test_large_node_in_place_up_to_the_bound(spark):
    rows = [("iri", V + "x", V + "has", "bnode", "n", None, None, None)]
    rows += [("bnode", "n", V + "p", "literal", str(i), None, None, None) for i in range(1200)]
    frame = spark.createDataFrame(rows, STATEMENT_SCHEMA)
    assert len(bnodes.inlined_blocks(frame).collect()) == 1
    assert len(bnodes.inlined_blocks(frame, max_group=1100).collect()) > 1


def test_streamed_turtle(spark, tmp_path):
    report = write_rdf(generated(spark, "reef", 4), str(tmp_path / "x"), "ttl", prefixes={"ex": V})
    (text,) = written(report.path)
    assert text.count(f"@prefix ex: <{V}> .") == 1 and text.startswith("@prefix")
    for i in range(4):
        assert f"_:reef{i} a _:kind{i}reef ." in text


def test_sequential_labels(spark, tmp_path):
    report = write_rdf(generated(spark, "reef", 4), str(tmp_path / "x"), "ttl", relabel=True)
    text = "".join(written(report.path))
    assert all(f"_:b{4 + i} a _:b{i} ." in text for i in range(4))


@pytest.mark.parametrize(
    "fmt, pretty, streamable",
    [("ttl", True, False), ("ttl", False, True), ("nq", False, True), ("nq", True, True), ("trigs", False, True), ("trix", True, False), ("rj", False, False), ("jsonld", False, False)],
)
def test_output_planning(fmt, pretty, streamable):
    assert is_streamable(fmt, pretty) is streamable


def test_format_names():
    with pytest.raises(FormatError, match="Unsupported RDF Format reference specified: 'sheet'."):
        output_format("sheet")
    assert not supports_graphs("ttl") and supports_graphs("trig")
    assert (output_format("xml"), output_format("owl"), output_format("jsonld11")) == ("trix", "rdf", "jsonld")


def test_counts_and_sets(spark, tmp_path):
    twice = generated(spark, "tide", 5).unionAll(generated(spark, "tide", 5))
    streamed = write_rdf(twice, str(tmp_path / "a"), "nq", pretty=True)
    assert (streamed.written_raw, streamed.written_distinct) == (10, None)
    grouped = write_rdf(twice, str(tmp_path / "b"), "ttl", pretty=True)
    assert (grouped.written_raw, grouped.written_distinct) == (10, 5)
    always = write_rdf(twice, str(tmp_path / "c"), "ndjsonld")
    assert (always.written_raw, always.written_distinct) == (10, 5)


def test_output_path_rules(spark, tmp_path):
    frame = generated(spark, "tide", 3)
    first = write_rdf(frame, str(tmp_path / "deep" / "er" / "out"), "nq")
    assert first.path.endswith("/deep/er/out")
    again = write_rdf(frame.limit(1), first.path, "nq")
    assert again.path == first.path and "".join(written(first.path)).count(TYPE) == 1
    (tmp_path / "plain").mkdir()
    assert output_location(spark, str(tmp_path / "plain")) == str(tmp_path / "plain") + "/output"


def test_every_part_of_a_framed_format_is_a_document(spark, tmp_path):
    import xml.etree.ElementTree as ElementTree

    frame = SAMPLE(spark).repartition(3)
    for fmt, parse in (("trix", ElementTree.fromstring), ("rdf", ElementTree.fromstring), ("jsonld", json.loads)):
        for pretty in (False, True):
            report = write_rdf(frame, str(tmp_path / f"{fmt}{pretty}"), fmt, pretty=pretty)
            for part in written(report.path):
                parse(part)


def SAMPLE(spark):
    graph = V + "g"
    rows = [
        ("iri", V + "a", V + "p", "literal", 'tab\t quote" back\\slash \\n nl\n cr\r ü 中 😀 \'', None, None, None),
        ("iri", V + "a", V + "p", "literal", "", None, None, None),
        ("iri", V + "a", V + "p", "literal", "x <y> & z ]]> </triple>", None, "en-us", None),
        ("iri", V + "a", V + "p", "literal", "1.50", XSD + "decimal", None, None),
        ("iri", V + "a", V + "p", "literal", "true", XSD + "boolean", None, None),
        ("iri", V + "a", V + "q", "iri", V + "b", None, None, None),
        ("iri", V + "a", TYPE, "iri", V + "T", None, None, None),
        ("bnode", "x1", V + "q", "bnode", "x2", None, None, None),
        ("bnode", "x2", V + "q", "iri", V + "a", None, None, None),
    ]
    rows += [(*row[:7], graph) for row in rows[:4]]
    return spark.createDataFrame(rows, STATEMENT_SCHEMA)


@pytest.mark.parametrize("fmt", ["nt", "nq", "ttl", "ttls", "n3", "trig", "trigs", "trix", "rdf", "jsonld", "ndjsonld", "rj"])
@pytest.mark.parametrize("pretty", [False, True])
def test_round_trip(spark, tmp_path, fmt, pretty):
    """What is read back is what was written; blank-node labels are compared by shape."""
    frame = SAMPLE(spark)
    path = str(tmp_path / "out")
    write_rdf(frame, path, fmt, pretty=pretty, prefixes={"ex": V})
    back = read_rdf(spark, path, "rdf" if fmt == "rdf" else fmt)
    if fmt not in ("nq", "trig", "trigs", "trix", "jsonld", "ndjsonld"):
        frame = frame.withColumn("g", F.lit(None).cast("string"))
    expected = frame.distinct()
    plain = (F.col("s_kind") != "bnode") & (F.col("o_kind") != "bnode")
    assert {tuple(r) for r in back.where(plain).collect()} == {tuple(r) for r in expected.where(plain).collect()}
    assert back.where(~plain).groupBy("s_kind", "p", "o_kind").count().collect() == expected.where(~plain).groupBy(
        "s_kind", "p", "o_kind"
    ).count().collect()


def test_per_graph_split(spark, tmp_path):
    path = write_per_graph(SAMPLE(spark), str(tmp_path / "graphs"), "nt")
    counts = {r.g: r["count"] for r in spark.read.text(path).groupBy("g").count().collect()}
    assert counts == {None: 9, V + "g": 4}


# --- N-Triples parsing -------------------------------------------------------------------------

LINES = r"""
# a comment
<http://e/s> <http://e/p> "plain" .
<http://e/s><http://e/p>"tight"@EN-us.
	<http://e/s>	<http://e/p>	"tab separated"	.	# "comment" <x> .
_:b.1 <http://e/p> _:c .
<http://e/s> <http://e/p> "\t\b\n\r\f\"\'\\" .
<http://e/s> <http://e/p> "é \U0001F600 \\u00e9 \\U0001F600 😀" .
<http://e/é> <http://e/p> "x"^^<http://www.w3.org/2001/XMLSchema#string> <http://e/g> .
<http://e/s> <http://e/p> "a . \" <b> ." _:g1 .
<http://e/s> <http://e/p> "3"^^<http://e/dt>.
"""


def test_line_grammar(spark, tmp_path):
    (tmp_path / "x.nq").write_text(LINES)
    rows = read_rdf(spark, str(tmp_path / "x.nq")).collect()
    found = {(r.o, r.o_dt, r.o_lang) for r in rows if r.o_kind == "literal"}
    assert found == {
        ("plain", None, None),
        ("tight", None, "en-us"),
        ("tab separated", None, None),
        ("\t\b\n\r\f\"'\\", None, None),
        ("é 😀 \\u00e9 \\U0001F600 😀", None, None),
        ("x", None, None),
        ('a . " <b> .', None, None),
        ("3", "http://e/dt", None),
    }
    assert {r.s for r in rows if r.g == "http://e/g"} == {"http://e/é"}
    assert sum(r.s_kind == "bnode" and r.o_kind == "bnode" for r in rows) == 1
    assert len([r for r in rows if r.g and not r.g.startswith("http")]) == 1


@pytest.mark.parametrize(
    "line",
    ['<http://e/s> <http://e/p> "x"', '<http://e/s> "p" "o" .', '"s" <http://e/p> "o" .', '<http://e/s> <http://e/p> "x" "y" .', '<s> <p> "open .', "nothing"],
)
def test_malformed_lines(spark, tmp_path, line):
    (tmp_path / "x.nt").write_text('<http://e/s> <http://e/p> "fine" .\n' + line + "\n")
    with pytest.raises(Exception, match="Exception occurred while parsing"):
        read_rdf(spark, str(tmp_path / "x.nt")).collect()


def test_very_long_literals(spark, tmp_path):
    text = 'long "quoted" \\ ' * 200_000
    frame = spark.createDataFrame([("iri", V + "a", V + "p", "literal", text, None, None, None)], STATEMENT_SCHEMA)
    for fmt in ("nq", "ttl", "trix"):
        write_rdf(frame, str(tmp_path / fmt), fmt)
        assert read_rdf(spark, str(tmp_path / fmt), fmt).first().o == text


def test_large_line_files_are_split(spark, tmp_path):
    frame = spark.range(20000).selectExpr(
        "'iri' s_kind", f"concat('{V}', id) s", f"'{V}p' p", "'literal' o_kind", "repeat('x', 50) o",
        "string(null) o_dt", "string(null) o_lang", "string(null) g",
    )
    write_rdf(frame.coalesce(1), str(tmp_path / "x"), "nq")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        back = read_rdf(spark, str(tmp_path / "x"), "nq", distinct=False)
        assert back.rdd.getNumPartitions() > 4 and back.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st_.lists(st_.text(alphabet=st_.characters(exclude_categories=("Cs",), exclude_characters="\x00"), max_size=12), min_size=1, max_size=20))
def test_any_text_survives_nquads(spark, tmp_path_factory, texts):
    path = str(tmp_path_factory.mktemp("any") / "x")
    rows = [("iri", f"{V}{i}", V + "p", "literal", text, None, None, None) for i, text in enumerate(texts)]
    write_rdf(spark.createDataFrame(rows, STATEMENT_SCHEMA), path, "nq")
    assert {r.s: r.o for r in read_rdf(spark, path, "nq").collect()} == {f"{V}{i}": t for i, t in enumerate(texts)}


# --- documents ---------------------------------------------------------------------------------


def parse(fmt, text):
    return [tuple(row) for row in rdf_documents.PARSERS[fmt](text, "file:/d/doc")]


def test_turtle_subset():
    rows = parse(
        "trig",
        """PREFIX ex: <http://ex/> @base <http://b/> .
        ex:a ex:p '''x "y" z'''@en-US , 1.5, 2 , 3e4, true ; ex:q (1 ex:b) , [ ex:r "q\\n"^^ex:dt ] . # c
        [] a ex:B . [ ex:p 1 ] . _:x.y ex:p <rel> , () .
        ex:g { ex:a a ex:C . ex:b a ex:D } GRAPH ex:h { ex:a a ex:C . }""",
    )
    assert len(rows) == 19
    assert rows[0] == ("iri", "http://ex/a", "http://ex/p", "literal", 'x "y" z', None, "en-us", None)
    assert [r[4] for r in rows if r[7]] == ["http://ex/C", "http://ex/D", "http://ex/C"]
    assert ("bnode", "x.y", "http://ex/p", "iri", "http://b/rel", None, None, None) in rows


@pytest.mark.parametrize(
    "text", ["<a> <b> .", "ex:a ex:b ex:c .", "<a> <b> <c>", "<< <a> <b> <c> >> <d> <e> .", '<a> "b" <c> .', "<g> { <a> <b> <c> ."]
)
def test_turtle_errors(text):
    with pytest.raises(ValueError):
        parse("trig", text)


def test_rdf_xml_subset():
    rows = parse(
        "rdf",
        f"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="{V}" xml:base="{V}doc">
        <e:T rdf:about="#a" e:attr="v" xml:lang="EN"><e:p>text</e:p><e:n rdf:datatype="{XSD}integer">5</e:n>
        <e:q rdf:resource="b"/><e:r rdf:parseType="Resource"><e:s>in</e:s></e:r><e:t><e:U rdf:nodeID="n"/></e:t>
        <e:c rdf:parseType="Collection"><e:U rdf:ID="i"/></e:c></e:T></rdf:RDF>""",
    )
    facts = {(r[1], r[2], r[4], r[5], r[6]) for r in rows}
    assert (V + "doc#a", TYPE, V + "T", None, None) in facts
    assert (V + "doc#a", V + "attr", "v", None, "en") in facts
    assert (V + "doc#a", V + "n", "5", XSD + "integer", None) in facts
    assert (V + "doc#a", V + "q", V + "b", None, None) in facts
    assert (V + "doc#i", TYPE, V + "U", None, None) in facts
    assert len(rows) == 13


def test_json_ld_subset():
    rows = parse(
        "jsonld",
        json.dumps(
            {
                "@context": {"@vocab": V, "ex": "http://ex/", "knows": {"@type": "@id"}, "l": {"@container": "@list"}},
                "@id": "http://ex/a",
                "@type": "ex:T",
                "name": ["A", {"@value": "B", "@language": "DE"}, {"@value": "1", "@type": "ex:dt"}],
                "knows": "ex:b",
                "n": 5,
                "d": 2.5,
                "t": True,
                "l": [1, 2],
                "inner": {"name": "C"},
            }
        ),
    )
    facts = {(r[2], r[3], r[4], r[5], r[6]) for r in rows if r[1] == "http://ex/a"}
    assert (TYPE, "iri", "http://ex/T", None, None) in facts
    assert (V + "name", "literal", "B", None, "de") in facts
    assert (V + "knows", "iri", "http://ex/b", None, None) in facts
    assert (V + "d", "literal", "2.5E0", XSD + "double", None) in facts
    assert len(rows) == 15
    with pytest.raises(ValueError, match="remote context"):
        parse("jsonld", '{"@context": "http://ex/c", "@id": "http://ex/a"}')


# --- grouping ----------------------------------------------------------------------------------


def hub(spark):
    """One subject owns a third of all statements; copies included."""
    return spark.range(3000).selectExpr(
        "'iri' s_kind", f"if(id % 3 = 0, '{V}hub', concat('{V}', id)) s", f"concat('{V}p', id % 2) p", "'literal' o_kind",
        "string(id % 2500) o", "string(null) o_dt", "string(null) o_lang", "string(null) g",
    )


def test_hub_subjects_are_cut_but_whole(spark, tmp_path):
    blocks = grouping.turtle_blocks(hub(spark), max_group=100)
    sizes = {r.s: (r.parts, r.n) for r in blocks.groupBy("s").agg(F.count("*").alias("parts"), F.sum("n").alias("n")).collect()}
    assert sizes[V + "hub"][0] == 10 and max(r.n for r in blocks.collect()) < 200
    # One more subject may share the hub's hash class; all others are one block each.
    assert sum(parts > 1 for parts, _ in sizes.values()) <= 2
    assert sum(n for _, n in sizes.values()) == hub(spark).distinct().count()
    write_rdf(hub(spark), str(tmp_path / "x"), "ttl", pretty=True, max_group=100)
    back = read_rdf(spark, str(tmp_path / "x"), "ttl")
    assert back.exceptAll(hub(spark).distinct()).count() == 0 and back.count() == hub(spark).distinct().count()


def test_subjects_with_much_text_are_cut_too(spark, monkeypatch):
    monkeypatch.setattr(grouping, "MAX_GROUP_BYTES", 10_000)
    frame = spark.range(60).selectExpr(
        "'iri' s_kind", f"'{V}s' s", f"'{V}p' p", "'literal' o_kind", "concat(id, repeat('x', 1000)) o",
        "string(null) o_dt", "string(null) o_lang", "string(null) g",
    )
    blocks = grouping.turtle_blocks(frame).collect()
    assert len(blocks) == 7 and sum(r.n for r in blocks) == 60


def test_grouping_without_a_count(spark):
    blocks = grouping.turtle_blocks(hub(spark), max_group=None)
    assert blocks._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert blocks.count() == 2001


def test_grouping_shuffles_statements_once(spark):
    plan = grouping.turtle_blocks(hub(spark))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # Statements move once; the other two carry subject counts and hash classes.
    assert len(exchanges) == 3 and sum("part" in line.partition("(")[2].partition(")")[0] for line in exchanges) == 1


def test_inlining_keeps_shared_and_deep_nodes_labelled(spark):
    def row(s, p, o, kind="bnode", s_kind="bnode"):
        return (s_kind, s, V + p, kind, o, None, None, None)

    rows = [
        row(V + "a", "p", "shared", s_kind="iri"),
        row(V + "b", "p", "shared", s_kind="iri"),
        row("shared", "v", "1", "literal"),
        row(V + "a", "p", "outer", s_kind="iri"),
        row("outer", "q", "inner"),
        row("inner", "v", "2", "literal"),
        row("loop", "p", "loop"),
    ]
    blocks = {r.s: r.block for r in bnodes.inlined_blocks(spark.createDataFrame(rows, STATEMENT_SCHEMA)).collect()}
    assert set(blocks) == {V + "a", V + "b", "shared", "outer", "loop"}
    assert f'<{V}q> [ <{V}v> "2" ]' in blocks["outer"] and blocks["outer"].startswith("_:outer")
    assert "_:shared" in blocks[V + "a"] and "_:outer" in blocks[V + "a"]
    assert blocks["loop"] == f"_:loop\n    <{V}p> _:loop ."


def test_relabel_numbers_are_dense(spark):
    frame = spark.range(500).selectExpr(
        "'bnode' s_kind", "md5(string(id % 90)) s", f"'{V}p' p", "if(id % 2 = 0, 'bnode', 'literal') o_kind",
        "if(id % 2 = 0, md5(string(id % 70)), string(id)) o", "string(null) o_dt", "string(null) o_lang", "string(null) g",
    )
    labels = bnodes.sequential_labels(frame).orderBy("label").collect()
    assert [r.number for r in labels] == list(range(90))
    again = bnodes.relabel(frame)
    assert again.count() == 500 and again.where("s NOT RLIKE '^b[0-9]+$'").count() == 0
    assert again.where("o_kind = 'literal'").select("o").distinct().count() == 250


def test_render_without_a_path_gives_a_frame(spark):
    assert render_rdf(generated(spark, "x", 2), "nt").columns == ["value"]


# --- large Turtle files ------------------------------------------------------------------------

TURTLE = {
    "plain": '@prefix ex: <http://ex/> .\n@prefix e2: <http://e2/> .\n'
    + "".join(
        f'ex:s{i} a ex:T ;\n  e2:p "x. y\\n {i}", {i}.5, [ ex:q ex:o{i} ], (1 2) .\n[] ex:same "a" .\n_:b ex:p {i}.\n'
        for i in range(300)
    ),
    "long": '@prefix ex: <http://ex/> .\n' + "".join(f'ex:s{i} ex:p """line .\nnext .\n""" .\n' for i in range(300)),
    "comment": '@prefix ex: <http://ex/> .\n' + "".join(f"# note {i}.\nex:s{i} ex:p ex:o .\n" for i in range(300)),
    "based": '@prefix ex: <http://ex/> .\n@base <http://b/> .\n' + "".join(f"<s{i}> ex:p <o> .\n" for i in range(300)),
    "redefined": "".join(f"@prefix ex: <http://ex{i}/> .\nex:s ex:p ex:o .\n" for i in range(300)),
    "sparql": "PREFIX ex: <http://ex/>\n" + "".join(f"ex:s{i} ex:p ex:o .\n" for i in range(300)) + "ex:a ex:b ex:c.",
}


def test_large_turtle_files_are_cut_where_that_is_safe(spark, tmp_path):
    from quadweave.sources import turtle_split
    from quadweave.sources.lexed import read_records, turtle_lexer
    from quadweave.sources.rdf import scan_turtle, scope_bnodes

    for name, text in TURTLE.items():
        (tmp_path / f"{name}.ttl").write_text(text)
    (tmp_path / "small.ttl").write_text("<http://ex/a> <http://ex/b> <http://ex/c> .")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        records = read_records(spark, [str(tmp_path)], turtle_lexer(), 1000)
        files = turtle_split.describe(records, 1000)
        whole_ones = {r.file.rsplit("/", 1)[1] for r in files.where("NOT splits").collect()}
        assert whole_ones == {"based.ttl", "redefined.ttl"} and files.count() == len(TURTLE) + 1
        cut = scope_bnodes(scan_turtle(spark, [str(tmp_path)], cut=True))
        whole = scope_bnodes(scan_turtle(spark, [str(tmp_path)], cut=False))
        named = (F.col("s_kind") == "iri") & (F.col("o_kind") != "bnode")
        assert cut.count() == whole.count() > 300 * 6
        assert cut.where(named).exceptAll(whole.where(named)).count() == 0
        for kind, name in (("s_kind", "s"), ("o_kind", "o")):
            nodes = [f.where(F.col(kind) == "bnode").select(name).distinct().count() for f in (cut, whole)]
            assert nodes[0] == nodes[1]
        assert sorted(
            r.n for r in cut.where("s_kind = 'bnode'").groupBy("s").agg(F.count("*").alias("n")).collect()
        ) == sorted(r.n for r in whole.where("s_kind = 'bnode'").groupBy("s").agg(F.count("*").alias("n")).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ndjsonld_nodes_without_id_and_natural_values(spark, tmp_path):
    (tmp_path / "x.ndjsonld").write_text(
        f'{{"@type": ["{V}T"], "{V}n": [{{"@value": 5}}, {{"@value": true}}, {{"@value": 1.5}}]}}\n'
        f'{{"@type": ["{V}T"], "{V}n": [{{"@value": 5}}]}}\n\n'
        f'{{"@id": "{V}g", "@graph": [{{"{V}n": [{{"@value": "x", "@language": "DE"}}]}}, {{"{V}n": [{{"@id": "_:b"}}]}}]}}\n'
    )
    rows = read_rdf(spark, str(tmp_path)).collect()
    assert len(rows) == 8 and len({r.s for r in rows}) == 4
    assert {(r.o, (r.o_dt or "").rpartition("#")[2], r.o_lang) for r in rows if r.o_kind == "literal"} == {
        ("5", "integer", None),
        ("true", "boolean", None),
        ("1.5", "double", None),
        ("x", "", "de"),
    }
    assert {r.g for r in rows} == {None, V + "g"}


def test_large_trix_files(spark, tmp_path):
    from quadweave.sources.rdf import scan_trix

    def triples(n, word):
        return "".join(
            f"<triple><uri>{V}{word}{i}</uri><uri>{V}p</uri><plainLiteral>{word} &lt;{i}&gt;</plainLiteral></triple>\n"
            for i in range(n)
        )

    head, end = '<?xml version="1.0"?>\n<TriX xmlns="http://www.w3.org/2004/03/trix/trix-1/">\n', "</TriX>\n"
    bodies = {
        "one": f"<graph><uri>{V}g</uri>\n{triples(200, 'a')}</graph>",
        "default": f"<graph>\n{triples(200, 'b')}</graph>",
        "several": f"<graph>{triples(100, 'c')}</graph><graph><uri>{V}g2</uri>{triples(100, 'd')}</graph>",
        "again": f"<graph><id>n</id>{triples(50, 'e')}</graph><graph><id>n</id>{triples(50, 'f')}</graph>",
    }
    for name, body in bodies.items():
        (tmp_path / f"{name}.trix").write_text(head + body + end)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        cut = scan_trix(spark, [str(tmp_path)], cut=True)
        whole = scan_trix(spark, [str(tmp_path)])
        assert cut.count() == 700 and cut.exceptAll(whole).count() == 0
        counts = {r.g: r["count"] for r in cut.groupBy("g").count().collect()}
        assert counts == {V + "g": 200, None: 300, V + "g2": 100, "_:n": 100}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def shape(rows):
    """Statements with blank nodes as equal placeholders."""
    return sorted(str(["_" if kind == "bnode" else v for kind, v in ((r.s_kind, r.s), (None, r.p), (r.o_kind, r.o), (None, r.o_dt), (None, r.g))]) for r in rows)


def test_cut_turtle_reads_as_the_whole_document(spark, tmp_path, monkeypatch):
    from quadweave.sources import turtle_split
    from quadweave.sources.rdf import read_rdf

    documents = {
        "base": "@prefix v: <http://v/> . @base <http://b/> .\n<x> v:p v:o .\n",
        "comment": "@prefix v: <http://v/> .\nv:a v:p v:b ;# see there.\n  v:q v:c ;\n  v:r v:d .\n",
        "glued": "@prefix v: <http://v/> .\nv:a v:p v:b# see there.\n .\n",
        "late": "@prefix v: <http://v/> . PREFIX w: <http://w/>\nw:a v:p w:b .\nv:a v:p v:b .\n",
        "long": '@prefix v: <http://v/> .\nv:a v:p """one .\n# v:x v:y v:z .\n@prefix v: <http://v/> .""", \'\'\'\\\'\'\'.\'\'\' .\nv:b v:p v:c .\n',
        "block": "@prefix v: <http://v/> .\nv:g {\n v:a v:p v:b .\n v:c v:p 1.5 .\n}\n{ v:a v:p _:x .\n _:x v:p v:c }\nv:a v:q _:x .\n",
        "nested": "@prefix v: <http://v/> .\nv:a v:p [ v:q ( 1\n 2. ) ;\n v:r v:b ] .\n".replace("2.", "2"),
    }
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    monkeypatch.setattr(turtle_split.scan_turtle_pieces, "__kwdefaults__", {"graphs": True, "chunk": 1, "most_prefixes": 1000})
    for name, text in documents.items():
        (tmp_path / f"{name}.ttl").write_text(text)
    for name in documents:
        cut, whole = (read_rdf(spark, str(tmp_path / f"{name}.ttl"), "trig", cut=c).collect() for c in (None, False))
        assert shape(cut) == shape(whole) and len(whole) > 0
        assert len({r.s for r in cut if r.s_kind == "bnode"}) == len({r.s for r in whole if r.s_kind == "bnode"})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(
    "line",
    [
        '{"@id":"http://v/a","http://v/p":"text"}',
        '{"@id":"http://v/a","http://v/p":{"@value":"text"}}',
        '{"@id":"http://v/a","http://v/p":[{"@list":[{"@value":"x"}]}]}',
        '{"@id":"http://v/a","http://v/p":[{"@id":"http://v/b","http://v/q":[{"@value":"x"}]}]}',
        '{"@context":{"v":"http://v/"},"@id":"v:a","http://v/p":[{"@value":"x"}]}',
        '{"@id":"http://v/g","@graph":[],"http://v/p":[{"@value":"x"}]}',
    ],
)
def test_lines_that_are_not_expanded_json_ld_are_errors(spark, tmp_path, line):
    from quadweave.sources.rdf import read_rdf

    (tmp_path / "a.ndjsonld").write_text('{"@id":"http://v/a","http://v/p":[{"@value":"fine"}]}\n' + line + "\n")
    with pytest.raises(Exception, match="no expanded JSON-LD"):
        read_rdf(spark, str(tmp_path)).collect()


def test_trix_numeric_references_are_decoded(spark, tmp_path):
    from quadweave.sources.rdf import read_rdf

    triple = "<triple><uri>http://v/a</uri><uri>http://v/p</uri><plainLiteral>caf&#233; &#x41; &amp;amp; \u00fc</plainLiteral></triple>"
    (tmp_path / "a.trix").write_text(f'<TriX xmlns="http://www.w3.org/2004/03/trix/trix-1/"><graph>{triple}</graph></TriX>')
    assert [r.o for r in read_rdf(spark, str(tmp_path)).collect()] == ["caf\u00e9 A &amp; \u00fc"]


TRIX_TRIPLE = "<triple><uri>http://v/a</uri><uri>http://v/p</uri><plainLiteral>{}</plainLiteral></triple>"


@pytest.mark.parametrize("cut", [None, True])
def test_trix_comments_are_no_statements(spark, tmp_path, cut):
    hidden = f"<!-- {TRIX_TRIPLE.format('no').replace('</triple>', '')} -->"
    body = f"<graph>{hidden}{TRIX_TRIPLE.format('x --> y')}<!-- a\n b -->{TRIX_TRIPLE.format('z')}</graph><!-- end -->"
    (tmp_path / "a.trix").write_text(f'<?xml version="1.0"?><!-- top -->\n<TriX xmlns="http://www.w3.org/2004/03/trix/trix-1/">{body}</TriX>')
    assert sorted(r.o for r in read_rdf(spark, str(tmp_path), cut=cut).collect()) == ["x --> y", "z"]


@pytest.mark.parametrize("part", ["<![CDATA[<b>]]>", "<!-- </graph> -->"])
def test_trix_text_that_hides_tags_is_an_error(spark, tmp_path, part):
    body = f"<graph>{TRIX_TRIPLE.format(part)}</graph>"
    (tmp_path / "a.trix").write_text(f'<TriX xmlns="http://www.w3.org/2004/03/trix/trix-1/">{body}</TriX>')
    with pytest.raises(Exception, match="CDATA section, or an end tag in a comment"):
        read_rdf(spark, str(tmp_path)).collect()
