"""Prefix mappings, shared folders, and streams."""

import logging

import pytest
from pyspark.sql import functions as F

from quadweave import Mapping, parent, table, template, triples_map
from quadweave.errors import FormatError, PrefixError
from quadweave.operators import prefixes, statements
from quadweave.sources.files import scratch_folder
from quadweave.sources.rdf import read_rdf
from quadweave.streaming.jobs import start_dataset_sink, start_line_sink, start_statement_sink, stream_lines, written_so_far

V = "http://example.org/"
BASE = "http://example.com/base/"


@pytest.fixture
def files(tmp_path):
    for name, text in {
        "m/1-sea.json": '{"tide": "https://sea.test/tide/", "reef": "https://sea.test/old#"}',
        "m/2-land.yml": "---\nreef:   https://sea.test/reef#   # moved\n\"dune\": 'https://land.test/#d/'  # quoted\n#end\n",
        "plain": "tide: https://sea.test/",
        "cut.json": '{"tide": "https://sea.test/tide/", "reef"',
        "nested.yaml": "tide:\n  north: https://sea.test/n/\n",
        "flow.yaml": "tide: {north: https://sea.test/n/}\n",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_no_declarations(spark, files):
    assert prefixes.namespaces(spark, [], [str(files / "m")]) == {}
    assert prefixes.namespaces(spark, "") == {}


def test_default_prefixes(spark):
    assert prefixes.namespaces(spark, "foaf,skos") == {
        "foaf": "http://xmlns.com/foaf/0.1/",
        "skos": "http://www.w3.org/2004/02/skos/core#",
    }


def test_unknown_references_are_reported_and_dropped(spark, caplog):
    with caplog.at_level(logging.WARNING):
        found = prefixes.namespaces(spark, ["q=urn:quay?x=1&y=2", "lagoon", "rdf"])
    assert sorted(found) == ["q", "rdf"] and found["q"] == "urn:quay?x=1&y=2"
    assert "Prefix reference `lagoon` could not be resolved." in caplog.text


def test_mapping_files(spark, files):
    sea, land = str(files / "m/1-sea.json"), str(files / "m/2-land.yml")
    assert prefixes.namespaces(spark, "tide,reef", [sea]) == {"tide": "https://sea.test/tide/", "reef": "https://sea.test/old#"}
    assert prefixes.namespaces(spark, "dune,reef", [land]) == {"dune": "https://land.test/#d/", "reef": "https://sea.test/reef#"}
    # All files of a directory in name order: the YAML file overrides the JSON file; the defaults are gone.
    assert prefixes.namespaces(spark, "tide,reef,dune,foaf", [str(files / "m")]) == {
        "tide": "https://sea.test/tide/",
        "reef": "https://sea.test/reef#",
        "dune": "https://land.test/#d/",
    }


def test_mapping_file_errors(spark, files):
    with pytest.raises(PrefixError, match="Could not determine prefix mapping file format for"):
        prefixes.namespaces(spark, "tide", [str(files / "plain")])
    for name in ("cut.json", "nested.yaml", "flow.yaml"):
        with pytest.raises(PrefixError, match="Could not parse prefix mapping file"):
            prefixes.namespaces(spark, "tide", [str(files / name)])
    # Files are only looked at when a declaration refers to them.
    assert prefixes.namespaces(spark, "a=http://a/", [str(files / "cut.json")]) == {"a": "http://a/"}


def test_repeated_declaration(spark):
    with pytest.raises(PrefixError, match="more than once: ex"):
        prefixes.namespaces(spark, "ex=http://a/,ex=http://b/")


def test_compaction(spark):
    frame = spark.createDataFrame(
        [("http://a/x",), ("http://a/b/x.y",), ("http://a/b/x/y",), ("http://a/b/x.",), ("http://c/x",), ("http://a/",)], "i string"
    )
    short = prefixes.compact_iri(F.col("i"), {"a": "http://a/", "ab": "http://a/b/"})
    assert [r.s for r in frame.select(short.alias("s")).collect()] == [
        "a:x",
        "ab:x.y",
        "<http://a/b/x/y>",
        "<http://a/b/x.>",
        "<http://c/x>",
        "a:",
    ]
    known = spark.createDataFrame([("a", "http://a/"), ("ab", "http://a/b/"), ("zz", "http://a/")], "prefix string, iri string")
    assert sorted(r.i for r in prefixes.compact_column(frame, "i", known).collect()) == sorted(
        ["a:x", "ab:x.y", "<http://a/b/x/y>", "<http://a/b/x.>", "<http://c/x>", "a:"]
    )


def test_scratch_folder_follows_the_session(spark):
    assert scratch_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


# --- streams -----------------------------------------------------------------------------------


@pytest.fixture
def arriving(spark, tmp_path):
    """A folder that has files now, and a function that adds more."""
    folder = str(tmp_path / "in")

    def add(start, end):
        spark.range(start, end).select("id", (F.col("id") % 5).alias("kind")).coalesce(1).write.mode("append").parquet(folder)

    add(0, 100)
    return folder, add


def item_map():
    item = triples_map("t", table("t"), template("t/{id}"), classes=V + "T")
    return item.add(V + "kind", parent("k", ("kind", "kind")))


def test_stream_equals_batch_and_resumes(spark, tmp_path, arriving):
    folder, add = arriving
    kinds = spark.createDataFrame([(i, f"k{i}") for i in range(4)], "kind long, name string")
    mapping = Mapping.of(item_map(), triples_map("k", table("k"), template("k/{name}")))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def drain():
        stream = spark.readStream.schema("id long, kind long").parquet(folder)
        start_statement_sink(mapping.run(spark, {"t": stream, "k": kinds}), out, checkpoint).awaitTermination()
        return spark.read.parquet(out), mapping.run(spark, {"t": spark.read.parquet(folder), "k": kinds})

    for end in (None, 150):
        if end:
            add(100, end)
        streamed, batch = drain()
        assert streamed.count() == batch.count()
        assert streamed.exceptAll(batch).count() == 0


def test_stream_limit_and_lines(spark, tmp_path, arriving):
    folder, _ = arriving
    stream = spark.readStream.schema("id long, kind long").parquet(folder)
    mapping = Mapping.of(triples_map("t", table("t"), template("t/{id}"), classes=V + "T"))
    limited = mapping.run(spark, {"t": stream}, limit=7)
    start_line_sink(limited, str(tmp_path / "out"), str(tmp_path / "cp"), "ttl").awaitTermination()
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 7 and all(line.endswith(f"> a <{V}T> .") for line in lines)


def test_dataset_sink_with_prefixes_and_counts(spark, tmp_path, arriving):
    folder, add = arriving
    mapping = Mapping.of(triples_map("t", table("t"), template("t/{id}"), classes=V + "T"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def drain():
        stream = spark.readStream.schema("id long, kind long").parquet(folder)
        statements = mapping.run(spark, {"t": stream})
        start_dataset_sink(statements, out, checkpoint, "ttl", prefixes={"v": V}, pretty=True).awaitTermination()
        return written_so_far(spark, out), mapping.run(spark, {"t": spark.read.parquet(folder)}).distinct()

    for end in (None, 150):
        if end:
            add(100, end)
        report, batch = drain()
        assert (report.written_raw, report.written_distinct) == (batch.count(), batch.count())
        parts = sorted((tmp_path / "out").glob("batch=*/part-*"))
        assert parts and all(f"@prefix v: <{V}> ." in part.read_text() and "a v:T" in part.read_text() for part in parts if part.stat().st_size)
        read = read_rdf(spark, [str(p) for p in parts if p.stat().st_size], "ttl", cut=False)
        assert read.exceptAll(batch.select(read.columns)).count() == 0 and read.count() == batch.count()


def test_formats_that_cannot_stream(spark, arriving):
    stream = spark.readStream.schema("id long, kind long").parquet(arriving[0])
    mapping = Mapping.of(triples_map("t", table("t"), template("t/{id}"), classes=V + "T"))
    for fmt in ("jsonld", "rdf", "trix", "rj"):
        with pytest.raises(FormatError):
            stream_lines(mapping.run(spark, {"t": stream}), fmt)


def test_distinct_within_a_watermark(spark, tmp_path, arriving):
    folder, _ = arriving
    stream = spark.readStream.schema("id long, kind long").parquet(folder)
    stream = stream.withColumn("kind", F.col("kind").cast("string"))
    mapping = Mapping.of(triples_map("t", table("t"), template("k/{kind}"), classes=V + "T"))
    timed = mapping.run(spark, {"t": stream}).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    unique = statements.distinct_within(timed, "at", "1 hour").drop("at")
    query = start_statement_sink(unique, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_longest_namespace_by_table(spark):
    """Namespaces that end in a colon, a letter or a slash, and that hold one another: the table finds what the expression finds."""
    from quadweave.operators.prefixes import compact_column, compact_iri

    known = {"u": "urn:x:", "w": "http://w/", "deep": "http://w/a/", "let": "http://w/a/b", "hash": "http://w/a#", "all": ""}
    iris = [
        "urn:x:abc", "urn:x:", "urn:x:a:b", "urn:y:abc", "http://w/", "http://w/k", "http://w/a/k", "http://w/a/b", "http://w/a/bc",
        "http://w/a/b/c", "http://w/a#k", "http://w/a#k/l", "http://w", "plain", "http://w/a/b c", "",
    ]
    frame = spark.createDataFrame([(iri, n) for iri in [*iris, None] for n in range(2)], "iri string, n int")
    table = spark.createDataFrame(list(known.items()), "prefix string, iri string")
    by_table = compact_column(frame, "iri", table)
    by_expression = frame.withColumn("iri", compact_iri(F.col("iri"), known))
    assert by_table.columns == ["iri", "n"]
    assert sorted(map(str, by_table.collect())) == sorted(map(str, by_expression.collect()))
    assert {r.iri for r in by_table.collect()} >= {"u:abc", "<urn:x:a:b>", "w:k", "deep:k", "let:", "let:c", "hash:k", "all:plain"}
    empty = spark.createDataFrame([], "prefix string, iri string")
    assert compact_column(frame, "iri", empty).where("iri = '<urn:x:abc>'").count() == 2
