"""RDF formats: what sinks write, and what scans read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.maps import CUSTOMER_FULL, CUSTOMER_FULL_SQL, DOCUMENTS, ORDERS, SUPPLIER, customer_graphs, run
from catalogue.registry import BASE, TYPE, V, iri, query, st, union, v
from catalogue.statements import CUSTOMER_GRAPHS_SQL, supplier_contacts
from quadweave import ref, template, triples_map
from quadweave.operators import grouping, rendering
from quadweave.sinks.text import json_ld_nodes, rdf_xml_blocks, render_rdf, write_rdf
from quadweave.sources.files import scratch_folder
from quadweave.sources.rdf import read_rdf

PREFIXES = {"c": BASE + "customer/", "ex": V}
ESCAPED = "text"
for plain, escaped in (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'")):
    ESCAPED = f"replace({ESCAPED}, {plain}, {escaped})"


def document_texts(spark, folder):
    """Whole document texts as language-tagged literals, in a graph per language."""
    item = triples_map("d", DOCUMENTS, template("doc/{doc_id}"), graphs=template("lang/{lang}"))
    return run(spark, folder, item.add(V + "text", ref("text", language=ref("lang"))))


DOCUMENT_TEXTS_SQL = st(
    iri("doc/{}", "doc_id"), v("text"), "text", "documents", lang="lower(lang)", g=iri("lang/{}", "lang")
)

# --- row formats -------------------------------------------------------------------------------


@query(f"""SELECT '<{BASE}doc/' || doc_id || '> <{V}text> "' || {ESCAPED} || '"@' || lang || ' .' AS value FROM documents""")
def nt_lines(spark, folder):
    return render_rdf(document_texts(spark, folder), "nt")


@query(
    f"""SELECT '<{BASE}doc/' || doc_id || '> <{V}text> "' || {ESCAPED} || '"@' || lang || ' <{BASE}lang/' || lang || '> .'
    AS value FROM documents"""
)
def nquads_lines(spark, folder):
    return render_rdf(document_texts(spark, folder), "nq")


def customer_lines_sql(line: str) -> str:
    """SQL of one line per statement of the full customer mapping; ``line`` uses x (predicate and object)."""
    return f"""SELECT {line} AS value FROM (
      SELECT c_custkey, unnest(['a ex:Customer', 'ex:name "' || c_name || '"', 'ex:segment "' || c_mktsegment || '"',
        'ex:nation <{BASE}nation/' || c_nationkey || '>']) AS x FROM customer)"""


@query(customer_lines_sql("'c:' || c_custkey || ' ' || x || ' .'"))
def turtle_lines(spark, folder):
    return run(spark, folder, CUSTOMER_FULL).select(rendering.turtle_line(PREFIXES).alias("value"))


@query(
    f"""SELECT '<{BASE}graph/' || c_nationkey || '> {{ c:' || c_custkey || ' ' || x || ' . }}' AS value FROM (
      SELECT c_custkey, c_nationkey, unnest(['ex:name "' || c_name || '"', 'ex:segment "' || c_mktsegment || '"']) AS x
      FROM customer)
    UNION ALL SELECT 'c:' || c_custkey || ' ex:segment "' || c_mktsegment || '" .' FROM customer"""
)
def trig_lines(spark, folder):
    return customer_graphs(spark, folder).select(rendering.trig_line(PREFIXES).alias("value"))


# --- grouped formats ---------------------------------------------------------------------------


def block_sql(subject: str, first: str, rest: list[str]) -> str:
    parts = [f"{subject} || chr(10) || '    {first}"] + rest
    return " ;' || chr(10) || '    ".join(parts) + " .'"


@query(
    "SELECT s, block FROM (SELECT "
    + iri("customer/{}", "c_custkey")
    + " AS s, "
    + block_sql(
        f"'<{BASE}customer/' || c_custkey || '>'",
        f"<{V}name> \"' || c_name || '\"",
        [
            f"<{V}nation> <{BASE}nation/' || c_nationkey || '>",
            f"<{V}segment> \"' || c_mktsegment || '\"",
            f"a <{V}Customer>",
        ],
    )
    + " AS block FROM customer)"
)
def subject_blocks(spark, folder):
    return grouping.turtle_blocks(run(spark, folder, CUSTOMER_FULL)).select("s", "block")


@query(
    "SELECT "
    + block_sql(
        "'c:' || c_custkey",
        "a ex:Customer",
        [
            "ex:name \"' || c_name || '\"",
            f"ex:nation <{BASE}nation/' || c_nationkey || '>",
            "ex:segment \"' || c_mktsegment || '\"",
        ],
    )
    + " AS value FROM customer"
)
def turtle_blocks(spark, folder):
    blocks = grouping.turtle_blocks(run(spark, folder, CUSTOMER_FULL), PREFIXES)
    return blocks.select(F.col("block").alias("value"))


@query(
    "SELECT '<"
    + BASE
    + "graph/' || c_nationkey || '> {' || chr(10) || "
    + block_sql("'c:' || c_custkey", "ex:name \"' || c_name || '\"", ["ex:segment \"' || c_mktsegment || '\""])
    + " || chr(10) || '}' AS value FROM customer UNION ALL SELECT "
    + block_sql("'c:' || c_custkey", "ex:segment \"' || c_mktsegment || '\"", [])
    + " FROM customer"
)
def trig_blocks(spark, folder):
    blocks = grouping.trig_blocks(customer_graphs(spark, folder), PREFIXES)
    return blocks.select(F.col("block").alias("value"))


@query(
    f"""SELECT {iri("customer/{}", "c_custkey")} AS s, '<rdf:Description rdf:about="{BASE}customer/' || c_custkey || '">'
    || '<p:Nation xmlns:p="{V}" rdf:resource="{BASE}nation/' || c_nationkey || '"></p:Nation>'
    || '<p:name xmlns:p="{V}">' || c_name || '</p:name>'
    || '</rdf:Description>' AS block FROM customer"""
)
def rdfxml_blocks(spark, folder):
    item = triples_map("c", CUSTOMER_FULL.source, template("customer/{c_custkey}"))
    item = item.add(V + "name", ref("c_name")).add(V + "Nation", template("nation/{c_nationkey}"))
    return rdf_xml_blocks(run(spark, folder, item)).select("s", "block")


@query(
    f"""SELECT {iri("customer/{}", "c_custkey")} AS s, '{{"@id":"{BASE}customer/' || c_custkey || '","@type":["{V}Customer"],'
    || '"{V}name":[{{"@value":"' || c_name || '"}}],'
    || '"{V}nation":[{{"@id":"{BASE}nation/' || c_nationkey || '"}}],'
    || '"{V}segment":[{{"@value":"' || c_mktsegment || '"}}]}}' AS block FROM customer"""
)
def jsonld_nodes(spark, folder):
    # The pieces between the brackets are separated by a blank, which JSON does not care about.
    nodes = json_ld_nodes(run(spark, folder, CUSTOMER_FULL))
    return nodes.select("s", F.replace("block", F.lit(":[ "), F.lit(":[")).alias("block"))


# --- round trips -------------------------------------------------------------------------------


def round_trip(spark, frame, fmt, **options):
    """Write, read back, and give what was read."""
    path = scratch_folder(spark, fmt)
    write_rdf(frame, path, fmt, **options)
    return read_rdf(spark, path, fmt)


@query(DOCUMENT_TEXTS_SQL.replace(iri("lang/{}", "lang") + " AS g", "CAST(NULL AS VARCHAR) AS g"))
def nt_roundtrip(spark, folder):
    return round_trip(spark, document_texts(spark, folder), "nt")


@query(DOCUMENT_TEXTS_SQL)
def nq_roundtrip(spark, folder):
    return round_trip(spark, document_texts(spark, folder), "nq")


@query(DOCUMENT_TEXTS_SQL.replace(iri("lang/{}", "lang") + " AS g", "CAST(NULL AS VARCHAR) AS g"))
def rj_roundtrip(spark, folder):
    return round_trip(spark, document_texts(spark, folder), "rj")


@query(union(DOCUMENT_TEXTS_SQL, CUSTOMER_GRAPHS_SQL))
def ndjsonld_roundtrip(spark, folder):
    both = document_texts(spark, folder).unionByName(customer_graphs(spark, folder))
    return round_trip(spark, both, "ndjsonld")


@query(union(DOCUMENT_TEXTS_SQL, CUSTOMER_GRAPHS_SQL))
def trix_roundtrip(spark, folder):
    both = document_texts(spark, folder).unionByName(customer_graphs(spark, folder))
    return round_trip(spark, both, "trix")


@query(CUSTOMER_FULL_SQL)
def turtle_load(spark, folder):
    """Pretty Turtle documents, one per task, parsed in parallel."""
    return round_trip(spark, run(spark, folder, CUSTOMER_FULL), "ttl", prefixes=PREFIXES, pretty=True)


@query(union(DOCUMENT_TEXTS_SQL, CUSTOMER_GRAPHS_SQL))
def trig_load(spark, folder):
    both = document_texts(spark, folder).unionByName(customer_graphs(spark, folder))
    return round_trip(spark, both, "trig", prefixes=PREFIXES)


@query(
    union(
        CUSTOMER_FULL_SQL,
        DOCUMENT_TEXTS_SQL.replace(iri("lang/{}", "lang") + " AS g", "CAST(NULL AS VARCHAR) AS g"),
    )
)
def rdfxml_load(spark, folder):
    both = document_texts(spark, folder).unionByName(run(spark, folder, CUSTOMER_FULL))
    return round_trip(spark, both, "rdf")


@query(union(DOCUMENT_TEXTS_SQL, CUSTOMER_GRAPHS_SQL))
def jsonld_load(spark, folder):
    both = document_texts(spark, folder).unionByName(customer_graphs(spark, folder))
    return round_trip(spark, both, "jsonld")


@query(union(CUSTOMER_FULL_SQL, st(iri("order/{}", "o_orderkey"), f"'{TYPE}'", v("Order"), "orders", o_kind="iri")))
def rdf_load_union(spark, folder):
    """Three sets in two formats, two of them overlapping; the load is their union as a set."""
    root = scratch_folder(spark, "union")
    customers = run(spark, folder, CUSTOMER_FULL)
    orders = run(spark, folder, triples_map("o", ORDERS, template("order/{o_orderkey}"), classes=V + "Order"))
    write_rdf(customers, root + "/a", "nq")
    write_rdf(customers.where(F.col("p") == V + "name"), root + "/b", "nq")
    write_rdf(orders, root + "/c", "nt")
    quads = read_rdf(spark, [root + "/a", root + "/b"], "nq", distinct=False)
    triples = read_rdf(spark, root + "/c", "nt", distinct=False)
    return quads.unionByName(triples).dropDuplicates()


@query("SELECT 2 * count(DISTINCT s_suppkey) AS n FROM supplier")
def bnode_scope(spark, folder):
    """The same labels in two documents are different nodes."""
    root = scratch_folder(spark, "scope")
    item = triples_map("s", SUPPLIER, template("supplier-{s_suppkey}", term_type="bnode")).add(V + "name", ref("s_name"))
    frame = run(spark, folder, item)
    write_rdf(frame, root + "/a", "nt")
    write_rdf(frame, root + "/b", "nt")
    loaded = read_rdf(spark, [root + "/a", root + "/b"], "nt")
    return loaded.agg(F.countDistinct("s").alias("n"))


@query("SELECT 3 * count(*) AS n FROM supplier")
def bnode_turtle_load(spark, folder):
    """Pretty Turtle with blank nodes written in place keeps its number of statements."""
    loaded = round_trip(spark, supplier_contacts(spark, folder), "ttl", pretty=True, inline_bnodes=True)
    return loaded.agg(F.count(F.lit(1)).alias("n"))
