"""Operators on statements: sets, counts, limits, graphs, prefixes, blank nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.maps import CUSTOMER_FULL, CUSTOMER_FULL_SQL, EVENTS, SUPPLIER, customer_graphs, run
from catalogue.registry import BASE, TYPE, V, iri, query, read, st, union, v
from quadweave import parent, ref, table, template, triples_map
from quadweave.operators import bnodes, prefixes, statements
from quadweave.sinks.text import write_per_graph
from quadweave.sources.files import scratch_folder

EVENT_TYPES_SQL = st(iri("user/{}", "user_id"), f"'{TYPE}'", f"'{V}' || event_type", "events", o_kind="iri")


def event_types(spark, folder, **options):
    item = triples_map("e", EVENTS, template("user/{user_id}"))
    return run(spark, folder, item.add(TYPE, template(V + "{event_type}")), **options)


@query(f"SELECT DISTINCT * FROM ({EVENT_TYPES_SQL})")
def distinct_statements(spark, folder):
    """The set is found on the source columns, before any IRI is made."""
    return event_types(spark, folder, distinct=True)


@query("SELECT count(*) AS n FROM events")
def count_raw(spark, folder):
    return statements.count_raw(event_types(spark, folder))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def count_distinct(spark, folder):
    return statements.count_distinct(event_types(spark, folder))


@query(
    "SELECT CAST(count(*) AS BIGINT) AS written_raw, "
    "CAST(count(DISTINCT user_id || ' ' || event_type) AS BIGINT) AS written_distinct FROM events"
)
def count_collected_raw(spark, folder):
    """Raw count and set size of a collected output, from one pass."""
    return statements.count_both(event_types(spark, folder))


@query(f"SELECT * FROM ({CUSTOMER_FULL_SQL}) ORDER BY s, p, o LIMIT 20")
def limit_statements(spark, folder):
    return run(spark, folder, CUSTOMER_FULL).orderBy("s", "p", "o").limit(20)


CUSTOMER_GRAPHS_SQL = union(
    st(iri("customer/{}", "c_custkey"), v("name"), "c_name", "customer", g=iri("graph/{}", "c_nationkey")),
    st(iri("customer/{}", "c_custkey"), v("segment"), "c_mktsegment", "customer", g=iri("graph/{}", "c_nationkey")),
    st(iri("customer/{}", "c_custkey"), v("segment"), "c_mktsegment", "customer"),
)


@query(
    "SELECT DISTINCT s_kind, s, p, o_kind, o, o_dt, o_lang, CAST(NULL AS VARCHAR) AS g "
    f"FROM ({CUSTOMER_GRAPHS_SQL})"
)
def drop_graphs(spark, folder):
    return statements.drop_graphs(customer_graphs(spark, folder))


@query(f"SELECT g, count(*) AS n FROM ({CUSTOMER_GRAPHS_SQL}) GROUP BY g")
def graph_partition_counts(spark, folder):
    """Written as one directory per graph, counted from what was written."""
    root = scratch_folder(spark, "graphs")
    write_per_graph(customer_graphs(spark, folder), root, "nt")
    return statements.graph_counts(spark.read.text(root)).withColumn("g", F.col("g").cast("string"))


# --- prefixes ----------------------------------------------------------------------------------


@query(
    f"SELECT source AS prefix, arg_max('{V}' || doc_id || '#', doc_id) AS iri FROM documents GROUP BY source"
)
def prefix_load(spark, folder):
    """Every document row as a prefix mapping document, JSON and YAML by turns; the last one wins."""
    documents = read(spark, folder, "documents")["documents"]
    namespace = F.concat(F.lit(V), F.col("doc_id").cast("string"), F.lit("#"))
    is_json = F.col("doc_id") % 2 == 0
    return prefixes.prefixes_from_documents(
        documents.select(
            F.col("doc_id").alias("ordinal"),
            F.when(is_json, "json").otherwise("yaml").alias("format"),
            F.when(is_json, F.to_json(F.create_map("source", namespace)))
            .otherwise(F.concat(F.lit("# prefixes\n"), F.col("source"), F.lit(": "), namespace, F.lit("\n")))
            .alias("value"),
        )
    )


@query(
    f"""
    WITH d AS (
      SELECT CASE WHEN p_partkey % 2 = 0 THEN 'p' || p_partkey ELSE 's' || p_partkey END AS prefix,
             CASE WHEN p_partkey % 2 = 0 THEN '{V}' || p_type || '?part=' || p_partkey || '#' END AS inline
      FROM part)
    SELECT d.prefix, coalesce(d.inline, k.iri) AS iri, coalesce(d.inline, k.iri) IS NOT NULL AS resolved
    FROM d LEFT JOIN (SELECT 's' || s_suppkey AS prefix, '{V}supplier/' || s_suppkey || '#' AS iri FROM supplier) k
    ON d.prefix = k.prefix
    """
)
def prefix_resolve(spark, folder):
    """Inline declarations (with a second ``=`` inside) and references into a prefix table."""
    tables = read(spark, folder, "part", "supplier")
    key = F.col("p_partkey").cast("string")
    inline = F.concat(F.lit("p"), key, F.lit("=" + V), F.col("p_type"), F.lit("?part="), key, F.lit("#"))
    declarations = tables["part"].select(
        F.when(F.col("p_partkey") % 2 == 0, inline).otherwise(F.concat(F.lit("s"), key)).alias("declaration")
    )
    supplier = F.col("s_suppkey").cast("string")
    known = tables["supplier"].select(
        F.concat(F.lit("s"), supplier).alias("prefix"),
        F.concat(F.lit(V + "supplier/"), supplier, F.lit("#")).alias("iri"),
    )
    return prefixes.resolve_declarations(declarations, known)


@query(
    f"""
    SELECT 'c:' || c_custkey AS s, p.p, CASE WHEN p.p = '<{TYPE}>' THEN 'ex:Customer'
      ELSE 'base:' || 'c%23' || c_custkey END AS o
    FROM customer, (VALUES ('<{TYPE}>'), ('ex:code')) AS p(p)
    """.replace("'base:' || 'c%23' || c_custkey", f"'<{BASE}c%23' || c_custkey || '>'")
)
def compact_iris(spark, folder):
    """Longest namespace first; what is no plain local name stays a full IRI."""
    names = {"base": BASE, "c": BASE + "customer/", "ex": V}
    item = triples_map("c", table("customer"), template("customer/{c_custkey}"), classes=V + "Customer")
    frame = run(spark, folder, item.add(V + "code", template("c%23{c_custkey}")))
    return frame.select(*[prefixes.compact_iri(F.col(c), names).alias(c) for c in ("s", "p", "o")])


@query(
    f"""
    SELECT 'n' || c_nationkey || ':' || c_custkey AS s, c_name AS o FROM customer
    """
)
def compact_by_table(spark, folder):
    """Shortening by a prefix table: a join on the namespace part."""
    item = triples_map("c", table("customer"), template("nation/{c_nationkey}/{c_custkey}"))
    frame = run(spark, folder, item.add(V + "name", ref("c_name"))).select("s", "o")
    number = F.col("n_nationkey").cast("string")
    known = read(spark, folder, "nation")["nation"].select(
        F.concat(F.lit("n"), number).alias("prefix"), F.concat(F.lit(BASE + "nation/"), number, F.lit("/")).alias("iri")
    )
    return prefixes.compact_column(frame, "s", known)


# --- blank nodes -------------------------------------------------------------------------------


def supplier_contacts(spark, folder):
    """Suppliers as blank nodes that refer to a second blank node each."""
    supplier = triples_map("s", SUPPLIER, template("supplier-{s_suppkey}", term_type="bnode"))
    contact = triples_map("c", SUPPLIER, template("contact-{s_suppkey}", term_type="bnode"))
    return run(
        spark,
        folder,
        supplier.add(V + "contact", parent("c")).add(V + "balance", ref("s_nationkey")),
        contact.add(V + "name", ref("s_name")),
    )


@query(
    f"""
    WITH q AS (
      SELECT md5('supplier-' || s_suppkey) AS s, '{V}contact' AS p, 'bnode' AS o_kind,
             md5('contact-' || s_suppkey) AS o, CAST(NULL AS VARCHAR) AS o_dt FROM supplier
      UNION ALL SELECT md5('supplier-' || s_suppkey), '{V}balance', 'literal', CAST(s_nationkey AS VARCHAR),
             'http://www.w3.org/2001/XMLSchema#integer' FROM supplier
      UNION ALL SELECT md5('contact-' || s_suppkey), '{V}name', 'literal', s_name, NULL FROM supplier),
    l AS (SELECT label, 'b' || (row_number() OVER (ORDER BY label) - 1) AS new FROM
      (SELECT s AS label FROM q UNION SELECT o FROM q WHERE o_kind = 'bnode'))
    SELECT 'bnode' AS s_kind, a.new AS s, q.p, q.o_kind, coalesce(b.new, q.o) AS o, q.o_dt,
           CAST(NULL AS VARCHAR) AS o_lang, CAST(NULL AS VARCHAR) AS g
    FROM q JOIN l a ON q.s = a.label LEFT JOIN l b ON q.o_kind = 'bnode' AND q.o = b.label
    """
)
def bnode_relabel(spark, folder):
    return bnodes.relabel(supplier_contacts(spark, folder))


@query(
    f"""
    SELECT '[]' || chr(10) || '    <{V}balance> "' || s_nationkey ||
           '"^^<http://www.w3.org/2001/XMLSchema#integer> ;' || chr(10) ||
           '    <{V}contact> [ <{V}name> "' || s_name || '" ] .' AS block
    FROM supplier
    """
)
def bnode_inline(spark, folder):
    return bnodes.inlined_blocks(supplier_contacts(spark, folder)).select("block")
