"""Term maps, triples maps, sources and joins."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.registry import BASE, TYPE, V, XSD, iri, query, read, st, union, v
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
from quadweave.functions import default_functions
from quadweave.sources.files import scratch_folder
from quadweave.sources.rdf import scope_bnodes
from quadweave.sources.rdf_documents import parse_documents

CUSTOMER = table("customer", unique=["c_custkey"])
NATION = table("nation", unique=["n_nationkey"])
REGION = table("region", unique=["r_regionkey"])
ORDERS = table("orders", unique=["o_orderkey"])
SUPPLIER = table("supplier", unique=["s_suppkey"])
PART = table("part", unique=["p_partkey"])
EVENTS = table("events", unique=["event_id"])
LINEITEM = table("lineitem")
DOCUMENTS = table("documents", unique=["doc_id"])


def run(spark: SparkSession, folder: str, *maps, **options) -> DataFrame:
    """Run triples maps over the tables they name."""
    names = {item.source.name for item in maps if item.source.formulation == "table"}
    return Mapping.of(*maps).run(spark, read(spark, folder, *names), **options)


# --- terms -------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT 'iri' AS s_kind, {iri('customer/{}', 'o_custkey')} AS s FROM orders")
def subject_map(spark, folder):
    item = triples_map("order", ORDERS, template("customer/{o_custkey}"), classes=V + "Buyer")
    return run(spark, folder, item).select("s_kind", "s").distinct()


@query(st(iri("region/{}", "r_regionkey"), v("kind"), v("Region"), "region", o_kind="iri"))
def constant_object_map(spark, folder):
    item = triples_map("region", REGION, template("region/{r_regionkey}")).add(V + "kind", const(V + "Region"))
    return run(spark, folder, item)


@query(st(iri("nation/{}", "n_nationkey"), v("name"), "n_name", "nation"))
def reference_literal_map(spark, folder):
    return run(spark, folder, triples_map("n", NATION, template("nation/{n_nationkey}")).add(V + "name", ref("n_name")))


@query(
    st(
        iri("order/{}/line/{}", "l_orderkey", "l_linenumber"),
        v("part"),
        iri("part/{}", "l_partkey"),
        "lineitem",
        o_kind="iri",
    )
)
def template_iri_map(spark, folder):
    item = triples_map("l", LINEITEM, template("order/{l_orderkey}/line/{l_linenumber}"))
    return run(spark, folder, item.add(V + "part", template("part/{l_partkey}")))


@query(st(iri("c/{}", "url_encode(c_name)"), v("segment"), "c_mktsegment", "customer"))
def iri_safe_template(spark, folder):
    return run(spark, folder, triples_map("c", CUSTOMER, template("c/{c_name}")).add(V + "segment", ref("c_mktsegment")))


@query(st("'https://foo.bar/' || n_nationkey", v("name"), "n_name", "nation"))
def base_iri_map(spark, folder):
    item = triples_map("n", NATION, template("{n_nationkey}")).add(V + "name", ref("n_name"))
    return run(spark, folder, item, base_iri="https://foo.bar/")


@query(st("md5('supplier-' || s_suppkey)", v("name"), "s_name", "supplier", s_kind="bnode"))
def bnode_subject_map(spark, folder):
    subject = template("supplier-{s_suppkey}", term_type="bnode")
    return run(spark, folder, triples_map("s", SUPPLIER, subject).add(V + "name", ref("s_name")))


@query(
    st(
        iri("order/{}", "o_orderkey"),
        v("total"),
        "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)",
        "orders",
        dt=f"'{XSD}decimal'",
    )
)
def typed_literal_map(spark, folder):
    orders = read(spark, folder, "orders")["orders"]
    orders = orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    item = triples_map("o", ORDERS, template("order/{o_orderkey}"))
    item = item.add(V + "total", ref("o_totalprice", datatype=XSD + "decimal"))
    return Mapping.of(item).run(spark, {"orders": orders})


@query(st(iri("doc/{}", "doc_id"), v("text"), "text", "documents", lang="lower(lang)"))
def lang_literal_map(spark, folder):
    item = triples_map("d", DOCUMENTS, template("doc/{doc_id}")).add(V + "text", ref("text", language=ref("lang")))
    return run(spark, folder, item)


@query(
    union(
        st(
            iri("event/{}", "event_id"),
            v("at"),
            "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')",
            "events",
            dt=f"'{XSD}dateTime'",
        ),
        st(iri("event/{}", "event_id"), v("user"), "CAST(user_id AS VARCHAR)", "events", dt=f"'{XSD}integer'"),
    )
)
def natural_types_map(spark, folder):
    item = triples_map("e", EVENTS, template("event/{event_id}")).add(V + "at", ref("ts")).add(V + "user", ref("user_id"))
    return run(spark, folder, item)


@query(st(iri("order/{}", "o_orderkey"), v("status"), "o_orderstatus", "orders WHERE o_orderstatus <> 'F'"))
def null_drop_map(spark, folder):
    orders = read(spark, folder, "orders")["orders"]
    orders = orders.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("F")))
    item = triples_map("o", ORDERS, template("order/{o_orderkey}")).add(V + "status", ref("o_orderstatus"))
    return Mapping.of(item).run(spark, {"orders": orders})


@query(
    st(
        iri("part/{}", "p_partkey"),
        v("word"),
        "word",
        "(SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)",
    )
)
def multivalue_map(spark, folder):
    part = read(spark, folder, "part")["part"].withColumn("words", F.split("p_name", " "))
    item = triples_map("p", PART, template("part/{p_partkey}")).add(V + "word", ref("words"))
    return Mapping.of(item).run(spark, {"part": part})


@query(
    st(
        iri("part/{}", "p_partkey"),
        v("pair"),
        iri("pair/{}/{}/{}", "a.word", "b.tag", "a.word"),
        "(SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) a JOIN "
        "(SELECT p_partkey, unnest([p_brand, p_type]) AS tag FROM part) b USING (p_partkey)",
        o_kind="iri",
    ).replace("b.tag", "url_encode(b.tag)")
)
def multivalue_product_map(spark, folder):
    part = read(spark, folder, "part")["part"]
    part = part.withColumn("words", F.split("p_name", " ")).withColumn("tags", F.array("p_brand", "p_type"))
    item = triples_map("p", PART, template("part/{p_partkey}")).add(V + "pair", template("pair/{words}/{tags}/{words}"))
    return Mapping.of(item).run(spark, {"part": part})


@query(
    st(
        iri("part/{}", "p_partkey"),
        v("ref"),
        "CASE WHEN starts_with(x, 'http') THEN x ELSE '" + BASE + "' || x END",
        "(SELECT p_partkey, unnest([p_name, p_type, p_brand]) AS x FROM part) WHERE NOT contains(x, ' ')",
        o_kind="iri",
    )
)
def iri_valid_filter(spark, folder):
    item = triples_map("p", PART, template("part/{p_partkey}"))
    item = item.add(V + "ref", [ref(name, term_type="iri") for name in ("p_name", "p_type", "p_brand")])
    return run(spark, folder, item, on_invalid="drop")


# --- statements of a triples map ---------------------------------------------------------------


@query(st(iri("customer/{}", "c_custkey"), f"'{TYPE}'", v("Customer"), "customer", o_kind="iri"))
def class_map(spark, folder):
    return run(spark, folder, triples_map("c", CUSTOMER, template("customer/{c_custkey}"), classes=V + "Customer"))


@query(
    union(
        *[
            st(iri("supplier/{}", "s_suppkey"), v(p), o, "supplier")
            for p in ("name", "label")
            for o in ("s_name", "'SUPPLIER'")
        ]
    )
)
def predicate_object_map(spark, folder):
    item = triples_map("s", SUPPLIER, template("supplier/{s_suppkey}"))
    return run(spark, folder, item.add([V + "name", V + "label"], [ref("s_name"), literal("SUPPLIER")]))


@query(
    st(iri("user/{}", "user_id"), f"'{V}' || event_type", iri("event/{}", "event_id"), "events", o_kind="iri")
)
def dynamic_predicate_map(spark, folder):
    item = triples_map("e", EVENTS, template("user/{user_id}"))
    return run(spark, folder, item.add(template(V + "{event_type}"), template("event/{event_id}")))


@query(
    union(
        st(iri("customer/{}", "c_custkey"), v("name"), "c_name", "customer", g=iri("graph/{}", "c_nationkey")),
        st(iri("customer/{}", "c_custkey"), v("segment"), "c_mktsegment", "customer", g=iri("graph/{}", "c_nationkey")),
        st(iri("customer/{}", "c_custkey"), v("segment"), "c_mktsegment", "customer"),
    )
)
def graph_map(spark, folder):
    return customer_graphs(spark, folder)


def customer_graphs(spark, folder):
    """Names in a graph per nation, segments there and in the default graph."""
    default_graph = "http://www.w3.org/ns/r2rml#defaultGraph"
    item = triples_map("c", CUSTOMER, template("customer/{c_custkey}"), graphs=template("graph/{c_nationkey}"))
    item = item.add(V + "name", ref("c_name")).add(V + "segment", ref("c_mktsegment"), default_graph)
    return run(spark, folder, item)


CUSTOMER_FULL = (
    triples_map("customer", CUSTOMER, template("customer/{c_custkey}"), classes=V + "Customer")
    .add(V + "name", ref("c_name"))
    .add(V + "segment", ref("c_mktsegment"))
    .add(V + "nation", template("nation/{c_nationkey}"))
)
CUSTOMER_FULL_SQL = union(
    st(iri("customer/{}", "c_custkey"), f"'{TYPE}'", v("Customer"), "customer", o_kind="iri"),
    st(iri("customer/{}", "c_custkey"), v("name"), "c_name", "customer"),
    st(iri("customer/{}", "c_custkey"), v("segment"), "c_mktsegment", "customer"),
    st(iri("customer/{}", "c_custkey"), v("nation"), iri("nation/{}", "c_nationkey"), "customer", o_kind="iri"),
)


@query(CUSTOMER_FULL_SQL)
def customer_full_map(spark, folder):
    return run(spark, folder, CUSTOMER_FULL)


@query(
    union(
        st(iri("customer/{}", "c_custkey"), v("name"), "c_name", "customer"),
        st(iri("customer/{}", "c_custkey"), v("segment"), "c_mktsegment", "customer"),
    )
)
def select_predicates(spark, folder):
    """Branch pruning: two columns fewer in the scan."""
    mapping = Mapping.of(CUSTOMER_FULL).select(predicates=[V + "name", V + "segment"])
    return mapping.run(spark, read(spark, folder, "customer"))


@query(
    union(
        st(iri("part/{}", "p_partkey"), v("title"), "upper(p_name)", "part"),
        st(iri("part/{}", "p_partkey"), v("word"), "w", "(SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)"),
        st(iri("part/{}", "p_partkey"), v("brandType"), "p_brand || ' ' || p_type", "part"),
    )
)
def function_map(spark, folder):
    fn = "http://www.w3.org/2005/xpath-functions#"
    functions = default_functions().register(V + "join", lambda left, right: F.concat(left, F.lit(" "), right))
    item = (
        triples_map("p", PART, template("part/{p_partkey}"))
        .add(V + "title", call(fn + "upper-case", value="p_name"))
        .add(V + "word", call(fn + "tokenize", value="p_name", pattern=literal(" ")))
        .add(V + "brandType", call(V + "join", left="p_brand", right="p_type"))
    )
    return run(spark, folder, item, functions=functions)


# --- sources -----------------------------------------------------------------------------------


@query(st(iri("brand/{}", "p_brand").replace("CAST(p_brand AS VARCHAR)", "url_encode(p_brand)"), f"'{TYPE}'", v("Brand"), "part", o_kind="iri"))
def bound_table_map(spark, folder):
    """The unnamed input, bound to a DataFrame at run time."""
    item = triples_map("m", csv_source(None), template("brand/{p_brand}"), classes=V + "Brand")
    return Mapping.of(item).run(spark, {None: read(spark, folder, "part")["part"]})


NOTES = "(SELECT *, 'clerk ' || CAST(o_custkey % 97 AS VARCHAR) AS o_clerk FROM orders)"


@query(
    union(
        st(iri("customer/{}", "c_custkey"), v("name"), "c_name", "customer"),
        st(iri("customer/{}", "c_custkey"), v("nation"), "CAST(c_nationkey AS VARCHAR)", "customer"),
    )
)
def csv_source_map(spark, folder):
    root = scratch_folder(spark, "csv")
    read(spark, folder, "customer")["customer"].write.csv(root + "/customer", header=True)
    item = triples_map("c", csv_source("customer"), template("customer/{c_custkey}"))
    item = item.add(V + "name", ref("c_name")).add(V + "nation", ref("c_nationkey"))
    return Mapping.of(item).run(spark, root=root)


@query(
    union(
        st(iri("order/{}", "o_orderkey"), v("note"), "o_orderpriority || chr(10) || '\"' || o_orderstatus || '\", ' || o_clerk", NOTES),
        st(iri("order/{}", "o_orderkey"), v("total"), "CAST(o_custkey AS VARCHAR)", NOTES),
    )
)
def csv_line_breaks_map(spark, folder):
    """CSV files whose quoted fields hold line breaks, quotes and commas, read by many tasks without options."""
    root = scratch_folder(spark, "csv")
    note = F.concat("o_orderpriority", F.lit('\n"'), "o_orderstatus", F.lit('", '), F.concat(F.lit("clerk "), F.col("o_custkey") % 97))
    orders = read(spark, folder, "orders")["orders"].select("o_orderkey", note.alias("note"), "o_custkey")
    orders.write.options(header=True, quote='"', escape='"').csv(root + "/orders")
    item = triples_map("o", csv_source("orders"), template("order/{o_orderkey}"))
    return Mapping.of(item.add(V + "note", ref("note")).add(V + "total", ref("o_custkey"))).run(spark, root=root)


@query(
    st(
        iri("event/{}", "event_id"),
        v("k"),
        "json_extract_string(props, '$.k')",
        "events WHERE json_extract_string(props, '$.k') IS NOT NULL",
    )
)
def json_iterator_map(spark, folder):
    item = triples_map("e", json_source("events", column="props"), template("event/{event_id}"))
    return Mapping.of(item.add(V + "k", ref("$.k"))).run(spark, read(spark, folder, "events"))


@query(
    union(
        st(iri("order/{}", "o_orderkey"), v("status"), "o_orderstatus", "orders"),
        st(
            iri("order/{}", "o_orderkey"),
            v("tag"),
            "t",
            "(SELECT o_orderkey, unnest([o_orderpriority, o_orderstatus]) AS t FROM orders)",
        ),
    )
)
def json_file_map(spark, folder):
    """JSON files with an iterator into an array and a multi-valued path."""
    root = scratch_folder(spark, "json")
    orders = read(spark, folder, "orders")["orders"]
    item = F.struct("o_orderkey", "o_orderstatus", F.array("o_orderpriority", "o_orderstatus").alias("tags"))
    orders.select(F.array(item).alias("items")).write.json(root + "/orders")
    source = json_source("orders", "$.items[*]", lines=True)
    mapped = triples_map("o", source, template("order/{o_orderkey}"))
    mapped = mapped.add(V + "status", ref("o_orderstatus")).add(V + "tag", ref("tags[*]"))
    return Mapping.of(mapped).run(spark, root=root)


@query(
    union(
        st(iri("customer/{}", "c_custkey"), f"'{TYPE}'", v("Customer"), "customer", o_kind="iri"),
        st(iri("customer/{}", "c_custkey"), v("name"), "c_name", "customer"),
    )
)
def xml_iterator_map(spark, folder):
    root = scratch_folder(spark, "xml")
    customer = read(spark, folder, "customer")["customer"]
    customer.select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("name")).write.format("xml").options(
        rootTag="customers", rowTag="customer"
    ).save(root + "/customer")
    item = triples_map("c", xml_source("customer", "//customer"), template("customer/{@id}"), classes=V + "Customer")
    return Mapping.of(item.add(V + "name", ref("name"))).run(spark, root=root)


@query(
    union(
        st(iri("order/{}", "o_orderkey"), f"'{TYPE}'", v("Order"), "orders", o_kind="iri"),
        st(iri("order/{}", "o_orderkey"), v("status"), "o_orderstatus", "orders"),
        st(
            iri("order/{}", "o_orderkey"),
            v("customer"),
            iri("customer/{}", "c_custkey"),
            "orders JOIN customer ON o_custkey = c_custkey",
            o_kind="iri",
        ),
        st(iri("customer/{}", "c_custkey"), v("segment"), "lower(c_mktsegment)", "customer", g=v("customers")),
    )
)
def mapping_document_map(spark, folder):
    """The mapping itself is read from an RDF document; its sources are bound to the tables."""
    document = (Path(__file__).parent / "mappings" / "orders.ttl").read_text()
    texts = spark.createDataFrame([(document, "orders.ttl")], "value string, file string")
    mapping = Mapping.from_statements(scope_bnodes(parse_documents(texts, "ttl")))
    return mapping.run(spark, read(spark, folder, "orders", "customer"))


# --- joins -------------------------------------------------------------------------------------


@query(st(iri("order/{}", "o_orderkey"), v("customer"), iri("customer/{}", "o_custkey"), "orders", o_kind="iri"))
def parent_same_row(spark, folder):
    return run(
        spark,
        folder,
        triples_map("o", ORDERS, template("order/{o_orderkey}")).add(V + "customer", parent("buyer")),
        triples_map("buyer", ORDERS, template("customer/{o_custkey}")),
    )


@query(
    st(
        iri("order/{}", "o_orderkey"),
        v("customer"),
        iri("c/{}", "url_encode(c_name)"),
        "orders JOIN customer ON o_custkey = c_custkey",
        o_kind="iri",
    )
)
def parent_join(spark, folder):
    return run(
        spark,
        folder,
        triples_map("o", ORDERS, template("order/{o_orderkey}")).add(V + "customer", parent("c", ("o_custkey", "c_custkey"))),
        triples_map("c", CUSTOMER, template("c/{c_name}")),
    )


@query(
    st(
        iri("l/{}/{}", "a.l_orderkey", "a.l_linenumber"),
        v("samePart"),
        "b.o",
        "lineitem a JOIN (SELECT DISTINCT l_orderkey, l_partkey, "
        + iri("l/{}/{}", "l_orderkey", "l_linenumber")
        + " AS o FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey",
        o_kind="iri",
    )
)
def parent_join_multi(spark, folder):
    item = triples_map("l", LINEITEM, template("l/{l_orderkey}/{l_linenumber}"))
    same = parent("l", ("l_orderkey", "l_orderkey"), ("l_partkey", "l_partkey"))
    return run(spark, folder, item.add(V + "samePart", same))


@query(
    st(
        iri("l/{}/{}", "l_orderkey", "l_linenumber"),
        v("orderOf"),
        iri("cust/{}", "o_custkey"),
        "lineitem JOIN orders ON l_orderkey = o_orderkey",
        o_kind="iri",
    )
)
def parent_join_large(spark, folder):
    return run(
        spark,
        folder,
        triples_map("l", LINEITEM, template("l/{l_orderkey}/{l_linenumber}")).add(
            V + "orderOf", parent("o", ("l_orderkey", "o_orderkey"))
        ),
        triples_map("o", ORDERS, template("cust/{o_custkey}")),
    )


@query(
    st(
        iri("l/{}/{}", "l_orderkey", "l_linenumber"),
        v("order"),
        iri("order/{}", "o_orderkey"),
        "lineitem JOIN orders ON l_orderkey = o_orderkey",
        o_kind="iri",
    )
)
def parent_join_semi(spark, folder):
    """The parent's subject is made of its join key, so the join only tests for existence."""
    return run(
        spark,
        folder,
        triples_map("l", LINEITEM, template("l/{l_orderkey}/{l_linenumber}")).add(
            V + "order", parent("o", ("l_orderkey", "o_orderkey"))
        ),
        triples_map("o", ORDERS, template("order/{o_orderkey}")),
    )


@query(
    st(
        iri("customer/{}", "c_custkey"),
        v("nation"),
        iri("nation/{}", "n_name"),
        "customer JOIN nation ON c_nationkey = n_nationkey",
        o_kind="iri",
    )
)
def parent_join_cross_format(spark, folder):
    """A CSV child against a Parquet parent: keys compare as text."""
    root = scratch_folder(spark, "cross")
    tables = read(spark, folder, "customer", "nation")
    tables["customer"].write.csv(root + "/customer", header=True)
    child = triples_map("c", csv_source("customer"), template("customer/{c_custkey}"))
    return Mapping.of(
        child.add(V + "nation", parent("n", ("c_nationkey", "n_nationkey"))),
        triples_map("n", NATION, template("nation/{n_name}")),
    ).run(spark, {"nation": tables["nation"]}, root=root)


@query(
    st(
        iri("customer/{}", "c_custkey"),
        v("peer"),
        iri("peer/{}", "c_name").replace("CAST(c_name AS VARCHAR)", "url_encode(c_name)"),
        "customer",
        o_kind="iri",
    )
)
def parent_self_join(spark, folder):
    """A self join on a declared key finds the row itself, so no join is planned."""
    return run(
        spark,
        folder,
        triples_map("c", CUSTOMER, template("customer/{c_custkey}")).add(V + "peer", parent("p", ("c_custkey", "c_custkey"))),
        triples_map("p", CUSTOMER, template("peer/{c_name}")),
    )


@query(
    union(
        st(iri("line/{}/{}", "l_orderkey", "l_linenumber"), v("flag"), "l_returnflag", "lineitem"),
        st(
            iri("line/{}/{}", "l_orderkey", "l_linenumber"),
            v("orderOf"),
            iri("cust/{}", "o_custkey"),
            "lineitem JOIN orders ON l_orderkey = o_orderkey",
            o_kind="iri",
        ),
        st(
            iri("line/{}/{}", "l_orderkey", "l_linenumber"),
            v("order"),
            iri("order/{}", "o_orderkey"),
            "lineitem JOIN orders ON l_orderkey = o_orderkey",
            o_kind="iri",
            g=v("orders"),
        ),
        st(
            iri("line/{}/{}", "l_orderkey", "l_linenumber"),
            v("supplier"),
            iri("s/{}", "url_encode(s_name)"),
            "lineitem JOIN supplier ON l_suppkey = s_suppkey",
            o_kind="iri",
        ),
        st(
            iri("line/{}/{}", "l_orderkey", "l_linenumber"),
            v("part"),
            iri("part/{}", "p_partkey"),
            "lineitem JOIN part ON l_partkey = p_partkey",
            o_kind="iri",
        ),
    )
)
def parents_on_one_scan_map(spark, folder):
    """Four parents on declared keys, two of them on one key: one scan of the child, and one generator for all branches."""
    line = triples_map("l", LINEITEM, template("line/{l_orderkey}/{l_linenumber}"))
    line = line.add(V + "flag", ref("l_returnflag"))
    line = line.add(V + "orderOf", parent("buyer", ("l_orderkey", "o_orderkey")))
    line = line.add(V + "order", parent("order", ("l_orderkey", "o_orderkey")), V + "orders")
    line = line.add(V + "supplier", parent("supplier", ("l_suppkey", "s_suppkey")))
    line = line.add(V + "part", parent("part", ("l_partkey", "p_partkey")))
    mapping = Mapping.of(
        line,
        triples_map("buyer", ORDERS, template("cust/{o_custkey}")),
        triples_map("order", ORDERS, template("order/{o_orderkey}")),
        triples_map("supplier", table("supplier", unique=["s_suppkey"]), template("s/{s_name}")),
        triples_map("part", table("part", unique=["p_partkey"]), template("part/{p_partkey}")),
    )
    return mapping.run(spark, read(spark, folder, "lineitem", "orders", "supplier", "part"))


def star_maps():
    return (
        triples_map("region", REGION, template("region/{r_regionkey}"), classes=V + "Region").add(V + "name", ref("r_name")),
        triples_map("nation", NATION, template("nation/{n_nationkey}"), classes=V + "Nation")
        .add(V + "name", ref("n_name"))
        .add(V + "region", parent("region", ("n_regionkey", "r_regionkey"))),
        triples_map("customer", CUSTOMER, template("customer/{c_custkey}"), classes=V + "Customer")
        .add(V + "name", ref("c_name"))
        .add(V + "segment", ref("c_mktsegment"))
        .add(V + "nation", parent("nation", ("c_nationkey", "n_nationkey"))),
        triples_map("order", ORDERS, template("order/{o_orderkey}"), classes=V + "Order")
        .add(V + "status", ref("o_orderstatus"))
        .add(V + "priority", ref("o_orderpriority"))
        .add(V + "customer", parent("customer", ("o_custkey", "c_custkey"))),
    )


STAR_SQL = union(
    st(iri("region/{}", "r_regionkey"), f"'{TYPE}'", v("Region"), "region", o_kind="iri"),
    st(iri("region/{}", "r_regionkey"), v("name"), "r_name", "region"),
    st(iri("nation/{}", "n_nationkey"), f"'{TYPE}'", v("Nation"), "nation", o_kind="iri"),
    st(iri("nation/{}", "n_nationkey"), v("name"), "n_name", "nation"),
    st(
        iri("nation/{}", "n_nationkey"),
        v("region"),
        iri("region/{}", "r_regionkey"),
        "nation JOIN region ON n_regionkey = r_regionkey",
        o_kind="iri",
    ),
    st(iri("customer/{}", "c_custkey"), f"'{TYPE}'", v("Customer"), "customer", o_kind="iri"),
    st(iri("customer/{}", "c_custkey"), v("name"), "c_name", "customer"),
    st(iri("customer/{}", "c_custkey"), v("segment"), "c_mktsegment", "customer"),
    st(
        iri("customer/{}", "c_custkey"),
        v("nation"),
        iri("nation/{}", "n_nationkey"),
        "customer JOIN nation ON c_nationkey = n_nationkey",
        o_kind="iri",
    ),
    st(iri("order/{}", "o_orderkey"), f"'{TYPE}'", v("Order"), "orders", o_kind="iri"),
    st(iri("order/{}", "o_orderkey"), v("status"), "o_orderstatus", "orders"),
    st(iri("order/{}", "o_orderkey"), v("priority"), "o_orderpriority", "orders"),
    st(
        iri("order/{}", "o_orderkey"),
        v("customer"),
        iri("customer/{}", "c_custkey"),
        "orders JOIN customer ON o_custkey = c_custkey",
        o_kind="iri",
    ),
)


@query(STAR_SQL)
def star_schema_map(spark, folder):
    """Flagship: four triples maps, four scans, three existence joins, and no shuffle for the set."""
    return run(spark, folder, *star_maps(), distinct=True)
