"""Streaming twins of batch queries: the same mapping over a file stream, run until it is drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.maps import CUSTOMER, EVENTS, ORDERS
from catalogue.registry import BASE, V, iri, query, read, st, union, v
from quadweave import Mapping, parent, ref, template, triples_map
from quadweave.sources.files import scratch_folder
from quadweave.streaming.jobs import start_dataset_sink, start_line_sink, start_statement_sink, written_so_far


def stream(spark, folder, name):
    """A table as a file stream: its files in the folder, picked up as they appear."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def event_map():
    item = triples_map("e", EVENTS, template("event/{event_id}"))
    return item.add(V + "user", template("user/{user_id}")).add(V + "type", ref("event_type"))


EVENTS_SQL = union(
    st(iri("event/{}", "event_id"), v("user"), iri("user/{}", "user_id"), "events", o_kind="iri"),
    st(iri("event/{}", "event_id"), v("type"), "event_type", "events"),
)


def drained(spark, statements):
    root = scratch_folder(spark, "stream")
    query = start_statement_sink(statements, root + "/out", root + "/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(root + "/out")


@query(EVENTS_SQL)
def stream_map(spark, folder):
    return drained(spark, Mapping.of(event_map()).run(spark, {"events": stream(spark, folder, "events")}))


@query(
    f"""SELECT '<{BASE}event/' || event_id || '> <{V}user> <{BASE}user/' || user_id || '> .' AS value FROM events
    UNION ALL SELECT '<{BASE}event/' || event_id || '> <{V}type> "' || event_type || '" .' FROM events"""
)
def stream_nquads(spark, folder):
    root = scratch_folder(spark, "stream")
    statements = Mapping.of(event_map()).run(spark, {"events": stream(spark, folder, "events")})
    start_line_sink(statements, root + "/out", root + "/checkpoint").awaitTermination()
    return spark.read.text(root + "/out")


@query(
    f"""WITH d AS (
      SELECT 'e:' || event_id || ' v:user <{BASE}user/' || user_id || '> .' AS value FROM events
      UNION ALL SELECT 'e:' || event_id || ' v:type "' || event_type || '" .' FROM events)
    SELECT value, (SELECT count(*) FROM d) AS written FROM d"""
)
def stream_turtle(spark, folder):
    """Lines of the dataset sink's files below their headers, with the count that it keeps."""
    root = scratch_folder(spark, "stream")
    statements = Mapping.of(event_map()).run(spark, {"events": stream(spark, folder, "events")})
    prefixes = {"e": f"{BASE}event/", "v": V}
    start_dataset_sink(statements, root + "/out", root + "/checkpoint", "ttl", prefixes=prefixes).awaitTermination()
    lines = spark.read.text(root + "/out/batch=*").filter("value <> '' AND value NOT LIKE '@prefix %'")
    return lines.withColumn("written", F.lit(written_so_far(spark, root + "/out").written_raw).cast("bigint"))


@query("SELECT least(20, 2 * count(*)) AS n FROM events")
def stream_limit(spark, folder):
    """How many of the limited statements are statements of the whole mapping: all of them."""
    mapping = Mapping.of(event_map())
    limited = drained(spark, mapping.run(spark, {"events": stream(spark, folder, "events")}, limit=20))
    whole = mapping.run(spark, read(spark, folder, "events"))
    return limited.join(whole, ["s", "p", "o"], "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query(
    st(
        iri("order/{}", "o_orderkey"),
        v("customer"),
        iri("c/{}", "url_encode(c_name)"),
        "orders JOIN customer ON o_custkey = c_custkey",
        o_kind="iri",
    )
)
def stream_parent_join(spark, folder):
    order = triples_map("o", ORDERS, template("order/{o_orderkey}"))
    mapping = Mapping.of(
        order.add(V + "customer", parent("c", ("o_custkey", "c_custkey"))),
        triples_map("c", CUSTOMER, template("c/{c_name}")),
    )
    sources = {"orders": stream(spark, folder, "orders"), **read(spark, folder, "customer")}
    return drained(spark, mapping.run(spark, sources))
