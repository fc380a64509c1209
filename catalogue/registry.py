"""Registration of queries and shared helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE = "http://example.com/base/"
V = "http://example.org/"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function

    return register


def read(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


def st(
    s: str,
    p: str,
    o: str,
    source: str,
    *,
    s_kind: str = "iri",
    o_kind: str = "literal",
    dt: str = "CAST(NULL AS VARCHAR)",
    lang: str = "CAST(NULL AS VARCHAR)",
    g: str = "CAST(NULL AS VARCHAR)",
) -> str:
    """SQL of one statement branch; the terms are SQL expressions."""
    return (
        f"SELECT '{s_kind}' AS s_kind, {s} AS s, {p} AS p, '{o_kind}' AS o_kind, {o} AS o, "
        f"{dt} AS o_dt, {lang} AS o_lang, {g} AS g FROM {source}"
    )


def union(*branches: str) -> str:
    return " UNION ALL ".join(branches)


def iri(path: str, *keys: str) -> str:
    """SQL of a base IRI followed by path text, with ``{}`` for each key expression."""
    text = f"'{BASE}{path}'"
    for key in keys:
        text = text.replace("{}", f"' || CAST({key} AS VARCHAR) || '", 1)
    return text.replace(" || ''", "")


def v(name: str) -> str:
    return f"'{V}{name}'"
