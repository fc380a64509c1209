"""Output formats and how each is written: row by row, or grouped after a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from quadweave.errors import FormatError

# Format names and what they can hold. "always": row by row even when pretty output is
# wanted; "plain": row by row unless pretty; "never": always grouped, so always a set.
STREAMED = {
    "nt": "always",
    "nq": "always",
    "ttl": "plain",
    "ttls": "plain",
    "trig": "plain",
    "trigs": "plain",
    "n3": "plain",
    "trix": "plain",
    "rdf": "never",
    "jsonld": "never",
    "ndjsonld": "never",
    "rj": "never",
}
ALIASES = {"xml": "trix", "owl": "rdf", "jsonld11": "jsonld"}
WITH_GRAPHS = {"jsonld", "jsonld11", "trig", "trigs", "n3", "nq", "trix", "ndjsonld"}
NOT_SUPPORTED = {"brf", "pbrdf", "rpb", "rt", "trdf", "shaclc", "shc"}


@dataclass(frozen=True)
class OutputPlan:
    format: str
    grouped: bool  # a shuffle by subject; the result is a set
    graphs: bool  # the format can name graphs


def output_format(name: str) -> str:
    fmt = ALIASES.get(name, name)
    if fmt not in STREAMED:
        raise FormatError(f"Unsupported RDF Format reference specified: '{name}'.")
    return fmt


def is_streamable(name: str, pretty: bool) -> bool:
    rule = STREAMED[output_format(name)]
    return rule == "always" or (rule == "plain" and not pretty)


def supports_graphs(name: str) -> bool:
    return output_format(name) in WITH_GRAPHS


def plan_output(name: str, pretty: bool) -> OutputPlan:
    return OutputPlan(output_format(name), not is_streamable(name, pretty), supports_graphs(name))
