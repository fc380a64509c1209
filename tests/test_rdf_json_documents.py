"""Ordinary RDF/JSON documents, with line breaks anywhere."""

import json

import pytest

from quadweave.sources.rdf import read_rdf

DOCUMENT = {
    "http://example.org/oak": {
        "http://example.org/height": [{"type": "literal", "value": "21", "datatype": "http://www.w3.org/2001/XMLSchema#integer"}],
        "http://example.org/near": [{"type": "uri", "value": "http://example.org/ash"}, {"type": "bnode", "value": "_:b"}],
    },
    "_:b": {"http://example.org/name": [{"type": "literal", "value": "Ulme", "lang": "de"}]},
}


def test_an_indented_document_is_read_whole(spark, tmp_path):
    for name, indent in (("wide", 2), ("flat", None)):
        (tmp_path / f"{name}.rj").write_text(json.dumps(DOCUMENT, indent=indent))
    wide, flat = (read_rdf(spark, str(tmp_path / f"{n}.rj"), cut=False) for n in ("wide", "flat"))
    assert wide.count() == 4
    plain = [{(r.p, r.o, r.o_dt, r.o_lang) for r in x.filter("o_kind <> 'bnode'").collect()} for x in (wide, flat)]
    assert plain[0] == plain[1] == {
        ("http://example.org/height", "21", "http://www.w3.org/2001/XMLSchema#integer", None),
        ("http://example.org/near", "http://example.org/ash", None, None),
        ("http://example.org/name", "Ulme", None, "de"),
    }
    assert wide.filter("o_kind = 'bnode'").first().o == wide.filter("s_kind = 'bnode'").first().s


def test_by_lines_an_indented_document_is_an_error(spark, tmp_path):
    (tmp_path / "wide.rj").write_text(json.dumps(DOCUMENT, indent=2))
    with pytest.raises(Exception, match="parsing"):
        read_rdf(spark, str(tmp_path / "wide.rj")).collect()
