"""What makes a value an example: owners and different texts of the value itself, not of what surrounds it."""

from quadweave.llm.secrets import scan_secrets

COLUMNS = "doc_id bigint, text string, source string"


def block(body, kind="RSA "):
    return f"-----BEGIN {kind}PRIVATE KEY-----{body}-----END {kind}PRIVATE KEY-----"


def test_different_keys_of_many_sources_are_live(spark):
    keys = ["\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,AB\n\nMIIE" + c * 60 + "\n" + c * 20 + "\n" for c in "ghijkl"]
    rows = [(i, "é " + block(keys[i]) + " end", f"s{i}") for i in range(4)]
    same = "MIIE" + "z" * 60
    rows += [(10 + i, block(t, "") + " x" * i, f"s{i}") for i, t in enumerate([f"\n{same}\n", f"\\n{same}\\n", f"\r\n{same[:32]}\r\n{same[32:]}\r\n"])]
    rows += [(20, "-----BEGIN PRIVATE KEY----- is a header", "a"), (21, f"-----BEGIN EC PRIVATE KEY-----\nMHc{'q' * 40}", "a")]
    rows += [(22, "-----BEGIN RSA PRIVATE KEY-----\n" * 3 + block(keys[4], "EC "), "b")]
    found = {r.doc_id: r for r in scan_secrets(spark.createDataFrame(rows, COLUMNS)).collect()}
    for i in range(4):
        assert found[i].spans == f"key_block:2:{len(rows[i][1]) - 4}" and (found[i].n_live, found[i].n_example) == (1, 0)
    assert all((found[i].spans, found[i].n_live, found[i].n_example) == ("", 0, 1) for i in (10, 11, 12))
    assert found[20].spans == "" and found[20].n_live == found[20].n_example == 0
    assert found[21].spans == f"key_block:0:{len(rows[8][1])}" and found[22].spans == f"key_block:96:{len(rows[9][1])}"


def test_many_different_texts_of_one_source_make_an_example(spark):
    jwt = "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJ"
    rows = [(i, f"text {i} says {jwt}l", "hot") for i in range(12)] + [(100 + i, f"copy says {jwt}m", "hot") for i in range(12)]
    found = {r.doc_id: r for r in scan_secrets(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert all(r.n_example == 1 and r.spans == "" for i, r in found.items() if i < 100)
    assert all(r.n_live == 1 and r.spans for i, r in found.items() if i >= 100)


def test_long_key_bodies_and_unclosed_headers(spark):
    head = "-----BEGIN PRIVATE KEY-----"
    rows = [(1, block("\n" + "A-b " * 20_000 + "\n", ""), "a"), (2, f"{head}\n" * 2_000, "a"), (3, head + "A" * 2_000, "b")]
    found = {r.doc_id: r for r in scan_secrets(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert found[1].spans == f"key_block:0:{len(rows[0][1])}" and found[2].spans == "" and found[3].n_live == 1
