"""Null and shared ids neither save a contaminated document nor cost a clean one."""

from quadweave.llm.stages import keep_uncontaminated

SMALL = "/root/testdata/sf0.001"


def test_the_text_decides(spark):
    item = max((r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if r.text), key=lambda t: len(t.split()))
    rows = [
        (None, f"before {item} after", "null, contaminated"),
        (None, "a clean text without an id", "null, clean"),
        (7, item, "shared, contaminated"),
        (7, "a clean text that shares its id", "shared, clean"),
        (8, None, "no text"),
        (8, "", "empty"),
        (9, item, "repeated"),
        (9, item, "repeated"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _text_key string")
    kept = keep_uncontaminated(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert sorted(r._text_key for r in kept.collect()) == ["empty", "no text", "null, clean", "shared, clean"]
    assert keep_uncontaminated(spark, docs.limit(0), SMALL).count() == 0
