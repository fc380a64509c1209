"""Columns of records may be called like anything the sharder uses itself."""

from pyspark.sql import functions as F

from quadweave.llm.sharding import shard_records


def test_clashing_columns_pass_through(spark):
    own = ["h", "p", "r", "_lane", "_range", "_item", "_part", "_heavy", "__r", "bytes", "rows", "count"]
    rows = spark.range(400).select("id", (F.col("id") % 90).alias("key"), F.lit(7).cast("bigint").alias("size"), *(F.lit(x).alias(x) for x in own))
    found = shard_records(rows, unit=["id"], shards=4)
    assert found.columns == [*rows.columns, "shard", "slot"]
    got = found.collect()
    assert sorted(r.id for r in got) == list(range(400)) and all(r[x] == x for r in got for x in own)
    for shard in range(4):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
