"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir); docs has the columns of documents.

Documents without an id cannot be told apart: the n-gram join, which drops by id, keeps them. All but the last stage return the
columns they were given. Any columns beyond doc_id, text and source pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.llm.common import broadcast_if_small, shared_table
from quadweave.llm.decontaminate import benchmark_overlaps
from quadweave.llm.mixing import mix_sources, word_count
from quadweave.llm.ngram_join import ngram_components
from quadweave.llm.quality import fit_quality, held_out, score
from quadweave.llm.sharding import shard_records

#: The least probability of label 1 that keeps a document.
LEAST_QUALITY = 0.3
#: Keys of 32 bytes that may be broadcast.
KEY_ROWS = 1 << 18


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less the ids, which are broadcast only if they are few."""
    dropped = shared_table(ids.filter("doc_id IS NOT NULL").distinct(), "dropped")
    return docs.join(broadcast_if_small(dropped), "doc_id", "left_anti").select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier rejects; it learns from labelled rows outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out("doc_id"))
    model = fit_quality(docs.select("doc_id", "text"), labels)
    name = "_quality"
    return score(docs, model, name=name).filter(F.col(name) >= LEAST_QUALITY).select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document with the least id stays, once."""
    groups = shared_table(ngram_components(docs).select("doc_id", "component_id"), "near")
    kept = _without(docs, groups.filter("doc_id <> component_id").select("doc_id"))
    repeated = shared_table(
        groups.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated"
    )
    if repeated.isEmpty():
        return kept
    again = kept.join(broadcast_if_small(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return _without(kept, repeated).unionByName(again)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark; what counts is the text, so ids may be null or shared."""
    key = "_text_key"
    while key in docs.columns:
        key = "_" + key
    keyed = docs.withColumn(key, F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)))
    found = benchmark_overlaps(keyed.select(key, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    dropped = shared_table(found.select(key).distinct(), "dropped")
    return keyed.join(broadcast_if_small(dropped, KEY_ROWS), key, "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many whole copies of each document as the mix takes words of it, rounded; documents it passes over go."""
    sized = docs.withColumn("_size", word_count(F.col("text")))
    _, totals = mix_sources(sized.select("doc_id", "source", "_size"), size_col="_size")
    taken = (
        totals.filter("size > 0")
        .groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_words"))
        .agg(F.round(F.avg(F.col("taken") / F.col("size"))).cast("int").alias("_times"))
        .filter("_times > 0")
    )
    taken = broadcast_if_small(shared_table(taken, "taken"))
    same = (
        F.col("doc_id").eqNullSafe(F.col("_id"))
        & F.col("source").eqNullSafe(F.col("_source"))
        & (F.col("_size") == F.col("_words"))
    )
    return (
        sized.join(taken, same).withColumn("_copy", F.explode(F.expr("sequence(1, _times)"))).select(docs.columns)
    )


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot: 16 shards of nearly equal bytes, equal texts together."""
    text = F.coalesce(F.col("text"), F.lit(""))
    records = docs.withColumns({"_key": F.xxhash64(text), "_size": F.octet_length(text).cast("bigint") + 1})
    return shard_records(records, key="_key", size="_size", unit=["doc_id"]).drop("_key", "_size")
