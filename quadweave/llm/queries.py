"""One query for each operator over the driver's tables, with SQL where it says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.llm.collocations import collocations
from quadweave.llm.common import shared_table
from quadweave.llm.decontaminate import benchmark_overlaps
from quadweave.llm.fingerprint import edited_fingerprints
from quadweave.llm.line_dedup import dedup_lines
from quadweave.llm.minmax import near_duplicates
from quadweave.llm.mixing import mix_sources, word_count
from quadweave.llm.ngram_join import ngram_components
from quadweave.llm.quality import fit_quality, held_out, score
from quadweave.llm.secrets import scan_secrets
from quadweave.llm.sharding import shard_records
from quadweave.llm.url_filter import url_verdicts
from quadweave.llm.warc import archive_folder, read_records, write_archives
from quadweave.llm.whitening import whitened_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def near_duplicate_sql(words: int, numerator: int, denominator: int, kept: bool) -> str:
    """Jaccard links on word shingles and their components; on a small table (every pair that shares a shingle is counted)."""
    return rf"""
    WITH RECURSIVE d AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM documents),
    s AS (
      SELECT DISTINCT r, hash(array_to_string(g, ' ')) AS g FROM (
        SELECT r, w[i : i + {words} - 1] AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {words} + 1, 1) + 1)) AS i FROM d WHERE len(w) > 0))),
    n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
    pairs AS (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY ALL),
    links AS (
      SELECT a, b FROM pairs JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE {denominator} * shared >= {numerator} * (x.n + y.n - shared)),
    reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
    c AS (SELECT reach.a AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id{", doc_id = component_id AS kept" if kept else ""}
    FROM d JOIN c USING (r) LEFT JOIN n USING (r)
    """


#: The rules of the URL query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@query(
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
    f AS (SELECT d, max(page_id) AS first FROM p GROUP BY d)
    SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
      array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform(range(0, 4), lambda j:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          CAST((CAST('0x' || substr(p.d, CAST(5 * i + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * j AS INT)) & 31 AS INT) + 1, 1)), '')), '')
        AS payload_digest,
      CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
    FROM p JOIN f USING (d)
    """
)
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages")
    archives = archive_folder(pages)
    index = write_archives(pages, archives)
    return read_records(index, archives).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query()
def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, and where."""
    return benchmark_overlaps(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query()
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_lines(read(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", "n_near", F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))


@query()
def op4_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    _, totals = mix_sources(docs)
    return totals.select("doc_id", "size", "source_size", "target", "taken", "source")


@query()
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_verdicts(read(spark, folder, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "template")


@query()
def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(read(spark, folder, "documents"))


@query()
def op7_document_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return edited_fingerprints(read(spark, folder, "documents"))


@query()
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read(spark, folder, "documents").select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    dealt = shard_records(shared_table(docs, "keys"), unit=["doc_id"])
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op9_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return ngram_components(docs, words=3, similarity=(9, 10)).select("doc_id", "n_shingles", "component_id", "class_id")


@query()
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    labels = read(spark, folder, "labels").filter(~held_out("doc_id"))
    scored = score(docs, fit_quality(docs, labels))
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@query()
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector along the components of all vectors' covariance, at unit variance; signs are arbitrary, so there is no SQL."""
    return whitened_vectors(read(spark, folder, "embeddings"))


@query(near_duplicate_sql(words=2, numerator=80, denominator=100, kept=True))
def op12_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the least id that near-duplicates of them lead to; all rows of a table without near-duplicates are kept."""
    return near_duplicates(read(spark, folder, "documents"))


@query(
    """
    WITH p AS (
      SELECT row_number() OVER () AS piece, lang, w FROM (
        SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
          SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
          FROM documents))
      WHERE len(w) > 0),
    g AS (
      SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
      FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS sizes(m))),
    f AS (SELECT lang, m, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
    size AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
    candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
    longer AS (
      SELECT lang, phrase, max(a) AS most FROM (
        SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE m = 3)
      GROUP BY ALL),
    cuts AS (
      SELECT c.lang, c.phrase, c.a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS rest
      FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c LEFT JOIN longer USING (lang, phrase)
      WHERE most IS NULL OR 100 * most < 50 * c.a),
    scored AS (
      SELECT cuts.lang, cuts.phrase, a, k, h.f AS l, r.f AS r, 1000000::HUGEINT * a * a // (h.f * r.f) AS score
      FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f r ON r.lang = cuts.lang AND r.phrase = rest),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
      CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
    FROM lowest JOIN size USING (lang) QUALIFY rank <= 2000
    """
)
def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """Each language's 2000 phrases of two and three words that hold together best."""
    return collocations(read(spark, folder, "documents"))
