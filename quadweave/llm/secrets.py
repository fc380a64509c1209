"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Patterns give candidate spans of every whole text. The hash of each candidate's value is aggregated over the
corpus: in how many different texts and under how many owners it occurs. Values that many owners share or many texts
hold are examples and placeholders; others look live. Further kinds are reported only where they look live.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.llm.common import shared_table


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: the group with the value, and its least length in characters
    group: int
    least: int
    base: bool = True
    #: what doesn't count in the value, such as line breaks in a key
    blank: str = ""


#: The body of a private key is all up to '-----END', or without that, as in a text that is cut off, what looks like one.
#: It is searched no further than the next five dashes, so headers without an end cost no more than their text.
KEY_BODY = r"((?>(?s:.*?)(?=-----))(?=-----END\x20(?:[A-Z]+\x20)?PRIVATE\x20KEY-----)|\s*+[A-Za-z0-9+/=\\\r\n]{20,})"

#: Kinds in their order. The first three are the base.
KINDS = (
    Kind("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 18),
    Kind("hex", r"[0-9a-f]{16,}", 0, 16),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30, False),
    Kind(
        "key_block",
        r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----" + KEY_BODY + r"(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----)?",
        1,
        20,
        False,
        r"\s+|\\[nr]",
    ),
    Kind("url_login", r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@]+:([^\s/:@]+)@", 1, 4, False),
)


def spans(text: Column, kind: Kind, rank: int) -> Column:
    """array<struct<start, rank, kind, end, hash>> of the matches that pass, leftmost and not overlapping.

    Matches and the pieces between them alternate, so lengths add up to places (code points).
    """
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = whole if kind.group == 0 else F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    steps = F.arrays_zip(
        F.transform(F.split(text, kind.pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(whole, lambda x: F.length(x)).alias("size"),
        value.alias("value"),
    )
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,hash:bigint,passes:boolean>>")

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        value = F.regexp_replace(x["value"], kind.blank, "") if kind.blank else x["value"]
        end = start + F.coalesce(x["size"], F.lit(0))
        row = F.struct(
            start.alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind.name).alias("kind"),
            end.alias("end"),
            F.xxhash64(F.lit(kind.name), value).alias("hash"),
            (F.length(value) >= kind.least).alias("passes"),
        )
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(row)).alias("out"))

    found = F.aggregate(steps, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")), step, lambda x: x["out"])
    kept = F.filter(found, lambda x: x["passes"])
    return F.when(text.rlike(kind.pattern), kept).otherwise(empty)


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    example_owners: int = 3,
    example_texts: int = 10,
) -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    spans lists kind:start:end of all spans by start, then kind; base spans always, further kinds if fewer than
    ``example_owners`` owners have the value and fewer than ``example_texts`` different texts hold it. n_live and n_example
    count all candidates by that test. A null text is empty and has none; a null owner is one owner. Repeated rows come
    back as often; copies of a text count once; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.array_sort(F.concat(*(spans(text, kind, i) for i, kind in enumerate(KINDS))))
    base = sum(kind.base for kind in KINDS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(owner_col).alias("owner"), F.xxhash64(text).alias("text_hash"), found.alias("found"))
    listed = F.filter("found", lambda x: x["rank"] < base)

    def count(rank: int) -> Column:
        return F.size(F.filter("found", lambda x: x["rank"] == rank)).cast("bigint")

    rows = rows.select(
        "id",
        "owner",
        "found",
        *(count(i).alias(f"n_{kind.name}") for i, kind in enumerate(KINDS) if kind.base),
        F.sha2(_joined(listed), 256).alias("base_sha256"),
        F.when(F.size("found") > 0, F.sha2(F.to_json("found"), 256)).alias("key"),
        "text_hash",
    )
    rows = shared_table(rows, "candidates")
    used = (
        rows.select("text_hash", F.coalesce("owner", F.lit("")).alias("owner"), F.explode("found.hash").alias("hash"))
        .groupBy("hash")
        .agg(F.count_distinct("owner").alias("owners"), F.count_distinct("text_hash").alias("texts"))
    )
    # the outcome of a row follows from its candidates alone, so equal lists are looked up once
    lists = rows.filter("key IS NOT NULL").groupBy("key").agg(F.first("found").alias("found"))
    live = (F.col("owners") < example_owners) & (F.col("texts") < example_texts)
    looked = (
        lists.select("key", F.explode("found").alias("x"))
        .select("key", "x", F.col("x.hash").alias("hash"))
        .join(used, "hash")
        .groupBy("key")
        .agg(
            F.array_sort(F.collect_list(F.when((F.col("x.rank") < base) | live, F.col("x")))).alias("kept"),
            F.count_if(live).alias("n_live"),
            F.count_if(~live).alias("n_example"),
        )
        .select("key", _joined(F.col("kept")).alias("spans"), "n_live", "n_example")
    )
    # rows without candidates have no key; they would meet in one task
    none = rows.filter("key IS NULL").withColumns(
        {"spans": F.lit(""), "n_live": F.lit(0).cast("bigint"), "n_example": F.lit(0).cast("bigint")}
    )
    joined = rows.filter("key IS NOT NULL").join(looked, "key", "left").unionByName(none)
    return joined.select(
        F.col("id").alias(id_col),
        *(f"n_{kind.name}" for kind in KINDS if kind.base),
        "base_sha256",
        F.coalesce("spans", F.lit("")).alias("spans"),
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_live", "n_example")),
    )
