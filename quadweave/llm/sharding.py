"""Sharding by sampled splitters: shards of nearly equal size, equal keys together.

Keys are sampled with a chance in proportion to their size; quantiles of the sample cut the key order into many more
ranges than shards. The exact size of every range is counted; overfull ranges are subdivided: keys that are
heavier than a range stand alone (in parts of half a shard, if one is heavier than a whole one), the others are
dealt to parts by their hash. Heavy keys go to the emptiest shard, largest first; ranges fill the shards in key order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges for each shard; a range is the unit of balance.
RANGES = 128
#: Expected rows of the sample for each range.
SAMPLE = 8
#: Records that are numbered together, about.
LANE_ROWS = 50_000


def _splitters(records: DataFrame, key: str, size: str, total: int, count: int, seed: int) -> np.ndarray:
    """count - 1 keys that cut a size-weighted sample evenly; the driver gets the sample, SAMPLE * count rows or so."""
    step = total / (SAMPLE * count)
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *records.columns), 11) / F.lit(float(1 << 53))
    sample = records.filter(chance * step < F.col(size)).select(key, size).toArrow()
    keys, weights = sample[key].to_numpy(), np.maximum(sample[size].to_numpy(), step)
    order = np.argsort(keys, kind="stable")
    reached = np.cumsum(weights[order])
    if not len(keys):
        return np.zeros(0, dtype=np.int64)
    cuts = np.searchsorted(reached, reached[-1] * np.arange(1, count) / count)
    return np.unique(keys[order][cuts])


def _pack(items: list[dict], shards: int) -> list[int]:
    """The shard of each item: heavy ones to the emptiest, largest first; the others in order by running size."""
    load, shard = [0] * shards, [0] * len(items)
    for i in sorted((i for i, x in enumerate(items) if x["heavy"] is not None), key=lambda i: (-items[i]["bytes"], i)):
        shard[i] = min(range(shards), key=lambda s: (load[s], s))
        load[shard[i]] += items[i]["bytes"]
    light = [i for i, x in enumerate(items) if x["heavy"] is None]
    level = (sum(load) + sum(items[i]["bytes"] for i in light)) / shards
    rooms = [max(0.0, level - x) for x in load]
    scale = sum(items[i]["bytes"] for i in light) / (sum(rooms) or 1)
    edges, reached, s = np.cumsum(rooms) * scale, 0, 0
    for i in light:
        while s < shards - 1 and reached + items[i]["bytes"] / 2 > edges[s]:
            s += 1
        shard[i] = s
        reached += items[i]["bytes"]
    return shard


def shard_records(
    records: DataFrame, *, key: str = "key", size: str = "size", unit: list[str], shards: int = 16, seed: int = 5
) -> DataFrame:
    """records with further columns shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    key: a long, never null, equal for records that belong together; size: a positive long; unit: columns that order
    records of one key. Records of one key share a shard unless they are heavier than a whole shard. Columns of records
    that are called like the results are replaced; any other names pass through. An empty table gives no rows.
    """
    records = records.drop("shard", "slot")
    mark = "_"
    while any(x.startswith(mark) for x in records.columns):
        mark += "_"
    range_, heavy_, part_, parts_, splits_ = (mark + x for x in ("range", "heavy", "part", "parts", "splits"))
    item_, lane_, lanes_, row_, offset_ = (mark + x for x in ("item", "lane", "lanes", "row", "offset"))
    narrow = records.select(*dict.fromkeys([key, size, *unit]))
    total = int(narrow.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])
    count = shards * RANGES
    cuts = _splitters(narrow, key, size, total, count, seed) if total else np.zeros(0, dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(), side="right").astype(np.int32))

    spark, full = records.sparkSession, total / count
    ranged = narrow.withColumn(range_, range_of(key))
    ranges = ranged.groupBy(range_).agg(F.sum(size).alias("bytes")).collect()  # at most count rows
    over = [(x[range_],) for x in ranges if x["bytes"] > 2 * full]
    crowded = F.broadcast(spark.createDataFrame(over, f"{range_} int"))
    heavy = (
        ranged.join(crowded, range_, "left_semi")
        .groupBy(F.col(key).alias(heavy_), range_)
        .agg(F.sum(size).alias("bytes"))
        .filter(F.col("bytes") > full)
        .collect()  # fewer than count rows, since each has more than a count-th of all bytes
    )
    whole = total / shards
    parts = [(x[heavy_], -int(-2 * x["bytes"] // whole) if x["bytes"] > whole else 1) for x in heavy]
    rest = {x[range_]: x["bytes"] for x in ranges}
    for x in heavy:
        rest[x[range_]] -= x["bytes"]
    splits = [(r, -int(-b // full)) for r, b in rest.items() if b > 2 * full]

    def tagged(frame: DataFrame) -> DataFrame:
        return (
            frame.withColumn(range_, range_of(key))
            .join(F.broadcast(spark.createDataFrame(parts, f"{heavy_} bigint, {parts_} int")), F.col(key) == F.col(heavy_), "left")
            .join(F.broadcast(spark.createDataFrame(splits, f"{range_} int, {splits_} int")), range_, "left")
            .withColumn(
                part_,
                F.when(F.col(heavy_).isNotNull(), F.pmod(F.xxhash64(F.lit(seed + 1), *unit), F.col(parts_)))
                .when(F.col(splits_).isNotNull(), F.pmod(F.xxhash64(F.lit(seed + 2), key), F.col(splits_)))
                .otherwise(F.lit(0))
                .cast("int"),
            )
            .drop(parts_, splits_)
        )

    sums = tagged(narrow).groupBy(range_, heavy_, part_).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))
    items = [x.asDict() for x in sums.orderBy(range_, F.col(heavy_).asc_nulls_first(), part_).collect()]
    for x in items:
        x["heavy"] = x[heavy_]
    chosen = [
        (x[range_], x[heavy_], x[part_], s, i, max(1, x["rows"] // LANE_ROWS))
        for i, (x, s) in enumerate(zip(items, _pack(items, shards), strict=True))
    ]
    table = F.broadcast(
        spark.createDataFrame(chosen, f"{mark}r int, {mark}h bigint, {mark}p int, shard int, {item_} int, {lanes_} int")
    )

    def dealt(frame: DataFrame) -> DataFrame:
        return (
            tagged(frame)
            .join(
                table,
                (F.col(range_) == F.col(mark + "r"))
                & F.col(heavy_).eqNullSafe(F.col(mark + "h"))
                & (F.col(part_) == F.col(mark + "p")),
            )
            .drop(range_, heavy_, part_, *(mark + x for x in "rhp"))
            .withColumn(lane_, F.pmod(F.xxhash64(F.lit(seed + 3), key, *unit), F.col(lanes_)))
            .drop(lanes_)
        )

    before = Window.partitionBy("shard").orderBy(item_, lane_).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt(narrow)
        .groupBy("shard", item_, lane_)
        .count()
        .select(item_, lane_, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(offset_))
    )
    inner = Window.partitionBy(item_, lane_).orderBy(key, *unit)
    return (
        dealt(records)
        .withColumn(row_, F.row_number().over(inner))
        .join(offsets, [item_, lane_])
        .withColumn("slot", F.col(offset_) + F.col(row_) - 1)
        .drop(item_, lane_, offset_, row_)
    )
