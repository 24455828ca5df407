"""Sharding by sampled splitters, in DataFrame functions only.

Records are ordered by (hash of the text, doc_id), so copies lie side by side, and cut into many ranges of about equal
bytes: a sample that takes keys in proportion to their size gives the splitters, as Spark's own range partitioning does
for counts. A range that comes out overfull is subdivided by a hash of the key and of the row's number, so no task holds
more than a few ranges' worth, whatever the keys, even if all rows are the same. With each range's exact bytes and rows known, a running sum inside every range gives each
record its exact place in the whole order, and shard k takes the k-th equal part of all bytes. Shards therefore differ by
at most two records' sizes, and copies stay together but for those at a shard's edge.

The text is read once: all later steps use a table of keys and sizes, some 40 bytes a row.

Defined results: a null text has no bytes and is hashed as the empty text; null doc_id sorts as the largest; rows that
repeat in doc_id and text get places of their own, in any order among themselves; an empty table gives an empty table;
other columns are ignored by assign() and kept by write().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, text_or_empty

#: Bytes that a record takes besides its text.
OVERHEAD = 16
RANGES_PER_SHARD = 32
SAMPLES_PER_RANGE = 16
#: A range beyond so many times the intended bytes is subdivided.
OVERFULL = 3


def _key(text_hash: str, doc_id: str) -> Column:
    """32 hex digits that sort as the unsigned hash, then doc_id."""
    digits = lambda c: F.lpad(F.hex(c), 16, "0")
    return F.concat(digits(F.col(text_hash)), digits(F.coalesce(F.col(doc_id).cast("long"), F.lit(-1))))


def records(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32 and the order's key of every record, and row, a number of its own: the given one, or one that holds once this is written."""
    text = text_or_empty()
    number = F.monotonically_increasing_id() if row is None else row
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"), number.alias("row"))
    return rows.select("doc_id", "size", "text_crc32", _key("hash", "doc_id").alias("key"), "row")


def splitters(keys: DataFrame, total: int, n_ranges: int) -> list[str]:
    """Up to n_ranges - 1 boundaries from a size-weighted sample of about n_ranges * SAMPLES_PER_RANGE keys, whatever the input's size."""
    rate = n_ranges * SAMPLES_PER_RANGE / total
    chance = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = keys.where(chance < F.col("size") * rate).groupBy("key").agg(F.sum(F.greatest(F.lit(1.0), F.col("size") * rate)).alias("weight"))
    upto = sample.select("key", F.sum("weight").over(Window.orderBy("key")).alias("upto"), F.sum("weight").over(Window.partitionBy()).alias("all"))
    part = F.floor(F.col("upto") * n_ranges / F.col("all"))
    cuts = upto.groupBy(part.alias("part")).agg(F.min("key").alias("key")).where(F.col("part") > 0)
    return sorted(r.key for r in cuts.collect())


def range_of(key: str, bounds: list[str]) -> Column:
    """The number of boundaries at or below the key: one step over coarse boundaries, one over the fine ones of that part."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    coarse = F.lit(bounds[::step])
    fine = F.array(*(F.lit(bounds[i : i + step]) for i in range(0, len(bounds), step)))
    below = lambda a: F.size(F.filter(a, lambda x: x <= F.col(key)))
    return F.when(below(coarse) == 0, 0).otherwise((below(coarse) - 1) * step + below(F.element_at(fine, below(coarse))))


def divided(keys: DataFrame, total: int, n_ranges: int) -> DataFrame:
    """keys with their range, and part, the share of an overfull range that they go to."""
    keys = materialize(keys.withColumn("range", range_of("key", splitters(keys, total, n_ranges) if total else [])), "ranged")
    parts = F.ceil(F.sum("size") * n_ranges / F.lit(max(total, 1)))
    parts = keys.groupBy("range").agg(F.when(F.sum("size") * n_ranges > OVERFULL * total, parts).otherwise(1).alias("parts"))
    rows = keys.join(F.broadcast(parts), "range")  # at most n_ranges rows
    return rows.withColumn("part", F.pmod(F.xxhash64("key", "row"), F.col("parts"))).drop("parts")


def placed(keys: DataFrame, n_shards: int) -> DataFrame:
    """row, doc_id, size, text_crc32, shard and slot of written records."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    n_ranges = n_shards * RANGES_PER_SHARD
    keys = divided(keys, total, n_ranges)

    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges, whose number is fixed
    offsets = keys.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    offsets = offsets.select("range", "part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "rows")))

    inside = Window.partitionBy("range", "part").orderBy("key", "size", "row")
    own = keys.select("*", F.row_number().over(inside).alias("nth"), F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    rows = own.join(F.broadcast(offsets), ["range", "part"])  # at most n_ranges + sum of parts, less than 3 * n_ranges, rows
    middle = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")
    shard = F.least(F.lit(n_shards - 1), F.floor(middle.cast("decimal(38,0)") * n_shards / F.lit(max(1, 2 * total))))
    rows = rows.select("row", "doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("place"))
    rows = materialize(rows, "placed")
    firsts = rows.groupBy("shard").agg(F.min("place").alias("first"))
    rows = rows.join(F.broadcast(firsts), "shard")  # n_shards rows
    return rows.select("row", "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def assign(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every record; the law is `bytes`."""
    rows = placed(materialize(records(docs), "keys"), n_shards)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, n_shards: int = 40, files_per_shard: int = 8) -> None:
    """Write docs as Parquet below path, one folder for each shard, with slot as a column, in the order of the slots.

    The rows are written once with a number, by which they meet their places; a shard's files are ranges of its slots, so
    no task holds a whole shard. Columns of docs named shard or slot give way to those of the shards.
    """
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    places = placed(materialize(records(rows, F.col("__row")), "keys"), n_shards).select(F.col("row").alias("__row"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    out = rows.join(places, "__row").select(*(c for c in docs.columns if c not in ("shard", "slot")), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))
    out.repartitionByRange(n_shards * files_per_shard, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
