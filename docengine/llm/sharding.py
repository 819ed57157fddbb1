"""Sharding by jump consistent hashing (Lamping and Veach): a stable key and the number of shards decide, without a ring.

One more shard takes 1 / (n + 1) of the rows, all into itself. Slots number the rows of each shard without gaps, in the
order of the keys' hashes: counts of small hash ranges are summed up first, then each range numbers its own rows, so no
task sees a whole shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .common import free_name, materialize, maybe_broadcast

#: Rows that one numbering range holds on average.
RANGE_ROWS = 20_000


def key_hash(key: Column) -> Column:
    """A stable 64-bit hash: the first 16 hex digits of md5 of the key as text (nulls as an empty one), as a signed long."""
    hexed = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 16)
    return F.shiftleft(F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(hexed, 9, 8), 16, 10).cast("long"))


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key."""
    k, b, j = keys.astype(np.uint64), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        b[live] = j[live]
        k[live] = k[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((k[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        j[live] = ((b[live] + 1) * step).astype(np.int64)
        live = live[j[live] < shards]
    return b


def _jumped(batches: Iterator[pa.RecordBatch], shards: int, grown: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(jump(keys, shards).astype(np.int32)), pa.array(jump(keys, grown).astype(np.int32))], names=[*batch.schema.names, "shard", "grown_shard"])


def assign_shards(docs: DataFrame, id_col: str = "doc_id", shards: int = 8) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``grown_shard`` (with one shard more); no shuffle.

    Rows with equal ids share a shard; null ids count as one key. An empty table gives an empty one. Columns of ``docs``
    that have one of these names are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    kept = docs.drop("shard", "grown_shard")
    key = free_name(kept, "_key_hash")
    keyed = kept.withColumn(key, key_hash(kept[id_col]))
    schema = StructType([*keyed.schema.fields]).add("shard", IntegerType()).add("grown_shard", IntegerType())
    return keyed.mapInArrow(partial(_jumped, shards=shards, grown=shards + 1), schema).drop(key)


def number_slots(rows: DataFrame, id_col: str, tie_cols: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, ... within each shard, by the hash of the id, then the id, then ``tie_cols``.

    Hash ranges spread the ids over tasks; rows equal in id and ``tie_cols`` are spread by their hashed position in a
    Parquet copy of ``rows`` if they alone exceed a range, and are numbered in any order. A column ``slot`` is replaced; other
    columns stay, whatever their names. Null ids count as one key; an empty table gives an empty one.
    """
    hashed, part, dealt, at, start, many, place = (free_name(rows, n) for n in ("_hash", "_range", "_salt", "_at", "_start", "_parts", "_row"))
    kept = [c for c in rows.columns if c.lower() != "slot"]
    done = materialize(rows.select(*kept, key_hash(rows[id_col]).alias(hashed)), "sharded")
    total = done.count()
    bits = max(0, int(np.ceil(np.log2(max(1, total / range_rows)))))
    done = done.withColumn(part, F.shiftrightunsigned(hashed, 64 - bits).cast("long") if bits else F.lit(0).cast("long"))
    # a key with more rows than a range is dealt to several ranges by position
    sums = done.groupBy("shard", part).agg(F.count("*").alias(many))
    full = sums.filter(F.col(many) > 4 * range_rows).select("shard", part, (F.col(many) / range_rows).cast("int").alias(many))
    crowded = full.count()
    if crowded:
        done = done.select("*", F.col("_metadata.row_index").alias(place)).join(maybe_broadcast(full, crowded), ["shard", part], "left")
        done = done.withColumn(dealt, F.when(F.col(many).isNotNull(), F.pmod(F.xxhash64(place), F.col(many))).otherwise(F.lit(0)).cast("long"))
    else:
        done = done.withColumn(dealt, F.lit(0).cast("long"))
    sums = done.groupBy("shard", part, dealt).agg(F.count("*").alias(start))
    order = Window.partitionBy("shard").orderBy(part, dealt).rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(sums.withColumn(start, F.coalesce(F.sum(start).over(order), F.lit(0))), "starts")
    within = Window.partitionBy("shard", part, dealt).orderBy(hashed, id_col, *tie_cols)
    placed = done.withColumn(at, F.row_number().over(within))
    placed = placed.join(maybe_broadcast(starts, starts.count()), ["shard", part, dealt])
    return placed.select(*kept, (F.col(start) + F.col(at) - 1).cast("long").alias("slot"))
