"""Shared helpers of the training-data operators: work folder, materialised steps, bounded broadcasts."""

from __future__ import annotations

import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow key table up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 400_000
#: Bits of a broadcast Bloom filter (half a MB of bits, some 2 MB as a hash table).
BLOOM_BITS = 1 << 22


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where none is named, a temporary one is set if driver and executors
    are one process; on a cluster that is an error, as its machines don't share such a folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="docengine-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared work folder and read it back: lineage ends here and survives lost executors."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def drop_step(df: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for ``df``, once nothing reads it any more.

    The driver's collector is asked too: Spark removes the shuffle files of finished jobs when their plans are collected.
    """
    if df is not None and getattr(df, "written", None):
        spark = df.sparkSession
        gc.collect()
        spark._jvm.System.gc()
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        df.written = None


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the counted rows are within the bound."""
    return F.broadcast(df) if rows <= limit else df


def maybe_wanted(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str, name: str) -> DataFrame:
    """``df`` with a column ``name``: whether the row's key may be among the wanted ones (always if it is, else by chance).

    A Bloom filter of ``BLOOM_BITS`` bits is broadcast, whose size does not depend on the data.
    """
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit(BLOOM_BITS - 1))
    word, bit = free_name(df, "_word"), free_name(df, "_bit")
    bits = wanted.select(place(wanted[wanted_key]).alias("at")).selectExpr(f"at >> 6 AS {word}", f"shiftleft(1L, cast(at & 63 AS int)) AS {bit}")
    bits = bits.groupBy(word).agg(F.bit_or(bit).alias(bit))  # at most BLOOM_BITS / 64 rows
    own = place(df[key])
    one = F.call_function("shiftleft", F.lit(1).cast("long"), own.bitwiseAND(F.lit(63)).cast("int"))
    seen = df.join(F.broadcast(bits), F.shiftright(own, 6) == bits[word], "left")
    return seen.select(*[df[c] for c in df.columns], F.coalesce(bits[bit].bitwiseAND(one) != 0, F.lit(False)).alias(name))


def only_rows(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows of ``df`` that ``maybe_wanted`` lets through."""
    name = free_name(df, "_may")
    return maybe_wanted(df, key, wanted, wanted_key, name).filter(name).drop(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have yet (names are compared without case)."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted = "_" + wanted
    return wanted


def text_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The named string column, nulls as empty texts."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without copying."""
    n = len(texts)
    bufs = texts.buffers()
    off = np.frombuffer(bufs[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def process_cache() -> dict:
    """What a worker process keeps from task to task; functions travel by value, so their modules can't hold it."""
    return sys.__dict__.setdefault("_docengine_kept", {})


def row_blocks(texts: pa.Array, most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes at a time; a longer text is a range of its own."""
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b
