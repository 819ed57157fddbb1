"""Mixing sources to target weights.

Sizes are summed by source; targets come from weights and a budget, no source beyond ``most`` times its own size (what
is above goes to the others by weight); a source's repetition rate is target / size. Each document is then emitted
floor(rate) times, plus once more if a hash of its id, seeded, falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, free_name, materialize, maybe_broadcast

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def chance(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 32 bits of md5(seed:key); null keys share one."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def water_fill(sources: DataFrame, budget: float, most: float) -> DataFrame:
    """(source, source_size, weight) with ``target``: shares of budget * all sizes by weight, none above most * its size.

    Sources are filled in the order of their cap per weight. Those before the first whose cap exceeds its share of what the
    earlier ones left are capped; the rest share that remainder by weight. The level there is the highest of all levels
    that a cap exceeds. One row a source: a table of sources, not of documents, is ordered here.
    """
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    x = sources.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    x = x.withColumn("left", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    x = x.withColumn("level", F.col("left") / F.sum("weight").over(rest))
    x = x.withColumn("free", F.max(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("level"))).over(Window.partitionBy()))
    return x.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * F.col("free"), F.col("cap")))).select("source", "source_size", "weight", "target")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (0 or more), one row for each row of ``docs``.

    Sources by code point, null last, take the weights in turn. A null or empty text has size 0, and a source of size 0
    has target 0; its documents are emitted no time. Rows with equal ids have equal chances. An empty table gives an empty
    one. Columns of ``docs`` that have one of these names are replaced.
    """
    made = ["size", "source_size", "target", "copies"]
    sized = docs.drop(*made).withColumn("size", word_count(docs[text_col]))
    key = free_name(sized, "_source")
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (((F.row_number().over(ranked) - 1) % len(weights)) + 1).cast("int"))
    sources = sized.groupBy(sized[source_col].alias("source")).agg(F.sum("size").alias("source_size")).withColumn("weight", turn)
    rates = materialize(water_fill(sources, budget, most).select(F.col("source").alias(key), "source_size", "target"), "rates")
    # a source is a short name, so the counted rows bound the bytes; beyond the bound a shuffled join takes over, where adaptive execution splits hot sources
    joined = sized.join(maybe_broadcast(rates, rates.limit(BROADCAST_ROWS + 1).count()), sized[source_col].eqNullSafe(F.col(key)), "left").drop(key)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (chance(joined[id_col], seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", F.floor(rate).cast("long") + extra)


def emit_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of ``mix_sources`` ``copies`` times, with the named columns."""
    times = free_name(mixed, "_time")
    return mixed.filter("copies > 0").withColumn(times, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)
