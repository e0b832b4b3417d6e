"""Mixing sources to target weights.

Sizes are summed per source, targets derived from the weights, and every document is
emitted floor(rate) times plus one more time by a coin whose probability is the
fraction of its source's rate. The coin is a hash of seed, id and text.

* NULL text and text without a word: size 0; it is emitted by the same rule.
* NULL source: a source of its own, the last in order.
* Equal rows share their coin, so reruns and repeated rows agree.
* A source without words has target 0 and rate 0; an empty table gives no rows.
* Only doc_id, text and source are used; other columns stay in ``mix`` as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from themeloom.llm.common import bounded_broadcast, fresh, spaced_words
from themeloom.operators.storage import written


@dataclass(frozen=True)
class MixPlan:
    weights: tuple[float, ...] = (5, 2, 1)
    total_share: float = 1.5
    max_rate: float = 2.0
    seed: int = 42


def source_ranks(sources: DataFrame) -> DataFrame:
    """Position of each source by code point, NULL last, without one task for all."""
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    placed = written(
        sources.repartitionByRange(parts, order)
        .sortWithinPartitions(order)
        .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    )
    # one row per partition of the step above
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = starts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rank = F.col("_at") - F.col("_first") + F.col("_before")
    return placed.join(F.broadcast(starts), "_part").withColumn("rank", rank).drop(*starts.columns, "_at")


def source_targets(sizes: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """source, source_size, target of a table (source, size), one row per source.

    Shares go by weight; a source whose share is above its limit stays at the limit
    and the rest is shared anew. Each round is one aggregate over the sources.
    """
    totals = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(
        F.array(*(F.lit(float(w)) for w in plan.weights)), (F.col("rank") % len(plan.weights) + 1).cast("int")
    )
    table = written(
        source_ranks(totals).select(
            "source", "source_size", weight.alias("weight"), (F.col("source_size") * plan.max_rate).alias("limit")
        )
    )
    everything = table.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        over = F.col("limit") < level * F.col("weight")
        held, open_weight, n = table.agg(
            F.coalesce(F.sum(F.when(over, F.col("limit"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
            F.count_if(over),
        ).first()
        if n == stopped or not open_weight:
            break
        stopped, level = n, (plan.total_share * everything - held) / open_weight
    return table.select(
        "source", "source_size", F.least("limit", level * F.col("weight")).alias("target")
    )


def coin(seed: int, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from 52 bits of a digest of seed, id and text."""
    told = F.concat(
        F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))
    )
    return F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("double") / float(1 << 52)


def copies(docs: DataFrame, plan: MixPlan = MixPlan(), kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``kept`` columns with _size, _source_size, _target and _copies of each document."""
    size = F.size(spaced_words(F.col("text"))).cast("long")
    sized = docs.select(
        *kept, F.col("source").alias("_source"), size.alias("_size"), coin(plan.seed, F.col("doc_id"), F.col("text")).alias("_coin")
    )
    targets = written(
        source_targets(sized.select(F.col("_source").alias("source"), F.col("_size").alias("size")), plan)
        .select(F.col("source").alias("_of"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    )
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    number = F.floor(rate) + (F.col("_coin") < rate - F.floor(rate)).cast("long")
    joined = sized.join(bounded_broadcast(targets), F.col("_source").eqNullSafe(F.col("_of")), "left")
    return joined.select(*kept, "_size", "_source_size", "_target", number.alias("_copies"))


def mix_report(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """Words that the mix takes of every document."""
    return copies(docs, plan).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )


def mix(docs: DataFrame, plan: MixPlan = MixPlan(), copy_no: str = "copy_no") -> DataFrame:
    """The mixed documents: all columns, one row per copy, numbered from 1."""
    whole = fresh(docs, "_row")
    packed = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias(whole))
    many = copies(packed, plan, (whole,)).where("_copies > 0")
    return many.select(
        F.col(f"{whole}.*"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias(fresh(docs, copy_no)),
    )
