"""Mixing sources to target weights by weighted fair queueing.

Every source serves its documents in a shuffled order, up to ``passes`` times. A document's virtual finish time is the
number of its source's tokens served up to and including it, divided by the source's weight. Sorting all documents by
that time and truncating at the total budget gives every source its share; what a source that runs dry leaves over goes
to the others by weight, without any further rule.

Running totals are two-level: rows are range-partitioned on their sort key, summed within partitions, and only the
partitions' totals are added up, so neither a hot source nor the global order meets in one task.

Defined results: null and empty texts have size 0 and are never taken; a null source is a source of its own, last in
order; repeated rows are separate documents; extra columns pass through ``mixed_documents``; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrispark.llm.staging import parts_for, staged

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
PASSES = 2
ROWS_PER_PART = 250_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffle_key() -> Column:
    """What the shuffled order of documents goes by: a hash of id and text that any engine can compute."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, passes: int = PASSES
) -> DataFrame:
    """(source, source_size) -> the same with weight and target: the budget shared by weight, no more than
    ``passes`` times a source's size, the excess shared again by weight until no source is above.

    Sources by rising ratio of limit to weight are full first; the level of the rest follows from running sums.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    filled = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    limit = F.col("source_size") * F.lit(float(passes))
    levels = (
        sizes.withColumn("place", F.row_number().over(ordered) - 1)
        .withColumn("weight", pick)
        .withColumn("ratio", limit / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum(limit).over(filled), F.lit(0.0)))
        .withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
        .withColumn("level", F.col("rest") / F.col("rest_weight"))
        .withColumn("level", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything))
    )
    target = F.least(limit, F.coalesce(F.col("weight") * F.col("level"), limit))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def _running(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, parts: int) -> DataFrame:
    """Adds the running total of ``value`` in ``order`` within ``keys``, over range partitions of (keys, order)."""
    placed = staged(
        rows.repartitionByRange(parts, *keys, *order).withColumn("part", F.spark_partition_id()), f"{name}-ranges"
    )
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("part", *keys).agg(F.sum(value).alias("amount"))
        .withColumn("offset", F.coalesce(F.sum("amount").over(before), F.lit(0))).drop("amount")
    )
    within = Window.partitionBy("part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn(name, F.sum(value).over(within))
        .join(offsets, ["part", *keys])
        .withColumn(name, F.col(name) + F.col("offset")).drop("part", "offset")
    )


def mix(
    documents: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, passes: int = PASSES
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, times (passes taken), taken (words taken)."""
    spark = documents.sparkSession
    sized = staged(
        documents.select(
            "doc_id", n_words(F.col("text")).alias("size"), F.coalesce(F.col("source"), F.lit("")).alias("name"),
            F.col("source").isNull().alias("unnamed"), shuffle_key().alias("shuffled"),
        ).withColumn("row", F.monotonically_increasing_id()), "mix-sizes",
    )
    per_source = sized.groupBy("name", "unnamed").agg(F.sum("size").alias("source_size"))
    targets = source_targets(
        per_source.select(F.when(~F.col("unnamed"), F.col("name")).alias("source"), "source_size"), weights, budget, passes
    ).select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed"), "source_size", "weight", "target")
    parts = parts_for(spark, sized.count() * passes, ROWS_PER_PART)
    order = ["shuffled", "doc_id", "size"]
    served = _running(sized, ["name", "unnamed"], order, "size", "served", parts).join(targets, ["name", "unnamed"])
    copies = served.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).select(
        "row", "doc_id", "name", "unnamed", "shuffled", "size", "source_size", "target", "served", "pass",
        ((F.col("served") + F.col("pass") * F.col("source_size")) / F.col("weight")).alias("finish"),
    )
    queued = _running(
        copies, [], ["finish", "name", "unnamed", "pass", *order, "served"], "size", "queued", parts
    )
    total = (sized.agg(F.sum("size")).first()[0] or 0) * float(budget)
    return (
        queued.withColumn("took", (F.col("queued") <= F.lit(total)) & (F.col("size") > 0))
        .groupBy("row", "doc_id", "shuffled", "name", "unnamed", "size", "source_size", "target")
        .agg(F.sum(F.col("took").cast("long")).alias("times"))
        .select(
            "doc_id", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"),
            "shuffled", F.when(~F.col("unnamed"), F.col("name")).alias("source"),
        )
    )


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns; a document taken twice is there twice.

    Rows with the same doc_id, source and text share one decision, that of the most taken of them.
    """
    times = (
        mix(documents, **options).filter("times > 0")
        .groupBy(F.col("doc_id").alias("_id"), F.col("shuffled").alias("_key"), F.col("source").alias("_source"))
        .agg(F.max("times").alias("_times"))
    )
    rows = documents.select(F.struct("*").alias("row"), shuffle_key().alias("key"))
    match = F.col("row.doc_id").eqNullSafe(F.col("_id")) & F.col("row.source").eqNullSafe(F.col("_source")) & (F.col("key") == F.col("_key"))
    taken = rows.join(times, match).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
    return taken.select("row.*")
