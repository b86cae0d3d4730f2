"""Context blocks for grounded answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrispark.functions import text as tx
from agrispark.functions.numeric import fixed
from agrispark.rules import corpus as rc


def context_blocks(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row per query: context text, its sources and how many chunks it uses.

    ``ranked`` holds the few final chunks of each query, so the collected group is bounded by that number.
    """
    chunk = F.struct("rank", "source", "page", "rerank_score", "text")
    grouped = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(chunk)).alias("chunks"))

    def block(c, i):
        label = F.when(F.coalesce(c["page"], F.lit(0)) != 0, F.concat(c["source"], F.lit(", p."), c["page"].cast("string"))).otherwise(c["source"])
        return F.concat(
            F.lit("[CHUNK "), (i + 1).cast("string"), F.lit("]\nSource: "), label, F.lit("\nRelevance score: "),
            fixed(c["rerank_score"], 3), F.lit("\nContent:\n"), tx.strip(c["text"]), F.lit("\n"),
        )

    joined = queries.select("query_id", F.col("text").alias("query_text")).join(grouped, "query_id", "left")
    body = tx.strip(F.array_join(F.transform("chunks", block), "\n"))
    sources = F.array_sort(F.array_distinct(F.transform("chunks", lambda c: c["source"])))
    return joined.select(
        "query_id", "query_text", F.coalesce(body, F.lit(rc.NO_CONTEXT)).alias("context"),
        F.coalesce(sources, F.array().cast("array<string>")).alias("sources"),
        F.coalesce(F.size("chunks"), F.lit(0)).cast("long").alias("chunks_used"),
    )


def within_budget(blocks: DataFrame, context: str = "context", query: str = "query_text") -> DataFrame:
    """Context cut to the token budget; grounded means chunks were used and nothing was cut."""
    kept, truncated = tx.budget_prefix(F.col(context), F.col(query))
    out = blocks.withColumns({"_kept": kept, "truncated": truncated}).drop(context).withColumnRenamed("_kept", context)
    if "chunks_used" in blocks.columns:
        out = out.withColumn("grounded", (F.col("chunks_used") > 0) & ~F.col("truncated"))
    return out
