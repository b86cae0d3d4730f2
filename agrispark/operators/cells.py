"""Dense search over an inverted file: vectors stored by the cell of their nearest coarse centre.

A query is compared with the vectors of its nearest cells only. Each cell keeps the widest angle between its centre and
its members, so the best likeness that any member can have to a query is known: an exact search goes on with the cells
that may still beat the worst row found so far. All vectors are indexed; only the centres are fitted on a sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrispark.operators.retrieval import GRID, best_per_query, dense_search, likeness, top_n, write_once

SAMPLE_ROWS = 100_000  # vectors at most, about, that the centres are fitted on
SAMPLE_QUERIES = 256  # stored vectors at most, about, that are searched exactly to find out how many cells to probe
MOST_CELLS = 4_096
BLOCK_ROWS = 2_048  # vectors of a cell, and queries, that meet in one matrix product
SLACK = 1e-6  # radians; more than vectors move when they are laid on the grid


@dataclass
class CellIndex:
    """``vectors`` (chunk_id, embedding) partitioned by cell, ``cells`` (cell, widest, rows), and the unit centres."""

    vectors: DataFrame
    cells: DataFrame
    centres: np.ndarray


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


def fit_centres(vectors: DataFrame, cells: int | None = None, seed: int = 1) -> np.ndarray:
    """Unit centres from at most about ``SAMPLE_ROWS`` vectors, chosen by a hash of their ids; by default as many as the
    square root of the number of vectors, up to ``MOST_CELLS``."""
    rows = vectors.count()
    every = max(1, -(-rows // SAMPLE_ROWS))
    sample = vectors.where(F.pmod(F.xxhash64("chunk_id"), F.lit(every)) == 0).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    k = min(cells or max(1, round(rows**0.5)), MOST_CELLS, max(1, rows // every))
    if rows == 0 or k < 2:
        return np.zeros((1, len((vectors.select("embedding").first() or [[0.0]])[0])))
    return _unit(np.array(KMeans(k=k, seed=seed, maxIter=10).fit(sample).clusterCenters()))


def _angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centres.T, -1.0, 1.0))


def build_cells(vectors: DataFrame, path: str, centres: np.ndarray) -> CellIndex:
    """Every vector stored below ``path`` in the partition of its nearest centre, with the angle to it."""
    spark = vectors.sparkSession
    kind = vectors.schema["chunk_id"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                away = _angles(np.stack(batch["embedding"]).astype("<f8"), centres)
                cell = away.argmin(1)
                yield batch.assign(cell=cell.astype("int32"), angle=away[np.arange(len(cell)), cell])

    placed = vectors.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInPandas(
        place, f"chunk_id {kind}, embedding array<double>, cell int, angle double"
    )
    placed.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/vectors")
    cells = stored.groupBy("cell").agg(F.max("angle").alias("widest"), F.count(F.lit(1)).alias("rows"))
    return CellIndex(stored.select("chunk_id", "embedding", "cell"), write_once(spark, cells, f"{path}/cells"), centres)


def _probes(index: CellIndex, queries: DataFrame) -> DataFrame:
    """(query_id, embedding, cell, best, turn): every filled cell of a query, the most its members can be like, and its
    place by the distance of the centres."""
    widest = {r["cell"]: r["widest"] for r in index.cells.collect()}  # a row for each of MOST_CELLS cells at most
    filled = np.array(sorted(widest), dtype="int32")
    centres, reach = index.centres[filled], np.array([widest[c] for c in filled])
    kind = queries.schema["query_id"].dataType.simpleString()

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) and len(filled):
                away = _angles(np.stack(batch["embedding"]).astype("<f8"), centres)
                order = np.argsort(away, axis=1, kind="stable")
                best = (1.0 + np.cos(np.maximum(0.0, np.take_along_axis(away - reach, order, 1) - SLACK))) / 2.0
                yield pd.DataFrame({
                    "query_id": np.repeat(batch["query_id"].to_numpy(), len(filled)), "cell": filled[order].ravel(),
                    "best": best.ravel(), "turn": np.tile(np.arange(len(filled), dtype="int32"), len(batch)),
                })

    return queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInPandas(
        near, f"query_id {kind}, cell int, best double, turn int"
    )


def _packed(rows: DataFrame, name: str) -> DataFrame:
    """Blocks of the vectors of one cell: (cell, <name>s, <name>_vectors)."""
    kind = rows.schema[name].dataType.simpleString()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell, part in batch.groupby("cell", sort=False):
                for start in range(0, len(part), BLOCK_ROWS):
                    some = part.iloc[start:start + BLOCK_ROWS]
                    matrix = np.floor(np.stack(some["embedding"]).astype("<f8") * GRID + 0.5)
                    yield pd.DataFrame({"cell": [cell], f"{name}s": [some[name].to_numpy()], f"{name}_vectors": [matrix.tobytes()]})

    return rows.select("cell", name, "embedding").mapInPandas(pack, f"cell int, {name}s array<{kind}>, {name}_vectors binary")


def _compared(index: CellIndex, queries: DataFrame, probes: DataFrame, n: int) -> DataFrame:
    """The best n of the probed cells for every query: cells' blocks meet the blocks of the queries that probe them."""
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).join(probes.select("query_id", "cell"), "query_id")
    asked = asked.repartition("cell").sortWithinPartitions("cell")
    met = _packed(index.vectors, "chunk_id").join(_packed(asked, "query_id"), "cell")
    id_type, query_type = (f.schema[c].dataType.simpleString() for f, c in ((index.vectors, "chunk_id"), (queries, "query_id")))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, matrix, names, wanted in batch[["chunk_ids", "chunk_id_vectors", "query_ids", "query_id_vectors"]].itertuples(index=False):
                scores = likeness(np.frombuffer(matrix, "<f8").reshape(len(ids), -1), np.frombuffer(wanted, "<f8").reshape(len(names), -1))
                col, found, value = best_per_query(scores, np.asarray(ids), n)
                yield pd.DataFrame({"query_id": np.asarray(names)[col], "chunk_id": found, "dense_score": value})

    return top_n(met.mapInPandas(nearest, f"query_id {query_type}, chunk_id {id_type}, dense_score double"), n, "dense_score")


def enough_probes(index: CellIndex, n: int, recall: float = 0.95) -> int:
    """The fewest cells to probe so that a sample of stored vectors finds that share of its nearest n."""
    every = max(1, index.cells.agg(F.sum("rows")).first()[0] // SAMPLE_QUERIES)
    sample = index.vectors.where(F.pmod(F.xxhash64("chunk_id", F.lit(1)), F.lit(every)) == 0).select(F.col("chunk_id").alias("query_id"), "embedding")
    nearest = dense_search(index.vectors.select("chunk_id", "embedding"), sample, n).select("query_id", "chunk_id")
    turns = nearest.join(index.vectors.select("chunk_id", "cell"), "chunk_id").join(_probes(index, sample), ["query_id", "cell"])
    hits = sorted(turns.groupBy("turn").agg(F.count(F.lit(1)).alias("hits")).collect())  # a row for each cell at most
    found, wanted = 0, recall * sum(r["hits"] for r in hits)
    for r in hits:
        found += r["hits"]
        if found >= wanted:
            return r["turn"] + 1
    return 1


def cell_search(index: CellIndex, queries: DataFrame, n: int, probes: int, path: str, exact: bool = False) -> DataFrame:
    """(query_id, chunk_id, dense_score, rank): the nearest n vectors in each query's ``probes`` nearest cells.

    With ``exact``, cells whose members may be as near as the n-th row found are searched as well, which gives the rows
    of ``retrieval.dense_search``. Both sides have unit length.
    """
    spark = queries.sparkSession
    every = write_once(spark, _probes(index, queries), f"{path}/probes")
    first = write_once(spark, _compared(index, queries, every.where(F.col("turn") < probes), n), f"{path}/first")
    if not exact:
        return first
    worst = first.groupBy("query_id").agg(F.min("dense_score").alias("worst"), F.count(F.lit(1)).alias("held"))
    more = every.where(F.col("turn") >= probes).join(worst, "query_id", "left").where(
        f"worst IS NULL OR held < {n} OR best >= worst"
    )
    rest = _compared(index, queries, more, n)
    return top_n(first.drop("rank").unionByName(rest.drop("rank")), n, "dense_score")
