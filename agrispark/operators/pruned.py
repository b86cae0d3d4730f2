"""Sparse search that leaves out what can't reach a query's best n: MaxScore over posting blocks.

Posting blocks are classes of chunk length, so a block's greatest term weight is close to what its postings reach. A few
rare terms of a query find first candidates, whose whole scores give the score to beat. In each block the query's terms
are then ordered by bound per posting, common terms first: those whose bounds together stay below that score can't make a
candidate alone. Only the others form pairs of chunks and queries; common terms are looked up for the candidates that may still reach the score.

Postings of the query terms are dealt by chunk once and stored in packs of chunks of one block, with numbers for terms. A
pack has all postings of its chunks, so candidates are found, looked up and ranked where it is read; only the best of
each pack and the counts of pairs are shuffled.

Scores are sums of whole units, so the result has the rows of ``retrieval.bm25_search``, ties included.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from agrispark.operators import retrieval
from agrispark.operators.retrieval import SCORE_UNITS, SparseIndex, contribution, saturation, top_n, write_once

BLOCKS_PER_OCTAVE = 4
MIXED = -1  # block of chunks whose id stands for texts of several lengths: no bound holds, every term forms pairs
LOOKUPS = 2  # rounds in which common terms are added to candidates
SEED_ROWS = 4  # candidates of rare terms that are scored in full, for each query and pack, and for each row that is asked for
PARTS_PER_CORE = 2
PACKS_PER_TASK = 32  # a task's packs come with the query terms of their blocks and may be held together
PAIRS_AT_ONCE = 1_000_000  # pairs that a task holds at once, about
NOTHING = -(1 << 62)  # score to beat where none is known


@dataclass
class PrunedSearch:
    """Best rows as in ``bm25_search``, and (query_id, step, formed): the pairs of chunk and query term that were formed."""

    rows: DataFrame
    pairs: DataFrame


def posting_block() -> Column:
    return F.floor(F.log2(F.greatest("doc_len", F.lit(1))) * F.lit(float(BLOCKS_PER_OCTAVE))).cast("int")


def impact_bounds(index: SparseIndex, path: str) -> DataFrame:
    """(term, block, most, postings): bounds of the term weights of every block, stored with the index."""
    bounds = index.postings.groupBy("term", posting_block().alias("block")).agg(
        F.max(saturation(index)).alias("most"), F.count(F.lit(1)).alias("postings")
    )
    return write_once(index.postings.sparkSession, bounds, path)


def _bound(weight: Column) -> Column:
    """The most that a term may add; a negative query weight adds nothing at best."""
    return F.greatest(contribution(weight, F.col("query_weight")), F.lit(0).cast("long"))


def _pack(rows: pa.Table) -> pa.Table:
    """Postings of some chunks -> a row per block: chunk ids in order, postings of each, their term numbers and weights."""
    named = rows["chunk_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    order = pc.array_sort_indices(named.dictionary, null_placement="at_start")
    place = np.empty(len(order), dtype=np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    chunk, length, term = place[named.indices.to_numpy()], rows["doc_len"].to_numpy(), rows["term_no"].to_numpy()
    low, high = np.full(len(order), np.iinfo(np.int64).max), np.zeros(len(order), dtype=np.int64)
    np.minimum.at(low, chunk, length)
    np.maximum.at(high, chunk, length)
    block = np.full(len(order), MIXED, dtype=np.int32)
    block[chunk] = rows["block"].to_numpy()
    block[low != high] = MIXED
    sorted_chunks = np.lexsort((np.arange(len(order)), block))
    sizes = np.bincount(chunk, minlength=len(order))[sorted_chunks].astype("<i4")
    by = np.lexsort((term, chunk, block[chunk]))
    term, weight = term[by].astype("<i8"), rows["weight"].to_numpy()[by].astype("<f8")
    cuts = np.r_[np.flatnonzero(np.diff(block[sorted_chunks], prepend=MIXED - 1)), len(order)]
    ends = np.r_[0, np.cumsum(sizes)]
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    ids = named.dictionary.take(order).take(pa.array(sorted_chunks))
    return pa.table({
        "block": pa.array(block[sorted_chunks][cuts[:-1]]),
        "chunk_ids": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), ids),
        "sizes": pa.array([sizes[a:b].tobytes() for a, b in spans], pa.binary()),
        "term_nos": pa.array([term[ends[a]:ends[b]].tobytes() for a, b in spans], pa.binary()),
        "weights": pa.array([weight[ends[a]:ends[b]].tobytes() for a, b in spans], pa.binary()),
    })


def _packs(index: SparseIndex, numbers: DataFrame, path: str) -> tuple[DataFrame, int]:
    """(block, chunk_ids, sizes, term_nos, weights): all postings of the numbered terms, by chunk, few to a task; and how many."""
    spark, kind = numbers.sparkSession, index.postings.schema["chunk_id"].dataType
    amount = int(index.chunks * index.mean_length)
    parts = max(-(-amount // retrieval.POSTINGS_PER_PART), PARTS_PER_CORE * spark.sparkContext.defaultParallelism)
    weighed = index.postings.join(numbers, "term").select(
        "chunk_id", "doc_len", posting_block().alias("block"), "term_no", saturation(index).alias("weight"),
        F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).alias("part"),
    )
    dealt = retrieval.in_parts(weighed, "part", amount, retrieval.POSTINGS_PER_PART)
    schema = StructType([
        StructField("block", IntegerType()), StructField("chunk_ids", ArrayType(kind)), StructField("sizes", BinaryType()),
        StructField("term_nos", BinaryType()), StructField("weights", BinaryType()),
    ])
    packs = write_once(spark, dealt.groupBy("part").applyInArrow(_pack, schema), f"{path}/packs")
    n = packs.count()
    return packs.repartition(min(max(-(-n // PACKS_PER_TASK), parts), retrieval.MOST_PARTS)), n


def _each(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place of all members of runs that begin at ``first``."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - (np.cumsum(count) - count)[owner] + first[owner]


def _slices(amount: np.ndarray) -> Iterator[slice]:
    """Neighbours of about ``PAIRS_AT_ONCE`` together."""
    cuts = np.flatnonzero(np.diff(np.cumsum(amount) // PAIRS_AT_ONCE)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(amount)], strict=True):
        yield slice(int(a), int(b))


def _units(weight: np.ndarray, query_weight: np.ndarray) -> np.ndarray:
    """``retrieval.contribution`` of pairs."""
    return np.floor(weight * query_weight * SCORE_UNITS + 0.5).astype(np.int64)


class _Asked:
    """Query terms as arrays in the order of queries, with the first and the number of each query's."""

    def __init__(self, entries: pa.StructArray) -> None:
        of = {f.name: entries.field(f.name).to_numpy() for f in entries.type}
        by = np.lexsort((of["term_no"], of["query_no"]))
        self.of = {name: values[by] for name, values in of.items()}
        self.queries, self.first, self.column = np.unique(self.of["query_no"], return_index=True, return_inverse=True)
        self.terms, self.term = np.unique(self.of["term_no"], return_inverse=True)

    def per_query(self, name: str, which: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.queries), dtype=np.int64)
        np.add.at(total, self.column[which], self.of[name][which])
        return total


class _Chunks:
    """A pack for the terms of some queries: postings by chunk, then term."""

    def __init__(self, batch: pa.RecordBatch, row: int, asked: _Asked) -> None:
        self.asked, self.ids = asked, batch["chunk_ids"][row].values
        sizes, term, weight = (np.frombuffer(batch[c][row].as_buffer(), t) for c, t in (("sizes", "<i4"), ("term_nos", "<i8"), ("weights", "<f8")))
        place = np.minimum(np.searchsorted(asked.terms, term), len(asked.terms) - 1)
        known = asked.terms[place] == term
        self.chunk, self.term, self.weight = np.repeat(np.arange(len(sizes)), sizes)[known], place[known], weight[known]
        self.keys = self.chunk * len(asked.terms) + self.term

    def found(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Chunk, column, units and postings of the pairs of chunk and query that the terms form, chunk by chunk."""
        some = np.flatnonzero(which)
        some = some[np.argsort(self.asked.term[some], kind="stable")]
        term, column, weight = self.asked.term[some], self.asked.column[some], self.asked.of["query_weight"][some]
        first, count = np.searchsorted(term, self.term), np.bincount(term, minlength=len(self.asked.terms))[self.term]
        width, ends = len(self.asked.queries), np.searchsorted(self.chunk, np.arange(len(self.ids) + 1))
        formed = np.r_[0, np.cumsum(count)][ends]
        for part in _slices(np.diff(formed) + width):
            of = slice(ends[part.start], ends[part.stop])
            posting, entry = _each(first[of], count[of])
            cell = (self.chunk[of][posting] - part.start) * width + column[entry]
            units, n = np.zeros((part.stop - part.start) * width, dtype=np.int64), np.bincount(cell, minlength=(part.stop - part.start) * width)
            np.add.at(units, cell, _units(self.weight[of][posting], weight[entry]))
            met = np.flatnonzero(n)
            yield met // width + part.start, met % width, units[met], n[met]

    def looked_up(self, chunk: np.ndarray, column: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units and number of the postings found, for chunks and the terms of their queries."""
        some = np.flatnonzero(which)
        term, weight, width = self.asked.term[some], self.asked.of["query_weight"][some], len(self.asked.queries)
        count = np.bincount(self.asked.column[some], minlength=width)
        first = (np.cumsum(count) - count)[column]
        units, n = np.zeros(len(chunk), dtype=np.int64), np.zeros(len(chunk), dtype=np.int64)
        if len(self.keys):
            for part in _slices(count[column]):
                owner, entry = _each(first[part], count[column][part])
                wanted = chunk[part][owner] * len(self.asked.terms) + term[entry]
                place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                hit = self.keys[place] == wanted
                np.add.at(units[part], owner[hit], _units(self.weight[place[hit]], weight[entry[hit]]))
                n[part] = np.bincount(owner[hit], minlength=part.stop - part.start)
        return units, n


def _best(column: np.ndarray, units: np.ndarray, chunk: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n of every column by units, then chunk."""
    order = np.lexsort((chunk, -units, column))
    ordered = column[order]
    return order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < n]


def _seed_scores(n: int, each: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs with query terms -> the n best whole scores per query of a task, and the pairs formed for them."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, value, formed = (np.zeros(0, dtype=np.int64) for _ in range(3))
        for batch in batches:
            for row in range(batch.num_rows):
                asked = _Asked(batch["entries"][row].values)
                chunks, every = _Chunks(batch, row, asked), np.ones(len(asked.column), dtype=bool)
                found = [np.concatenate(x) for x in zip(*chunks.found(asked.of["seed"] > 0), strict=True)]
                kept = _best(found[1], found[2], found[0], each)
                units, hits = chunks.looked_up(found[0][kept], found[1][kept], every)
                spent = np.bincount(found[1], found[3], len(asked.queries)).astype(np.int64)
                np.add.at(spent, found[1][kept], hits)
                query, value = np.r_[query, asked.queries[found[1][kept]]], np.r_[value, units]
                best = _best(query, value, np.zeros(len(query)), n)
                query, value = query[best], value[best]
                done = np.flatnonzero(spent)
                yield pa.record_batch({"query_no": asked.queries[done], "units": pa.nulls(len(done), pa.int64()), "formed": spent[done]})
        yield pa.record_batch({"query_no": query, "units": value, "formed": np.zeros(len(query), dtype=np.int64)})

    return score


def _found_best(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs with the query terms of their block -> best n chunks of every query and pack, and the pairs formed."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                asked = _Asked(batch["entries"][row].values)
                chunks, turn = _Chunks(batch, row, asked), asked.of["turn"]
                least, width = asked.of["least"][asked.first], len(asked.queries)
                spent = {step: np.zeros(width, dtype=np.int64) for step in ("essential", "common")}
                for chunk, column, units, formed in chunks.found(turn < 0):
                    np.add.at(spent["essential"], column, formed)
                    rest = asked.per_query("bound", turn >= 0)
                    for now in range(LOOKUPS):  # the greatest bounds first; who can't reach the score any more drops out
                        kept = units + rest[column] >= least[column]
                        chunk, column, units = chunk[kept], column[kept], units[kept]
                        more, hits = chunks.looked_up(chunk, column, turn == now)
                        np.add.at(spent["common"], column, hits)
                        units, rest = units + more, rest - asked.per_query("bound", turn == now)
                    kept = np.flatnonzero(units >= least[column])
                    kept = kept[_best(column[kept], units[kept], chunk[kept], n)]
                    yield pa.record_batch({
                        "query_no": asked.queries[column[kept]], "step": pa.nulls(len(kept), pa.string()), "chunk_id": chunks.ids.take(pa.array(chunk[kept])),
                        "units": units[kept], "formed": np.zeros(len(kept), dtype=np.int64),
                    })
                for step, pairs in spent.items():
                    done = np.flatnonzero(pairs)
                    yield pa.record_batch({
                        "query_no": asked.queries[done], "step": pa.array([step] * len(done), pa.string()), "chunk_id": pa.nulls(len(done), chunks.ids.type),
                        "units": np.zeros(len(done), dtype=np.int64), "formed": pairs[done],
                    })

    return search


def _asked(terms: DataFrame, keys: list[str], *columns: str) -> Iterator[DataFrame]:
    """Query terms as one array per key, in blocks of queries that are small enough to broadcast."""
    for block in retrieval.blocks_by(terms, "query_no", terms.count(), retrieval.QUERY_TERMS_PER_BLOCK):
        yield F.broadcast(block.groupBy(*keys).agg(F.collect_list(F.struct("query_no", "term_no", "query_weight", *columns)).alias("entries")))


def _to_beat(packs: DataFrame, each: int, terms: DataFrame, bounds: DataFrame, n: int, path: str) -> tuple[DataFrame, DataFrame]:
    """(query_no, least): the n-th best whole score among chunks that rare terms find, so many of each pack, and the pairs formed for it."""
    spark = terms.sparkSession
    per_term = bounds.groupBy("term_no").agg(F.max("most").alias("most"), F.sum("postings").alias("postings"))
    earlier = W.partitionBy("query_no").orderBy(F.col("bound").desc(), "term_no").rowsBetween(W.unboundedPreceding, -1)
    seeds = (
        terms.join(per_term, "term_no").withColumn("bound", _bound(F.col("most")))
        .withColumn("seed", (F.coalesce(F.sum("postings").over(earlier), F.lit(0)) < n).cast("int"))
    )
    seeds = write_once(spark, seeds, f"{path}/seeds")
    unmixed, schema = packs.where(F.col("block") != MIXED), "query_no long, units long, formed long"
    scores = [unmixed.crossJoin(asked).mapInArrow(_seed_scores(n, each), schema) for asked in _asked(seeds, [], "seed")]
    scored = write_once(spark, retrieval.union_all(scores), f"{path}/seed-scores")
    best = W.partitionBy("query_no").orderBy(F.col("units").desc())
    ranked = scored.where("units IS NOT NULL").withColumn("rank", F.row_number().over(best))
    least = ranked.where(F.col("rank") == n).select("query_no", F.col("units").alias("least"))
    return least, scored.where("formed > 0").select("query_no", F.lit("seed").alias("step"), "formed")


def pruned_search(index: SparseIndex, bounds: DataFrame, queries: DataFrame, n: int, path: str) -> PrunedSearch:
    """The best n matching chunks of every query (see ``bm25_search``), steps stored below ``path``."""
    spark = queries.sparkSession
    weighted = write_once(spark, retrieval.weighted_terms(index, retrieval.query_terms(queries)), f"{path}/weighted")
    numbers = write_once(spark, weighted.select("term").distinct().withColumn("term_no", F.monotonically_increasing_id()), f"{path}/numbers")
    names = write_once(spark, weighted.select("query_id").distinct().withColumn("query_no", F.monotonically_increasing_id()), f"{path}/names")
    named = weighted.join(names.withColumnRenamed("query_id", "_name"), F.col("query_id").eqNullSafe(F.col("_name")))
    terms = write_once(spark, named.join(numbers, "term").select("query_no", "term_no", "query_weight"), f"{path}/terms")
    bounds = write_once(spark, bounds.join(numbers, "term").drop("term"), f"{path}/bounds-asked")
    packs, count = _packs(index, numbers, path)
    least, formed = _to_beat(packs, max(SEED_ROWS, -(-SEED_ROWS * n // max(count, 1))), terms, bounds, n, path)
    low_first = W.partitionBy("query_no", "block").orderBy(F.col("bound") / F.col("postings"), "term_no").rowsBetween(W.unboundedPreceding, 0)
    below, rest = F.col("below"), F.max(F.when(F.col("below") < F.col("least"), F.col("below"))).over(W.partitionBy("query_no", "block"))
    turn = F.floor((rest - below) * LOOKUPS / F.greatest(rest, F.lit(1))).cast("int")
    by_block = (
        terms.join(bounds, "term_no").withColumn("bound", _bound(F.col("most"))).withColumn("below", F.sum("bound").over(low_first))
        .join(least, "query_no", "left").withColumn("least", F.coalesce("least", F.lit(NOTHING)))
        .select("query_no", "block", "term_no", "query_weight", "bound", "least", F.when(below >= F.col("least"), F.lit(-1)).otherwise(turn).alias("turn"))
    )
    whole = terms.join(least, "query_no", "left").select(
        "query_no", F.lit(MIXED).alias("block"), "term_no", "query_weight", F.lit(0).cast("long").alias("bound"),
        F.coalesce("least", F.lit(NOTHING)).alias("least"), F.lit(-1).alias("turn"),
    )
    planned = write_once(spark, by_block.unionByName(whole), f"{path}/blocks")
    schema = StructType([
        StructField("query_no", LongType()), StructField("step", StringType()), StructField("chunk_id", index.postings.schema["chunk_id"].dataType),
        StructField("units", LongType()), StructField("formed", LongType()),
    ])
    searched = [packs.join(asked, "block").mapInArrow(_found_best(n), schema) for asked in _asked(planned, ["block"], "bound", "least", "turn")]
    found = write_once(spark, retrieval.union_all(searched), f"{path}/found")
    best = top_n(found.where("step IS NULL").join(names, "query_no").select("query_id", "chunk_id", "units"), n, "units")
    formed = formed.unionByName(found.where("step IS NOT NULL").select("query_no", "step", "formed"))
    return PrunedSearch(
        retrieval.with_share_of_best(best), formed.join(names, "query_no").groupBy("query_id", "step").agg(F.sum("formed").alias("formed")),
    )
