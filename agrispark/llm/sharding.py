"""Resharding by minimum-cost flow.

Documents lie in shards, each a set of block files. When the number or the capacities of shards change, a minimum-cost
flow from old shard sizes to new capacities says how many bytes go from where to where so that the fewest move: bytes
that stay cost nothing. The flow is carried out in blocks: whole blocks go to one shard, and the few blocks on a border are
split by rows, longest first into the part they fit, so that shards meet their capacities to within a small document.
Only blocks with rows that move are read and written again; the files of all others stay as they are.

The driver sees one row per block (``MOST_BLOCKS`` a shard at most, larger blocks beyond that) and the flow's edges.

Defined results: a null text has no bytes and the CRC of no bytes; null ids are placed by their text; equal rows are
separate rows of one block; a document longer than a shard's capacity makes its shard too large by the excess; extra
columns, whatever their names, travel along in a struct; an empty table gives an empty layout.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrispark.llm.staging import parts_for, staged

ROW_BYTES = 8
BLOCK_BYTES, LEAST_BLOCKS, MOST_BLOCKS = 32 << 20, 4, 4096
PART_BYTES = 64 << 20
OLD_SHARDS, NEW_SHARDS = 16, 24


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def cheapest_flow(
    supply: dict[int, int], capacity: dict[int, int], cost: Callable[[int, int], int] = lambda old, new: int(old != new)
) -> dict[tuple[int, int], int]:
    """Amounts (old, new) -> bytes that bring all supply within capacity at the least total cost.

    Successive cheapest paths: every path takes as much as it can, and paths may take back what an earlier one sent.
    """
    if sum(supply.values()) > sum(capacity.values()):
        raise ValueError("more supply than capacity")
    sent: dict[tuple[int, int], int] = defaultdict(int)
    left, room = dict(supply), dict(capacity)
    while any(left.values()):
        price = {("old", i): 0 for i, n in left.items() if n}
        came: dict[tuple, tuple] = {}
        queue = deque(price)
        while queue:
            at = queue.popleft()
            side, k = at
            if side == "old":
                steps = [(("new", j), cost(k, j)) for j in room]
            else:
                steps = [(("old", i), -cost(i, k)) for i in supply if sent[i, k]]
            for to, extra in steps:
                if to not in price or price[at] + extra < price[to]:
                    price[to], came[to] = price[at] + extra, at
                    queue.append(to)
        end = min((("new", j) for j, n in room.items() if n and ("new", j) in price), key=lambda v: (price[v], v[1]))
        path = [end]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:]))
        back = [sent[b[1], a[1]] for a, b in steps if a[0] == "new"]
        amount = min([left[path[0][1]], room[end[1]], *back])
        for a, b in steps:
            if a[0] == "old":
                sent[a[1], b[1]] += amount
            else:
                sent[b[1], a[1]] -= amount
        left[path[0][1]] -= amount
        room[end[1]] -= amount
    return {k: n for k, n in sent.items() if n}


def even_capacities(total: int, shards: int) -> dict[int, int]:
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def laid_out(documents: DataFrame, shards: int) -> DataFrame:
    """The documents stored in shards by hash, each in blocks: (doc, name, size, row_id, unit), a file per unit.

    ``doc`` is the whole row; ``unit`` is shard * MOST_BLOCKS + block.
    """
    spark = documents.sparkSession
    total = documents.agg(F.sum(size_of(F.col("text")))).first()[0] or 0
    blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, -(-total // (shards * BLOCK_BYTES))))
    name = F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))
    unit = F.pmod("name", F.lit(shards)) * MOST_BLOCKS + F.pmod(F.shiftright("name", 32), F.lit(blocks))
    rows = documents.select(F.struct("*").alias("doc"), size_of(F.col("text")).alias("size"), name.alias("name"))
    placed = rows.withColumn("unit", unit.cast("int")).withColumn("row_id", F.monotonically_increasing_id())
    return staged(placed.repartition(parts_for(spark, total, PART_BYTES), "unit"), "shards", "unit")


def _placements(units: list[tuple[int, int]], flow: dict[tuple[int, int], int]) -> dict[int, list[tuple[int, int]]]:
    """For every unit the shards that its bytes go to, with their number; what stays comes first in a shard."""
    out: dict[int, list[tuple[int, int]]] = {}
    for shard in {u // MOST_BLOCKS for u, _ in units}:
        goals = deque(sorted(((j, n) for (i, j), n in flow.items() if i == shard), key=lambda g: (g[0] != shard, g[0])))
        for unit, size in sorted(u for u in units if u[0] // MOST_BLOCKS == shard):
            out[unit] = []
            while size:
                to, room = goals.popleft()
                take = min(size, room)
                out[unit].append((to, take))
                size -= take
                if room > take:
                    goals.appendleft((to, room - take))
    return out


def _split(stored: DataFrame, pieces: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """(row_id, to) for the rows of units that go to several shards; a unit's rows without texts fit a task."""
    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        goals = pieces[int(frame["unit"].iloc[0])]
        shards, room = [to for to, _ in goals], [n for _, n in goals]
        frame = frame.sort_values(["size", "name", "row_id"], ascending=[False, True, True])
        to = []
        for size in frame["size"].tolist():
            k = next((i for i, n in enumerate(room) if n >= size), None)
            k = max(range(len(room)), key=room.__getitem__) if k is None else k
            room[k] -= size
            to.append(shards[k])
        return pd.DataFrame({"row_id": frame["row_id"], "to": to})

    some = stored.where(F.col("unit").isin(list(pieces))).select("unit", "size", "name", "row_id")
    return some.groupBy("unit").applyInPandas(fit, "row_id long, to int")


def resharded(stored: DataFrame, capacities: Callable[[int], dict[int, int]]) -> DataFrame:
    """The layout with new capacities (of the total size): the stored columns and ``to``, the new shard.

    Untouched units are read from the files they have; only the others are rewritten, by new shard.
    """
    sizes = [(r["unit"], r["size"]) for r in stored.groupBy("unit").agg(F.sum("size").alias("size")).collect()]  # a row per block
    supply: dict[int, int] = defaultdict(int)
    for unit, size in sizes:
        supply[unit // MOST_BLOCKS] += size
    flow = cheapest_flow(supply, capacities(sum(supply.values())))
    goals = _placements(sizes, flow)
    split = {u: g for u, g in goals.items() if len(g) > 1}
    whole = {u: g[0][0] for u, g in goals.items() if len(g) == 1 and g[0][0] != u // MOST_BLOCKS}
    stay = stored.where(~F.col("unit").isin([*split, *whole])).withColumn("to", F.shiftright("unit", MOST_BLOCKS.bit_length() - 1))
    spark = stored.sparkSession
    places = spark.createDataFrame(list(whole.items()), "unit int, to int")
    moved = stored.where(F.col("unit").isin(list(whole))).join(places, "unit")
    cut = stored.where(F.col("unit").isin(list(split))).join(_split(stored, split), "row_id") if split else None
    rewritten = moved if cut is None else moved.unionByName(cut)
    total = sum(n for u, n in sizes if u in split or u in whole)
    files = staged(rewritten.repartition(parts_for(spark, total, PART_BYTES), "to", "unit"), "rewritten", "to")
    return stay.unionByName(files)


def numbered(layout: DataFrame) -> DataFrame:
    """Adds ``slot``, gapless from 0 in every shard: units one after the other, rows by name within them."""
    earlier = Window.partitionBy("to").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    offsets = layout.groupBy("to", "unit").agg(F.count(F.lit(1)).alias("n")).select(
        "to", "unit", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")
    )
    place = F.row_number().over(Window.partitionBy("to", "unit").orderBy("name", "row_id"))
    return layout.join(offsets, ["to", "unit"]).withColumn("slot", F.col("offset") + place - 1).drop("offset")


def grown(documents: DataFrame, old: int = OLD_SHARDS, new: int = NEW_SHARDS) -> DataFrame:
    """Documents stored in ``old`` shards and resharded into ``new`` ones of equal bytes, read back from their files.

    One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard.
    """
    stored = laid_out(documents.select("doc_id", "text"), old)
    layout = resharded(stored, lambda total: even_capacities(total, new))
    read = layout.select(
        "to", "unit", "name", "row_id", F.col("doc.doc_id").alias("doc_id"), size_of(F.col("doc.text")).alias("size"),
        F.crc32(F.coalesce("doc.text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return numbered(staged(read, "placed")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("to").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.shiftright("unit", MOST_BLOCKS.bit_length() - 1).alias("old_shard"),
    )
