"""Near-duplicate documents: circulant MinHash, banding, and exact verification on full shingle sets.

Documents with equal sets are one node from the start, named by its smallest doc_id; only distinct sets are compared.
With 28 bands of 4 rows, two sets of Jaccard similarity 0.8 share no bucket with probability 4e-7; that the estimate
below excludes them has probability 8e-7 (112 independent coordinates).

No bucket's pairs are all formed. First every member of a bucket meets the bucket's smallest member; what the exact check
confirms is merged. Where a bucket still holds several components, its members of different components are compared by
short signatures, block by block; whoever might be similar to some member of another component is then checked exactly
against all of it, also in blocks. A signature estimate below ``ESTIMATE`` excludes a similarity of 0.8 by more than five
standard deviations. Blocks bound the memory of a task; they drop nothing.

Defined results: a null or empty text has an empty set and stays by itself; rows without a doc_id are compared with
nothing, have no component and are not dropped; rows that repeat a doc_id are separate documents of that name; extra columns pass
through ``without_copies``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrispark.llm.components import components
from agrispark.llm.shingles import HASHES, bands, set_id, shingle_set, signature, similar
from agrispark.llm.staging import staged
from agrispark.llm.words import WordHashes, texts_of

ESTIMATE = 0.6  # share of equal coordinates from which a pair is checked exactly
BUCKET_BLOCK = 2048  # members of a bucket compared in one task
CHECK_BLOCK = 256  # sets of a block, checked against those of another
CHECK_PACK = 2048  # sets that travel together


def _shingled(batches: Iterator[pa.RecordBatch], size: int):
    """Rows' other columns and shingle sets, some documents at a time."""
    hashes = WordHashes(seed=3, lower=True)
    for batch in batches:
        for at in range(0, len(batch), 500):
            rows = batch.slice(at, 500)
            data, offsets = texts_of(rows["text"])
            words, first = hashes.of(data, offsets)
            yield rows, [shingle_set(words[i:j], size) for i, j in zip(first[:-1], first[1:])]


def signatures(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_id, bands and the signature's low bytes of every document."""
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _shingled(batches, size):
            signs = [signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                rows["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.binary()),
                pa.array([None if s is None else bands(s).view(np.int64).tolist() for s in signs], pa.list_(pa.int64())),
                pa.array([None if s is None else (s & np.uint32(255)).astype(np.uint8).tobytes() for s in signs], pa.binary()),
            ], ["doc_id", "n_shingles", "set_id", "bands", "sign"])

    return _plain(documents).mapInArrow(signed, "doc_id long, n_shingles long, set_id binary, bands array<long>, sign binary")


def _plain(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _sets_of(documents: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the documents that ``nodes`` name."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _shingled(batches, size):
            yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    wanted = _plain(documents).join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    return wanted.mapInArrow(listed, "node long, shingles binary")


def _agreeing(a: bytes, b: bytes) -> float:
    return float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow the similarity."""
    @F.pandas_udf("double")
    def agreement(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_agreeing(p, q) for p, q in zip(x, y)], dtype=float)

    sized = F.lit(percent) * F.greatest("n_a", "n_b") <= F.lit(100) * F.least("n_a", "n_b")
    return pairs.filter(sized).filter(agreement("sign_a", "sign_b") >= ESTIMATE)


def _similar_pairs(a: pd.DataFrame, b: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """For every node of ``a`` one member of ``b``, if any, with a similar set."""
    members = [np.frombuffer(s, np.uint64) for s in b["shingles_"]]
    names, sizes = b["node_"].to_numpy(), np.array([len(m) for m in members])
    owner, values = np.repeat(np.arange(len(members)), sizes), np.concatenate(members)
    if len(members) > 1:
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
    found = []
    for node, data in zip(a["node"].to_numpy(), a["shingles"]):
        own = np.frombuffer(data, np.uint64)
        lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(members))
        ok = (100 * both >= percent * (len(own) + sizes - both)) & (names != node)
        if ok.any():
            found.append((int(node), int(names[ok.argmax()])))
    return found


def _confirmed(tests: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the nodes and groups of ``tests`` (node, group): one for each block of a group that holds a
    similar member. ``groups`` has (group, member). Both sides of a group are dealt into blocks, and pairs of blocks are
    packed together, about CHECK_PACK sets a pack, since most groups are small."""
    block = lambda n: F.ceil(F.col(n) / CHECK_BLOCK)
    shape = (
        tests.groupBy("group").agg(F.count("*").alias("n_left"))
        .join(groups.groupBy("group").agg(F.count("*").alias("n_right")), "group")
        .select("group", "n_left", "n_right", block("n_left").alias("lefts"), block("n_right").alias("rights"))
    )
    shape = staged(shape, "check-shape")
    rows = shape.agg(F.sum(F.col("n_left") * F.col("rights") + F.col("n_right") * F.col("lefts"))).first()[0] or 0
    packs = max(1, -(-rows // CHECK_PACK))
    dealt = lambda who, n: F.pmod(F.xxhash64(who), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    pack = F.pmod(F.xxhash64("group", "i", "j"), F.lit(packs))
    left = tests.join(shape, "group").select("group", F.col("node"), dealt("node", "lefts").alias("i"), every("rights").alias("j"))
    right = groups.join(shape, "group").select("group", F.col("member").alias("node"), dealt("member", "rights").alias("j"), "lefts").select(
        "group", "node", "j", every("lefts").alias("i")
    )
    left = left.withColumn("pack", pack).join(sets, "node")
    right = right.withColumn("pack", pack).join(sets, "node").select(
        *[F.col(c).alias(f"{c}_") for c in ("pack", "group", "i", "j", "node", "shingles")]
    )

    def check(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            others = b.groupby(["group_", "i_", "j_"]).indices
            for name, rows in a.groupby(["group", "i", "j"]).indices.items():
                if name in others:
                    found += _similar_pairs(a.iloc[rows], b.iloc[others[name]], percent)
        return pd.DataFrame(found, columns=["a", "b"]).astype({"a": "int64", "b": "int64"})

    return left.groupBy("pack").cogroup(right.groupBy("pack_")).applyInPandas(check, "a long, b long")


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """(node, group) for members of a bucket that may be similar to a member of another component of it.

    ``rows`` has (bucket, band, node, n, sign, bands, root, n_root). The smaller component's members are tested against
    the greater one, named by its root. Of the buckets that two members share only that of the first band compares them;
    which they share is told by the buckets' own 64-bit names, since equal low bytes are no shared bucket.
    """
    blocks = F.ceil(F.count("*") / F.lit(BUCKET_BLOCK))
    shaped = rows.join(rows.groupBy("bucket").agg(blocks.alias("blocks")), "bucket")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = shaped.withColumn("mine", mine).withColumn("other", other).select(
        "bucket", "band", "node", "n", "sign", "bands", "root", "n_root",
        F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_root", "root", "node"]).reset_index(drop=True)
        signs = np.frombuffer(b"".join(frame["sign"]), np.uint8).reshape(len(frame), HASHES)
        n, root = frame["n"].to_numpy(), frame["root"].to_numpy()
        node, band = frame["node"].to_numpy(), int(frame["band"].iloc[0])
        earlier = np.stack(frame["bands"].to_numpy())[:, :band]
        after = np.flatnonzero(np.diff(root, append=root[-1] + 1)) + 1  # where the next component begins
        ends = np.repeat(after, np.diff(after, prepend=0))
        found = set()
        for x in range(len(frame)):
            rest = slice(ends[x], len(frame))
            fit = percent * np.maximum(n[rest], n[x]) <= 100 * np.minimum(n[rest], n[x])
            if fit.any():
                which = ends[x] + np.flatnonzero(fit)
                near = which[(signs[which] == signs[x]).mean(1) >= ESTIMATE]
                near = near[~(earlier[near] == earlier[x]).any(1)]
                found.update((int(node[x]), int(r)) for r in np.unique(root[near]))
        return pd.DataFrame(sorted(found), columns=["node", "group"]).astype({"node": "int64", "group": "int64"})

    return dealt.groupBy("bucket", "i", "j").applyInPandas(compare, "node long, group long").distinct()


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included) and kept, per row."""
    signed = staged(signatures(documents, size), "signatures")
    nodes = staged(
        signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_id").agg(
            F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sign").alias("sign")
        ), "nodes",
    )
    placed = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("size")).filter("size > 1")
    members = staged(placed.join(shared, "bucket").select("bucket", "band", "first", "node"), "members")

    described = nodes.select("node", "n", "sign")
    a = described.select(F.col("node").alias("first"), F.col("n").alias("n_a"), F.col("sign").alias("sign_a"))
    b = described.select("node", F.col("n").alias("n_b"), F.col("sign").alias("sign_b"))
    pairs = members.filter("node != first").select("first", "node").distinct().join(a, "first").join(b, "node")
    sets = staged(_sets_of(documents, members.select("node").distinct(), size), "sets")
    tests = staged(_possible(pairs, percent).select("node", F.col("first").alias("group")), "tests")
    links = staged(_confirmed(tests, tests.select("group", F.col("group").alias("member")).distinct(), sets, percent), "confirmed")

    roots = components(links)
    rooted = members.join(roots, "node", "left").select("bucket", "band", "node", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least != most")
    sizes = rooted.select("node", "root").distinct().groupBy("root").agg(F.count("*").alias("n_root"))
    sizes = staged(sizes, "sizes")  # so a large component's join can split
    rows = rooted.join(several.select("bucket"), "bucket", "left_semi").join(sizes, "root").join(nodes.select("node", "n", "sign", "bands"), "node")
    more = staged(_across(rows, percent), "across")
    grouped = rooted.select(F.col("root").alias("group"), F.col("node").alias("member")).distinct()
    grouped = grouped.join(more.select("group").distinct(), "group", "left_semi")
    late = staged(_confirmed(more, grouped, sets, percent), "confirmed-late")
    roots = staged(components(links.unionByName(late)), "roots")

    named = nodes.select("set_id", "node").join(roots, "node", "left").select("set_id", F.coalesce("root", "node").alias("component"))
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_id"))
    return (
        signed.withColumn("key", own).join(named.withColumnRenamed("set_id", "key"), "key", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def without_copies(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which each component of near copies keeps the one with its smallest doc_id, with all columns.

    Rows that repeat a kept doc_id all stay.
    """
    dropped = near_duplicates(documents, size, percent).filter("NOT kept").select("doc_id").distinct()
    return documents.join(dropped, "doc_id", "left_anti").select(*documents.columns)
