"""Removal of word sequences that repeat across documents, by prefix-partitioned suffix trees.

A window of ``WINDOW`` words goes if the same words also start a window of a document with a smaller doc_id.

Suffixes are partitioned by prefixes. Of every window's runs of ``PREFIX`` words the one with the least hash is its
anchor, so equal windows have equal anchors at equal places, and a few per cent of a text's positions are anchors. The
suffixes around an anchor go to the partition that its run of words names; a prefix that only one document has is
dropped, since nothing below it can repeat. Prefixes that keep up to ``HEAVY`` suffixes, counted with every repetition
within a document, and ``HEAVY_WORDS`` words are packed into groups that fit in memory, and
each group's subtree is built by naming ever longer words (1, 2, 4 ... ``WINDOW``), which sorts its suffixes; leaves that
share a node of depth ``WINDOW`` are its deep repeats. A heavier prefix is lengthened to the full depth at once: its
nodes are then named by 128-bit hashes, the smallest document per node is combined before the shuffle, and no group
meets in one task.

Documents with equal words are handled by their first copy; of the others every window repeats.

Defined results: null and empty texts have no words and lose none; rows without a doc_id keep all their words and cause no
losses; rows that repeat a doc_id are not smaller than each other, so neither takes from the other; extra columns pass
through ``without_repeats``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrispark.llm.staging import staged
from agrispark.llm.words import WordHashes, mixed, texts_of

WINDOW = 50
PREFIX = 8
HEAVY = 4096  # suffixes of a prefix up to which its subtree is built in memory
HEAVY_WORDS = 1 << 19  # words of a prefix's suffixes up to which
GROUP = 8192  # suffixes that a group of prefixes holds, about
GROUP_WORDS = 1 << 20  # and words
FLUSH = 4096  # rows of suffixes that a batch holds
NOTHING = hashlib.sha256(b"").hexdigest()


def runs(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = len(words) - size + 1
    out = np.full(max(n, 0), np.uint64(seed + size))
    for k in range(size if n > 0 else 0):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n])
    return out


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every anchor, first window that has it, and the number of such windows, all following one another."""
    if len(words) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = runs(words, PREFIX)
    views = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW - PREFIX + 1)
    at = np.concatenate([views[i:i + 4096].argmin(1) + np.arange(i, min(i + 4096, len(views))) for i in range(0, len(views), 4096)])
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return hashes[at[first]], first, np.diff(first, append=len(at))


def deep_nodes(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The node of depth ``WINDOW`` under which the suffix at each start lies: equal exactly for equal words.

    Names of length 2k follow from pairs of names of length k; names are ranks, so their order is that of the suffixes.
    """
    names = np.unique(words, return_inverse=True)[1].astype(np.int64)
    length, n = 1, len(words)
    while length < WINDOW:
        step = min(length, WINDOW - length)
        pairs = names[:n - step] * (int(names.max()) + 1) + names[step:]
        names = np.concatenate([np.unique(pairs, return_inverse=True)[1].astype(np.int64), names[n - step:]])
        length += step
    return names[starts]


def _packed(documents: DataFrame) -> DataFrame:
    """doc_id, tag (hash of the text) and compressed text: what travels when texts must be shuffled."""
    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for at in range(0, len(batch), 512):
                rows = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], rows["tag"], pa.array([compress(t.as_py() or b"") for t in rows["text"]], pa.binary())],
                    ["doc_id", "tag", "packed"],
                )

    return _plain(documents).filter("doc_id IS NOT NULL").mapInArrow(squeeze, "doc_id long, tag long, packed binary")


def _plain(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.col("text").cast("binary").alias("text")
    )


def _outlines(documents: DataFrame) -> DataFrame:
    """doc_id, tag, n_words, sequence (name of all its words), whole_sha256 and the distinct anchors of every document,
    with the suffixes of each and the words that these cover."""
    def counted(words: np.ndarray) -> list[dict]:
        found, _, windows = anchors(words)
        names, which, times = np.unique(found, return_inverse=True, return_counts=True)
        covered = np.bincount(which, weights=windows + WINDOW - 1, minlength=len(names)).astype(np.int64)
        return [{"anchor": a, "times": n, "words": w} for a, n, w in zip(names.view(np.int64).tolist(), times.tolist(), covered.tolist())]

    def outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(seed=17, lower=False)
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows = batch.slice(at, 500)
                data, offsets = texts_of(rows["text"])
                words, first = hashes.of(data, offsets)
                own = [words[i:j] for i, j in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([
                    rows["doc_id"], rows["tag"], pa.array([len(w) for w in own], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(w.tobytes()) for w in own], pa.binary()),
                    pa.array([hashlib.sha256(b" ".join(data[a:b].tobytes().split())).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]),
                    pa.array([counted(w) for w in own], pa.list_(pa.struct([("anchor", pa.int64()), ("times", pa.int64()), ("words", pa.int64())]))),
                ], ["doc_id", "tag", "n_words", "sequence", "whole_sha256", "anchors"])

    return _plain(documents).mapInArrow(
        outlined, "doc_id long, tag long, n_words long, sequence binary, whole_sha256 string, "
        "anchors array<struct<anchor: long, times: long, words: long>>"
    )


_SUFFIXES = (
    "doc_id long, tag long, anchor long, start int, windows int, words binary, node_a long, node_b long, starts array<int>"
)


def _suffixes(chosen: DataFrame) -> DataFrame:
    """Rows of ``chosen`` (doc_id, tag, packed, light, heavy: shared anchors) -> one row for each occurrence of a light
    anchor, with the words that its windows cover, and one for each distinct window of the heavy ones, with its starts."""
    names = [f.split()[0] for f in _SUFFIXES.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unpack = WordHashes(seed=17, lower=False), zstandard.ZstdDecompressor().decompress
        rows: list[tuple] = []
        full = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        for batch in batches:
            for doc_id, tag, packed, light, heavy in zip(*(batch[c] for c in ("doc_id", "tag", "packed", "light", "heavy"))):
                data = np.frombuffer(unpack(packed.as_py()), np.uint8)
                words, _ = hashes.of(data, np.array([0, len(data)]))
                found, first, count = anchors(words)
                key = doc_id.as_py(), tag.as_py()
                marks = found.view(np.int64)
                for k in np.flatnonzero(np.isin(marks, np.array(light.as_py() or [], np.int64))):
                    span = words[first[k]:first[k] + count[k] + WINDOW - 1]
                    rows.append((*key, int(marks[k]), int(first[k]), int(count[k]), span.tobytes(), None, None, None))
                    if len(rows) >= FLUSH:
                        yield full()
                        rows = []
                if heavy.as_py():
                    some = np.flatnonzero(np.isin(marks, np.array(heavy.as_py(), np.int64)))
                    starts = np.concatenate([np.arange(first[k], first[k] + count[k]) for k in some])
                    a, b = runs(words, WINDOW)[starts], runs(words, WINDOW, 1 << 20)[starts]
                    order = np.lexsort((starts, b, a))
                    a, b, starts = a[order].view(np.int64), b[order].view(np.int64), starts[order]
                    cuts = np.flatnonzero(np.diff(a, prepend=a[0] - 1) | np.diff(b, prepend=b[0] - 1))
                    for i, j in zip(cuts, np.append(cuts[1:], len(a))):
                        rows.append((*key, None, None, None, None, int(a[i]), int(b[i]), starts[i:j].tolist()))
                        if len(rows) >= FLUSH:
                            yield full()
                            rows = []
        if rows:
            yield full()

    return chosen.mapInArrow(collected, _SUFFIXES)


def _subtree(frame: pd.DataFrame) -> pd.DataFrame:
    """Starts of the windows of a group of suffixes that a smaller document also has."""
    spans = [np.frombuffer(w, np.uint64) for w in frame["words"]]
    windows = frame["windows"].to_numpy(np.int64)
    base = np.concatenate([[0], np.cumsum([len(s) for s in spans])[:-1]])
    member = np.repeat(np.arange(len(spans)), windows)
    place = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    nodes = deep_nodes(np.concatenate(spans), base[member] + place)
    docs = frame["doc_id"].to_numpy(np.int64)
    least = np.full(int(nodes.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, nodes, docs[member])
    repeated = np.flatnonzero(docs[member] > least[nodes])
    starts = frame["start"].to_numpy(np.int64)[member[repeated]] + place[repeated]
    cuts = np.flatnonzero(np.diff(member[repeated], prepend=-1))
    owner = member[repeated][cuts]
    return pd.DataFrame({
        "doc_id": docs[owner], "tag": frame["tag"].to_numpy(np.int64)[owner],
        "starts": [s.astype(np.int32) for s in np.split(starts, cuts[1:])] if len(cuts) else [],
    })


def _shared_prefixes(outlines: DataFrame) -> DataFrame:
    """(anchor, is_heavy) of the prefixes that several documents have; all their suffixes count, within documents too."""
    return (
        outlines.filter("NOT copy AND doc_id IS NOT NULL").select("doc_id", F.inline("anchors")).groupBy("anchor")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.sum("times").alias("n"), F.sum("words").alias("n_words"))
        .filter("least < most").select("anchor", ((F.col("n") > HEAVY) | (F.col("n_words") > HEAVY_WORDS)).alias("is_heavy"))
    )


def repeated_windows(documents: DataFrame, outlines: DataFrame) -> DataFrame:
    """(doc_id, tag, starts) of the repeated windows of documents whose words no smaller document has as a whole."""
    shared = staged(_shared_prefixes(outlines), "shared-prefixes")
    per_document = (
        outlines.filter("NOT copy AND doc_id IS NOT NULL").select("doc_id", "tag", F.explode("anchors.anchor").alias("anchor")).join(shared, "anchor")
        .groupBy("doc_id", "tag").agg(
            F.collect_list(F.when(~F.col("is_heavy"), F.col("anchor"))).alias("light"),
            F.collect_list(F.when(F.col("is_heavy"), F.col("anchor"))).alias("heavy"),
        )
    )
    suffixes = staged(_suffixes(_packed(documents).join(per_document, ["doc_id", "tag"])), "suffixes")
    light = suffixes.filter("anchor IS NOT NULL").select("doc_id", "tag", "anchor", "start", "windows", "words")
    held = light.agg(F.count("*").alias("n"), F.sum(F.col("windows") + F.lit(WINDOW - 1)).alias("n_words")).first()
    groups = max(1, -(-held["n"] // GROUP), -(-(held["n_words"] or 0) // GROUP_WORDS))
    trees = (
        light.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups))).groupBy("group")
        .applyInPandas(lambda key, frame: _subtree(frame), "doc_id long, tag long, starts array<int>")
    )
    nodes = suffixes.filter("anchor IS NULL").select("doc_id", "tag", "node_a", "node_b", "starts")
    least = staged(nodes.groupBy("node_a", "node_b").agg(F.min("doc_id").alias("least")), "least")  # so a hot node's join can split
    deep = nodes.join(least, ["node_a", "node_b"]).filter("doc_id > least").select("doc_id", "tag", "starts")
    return trees.unionByName(deep)


def removals(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, tag, n_words, n_removed and kept_sha256 of every row, and ``kept``, the words left joined by
    one space, of those that lose some, if asked for."""
    outlined = staged(_outlines(documents), "outlines")
    named = outlined.groupBy("sequence").agg(F.min("doc_id").alias("least"))
    outlines = staged(
        outlined.join(named, "sequence").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)) & (F.col("n_words") >= WINDOW))
        .drop("sequence", "least"), "copies",
    )
    marks = repeated_windows(documents, outlines).groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("starts")).alias("starts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for doc_id, tag, packed, starts in zip(*(batch[c] for c in ("doc_id", "tag", "packed", "starts"))):
                words = unpack(packed.as_py()).split()
                edges = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.array(starts.as_py(), np.int64))
                edges[at] += 1
                np.add.at(edges, at + WINDOW, -1)
                gone = np.cumsum(edges[:-1]) > 0
                kept = b" ".join([words[i] for i in np.flatnonzero(~gone)])
                rows.append((doc_id.as_py(), tag.as_py(), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                    ["doc_id", "tag", "removed", "sha256", "kept"],
                )

    changed = (
        _packed(documents).join(marks, ["doc_id", "tag"])
        .mapInArrow(cut, "doc_id long, tag long, removed long, sha256 string, kept string").dropDuplicates(["doc_id", "tag"])
    )
    gone = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0)))
    sha = F.when(F.col("copy"), F.lit(NOTHING)).otherwise(F.coalesce("sha256", "whole_sha256"))
    return outlines.join(changed, ["doc_id", "tag"], "left").select(
        "doc_id", "tag", "n_words", gone.alias("n_removed"), sha.alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents without their repeated words; a document that lost all its words goes, one that lost none is unchanged.

    A column ``n_chars`` is set to the new text's length.
    """
    lost = removals(documents, with_text=True).filter("n_removed > 0").select(
        F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), (F.col("n_removed") == F.col("n_words")).alias("_all"), F.col("kept").alias("_kept")
    ).dropDuplicates(["_id", "_tag"])
    rows = documents.select(F.struct("*").alias("row"), F.xxhash64("text").alias("key"))
    joined = rows.join(lost, (F.col("row.doc_id") == F.col("_id")) & (F.col("key") == F.col("_tag")), "left")
    new = {"text": F.coalesce("_kept", "row.text")}
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("_kept").isNotNull(), F.length("_kept").cast(kind)).otherwise(F.col("row.n_chars"))
    return joined.filter("_all IS NULL OR NOT _all").select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns])
