"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed from left to right into phrases, each the shortest run of characters that is not in the dictionary yet,
which it then enters. The set of phrases is hashed and sketched by minimum hashes: the hash's top bits choose one of
``BINS`` bins, the least of the rest stays. Likeness is the share of equal bins among those that either sketch fills, an
estimate of the phrase sets' Jaccard similarity.

``next_documents`` brings each document and its successor into one task with a single shuffle of compressed texts: the
first ids of range partitions bound the blocks, and the first document of a block is also sent to the block before.

Defined results: null and empty texts have an empty phrase set, whose fingerprint is all "-"; two such are alike by 1,
one such and another by 0. Rows of equal doc_id have a fixed order of their own; null ids come first, and the successor of
the last document is the one with the smallest id. An only document is its own successor. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrispark.llm.staging import parts_for

BINS = 128
EMPTY = "-" * 4
ROWS_PER_PART = 20_000
BLOCKS_PER_PART = 4


def parse(text: str, seen: set[str], phrase: str = "") -> str:
    """Adds the phrases of a text to ``seen``, going on from an unfinished phrase; returns what is left unfinished."""
    add = seen.add
    for c in text:
        phrase += c
        if phrase not in seen:
            add(phrase)
            phrase = ""
    return phrase


def sketch(seen: set[str], rest: str = "") -> np.ndarray:
    """Minimum hashes of a phrase set and an unfinished last phrase; -1 marks an empty bin."""
    out = np.full(BINS, -1, np.int64)
    words = list(seen)
    if rest:
        words.append(rest)
    if words:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        hashes.sort()
        bins = (hashes >> np.uint64(57)).astype(np.int64)
        filled, first = np.unique(bins, return_index=True)
        out[filled] = ((hashes[first] >> np.uint64(25)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return out


def shown(minima: np.ndarray) -> str:
    """A sketch as text: four hexadecimal digits a bin, folded from the minimum hash."""
    return "".join(EMPTY if m < 0 else f"{(m ^ (m >> 16)) & 0xFFFF:04x}" for m in minima.tolist())


def likeness(a: str, b: str) -> float:
    """Share of equal bins of two fingerprints among the bins that either fills; 1 if neither fills any."""
    if a == b:
        return 1.0
    pairs = [(a[i:i + 4], b[i:i + 4]) for i in range(0, 4 * BINS, 4)]
    filled = [x == y for x, y in pairs if x != EMPTY or y != EMPTY]
    return sum(filled) / len(filled)


def fingerprint(text: str) -> str:
    seen: set[str] = set()
    return shown(sketch(seen, parse(text, seen)))


def fingerprints(frame: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of a text column."""
    @F.pandas_udf("string")
    def of(column):
        return column.fillna("").map(fingerprint)

    return frame.withColumn(name, of(F.col(text)))


def with_edited(text: str, follower: str) -> tuple[str, str, str]:
    """Fingerprint of a text, and the text and fingerprint whose last quarter the follower's start replaces.

    The two parses are one up to the cut.
    """
    quarter = len(text) // 4
    kept, tail, new = text[:len(text) - quarter], text[len(text) - quarter:], follower[:quarter]
    seen: set[str] = set()
    phrase = parse(kept, seen)
    other = set(seen)
    own = shown(sketch(seen, parse(tail, seen, phrase)))
    return own, kept + new, shown(sketch(other, parse(new, other, phrase)))


def next_documents(documents: DataFrame) -> DataFrame:
    """Rows (block, doc_id, tail, packed) sorted within partitions: every block's documents by ascending id and last,
    as ``tail``, the document that follows the block. ``packed`` is the compressed text."""
    spark = documents.sparkSession
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.count()
    parts = parts_for(spark, n, ROWS_PER_PART)
    firsts = sorted(
        r[0] for r in ids.filter("doc_id IS NOT NULL").repartitionByRange(parts * BLOCKS_PER_PART, "doc_id")
        .groupBy(F.spark_partition_id()).agg(F.min("doc_id")).select("min(doc_id)").collect()
    )  # one number per block of rows
    bounds = np.array(firsts[1:], np.int64)
    start = firsts[0] if firsts else None

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.slice(at, 256)
                out = []
                for doc_id, text in zip(rows["doc_id"].to_pylist(), rows["text"]):
                    data = squeeze(text.as_py() or b"")
                    block = 0 if doc_id is None else int(np.searchsorted(bounds, doc_id, "right"))
                    out.append((block, doc_id, False, data))
                    if doc_id is not None and block and doc_id == firsts[block]:
                        out.append((block - 1, doc_id, True, data))
                    if doc_id == start and doc_id is not None:
                        out.append((len(bounds), doc_id, True, data))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.binary())],
                    ["block", "doc_id", "tail", "packed"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return (
        rows.mapInArrow(packed, "block int, doc_id long, tail boolean, packed binary")
        .repartition(parts, "block").sortWithinPartitions("block", "tail", F.col("doc_id").asc_nulls_first(), "packed")
    )


def fingerprint_pairs(documents: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness and the next document's."""
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    fields = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held: list = []  # the document whose successor is still to come, as (block, doc_id, text)
        waiting: list = []  # its row, complete but for the likeness to the next
        out: list = []

        def rows_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], fields)

        last_tail = -1
        for batch in batches:
            for block, doc_id, tail, data in zip(*(batch[c] for c in ("block", "doc_id", "tail", "packed"))):
                block, doc_id, tail = block.as_py(), doc_id.as_py(), tail.as_py()
                if tail and last_tail == block:
                    continue  # equal ids begin the next block: the first of them is the successor
                last_tail = block if tail else -1
                text = unpack(data.as_py()).decode("utf-8", "replace")
                if held:
                    own, edited, new = with_edited(held[1], text)
                    row = [held[0], len(held[1]), hashlib.sha256(edited.encode()).hexdigest(), own, new, likeness(own, new), None]
                    if waiting:
                        waiting[0][6] = likeness(waiting[0][3], own)
                        out.append(waiting.pop())
                    if tail:
                        row[6] = likeness(own, fingerprint(text))
                        out.append(row)
                    else:
                        waiting = [row]
                held = [] if tail else [doc_id, text]
                if len(out) >= 512:
                    yield rows_of(out)
                    out = []
        if held:  # only if no id bounds a block: every id is null
            own, edited, new = with_edited(held[1], held[1])
            if waiting:
                waiting[0][6] = likeness(waiting[0][3], own)
                out.append(waiting.pop())
            out.append([held[0], len(held[1]), hashlib.sha256(edited.encode()).hexdigest(), own, new, likeness(own, new), 1.0])
        if out:
            yield rows_of(out)

    return next_documents(documents).mapInArrow(compared, schema)
